"""The driver's entry works on its own, also without the training-data subpackage."""

import builtins
import importlib
import sys

import duckdb
import pytest

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_entry_has_rows_and_a_stable_schema(spark):
    import __spark_entry__ as e

    out = e.entry(spark)
    assert out.columns[0] == "doc_id" and out.count() > 0


def test_every_oracle_belongs_to_a_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_imports_without_the_subpackage_or_the_pipeline(monkeypatch):
    real = builtins.__import__

    def without(name, globals=None, locals=None, fromlist=(), level=0):
        if name.startswith("textloom.llm") or name == "corpus_pipeline" or (name == "textloom" and "llm" in (fromlist or ())):
            raise ImportError(name)
        return real(name, globals, locals, fromlist, level)

    for m in [m for m in sys.modules if m.startswith("textloom.llm") or m in ("corpus_pipeline", "__spark_entry__")]:
        monkeypatch.delitem(sys.modules, m)
    monkeypatch.setattr(builtins, "__import__", without)
    e = importlib.import_module("__spark_entry__")
    assert "feature_vector" in e.queries() and not any(q.startswith("op") or q == "pipeline" for q in e.queries())


@pytest.mark.parametrize("name", ["doc_statistical_features", "pmi_vocabulary", "raw_normalized", "audit_scalars", "manifest_stats", "lineage_groups", "split_assignment", "pilot_join_mismatches", "token_length_by_label", "roc_auc"])
def test_queries_agree_with_their_sql(spark, name):
    from textloom.plans.catalogue import ORACLE, QUERIES

    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = QUERIES[name](spark, SF)
    want = db.sql(ORACLE[name])
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    plain = lambda rows: sorted(tuple(f"{v:.6f}" if isinstance(v, float) else str(v) for v in r) for r in rows)
    assert plain(got.select(*cols).collect()) == plain(db.sql(f"select {', '.join(cols)} from ({ORACLE[name]})").fetchall())
