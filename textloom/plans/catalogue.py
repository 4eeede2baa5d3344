"""All queries of the reference's own operators, by name, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.stable import hash_bucket, stable_rank
from textloom.functions.text import words
from textloom.operators import audit, evaluation, features, ingest, manifest, pilot, pilot_join, splits, tokenizer_audit, vocabulary
from textloom.plans.adapters import labelled, raw_rows, table, turns
from textloom.session import materialise, new_path
from textloom.sources import readers, writers
from textloom.sources.writers import shard_counts

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL if there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# Pieces of SQL that several oracles share.
_RUNS = r"regexp_extract_all(lower({t}), '[\p{{L}}\p{{N}}_]+')"
_WORDS3 = "list_filter(" + _RUNS + ", lambda w: regexp_full_match(w, '[a-z]{{3,}}'))"
_WORDS1 = "list_filter(" + _RUNS + ", lambda w: regexp_full_match(w, '[a-z]+'))"
_RAW = """raw AS (SELECT doc_id, 'doc-' || lpad(CAST(doc_id AS VARCHAR), 8, '0') AS id, 'S' || CAST(doc_id // 4 AS VARCHAR) AS source_id,
  'A' || substr(sha256(substr(text, 1, 64)), 1, 16) AS adv_source_id,
  (['human', 'gpt2', 'mistral', 'mpt-chat'])[CAST(doc_id % 4 AS INT) + 1] AS model,
  CASE WHEN doc_id % 4 = 0 THEN NULL WHEN (doc_id // 4) % 2 = 0 THEN 'greedy' ELSE 'sampling' END AS decoding,
  CASE WHEN doc_id % 4 = 0 THEN NULL WHEN (doc_id // 4) % 2 = 0 THEN '1.0' ELSE '1.2' END AS repetition_penalty,
  (['none', 'whitespace', 'upper_lower', 'synonym', NULL])[CAST((doc_id % 20) // 4 AS INT) + 1] AS attack,
  lang AS domain, text AS generation FROM documents)"""
_BLANK = r"NOT regexp_matches(coalesce(generation, ''), '[^\s\p{Z}]')"
_RECORDS = _RAW + f""",
records AS (SELECT doc_id, id AS record_id, generation AS text, CASE WHEN model = 'human' THEN 0 ELSE 1 END AS label, source_id, adv_source_id, model,
  decoding, repetition_penalty, coalesce(attack, 'none') AS attack, coalesce(domain, 'unknown') AS domain,
  length(generation) AS text_length, sha256(generation) AS text_hash FROM raw WHERE NOT ({_BLANK}))"""
_KEPT = _RECORDS + """,
marked AS (SELECT *, row_number() OVER (PARTITION BY text_hash ORDER BY record_id) AS rn, min(label) OVER (PARTITION BY text_hash) AS lo, max(label) OVER (PARTITION BY text_hash) AS hi FROM records),
kept AS (SELECT * EXCLUDE (rn, lo, hi) FROM marked WHERE rn = 1 AND lo = hi)"""
_GROUPED = _KEPT + """,
edges AS (SELECT DISTINCT 'source:' || source_id AS a, 'adv:' || adv_source_id AS b FROM kept),
arcs AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach AS (SELECT a AS v, a AS r FROM arcs UNION SELECT arcs.b, reach.r FROM reach JOIN arcs ON arcs.a = reach.v),
comp AS (SELECT v, min(r) AS c FROM reach GROUP BY v),
grouped AS (SELECT kept.*, 'group-' || substr(sha256(c), 1, 16) AS group_id FROM kept JOIN comp ON comp.v = 'source:' || kept.source_id)"""
_STATS = _GROUPED + """,
stats AS (SELECT group_id, count(*) AS size, count(*) FILTER (label = 0) AS human, count(*) FILTER (label = 1) AS ai FROM grouped GROUP BY group_id)"""
_COST = "abs({s}n + g.size - t.n{r}) / greatest(t.n{r}, 1) + 2 * (abs({s}h + g.human - t.h{r}) / greatest(t.h{r}, 1) + abs({s}a + g.ai - t.a{r}) / greatest(t.a{r}, 1)) - 3 * (CASE WHEN {s}h = 0 AND g.human > 0 THEN 1 ELSE 0 END + CASE WHEN {s}a = 0 AND g.ai > 0 THEN 1 ELSE 0 END)"
_OPEN = "abs(size - t.n{r}) / greatest(t.n{r}, 1) + abs(human - t.h{r}) / greatest(t.h{r}, 1) + abs(ai - t.a{r}) / greatest(t.a{r}, 1)"
_ASSIGNED = _STATS + f""",
t AS (SELECT sum(size) * 0.8::DOUBLE AS n8, sum(human) * 0.8::DOUBLE AS h8, sum(ai) * 0.8::DOUBLE AS a8, sum(size) * 0.1::DOUBLE AS n1, sum(human) * 0.1::DOUBLE AS h1, sum(ai) * 0.1::DOUBLE AS a1 FROM stats),
o1 AS (SELECT stats.* FROM stats, t ORDER BY {_OPEN.format(r=8)}, group_id LIMIT 1),
o2 AS (SELECT stats.* FROM stats, t WHERE group_id NOT IN (SELECT group_id FROM o1) ORDER BY {_OPEN.format(r=1)}, group_id LIMIT 1),
o3 AS (SELECT stats.* FROM stats, t WHERE group_id NOT IN (SELECT group_id FROM o1 UNION ALL SELECT group_id FROM o2) ORDER BY {_OPEN.format(r=1)}, group_id LIMIT 1),
ordered AS (SELECT *, row_number() OVER (ORDER BY size DESC, sha256('42:' || group_id)) AS k FROM stats
  WHERE group_id NOT IN (SELECT group_id FROM o1 UNION ALL SELECT group_id FROM o2 UNION ALL SELECT group_id FROM o3)),
walk AS (SELECT 0::BIGINT AS k, ''::VARCHAR AS group_id, ''::VARCHAR AS split, o1.size::BIGINT AS xn, o1.human::BIGINT AS xh, o1.ai::BIGINT AS xa, o2.size::BIGINT AS yn, o2.human::BIGINT AS yh, o2.ai::BIGINT AS ya, o3.size::BIGINT AS zn, o3.human::BIGINT AS zh, o3.ai::BIGINT AS za FROM o1, o2, o3
 UNION ALL
 SELECT k, group_id, s, xn + CASE WHEN s = 'train' THEN size ELSE 0 END, xh + CASE WHEN s = 'train' THEN human ELSE 0 END, xa + CASE WHEN s = 'train' THEN ai ELSE 0 END,
  yn + CASE WHEN s = 'validation' THEN size ELSE 0 END, yh + CASE WHEN s = 'validation' THEN human ELSE 0 END, ya + CASE WHEN s = 'validation' THEN ai ELSE 0 END,
  zn + CASE WHEN s = 'test' THEN size ELSE 0 END, zh + CASE WHEN s = 'test' THEN human ELSE 0 END, za + CASE WHEN s = 'test' THEN ai ELSE 0 END
 FROM (SELECT *, CASE WHEN cz <= cx AND cz <= cy THEN 'test' WHEN cx <= cy THEN 'train' ELSE 'validation' END AS s FROM (
  SELECT g.k, g.group_id, g.size, g.human, g.ai, w.xn, w.xh, w.xa, w.yn, w.yh, w.ya, w.zn, w.zh, w.za,
   {_COST.format(s="w.x", r=8)} AS cx, {_COST.format(s="w.y", r=1)} AS cy, {_COST.format(s="w.z", r=1)} AS cz
  FROM walk w JOIN ordered g ON g.k = w.k + 1, t))),
assigned AS (SELECT group_id, split FROM walk WHERE k > 0 UNION ALL SELECT group_id, 'train' FROM o1 UNION ALL SELECT group_id, 'validation' FROM o2 UNION ALL SELECT group_id, 'test' FROM o3),
split_rows AS (SELECT grouped.*, split FROM grouped JOIN assigned USING (group_id))"""

# The pilot: groups by the least cost until the human rows reach the goal, then AI rows that cover new kinds first.
_PICKED = _ASSIGNED + """,
train AS (SELECT *, ['model ' || coalesce(nullif(model, ''), 'unknown'), 'domain ' || coalesce(nullif(domain, ''), 'unknown'), 'attack ' || coalesce(nullif(attack, ''), 'none')] AS cover FROM split_rows WHERE split = 'train'),
goal AS (SELECT CAST(least(round_even(least(10000, count(*)) * 0.5::DOUBLE, 0), count(*) FILTER (label = 0)) AS BIGINT) AS want FROM train),
choice AS (SELECT group_id, count(*) FILTER (label = 0) AS human, list_distinct(flatten(list(cover))) AS cover FROM train GROUP BY group_id HAVING count(*) FILTER (label = 0) > 0),
pick AS (SELECT 0::BIGINT AS k, ''::VARCHAR AS group_id, 0::BIGINT AS have, []::VARCHAR[] AS covered, []::VARCHAR[] AS taken
 UNION ALL
 SELECT k + 1, group_id, have + human, list_distinct(list_concat(covered, cover)), list_append(taken, group_id)
 FROM (SELECT p.k, g.group_id, p.have, g.human, p.covered, g.cover, p.taken FROM pick p, choice g, goal WHERE p.have < want AND NOT list_contains(p.taken, g.group_id)
  ORDER BY abs(p.have + g.human - want) / greatest(want, 1) + 3 * greatest(0, p.have + g.human - want) / greatest(want, 1) - 0.03::DOUBLE * len(list_filter(g.cover, lambda x: NOT list_contains(p.covered, x))), g.group_id LIMIT 1))"""
_SAMPLED = _PICKED + """,
chosen AS (SELECT record_id, group_id, label, cover, sha256('43:' || record_id) AS r FROM train WHERE group_id IN (SELECT group_id FROM pick WHERE k > 0)),
size AS (SELECT count(*) FILTER (label = 0) AS n FROM chosen),
heads AS (SELECT cover, min(r) AS r, arg_min(record_id, r) AS record_id FROM chosen WHERE label = 1 GROUP BY cover),
seek AS (SELECT 0::BIGINT AS k, ''::VARCHAR AS record_id, (SELECT list_distinct(flatten(list(cover))) FROM heads) AS missing
 UNION ALL
 SELECT k + 1, record_id, list_filter(missing, lambda x: NOT list_contains(cover, x))
 FROM (SELECT s.k, h.record_id, h.cover, s.missing FROM seek s, heads h, size WHERE len(s.missing) > 0 AND s.k < n
  ORDER BY len(list_filter(h.cover, lambda x: list_contains(s.missing, x))) DESC, h.r LIMIT 1)),
ranked AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN record_id IN (SELECT record_id FROM seek) THEN 0 ELSE 1 END, r) AS place FROM chosen WHERE label = 1)"""


# --- features -------------------------------------------------------------------------------------------------------

_SENT = r"""s AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '[.!?]+(?:[\s\p{Z}]+|$)'), lambda x: len(""" + _WORDS1.format(t="x") + r""")), lambda n: n > 0) AS n FROM documents),
b AS (SELECT doc_id, CASE WHEN len(n) < 2 THEN 0.0 ELSE list_aggregate(n, 'stddev_pop') / list_avg(n) END AS burstiness FROM s),
w AS (SELECT doc_id, unnest(""" + _WORDS1.format(t="coalesce(text, '')") + r""") AS word FROM documents),
c AS (SELECT doc_id, word, count(*) AS c FROM w GROUP BY ALL),
e AS (SELECT doc_id, count(*) AS d, sum(c) AS n, sum(c * log2(c)) AS t FROM c GROUP BY doc_id),
stat AS (SELECT doc_id, round(burstiness, 6) AS burstiness, round(coalesce(d / sqrt(n), 0.0), 6) AS rttr, round(coalesce(greatest(log2(n) - t / n, 0.0), 0.0), 6) AS entropy FROM b LEFT JOIN e USING (doc_id))"""
_VOCAB = """t AS (SELECT CASE WHEN role = 'user' THEN 0 ELSE 1 END AS y, unnest(""" + _WORDS3.format(t="text") + """) AS word FROM conversations),
c2 AS (SELECT word, count(*) FILTER (y = 0) AS h, count(*) FILTER (y = 1) AS a FROM t GROUP BY word),
tot AS (SELECT sum(h) AS sh, sum(a) AS sa, count(*) AS v FROM c2),
vocab AS (SELECT * FROM (SELECT word, log2(((a + 1) / (sa + v)) / ((h + 1) / (sh + v))) AS weight FROM c2, tot WHERE h + a >= 5 ORDER BY round(weight, 9) DESC, word LIMIT 500) WHERE weight > 0)"""
_SCORE = """dw AS (SELECT doc_id, unnest(""" + _WORDS3.format(t="coalesce(text, '')") + """) AS word FROM documents),
sc AS (SELECT doc_id, sum(coalesce(weight, 0)) / count(*) AS p FROM dw LEFT JOIN vocab USING (word) GROUP BY doc_id),
score AS (SELECT doc_id, round(coalesce(p, 0.0), 6) AS pmi_score FROM documents LEFT JOIN sc USING (doc_id))"""


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in names})


def _vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary.fit(turns(spark, sf_dir), min_freq=5, top_k=500)


@query("WITH " + _SENT + " SELECT * FROM stat")
def doc_statistical_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return _rounded(features.statistical(docs).drop("text"), "burstiness", "rttr", "entropy")


@query("SELECT doc_id, CAST(len(" + _WORDS1.format(t="coalesce(text, '')") + ") AS INT) AS words, CAST(len(" + _WORDS3.format(t="coalesce(text, '')") + ") AS INT) AS long_words FROM documents")
def doc_word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(words(text)).alias("words"), F.size(words(text, 3)).alias("long_words"))


@query("WITH " + _VOCAB + " SELECT word, round(weight, 6) AS weight FROM vocab")
def pmi_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_vocabulary(spark, sf_dir), "weight")


@query("WITH " + _VOCAB + ", " + _SCORE + " SELECT * FROM score")
def pmi_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return _rounded(vocabulary.score(docs, _vocabulary(spark, sf_dir)).select("doc_id", "pmi_score"), "pmi_score")


@query("WITH " + _VOCAB + ", " + _SCORE + ", " + _SENT + " SELECT * FROM score JOIN stat USING (doc_id)")
def feature_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return _rounded(features.extract(docs, _vocabulary(spark, sf_dir)).drop("text"), *features.NAMES)


@query("WITH " + _SENT + """, r AS (SELECT quality AS label, burstiness, rttr, entropy, row_number() OVER (PARTITION BY quality ORDER BY doc_id) AS k FROM stat JOIN labels USING (doc_id))
SELECT label, round(avg(burstiness), 4) AS burstiness, round(avg(rttr), 4) AS rttr, round(avg(entropy), 4) AS entropy FROM r WHERE k <= 1000 GROUP BY label""")
def feature_averages_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features.statistical(labelled(spark, sf_dir).select("doc_id", "label", "text"))
    out = features.class_averages(_rounded(rows, "burstiness", "rttr", "entropy"), "doc_id")
    return out.withColumns({c: F.round(c, 4) for c in ("burstiness", "rttr", "entropy")})


# --- ingest ---------------------------------------------------------------------------------------------------------


@query("WITH " + _RECORDS + " SELECT record_id, text, label, source_id, adv_source_id, model, decoding, repetition_penalty, attack, domain, CAST(text_length AS INT) AS text_length, text_hash FROM records")
def raw_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.normalize(raw_rows(spark, sf_dir)).drop("title", "prompt")


@query("WITH " + _RAW + r""" SELECT id, regexp_replace(generation, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS text, model, domain, coalesce(attack, 'none') AS attack, coalesce(decoding, 'default') AS decoding,
CASE WHEN model = 'human' THEN 0 ELSE 1 END AS is_ai FROM raw WHERE NOT (""" + _BLANK + ")")
def parser_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.parse(raw_rows(spark, sf_dir)).drop("title")


_SAID = ("0", "human", " FALSE", "1", "Ai", "generated", "true", "odd", "")


@query("WITH " + _RAW + """, x AS (SELECT id, model, (['0', 'human', ' FALSE', '1', 'Ai', 'generated', 'true', 'odd', ''])[CAST(doc_id % 9 AS INT) + 1] AS said FROM raw)
SELECT id, CASE WHEN lower(trim(said)) IN ('0', 'human', 'false') THEN 0 WHEN lower(trim(said)) IN ('1', 'ai', 'generated', 'true') THEN 1 WHEN model = 'human' THEN 0 ELSE 1 END AS label FROM x""")
def audit_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.get(F.array(*[F.lit(x) for x in _SAID]), (F.col("doc_id") % 9).cast("int"))
    return raw_rows(spark, sf_dir).select("id", ingest.audit_label(said, F.col("model")).alias("label"))


@query("WITH " + _RAW + """, x AS (SELECT id, (['0', 'human', ' FALSE', '1', 'Ai', 'generated', 'true', 'odd', ''])[CAST(doc_id % 9 AS INT) + 1] AS said FROM raw)
SELECT id, CASE WHEN contains(said, '1') OR contains(lower(said), 'ai') THEN 1 ELSE 0 END AS label FROM x""")
def loader_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.get(F.array(*[F.lit(x) for x in _SAID]), (F.col("doc_id") % 9).cast("int"))
    return raw_rows(spark, sf_dir).select("id", ingest.loader_label(said, F.lit(None).cast("string")).alias("label"))


@query(r"""WITH p AS (SELECT u.conv_id, u.turn, u.text AS human_text, a.text AS ai_text FROM conversations u LEFT JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user'),
x AS (SELECT conv_id, turn, human_text AS text, 0 AS label, 'human' AS model FROM p UNION ALL SELECT conv_id, turn, ai_text, 1, 'gpt_rewrite' FROM p)
SELECT conv_id, turn, regexp_replace(text, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS text, label, model FROM x WHERE text IS NOT NULL AND text <> ''""")
def pairs_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    human = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("human_text"))
    ai = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("ai_text"))
    return ingest.pairs_to_rows(human.join(ai, ["conv_id", "turn"], "left"), ["conv_id", "turn"])


@query("WITH " + _RAW + """ SELECT 'human' AS side, count(*) AS rows FROM raw WHERE model = 'human' UNION ALL SELECT 'ai', count(*) FROM raw WHERE model IS DISTINCT FROM 'human'""")
def sample_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = raw_rows(spark, sf_dir).withColumn("label", F.lit(None).cast("string"))
    total = lambda df, side: df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(side).alias("side"), "rows")
    return total(ingest.human_samples(raw), "human").unionByName(total(ingest.ai_samples(raw), "ai"))


# --- audit ----------------------------------------------------------------------------------------------------------


@query("WITH " + _RAW + """, x AS (SELECT CASE WHEN model = 'human' THEN '0' ELSE '1' END AS label, model, domain, coalesce(attack, 'missing') AS attack, coalesce(decoding, 'missing') AS decoding FROM raw)
SELECT 'label' AS section, label AS key, count(*) AS rows FROM x GROUP BY label UNION ALL SELECT 'model', model, count(*) FROM x GROUP BY model UNION ALL SELECT 'domain', domain, count(*) FROM x GROUP BY domain
UNION ALL SELECT 'attack', attack, count(*) FROM x GROUP BY attack UNION ALL SELECT 'decoding', decoding, count(*) FROM x GROUP BY decoding""")
def audit_category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.category_counts(audit.prepared(raw_rows(spark, sf_dir)).drop("text"), ("label", "model", "domain", "attack", "decoding"))


@query("WITH " + _RAW + """, x AS (SELECT 'attack' AS field, count(*) AS missing FROM raw WHERE attack IS NULL UNION ALL SELECT 'decoding', count(*) FROM raw WHERE decoding IS NULL
UNION ALL SELECT 'title', count(*) FROM raw UNION ALL SELECT 'generation', count(*) FROM raw WHERE coalesce(generation, '') = '') SELECT * FROM x WHERE missing > 0""")
def audit_missing_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.missing_fields(raw_rows(spark, sf_dir), ("id", "model", "attack", "decoding", "title", "generation"))


@query("WITH " + _RAW + r""", x AS (SELECT *, regexp_replace(coalesce(generation, ''), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS t FROM raw)
SELECT count(*) AS rows, count(*) FILTER (model = 'human') AS human_rows, count(*) FILTER (model <> 'human') AS ai_rows, count(*) FILTER (coalesce(model, '') = '') AS unknown_rows, count(DISTINCT id) AS unique_ids, count(DISTINCT source_id) AS unique_sources,
count(DISTINCT adv_source_id) AS unique_adv_sources, count(*) - count(DISTINCT id) AS duplicate_ids, count(*) - count(DISTINCT t) AS duplicate_texts, count(*) FILTER (t = '') AS empty_texts,
CAST(min(length(t)) AS INT) AS min_length, CAST(max(length(t)) AS INT) AS max_length, round(avg(length(t)), 2) AS mean_length FROM x""")
def audit_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.scalars(raw_rows(spark, sf_dir))


@query("WITH " + _RAW + r""" SELECT doc_id AS position, id, CASE WHEN model = 'human' THEN 0 ELSE 1 END AS label, model, domain, coalesce(attack, 'missing') AS attack, coalesce(decoding, 'missing') AS decoding,
substr(regexp_replace(generation, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'), 1, 300) AS text_preview FROM raw ORDER BY doc_id LIMIT 10""")
def audit_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.samples(raw_rows(spark, sf_dir), "doc_id")


@query("WITH " + _RAW + """, x AS (SELECT CASE WHEN model = 'human' THEN 'human' ELSE 'ai' END AS label, model, domain, coalesce(attack, 'none') AS attack, coalesce(decoding, 'default') AS decoding FROM raw WHERE NOT (""" + _BLANK + """)),
u AS (SELECT unnest([{'section': 'label', 'key': label}, {'section': 'model', 'key': model}, {'section': 'domain', 'key': domain}, {'section': 'attack', 'key': attack}, {'section': 'decoding', 'key': decoding}]) AS c FROM x)
SELECT c.section AS section, c.key AS key, count(*) AS rows, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM x), 1) AS percent FROM u GROUP BY ALL""")
def parser_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.parser_summary(ingest.parse(raw_rows(spark, sf_dir)).drop("text"))


# --- manifest -------------------------------------------------------------------------------------------------------


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records without their texts, which nothing behind the hash needs."""
    return ingest.normalize(raw_rows(spark, sf_dir)).drop("text", "title", "prompt")


def _kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.kept(_records(spark, sf_dir))


def _grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.with_groups(materialise(_kept(spark, sf_dir), "kept"))


def _split_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = materialise(_grouped(spark, sf_dir), "grouped")
    return rows.join(materialise(splits.assign_splits(manifest.group_stats(rows)), "splits"), "group_id")


@query("WITH " + _KEPT + " SELECT record_id, label, text_hash FROM kept")
def manifest_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kept(spark, sf_dir).select("record_id", "label", "text_hash")


@query("WITH " + _RECORDS + """, x AS (SELECT text_hash, count(*) AS n, min(label) AS a, max(label) AS b FROM records GROUP BY text_hash)
SELECT count(*) FILTER (a = b) AS rows_kept, CAST(coalesce(sum(n - 1) FILTER (a = b), 0) AS BIGINT) AS duplicate_texts_removed, count(*) FILTER (a <> b) AS conflicting_texts_removed,
CAST(coalesce(sum(n) FILTER (a <> b), 0) AS BIGINT) AS conflicting_rows_removed, (SELECT count(*) FROM raw WHERE """ + _BLANK + ") AS empty_rows_removed FROM x")
def manifest_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.stats(raw_rows(spark, sf_dir), _records(spark, sf_dir))


@query("WITH " + _RECORDS + """, y AS (SELECT text_hash, doc_id, label, first_value(label) OVER (PARTITION BY text_hash ORDER BY doc_id) AS f FROM records),
z AS (SELECT text_hash, max(CASE WHEN label <> f THEN 1 ELSE 0 END) OVER (PARTITION BY text_hash ORDER BY doc_id) AS broken FROM y),
x AS (SELECT text_hash, count(*) FILTER (broken = 0) AS b, count(*) FILTER (broken = 1) AS a FROM z GROUP BY text_hash)
SELECT count(*) FILTER (a = 0) AS rows_kept, CAST(coalesce(sum(b - 1), 0) AS BIGINT) AS duplicate_texts_removed, count(*) FILTER (a > 0) AS conflicting_texts_removed, CAST(coalesce(sum(a + 1) FILTER (a > 0), 0) AS BIGINT) AS conflicting_rows_removed,
(SELECT count(*) FROM raw) AS rows_seen, (SELECT count(*) FROM raw WHERE """ + _BLANK + ") AS empty_rows_removed FROM x")
def manifest_stats_stream_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = raw_rows(spark, sf_dir)
    position = raw.select(F.col("id").alias("record_id"), F.col("doc_id").alias("position"))
    records = _records(spark, sf_dir).select("record_id", "text_hash", "label").join(position, "record_id")
    return manifest.stats_in_arrival_order(raw, records, "position")


@query("WITH RECURSIVE " + _GROUPED + " SELECT record_id, group_id FROM grouped")
def lineage_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grouped(spark, sf_dir).select("record_id", "group_id")


@query("WITH RECURSIVE " + _KEPT + """,
edges AS (SELECT 'source:' || source_id AS a, 'adv:' || adv_source_id AS b FROM records UNION SELECT min('source:' || source_id) OVER (PARTITION BY text_hash), 'source:' || source_id FROM records),
arcs AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach AS (SELECT a AS v, a AS r FROM arcs UNION SELECT arcs.b, reach.r FROM reach JOIN arcs ON arcs.a = reach.v),
comp AS (SELECT v, min(r) AS c FROM reach GROUP BY v)
SELECT record_id, 'group-' || substr(sha256(c), 1, 16) AS group_id FROM kept JOIN comp ON comp.v = 'source:' || kept.source_id""")
def lineage_groups_all_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = materialise(_records(spark, sf_dir), "records")
    return manifest.with_groups(manifest.kept(records), lineage=records, bridge_texts=True).select("record_id", "group_id")


@query("WITH RECURSIVE " + _STATS + " SELECT * FROM stats")
def group_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.group_stats(_grouped(spark, sf_dir))


@query("WITH RECURSIVE " + _ASSIGNED + " SELECT * FROM assigned")
def split_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.assign_splits(manifest.group_stats(_grouped(spark, sf_dir)))


@query("WITH RECURSIVE " + _ASSIGNED + """,
u AS (SELECT split, unnest([{'section': 'rows', 'key': ''}, {'section': 'label', 'key': CAST(label AS VARCHAR)}, {'section': 'model', 'key': model}, {'section': 'domain', 'key': domain}, {'section': 'attack', 'key': attack}]) AS c FROM split_rows)
SELECT split, c.section AS section, c.key AS key, count(*) AS rows FROM u GROUP BY ALL UNION ALL SELECT split, 'groups', '', count(DISTINCT group_id) FROM split_rows GROUP BY split""")
def split_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.distribution(materialise(_split_rows(spark, sf_dir), "split-rows"))


@query("WITH RECURSIVE " + _ASSIGNED + """,
u AS (SELECT split, unnest([{'key': 'group_id', 'value': group_id}, {'key': 'source_id', 'value': source_id}, {'key': 'adv_source_id', 'value': adv_source_id}, {'key': 'text_hash', 'value': text_hash}]) AS c FROM split_rows),
x AS (SELECT c.key AS key, c.value AS value, count(DISTINCT split) AS n FROM u GROUP BY ALL) SELECT key, count(*) FILTER (value IS NOT NULL AND n > 1) AS violations FROM x GROUP BY key""")
def leakage_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.leakage(_split_rows(spark, sf_dir))


@query("WITH RECURSIVE " + _ASSIGNED + " SELECT split, count(DISTINCT label) = 2 AS has_both FROM split_rows GROUP BY split")
def split_class_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.split_classes(_split_rows(spark, sf_dir))


@query("WITH RECURSIVE " + _ASSIGNED + " SELECT split, CAST(CAST('0x' || substr(text_hash, 1, 8) AS BIGINT) % 32 AS INT) AS shard, count(*) AS rows FROM split_rows GROUP BY ALL")
def shard_row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_counts(manifest.with_shards(_split_rows(spark, sf_dir)))


# --- pilot ----------------------------------------------------------------------------------------------------------


def _train(rows: DataFrame) -> DataFrame:
    return rows.where("split = 'train'").withColumn("label", F.col("label").cast("string"))


@query("WITH RECURSIVE " + _ASSIGNED + " SELECT group_id, count(*) AS rows, count(*) FILTER (label = 0) AS human, count(*) FILTER (label = 1) AS ai, CAST(count(DISTINCT model) + count(DISTINCT domain) + count(DISTINCT attack) AS INT) AS covered FROM split_rows WHERE split = 'train' GROUP BY group_id")
def pilot_group_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pilot.summarize(_train(_split_rows(spark, sf_dir))).withColumn("covered", F.size("coverage")).drop("coverage")


def _selected(rows: DataFrame) -> DataFrame:
    return pilot.select_groups(materialise(pilot.summarize(_train(rows)), "pilot-groups"))


@query("WITH RECURSIVE " + _PICKED + " SELECT group_id FROM pick WHERE k > 0")
def pilot_selected_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _selected(materialise(_split_rows(spark, sf_dir), "split-rows"))


@query("WITH RECURSIVE " + _SAMPLED + """, sample AS (SELECT record_id, group_id, label FROM chosen WHERE label = 0 UNION ALL SELECT record_id, group_id, label FROM ranked, size WHERE place <= n)
SELECT record_id, group_id, CAST(label AS VARCHAR) AS label, sha256('44:' || record_id) AS pilot_rank FROM sample""")
def pilot_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = materialise(_split_rows(spark, sf_dir), "split-rows")
    chosen = _train(rows).join(F.broadcast(_selected(rows)), "group_id", "left_semi")
    return pilot.balanced(chosen).select("record_id", "group_id", "label", "pilot_rank")


@query("WITH RECURSIVE " + _ASSIGNED + """, train AS (SELECT DISTINCT group_id FROM split_rows WHERE split = 'train')
SELECT n.split AS split, count(DISTINCT r.group_id) AS shared FROM (SELECT unnest(['validation', 'test']) AS split) n LEFT JOIN (SELECT * FROM split_rows WHERE group_id IN (SELECT group_id FROM train)) r ON r.split = n.split GROUP BY n.split""")
def pilot_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = materialise(_split_rows(spark, sf_dir), "split-rows")
    return pilot.overlap(_selected(rows), rows.where("split <> 'train'"))


def _assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kept rows as assignments to join back."""
    return materialise(_kept(spark, sf_dir).withColumns({"group_id": F.col("source_id"), "split": F.lit("train")}), "assignments")


def _labelled_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source that holds the labelled documents only, so that some ids are missing."""
    return raw_rows(spark, sf_dir).join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")


_SAMPLE = _KEPT + ", sample AS (SELECT * FROM kept)"


@query("WITH " + _SAMPLE + " SELECT record_id, label, sample.source_id AS group_id, 'train' AS split, raw.model AS model, coalesce(raw.attack, 'none') AS attack, length(generation)::INT AS text_length, sha256(generation) AS text_hash FROM sample JOIN raw ON raw.id = sample.record_id")
def pilot_text_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = pilot_join.join_texts(raw_rows(spark, sf_dir), _assignments(spark, sf_dir))
    return pilot_join.finished(joined).select("record_id", "label", "group_id", "split", "model", "attack", "text_length", "text_hash")


@query("WITH " + _SAMPLE + " SELECT record_id FROM sample WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def pilot_missing_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pilot_join.missing_ids(_labelled_raw(spark, sf_dir), _assignments(spark, sf_dir))


@query("WITH " + _SAMPLE + """, j AS (SELECT raw AS a, sample AS b FROM sample JOIN raw ON raw.id = sample.record_id),
u AS (SELECT unnest([{'field': 'model', 'x': a.model, 'y': b.model}, {'field': 'domain', 'x': a.domain, 'y': b.domain}, {'field': 'decoding', 'x': a.decoding, 'y': b.decoding},
 {'field': 'repetition_penalty', 'x': a.repetition_penalty, 'y': b.repetition_penalty}, {'field': 'attack', 'x': a.attack, 'y': b.attack}, {'field': 'text_hash', 'x': sha256(a.generation), 'y': b.text_hash},
 {'field': 'label', 'x': CASE WHEN a.model = 'human' THEN '0' ELSE '1' END, 'y': CAST(b.label AS VARCHAR)}]) AS c FROM j)
SELECT c.field AS field, count(*) FILTER (coalesce(c.x, '') <> coalesce(c.y, '')) AS mismatches FROM u GROUP BY c.field""")
def pilot_join_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pilot_join.mismatches(pilot_join.join_texts(raw_rows(spark, sf_dir), _assignments(spark, sf_dir)))


@query("WITH " + _SAMPLE + " SELECT coalesce(record_id, id) AS record_id, CASE WHEN id IS NULL THEN 'assignments' ELSE 'ids' END AS only_in FROM sample FULL JOIN (SELECT id FROM raw WHERE doc_id IN (SELECT doc_id FROM labels)) r ON r.id = record_id WHERE id IS NULL OR record_id IS NULL")
def pilot_id_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = _labelled_raw(spark, sf_dir).select(F.col("id").alias("record_id"))
    return pilot_join.id_sets_differ(ids, _assignments(spark, sf_dir))


# --- sources and sinks: written, then read back ---------------------------------------------------------------------

_FLAT = "SELECT record_id, label, model, coalesce(decoding, '') AS decoding, attack, domain, CAST(text_length AS INT) AS text_length, text_hash FROM records"


def _flat(raw: DataFrame) -> DataFrame:
    return ingest.normalize(raw).select("record_id", "label", "model", F.coalesce("decoding", F.lit("")).alias("decoding"), "attack", "domain", "text_length", "text_hash")


@query("WITH " + _RECORDS + " " + _FLAT)
def source_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "csv")
    writers.write_csv(raw_rows(spark, sf_dir).drop("doc_id"), path)
    return _flat(readers.read_csv(spark, path))


@query("WITH " + _RECORDS + " " + _FLAT)
def source_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "jsonl")
    raw_rows(spark, sf_dir).drop("doc_id").write.option("compression", "gzip").json(path)
    return _flat(readers.read_jsonl(spark, path, raw_rows(spark, sf_dir).drop("doc_id").schema))


@query("WITH " + _RECORDS + " " + _FLAT)
def source_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose kind the source's name tells."""
    path = new_path(spark, "source") + ".csv.gz"
    writers.write_csv(raw_rows(spark, sf_dir).drop("doc_id"), path)
    return _flat(readers.load_source(spark, "auto", path))


@query(r"""WITH p AS (SELECT CAST(u.conv_id AS VARCHAR) || '/' || CAST(u.turn AS VARCHAR) AS page_title, u.text AS human_text, a.text AS ai_text FROM conversations u LEFT JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user'),
x AS (SELECT page_title, human_text AS text, 0 AS label FROM p UNION ALL SELECT page_title, ai_text, 1 FROM p)
SELECT page_title, regexp_replace(text, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS text, label FROM x WHERE text IS NOT NULL AND text <> ''""")
def source_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    human = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("human_text"))
    ai = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("ai_text"))
    path = new_path(spark, "pairs")
    human.join(ai, ["conv_id", "turn"], "left").select(F.concat_ws("/", "conv_id", "turn").alias("page_title"), "human_text", "ai_text").write.json(path)
    return ingest.pairs_to_rows(readers.read_pairs(spark, path), ["page_title"]).select("page_title", "text", "label")


@query("WITH " + _VOCAB + " SELECT word, round(weight, 6) AS weight FROM vocab")
def source_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "vocabulary") + ".json"
    writers.write_vocabulary(_vocabulary(spark, sf_dir), path)
    return _rounded(readers.read_vocabulary(spark, path), "weight")


@query("WITH RECURSIVE " + _ASSIGNED + " SELECT record_id, CAST(label AS VARCHAR) AS label, split, model, attack, CAST(text_length AS VARCHAR) AS text_length, text_hash FROM split_rows")
def sink_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "shards")
    writers.write_shards(materialise(_split_rows(spark, sf_dir), "split-rows"), path)
    parts = [readers.read_assignments(spark, path, x) for x in manifest.SPLITS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("record_id", "label", "split", "model", "attack", "text_length", "text_hash")


@query("WITH RECURSIVE " + _ASSIGNED + " SELECT split, CAST(CAST('0x' || substr(text_hash, 1, 8) AS BIGINT) % 32 AS INT) AS shard, count(*) AS rows FROM split_rows GROUP BY ALL")
def sink_shard_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index that lies beside the shards."""
    path = new_path(spark, "shards")
    writers.write_shards(materialise(_split_rows(spark, sf_dir), "split-rows"), path)
    found = spark.read.option("multiLine", True).json(f"{path}/shard_index.json").select(F.explode("files").alias("f"))
    return found.select("f.split", F.col("f.shard").cast("int").alias("shard"), "f.rows")


@query("WITH RECURSIVE " + _ASSIGNED + " SELECT record_id, label, split, model, group_id FROM split_rows")
def sink_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "manifests")
    writers.write_splits(materialise(_split_rows(spark, sf_dir), "split-rows"), path, "record_id")
    found = spark.read.schema("record_id string, label int, split string, model string, group_id string").json(path)
    return found.select("record_id", "label", "split", "model", "group_id")


@query("WITH " + _SAMPLE + " SELECT record_id, CAST(label AS VARCHAR) AS label, true AS listed FROM sample")
def sink_pilot(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "pilot")
    rows = _assignments(spark, sf_dir).withColumn("pilot_rank", stable_rank(F.col("record_id"), 44)).drop("doc_id")
    writers.write_pilot(rows, path)
    ids = readers.read_ids(spark, f"{path}/pilot_record_ids").withColumn("listed", F.lit(True))
    return readers.read_pilot(spark, f"{path}/pilot_assignments").join(ids, "record_id", "full_outer").select("record_id", "label", "listed")


@query("WITH " + _SAMPLE + " SELECT record_id, label, generation AS text, sha256(generation) AS text_hash FROM sample JOIN raw ON raw.id = sample.record_id")
def sink_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "joined")
    rows = _assignments(spark, sf_dir)
    raw = raw_rows(spark, sf_dir).withColumn("attack", F.coalesce("attack", F.lit("none")))
    writers.write_joined(raw, rows, path)
    return spark.read.schema("record_id string, label int, text string, text_hash string").json(f"{path}/pilot_texts")


@query("SELECT DISTINCT unnest(json_keys(props)) AS field FROM events")
def audit_observed_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.observed_fields(table(spark, sf_dir, "events"), "props")


@query("SELECT doc_id, row_number() OVER (ORDER BY sha256('42:' || CAST(doc_id AS VARCHAR)), doc_id) AS place FROM documents ORDER BY place LIMIT 100")
def audit_shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    first = audit.shuffled(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 100)
    return first.select("doc_id", F.row_number().over(Window.orderBy(stable_rank(F.col("doc_id").cast("string"), 42), "doc_id")).cast("long").alias("place"))


@query("SELECT doc_id, CAST(to_json({'doc_id': doc_id, 'lang': lang, 'source': source}) AS VARCHAR) AS json FROM documents")
def record_dicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = audit.as_dicts(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"))
    return out.select(F.get_json_object("json", "$.doc_id").cast("long").alias("doc_id"), "json")


@query("SELECT vec_id, CAST(len(embedding) AS INT) AS n FROM embeddings")
def nested_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.size(audit.flat(F.array("embedding"))).alias("n"))


@query("WITH " + _RECORDS + """, marked AS (SELECT *, row_number() OVER (PARTITION BY text_hash ORDER BY doc_id) AS rn, min(label) OVER (PARTITION BY text_hash) AS lo, max(label) OVER (PARTITION BY text_hash) AS hi FROM records)
SELECT record_id, label, text_hash FROM marked WHERE rn = 1 AND lo = hi""")
def manifest_kept_arrival_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = raw_rows(spark, sf_dir)
    position = raw.select(F.col("id").alias("record_id"), F.col("doc_id").alias("position"))
    records = _records(spark, sf_dir).select("record_id", "text_hash", "label").join(position, "record_id")
    return manifest.kept_in_arrival_order(records, "position").drop("position")


# --- tokens ---------------------------------------------------------------------------------------------------------

_LENGTHS = r"n AS (SELECT doc_id, quality AS label, text, 2 + len(regexp_extract_all(text, '[^\s\p{Z}]+')) AS x FROM documents JOIN labels USING (doc_id))"
_SUMMARY = "count(*) AS count, CAST(min(x) AS INT) AS min, CAST(max(x) AS INT) AS max, round(avg(x), 3) AS mean, round(quantile_cont(x, 0.5), 6) AS median, round(quantile_cont(x, 0.9), 6) AS p90, round(quantile_cont(x, 0.95), 6) AS p95, round(quantile_cont(x, 0.99), 6) AS p99"


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled(spark, sf_dir).select(F.col("doc_id").cast("string").alias("record_id"), "label", "text")
    return tokenizer_audit.tokenized(rows).drop("token_ids", "attention_mask", "special_tokens_mask")


@query("WITH " + _LENGTHS + " SELECT " + _SUMMARY + " FROM n")
def token_length_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenizer_audit.length_summary(_tokens(spark, sf_dir))


@query("WITH " + _LENGTHS + " SELECT label, " + _SUMMARY + " FROM n GROUP BY label")
def token_length_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenizer_audit.length_summary(_tokens(spark, sf_dir), "label")


@query("WITH n AS (SELECT text, 2 + len(regexp_extract_all(coalesce(text, ''), '[^\\s\\p{Z}]+')) AS x FROM documents) " + r"SELECT count(*) AS rows, count(*) FILTER (NOT regexp_matches(coalesce(text, ''), '[^\s\p{Z}]')) AS empty, count(*) FILTER (x > 512) AS truncated, round(count(*) FILTER (x > 512) / count(*), 6) AS rate FROM n")
def truncation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokenizer_audit.truncation(tokenizer_audit.tokenized(rows).select("text", "truncated"))


@query("SELECT 'lang' AS section, lang AS key, count(*) AS rows FROM documents GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY source")
def metadata_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.category_counts(table(spark, sf_dir, "documents").select("lang", "source"), ("lang", "source"))


@query("WITH r AS (SELECT doc_id, quality AS label, row_number() OVER (PARTITION BY quality ORDER BY doc_id) AS k FROM documents JOIN labels USING (doc_id)) SELECT doc_id, label, sha256('42:' || CAST(doc_id AS VARCHAR)) AS rank FROM r WHERE k <= 32")
def first_n_per_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = audit.first_per_label(labelled(spark, sf_dir).select("doc_id", "label"), 32, "doc_id")
    return rows.select("doc_id", "label", stable_rank(F.col("doc_id").cast("string"), 42).alias("rank"))


@query("SELECT doc_id, CASE WHEN CAST('0x' || substr(sha256('42:' || CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) % 100 < 80 THEN 'train' ELSE 'test' END AS part FROM documents")
def hash_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.when(hash_bucket(F.col("doc_id").cast("string"), 42) < 80, "train").otherwise("test").alias("part"))


# --- models and evaluation ------------------------------------------------------------------------------------------


def _model(spark: SparkSession, sf_dir: str) -> tuple[features.Detector, DataFrame]:
    """Trees trained on the hashed four fifths of the labelled documents, and the other fifth."""
    rows = labelled(spark, sf_dir).select("doc_id", "text", "label", hash_bucket(F.col("doc_id").cast("string"), 42).alias("b"))
    words_ = vocabulary.fit(rows.where("b < 80"), min_freq=5, top_k=500)
    found = materialise(features.extract(rows, words_).drop("text"), "features")
    return features.Detector().train(found.where("b < 80")), found.where("b >= 80")


@query()
def classifier_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, rest = _model(spark, sf_dir)
    return evaluation.by_class(model.predict(rest))


@query()
def feature_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, _ = _model(spark, sf_dir)
    return spark.createDataFrame(list(model.importance().items()), "feature string, importance double")


_SCORED = "WITH s AS (SELECT quality AS label, round((CAST('0x' || substr(sha256(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) % 1000) / 2000.0::DOUBLE + 0.4 * quality, 6) AS score, lang, source FROM documents JOIN labels USING (doc_id))"


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A made-up score that leans towards the label, to measure metrics on."""
    part = F.pmod(F.conv(F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 8), 16, 10).cast("bigint"), F.lit(1000))
    return labelled(spark, sf_dir).select("doc_id", "label", F.round(part / 2000.0 + 0.4 * F.col("label"), 6).alias("score"), "lang", "source")


@query(_SCORED + ", p AS (SELECT label, CASE WHEN score > 0.5 THEN 1 ELSE 0 END AS p FROM s), c AS (SELECT unnest([0, 1]) AS class), x AS (SELECT class, count(*) FILTER (label = class AND p = class) AS hit, count(*) FILTER (p = class) AS said, count(*) FILTER (label = class) AS support, count(*) FILTER (label = p) / count(*) AS acc FROM p, c GROUP BY class), y AS (SELECT *, CASE WHEN said = 0 THEN 0.0 ELSE hit / said END AS pr, CASE WHEN support = 0 THEN 0.0 ELSE hit / support END AS re FROM x) SELECT class, round(pr, 6) AS precision, round(re, 6) AS recall, round(CASE WHEN pr + re = 0 THEN 0 ELSE 2 * pr * re / (pr + re) END, 6) AS f1, support, round(acc, 6) AS accuracy FROM y")
def metrics_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.by_class(_scored(spark, sf_dir).withColumn("predicted", (F.col("score") > 0.5).cast("int")))


@query(_SCORED + ", r AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS k FROM s) SELECT round((sum(k) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2) / (count(*) FILTER (label = 1) * count(*) FILTER (label = 0)), 6) AS auc FROM r")
def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.roc_auc(_scored(spark, sf_dir))


@query(_SCORED + ", t AS (SELECT DISTINCT score AS x FROM s), r AS (SELECT x, count(*) FILTER (label = 1 AND score >= x) / count(*) FILTER (label = 1) AS tpr, count(*) FILTER (label = 0 AND score >= x) / count(*) FILTER (label = 0) AS fpr FROM t, s GROUP BY x) SELECT round(x, 6) AS threshold, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr FROM r WHERE fpr <= 0.05 ORDER BY x LIMIT 1")
def threshold_under_fpr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.threshold_under_fpr(_scored(spark, sf_dir))


@query(_SCORED + ", p AS (SELECT *, CASE WHEN (score > 0.5) = (label = 1) THEN 1 ELSE 0 END AS ok FROM s) SELECT 'lang' AS dimension, lang AS value, count(*) AS rows, round(avg(ok), 6) AS accuracy FROM p GROUP BY lang UNION ALL SELECT 'source', source, count(*), round(avg(ok), 6) FROM p GROUP BY source")
def slice_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.slices(_scored(spark, sf_dir).withColumn("predicted", (F.col("score") > 0.5).cast("int")), ("lang", "source"))


@query(_SCORED + ", t AS (SELECT score AS x, count(*) FILTER (label = 1) AS pos FROM s GROUP BY score), r AS (SELECT x, any_value(pos) AS pos, count(*) FILTER (label = 1 AND score >= x) AS tp, count(*) FILTER (score >= x) AS said FROM t, s GROUP BY x) SELECT round(sum(pos / (SELECT count(*) FILTER (label = 1) FROM s) * tp / said), 6) AS pr_auc FROM r")
def pr_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.average_precision(_scored(spark, sf_dir))


@query(_SCORED + ", p AS (SELECT label, score > 0.5 AS p FROM s) SELECT round(count(*) FILTER (label = 0 AND p) / count(*) FILTER (label = 0), 6) AS fpr, round(count(*) FILTER (label = 1 AND NOT p) / count(*) FILTER (label = 1), 6) AS fnr FROM p")
def miss_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.miss_rates(_scored(spark, sf_dir).withColumn("predicted", (F.col("score") > 0.5).cast("int")))


@query(_SCORED + ", x AS (SELECT label, score, CASE WHEN length(text) < 128 THEN '<128' WHEN length(text) < 256 THEN '128-255' WHEN length(text) < 512 THEN '256-511' WHEN length(text) < 1024 THEN '512-1023' WHEN length(text) < 2048 THEN '1024-2047' ELSE '>=2048' END AS b FROM (SELECT text, quality AS label, round((CAST('0x' || substr(sha256(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) % 1000) / 2000.0::DOUBLE + 0.4 * quality, 6) AS score FROM documents JOIN labels USING (doc_id))) SELECT 'length' AS dimension, b AS value, count(*) AS rows, round(avg(CASE WHEN (score > 0.5) = (label = 1) THEN 1 ELSE 0 END), 6) AS accuracy FROM x GROUP BY b")
def slices_by_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = table(spark, sf_dir, "documents").select("doc_id", evaluation.length_bucket(F.length("text")).alias("length"))
    scored = _scored(spark, sf_dir).withColumn("predicted", (F.col("score") > 0.5).cast("int"))
    return evaluation.slices(scored.join(lengths, "doc_id"), ("length",))


@query("WITH x AS (SELECT doc_id, " + _WORDS1.format(t="text") + " AS w FROM documents), k AS (SELECT doc_id, w, unnest(range(0, greatest(CAST(ceil((len(w) - 128) / 64) AS BIGINT), 0) + 1)) AS chunk FROM x) SELECT doc_id, CAST(chunk AS INT) AS chunk, CAST(len(w[chunk * 64 + 1 : chunk * 64 + 128]) AS INT) AS n FROM k")
def chunk_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", words(F.coalesce("text", F.lit(""))).alias("tokens"))
    return evaluation.chunks(rows, 128, 64).select("doc_id", "chunk", F.size("chunk_tokens").alias("n"))


@query(_SCORED + " SELECT label, round((SELECT count(*) FROM s) / (2 * count(*)), 6) AS weight FROM s GROUP BY label")
def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.class_weights(_scored(spark, sf_dir))


@query(_SCORED + " SELECT CASE WHEN score <= 0.2 OR score >= 0.7 THEN 'fast' ELSE 'slow' END AS route, count(*) AS rows FROM s GROUP BY ALL")
def cascade_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.route(_scored(spark, sf_dir), 0.2, 0.7).groupBy("route").agg(F.count(F.lit(1)).alias("rows"))
