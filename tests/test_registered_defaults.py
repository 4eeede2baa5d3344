"""Registered queries work at their operators' own sizes."""

from textloom.plans import catalogue


def test_registered_models_take_all_rounds(spark, monkeypatch):
    rows = spark.createDataFrame([(1, "a text", 1)], "doc_id long, text string, label int")
    monkeypatch.setattr(catalogue, "labelled", lambda *_: rows)
    monkeypatch.setattr(catalogue.vocabulary, "fit", lambda *_, **__: None)
    monkeypatch.setattr(catalogue.features, "extract", lambda r, _: r)
    monkeypatch.setattr(catalogue.features.Detector, "train", lambda self, _: self)
    model, _ = catalogue._model(spark, "")
    assert model.trees.getMaxIter() == 200


def test_registered_pilots_take_the_default_target(spark):
    fields = "group_id string, record_id string, label int, split string, model string, domain string, attack string"
    rows = spark.createDataFrame([(f"g{k // 2}", f"r{k}", k % 2, "train", "m", "d", "a") for k in range(400)], fields)
    assert catalogue._selected(rows).count() == 200
