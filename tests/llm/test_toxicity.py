"""The classifier chain on labels it has not seen."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stringwatch.llm import toxicity
from stringwatch.llm.queries import LLM_QUERIES


def test_linear_model_has_no_slope_left():
    rng = np.random.default_rng(0)
    x, n = (rng.random((80, 5)) < 0.3).astype(float), rng.integers(1, 9, 80).astype(float)
    y = rng.binomial(n.astype(int), 0.4).astype(float)
    model = toxicity.LinearModel(x, y, n)
    rest = x.T @ (y - n * model.probabilities(x)) - 0.3 * model.weights
    assert np.abs(rest).max() < 0.05


def test_later_models_see_out_of_fold_probabilities(monkeypatch):
    seen = []
    original = toxicity.LinearModel

    class Watched(original):
        def __init__(self, x, y, n, ridge=0.3):
            seen.append(x.shape)
            super().__init__(x, y, n, ridge)

    monkeypatch.setattr(toxicity, "LinearModel", Watched)
    rng = np.random.default_rng(5)
    x = (rng.random((300, 6)) < 0.5).astype(float)
    y = np.column_stack([x[:, 0] * x[:, 1], x[:, 0] * x[:, 1] + x[:, 2] > 1, x[:, 3]]).astype(float)
    chain = toxicity.Chain(x, y, np.arange(300) % 5)
    assert [s[1] for s in seen] == [6] * 6 + [7] * 6 + [8] * 6
    assert all(seen[i][0] > s[0] for i in (0, 6, 12) for s in seen[i + 1 : i + 6])
    assert chain.probabilities(x).shape == (300, 3)
    assert ((chain.probabilities(x)[:, 2] > 0.5) == y[:, 2]).all()


def test_terms():
    assert toxicity.terms_of({"stupidity", "a"}) == {"stupidity", "a", "stup*", "stupi*", "stupid*"}


@pytest.fixture(scope="module")
def tables(spark):
    rows = [(i, f"plain words {i} " + ("you idiot and moron grumblo" + "abcdef"[i % 6] if i % 4 == 0 else "fine machine"), 0.0) for i in range(400)]
    rows += [(None, None, 0.0), (None, "idiot moron", 0.0), (1000, "", 0.0), (1001, "calm " * 50000 + "idiot moron grumblox", 0.0), (4, "repeated idiot moron", 0.0)]
    alarms = spark.createDataFrame(rows, "alarm_event_id long, alarm_name string, p_toxic double")
    labels = spark.createDataFrame([(i, int(i % 4 == 0), 1) for i in range(300)] + [(5, None, 1), (None, 1, 1)], "alarm_event_id long, toxic int, quality int")
    return alarms, labels


def test_odd_rows(spark, tables):
    alarms, labels = tables
    rows = toxicity.alarm_toxicity(alarms, labels).collect()
    assert len(rows) == 405 and list(rows[0].asDict()) == ["alarm_event_id", "p_insult", "p_contempt", "p_threat", "p_toxic", "toxic"]
    for row in rows:
        if row.alarm_event_id is not None:
            assert row.toxic == (row.alarm_event_id in (4, 1001) or row.alarm_event_id < 400 and row.alarm_event_id % 4 == 0)
    assert sorted(r.toxic for r in rows if r.alarm_event_id is None) == [False, True]
    kept = toxicity.harmless_alarms(alarms, labels)
    assert kept.columns == alarms.columns and kept.count() == sum(not r.toxic for r in rows)


def test_without_labels_nothing_is_toxic(tables):
    alarms, labels = tables
    for few in (labels.limit(0), labels.where("toxic = 0")):
        assert toxicity.alarm_toxicity(alarms, few).where("toxic").count() == 0
    assert toxicity.alarm_toxicity(alarms.limit(0), labels).count() == 0


def test_unseen_labels(spark):
    sf_dir = "/root/testdata/sf0.1"
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumnsRenamed({"doc_id": "alarm_event_id", "text": "alarm_name"})
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").withColumnRenamed("doc_id", "alarm_event_id").dropDuplicates(["alarm_event_id"])
    held = F.pmod(F.xxhash64("alarm_event_id"), F.lit(3)) == 0
    scored = toxicity.alarm_toxicity(documents, labels.where(~held)).join(labels.where(held).select("alarm_event_id", F.col("toxic").alias("label")), "alarm_event_id")
    rows = scored.select("alarm_event_id", scored.toxic, F.col("label")).toPandas()
    # about a tenth of the toxic labels stand on texts that have no toxic word, or but one as clean texts do
    assert rows[rows["label"] == 1]["toxic"].mean() > 0.85
    assert rows[rows["label"] == 0]["toxic"].mean() < 0.01


def test_query_returns_every_document(spark):
    sf_dir = "/root/testdata/sf0.001"
    assert LLM_QUERIES["op5_toxicity"](spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
