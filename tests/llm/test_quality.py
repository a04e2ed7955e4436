"""The additive model on held-out labels, its features against plain Python."""

import numpy as np
import pyarrow as pa
import pytest
import zlib
from pyspark.sql import functions as F

from stringwatch.llm import quality
from stringwatch.llm.queries import LLM_QUERIES

TEXTS = [None, "", " ", "One two two, three.\nfour | five!!\nOne two two, three.", "ÄÖÜ x 1234", "w " * 5000, "\n\nabc\n", "z" * 60000]


def plain(text):
    data = (text or "").encode()
    out = dict.fromkeys(quality.FEATURES, 0.0)
    if not data:
        return out
    words, n = data.split(), len(data)
    number = max(len(words), 1)
    lines = [line for line in data.split(b"\n") if line]
    calm, marks = b",.;:", [b for b in data if 32 < b < 127 and not chr(b).isalnum()]
    out["log_bytes"], out["log_words"], out["word_bytes"] = np.log1p(n), np.log1p(len(words)), sum(map(len, words)) / number
    out["upper"] = sum(65 <= b <= 90 for b in data) / n
    out["digit"], out["space"] = sum(48 <= b <= 57 for b in data) / n, sum(b in b" \t\n\r\x0b\x0c" for b in data) / n
    out["sentence_end"], out["pipe"] = sum(b in calm for b in data) / n, data.count(b"|") / n
    out["other_mark"] = sum(b not in calm + b"|" for b in marks) / n
    out["non_ascii"], out["line"] = sum(b > 127 for b in data) / n, max(len(lines), 1) / number
    out["short_word"], out["long_word"] = sum(len(w) <= 2 for w in words) / number, sum(len(w) >= 14 for w in words) / number
    out["marked_word"] = sum(w[-1] in marks and w[-1] not in calm for w in words) / number
    out["distinct_words"], out["repeated_word"] = len(set(words)) / number, sum(a == b for a, b in zip(words, words[1:])) / number
    out["distinct_lines"] = len(set(lines)) / max(len(lines), 1)
    return out


def test_features_equal_plain_python():
    found = quality.features(pa.array(TEXTS))
    for row, text in zip(found, TEXTS):
        assert row == pytest.approx(list(plain(text).values())), text and text[:20]


def test_tables_learn_sums_and_pairs():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    model = quality.AdditiveModel().fit(x, y)
    assert (1, 0) in model.pairs
    fresh = rng.normal(size=(2000, 4))
    assert ((model.scores(fresh) > 0.5) == ((fresh[:, 0] > 0.3) ^ (fresh[:, 1] > 0))).mean() > 0.9


def test_one_kind_of_label_gives_its_share():
    model = quality.AdditiveModel().fit(np.zeros((9, 2)), np.ones(9))
    assert model.scores(np.zeros((2, 2))) == pytest.approx([0.95, 0.95])
    assert quality.AdditiveModel().fit(np.zeros((0, 2)), np.zeros(0)).scores(np.zeros((1, 2))) == pytest.approx([0.5])


def test_held_out_labels(spark):
    sf_dir = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").dropDuplicates(["doc_id"])
    scored = LLM_QUERIES["op4_quality"](spark, sf_dir)
    assert scored.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = scored.join(labels, "doc_id", "left").toPandas()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert all(rows["held_out"] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in rows["doc_id"]])
    assert all(rows["predicted"] == (rows["score"] >= 0.3))
    unseen = rows[rows["held_out"] & rows["quality"].notna()]
    assert (unseen["predicted"] == unseen["quality"]).mean() > 0.97
    assert unseen[unseen["quality"] == 1]["predicted"].mean() > 0.98


def test_labels_of_held_out_rows_change_nothing(spark):
    rows = [(i, ("good words here " if i % 2 else "bad | bad | bad ") * (i % 7 + 1), "score") for i in range(200)] + [(None, None, "score"), (3, "again", "x")]
    alarms = spark.createDataFrame(rows, "alarm_event_id long, alarm_name string, score string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(None, 1), (7, None)], "alarm_event_id long, quality int")
    turned = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = (quality.alarm_quality(alarms, x).orderBy("alarm_event_id", "score").collect() for x in (labels, turned))
    assert one == two and len(one) == 202
    assert one[0].alarm_event_id is None and one[0].held_out and 0 <= one[0].score <= 1
    assert quality.alarm_quality(alarms.limit(0), labels).count() == 0
    assert quality.alarm_quality(alarms, labels.limit(0)).select("score").distinct().count() == 1
