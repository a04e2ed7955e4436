"""Toxic language by a chain of linear classifiers.

Categories are predicted one after the other: each model sees the words of a
text and the probabilities of the categories before it; the last one predicts
the label itself. Within training those probabilities are out of fold, so that
later models meet them as they will be on unseen texts.

The project's own records have no such labels. The operator is general: it
reads alarm messages, but any texts under these column names will do.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stringwatch.storage import Scratch

WORD = re.compile(r"\w+")
FOLDS = 5
#: a labelled toxic text belongs to the categories whose seed words it has
CATEGORIES: dict[str, tuple[str, ...]] = {
    "insult": (
        "idiot", "moron", "imbecile", "fool", "stupid", "dumb", "dummy", "loser", "clown", "jerk", "coward", "liar", "pig",
        "rat", "creep", "freak", "cretin", "dunce", "numbskull", "ignoramus", "bastard", "simpleton",
    ),
    "contempt": (
        "worthless", "pathetic", "disgusting", "trash", "garbage", "scum", "vermin", "useless", "filthy", "vile", "despicable",
        "inferior", "subhuman", "rubbish", "revolting", "hopeless", "laughable", "miserable", "repulsive",
    ),
    "threat": ("kill", "murder", "hurt", "destroy", "hang", "shoot", "stab", "beat", "burn", "die", "suffer", "bleed"),
}


#: beginnings of words, for words that occur with many endings
STEMS = (4, 5, 6)


def words_of(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


def terms_of(words: set[str], stems: Sequence[int] = STEMS) -> set[str]:
    """The words and, marked by a star, the beginnings of longer ones."""
    return words.union(*({w[:n] + "*" for w in words if len(w) > n} for n in stems))


class LinearModel:
    """Logistic regression with a ridge, by Newton steps; row i stands for n[i] texts, y[i] of them positive."""

    def __init__(self, x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 0.3):
        share = (y.sum() + 0.5) / (n.sum() + 1)
        self.weights, self.intercept = np.zeros(x.shape[1]), float(np.log(share / (1 - share)))
        if not 0 < y.sum() < n.sum():
            return
        full = np.column_stack([x, np.ones(len(x))])
        penalty = np.full(full.shape[1], ridge)
        penalty[-1] = 1e-6
        beta = np.append(self.weights, self.intercept)
        for _ in range(12):
            p = 1 / (1 + np.exp(-np.clip(full @ beta, -30, 30)))
            slope = full.T @ (y - n * p) - penalty * beta
            curve = (full * (n * p * (1 - p))[:, None]).T @ full + np.diag(penalty)
            step = np.linalg.solve(curve, slope)
            beta = beta + step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
            if np.abs(step).max() < 1e-2:
                break
        self.weights, self.intercept = beta[:-1], float(beta[-1])

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weights + self.intercept, -30, 30)))


class Chain:
    """Models of the categories in their order; fitted on the driver on a bounded sample."""

    def __init__(self, x: np.ndarray, y: np.ndarray, folds: np.ndarray):
        # texts with the same terms in the same fold are one row
        rows, row = np.unique(np.column_stack([x, folds]), axis=0, return_inverse=True)
        row = row.ravel()
        n = np.bincount(row).astype(float)
        x, folds = rows[:, :-1], rows[:, -1]
        self.models: list[LinearModel] = []
        earlier = np.zeros((len(x), 0))
        for target in y.T:
            positive = np.bincount(row, target)
            seen = np.column_stack([x, earlier])
            self.models.append(LinearModel(seen, positive, n))
            out_of_fold = np.zeros(len(x))
            for fold in np.unique(folds):
                inside = folds == fold
                model = self.models[-1] if inside.all() else LinearModel(seen[~inside], positive[~inside], n[~inside])
                out_of_fold[inside] = model.probabilities(seen[inside])
            earlier = np.column_stack([earlier, out_of_fold])
        # the last positives and their out-of-fold probabilities settle where toxic begins
        self.threshold = best_threshold(out_of_fold, positive, n)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        found = np.zeros((len(x), 0))
        for model in self.models:
            found = np.column_stack([found, model.probabilities(np.column_stack([x, found]))])
        return found


def best_threshold(probability: np.ndarray, positive: np.ndarray, n: np.ndarray) -> float:
    """Of 0.35, 0.40 .. 0.65 the one with the best F1; of equal ones that closest to 0.5."""
    steps = sorted(np.round(np.arange(0.35, 0.66, 0.05), 2), key=lambda t: (abs(t - 0.5), t))
    return max(steps, key=lambda t: 2 * positive[probability >= t].sum() / max(positive.sum() + n[probability >= t].sum(), 1))


def _presence(texts: pa.Array, places: Mapping[str, int], stems: Sequence[int]) -> np.ndarray:
    """Which terms each text has; the words of one text at a time are in memory."""
    known, x = places.keys(), np.zeros((len(texts), len(places)), np.float32)
    for row, text in enumerate(texts):
        for word in terms_of(words_of(text.as_py()), stems) & known:
            x[row, places[word]] = 1
    return x


class ToxicityModel:
    def __init__(self, categories: Sequence[str], vocabulary: Sequence[str], chain: Chain | None, share: float):
        self.categories = list(categories)
        self.places = {word: i for i, word in enumerate(vocabulary)}
        self.stems = sorted({len(word) - 1 for word in vocabulary if word.endswith("*")})
        self.chain, self.share = chain, share
        self.threshold = chain.threshold if chain is not None else 0.5

    def probabilities(self, texts: pa.Array) -> np.ndarray:
        """Rows x (categories, toxic)."""
        if self.chain is None:
            return np.full((len(texts), len(self.categories) + 1), self.share)
        return self.chain.probabilities(_presence(texts, self.places, self.stems))


def fit_toxicity(
    alarms: DataFrame,
    labels: DataFrame,
    categories: Mapping[str, Sequence[str]] = CATEGORIES,
    sample_rows: int = 12_000,
    vocabulary_size: int = 192,
    least_texts: int = 3,
    scratch: Scratch | None = None,
) -> ToxicityModel:
    """Fit on at most ``sample_rows`` labelled alarms, those of smallest hash.

    Words and beginnings of words are chosen by how much they tell about the
    label in the sample: at most ``vocabulary_size`` of those found in
    ``least_texts`` texts or more.
    """
    known = (
        labels.where("alarm_event_id is not null and toxic is not null")
        .groupBy("alarm_event_id")
        .agg(F.max("toxic").cast("int").alias("toxic"))
        .orderBy(F.xxhash64("alarm_event_id"))
        .limit(sample_rows)
        .withColumnRenamed("alarm_event_id", "_known_id")
    )
    # at most sample_rows rows on the broadcast side
    texts = alarms.join(F.broadcast(known), alarms.alarm_event_id == known._known_id).select("alarm_event_id", "alarm_name", "toxic")

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = Counter(), Counter()
            for text, toxic in zip(batch.column("alarm_name"), batch.column("toxic").to_pylist()):
                both[toxic > 0].update(w for w in terms_of(words_of(text.as_py())) if len(w) <= 40)
            for toxic, counts in enumerate(both):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64()), pa.array([toxic] * len(counts), pa.int32())],
                    ["word", "n", "toxic"],
                )

    texts = (scratch or Scratch(alarms.sparkSession)).stage(texts, "labelled")  # read three times
    totals = texts.groupBy().agg(F.count(F.lit(1)).alias("rows"), F.sum("toxic").alias("toxic")).first()
    rows, toxic = totals["rows"], totals["toxic"] or 0
    names = list(categories)
    share = (toxic + 0.5) / (rows + 1) if rows else 0.0
    if not 0 < toxic < rows:
        return ToxicityModel(names, [], None, 0.0 if not toxic else share)
    tallied = texts.mapInArrow(tally, "word string, n bigint, toxic int").groupBy("word").agg(
        F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("a"), F.sum("n").alias("n")
    )

    def term(seen, expected):
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    a, b = F.col("a").cast("double"), (F.col("n") - F.col("a")).cast("double")
    p = toxic / rows
    tells = 2 * (term(a, F.col("n") * p) + term(b, F.col("n") * (1 - p)))
    # the likelihood ratio of a word that has nothing to do with the label exceeds 10.8 once in a thousand times
    chosen = (
        tallied.where(F.col("n") >= least_texts).withColumn("tells", tells).where("tells >= 10.8").orderBy(F.desc("tells"), "word").limit(vocabulary_size)
    )
    vocabulary = [r["word"] for r in chosen.select("word").collect()]
    places = {word: i for i, word in enumerate(vocabulary)}
    seeds = [frozenset(categories[name]) for name in names]
    key = alarms.schema["alarm_event_id"].dataType.simpleString()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, targets = [], []
            for text, toxic in zip(batch.column("alarm_name"), batch.column("toxic").to_pylist()):
                words = words_of(text.as_py())
                found.append(sorted(places[w] for w in terms_of(words) & places.keys()))
                targets.append([int(toxic > 0 and bool(words & s)) for s in seeds] + [int(toxic > 0)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("alarm_event_id"), pa.array(found, pa.list_(pa.int32())), pa.array(targets, pa.list_(pa.int32()))],
                ["alarm_event_id", "found", "targets"],
            )

    sample = (
        texts.mapInArrow(measure, f"alarm_event_id {key}, found array<int>, targets array<int>")
        .dropDuplicates(["alarm_event_id"])
        .withColumn("fold", F.pmod(F.xxhash64(F.col("alarm_event_id").cast("string")), F.lit(FOLDS)))
        .toPandas()
        .sort_values("alarm_event_id")
    )
    x = np.zeros((len(sample), len(vocabulary)))
    for row, found in enumerate(sample["found"]):
        x[row, np.asarray(found, np.int64)] = 1
    y = np.array(sample["targets"].tolist(), float)
    return ToxicityModel(names, vocabulary, Chain(x, y, sample["fold"].to_numpy()), share)


def alarm_toxicity(
    alarms: DataFrame,
    labels: DataFrame,
    threshold: float | None = None,
    categories: Mapping[str, Sequence[str]] = CATEGORIES,
    sample_rows: int = 12_000,
) -> DataFrame:
    """Toxicity of every alarm message.

    ``labels`` has alarm_event_id and toxic (0 or 1, null: unknown; of several
    the largest counts). Returns alarm_event_id, p_<category> for each category,
    p_toxic and toxic (p_toxic >= ``threshold``; by default the one that serves the
    out-of-fold probabilities of the labelled texts best). A text alone decides.

    Null and empty messages have no words; very long ones are read whole. Null
    ids and repeated rows give a row each; without labels, or with none that is
    toxic, nothing is toxic. Empty tables give no rows; other columns are left
    out.
    """
    model = fit_toxicity(alarms, labels, categories, sample_rows)
    threshold = model.threshold if threshold is None else threshold
    names = [f"p_{name}" for name in model.categories] + ["p_toxic"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = model.probabilities(batch.column("alarm_name"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("alarm_event_id"), *(pa.array(c, pa.float64()) for c in found.T)], ["alarm_event_id", *names]
            )

    key = alarms.schema["alarm_event_id"].dataType.simpleString()
    schema = f"alarm_event_id {key}, " + ", ".join(f"{name} double" for name in names)
    scored = alarms.select("alarm_event_id", "alarm_name").mapInArrow(score, schema)
    return scored.withColumn("toxic", F.col("p_toxic") >= threshold)


def harmless_alarms(
    alarms: DataFrame, labels: DataFrame, threshold: float | None = None, sample_rows: int = 12_000, scratch: Scratch | None = None
) -> DataFrame:
    """The alarms whose message is not toxic, with all their columns, in one pass over the texts."""
    model = fit_toxicity(alarms, labels, sample_rows=sample_rows, scratch=scratch)
    threshold = model.threshold if threshold is None else threshold

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = model.probabilities(batch.column("alarm_name"))[:, -1]
            yield batch.filter(pa.array(toxic < threshold))

    return alarms.mapInArrow(keep, alarms.schema)
