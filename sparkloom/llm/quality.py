"""Quality classifier: random Fourier features of document statistics approximate a
Gaussian kernel; normal equations summed by partition fit ridge scores, and isotonic
calibration turns them into probabilities.

All labelled rows outside the held-out fold are used.  They are split in four folds, whose
normal equations are kept apart: each fold is scored by the fit of the other three, and
these scores, binned, calibrate the final fit of all four.  What reaches the driver is a
fixed number of sums, whatever the number of rows.

Defined cases
  * null text counts as empty and gets a score like any other text;
  * labels that are null are ignored; a document with several labels counts with their mean;
  * without labels every score is 0.5; repeated rows are scored each; null ids are scored,
    cannot be labelled and fall in the fold of the empty id; an empty table gives an empty
    result.
"""

from __future__ import annotations

import math
from collections import Counter
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, crc32_of_id, int64s, utf8, written

RANDOM_FEATURES, SCALE, RIDGE, SEED = 192, 4.0, 1e-4, 7
THRESHOLD, HELD_OUT, FOLDS = 0.3, 0, 5
BINS = 4096
STATISTICS = [
    "log_bytes", "log_words", "mean_word", "spaces", "letters", "capitals", "digits", "commas_stops", "marks", "symbols",
    "pipes", "ends_marked", "distinct_words", "top_word", "repeats", "distinct_pairs", "log_lines", "distinct_lines", "line_words", "entropy", "short_words", "capital_words",
]

_byte = lambda chars: np.isin(np.arange(256), list(chars))
_LOWER, _UPPER, _DIGIT, _SPACE = _byte(b"abcdefghijklmnopqrstuvwxyz"), _byte(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _byte(b"0123456789"), _byte(b" \t\n\r\v\f")
_HIGH, _STOP, _MARK, _PIPE = np.arange(256) >= 128, _byte(b",."), _byte(b"!?;:'\"-()"), _byte(b"|")
_SYMBOL = ~(_LOWER | _UPPER | _DIGIT | _SPACE | _HIGH | _STOP | _MARK | _PIPE)
_CLASSES = np.stack([_LOWER | _UPPER | _HIGH, _UPPER, _DIGIT, _SPACE, _STOP, _MARK, _SYMBOL, _PIPE]).astype(np.float64)
_ENDING = tuple(bytes([c]) for c in np.nonzero(_SYMBOL | _MARK)[0].tolist())


def statistics(text: bytes) -> list[float]:
    """The statistics of one whole text, in the order of STATISTICS."""
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256).astype(np.float64)
    total = max(1.0, float(len(text)))
    letters, upper, digits, space, stops, marks, symbols, pipes = (_CLASSES @ counts).tolist()
    share = counts[counts > 0] / total
    words = text.split()
    n = max(1, len(words))
    seen = Counter(words)
    lines = [x for x in text.split(b"\n") if x]
    return [
        math.log1p(len(text)), math.log1p(len(words)), (len(text) - space) / n, space / total, letters / total, upper / max(1.0, letters), digits / total, stops / n, marks / n, symbols / n,
        pipes / n, sum(w.endswith(_ENDING) for w in words) / n, len(seen) / n, max(seen.values(), default=0) / n, sum(map(eq, words, words[1:])) / n, len(set(zip(words, words[1:]))) / max(1, n - 1), math.log1p(len(lines)), len(set(lines)) / max(1, len(lines)),
        math.log1p(n / max(1, len(lines))), -float(share @ np.log2(share)) if len(share) else 0.0, sum(c for w, c in seen.items() if len(w) <= 3) / n, sum(c for w, c in seen.items() if w.isupper()) / n,
    ]


def _statistics(batches):
    names = ["doc_id", "bucket", *STATISTICS]
    for batch in batches:
        m = np.array([statistics(t) for t in batch.column(2).to_pylist()], np.float64).reshape(-1, len(STATISTICS))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(np.ascontiguousarray(m[:, k])) for k in range(m.shape[1]))], names)


class Features:
    """Standardised statistics, random cosines of them, and a constant."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray):
        rng = np.random.default_rng(SEED)
        self.mean, self.deviation = mean, np.where(deviation > 1e-12, deviation, 1.0)
        self.omega = rng.normal(0, 1 / SCALE, (len(mean), RANDOM_FEATURES))
        self.phase = rng.uniform(0, 2 * np.pi, RANDOM_FEATURES)

    def __call__(self, statistics: np.ndarray) -> np.ndarray:
        z = np.clip((statistics - self.mean) / self.deviation, -8, 8)
        return np.hstack([np.cos(z @ self.omega + self.phase) * math.sqrt(2 / RANDOM_FEATURES), z * 0.1, np.ones((len(z), 1))])


def _matrix(batch, first: int) -> np.ndarray:
    return np.stack([np.asarray(batch.column(first + k)) for k in range(len(STATISTICS))], 1)


def _equations(features: Features):
    """A partition's normal equations for each fold."""

    def run(batches):
        sums = {}
        for batch in batches:
            fold, y, x = int64s(batch.column(0)), np.asarray(batch.column(1), dtype=np.float64), features(_matrix(batch, 2))
            for k in np.unique(fold).tolist():
                here = x[fold == k]
                sums[k] = sums.get(k, 0) + np.vstack([here.T @ here, y[fold == k] @ here])
        for k, s in sums.items():
            yield pa.RecordBatch.from_pydict({"fold": pa.array([k], pa.int64()), "sums": pa.array([s.tobytes()], pa.binary())})

    return run


def _add(batches):
    sums = {}
    for batch in batches:
        for k, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            sums[k] = sums.get(k, 0) + np.frombuffer(s, np.float64)
    for k, s in sums.items():
        yield pa.RecordBatch.from_pydict({"fold": pa.array([k], pa.int64()), "sums": pa.array([s.tobytes()], pa.binary())})


def _solve(sums: np.ndarray) -> np.ndarray:
    a, b = sums[:-1], sums[-1]
    n = max(1.0, a[-1, -1])
    return np.linalg.solve(a + RIDGE * n * np.eye(len(a)), b)


def pool_adjacent(x: np.ndarray, weight: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic fit: mean place and level of each block, both increasing."""
    blocks: list[list[float]] = []
    for p, w, g in zip(x.tolist(), weight.tolist(), good.tolist()):
        blocks.append([p * w, w, g])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    b = np.array(blocks)
    return b[:, 0] / b[:, 1], (b[:, 2] + 0.1) / (b[:, 1] + 0.2)


class Model:
    """Statistics to a score in (0, 1); strictly increasing in the ridge score."""

    def __init__(self, features: Features | None = None, weights=None, places=None, levels=None):
        self.features, self.weights, self.places, self.levels = features, weights, places, levels

    def __call__(self, statistics: np.ndarray) -> np.ndarray:
        if self.features is None:
            return np.full(len(statistics), 0.5)
        raw = self.features(statistics) @ self.weights
        level = np.interp(raw, self.places, np.maximum.accumulate(self.levels))
        return 0.998 * level + 0.002 / (1 + np.exp(-np.clip(raw, -30, 30)))


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, its crc32 modulo FOLDS, and the statistics, in a written table."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (crc32_of_id(id_col) % FOLDS).alias("bucket"), utf8(text_col).alias("text"))
    return written(rows.mapInArrow(_statistics, "doc_id long, bucket long, " + ", ".join(f"{c} double" for c in STATISTICS)), "statistics")


def fit(stats: DataFrame, labels: DataFrame, held_out: int = HELD_OUT, label_col: str = "quality") -> Model:
    """The model of the labelled documents outside the held-out fold."""
    spark = stats.sparkSession
    known = labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.avg(F.col(label_col).cast("double")).alias("y"))
    train = written(stats.where(F.col("bucket") != held_out).join(known, "doc_id").select("bucket", "y", *STATISTICS), "train")
    s = stats.agg(*[F.avg(c) for c in STATISTICS], *[F.stddev_pop(c) for c in STATISTICS]).first()
    if s[0] is None:
        return Model()
    features = Features(np.array(s[: len(STATISTICS)], float), np.array(s[len(STATISTICS) :], float))
    # as many partial sums as there are tasks at a time, then a few, then one
    tasks = max(4, 2 * spark.sparkContext.defaultParallelism)
    schema = "fold long, sums binary"
    partial = train.coalesce(tasks).mapInArrow(_equations(features), schema)
    if tasks > 64:
        partial = partial.repartition(-(-tasks // 64)).mapInArrow(_add, schema)
    folds = {r.fold: np.frombuffer(bytes(r.sums), np.float64) for r in partial.repartition(1).mapInArrow(_add, schema).collect()}
    if not folds:
        return Model()
    width = len(STATISTICS) + RANDOM_FEATURES + 1
    total = sum(folds.values()).reshape(-1, width)
    weights = _solve(total)
    apart = {k: _solve(total - v.reshape(-1, width)) if len(folds) > 1 else weights for k, v in folds.items()}

    def bins(batches):
        for batch in batches:
            fold, x = int64s(batch.column(0)), features(_matrix(batch, 2))
            raw = np.zeros(len(fold))
            for k, w in apart.items():
                raw[fold == k] = x[fold == k] @ w
            yield pa.RecordBatch.from_arrays([pa.array(np.clip((raw + 1) * (BINS / 3), 0, BINS - 1).astype(np.int64)), batch.column(1)], ["bin", "y"])

    table = sorted(train.mapInArrow(bins, "bin long, y double").groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("good")).collect())
    b = np.array([(r.bin, r.n, r.good) for r in table], float)
    return Model(features, weights, *pool_adjacent((b[:, 0] + 0.5) * (3 / BINS) - 1, b[:, 1], b[:, 2]))


def classify(docs: DataFrame, labels: DataFrame, held_out: int = HELD_OUT, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    bounded_batches(docs.sparkSession)
    stats = measured(docs)
    model = fit(stats, labels, held_out)

    def score(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(int64s(batch.column(1)) == held_out), pa.array(model(_matrix(batch, 2)))], ["doc_id", "held_out", "score"])

    scored = stats.mapInArrow(score, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame, held_out: int = HELD_OUT, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that the classifier accepts, all columns as they came.  They are written
    with their statistics, which so are taken once, for the fit and for the scores."""
    bounded_batches(docs.sparkSession)
    schema = T.StructType([*docs.schema.fields, T.StructField("_statistics", T.ArrayType(T.DoubleType()))])

    def measure(batches):
        for batch in batches:
            m = pa.array([statistics(t) for t in batch.column(batch.num_columns - 1).to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], m], [*batch.schema.names[:-1], "_statistics"])

    whole = written(docs.select(*docs.columns, utf8(text_col).alias("_bytes")).mapInArrow(measure, schema), "measured")
    each = [F.col("_statistics")[k].alias(c) for k, c in enumerate(STATISTICS)]
    model = fit(whole.select(F.col(id_col).cast("long").alias("doc_id"), (crc32_of_id(id_col) % FOLDS).alias("bucket"), *each), labels, held_out)

    def keep(batches):
        for batch in batches:
            if batch.num_rows:
                m = np.asarray(batch.column(batch.num_columns - 1).flatten()).reshape(-1, len(STATISTICS))
                yield batch.select(range(batch.num_columns - 1)).filter(pa.array(model(m) >= threshold))

    return whole.mapInArrow(keep, docs.schema)


def op4_quality_classifier(spark, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
