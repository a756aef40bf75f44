"""Document fingerprints: quartile bucket digests of hashed byte triplets.

A digest counts the hashed byte triplets of a whole text in ``BUCKETS`` buckets and writes
each bucket as two bits, by the quartile of the text's own counts that it falls in; a
header holds the length (logarithmic), the quartile ratios and a checksum byte.  Two
digests are compared by a bounded difference, given here as a likeness from 0 to 1.

Defined cases
  * null text counts as empty; texts under three bytes have no triplet, so an all-zero
    body, and differ by length and checksum;
  * equal texts have equal fingerprints and likeness 1;
  * "next" follows descending doc_id, null ids last, equal ids by text hash; the last row's
    next is the first row, and a single row is its own next;
  * repeated rows are kept, extra columns are ignored, an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, written

BUCKETS = 1024
LENGTH_STEP, LENGTH_CAP, RATIO_STEP = 16, 40, 4
RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def bucket_counts(data: bytes, buckets: int = BUCKETS) -> np.ndarray:
    a = np.frombuffer(data, np.uint8)
    counts = np.zeros(buckets, np.int64)
    shift = np.uint32(32 - int(math.log2(buckets)))
    for at in range(0, max(0, len(a) - 2), 1 << 20):  # blocks bound the memory of a very long text
        b = a[at : at + (1 << 20) + 2].astype(np.uint32)
        h = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
        h *= np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA77)
        counts += np.bincount(h >> shift, minlength=buckets)
    return counts


def digest(text: str, buckets: int = BUCKETS) -> np.ndarray:
    """Header (length code, quartile ratios, checksum) and packed quartile codes."""
    data = text.encode("utf-8", "surrogatepass")
    counts = bucket_counts(data, buckets)
    at = [buckets // 4 - 1, buckets // 2 - 1, 3 * buckets // 4 - 1]
    q1, q2, q3 = np.partition(counts, at)[at]
    codes = ((counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)).reshape(-1, 4)
    body = codes[:, 0] << 6 | codes[:, 1] << 4 | codes[:, 2] << 2 | codes[:, 3]
    ratio = lambda q: int(15 * q / q3) if q3 else 0
    head = [min(255, int(10 * math.log1p(len(data)))), ratio(q1) << 4 | ratio(q2), zlib.crc32(data) & 255]
    return np.concatenate([np.array(head, np.uint8), body.astype(np.uint8)])


_A, _B = np.arange(256)[:, None], np.arange(256)[None, :]
#: Difference of two packed bytes: sum over the four codes, where opposite quartiles count 6.
_PAIR = sum(np.array([0, 1, 2, 6])[np.abs((_A >> s & 3) - (_B >> s & 3))] for s in (0, 2, 4, 6)).astype(np.uint8)


def likeness(x: np.ndarray, y: np.ndarray) -> float:
    """1 for equal digests, falling with the bounded difference to 0."""
    most = 24 * (len(x) - 3) + LENGTH_STEP * LENGTH_CAP + RATIO_STEP * 30 + 1
    apart = int(_PAIR[x[3:], y[3:]].sum()) + LENGTH_STEP * min(LENGTH_CAP, abs(int(x[0]) - int(y[0])))
    apart += RATIO_STEP * (abs((int(x[1]) >> 4) - (int(y[1]) >> 4)) + abs((int(x[1]) & 15) - (int(y[1]) & 15))) + (x[2] != y[2])
    return 1.0 - apart / most


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _row(doc_id, text, own, following, its):
    new = edited(text, following)
    d = digest(new)
    return (doc_id, len(text), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), own.tobytes().hex(), d.tobytes().hex(), likeness(own, d), likeness(own, its))


def _batch(rows, schema):
    return pa.RecordBatch.from_arrays([pa.array(list(c), t.type) for c, t in zip(zip(*rows), schema)], schema=schema)


_FIELDS = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
_NONE = (None,) * 5


def _chain(batches):
    """Rows in order of a range partition: each finished with its next; of the partition's
    ends, the first text and the last row come out as they are."""
    from pyspark import TaskContext

    schema = pa.schema([*_FIELDS, ("part", pa.int64()), ("side", pa.int64()), ("text", pa.string())])
    part, held, rows = TaskContext.get().partitionId(), None, []
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            own = digest(text)
            if held is None:
                rows.append((None, None, *_NONE, part, 1, text))
            else:
                rows.append((*_row(*held, text, own), part, 0, None))
            held = (doc_id, text, own)
            if len(rows) >= 512:
                yield _batch(rows, schema)
                rows = []
    if held is not None:
        rows.append((held[0], None, *_NONE, part, 2, held[1]))
        yield _batch(rows, schema)


def _ends(batches):
    schema = pa.schema(_FIELDS)
    for batch in batches:
        rows = [_row(i, t, digest(t), n, digest(n)) for i, t, n in zip(*(batch.column(k).to_pylist() for k in range(3)))]
        if rows:
            yield _batch(rows, schema)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digest of every whole text, of its edited text, and their likenesses (RESULT)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # equal ids go on by text hash, and equal rows by a place of their own, so that no key
    # holds a partition together
    keyed = rows.withColumn("h", F.xxhash64("text")).withColumn("at", F.monotonically_increasing_id())
    order = [F.col("doc_id").desc_nulls_last(), F.col("h"), F.col("at")]
    chained = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    done = written(chained.mapInArrow(_chain, f"{RESULT}, part long, side long, text string"), "digests")
    parts = sorted(r.part for r in done.where("side = 1").select("part").collect())  # one for each partition
    if not parts:
        return spark.createDataFrame([], RESULT)
    nexts = spark.createDataFrame([(p, q) for p, q in zip(parts, parts[1:] + parts[:1])], "part long, next_part long")
    firsts = done.where("side = 1").select(F.col("part").alias("next_part"), F.col("text").alias("following"))
    # whole texts meet by shuffle; of what is broadcast there is one row of two numbers for each partition
    lasts = done.where("side = 2").select("part", "doc_id", "text").join(F.broadcast(nexts), "part").hint("merge").join(firsts.hint("merge"), "next_part")
    ends = lasts.select("doc_id", "text", "following").mapInArrow(_ends, RESULT)
    return done.where("side = 0").drop("part", "side", "text").unionByName(ends)


def op2_document_fingerprints(spark, sf_dir: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
