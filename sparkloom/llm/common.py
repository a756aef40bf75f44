"""Helpers that all operators of this subpackage share: written tables in the shared
folder, bounded Arrow batches and byte-level text access."""

from __future__ import annotations

import atexit
import sys
import tempfile
import types
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"
_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share.  The cluster names it in
    ``spark.checkpoint.dir``; only where that is unset and all runs on one machine (as in
    tests) a temporary folder is made and set."""
    path = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(CHECKPOINT_CONF)
    if not path:
        path = spark.sparkContext._jsc.sc().getCheckpointDir()
        path = path.get() if path.isDefined() else None
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="sparkloom-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.  This cuts the
    lineage, survives lost executors and computes each row once however often the
    result is used.  The files go when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sparkloom-{label}-{uuid.uuid4().hex}"
    df.write.mode("error").option("compression", "zstd").parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def _drop_written() -> None:
    for spark, path in _written:
        try:
            jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(conf).delete(target, True)
        except Exception:  # the session is gone; the shared folder's own clean-up applies
            return


def bounded_batches(spark: SparkSession, rows: int = 2048, size: int = 16 << 20) -> None:
    """Bound what one Arrow batch holds, by rows and by bytes: very long texts else make
    batches of any size."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def utf8(column: str):
    """The text's UTF-8 bytes, null as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")


def kept(group: str, name: str, make):
    """An object of this worker process, kept from task to task.  A worker holds those of
    one operator at a time, so that its memory stays bounded through a pipeline."""
    held = sys.modules.setdefault("_sparkloom_kept", types.ModuleType("_sparkloom_kept")).__dict__
    if held.get("group") != group:
        held.clear()
        held["group"] = group
    if name not in held:
        held[name] = make()
    return held[name]


def int64s(column: pa.Array) -> np.ndarray:
    """A long column as numpy; nulls become 0 and need a mask of their own."""
    return column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64, copy=False)


def crc32_of_id(column: str = "doc_id"):
    """crc32 of the id as decimal text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def text(column: str):
    """The text as a string, null as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def pieces(batch: pa.RecordBatch, column: int, size: int = 8 << 20):
    """Slices of a batch whose texts have at most about ``size`` bytes, one text at least."""
    offsets = np.frombuffer(batch.column(column).buffers()[1], np.int32)[batch.column(column).offset :][: batch.num_rows + 1].astype(np.int64)
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def coded_words(texts: pa.Array, lower: bool = True) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words between ASCII white space, in ASCII lower case unless told otherwise: the
    distinct words, each word's place among them, and the number of words of each text."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    counts = np.diff(np.asarray(lists.offsets)).astype(np.int64)
    flat = lists.flatten()
    empty = np.asarray(pc.equal(pc.binary_length(flat), 0))
    if empty.any():  # white space at either end leaves an empty word
        counts -= np.bincount(np.repeat(np.arange(len(counts)), counts)[empty], minlength=len(counts))
        flat = flat.filter(pa.array(~empty))
    coded = flat.dictionary_encode()
    return coded.dictionary.cast(pa.binary()), np.asarray(coded.indices), counts


def split_words(texts: pa.Array, lower: bool = True) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """As ``coded_words``, with the distinct words as a list."""
    words, codes, counts = coded_words(texts, lower)
    return words.to_pylist(), codes, counts
