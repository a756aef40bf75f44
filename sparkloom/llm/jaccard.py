"""N-gram Jaccard join with Bayesian candidate pruning.

Texts are sets of word shingles; documents with one set form a copy class, and classes
are joined.  Candidates share a band of their MinHash signature.  Candidates compare
their signatures some values at a time, and a pair is dropped as soon as the posterior
probability that its Jaccard similarity reaches the threshold falls under a tolerance;
what survives ties classes together loosely.  All pairs of such a group are then pruned the
same way and verified exactly on their shingle sets, each pair in one place.  Links are
counted and groups joined where they are found: no pair leaves its task.  Groups of more
than a tile go through pairs of tiles, so that a task's size has a fixed bound.

Words are what ASCII white space separates, in ASCII lower case; a text of fewer words
than a shingle has one shingle of all its words, a text without words none.

Defined cases
  * null text counts as empty; texts without words form one copy class without links;
  * class_id is the least doc_id of the documents tied by links, copy_id of those of one
    shingle set; null ids give way to others and stay null where all are;
  * n_links counts other copy classes at the threshold or more, n_copies the documents of
    one's own; repeated rows are copies; an empty table gives an empty result.
"""

from __future__ import annotations

from fractions import Fraction
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, pieces, split_words, text, written
from .components import components, hot_join

WORDS, THRESHOLD = 5, 0.8
BANDS, ROWS = 28, 4  # a pair at the threshold misses all bands with a chance of 4e-7
TOLERANCE, STEP = 1e-5, 16
TILE = 512

_rng = np.random.default_rng(20240601)
_MUL = (_rng.integers(0, 2**32, BANDS * ROWS, dtype=np.uint64) | 1).astype(np.uint32)[:, None]
_ADD = _rng.integers(0, 2**32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32)[:, None]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def shingles(texts: pa.Array, size: int = WORDS):
    """For each text the sorted distinct 64-bit hashes of its word shingles."""
    words, codes, counts = split_words(texts)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))[codes]
    at = 0
    for count in counts.tolist():
        w, at = hashes[at : at + count], at + count
        if not count:
            yield np.empty(0, np.uint64)
            continue
        n = max(1, count - size + 1)
        h = np.full(n, min(count, size), np.uint64)
        for k in range(min(size, count)):
            h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + w[k : k + n])
        yield np.unique(h)


def signature(sh: np.ndarray) -> np.ndarray:
    """MinHash values of a shingle set, as many as BANDS * ROWS."""
    x = (sh >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(_MUL), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 1024):
        v = _MUL * x[None, at : at + 1024]
        v += _ADD
        v ^= v >> np.uint32(16)
        np.minimum(out, v.min(axis=1), out=out)
    return out


def set_digest(sh: np.ndarray) -> tuple[int, int]:
    """128 bits that depend on the set alone."""
    with np.errstate(over="ignore"):
        d = np.array([_mix(sh).sum(), _mix(sh ^ np.uint64(0xA0761D6478BD642F)).sum()], np.uint64) + np.uint64(len(sh))
    return tuple(d.view(np.int64).tolist())


def least_matches(n: int, threshold: float, tolerance: float) -> int:
    """The least matches among n values with which the posterior of the similarity, from a
    uniform prior, still puts at least ``tolerance`` on the threshold or more."""
    total = 0.0
    for m in range(n + 1):
        total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if total >= tolerance:
            return m
    return n + 1


def prune(sig: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float, tolerance: float, block: int = 1 << 15) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs (a, b) of rows those that the posterior never rules out; some pairs at a
    time, so that many pairs take little memory."""
    least = [least_matches(min(at + STEP, sig.shape[1]), threshold, tolerance) for at in range(0, sig.shape[1], STEP)]
    kept = []
    for cut in range(0, len(a), block):
        x, y = a[cut : cut + block], b[cut : cut + block]
        seen = np.zeros(len(x), np.int64)
        for k, at in enumerate(range(0, sig.shape[1], STEP)):
            seen += (sig[x, at : at + STEP] == sig[y, at : at + STEP]).sum(1)
            keep = seen >= least[k]
            x, y, seen = x[keep], y[keep], seen[keep]
        kept.append((x, y))
    return tuple(np.concatenate([k[i] for k in kept]) if kept else np.empty(0, np.int64) for i in (0, 1))


def tile_pairs(left: np.ndarray, right: np.ndarray | None, most: int = 1 << 16):
    """Index pairs within ``left``, or between both, some at a time."""
    if right is None:
        n, at = len(left), 0
        while at < n - 1:
            end, held = at, 0
            while end < n - 1 and (end == at or held + n - 1 - end <= most):
                held += n - 1 - end
                end += 1
            rows = np.arange(at, end)
            count = n - 1 - rows
            i = np.repeat(rows, count)
            j = np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count) + i + 1
            yield left[i], left[j]
            at = end
    else:
        step = max(1, most // max(1, len(right)))
        for at in range(0, len(left), step):
            cut = left[at : at + step]
            yield np.repeat(cut, len(right)), np.tile(right, len(cut))


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index of each index's component."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def shared(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact intersection sizes of the pairs."""
    if len(a) <= 16 * len(sets):
        return np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(a.tolist(), b.tolist())], np.int64)
    # many pairs among few sets: count by shingle instead
    n = len(sets)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    _, column, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    start = np.cumsum(df) - df
    count = np.zeros((n, n), np.int32)
    wide = np.nonzero(df > 12)[0]
    for at in range(0, len(wide), 2048):
        place = np.full(len(df), -1)
        place[wide[at : at + 2048]] = np.arange(len(wide[at : at + 2048]))
        here = place[column] >= 0
        m = np.zeros((n, len(wide[at : at + 2048])), np.float32)
        m[row[here], place[column[here]]] = 1
        count += (m @ m.T).astype(np.int32)
    for d in range(2, 13):
        rows = row[start[df == d][:, None] + np.arange(d)]
        for i in range(d):
            for j in range(i + 1, d):
                np.add.at(count, (rows[:, i], rows[:, j]), 1)
                np.add.at(count, (rows[:, j], rows[:, i]), 1)
    return count[a, b].astype(np.int64)


def _sketch(size: int):
    def run(batches):
        for batch in (piece for whole in batches for piece in pieces(whole, 2)):
            rows = []
            for sh in shingles(batch.column(2), size):
                rows.append((*set_digest(sh), len(sh), signature(sh).tobytes()))
            d1, d2, n, sig = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(n, pa.int64()), pa.array(sig, pa.binary())], ["uid", "doc_id", "text_hash", "d1", "d2", "n", "sig"])

    return run


def _groups(batches, keys: int):
    """Runs of rows with equal leading columns, of a sorted partition, as tables."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([np.asarray(batch.column(k), dtype=np.int64) for k in range(keys)], 1)
        cuts = [0, *(np.nonzero((key[1:] != key[:-1]).any(1))[0] + 1).tolist(), len(key)]
        for i, j in zip(cuts, cuts[1:]):
            k = tuple(key[i].tolist())
            if held and k != last:
                yield last, pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(i, j - i))
            last = k
    if held:
        yield last, pa.Table.from_batches(held)


def _sides(key, block: np.ndarray):
    left = np.nonzero(block == key[1])[0]
    return (left, None) if key[1] == key[2] else (left, np.nonzero(block == key[2])[0])


def _candidates(threshold: float, tolerance: float):
    """Buckets to a forest of the pairs that pruning leaves."""

    def settle(cids, sigs, lists):
        cid, sig = np.concatenate(cids), np.concatenate(sigs)
        a, b = (np.concatenate([x[k] for x in lists]) for k in (0, 1)) if lists else (np.empty(0, np.int64),) * 2
        a, b = prune(sig, a, b, threshold, tolerance)
        ids, place = np.unique(cid, return_inverse=True)
        root = roots(len(ids), place[a], place[b])
        own = np.nonzero(root != np.arange(len(ids)))[0]
        return pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array(ids[root[own]])], ["a", "b"])

    def run(batches):
        cids, sigs, lists, n, pairs = [], [], [], 0, 0
        for key, table in _groups(batches, 3):
            cid = np.asarray(table.column(4), dtype=np.int64)
            sig = np.frombuffer(b"".join(table.column(5).to_pylist()), np.uint32).reshape(len(cid), -1)
            for a, b in tile_pairs(*_sides(key, np.asarray(table.column(3), dtype=np.int64))):
                if len(a) > 10_000:
                    a, b = prune(sig, a, b, threshold, tolerance)
                lists.append((a + n, b + n))
                pairs += len(a)
            cids.append(cid)
            sigs.append(sig)
            n += len(cid)
            if n > 8_192 or pairs > 1 << 18:
                yield settle(cids, sigs, lists)
                cids, sigs, lists, n, pairs = [], [], [], 0, 0
        if n:
            yield settle(cids, sigs, lists)

    return run


def _verify(size: int, threshold: float, tolerance: float):
    """Groups to each class's number of links and root within its tile."""
    t = Fraction(threshold).limit_denominator(10_000)

    def run(batches):
        for key, table in _groups(batches, 3):
            cid, d1, d2 = (np.asarray(table.column(k), dtype=np.int64) for k in (4, 5, 6))
            sets = [s for chunk in table.column(7).chunks for s in shingles(chunk, size)]
            # rows that repeat an id come with every row of it: keep one of the class's own text
            fit = np.array([set_digest(s) == (x, y) for s, x, y in zip(sets, d1.tolist(), d2.tolist())], bool)
            _, at = np.unique(np.where(fit, cid, -1), return_index=True)
            at = np.array([i for i in at.tolist() if fit[i]], np.int64)
            sets, cid, block = [sets[i] for i in at], cid[at], np.asarray(table.column(3), dtype=np.int64)[at]
            if not sets:
                continue
            sig, length = np.stack([signature(s) for s in sets]), np.array([len(s) for s in sets])
            links, found = np.zeros(len(cid), np.int64), []
            for a, b in tile_pairs(*_sides(key, block)):
                a, b = prune(sig, a, b, threshold, tolerance)
                found.append((a, b))
            a, b = (np.concatenate([x[k] for x in found]) if found else np.empty(0, np.int64) for k in (0, 1))
            both = shared(sets, a, b)
            good = t.denominator * both >= t.numerator * (length[a] + length[b] - both)
            a, b = a[good], b[good]
            np.add.at(links, a, 1)
            np.add.at(links, b, 1)
            root = roots(len(cid), a, b)
            yield pa.RecordBatch.from_arrays([pa.array(cid), pa.array(cid[root]), pa.array(links)], ["a", "b", "links"])

    return run


def _tiled(df: DataFrame, group: str, size: str, tile: int) -> DataFrame:
    """Rows of a group dealt to blocks, and to every pair of blocks that they belong to."""
    blocks = F.ceil(F.col(size) / F.lit(tile)).cast("long")
    own = df.withColumn("nb", blocks).withColumn("block", F.pmod(F.xxhash64("cid"), F.col("nb")))
    pair = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    return pair.select(F.col(group).alias("g"), F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "cid", *[c for c in df.columns if c not in (group, size, "cid")])


def _uid(id_col: str, text_col: str):
    """A document's id, or a hash of its text where it has none."""
    return F.coalesce(F.col(id_col).cast("long"), _text_hash(text_col))


def _text_hash(text_col: str):
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def classified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WORDS, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, tile: int = TILE) -> DataFrame:
    """As ``near_duplicates``, with text_hash and component, which tells classes apart even
    where ids repeat."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(_uid(id_col, text_col).alias("uid"), F.col(id_col).cast("long").alias("doc_id"), text(text_col).alias("text"))
    sketch = written(rows.select("*", F.xxhash64("text").alias("text_hash")).mapInArrow(_sketch(size), "uid long, doc_id long, text_hash long, d1 long, d2 long, n long, sig binary"), "sketches")
    classes = written(sketch.groupBy("d1", "d2").agg(F.min("uid").alias("uid"), F.min("doc_id").alias("copy_id"), F.count(F.lit(1)).alias("n_copies"), F.first("n").alias("n"), F.first("sig").alias("sig")).withColumn("cid", F.monotonically_increasing_id()), "classes")

    band = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.xxhash64(k, F.substring("sig", k * (4 * ROWS) + 1, F.lit(4 * ROWS)))))
    keys = classes.where("n > 0").select("cid", band.alias("band", "key")).select("cid", "key")
    alike = written(keys.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1").withColumn("n", F.col("size")), "bands")
    met = hot_join(keys, alike, "key", "n", alike.agg(F.sum("n")).first()[0] or 0)
    buckets = _tiled(met.join(classes.select("cid", "sig"), "cid"), "key", "size", 2 * tile).repartition("g", "i", "j").sortWithinPartitions("g", "i", "j")
    loose = components(buckets.mapInArrow(_candidates(threshold, tolerance), "a long, b long"))

    sizes = loose.groupBy("component").agg(F.count(F.lit(1)).alias("size")).withColumn("n", F.col("size"))
    members = hot_join(loose, sizes, "component", "n", loose.count()).withColumnRenamed("id", "cid").join(classes.select("cid", "uid", "d1", "d2"), "cid")
    texts = members.join(rows.select("uid", "text"), "uid").select("component", "size", "cid", "d1", "d2", "text")
    groups = _tiled(texts, "component", "size", tile).repartition("g", "i", "j").sortWithinPartitions("g", "i", "j")
    verified = written(groups.mapInArrow(_verify(size, threshold, tolerance), "a long, b long, links long"), "links")
    links = verified.groupBy(F.col("a").alias("cid")).agg(F.sum("links").alias("n_links"))
    final = components(verified.select("a", "b")).select(F.col("id").alias("cid"), "component")

    tied = classes.select("cid", "d1", "d2", "uid", "copy_id", "n_copies").join(links, "cid", "left").join(final, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    tied = written(tied, "tied")
    heads = tied.groupBy("component").agg(F.min("uid").alias("class_uid"), F.min("copy_id").alias("class_id"), F.count(F.lit(1)).alias("n"))
    tied = hot_join(tied, heads, "component", "n", tied.count()).select("d1", "d2", "component", "class_uid", "class_id", "copy_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies")
    return sketch.select("uid", "doc_id", "text_hash", "d1", "d2").join(tied, ["d1", "d2"]).drop("d1", "d2")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row for each document: uid (its id, or a hash of its text), doc_id, class_uid,
    class_id, copy_id, n_links and n_copies."""
    return classified(docs, id_col, text_col, **options).drop("text_hash", "component")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents with one of each class of near duplicates left, that of the least id; of
    rows that share this id too, one text's, and of rows that are all the same, one."""
    found = classified(docs, id_col, text_col, **options)
    stay = found.groupBy("component").agg(F.min(F.struct("uid", "text_hash")).alias("head")).select(F.col("head.uid").alias("_uid"), F.col("head.text_hash").alias("_text"))
    marked = docs.withColumn("_uid", _uid(id_col, text_col)).withColumn("_text", _text_hash(text_col))
    return marked.join(stay, ["_uid", "_text"], "left_semi").dropDuplicates(["_uid", "_text"]).select(*docs.columns)


def op3_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "class_id", "copy_id", "n_links", "n_copies")
