"""Mixing sources to target weights, in DataFrame operations alone.

Temperature mixing: a source's weight is its share of all tokens to the power of an
exponent, normalised.  The exponent is found by bracketing: the entropy of the weights and
the largest repetition of a source are computed for a grid of exponents at once, and the
bracket shrinks around the target.  Weights become token budgets, and a source's budget is
filled by whole passes over its documents and a part of one more; every pass is a keyed
permutation of the source's blocks, and of the documents of each block, so that a prefix
of any pass is a random part of the source.  Rows sorted by ``place`` come in the mixture's
proportions from the first to the last.

Defined cases
  * null text counts as empty; a document has its words and one end as tokens, so every
    source has a share; a null source is a source of its own;
  * rows equal in id, text and source are taken together, as often as they are there;
  * one source gets weight 1; an empty table gives an empty result;
  * a pass ends with the document in which its budget is reached.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

BLOCKS, BLOCK_TOKENS = 1024, 1 << 24  # blocks of a source at least, and their tokens at most (if one source had all)
GRID, ROUNDS = 32, 5
SEED = 20240601


def tokens(text: str) -> Column:
    return (F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"\S+")) + 1).cast("long")


def _measures(shares: DataFrame, low: float, high: float, total: float, budget: float | None) -> list:
    """Entropy of the weights and the largest repetition, for a grid of exponents."""
    grid = shares.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(GRID)))).withColumn("x", F.lit(low) + F.col("k") * ((high - low) / GRID))
    power = F.pow("p", F.col("x"))
    sums = grid.groupBy("k", "x").agg(F.sum(power).alias("z"), F.sum(power * F.log("p")).alias("a"), F.max(F.pow("p", F.col("x") - 1)).alias("most"), F.min(F.pow("p", F.col("x") - 1)).alias("least"))
    repeat = F.col("most") / F.col("least") if budget is None else F.col("most") / F.col("z") * (budget / total)
    return sums.select("k", "x", (F.log("z") - F.col("x") * F.col("a") / F.col("z")).alias("entropy"), repeat.alias("repetition")).orderBy("k").collect()


def exponent(totals: DataFrame, total: float, budget: float | None, target_entropy: float | None, max_repetition: float | None) -> float:
    """The exponent from 0 (even weights) to 1 (the sources' own shares): the largest whose
    entropy reaches ``target_entropy`` (a part of the greatest possible), raised as far as
    ``max_repetition`` asks for."""
    shares = totals.select((F.col("total") / F.lit(total)).alias("p"))
    n = totals.count()
    if n < 2:
        return 1.0
    aims = []
    if target_entropy is not None:
        aims.append(lambda r: r.entropy >= target_entropy * math.log(n) - 1e-12)
    if max_repetition is not None:
        aims.append(lambda r: r.repetition > max_repetition)
    found = []
    for wide in aims:  # each holds below its exponent and fails above
        low, high = 0.0, 1.0
        for _ in range(ROUNDS):
            rows = _measures(shares, low, high, total, budget)
            if wide(rows[-1]):
                low = high
                break
            held = [r.x for r in rows if wide(r)]
            if not held:
                high = low
                break
            low = max(held)
            high = min(r.x for r in rows if r.x > low)
        found.append(low if wide is aims[0] and target_entropy is not None else high)
    return max(found, default=1.0)


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", budget: float | str | None = "total", target_entropy: float | None = 0.95, max_repetition: float | None = 4.0, blocks: int | None = None, seed: int = SEED) -> DataFrame:
    """The selected copies: doc_id, text_hash, source, n_copies, n_tokens, weight, epoch,
    block and place.  ``budget``: tokens, "total" for as many as there are, or "cover" for
    the least that takes every source once."""
    hashed = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash"), F.col(source_col).cast("string").alias("source"), tokens(text_col).alias("n"))
    sized = written(hashed.groupBy("doc_id", "text_hash", "source").agg(F.count(F.lit(1)).alias("n_copies"), F.first("n").alias("n_tokens")), "sized")
    key = F.coalesce(F.xxhash64("source"), F.lit(0))
    blocks = blocks or max(BLOCKS, -(-(sized.agg(F.sum(F.col("n_tokens") * F.col("n_copies"))).first()[0] or 0) // BLOCK_TOKENS))
    sized = sized.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text_hash"), F.lit(blocks))).withColumn("mass", F.col("n_tokens") * F.col("n_copies"))
    block_mass = written(sized.groupBy("source", "block").agg(F.sum("mass").alias("block_mass")), "blocks")
    totals = block_mass.groupBy("source").agg(F.sum("block_mass").alias("total"))
    total = totals.agg(F.sum("total")).first()[0]
    if not total:
        return sized.select("doc_id", "text_hash", "source", "n_copies", "n_tokens", F.lit(0.0).alias("weight"), F.lit(0).alias("epoch"), "block", F.lit(0.0).alias("place"))
    size = None if budget == "cover" else float(total if budget == "total" else budget)
    x = exponent(totals, float(total), size, target_entropy, max_repetition)
    power = F.pow(F.col("total") / F.lit(float(total)), F.lit(x))
    z, cover = totals.agg(F.sum(power), F.max(F.col("total") / power)).first()
    size = cover * z if size is None else size
    weights = totals.select("source", "total", (power / F.lit(z)).alias("weight")).withColumn("due", F.col("weight") * F.lit(size))

    # the passes of a source over its blocks: at most ``blocks`` rows for each pass
    passes = block_mass.join(weights, block_mass["source"].eqNullSafe(weights["source"])).drop(weights["source"])
    passes = passes.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("due") / F.col("total") - 1e-9).cast("int") - 1))))
    by_pass = Window.partitionBy(F.xxhash64("source"), "source", "epoch").orderBy(F.xxhash64(F.lit(seed), "epoch", "source", "block"), "block")
    start = F.coalesce(F.sum("block_mass").over(by_pass.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    passes = passes.withColumn("start", F.col("epoch") * F.col("total") + start).where(F.col("start") < F.col("due") - 1e-6)
    passes = passes.select(key.alias("key"), "source", "block", "epoch", "start", "weight", "due")

    dealt = sized.withColumn("key", key).drop("source").join(passes, ["key", "block"])
    in_block = Window.partitionBy("key", "block", "epoch").orderBy(F.xxhash64(F.lit(seed), "epoch", "doc_id", "text_hash"), "doc_id", "text_hash")
    at = F.col("start") + F.coalesce(F.sum("mass").over(in_block.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    chosen = dealt.withColumn("at", at).where(F.col("at") < F.col("due") - 1e-6)
    return chosen.select("doc_id", "text_hash", "source", "n_copies", "n_tokens", "weight", "epoch", "block", (F.col("at") / F.col("due")).alias("place"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The documents as the mixture takes them: rows come as often as they are chosen."""
    chosen = mixture(docs, id_col, text_col, source_col, **options)
    times = chosen.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.col("source").alias("_source")).agg(F.count(F.lit(1)).alias("_times"))
    keyed = docs.withColumn("_text", F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    same = keyed[id_col].eqNullSafe(times["_id"]) & (keyed["_text"] == times["_hash"]) & keyed[source_col].cast("string").eqNullSafe(times["_source"])
    taken = keyed.join(times, same).select(*[keyed[c] for c in docs.columns], "_times")
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times").cast("int")))).select(*docs.columns)


def op1_source_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = mixture(docs).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("n_copies").cast("int"))))
    return rows.select("doc_id", "source", "n_tokens", "weight", "epoch", "block", "place")
