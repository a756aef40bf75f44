"""Mixing, packing and the pipeline."""

import math
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import mixing, packing
from tests.llm.conftest import rows_to_docs, words

# ---------------------------------------------------------------- mixing


def mix_rows():
    import random

    rng = random.Random(2)
    return [(i, words(rng, rng.randrange(5, 60)), "big" if i % 3 else f"s{i % 5}") for i in range(600)]


def shares(rows):
    total = defaultdict(int)
    for _, t, s in rows:
        total[s] += len((t or "").split()) + 1
    return total


def brute_exponent(total, entropy=None, repetition=None, budget=None):
    p = np.array(list(total.values()), float)
    p /= p.sum()

    def h(x):
        w = p**x / (p**x).sum()
        return -(w * np.log(w)).sum()

    def r(x):
        return (p ** (x - 1)).max() / ((p ** (x - 1)).min() if budget == "cover" else (p**x).sum())

    grid = np.linspace(0, 1, 200_001)
    found = []
    if entropy is not None:
        ok = [x for x in (0.0, 1.0) if h(x) >= entropy * math.log(len(p))]
        lo, hi = 0.0, 1.0
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if h(mid) >= entropy * math.log(len(p)) else (lo, mid)
        found.append(lo if ok else 0.0)
    if repetition is not None:
        found.append(next((x for x in grid[:: 20] if r(x) <= repetition), 1.0))
    return max(found)


@pytest.mark.parametrize("entropy, repetition, budget", [(0.9, None, "total"), (0.99, None, "total"), (None, 2.0, "total"), (0.99, 1.5, "total"), (0.95, 2.0, "cover"), (None, None, "total")])
def test_weights(spark, entropy, repetition, budget):
    rows = mix_rows()
    total = shares(rows)
    got = mixing.mixture(rows_to_docs(spark, rows), budget=budget, target_entropy=entropy, max_repetition=repetition, blocks=8).collect()
    weight = {r.source: r.weight for r in got}
    x = brute_exponent(total, entropy, repetition, budget) if entropy or repetition else 1.0
    p = {s: (n / sum(total.values())) ** x for s, n in total.items()}
    for s in total:
        assert weight[s] == pytest.approx(p[s] / sum(p.values()), rel=2e-3)
    size = sum(total.values()) if budget == "total" else max(n / weight[s] for s, n in total.items())
    taken = defaultdict(int)
    for r in got:
        taken[r.source] += r.n_tokens * r.n_copies
    for s in total:
        assert -1e-6 <= taken[s] - weight[s] * size <= 62
    if budget == "cover":
        assert {r.doc_id for r in got} == {i for i, _, _ in rows}
    if repetition and budget == "total":
        assert max(taken[s] / total[s] for s in total) <= repetition + 0.35


def test_passes_are_whole_and_differ(spark):
    rows = mix_rows()
    got = mixing.mixture(rows_to_docs(spark, rows), max_repetition=None, target_entropy=1.0, blocks=8).collect()
    passes = defaultdict(list)
    for r in got:
        passes[r.source, r.epoch].append((r.place, r.doc_id))
    sizes = {s: sum(x == s for _, _, x in rows) for s in shares(rows)}
    for (s, e), docs in passes.items():
        ids = [i for _, i in sorted(docs)]
        assert len(set(ids)) == len(ids) and (len(ids) == sizes[s] if (s, e + 1) in passes else True)
        if (s, e + 1) in passes:
            assert ids[:20] != [i for _, i in sorted(passes[s, e + 1])][:20]
    assert all(0 <= r.place < 1 for r in got)


def test_mixing_edges(spark, edge_docs, edge_rows, no_docs):
    got = mixing.mixed(edge_docs, budget="cover", target_entropy=1.0, max_repetition=None)
    assert got.columns == edge_docs.columns
    have = [(r.doc_id, r.text) for r in got.collect()]
    for i, t, _ in edge_rows:
        assert have.count((i, t)) >= sum((j, u) == (i, t) for j, u, _ in edge_rows)
    assert mixing.mixture(no_docs).count() == 0 == mixing.mixed(no_docs).count()
    one = mixing.mixture(edge_docs.where("source = 's0'"))
    assert {r.weight for r in one.collect()} == {1.0}


# ---------------------------------------------------------------- packing


def reference_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer())
    return [np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4") for x in texts]


def check_packing(pieces, rows, window):
    documents = defaultdict(list)
    for (i, _, _), ids in zip(rows, reference_ids([t for _, t, _ in rows])):
        documents[i].append(ids)
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append(p)
    padding = 0
    for s in sequences.values():
        s.sort(key=lambda p: p.offset)
        at = 0
        for p in s:
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    by = defaultdict(list)
    for p in pieces:
        by[p.doc_id].append(p)
    assert set(by) == set(documents)
    for i, found in by.items():
        assert sum(p.length for p in found) == sum(map(len, documents[i]))
        for p in found:
            assert any(len(ids) == p.doc_tokens and zlib.crc32(ids[p.start : p.start + p.length].tobytes()) == p.ids_crc32 for ids in documents[i])
        if len(documents[i]) == 1:
            at = 0
            for p in sorted(found, key=lambda p: p.start):
                assert p.start == at
                at += p.length
    return padding


@pytest.mark.parametrize("window, most, merge", [(2048, 32, 32), (64, 3, 1), (100, 1, 2)])
def test_packing_brute_force(edge_docs, edge_rows, window, most, merge):
    pieces = packing.pack(edge_docs, window=window, open_windows=most, merge_parts=merge).collect()
    assert check_packing(pieces, edge_rows, window) == 0


def test_packing_of_nothing(spark, no_docs):
    assert packing.pack(no_docs).count() == 0
    (p,) = packing.pack(rows_to_docs(spark, [(1, None, None)])).collect()
    assert (p.start, p.length, p.doc_tokens, p.offset) == (0, 1, 1, 0)


ODD = "İstanbul ΣΑΣ Å K don't we'll, x', naïve. ÉCOLE, straße. <|endoftext|> a<|startoftext|>B ﬁ éa \x85b c \x1cq 12,5. ..., é, ñ. A,. b.. ,"


def test_words_have_the_tokenizers_ids():
    texts = [ODD, "", "  ", ODD.lower(), "x" * 300, "the thing, the. thing"]
    store = packing.WordIds(packing.default_tokenizer(), 1)
    for _ in range(2):  # the second time all words are known
        ids, counts = store.encode(pa.array(texts))
        assert np.array_equal(ids, np.concatenate(reference_ids(texts))) and counts.tolist() == [len(x) for x in reference_ids(texts)]


def test_best_fit_and_fullest():
    p = packing.Packer(10, 2)
    ids = np.arange(10, dtype=np.uint32)
    assert not list(p.place("a", 0, ids[:6], 6)) and not list(p.place("b", 0, ids[:5], 5))
    assert not list(p.place("c", 0, ids[:3], 3))  # best fit: beside a
    (full,) = p.place("d", 0, ids[:7], 7)  # none fits: the fullest takes the head
    assert [(x[0], len(x[2])) for x in full] == [("a", 6), ("c", 3), ("d", 1)]


# ---------------------------------------------------------------- pipeline


def test_pipeline(spark, tmp_path):
    import corpus_pipeline
    import random

    rng = random.Random(6)
    rows = [(i, words(rng, 80, 2_000), f"s{min(i % 7, 3)}") for i in range(120)]
    junk = [(1000 + i, " ".join(w + "###" for w in words(rng, 60).split()), "s1") for i in range(40)]
    copies = [(2000 + i, rows[i][1] + " tail", "s2") for i in range(10)] + [(3000 + i, rows[i][1], "s2") for i in range(5)]
    private = [(4000, rows[20][1] + " " + words(rng, 60, 2_000) + " write to ann.lee@mail1.example.com", "s0")]
    every = [*rows, *junk, *copies, *private]
    d = str(tmp_path)
    spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in every], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(i < 1000), 0) for i, _, _ in [*rows, *junk]], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    docs, after = spark.read.parquet(f"{d}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, d), name)
        after[name] = docs
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    good = {i for i, _, _ in every if not 1000 <= i < 2000}
    assert {r.doc_id for r in after["quality"].collect()} == good
    kept = {i for i, _, _ in rows} | {4000}
    assert sorted(r.doc_id for r in after["near_duplicates"].collect()) == sorted(kept)
    texts = {r.doc_id: r.text for r in after["pii"].collect()}
    assert "ann.lee" not in texts[4000] and all(texts[i] == t for i, t, _ in rows)
    assert {r.doc_id for r in after["mixing"].collect()} == kept and after["mixing"].groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3
    mixed = [(r.doc_id, r.text, r.source) for r in after["mixing"].collect()]
    assert check_packing(after["packing"].collect(), mixed, 2048) == 0
    ids = lambda df: sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in df.groupBy("doc_id").agg(F.min("start").alias("start"), F.sum("length").alias("length"), F.max("doc_tokens").alias("ids_crc32")).collect())
    assert ids(corpus_pipeline.run(spark, d)) == ids(after["packing"])


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def test_pipeline_edges(spark, tmp_path):
    """Null and empty texts, rows that repeat, null ids and sources; and no rows at all."""
    import random

    import corpus_pipeline

    rng = random.Random(9)
    rows = [(i, words(rng, 60, 900), "en", f"s{i % 2}", 1) for i in range(30)]
    odd = [(100, None, None, None, None), (101, "", "en", "s0", 0), (None, "no id at all here", None, "s1", 5), rows[3], rows[3], (3, "another text of id three", "en", "s0", 9)]
    for name, some in (("some", [*rows, *odd]), ("none", [])):
        spark.createDataFrame(some, DOCUMENTS).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([(r[0], 1, 0) for r in some[:20]], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
    got = corpus_pipeline.run(spark, f"{tmp_path}/some").collect()
    assert {r.doc_id for r in got} >= {*range(30)} and {100, 101} & {r.doc_id for r in got}  # null and empty are copies: one of them stays


def test_registered_queries():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert {f"op{n}" for n in range(1, 11)} <= {n.split("_")[0] for n in names} and "pipeline" in names
