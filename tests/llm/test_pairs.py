"""Fingerprints, the Jaccard join and top-k search against brute force."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkloom.llm import components, digest, jaccard, topk
from tests.llm.conftest import rows_to_docs, words

# ---------------------------------------------------------------- fingerprints


def test_fingerprints_brute_force(edge_docs, edge_rows):
    got = digest.fingerprints(edge_docs).collect()
    assert len(got) == len(edge_rows)
    plain = [(i, t or "") for i, t, _ in edge_rows]
    by_text = {}
    for r in got:
        by_text.setdefault(r.doc_id, set()).add((r.n_chars, r.fingerprint))
    for i, t in plain:
        assert (len(t), digest.digest(t).tobytes().hex()) in by_text[i]
    unique = {i for i, _ in plain if i is not None and sum(j == i for j, _ in plain) == 1}
    order = sorted(((i, t) for i, t in plain if i is not None), key=lambda x: -x[0])
    for k, (i, t) in enumerate(order[:-1]):
        if i in unique and order[k + 1][0] in unique:
            r = next(r for r in got if r.doc_id == i)
            new = digest.edited(t, order[k + 1][1])
            assert r.edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
            assert r.edited_fingerprint == digest.digest(new).tobytes().hex()
            assert r.near_next == digest.likeness(digest.digest(t), digest.digest(order[k + 1][1]))
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)


def test_last_document_is_followed_by_the_first(spark):
    docs = rows_to_docs(spark, [(1, "abcd", "s"), (9, "WXYZ", "s"), (5, "mnop", "s")])
    got = {r.doc_id: r.edited_sha256 for r in digest.fingerprints(docs.repartition(3)).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == {9: sha("WXmn"), 5: sha("mnab"), 1: sha("abWX")}
    (one,) = digest.fingerprints(docs.where("doc_id = 1")).collect()
    assert one.edited_sha256 == sha("abab") and one.near_next == 1


def test_fingerprints_of_nothing(no_docs):
    assert digest.fingerprints(no_docs).count() == 0


@given(st.text(max_size=200), st.text(max_size=200))
def test_likeness(a, b):
    x, y = digest.digest(a), digest.digest(b)
    assert digest.likeness(x, x) == 1 and 0 <= digest.likeness(x, y) == digest.likeness(y, x) <= 1


def test_likeness_falls_with_edits():
    rng = random.Random(1)
    a, b = words(rng, 400), words(rng, 400)
    mixed = digest.edited(a, b)
    assert 1 > digest.likeness(digest.digest(a), digest.digest(mixed)) > digest.likeness(digest.digest(a), digest.digest(b))


def test_blocks_of_a_long_text_are_one_count():
    data = bytes(np.random.default_rng(1).integers(0, 256, 3_000_000, dtype=np.uint8))
    assert digest.bucket_counts(data).sum() == len(data) - 2


# ---------------------------------------------------------------- Jaccard join


def brute_force(rows, size=5, threshold=0.8):
    def shingle(t):
        w = (t or "").encode().lower().split()
        return frozenset(tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))) if w else frozenset()

    sets = [shingle(t) for _, t, _ in rows]
    distinct = list(dict.fromkeys(sets))
    links = {s: [o for o in distinct if o is not s and s and o and len(s & o) >= threshold * len(s | o)] for s in distinct}
    root = {s: s for s in distinct}

    def find(s):
        while root[s] is not s:
            s = root[s]
        return s

    for s, others in links.items():
        for o in others:
            root[find(s)] = find(o)
    return sets, links, find


def check_join(docs, rows, **options):
    sets, links, find = brute_force(rows)
    got = jaccard.near_duplicates(docs, **options).collect()
    assert len(got) == len(rows)
    least = {}
    for (i, _, _), s in zip(rows, sets):
        if i is not None:
            least[find(s)] = min(i, least.get(find(s), i))
    want = sorted((i if i is not None else -1, least.get(find(s), -1), len(links[s]), sum(x == s for x in sets)) for (i, _, _), s in zip(rows, sets))
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.class_id if r.class_id is not None else -1, r.n_links, r.n_copies) for r in got) == want


def test_join_edges(edge_docs, edge_rows):
    check_join(edge_docs, edge_rows)


def near_copies(rng, count, length=120):
    base = words(rng, length, 5_000).split()
    out = []
    for _ in range(count):
        copy = list(base)
        for _ in range(rng.randrange(0, 3)):
            copy[rng.randrange(length)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("tile", [512, 8])
def test_join_groups_and_tiles(spark, tile):
    rng = random.Random(5)
    texts = [*near_copies(rng, 40), *near_copies(rng, 3), *near_copies(rng, 2), *[words(rng, 100, 5_000) for _ in range(20)]]
    passage = words(rng, 60, 5_000)
    texts += [f"{passage} {words(rng, 150, 5_000)}" for _ in range(15)]
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(500 + i, texts[0], "s") for i in range(30)]
    check_join(rows_to_docs(spark, rows).repartition(4), rows, tile=tile)


def test_keep_one(spark, edge_docs, edge_rows):
    kept = jaccard.keep_one(edge_docs)
    assert kept.columns == edge_docs.columns
    _, _, find = brute_force(edge_rows)
    sets, _, _ = brute_force(edge_rows)
    assert len({r.text for r in kept.collect()}) == kept.count()
    ids = [r.doc_id for r in kept.collect()]
    assert 104 not in ids and ids.count(3) == 1 and 5 in ids


def test_keep_one_tells_classes_of_one_id_apart(spark):
    a, b, c = ("first text of many words " * 3, "second text that is another one " * 3, "third of them all " * 4)
    rows = [(3, b, "s"), (5, a, "s"), (5, b, "s"), (5, c, "s"), (5, c, "s"), (7, b.upper(), "s"), (None, a, "s")]
    kept = sorted((r.doc_id, r.text) for r in jaccard.keep_one(rows_to_docs(spark, rows).repartition(3)).collect())
    assert len(kept) == 3 and {t for _, t in kept} >= {b, c} and (3, b) in kept and (5, c) in kept


def test_band_that_all_share(spark):
    """One key with most rows: near copies of one text, and every link is counted."""
    rng = random.Random(7)
    base = words(rng, 300, 5_000).split()
    rows = [(i, " ".join([*base[:290], f"x{i}"]), "s") for i in range(150)] + [(1000 + i, words(rng, 80, 5_000), "s") for i in range(20)]
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.near_duplicates(rows_to_docs(spark, rows).repartition(4), tile=32).collect()}
    assert all(got[i] == (0, 149) for i in range(150)) and all(got[1000 + i] == (1000 + i, 0) for i in range(20))


def test_join_of_nothing(no_docs):
    assert jaccard.near_duplicates(no_docs).count() == 0 and jaccard.keep_one(no_docs).count() == 0


def test_pruning_keeps_and_drops():
    sig = np.zeros((3, 112), np.uint32)
    sig[1, :100], sig[1, 100:] = 0, 9
    sig[2] = np.arange(112) + 1
    a, b = jaccard.prune(sig, np.array([0, 0]), np.array([1, 2]), 0.8, 1e-5)
    assert list(zip(a, b)) == [(0, 1)]
    assert jaccard.least_matches(112, 0.8, 1e-5) < 0.8 * 112 < 112


def test_signatures_estimate_jaccard():
    rng = np.random.default_rng(2)
    errors = []
    for k in range(40):
        both = rng.integers(0, 2**63, 800, dtype=np.uint64)
        a, b = both[:600], both[100:]
        errors.append((jaccard.signature(a) == jaccard.signature(b)).mean() - 500 / 800)
    assert abs(np.mean(errors)) < 0.02


@settings(max_examples=20)
@given(st.lists(st.sets(st.integers(0, 30), min_size=1, max_size=20), min_size=2, max_size=14), st.booleans())
def test_shared_counts(sets, many):
    arrays = [np.array(sorted(s), np.uint64) for s in sets]
    a, b = np.triu_indices(len(sets), 1)
    if many:
        a, b = np.tile(a, 40), np.tile(b, 40)
    assert jaccard.shared(arrays, a, b).tolist() == [len(sets[i] & sets[j]) for i, j in zip(a, b)]


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (4, 5), (5, 6), (10, 11), (12, 11), (7, 7), *[(100, 100 + k) for k in range(1, 40)], (139, 200)]
    got = {r.id: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(1, 7), 1), 10: 10, 11: 10, 12: 10, **dict.fromkeys(range(100, 140), 100), 200: 100}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---------------------------------------------------------------- top-k


def brute_top(rows, every=50, k=5):
    good = [(i, v) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    vec = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in good]
    queries = {}
    for i, v in sorted(vec):
        if i % every == 0:
            queries.setdefault(i, v)
    out = []
    for q, a in queries.items():
        best = sorted(((-sum(x * y for x, y in zip(a, b)), i) for i, b in vec if i != q))[:k]
        out += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    return sorted(out)


def run_top(spark, rows, **options):
    df = spark.createDataFrame([(i, v, "x", 1.0, 2) for i, v in rows], "vec_id long, embedding array<float>, id string, score double, rank int")
    vectors = df.repartition(3).select("vec_id", topk.quantised(F.col("embedding")).alias("vector"), "id", "score", "rank")
    return sorted(map(tuple, topk.exact_top_k(vectors, F.col("vec_id") % 50 == 0, **options).collect()))


def vectors(n, seed=0, width=8):
    rng = np.random.default_rng(seed)
    return [(i, rng.normal(0, 0.3, width).tolist()) for i in range(n)]


def test_top_k_brute_force(spark):
    rows = vectors(260)
    rows += [(300, None), (350, []), (400, [1.0, None] * 4), (450, [float("nan")] * 8), (451, [float("inf")] * 8), (None, [0.1] * 8), (7, rows[7][1]), (50, rows[50][1]), (500, [0.1, 0.2])]
    rows += [(600 + i, rows[3][1]) for i in range(40)]  # ties
    assert run_top(spark, rows) == brute_top(rows)
    assert run_top(spark, rows, round_queries=3) == brute_top(rows)


def test_top_k_few_and_none(spark):
    assert run_top(spark, vectors(3)) == brute_top(vectors(3))
    assert run_top(spark, [(1, [0.5])]) == [] == run_top(spark, [])


def test_large_components_stay_exact(spark):
    rows = [(i, [1e6 + i, -3e4 * i, 2.0**18]) for i in range(60)]
    assert run_top(spark, rows) == brute_top(rows)
