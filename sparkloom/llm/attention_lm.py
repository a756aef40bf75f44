"""Language-model scoring with a causal self-attention model trained in numpy.

Words (split at ASCII white space, lower-cased in ASCII) are read as subword ids of a public
byte-level tokenizer; an id that no training text holds is read as its bytes, so that every
text has ids.  One layer of causal self-attention reads the ids so far and gives the
distribution of the next id, as a softmax over classes of ids and one over the members of a
class; counts enter as the biases that training starts from.  Texts are cut into overlapping
windows of twice ``STRIDE`` ids, of which the second half is scored: each id once, with
batched masked attention.  A text's score is the sum over its ids and its end.

The weights are trained on every training document, by rounds of local gradient descent:
in each round the tasks start from the same weights, descend along their own share of the
documents and are averaged, weighted by ids.  The rounds' shares of the documents grow, and
together they read each document once; where that is less than ``LEAST_IDS`` ids, all
documents are read over again until it is enough.

Every text's ids are written once: all rounds and the scoring read these, not the texts.

The base counts every word of every training document.  Counts of the ``TOP_WORDS`` most
frequent words are broadcast; those of all others are joined, so that every base is exact.

Defined cases
  * null text counts as empty: its only token is the end; without training documents
    nothing is known, every base is 1 and all ids are equally likely;
  * documents that share an id are scored each; null ids fall in the fold of the empty id;
    texts of any length are scored whole; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import os
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, coded_words, crc32_of_id, kept, pieces, split_words, text, written

DIM, INNER, STRIDE = 40, 16, 32
#: Windows of one step, ids read at least, and bytes of training text for each task.
BATCH, LEAST_IDS, TASK_BYTES = 128, 4_000_000, 8 << 20
#: The first way along the documents goes in rounds of so many 64ths, later ways in halves.
ROUNDS, LATER_ROUNDS = (1, 1, 2, 4, 8, 16, 32), (32, 32)
RATE, LAST_RATE = 0.03, 0.001
TOP_WORDS, STORE_WORDS = 200_000, 400_000
TEXT_BYTES = 2 << 20
#: Windows of attention, and ids told, at a time: their arrays fit the cache of a core.
SOME, COLUMNS = 16, 2048
#: Rows of a group that are summed for all groups at once, and weights stepped at a time.
MANY, CELLS = 16, 1 << 15
FOLDS, HELD_OUT = 7, 2
END = b"\xff"  # no byte of UTF-8, so no word
BYTE_LETTERS = {b: 256 + k for k, b in enumerate([*range(33), *range(127, 161), 173])}
LETTER_BYTES = {**{chr(b): b for b in range(256) if b not in BYTE_LETTERS}, **{chr(c): b for b, c in BYTE_LETTERS.items()}}
SPACE = chr(BYTE_LETTERS[32])
NEVER = np.float32(-1e30)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def steady() -> None:
    """Keeps numpy's products in this process to one thread, as tasks already use all cores,
    and lets freed arrays stay with the process: every step takes the same ones again."""
    import ctypes
    import glob

    libc = ctypes.CDLL(None)
    if hasattr(libc, "mallopt"):
        for option in (-3, -1):  # fixed by glibc: sizes from which memory is mapped, and given back
            libc.mallopt(option, 64 << 20)
    for path in glob.glob(os.path.join(os.path.dirname(np.__file__), "..", "numpy.libs", "*openblas*")):
        library = ctypes.CDLL(path)
        for name in ("scipy_openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "openblas_set_num_threads"):
            if hasattr(library, name):
                getattr(library, name)(1)


class Subwords:
    """Words to the tokenizer's ids, as it splits them after a space."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks already use all cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.pieces = [self.tokenizer.id_to_token(i) for i in range(self.tokenizer.get_vocab_size())]
        self.opens = np.array([p[:1] == SPACE for p in self.pieces])

    def __call__(self, words: list[bytes], some: int = 4096) -> tuple[np.ndarray, np.ndarray]:
        """All words' ids one after the other, and how many each word has.  Words go in one
        text with a space before each, which so opens its word's first subword."""
        ids, counts = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for at in range(0, len(words), some):
            cut = words[at : at + some]
            text = (b" " + b" ".join(cut)).decode()
            if len(text.split()) == len(cut):
                found = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64)
                begins = np.nonzero(self.opens[found])[0]
                ids.append(found)
                counts.append(np.diff(begins, append=len(found)))
            elif len(cut) > 1:  # some word holds white space that is not ASCII: on to fewer words
                for part in (cut[: len(cut) // 2], cut[len(cut) // 2 :]):
                    for held, new in zip((ids, counts), self(part, some)):
                        held.append(new)
            else:
                ids.append(np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int64))
                counts.append(np.array([len(ids[-1])]))
        return np.concatenate(ids), np.concatenate(counts)


class Vocabulary:
    """Own ids of subwords: the end is 0, then the tokenizer's ids that training texts hold
    and single bytes, the most frequent first.  Any other id is read as its bytes."""

    def __init__(self, path: str, ids: np.ndarray):
        self.subwords = Subwords(path)
        pieces = self.subwords.pieces
        own = {int(i): k for k, i in enumerate(ids, 1)}
        self.of_byte = {b: own[self.subwords.tokenizer.token_to_id(c)] for c, b in LETTER_BYTES.items()}
        read = [[own[i]] if i in own else [self.of_byte[LETTER_BYTES[c]] for c in p if c in LETTER_BYTES] for i, p in enumerate(pieces)]
        self.size = len(ids) + 1
        self.length = np.array([len(r) for r in read])
        self.start = np.cumsum(self.length) - self.length
        self.flat = np.array([k for r in read for k in r], np.int32)

    def __call__(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All words' own ids one after the other, and how many each word has."""
        found, counts = self.subwords(words)
        length = self.length[found]
        ends = np.cumsum(length)
        place = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[found] - ends + length, length)
        return self.flat[place], np.add.reduceat(length, np.cumsum(counts) - counts) if len(counts) else counts


class Growing:
    """An array that grows by doubling."""

    def __init__(self, kind):
        self.values, self.size = np.zeros(1 << 12, kind), 0

    def add(self, more) -> None:
        size = self.size + len(more)
        if size > len(self.values):
            self.values = np.concatenate([self.values[: self.size], np.zeros(max(size, 2 * self.size) - self.size, self.values.dtype)])
        self.values[self.size : size] = more
        self.size = size


class Words:
    """Words with their ids, as they are met; row 0 is the end."""

    def __init__(self, path: str, ids: np.ndarray):
        steady()
        self.vocabulary = Vocabulary(path, ids)
        self.reset()

    def reset(self, keep: int = 0) -> None:
        """Forgets words but the first met, which are mostly the frequent ones."""
        if keep:
            self.names = self.names[:keep]
            self.index = dict(zip(self.names, range(keep)))
            self.start.size = self.length.size = keep
            self.flat.size = int(self.start.values[keep - 1] + self.length.values[keep - 1])
            return
        self.index: dict[bytes, int] = {END: 0}
        self.names: list[bytes] = [END]
        self.flat, self.start, self.length = Growing(np.int32), Growing(np.int64), Growing(np.int32)
        self.flat.add([0])
        self.start.add([0])
        self.length.add([1])

    def rows(self, texts: pa.Array) -> np.ndarray:
        """The rows of all words, row 0 after each text."""
        words, codes, counts = split_words(texts)
        index = self.index
        table = np.fromiter(map(index.get, words, repeat(-1)), np.int32, len(words))
        at = np.flatnonzero(table < 0)
        if len(at):
            fresh = [words[k] for k in at.tolist()]
            table[at] = np.arange(len(index), len(index) + len(at))
            flat, lengths = self.vocabulary(fresh)
            index.update(zip(fresh, range(len(index), len(index) + len(fresh))))
            self.names += fresh
            self.start.add(self.flat.size + np.cumsum(lengths) - lengths)
            self.length.add(lengths)
            self.flat.add(flat)
        inner = np.ones(len(codes) + len(counts), bool)
        inner[np.cumsum(counts + 1) - 1] = False
        rows = np.zeros(len(inner), np.int32)
        rows[inner] = table[codes]
        return rows

    def stream(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words in a row, and where each text's begin."""
        length = self.length.values[rows].astype(np.int64)
        ends = np.cumsum(length)
        place = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start.values[rows] - ends + length, length)
        after = ends[rows == 0]
        return self.flat.values[place], np.concatenate([[0], after[:-1]]) if len(after) else after


# ---------------------------------------------------------------- the model


def class_width(size: int) -> int:
    """Ids of one class: about as many as there are classes."""
    return max(1, math.isqrt(size - 1) + 1)


def initial(counts: np.ndarray, seed: int) -> dict[str, np.ndarray]:
    """Weights before training: what ids follow is told by the counts alone."""
    rng, size, width = np.random.default_rng(seed), len(counts), class_width(len(counts))
    classes = -(-size // width)
    share = (counts + 0.5) / (counts + 0.5).sum()
    of_class = np.add.reduceat(share, np.arange(0, size, width))
    draw = lambda scale, *shape: rng.normal(0, scale, shape)
    weights = {
        "embed": draw(0.3, size, DIM), "query": draw(INNER**-0.5, DIM, INNER), "key": draw(DIM**-0.5, DIM, INNER), "value": draw(DIM**-0.5, DIM, INNER), "mix": draw(INNER**-0.5, INNER, DIM),
        "last": draw(DIM**-0.5, DIM, DIM), "before": draw(DIM**-0.5, DIM, DIM), "distance": np.zeros(2 * STRIDE),
        "member": draw(0.05, size, DIM), "member_bias": np.log(share) - np.log(np.repeat(of_class, width)[:size]), "class": draw(0.05, classes, DIM), "class_bias": np.log(of_class),
    }
    return {k: v.astype(np.float32) for k, v in weights.items()}


def windows(stream: np.ndarray, begins: np.ndarray, step: int):
    """Windows of every text: for each the place of its first told id, ``step`` places on
    from the one before, and the first and last place of its text."""
    ends = np.concatenate([begins[1:], [len(stream)]])
    each = -(-(ends - begins) // step)
    text = np.repeat(np.arange(len(begins)), each)
    base = begins[text] + step * (np.arange(len(text)) - np.repeat(np.cumsum(each) - each, each))
    return base, begins[text], ends[text] - 1


def cut_windows(stream, base, low, high, ahead: int):
    """Read ids, whether they are there, the ids to tell, and which of these count.
    ``ahead``: places of the windows that are only read."""
    place = base[:, None] + np.arange(-ahead, 2 * STRIDE - ahead)
    there = (place >= low[:, None]) & (place <= high[:, None])
    read = stream[np.clip(place - 1, 0, len(stream) - 1)]
    read[place == low[:, None]] = 0  # a text opens after an end
    return read, there, stream[np.minimum(place[:, ahead:], len(stream) - 1)], there[:, ahead:]


def _mask(ahead: int) -> tuple[np.ndarray, np.ndarray]:
    """How far back each place is of each told one, and what must not be seen yet."""
    gap = np.arange(ahead, 2 * STRIDE)[None, :] - np.arange(2 * STRIDE)[:, None]
    return np.maximum(gap, 0), np.where(gap < 0, NEVER, np.float32(0))


_MASKS = {ahead: _mask(ahead) for ahead in (0, STRIDE)}


def _times(x: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    return (x.reshape(-1, x.shape[2]) @ matrix).reshape(*x.shape[:2], -1)


def attention(bias: np.ndarray, q: np.ndarray, k: np.ndarray, v: np.ndarray, there: np.ndarray | None):
    """What each told place sees of the places before it, times the sum of its weights, which
    is the last column as ``v`` ends with a one.  Scores are kept as (window, place, told).
    ``there``: None if all places are that any counted one sees."""
    a = k @ q.transpose(0, 2, 1)
    a += bias
    if there is not None:
        some = np.flatnonzero(~there[:, 0])  # only windows at a text's begin lack places before told ones
        if len(some):
            a[some] += np.where(there[some], np.float32(0), NEVER)[:, :, None]
    if a.max() > 60:
        np.minimum(a, np.float32(60), out=a)
    np.exp(a, out=a)
    return a.transpose(0, 2, 1) @ v, a


def _bias(w: dict, ahead: int) -> np.ndarray:
    gap, later = _MASKS[ahead]
    return w["distance"][gap] + later


#: The products of a place's embedding, side by side in one matrix.
_SIDE = (("query", INNER), ("key", INNER), ("last", DIM), ("before", DIM), ("value", INNER))
_AT = {name: slice(at, at + width) for (name, width), at in zip(_SIDE, np.cumsum([0, *(n for _, n in _SIDE)]).tolist())}
_SEEN = slice(_AT["value"].start, _AT["value"].stop + 1)  # the value and a one


def _with_one(x: np.ndarray) -> np.ndarray:
    return np.concatenate([x, np.ones((len(x), 1), x.dtype)], 1)


def outputs(w: dict) -> dict:
    """The output weights with their biases as a last column, for states that end with a one."""
    return {name: np.concatenate([w[name], w[name + "_bias"][:, None]], 1) for name in ("class", "member")}


def tables(w: dict) -> dict:
    """Products of every id's embedding, so that scoring looks them up."""
    of = {name: w["embed"] @ w[name] for name, _ in _SIDE}
    return {"early": _with_one(np.concatenate([of["key"], of["value"]], 1)), "late": np.concatenate([of["query"], of["last"]], 1), "before": of["before"], "bias": _bias(w, STRIDE), "mix": w["mix"], **outputs(w)}


def attend_scored(t: dict, read: np.ndarray, there: np.ndarray, state: np.ndarray) -> None:
    """The states that tell the ids of the windows' second halves, from tables, into ``state``."""
    here = slice(STRIDE - 1, -1)
    late, early = t["late"].take(read[:, STRIDE:], 0), t["early"].take(read, 0)
    seen, _ = attention(t["bias"], late[:, :, :INNER], early[:, :, :INNER], early[:, :, INNER:], there)
    seen = seen[:, :, :-1] / (seen[:, :, -1:] + np.float32(1e-30))
    out = _times(seen, t["mix"])
    out += late[:, :, INNER:]
    earlier = t["before"].take(read[:, here], 0)
    earlier[~there[:, STRIDE - 1], 0] = 0  # a text's first place has none before it
    np.add(out, earlier, out=state[:, :, :DIM])


def tell(w: dict, states: np.ndarray, every: np.ndarray, counted: np.ndarray, grads: dict | None = None, shifted: bool = False):
    """Natural log probability of each counted id given its state, which ends with a one; with
    ``grads`` also the gradient of the mean loss by all states, and by the output weights added
    to ``grads``.  ``w``: as ``outputs`` gives them.  Powers are taken without a shift by the
    greatest, and all over again with it if a sum is out of range (``shifted``)."""
    ids, n, width = every[counted], len(counted), class_width(len(w["member"]))
    of = ids // width
    order = np.argsort(of.astype(np.int16), kind="stable")
    h, of = states.take(counted[order], 0), of[order]
    own = ids[order] - of * width
    mine, total = np.zeros(n, h.dtype), np.ones((2, n), h.dtype)
    at, scale = np.arange(COLUMNS), h.dtype.type(1 / max(n, 1))
    found = None if grads is None else {k: np.zeros_like(w[k]) for k in ("class", "member")}
    dh = None if grads is None else np.empty_like(h)

    def block(name: str, rows: slice, begin: int, end: int, row: np.ndarray, sums: np.ndarray) -> None:
        """One softmax over some rows of the output weights for some of the ids."""
        matrix, x, sums = w[name][rows], h[begin:end], sums[begin:end]
        z = matrix @ x.T
        if shifted:
            z -= z.max(0)
        flat, place = z.reshape(-1), row[begin:end] * len(x) + at[: len(x)]
        mine[begin:end] += flat[place]
        np.exp(z, out=z)
        z.sum(0, out=sums)
        if found is not None:
            z *= scale / sums
            flat[place] -= scale
            found[name][rows] += z @ x
            if name == "class":
                np.matmul(z.T, matrix, out=dh[begin:end])
            else:
                dh[begin:end] += z.T @ matrix

    cuts = np.searchsorted(of, np.arange(len(w["class"]) + 1)).tolist()
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        for begin in range(0, n, COLUMNS):
            block("class", slice(None), begin, min(begin + COLUMNS, n), of, total[0])
        for c, (low, high) in enumerate(zip(cuts, cuts[1:])):
            for begin in range(low, high, COLUMNS):
                block("member", slice(c * width, (c + 1) * width), begin, min(begin + COLUMNS, high), own, total[1])
    if not shifted and n and not (total.min() > 1e-25 and total.max() < 1e25):
        return tell(w, states, every, counted, grads, True)
    logp = np.empty_like(mine)
    logp[order] = mine - np.log(total).sum(0)
    if grads is None:
        return logp
    for name, g in found.items():
        grads[name] += g[:, :-1]
        grads[name + "_bias"] += g[:, -1]
    out = np.zeros((len(states), DIM), h.dtype)
    out[counted[order]] = dh[:, :-1]
    return logp, out


def summed(rows: np.ndarray, order: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Sums of groups of rows, of which ``order`` has the places group by group, from
    ``first`` on, ``count`` of each; groups fall in size.  All groups' first rows are added at
    once, then the second ones, and so on; the rest of large groups by group."""
    out = rows.take(order[first], 0)
    more = np.searchsorted(-count, -np.arange(1, MANY + 1))  # groups of more than 1, 2, ... rows
    for k, n in enumerate(more[:-1].tolist(), 1):
        if not n:
            return out
        out[:n] += rows.take(order[first[:n] + k], 0)
    for g in range(int(more[-1])):
        out[g] += rows.take(order[first[g] + MANY : first[g] + count[g]], 0).sum(0)
    return out


def laid_out(w: dict) -> tuple[np.ndarray, dict]:
    """Zeros of the weights' shapes, one after the other in one array."""
    flat = np.zeros(sum(x.size for x in w.values()), next(iter(w.values())).dtype)
    return flat, _views(flat, w)


def _views(flat: np.ndarray, like: dict) -> dict:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape)
        at += like[k].size
    return out


def gradient(w: dict, read, there, ids, use, grads: dict | None = None) -> tuple[float, dict]:
    """Mean loss over the ids that count, and its gradient, added to ``grads`` if given.
    Attention goes by ``SOME`` windows at a time, whose arrays stay in a core's cache; products
    of embeddings are made once for each different id that is read, and so are their gradients.
    Windows begin within their text, so that no counted place sees one that is not there."""
    grads = laid_out(w)[1] if grads is None else grads
    flat = lambda y: y.reshape(-1, y.shape[2])
    where = read.ravel()
    order = np.argsort(where.astype(np.uint16) if len(w["embed"]) < 1 << 16 else where, kind="stable")
    first = np.flatnonzero(np.diff(where[order], prepend=-1))
    count = np.diff(first, append=len(where))
    falling = np.argsort(-count, kind="stable")
    first, count = first[falling], count[falling]
    met = where[order[first]]
    at = np.empty(len(w["embed"]), np.int64)
    at[met] = np.arange(len(met))
    at = at[read]
    side, x, kind = np.concatenate([w[name] for name, _ in _SIDE], 1), w["embed"][met], w["embed"].dtype
    products, bias, mix = _with_one(x @ side), _bias(w, 0), w["mix"]
    cuts = [slice(k, k + SOME) for k in range(0, len(read), SOME)]
    state, seen = np.empty((*read.shape, DIM + 1), kind), np.empty((*read.shape, INNER + 1), kind)
    state[:, :, DIM] = 1
    made = []
    for cut in cuts:
        all_ = products.take(at[cut], 0)
        seen[cut], a = attention(bias, all_[:, :, _AT["query"]], all_[:, :, _AT["key"]], all_[:, :, _SEEN], None)
        made.append((all_, a))
        total = seen[cut][:, :, -1:]
        total += kind.type(1e-30)
        some = seen[cut][:, :, :-1]
        some /= total
        here = state[cut][:, :, :DIM]
        np.add(_times(some, mix), all_[:, :, _AT["last"]], out=here)
        here[:, 1:] += all_[:, :-1, _AT["before"]]
    logp, dh_all = tell(outputs(w), flat(state), ids.ravel(), np.flatnonzero(use), grads)
    dh_all = dh_all.reshape(*read.shape, DIM)
    values, total = seen[:, :, :-1], seen[:, :, -1:]
    grads["mix"] += flat(values).T @ flat(dh_all)
    pull = np.empty_like(seen)  # by what is seen, over the sum; less its mean
    np.divide(_times(dh_all, mix.T), total, out=pull[:, :, :-1])
    pull[:, :, -1] = -np.einsum("wpi,wpi->wp", values, pull[:, :, :-1])
    by_all, distance = np.empty((*read.shape, side.shape[1]), kind), 0  # the gradients by the products, side by side
    for cut, (all_, a) in zip(cuts, made):
        dh, by, part = dh_all[cut], by_all[cut], pull[cut]
        ds = all_[:, :, _SEEN] @ part.transpose(0, 2, 1)
        ds *= a
        np.matmul(a, part[:, :, :-1], out=by[:, :, _AT["value"]])
        np.matmul(ds.transpose(0, 2, 1), all_[:, :, _AT["key"]], out=by[:, :, _AT["query"]])
        np.matmul(ds, all_[:, :, _AT["query"]], out=by[:, :, _AT["key"]])
        by[:, :, _AT["last"]], by[:, :-1, _AT["before"]], by[:, -1, _AT["before"]] = dh, dh[:, 1:], 0
        distance += ds.sum(0)
    grads["distance"] += np.bincount(_MASKS[0][0].ravel(), weights=distance.ravel(), minlength=2 * STRIDE).astype(kind)
    by = summed(flat(by_all), order, first, count)
    both = x.T @ by
    for name, _ in _SIDE:
        grads[name] += both[:, _AT[name]]
    grads["embed"][met] += by @ side.T
    return -float(logp.mean()), grads


class Descent:
    """Adam's steps from given weights, which lie in one array, as do their gradients; a part
    that fits the cache is stepped at a time."""

    def __init__(self, weights: dict, rate: float):
        self.rate, self.n = rate, 0
        self.flat, self.w = laid_out(weights)
        for k, x in weights.items():
            self.w[k][...] = x
        self.g, self.grads = laid_out(weights)
        self.m, self.v = np.zeros_like(self.flat), np.zeros_like(self.flat)  # means of g and g^2, times 10 and 100

    def step(self, *window) -> float:
        self.g[...] = 0
        loss, _ = gradient(self.w, *window, self.grads)
        self.n += 1
        rate = self.rate * min(1.0, self.n / 10) / (1 - 0.9**self.n)
        root = math.sqrt(0.01 / (1 - 0.99**self.n))
        kind = self.flat.dtype.type
        for at in range(0, len(self.flat), CELLS):
            g, m, v, w = (x[at : at + CELLS] for x in (self.g, self.m, self.v, self.flat))
            m *= kind(0.9)
            m += g
            v *= kind(0.99)
            g *= g
            v += g
            np.sqrt(v, out=g)
            g += kind(1e-8 / root)
            np.divide(m, g, out=g)
            g *= kind(0.1 * rate / root)
            w -= g
        return loss


def descend(weights: dict, rate: float, streams, rng) -> tuple[dict, int]:
    """The weights after one way along all windows of the streams, and the ids read.  Here
    windows do not overlap, and all of their ids are told."""
    run, told = Descent(weights, rate), 0
    for stream, begins in streams:
        base, low, high = windows(stream, begins, 2 * STRIDE)
        order = rng.permutation(len(base))
        for at in range(0, len(order), BATCH):
            cut = order[at : at + BATCH]
            read, there, ids, use = cut_windows(stream, base[cut], low[cut], high[cut], 0)
            run.step(read, there, ids, use)
            told += int(use.sum())
    return run.w, told


def log_probabilities(table: dict, stream: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Natural log probability of each id of the stream, each in one window, by the model
    whose ``tables`` are given."""
    base, low, high = windows(stream, begins, STRIDE)
    out = np.empty(len(stream))
    for at in range(0, len(base), 512):
        cut = slice(at, at + 512)
        read, there, ids, use = cut_windows(stream, base[cut], low[cut], high[cut], STRIDE)
        state = np.ones((len(read), STRIDE, DIM + 1), table["mix"].dtype)
        for k in range(0, len(read), 2 * SOME):
            attend_scored(table, read[k : k + 2 * SOME], there[k : k + 2 * SOME], state[k : k + 2 * SOME])
        counted = np.flatnonzero(use)
        out[(base[cut][:, None] + np.arange(STRIDE)).ravel()[counted]] = tell(table, state.reshape(-1, DIM + 1), ids.ravel(), counted)
    return out


# ---------------------------------------------------------------- counts


def _words(batches):
    """(word, n): the words of some texts at a time, with the texts' ends."""
    for batch in batches:
        for part in pieces(batch, 0):
            words, codes, _ = coded_words(part.column(0))
            n = np.bincount(codes, minlength=len(words))
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([words, pa.array([END], pa.binary())]), pa.array(np.append(n, part.num_rows))], ["word", "n"])


def _subwords(path: str):
    """Counted words to (id, n): the tokenizer's ids."""

    def run(batches):
        subwords = kept("lm subwords", "subwords", lambda: Subwords(path))
        often = np.zeros(len(subwords.pieces), np.int64)
        for batch in batches:
            words, n = batch.column(0).to_pylist(), np.asarray(batch.column(1))
            found, counts = subwords([w for w in words if w != END])
            n = np.repeat(n[[w != END for w in words]], counts)
            often += np.bincount(found, weights=n, minlength=len(often)).astype(np.int64)
        used = np.nonzero(often)[0]
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(often[used])], ["id", "n"])

    return run


def vocabulary(counts: DataFrame, tokenizer: str) -> tuple[np.ndarray, np.ndarray]:
    """The tokenizer's ids that the counted words hold and those of all bytes, and how often
    each own id is met (the end first)."""
    often = counts.mapInArrow(_subwords(tokenizer), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()  # at most the tokenizer's ids
    read = Subwords(tokenizer).tokenizer  # once: it is slow to read
    of_id = {read.token_to_id(c): 0 for c in LETTER_BYTES}
    of_id.update({r.id: r.n for r in often})
    ids = sorted(of_id, key=lambda i: (-of_id[i], i))
    ends = counts.where(F.col("word") == F.lit(bytearray(END))).agg(F.sum("n")).first()[0]
    return np.array(ids, np.int64), np.array([ends or 0, *(of_id[i] for i in ids)], np.float64)


# ---------------------------------------------------------------- training by rounds


def _packed(weights: dict) -> bytes:
    return b"".join(weights[k].tobytes() for k in sorted(weights))


def _unpacked(data: bytes, like: dict, kind=np.float32) -> dict:
    return _views(np.frombuffer(data, kind), like)


def _round(shared, rate: float, seed: int):
    """The weights that a task comes to, times the ids it read: (n, weights)."""

    def run(batches):
        from pyspark import TaskContext

        steady()
        weights = shared.value
        streams = (stored(part.column(0), len(weights["embed"])) for batch in batches for part in pieces(batch, 0, TEXT_BYTES))
        found, told = descend(weights, rate, streams, np.random.default_rng([seed, TaskContext.get().partitionId()]))
        if told:
            yield pa.RecordBatch.from_arrays([pa.array([told]), pa.array([(np.frombuffer(_packed(found), np.float32) * np.float64(told)).tobytes()], pa.binary())], ["n", "weights"])

    return run


def _added(batches):
    n, total = 0, None
    for batch in batches:
        for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            n, total = n + k, np.frombuffer(data) if total is None else total + np.frombuffer(data)
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total.tobytes()], pa.binary())], ["n", "weights"])


def train(rows: DataFrame, tokenizer: str, ids: np.ndarray, counts: np.ndarray, size: int, seed: int = 5) -> dict:
    """Weights after all rounds.  ``rows``: ids as ``encoded`` gives them, or text, and part
    from 0 to 63; ``size``: the texts' bytes."""
    context = rows.sparkSession.sparkContext
    if "ids" not in rows.columns:
        rows = encoded(rows.select(F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("fold"), F.col("part").cast("long"), "text"), tokenizer, ids, b"", np.zeros(1))
    weights, total = initial(counts, seed), counts.sum()
    tasks = max(context.defaultParallelism, math.ceil(size / TASK_BYTES))
    ways = math.ceil(LEAST_IDS / total) if total else 0
    for way in range(ways):
        at = 0
        for k, parts in enumerate(LATER_ROUNDS if way else ROUNDS):
            done = (way + (at + parts / 2) / 64) / ways
            rate = RATE * (LAST_RATE / RATE) ** done
            shared = context.broadcast(weights)
            here = rows.where(F.col("part").between(at, at + parts - 1)).select("ids").coalesce(tasks)
            found = here.mapInArrow(_round(shared, rate, seed + 100 * way + k), "n long, weights binary")
            n = tasks
            while n > 16:  # sums meet by sixteens, so that no task holds many
                n = -(-n // 16)
                found = found.repartition(n).mapInArrow(_added, "n long, weights binary")
            sums = found.collect()  # at most 16 rows
            if sums:
                n = sum(r.n for r in sums)
                weights = _unpacked((sum(np.frombuffer(bytes(r.weights)) for r in sums) / n).astype(np.float32).tobytes(), weights)
            shared.destroy()
            at += parts
    return weights


# ---------------------------------------------------------------- scoring


def _blobs(batches):
    """Counted words as one row of raw arrays for each batch; words are joined by line ends."""
    for batch in batches:
        if batch.num_rows:
            cells = [b"\n".join(batch.column(0).to_pylist()), np.asarray(batch.column(1), np.int64).tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in cells], ["words", "n"])


def frequent_words(counts: DataFrame, most: int) -> tuple[int, bytes, np.ndarray]:
    """The least count of the words that are broadcast, these words, the end first, and
    log10 of their counts and one.  Whole levels of counts, at most ``most`` words."""
    step = F.floor(F.log2("n") * 8).cast("int").alias("step")
    least, room = 1 << 30, most
    for r in sorted(counts.groupBy(step).count().collect(), reverse=True):  # a few hundred levels at most
        if r["count"] > room:
            break
        room -= r["count"]
        least = r.step
    often = counts.where((F.floor(F.log2("n") * 8) >= least) & (F.col("word") != F.lit(bytearray(END))))
    found = often.select("word", "n").mapInArrow(_blobs, "words binary, n binary").collect()
    end = counts.where(F.col("word") == F.lit(bytearray(END))).agg(F.sum("n")).first()[0]
    n = np.concatenate([[end or 0], *(np.frombuffer(bytes(r.n), np.int64) for r in found)]).astype(np.float64)
    return least, b"\n".join(bytes(r.words) for r in found), np.where(n > 0, np.log10(n + 1), np.nan)


class Reader:
    """A worker's state: the frequent words' counts, and words as they are met."""

    def __init__(self, path: str, ids: np.ndarray, names: bytes, logs: np.ndarray):
        self.words = Words(path, ids)
        self.count = dict(zip(names.split(b"\n") if names else (), logs[1:].tolist()))
        self.logs = Growing(np.float64)
        self.logs.add(logs[:1])

    def read(self, texts: pa.Array):
        """For each text: tokens, known frequent ones, their base sum and its words that are
        not frequent; then all ids and where each text's begin."""
        if len(self.words.index) > STORE_WORDS:
            self.words.reset(STORE_WORDS // 2)
            self.logs.size = STORE_WORDS // 2
        rows = self.words.rows(texts)
        names = self.words.names
        self.logs.add([self.count.get(w, math.nan) for w in names[self.logs.size :]])
        ends = np.nonzero(rows == 0)[0]
        starts = np.concatenate([[0], ends[:-1] + 1])
        logs = self.logs.values[rows]
        known = ~np.isnan(logs)
        rare = np.nonzero(~known & (rows != 0))[0]
        cuts = np.concatenate([[0], np.searchsorted(rare, ends)]).astype(np.int32)
        others = pa.ListArray.from_arrays(pa.array(cuts), pa.array([names[i] for i in rows[rare].tolist()], pa.binary()))
        return ends - starts + 1, np.add.reduceat(known.astype(np.int64), starts), np.add.reduceat(np.where(known, logs, 0), starts), others, *self.words.stream(rows)


def id_kind(size: int):
    """How ids of a vocabulary of that size are stored."""
    return np.uint16 if size <= 1 << 16 else np.int32


def cells(stream: np.ndarray, begins: np.ndarray, size: int) -> pa.Array:
    """Each text's ids as bytes."""
    data = stream.astype(id_kind(size))
    offsets = (np.append(begins, len(stream)) * data.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def stored(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """All ids of ``cells``, and where each text's begin."""
    kind = np.dtype(id_kind(size))
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset :][: len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], kind, (offsets[-1] - offsets[0]) // kind.itemsize, offsets[0])
    return data.astype(np.int64), (offsets[:-1] - offsets[0]) // kind.itemsize


def _encode(path: str, shared, name: str):
    def run(batches):
        from pyspark import TaskContext

        reader = kept(f"lm {name}", "reader", lambda: Reader(path, *shared.value))
        rid = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in pieces(batch, 3, TEXT_BYTES):
                n = part.num_rows
                counts, known, base, rare, stream, begins = reader.read(part.column(3))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(rid, rid + n)), *(part.column(k) for k in range(3)), pa.array(counts), pa.array(known), pa.array(base), rare, cells(stream, begins, reader.words.vocabulary.size)],
                    ["rid", "doc_id", "fold", "part", "n_tokens", "known", "base", "rare", "ids"],
                )
                rid += n

    return run


def encoded(rows: DataFrame, tokenizer: str, ids: np.ndarray, names: bytes, logs: np.ndarray) -> DataFrame:
    """Every text's ids, written: all texts are split and looked up once, for all rounds of
    training and for scoring; and what their frequent words add to the base, and the others.
    ``rows``: doc_id, fold, part, text."""
    context = rows.sparkSession.sparkContext
    shared = context.broadcast((ids, names, logs))
    run = _encode(tokenizer, shared, f"{shared._jbroadcast.id()}-{context.applicationId}")
    return written(rows.mapInArrow(run, "rid long, doc_id long, fold long, part long, n_tokens long, known long, base double, rare array<binary>, ids binary"), "ids")


def _score(shared, name: str, held_out: int):
    def run(batches):
        def ready():
            steady()
            return tables(shared.value)

        model = kept(f"lm {name}", "model", ready)
        for batch in batches:
            for part in pieces(batch, 6, TEXT_BYTES):
                stream, begins = stored(part.column(6), len(model["member"]))
                score = np.add.reduceat(log_probabilities(model, stream, begins), begins) / math.log(10)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(np.asarray(part.column(2)) == held_out), *(part.column(k) for k in range(3, 6)), pa.array(score)],
                    ["rid", "doc_id", "held_out", "n_tokens", "known", "base", "score"],
                )

    return run


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = FOLDS, held_out: int = HELD_OUT, tokenizer: str | None = None, top_words: int = TOP_WORDS, seed: int = 5) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every
    document, learning from those outside the fold."""
    spark = docs.sparkSession
    bounded_batches(spark)
    tokenizer = tokenizer or default_tokenizer()
    part = F.pmod(F.xxhash64(F.col(id_col).cast("long"), text(text_col)), F.lit(64)).alias("part")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (crc32_of_id(id_col) % folds).cast("long").alias("fold"), part, text(text_col).alias("text"))
    learnt = F.col("fold") != held_out
    counts = written(rows.where(learnt).select("text").mapInArrow(_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    tokens, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    size = counts.agg(F.sum(F.col("n") * (F.octet_length("word") + 1))).first()[0] or 0
    ids, often = vocabulary(counts, tokenizer)
    least, names, logs = frequent_words(counts, top_words)
    read = encoded(rows, tokenizer, ids, names, logs)
    weights = train(read.where(learnt).select("part", "ids"), tokenizer, ids, often, size, seed)
    shared = spark.sparkContext.broadcast(weights)

    run = _score(shared, f"{shared._jbroadcast.id()}-{spark.sparkContext.applicationId}", held_out)
    scored = written(read.select("rid", "doc_id", "fold", "n_tokens", "known", "base", "ids").mapInArrow(run, "rid long, doc_id long, held_out boolean, n_tokens long, known long, base double, score double"), "scored")
    rare = counts.where((F.floor(F.log2("n") * 8) < least) & (F.col("word") != F.lit(bytearray(END))))
    met = read.select("rid", F.explode("rare").alias("word")).join(rare, "word")
    more = met.groupBy("rid").agg(F.count(F.lit(1)).alias("more"), F.sum(F.log10(F.col("n") + 1.0)).alias("sum"))
    base = F.col("base") + F.coalesce("sum", F.lit(0.0)) - F.col("n_tokens") * F.lit(math.log10(tokens + distinct + 1))
    known = F.col("known") + F.coalesce("more", F.lit(0))
    return scored.join(more, "rid", "left").select("doc_id", "held_out", "n_tokens", known.alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"), base.alias("base_score"), "score")


def op10_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
