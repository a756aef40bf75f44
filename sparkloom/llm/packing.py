"""Packing: bounded-space online packing of tokenised documents into fixed windows.

Each partition keeps a fixed number of open windows.  A piece goes to the window it fits
best; when none fits and no more may be opened, the fullest window is filled to the brim
with the piece's head and emitted, and the tail goes on.  At the end the leftovers of a
few partitions each meet and are packed the same way; what then remains is cut at powers
of two, which need no padding.

Defined cases
  * null text counts as empty: its only id is the end id; every id lies in one piece;
  * a document of any length is cut at full windows as it comes; repeated rows and ids
    are packed each; null ids are carried; an empty table gives an empty result.
"""

from __future__ import annotations

import os
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, kept, pieces, split_words, text, written

WINDOW = 2048
OPEN_WINDOWS = 32
MERGE_PARTS = 32
END_ID = 1
CACHE_WORDS = 1_200_000
RESULT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


#: The byte-level alphabet's letters for the bytes that are no printable Latin-1 character:
#: those bytes in order, from code point 256.
BYTE_LETTERS = {b: 256 + k for k, b in enumerate([*range(33), *range(127, 161), 173])}
SPECIAL = "<|"  # may open a special token, which is found before case is lowered


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class _Growing:
    """An array that grows by doubling."""

    def __init__(self, kind):
        self.values, self.size = np.empty(1 << 12, kind), 0

    def add(self, more) -> None:
        size = self.size + len(more)
        if size > len(self.values):
            self.values = np.concatenate([self.values[: self.size], np.empty(max(size, 2 * self.size) - self.size, self.values.dtype)])
        self.values[self.size : size] = more
        self.size = size


class WordIds:
    """Token ids of texts, by a bounded store of the ids of white-space separated words.
    The tokenizer drops white space and never joins across it, so a text's ids are its
    words' ids one after the other."""

    def __init__(self, path: str, end_id: int):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks already use all cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.end_id = end_id
        #: a closing comma or full stop after a letter is a piece of its own
        self.closing = {ord(c): self.tokenizer.encode(c, add_special_tokens=False).ids[0] for c in ",."}
        self.reset()

    def reset(self) -> None:
        self.index = {None: 0}  # row 0 is the end
        self.starts, self.lengths, self.pool = _Growing(np.int64), _Growing(np.int64), _Growing(np.uint32)
        self.starts.add([0])
        self.lengths.add([1])
        self.pool.add([self.end_id])

    def plain(self, word: str) -> list[int] | None:
        """The ids of a word of Latin letters, straight from the merges: normalising leaves
        it as it is and splitting leaves it whole."""
        if not word.isalpha():
            return None
        word = word.lower()
        if not word.isascii():
            if max(word) >= "\u0250" or not word.isalpha() or not unicodedata.is_normalized("NFC", word):
                return None
            word = word.encode().decode("latin-1").translate(BYTE_LETTERS)
        return [t.id for t in self.model.tokenize(word)]

    def learn(self, words: list[bytes]) -> None:
        flat, lengths, rest, n = [], [], [], len(self.index)
        index, closing, plain, tokenize = self.index, self.closing, self.plain, self.model.tokenize
        pool, starts, known, old = self.pool.values, self.starts.values, self.lengths.values, n
        for word in words:
            tail = closing.get(word[-1])
            base = word if tail is None else word[:-1]
            row = index.get(base)
            if row is not None and row < old and tail is not None and base.isalpha():
                ids = pool[starts[row] : starts[row] + known[row]].tolist()
            elif base.isalpha() and base.islower():  # of bytes: ASCII letters alone
                ids = [t.id for t in tokenize(base.decode())]
            else:
                ids = plain(base.decode())
                if ids is None:
                    rest.append(word)
                    continue
            if tail is not None:
                ids.append(tail)
            index[word] = n
            n += 1
            lengths.append(len(ids))
            flat += ids
        for word, e in zip(rest, self.tokenizer.encode_batch([w.decode() for w in rest], add_special_tokens=False)):
            index[word] = n
            n += 1
            lengths.append(len(e.ids))
            flat += e.ids
        lengths = np.array(lengths, np.int64)
        self.starts.add(self.pool.size + np.cumsum(lengths) - lengths)
        self.lengths.add(lengths)
        self.pool.add(flat)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids with an end id after each text, and the ids' count for each text."""
        if len(self.index) > CACHE_WORDS:
            self.reset()
        # the tokenizer lowers case too, but only after it has looked for special tokens
        words, codes, counts = split_words(texts, lower=not pc.any(pc.match_substring(texts, SPECIAL)).as_py())
        self.learn([w for w in words if w not in self.index])
        table = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        closing = np.cumsum(counts + 1) - 1
        inner = np.ones(len(codes) + len(counts), bool)
        inner[closing] = False
        rows = np.zeros(len(inner), np.int64)
        rows[inner] = table[codes]
        n = self.lengths.values[rows]
        ends = np.cumsum(n)
        ids = self.pool.values[np.repeat(self.starts.values[rows] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)]
        return ids, np.diff(ends[closing], prepend=0)


def word_ids(path: str, end_id: int) -> WordIds:
    """One store for each worker process."""
    return kept("packing", f"{path} {end_id}", lambda: WordIds(path, end_id))


class Packer:
    """Windows of ``size`` ids, at most ``most`` of them open."""

    def __init__(self, size: int, most: int):
        self.size, self.most = size, most
        self.open: list[list] = []  # [free, pieces]

    def place(self, doc_id, start: int, ids: np.ndarray, total: int):
        """Yields the pieces of each window that is full."""
        while len(ids):
            n, best, fullest = len(ids), None, None
            if n < self.size:
                for w in self.open:
                    if w[0] >= n:
                        if best is None or w[0] < best[0]:
                            best = w
                    elif fullest is None or w[0] < fullest[0]:
                        fullest = w
            if best is None:
                if n >= self.size or len(self.open) < self.most:
                    best = [self.size, []]
                    self.open.append(best)
                else:
                    best = fullest
            head = ids[: best[0]]
            best[1].append((doc_id, start, head, total))
            best[0] -= len(head)
            if not best[0]:
                self.open.remove(best)
                yield best[1]
            start, ids = start + len(head), ids[len(head) :]

    def rest(self):
        """The pieces of the windows still open, the fullest window first."""
        for _, pieces in sorted(self.open, key=lambda w: w[0]):
            yield from pieces
        self.open = []


class _Rows:
    def __init__(self):
        self.columns = [[] for _ in range(9)]

    def add(self, pieces, sequence: int) -> None:
        at = 0
        for doc_id, start, ids, total in pieces:
            for c, v in zip(self.columns, (doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, sequence, at, None, None)):
                c.append(v)
            at += len(ids)

    def spare(self, doc_id, start, ids, total, group: int) -> None:
        for c, v in zip(self.columns, (doc_id, start, len(ids), None, total, None, None, group, ids.astype("<u4").tobytes())):
            c.append(v)

    def batch(self, more: bool) -> pa.RecordBatch:
        kinds = [pa.int64()] * 8 + [pa.binary()]
        names = [*_NAMES, "part_group", "ids"]
        out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(self.columns, kinds)][: 9 if more else 7], names[: 9 if more else 7])
        self.columns = [[] for _ in range(9)]
        return out


def _pack(path: str, end_id: int, size: int, most: int, merge: int):
    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        store, packer, rows, done = word_ids(path, end_id), Packer(size, most), _Rows(), 0
        for batch in batches:
            for piece in pieces(batch, 1):
                ids, counts = store.encode(piece.column(1))
                cut = 0
                for doc_id, n in zip(piece.column(0).to_pylist(), counts.tolist()):
                    for full in packer.place(doc_id, 0, ids[cut : cut + n], n):
                        rows.add(full, (part << 32) + done)
                        done += 1
                    cut += n
                # open windows must not keep a whole batch's ids alive
                for w in packer.open:
                    w[1] = [(d, s, i.copy() if i.base is not None else i, t) for d, s, i, t in w[1]]
            if rows.columns[0]:
                yield rows.batch(True)
        for piece in packer.rest():
            rows.spare(*piece, part // merge)
        yield rows.batch(True)

    return run


def _merge(size: int, most: int):
    def run(key, table):
        group = key[0].as_py()
        packer, rows, done = Packer(size, most), _Rows(), 0
        base = (1 << 30) + group << 32
        columns = [table.column(n).to_pylist() for n in ("doc_id", "start", "ids", "doc_tokens")]
        pieces = [(d, s, np.frombuffer(i, "<u4"), t) for d, s, i, t in zip(*columns)]
        pieces.sort(key=lambda p: (-len(p[2]), p[0] is None, p[0] or 0, p[1]))
        for piece in pieces:
            for full in packer.place(*piece):
                rows.add(full, base + done)
                done += 1
        last = Packer(size, 1)
        for piece in packer.rest():
            for full in last.place(*piece):
                rows.add(full, base + done)
                done += 1
        left = list(last.rest())
        n = sum(len(p[2]) for p in left)
        while n:  # what remains is cut at powers of two
            room, cut = 1 << n.bit_length() - 1, []
            n -= room
            while room:
                d, s, ids, t = left.pop(0)
                cut.append((d, s, ids[:room], t))
                if len(ids) > room:
                    left.insert(0, (d, s + room, ids[room:], t))
                room -= len(cut[-1][2])
            rows.add(cut, base + done)
            done += 1
        return pa.Table.from_batches([rows.batch(False)])

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, open_windows: int = OPEN_WINDOWS, tokenizer: str | None = None, end_id: int = END_ID, merge_parts: int = MERGE_PARTS) -> DataFrame:
    """Pieces of all documents in windows of ``window`` ids (RESULT)."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text(text_col).alias("text"))
    run = _pack(tokenizer or default_tokenizer(), end_id, window, open_windows, merge_parts)
    packed = written(rows.mapInArrow(run, f"{RESULT}, part_group long, ids binary"), "pieces")
    # at most open_windows windows of each partition are left: a group's size has a fixed bound
    merged = packed.where("part_group is not null").groupBy("part_group").applyInArrow(_merge(window, 4 * open_windows), RESULT)
    return packed.where("part_group is null").select(*_NAMES).unionByName(merged)


def op9_sequence_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
