"""The column encodings of the sequences that sources are, and their byte codecs.

What depends on the lines before is computed over ranges of a source (``ordered``), so that
one long log is spread over many tasks."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import Ordered, numbered

RUN_CAP = 65_535
PATTERN_MARK, MIN_REPEATS, MAX_PATTERN = 0xFF, 3, 19
SHORT_BLOCK = 64


def zigzag(n: Column) -> Column:
    return F.shiftleft(n, 1).bitwiseXOR(F.shiftright(n, 63))


def unzigzag(z: Column) -> Column:
    return F.shiftrightunsigned(z, 1).bitwiseXOR(-z.bitwiseAND(F.lit(1).cast("long")))


def varint_size(z: Column) -> Column:
    """Bytes of a varint; 10 for a negative number."""
    return F.when(z < 0, 10).otherwise(F.greatest(F.lit(1), F.ceil(F.length(F.bin(z)) / 7))).cast("int")


def compare_sizes(df: DataFrame, column: str) -> DataFrame:
    """Varints against four bytes each."""
    totals = df.agg(F.count(column).alias("count"), (F.count(column) * 4).alias("fixed_bytes"), F.coalesce(F.sum(varint_size(F.col(column))), F.lit(0)).alias("varint_bytes"))
    saved = F.col("fixed_bytes") - F.col("varint_bytes")
    return totals.select("*", F.try_divide("fixed_bytes", "varint_bytes").alias("ratio"), saved.alias("saved_bytes"), (F.try_divide(saved, F.col("fixed_bytes")) * 100).alias("saved_pct"))


def delta_encode(df: DataFrame, column: str = "ts_ms") -> DataFrame:
    """base and delta: the first value of a source, and each one's step from the last."""
    rows = Ordered(df.where(F.col(column).isNotNull())).previous(F.col(column), "_before").rows()
    base = rows.where("_before is null").select("source", F.col(column).alias("base"))
    return rows.withColumn("delta", F.coalesce(F.col(column) - F.col("_before.v"), F.lit(0))).drop("_before").join(base, "source")


def delta_decode(df: DataFrame) -> DataFrame:
    return Ordered(df).running(F.col("delta"), "_sum").rows().withColumn("decoded", F.col("base") + F.col("_sum")).drop("_sum")


def delta_of_delta(df: DataFrame, column: str = "ts_ms") -> DataFrame:
    """dod and the bits that a prefix code takes for it: the first value whole, the first
    step in 32 bits, then 1, 9, 12, 16 or 36 bits."""
    ordered = Ordered(df.where(F.col(column).isNotNull())).previous(F.col(column), "_before")
    rows = ordered.previous(F.col(column) - F.col("_before.v"), "_step").rows()
    step = F.col(column) - F.col("_before.v")
    dod = step - F.col("_step.v")
    bits = F.when(F.col("_before").isNull(), 64).when(dod.isNull(), 32).when(dod == 0, 1).when(dod.between(-63, 63), 9).when(dod.between(-255, 255), 12).when(dod.between(-2047, 2047), 16).otherwise(36)
    return rows.select("*", step.alias("step"), dod.alias("dod"), bits.alias("bits")).drop("_before", "_step")


def runs(df: DataFrame, column: str, cap: int = RUN_CAP) -> DataFrame:
    """(source, run, value, count): runs of equal values in order, split at the cap."""
    value = F.col(column)
    ordered = Ordered(df.select("source", "log_idx", column)).previous(value, "_before")
    opens = F.when(F.col("_before").isNotNull() & F.col("_before.v").eqNullSafe(value), 0).otherwise(1).cast("long")
    marked = ordered.running(opens, "_run").rows()
    whole = marked.groupBy("source", "_run").agg(F.first(column).alias("value"), F.count(F.lit(1)).alias("n"))
    piece = whole.withColumn("_piece", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / cap) - 1)))
    counted = piece.withColumn("count", F.least(F.lit(cap).cast("long"), F.col("n") - F.col("_piece") * cap))
    return numbered(counted, "_run", "_at", ("_piece",)).select("source", (F.col("_at") + 1).alias("run"), "value", "count")


def expand_runs(run_table: DataFrame) -> DataFrame:
    """(source, place, value) again, places from 0."""
    placed = Ordered(run_table, "run").running(F.col("count"), "_before", before=True).rows()
    return placed.select("source", F.posexplode(F.array_repeat("value", F.col("count").cast("int"))).alias("_k", "value"), "_before").select("source", (F.col("_before") + F.col("_k")).alias("place"), "value")


def dictionary(df: DataFrame, column: str, order: str = "log_idx") -> DataFrame:
    """(source, value, id): ids by first appearance, from 0."""
    first = df.where(F.col(column).isNotNull()).groupBy("source", F.col(column).alias("value")).agg(F.min(order).alias("_first"))
    return numbered(first, "_first", "id", ("value",)).select("source", "value", "id")


def dictionary_encode(df: DataFrame, column: str) -> DataFrame:
    ids = dictionary(df, column).select("source", F.col("value").alias(column), F.col("id").alias(f"{column}_id"))
    return df.join(ids, ["source", column], "left")


def dictionary_decode(df: DataFrame, ids: DataFrame, id_column: str, as_column: str) -> DataFrame:
    """Values again; an id that is not in the dictionary gives none."""
    return df.join(ids.select("source", F.col("id").alias(id_column), F.col("value").alias(as_column)), ["source", id_column], "left")


def token_pool(templates: DataFrame) -> DataFrame:
    """(source, token, id): the tokens of all patterns, numbered as they first appear in
    the order of the templates."""
    places = templates.select("source", "rank", F.posexplode("pattern").alias("pos", "token"))
    first = places.groupBy("source", "token").agg(F.min(F.struct("rank", "pos")).alias("_first"))
    return first.select("source", "token", (F.row_number().over(Window.partitionBy("source").orderBy("_first")) - 1).alias("id"))


def template_refs(templates: DataFrame, pool: DataFrame) -> DataFrame:
    """(source, template_id, refs): each pattern as ids of the pool."""
    places = templates.select("source", "template_id", F.posexplode("pattern").alias("pos", "token")).join(pool, ["source", "token"])
    return places.groupBy("source", "template_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"]).alias("refs"))


def patterns_of_refs(refs: DataFrame, pool: DataFrame) -> DataFrame:
    """(source, template_id, pattern) again."""
    places = refs.select("source", "template_id", F.posexplode("refs").alias("pos", "id")).join(pool, ["source", "id"])
    return places.groupBy("source", "template_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"]).alias("pattern"))


# ---------------------------------------------------------------- byte codecs


def varint_encode(n: int) -> bytes:
    """Groups of seven bits, the lowest first; the high bit tells that more follow."""
    if n < 0:
        raise ValueError("a varint holds no negative number")
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def varint_decode(data: bytes, at: int = 0) -> tuple[int, int]:
    """The number at ``at`` and its length in bytes."""
    value = 0
    for k in range(10):
        if at + k >= len(data):
            raise ValueError("the data end within a varint")
        byte = data[at + k]
        value |= (byte & 0x7F) << 7 * k
        if byte < 0x80:
            return value, k + 1
    raise ValueError("a varint is too long")


def varints_encode(numbers) -> bytes:
    return b"".join(map(varint_encode, numbers))


def varints_decode(data: bytes, count: int) -> list[int]:
    out, at = [], 0
    for _ in range(count):
        value, size = varint_decode(data, at)
        out.append(value)
        at += size
    return out


def rle_encode(values: list[int], cap: int = RUN_CAP) -> bytes:
    """(value, count) varints of runs, split at the cap."""
    out, at = bytearray(), 0
    while at < len(values):
        end = at
        while end < len(values) and values[end] == values[at] and end - at < cap:
            end += 1
        out += varint_encode(values[at]) + varint_encode(end - at)
        at = end
    return bytes(out)


def rle_decode(data: bytes, count: int | None = None) -> list[int]:
    out, at = [], 0
    while at < len(data) and (count is None or len(out) < count):
        value, size = varint_decode(data, at)
        times, more = varint_decode(data, at + size)
        out += [value] * times
        at += size + more
    return out if count is None else out[:count]


def pattern_rle_encode(values: list[int]) -> tuple[str, bytes]:
    """("pattern" or "runs", bytes).  A pattern of the fewest values that opens the data and
    repeats at least three times is written once, with its repeats, before the runs of the
    rest.  The tag tells the forms apart, where the first byte alone could not."""
    n = len(values)
    if n >= 4:
        for size in range(2, min(n // 2, MAX_PATTERN) + 1):
            pattern = values[:size]
            times = 1
            while values[times * size : (times + 1) * size] == pattern:
                times += 1
            if times >= MIN_REPEATS:
                head = bytes([PATTERN_MARK]) + varint_encode(size) + varints_encode(pattern) + varint_encode(times)
                return "pattern", head + rle_encode(values[times * size :])
    return "runs", rle_encode(values)


def pattern_rle_decode(mode: str, data: bytes, count: int | None = None) -> list[int]:
    if mode == "runs":
        return rle_decode(data, count)
    size, used = varint_decode(data, 1)
    at, pattern = 1 + used, []
    for _ in range(size):
        value, used = varint_decode(data, at)
        pattern.append(value)
        at += used
    times, used = varint_decode(data, at)
    out = pattern * times + rle_decode(data[at + used :])
    return out if count is None else out[:count]


#: Prefix, its bits, bits of the value, and the greatest size of the value.
_DOD_CODES = ((0b10, 2, 7, 63), (0b110, 3, 9, 255), (0b1110, 4, 12, 2047), (0b1111, 4, 32, 2**31 - 1))


def timestamps_encode(values: list[int]) -> bytes:
    """Delta-of-delta codes in one run of bits: 64 for the first value, 32 for the first
    step, then one zero bit for no change of step, else a prefix and the change."""
    bits, width = 0, 0

    def put(value: int, n: int) -> None:
        nonlocal bits, width
        bits = bits << n | value & (1 << n) - 1
        width += n

    for k, v in enumerate(values):
        if k == 0:
            put(v, 64)
        elif k == 1:
            put(v - values[0], 32)
        else:
            change = v - 2 * values[k - 1] + values[k - 2]
            if change == 0:
                put(0, 1)
                continue
            code = next((c for c in _DOD_CODES if abs(change) <= c[3]), None)
            if code is None:
                raise ValueError("a change of step over 32 bits")
            put(code[0], code[1])
            put(change, code[2])
    return struct.pack(">I", len(values)) + (bits << -width % 8).to_bytes(-(-width // 8), "big")


def timestamps_decode(data: bytes) -> list[int]:
    count = struct.unpack(">I", data[:4])[0]
    bits, left = int.from_bytes(data[4:], "big"), 8 * (len(data) - 4)

    def take(n: int, signed: bool = False) -> int:
        nonlocal left
        left -= n
        value = bits >> left & (1 << n) - 1
        return value - (1 << n) if signed and value >> n - 1 else value

    out: list[int] = []
    for k in range(count):
        if k == 0:
            out.append(take(64, True))
        elif k == 1:
            out.append(out[0] + take(32, True))
        else:
            change = 0
            if take(1):
                ones = 1
                while ones < 4 and take(1):
                    ones += 1
                change = take(_DOD_CODES[ones - 1][2], True)
            out.append(2 * out[-1] - out[-2] + change)
    return out


def bwt(data: bytes, block: int = 256 << 10) -> bytes:
    """Blocks, each with size and row of the text, little-endian, then its last column.
    Rotations are sorted by prefix doubling, in n log n steps and linear memory."""
    import numpy as np

    out = bytearray()
    for at in range(0, len(data), block):
        piece = np.frombuffer(data[at : at + block], np.uint8)
        n = len(piece)
        if n <= SHORT_BLOCK:  # rotations as they are, without arrays
            text = piece.tobytes()
            turned = sorted(range(n), key=lambda k: text[k:] + text[:k])
            out += struct.pack("<II", n, turned.index(0)) + bytes(text[k - 1] for k in turned)
            continue
        rank, step = piece.astype(np.int64), 1
        order = np.argsort(rank, kind="stable")
        while True:
            second = rank[(np.arange(n) + step) % n]
            order = np.lexsort((second, rank))
            new = np.zeros(n, np.int64)
            new[order[1:]] = np.cumsum((rank[order[1:]] != rank[order[:-1]]) | (second[order[1:]] != second[order[:-1]]))
            rank = new
            step *= 2
            if rank.max(initial=0) == n - 1 or step >= n:
                break
        order = np.lexsort((np.arange(n), rank))
        out += struct.pack("<II", n, int(np.nonzero(order == 0)[0][0])) + piece[(order - 1) % n].tobytes()
    return bytes(out)


def inverse_bwt(data: bytes) -> bytes:
    import numpy as np

    out, at = bytearray(), 0
    while at < len(data):
        n, row = struct.unpack("<II", data[at : at + 8])
        last = data[at + 8 : at + 8 + n]
        follow = sorted(range(n), key=last.__getitem__) if n <= SHORT_BLOCK else np.argsort(np.frombuffer(last, np.uint8), kind="stable").tolist()
        piece = bytearray()
        for _ in range(n):
            row = follow[row]
            piece.append(last[row])
        out += piece
        at += 8 + n
    return bytes(out)


#: Byte codecs by name: (encode, decode) of a list of whole numbers.
CODECS = {
    "varint": (varints_encode, lambda data: varints_decode(data, sum(b < 0x80 for b in data))),
    "rle": (rle_encode, rle_decode),
    "timestamps": (timestamps_encode, timestamps_decode),
}


def codec_functions(name: str):
    """A codec as two functions for DataFrames: array<long> to binary, and back."""
    encode, decode = CODECS[name]

    @F.pandas_udf("binary")
    def encoded(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else encode([int(x) for x in v]))

    @F.pandas_udf("array<long>")
    def decoded(data: pd.Series) -> pd.Series:
        return data.map(lambda d: None if d is None else decode(bytes(d)))

    return encoded, decoded


def came_back(values: list[int], stamps: list[int]) -> bool:
    """Whether pattern runs, runs and block sorting give the values again, and bit-packed
    timestamps the stamps."""
    again, data = values[:2] * 5 + values, varints_encode(values)
    ok = all(pattern_rle_decode(*pattern_rle_encode(x)) == x for x in (values, again)) and rle_decode(rle_encode(values)) == values
    return ok and timestamps_decode(timestamps_encode(stamps)) == stamps and inverse_bwt(bwt(data, 256)) == data


def came_back_function():
    """``came_back`` for DataFrames: of the values and the stamps of a row, as arrays."""

    @F.pandas_udf("boolean")
    def whole(values: pd.Series, stamps: pd.Series) -> pd.Series:
        return pd.Series([came_back(v.tolist(), s.tolist()) for v, s in zip(values, stamps)], dtype=bool)

    return whole
