"""PII: format-preserving Feistel pseudonyms.

Numbers, dates, addresses and keys that pass their format's own check are replaced by the
image of a keyed Feistel permutation of all values of that format (cycle-walked where the
domain is no product), with check digits made anew.  Equal values so become equal
pseudonyms in every document, different ones stay different, and a pseudonym is again a
valid value of the same format and length.

Formats: payment cards (Luhn), IBAN (mod 97), US social security numbers, telephone
numbers, IPv4 addresses, calendar dates (also before a time), e-mail addresses but for their
top domain, and access keys, passwords and tokens of assignments and bearer tokens.  What fails its check stays as it is.

Defined cases
  * null text stays null and empty text empty; ids, other columns and repeated rows are
    kept; texts of any length are read whole; an empty table gives an empty result.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

KEY = b"sparkloom: give a key of your own"
ROUNDS = 8
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()

MAYBE = re.compile(r"[0-9@]|AKIA|(?i:passw|pwd|token|secret|bearer|api[_-]?key)")  # of all that PII can match
PII = re.compile(
    r"""
    (?P<email>(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9._+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})
  | (?P<access>(?<![A-Z0-9a-z])AKIA[0-9A-Z]{16}(?![A-Z0-9a-z]))
  | (?P<secret>(?i:(?<![a-z])(?:password|passwd|pwd|token|secret|api[_-]?key)\s{0,3}[=:]\s{0,3}["']?)(?P<value>[^\s"'<>,;]{7,}[^\s"'<>,;.:!?)\]}]))
  | (?P<bearer>(?i:(?<![a-z])bearer\s{1,3})(?P<carried>(?=[A-Za-z._~+/-]*\d)[A-Za-z0-9._~+/-]{15,}[A-Za-z0-9]))
  | (?P<iban>(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))
  | (?P<iso>(?<![\w.-])\d{4}-\d{2}-\d{2}(?=T\d{2}:\d{2}|(?!\w|-\w)))
  | (?P<slash>(?<![\w/.-])\d{2}(?P<sep>[/.])\d{2}(?P=sep)\d{4}(?![\w/]|-\w|\.\d))
  | (?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?!\w|-\w))
  | (?P<ip>(?<![\w.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![\w]|\.\d))
  | (?P<intl>(?<![\w+])\+\d{1,3}(?:[ .-]?\(?\d{2,4}\)?){2,5}(?!\w))
  | (?P<nanp>(?<![\w+-])(?:\(\d{3}\)[ ]?|\d{3}[-.])\d{3}[-.]\d{4}(?!\w|-\w))
  | (?P<card>(?<![\w-])(?:\d{13,19}|\d{4}(?P<gap>[ -])\d{4}(?P=gap)\d{4}(?P=gap)\d{4}(?:(?P=gap)\d{1,3})?|\d{4}[ -]\d{6}[ -]\d{4,5})(?!\w|-\w))
    """,
    re.X | re.A,
)


class Feistel:
    """A keyed permutation of 0 ... n - 1 for any n, a different one for each format."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _round(self, tag: bytes, k: int, n: int, x: int) -> int:
        data = b"%s|%d|%d|%d" % (tag, k, n, x)
        return int.from_bytes(hashlib.blake2b(data, key=self.key, digest_size=64).digest(), "big")

    def permute(self, tag: str, n: int, x: int) -> int:
        if n < 2:
            return x
        a = isqrt(n - 1) + 1
        b = -(-n // a)
        name = tag.encode()
        while True:
            left, right = divmod(x, b)
            for k in range(ROUNDS):
                if k % 2:
                    right = (right + self._round(name, k, n, left)) % b
                else:
                    left = (left + self._round(name, k, n, right)) % a
            x = left * b + right
            if x < n:
                return x

    def mixed(self, tag: str, radices: list[int], digits: list[int]) -> list[int]:
        """The permutation of a mixed-radix number."""
        n, x = 1, 0
        for r, d in zip(radices, digits):
            n, x = n * r, x * r + d
        x, out = self.permute(tag, n, x), []
        for r in reversed(radices):
            x, d = divmod(x, r)
            out.append(d)
        return out[::-1]


_SETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def _characters(feistel: Feistel, tag: str, text: str) -> str:
    """Each digit, small and capital letter goes to one of its own kind; hex stays hex."""
    is_hex = re.fullmatch(r"[0-9a-f]{8,}", text) and not text.isdigit()
    sets = ("0123456789abcdef",) if is_hex else _SETS
    kind = [next((s for s in sets if c in s), None) for c in text]
    places = [i for i, s in enumerate(kind) if s]
    shape = "".join(c if s is None else "xh"[len(sets) == 1] if s is sets[0] else "aA"[s is sets[-1]] for c, s in zip(text, kind))
    out = list(text)
    while True:
        new = feistel.mixed(f"{tag}:{shape}", [len(kind[i]) for i in places], [kind[i].index(out[i]) for i in places])
        for i, d in zip(places, new):
            out[i] = kind[i][d]
        if not is_hex or not "".join(out).isdigit():  # hex walks on until it shows as hex
            return "".join(out)


def luhn(digits: list[int]) -> int:
    """The check digit that follows ``digits``."""
    return -sum(d if k % 2 else d * 2 - 9 * (d > 4) for k, d in enumerate(reversed(digits))) % 10


def _fill(shape: str, digits) -> str:
    it = iter(digits)
    return "".join(str(next(it)) if c.isdigit() else c for c in shape)


def card(f: Feistel, text: str) -> str:
    d = [int(c) for c in text if c.isdigit()]
    if luhn(d[:-1]) != d[-1] or len(set(d)) == 1:
        return text
    new = [d[0], *f.mixed(f"card{len(d)}:{d[0]}", [10] * (len(d) - 2), d[1:-1])]
    return _fill(text, [*new, luhn(new)])


def _mod97(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97


def iban(f: Feistel, text: str) -> str:
    plain = text.replace(" ", "")
    if not 15 <= len(plain) <= 34 or _mod97(plain) != 1:
        return text
    body = _characters(f, f"iban{plain[:2]}", plain[4:])
    new = iter(plain[:2] + f"{98 - _mod97(plain[:2] + '00' + body):02d}" + body)
    return "".join(c if c == " " else next(new) for c in text)


def ssn(f: Feistel, text: str) -> str:
    area, group, serial = map(int, text.split("-"))
    if area in (0, 666) or area > 899 or not group or not serial:
        return text
    a, g, s = f.mixed("ssn", [898, 99, 9999], [area - 1 - (area > 666), group - 1, serial - 1])
    return f"{a + 1 + (a + 1 >= 666):03d}-{g + 1:02d}-{s + 1:04d}"


def ip(f: Feistel, text: str) -> str:
    parts = text.split(".")
    octets = [int(p) for p in parts]
    if max(octets) > 255 or any(len(p) > 1 and p[0] == "0" for p in parts):
        return text
    low, count = {1: 0, 2: 10, 3: 100}, {1: 10, 2: 90, 3: 156}
    sizes = [len(p) for p in parts]
    new = f.mixed("ip" + "".join(map(str, sizes)), [count[n] for n in sizes], [o - low[n] for o, n in zip(octets, sizes)])
    return ".".join(str(d + low[n]) for d, n in zip(new, sizes))


def _day(f: Feistel, year: int, month: int, day: int) -> datetime.date | None:
    try:
        n = datetime.date(year, month, day).toordinal()
    except ValueError:
        return None
    return datetime.date.fromordinal(FIRST_DAY + f.permute("date", LAST_DAY - FIRST_DAY + 1, n - FIRST_DAY)) if FIRST_DAY <= n <= LAST_DAY else None


def iso(f: Feistel, text: str) -> str:
    new = _day(f, *map(int, text.split("-")))
    return new.isoformat() if new else text


def slash(f: Feistel, text: str) -> str:
    """dd.mm.yyyy; mm/dd/yyyy, or dd/mm/yyyy where that alone is a date."""
    a, b, year = int(text[:2]), int(text[3:5]), int(text[6:])
    sep = text[2]
    if sep == "/" and (new := _day(f, year, a, b)):
        return f"{new.month:02d}/{new.day:02d}/{new.year}"
    new = _day(f, year, b, a)
    return f"{new.day:02d}{sep}{new.month:02d}{sep}{new.year}" if new else text


def nanp(f: Feistel, text: str) -> str:
    d = [int(c) for c in text if c.isdigit()]
    if d[0] < 2 or d[3] < 2:
        return text
    new = f.mixed("nanp", [8, 10, 10, 8, 10, 10, 10, 10, 10, 10], [d[0] - 2, *d[1:3], d[3] - 2, *d[4:]])
    return _fill(text, [new[0] + 2, *new[1:3], new[3] + 2, *new[4:]])


def intl(f: Feistel, text: str) -> str:
    d = [int(c) for c in text if c.isdigit()]
    if not 8 <= len(d) <= 15:
        return text
    american = d[0] == 1 and len(d) == 11
    if american and d[1] > 1 and d[4] > 1:
        return text[: text.index("1") + 1] + nanp(f, text[text.index("1") + 1 :])
    code = re.match(r"\+(\d{1,3})(?=[ .(-])|\+(\d\d)", text)
    code = 1 if american else len(code[1] or code[2])
    new = d[code:]
    while True:
        new = f.mixed(f"intl{len(d)}:{d[:code]}", [10] * (len(d) - code), new)
        if not american or new[0] < 2 or new[3] < 2:  # numbers that are no NANP ones walk on among themselves
            return _fill(text, [*d[:code], *new])


def grouped(f: Feistel, kind: str, text: str) -> str:
    """A card number or IBAN in groups, the last of which may be its neighbours'."""
    change = {"card": card, "iban": iban}[kind]
    end, least = len(text), 13 if kind == "card" else 15
    while end > 0 and sum(c.isalnum() for c in text[:end]) >= least:
        new = change(f, text[:end])
        if new != text[:end]:
            return new
        end = max(text.rfind(" ", 0, end), text.rfind("-", 0, end))
    return text


def pseudonym(f: Feistel, m: re.Match) -> str:
    text = m[0]
    kind = next(k for k in ("email", "access", "secret", "bearer", "iban", "iso", "slash", "ssn", "ip", "intl", "nanp", "card") if m[k] is not None)
    if kind in ("card", "iban"):
        return grouped(f, kind, text)
    if kind == "email":
        local, _, domain = text.partition("@")
        *names, top = domain.split(".")  # each name by itself, so that one host stays one host
        return ".".join([f'{_characters(f, "email", local)}@{_characters(f, "domain", names[0])}', *(_characters(f, "domain", n) for n in names[1:]), top])
    if kind == "access":
        value = text[4:]
        sets = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
        return "AKIA" + "".join(sets[d] for d in f.mixed("access", [36] * 16, [sets.index(c) for c in value]))
    if kind == "secret":
        at = m.start("value") - m.start()
        return text[:at] + _characters(f, "secret", m["value"])
    if kind == "bearer":
        return text[: m.start("carried") - m.start()] + _characters(f, "secret", m["carried"])
    return {"iso": iso, "slash": slash, "ssn": ssn, "ip": ip, "intl": intl, "nanp": nanp}[kind](f, text)


def replace(f: Feistel, text: str) -> tuple[str, int]:
    """The text with its pseudonyms, and how many there are."""
    if not MAYBE.search(text):
        return text, 0
    n, out, done, at = 0, [], 0, 0
    while m := PII.search(text, at):
        new = pseudonym(f, m)
        at = m.end()
        if m["card"] or m["iban"]:  # goes on behind the groups that were taken, or behind the first one
            at = m.start() + (len(new) if new != m[0] else re.match(r"[^ -]+", new).end())
        if new != m[0]:
            n += 1
            out += [text[done : m.start()], new]
            done = at
    return "".join([*out, text[done:]]), n


def pseudonymise(docs: DataFrame, text_col: str = "text", key: bytes = KEY, count_col: str | None = None) -> DataFrame:
    """``docs`` with the text column's personal values replaced; ``count_col`` adds their number."""
    bounded_batches(docs.sparkSession)
    f, at = Feistel(key), docs.columns.index(text_col)
    schema = docs.schema if count_col is None else docs.withColumn(count_col, F.lit(0).cast("long")).schema

    def run(batches):
        for batch in batches:
            done = [(None, 0) if t is None else replace(f, t) for t in batch.column(at).to_pylist()]
            columns = [pa.array([t for t, _ in done], batch.schema.field(at).type) if k == at else batch.column(k) for k in range(batch.num_columns)]
            names = list(batch.schema.names)
            if count_col is not None:
                columns.append(pa.array([n for _, n in done], pa.int64()))
                names.append(count_col)
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(run, schema)


def op5_pii_pseudonyms(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pseudonymise(docs, count_col="n_replaced")
