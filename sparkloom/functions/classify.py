"""Semantic types of values, as Column expressions made from the pattern registry."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import DEFAULT, UNKNOWN, Pattern, Registry

DEFAULT_REGISTRY = Registry()
#: Names that count as a severity.
SEVERITIES = ["debug", "info", "notice", "warn", "warning", "error", "err", "critical", "crit", "fatal", "alert", "emerg", "emergency", "trace", "verbose"]


def is_blank(value: Column) -> Column:
    return F.coalesce(~value.rlike(r"(?U)\S"), F.lit(True))


def _chain(value: Column, registry: Registry, pick) -> Column:
    """One CASE over all patterns, the best first: the first hit is the best match."""
    case = F.when(is_blank(value), pick(UNKNOWN))
    for p in registry.by_priority():
        case = case.when(value.rlike(p.java), pick(p))
    return case.otherwise(pick(DEFAULT))


def best_pattern(value: Column, registry: Registry = DEFAULT_REGISTRY) -> Column:
    """The place of the best match's pattern in order of priority; 0 for a blank value, and
    one past the last where none fits.  One CASE, from which type and confidence follow."""
    case = F.when(is_blank(value), 0)
    for k, p in enumerate(registry.by_priority(), 1):
        case = case.when(value.rlike(p.java), k)
    return case.otherwise(len(registry.patterns) + 1)


def _looked_up(place: Column, registry: Registry, pick) -> Column:
    return F.element_at(F.array(*[F.lit(pick(p)) for p in (UNKNOWN, *registry.by_priority(), DEFAULT)]), place + 1)


def type_of(place: Column, registry: Registry = DEFAULT_REGISTRY) -> Column:
    return _looked_up(place, registry, lambda p: p.type)


def confidence_of(place: Column, registry: Registry = DEFAULT_REGISTRY) -> Column:
    """In hundredths, so that sums are exact."""
    return _looked_up(place, registry, lambda p: p.confidence % 100)


def best_type(value: Column, registry: Registry = DEFAULT_REGISTRY) -> Column:
    return type_of(best_pattern(value, registry), registry)


def best_confidence(value: Column, registry: Registry = DEFAULT_REGISTRY) -> Column:
    return confidence_of(best_pattern(value, registry), registry)


def _match(value: Column, p: Pattern) -> Column:
    whole = p.name in (DEFAULT.name, UNKNOWN.name)
    text = value if whole else F.regexp_extract(value, p.java, p.group)
    start = F.lit(0) if whole else (F.regexp_instr(value, F.lit(p.java)) - 1).cast("int")
    length = F.length(value) if whole else F.length(F.regexp_extract(value, p.java, 0))
    return F.struct(F.lit(p.type).alias("type"), text.alias("value"), F.lit(p.confidence % 100 / 100).alias("confidence"), F.lit(p.name).alias("pattern_name"), start.alias("start"), (start + length).cast("int").alias("end"))


def best_match(value: Column, registry: Registry = DEFAULT_REGISTRY) -> Column:
    """(type, value, confidence, pattern_name, start, end) of the best match."""
    return _chain(value, registry, lambda p: _match(value, p))


def recognize(value: Column, registry: Registry = DEFAULT_REGISTRY) -> Column:
    """All matches, the best first; the default for a value without any, none for a blank."""
    hits = F.filter(F.array(*[F.when(value.rlike(p.java), _match(value, p)) for p in registry.by_priority()]), lambda m: m.isNotNull())
    return F.when(is_blank(value), F.slice(F.array(_match(value, DEFAULT)), 1, 0)).when(F.size(hits) > 0, hits).otherwise(F.array(_match(value, DEFAULT)))


def is_valid_ip(value: Column) -> Column:
    """IPv4 with octets up to 255, or IPv6 of eight groups."""
    octets = F.transform(F.split(value, r"\."), lambda x: x.try_cast("int"))
    v4 = value.rlike(r"^\d{1,3}(?:\.\d{1,3}){3}$") & F.forall(octets, lambda x: x.between(0, 255))
    return F.coalesce(v4 | value.rlike(r"^(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}$"), F.lit(False))


def is_valid_severity(value: Column) -> Column:
    return F.coalesce(F.lower(value).isin(SEVERITIES), F.lit(False))


_WEEKDAY = r"^(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)\s+"


def _parsed(value: Column, *formats: str) -> Column:
    return F.coalesce(*[F.unix_millis(F.try_to_timestamp(value, F.lit(f))) for f in formats])


def is_valid_timestamp(value: Column) -> Column:
    """One of four usual forms, or a number of seconds or milliseconds since 1970."""
    bare = F.regexp_replace(value, r"^\[+|\]+$", "")
    number = bare.try_cast("double")
    forms = [
        (r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$", "yyyy-MM-dd HH:mm:ss", bare),
        (_WEEKDAY + r"[A-Z][a-z]{2} \d{1,2} \d{2}:\d{2}:\d{2} \d{4}$", "MMM d HH:mm:ss yyyy", F.regexp_replace(bare, _WEEKDAY, "")),
        (r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2},\d{1,6}$", "yyyy-MM-dd HH:mm:ss", F.regexp_replace(bare, r",\d+$", "")),
        (r"^\d{8}-\d{2}:\d{2}:\d{2}:\d{1,6}$", "yyyyMMdd-HH:mm:ss", F.regexp_replace(bare, r":\d+$", "")),
    ]
    good = [F.when(bare.rlike(r), F.try_to_timestamp(v, F.lit(f)).isNotNull()) for r, f, v in forms]
    return F.coalesce(reduce(lambda a, b: F.coalesce(a, b), good), (number > 1e9) & (number < 2e12), F.lit(False))


def epoch_ms(value: Column) -> Column:
    """Milliseconds since 1970 of every form with a date and a year; null for others.
    Forms without a zone are read in the session's."""
    v = F.regexp_replace(F.trim(value), r"^\[+|\]+$", "")
    digits = F.when(v.rlike(r"^\d{1,18}$"), F.when(v.try_cast("long") > 10**12, v.try_cast("long")).otherwise(v.try_cast("long") * 1000))
    iso = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}"
    zone = r"(?:Z|[+-]\d{2}:?\d{2})?$"
    spaced = F.regexp_replace(F.regexp_replace(v, r"^(\d{4}-\d{2}-\d{2})T", "$1 "), r",(\d{3,6})", ".$1")
    named = F.regexp_replace(F.regexp_replace(v, _WEEKDAY, ""), r"\s+", " ")
    return F.coalesce(
        digits,
        F.when(v.rlike(iso + r"(?:[.,]\d{1,6})?" + zone), F.unix_millis(spaced.try_cast("timestamp"))),
        F.when(v.rlike(r"^\d{8}-\d{2}:\d{2}:\d{2}:\d{3}$"), _parsed(v, "yyyyMMdd-HH:mm:ss:SSS")),
        F.when(named.rlike(r"^[A-Z][a-z]{2} \d{1,2} \d{2}:\d{2}:\d{2} \d{4}$"), _parsed(named, "MMM d HH:mm:ss yyyy")),
    )


def epoch_ms_compat(value: Column) -> Column:
    """The older reading: only ISO forms of 19 characters or with a T, and digits; else 0."""
    digits = value.rlike(r"^\d{1,18}$")
    iso = value.rlike(r"^\d{4}-\d{2}-\d{2}(?:T\d{2}:\d{2}:\d{2}(?:\.\d{1,6})?(?:Z|[+-]\d{2}:?\d{2})?| \d{2}:\d{2}:\d{2})$")
    return F.coalesce(F.when(digits | iso, epoch_ms(value)), F.lit(0))
