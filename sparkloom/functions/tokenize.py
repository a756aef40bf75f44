"""Tokenising log lines, as Column expressions.

A line that opens with two or more segments closed by a pipe is split at its pipes; in any
other line bracketed and quoted stretches are tokens, and what lies between is split at
white space.  Where a quote opens before a bracket and closes within it, the leftmost
stretch wins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PIPED = r"^(?:[^|]+\|){2,}"
SPECIAL = r"""\[[^\]]+\]|["'][^"']*["']"""
GENERAL = rf"(?U){SPECIAL}|(?:(?!{SPECIAL})\S)+"
BRACKET, QUOTED, PIPE, WORD, NUMBER, PUNCTUATION = "bracket", "quoted", "pipe", "word", "number", "punctuation"
WHITESPACE = "whitespace"
MARKS = ",:;-"


def stripped(text: Column) -> Column:
    """Without white space at either end, in Unicode's sense."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def is_piped(line: Column) -> Column:
    return line.rlike(PIPED)


def _raw(line: Column) -> Column:
    return F.regexp_extract_all(line, F.lit(GENERAL), F.lit(0))


def _blank(line: Column) -> Column:
    return F.coalesce(~line.rlike(r"(?U)\S"), F.lit(True))


def parts(line: Column) -> Column:
    """What a line is split into: stripped segments, or tokens but white space.  Keep it as
    a column of its own, and ``fields_of`` and ``types_of`` share the work."""
    segments = F.transform(F.split(line, r"\|", -1), stripped)
    return F.when(_blank(line), F.array().cast("array<string>")).when(is_piped(line), segments).otherwise(_raw(line))


def token_type(token: Column) -> Column:
    """The kind of a token of a line without pipes."""
    first = F.substring(token, 1, 1)
    return (
        F.when((first == "[") & token.rlike(r"^\[[^\]]+\]$"), BRACKET)
        .when(first.isin('"', "'") & token.rlike(r"""^["'][^"']*["']$"""), QUOTED)
        .when(~first.between("A", "z") & token.rlike(r"(?U)^\d+(?:\.\d+)?$"), NUMBER)
        .when((F.length(token) <= len(MARKS)) & (F.instr(F.lit(MARKS), token) > 0), PUNCTUATION)
        .otherwise(WORD)
    )


def _bare(token: Column) -> Column:
    special = F.substring(token, 1, 1).isin("[", '"', "'") & token.rlike(rf"^(?:{SPECIAL})$")
    return F.when(special, F.substring(token, F.lit(2), F.length(token) - 2)).otherwise(token)


def fields_of(parts_: Column, piped: Column) -> Column:
    mark = lambda t: (F.length(t) <= len(MARKS)) & (F.instr(F.lit(MARKS), t) > 0)
    return F.when(piped, parts_).otherwise(F.transform(F.filter(parts_, lambda t: ~mark(t)), _bare))


def types_of(parts_: Column, piped: Column) -> Column:
    segment = F.flatten(F.transform(parts_, lambda t, i: F.when(i == 0, F.array(F.lit(WORD))).otherwise(F.array(F.lit(PIPE), F.lit(WORD)))))
    return F.when(piped, segment).otherwise(F.transform(parts_, token_type))


def fields(line: Column) -> Column:
    """The field values of a line: its tokens without white space, punctuation, pipes and
    delimiters."""
    return fields_of(parts(line), F.coalesce(is_piped(line), F.lit(False)))


def token_types(line: Column) -> Column:
    """The types of a line's tokens but white space, in order."""
    return types_of(parts(line), F.coalesce(is_piped(line), F.lit(False)))


def tokens(line: Column) -> Column:
    """All tokens with type, value and place: array of (type, value, start, end), white
    space included."""
    every = F.regexp_extract_all(line, F.lit(rf"(?U){SPECIAL}|\s+|(?:(?!{SPECIAL})\S)+"), F.lit(0))
    pieces = F.regexp_extract_all(line, F.lit(r"\||[^|]+|(?<=\|)(?=\|)|(?<=\|)$"), F.lit(0))
    kind = lambda t: F.when(t.rlike(r"(?U)^\s+$"), WHITESPACE).otherwise(token_type(t))
    piped = lambda t: F.when(t == "|", PIPE).otherwise(WORD)

    def placed(values: Column, kind, value) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<type:string,value:string,start:int,end:int>>").alias("out"))
        step = lambda acc, t: F.struct(
            (acc["at"] + F.length(t)).alias("at"),
            F.concat(acc["out"], F.array(F.struct(kind(t).alias("type"), value(t).alias("value"), acc["at"].alias("start"), (acc["at"] + F.length(t)).alias("end")))).alias("out"),
        )
        return F.aggregate(values, start, step, lambda acc: acc["out"])

    none = F.array().cast("array<struct<type:string,value:string,start:int,end:int>>")
    return F.when(_blank(line), none).when(is_piped(line), placed(pieces, piped, stripped)).otherwise(placed(every, kind, lambda t: t))


def words(line: Column) -> Column:
    """Split at white space alone, as the quality metrics do."""
    return F.filter(F.split(line, r"(?U)\s+"), lambda w: w != "")
