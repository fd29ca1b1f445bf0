"""Column builders for text normal forms, coercion, comparison and value search. JVM-side expressions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that page search ignores (fixed values).
STOP_WORDS = "a an and are as at be by for from has have in is it its of on or that the to was were will with this these those which".split()
#: Patterns of typed values (fixed values).
VALUE_PATTERNS = {
    "date": r"(\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{1,2}\s+[A-Za-z]{3,9}\s+\d{4})",
    "currency": r"(-?[$€£¥]?\s?[\d,]+\.\d{2}|-?[$€£¥]\s?[\d,]+)",
    "integer": r"(-?\d[\d,]*)",
    "number": r"(-?\d[\d,]*(?:\.\d+)?)",
}
SYMBOLED = r"(-?[$€£¥]\s?[\d,]+(?:\.\d{2})?)"
#: What a typed text must look like as a whole (fixed values).
WHOLE_PATTERNS = {
    "date": [r"^\d{4}-\d{2}-\d{2}$", r"^\d{2}/\d{2}/\d{4}$", r"^\d{1,2}\s+[A-Za-z]{3,9}\s+\d{4}$"],
    "currency": [r"^-?[$€£¥]?\s?[\d,]+(?:\.\d{1,2})?$"],
}
#: Date formats in the order in which they are tried: month first before day first.
DATE_FORMATS = ("yyyy-M-d", "M/d/yyyy", "d/M/yyyy", "d MMMM yyyy", "d MMM yyyy", "MMMM d, yyyy")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_empty(c: Column | str) -> Column:
    """Of a text: null or ''. 0 and false are not empty."""
    return col(c).isNull() | (col(c) == "")


def tokens(c: Column | str) -> Column:
    words = F.regexp_extract_all(F.lower(F.coalesce(col(c), F.lit(""))), F.lit("[a-z0-9]+"), 0)
    return F.filter(words, lambda w: ~w.isin(STOP_WORDS))


def normal(c: Column | str) -> Column:
    """Lower case, white space of any kind (no-break spaces too) as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(col(c)), r"(?U)\s+", " "))


def words_of(c: Column | str) -> Column:
    """The different runs of [a-z0-9] in normal form."""
    return F.array_distinct(F.regexp_extract_all(normal(c), F.lit("[a-z0-9]+"), F.lit(0)))


def key_form(c: Column | str, numeric: bool = False) -> Column:
    """What merging compares: texts in normal form; numbers as text, whole ones without a fraction."""
    if not numeric:
        return normal(c)
    number = col(c).cast("double")
    return F.when(number == F.floor(number), F.floor(number).cast("string")).otherwise(number.cast("string"))


def coerce(c: Column | str, kind: str, allowed: list[str] | None = None) -> Column:
    """The typed value as text (canonical), null where it doesn't fit."""
    text = F.trim(col(c).cast("string"))
    text = F.when(text != "", text)
    plain = F.regexp_replace(text, ",", "")
    if kind == "integer":
        return plain.try_cast("bigint").cast("string")
    if kind == "number":
        return plain.try_cast("double").cast("string")
    if kind == "boolean":
        low = F.lower(text)
        return F.when(low.isin("true", "yes", "y", "1"), "true").when(low.isin("false", "no", "n", "0"), "false")
    if kind in WHOLE_PATTERNS:
        fits = reduce(lambda a, b: a | b, (text.rlike(p) for p in WHOLE_PATTERNS[kind]))
        return F.when(fits, text)
    if kind == "enum":
        return F.coalesce(*(F.when(F.lower(text) == a.lower(), a) for a in allowed or []), F.lit(None).cast("string"))
    return text


def date_form(c: Column | str) -> Column:
    text = F.trim(col(c))
    return F.coalesce(*(F.try_to_timestamp(text, F.lit(f)).cast("date") for f in DATE_FORMATS))


def money_form(c: Column | str) -> Column:
    digits = F.regexp_replace(col(c), r"[^\d.\-]", "")
    return F.round(F.when(digits != "", digits).try_cast("double"), 2)


def values_match(a: Column | str, b: Column | str, kind: str) -> Column:
    """Null equals null; else by normal form; what can't be read never equals."""
    a, b = col(a), col(b)
    if kind == "date":
        same = date_form(a) == date_form(b)
    elif kind == "currency":
        same = money_form(a) == money_form(b)
    elif kind in ("number", "integer"):
        same = F.abs(F.regexp_replace(a, ",", "").try_cast("double") - F.regexp_replace(b, ",", "").try_cast("double")) < 1e-6
    else:
        same = normal(a) == normal(b)
    return F.when(a.isNull() & b.isNull(), True).when(a.isNull() | b.isNull(), False).otherwise(F.coalesce(same, F.lit(False)))


def keyword_at(c: Column | str, keyword: str) -> Column:
    """Place (from 1) of the first hit with no letter on either side, 0 for none."""
    return F.regexp_instr(col(c), F.lit(rf"(?i)(?<![A-Za-z])\Q{keyword}\E(?![A-Za-z])"))


def value_after(c: Column | str, keyword: str, kind: str = "string", allowed: list[str] | None = None) -> Column:
    """The value that follows a keyword on its line, typed; null for none."""
    at = keyword_at(c, keyword)
    rest = F.regexp_replace(F.substr(col(c), at + len(keyword)), r"^[ :\t#.\-]+", "")
    tail = F.when((at > 0) & (rest != ""), rest)
    return typed_value(tail, kind, allowed)


def typed_value(tail: Column, kind: str, allowed: list[str] | None = None) -> Column:
    """The value at or near the beginning of what follows a keyword; null for none."""
    found = lambda pattern: F.nullif(F.trim(F.regexp_extract(tail, pattern, 1)), F.lit(""))
    if kind == "currency":
        return F.coalesce(found(SYMBOLED), found(VALUE_PATTERNS[kind]))
    if kind in VALUE_PATTERNS:
        return found(VALUE_PATTERNS[kind])
    if kind == "enum":
        return F.coalesce(*(F.when(tail.rlike(rf"(?i)\b\Q{a}\E\b"), a) for a in allowed or []), F.lit(None).cast("string"))
    if kind == "boolean":
        low = F.lower(tail)
        has = lambda *w: reduce(lambda a, b: a | b, (low.contains(x) for x in w))
        return F.when(has("yes", "true", "shall automatically"), "true").when(has("no", "false", "shall not"), "false")
    return F.nullif(F.substring(F.trim(F.split(tail, "  ")[0]), 1, 200), F.lit(""))


def split_row(c: Column | str, columns: list[tuple[str, str]]) -> Column:
    """A printed table row as a map of column to value: cells parted by two or more blanks, tabs or bars.

    Fewer than two cells, or nothing but column names: null. A typed cell that doesn't fit leaves its column out.
    For many rows see split_rows(), which takes each line apart once.
    """
    parts = row_parts(c)
    return row_map([row_value(parts, i, kind) for i, (_, kind) in enumerate(columns)], row_cells(parts), columns)


def split_rows(df: DataFrame, line: Column, columns: list[tuple[str, str]], to: str = "cells") -> DataFrame:
    """df with split_row() of a line as a further column, without the rows where that is null.

    Each step is a projection of its own and all of them compiled code: the line is split once, each cell read once.
    A filter on the map would be pushed below the steps and repeat them, so the map is unpacked from a list of one or none.
    """
    kept, names = df.columns, [f"_v{i}" for i in range(len(columns))]
    x = df.select(*kept, row_parts(line).alias("_parts"))
    x = x.select(*kept, row_cells(F.col("_parts")).alias("_cells"), *(row_value(F.col("_parts"), i, kind).alias(n) for i, (n, (_, kind)) in enumerate(zip(names, columns, strict=True))))
    x = x.select(*kept, row_map([F.col(n) for n in names], F.col("_cells"), columns).alias("_map"))
    return x.select(*kept, F.explode(F.when(F.col("_map").isNotNull(), F.array("_map"))).alias(to))


#: Runs of separators, so that no empty piece stands between two.
_PARTED = r"(?:\s{2,}|\t|\s*\|\s*)+"


def row_parts(c: Column | str) -> Column:
    """The pieces of a line; only the first and the last can be empty."""
    return F.split(col(c), _PARTED)


def _blank_first(parts: Column) -> Column:
    return (F.trim(F.get(parts, F.lit(0))) == "").cast("int")


def row_cells(parts: Column) -> Column:
    """How many cells aren't empty."""
    n = F.size(parts)
    return n - _blank_first(parts) - F.when((n > 1) & (F.trim(F.get(parts, n - 1)) == ""), 1).otherwise(0)


def row_value(parts: Column, i: int, kind: str) -> Column:
    """The i-th cell (from 0), typed; null where there is none or it doesn't fit."""
    cell = F.nullif(F.trim(F.get(parts, _blank_first(parts) + i)), F.lit(""))
    return F.nullif(F.regexp_extract(cell, VALUE_PATTERNS[kind], 1), F.lit("")) if kind in VALUE_PATTERNS else cell


def row_map(values: list[Column], cells: Column, columns: list[tuple[str, str]]) -> Column:
    names = [n.replace("_", " ").lower() for n, _ in columns]
    data = reduce(lambda a, b: a | b, (F.coalesce(~F.lower(v).isin(names), F.lit(False)) for v in values))
    entries = F.array(*(F.when(v.isNotNull(), F.struct(F.lit(n).alias("key"), v.alias("value"))) for v, (n, _) in zip(values, columns, strict=True)))
    return F.when((cells >= 2) & data, F.map_from_entries(F.array_compact(entries)))


def cite(page: Column | str, block: Column | str) -> Column:
    return F.concat(F.lit("p"), col(page).cast("string"), F.when(~is_empty(block), F.concat(F.lit(":"), col(block))).otherwise(""))


def token_estimate(n_chars: Column | str, images: Column | str | None = None) -> Column:
    tokens = F.floor(col(n_chars) / 4).cast("long")
    return tokens if images is None else tokens + col(images) * 300
