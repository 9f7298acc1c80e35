"""Numbering grammar: what a marker counts, and which marker may follow which."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NONE = "cast(array() as array<bigint>)"
_ROMAN = (("i", 1), ("v", 5), ("x", 10), ("l", 50), ("c", 100), ("d", 500), ("m", 1000))


def parse_roman(text: Column) -> Column:
    """Value of a Roman numeral, read from the right: what is below the largest digit
    seen is taken away. Any order of digits is read; null for other characters."""
    low = F.lower(text)
    value = F.create_map(*[F.lit(x) for pair in _ROMAN for x in pair])

    def step(acc: Column, c: Column) -> Column:
        v = F.element_at(value, c)
        return F.struct((acc["total"] + F.when(v < acc["top"], -v).otherwise(v)).alias("total"), F.greatest(acc["top"], v).alias("top"))

    zero = F.struct(F.lit(0).alias("total"), F.lit(0).alias("top"))
    return F.when(low.rlike("^[ivxlcdm]+$"), F.aggregate(F.split(F.reverse(low), ""), zero, step, lambda a: a["total"]))


def alpha_value(text: Column) -> Column:
    """1 for "a" to 26 for "z"; null unless one letter."""
    return F.when(text.rlike("^[A-Za-z]$"), F.ascii(F.lower(text)) - 96)


def _roman_or_int(token: Column) -> Column:
    return F.when(token.rlike(r"^\d+$"), token.try_cast("bigint")).otherwise(parse_roman(token).cast("bigint"))


def _path(value: Column) -> Column:
    return F.when(value > 0, F.array(value.cast("bigint"))).otherwise(F.expr(_NONE))


def parse_marker(family: Column, marker: Column) -> Column:
    """struct(path, alt): the number's parts, empty if it has none or one of them has
    more digits than 64 bits hold, and a second reading for single lower-case letters
    that are Roman numerals too."""
    token = F.element_at(F.split(marker, r"\s+"), -1)
    inner = F.regexp_extract(marker, r"\(([^)]*)\)", 1)
    numbers = F.transform(F.regexp_extract_all(marker, F.lit(r"\d+"), F.lit(0)), lambda d: d.try_cast("bigint"))
    dotted = F.regexp_extract(marker, r"^(?:[A-Za-z]+\s+|\()?(\d{1,18}(?:\.\d{1,18})*)\.?\)?$", 1)  # parts that 64 bits hold for sure
    digits = F.when(dotted != "", F.split(dotted, r"\.").cast("array<bigint>")).otherwise(F.when(F.exists(numbers, lambda d: d.isNull()), F.expr(_NONE)).otherwise(numbers))
    single = F.length(inner) == 1
    path = (
        F.when(family == "article", _path(_roman_or_int(token)))
        .when(family == "region", _path(F.coalesce(_roman_or_int(token), alpha_value(token))))
        .when(family.isin("section", "hier-decimal", "decimal"), digits)
        .when(family == "paren-num", F.slice(digits, 1, 1))
        .when(family == "paren-upper", F.when(single, _path(alpha_value(inner))).otherwise(F.expr(_NONE)))
        .when(family == "paren-lower", F.when(single, _path(alpha_value(inner))).otherwise(_path(parse_roman(inner))))
        .otherwise(F.expr(_NONE))
    )
    alt = F.when((family == "paren-lower") & single, _path(parse_roman(inner))).otherwise(F.expr(_NONE))
    return F.struct(path.alias("path"), alt.alias("alt"))


def readings(marker: Column) -> Column:
    return F.filter(F.array(marker["path"], marker["alt"]), lambda p: F.size(p) > 0)


def is_sibling_successor(a: Column, b: Column, max_skip: int = 0) -> Column:
    """Whether b may follow a on one level; readings may cross."""

    def follows(pa: Column, pb: Column) -> Column:
        n = F.size(pa)
        step = F.element_at(pb, -1) - F.element_at(pa, -1)
        return (F.size(pb) == n) & (F.slice(pa, 1, n - 1) == F.slice(pb, 1, n - 1)) & step.between(1, 1 + max_skip)

    return F.exists(readings(a), lambda pa: F.exists(readings(b), lambda pb: follows(pa, pb)))


def is_child_start(a: Column, b: Column) -> Column:
    """Whether b is a's number with a 1 behind it."""
    return F.exists(readings(a), lambda pa: F.exists(readings(b), lambda pb: pb == F.concat(pa, F.array(F.lit(1).cast("bigint")))))


def starts_sequence(a: Column) -> Column:
    return F.exists(readings(a), lambda p: F.element_at(p, -1) == 1)
