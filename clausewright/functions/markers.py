"""Clause markers: where numbered headings begin."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Marker families by priority.
FAMILIES = (
    ("article", r"(?i:ARTICLE\s+(?:[IVXLC]+|\d+))"),
    ("section", r"(?i:(?:Section|Clause)\s+\d+(?:\.\d+)*)"),
    ("region", r"(?i:(?:Schedule|Annex(?:ure)?|Exhibit|Appendix)\s+(?:[A-Z]+|\d+))"),
    ("hier-decimal", r"\d+(?:\.\d+)+\.?"),
    ("decimal", r"\d+\.(?=\s)"),
    ("paren-lower", r"\([a-z]{1,3}\)"),
    ("paren-upper", r"\([A-Z]{1,3}\)"),
    ("paren-num", r"\(\d+\)"),
)


# All families at one place, the first by priority; a first look passes over most places.
_ANY = "(?=[ACESaces][A-Za-z]|[0-9(])(?:" + "|".join(rx for _, rx in FAMILIES) + ")"
_HEAD = r"^\s*+(" + "|".join(rx for _, rx in FAMILIES) + ")"
#: Where families found independently and all families at one place can differ: an
#: article's or a region's number that goes on as a dotted one, which was found before.
_CUT = r"(?i)(?:ARTICLE|Schedule|Annex(?:ure)?|Exhibit|Appendix)\s+\d+\.\d+\.\d"
#: Marks that stand before and behind what one search finds.
_OPEN, _CLOSE = "\x01", "\x02"


def head_marker(text: Column) -> Column:
    """The marker at a block's first character that is no white space, "" if there is
    none: of the first family, by priority, that matches there."""
    return F.regexp_extract(text, _HEAD, 1)


def head_start(text: Column) -> Column:
    """Where a block's first character that is no white space stands."""
    return F.when(text.rlike(r"^\s"), F.length(F.regexp_extract(text, r"^\s+", 0))).otherwise(0)


def priority_of(marker: Column) -> Column:
    """A marker's family by its number; no marker fits two of them."""
    first = F.substring(marker, 1, 1)
    inside = F.substring(marker, 2, 1)
    return (
        F.when(first == "(", F.when(inside.between("a", "z"), 5).when(inside.between("A", "Z"), 6).otherwise(7))
        .when(first.between("0", "9"), F.when(marker.rlike(r"\.\d"), 3).otherwise(4))
        .when(marker.rlike("^(?i:ARTICLE)"), 0)
        .when(marker.rlike("^(?i:Section|Clause)"), 1)
        .otherwise(2)
    )


def block_start_marker(text: Column) -> Column:
    """struct(family, marker, start) of the marker at a block's first character that
    is no white space; null if there is none. It is the first family, by priority,
    that matches there, so no scan of the block is needed."""
    marker = head_marker(text)
    return F.when(marker != "", F.struct(family_name(priority_of(marker)).alias("family"), marker.alias("marker"), head_start(text).alias("start")))


def _matches(text: Column, order: int, rx: str) -> Column:
    found = F.regexp_extract_all(text, F.lit(rx), F.lit(0))
    each = F.arrays_zip(F.split(text, rx, -1).alias("gap"), found.alias("match"))
    none = F.expr("cast(array() as array<struct<start: int, priority: int, marker: string>>)")

    def step(acc: Column, x: Column) -> Column:
        start = acc["pos"] + F.length(x["gap"])
        hit = F.array(F.struct(start.alias("start"), F.lit(order).alias("priority"), x["match"].alias("marker")))
        end = start + F.coalesce(F.length(x["match"]), F.lit(0))
        return F.struct(end.alias("pos"), F.when(x["match"].isNotNull(), F.concat(acc["out"], hit)).otherwise(acc["out"]).alias("out"))

    folded = F.aggregate(each, F.struct(F.lit(0).alias("pos"), none.alias("out")), step, lambda a: a["out"])
    return F.when(F.size(found) > 0, folded).otherwise(none)


def _independent(text: Column) -> Column:
    """Families searched independently; by (start, priority), each is kept that starts
    no earlier than the last kept one ends."""
    found = F.array_sort(F.concat(*[_matches(text, i, rx) for i, (_, rx) in enumerate(FAMILIES)]))
    none = F.expr("cast(array() as array<struct<start: int, priority: int, marker: string>>)")

    def step(acc: Column, x: Column) -> Column:
        free = x["start"] >= acc["end"]
        return F.struct(
            F.when(free, x["start"] + F.length(x["marker"])).otherwise(acc["end"]).alias("end"),
            F.when(free, F.concat(acc["out"], F.array(x))).otherwise(acc["out"]).alias("out"),
        )

    return F.aggregate(found, F.struct(F.lit(0).alias("end"), none.alias("out")), step, lambda a: a["out"])


def _one_pass(text: Column) -> Column:
    """All families searched at once, in a text without marks: what each mark opens is a
    marker up to the next mark, and then text up to the next marker."""
    parts = F.split(F.regexp_replace(text, f"({_ANY})", f"{_OPEN}$1{_CLOSE}"), _OPEN, -1)
    none = F.expr("cast(array() as array<struct<start: int, priority: int, marker: string>>)")

    def step(acc: Column, part: Column) -> Column:
        marker = F.substring_index(part, _CLOSE, 1)
        hit = F.array(F.struct(acc["pos"].alias("start"), priority_of(marker).alias("priority"), marker.alias("marker")))
        first = acc["pos"] < 0
        return F.struct(F.when(first, F.length(part)).otherwise(acc["pos"] + F.length(part) - 1).alias("pos"), F.when(first, acc["out"]).otherwise(F.concat(acc["out"], hit)).alias("out"))

    return F.aggregate(parts, F.struct(F.lit(-1).alias("pos"), none.alias("out")), step, lambda a: a["out"])


def scan(text: Column) -> Column:
    """All markers of a text as array of struct(start, priority, marker): families are
    searched independently; by (start, priority), each is kept that starts no earlier
    than the last kept one ends. One search for all of them finds the same, except
    behind a number that _CUT names; its marks must not be in the text."""
    odd = (text.rlike(r"\d\.\d+\.\d") & text.rlike(_CUT)) | F.contains(text, F.lit(_OPEN)) | F.contains(text, F.lit(_CLOSE))
    return F.when(odd, _independent(text)).when(text.isNotNull(), _one_pass(text))


def family_name(priority: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n, _ in FAMILIES]), priority + 1)
