"""Bounds as callers give them: text of four numbers, or JSON of a list or of named sides."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SIDES = ("west", "south", "east", "north")


def _numbers(texts: Column) -> Column:
    """The texts as four doubles; null unless there are four and each is a number."""
    read = F.transform(texts, lambda x: F.trim(x).try_cast("double"))
    return F.when((F.size(texts) == 4) & ~F.exists(read, lambda x: x.isNull()), read)


def parse_bounds(text: Column) -> Column:
    """minx,miny,maxx,maxy as an array of doubles, with blanks around the numbers; null where it is refused or missing."""
    return _numbers(F.split(text, ",", -1))


def coerce_bounds(json: Column) -> Column:
    """Bounds given as JSON, a list of four or an object with four sides, as an array of doubles; null for all else.

    Numbers may stand in quotes; further members of an object are passed over.
    Null, true, false and nested values are no numbers.
    """
    listed = _numbers(F.from_json(json, "array<string>"))
    sides = F.from_json(json, ", ".join(f"{s} STRING" for s in SIDES))
    named = F.when(F.ltrim(json).startswith("{"), _numbers(F.array(*[sides[s] for s in SIDES])))
    return F.when(F.ltrim(json).startswith("["), listed).otherwise(named)


def status(asked: Column, bounds: Column) -> Column:
    """200 for bounds that were read or not asked for, else 400."""
    return F.when(asked.isNotNull() & bounds.isNull(), 400).otherwise(200)
