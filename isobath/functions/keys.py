"""Keys, codes, limits and other small texts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Seconds of a limit's period. Fixed values.
PERIODS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}
#: Bits of a sample type; other types count as 8. Fixed values.
BIT_DEPTHS = {"uint8": 8, "int8": 8, "uint16": 16, "int16": 16, "uint32": 32, "int32": 32, "float32": 32, "float64": 64}
#: Banner colours of a marking, the first that it contains. Fixed values.
MARKINGS = [("TOP SECRET", "255,140,0"), ("SECRET", "239,68,68"), ("CONFIDENTIAL", "59,130,246"), ("RESTRICTED", "234,179,8")]
UNMARKED = "34,197,94"


def lookup(values: dict, key: Column) -> Column:
    return F.element_at(F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(v))]), key)


def coordinates(*bounds: Column) -> Column:
    """Bounds rounded to five decimals, comma-joined, as keys hold them."""
    return F.concat_ws(",", *[F.round(b, 5).cast("string") for b in bounds])


def result_key(bounds: list[Column], start: Column, end: Column, model: Column, version: Column) -> Column:
    """The key under which a survey of these bounds, days and model is found again; cloud cover is no part of it."""
    return F.sha1(F.concat_ws("|", coordinates(*bounds), start, end, model, F.coalesce(version, F.lit(""))))


def scene_key(bounds: list[Column], start: Column, end: Column, cloud: Column, pixels: Column) -> Column:
    return F.concat(F.lit("s2_"), F.substring(F.sha1(F.concat_ws("|", coordinates(*bounds), start, end, cloud, pixels)), 1, 24))


def report_code(key: Column, prefix: str = "RPT-") -> Column:
    """Eight hexadecimal digits in upper case, derived from a key so that a rerun gives the same code."""
    return F.concat(F.lit(prefix), F.upper(F.substring(F.md5(key), 1, 8)))


def weak_etag(total: Column, latest: Column, offset: Column, limit: Column) -> Column:
    return F.concat(F.lit('W/"'), F.concat_ws("-", total, F.coalesce(latest, F.lit("")), offset, limit), F.lit('"'))


def first_hop(forwarded: Column, peer: Column) -> Column:
    """The client: the first hop of a forwarding header if there is one, else the peer, else unknown."""
    return F.coalesce(F.when(forwarded != "", F.trim(F.split_part(forwarded, F.lit(","), F.lit(1)))), peer, F.lit("unknown"))


def parse_limit(spec: Column) -> Column:
    """(count, seconds) of a limit such as 5/minute; 5 a minute where the count is no number, 60 seconds for an unknown period."""
    count = F.trim(F.split_part(spec, F.lit("/"), F.lit(1))).try_cast("int")
    seconds = F.coalesce(lookup(PERIODS, F.lower(F.trim(F.split_part(spec, F.lit("/"), F.lit(2))))), F.lit(60))
    return F.struct(F.coalesce(count, F.lit(5)).alias("count"), F.when(count.isNull(), 60).otherwise(seconds).alias("seconds"))


def byte_range(header: Column, size: Column) -> Column:
    """(status, start, end) of a range request: 200 without a header, 206 with a good range, 416 beyond the file or for no numbers."""
    spec = F.trim(F.replace(header, F.lit("bytes="), F.lit("")))
    good = spec.rlike("^[0-9]*-[0-9]*$|^[0-9]+$")
    first, last = (F.split_part(spec, F.lit("-"), F.lit(i)) for i in (1, 2))
    start = F.when(first == "", F.lit(0)).otherwise(first.try_cast("bigint"))
    end = F.when(F.coalesce(last, F.lit("")) == "", size - 1).otherwise(last.try_cast("bigint"))
    status = F.when(header.isNull(), 200).when(~good | (start >= size) | (end >= size), 416).otherwise(206)
    return F.struct(status.alias("status"), F.when(status == 206, start).alias("start"), F.when(status == 206, end).alias("end"))


def bit_depth(dtype: Column) -> Column:
    return F.coalesce(lookup(BIT_DEPTHS, dtype), F.lit(8))


def marking_colour(text: Column) -> Column:
    out = F.lit(UNMARKED)
    for name, colour in reversed(MARKINGS):
        out = F.when(F.contains(F.upper(text), F.lit(name)), colour).otherwise(out)
    return out


def iso_time(text: Column) -> Column:
    """A timestamp in UTC of ISO text with an offset or Z; null where it is none."""
    return F.try_to_timestamp(F.regexp_replace(text, "Z$", "+00:00"))


def day_and_time(day: Column, time: Column) -> Column:
    """dayTtime where both are given, else the day."""
    return F.when(day.isNotNull() & time.isNotNull(), F.concat_ws("T", day, time)).otherwise(day)


def levels(width: Column, height: Column, steps: Column) -> Column:
    """(level, width, height, scale) of each resolution level; 5 steps where none are named."""
    steps = F.when(F.coalesce(steps, F.lit(0)) == 0, 5).otherwise(steps)

    def at(i: Column) -> Column:
        by = F.pow(F.lit(2.0), i)
        side = [F.greatest(F.lit(1), F.floor(x / by)).cast("long") for x in (width, height)]
        return F.struct(i.alias("level"), side[0].alias("width"), side[1].alias("height"), (1 / by).alias("scale"))

    return F.transform(F.sequence(F.lit(0), steps), at)


def level_count(width: Column, height: Column) -> Column:
    """Decomposition levels of a wavelet code: log2 of the smaller side over 64, between 1 and 12."""
    return F.greatest(F.lit(1), F.least(F.lit(12), F.log2(F.least(width, height) / 64).cast("int")))


def finite(x: Column) -> Column:
    """x, or null where it is not a number or infinite."""
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")), x)
