"""Colour columns: parsing, distance, luminance, saturation."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def let(value: Column, fn) -> Column:
    """``fn(value)`` with ``value`` computed once, however often ``fn`` uses it."""
    return F.transform(F.array(value), fn)[0]


def _hex(text: Column, at: int) -> Column:
    return F.conv(F.substring(text, at, 2), 16, 10).cast("int")


def _made(r: Column, g: Column, b: Column, al: Column) -> Column:
    return F.struct(r.alias("r"), g.alias("g"), b.alias("b"), al.alias("al"))


RGB = r"(?i)^rgba?\(\s*(\d+)[,\s]+(\d+)[,\s]+(\d+)(?:\s*[,/]\s*([\d.]+))?\s*\)"


def parse(value: Column) -> Column:
    """``#rgb``, ``#rrggbb``, ``#rrggbbaa`` or ``rgb()/rgba()`` → struct(r, g, b, al) with alpha in 0–255; else null."""
    v = F.trim(value)
    body = F.upper(F.regexp_extract(v, "(?i)^#([0-9a-f]+)$", 1))
    wide = let(body, lambda x: F.when(F.length(x).isin(3, 4), F.regexp_replace(x, "(.)", "$1$1")).otherwise(x))
    from_hex = let(wide, lambda w: F.when(
        F.length(w).isin(6, 8), _made(_hex(w, 1), _hex(w, 3), _hex(w, 5), F.when(F.length(w) == 8, _hex(w, 7)).otherwise(255))
    ))
    part = lambda i: F.regexp_extract(v, RGB, i)
    alpha = F.when(part(4) == "", 255).otherwise(F.round(part(4).try_cast("double") * 255).cast("int"))
    from_rgb = F.when(v.rlike(RGB), _made(part(1).cast("int"), part(2).cast("int"), part(3).cast("int"), alpha))
    return F.coalesce(from_hex, from_rgb)


def rgb_distance(a, b) -> Column:
    return F.abs(a["r"] - b["r"]) + F.abs(a["g"] - b["g"]) + F.abs(a["b"] - b["b"])


def distance(a, b) -> Column:
    """Manhattan distance of the channels plus that of alpha: a wash is never near its opaque colour."""
    return rgb_distance(a, b) + F.abs(a["al"] - b["al"])


def luminance(c) -> Column:
    return (F.lit(0.2126) * c["r"] + F.lit(0.7152) * c["g"] + F.lit(0.0722) * c["b"]) / 255


def saturation(c) -> Column:
    hi, lo = F.greatest(c["r"], c["g"], c["b"]), F.least(c["r"], c["g"], c["b"])
    return F.when(hi == 0, F.lit(0.0)).otherwise((hi - lo) / F.greatest(hi, F.lit(1)))
