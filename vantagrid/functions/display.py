"""Names, paths and colours of what a scene shows, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that file names may not have, names that devices own, and the stops of the colour ramp.
ILLEGAL = '<>:"/\\|?*'
RESERVED = ["CON", "PRN", "AUX", "NUL", "COM1", "COM2", "COM3", "COM4", "COM5", "COM6", "COM7", "COM8", "COM9", "LPT1", "LPT2", "LPT3", "LPT4", "LPT5", "LPT6", "LPT7", "LPT8", "LPT9"]
STOPS = [(0.19, 0.07, 0.23), (0.16, 0.40, 0.85), (0.14, 0.65, 0.86), (0.17, 0.82, 0.56), (0.52, 0.86, 0.27), (0.86, 0.80, 0.20), (0.97, 0.55, 0.17), (0.62, 0.09, 0.06)]


def safe_asset_path(path: Column) -> Column:
    """Whether a path stays inside of its folder: relative, with forward slashes and plain segments only. Null is unsafe."""
    plain = ~F.exists(F.split(path, "/"), lambda s: s.isin("", ".", ".."))
    return F.coalesce(plain & ~F.contains(path, F.lit("\\")) & ~path.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), F.lit(False))


def label(name: Column, entity_id: Column, prefix: str, kind: str) -> Column:
    """The trimmed name; where it is blank or null, the kind with the id's number, or the id."""
    number = F.regexp_extract(entity_id, f"^{prefix}-([0-9]+)$", 1)
    return F.coalesce(F.nullif(F.trim(name), F.lit("")), F.when(number != "", F.concat(F.lit(f"{kind} "), number)).otherwise(entity_id))


def file_stem(text: Column) -> Column:
    """What of a label a file may be called; empty where nothing is left."""
    illegal = "[\\x00-\\x1F\\x7F\\s\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF" + "".join("\\" + c for c in ILLEGAL) + "]"
    stem = F.regexp_replace(F.regexp_replace(text, illegal, "-"), "-{2,}", "-")
    stem = F.regexp_replace(F.regexp_replace(stem, "^[-.]+", ""), "[-.]+$", "")
    return F.when(F.upper(stem).isin(RESERVED), F.concat(F.lit("_"), stem)).otherwise(stem)


def _held(t: Column) -> Column:
    return F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))


def ramp(t: Column) -> list[Column]:
    """Red, green and blue of a share between 0 and 1, by straight lines between the stops."""
    x = _held(t) * (len(STOPS) - 1)
    below = F.least(F.floor(x), F.lit(len(STOPS) - 2)).cast("int")
    stops = [F.array(*(F.lit(s[c]) for s in STOPS)) for c in range(3)]
    return [F.get(s, below) + (F.get(s, below + 1) - F.get(s, below)) * (x - below) for s in stops]


def hue(degrees: Column) -> list[Column]:
    """Red, green and blue of a full colour by its angle: each is a trapezium around its own angle."""
    out = []
    for own in (0, 120, 240):
        away = F.abs(F.pmod(degrees - own + 180, F.lit(360.0)) - 180)
        out.append(_held(2 - away / 60))
    return out


def coverage_share(count: Column, cameras: Column) -> Column:
    """The share of the cameras in question that see a place."""
    return _held(count / F.greatest(cameras, F.lit(1)).cast("double"))


def overlay(count: Column, cameras: Column, blind_only: Column) -> tuple[Column, Column]:
    """Whether a place is drawn, and how strongly: by its share, or where only blind spots are asked for, those alone."""
    return ~blind_only | (count == 0), F.when(blind_only, (count == 0).cast("double")).otherwise(coverage_share(count, cameras))
