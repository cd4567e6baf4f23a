"""Scalar formulas of the domain as Column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumewalk.functions.geo import col

# The fifteen route labels, one per 10000 of the summed signal.
ROUTE_LABELS = ["A", "AB", "B", "BC", "C", "CD", "D", "DE", "E", "EF", "F", "FG", "G", "GH", "H"]
STATIC_LABELS = ["A", "B", "C", "D", "E", "F", "G", "H"]
SIGNAL_STEP = 10000


def location_label(code) -> Column:
    """Label of a running signal code; a code off the list keeps its number as text."""
    c = col(code).cast("long")
    known = (c % SIGNAL_STEP == 0) & (c >= 0) & (c < SIGNAL_STEP * len(ROUTE_LABELS))
    slot = F.when(known, F.floor(c / SIGNAL_STEP).cast("int") + 1).otherwise(1)
    return F.when(known, F.element_at(F.array(*map(F.lit, ROUTE_LABELS)), slot)).otherwise(c.cast("string"))


def regime(location) -> Column:
    return F.when(col(location).isin(STATIC_LABELS), "static").otherwise("dynamic")


def sensor_codes_to_null(value) -> Column:
    """777 and 7777 mean no reading above zero; 888, 8888 and -999 mean no reading."""
    v = col(value)
    return F.when(v.isin(777.0, 7777.0), 0.0).when(v.isin(888.0, 8888.0, -999.0), None).otherwise(v)


def minute_ventilation(hr, fb, age, sex, fvc) -> Column:
    """Litres of air per minute / 1000 from heart rate, breathing rate, age, sex and lung capacity."""
    code = F.when(col(sex) == "M", 1.0).otherwise(2.0)
    return (
        F.exp(F.lit(-8.75))
        * F.pow(col(hr), F.lit(1.72))
        * F.pow(col(fb), F.lit(0.611))
        * F.pow(col(age), F.lit(0.298))
        * F.pow(code, F.lit(-0.206))
        * F.pow(col(fvc), F.lit(0.614))
        / 1000.0
    )


def feature_similarity(a, b, circular: Column | bool = False) -> Column:
    a, b = col(a), col(b)
    d = F.abs(a - b)
    around = F.greatest(F.lit(0.0), 1 - F.least(d, 360.0 - d) / 180.0)
    scale = F.greatest(F.abs(a), F.abs(b), F.lit(1e-8))
    plain = F.when(a == b, 1.0).otherwise(1 - F.least(d / scale, F.lit(1.0)))
    flag = F.lit(circular) if isinstance(circular, bool) else circular
    return F.when(flag, around).otherwise(plain)


#: Letters and signs without an ASCII decomposition, and what stands for them in a name; fixed values.
SPELLED_OUT = {"°": "deg", "ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "þ": "th", "Þ": "Th", "€": "EUR", "ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ł": "l", "Ł": "L", "ð": "d", "Ð": "D", "ı": "i", "×": "x", "µ": "u", "μ": "u"}


def _folded() -> dict[str, str]:
    """Latin letters and signs whose compatibility decomposition is one ASCII character and marks."""
    out = {}
    for c in map(chr, (*range(0xA0, 0x250), *range(0x1E00, 0x1F00), *range(0x2070, 0x20A0))):
        plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if len(plain) == 1 and plain.isascii():
            out[c] = plain
    return out


def plain_name(text) -> Column:
    """Lower-case ASCII name with underscores, usable as a column name: accents are folded, a few signs spelled out, other characters dropped."""
    one = _folded() | {c: v for c, v in SPELLED_OUT.items() if len(v) == 1}
    out = F.translate(F.trim(col(text)), "".join(one), "".join(one.values()))
    for c, v in SPELLED_OUT.items():
        if len(v) > 1:
            out = F.replace(out, F.lit(c), F.lit(v))
    return F.lower(F.replace(F.regexp_replace(out, r"[^\x00-\x7F]", ""), F.lit(" "), F.lit("_")))


def half_open_bin(value, start: float, width, bins: int) -> Column:
    """0-based bin of [start, start + bins*width); outside it, null. The last edge belongs to no bin."""
    width = F.lit(width) if isinstance(width, (int, float)) else width
    k = F.floor((col(value) - F.lit(start)) / width)
    return F.when((k >= 0) & (k < bins), k.cast("int"))


def sequence_id(subject, variable) -> Column:
    return F.concat(F.lit("S"), col(subject).cast("string"), col(variable))


def clip(value, low, high) -> Column:
    low = F.lit(low) if not isinstance(low, Column) else low
    high = F.lit(high) if not isinstance(high, Column) else high
    return F.least(F.greatest(col(value), low), high)


def finite(value) -> Column:
    """The value, or null when it is null, NaN or infinite."""
    v = col(value)
    return F.when(~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), v)


def valid_profile(age="age", sex="sex", height="height", fb="fb", hr="hr") -> Column:
    return F.coalesce(
        col(age).between(18, 100)
        & col(sex).isin("M", "F")
        & col(height).between(140, 220)
        & col(fb).between(15, 30)
        & col(hr).between(80, 150),
        F.lit(False),
    )


def category_match(columns: str | Sequence[str] | None, values) -> Column:
    """OR across columns, IN within one.

    A flat value list is used for every column, a nested one is matched column
    by column; an empty list inside a nested one matches nothing. Without
    columns or values every row matches.
    """
    if not columns or values is None:
        return F.lit(True)
    names = [columns] if isinstance(columns, str) else list(columns)
    vals = values if isinstance(values, (list, tuple)) else [values]
    nested = bool(vals) and isinstance(vals[0], (list, tuple))
    per_column = vals if nested else [vals] * len(names)
    match = F.lit(False)
    for name, allowed in zip(names, per_column):
        allowed = allowed if isinstance(allowed, (list, tuple)) else [allowed]
        if allowed:
            match = match | F.coalesce(F.col(name).isin(list(allowed)), F.lit(False))
    return match


def yeo_johnson(value, lam: float) -> Column:
    v = col(value)
    up = F.log1p(v) if abs(lam) < 1e-12 else (F.pow(v + 1, F.lit(lam)) - 1) / lam
    down = -F.log1p(-v) if abs(lam - 2) < 1e-12 else -(F.pow(1 - v, F.lit(2 - lam)) - 1) / (2 - lam)
    return F.when(v >= 0, up).otherwise(down)


def overfit_band(holdout, development) -> tuple[Column, Column]:
    """Ratio of holdout to development error and its band at 10 % and 25 %."""
    ratio = F.try_divide(col(holdout), col(development))
    band = F.when(ratio >= 1.25, "high").when(ratio >= 1.10, "moderate").otherwise("low")
    return ratio, band
