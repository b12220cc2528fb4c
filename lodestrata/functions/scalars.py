"""Column functions that parse, coerce and label values. A value that can't be parsed is null unless said otherwise."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that mean true and false (fixed values).
TRUE_WORDS = ("true", "yes", "on", "1")
FALSE_WORDS = ("false", "no", "off", "0")


def col(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def short_name(n: int) -> str:
    """A place as letters in base 26: a, b, ..., z, ba, bb."""
    out = ""
    while True:
        n, digit = divmod(n, 26)
        out = chr(97 + digit) + out
        if not n:
            return out


def finite(c: Column) -> Column:
    """NaN and infinities become null."""
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def parse_number(c: Column) -> Column:
    """A double; NaN counts as unparsed."""
    d = F.trim(c.cast("string")).try_cast("double")
    return F.when(~F.isnan(d), d)


def whole(d: Column) -> Column:
    """A double as a long where it has no fraction."""
    return F.when(d == F.floor(d), d.try_cast("bigint"))


def truncated(d: Column) -> Column:
    return F.when(d < 0, F.ceil(d)).otherwise(F.floor(d)).try_cast("bigint")


def strip_number(c: Column) -> Column:
    """A number, else the number that is left without everything but digits and periods."""
    return F.coalesce(parse_number(c), parse_number(F.regexp_replace(c.cast("string"), r"[^\d\.]", "")))


def strip_int(c: Column) -> Column:
    return strip_number(c).try_cast("bigint")


def digits_and_period(c: Column) -> Column:
    """Only what is left without everything but digits and periods: signs are lost."""
    return parse_number(F.regexp_replace(c.cast("string"), r"[^\d\.]", ""))


def parse_bool_word(c: Column) -> Column:
    word = F.lower(F.trim(c.cast("string")))
    return F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False)


def bool_from_number(c: Column) -> Column:
    return parse_number(c) != 0


def _slashed(text: Column) -> Column:
    """Text that can be a date with slashes. A failed parse costs an exception, which what has another shape is spared."""
    return F.when(text.rlike(r"^[-+0-9]+/[-+0-9]+/[-+0-9]+$"), text)


def parse_us_date(c: Column) -> Column:
    return F.try_to_timestamp(_slashed(F.trim(c.cast("string"))), F.lit("M/d/yyyy"))


def parse_euro_date(c: Column) -> Column:
    return F.try_to_timestamp(_slashed(F.trim(c.cast("string"))), F.lit("d/M/yyyy"))


def parse_datetime(c: Column) -> Column:
    text = F.trim(c.cast("string"))
    timed = F.when(text.rlike(r"^[-+0-9]+/[-+0-9]+/[-+0-9]+ [-+0-9]+:[-+0-9]+:[-+0-9]+$"), text)
    return F.coalesce(F.try_to_timestamp(text), F.try_to_timestamp(_slashed(text), F.lit("M/d/yyyy")), F.try_to_timestamp(timed, F.lit("M/d/yyyy H:m:s")))


def strict_datetime(c: Column) -> Column:
    """Fails on a value that is no time."""
    return F.to_timestamp(c)


def to_text(c: Column) -> Column:
    return F.nullif(c.cast("string"), F.lit(""))


def as_text(c: Column, kind) -> Column:
    """Nested and odd values as text: JSON, hexadecimal or the plain cast."""
    from lodestrata.functions import types

    if types.is_nested(kind):
        return F.to_json(c)
    return F.hex(c) if kind.typeName() == "binary" else c.cast("string")


def int_digits(c: Column) -> Column:
    """Characters of the whole part, sign included; 1 for null."""
    return F.coalesce(F.length(truncated(c.cast("double")).cast("string")), F.lit(1))


def round_half_even(c: Column) -> Column:
    return F.bround(c, 0)


#: Decimals of a label at most, with a suffix and without (fixed values).
MOST_DECIMALS = (2, 6)


def number_label(value: Column, step: Column | float, ref: Column | float | None = None) -> Column:
    """A number with the suffix that its reference size asks for (K, M, B, T), and as many decimals as tell steps apart, two behind a suffix at most. What is next to nothing beside a step is 0."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(float(x))
    step, size = lit(step), F.abs(lit(ref) if ref is not None else value)
    scale = reduce(lambda a, b: a.when(size >= b, F.lit(float(b))), (1e9, 1e6, 1e3), F.when(size >= 1e12, F.lit(1e12))).otherwise(F.lit(1.0))
    snapped = F.when((step > 0) & (F.abs(value) < step * 1e-9), 0.0).otherwise(value)
    # each part is named once and used often: written out, the expression would be too large to compile
    return _named({"value": snapped / scale, "step": step / scale, "scale": scale}, _label)


def _named(parts: dict[str, Column], make) -> Column:
    return F.transform(F.array(F.struct(*[v.alias(k) for k, v in parts.items()])), make)[0]


def _label(of: Column) -> Column:
    plain = of["scale"] == 1
    apart = F.when(of["step"] > 0, (1 - F.floor(F.log10(of["step"]))).cast("int")).otherwise(F.when(plain, 0).otherwise(1))
    places = F.greatest(F.lit(0), F.least(F.when(plain, MOST_DECIMALS[1]).otherwise(MOST_DECIMALS[0]), apart))
    shown = reduce(lambda a, n: a.when(places == n, F.format_string(f"%.{n}f", of["value"])), range(1, 7), F.when(places == 0, F.format_string("%.0f", of["value"])))
    trimmed = F.when(shown.contains("."), F.regexp_replace(F.regexp_replace(shown, "0+$", ""), r"\.$", "")).otherwise(shown)
    suffix = F.when(of["scale"] == 1e12, "T").when(of["scale"] == 1e9, "B").when(of["scale"] == 1e6, "M").when(of["scale"] == 1e3, "K").otherwise("")
    return F.concat(F.when(trimmed == "-0", "0").otherwise(trimmed), suffix)


def _bounds_label(lo: Column, hi: Column) -> Column:
    """Two labels with a dash, or <> where one is negative and its sign would look like the dash."""
    return F.concat(lo, F.when(lo.startswith("-") | hi.startswith("-"), "<>").otherwise("–"), hi)


def bucket_label(lo: Column, hi: Column, step: Column | None = None, ref: Column | None = None) -> Column:
    """lo–hi; both bounds share the suffix of `ref`, by default the larger one's size, as all buckets of a histogram do."""
    step, ref = hi - lo if step is None else step, F.greatest(F.abs(lo), F.abs(hi)) if ref is None else ref
    return _bounds_label(number_label(lo, step, ref), number_label(hi, step, ref))


def tail_label(lo: Column, hi: Column, step: Column) -> Column:
    """As bucket_label, but each bound has its own suffix: a tail can span several orders of size."""
    return _bounds_label(number_label(lo, step), number_label(hi, step))


#: The narrowest integer types with their strict upper bounds, signed and unsigned (fixed values).
SIGNED = (("tinyint", 127), ("smallint", 32767), ("int", 2147483647))
UNSIGNED = (("smallint", 255), ("int", 65535), ("bigint", 4294967295))


def narrowest_int(lo: int | None, hi: int | None) -> str:
    """The narrowest integer type for values from lo to hi; values without sign take the next wider type with one."""
    if lo is None or hi is None:
        return "tinyint"
    if lo < 0:
        return next((t for t, most in SIGNED if -most < lo and hi < most), "bigint")
    return next((t for t, most in UNSIGNED if hi < most), "bigint")
