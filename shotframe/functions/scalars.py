"""Scalar rules of field files as column expressions: text fields, header words, scalars, times and angles. Nulls give null unless said."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INT16, INT32 = 2**15 - 1, 2**31 - 1


def half_up(v: Column, places: int = 0) -> Column:
    """Rounded so that halves go up, also below zero."""
    return F.floor(v * 10.0**places + 0.5) / 10.0**places


def fixed(v: Column, places: int) -> Column:
    """With so many decimals; halves go away from zero, and what is below zero keeps its sign."""
    return F.concat(F.when(v < 0, "-").otherwise(""), half_up(F.abs(v), places).cast(f"decimal(38,{places})").cast("string"))


def fit_number(v: Column, width: int) -> Column:
    """Exactly width characters, to the right: with two decimals, else one, else none; at last cut off on the right."""
    shown = F.when(F.length(fixed(v, 2)) <= width, fixed(v, 2)).when(F.length(fixed(v, 1)) <= width, fixed(v, 1)).otherwise(fixed(v, 0))
    return F.lpad(shown, width, " ")


def csv_cell(v: Column) -> Column:
    """Quoted only if it holds a quote, a comma or a line end."""
    return F.when(v.rlike('[",\n\r]'), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v)


def xml_escape(v: Column) -> Column:
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        v = F.replace(v, F.lit(mark), F.lit(name))
    return v


def normal_token(v: Column) -> Column:
    return F.regexp_replace(F.lower(v), "[^a-z0-9]", "")


def column_letter(i: Column) -> Column:
    """0 is A, 26 is AA; up to three letters."""
    letter = lambda x: F.chr((F.lit(65) + x % 26).cast("long"))
    two, three = F.floor(i / 26) - 1, F.floor((i - 26) / 676) - 1
    return F.when(i < 26, letter(i)).when(i < 702, F.concat(letter(two), letter(i))).otherwise(F.concat(letter(three), letter(F.floor((i - 26) / 26)), letter(i)))


def clean_message(v: Column) -> Column:
    """Line ends as blanks, without other control characters but tabs and without outer white space; null if it is longer than 512 characters or nothing is left."""
    kept = F.regexp_replace(F.regexp_replace(v, "[\\r\\n]+", " "), "[\\x00-\\x08\\x0B-\\x1F\\x7F]", "")
    kept = F.regexp_replace(kept, "^[\\s\\x{A0}\\x{FEFF}]+|[\\s\\x{A0}\\x{FEFF}]+$", "")
    return F.when((F.length(v) <= 512) & (kept != ""), kept)


def touches(name: Column) -> Column:
    """Whether a file's name, in any folder and case, is that of a shot's scratch file; names over 260 characters are none."""
    base = F.lower(F.element_at(F.split(name, r"[\\/]"), -1))
    return F.coalesce(F.length(name).between(1, 260) & base.startswith("tmp"), F.lit(False))


def log_key(shot: Column, time: Column) -> Column:
    return F.concat_ws("@", shot.cast("string"), time)


def epoch_iso(v: Column) -> Column:
    """Milliseconds from 1e11 on, else seconds; as ISO text in UTC (the session's time zone)."""
    ms = F.when(v >= 1e11, v).otherwise(v * 1000).cast("long")
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def tape_date(ts: Column) -> Column:
    """A blank, two digits of the year and three of its day."""
    return F.concat(F.lit(" "), F.date_format(ts, "yyDDD"))


def sample_ms(i: Column, interval_us: Column) -> Column:
    return i * interval_us / 1000.0


def interval_unit(v: Column) -> Column:
    return F.when(v < 0.1, "s").when(v <= 200, "ms").otherwise("us")


def apply_scalar(raw: Column, scalar: Column) -> Column:
    """A negative scalar divides, a positive one multiplies, 0 counts as 1."""
    return F.when(scalar < 0, raw / -scalar).when(scalar > 0, raw * scalar).otherwise(raw * 1.0)


def encode_scalar(real: Column, scalar: Column) -> Column:
    """The whole number that the scalar turns into real again, within 32 bits."""
    raw = F.floor(F.when(scalar < 0, real * -scalar).when(scalar > 0, real / scalar).otherwise(real) + 0.5)
    return F.when(raw.isNotNull(), F.greatest(F.least(raw, F.lit(INT32)), F.lit(-INT32 - 1))).cast("long")


#: Coordinate scalars, from the weakest.
SCALARS = (1, -10, -100, -1000, -10000)


def fit_scalar(most: Column, wanted: int) -> Column:
    """wanted, or from a negative one the next weaker at which the largest magnitude still fits 32 bits; at last 1."""
    if wanted >= 0:
        return F.lit(wanted)
    some = F.when(most.isNull() | F.isnan(most) | (most <= 0) | (most == float("inf")), F.lit(wanted)).when(most * float(-wanted) <= INT32, F.lit(wanted))
    for s in reversed(SCALARS[1 : SCALARS.index(wanted)] if wanted in SCALARS else ()):
        some = some.when(most * float(-s) <= INT32, F.lit(s))
    return some.otherwise(F.lit(1))


def _finite(v: Column) -> Column:
    return F.when(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")), v)


def _is_whole(v: Column, factor: float) -> Column:
    return F.abs(v * factor - half_up(v * factor)) < 1e-6


def _scalar_of(most: Column, whole: list[Column]) -> Column:
    """The weakest scalar that keeps all values whole and within 32 bits, else the finest within 32 bits; 1 without values."""
    fits = [most * 10.0**k <= INT32 for k in range(len(SCALARS))]
    some = F.when(most.isNull(), F.lit(1))
    for k, s in enumerate(SCALARS):
        some = some.when(fits[k] & whole[k], F.lit(s))
    for k in reversed(range(len(SCALARS))):
        some = some.when(fits[k], F.lit(SCALARS[k]))
    return some.otherwise(F.lit(1))


def choose_scalar(v: Column) -> Column:
    """An aggregate over single values."""
    v = _finite(v)
    return _scalar_of(F.max(F.abs(v)), [F.coalesce(F.bool_and(_is_whole(v, 10.0**k)), F.lit(True)) for k in range(len(SCALARS))])


def with_scalar(rows: DataFrame, name: str, window, *values: str) -> DataFrame:
    """rows with the scalar of all values of several columns over a window; in steps, so that no expression is written out many times."""
    steps = {f"{name}_most": F.greatest(*[F.abs(_finite(F.col(v))) for v in values], F.lit(None))}
    for k in range(len(SCALARS)):
        whole = [F.coalesce(_is_whole(_finite(F.col(v)), 10.0**k), F.lit(True)) for v in values]
        steps[f"{name}_whole{k}"] = functools.reduce(Column.__and__, whole)
    over = rows.withColumns(steps)
    over = over.withColumns({s: (F.max(s) if s.endswith("most") else F.bool_and(s)).over(window) for s in steps})
    return over.withColumn(name, _scalar_of(F.col(f"{name}_most"), [F.col(f"{name}_whole{k}") for k in range(len(SCALARS))])).drop(*steps)


def word_or_null(v: Column, bits: int, unsigned: bool = False) -> Column:
    """A header word's value as a whole number, if it is not 0 and fits."""
    low, high = (0, 2**bits - 1) if unsigned and bits == 16 else (-(2 ** (bits - 1)), 2 ** (bits - 1) - 1)
    n = F.floor(v + 0.5)
    return F.when((n != 0) & n.between(low, high), n)


def clamp01(v: Column) -> Column:
    """NaN and null are 0."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.nanvl(F.coalesce(v, F.lit(0.0)), F.lit(0.0))))


def wrap180(degrees: Column) -> Column:
    """The same angle in (-180, 180]."""
    turned = F.pmod(degrees, F.lit(360.0))
    return F.when(turned > 180, turned - 360).otherwise(turned)


def signed_power(x: Column, g: float) -> Column:
    return x if g <= 0 or g == 1 else F.signum(x) * F.pow(F.abs(x), F.lit(g))
