"""Number parsing, rounding and printing, exact to the last digit.

Spark's ``round`` and ``printf`` work on the shortest decimal form of a double and
so differ from Python and JavaScript at half-way points: 0.1235 is stored slightly
below 0.1235, hence prints as 0.123 there but as 0.124 in the JVM. Magnitudes are
rounded to four digits and then shown with three, so every tenth one sits on such a
point. The functions here decide on the stored binary value instead.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# What counts as a number in text. The JVM would also take "1d" or "0x1p3".
NUMBER_PATTERN = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity|nan))\s*$"
BLANK_PATTERN = r"^\s*$"

_SPLITTER = float(2**27 + 1)


def parse_number(text: str) -> str:
    """SQL for a text column (given as SQL) as double, null where it is not a number."""
    return f"CASE WHEN {text} RLIKE r'{NUMBER_PATTERN}' THEN try_cast({text} AS double) END"


def is_blank(text: str) -> str:
    """SQL for a test of a text column (given as SQL)."""
    return f"{text} RLIKE r'{BLANK_PATTERN}'"


def is_finite(number: Column) -> Column:
    return ~F.isnan(number) & (F.abs(number) != F.lit(float("inf")))


def _nearest(size: Column, digits: int, half_even: bool) -> Column:
    """The integer nearest to ``size * 10^digits`` for ``size >= 0``, exactly.

    Away from a half-way point the product decides. Close to one, ``size`` is cut into
    two halves whose products with the scale carry no rounding error, so the sign of the
    remainder against the half-way point is exact.
    """
    scale = float(10**digits)
    scaled = size * scale
    nearest = F.rint(scaled)
    close = F.abs(scaled - nearest) > 0.4999

    stretched = size * _SPLITTER
    high = stretched - (stretched - size)
    low = size - high
    floor = F.floor(scaled).cast("double")
    rest = (high * scale - (floor + 0.5)) + low * scale
    up = rest > 0
    up = up | ((rest == 0) & (floor % 2 == 1)) if half_even else up | (rest == 0)
    return F.when(close, floor + up.cast("double")).otherwise(nearest)


def round_half_even(number: Column, digits: int) -> Column:
    """``round(number, digits)`` as Python does it."""
    size = _nearest(F.abs(number), digits, half_even=True) / float(10**digits)
    return F.when(number < 0, -size).otherwise(size)


def round_scaled(number: Column, digits: int) -> Column:
    """Rounding as numpy does it: scale, round half to even, scale back."""
    return F.rint(number * float(10**digits)) / float(10**digits)


def to_fixed(number: Column, digits: int) -> Column:
    """``number.toFixed(digits)`` as a browser shows it."""
    size = _nearest(F.abs(number), digits, half_even=False) / float(10**digits)
    sign = F.when(number < 0, F.lit("-")).otherwise(F.lit(""))
    return F.concat(sign, F.format_string(f"%.{digits}f", size))


def plain_number(number: Column) -> Column:
    """A double as JavaScript prints it: no ".0", no exponent between 1e-6 and 1e21."""
    text = number.cast("string")
    size = F.abs(number)
    expanded = F.regexp_replace(
        text.try_cast("decimal(38,16)").cast("string"), r"\.?0+$", ""
    )
    return (
        F.when(size == 0, F.lit("0"))
        .when((size >= 1e-3) & (size < 1e7), F.regexp_replace(text, r"\.?0+$", ""))
        .when((size >= 1e-6) & (size < 1e21), expanded)
        .otherwise(
            F.lower(F.regexp_replace(F.regexp_replace(text, r"\.0E", "E"), r"E(\d)", "E+$1"))
        )
    )
