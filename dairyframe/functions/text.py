"""Text, number and unit expressions. Every function maps columns to a column."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# Unit factors and the id/label formats the results must share.
LB_TO_KG = 0.45359237
KG_TO_LB = 2.20462
MILK_EVENT = "milkrecording"
NUMBER_PATTERN = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value computed once, however often ``body`` uses it, also inside a lambda.

    A plain column expression is computed again at each place that uses it, and for every element of a lambda.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def norm_header(c: Column) -> Column:
    """Lower-case, trim, and keep only letters a-z and digits."""
    return F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", "")


def norm_header_text(name: str) -> str:
    """Driver-side twin of :func:`norm_header` for a header known on the driver."""
    return "".join(ch for ch in str(name).strip().lower() if ch.isascii() and ch.isalnum())


def parse_number(c: Column) -> Column:
    """Text to double: blanks trimmed, trailing ``*`` flags dropped, lone comma read as point.

    Unreadable text, NaN and infinities become null.
    """

    def pointed(text: Column) -> Column:
        return F.when(text.contains(",") & ~text.contains("."), F.replace(text, F.lit(","), F.lit("."))).otherwise(text)

    return to_number(let(F.regexp_replace(F.trim(c), r"\*+$", ""), pointed))


def to_number(c: Column) -> Column:
    """Plain decimal or exponent notation to double; anything else is null.

    The pattern keeps out forms the JVM parser accepts on its own, such as a trailing ``d``.
    """
    return let(F.trim(c), lambda text: F.when(text.rlike(NUMBER_PATTERN), text.try_cast("double")))


def comma_number(c: Column) -> Column:
    """Text to double where every comma is a decimal point; null when unreadable."""
    return to_number(F.replace(c, F.lit(","), F.lit(".")))


def finite(c: Column) -> Column:
    """NaN and infinities to null; the one place where both missing forms meet."""
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)


def whole(c: Column) -> Column:
    """Truncate toward zero to INT, the way an integer cast of a parsed number does; null beyond its range."""
    return c.try_cast("int")


def to_date_time(c: Column) -> Column:
    """ISO or month-first date text to timestamp; null when unreadable."""
    return F.coalesce(F.try_to_timestamp(c), F.try_to_timestamp(c, F.lit("M/d/yyyy")))


def norm_id(c: Column) -> Column:
    """``1483.0`` becomes ``1483``; any other id is trimmed text."""
    number = to_number(c)
    is_whole = number.isNotNull() & (number == F.floor(number)) & (F.abs(number) < 1e18)
    return F.when(is_whole, number.cast("bigint").cast("string")).otherwise(F.trim(c))


def lb_to_kg(c: Column) -> Column:
    return c * F.lit(LB_TO_KG)


def kg_to_lb(c: Column) -> Column:
    return c * F.lit(KG_TO_LB)


def in_unit(c: Column, unit: Column) -> Column:
    """A kg value shown in ``unit`` ('kg' or 'lb')."""
    return F.when(unit.isin("lb", "lbs"), kg_to_lb(c)).otherwise(c)


def weight_text(c: Column, unit: str, digits: int = 1) -> Column:
    """A kg value as display text; pounds get thousands separators, kg does not."""
    if unit == "lbs":
        return F.format_string(f"%,.{digits}f", kg_to_lb(c))
    return F.format_string(f"%.{digits}f", c)


def unit_label(base_unit: Column, unit: str) -> Column:
    return F.replace(base_unit, F.lit("kg"), F.lit("lbs")) if unit == "lbs" else base_unit


def parity_group(parity: Column) -> Column:
    """'1', '2' or '3+'; a missing parity counts as 1."""
    p = F.coalesce(parity, F.lit(1))
    return F.when(p <= 2, p.cast("string")).otherwise(F.lit("3+"))


def cow_label(cow_id: Column, birth_year: Column, parity: Column) -> Column:
    """Display name of a lactation, with the birth year when it is known."""
    born = F.when(birth_year.isNotNull(), F.concat(F.lit(" (b. "), birth_year.cast("string"), F.lit(")")))
    parity_text = F.coalesce(parity.cast("string"), F.lit("None"))
    return F.concat(F.lit("Cow "), cow_id, F.coalesce(born, F.lit("")), F.lit(" - parity "), parity_text)


def safe_path_part(c: Column) -> Column:
    """Runs of characters outside letters, digits and `_.=-` become ``-``."""
    cleaned = F.trim(F.regexp_replace(F.trim(c), "[^A-Za-z0-9_.=-]+", "-"), F.lit("-"))
    return F.coalesce(F.nullif(cleaned, F.lit("")), F.lit("unnamed"))


def email_domain(c: Column) -> Column:
    return F.lower(F.substring_index(c, "@", -1))


def byte_text(c: Column) -> Column:
    """A byte count as text in the largest unit that keeps it at least 1; whole numbers stay whole."""
    size = c.cast("double")
    text = None
    for power, unit in ((3, "GB"), (2, "MB"), (1, "KB")):
        scaled = size / F.lit(float(1024**power))
        shown = F.when(
            scaled == F.floor(scaled), F.format_string(f"%d {unit}", scaled.cast("bigint"))
        ).otherwise(F.format_string(f"%.1f {unit}", scaled))
        reached = size >= 1024**power
        text = F.when(reached, shown) if text is None else text.when(reached, shown)
    return text.otherwise(F.format_string("%d bytes", c.cast("bigint")))


def first_text(*cols: Column) -> Column:
    """First column that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols])
