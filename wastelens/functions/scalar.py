"""Scalar column functions. All stay in built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wastelens.functions import constants as K


def rd(c: Column, digits: int) -> Column:
    return F.round(c.cast("double"), digits)


def steady_round(c: Column, digits: int) -> Column:
    """Half-up rounding that ignores the noise that the order of a floating sum leaves behind."""
    return F.round(c.try_cast("decimal(38,9)"), digits).cast("double")


def pct(part: Column, whole: Column) -> Column:
    """100 * part / whole as double; 0 when the whole is not positive."""
    part, whole = part.cast("double"), whole.cast("double")
    return F.when(whole > 0, part / whole * 100).otherwise(F.lit(0.0))


def or_zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0).cast("double"))


def fixed_text(c: Column, digits: int) -> Column:
    """Text of a number with a fixed count of decimals, half-up."""
    return F.round(c.cast("double"), digits).cast(f"decimal(20,{digits})").cast("string")


# ---- calendar ----
def weekday(fecha: Column) -> Column:
    """Monday = 0."""
    return F.weekday(fecha)


def is_weekend(fecha: Column) -> Column:
    return (F.weekday(fecha) >= 5).cast("int")


def event_code(fecha: Column) -> Column:
    """1 on day 15 (wins), 2 on a national holiday, else 0."""
    return (
        F.when(F.dayofmonth(fecha) == 15, F.lit(1))
        .when(F.date_format(fecha, "MM-dd").isin(K.HOLIDAYS), F.lit(2))
        .otherwise(F.lit(0))
    )


def weather_code(fecha: Column) -> Column:
    """A stand-in weather code 1..3 that depends on the date only, never on row order."""
    return F.pmod(F.unix_date(fecha), F.lit(3)).cast("int") + 1


def _names(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def weekday_name(index: Column) -> Column:
    return F.element_at(_names(K.WEEKDAYS), (index + 1).cast("int"))


def month_name(number: Column) -> Column:
    return F.when(
        number.between(1, 12), F.element_at(_names(K.MONTHS), F.when(number.between(1, 12), number).otherwise(1).cast("int"))
    ).otherwise(F.lit("-"))


# ---- text ----
def fold_accents(c: Column) -> Column:
    return F.translate(F.lower(c), "áéíóúñ", "aeioun")


def fold_latin(c: Column) -> Column:
    """Wider fold for exports: capitals, umlaut, degree sign, dashes and curly quotes."""
    return F.translate(c, "áéíóúñüÁÉÍÓÚÑÜ°–—“”‘’", "aeiounuAEIOUNUo--\"\"''")


def money_text(c: Column) -> Column:
    value = F.round(F.coalesce(c.cast("double"), F.lit(0.0)), 2)
    return F.concat(F.lit(K.CURRENCY + " "), F.format_number(value, 2))


def date_text(c: Column) -> Column:
    return F.coalesce(F.date_format(c, "dd/MM/yyyy"), F.lit("-"))


def datetime_text(c: Column) -> Column:
    return F.coalesce(F.date_format(c, "dd/MM/yyyy HH:mm:ss"), F.lit("-"))


# ---- units and factors ----
def to_kg(cantidad: Column, unidad: Column) -> Column:
    """Grams and millilitres divided by 1000; every other unit counts as kg or litre."""
    cantidad = F.coalesce(cantidad.cast("double"), F.lit(0.0))
    small = F.lower(F.trim(F.coalesce(unidad, F.lit("kg")))).isin(K.UNITS_PER_THOUSAND)
    return F.when(small, cantidad / 1000).otherwise(cantidad)


def keyword_factor(name: Column, factors: dict[str, float], default: float) -> Column:
    """Factor of the first listed keyword contained in the folded name.

    The factor list is short and fixed, so this is one CASE expression, not a join.
    """
    folded = fold_accents(name)
    out = None
    for key, value in factors.items():
        hit = folded.contains(key)
        out = F.when(hit, F.lit(value)) if out is None else out.when(hit, F.lit(value))
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


# ---- risk ----
def level_by_cuts(value: Column, cuts: tuple[float, float, float]) -> Column:
    low, mid, high = cuts
    return (
        F.when(value < low, F.lit("BAJO"))
        .when(value < mid, F.lit("MEDIO"))
        .when(value < high, F.lit("ALTO"))
        .otherwise(F.lit("CRITICO"))
    )


def expiry_level(days: Column) -> Column:
    return (
        F.when(days <= 1, F.lit("CRITICO"))
        .when(days <= 2, F.lit("ALTO"))
        .when(days <= 4, F.lit("MEDIO"))
        .otherwise(F.lit("BAJO"))
    )


def expiry_risk_pct(days: Column) -> Column:
    return F.greatest(F.lit(0.0), rd((7 - days) / 7 * 100, 2))


def level_rank(level: Column) -> Column:
    out = F.lit(9)
    for name, rank in reversed(K.LEVEL_ORDER.items()):
        out = F.when(level == name, F.lit(rank)).otherwise(out)
    return out


def recommended_production(demand: Column, mae: Column, factor: float = 1.10) -> Column:
    return F.ceil(F.greatest(demand * factor, demand + mae * 0.5)).cast("long")


def waste_risk(demand: Column, production: Column, mae: Column) -> Column:
    safe = F.when(demand > 0, demand)
    over = (production - demand) / safe * 100
    error = mae / safe * 100
    return (
        F.when(safe.isNull() | (error > 40) | (over > 25), F.lit("alto"))
        .when((error > 20) | (over > 15), F.lit("medio"))
        .otherwise(F.lit("bajo"))
    )


def confidence(r2: Column) -> Column:
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), r2)), F.lit(0.0))


# ---- tolerant parsing (ANSI casts would fail the job) ----
def parse_date(c: Column) -> Column:
    return c.try_cast("date")


def parse_number(c: Column) -> Column:
    return c.try_cast("double")


# ---- validation flags ----
def valid_email(c: Column) -> Column:
    return F.coalesce(c.rlike(K.EMAIL_PATTERN), F.lit(False))


def valid_tax_id(c: Column) -> Column:
    return F.coalesce(c.rlike(K.TAX_ID_PATTERN), F.lit(False))


def valid_phone(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).eqNullSafe("") | F.coalesce(c.rlike(K.PHONE_PATTERN), F.lit(False))


def not_blank(c: Column) -> Column:
    return F.length(F.trim(F.coalesce(c.cast("string"), F.lit("")))) > 0


def not_negative(c: Column) -> Column:
    return F.coalesce(c.try_cast("double") >= 0, F.lit(False))


def valid_password(c: Column) -> Column:
    return F.coalesce(F.length(c) >= K.MIN_PASSWORD, F.lit(False))
