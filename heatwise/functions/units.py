"""Units, odds, times and codes as column functions. Bad input gives NULL, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FURLONG_METRES, POUND_KG = 201.168, 0.45359237


def number(c: Column) -> Column:
    """A number in plain digits. A bare cast would take Java's suffixes (8f, 2d) as well."""
    return F.when(c.rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"), c.try_cast("double"))


def _group(c: Column, pattern: str, n: int) -> Column:
    """A group of a pattern as a number; NULL where the pattern or the group is absent."""
    return F.nullif(F.regexp_extract(c, pattern, n), F.lit("")).try_cast("double")


def _zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def metres_to_furlongs(c: Column) -> Column:
    return F.round(number(c) / FURLONG_METRES, 4)


def uk_distance_to_furlongs(c: Column) -> Column:
    """Text of miles, furlongs and yards (1m4f 110y); a bare number passes; nothing or all zero is NULL."""
    t = F.regexp_replace(F.lower(F.trim(c)), r"\s+", "")
    pattern = r"^(?:(\d+(?:\.\d+)?)m)?(?:(\d+(?:\.\d+)?)f)?(?:(\d+(?:\.\d+)?)y(?:ds?)?)?$"
    total = _zero(_group(t, pattern, 1)) * 8 + _zero(_group(t, pattern, 2)) + _zero(_group(t, pattern, 3)) / 220
    return F.coalesce(number(t), F.round(F.when(t.rlike(pattern) & (total > 0), total), 4))


def text_distance_to_furlongs(c: Column) -> Column:
    """Card text: 1 1/16 Miles, 5½f, 1¼ miles, About 6 Furlongs, 1 Mile 70 Yards, 880 yards."""
    t = F.lower(c)
    for sign, text in (("½", "1/2"), ("¼", "1/4"), ("¾", "3/4")):
        t = F.replace(t, F.lit(sign), F.lit(f" {text} "))
    t = F.trim(F.regexp_replace(F.regexp_replace(t, r"\s+", " "), r"^\s*about\s+", ""))
    pattern = r"^(\d+)?(?:\s*(\d+)/(\d+))?\s*(m(?:iles?)?|f(?:urlongs?)?|y(?:ards?|ds?))(?:\s+(\d+)\s*y(?:ards?|ds?)?)?$"
    kind = F.regexp_extract(t, pattern, 4)
    unit = F.when(kind.startswith("m"), 8.0).when(kind.startswith("y"), 1 / 220).otherwise(1.0)
    whole = _zero(_group(t, pattern, 1)) + _zero(F.try_divide(_group(t, pattern, 2), _group(t, pattern, 3)))
    total = whole * unit + _zero(_group(t, pattern, 5)) / 220
    return F.round(F.when(t.rlike(pattern) & (total > 0), total), 4)


def kg_to_lbs(c: Column) -> Column:
    return F.when(number(c) > 0, F.round(number(c) / POUND_KG, 2))


def stones_to_lbs(c: Column) -> Column:
    """9-2 is 128; a number passes."""
    pattern = r"^\s*(\d+)-(\d+)\s*$"
    return F.coalesce(number(c), _group(c, pattern, 1) * 14 + _group(c, pattern, 2))


def odds_to_decimal(c: Column) -> Column:
    """Evens is 2; a/b and a-b are a/b + 1; a positive number passes."""
    t = F.upper(F.trim(c))
    pattern = r"^(\d+(?:\.\d+)?)\s*[/-]\s*(\d+(?:\.\d+)?)$"
    ratio = F.round(F.try_divide(_group(t, pattern, 1), _group(t, pattern, 2)) + 1, 4)
    return F.when(t.isin("EVENS", "EVEN", "EVS", "EV"), 2.0).when(t.rlike(pattern), ratio).when(number(t) > 0, number(t))


def card_odds_to_decimal(c: Column) -> Column:
    """As odds_to_decimal, but a bare number counts only within 1 to 1001."""
    t = F.trim(c)
    return F.when(number(t).isNull(), odds_to_decimal(t)).when(number(t).between(1, 1001), number(t))


def sp_to_decimal(c: Column) -> Column:
    """Starting prices with a favourite's mark (F, J, C) behind them."""
    return odds_to_decimal(F.regexp_replace(F.trim(c), r"(?i)(?<=[0-9sn])\s*[fjc]+$", ""))


def going_to_surface(going: Column, all_weather: Column) -> Column:
    return F.when(F.coalesce(all_weather, F.lit(False)) | F.coalesce(F.contains(F.lower(going), F.lit("standard")), F.lit(False)), "synthetic").otherwise("turf")


def first_rule(c: Column, rules: list[tuple[str, str]]) -> Column:
    """The name of the first rule whose text stands in the column; else its text in lower case, NULL where that is empty."""
    t, out = F.lower(F.trim(c)), None
    for part, name in rules:
        out = F.when(t.contains(part), name) if out is None else out.when(t.contains(part), name)
    return out.otherwise(F.nullif(t, F.lit("")))


# Words of ground descriptions and what they come to. The first that stands in the text counts, so `Good, Firm in places` is good.
UK_GOING = [("heavy", "heavy"), ("good", "good"), ("soft", "soft"), ("firm", "fast")]
HK_GOING = [("heavy", "heavy"), ("soft", "soft"), ("good", "good"), ("yielding", "yielding"), ("fast", "fast")]


def uk_going_to_condition(c: Column) -> Column:
    """Ground of artificial tracks (standard, standard to slow) counts as fast."""
    return F.when(F.lower(F.trim(c)).startswith("standard"), "fast").otherwise(first_rule(c, UK_GOING))


def hk_going_to_condition(c: Column) -> Column:
    return first_rule(c, HK_GOING)


def map_code(c: Column, mapping: dict[str, str], default: str | None = None) -> Column:
    """A code's name; other codes pass, or become the default."""
    found = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])[F.lower(F.trim(c))]
    return F.coalesce(found, c if default is None else F.lit(default))


def time_to_seconds(c: Column) -> Column:
    """m:ss.ff, :ss.f or seconds; what is not positive is NULL."""
    pattern = r"^\s*(\d*):(\d{1,2}(?:\.\d+)?)\s*$"
    s = F.coalesce(number(c), F.when(c.rlike(pattern), _zero(_group(c, pattern, 1)) * 60 + _group(c, pattern, 2)))
    return F.when(s > 0, F.round(s, 3))


def clock_to_minutes(c: Column) -> Column:
    pattern = r"^\s*(\d{1,2}):(\d{2})\s*$"
    h, m = _group(c, pattern, 1), _group(c, pattern, 2)
    return F.when((h < 24) & (m < 60), (h * 60 + m).cast("int"))


def first_int(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"(\d+)", 1), F.lit("")).try_cast("int")


def first_number(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"(-?\d+(?:\.\d+)?)", 1), F.lit("")).try_cast("double")


def money(c: Column) -> Column:
    return number(F.regexp_replace(c, r"[$,\s]", ""))


def fx_to_usd(c: Column, rate: Column | float) -> Column:
    return F.round(number(c) * rate, 2)


def coerce_int(c: Column) -> Column:
    """Whole part of a number, towards zero."""
    return number(F.trim(c)).try_cast("int")


def coerce_float(c: Column) -> Column:
    return F.when(~F.isnan(number(F.trim(c))), number(F.trim(c)))


def coerce_date(c: Column, formats: tuple[str, ...] = ("yyyy-MM-dd", "yyyy/MM/dd", "dd/MM/yyyy", "yyyyMMdd")) -> Column:
    return F.coalesce(*[F.to_date(F.try_to_timestamp(F.trim(c), F.lit(f))) for f in formats])


def coerce_str(c: Column) -> Column:
    return F.nullif(F.trim(c.cast("string")), F.lit(""))


def is_missing(c: Column, numeric: bool = False) -> Column:
    return c.isNull() | F.isnan(c) if numeric else c.isNull() | (F.trim(c) == "")
