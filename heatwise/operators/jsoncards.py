"""Whole race cards from free text that holds JSON: the first object is found by its braces, then typed field by field."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import units

# Names that enumerated fields may have. Anything else is `unknown`.
SURFACES = ("dirt", "turf", "synthetic")
CONDITIONS = ("fast", "good", "sloppy", "muddy", "heavy", "frozen", "firm", "yielding", "soft")
RACE_TYPES = ("maiden_claiming", "maiden_special_weight", "claiming", "allowance", "allowance_optional_claiming", "stakes", "graded_stakes", "handicap")
DATES = ("yyyy-MM-dd", "M/d/yyyy", "M/d/yy", "MMMM d, yyyy", "MMM d, yyyy")


def _once(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is made once, however often f names it: Spark evaluates what stands in lambdas anew at each mention."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def balanced_objects(c: Column) -> Column:
    """All outermost {...} of a text, in order. Braces and quotes inside a string do not count, nor does a quote behind a backslash there; quotes outside of
    objects are words. A brace that is never closed gives nothing. One fold over the pieces between braces, quotes and backslashes."""
    pieces = F.regexp_extract_all(c, F.lit(r'[\\"{}]|[^\\"{}]+'), 0)
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("depth"), F.lit(0).alias("begin"), F.lit(False).alias("quoted"), F.lit(False).alias("escaped"), F.array().cast("array<struct<a:int,n:int>>").alias("spans"))

    def step(s: Column, t: Column) -> Column:
        i, outside = s["i"] + 1, s["depth"] == 0
        bare = ~outside & ~s["quoted"]
        opens, closes = (outside | bare) & (t == "{"), bare & (t == "}")
        quote = ~outside & (t == '"') & ~s["escaped"]
        begin = F.when(outside & opens, i).otherwise(s["begin"])
        done = F.array(F.struct(begin.alias("a"), (i - begin + 1).alias("n")))
        return F.struct(
            i.alias("i"), (s["depth"] + opens.cast("int") - closes.cast("int")).alias("depth"), begin.alias("begin"), F.when(quote, ~s["quoted"]).otherwise(s["quoted"]).alias("quoted"),
            (s["quoted"] & (t == "\\") & ~s["escaped"]).alias("escaped"), F.when(closes & (s["depth"] == 1), F.concat(s["spans"], done)).otherwise(s["spans"]).alias("spans"),
        )

    cut = lambda p: F.transform(F.aggregate(p, start, step)["spans"], lambda x: F.array_join(F.slice(p, x["a"], x["n"]), ""))
    return _once(pieces, cut)


#: Objects of a text that are tried one by one before it takes all.
TRIED = 3
#: A brace, or what stands between braces inside of an object, strings whole. Possessive, so that Java's matcher goes on in a loop and never back.
_BETWEEN = r'[{}]|(?:[^{}"]++|"[^"\\]*+(?:\\.[^"\\]*+)*+"?+)++'


def _from_brace(c: Column) -> Column:
    """A text from its first opening brace on; empty where there is none."""
    return _once(F.instr(c, "{"), lambda i: F.when(i > 0, F.substr(c, i)).otherwise(""))


def _closed(c: Column) -> Column:
    """The object that a text begins with, up to the brace that closes it, as the first of balanced_objects(); empty where none does."""

    def step(s: Column, t: Column) -> Column:
        i, depth = s["i"] + 1, s["depth"] + (t == "{").cast("int") - (t == "}").cast("int")
        return F.when(s["n"] > 0, s).otherwise(F.struct(i.alias("i"), depth.alias("depth"), F.when(depth == 0, i).otherwise(F.lit(0)).alias("n")))

    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("depth"), F.lit(0).alias("n"))
    return _once(F.regexp_extract_all(c, F.lit(f"(?s){_BETWEEN}"), 0), lambda p: F.array_join(F.slice(p, 1, F.aggregate(p, start, step)["n"]), ""))


def _first_object(c: Column, parsed: Callable[[Column], Column]) -> Column:
    """What parsed gives for the first JSON object of a text: that of a fenced block, else the first outermost {...} for which it is not NULL."""
    fenced = F.regexp_extract(c, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)

    def first(c: Column, tries: int) -> Column:
        """Quotes outside of objects are words, so each object is cut off before the next is looked for."""
        if not tries:
            return F.get(F.filter(F.transform(balanced_objects(c), parsed), lambda x: x.isNotNull()), F.lit(0))
        rest = lambda t, x: first(F.substr(t, F.length(x) + 1), tries - 1)
        one = lambda t: _once(_closed(t), lambda x: F.when(x != "", F.coalesce(parsed(x), rest(t, x))))
        return _once(_from_brace(c), one)

    return F.coalesce(_once(fenced, lambda x: F.when(x != "", parsed(x))), first(c, TRIED))


def first_json_text(c: Column) -> Column:
    """The first JSON object of a text: that of a fenced block, else the first outermost {...} that parses. NULL where there is none."""
    return _first_object(c, lambda x: F.when(F.try_parse_json(x).isNotNull(), x))


def first_json_object(c: Column) -> Column:
    """first_json_text() as a variant."""
    return _first_object(c, F.try_parse_json)


def _raw(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "string")


def _text(v: Column, name: str) -> Column:
    return _once(F.trim(_raw(v, name)), lambda x: F.when(x != "", x))


def _number(v: Column, name: str, least: float | None = None, most: float | None = None) -> Column:
    """A number, with or without $ and commas; out of its range it is NULL."""
    x = _once(F.regexp_replace(_raw(v, name), r"[$,\s]", ""), units.number)
    if least is None:
        return x
    return _once(x, lambda n: F.when(n >= least if most is None else n.between(least, most), n))


def _whole(v: Column, name: str, least: int | None = None, most: int | None = None) -> Column:
    """The nearest whole number, of two the even one; out of its range it is NULL."""
    x = F.bround(_number(v, name), 0).try_cast("int")
    return x if least is None else _once(x, lambda n: F.when(n.between(least, most), n))


def _one_of(v: Column, name: str, allowed: tuple[str, ...]) -> Column:
    return _once(F.translate(F.lower(F.trim(_raw(v, name))), "- ", "__"), lambda x: F.when(x.isin(*allowed), x).otherwise("unknown"))


def _date(v: Column, name: str) -> Column:
    """A date in one of DATES; years of two digits from 69 on are of the last century."""
    last_century = lambda t: lambda d: F.when(t.rlike(r"/\d\d$") & (F.year(d) >= 2069), F.add_months(d, -1200)).otherwise(d)
    return _once(F.trim(_raw(v, name)), lambda t: _once(units.coerce_date(t, DATES), last_century(t)))


def _track(v: Column) -> Column:
    """A code of two to five characters, which must be text."""
    t = F.when(F.schema_of_variant(F.try_variant_get(v, "$.track_code", "variant")) == "STRING", F.upper(_text(v, "track_code")))
    return _once(t, lambda x: F.when(F.length(x).between(2, 5), x))


def _items(v: Column, name: str) -> Column:
    """Elements of a list; what is no list has none."""
    return F.coalesce(F.try_variant_get(v, f"$.{name}", "array<variant>"), F.array().cast("array<variant>"))


def _flags(v: Column, name: str) -> Column:
    words = F.coalesce(F.try_variant_get(v, f"$.{name}", "array<string>"), F.array().cast("array<string>"))
    return F.filter(F.transform(words, lambda x: F.trim(x)), lambda x: x != "")


def _common(v: Column) -> list[Column]:
    return [
        _track(v).alias("track_code"), _number(v, "distance_furlongs", 2, 20).alias("distance"), _one_of(v, "surface", SURFACES).alias("surface"), _one_of(v, "condition", CONDITIONS).alias("condition"),
        _one_of(v, "race_type", RACE_TYPES).alias("race_type"), _number(v, "claiming_price").alias("claiming_price"), _number(v, "purse_usd").alias("purse"),
    ]


def past_line(v: Column) -> Column:
    finish, behind = _whole(v, "finish_position", 1, 30), _number(v, "lengths_behind", 0)
    behind = _once(F.struct(finish.alias("f"), behind.alias("b")), lambda x: F.when((x["f"] == 1) & x["b"].isNotNull(), 0.0).otherwise(x["b"]))
    number = F.coalesce(F.nullif(_whole(v, "race_number"), F.lit(0)), F.lit(1))
    return F.struct(
        _date(v, "race_date").alias("race_date"), *_common(v), F.least(F.greatest(number, F.lit(1)), F.lit(20)).alias("race_number"), _whole(v, "post_position", 1, 24).alias("post"), finish.alias("finish"),
        behind.alias("lengths_behind"), _whole(v, "field_size", 2, 30).alias("field_size"), _text(v, "jockey").alias("jockey"), _number(v, "weight_lbs", 95, 145).alias("weight"),
        _number(v, "odds_final", 1).alias("odds"), _number(v, "speed_figure", -20, 150).alias("speed_figure"), F.coalesce(_text(v, "speed_figure_source"), F.lit("unknown")).alias("figure_source"),
        _number(v, "fraction_q1", 10, 100).alias("first_call"), _number(v, "fraction_q2", 20, 160).alias("second_call"), _number(v, "fraction_finish", 40, 300).alias("final_time"), _text(v, "comment").alias("comment"),
    )


def _all(x: Column, *names: str) -> Column:
    out = F.lit(True)
    for n in names:
        out = out & x[n].isNotNull()
    return out


def entry(v: Column) -> Column:
    name, odds = _once(_text(v, "horse_name"), lambda x: F.when(F.length(x) <= 100, x)), _number(v, "morning_line_odds", 1, 500)
    past = F.filter(F.transform(_items(v, "pp_lines"), past_line), lambda x: _all(x, "race_date", "track_code", "distance", "post"))
    newest = F.array_sort(past, lambda a, b: F.when(a["race_date"] > b["race_date"], -1).when(a["race_date"] < b["race_date"], 1).otherwise(0))
    return F.struct(
        name.alias("horse"), _whole(v, "post_position", 1, 24).alias("post"), odds.alias("odds"), (1 / odds).alias("implied"), _text(v, "jockey").alias("jockey"), _text(v, "trainer").alias("trainer"),
        _text(v, "owner").alias("owner"), _number(v, "weight_lbs", 95, 145).alias("weight"), _flags(v, "medication_flags").alias("medication"), _flags(v, "equipment_changes").alias("equipment"), newest.alias("history"),
    )


def race(v: Column) -> Column:
    distance = _number(v, "distance_furlongs", 2, 20)
    entries = F.filter(F.transform(_items(v, "entries"), entry), lambda x: _all(x, "horse", "post"))
    return F.struct(
        _whole(v, "race_number", 1, 20).alias("number"), _date(v, "race_date").alias("race_date"), *_common(v), _text(v, "track_name").alias("track_name"), _text(v, "race_name").alias("race_name"),
        F.coalesce(_text(v, "distance_raw"), F.concat(distance.cast("string"), F.lit(" Furlongs"))).alias("distance_text"), _whole(v, "grade", 1, 3).alias("grade"), _text(v, "age_sex_restrictions").alias("restrictions"),
        _text(v, "weight_conditions").alias("weight_conditions"), _text(v, "post_time").alias("post_time"), _text(v, "weather").alias("weather"), entries.alias("entries"),
    )


def full_cards_from_json_text(df: DataFrame, body: str) -> DataFrame:
    """df with `races` of the first JSON object in a text, and the card's date and track where all its races agree.

    A name that is not known is `unknown`; an optional value out of its range is NULL; a runner without name or post (1 to 24), a past line without date,
    track, distance or post, and a race without number (1 to 20), track or distance (2 to 20 furlongs) go. A race without a readable date keeps NULL. Past
    lines stand with the latest first. Confidence is 0.4 for the race and 0.6 times the share of runners with a past. Texts that are NULL, empty or without
    an object have no races (NULL); columns of df named races, card_date or track_code are replaced.
    """
    card = df.withColumn("_card", first_json_object(F.col(body)))
    whole = F.filter(F.transform(_items(F.col("_card"), "races"), race), lambda x: _all(x, "number", "track_code", "distance"))
    share = lambda r: F.coalesce(F.try_divide(F.size(F.filter(r["entries"], lambda e: F.size(e["history"]) > 0)), F.size(r["entries"])), F.lit(0.0))
    judged = F.transform(F.col("_races"), lambda r: r.withField("confidence", F.round(0.4 + 0.6 * share(r), 3)))
    card = card.withColumn("_races", F.when(F.col("_card").isNotNull(), whole)).withColumn("races", judged)

    def agreed(field: str) -> Column:
        """The value that all races have."""
        values = F.array_distinct(F.transform("races", lambda r: r[field]))
        return F.when(F.size(values) == 1, F.get(values, F.lit(0)))

    return card.withColumns({"card_date": agreed("race_date"), "track_code": agreed("track_code")}).drop("_card", "_races")
