"""Nested race cards, and cards from text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text, units
from . import jsoncards


def unnest_card(cards: DataFrame, key: str) -> dict[str, DataFrame]:
    """Tables of cards, races, entries and past rows, with their parents' keys."""
    races = cards.select(key, F.explode("races").alias("r"))
    entries = races.select(key, F.col("r.number").alias("number"), F.explode("r.entries").alias("e"))
    history = entries.select(key, "number", F.col("e.post").alias("post"), F.posexplode("e.history").alias("nth", "h"))
    return {
        "cards": cards.withColumn("n_races", F.size("races")).drop("races"),
        "races": races.select(key, "r.*").drop("entries"),
        "entries": entries.select(key, "number", "e.*").drop("history"),
        "history": history.select(key, "number", "post", "nth", "h.*"),
    }


def nest_card(tables: dict[str, DataFrame], key: str) -> DataFrame:
    """The inverse: past rows in their order, entries by post, races by number."""

    def gather(child: DataFrame, keys: list[str], order: str, drop: tuple[str, ...], name: str) -> DataFrame:
        fields = [c for c in child.columns if c not in keys]
        row = F.struct(F.col(order).alias("_o"), F.struct(*[c for c in fields if c not in drop]).alias("v"))
        return child.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["v"]).alias(name))

    past = gather(tables["history"], [key, "number", "post"], "nth", ("nth",), "history")
    entries = gather(tables["entries"].join(past, [key, "number", "post"], "left"), [key, "number"], "post", (), "entries")
    races = gather(tables["races"].join(entries, [key, "number"], "left"), [key], "number", (), "races")
    return tables["cards"].drop("n_races").join(races, key, "left")


def has_enough_data(entries: Column, confidence: Column, least: int = 4, sure: float = 0.5) -> Column:
    """At least four runners with a history, and a confidence of 0.5."""
    return (F.size(F.filter(entries, lambda e: F.size(e["history"]) > 0)) >= least) & (confidence >= sure)


def hydrate_card(entries: DataFrame, probs: DataFrame) -> DataFrame:
    """Entries with model and market chances and their difference, by race and post."""
    both = entries.join(probs, ["race", "post"], "left")
    return both.withColumn("edge", F.col("model_prob") - F.col("market_prob"))


def segment_blocks(docs: DataFrame, key: str, body: str, header: str) -> DataFrame:
    """Lines of each document by block: a line that matches the header begins one, lines before the first are left out."""
    lines = docs.select(key, F.posexplode(F.split(body, "\n")).alias("line_no", "line"))
    block = F.sum(F.col("line").rlike(header).cast("int")).over(Window.partitionBy(key).orderBy("line_no"))
    return lines.withColumn("block", block).where("block > 0")


DAY = r"(?:\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4})"


def extract_header(blocks: DataFrame, key: str, n: int = 20) -> DataFrame:
    """Fields of each block's first lines. A block without a usable distance (2 to 20 furlongs) is left out.

    The track is a code of two to five capitals before a date in its line; the condition is the first of the known ones that is named, `unknown` where none
    is; a grade is 1 to 3 or I to III. What is not there is NULL, and a missing track, date or purse is a warning.
    """
    first = F.row_number().over(Window.partitionBy(key, "block").orderBy("line_no"))
    head = blocks.withColumn("_n", first).where(F.col("_n") <= n).groupBy(key, "block").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("t"))
    get = lambda p: F.nullif(F.trim(F.regexp_extract("t", p, 1)), F.lit(""))
    distance = units.text_distance_to_furlongs(get(r"(?i)((?:about\s+)?\d[\d /½]*\s*(?:miles?|furlongs?|f\b)(?:\s+\d+\s*yards?)?)"))
    condition = F.coalesce(*[F.when(F.col("t").rlike(rf"(?i)\b{x}\b"), F.lit(x)) for x in jsoncards.CONDITIONS], F.lit("unknown"))
    numeral = F.upper(get(r"(?i)\bgrade\s+(I{1,3}|[123])\b"))
    grade = F.when(numeral.startswith("I"), F.length(numeral)).otherwise(numeral.try_cast("int"))
    out = head.select(key, "block", distance.alias("distance"), text.race_type(F.col("t")).alias("race_type"), units.money(get(r"(?i)purse:?\s*(\$?[\d,]+)")).alias("purse"), units.coerce_date(get(rf"({DAY})"), ("yyyy-MM-dd", "M/d/yyyy")).alias("day"), F.lower(get(r"(?i)\b(turf|dirt|synthetic)\b")).alias("surface"), get(rf"\b([A-Z]{{2,5}})\b[^\n]*?{DAY}").alias("track"), condition.alias("condition"), units.money(get(r"(?i)claiming(?:\s+price)?:?\s*(\$[\d,]+)")).alias("claiming_price"), grade.alias("grade"))
    out = out.withColumn("warnings", F.array_compact(F.array(F.when(F.col("track").isNull(), F.lit("no track")), F.when(F.col("purse").isNull(), F.lit("no purse")), F.when(F.col("day").isNull(), F.lit("no date")))))
    return out.where(F.col("distance").between(2, 20))


def extract_entries(blocks: DataFrame, key: str, runner: str) -> DataFrame:
    """Runners of each block: a line that matches (post, name) begins one, and the three lines after it may name rider, weight and odds. Flags are the letters of the first word of its line that has only L and B, three at most."""
    own = F.sum(F.col("line").rlike(runner).cast("int")).over(Window.partitionBy(key, "block").orderBy("line_no"))
    rows = blocks.withColumn("runner", own).where("runner > 0")
    nth = F.row_number().over(Window.partitionBy(key, "block", "runner").orderBy("line_no"))
    near = rows.withColumn("_n", nth).where("_n <= 4").groupBy(key, "block", "runner").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("t"))
    get = lambda p, i=1: F.nullif(F.trim(F.regexp_extract("t", p, i)), F.lit(""))
    flags = F.array_sort(F.array_distinct(F.filter(F.split(F.regexp_extract(F.get(F.split("t", "\n"), F.lit(0)), r"\b([LB]{1,3})\b", 1), ""), lambda x: x != "")))
    return near.select(key, "block", get(runner, 1).cast("int").alias("post"), text.clean_name(get(runner, 2)).alias("name"), text.collapse_ws(get(r"(?i)jockey:?\s*([^\n]+)")).alias("jockey"), units.first_number(get(r"(?i)weight:?\s*(\d+)")).alias("weight"), units.card_odds_to_decimal(get(r"(?i)odds:?\s*(\S+)")).alias("odds"), text.collapse_ws(get(r"(?i)trainer:?\s*([^\n]+)")).alias("trainer"), flags.alias("flags"))


def extract_history(blocks: DataFrame, key: str, runner: str, least: int = 8) -> DataFrame:
    """Dated lines of at least eight tokens below a runner: date, track, then named fields (fin=, fig=) or the tokens in their places."""
    own = F.sum(F.col("line").rlike(runner).cast("int")).over(Window.partitionBy(key, "block").orderBy("line_no"))
    t = F.split(F.trim("line"), r"\s+")
    rows = blocks.withColumn("runner", own).where((F.col("runner") > 0) & F.col("line").rlike(r"^\s*\d{4}-\d{2}-\d{2}\b")).withColumn("t", t).where(F.size("t") >= least)
    named = lambda name, at: F.coalesce(units.first_number(F.nullif(F.regexp_extract("line", rf"(?i)\b{name}=(\S+)", 1), F.lit(""))), units.number(F.get("t", at)))
    out = rows.select(key, "block", "runner", "line_no", units.coerce_date(F.get("t", 0)).alias("day"), F.get("t", 1).alias("track"), named("fin", 2).cast("int").alias("finish"), named("fig", 3).alias("figure"))
    w = Window.partitionBy(key, "block", "runner").orderBy(F.desc("day"), "line_no")
    return out.withColumn("gap", F.datediff("day", F.lead("day").over(w)))


JSON_CARD = "track string, card_date string, races array<struct<number:string,surface:string,entries:array<struct<post:string,horse:string,odds:string>>>>"
SURFACES = ("turf", "dirt", "synthetic")


def cards_from_json_text(df: DataFrame, body: str) -> DataFrame:
    """The first JSON object of a text (whole, fenced or within words), typed: an unknown surface is `unknown`, odds out of range are NULL, an entry without post or name goes."""
    c = F.col(body)
    card = F.from_json(jsoncards.first_json_text(c), JSON_CARD)

    def entry(e: Column) -> Column:
        o = units.coerce_float(e["odds"])
        return F.struct(units.coerce_int(e["post"]).alias("post"), units.coerce_str(e["horse"]).alias("horse"), F.when(o.between(1, 1001), o).alias("odds"))

    def race(r: Column) -> Column:
        s = F.lower(r["surface"])
        good = F.filter(F.transform(r["entries"], entry), lambda e: e["post"].isNotNull() & e["horse"].isNotNull())
        return F.struct(units.coerce_int(r["number"]).alias("number"), F.when(s.isin(*SURFACES), s).otherwise("unknown").alias("surface"), good.alias("entries"))

    races = F.filter(F.transform(F.col("_card.races"), race), lambda r: r["number"].isNotNull())
    return df.withColumn("_card", card).withColumns({"track": F.col("_card.track"), "card_date": units.coerce_date(F.col("_card.card_date")), "races": races}).drop("_card")
