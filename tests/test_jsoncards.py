"""Race cards from JSON in free text."""

import datetime as dt
import json

import pytest

from heatwise.operators import jsoncards as J

PAST = {"race_date": "03/05/2019", "track_code": "bel", "distance_furlongs": "8", "post_position": "3", "race_number": 44, "finish_position": 1, "lengths_behind": 2.5, "weight_lbs": 300, "odds_final": 0.5, "speed_figure": 151, "fraction_q1": 22.4, "fraction_finish": 20, "surface": "Moon", "race_type": "Maiden Claiming", "comment": " wide "}
ENTRY = {"horse_name": ' Say "Hi" {now} ', "post_position": 2.5, "morning_line_odds": "4", "jockey": "", "weight_lbs": "122", "medication_flags": [" L ", "", "B"], "equipment_changes": "none", "pp_lines": [PAST, PAST | {"race_date": "Mar 6, 2019"}, PAST | {"race_date": "?"}, "text", PAST | {"track_code": "toolong"}]}
RACE = {"race_number": "3", "race_date": "January 2, 2020", "track_code": " sar ", "distance_furlongs": 6, "surface": "TURF", "condition": "firm", "race_type": "graded-stakes", "grade": 7, "purse_usd": "$1,250,000", "claiming_price": "n/a", "weather": "clear }", "entries": [ENTRY, {"post_position": 4}, {"horse_name": "X", "post_position": 25}, {"horse_name": "Y", "post_position": 4}, 7]}
CARD = {"races": [RACE, RACE | {"race_number": 21}, RACE | {"track_code": 12}, RACE | {"distance_furlongs": 1}, "no race"]}


def cards(spark, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r for r in J.full_cards_from_json_text(df, "t").orderBy("i").collect()]


def objects(spark, text):
    return spark.createDataFrame([(text,)], "t string").select(J.balanced_objects(J.F.col("t")).alias("x")).first()["x"]


@pytest.mark.parametrize("text, want", [
    ('Card {draft}: {"a": 1} and {"b": {"c": 2}} }', ["{draft}", '{"a": 1}', '{"b": {"c": 2}}']),
    (r'a 5" rail {"a": "}{", "b": "\"}\\"} rest', [r'{"a": "}{", "b": "\"}\\"}']),
    ('{"a": {"b": 1}', []), ("", []), ("no braces", []), ("}{}", ["{}"]), (r"\{}", ["{}"]),
])
def test_objects_by_their_braces(spark, text, want):
    assert objects(spark, text) == want


def test_first_object_that_parses(spark):
    texts = ['Card {draft}: {"a": 1} {"a": 2}', 'x {"a": 3} ```json\n{"a": 4}\n```', "```\n{bad}\n``` {\"a\": 5} trailing {", '[{"a": 6}]', '{"a": {"b": 1}', None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = df.select("i", J.F.try_variant_get(J.first_json_object(J.F.col("t")), "$.a", "int").alias("a")).orderBy("i").collect()
    assert [r["a"] for r in got] == [1, 4, 5, 6, None, None, None]


def test_full_card(spark):
    text = "Here {is} it: " + json.dumps(CARD) + " Hope {that} helps"
    (card,) = cards(spark, text)
    (race,) = card["races"]
    assert (card["track_code"], card["card_date"]) == ("SAR", dt.date(2020, 1, 2))
    assert (race["number"], race["surface"], race["condition"], race["race_type"], race["grade"], race["purse"], race["claiming_price"]) == (3, "turf", "firm", "graded_stakes", None, 1250000.0, None)
    assert (race["distance_text"], race["weather"], race["confidence"]) == ("6.0 Furlongs", "clear }", 0.7)
    first, second = race["entries"]
    assert (first["horse"], first["post"], first["odds"], first["implied"], first["jockey"], first["weight"], first["medication"], first["equipment"]) == ('Say "Hi" {now}', 2, 4.0, 0.25, None, 122.0, ["L", "B"], [])
    assert (second["horse"], second["history"]) == ("Y", [])
    late, early = first["history"]
    assert (late["race_date"], early["race_date"]) == (dt.date(2019, 3, 6), dt.date(2019, 3, 5))
    assert (early["track_code"], early["race_number"], early["finish"], early["lengths_behind"], early["weight"], early["odds"], early["speed_figure"], early["first_call"], early["final_time"]) == ("BEL", 20, 1, 0.0, None, None, None, 22.4, None)
    assert (early["surface"], early["race_type"], early["figure_source"], early["comment"]) == ("unknown", "maiden_claiming", "unknown", "wide")


def test_texts_without_cards_and_odd_ones(spark):
    none, empty, words, bare, mixed, long = cards(spark, None, "", "no {card}", '{"races": "none"}', json.dumps({"races": [RACE, RACE | {"track_code": "BEL", "race_date": "1/2/99"}]}), "{x} " * 2000 + json.dumps({"races": [RACE | {"entries": [ENTRY] * 60}]}))
    assert none["races"] is None and empty["races"] is None and words["races"] is None
    assert bare["races"] == [] and bare["card_date"] is None
    assert mixed["track_code"] is None and mixed["card_date"] is None and mixed["races"][1]["race_date"] == dt.date(1999, 1, 2)
    assert len(long["races"][0]["entries"]) == 60
    assert J.full_cards_from_json_text(spark.createDataFrame([], "t string, races int"), "t").count() == 0


def test_values_are_made_once_and_races_too(spark):
    """A range names its value once, and no filter makes the races of a card a second time."""
    from pyspark.sql import functions as F

    from heatwise.plans import flows

    one = J._number(F.col("v"), "x", 2, 20)
    assert str(one).count("try_variant_get") == 1
    df = flows.x05_full(spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if x.lstrip(" :+-").startswith("Filter") and "try_variant_get" in x]


def test_first_object_takes_pieces_between_braces(spark):
    """Strings inside of an object are no pieces of their own, and the object is the one that the fold over all quotes finds."""
    import random

    from pyspark.sql import functions as F

    card = '{"races": [{"entries": [' + ", ".join(f'{{"horse": "A \\"{i}\\" }}{{", "odds": "3"}}' for i in range(50)) + "]}]}"
    assert spark.range(1).select(F.size(F.regexp_extract_all(F.lit(card), F.lit(f"(?s){J._BETWEEN}"), 0))).first()[0] < 4 * 52
    rng = random.Random(5)
    parts = ["{", "}", '"', "\\", '{"a": 1}', '{"a": "}{"}', " x ", '{"b": {"c": "\\""}}', "\n", "{}", "[", '{"d": [1, {"e": "\\\\"}]}']
    rows = [("".join(rng.choice(parts) for _ in range(rng.randint(0, 14))),) for _ in range(800)] + [(None,), ("{draft} " * 9 + '{"z": 1}',), ("A 5\" card {draft}: " + card + " and {}",)]
    whole = F.get(F.filter(J.balanced_objects(F.col("t")), lambda x: F.try_parse_json(x).isNotNull()), F.lit(0))
    got = spark.createDataFrame(rows, "t string").select(whole.alias("want"), J.first_json_text(F.col("t")).alias("got")).collect()
    assert all(r["want"] == r["got"] for r in got) and sum(r["got"] is not None for r in got) > 400
    assert got[-1]["got"] == card and got[-2]["got"] == '{"z": 1}'
    long = '{"a": "' + 'x\\"' * 200_000 + '"}'
    assert spark.createDataFrame([(long,)], "t string").select(J.first_json_text(F.col("t"))).first()[0] == long
