"""Field maps from names and values."""

import pytest

from heatwise.operators import mapping as M


@pytest.mark.parametrize("a, b, most, want", [("track", "track", 0, 0), ("trakc", "track", 1, 1), ("horse", "hrse", 1, 1), ("horse", "house_name", 2, None), ("abc", "xyz", 2, None), ("", "ab", 2, 2), ("ca", "abc", 3, 3)])
def test_edits(a, b, most, want):
    assert M.edits(a, b, most) == want


def test_map_by_names_and_values(spark):
    df = spark.createDataFrame(
        [("SAR", "2020-01-02", "1", "A", "2", "5/2", "9-2", "1m4f", "Good", "Soft", "7", None, "x"), ("SAR", "2020-01-02", "1", "B", "1", "EVS", "9-4", "6f", "Heavy", "Soft", "7", None, "y")],
        "course string, `Race Date` string, race_no string, runner string, finish_positon string, odds string, weight string, distance string, going string, surfcae string, race_id string, trainer string, jockey_id string",
    )
    got = M.automatic_map(df, "UK")
    assert {k: v["column"] for k, v in got.items()} == {
        "race_track_code": "course", "race_race_date": "Race Date", "race_race_number": "race_no", "horse_name_display": "runner", "finish_position": "finish_positon", "odds_final": "odds", "weight_lbs": "weight",
        "race_distance_furlongs": "distance", "race_condition": "going", "race_surface": "surfcae", "trainer_name_display": "trainer",
    }
    assert {k: v["transform"] for k, v in got.items() if "transform" in v} == {"odds_final": "odds_to_decimal", "weight_lbs": "stones_to_lbs", "race_distance_furlongs": "uk_distance_to_furlongs", "race_condition": "uk_going_to_condition"}
    assert "transform" not in M.automatic_map(df, "us")["race_condition"]


def test_values_overrule_names_and_fields_move_on(spark):
    df = spark.createDataFrame([("one", "1.5"), ("two", "2")], "odds string, sp string")
    assert M.automatic_map(df)["odds_final"]["column"] == "sp"
    options = {"a": [((0, 0), "x"), ((1, 0), "y")], "b": [((0, 1), "x")], "c": []}
    assert M.assign(options) == {"a": "y", "b": "x"}


def test_empty_tables_go_by_exact_names(spark):
    empty = spark.createDataFrame([], "Track string, hrose string, `odd.name` int")
    assert M.automatic_map(empty) == {"race_track_code": {"column": "Track", "type": "string"}}
