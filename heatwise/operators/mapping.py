"""Field maps of unknown tables, from the names of their columns and the shapes of their values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Shapes of a value, as patterns over its trimmed text.
SHAPES = {
    "number": r"[+-]?(\d+\.?\d*|\.\d+)",
    "date": r"(\d{4}[-/]\d{1,2}[-/]\d{1,2}|\d{1,2}/\d{1,2}/\d{4}|\d{8})([ T].*)?",
    "odds": r"(?i)(\d+(\.\d+)?\s*[/-]\s*\d+(\.\d+)?|evens?|evs?)[fjc]?",
    "stones": r"\d{1,2}-\d{1,2}",
    "clock": r"\d*:\d{1,2}(\.\d+)?",
    "length": r"(?i)(\d+(\.\d+)?\s*m)?\s*(\d+(\.\d+)?\s*f)?\s*(\d+\s*y(ds?)?)?",
    "word": r".*\p{L}.*",
}
#: Canonical field -> names it goes by (first ones first), shapes its values may have, names that only look like it.
FIELDS: dict[str, dict[str, Sequence[str]]] = {
    "race_track_code": {"names": ("track_code", "track", "course", "venue", "racecourse"), "shapes": ("word",), "blocked": ("track_type", "track_condition")},
    "race_race_date": {"names": ("race_date", "date", "meeting_date"), "shapes": ("date",), "blocked": ("birth_date", "foaling_date")},
    "race_race_number": {"names": ("race_number", "race_no", "race_num", "race"), "shapes": ("number",), "blocked": ("race_id",)},
    "race_distance_furlongs": {"names": ("distance_furlongs", "distance", "dist", "dist_m"), "shapes": ("number", "length"), "blocked": ("beaten_distance",)},
    "race_surface": {"names": ("surface", "track_surface"), "shapes": ("word",)},
    "race_condition": {"names": ("condition", "track_condition", "going"), "shapes": ("word",)},
    "race_purse_usd": {"names": ("purse_usd", "purse", "prize_money", "prize"), "shapes": ("number",)},
    "horse_name_display": {"names": ("horse_name", "horse", "runner"), "shapes": ("word",), "blocked": ("horse_id", "horse_age")},
    "jockey_name_display": {"names": ("jockey_name", "jockey", "rider"), "shapes": ("word",), "blocked": ("jockey_id",)},
    "trainer_name_display": {"names": ("trainer_name", "trainer"), "shapes": ("word",), "blocked": ("trainer_id",)},
    "finish_position": {"names": ("finish_position", "finish_pos", "position", "place", "pos"), "shapes": ("number",)},
    "post_position": {"names": ("post_position", "post", "draw", "barrier", "stall"), "shapes": ("number",)},
    "odds_final": {"names": ("odds_final", "odds", "starting_price", "sp", "decimal_odds"), "shapes": ("number", "odds")},
    "weight_lbs": {"names": ("weight_lbs", "weight", "lbs"), "shapes": ("number", "stones")},
    "speed_figure": {"names": ("speed_figure", "speed_rating", "rating", "official_rating"), "shapes": ("number",)},
    "fraction_finish_sec": {"names": ("finish_time", "final_time", "time"), "shapes": ("number", "clock")},
}
KIND = {"race_race_date": "date", "race_race_number": "int", "finish_position": "int", "post_position": "int"}


def profile(df: DataFrame) -> dict[str, dict[str, float]]:
    """For each column the share of its values that have each of SHAPES, and its median number, from one pass. Nulls and empty texts are no values; a column without
    values has no shares. What comes to the driver is one row, as wide as the table has columns."""
    aggs = []
    for i, name in enumerate(df.columns):
        t = F.nullif(F.trim(F.col(f"`{name}`").cast("string")), F.lit(""))
        aggs += [F.avg(t.rlike(f"^({p})$").cast("double")).alias(f"{i}.{shape}") for shape, p in SHAPES.items()]
        aggs.append(F.percentile_approx(F.when(t.rlike(f"^({SHAPES['number']})$"), t.try_cast("double")), 0.5).alias(f"{i}.median"))
    one = df.agg(*aggs).first().asDict()
    return {name: {k: one[f"{i}.{k}"] for k in [*SHAPES, "median"] if one[f"{i}.{k}"] is not None} for i, name in enumerate(df.columns)}


def edits(a: str, b: str, most: int) -> int | None:
    """Edit distance of two names (a swap of neighbours counts once) if it is at most `most`."""
    if abs(len(a) - len(b)) > most:
        return None
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        older, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            best = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, older[j - 2] + 1)
            row.append(best)
        if min(row) > most:
            return None
    return row[-1] if row[-1] <= most else None


def costs(profiles: Mapping[str, Mapping[str, float]], fields: Mapping[str, Mapping[str, Sequence[str]]], share: float = 0.9) -> dict[str, list[tuple[tuple[int, int], str]]]:
    """For each field the columns that may be it, the best first: by edits, then by the place of the name. One edit is allowed for each four letters, two at most;
    at least `share` of the values must have a shape of the field; blocked names never count, nor does a column without values unless its name is exact."""
    blocked, out = {b for f in fields.values() for b in f.get("blocked", ())}, {}
    known = {n for f in fields.values() for n in f["names"]}
    for field, f in fields.items():
        found = []
        for column, p in profiles.items():
            low = "_".join(column.lower().replace("-", " ").replace("_", " ").split())
            if low in blocked and low not in f["names"]:
                continue
            # A name that is another field's own is not a misspelt one.
            near = [(0 if low == n else d, place) for place, n in enumerate(f["names"]) if (low == n or low not in known) and (d := edits(low, n, min(2, len(n) // 4))) is not None]
            fits = sum(p.get(s, 0.0) for s in f["shapes"]) >= share if p else bool(near) and min(near)[0] == 0
            if near and fits:
                found.append((min(near), column))
        out[field] = sorted(found)
    return out


def assign(options: Mapping[str, Sequence[tuple[tuple[int, int], str]]]) -> dict[str, str]:
    """A column for as many fields as can have one, each column once. Fields with better names choose first; one that took a column moves on if it has another."""
    owner: dict[str, str] = {}

    def seat(field: str, seen: set[str]) -> bool:
        for _, column in options[field]:
            if column not in seen:
                seen.add(column)
                if column not in owner or seat(owner[column], seen):
                    owner[column] = field
                    return True
        return False

    for field in sorted((f for f in options if options[f]), key=lambda f: (options[f][0][0], list(options).index(f))):
        seat(field, set())
    return {field: column for column, field in owner.items()}


def transform_of(field: str, p: Mapping[str, float], jurisdiction: str | None) -> dict[str, str]:
    """The transformer that the values of a column call for, else the type of the field."""
    home = (jurisdiction or "").lower() in ("uk", "ie", "ire", "uk/ie")
    if field == "odds_final":
        return {"transform": "odds_to_decimal", "type": "double"}
    if field == "weight_lbs":
        return {"transform": "stones_to_lbs", "type": "double"} if p.get("stones", 0) > 0 else {"type": "double"}
    if field == "race_distance_furlongs":
        metres = p.get("number", 0) >= 0.9 and p.get("median", 0) > 400
        return {"transform": "metres_to_furlongs", "type": "double"} if metres else {"type": "double"} if p.get("number", 0) >= 0.9 else {"transform": "uk_distance_to_furlongs", "type": "double"}
    if field == "fraction_finish_sec":
        return {"transform": "time_to_seconds", "type": "double"}
    if field == "race_condition" and home:
        return {"transform": "uk_going_to_condition", "type": "string"}
    if field in ("race_purse_usd", "speed_figure"):
        return {"type": "double"}
    return {"type": KIND.get(field, "string")}


def automatic_map(df: DataFrame, jurisdiction: str | None = None, fields: Mapping[str, Mapping[str, Sequence[str]]] = FIELDS) -> dict[str, dict]:
    """A spec for rows.apply_field_map(): canonical field -> column, type and transformer. Fields that no column fits are left out.

    Names match in any case, with blanks or hyphens for underscores, or within the edits that costs() allows; values must have the field's shape, so a column
    whose name fits but whose values do not is passed over. Empty tables go by exact names alone.
    """
    p = profile(df)
    found = assign(costs(p, fields))
    return {f: {"column": found[f], **transform_of(f, p[found[f]], jurisdiction)} for f in fields if f in found}
