"""Registries by name: readers of raw sources, and field maps, which are checked when they are loaded."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators.rows import COERCE, TRANSFORMS, apply_field_map
from .files import read_bundle, read_csv_source

Reader = Callable[[SparkSession, str], DataFrame]
READERS: dict[str, Reader] = {}


def reader(name: str) -> Callable[[Reader], Reader]:
    def add(f: Reader) -> Reader:
        READERS[name] = f
        return f

    return add


reader("csv")(read_csv_source)


@reader("runs_and_races")
def runs_and_races(spark: SparkSession, path: str) -> DataFrame:
    """Folders `runs` and `races` with the key race_id."""
    return read_bundle(spark, path, "runs", "races", "race_id")


def read_source(spark: SparkSession, name: str, path: str) -> DataFrame:
    if name not in READERS:
        raise KeyError(f"no reader {name!r}; known: {', '.join(sorted(READERS))}")
    return READERS[name](spark, path)


class FieldMaps:
    """Field maps by name: canonical field -> {column | const, transform, type}."""

    def __init__(self) -> None:
        self._maps: dict[str, dict[str, dict]] = {}

    def load(self, name: str, text: str) -> None:
        """Add a map given as JSON. All that is wrong with it is told at once, and nothing is added then."""
        spec, wrong = json.loads(text), []
        for field, s in spec.items():
            if ("column" in s) == ("const" in s):
                wrong.append(f"{field}: needs a column or a constant, and not both")
            for key, known in (("transform", TRANSFORMS), ("type", COERCE)):
                if key in s and s[key] not in known:
                    wrong.append(f"{field}: no {key} {s[key]!r}; known: {', '.join(sorted(known))}")
            wrong += [f"{field}: unknown entry {k!r}" for k in s if k not in ("column", "const", "transform", "type")]
        if wrong:
            raise ValueError(f"field map {name}: " + "; ".join(wrong))
        self._maps[name] = spec

    def get(self, name: str) -> dict[str, dict]:
        if name not in self._maps:
            raise KeyError(f"no field map {name!r}; known: {', '.join(sorted(self._maps))}")
        return self._maps[name]

    def apply(self, df: DataFrame, name: str) -> DataFrame:
        return apply_field_map(df, self.get(name))
