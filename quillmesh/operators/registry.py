"""Comparators of item pairs, by name: the extension point of pair scoring.

A comparator is a builder of a score column from the column prefixes of both items; where it gives null it does not
apply. What the catalogue says about one stands beside the builder, not in it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.functions.similarity import jaro_winkler_similarity, levenshtein_similarity

Builder = Callable[[str, str], Column]


class Registry:
    """Builders in order of registration, and their catalogue rows."""

    def __init__(self) -> None:
        self.builders: dict[str, Builder] = {}
        self.notes: dict[str, tuple[str, str, str]] = {}

    def comparator(self, name: str, inputs: str, values: str = "[0,1]", note: str = "") -> Callable[[Builder], Builder]:
        """Registers the decorated builder; inputs are its columns, comma-joined."""
        if name in self.builders:
            raise ValueError(f"{name} is registered")

        def add(builder: Builder) -> Builder:
            self.builders[name], self.notes[name] = builder, (inputs, values, note)
            return builder

        return add

    def scores(self, a: str, b: str, decimals: int) -> list[Column]:
        """A struct (place, method, value) for each comparator."""
        values = [F.round(build(a, b), decimals).cast("double") for build in self.builders.values()]
        return [F.struct(F.lit(k).alias("place"), F.lit(name).alias("method"), value.alias("value")) for k, (name, value) in enumerate(zip(self.builders, values, strict=True))]

    def catalogue(self, spark: SparkSession) -> DataFrame:
        rows = [(k, name, *self.notes[name]) for k, name in enumerate(self.builders)]
        return spark.createDataFrame(rows, "place int, method string, fields string, span string, description string")


def default_registry() -> Registry:
    registry = Registry()

    def named(a: str, b: str, value: Column) -> Column:
        return F.when((F.col(f"{a}key") != "") & (F.col(f"{b}key") != ""), value)

    @registry.comparator("exact_key", "exp,key", "{0,1}", "equal file number and equal name key")
    def _(a: str, b: str) -> Column:
        equal = (F.col(f"{a}exp") == F.col(f"{b}exp")) & (F.col(f"{a}key") == F.col(f"{b}key"))
        return F.when(F.col(f"{a}exp").isNotNull() & F.col(f"{b}exp").isNotNull(), equal.cast("double"))

    @registry.comparator("jaro_winkler", "key", note="Jaro-Winkler similarity of name keys")
    def _(a: str, b: str) -> Column:
        return named(a, b, jaro_winkler_similarity(F.col(f"{a}key"), F.col(f"{b}key")))

    @registry.comparator("levenshtein", "key", note="Levenshtein similarity of name keys")
    def _(a: str, b: str) -> Column:
        return named(a, b, levenshtein_similarity(F.col(f"{a}key"), F.col(f"{b}key")))

    return registry
