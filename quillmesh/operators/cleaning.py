"""Cleaning steps as DataFrame functions, and profiles that chain them.

Each step is df -> df for df.transform(); rows are never dropped or reordered. A SourceSpec says which columns
a source has for each step, so profiles are not tied to one schema; absent columns are skipped.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmesh.functions import text as X

Step = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class SourceSpec:
    lost_letter: tuple[str, ...] = ()
    names: tuple[str, ...] = ()
    bracketed: bool = False
    ages: tuple[str, ...] = ()
    dates: tuple[str, ...] = ()
    keys: tuple[str, ...] = ()
    numbers: tuple[str, ...] = ()
    name_parts: tuple[str, ...] = ()
    full_name: str = "full_name"
    drop: tuple[str, ...] = ()
    drop_pattern: str = r"^Unnamed"
    rename: dict[str, str] = field(default_factory=dict)


def _texts(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def _each(df: DataFrame, names, fn) -> DataFrame:
    have = [c for c in names if c in df.columns]
    return df.withColumns({c: fn(F.col(f"`{c}`")) for c in have}) if have else df


def squeeze(upper: bool = False) -> Step:
    return lambda df: _each(df, _texts(df), lambda c: F.upper(X.squeeze_space(c)) if upper else X.squeeze_space(c))


def restore_letter(spec: SourceSpec) -> Step:
    return lambda df: _each(df, spec.lost_letter, lambda c: F.replace(c, F.lit("?"), F.lit("Ñ")))


def clean_names(spec: SourceSpec) -> Step:
    return lambda df: _each(df, spec.names, lambda c: X.clean_name(c, spec.bracketed))


def parse_types(spec: SourceSpec) -> Step:
    def step(df: DataFrame) -> DataFrame:
        df = _each(df, spec.ages, X.age_years)
        df = _each(df, spec.dates, X.parse_date)
        df = _each(df, spec.keys, X.to_key)
        return _each(df, spec.numbers, X.to_number)

    return step


def join_full_name(spec: SourceSpec) -> Step:
    return lambda df: df.withColumn(spec.full_name, X.join_names(*[F.col(f"`{c}`") for c in spec.name_parts])) if spec.name_parts and set(spec.name_parts) <= set(df.columns) else df


def drop_columns(spec: SourceSpec) -> Step:
    import re

    return lambda df: df.drop(*[c for c in df.columns if c in spec.drop or re.match(spec.drop_pattern, c)])


def add_name_key(spec: SourceSpec) -> Step:
    return lambda df: df.withColumns({f"{c}_key": X.name_key(F.col(f"`{c}`")) for c in (*spec.names, spec.full_name) if c in df.columns})


def rename_columns(spec: SourceSpec) -> Step:
    return lambda df: df.withColumnsRenamed(spec.rename)


def profile(name: str, spec: SourceSpec) -> list[Step]:
    """Steps of a profile: 'full' (typed, upper-case, with keys), 'min', 'std' (names joined), 'renamed'."""
    s0, letter, names, types = squeeze(), restore_letter(spec), clean_names(spec), parse_types(spec)
    joined, dropped, keyed, renamed = join_full_name(spec), drop_columns(spec), add_name_key(spec), rename_columns(spec)
    chains = {
        "full": [squeeze(upper=True), letter, names, types, joined, dropped, keyed, renamed],
        "min": [s0, letter],
        "std": [s0, letter, joined, dropped],
        "renamed": [s0, letter, names, joined, dropped, renamed],
    }
    return chains[name]


def apply_profile(df: DataFrame, name: str, spec: SourceSpec) -> DataFrame:
    for step in profile(name, spec):
        df = df.transform(step)
    return df
