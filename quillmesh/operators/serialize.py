"""Serialisation of rows to text: blocks of columns in a fixed order, and the way back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.functions.text import format_value

Blocks = list[tuple[str, list[str]]]


def _column(c: str, tokens: bool, skip_null: bool) -> Column:
    value = format_value(F.col(f"`{c}`"))
    lead = f"[COL] {c} [VAL] " if tokens else f"{c}: "
    full = F.concat(F.lit(lead), value)
    return F.when(value != "", full).otherwise(F.lit("") if skip_null else F.lit(lead + "NULL"))


def serialize(df: DataFrame, blocks: Blocks, tokens: bool = True, skip_null: bool = True) -> Column:
    """Text of a row. A block without any value is left out; columns that the table lacks are skipped."""
    parts = []
    for name, cols in blocks:
        cols = [c for c in cols if c in df.columns]
        if not cols:
            continue
        some = F.greatest(*[(format_value(F.col(f"`{c}`")) != "").cast("int") for c in cols], F.lit(0)) > 0
        body = F.array_join(F.filter(F.array(*[_column(c, tokens, skip_null) for c in cols]), lambda x: x != ""), " " if tokens else ", ")
        parts.append(F.when(some, F.concat(F.lit(f"[BLK_{name}] " if tokens else ""), body)).otherwise(""))
    return F.array_join(F.filter(F.array(*parts), lambda x: x != ""), " " if tokens else ". ")


def serialize_blocks(df: DataFrame, blocks: Blocks, tokens: bool = True) -> Column:
    """The older form: everything joined by single spaces; with tokens a null is written as NULL, without it is left out."""
    parts = []
    for name, cols in blocks:
        cols = [c for c in cols if c in df.columns]
        values = [format_value(F.col(f"`{c}`")) for c in cols]
        if not cols:
            continue
        one = [F.when(v != "", F.concat(F.lit(f"[COL] {c} [VAL] " if tokens else f"{c}: "), v)).otherwise(f"[COL] {c} [VAL] NULL" if tokens else "") for c, v in zip(cols, values, strict=True)]
        some = F.exists(F.array(*values), lambda v: v != "")
        body = F.array_join(F.filter(F.array(*one), lambda x: x != ""), " ")
        parts.append(F.when(some, F.concat(F.lit(f"[BLK_{name}] " if tokens else ""), body)).otherwise(""))
    return F.array_join(F.filter(F.array(*parts), lambda x: x != ""), " ")


def name_text(df: DataFrame, column: str, parts: tuple[str, ...] = (), label: str = "nombre") -> Column:
    """`column: name`, or, where the column is null or absent, `label: ` and the filled name parts; '' without a name."""
    whole = F.col(f"`{column}`").cast("string") if column in df.columns else F.lit(None).cast("string")
    own = [F.trim(F.col(f"`{p}`").cast("string")) for p in parts if p in df.columns]
    joined = F.array_join(F.filter(F.array(*own), lambda x: x.isNotNull() & (x != "")), " ") if own else F.lit("")
    name = F.coalesce(F.trim(whole), joined)
    return F.when(name != "", F.concat(F.when(whole.isNotNull(), column).otherwise(label), F.lit(": "), name)).otherwise("")


def serialize_zeroshot(df: DataFrame, leave_out: tuple[str, ...] = ("record_id", "source")) -> Column:
    """All columns in their own order as `name: value`, nulls skipped."""
    cols = [c for c in df.columns if c not in leave_out]
    return F.array_join(F.filter(F.array(*[_column(c, False, True) for c in cols]), lambda x: x != ""), ", ")


def pretty(df: DataFrame) -> Column:
    """One `column: value` a line, nulls left out."""
    return F.concat_ws("\n", *[F.when(F.col(f"`{c}`").isNotNull(), F.concat(F.lit(f"{c}: "), F.col(f"`{c}`").cast("string"))) for c in df.columns])


def parse(text: Column) -> Column:
    """array of (block, col, val) of a tokened serialisation."""
    blocks = F.filter(F.split(text, r"\[BLK_"), lambda b: b != "")

    def columns(b: Column) -> Column:
        name = F.regexp_extract(b, r"^([^\]]*)\]", 1)
        cols = F.filter(F.split(F.regexp_replace(b, r"^[^\]]*\] ?", ""), r"\[COL\] "), lambda c: F.trim(c) != "")
        return F.transform(cols, lambda c: F.struct(name.alias("block"), F.substring_index(c, " [VAL] ", 1).alias("col"), F.trim(F.regexp_replace(c, r"(?s)^.*? \[VAL\] ", "")).alias("val")))

    return F.flatten(F.transform(blocks, columns))
