"""Data-quality profiling: one pass over the table wherever the figures allow it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.functions.names import spare
from quillmesh.functions.text import snake_case
from quillmesh.operators.numbering import numbered, running

#: Ids of a range in which gaps are sought, and of a span in which missing ones are dealt out.
GAP_RANGE = 4096


def _one_column(df: DataFrame, c: str, kind: str) -> DataFrame:
    v = F.col(f"`{c}`")
    got = df.select(v.alias("v")).agg(F.count("*").alias("rows"), F.count("v").alias("non_null"), F.countDistinct("v").alias("n_distinct"), F.min(F.col("v").cast("string")).alias("least"), F.min("v").cast("string").alias("example"))
    return got.select(
        F.lit(c).alias("column"), F.lit(kind).alias("dtype"), "rows", "non_null", (F.col("rows") - F.col("non_null")).alias("nulls"), "n_distinct",
        (F.col("n_distinct") + (F.col("rows") > F.col("non_null")).cast("long")).alias("n_values"), F.round(100 * (F.col("rows") - F.col("non_null")) / F.greatest("rows", F.lit(1)), 4).alias("null_pct"), "example",
    )


def column_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, dtype, rows, non_null, nulls, n_distinct without null, n_values with it, null_pct, example: the least value).

    Each column is scanned alone, so that counting distinct values multiplies no rows.
    """
    kinds = dict(df.dtypes)
    out = None
    for c in columns or df.columns:
        own = _one_column(df, c, kinds[c])
        out = own if out is None else out.unionAll(own)
    return out


def null_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, rows, nulls, n_distinct, null_pct)."""
    return column_profile(df, columns).select("column", "rows", "nulls", "n_distinct", "null_pct")


def cuts(df: DataFrame, column: Column, points: tuple[float, ...]) -> DataFrame:
    """One row, q: exact quantiles with linear interpolation, null without values. Values are counted, then placed by running sums."""
    counts = df.select(column.cast("double").alias("v")).filter("v is not null").groupBy("v").agg(F.count("*").alias("n"))
    placed = running(counts, [F.col("v")], {"upto": F.col("n")})
    placed = placed.crossJoin(placed.agg(F.sum("n").alias("all")))  # one row
    take = []
    for k, p in enumerate(points):
        for end, at in (("lo", F.floor((F.col("all") - 1) * p)), ("hi", F.ceil((F.col("all") - 1) * p))):
            take.append(F.max(F.when((F.col("upto") > at) & (F.col("upto") - F.col("n") <= at), F.col("v"))).alias(f"{end}{k}"))
    got = placed.agg(F.max("all").alias("all"), *take)
    part = lambda p: (F.col("all") - 1) * p - F.floor((F.col("all") - 1) * p)
    return got.select(F.array(*[F.col(f"lo{k}") + (F.col(f"hi{k}") - F.col(f"lo{k}")) * part(p) for k, p in enumerate(points)]).alias("q"))


def describe(df: DataFrame, column: str) -> DataFrame:
    """count, mean, sample deviation, min, quartiles and max of a numeric column."""
    c = F.col(column)
    got = df.agg(F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max")).crossJoin(cuts(df, c, (0.25, 0.5, 0.75)))
    return got.select("n", *[F.round(x, 6).alias(x) for x in ("mean", "std", "min", "max")], *[F.round(F.get("q", F.lit(k)), 6).alias(a) for k, a in enumerate(("q1", "median", "q3"))])


def quantiles(df: DataFrame, column: str, points: tuple[float, ...] = (0.25, 0.75, 0.9, 0.95, 0.99)) -> DataFrame:
    """Exact, with linear interpolation."""
    got = cuts(df, F.col(column), points)
    return got.select(F.posexplode("q").alias("k", "value")).select(F.element_at(F.array(*[F.lit(p) for p in points]), F.col("k") + 1).alias("point"), F.round("value", 6).alias("value"))


def top_n_with_others(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    """The n most frequent values and one row of all others, with shares."""
    counts = df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("count"))
    top = counts.orderBy(F.desc("count"), F.asc_nulls_last("value")).limit(n)
    marked = counts.join(top.select(F.col("value").alias("_v"), F.lit(True).alias("_top")), F.col("value").eqNullSafe(F.col("_v")), "left")  # columns of its own
    rolled = marked.groupBy(F.when(F.col("_top"), F.col("value")).otherwise("(others)").alias("value"), F.coalesce("_top", F.lit(False)).alias("top")).agg(F.sum("count").alias("count"))
    total = counts.agg(F.sum("count").alias("_t"))
    return rolled.crossJoin(total).select("value", "top", "count", F.round(100 * F.col("count") / F.col("_t"), 4).alias("pct"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("count"))
    total = counts.agg(F.sum("count").alias("_t"))
    return counts.crossJoin(total).select("value", "count", F.round(F.col("count") / F.col("_t"), 6).alias("ratio"))


def group_mode(df: DataFrame, key: str, column: str) -> DataFrame:
    """The most frequent value of each group, the smallest on a tie; counts are pre-aggregated."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(key, column).agg(F.count("*").alias("n"))
    most = counts.groupBy(key).agg(F.max("n").alias("_m"))
    return counts.join(most, key).filter("n = _m").groupBy(key).agg(F.min(column).alias("mode"), F.min("n").alias("n"))


def frequency_of_frequencies(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("n_keys"))


def iqr_outliers(df: DataFrame, column: str, factor: float = 1.5) -> DataFrame:
    """Rows above the third quartile by `factor` interquartile ranges, counted beside the bound."""
    q = cuts(df, F.col(column), (0.25, 0.75))
    bound = q.select((F.get("q", F.lit(1)) + factor * (F.get("q", F.lit(1)) - F.get("q", F.lit(0)))).alias("bound"))
    return df.crossJoin(bound).groupBy("bound").agg(F.sum((F.col(column) > F.col("bound")).cast("long")).alias("n_outliers"), F.count("*").alias("n")).select(F.round("bound", 6).alias("bound"), "n_outliers", "n")


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """Share of rows in which two columns agree: of all rows a null counting as a mismatch, and of rows with both."""
    same, both = (F.col(a) == F.col(b)).cast("int"), F.col(a).isNotNull() & F.col(b).isNotNull()
    return df.agg(F.round(100 * F.avg(F.coalesce(same, F.lit(0))), 4).alias("pct_all"), F.round(100 * F.avg(F.when(both, same)), 4).alias("pct_both"), F.sum(both.cast("long")).alias("n_both"))


def concordance(df: DataFrame, category: str, flags: list[str]) -> DataFrame:
    return df.groupBy(category).agg(F.count("*").alias("n"), *[F.sum((F.col(f) == 1).cast("long")).alias(f"n_{f}") for f in flags])


def block_completeness(df: DataFrame, blocks: dict[str, list[str]]) -> DataFrame:
    """Per block: share of rows with all, some and none of its columns filled."""
    sets = {b: [F.col(c).isNotNull().cast("int") for c in cols] for b, cols in blocks.items()}
    total = lambda cols: sum(cols[1:], cols[0])
    pct = lambda cond: F.round(100 * F.avg(cond.cast("int")), 4)
    rows = [F.struct(F.lit(b).alias("block"), pct(total(c) == len(c)).alias("full"), pct((total(c) > 0) & (total(c) < len(c))).alias("partial"), pct(total(c) == 0).alias("empty")).alias(f"b{k}") for k, (b, c) in enumerate(sets.items())]
    return df.agg(*rows).select(F.explode(F.array(*[f"b{k}" for k in range(len(rows))])).alias("x")).select("x.*")


def offending_characters(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """Rows in which each character of a pattern occurs."""
    hits = F.explode(F.array_distinct(F.regexp_extract_all(F.col(column), F.lit(f"({pattern})"), F.lit(1))))
    return df.select(hits.alias("character")).groupBy("character").agg(F.count("*").alias("n_rows"))


def length_statistics(df: DataFrame, length: Column, cuts_at: tuple[int, ...] = (128, 256, 384, 512)) -> DataFrame:
    got = df.select(length.alias("n"))
    shares = [F.round(100 * F.avg((F.col("n") <= k).cast("int")), 4).alias(f"pct_le_{k}") for k in cuts_at]
    sums = got.agg(F.count("*").alias("rows"), F.round(F.avg("n"), 6).alias("mean"), F.max("n").cast("long").alias("max"), *shares)
    both = sums.crossJoin(cuts(got, F.col("n"), (0.5, 0.95)))
    return both.select("rows", "mean", F.round(F.get("q", F.lit(0)), 6).alias("median"), F.round(F.get("q", F.lit(1)), 6).alias("p95"), "max", *[f"pct_le_{k}" for k in cuts_at])


def duplicate_flags(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows with `duplicated` (the key occurs again anywhere) and `repeated` (it occurred before).

    Counts and first rows are aggregated by key and joined back, which copies in great number do not skew.
    """
    n, first = spare("copies", df.columns), spare("first_row", df.columns)
    names = [spare(f"key_{i}", df.columns) for i in range(len(keys))]
    own = df.groupBy(*keys).agg(F.count("*").alias(n), F.min(order).alias(first)).toDF(*names, n, first)
    on = None
    for name, k in zip(names, keys, strict=True):
        same = F.col(k).eqNullSafe(F.col(name))
        on = same if on is None else on & same
    return df.join(own, on).withColumns({"duplicated": F.col(n) > 1, "repeated": F.col(order) > F.col(first)}).drop(n, first, *names)


def group_sizes(df: DataFrame, keys: list[str]) -> DataFrame:
    """(size, n_groups) of groups of two rows or more."""
    return df.groupBy(*keys).agg(F.count("*").alias("size")).filter("size > 1").groupBy("size").agg(F.count("*").alias("n_groups"))


def domain_outliers(df: DataFrame, bounds: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    """(column, n_low, n_high): values under the least and over the greatest that a column may have."""
    one = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    none = F.lit(False)
    rows = [F.struct(F.lit(c).alias("column"), one(F.col(c) < lo if lo is not None else none).alias("n_low"), one(F.col(c) > hi if hi is not None else none).alias("n_high")).alias(f"c{k}") for k, (c, (lo, hi)) in enumerate(bounds.items())]
    return df.agg(*rows).select(F.explode(F.array(*[f"c{k}" for k in range(len(rows))])).alias("x")).select("x.*")


def declared_difference(df: DataFrame, declared: str, computed: Column, slack: float = 1) -> DataFrame:
    """Rows with both a declared and a computed value, and those of them further apart than slack."""
    apart = F.abs(computed - F.col(declared))
    return df.agg(F.count(apart).alias("n_both"), F.coalesce(F.sum((apart > slack).cast("long")), F.lit(0)).alias("n_apart"), F.round(F.avg(apart), 6).alias("mean_apart"))


def equals_row_number(df: DataFrame, column: str, order: list[str], first: int = 0) -> DataFrame:
    """Rows, and those whose sequence number is their place in the order, counted from `first`."""
    place = spare("place", df.columns)
    placed = numbered(df, [F.col(c) for c in order], place)
    return placed.agg(F.count("*").alias("n"), F.coalesce(F.sum((F.col(column) == F.col(place) + first).cast("long")), F.lit(0)).alias("n_equal"))


def estimated_tokens(df: DataFrame, blocks: list[tuple[str, list[str]]], ids: tuple[str, ...] = ("expediente",), dates: str = "fecha") -> Column:
    """A row's length in tokens, estimated: one for each block with a value; per column of it one, the words of its name,
    and for a value one and its words, two more around an id or a date (ten characters of it); for a null one."""
    words = lambda c: F.size(F.filter(F.split(F.trim(c), r"\s+"), lambda w: w != ""))
    total = F.lit(0)
    for _, names in blocks:
        cols = [c for c in names if c in df.columns]
        own = F.lit(1)
        for c in cols:
            value = F.col(f"`{c}`").cast("string")
            marks = 2 * (c in ids) + 2 * (dates in c)
            filled = 1 + marks + words(F.substr(value, F.lit(1), F.lit(10)) if dates in c else value)
            own = own + 1 + len(c.split()) + F.when(value.isNull(), 1).otherwise(filled)
        if cols:
            total = total + F.when(F.coalesce(*[F.col(f"`{c}`").cast("string") for c in cols]).isNotNull(), own).otherwise(0)
    return total


def head_rows(df: DataFrame, n: int, order: list[str], condition: Column | None = None) -> DataFrame:
    """The first n rows, of those that meet a condition, in a total order."""
    return (df.filter(condition) if condition is not None else df).orderBy(*order).limit(n)


def sample_rows(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """n rows without replacement, the same at every run: those of least md5 of key and seed."""
    return df.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(f"|{seed}"))), key).limit(n)


def differing_columns(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Over keys that occur more than once: in how many each column differs, null counting as a value."""
    kinds = [(F.countDistinct(c) + F.max(F.col(c).isNull().cast("int"))).alias(f"k_{c}") for c in columns]
    groups = df.groupBy(key).agg(F.count("*").alias("n"), *kinds).filter("n > 1")
    return groups.agg(F.count("*").alias("n_groups"), *[F.coalesce(F.sum((F.col(f"k_{c}") > 1).cast("long")), F.lit(0)).alias(f"n_{c}") for c in columns])


def key_conflicts(df: DataFrame, key: str, value: str) -> DataFrame:
    """Keys with more than one value, with their values in order."""
    return df.groupBy(key).agg(F.countDistinct(value).alias("n_values"), F.array_join(F.sort_array(F.collect_set(value)), "|").alias("values")).filter("n_values > 1")


def id_gaps(df: DataFrame, column: str, range_size: int = 1 << 20) -> DataFrame:
    """Gaps between consecutive distinct ids.

    Ids are dealt to ranges; gaps inside a range by a window each, gaps between ranges from their ends.
    """
    ids = df.select(F.col(column).alias("id")).filter("id is not null").distinct().withColumn("r", F.floor(F.col("id") / range_size))
    inside = ids.withColumn("before", F.lag("id").over(Window.partitionBy("r").orderBy("id")))
    ends = ids.groupBy("r").agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
    across = ends.select(F.col("lo").alias("id"), F.lag("hi").over(Window.orderBy("r")).alias("before"))
    both = inside.select("id", "before").unionByName(across).filter("id - before > 1")
    return both.select(F.col("before").alias("after_id"), F.col("id").alias("next_id"), (F.col("id") - F.col("before") - 1).alias("n_missing"))


def missing_in_sequence(df: DataFrame, column: str, lo: int, hi: int) -> DataFrame:
    """Numbers of [lo, hi] that the column lacks."""
    return df.sparkSession.range(lo, hi + 1).select(F.col("id").alias("missing")).join(df.select(F.col(column).alias("missing")), "missing", "left_anti")


def missing_between_ends(df: DataFrame, column: str) -> DataFrame:
    """Numbers between the column's least and greatest that it lacks: each gap is found by id_gaps() and dealt out from there."""
    gaps = id_gaps(df, column, GAP_RANGE)
    # a wide gap is cut in spans, so that no single row makes all of it
    spans = F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_missing") - 1) / GAP_RANGE))
    cut = gaps.select("after_id", "next_id", F.explode(spans).alias("span")).withColumn("first", F.col("after_id") + 1 + F.col("span") * GAP_RANGE)
    return cut.select(F.explode(F.sequence(F.col("first"), F.least(F.col("first") + GAP_RANGE, F.col("next_id")) - 1)).alias("missing"))


def cleaning_plan(profile: DataFrame) -> DataFrame:
    """profile (column, dtype): which cleaning a column calls for."""
    name, text = F.lower("column"), F.col("dtype") == "string"
    rule = F.when(text & name.rlike("date|fecha|ts$"), "parse date").when(text & name.rlike("age|edad"), "parse age").when(text, "trim spaces").otherwise("none")
    return profile.withColumn("action", rule)


def imputation_plan(profile: DataFrame) -> DataFrame:
    """profile (column, null_pct): what to do about missing values."""
    rule = F.when(F.lower("column").rlike("(^|_)(id|key)$|key$"), "critical").when(F.col("null_pct") > 80, "drop").when(F.col("null_pct") < 5, "simple").otherwise("advanced")
    return profile.withColumn("plan", rule)


def target_dictionary(profile: DataFrame, blocks: list[tuple[str, str]]) -> DataFrame:
    """profile (column, dtype): semantic block by the first pattern that fits, target name, kind and lineage."""
    block = None
    for pattern, name in blocks:
        hit = F.lower("column").rlike(pattern)
        block = F.when(hit, name) if block is None else block.when(hit, name)
    kind = F.when(F.col("dtype").isin("bigint", "int", "double"), "numeric").when(F.col("dtype").startswith("timestamp"), "temporal").otherwise("categorical")
    target = snake_case(F.col("column"))
    return profile.select("column", block.otherwise("other").alias("block"), target.alias("target"), kind.alias("kind"), F.format_string("%s -> %s", F.col("column"), target).alias("lineage"))


def schema_rows(df: DataFrame) -> DataFrame:
    """(column, dtype) of a table."""
    return df.sparkSession.createDataFrame([(n, t) for n, t in df.dtypes], "column string, dtype string")


def running_offsets(df: DataFrame, group: str) -> DataFrame:
    """Rows of each group and of all groups before it."""
    counts = df.groupBy(group).agg(F.count("*").alias("n"))
    return counts.withColumn("offset", F.sum("n").over(Window.orderBy(group).rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))


def categorical_resume(df: DataFrame, column: str) -> DataFrame:
    """Distinct raw and normalised values, values met once, and whether normalising reduces them; nulls left out."""
    c = F.col(column)
    counts = df.filter(c.isNotNull()).groupBy(c.alias("v")).agg(F.count("*").alias("n"))
    return counts.agg(
        F.count("*").alias("n_raw"), F.countDistinct(F.upper(F.trim("v"))).alias("n_normal"), F.sum((F.col("n") == 1).cast("long")).alias("n_single"),
        (F.countDistinct(F.upper(F.trim("v"))) < F.count("*")).alias("reduces"),
    )


def identifier_composition(df: DataFrame, column: str, sentinel: str = "S/E") -> DataFrame:
    """Rows of an identifier column by kind, and its distinct values."""
    c = F.col(column)
    kind = F.when(c.isNull(), "null").when(c == sentinel, "sentinel").when(c.rlike(r"^\d+\.?0?$"), "numeric").otherwise("other")
    return df.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.countDistinct(c).alias("n_distinct"))
