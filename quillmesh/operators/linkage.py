"""Record linkage: candidate pairs, the classification cascade, review decisions, entities and splits.

Records are (record_id, source, exp, name, key): a stable id, one of several sources, a file number that may
be null, a name, and its name key. Source order matters for numbering and is the order of record_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.functions.names import spare
from quillmesh.functions.scores import pairs_of
from quillmesh.functions.similarity import jaro_winkler_similarity, levenshtein_similarity
from quillmesh.operators.components import connected_components
from quillmesh.operators.numbering import numbered
from quillmesh.session import ship_package
from quillmesh.storage import Stage

EXACT, METRIC, OPEN, REVIEWED = "exact_key", "classic_metric", "unconfirmed", "manual_review"


def keep_first(df: DataFrame, keys: list[str], order: str = "record_id") -> DataFrame:
    """The row of least `order` for each key; null keys are keys, and one of rows that tie stays."""
    place = spare("place", df.columns)
    return df.withColumn(place, F.row_number().over(Window.partitionBy(*keys).orderBy(order))).filter(F.col(place) == 1).drop(place)


def number_records(df: DataFrame, order: list[str], name: str = "record_id") -> DataFrame:
    """Consecutive ids from 0 in a total order."""
    return numbered(df, [F.col(c) for c in order], name)


def first_seen_ids(df: DataFrame, keys: list[str], name: str = "entity_id", order: str = "record_id") -> DataFrame:
    """Dense numbers of groups in order of their first row; null keys group together.

    Groups are numbered on one row a group, and the numbers joined back, null-safely.
    """
    first = spare("first_row", df.columns)
    groups = numbered(df.groupBy(*keys).agg(F.min(order).alias(first)), [F.col(first)], name).drop(first)
    own = [spare(f"own_{k}", df.columns) for k in keys]
    renamed = groups.select(*[F.col(k).alias(o) for k, o in zip(keys, own, strict=True)], name)
    on = None
    for k, o in zip(keys, own, strict=True):
        same = F.col(k).eqNullSafe(F.col(o))
        on = same if on is None else on & same
    return df.join(renamed, on).drop(*own)


def key_candidates(records: DataFrame) -> DataFrame:
    """Pairs of different sources that share a file number, after keep-first by (file number, source, key)."""
    reps = keep_first(records.filter("exp is not null"), ["exp", "source", "key"]).select("record_id", "source", "exp", "key")
    a, b = reps.alias("a"), reps.alias("b")
    on = (F.col("a.exp") == F.col("b.exp")) & (F.col("a.record_id") < F.col("b.record_id")) & (F.col("a.source") != F.col("b.source"))
    return a.join(b, on).select(
        F.col("a.record_id").alias("id_a"), F.col("b.record_id").alias("id_b"), F.col("a.source").alias("source_a"), F.col("b.source").alias("source_b"),
        F.col("a.key").alias("key_a"), F.col("b.key").alias("key_b"), F.col("a.exp").alias("exp_shared"), F.lit(False).alias("null_exp"),
    )


def null_key_candidates(records: DataFrame, source: str) -> DataFrame:
    """Records of one source without a file number, paired by name key with the first record of each other source."""
    left = records.filter((F.col("source") == source) & F.col("exp").isNull() & (F.col("key") != "")).alias("a")
    right = keep_first(records.filter(F.col("source") != source), ["source", "key"]).alias("b")
    return left.join(right, F.col("a.key") == F.col("b.key")).select(
        F.col("a.record_id").alias("id_a"), F.col("b.record_id").alias("id_b"), F.col("a.source").alias("source_a"), F.col("b.source").alias("source_b"),
        F.col("a.key").alias("key_a"), F.col("b.key").alias("key_b"), F.lit(None).cast("long").alias("exp_shared"), F.lit(True).alias("null_exp"),
    )


def candidate_pairs(records: DataFrame, null_source: str) -> DataFrame:
    return key_candidates(records).unionByName(null_key_candidates(records, null_source))


LEAST_JW, LEAST_LEV = 0.88, 0.85


def scored_pairs(pairs: DataFrame, undecided_only: bool = False, least_jw: float = LEAST_JW, least_lev: float = LEAST_LEV) -> DataFrame:
    """Jaro-Winkler and Levenshtein similarity of the keys, rounded to nine places, in one pass over the pairs.

    Equal keys need no Python. With undecided_only, jw is null also where classify() does without: for pairs without
    a file number, where lev is enough, and where the keys' lengths and first letters keep jw under least_jw.
    """
    ship_package(pairs.sparkSession)
    a, b = F.col("key_a"), F.col("key_b")
    pairs = pairs.withColumn("lev", F.round(levenshtein_similarity(a, b), 9))
    open_ = ~((a == b) & (a != ""))
    if undecided_only:
        short, long = F.least(F.char_length(a), F.char_length(b)), F.greatest(F.char_length(a), F.char_length(b))
        jaro = (2 + short / F.greatest(long, F.lit(1))) / 3
        lead = sum(((F.substr(a, F.lit(1), F.lit(k)) == F.substr(b, F.lit(1), F.lit(k))) & (short >= k)).cast("int") for k in range(1, 5))
        open_ = open_ & ~F.col("null_exp") & (F.col("lev") < least_lev) & (jaro + 0.1 * lead * (1 - jaro) >= least_jw - 1e-6)
    jw = F.round(jaro_winkler_similarity(F.when(open_, a), F.when(open_, b)), 9)
    return pairs.withColumn("jw", F.when((a == b) & (a != ""), F.lit(1.0)).otherwise(jw))


def classify(scored: DataFrame, least_jw: float = LEAST_JW, least_lev: float = LEAST_LEV) -> DataFrame:
    """The cascade: equal keys, then either metric, else unconfirmed; null-key pairs are always unconfirmed."""
    known = ~F.col("null_exp")
    criterion = (
        F.when(known & (F.col("key_a") == F.col("key_b")), EXACT)
        .when(known & (F.coalesce(F.col("jw") >= least_jw, F.lit(False)) | (F.col("lev") >= least_lev)), METRIC)
        .otherwise(OPEN)
    )
    return scored.withColumn("criterion", criterion)


def review_state(criterion: Column, decision: Column) -> Column:
    """How a row of the review table is marked."""
    blank = F.coalesce(F.trim(decision), F.lit("")) == ""
    return (
        F.when(decision == "match", "green").when(decision == "no_match", "red")
        .when(blank & criterion.isin(EXACT, METRIC), "green").when(blank & (criterion == OPEN), "yellow").otherwise("none")
    )


def is_positive(criterion: Column, decision: Column) -> Column:
    """Precedence: a decision first, then the automatic criteria."""
    blank = F.coalesce(F.trim(decision), F.lit("")) == ""
    return F.coalesce(decision == "match", F.lit(False)) | (blank & criterion.isin(EXACT, METRIC))


def settle(reviewed: DataFrame) -> DataFrame:
    """States after finalising: automatic pairs become matches, decided open pairs manual reviews."""
    blank = F.coalesce(F.trim("decision"), F.lit("")) == ""
    auto = F.col("criterion").isin(EXACT, METRIC)
    return reviewed.withColumns({
        "decision": F.when(auto & blank, "match").otherwise(F.col("decision")),
        "criterion": F.when((F.col("criterion") == OPEN) & ~blank, REVIEWED).otherwise(F.col("criterion")),
    })


def merge_decisions(new: DataFrame, old: DataFrame) -> DataFrame:
    """Earlier decisions win where they are not blank."""
    name = spare("old_decision", new.columns)
    was = old.select("id_a", "id_b", F.col("decision").alias(name))
    return new.join(was, ["id_a", "id_b"], "left").withColumn("decision", F.coalesce(F.nullif(F.trim(name), F.lit("")), F.col("decision"))).drop(name)


def merge_report(new: DataFrame, old: DataFrame) -> DataFrame:
    """One row: pairs of the old and new review table, pairs lost and new, decisions copied, filled and open after merging."""
    pair = ["id_a", "id_b"]
    filled = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    both = old.select(*pair, F.col("decision").alias("was"), F.lit(True).alias("in_old")).join(new.select(*pair, "decision", F.lit(True).alias("in_new")), pair, "full")
    one = lambda c: F.coalesce(F.sum(F.coalesce(c, F.lit(False)).cast("long")), F.lit(0))
    here, there = F.col("in_new").isNotNull(), F.col("in_old").isNotNull()
    after = filled(F.col("was")) | filled(F.col("decision"))
    return both.agg(
        one(there).alias("n_old"), one(here).alias("n_new"), one(there & ~here).alias("n_lost"), one(here & ~there).alias("n_added"),
        one(here & there & filled(F.col("was"))).alias("n_copied"), one(here & after).alias("n_filled"), one(here & ~after).alias("n_open"),
    )


def star_edges(records: DataFrame) -> DataFrame:
    """Edges from the first record of (source, file number, key) to each other one."""
    known = records.filter("exp is not null and key <> ''").select("source", "exp", "key", "record_id")
    first = known.groupBy("source", "exp", "key").agg(F.min("record_id").alias("src"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return known.join(first, ["source", "exp", "key"]).filter("src <> record_id").select("src", F.col("record_id").alias("dst"))


def entities(records: DataFrame, edges: DataFrame) -> DataFrame:
    """(record_id, root, entity_id): components, singletons included, numbered in order of their first record.

    Roots are least record ids, so the numbering sorts one row an entity.
    """
    comp = connected_components(edges.select("src", "dst"), "src", "dst").toDF("record_id", "component")
    rooted = records.select("record_id").join(comp, "record_id", "left").select("record_id", F.coalesce("component", "record_id").alias("root"))
    rooted = Stage(records.sparkSession, "entities").put(rooted, "rooted")
    ids = numbered(rooted.select("root").distinct(), [F.col("root")], "entity_id")
    return rooted.join(ids, "root").select("record_id", "root", "entity_id")


def size_class(n: Column) -> Column:
    return F.when(n == 1, "singleton").when(n == 2, "pair").when(n == 3, "triad").otherwise("larger")


def natural_pairs(tagged: DataFrame) -> DataFrame:
    """Cross-source pairs inside an entity; source_a < source_b."""
    a, b = tagged.alias("a"), tagged.alias("b")
    return a.join(b, (F.col("a.entity_id") == F.col("b.entity_id")) & (F.col("a.source") < F.col("b.source"))).select(
        F.col("a.entity_id"), F.col("a.record_id").alias("id_a"), F.col("b.record_id").alias("id_b"), F.col("a.source").alias("source_a"), F.col("b.source").alias("source_b")
    )


def linkable(tagged: DataFrame, other: bool = False) -> DataFrame:
    """Records whose entity has two sources or more; or the others."""
    many = tagged.groupBy("entity_id").agg(F.countDistinct("source").alias("n")).filter("n >= 2")
    return tagged.join(many, "entity_id", "left_anti" if other else "left_semi")


def split_entities(tagged: DataFrame, train: float = 0.70, val: float = 0.15, seed: int = 42) -> DataFrame:
    """Records with a split by entity, stratified by linkable or not: floors for train and val, the rest test."""
    if train + val > 1:
        raise ValueError("shares exceed 1")
    kinds = tagged.groupBy("entity_id").agg((F.countDistinct("source") >= 2).alias("linkable"))
    order = F.md5(F.concat(F.col("entity_id").cast("string"), F.lit(f"|{seed}")))
    ranked = numbered(kinds.withColumn("order", order), [F.col("linkable"), F.col("order"), F.col("entity_id")], "place")
    # two rows: what each kind holds, and where it begins
    sizes = ranked.groupBy("linkable").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    ranked = ranked.join(F.broadcast(sizes), "linkable").withColumn("rn", F.col("place") - F.col("first") + 1)
    n_train, n_val = F.floor(F.col("n") * train), F.floor(F.col("n") * val)
    split = F.when(F.col("rn") <= n_train, "train").when(F.col("rn") <= n_train + n_val, "val").otherwise("test")
    return tagged.join(ranked.select("entity_id", "linkable", split.alias("split")), "entity_id")


def split_statistics(split: DataFrame) -> DataFrame:
    own = split.groupBy("split", "entity_id", "linkable").agg(F.count("*").alias("n"), F.countDistinct("source").alias("s"))
    return own.groupBy("split").agg(
        F.sum(F.col("linkable").cast("long")).alias("n_linkable"), F.sum((~F.col("linkable")).cast("long")).alias("n_singleton"), F.count("*").alias("n_entities"),
        F.sum("n").alias("n_records"), F.sum(pairs_of(F.col("s"))).alias("n_natural_pairs"),
    )


def source_regions(tagged: DataFrame, sources: tuple[str, ...] = ("A", "B", "C")) -> DataFrame:
    """Entities by the exact set of sources they occur in."""
    flags = tagged.groupBy("entity_id").agg(*[F.max((F.col("source") == s).cast("int")).alias(s) for s in sources])
    name = F.array_join(F.filter(F.array(*[F.when(F.col(s) == 1, s).otherwise("") for s in sources]), lambda x: x != ""), "+")
    return flags.select(name.alias("region")).groupBy("region").agg(F.count("*").alias("n_entities"))


def region_total(regions: DataFrame) -> DataFrame:
    """Entities in any source: the sum over source_regions(), whose regions exclude one another."""
    return regions.agg(F.coalesce(F.sum("n_entities"), F.lit(0)).alias("n_entities"))


def space_totals(records: DataFrame, space: DataFrame) -> DataFrame:
    """One row over pair_space(): records, all unordered pairs of them, pairs of different sources, and shared file numbers."""
    n = records.agg(F.count("*").alias("n_records")).withColumn("n_pairs", pairs_of(F.col("n_records")))
    sums = space.agg(F.coalesce(F.sum("space"), F.lit(0)).alias("n_cross_pairs"), F.coalesce(F.sum("shared_keys"), F.lit(0)).alias("n_shared_keys"))
    return n.crossJoin(sums)  # one row each


def residual_entity_pairs(tagged: DataFrame) -> DataFrame:
    """One row: pairs of different sources that share a file number, by entity and not by record, and those of them in two entities."""
    one = tagged.filter("exp is not null").groupBy("exp", "source", "entity_id").agg(F.min("record_id").alias("record_id"))
    a, b = one.alias("a"), one.alias("b")
    both = a.join(b, (F.col("a.exp") == F.col("b.exp")) & (F.col("a.record_id") < F.col("b.record_id")) & (F.col("a.source") != F.col("b.source")))
    return both.agg(F.count("*").alias("n_same_key"), F.coalesce(F.sum((F.col("a.entity_id") != F.col("b.entity_id")).cast("long")), F.lit(0)).alias("n_residual"))


def pair_index(scored: DataFrame) -> DataFrame:
    """scored (id_a, id_b, jw, lev) with the lesser id first, one row an unordered pair: of several, the least scores."""
    return scored.groupBy(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b")).agg(F.min("jw").alias("jw"), F.min("lev").alias("lev"))


def pair_space(records: DataFrame) -> DataFrame:
    """For each two sources: records of both, all pairs, and file numbers that both hold."""
    counts = records.groupBy("source").agg(F.count("*").alias("n"))
    keys = records.filter("exp is not null").select("source", "exp").distinct()
    a, b = counts.alias("a"), counts.alias("b")
    both = a.join(b, F.col("a.source") < F.col("b.source")).select(F.col("a.source").alias("source_a"), F.col("b.source").alias("source_b"), (F.col("a.n") * F.col("b.n")).alias("space"))
    shared = keys.alias("x").join(keys.alias("y"), (F.col("x.exp") == F.col("y.exp")) & (F.col("x.source") < F.col("y.source")))
    shared = shared.groupBy(F.col("x.source").alias("source_a"), F.col("y.source").alias("source_b")).agg(F.count("*").alias("shared_keys"))
    return both.join(shared, ["source_a", "source_b"], "left").withColumn("shared_keys", F.coalesce("shared_keys", F.lit(0)))


def cascade_by_cross(reviewed: DataFrame) -> DataFrame:
    """Counts by two sources and outcome; an open pair without a decision counts as a manual match."""
    blank = F.coalesce(F.trim("decision"), F.lit("")) == ""
    one = lambda cond: F.sum(cond.cast("long"))
    open_ = F.col("criterion") == OPEN
    yes = open_ & (blank | (F.col("decision") == "match"))
    return reviewed.groupBy("source_a", "source_b").agg(
        one(F.col("criterion") == EXACT).alias("n_exact"), one(F.col("criterion") == METRIC).alias("n_metric"), one(yes).alias("n_review_match"),
        one(open_ & ~blank & (F.col("decision") == "no_match")).alias("n_review_no_match"), F.count("*").alias("n_candidates"), one(~open_ | yes).alias("n_positive"),
    )


def manual_review_by_cross(reviewed: DataFrame) -> DataFrame:
    one = lambda cond: F.sum(cond.cast("long"))
    blank = F.coalesce(F.trim("decision"), F.lit("")) == ""
    return reviewed.filter(F.col("criterion") == OPEN).groupBy("source_a", "source_b").agg(
        one(F.coalesce(F.col("decision") == "match", F.lit(False))).alias("n_match"), one(F.coalesce(F.col("decision") == "no_match", F.lit(False))).alias("n_no_match"), one(blank).alias("n_blank")
    )


def null_key_diagnostics(records: DataFrame, source: str) -> DataFrame:
    """Over records of one source without a file number: how many names occur in each other source, or in none."""
    lost = records.filter((F.col("source") == source) & F.col("exp").isNull()).select("record_id", "key")
    others = records.filter(F.col("source") != source).select("key", F.col("source").alias("other")).distinct()
    found = lost.join(others, "key", "left").groupBy("record_id").agg(F.sort_array(F.collect_set("other")).alias("others"))
    return found.select(F.when(F.size("others") == 0, "none").otherwise(F.array_join("others", "+")).alias("found_in")).groupBy("found_in").agg(F.count("*").alias("n"))


def compare_keys(records: DataFrame, old: str, new: str) -> DataFrame:
    """By two sources: pairs that share the file number and each key, and the share of the new ones that are new."""
    a, b = records.alias("a"), records.alias("b")
    pairs = a.join(b, (F.col("a.exp") == F.col("b.exp")) & (F.col("a.source") < F.col("b.source")))
    was, now = F.col(f"a.{old}") == F.col(f"b.{old}"), F.col(f"a.{new}") == F.col(f"b.{new}")
    got = pairs.groupBy(F.col("a.source").alias("source_a"), F.col("b.source").alias("source_b")).agg(
        F.sum(was.cast("long")).alias("n_old"), F.sum(now.cast("long")).alias("n_new"), F.sum((now & ~was).cast("long")).alias("n_gained"), F.sum((was & ~now).cast("long")).alias("n_lost"),
    )
    return got.withColumn("pct_gained", F.round(100 * F.col("n_gained") / F.greatest("n_new", F.lit(1)), 4))


def display_clusters(tagged: DataFrame) -> DataFrame:
    """Entities of exactly three records, one of each of three sources."""
    return tagged.groupBy("entity_id").agg(F.count("*").alias("n"), F.countDistinct("source").alias("s"), F.min("record_id").alias("first_record")).filter("n = 3 and s = 3").select("entity_id", "first_record")
