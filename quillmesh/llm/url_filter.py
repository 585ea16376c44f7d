"""URL filters: fixed rules first, then a path-template tree learned from labelled urls, by DataFrame operations only.

A url's path is cut into segments; segments that vary by their form (numbers, dates, long hex, long or mixed
names) become wildcards, keeping a file ending. Per host the templates form a tree of up to `depth` segments
(deeper ones are folded into the last). Level by level from the host down, sibling branches are merged into a wildcard
where they are statistically alike: a branch with labels whose blocked share differs from its parent's by less than
`z` standard errors, and any branch of a parent with more than `fanout` branches that has fewer than `few`
labels. Branches without labels under a smaller parent stay, and inherit.

Each node's blocked share is smoothed with `prior` pseudo-urls of its parent's share, from the share of all
labelled urls at the root; a template is rejected when the share of its deepest node is at least `reject`.

Counts are aggregated by (host, template) before the tree is built, so a host with a third of all urls is one
row a template; joins back to urls can be split by adaptive execution. Only the root's two sums are one row.

Cases: a null url, or one without `://`, has an empty host and path, no rule, and the verdict of its template
like any other; repeated rows are judged each; no labelled urls gives share 0 everywhere (allow); input columns
that carry an output's name are replaced; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.storage import Stage

#: The rules of the query, (host and path prefix, verdict).
RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]
VARIABLE = r"^(\d+|.{40,}|[0-9a-fA-F-]{16,}|\D*\d\D*\d.*)$"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def url_host(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def matched_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else null. The rules are literals of the plan."""
    rule = verdict = None
    for text, kind in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    return rule, verdict


def template_segments(path: Column, depth: int) -> Column:
    """Segments of a path, those of a varying form as wildcards, and always `depth` of them ('' beyond the end); the last holds all deeper ones too."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    stem = lambda s: F.regexp_replace(s, r"\.[A-Za-z]{1,5}$", "")
    shape = lambda s: F.when(stem(s).rlike(VARIABLE), F.concat(F.lit("*"), F.regexp_extract(s, r"(\.[A-Za-z]{1,5})$", 1))).otherwise(s)
    shaped = F.transform(parts, shape)
    own = [F.coalesce(F.get(shaped, F.lit(k)), F.lit("")) for k in range(depth - 1)]
    return F.array(*own, F.coalesce(F.array_join(F.slice(shaped, depth, F.greatest(F.lit(1), F.size(shaped))), "/"), F.lit("")))


class TemplateTree:
    """Templates of labelled and other urls with their smoothed blocked share."""

    def __init__(self, urls: DataFrame, depth: int = 3, z: float = 1.64, fanout: int = 50, few: int = 5, prior: float = 10.0, stage: Stage | None = None):
        """urls: (host, path, blocked), blocked null where unlabelled."""
        self.depth = depth
        stage = stage or Stage(urls.sparkSession, "templates")
        cols = [f"s{k}" for k in range(depth)]
        split = urls.withColumn("_s", template_segments(F.col("path"), depth)).select("host", *[F.get("_s", F.lit(k)).alias(c) for k, c in enumerate(cols)], "blocked")
        sums = [F.count("*").alias("n"), F.count("blocked").alias("known"), F.coalesce(F.sum(F.col("blocked").cast("long")), F.lit(0)).alias("bad")]
        again = [F.sum(c).alias(c) for c in ("n", "known", "bad")]
        tree = stage.put(split.groupBy("host", *cols).agg(*sums), "counts")
        # merge level by level; raw segments are kept beside the merged ones for the way back
        tree = tree.select("*", *[F.col(c).alias(f"t{k}") for k, c in enumerate(cols)])
        for k in range(depth):
            up = ["host", *[f"t{j}" for j in range(k)]]
            nodes = tree.groupBy(*up, f"t{k}").agg(*again)
            parents = nodes.groupBy(*up).agg(F.count("*").alias("branches"), F.sum("known").alias("p_known"), F.sum("bad").alias("p_bad"))
            share = F.col("p_bad") / F.greatest("p_known", F.lit(1))
            error = F.sqrt(F.greatest(share * (1 - share), F.lit(0.01)) / F.greatest("known", F.lit(1)))
            alike = (F.col("known") >= few) & (F.col("known") < F.col("p_known")) & (F.abs(F.col("bad") / F.greatest("known", F.lit(1)) - share) < z * error)
            crowd = (F.col("branches") > fanout) & (F.col("known") < few)
            merged = nodes.join(parents, up).select(*up, F.col(f"t{k}"), F.when((F.col(f"t{k}") != "") & (alike | crowd), F.lit("*")).otherwise(F.col(f"t{k}")).alias("_to"))
            tree = tree.join(merged, [*up, f"t{k}"]).withColumn(f"t{k}", F.col("_to")).drop("_to")
        tree = stage.put(tree, "merged")
        root = tree.agg((F.coalesce(F.sum("bad"), F.lit(0)) / F.greatest(F.coalesce(F.sum("known"), F.lit(0)), F.lit(1))).alias("share")).first().share
        level = tree.groupBy("host").agg(*again)
        smooth = lambda above: (F.col("bad") + prior * above) / (F.col("known") + prior)
        level = level.select("host", smooth(F.lit(float(root))).alias("share"))
        for k in range(depth):
            up = ["host", *[f"t{j}" for j in range(k)]]
            nodes = tree.groupBy(*up, f"t{k}").agg(*again)
            level = nodes.join(level, up).select(*up, f"t{k}", F.when(F.col(f"t{k}") == "", F.col("share")).otherwise(smooth(F.col("share"))).alias("share"))
        keys = ["host", *[f"t{j}" for j in range(depth)]]
        name = F.concat_ws("/", "host", *[F.when(F.col(f"t{j}") != "", F.col(f"t{j}")) for j in range(depth)])
        self.templates = stage.put(tree.join(level, keys).select("host", *cols, name.alias("template"), "n", "known", "bad", "share"), "templates")

    def judge(self, urls: DataFrame, reject: float = 0.5) -> DataFrame:
        """urls (host, path, ...) with template, share and rejected."""
        cols = [f"s{k}" for k in range(self.depth)]
        keyed = urls.withColumn("_s", template_segments(F.col("path"), self.depth)).withColumns({c: F.get("_s", F.lit(k)) for k, c in enumerate(cols)}).drop("_s")
        found = keyed.join(self.templates.select("host", *cols, "template", "share"), ["host", *cols], "left").drop(*cols)
        return found.withColumn("rejected", F.coalesce(F.col("share") >= reject, F.lit(False)))


def filter_urls(pages: DataFrame, rules=RULES, reject: float = 0.5, **tree) -> DataFrame:
    """pages with host, path, rule, template, share and verdict; urls that a rule fits are the labelled ones."""
    pages = pages.drop("host", "path", "rule", "template", "share", "verdict", "rejected", "_ruled", "blocked")
    parsed = pages.withColumns({"host": url_host(F.col("url")), "path": url_path(F.col("url"))})
    rule, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    ruled = parsed.withColumns({"rule": rule, "_ruled": verdict})
    learned = TemplateTree(ruled.select("host", "path", (F.col("_ruled") == "block").alias("blocked")), **tree)
    judged = learned.judge(ruled, reject)
    return judged.withColumn("verdict", F.coalesce("_ruled", F.when(F.col("rejected"), "block").otherwise("allow"))).drop("_ruled", "rejected")


def op5_query(spark, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page's url."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(pages).select("page_id", "host", "path", "rule", "verdict", "template", "share")
