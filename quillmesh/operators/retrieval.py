"""Retrieval over embeddings: blocked top-K, ranking metrics, separability, hard-pair mining."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.functions.similarity import dot
from quillmesh.session import ship_package
from quillmesh.storage import Stage

BLOCK_ROWS = 4096
CHUNK_ROWS = 8192
#: Queries whose similarities with a chunk are held at once; chunks that a task holds; records of one entity that are paired with as many.
STRIP_ROWS, HELD_CHUNKS, PAIR_ROWS = 256, 32, 4096


def _chunks(pool: DataFrame) -> int:
    """Chunks of a pool, of CHUNK_ROWS vectors on average; a chunk is one row of a task."""
    return max(1, -(-pool.count() // CHUNK_ROWS))


def _vectors(rows: pa.StructArray, k: int) -> np.ndarray:
    return rows.field(k).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), -1)


class _Best:
    """The k best candidates so far of each query of a block, by (similarity rounded to nine places down, id)."""

    def __init__(self, rows: pa.StructArray, k: int, skip_self: bool):
        self.ids, self.q, self.k, self.skip_self = rows.field(0).to_numpy(), _vectors(rows, 1), k, skip_self
        self.sim, self.dot, self.cand = np.full((len(rows), k), -np.inf), np.zeros((len(rows), k)), None

    def meet(self, cid: np.ndarray, c: np.ndarray) -> None:
        if self.cand is None:
            self.cand = np.zeros(self.sim.shape, cid.dtype)
        for at in range(0, len(self.ids), STRIP_ROWS):
            own = slice(at, at + STRIP_ROWS)
            raw = self.q[own] @ c.T
            raw[~np.isfinite(raw)] = -np.inf
            if self.skip_self:
                raw[self.ids[own][:, None] == cid[None, :]] = -np.inf
            least = self.sim[own, -1]
            if len(cid) > self.k and np.isneginf(least).any():
                least = np.maximum(least, np.partition(raw, len(cid) - self.k, axis=1)[:, len(cid) - self.k])
            r, j = np.nonzero((raw >= least[:, None] - 1e-8) & (raw > -np.inf))  # rounding moves a similarity by less
            if not len(r):
                continue
            old = np.repeat(np.arange(len(raw)), self.k)
            row = np.concatenate([old, r])
            dot = np.concatenate([self.dot[own].ravel(), raw[r, j]])
            sim = np.concatenate([self.sim[own].ravel(), np.round(raw[r, j], 9)])
            cand = np.concatenate([self.cand[own].ravel(), cid[j]])
            order = np.lexsort((cand, -sim, row))
            first = np.searchsorted(row[order], np.arange(len(raw)))
            keep = order[(first[:, None] + np.arange(self.k)[None, :]).ravel()]  # each row has k at least
            for held, got in ((self.sim, sim), (self.dot, dot), (self.cand, cand)):
                held[own] = got[keep].reshape(-1, self.k)

    def batch(self) -> pa.RecordBatch:
        ok = np.isfinite(self.sim).ravel()
        return pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(self.ids, self.k)[ok]), pa.array(self.cand.ravel()[ok]), pa.array(self.sim.ravel()[ok]), pa.array(self.dot.ravel()[ok])], names=["query_id", "cand_id", "sim", "dot"]
        )


def top_k(queries: DataFrame, pool: DataFrame, k: int, block_rows: int = BLOCK_ROWS, skip_self: bool = True, exact: bool = False) -> DataFrame:
    """(query_id, cand_id, sim, rank): the k most similar candidates of each query by dot product, ties by id.

    Both inputs are (id, embedding) of one width, without nulls. Queries are the stated set: they are dealt to
    blocks, the pool to chunks, and both written. Each task reads a block and up to HELD_CHUNKS chunks from the written
    tables, so nothing is shuffled or broadcast and no pair list is formed; it keeps k candidates a query, and
    a second pass keeps k of those. With exact there is a column `dot`, the similarity before rounding.
    """
    spark = queries.sparkSession
    ship_package(spark)
    n_blocks, n_chunks = max(1, -(-queries.count() // block_rows)), _chunks(pool)
    blocks = queries.select("id", "embedding").withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int"))
    chunks = pool.select("id", "embedding").withColumn("chunk", F.pmod(F.xxhash64("id", F.lit(7)), F.lit(n_chunks)).cast("int"))
    stage = Stage(spark, "top_k")
    blocks = stage.put(blocks.groupBy("block").agg(F.collect_list(F.struct("id", "embedding")).alias("rows")).repartition(n_blocks), "blocks")
    chunks = stage.put(chunks.groupBy("chunk").agg(F.collect_list(F.struct("id", "embedding")).alias("cands")).repartition(n_chunks), "chunks")
    # each partition of blocks meets each of chunks; a block meets all chunks of a task before the next block
    pairs = blocks.join(chunks.select("cands").coalesce(-(-n_chunks // HELD_CHUNKS)).hint("shuffle_replicate_nl")).select("block", "rows", "cands")

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, None
        for batch in batches:
            for block, rows, cands in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                if block != at:
                    if held:
                        yield held.batch()
                    at, held = block, _Best(rows.values, k, skip_self)
                held.meet(cands.values.field(0).to_numpy(), _vectors(cands.values, 1))
        if held:
            yield held.batch()

    kind = f"query_id {queries.schema['id'].dataType.simpleString()}, cand_id {pool.schema['id'].dataType.simpleString()}, sim double, dot double"
    found = pairs.mapInArrow(best, kind)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("sim"), "cand_id"))
    return (found if exact else found.drop("dot")).withColumn("rank", rank).filter(F.col("rank") <= k)


def metrics_at_k(ranked: DataFrame, entities: DataFrame, queries: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """(k, hit, recall, recall_norm, precision), means over all queries; queries without a positive count as 0.

    ranked: top_k() with at least max(ks) a query; entities: (id, entity) of queries and candidates.
    """
    ent = entities.select("id", "entity")
    tagged = ranked.join(ent.toDF("query_id", "qe"), "query_id").join(ent.toDF("cand_id", "ce"), "cand_id")
    hits = tagged.filter("qe = ce").select("query_id", "rank")
    positives = queries.select("id").join(ent, "id").select(F.col("id").alias("query_id"), "entity").join(
        ent.groupBy("entity").agg((F.count("*") - 1).alias("n_pos")), "entity"
    )
    grid = positives.filter("n_pos > 0").withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))
    found = grid.join(hits, (grid["query_id"] == hits["query_id"]) & (F.col("rank") <= F.col("k")), "left").groupBy(grid["query_id"], "k", "n_pos").agg(F.count("rank").alias("h"))
    total = queries.agg(F.count("*").alias("n"))
    mean = lambda c: F.round(F.sum(c) / F.first("n"), 4)
    return found.crossJoin(total).groupBy("k").agg(
        mean((F.col("h") > 0).cast("double")).alias("hit"), mean(F.col("h") / F.col("n_pos")).alias("recall"),
        mean(F.col("h") / F.least("k", "n_pos")).alias("recall_norm"), mean(F.col("h") / F.col("k")).alias("precision"),
    )


def _met_blocks(queries: DataFrame, pool: DataFrame, extra: tuple[str, ...] = (), block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(rows, cands): each chunk of the pool (id, embedding, entity) with each block of queries (these and extra), as in top_k()."""
    n_blocks = max(1, -(-queries.count() // block_rows))
    blocks = queries.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int"))
    packed = blocks.groupBy("block").agg(F.collect_list(F.struct("id", "embedding", "entity", *extra)).alias("rows"))
    chunk = pool.withColumn("chunk", F.pmod(F.xxhash64("id", F.lit(7)), F.lit(_chunks(pool))).cast("int"))
    chunks = chunk.groupBy("chunk").agg(F.collect_list(F.struct("id", "embedding", "entity")).alias("cands"))
    return chunks.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))).join(packed, "block").select("rows", "cands")


def _block_sims(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(rows, query ids, candidate ids, similarities, other, same, known): other is false for a record and itself, known where both have an entity."""
    for batch in batches:
        for rows, cands in zip(batch.column(0), batch.column(1), strict=True):
            rows, cands = rows.values, cands.values
            qid, cid = rows.field(0).to_numpy(zero_copy_only=False), cands.field(0).to_numpy(zero_copy_only=False)
            q = rows.field(1).flatten().to_numpy().astype(np.float64).reshape(len(qid), -1)
            c = cands.field(1).flatten().to_numpy().astype(np.float64).reshape(len(cid), -1)
            qe, ce = rows.field(2), cands.field(2)
            known = qe.is_valid().to_numpy(zero_copy_only=False)[:, None] & ce.is_valid().to_numpy(zero_copy_only=False)[None, :]
            same = qe.to_numpy(zero_copy_only=False)[:, None] == ce.to_numpy(zero_copy_only=False)[None, :]
            yield rows, qid, cid, np.round(q @ c.T, 9), (qid[:, None] != cid[None, :]), same & known, known


def mean_reciprocal_rank(queries: DataFrame, pool: DataFrame) -> DataFrame:
    """The mean over all queries with a positive of 1 / rank of the first in the whole ranking, and their number.

    Both inputs are (id, embedding, entity). A first scan finds each query's best positive, a second counts the
    candidates before it by (similarity down, id); no ranking is kept.
    """
    ids = queries.schema["id"].dataType.simpleString()
    cids = pool.schema["id"].dataType.simpleString()
    queries, pool = queries.select("id", "embedding", "entity"), pool.select("id", "embedding", "entity")

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, qid, cid, sims, other, same, _ in _block_sims(batches):
            at = np.argsort(cid, kind="stable")
            got = np.where((other & same)[:, at], sims[:, at], -np.inf)
            first = got.argmax(axis=1)
            top = got[np.arange(len(qid)), first]
            ok = np.isfinite(top)
            yield pa.RecordBatch.from_arrays([pa.array(qid[ok]), pa.array(cid[at][first[ok]]), pa.array(top[ok])], names=["id", "cand", "top"])

    def before(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, qid, cid, sims, other, _, _ in _block_sims(batches):
            cand, top = rows.field(3).to_numpy(zero_copy_only=False)[:, None], rows.field(4).to_numpy()[:, None]
            ahead = other & (cid[None, :] != cand) & ((sims > top) | ((sims == top) & (cid[None, :] < cand)))
            yield pa.RecordBatch.from_arrays([pa.array(qid), pa.array(ahead.sum(axis=1))], names=["id", "ahead"])

    found = _met_blocks(queries, pool).mapInArrow(best, f"id {ids}, cand {cids}, top double")
    found = found.groupBy("id").agg(F.min(F.struct((-F.col("top")).alias("down"), "cand")).alias("b")).select("id", F.col("b.cand").alias("cand"), (-F.col("b.down")).alias("top"))
    ranked = _met_blocks(queries.join(found, "id"), pool, ("cand", "top")).mapInArrow(before, f"id {ids}, ahead long")
    return ranked.groupBy("id").agg((F.sum("ahead") + 1).alias("r")).agg(F.round(F.avg(1 / F.col("r")), 6).alias("mrr"), F.count("*").alias("n_queries"))


def separability(queries: DataFrame, pool: DataFrame) -> DataFrame:
    """Means and population deviations of similarity inside and between entities, and the means' distance in pooled deviations.

    Over all pairs of both inputs (id, embedding, entity): counts, sums and squares come from one blocked scan.
    """

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, _, sims, other, same, known in _block_sims(batches):
            parts = [sims[other & same], sims[other & known & ~same]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([True, False]), pa.array([len(x) for x in parts]), pa.array([float(x.sum()) for x in parts]), pa.array([float((x * x).sum()) for x in parts])], names=["same", "n", "s", "ss"]
            )

    met = _met_blocks(queries.select("id", "embedding", "entity"), pool.select("id", "embedding", "entity"))
    pick = lambda c, same: F.sum(F.when(F.col("same") == same, F.col(c)))
    of = {"pos": True, "neg": False}
    got = met.mapInArrow(sums, "same boolean, n long, s double, ss double").agg(*[pick(c, same).alias(f"{c}_{name}") for name, same in of.items() for c in ("n", "s", "ss")])
    for name in of:
        n = F.when(F.col(f"n_{name}") > 0, F.col(f"n_{name}"))
        got = got.withColumn(f"mean_{name}", F.col(f"s_{name}") / n)
        got = got.withColumn(f"std_{name}", F.sqrt(F.greatest(F.lit(0.0), F.col(f"ss_{name}") / n - F.col(f"mean_{name}") ** 2)))
    pooled = F.sqrt((F.col("std_pos") ** 2 + F.col("std_neg") ** 2) / 2)
    got = got.withColumn("delta", (F.col("mean_pos") - F.col("mean_neg")) / F.when(pooled > 0, pooled))
    return got.select(*[F.round(c, 6).alias(c) for c in ("mean_pos", "std_pos", "mean_neg", "std_neg", "delta")])


def pool_statistics(entities: DataFrame) -> DataFrame:
    sizes = entities.groupBy("entity").agg(F.count("*").alias("n"))
    return sizes.agg(F.count("*").alias("n_entities"), F.max("n").alias("max_positives"), F.round(F.avg("n"), 6).alias("mean_positives"), F.sum((F.col("n") > 1).cast("long")).alias("n_many"))


def _entity_pairs(records: DataFrame, near: DataFrame) -> DataFrame:
    """(id_a, id_b, similarity): pairs of one entity and different sources that near (entity, id_a, id_b) lacks.

    records are (id, entity, source, embedding). Entities of over PAIR_ROWS records are dealt to blocks. A task has two
    blocks of an entity and forms their pairs in strips, so vectors move once for each block of their entity and never
    with a pair.
    """
    spark = records.sparkSession
    ship_package(spark)
    known = records.filter("entity is not null and source is not null")
    sizes = known.groupBy("entity").agg(F.count("*").alias("n"))
    squares = sizes.agg(F.sum(F.col("n").cast("double") ** 2).alias("s")).first().s or 0
    tasks = int(max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(10_000, 4 * squares // PAIR_ROWS**2)))
    many = sizes.filter(F.col("n") > PAIR_ROWS).select("entity", F.ceil(F.col("n") / PAIR_ROWS).alias("n_blocks"))  # a row for PAIR_ROWS records at most

    def placed(df: DataFrame, *ids: str) -> DataFrame:
        """With n_blocks and, for each id, its block."""
        df = df.join(many, "entity", "left").withColumn("n_blocks", F.coalesce("n_blocks", F.lit(1).cast("long")))
        return df.withColumns({f"block_{c}": F.pmod(F.xxhash64(c), F.col("n_blocks")) for c in ids})

    packed = placed(known.select("id", "entity", "source", "embedding"), "id").groupBy("entity", F.col("block_id").alias("block"), "n_blocks").agg(F.collect_list(F.struct("id", "source", "embedding")).alias("rows"))
    met = packed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)))
    met = met.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")}).repartition(tasks, "entity", "low", "high")
    met = met.groupBy("entity", "low", "high").agg(F.collect_list(F.struct("rows")).alias("blocks")).filter((F.col("low") == F.col("high")) | (F.size("blocks") == 2))
    lists = placed(near, "id_a", "id_b").groupBy("entity", F.least("block_id_a", "block_id_b").alias("low"), F.greatest("block_id_a", "block_id_b").alias("high")).agg(F.collect_list(F.struct("id_a", "id_b")).alias("near"))
    met = met.join(lists, ["entity", "low", "high"], "left").select("blocks", "near")

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blocks, known_near in zip(batch.column(0), batch.column(1), strict=True):
                sides = []
                for one in blocks:
                    rows = one["rows"].values
                    ids = rows.field(0).to_numpy(zero_copy_only=False)
                    by = np.argsort(ids, kind="stable")
                    sides.append((ids[by], rows.field(1).to_numpy(zero_copy_only=False)[by], _vectors(rows, 2)[by]))
                (ids, sources, v), (cids, csources, c) = sides[0], sides[-1]  # a block may meet itself
                if known_near.is_valid:
                    a, b = (known_near.values.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
                    at = lambda x, own: np.minimum(np.searchsorted(own, x), len(own) - 1)
                    there = [(at(x, ids), at(y, cids), x, y) for x, y in ((a, b), (b, a))]
                    skip = np.concatenate([np.stack([i, j], 1)[(ids[i] == x) & (cids[j] == y)] for i, j, x, y in there])
                    skip = skip[np.argsort(skip[:, 0], kind="stable")]
                else:
                    skip = np.zeros((0, 2), np.int64)
                strip = max(1, (1 << 17) // len(cids))
                for k in range(0, len(ids), strip):
                    own = slice(k, k + strip)
                    ok = (sources[own][:, None] != csources[None, :]).astype(bool)
                    if len(sides) == 1:
                        ok &= np.arange(k, k + len(ok))[:, None] < np.arange(len(cids))[None, :]
                    i, j = skip[slice(*np.searchsorted(skip[:, 0], (k, k + len(ok))))].T
                    ok[i - k, j] = False
                    r, j = np.nonzero(ok)
                    x, y = ids[own][r], cids[j]
                    sims = np.round((v[own] @ c.T)[r, j], 6)
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(sims)], names=["id_a", "id_b", "similarity"])

    kind = records.schema["id"].dataType.simpleString()
    return met.mapInArrow(expand, f"id_a {kind}, id_b {kind}, similarity double")


def mine_hard_pairs(ranked: DataFrame, records: DataFrame, max_easy: int = 0, seed: int = 42) -> DataFrame:
    """(id_a, id_b, label, similarity, type) of a split, from the top-K over all its records.

    ranked: top_k(), with exact so that no vector moves with a ranked pair. records: (id, entity, source, embedding)
    of the split's linkable records. Positives are pairs of one entity and different sources: `positive` when either
    ranks the other, else `hard_positive`. Negatives are ranked pairs of different entity and source. With max_easy, so
    many of the `positive` ones stay, the least by a seeded hash. The result has all positives, in an entity about as
    many as the square of its records.
    """
    r = records.select("id", "entity", "source")
    pair = [F.least("query_id", "cand_id").alias("id_a"), F.greatest("query_id", "cand_id").alias("id_b")]
    if "dot" in ranked.columns:
        near = ranked.groupBy(*pair).agg(F.max("dot").alias("dot"))
    else:
        v = records.select("id", "embedding")
        near = ranked.select(*pair).distinct().join(v.toDF("id_a", "va"), "id_a").join(v.toDF("id_b", "vb"), "id_b").select("id_a", "id_b", dot(F.col("va"), F.col("vb")).alias("dot"))
    near = near.join(r.toDF("id_a", "ea", "sa"), "id_a").join(r.toDF("id_b", "eb", "sb"), "id_b").filter("sa <> sb")
    near = Stage(records.sparkSession, "hard_pairs").put(near.select("id_a", "id_b", "ea", (F.col("ea") == F.col("eb")).alias("same"), F.round("dot", 6).alias("similarity")), "near")
    columns = lambda df, label, name: df.select("id_a", "id_b", F.lit(label).alias("label"), "similarity", F.lit(name).alias("type"))
    easy, hard = near.filter("same"), _entity_pairs(records, near.filter("same").select(F.col("ea").alias("entity"), "id_a", "id_b"))
    if max_easy > 0:
        easy = easy.orderBy(F.xxhash64(F.lit(seed), "id_a", "id_b"), "id_a", "id_b").limit(max_easy)
    return columns(easy, 1, "positive").unionByName(columns(hard, 1, "hard_positive")).unionByName(columns(near.filter("not same"), 0, "hard_negative"))


def sanity_margin(pairs: DataFrame, least: float = 0.75) -> DataFrame:
    """pairs (a, b unit vectors, same): mean similarity of paraphrases and of others, their distance, and whether the first reaches `least`."""
    sim = dot(F.col("a"), F.col("b"))
    got = pairs.select("same", sim.alias("sim")).agg(F.avg(F.when(F.col("same"), F.col("sim"))).alias("pos"), F.avg(F.when(~F.col("same"), F.col("sim"))).alias("neg"))
    return got.select(F.round("pos", 6).alias("mean_pos"), F.round("neg", 6).alias("mean_neg"), F.round(F.col("pos") - F.col("neg"), 6).alias("margin"), (F.col("pos") >= least).alias("passed"))


def directional_metrics(vectors: DataFrame, sources: list, k: int = 5) -> DataFrame:
    """Hit and precision at k from each source to each other: queries have their entity in the target source,
    the pool is all of the target's records. vectors: (id, embedding, entity, source); sources: the stated few."""
    out = None
    for a in sources:
        for b in sources:
            if a == b:
                continue
            pool = vectors.filter(F.col("source") == b)
            queries = vectors.filter(F.col("source") == a).join(pool.select("entity").distinct(), "entity", "left_semi")
            ent = vectors.select("id", "entity")
            near = top_k(queries, pool, k).join(ent.toDF("query_id", "qe"), "query_id").join(ent.toDF("cand_id", "ce"), "cand_id")
            hits = near.groupBy("query_id").agg(F.sum((F.col("qe") == F.col("ce")).cast("long")).alias("h"))
            got = hits.agg(F.count("*").alias("n_queries"), F.round(F.avg((F.col("h") > 0).cast("double")), 4).alias("hit"), F.round(F.avg(F.col("h") / k), 4).alias("precision"))
            got = got.select(F.lit(a).alias("source_a"), F.lit(b).alias("source_b"), "n_queries", "hit", "precision")
            out = got if out is None else out.unionAll(got)
    return out
