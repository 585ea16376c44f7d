"""N-gram Jaccard self-join with rare-first prefix filtering, exact for the threshold.

A text's set is its distinct runs of five words (A-Z lower-cased; a shorter text is one run), as 64-bit
hashes. Runs are ordered rare first by a merged sketch of their counts, then by hash: any order common to
all sets keeps prefix filtering lossless, so the sketch's size (by the input, up to max_cells / 2 bytes) bounds
only speed. Two sets that reach the threshold share a run among the first n - ceil(0.8 n) + 1 of each; runs that
the sketch, which never estimates too low, shows in one text only are not dealt.

1. Equal sets are one node; only nodes go on, so copies never meet pair by pair.
2. Prefix runs are dealt by run and sorted; a run met once is dropped, in streams of constant memory.
3. Each set is first verified against one partner, the earlier set it shares most prefix runs with.
   This links large groups of near copies by a linear number of pairs.
4. Where a run still holds several components, the sets outside its largest component meet all others of
   the run, under length, positional and suffix filters. Pairs inside a component add nothing and are
   never formed, so a large group costs (sets outside its main component) x (its size) at most.
5. Each remaining pair is verified once on whole sets, and components are taken over verified links.

The suffix filter bounds the sets' difference from below by the hash ranges, of 1,024, that an odd number of
hashes of one set and an even number of the other fall into.

Cases: null or empty texts and texts without words have empty sets, link with nothing and are their own
component; repeated rows, and rows that share a doc_id but not the text, are judged row by row; a row with a
null doc_id represents nothing and gets the component of an equal text that has an id, else null; columns
other than doc_id and text are ignored; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.tokens import VALUES_LOWER, gram_hashes, grams_inside, text_groups, word_bounds, word_hashes
from quillmesh.operators.components import connected_components
from quillmesh.session import ship_package
from quillmesh.storage import Stage

RUN = 5
MAX_CELLS = 1 << 28
BLOCK = 1 << 20
FLUSH = 1 << 22
#: Least counts of the sketch's codes 1 to 15; code 1 is a single text's run for certain.
STEPS = np.array([1, 2, 3, 4, 5, 6, 8, 12, 18, 32, 64, 128, 512, 2048, 16384])
RANGES = 1024
MEMBERS = 512
ROUNDS = 8


def text_sets(batches: Iterator[pa.RecordBatch], run: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Slices of rows with the sorted distinct run hashes of each text."""
    for rows, data, bounds in text_groups(batches):
        starts, ends, counts = word_bounds(data, bounds)
        words = word_hashes(data, starts, ends, VALUES_LOWER)
        index, text, _ = grams_inside(counts, run)
        grams = gram_hashes(words, run)[index]
        cuts = np.searchsorted(text, np.arange(len(counts) + 1))
        first = np.cumsum(counts) - counts
        sets = []
        for i, n in enumerate(counts):
            if n >= run:
                sets.append(np.unique(grams[cuts[i] : cuts[i + 1]]))
            elif n:
                sets.append(gram_hashes(words[first[i] : first[i] + n], int(n), seed=int(n)))
            else:
                sets.append(grams[:0])
        yield rows, sets


def _sketch_rows(run: int, bits: int):
    """The cells of each task's runs, as one row a block of cells."""
    size = min(BLOCK, 1 << bits)

    def emit(held: list[np.ndarray]) -> pa.RecordBatch:
        cells = np.sort(np.concatenate(held) >> np.uint64(64 - bits))
        cuts = np.searchsorted(cells, np.arange((1 << bits) // size + 1, dtype=np.uint64) * np.uint64(size))
        full = np.flatnonzero(np.diff(cuts))
        blobs = [(cells[cuts[b] : cuts[b + 1]] % np.uint64(size)).astype(np.uint32).tobytes() for b in full]
        return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(blobs, pa.binary())], names=["block", "cells"])

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for _, sets in text_sets(batches, run):
            held += sets
            n += sum(map(len, sets))
            if n >= FLUSH:
                yield emit(held)
                held, n = [], 0
        if n:
            yield emit(held)

    return sketch


def _merge_rows(size: int):
    """Sums of blocks of cells, as 4-bit codes of the counts' magnitude."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, cells in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = sums.setdefault(block, np.zeros(size, np.uint32))
                cell, n = np.unique(np.frombuffer(cells.as_buffer(), np.uint32), return_counts=True)
                own[cell] += n.astype(np.uint32)
        for block, counts in sums.items():
            codes = np.searchsorted(STEPS, counts, side="right").astype(np.uint8)
            packed = codes[0::2] | (codes[1::2] << np.uint8(4))
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([packed.tobytes()], pa.binary())], names=["block", "codes"])

    return merge


def sketch_bits(docs: DataFrame, max_cells: int) -> int:
    """Cells for an input of this size: about one a run, a power of two."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return int(min(max(size * 0.2, 1 << 12), max_cells) - 1).bit_length()


def run_sketch(docs: DataFrame, run: int, bits: int) -> np.ndarray:
    """Codes of all texts' distinct runs' counts, by the leading bits of their hash."""
    size = min(BLOCK, 1 << bits)
    blocks = (1 << bits) // size
    parts = docs.select("text").mapInArrow(_sketch_rows(run, bits), "block int, cells binary")
    merged = parts.repartition(max(16, blocks), "block").mapInArrow(_merge_rows(size), "block int, codes binary")
    out = np.zeros((blocks, size // 2), np.uint8)
    for row in merged.toLocalIterator():
        out[row.block] = np.frombuffer(row.codes, np.uint8)
    return out.ravel()


def codes_of(sketch: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    cell = hashes >> np.uint64(64 - bits)
    return (sketch[cell >> np.uint64(1)] >> ((cell & np.uint64(1)) << np.uint64(2)).astype(np.uint8)) & 15


def _profile_rows(run: int, percent: int, bits: int, sketch, schema: pa.Schema):
    """Of each text: class fingerprint, set size, prefix runs rare first, parities by hash range."""

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sketch.value
        for rows, sets in text_sets(batches, run):
            n = np.array([len(s) for s in sets], np.int64)
            prefix, ranges, low, high = [], [], [], []
            for s in sets:
                if len(s):
                    # n - ceil(percent / 100 * n) + 1 runs, rare first
                    keep = len(s) - (percent * len(s) + 99) // 100 + 1
                    code = codes_of(counts, s, bits)
                    order = np.lexsort((s, code))[:keep]
                    # runs of a single text meet nothing, and keep their places only
                    alone = int(np.count_nonzero(code[order] == 1))
                    prefix.append(np.uint64(alone).tobytes() + s[order[alone:]].tobytes())
                    parity = np.bincount((s & np.uint64(RANGES - 1)).astype(np.int64), minlength=RANGES) & 1
                    ranges.append(np.packbits(parity.astype(bool)).view(np.int64))
                    for out, v in zip((low, high), fingerprint(s), strict=True):
                        out.append(v)
                else:
                    prefix.append(None), ranges.append(None), low.append(None), high.append(None)
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), rows.column(1), pa.array(n), pa.array(low, pa.int64()), pa.array(high, pa.int64()), pa.array(prefix, pa.binary()), pa.array(ranges, pa.list_(pa.int64()))],
                schema=schema,
            )

    return profile


def _posting_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        node, n, prefix = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
        for i in range(0, len(node), 512):
            parts = [np.frombuffer(p.as_buffer(), np.int64) for p in prefix[i : i + 512]]
            skipped = np.array([p[0] for p in parts])
            parts = [p[1:] for p in parts]
            sizes = np.array([len(p) for p in parts])
            pos = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes - skipped, sizes)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(parts)), pa.array(np.repeat(node[i : i + 512], sizes)), pa.array(np.repeat(n[i : i + 512], sizes).astype(np.int32)), pa.array(pos.astype(np.int32))],
                names=["run", "node", "n", "pos"],
            )


def _shared_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From postings sorted by run and size: those of runs met twice or more, with the set before as partner."""
    held: list[np.ndarray] | None = None  # the last row, and whether a row of its run has gone before
    before = False
    prev_node = -1
    for batch in batches:
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(4)]
        if not len(cols[0]):
            continue
        if held is not None:
            cols = [np.concatenate([h, c]) for h, c in zip(held, cols, strict=True)]
        run, node = cols[0], cols[1]
        same = run[1:] == run[:-1]
        last = np.concatenate([[before], same])
        follows = np.concatenate([same, [False]])
        partner = np.concatenate([[prev_node], node[:-1]])
        done = slice(0, len(run) - 1)
        keep = (last | follows)[done]
        yield _shared(cols, partner, last, keep, done)
        held, before, prev_node = [c[-1:].copy() for c in cols], bool(last[-1]), int(partner[-1])
    if held is not None:
        done = slice(0, 1)
        yield _shared(held, np.array([prev_node]), np.array([before]), np.array([before]), done)


def _shared(cols, partner, last, keep, done) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c[done][keep]) for c in cols] + [pa.array(partner[done][keep].astype(np.int64), mask=~last[done][keep])],
        names=["run", "node", "n", "pos", "partner"],
    )


def _other_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From postings sorted by run: each node with the nearest one before it, in its run, of another component."""
    held: list[np.ndarray] | None = None  # the row before the last row's block, if its run has one, and the last row
    for batch in batches:
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)]
        if not len(cols[0]):
            continue
        seen = 0
        if held is not None:
            seen = len(held[0])
            cols = [np.concatenate([h, c]) for h, c in zip(held, cols, strict=True)]
        run, node, comp = cols
        fresh = np.concatenate([[True], run[1:] != run[:-1]])
        starts = fresh | np.concatenate([[True], comp[1:] != comp[:-1]])
        first = np.flatnonzero(starts)[np.cumsum(starts) - 1]
        has = ~fresh[first]
        at = seen + np.flatnonzero(has[seen:])
        yield pa.RecordBatch.from_arrays([pa.array(node[at]), pa.array(node[first[at] - 1])], names=["node", "partner"])
        end = len(run) - 1
        held = [c[[first[end] - 1, end] if has[end] else [end]] for c in cols]


def _verify_rows(percent: int):
    """From rows (pair centre, salt, doc, is_centre, hashes) sorted so that a centre leads its members: the verified pairs."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, own = None, np.zeros(0, np.uint64)
        for batch in batches:
            a, salt, b, leads = (batch.column(k).to_pylist() for k in range(4))
            links: tuple[list, list, list, list] = ([], [], [], [])
            for i, blob in enumerate(batch.column(4)):
                s = np.frombuffer(blob.as_buffer(), np.uint64)
                if leads[i]:
                    centre, own = (a[i], salt[i]), s
                elif centre == (a[i], salt[i]):
                    where = np.searchsorted(own, s)
                    both = int((own[np.minimum(where, len(own) - 1)] == s).sum())
                    if 100 * both >= percent * (len(own) + len(s) - both):
                        for out, v in zip(links, (a[i], b[i], both, len(own) + len(s) - both), strict=True):
                            out.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in links], names=["a", "b", "both", "either"])

    return verify


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set that depend on all its hashes."""
    total, odd, xor = np.sum(s), np.sum(s * (s | np.uint64(1))), np.bitwise_xor.reduce(s)
    return int((total ^ (xor << np.uint64(1))).astype(np.int64)), int(odd.astype(np.int64))


def _set_rows(run: int):
    """The sets of nodes; of rows that share a doc_id, those of the node's own text."""

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, sets in text_sets(batches, run):
            low, high = rows.column(1).to_pylist(), rows.column(2).to_pylist()
            own = [i for i, s in enumerate(sets) if len(s) and fingerprint(s) == (low[i], high[i])]
            yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(own, pa.int64())), pa.array([sets[i].tobytes() for i in own], pa.binary())], names=["node", "hashes"])

    return sets_of


class NgramJoin:
    """The join's tables.

    classes: (doc_id, key, n, node), a row for each input row, key a hash of its text; nodes are the distinct sets.
    reps: (node, rep) with the least doc_id of each. links: verified pairs of nodes (a, b, both, either), of which at
    most one joins two components of a round, so that there are few more than they need. labels: (node, component),
    the least node reachable, for nodes that have links; components: (node, component_id), the least doc_id.
    """

    def __init__(self, docs: DataFrame, run: int = RUN, percent: int = 80, max_cells: int = MAX_CELLS, rounds: int = ROUNDS):
        self.spark, self.run, self.percent, self.max_cells, self.rounds = docs.sparkSession, run, percent, max_cells, rounds
        ship_package(self.spark)
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("key"))
        self.stage = Stage(self.spark, "ngram_join")
        self._profiles()
        self._postings()
        self._sets()
        self.last = False
        self._rounds()
        least = self.labels.join(self.reps.select("node", "rep"), "node").groupBy("component").agg(F.min("rep").alias("component_id"))
        self.components = self.stage.put(self.labels.join(least, "component").select("node", "component_id"), "components")
        self.stage.drop("postings", "sets")

    def _profiles(self) -> None:
        bits = sketch_bits(self.docs, self.max_cells)
        sketch = self.spark.sparkContext.broadcast(run_sketch(self.docs, self.run, bits))
        kind = "doc_id long, key long, n long, low long, high long, prefix binary, ranges array<bigint>"
        schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("n", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("prefix", pa.binary()), ("ranges", pa.list_(pa.int64()))])
        rows = self.docs.select("doc_id", "key", "text").mapInArrow(_profile_rows(self.run, self.percent, bits, sketch, schema), kind)
        profiles = self.stage.put(rows, "profiles")
        sketch.destroy()
        same = ["low", "high", "n"]
        reps = profiles.filter("doc_id is not null and n > 0").groupBy(*same).agg(
            F.min("doc_id").alias("rep"), F.first("prefix").alias("prefix"), F.first("ranges").alias("ranges")
        )
        self.reps = self.stage.put(reps.withColumn("node", F.monotonically_increasing_id()), "reps")
        self.classes = self.stage.put(profiles.select("doc_id", "key", *same).join(self.reps.select(*same, "node"), same, "left").select("doc_id", "key", "n", "node"), "classes")
        self.stage.drop("profiles")

    def _postings(self) -> None:
        """Prefix runs that two or more nodes share."""
        rows = self.reps.select("node", "n", "prefix").mapInArrow(_posting_rows, "run long, node long, n int, pos int")
        dealt = rows.repartition("run").sortWithinPartitions("run", "n", "node")
        self.postings = self.stage.put(dealt.mapInArrow(_shared_rows, "run long, node long, n int, pos int, partner long"), "postings")

    def _sets(self) -> None:
        """Whole sets of the nodes that share a prefix run with another."""
        wanted = self.reps.join(self.postings.select("node").distinct(), "node", "left_semi").select("node", "low", "high", F.col("rep").alias("doc_id"))
        texts = self.docs.join(wanted, "doc_id").select("node", "low", "high", "text")
        self.sets = self.stage.put(texts.mapInArrow(_set_rows(self.run), "node long, hashes binary"), "sets")

    def _rounds(self) -> None:
        """Rounds of one try a node while they link many components, then all pairs that are left."""
        self.labels = self.spark.createDataFrame([], "node long, component long")
        posts, pairs, tried, counts = self.postings, self._one_try(self.postings, None, 1), None, []
        for k in range(1, self.rounds + 2):
            pairs = self.stage.put(pairs, f"tried{k}")
            tried = pairs if tried is None else tried.unionByName(pairs)
            links = self.stage.put(self._spanning(self._verified(pairs)), f"links{k}")
            self.links = links if k == 1 else self.links.unionByName(links)
            counts.append(links.count())
            if counts[-1]:
                self._merge(links, k)
            if self.last:
                break
            posts = self.stage.put(self._mixed(posts), f"mixed{k}")
            self.stage.drop(f"mixed{k - 1}")
            # another round pays while it links a tenth of what the first one did
            self.last = k == self.rounds or counts[-1] * 10 <= counts[0]
            pairs = self._all_pairs(posts, tried) if self.last else self._one_try(posts, tried, k + 1)
        self.stage.drop(*[f"{name}{j}" for name in ("mixed", "tried") for j in range(1, k + 1)])

    def _labelled(self, rows: DataFrame, name: str, label: str) -> DataFrame:
        """rows with the component of the node in the column called name."""
        found = self.labels.toDF(name, label)
        return rows.join(found, name, "left").withColumn(label, F.coalesce(label, name))

    def _spanning(self, links: DataFrame) -> DataFrame:
        """Of the links between two components, one."""
        of = self._labelled(self._labelled(links, "a", "ca"), "b", "cb")
        one = of.groupBy(F.least("ca", "cb").alias("low"), F.greatest("ca", "cb").alias("high")).agg(F.min(F.struct("a", "b", "both", "either")).alias("m"))
        return one.select("m.*")

    def _merge(self, links: DataFrame, k: int) -> None:
        """Components over those that were, joined by new links."""
        of = self._labelled(self._labelled(links, "a", "ca"), "b", "cb")
        moved = connected_components(of.select("ca", "cb"), "ca", "cb").toDF("old", "component")
        # nodes without links so far are their own components
        old = self.labels.select("node", F.col("component").alias("old")).union(moved.select(F.col("old").alias("node"), "old"))
        old = old.groupBy("node").agg(F.min("old").alias("old"))
        labels = old.join(moved, "old", "left").select("node", F.coalesce("component", "old").alias("component"))
        self.labels = self.stage.put(labels, f"labels{k}")
        self.stage.drop(f"labels{k - 1}")

    def _mixed(self, posts: DataFrame) -> DataFrame:
        """The postings of runs that still hold several components."""
        posts = self._labelled(posts.select("run", "node", "n", "pos"), "node", "comp")
        several = posts.groupBy("run").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("run")
        return posts.join(several, "run", "left_semi")

    def _bounded(self, pairs: DataFrame) -> DataFrame:
        """Length and suffix filters, on pairs (a, b)."""
        size = self.reps.select("node", "n", "ranges")
        both = pairs.join(size.toDF("a", "na", "ra"), "a").join(size.toDF("b", "nb", "rb"), "b")
        return both.filter(self._fits("na", "nb", "ra", "rb")).select("a", "b")

    def _fits(self, na: str, nb: str, ra: str, rb: str) -> Column:
        """Whether sizes and parities by hash range leave room for the threshold."""
        a, b, p = F.col(na), F.col(nb), self.percent
        differ = sum((F.bit_count(F.get(ra, F.lit(k)).bitwiseXOR(F.get(rb, F.lit(k)))) for k in range(RANGES // 64)), F.lit(0))
        return (F.least(a, b) * 100 >= F.greatest(a, b) * p) & ((a + b - differ) * (100 + p) >= (a + b) * (2 * p))

    def _one_try(self, posts: DataFrame, tried: DataFrame | None, k: int) -> DataFrame:
        """Each node with the one, of those that stand before it in its runs and in another component, that does so most often."""
        if tried is None:
            near = posts.filter("partner is not null").select("node", "partner")
        else:
            dealt = posts.select("run", "node", "comp").repartition("run").sortWithinPartitions("run", F.xxhash64("node", F.lit(k)), "node")
            near = dealt.mapInArrow(_other_rows, "node long, partner long")
        votes = near.groupBy(F.least("node", "partner").alias("a"), F.greatest("node", "partner").alias("b"), "node").agg(F.count("*").alias("votes"))
        if tried is not None:
            votes = votes.join(tried, ["a", "b"], "left_anti")
        best = votes.groupBy("node").agg(F.max(F.struct("votes", "a", "b")).alias("m"))
        return self._bounded(best.select("m.a", "m.b").distinct())

    def _all_pairs(self, posts: DataFrame, tried: DataFrame) -> DataFrame:
        """Pairs of one run and different components that were not tried, after the positional filter."""
        sizes = posts.groupBy("run", "comp").count()
        main = sizes.groupBy("run").agg(F.max(F.struct("count", "comp")).alias("m")).select("run", F.col("m.comp").alias("main"))
        post = posts.join(main, "run").join(self.reps.select("node", "ranges"), "node")
        a, b = post.filter("comp <> main").alias("a"), post.alias("b")
        na, nb, at_a, at_b = F.col("a.n"), F.col("b.n"), F.col("a.pos"), F.col("b.pos")
        p = self.percent
        # a pair that reaches its least overlap shares a run that early in both sets
        reach = F.least(na - at_a, nb - at_b)
        pairs = a.join(
            b,
            (F.col("a.run") == F.col("b.run")) & (F.col("a.comp") != F.col("b.comp")) & ((F.col("b.comp") == F.col("b.main")) | (F.col("a.node") < F.col("b.node")))
            & (reach * (100 + p) >= (na + nb) * p) & self._fits("a.n", "b.n", "a.ranges", "b.ranges"),
        )
        return pairs.select(F.least("a.node", "b.node").alias("a"), F.greatest("a.node", "b.node").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")

    def _verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs that reach the threshold; centres with many partners are dealt to several groups."""
        salts = pairs.groupBy("a").agg(F.ceil(F.count("*") / F.lit(MEMBERS)).cast("int").alias("salts"))
        member = pairs.join(salts, "a").select("a", F.expr("pmod(xxhash64(b), salts)").cast("int").alias("salt"), F.col("b").alias("node"), F.lit(False).alias("leads"))
        centre = salts.select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("a").alias("node"), F.lit(True).alias("leads"))
        rows = member.union(centre).join(self.sets, "node").select("a", "salt", "node", "leads", "hashes")
        dealt = rows.repartition("a", "salt").sortWithinPartitions("a", "salt", F.desc("leads"), "node")
        return dealt.mapInArrow(_verify_rows(self.percent), "a long, b long, both long, either long")

    def membership(self) -> DataFrame:
        """(doc_id, n_shingles, component_id), a row for each input row."""
        least = self.reps.select("node", "rep").join(self.components, "node", "left").select("node", F.coalesce("component_id", "rep").alias("component_id"))
        return self.classes.join(least, "node", "left").select(
            "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
        )

    def survivors(self) -> DataFrame:
        """(doc_id, key): of each component the row of least doc_id, then least key; every row whose set is empty. Without null doc_ids."""
        rows = self.classes.filter("doc_id is not null")
        kept = self._labelled(rows.filter("n > 0"), "node", "comp").groupBy("comp").agg(F.min(F.struct("doc_id", "key")).alias("m")).select("m.*")
        return kept.union(rows.filter("n = 0").select("doc_id", "key").distinct())


def op8_query(spark, sf_dir: str) -> DataFrame:
    """Set size and component of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return NgramJoin(docs).membership().select("doc_id", "n_shingles", "component_id")


OP8_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, q.c AS component_id
FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id JOIN (SELECT a, min(b) AS c FROM r GROUP BY a) q ON q.a = d.doc_id
"""
