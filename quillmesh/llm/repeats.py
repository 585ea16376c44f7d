"""Substring dedup: words covered by a window of 35 words that starts anywhere else too are removed.

1. Every window is named by its anchor, the least hash of the 12-word runs inside it (the leftmost if equal).
   Equal windows have equal anchors at different places, and a text has about one anchor per 12 words.
2. Count-min prefilter: each task counts its anchor places in two rows of cells and ships these counters; they are
   summed by blocks of cells, and one bit a cell says whether it was met twice. Estimates are never too low, so a
   window whose anchor is met once by either row is not repeated. A second, coarse bitmap marks anchors that may be
   met `hot` times or more.
3. Tasks first compare the windows of a few megabytes of text among themselves: of equal ones one goes on, known to
   be repeated. The rest is dealt by anchor, up to 24 neighbouring windows a row, sorted, and grouped exactly by
   128 bits of hash; an anchor has fewer than `hot` places, which bounds what a group holds. Windows of hot anchors
   are dealt by their own hash, in groups that keep one row a different window. Marks, a row for each row dealt, go
   back to their texts.

The sketch's cells follow the size of the input, up to max_cells (then estimates get looser and more windows
are grouped exactly; nothing is lost). The broadcast bits are max_cells / 4 bytes and 2 MB at most.

Cases: null or empty texts and texts of fewer than 35 words keep all words (kept is '' without words);
repeated rows are other places, so their windows repeat; windows that overlap themselves count; a null
doc_id stays null, doc_id must be an integer or the text of one; other columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.tokens import gram_hashes, grams_inside, mix, text_groups, word_bounds, word_hashes
from quillmesh.session import ship_package
from quillmesh.storage import Stage

WINDOW, ANCHOR = 35, 12
MAX_CELLS = 1 << 30
BLOCK = 1 << 20
PLACE_BITS = 24
FLUSH = 1 << 22
HOT = 4096
HOT_BITS = 24
#: Windows compared at once, by a task before the shuffle and by a task after it.
AT_ONCE = 1 << 20


def window_anchors(words: np.ndarray, counts: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window starts, index of each window's anchor, hashes of all anchor-length runs) of a group of texts."""
    grams = gram_hashes(words, anchor)
    starts, _, _ = grams_inside(counts, window)
    span = window - anchor + 1
    at = np.empty(len(starts), np.int64)
    mask = np.uint64((1 << PLACE_BITS) - 1)
    lo = 0
    while lo < len(starts):
        base = int(starts[lo])
        hi = int(np.searchsorted(starts, base + (1 << PLACE_BITS) - 2 * span))
        part = grams[base : int(starts[hi - 1]) + span]
        key = (part & ~mask) | np.arange(len(part), dtype=np.uint64)
        short = -len(key) % span
        padded = np.concatenate([key, np.full(short, ~np.uint64(0))]).reshape(-1, span)
        left = np.minimum.accumulate(padded, axis=1).ravel()
        right = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
        where = starts[lo:hi] - base
        least = np.minimum(right[where], left[where + span - 1])
        at[lo:hi] = (least & mask).astype(np.int64) + base
        lo = hi
    return starts, at, grams


def cell_rows(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    """The cell of each hash in both rows of the sketch."""
    shift = np.uint64(64 - bits)
    return [hashes >> shift, (hashes * np.uint64(0xA24BAED4963EE407)) >> shift]


def _sketch_rows(window: int, anchor: int, bits: int):
    """Each task's sketch of its anchor places: (block, cells counted once, other cells with their counts)."""
    size = min(BLOCK, 1 << bits)
    per_row = (1 << bits) // size

    def emit(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        for row, cells in enumerate(cell_rows(np.concatenate(held), bits)):
            cells, n = np.unique(cells, return_counts=True)
            cuts = np.searchsorted(cells, np.arange(per_row + 1, dtype=np.uint64) * np.uint64(size))
            full, once, more = np.flatnonzero(np.diff(cuts)), [], []
            for b in full:
                cell, count = (cells[cuts[b] : cuts[b + 1]] % np.uint64(size)).astype(np.uint32), n[cuts[b] : cuts[b + 1]].astype(np.uint32)
                once.append(cell[count == 1].tobytes()), more.append(np.stack([cell[count > 1], count[count > 1]]).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array((full + row * per_row).astype(np.int32)), pa.array(once, pa.binary()), pa.array(more, pa.binary())], names=["block", "once", "more"])

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size_now = [], 0
        for _, data, bounds in text_groups(batches):
            starts, ends, counts = word_bounds(data, bounds)
            _, at, grams = window_anchors(word_hashes(data, starts, ends), counts, window, anchor)
            if len(at):
                held.append(grams[at[np.concatenate([[True], at[1:] != at[:-1]])]])
                size_now += len(held[-1])
            if size_now >= FLUSH:
                yield from emit(held)
                held, size_now = [], 0
        if size_now:
            yield from emit(held)

    return sketch


def _merge_rows(size: int, per_row: int, coarse: int, hot: int):
    """Sums of the tasks' sketches, as bits: cells met twice, and, for the first row, coarse cells with one met `hot` times."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, once, more in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                counts = sums.setdefault(block, np.zeros(size, np.uint32))
                counts[np.frombuffer(once.as_buffer(), np.uint32)] += 1
                cell, n = np.frombuffer(more.as_buffer(), np.uint32).reshape(2, -1)
                counts[cell] += n
        pack = lambda x: np.packbits(x, bitorder="little").tobytes()
        for block, counts in sums.items():
            often = pack((counts >= hot).reshape(-1, coarse).any(axis=1)) if block < per_row else None
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([pack(counts >= 2)], pa.binary()), pa.array([often], pa.binary())], names=["block", "bits", "often"])

    return merge


def sketch_bits(docs: DataFrame, max_cells: int) -> int:
    """Cells of a sketch row for an input of this size: some twenty for each expected anchor, a power of two."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return int(min(max(size * 0.5, 1 << 16), max_cells) - 1).bit_length()


def repeated_cells(docs: DataFrame, window: int, anchor: int, bits: int, hot: int) -> tuple[np.ndarray, np.ndarray]:
    """Two rows of bits for cells met twice or more, and the bits of coarse cells that may hold a hot anchor."""
    size = min(BLOCK, 1 << bits)
    per_row = (1 << bits) // size
    coarse = 1 << max(0, bits - HOT_BITS)
    parts = docs.select("text").mapInArrow(_sketch_rows(window, anchor, bits), "block int, once binary, more binary")
    merged = parts.repartition(max(16, per_row // 8), "block").mapInArrow(_merge_rows(size, per_row, coarse, hot), "block int, bits binary, often binary")
    out, often = np.zeros((2 * per_row, size // 8), np.uint8), np.zeros((per_row, size // coarse // 8), np.uint8)
    for row in merged.toLocalIterator():
        out[row.block] = np.frombuffer(row.bits, np.uint8)
        if row.often is not None:
            often[row.block] = np.frombuffer(row.often, np.uint8)
    return out.reshape(2, -1), often.ravel()


def _bit(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _split_rows(window: int, anchor: int, bits: int, cells, schema: pa.Schema):
    """Each text: kept whole, or its window places estimated repeated, as ranges [from, to)."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice, _ = cells.value
        pack = zstandard.ZstdCompressor(level=3)
        rid = TaskContext.get().partitionId() << 40
        for rows, data, bounds in text_groups(batches):
            starts, ends, counts = word_bounds(data, bounds)
            places, at, grams = window_anchors(word_hashes(data, starts, ends), counts, window, anchor)
            suspect = np.ones(len(places), bool)
            for row, cell in zip(twice, cell_rows(grams[at] if len(at) else grams[:0], bits), strict=True):
                suspect &= _bit(row, cell)
            first = np.cumsum(counts) - counts
            hot = places[suspect]
            cuts = np.searchsorted(hot, np.append(first, counts.sum()))
            raw = data.tobytes()
            kept, text, ranges = [], [], []
            for i in range(rows.num_rows):
                own = raw[bounds[i] : bounds[i + 1]]
                if cuts[i] == cuts[i + 1]:
                    kept.append(b" ".join(own.split()))
                    text.append(None), ranges.append(None)
                    continue
                p = hot[cuts[i] : cuts[i + 1]] - first[i]
                gap = np.flatnonzero(np.diff(p) > 1)
                ranges.append(np.stack([p[np.concatenate([[0], gap + 1])], p[np.concatenate([gap, [len(p) - 1]])] + 1], 1).astype(np.int32).tobytes())
                kept.append(None), text.append(pack.compress(own))
            ids = pa.array(np.arange(rid, rid + rows.num_rows))
            rid += rows.num_rows
            yield pa.RecordBatch.from_arrays(
                [ids, rows.column(0), pa.array(counts.astype(np.int64)), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(text, pa.binary()), pa.array(ranges, pa.binary())],
                schema=schema,
            )

    return split


NAMES = ["k", "rid", "at", "bits", "hashes"]
DEALT = "k long, rid long, at int, bits long, hashes binary"
SPAN = 24
PLACES = np.arange(SPAN)


def _window_rows(window: int, anchor: int, bits: int, cells):
    """The windows estimated repeated, in rows of up to 24 neighbours with one anchor.

    A row is (k it is dealt by, rid, at: the first place, bits: which places have a hash here, and 24 bits higher which
    are known to be repeated, hashes). Equal windows of one go are compared here, and only the first keeps its hash.
    """

    def emit(cols: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        h, a, rid, place, spot, often, h2 = (np.concatenate(c) for c in cols)
        order = np.argsort(h, kind="stable")
        same = (h[order][1:] == h[order][:-1]) & (a[order][1:] == a[order][:-1])
        rep, met = np.ones(len(h), bool), np.zeros(len(h), bool)
        rep[order[1:][same]] = False
        met[order[1:][same]] = met[order[:-1][same]] = True
        # rows are cut where the text, the anchor or the neighbourhood ends
        cut = np.concatenate([[True], (rid[1:] != rid[:-1]) | (place[1:] != place[:-1] + 1) | (spot[1:] != spot[:-1])])
        first = np.flatnonzero(cut)
        row = np.cumsum(cut) - 1
        bit = 1 << (place - place[first[row]])
        own = rep & ~often
        has = np.bincount(row, bit * own, len(first)).astype(np.int64)
        known = np.bincount(row, bit * met, len(first)).astype(np.int64)
        size = np.bincount(row, own, len(first)).astype(np.int64)
        k = np.where(has > 0, a[first], mix(rid[first].view(np.uint64))).view(np.int64)
        some = (has | known) > 0
        yield _row_batch(k[some], rid[first][some], place[first][some], (has | known << SPAN)[some], h[own], size[some])
        if often.any():
            lone = np.flatnonzero(rep & often)
            yield _row_batch(h2[lone].view(np.int64), rid[lone], place[lone], 1 | met[lone].astype(np.int64) << SPAN, h[lone], np.ones(len(lone), np.int64))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, hot = cells.value
        shift = np.uint64(64 - min(bits, HOT_BITS))
        cols: list[list[np.ndarray]] = [[] for _ in range(7)]
        n = spots = 0
        for rows, data, bounds in text_groups(_unpacked(batches)):
            starts, ends, counts = word_bounds(data, bounds)
            words = word_hashes(data, starts, ends)
            all_places, at, grams = window_anchors(words, counts, window, anchor)
            first = np.cumsum(counts) - counts
            place, text = [], []
            for i, blob in enumerate(rows.column(2)):
                for x, y in np.frombuffer(blob.as_buffer(), np.int32).reshape(-1, 2):
                    place.append(np.arange(x, y)), text.append(np.full(y - x, i))
            place, text = np.concatenate(place), np.concatenate(text)
            index = first[text] + place
            spot = at[np.searchsorted(all_places, index)]
            a = grams[spot]
            often = _bit(hot, a >> shift)
            h2 = gram_hashes(words, window, seed=1)[index] if often.any() else np.zeros(len(index), np.uint64)
            rid = rows.column(0).to_numpy()[text]
            for col, own in zip(cols, (gram_hashes(words, window)[index], a, rid, place, spot + spots, often, h2), strict=True):
                col.append(own)
            n, spots = n + len(index), spots + len(words)
            if n >= AT_ONCE:
                yield from emit(cols)
                cols, n = [[] for _ in range(7)], 0
        if n:
            yield from emit(cols)

    return windows


def _unpacked(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Slices of (rid, packed text, ranges) with their texts."""
    plain = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            part = batch.slice(k, rows)
            texts = pa.array([plain(x) for x in part.column(1).to_pylist()], pa.large_binary()).cast(pa.large_string())
            yield pa.RecordBatch.from_arrays([part.column(0), texts, part.column(2)], names=["rid", "text", "ranges"])


def _row_batch(k, rid, at, bits, hashes: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32) * 8
    blobs = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(hashes))])
    return pa.RecordBatch.from_arrays([pa.array(k), pa.array(rid), pa.array(at.astype(np.int32)), pa.array(bits), blobs], names=NAMES)


def _met_again(limit: int):
    """From rows sorted by k: (rid, at, mask) of those with windows met twice or more.

    Rows of complete groups are compared `limit` windows at a time. Of a group that is longer, one row a different
    window stays in memory.
    """

    def compare(rows: list[np.ndarray], hashes: np.ndarray):
        """The mask of repeated places of each row; and the first of each different window, with whether it is repeated."""
        k, _, at, bits = rows
        own, bit = np.nonzero((bits[:, None] >> PLACES) & 1)
        order = np.lexsort((hashes, k[own]))
        h, g = hashes[order], k[own][order]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (g[1:] != g[:-1])]) if len(h) else np.zeros(0, bool)
        window = np.cumsum(new) - 1
        known = (bits[own] >> (SPAN + bit)) & 1
        again = (np.bincount(window) > 1) | (np.bincount(window, known[order]) > 0) if len(h) else np.zeros(0, bool)
        mask = bits >> SPAN
        mask |= np.bincount(own[order], again[window] * (1 << bit[order]), len(bits)).astype(np.int64)
        return mask, own[order][new], bit[order][new], h[new], again

    def marks(rows: list[np.ndarray], mask: np.ndarray) -> pa.RecordBatch:
        some = mask > 0
        return pa.RecordBatch.from_arrays([pa.array(rows[1][some]), pa.array(rows[2][some].astype(np.int32)), pa.array(mask[some].astype(np.int32))], names=["rid", "at", "mask"])

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, hashes = [np.zeros(0, np.int64)] * 4, np.zeros(0, np.uint64)
        parts: list[tuple[list[np.ndarray], np.ndarray]] = []
        n = 0

        def together():
            every = [(rows, hashes), *parts]
            return [np.concatenate([x[0][c] for x in every]) for c in range(4)], np.concatenate([x[1] for x in every])

        for batch in batches:
            if not batch.num_rows:
                continue
            blobs = batch.column(4)
            edges = np.frombuffer(blobs.buffers()[1], np.int32)[blobs.offset : blobs.offset + len(blobs) + 1]
            own = np.frombuffer(blobs.buffers()[2], np.uint8)[edges[0] : edges[-1]].copy().view(np.uint64) if edges[-1] > edges[0] else np.zeros(0, np.uint64)
            parts.append(([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(4)], own))
            n += len(own) + batch.num_rows
            if n < limit:
                continue
            rows, hashes = together()
            parts, size = [], np.bitwise_count(rows[3] & ((1 << SPAN) - 1)).astype(np.int64)
            open_from = int(np.searchsorted(rows[0], rows[0][-1]))
            at = int(size[:open_from].sum())
            if open_from:
                closed = [c[:open_from] for c in rows]
                yield marks(closed, compare(closed, hashes[:at])[0])
                rows, hashes = [c[open_from:] for c in rows], hashes[at:]
            if len(hashes) >= limit // 2:
                mask, first, bit, h, again = compare(rows, hashes)
                yield marks(rows, mask)
                rows, hashes = [rows[0][first], rows[1][first], rows[2][first] + bit, 1 | again.astype(np.int64) << SPAN], h
            n = 0
        rows, hashes = together()
        if len(rows[0]):
            yield marks(rows, compare(rows, hashes)[0])

    return met


def _cut_rows(window: int, schema: pa.Schema):
    """From rows sorted by (rid, mark), a text before its marks: the words that no marked window covers."""

    def finish(plain, doc, marks: list[np.ndarray]):
        doc_id, text = doc
        words = plain(text).split()
        drop = np.zeros(len(words) + 1, np.int64)
        for at, mask in marks:
            row, place = np.nonzero((mask[:, None] >> PLACES) & 1)
            np.add.at(drop, at[row] + place, 1)
            np.subtract.at(drop, at[row] + place + window, 1)
        gone = np.cumsum(drop[:-1]) > 0
        return doc_id, len(words), int(gone.sum()), b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])

    def batch_of(done: list) -> pa.RecordBatch:
        cols = list(zip(*done, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.binary()).cast(pa.string())], schema=schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = zstandard.ZstdDecompressor().decompress
        doc, marks = None, []
        for batch in batches:
            heads = np.flatnonzero(~batch.column(1).to_numpy(zero_copy_only=False))
            at, mask = (batch.column(c).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for c in (4, 5))
            marks.append((at[: heads[0] if len(heads) else None], mask[: heads[0] if len(heads) else None]))
            done = []
            # a batch may hold marks of the text before it only
            for k, nxt in zip(heads.tolist(), [*heads.tolist(), batch.num_rows][1:], strict=True):
                if doc is not None:
                    done.append(finish(plain, doc, marks))
                doc, marks = (batch.column(2)[k].as_py(), batch.column(3)[k].as_py()), [(at[k + 1 : nxt], mask[k + 1 : nxt])]
            if done:
                yield batch_of(done)
        if doc is not None:
            yield batch_of([finish(plain, doc, marks)])

    return cut


def remove_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, max_cells: int = MAX_CELLS, hot: int = HOT, at_once: int = AT_ONCE) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): kept words joined by one space. window - anchor is 23 at most."""
    if window - anchor >= SPAN:
        raise ValueError(f"window - anchor must be under {SPAN}")
    spark = docs.sparkSession
    ship_package(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    stage, bits = Stage(spark, "repeats"), sketch_bits(docs, max_cells)
    cells = spark.sparkContext.broadcast(repeated_cells(docs, window, anchor, bits, hot))
    schema = pa.schema([("rid", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("kept", pa.string()), ("text", pa.binary()), ("ranges", pa.binary())])
    kind = "rid long, doc_id long, n_words long, kept string, text binary, ranges binary"
    rows = stage.put(docs.mapInArrow(_split_rows(window, anchor, bits, cells, schema), kind), "rows", compression="zstd")
    suspects = rows.filter("ranges is not null")
    windows = suspects.select("rid", "text", "ranges").mapInArrow(_window_rows(window, anchor, bits, cells), DEALT)
    marks = windows.repartition("k").sortWithinPartitions("k").mapInArrow(_met_again(at_once), "rid long, at int, mask int")
    none = F.lit(None)
    texts = suspects.select("rid", F.lit(False).alias("mark"), "doc_id", "text", none.cast("int").alias("at"), none.cast("int").alias("mask"))
    both = marks.select("rid", F.lit(True).alias("mark"), none.cast("long").alias("doc_id"), none.cast("binary").alias("text"), "at", "mask").union(texts)
    out = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])
    cut = both.repartition("rid").sortWithinPartitions("rid", "mark").mapInArrow(_cut_rows(window, out), "doc_id long, n_words long, n_removed long, kept string")
    return rows.filter("ranges is null").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept").union(cut)


def op10_query(spark, sf_dir: str) -> DataFrame:
    """Repeated 35-word passages removed from every document."""
    kept = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM w WHERE len(w) >= 35)),
m AS (SELECT doc_id, i FROM g WHERE g IN (SELECT g FROM g GROUP BY g HAVING count(*) > 1)),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM m),
k AS (SELECT t.doc_id, string_agg(t.word, ' ' ORDER BY t.p) AS kept FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM w) t
 LEFT JOIN c ON c.doc_id = t.doc_id AND c.p = t.p WHERE c.p IS NULL GROUP BY t.doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(r.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM w LEFT JOIN k ON k.doc_id = w.doc_id LEFT JOIN (SELECT doc_id, count(*) AS n FROM c GROUP BY doc_id) r ON r.doc_id = w.doc_id
"""
