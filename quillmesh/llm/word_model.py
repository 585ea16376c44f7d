"""Perplexity of documents under a modified Kneser-Ney model of word pairs, as large as the corpus's pairs.

A text is a circle of its words (ASCII case folded) and one boundary sign, so each sign of it is as often a context as it
is predicted. With n uses of a pair (b, w), total uses of b, left = the sum of the discounts of b's pairs, and lower(w)
from the number of kinds of words before w, a document that itself has `own` uses of the pair and `held` of b gets

    p = ((n - own) - d(n - own) + left * lower(w)) / max(total - held, left)

so its own uses do not vouch for itself. A word of one text alone counts as unknown. The logarithm is a sum of
three parts: log lower(w), log(left / max(total - held, left)), and log(1 + (n - own - d) / (left * lower(w))), which is 0
unless another text has the pair. The first two need words only, the third only pairs of two texts or more; so
the model holds these pairs alone, and loses nothing by it.

The model is sorted arrays of hashes (40 bits of words, 48 of pairs), cut into `ranges` by hash; no part of it is collected or broadcast. What asks
about a range (pairs about their words, documents about words and pairs) is sent to it in packed blocks, a row each,
and a block is answered at once; a word or pair that many texts share is a few bytes in each block, never a row.
Texts are read `passes` times for the counts and again for the uses, each time for another share of the ranges: more
passes write less to disk at a time, and need more CPU.

Cases: null and empty texts and texts without words have no row in the result; rows of one key have one; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.tokens import SLAB, VALUES_LOWER, give_back, mix, text_groups, word_bounds, word_hashes
from quillmesh.storage import Stage

WORD_BITS, PAIR_BITS = 40, 48
U = np.uint64
#: Characters of the corpus a range; a range is merged in one task.
RANGE_CHARS = 1 << 25
LEAST_RANGES = 16
#: A range is merged in so many parts, one after the other; pairs whose hashes one step makes at a time.
PARTS, KEYS_AT_ONCE = 4, 1 << 17
STATS = ["<u4"] * 4 + ["<u8", "<u4"]  # of a word: pairs with 1, 2, and more uses, kinds before it, uses, texts
BLOCK = "kind int, range int, block binary, c1 long, c2 long, c3 long, c4 long, total long"
PAIRS, WORDS, FIGURES = 0, 1, 2


def discounts(n: list[float]) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts of 0, 1, 2, and 3 or more, from the number of n-grams counted 1 to 4 times."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
    d = [k + 1 - (k + 2) * y * n[k + 1] / n[k] if n[k] else 0.5 * (k + 1) for k in range(3)]
    return np.concatenate([[0.0], np.clip(d, 0.05, [0.95, 1.95, 2.95])])


def pack(*columns: np.ndarray) -> bytes:
    """Columns of one length, byte plane by byte plane, compressed."""
    planes = [np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.itemsize).T.tobytes() for c in columns]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def unpack(block: bytes, kinds: list[str]) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(block), np.uint8)
    sizes = [np.dtype(k).itemsize for k in kinds]
    n, at, out = len(raw) // sum(sizes), 0, []
    for kind, s in zip(kinds, sizes, strict=True):
        out.append(np.ascontiguousarray(raw[at : at + n * s].reshape(s, n).T).view(kind).reshape(n))
        at += n * s
    return out


def steps(keys: np.ndarray) -> np.ndarray:
    """Differences of sorted keys, the first from 0."""
    return np.diff(keys, prepend=U(0))


def changes(keys: np.ndarray) -> np.ndarray:
    """Where each run of equal sorted keys begins."""
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)


def pair_keys(before: np.ndarray, word: np.ndarray, words: np.ndarray | None = None) -> np.ndarray:
    """A hash of each pair of word hashes, or of indices into words."""
    out = np.empty(len(before), U)
    for k in range(0, len(out), KEYS_AT_ONCE):
        a, b = before[k : k + KEYS_AT_ONCE], word[k : k + KEYS_AT_ONCE]
        if words is not None:
            a, b = words[a], words[b]
        out[k : k + KEYS_AT_ONCE] = mix(a * U(0x9E3779B97F4A7C15) + b) >> U(64 - PAIR_BITS)
    return out


def pair_ranges(keys: np.ndarray, ranges: int) -> np.ndarray:
    """The range of each pair's hash, by its first 40 bits."""
    return ((keys >> U(PAIR_BITS - WORD_BITS)) * U(ranges) >> U(WORD_BITS)).astype(np.int64)


def range_cuts(keys: np.ndarray, ranges: int) -> np.ndarray:
    """Where each range begins in sorted 40-bit keys, and their number."""
    edges = [-(-(k << WORD_BITS) // ranges) for k in range(ranges + 1)]
    return np.searchsorted(keys, np.array(edges, U))


class Group:
    """The signs of a group of texts: pairs and words with their texts and uses, as indices into sorted word hashes."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        starts, ends, counts = word_bounds(data, bounds)
        words = np.maximum(word_hashes(data, starts, ends, VALUES_LOWER) >> U(64 - WORD_BITS), U(1))
        live = np.flatnonzero(counts)
        self.events = np.where(counts > 0, counts + 1, 0)
        sizes = counts[live] + 1
        signs, solid = np.zeros(int(sizes.sum()), U), np.ones(int(sizes.sum()), bool)
        solid[np.cumsum(sizes) - sizes] = False
        signs[solid] = words
        # by a hash table, as there are far fewer different signs than signs
        coded = pa.array(signs).dictionary_encode()
        found = coded.dictionary.to_numpy()
        order = np.argsort(found)
        rank = np.empty(len(found), U)
        rank[order] = np.arange(len(found), dtype=U)
        self.words, self.ids = found[order], rank[coded.indices.to_numpy()]
        self.texts = np.repeat(live, sizes).astype(U)
        self.text_bits = U(int(len(counts)).bit_length())

    def _runs(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        code.sort()
        at = changes(code)
        kept = code[at]
        return kept >> self.text_bits, (kept & ((U(1) << self.text_bits) - U(1))).astype(np.uint32), np.diff(np.append(at, len(code))).astype(np.uint32)

    def word_uses(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the word, text, uses), sorted."""
        return self._runs(self.ids << self.text_bits | self.texts)

    def pair_uses(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(index of the word before, index of the word, text, uses), sorted; indices and text fit 63 bits, see text_groups."""
        bits = U(int(len(self.words)).bit_length())
        after = np.append(self.ids[1:], U(0))  # the sign behind a text's last word is the next text's boundary
        pair, text, own = self._runs((self.ids << bits | after) << self.text_bits | self.texts)
        return pair >> bits, pair & ((U(1) << bits) - U(1)), text, own


def _blocks(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*[(*r, *[0] * (8 - len(r))) for r in rows], strict=True)) if rows else [[]] * 8
    kinds = [pa.int32(), pa.int32(), pa.binary(), *[pa.int64()] * 5]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["kind", "range", "block", "c1", "c2", "c3", "c4", "total"])


def _word_rows(words: np.ndarray, stats: list[np.ndarray], ranges: int) -> list[tuple]:
    """Rows of the stats of sorted words, by range."""
    cuts = range_cuts(words, ranges)
    return [(WORDS, r, pack(steps(words[a:b]), *[s[a:b].astype(k) for s, k in zip(stats, STATS, strict=True)])) for r, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]


def _count_map(ranges: int, low: int, high: int):
    """Pairs of each group with uses and texts, for ranges low to high - 1; words with uses and texts in the first pass."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, bounds in text_groups(batches, limit=8 * SLAB):
            group = Group(data, bounds)
            if not len(group.words):
                continue
            rows = []
            if low == 0:
                word, _, own = group.word_uses()
                at, none = changes(word), np.zeros(len(group.words), np.int64)
                rows += _word_rows(group.words, [none] * 4 + [np.add.reduceat(own.astype(np.int64), at), np.diff(np.append(at, len(word)))], ranges)
                del word, own, at, none
            known, (before, word, _, own) = group.words, group.pair_uses()
            del group
            at = changes(before << U(32) | word)
            uses, texts = np.add.reduceat(own.astype(np.int64), at), np.diff(np.append(at, len(word)))
            before, word = known[before[at]], known[word[at]]
            del own, at
            own_range = pair_ranges(pair_keys(before, word), ranges)
            order = np.flatnonzero((own_range >= low) & (own_range < high))
            order = order[np.argsort(own_range[order].astype(np.uint16 if ranges < 1 << 16 else np.int64), kind="stable")]  # by range, then by the word before
            cuts = np.searchsorted(own_range[order], np.arange(low, high + 1))
            for r, a, b in zip(range(low, high), cuts, cuts[1:]):
                if b > a:
                    some = order[a:b]
                    rows.append((PAIRS, r, pack(steps(before[some]), word[some], uses[some].astype(np.uint32), np.minimum(texts[some], 2).astype(np.uint8))))
            yield _blocks(rows)

    return count


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[dict]]]:
    """Rows sorted by range, one iterator a range."""
    rows = (row for batch in batches for row in batch.to_pylist())
    yield from groupby(rows, key=lambda row: row["range"])


def _merge_words(words: list[np.ndarray], stats: list[list[np.ndarray]]) -> tuple[np.ndarray, list[np.ndarray]]:
    keys = np.concatenate(words)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = changes(keys)
    return keys[at], [np.add.reduceat(np.concatenate(s)[order].astype(np.int64), at) if len(at) else np.zeros(0, np.int64) for s in stats]


def _split(columns: list[np.ndarray], parts: int) -> list[list[np.ndarray] | None]:
    """Pairs (word before, word, ...) dealt by their hashes to parts, None where there are none; each part has arrays of its own."""
    own = (pair_keys(*columns[:2]) % U(parts)).astype(np.uint8)
    order = np.argsort(own, kind="stable")
    cuts = np.searchsorted(own[order], np.arange(parts + 1))
    return [[c[order[a:b]] for c in columns] if b > a else None for a, b in zip(cuts, cuts[1:])]


def _merge_pairs(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word before, word, uses, texts) of different pairs, by their hashes."""
    before, word, uses, texts = columns
    order = np.argsort(pair_keys(before, word))
    before, word = before[order], word[order]
    # by the words too: pairs of one hash stay apart, and no word loses its last pair
    at = np.flatnonzero(np.concatenate([[True], (before[1:] != before[:-1]) | (word[1:] != word[:-1])]))
    return before[at], word[at], np.add.reduceat(uses[order].astype(np.int64), at), np.add.reduceat(texts[order].astype(np.int64), at)


def _count_reduce(ranges: int):
    """Each range's pairs: those of two texts or more by the range of the word before, and what all say about their words."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _ranges(batches):
            parts: list[list] = [[] for _ in range(PARTS)]
            for row in rows:
                if row["kind"] == PAIRS:
                    before, *rest = unpack(row["block"], ["<u8", "<u8", "<u4", "u1"])
                    for part, some in zip(parts, _split([np.cumsum(before, dtype=U), *rest], PARTS), strict=True):
                        if some:
                            part.append(some)
                else:
                    yield _blocks([(WORDS, row["range"], row["block"])])
            words, figures, shared = None, np.zeros(5, np.int64), []
            while parts:
                if not (part := parts.pop()):
                    continue
                columns = [np.concatenate(c) for c in zip(*part, strict=True)]
                part.clear()
                before, word, uses, texts = _merge_pairs(columns)
                del columns
                one = [uses == 1, uses == 2, uses > 2]
                zero = np.zeros(len(uses), np.uint8)
                stats = [[x.astype(np.uint8), zero] for x in one] + [[zero, zero + 1], [zero, zero], [zero, zero]]
                got = _merge_words([before, word], stats)
                words = got if words is None else _merge_words([words[0], got[0]], [list(s) for s in zip(words[1], got[1], strict=True)])
                figures += [*[int((uses == k).sum()) for k in range(1, 5)], len(uses)]
                some = np.flatnonzero(texts > 1)
                shared.append([before[some], word[some], uses[some].astype(np.uint32)])
            if words is None:
                continue
            out = _word_rows(*words, ranges)
            out.append((FIGURES, 0, b"", *figures.tolist()))
            before, word, uses = (np.concatenate(c) for c in zip(*shared, strict=True))
            order = np.argsort(before)
            cuts = range_cuts(before[order], ranges)
            for r, (a, b) in enumerate(zip(cuts, cuts[1:])):
                if b > a:
                    some = order[a:b]
                    out.append((PAIRS, r, pack(steps(before[some]), word[some], uses[some])))
            yield _blocks(out)
        give_back()

    return merge


def _words_of(blocks: list[bytes]) -> tuple[np.ndarray, list[np.ndarray]]:
    parts = [unpack(b, ["<u8", *STATS]) for b in blocks]
    if not parts:
        return np.zeros(0, U), [np.zeros(0, np.int64)] * len(STATS)
    return _merge_words([np.cumsum(p[0], dtype=U) for p in parts], [[p[k] for p in parts] for k in range(1, 1 + len(STATS))])


def _word_reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each range's words, one block, and how many of them have 1 to 4 kinds of words before them."""
    for r, rows in _ranges(batches):
        words, stats = _words_of([row["block"] for row in rows])
        kinds = stats[3]
        yield _blocks([(WORDS, r, pack(steps(words), *[s.astype(k) for s, k in zip(stats, STATS, strict=True)]), *[int((kinds == k).sum()) for k in range(1, 5)], len(words))])
    give_back()


class Model:
    """The fitted numbers: discounts of pairs and of kinds, number of pairs, and probability of an unknown word."""

    def __init__(self, pairs, words):
        self.high, self.low = discounts([float(x or 0) for x in pairs[:4]]), discounts([float(x or 0) for x in words[:4]])
        self.pairs = float(pairs[4] or 1)
        many = (words[4] or 0) - (words[0] or 0) - (words[1] or 0)
        self.unknown = float(self.low[1] * (words[0] or 0) + self.low[2] * (words[1] or 0) + self.low[3] * many) / self.pairs / ((words[4] or 0) + 1)

    def left(self, stats: list[np.ndarray]) -> np.ndarray:
        return self.high[1] * stats[0] + self.high[2] * stats[1] + self.high[3] * stats[2]

    def lower(self, stats: list[np.ndarray]) -> np.ndarray:
        kinds, texts = stats[3], stats[5]
        return np.where(texts > 1, (kinds - self.low[np.minimum(kinds, 3)]) / self.pairs, 0.0) + self.unknown


def _left_of(ranges: int, model: Model):
    """Pairs with the back-off mass of the word before, by the range of the word."""

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _ranges(batches):
            words, left = np.zeros(0, U), None
            for row in rows:
                if row["kind"] == WORDS:
                    words, stats = _words_of([row["block"]])
                    left = model.left(stats)
                    continue
                before, word, uses = unpack(row["block"], ["<u8", "<u8", "<u4"])
                before = np.cumsum(before, dtype=U)
                order = np.argsort(word)
                mass = left[np.searchsorted(words, before)].astype(np.float32)[order]
                key, word, uses = pair_keys(before, word)[order], word[order], uses[order]
                cuts = range_cuts(word, ranges)
                yield _blocks([(PAIRS, r, pack(steps(word[a:b]), key[a:b], uses[a:b], mass[a:b])) for r, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a])

    return answer


def _weight_of(ranges: int, model: Model):
    """Pairs with left * lower, by the range of the pair."""

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _ranges(batches):
            words, lower = np.zeros(0, U), None
            for row in rows:
                if row["kind"] == WORDS:
                    words, stats = _words_of([row["block"]])
                    lower = model.lower(stats)
                    continue
                word, key, uses, mass = unpack(row["block"], ["<u8", "<u8", "<u4", "<f4"])
                weight = (mass * lower[np.searchsorted(words, np.cumsum(word, dtype=U))]).astype(np.float32)
                order = np.argsort(key)
                key, uses, weight = key[order], uses[order], weight[order]
                cuts = np.searchsorted(pair_ranges(key, ranges), np.arange(ranges + 1))
                yield _blocks([(PAIRS, r, pack(steps(key[a:b]), uses[a:b], weight[a:b])) for r, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a])

    return answer


ASKS = "kind int, range int, grp long, size int, block binary"


def _asks(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["kind", "range", "grp", "size", "block"])


TABLE, USES, KEYS = 0, 1, 2


def _use_map(ranges: int, low: int, high: int):
    """Uses of words (ranges 0 and on) and of pairs (from `ranges` on) by the texts of each group, and the group's keys.

    A group is named by a hash of its keys in order. Groups of the same keys share a name, see _total.
    """

    def use(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, bounds in text_groups(batches, limit=8 * SLAB):
            group = Group(data, bounds)
            if not len(group.words):
                continue
            keys = batch.column(1).to_numpy().astype(np.int64)
            name = int(np.bitwise_xor.reduce(mix(keys.view(U) + np.arange(1, len(keys) + 1, dtype=U) * U(0xD6E8FEB86659FD93))).view(np.int64))
            rows = [(KEYS, -1, name, len(keys), pack(keys, group.events.astype(np.int64)))]
            word, text, own = group.word_uses()
            cuts = range_cuts(group.words[word], ranges)
            ask = lambda r, *cols: (USES, r, name, len(keys), pack(*cols))
            rows += [ask(r, steps(group.words[word[a:b]]), text[a:b], own[a:b]) for r, (a, b) in enumerate(zip(cuts, cuts[1:])) if low <= r < high and b > a]
            del word, text, own
            known, (before, word, text, own) = group.words, group.pair_uses()
            del group
            key = pair_keys(before, word, known)
            del before, word
            own_range = pair_ranges(key, ranges)
            some = np.flatnonzero((own_range >= low) & (own_range < high))
            some = some[np.argsort(key[some])]
            key, text, own, own_range = key[some], text[some], own[some], own_range[some]
            cuts = np.searchsorted(own_range, np.arange(low, high + 1))
            rows += [ask(ranges + r, steps(key[a:b]), text[a:b], own[a:b]) for r, a, b in zip(range(low, high), cuts, cuts[1:]) if b > a]
            yield _asks(rows)

    return use


def _use_reduce(ranges: int, model: Model):
    """Sums of log lower and of the gain over it, by text of each block of uses."""

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r, rows in _ranges(batches):
            tables, ready = [], False
            for row in rows:
                if row["kind"] == TABLE:
                    tables.append(row["block"])
                    continue
                if row["kind"] == KEYS:
                    yield _asks([(KEYS, -1, row["grp"], row["size"], row["block"])])
                    continue
                if not ready and r < ranges:
                    known, stats = _words_of(tables)
                    lower, left, total = np.log(model.lower(stats)), model.left(stats), stats[4]
                elif not ready:
                    cols = [unpack(t, ["<u8", "<u4", "<f4"]) for t in tables] or [(np.zeros(0, U), np.zeros(0, np.uint32), np.zeros(0, np.float32))]
                    known, uses, weight = np.concatenate([np.cumsum(c[0], dtype=U) for c in cols]), np.concatenate([c[1] for c in cols]), np.concatenate([c[2] for c in cols])
                    order = np.argsort(known)
                    known, uses, weight = known[order], uses[order].astype(np.int64), weight[order].astype(np.float64)
                ready, tables = True, []
                key, text, own = unpack(row["block"], ["<u8", "<u4", "<u4"])
                key = np.cumsum(key, dtype=U)
                at = np.searchsorted(known, key)
                if r < ranges:
                    base = np.bincount(text, own * lower[at], row["size"])
                    gain = own * np.log(left[at] / np.maximum(total[at] - own.astype(np.int64), left[at]))
                else:
                    base = np.zeros(row["size"])
                    hit = np.flatnonzero(known[np.minimum(at, max(len(known) - 1, 0))] == key) if len(known) else np.zeros(0, np.int64)
                    text, own, at = text[hit], own[hit], at[hit]
                    rest = np.maximum(uses[at] - own.astype(np.int64), 0)
                    gain = own * np.log1p((rest - model.high[np.minimum(rest, 3)]) / weight[at])
                gain = np.bincount(text, gain, row["size"])
                yield _asks([(USES, r, row["grp"], row["size"], pack(base.astype(np.float32), gain.astype(np.float32)))])
        give_back()

    return answer


def _total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, base, gain, events) of the texts of each group, added up over passes and over groups of the same keys."""
    rows = (row for batch in batches for row in batch.to_pylist())
    for _, own in groupby(rows, key=lambda row: row["grp"]):
        base, gain, keys, events, times = 0.0, 0.0, None, None, 0
        for row in own:
            if row["kind"] == KEYS:
                keys, events = unpack(row["block"], ["<i8", "<i8"])
                times += 1
            else:
                parts = unpack(row["block"], ["<f4", "<f4"])
                base, gain = base + parts[0].astype(np.float64), gain + parts[1].astype(np.float64)
        some = np.flatnonzero(events)
        base, gain = (np.broadcast_to(x, len(events))[some] for x in (base, gain))
        yield pa.RecordBatch.from_arrays([pa.array(keys[some]), pa.array(base), pa.array(gain), pa.array(events[some] * times)], names=["key", "base", "gain", "events"])


def _dealt(rows: DataFrame, parts: int, job: Callable, schema: str) -> DataFrame:
    """Rows dealt by range, tables first, through one job."""
    return rows.repartition(parts, "range").sortWithinPartitions("range", "kind").mapInArrow(job, schema)


def _sums(table: DataFrame) -> list:
    return list(table.agg(*[F.sum(c) for c in ("c1", "c2", "c3", "c4", "total")]).first())


def word_perplexity(docs: DataFrame, stage: Stage, chars: int, passes: int = 2) -> DataFrame:
    """(key, word_log_perplexity, order_gain) of docs (key, text) with about chars characters: see the head of the module."""
    ranges = max(LEAST_RANGES, chars // RANGE_CHARS)
    texts = docs.select("text", "key")
    edges = [ranges * k // passes for k in range(passes + 1)]
    counted = None
    for k, (low, high) in enumerate(zip(edges, edges[1:])):
        mapped = texts.mapInArrow(_count_map(ranges, low, high), BLOCK)
        part = stage.put(_dealt(mapped, ranges, _count_reduce(ranges), BLOCK), f"counted{k}")
        counted = part if counted is None else counted.unionByName(part)
    words = stage.put(_dealt(counted.filter(F.col("kind") == WORDS), ranges, _word_reduce, BLOCK), "words")
    model = Model(_sums(counted.filter(F.col("kind") == FIGURES)), _sums(words))
    # tables go first: words are dealt with the kind below that of pairs
    first = lambda pairs: words.withColumn("order", F.lit(0)).unionByName(pairs.withColumn("order", F.lit(1)))
    dealt = lambda rows, job: rows.repartition(ranges, "range").sortWithinPartitions("range", "order").drop("order").mapInArrow(job, BLOCK)
    massed = stage.put(dealt(first(counted.filter(F.col("kind") == PAIRS)), _left_of(ranges, model)), "massed")
    stage.drop(*[f"counted{k}" for k in range(passes)])
    weighed = stage.put(dealt(first(massed), _weight_of(ranges, model)), "weighed")
    stage.drop("massed")
    table = lambda df, start: df.select(F.lit(TABLE).alias("kind"), (F.col("range") + start).cast("int").alias("range"), F.lit(0).cast("long").alias("grp"), F.lit(0).alias("size"), "block")
    tables = table(words, 0).unionByName(table(weighed, ranges))
    answered = None
    for k, (low, high) in enumerate(zip(edges, edges[1:])):
        inside = F.pmod(F.col("range"), F.lit(ranges)).between(low, high - 1)
        asks = tables.filter(inside).unionByName(texts.mapInArrow(_use_map(ranges, low, high), ASKS))
        part = stage.put(_dealt(asks, 2 * ranges, _use_reduce(ranges, model), ASKS), f"answered{k}")
        answered = part if answered is None else answered.unionByName(part)
    stage.drop("words", "weighed")
    totals = answered.repartition("grp").sortWithinPartitions("grp", "kind", "range").mapInArrow(_total, "key long, base double, gain double, events long")
    # every pass counts a text's events, and every row of a key adds its own
    events = F.sum("events") / F.lit(passes)
    totals = totals.groupBy("key").agg((-F.sum(F.col("base") + F.col("gain")) / events).alias("word_log_perplexity"), (F.sum("gain") / events).alias("order_gain"))
    out = stage.put(totals, "word_scores")
    stage.drop(*[f"answered{k}" for k in range(passes)])
    return out
