"""Quality rules: fixed base rules, then perplexity under a character model of the document's language and under a word model.

The character model is modified Kneser-Ney of order 4 over 32 character classes, counted by Spark over all documents:
each task sums its n-gram counts, Spark adds them by (language, n-gram). Discounts, continuation counts and
interpolation are computed from these counts for each language, whose model is arrays of sorted n-gram
hashes with their log-probabilities and back-off weights. An order-4 alphabet of 32 classes has 2^20
n-grams, so a language's model has a proven bound of 16 MB; languages are scored in blocks of at most
max_languages, one broadcast for each. A document gets the perplexity of the language whose model fits it best
(`fit`), and is judged among that language's documents, so a wrong language mark widens no band.

The word model (`word_model.py`) is modified Kneser-Ney over word pairs, counted by Spark over all documents and as
large as their different pairs: no part of it is collected or broadcast. It is one model for all languages. As each
document is part of the corpus, its own uses are taken off its pairs' counts and its contexts' totals, and a word
of one document alone counts as unknown; else any order of words would vouch for itself. Besides the perplexity there is
`order_gain`, the mean log-ratio of a word's probability after its neighbour to the one without: shuffled words keep
their frequencies and lose this gain.

Words are judged by best-fitting language: a document is rejected when its word perplexity is over the median by more than
`spread` median absolute deviations, or when its order gain is under `order` times the language's median gain.
There is no lower end, as near copies vouch for each other. Where the median gain is not positive, order says
nothing and is not judged.

Verdict: a language's band is its median log-perplexity plus and minus `spread` of its own median absolute
deviations, exact copies counted once; for texts shorter than the language's median length it widens with the
noise of a mean, by the root of median length / length. There is no fixed width. Documents beyond either end are
rejected.

Cases: null texts count as empty; texts without words fail the base rules and have perplexity 0; a null
language is a language of its own; repeated rows are counted and judged each; a language of
fewer than `few` different documents has no band and rejects nothing by it; input columns that carry an output's name are replaced; empty tables give no rows.
"""

from __future__ import annotations

import unicodedata
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.tokens import SLAB, SPACE, gram_hashes, grams_inside, mix, text_groups, word_bounds, word_hashes
from quillmesh.llm.word_model import discounts, word_perplexity
from quillmesh.session import ship_package
from quillmesh.storage import Stage

ORDER, BITS = 4, 5
GRAMS = 1 << (ORDER * BITS)
WINDOW = 8
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True


def _classes() -> np.ndarray:
    """Class of each code point below 0x250; letters by their base letter, others by a hash of the code point."""
    out = np.zeros(0x250, np.uint8)
    for c in range(len(out)):
        ch = unicodedata.normalize("NFD", chr(c))[0].lower()
        if "a" <= ch <= "z":
            out[c] = 1 + ord(ch) - 97
        elif ch.isspace():
            out[c] = 0
        elif ch.isdigit():
            out[c] = 27
        elif ch in ".,;:!?'\"()-":
            out[c] = 28
        elif ch in "#*$%&|<>":
            out[c] = 29
        else:
            out[c] = 1 + c % 26 if ch.isalpha() else 30
    return out


CLASSES = _classes()
START = 31


def char_classes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(class of each code point, byte place of each code point)."""
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    first = data[lead].astype(np.int64)
    code = first.copy()
    two = np.flatnonzero((first >= 0xC0) & (first < 0xE0))
    code[two] = ((first[two] & 0x1F) << 6) | (data[lead[two] + 1] & 0x3F)
    out = CLASSES[np.minimum(code, len(CLASSES) - 1)]
    far = np.flatnonzero((first >= 0xE0) | (code >= len(CLASSES)))
    if len(far):
        last = np.append(lead, len(data))[far + 1] - 1
        out[far] = 1 + (code[far] * 31 + (data[last] & 0x3F)) % 26
    return out, lead


def char_grams(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(packed 4-gram that ends at each code point, code points per text); texts begin with START classes."""
    cls, lead = char_classes(data)
    counts = np.diff(np.searchsorted(lead, bounds))
    n = len(cls)
    key = cls.astype(np.int32)
    pos = np.arange(n) - np.repeat(np.cumsum(counts) - counts, counts)
    for back in range(1, ORDER):
        earlier = np.full(n, START, np.int32)
        earlier[back:] = cls[:-back] if n > back else []
        earlier[pos < back] = START
        key |= earlier << np.int32(BITS * back)
    return key, counts


#: Code points whose n-grams a task holds before it counts them.
HELD = 1 << 22


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each task's 4-gram counts by language, as (lang, gram, n)."""
    sums: dict[str | None, np.ndarray] = {}
    held: dict[str | None, list[np.ndarray]] = {}

    def add():
        """Counts what is held: each time costs as much as there are n-grams a language."""
        for lang in list(held):
            if lang not in sums and len(sums) >= 16:
                yield from emit()
            part = np.bincount(np.concatenate(held.pop(lang)), minlength=GRAMS)
            if lang in sums:
                sums[lang] += part
            else:
                sums[lang] = part

    def emit():
        for lang, counts in sums.items():
            gram = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(gram.astype(np.int32)), pa.array(counts[gram])], names=["lang", "gram", "n"])
        sums.clear()

    size = 0
    for rows, data, bounds in text_groups(batches, limit=SLAB):
        key, counts = char_grams(data, bounds)
        langs = rows.column(1).to_pylist()
        which = {lang: k for k, lang in enumerate(dict.fromkeys(langs))}
        own = np.repeat(np.array([which[x] for x in langs]), counts)
        for lang, k in which.items():
            held.setdefault(lang, []).append(key.take(np.flatnonzero(own == k)))
        size += len(key)
        if size >= HELD:
            yield from add()
            size = 0
    yield from add()
    yield from emit()


def _discounts(counts: np.ndarray) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts of 0, 1, 2, and 3 or more."""
    return discounts([float((counts == k).sum()) for k in range(1, 5)])


def _hash(keys: np.ndarray, order: int) -> np.ndarray:
    """A 32-bit hash of packed n-grams, different for different n-grams of one order."""
    return (keys.astype(np.uint64) * np.uint64(0x9E3779B1) + np.uint64(order)).astype(np.uint32)


def kneser_ney(gram: np.ndarray, n: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """By order 1 to 4: sorted hashes and probabilities of n-grams, sorted hashes and back-off weights of their contexts."""
    counts = {ORDER: (gram.astype(np.int64), n.astype(np.float64))}
    for order in range(ORDER - 1, 0, -1):
        above = counts[order + 1][0]
        keys, kinds = np.unique(above & ((1 << (BITS * order)) - 1), return_counts=True)
        counts[order] = (keys, kinds.astype(np.float64))
    model, lower = [], None
    for order in range(1, ORDER + 1):
        keys, c = counts[order]
        d = _discounts(c)[np.minimum(c, 3).astype(np.int64)]
        context, where = np.unique(keys >> BITS, return_inverse=True)
        total = np.bincount(where, c)
        weight = np.bincount(where, d) / total
        below = np.full(len(keys), 1 / (1 << BITS)) if order == 1 else _lookup(lower, keys & ((1 << (BITS * (order - 1))) - 1), order - 1)
        p = (c - d) / total[where] + weight[where] * below
        g, h = _hash(keys, order), _hash(context, order)
        a, b = np.argsort(g), np.argsort(h)
        lower = (g[a], p[a].astype(np.float32), h[b], weight[b].astype(np.float32))
        model.append(lower)
    return model


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(table, keys), max(len(table) - 1, 0))
    return at, table[at] == keys if len(table) else np.zeros(len(keys), bool)


def _lookup(table, keys: np.ndarray, order: int) -> np.ndarray:
    at, found = _find(table[0], _hash(keys, order))
    return np.where(found, table[1][at], 1e-9)


def log_probabilities(model, keys: np.ndarray) -> np.ndarray:
    """Natural log-probability of the last class of each packed 4-gram given the other three."""
    p = np.full(len(keys), 1 / (1 << BITS))
    for order, (grams, probs, contexts, weights) in enumerate(model, 1):
        own = keys & ((1 << (BITS * order)) - 1)
        at, found = _find(grams, _hash(own, order))
        ctx, known = _find(contexts, _hash(own >> BITS, order))
        p = np.where(found, probs[at], np.where(known, weights[ctx], 1.0) * p)
    return np.log(p).astype(np.float32)


#: Languages whose log-probabilities of one n-gram lie side by side, so that a text's n-grams are looked up once for all.
BESIDE = 8
#: Code points summed in 32 bits; their sums are added in 64.
CHUNK = 4096


class Scorer:
    """A block's models; their 2^20 n-grams are looked up once a worker."""

    def __init__(self, models: dict, known: list):
        self.tables = [
            np.stack([log_probabilities(models[lang], np.arange(GRAMS, dtype=np.int64)) for lang in known[k : k + BESIDE]], axis=1) for k in range(0, len(known), BESIDE)
        ]

    def sums(self, grams: np.ndarray, counts: np.ndarray) -> Iterator[np.ndarray]:
        """Of each language in order, the sum of log-probabilities of each text; counts, n-grams a text, are not 0."""
        chunks = -(-counts // CHUNK)
        before = np.cumsum(chunks) - chunks
        cuts = np.repeat(np.cumsum(counts) - counts, chunks) + CHUNK * (np.arange(int(chunks.sum())) - np.repeat(before, chunks))
        for table in self.tables:
            parts = np.add.reduceat(table.take(grams, axis=0), cuts, axis=0).astype(np.float64)
            yield from np.add.reduceat(parts, before, axis=0).T


_SCORERS: dict[str, Scorer] = {}


def scorer(key: str, models, known: list) -> Scorer:
    """One scorer is kept in each worker. A task's own function could not keep it: its globals are copies, made anew for each task."""
    if key not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[key] = Scorer(models.value, known)
    return _SCORERS[key]


def base_counts(data: np.ndarray, bounds: np.ndarray) -> dict[str, np.ndarray]:
    """The base figures of each text of a group."""
    starts, ends, counts = word_bounds(data, bounds)
    inside_bounds = lambda flags: np.diff(np.searchsorted(np.flatnonzero(flags), bounds))
    index, text, _ = grams_inside(counts, WINDOW)
    grams = gram_hashes(word_hashes(data, starts, ends), WINDOW)[index] + mix(text.astype(np.uint64))
    order = np.argsort(grams)
    same = grams[order][1:] == grams[order][:-1]
    again = np.zeros(len(grams), bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    first = index[again]
    cover = np.bincount(first, minlength=len(starts) + 1) - np.bincount(first + WINDOW, minlength=len(starts) + 1)
    inside = np.concatenate([[0], np.cumsum(np.cumsum(cover[:-1]) > 0)])
    cut = np.concatenate([[0], np.cumsum(counts)])
    repeat = inside[cut[1:]] - inside[cut[:-1]]
    raw = data.tobytes()
    dup = np.zeros(len(counts), np.int64)
    for i in range(len(counts)):
        lines = raw[bounds[i] : bounds[i + 1]].split(b"\n")
        if len(lines) > 1 and len(set(lines)) < len(lines):
            solid = [x for x in lines if x.split(None, 1)]
            dup[i] = len(solid) - len(set(solid))
    return {
        "n_words": counts.astype(np.int64), "word_chars": inside_bounds(~SPACE[data] & ((data & 0xC0) != 0x80)), "n_symbols": inside_bounds(SYMBOLS[data]),
        "n_dup_lines": dup, "n_repeat_words": repeat,
    }


def _score_rows(key: str, models, known: list, schema: pa.Schema):
    """The base figures, and the least mean log-perplexity among the known languages with its language."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fits = scorer(key, models, known)
        for rows, data, bounds in text_groups(batches, limit=SLAB):
            figures = base_counts(data, bounds)
            grams, counts = char_grams(data, bounds)
            some = counts > 0
            own = rows.column(1).to_pylist()
            mean, fit = np.where(some, np.inf, 0.0), own if not known else [None] * len(own)
            for lang, total in zip(known, fits.sums(grams, counts[some]) if some.any() else []):
                part = np.zeros(len(counts))
                part[some] = -total / counts[some]
                better = some & (part < mean)
                mean = np.where(better, part, mean)
                fit = [lang if b else x for b, x in zip(better, fit, strict=True)]
            fit = [x if s else lang for x, s, lang in zip(fit, some, own, strict=True)]
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), rows.column(3), *[pa.array(v) for v in figures.values()], pa.array(mean), pa.array(fit, pa.string())], schema=schema)

    return score


COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def quality_rules(docs: DataFrame, spread: float = 8.0, few: int = 10, max_languages: int = 24, order: float = 0.2) -> DataFrame:
    """(doc_id, lang, the base figures, log_perplexity, fit, word_log_perplexity, order_gain, low, high, base_failed, kept)."""
    spark = docs.sparkSession
    ship_package(spark)
    # repeated rows share a key, and their figures
    docs = docs.select("doc_id", "lang", "text", F.xxhash64("doc_id", "lang", "text").alias("key"))
    stage = Stage(spark, "quality_rules")
    counted = docs.select("text", "lang").mapInArrow(_count_rows, "lang string, gram int, n long")
    model = stage.put(counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "counts")
    chars = model.agg(F.sum("n")).first()[0] or 0
    languages = [r.lang for r in model.select("lang").distinct().orderBy("lang").toLocalIterator()]
    schema = pa.schema([("doc_id", docs_type(docs)), ("lang", pa.string()), ("key", pa.int64()), *[(c, pa.int64()) for c in COLUMNS], ("log_perplexity", pa.float64()), ("fit", pa.string())])
    kind = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang string, key long, {', '.join(f'{c} long' for c in COLUMNS)}, log_perplexity double, fit string"
    parts = []
    for k in range(0, max(len(languages), 1), max_languages):
        block = languages[k : k + max_languages]
        models = {}
        for lang in block:
            got = model.filter(F.col("lang").eqNullSafe(F.lit(lang))).select("gram", "n").toArrow()
            models[lang] = kneser_ney(*[c.to_numpy() for c in got.columns])
        parts.append(docs.mapInArrow(_score_rows(uuid.uuid4().hex, spark.sparkContext.broadcast(models), block, schema), kind))
    scored = parts[0]
    if len(parts) > 1:
        # every block sees every document; the best fit of all blocks stays
        parts = [stage.put(p, f"block{k}") for k, p in enumerate(parts)]
        best = None
        for p in parts:
            own = p.select("key", F.struct("log_perplexity", "fit").alias("best"))
            best = own if best is None else best.union(own)
        best = best.groupBy("key").agg(F.min("best").alias("best"))
        scored = parts[0].drop("log_perplexity", "fit").join(best, "key").select("doc_id", "lang", "key", *COLUMNS, "best.log_perplexity", "best.fit")
    scored = stage.put(scored, "scored")
    scored = stage.put(scored.join(word_perplexity(docs, stage, chars), "key", "left").drop("key"), "worded")
    stage.drop("scored", "word_scores")
    worded = scored.filter("n_words > 0")
    worded = worded.select(F.col("fit").alias("_fit"), "log_perplexity", "word_chars").distinct()
    middle = worded.groupBy("_fit").agg(
        F.percentile_approx("log_perplexity", 0.5, 10000).alias("mid"), F.percentile_approx("word_chars", 0.5, 10000).alias("length"), F.count("*").alias("texts")
    )
    middle = middle.filter(F.col("texts") >= few).withColumnRenamed("_fit", "_mid_fit")
    off = worded.join(middle, F.col("_fit").eqNullSafe(F.col("_mid_fit"))).select("_fit", "mid", "length", F.abs(F.col("log_perplexity") - F.col("mid")).alias("off"))
    band = off.groupBy("_fit", "mid", "length").agg((F.percentile_approx("off", 0.5, 10000) * spread).alias("half"))
    band = stage.put(band, "bands")
    usual = scored.filter("word_log_perplexity is not null").groupBy(F.col("fit").alias("_lang")).agg(
        F.percentile_approx("word_log_perplexity", 0.5, 10000).alias("word_mid"), F.percentile_approx("order_gain", 0.5, 10000).alias("gain")
    )
    off = scored.join(usual, F.col("fit").eqNullSafe(F.col("_lang"))).select("_lang", "word_mid", "gain", F.abs(F.col("word_log_perplexity") - F.col("word_mid")).alias("off"))
    usual = stage.put(off.groupBy("_lang", "word_mid", "gain").agg((F.percentile_approx("off", 0.5, 10000) * spread).alias("word_half")), "word_bands")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    judged = scored.join(band, F.col("fit").eqNullSafe(F.col("_fit")), "left")
    slack = F.col("half") * F.sqrt(F.greatest(F.lit(1.0), F.col("length") / F.greatest("word_chars", F.lit(1))))
    judged = judged.withColumns({"low": F.col("mid") - slack, "high": F.col("mid") + slack}).drop("_fit", "mid", "length", "half")
    judged = judged.join(usual, F.col("fit").eqNullSafe(F.col("_lang")), "left")
    inside = F.coalesce(F.col("log_perplexity").between(F.col("low"), F.col("high")), F.lit(True))
    odd = F.col("word_log_perplexity") > F.col("word_mid") + F.col("word_half")
    mixed = (F.col("gain") > 0) & (F.col("order_gain") < F.col("gain") * F.lit(float(order)))
    judged = judged.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & inside & ~F.coalesce(odd | mixed, F.lit(False)))
    return judged.drop("_lang", "word_mid", "word_half", "gain")


def docs_type(docs: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(docs.schema["doc_id"].dataType)


def op7_query(spark, sf_dir: str) -> DataFrame:
    """Base figures and verdict of every document."""
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        "doc_id", *COLUMNS, "base_failed", "kept", "log_perplexity", "word_log_perplexity", "order_gain"
    )
