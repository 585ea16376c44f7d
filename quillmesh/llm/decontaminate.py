"""Benchmark decontamination: one Aho-Corasick automaton over word windows of the benchmark items.

Texts become runs of words (A-Z lower-cased; 0-9, a-z and everything beyond ASCII). The automaton's
symbols are word numbers, its patterns the windows of 13 consecutive item words (a shorter item is one
window). Each document is scanned once; hits are word ranges, mapped back to code points.

Size: windows are streamed from the benchmark into blocks of at most max_windows, and each block is one
automaton and one broadcast of bounded size (some 200 bytes a window). A benchmark of up to max_windows windows, some
200,000 words, is one automaton and one scan, without shuffle or stage table; a larger one needs a scan and a pass
through the shared folder for each block, and gives the same rows.

Cases: null or empty texts have no words, no hits and are not contaminated; items without words are
ignored; a null item_id marks words but is not named; repeated rows and ids are judged row by row; input
columns that carry an output's name are replaced; empty tables give empty results.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from itertools import repeat

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quillmesh.functions.names import spare
from quillmesh.session import ship_package
from quillmesh.storage import Stage

WINDOW = 13
MAX_WINDOWS = 200_000
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
RAW_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
OUT = ["n_words", "n_hit", "items", "hit_spans", "contaminated"]


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def window_blocks(rows, window: int, limit: int) -> Iterator[dict]:
    """Blocks {words of a window: item ids} of at most limit windows, from (item_id, text) rows."""
    block: dict = {}
    for item, text in rows:
        words = words_of((text or "").encode())
        for i in range(max(1, len(words) - window + 1) if words else 0):
            names = block.setdefault(tuple(words[i : i + window]), [])
            if item is not None and str(item) not in names:
                names.append(str(item))
            if len(block) >= limit:
                yield block
                block = {}
    if block:
        yield block


class Scanner:
    """The automaton of one block."""

    def __init__(self, block: dict):
        self.vocabulary: dict[bytes, int] = {}
        self.names: list[list[str]] = []
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        self.lengths: list[int] = []
        for words, names in block.items():
            self.automaton.add_word(tuple(self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words), len(self.names))
            self.names.append(names)
            self.lengths.append(len(words))
        self.automaton.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged word ranges that hits cover, and the items that own them."""
        if not self.lengths:
            return [], set()
        ids = tuple(map(self.vocabulary.get, words, repeat(0)))
        ranges: list[tuple[int, int]] = []
        items: set[str] = set()
        for end, k in self.automaton.iter(ids):
            start = end + 1 - self.lengths[k]
            items.update(self.names[k])
            while ranges and start <= ranges[-1][1]:
                start = min(start, ranges.pop()[0])
            ranges.append((start, end + 1))
        return ranges, items


_SCANNERS: dict[str, Scanner] = {}


def _scanner(key: str, block) -> Scanner:
    """One automaton is kept in each worker."""
    if key not in _SCANNERS:
        _SCANNERS.clear()
        _SCANNERS[key] = Scanner(block.value)
    return _SCANNERS[key]


def union_ranges(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def code_point_spans(text: bytes, ranges: list[tuple[int, int]]) -> list[dict]:
    """Code points [start, end) of word ranges in the text as it was."""
    at = [m.span() for m in RAW_WORD.finditer(text)]
    points = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
    return [{"start": int(points[at[a][0]]), "end": int(points[at[b - 1][1]])} for a, b in ranges]


def _text_bytes(column: pa.Array) -> list[bytes]:
    return pc.fill_null(column.cast(pa.large_string()), "").cast(pa.large_binary()).to_pylist()


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = 20, max_windows: int = MAX_WINDOWS, keep_text: bool = False) -> DataFrame:
    """docs (text last or dropped) with n_words, n_hit, items (sorted ids), hit_spans and contaminated (share * n_hit >= n_words > 0 hits)."""
    spark = docs.sparkSession
    ship_package(spark)
    docs = docs.drop(*OUT)
    others = [f for f in docs.schema.fields if f.name != "text"]
    state = [spare(n, docs.columns) for n in ("ranges", "item_ids")]
    carried = T.StructType([*others, T.StructField("text", T.StringType()), T.StructField(state[0], T.ArrayType(T.IntegerType())), T.StructField(state[1], T.ArrayType(T.StringType()))])
    tail = [
        T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("hit_spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
        T.StructField("contaminated", T.BooleanType()),
    ]
    final = T.StructType([*others, *([T.StructField("text", T.StringType())] if keep_text else []), *tail])
    rows = benchmark.select("item_id", "text").toLocalIterator(prefetchPartitions=False)
    blocks = window_blocks(rows, window, max_windows)
    block = next(blocks, {})
    stage, k = Stage(spark, "decontaminate"), 0
    while (following := next(blocks, None)) is not None:
        scan = _pass(spark.sparkContext.broadcast(block), carried, None, state, share, keep_text)
        docs = stage.put(docs.mapInArrow(scan, carried), f"block{k}")
        if k:
            stage.drop(f"block{k - 1}")
        block, k = following, k + 1
    return docs.mapInArrow(_pass(spark.sparkContext.broadcast(block), carried, final, state, share, keep_text), final)


def _pass(block, carried: T.StructType, final: T.StructType | None, state: list[str], share: int, keep_text: bool):
    target = to_arrow_schema(final or carried)
    names = [f.name for f in target][: -5 if final else -3]
    names = [n for n in names if n != "text"]
    key = uuid.uuid4().hex

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(key, block)
        for batch in batches:
            table = pa.Table.from_batches([batch])
            earlier = table.column(state[0]).to_pylist() if state[0] in table.column_names else None
            before = table.column(state[1]).to_pylist() if earlier is not None else None
            texts = _text_bytes(table.column("text").combine_chunks())
            cols: dict[str, list] = {n: [] for n in (OUT if final else state)}
            for i, text in enumerate(texts):
                words = words_of(text)
                ranges, items = scanner.scan(words)
                if earlier is not None:
                    flat = earlier[i]
                    ranges = union_ranges(ranges + list(zip(flat[::2], flat[1::2], strict=True)))
                    items |= set(before[i])
                if not final:
                    cols[state[0]].append([x for r in ranges for x in r])
                    cols[state[1]].append(sorted(items))
                    continue
                hit = sum(b - a for a, b in ranges)
                cols["n_words"].append(len(words))
                cols["n_hit"].append(hit)
                cols["items"].append(sorted(items))
                cols["hit_spans"].append(code_point_spans(text, ranges) if ranges else [])
                cols["contaminated"].append(hit > 0 and share * hit >= len(words))
            arrays = [table.column(n).combine_chunks() for n in names]
            if not final or keep_text:
                arrays.append(table.column("text").combine_chunks())
            arrays += [pa.array(v, target.field(n).type) for n, v in cols.items()]
            yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, target, strict=True)], schema=target)

    return scan


def op3_query(spark, sf_dir: str) -> DataFrame:
    """Contamination of every document by any benchmark item."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated"
    )


OP3_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 13) AS k, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, lens WHERE len(w) >= k)),
hits AS (SELECT dw.doc_id, dw.i, dw.k, bw.item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.g = bw.g),
nh AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id),
ni AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
 sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN nh ON d.doc_id = nh.doc_id LEFT JOIN ni ON d.doc_id = ni.doc_id
"""
