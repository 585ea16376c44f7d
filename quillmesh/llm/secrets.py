"""Secret scans: keyword prefilter by one automaton, anchored expressions at its hits, checksum validation.

One Aho-Corasick automaton over lower-cased keywords scans each text once; only where a keyword starts is
the expression of its kind tried, anchored there. Kinds with an embedded checksum are kept only if it holds; the base
kinds have none. Runs of hexadecimal digits have one keyword, too, 16 digits, found in the text with every digit as one
sign by a substring search, which is an automaton's work for a single keyword.

Kinds, in this order: assign, access, hex (base kinds: whole match, leftmost and non-overlapping per kind),
github and npm (tokens whose last six base-62 digits are the CRC-32 of the thirty characters before).

Cases: null and empty texts have no spans; spans are code points, end exclusive; repeated rows are scanned
each; columns other than doc_id and text are carried unless they carry an output's name; empty tables give no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quillmesh.session import ship_package

KINDS = ["assign", "access", "hex", "github", "npm"]
BASE = 3
#: Keywords by kind.
KEYWORDS = {
    "assign": ["password", "passwd", "secret", "token", "api_key", "apikey"],
    "access": ["akia"],
    "github": ["ghp_", "gho_", "ghu_", "ghs_", "ghr_"],
    "npm": ["npm_"],
}
ASSIGN = re.compile(rb"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{16,}")
#: Hexadecimal digits as one sign; 16 of it are the keyword of their kind.
HEX_SIGN = bytes(1 if b in b"0123456789abcdef" else 0 for b in range(256))
HEX_KEY = b"\x01" * 16
CHECKED = {"github": re.compile(rb"gh[pousr]_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])"), "npm": re.compile(rb"npm_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")}
DIGITS = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def base62(n: int, width: int = 6) -> bytes:
    out = bytearray()
    for _ in range(width):
        n, r = divmod(n, 62)
        out.append(DIGITS[r])
    return bytes(reversed(out))


@lru_cache(1)
def _automaton():
    a = ahocorasick.Automaton(ahocorasick.STORE_ANY)
    for kind, words in KEYWORDS.items():
        for w in words:
            a.add_word(w, (kind, len(w)))
    a.make_automaton()
    return a


def find_spans(text: bytes) -> list[tuple[int, int, int]]:
    """(start, kind number, end) in bytes, sorted."""
    spans = []
    signs, at = text.translate(HEX_SIGN), 0
    while (at := signs.find(HEX_KEY, at)) >= 0:
        # the first sign of the first 16 in a row, so the expression begins where the run does
        end = HEX.match(text, at).end()
        spans.append((at, 2, end))
        at = end
    # lower() of bytes folds A-Z only; one character a byte keeps the places
    hits = sorted((end + 1 - n, kind) for end, (kind, n) in _automaton().iter(text.lower().decode("latin-1")))
    done = dict.fromkeys(KINDS, 0)
    for start, kind in hits:
        if start < done[kind]:
            continue
        if kind == "assign":
            if m := ASSIGN.match(text, start):
                done[kind] = m.end()
                if m.end(2) - m.start(2) >= 12:
                    spans.append((start, 0, m.end()))
        elif kind == "access":
            if m := ACCESS.match(text, start):
                done[kind] = m.end()
                if m.end() - start >= 18:
                    spans.append((start, 1, m.end()))
        elif (m := CHECKED[kind].match(text, start)) and base62(zlib.crc32(m[1])) == m[2]:
            done[kind] = m.end()
            spans.append((start, KINDS.index(kind), m.end()))
    return sorted(spans)


def scan_secrets(docs: DataFrame) -> DataFrame:
    """docs without text, with secrets: an array of (kind, start, end) by start, then kind as listed."""
    ship_package(docs.sparkSession)
    docs = docs.drop("secrets")
    kept = [f for f in docs.schema.fields if f.name != "text"]
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType([*kept, T.StructField("secrets", T.ArrayType(span))])
    target = to_arrow_schema(schema)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            texts = pc.fill_null(table.column("text").combine_chunks().cast(pa.large_string()), "").cast(pa.large_binary())
            found = []
            for x in texts:
                text = x.as_py()
                spans = find_spans(text)
                if spans and not text.isascii():
                    points = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
                    spans = [(int(points[a]), k, int(points[b])) for a, k, b in spans]
                found.append([{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans])
            arrays = [table.column(f.name).combine_chunks().cast(target.field(f.name).type) for f in kept]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(found, target.field("secrets").type)], schema=target)

    return docs.mapInArrow(scan, schema)


def op9_query(spark, sf_dir: str) -> DataFrame:
    """Counts and spans of secrets in every document."""
    found = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("secrets", lambda s: s["kind"].isin(*KINDS[:BASE]))
    return found.select(
        "doc_id", of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans")
    )
