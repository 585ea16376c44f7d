"""Token-ID output: a wavelet matrix per shard, and the tokenizer that feeds it.

Documents are dealt by ranges of doc_id, sorted, and encoded; every shard of about shard_tokens tokens (at
least one document) becomes one file image: a header, the end offset of each document, and one bit-plane per
bit of the largest id, compressed. Images are rows (first doc_id, partition, number, image) of a Parquet
table in the shared folder, one row a file, so executors need no file system of their own and a lost one is redone by Spark.

A wavelet matrix orders each plane by the bits above it. access(i) follows one bit a plane; rank(id, i)
counts an id among the first i tokens; select(id, k) finds its k-th occurrence; all from the planes and a
popcount every 512 bits. tokens() undoes the planes for the whole shard at once.

Encoding: the tokenizer splits words at single blanks and line ends between visible characters whatever
stands around them, so such texts are encoded word by word, and each word once a worker (up to a bounded
number); other texts go to the tokenizer whole. Ids are those of the whole text.

Cases: null texts are empty and hold the end id only; ties of doc_id are ordered by text; a null doc_id comes
first; other columns are ignored; an empty table gives an empty table and no rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmesh.llm.tokens import give_back
from quillmesh.session import ship_package
from quillmesh.storage import Stage

MAGIC = b"QWM1"
STEP = 512
SHARD_TOKENS = 1 << 20
#: Words whose ids a worker keeps; each takes some 180 bytes.
KEPT_WORDS = 1_500_000
END_ID = 0

#: Where these stand, or any other white space, blanks don't split alike whatever stands around them; the last begins special tokens.
ODD = ("  ", "\n\n", " \n", "\n ", "<|")
#: ASCII punctuation but the apostrophe: at a word's end, a piece of its own.
TAIL = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def _byte_letters() -> dict[int, str]:
    """The visible character by which byte-level vocabularies write each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    out.update({b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in out)})
    return out


LETTERS = {b: c for b, c in _byte_letters().items()}


class _OddSpace(Exception):
    pass


class _Words(dict):
    """Ids of words as bytes; made when first met. When full, only words met since it was full before stay."""

    def __init__(self, encoder: Encoder, lead: str, most: int):
        self.encoder, self.lead, self.most, self.before = encoder, lead, most // 2, {}
        self.spelled, self.packed, self.tokenize = lead.replace(" ", LETTERS[32]), encoder.packed, encoder.model.tokenize

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.most:
            self.before = dict(self)
            self.clear()
        if self.before and (ids := self.before.pop(word, None)):
            pass
        elif word.isascii() and word.isalpha():  # as Encoder.word(), without its calls
            packed = self.packed
            ids = b"".join([packed[t.id] for t in self.tokenize(self.spelled + word)])
        else:
            ids = self.encoder.word(self.lead, word)
        self[word] = ids
        return ids


class Encoder:
    """A byte-level tokenizer file, with the words that were met."""

    def __init__(self, path: str, kept_words: int = KEPT_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.packed = [struct.pack("<I", k) for k in range(max(self.tokenizer.get_vocab().values(), default=0) + 1)]
        self.first, self.after = _Words(self, "", kept_words), _Words(self, " ", kept_words)
        self.line_end = self.whole("\n")
        self.tail = lru_cache(4096)(self._piece)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _piece(self, text: str) -> bytes:
        """Ids of a text that is one piece for the tokenizer."""
        spelled = text.replace(" ", LETTERS[32]) if text.isascii() else "".join([LETTERS[b] for b in text.encode()])
        packed = self.packed
        return b"".join([packed[t.id] for t in self.model.tokenize(spelled)])

    def word(self, lead: str, word: str) -> bytes:
        if word.isalpha():
            return self._piece(lead + word)
        if not word:
            return self.whole(lead)
        body = word.rstrip(TAIL)
        if body.isalpha():
            known = self.after if lead else self.first
            return (known[body] if body in known else known.setdefault(body, self._piece(lead + body))) + self.tail(word[len(body) :])
        if word.split() != [word]:
            raise _OddSpace
        return self.whole(lead + word) if body else self._piece(lead + word)

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of a text."""
        if not text:
            return b""
        if any(x in text for x in ODD):
            return self.whole(text)
        out = []
        try:
            for line in text.split("\n"):
                words = line.split(" ")
                out.append(self.first[words[0]] + b"".join(map(self.after.__getitem__, words[1:])))
        except _OddSpace:
            return self.whole(text)
        return self.line_end.join(out)


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, kept_words: int = KEPT_WORDS) -> Encoder:
    """One encoder is kept in each worker."""
    if (path, kept_words) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path, kept_words] = Encoder(path, kept_words)
    return _ENCODERS[path, kept_words]


#: Tokens of a plane that are parted at a time, so that their places stay in a core's cache.
PART = 1 << 15


def _parted(cur: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Those without the bit, then those with it; by places, as masks cost four times as much."""
    out, a = np.empty_like(cur), 0
    b = len(cur) - int(np.count_nonzero(ones))
    for at in range(0, len(cur), PART):
        some, bits = cur[at : at + PART], ones[at : at + PART]
        with_, without = np.flatnonzero(bits), np.flatnonzero(~bits)
        some.take(without, out=out[a : a + len(without)], mode="clip")
        some.take(with_, out=out[b : b + len(with_)], mode="clip")
        a, b = a + len(without), b + len(with_)
    return out


def build_image(ids: np.ndarray, ends: np.ndarray) -> bytes:
    """The file image of a shard: ids of its documents one after another, and where each document ends."""
    width = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    kind = np.uint16 if width <= 16 else np.uint32
    planes, cur = [], ids.astype(kind)
    for bit in range(width - 1, -1, -1):
        ones = (cur & kind(1 << bit)).astype(bool)
        planes.append(np.packbits(ones, bitorder="little").tobytes())
        if bit:
            cur = _parted(cur, ones)
    pack = zstandard.ZstdCompressor(level=1).compress
    head = MAGIC + struct.pack("<QII", len(ids), len(ends), width)
    blobs = [pack(np.asarray(ends, "<u8").tobytes()), *map(pack, planes)]
    return head + struct.pack(f"<{len(blobs)}Q", *map(len, blobs)) + b"".join(blobs)


class WaveletMatrix:
    """A shard read from its image."""

    def __init__(self, image: bytes):
        if image[:4] != MAGIC:
            raise ValueError("not a shard image")
        self.n, self.docs, self.width = struct.unpack_from("<QII", image, 4)
        sizes = struct.unpack_from(f"<{self.width + 1}Q", image, 20)
        at, blobs = 20 + 8 * (self.width + 1), []
        for size in sizes:
            blobs.append(zstandard.ZstdDecompressor().decompress(image[at : at + size]))
            at += size
        self.ends = np.frombuffer(blobs[0], "<u8").astype(np.int64)
        self.planes = [np.frombuffer(b, np.uint8) for b in blobs[1:]]
        self.sums = self.zeros = None

    def _bits(self, plane: np.ndarray) -> np.ndarray:
        return np.unpackbits(plane, count=self.n, bitorder="little").view(bool)

    def tokens(self) -> np.ndarray:
        """All ids in order."""
        kind = np.uint16 if self.width <= 16 else np.uint32
        out = np.zeros(self.n, kind)
        for bit, plane in enumerate(reversed(self.planes)):
            ones = self._bits(plane)
            if bit:
                below, out = out, np.empty(self.n, kind)
                zeros = self.n - int(np.count_nonzero(ones))
                out[np.flatnonzero(~ones)] = below[:zeros]
                out[np.flatnonzero(ones)] = below[zeros:] | kind(1 << bit)
            else:
                out |= ones
        return out.astype(np.uint32)

    def _index(self) -> None:
        if self.sums is None:
            counts = [np.bitwise_count(p).astype(np.int64) for p in self.planes]
            step = STEP // 8
            self.sums = [np.concatenate([[0], np.cumsum(np.add.reduceat(c, np.arange(0, len(c), step)))]) if len(c) else np.zeros(1, np.int64) for c in counts]
            self.zeros = [self.n - int(s[-1]) for s in self.sums]

    def _ones(self, level: int, i: int) -> int:
        """Set bits among the first i of a plane."""
        block = i // STEP
        part = self.planes[level][block * STEP // 8 : (i + 7) // 8]
        left = int(np.bitwise_count(part).sum())
        if i % 8 and len(part):
            left -= int(part[-1] >> (i % 8)).bit_count()
        return int(self.sums[level][block]) + left

    def _bit(self, level: int, i: int) -> int:
        return int(self.planes[level][i >> 3] >> (i & 7)) & 1

    def access(self, i: int) -> int:
        """The id at place i."""
        self._index()
        value = 0
        for level in range(self.width):
            bit = self._bit(level, i)
            i = self.zeros[level] + self._ones(level, i) if bit else i - self._ones(level, i)
            value = 2 * value + bit
        return value

    def _range(self, value: int, i: int) -> tuple[int, int]:
        lo, hi = 0, i
        for level in range(self.width):
            a, b = self._ones(level, lo), self._ones(level, hi)
            lo, hi = (self.zeros[level] + a, self.zeros[level] + b) if value >> (self.width - 1 - level) & 1 else (lo - a, hi - b)
        return lo, hi

    def rank(self, value: int, i: int | None = None) -> int:
        """Occurrences of an id among the first i tokens, or all."""
        if value >> self.width:
            return 0
        self._index()
        lo, hi = self._range(value, self.n if i is None else i)
        return hi - lo

    def select(self, value: int, k: int) -> int:
        """The place of the k-th (from 0) occurrence of an id; -1 if there are fewer."""
        if k < 0 or k >= self.rank(value):
            return -1
        at = self._range(value, 0)[0] + k
        for level in range(self.width - 1, -1, -1):
            one = value >> (self.width - 1 - level) & 1
            k = at - self.zeros[level] if one else at
            lo, hi = 0, self.n
            while lo < hi:  # the k-th bit of this kind
                mid = (lo + hi) // 2
                upto = self._ones(level, mid + 1)
                if (upto if one else mid + 1 - upto) > k:
                    hi = mid
                else:
                    lo = mid + 1
            at = lo
        return at


def _shard_rows(path: str, shard_tokens: int, kept_words: int):
    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, number = encoder(path, kept_words), TaskContext.get().partitionId(), 0
        end = np.array([END_ID], "<u4").tobytes()
        ids, names, held, size = [], [], [], 0

        def flush() -> pa.RecordBatch:
            image = build_image(np.frombuffer(b"".join(held), "<u4"), np.array(ids, np.int64))
            cols = [pa.array([names[0]], pa.int64()), pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([size], pa.int64()), pa.array([list(names)], pa.list_(pa.int64())), pa.array([image], pa.large_binary()).cast(pa.binary())]
            return pa.RecordBatch.from_arrays(cols, names=["first_doc", "part", "number", "n_tokens", "doc_ids", "image"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                got = enc.encode(text.as_py() or "") + end
                if size and size + len(got) // 4 > shard_tokens:
                    yield flush()
                    number += 1
                    ids, names, held, size = [], [], [], 0
                size += len(got) // 4
                held.append(got), ids.append(size), names.append(doc_id.as_py())
        if size:
            yield flush()
            held.clear()
        give_back()

    return shards


def write_shards(docs: DataFrame, tokenizer_path: str, stage: Stage, name: str = "shards", shard_tokens: int = SHARD_TOKENS, partitions: int | None = None, kept_words: int = KEPT_WORDS) -> DataFrame:
    """The shard table: (first_doc, part, number, n_tokens, doc_ids, image), in ascending doc_id order."""
    spark = docs.sparkSession
    ship_package(spark)
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    dealt = rows.repartitionByRange(partitions, "doc_id").sortWithinPartitions("doc_id", "text")
    return stage.put(dealt.mapInArrow(_shard_rows(tokenizer_path, shard_tokens, kept_words), "first_doc long, part int, number int, n_tokens long, doc_ids array<long>, image binary"), name, maxRecordsPerFile=1)


def _read_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for names, part, number, image in zip(*batch.columns, strict=True):
            shard = WaveletMatrix(image.as_py())
            raw = shard.tokens().astype("<u4").tobytes()
            first = np.concatenate([[0], shard.ends[:-1]])
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(first.tolist(), shard.ends.tolist(), strict=True)]
            n = len(first)
            cols = [names.values, pa.repeat(part, n), pa.repeat(number, n), pa.array(first), pa.array(shard.ends - first), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "part", "number", "first", "n_tokens", "ids_crc32"])
    give_back()


def read_shards(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the images."""
    order = Window.orderBy(F.col("first_doc").asc_nulls_first(), "part", "number")
    # one row a shard of a million tokens goes to the running sum, without its image
    before = shards.select("part", "number", (F.sum("n_tokens").over(order) - F.col("n_tokens")).alias("before"))
    rows = shards.select("doc_ids", "part", "number", "image").mapInArrow(_read_rows, "doc_id long, part int, number int, first long, n_tokens long, ids_crc32 long")
    return rows.join(before, ["part", "number"]).select("doc_id", (F.col("first") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def token_output(docs: DataFrame, tokenizer_path: str, kept_words: int = KEPT_WORDS) -> DataFrame:
    """Write documents as shards in the shared folder and read them back."""
    stage = Stage(docs.sparkSession, "token_output")
    return read_shards(write_shards(docs, tokenizer_path, stage, kept_words=kept_words))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op4_query(spark, sf_dir: str) -> DataFrame:
    """Start, length and checksum of every document's ids, from the files."""
    return token_output(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_tokenizer())
