"""Packing documents into training sequences along a space-filling curve.

A document becomes the ids of its tokens and an end id.  Its ids are hashed into
a vector of fixed length (signed counts, damped and normalised), which a fixed
random projection takes to a few dimensions.  The coordinates, spread evenly by
the normal distribution function, give the document's place on a Hilbert curve, so
that documents of similar words are near each other along it.

Documents are range-partitioned along the curve at boundaries that a sample of at
most ``SAMPLE_PER_RANGE`` documents a range (on average) gives.  The sample only
balances the ranges; every document is packed.  Equal keys are told apart by a
hash of the id, so copies of one text spread over ranges.  Within a range the ids
are laid end to end and cut wherever a sequence is full.  What is left at a
range's end is cut into sequences whose lengths are powers of two, largest first,
which need no padding.

Texts are encoded once.  Ids travel with two bytes each (four in vocabularies of
over 65536 pieces).
"""

from __future__ import annotations

import math
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import default_path, map_batches, shared_bytes, shuffle_partitions, text_of

MAX_TOKENS = 4096
#: hashed dimensions, dimensions of the curve, bits of each of those
HASHED, DIMS, BITS = 256, 4, 15
#: documents that set the boundaries, per range; ids that make a range worth having
SAMPLE_PER_RANGE, RANGE_TOKENS = 64, 1 << 19
#: chunks, and words within chunks, whose ids a worker remembers, in each of two generations
CHUNKS_KEPT, WORDS_KEPT = 400_000, 150_000
#: texts that are encoded at once
_ROWS = 256

#: pre-token pattern and normalizers of the vocabulary whose chunks are encoded one by one (fixed values)
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]


class Remembered:
    """A memo of two generations: what was used since the last change of generations survives it."""

    def __init__(self, size: int):
        self.size, self.new, self.old = size, {}, {}

    def put(self, key, value):
        if len(self.new) >= self.size:
            self.old, self.new = self.new, {}
        self.new[key] = value
        return value


class Ids:
    """Ids of whole texts as the library gives them, without special tokens added, packed in two or four bytes each."""

    loaded: dict = {}

    @classmethod
    def load(cls, data: bytes) -> Ids:
        key = zlib.crc32(data), len(data)
        if key not in cls.loaded:
            cls.loaded[key] = cls(data)
        return cls.loaded[key]

    def __init__(self, data: bytes):
        import json
        import os
        import re

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_buffer(data)
        self.model = self.library.model
        self.kind = np.dtype(np.uint16 if self.library.get_vocab_size(with_added_tokens=True) <= 1 << 16 else np.uint32)
        self.code = "H" if self.kind.itemsize == 2 else "I"
        spec = json.loads(data)
        cut = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        added = spec.get("added_tokens") or []
        # white space is dropped and parts every match, so chunks between it can be encoded one by one
        self.by_chunk = ((spec.get("normalizer") or {}).get("normalizers") == _NORMAL and len(cut) == 2 and cut[0].get("pattern") == {"Regex": _WORDS}
                         and cut[0].get("behavior") == "Removed" and cut[0].get("invert") and cut[1].get("type") == "ByteLevel"
                         and not cut[1].get("add_prefix_space") and not cut[1].get("use_regex")
                         and not any(a["lstrip"] or a["rstrip"] or a["single_word"] or a["normalized"] or a["content"].split() != [a["content"]] for a in added))
        # what the pattern does within ASCII and the letters of Latin-1, where lower-casing is plain and NFC changes nothing;
        # without the signs that special strings begin with
        special = "".join(re.escape(x) for x in {a["content"][:1] for a in added}) or "\x00"
        self.plain = re.compile(f"(?:(?![{special}])[\x21-\x7e\xc0-\xd6\xd8-\xf6\xf8-\xff]){{1,256}}").fullmatch
        self.words = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^a-z0-9\xdf-\xf6\xf8-\xff]+").findall
        self.odd_blank = re.compile("[\x1c-\x1f]").search
        self.blanks = re.compile(r"[^\S\x1c-\x1f]+")
        # byte-level signs: printable Latin-1 stands for itself, other bytes for signs from 256 on
        own = {*range(33, 127), *range(161, 173), *range(174, 256)}
        other = iter(range(256, 512))
        self.sign = [chr(b) if b in own else chr(next(other)) for b in range(256)]
        self.chunks, self.parts = Remembered(CHUNKS_KEPT), Remembered(WORDS_KEPT)

    def _packed(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        found = self.chunks.old.get(chunk)
        if found is None:
            if self.plain(chunk):
                low = chunk.lower()
                found = self._word(low) if low.isalpha() else b"".join([self._word(w) for w in self.words(low)])
            else:
                found = self._packed(self.library.encode(chunk, add_special_tokens=False).ids)
        return self.chunks.put(chunk, found) if len(chunk) <= 64 else found

    def _word(self, word: str) -> bytes:
        found = self.parts.new.get(word)
        if found is None:
            found = self.parts.old.get(word)
            if found is None:
                signs = word if word.isascii() else "".join([self.sign[b] for b in word.encode()])
                found = self._packed([t.id for t in self.model.tokenize(signs)])
            self.parts.put(word, found)
        return found

    def encode(self, text: str) -> bytes:
        if not self.by_chunk:
            return self._packed(self.library.encode(text, add_special_tokens=False).ids)
        chunks = [c for c in self.blanks.split(text) if c] if self.odd_blank(text) else text.split()
        known = self.chunks.new
        return b"".join([known.get(c) or self._chunk(c) for c in chunks])


# ------------------------------------------------------------ the curve

_rng = np.random.default_rng(20240311)
_PROJECTION = _rng.standard_normal((HASHED, DIMS))


def hashed_place(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Dimension and sign of each id in the hashed vector."""
    h = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(40)).astype(np.int64) % HASHED, 1.0 - 2.0 * ((h >> np.uint64(33)) & np.uint64(1)).astype(np.float64)


def hashed_vector(ids: np.ndarray) -> np.ndarray:
    """Signed counts of hashed ids, damped and of length one (zero without ids)."""
    place, sign = hashed_place(ids)
    counts = np.bincount(place, sign, HASHED)
    damped = np.sign(counts) * np.log1p(np.abs(counts))
    return damped / max(math.sqrt(float((damped ** 2).sum())), 1e-12)


def grid(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Coordinates 0 .. 2^bits - 1 of projected vectors, spread evenly by the normal distribution function."""
    # logistic form of the distribution function; off by less than 0.01
    share = 1 / (1 + np.exp(-1.702 * points))
    return np.minimum((share * (1 << bits)).astype(np.int64), (1 << bits) - 1)


def hilbert(coordinates: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places on the Hilbert curve, by turning coordinates into the curve's transposed index bit by bit."""
    x = coordinates.astype(np.int64).T.copy()
    dims = len(x)
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for i in range(dims):
            high = ((x[i] >> b) & 1).astype(bool)
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] >> b) & 1, (1 << b) - 1, 0)
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


# ------------------------------------------------------------ Spark

def _encoded(vocabulary, end: int, bounds):
    """(id, tie, text) -> (range, key, tie, id, packed ids); without bounds the range is 0 and no ids are given out."""

    def run(batches):
        ids_of = Ids.load(vocabulary.value)
        last = np.array([end], ids_of.kind).tobytes()
        for whole in batches:
            for at in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(at, _ROWS)
                ids, points = [], np.zeros((batch.num_rows, HASHED))
                for i, text in enumerate(batch.column(2).to_pylist()):
                    data = ids_of.encode(text)
                    points[i] = hashed_vector(np.frombuffer(data, ids_of.kind))
                    ids.append(data + last)
                key, tie = hilbert(grid(points @ _PROJECTION)), batch.column(1).to_numpy(zero_copy_only=False)
                n = np.array([len(x) // ids_of.kind.itemsize for x in ids], np.int64)
                if bounds is None:
                    yield {"range": np.zeros(len(key), np.int64), "key": key, "tie": tie, "id": batch.column(0), "n": n, "ids": [b""] * len(key)}
                    continue
                keys, ties = bounds.value
                # ranges of equal keys are parted by the tie
                low, high = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
                place = [a + int(np.searchsorted(ties[a:b], t, "right")) if a < b else a for a, b, t in zip(low.tolist(), high.tolist(), tie.tolist(), strict=True)]
                yield {"range": place, "key": key, "tie": tie, "id": batch.column(0), "n": n, "ids": ids}

    return run


def lengths(total: int, most: int) -> list[int]:
    """Sequences for so many ids: full ones, then the rest in powers of two."""
    rest = total % most
    return [most] * (total // most) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def _cut(vocabulary, most: int):
    """Documents of a range in curve order -> their pieces.  Only the ids of the range's last, unfinished sequence are held back."""

    def run(batches):
        kind = Ids.load(vocabulary.value).kind
        held: list[tuple] = []  # pieces of the sequence in work
        sequence = filled = 0
        place = None

        def given(pieces, number):
            return {"id": pa.concat_arrays([p[0] for p in pieces]), "start": [p[1] for p in pieces], "length": [p[2] for p in pieces],
                    "ids": [p[3].astype("<u4").tobytes() for p in pieces], "doc_tokens": [p[4] for p in pieces],
                    "sequence_id": [(place << 40) + number] * len(pieces), "offset": np.cumsum([0, *(p[2] for p in pieces)])[:-1]}

        for whole in batches:
            for i in range(whole.num_rows):
                place = whole.column(0)[i].as_py()
                doc, ids = whole.column(3).slice(i, 1), np.frombuffer(whole.column(5)[i].as_py(), kind)
                at = 0
                while at < len(ids):
                    take = min(len(ids) - at, most - filled)
                    held.append((doc, at, take, ids[at:at + take], len(ids)))
                    at, filled = at + take, filled + take
                    if filled == most:
                        yield given(held, sequence)
                        held, filled, sequence = [], 0, sequence + 1
        # the rest, in powers of two
        for size in lengths(filled, most):
            pieces, room = [], size
            while room:
                doc, start, n, ids, total = held.pop(0)
                take = min(n, room)
                pieces.append((doc, start, take, ids[:take], total))
                if take < n:
                    held.insert(0, (doc, start + take, n - take, ids[take:], total))
                room -= take
            yield given(pieces, sequence)
            sequence += 1

    return run


def pack(docs: DataFrame, path: str | None = None, end: int = 2, most: int = MAX_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, length, ids, doc_tokens, sequence_id, offset), a row per piece of a document.

    ``ids`` holds the piece's ids, little-endian unsigned 32-bit.  A sequence has
    ``most`` ids or, at the end of a range, a power of two of them; its pieces fill
    it without gaps from 0.  Sequence ids are unique, but not consecutive.
    ``most`` must be a power of two.

    Null and empty texts are a document of the end id alone.  Documents are packed
    row by row: repeated rows, and rows with equal or null ids, stay apart, though
    their ``start`` values can then be told apart by the sequence only.  Texts are
    taken whole.  Other columns are not read.  An empty table gives an empty result.
    """
    if most < 1 or most & (most - 1):
        raise ValueError("the longest sequence must be a power of two")
    spark = docs.sparkSession
    vocabulary = shared_bytes(spark, path or default_path("word_bpe_49k.json"))
    kind = docs.schema[id_col].dataType
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text_of(docs, text_col).alias("text"))
    rows = rows.select("id", F.xxhash64("id", F.when(F.col("id").isNull(), F.monotonically_increasing_id())).alias("tie"), "text")
    schema = T.StructType([T.StructField("range", T.IntegerType()), T.StructField("key", T.LongType()), T.StructField("tie", T.LongType()),
                           T.StructField("id", kind), T.StructField("n", T.LongType()), T.StructField("ids", T.BinaryType())])

    ranges = shuffle_partitions(spark)
    n = docs.select(F.lit(1)).count()
    wanted = ranges * SAMPLE_PER_RANGE
    sample = (rows if n <= wanted else rows.sample(wanted / n, 7)).repartition(min(ranges, max(1, n // 64)))
    seen = sorted((r["key"], r["tie"], r["n"]) for r in map_batches(sample, _encoded(vocabulary, end, None), schema).select("key", "tie", "n").collect())
    tokens = sum(s[2] for s in seen)
    ranges = max(1, min(ranges, int(tokens * max(1.0, n / max(len(seen), 1)) / RANGE_TOKENS)))
    ends = np.cumsum([s[2] for s in seen])
    at = sorted({int(np.searchsorted(ends, tokens * k / ranges)) for k in range(1, ranges)}) if seen else []
    bounds = spark.sparkContext.broadcast((np.array([seen[i][0] for i in at], np.int64), np.array([seen[i][1] for i in at], np.int64)))

    dealt = map_batches(rows, _encoded(vocabulary, end, bounds), schema)
    ordered = dealt.repartitionById(len(at) + 1, "range").sortWithinPartitions("key", "tie", "id")
    pieces = map_batches(ordered, _cut(vocabulary, most), T.StructType([
        T.StructField("id", kind), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType()),
        T.StructField("doc_tokens", T.LongType()), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))
    return pieces.withColumnRenamed("id", id_col)


def packed_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, sequence_id, offset): the pieces with a checksum in place of their ids."""
    return pack(docs, id_col=id_col, text_col=text_col).select(id_col, "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
