"""Near-duplicate documents by b-bit MinHash, confirmed on full shingle sets.

A document's set holds its distinct five-word shingles.  256 minima are taken of
it.  Bands of five minima give candidates; the two lowest bits of each (mixed)
minimum, packed into eight longs, give an estimate by counting equal pairs of
bits: of the share m of equal ones a quarter is chance, so the similarity is
about (m - 1/4) / (3/4).  Candidates whose estimate is far too low go; the rest
are compared on their full sets.

With 45 bands of five a pair at the threshold of 0.75 is missed by the bands with
probability 5e-6 and by the estimate (cut at 0.58, five deviations below) with
1e-7; more alike pairs less often.

The two bits of 64 minima lie in two longs, one a plane, so that 64 minima are
compared by two differences, one union and one count; no signature holds nulls.
Both keep the generated method of the join by bucket small enough for the JVM to
compile it.  A signature is one struct, whose longs are read where they are
compared: as columns, all 64 of a pair are live at once in that method.

Documents of equal word sequences are one node from the start.  A bucket isn't
expanded into its pairs: twice, each document is compared with one document of
another component, the best by estimate among the most central ones of its
buckets, which joins most of a group of near copies.  What is left are documents
whose buckets still hold different components.  They get a longer signature of
1024 minima, whose estimate tells a link from a pair that merely shares a passage
(cut at 0.67, again five deviations).  A join by bucket estimates their pairs and
gives out only those that pass, each one in the first bucket that it shares; these
are compared in full, so no link between candidates is lost.  Joins are plain ones
that Spark splits when a key is hot.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.cut import cut
from .common import map_batches, text_of
from .graphs import joined_by

SHINGLE = 5
MINIMA, BANDS, BAND_ROWS = 256, 45, 5
#: minima of the longer signature
LONG_MINIMA = 1024
#: rows that a worker turns into Python objects at once, however many an Arrow batch has
ROWS = 512
#: rounds of one comparison each before the exact rest
PIVOT_ROUNDS = 2
#: bits of the filter that spares the sets of documents without candidates (8 MB at any input size)
FILTER_BITS = 1 << 26
_BITMAP = 1 << 15

_rng = np.random.default_rng(20240229)
_TIMES = _rng.integers(0, 1 << 32, LONG_MINIMA, dtype=np.uint32) | np.uint32(1)
_PLUS = _rng.integers(0, 1 << 32, LONG_MINIMA, dtype=np.uint32)
_FOLD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def _in_parts(batches):
    """Slices of at most ROWS rows; they share the batch's memory."""
    for batch in batches:
        for first in range(0, batch.num_rows, ROWS):
            yield batch.slice(first, ROWS)


def shingle_set(text: str) -> tuple[np.ndarray, bytes]:
    """Sorted 64-bit hashes of a text's distinct shingles, and a key of its word sequence."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()
    key = hashlib.blake2b(b" ".join(words), digest_size=16).digest()
    if not words:
        return np.zeros(0, np.uint64), key
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    size = min(SHINGLE, len(words))
    n = len(words) - size + 1
    total = np.full(n, np.uint64(size))
    for i in range(size):
        total = total * _FOLD + h[i:i + n]
    total ^= total >> np.uint64(32)
    total *= _MIX
    total ^= total >> np.uint64(29)
    return np.unique(total), key


def minima(shingles: np.ndarray, count: int = MINIMA) -> np.ndarray:
    """The first minima of a set that isn't empty."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(count, np.uint32(0xFFFFFFFF))
    for at in range(0, len(x), 1024):
        values = np.multiply.outer(_TIMES[:count], x[at:at + 1024])
        values += _PLUS[:count, None]
        np.minimum(least, values.min(axis=1), out=least)
    return least


def _packed(least: np.ndarray) -> dict[str, pa.Array]:
    """Two bits of each minimum, one bit of 64 of them in a long: columns s0 and t0, s1 and t1, ..."""
    rows, count = least.shape
    low = ((least.astype(np.uint64) * _MIX) >> np.uint64(62)).reshape(rows, count // 64, 64)
    places = np.arange(64, dtype=np.uint64)
    planes = {"s": low & np.uint64(1), "t": low >> np.uint64(1)}
    packed = {plane: (bits << places).sum(axis=2, dtype=np.uint64) for plane, bits in planes.items()}
    return {c: pa.array(np.ascontiguousarray(packed[c[0]][:, int(c[1:])]).view(np.int64)) for c in _columns(count)}


def _columns(count: int) -> list[str]:
    return [f"{plane}{i}" for i in range(count // 64) for plane in "st"]


def _signature(count: int) -> Column:
    """The packed signature as one column."""
    return F.struct(*_columns(count)).alias("sig")


def _fields(count: int) -> list[T.StructField]:
    return [T.StructField(c, T.LongType(), False) for c in _columns(count)]


def _signatures(batches):
    numbers = np.arange(BANDS, dtype=np.uint64)
    for batch in _in_parts(batches):
        texts = batch.column(1).to_pylist()
        keys, sizes = [], np.zeros(len(texts), np.int64)
        least = np.zeros((len(texts), MINIMA), np.uint32)
        for i, text in enumerate(texts):
            found, key = shingle_set(text)
            keys.append(key)
            sizes[i] = len(found)
            if len(found):
                least[i] = minima(found)
        bands = np.zeros((len(texts), BANDS), np.uint64) + numbers
        for j in range(BAND_ROWS):
            bands = bands * _FOLD + least[:, j:BANDS * BAND_ROWS:BAND_ROWS]
            bands ^= bands >> np.uint64(31)
        offsets = pa.array(np.arange(len(texts) + 1, dtype=np.int32) * BANDS)
        yield {"id": batch.column(0), "key": keys, "n": pa.array(sizes), "bands": pa.ListArray.from_arrays(offsets, pa.array(bands.reshape(-1).view(np.int64))), **_packed(least)}


def _long_signatures(batches):
    """(id, shingles) -> id and the longer signature."""
    for batch in _in_parts(batches):
        least = np.array([minima(np.frombuffer(x, np.uint64), LONG_MINIMA) for x in batch.column(1).to_pylist()]).reshape(-1, LONG_MINIMA)
        yield {"id": batch.column(0), **_packed(least)}


def estimate(left: str, right: str, count: int = MINIMA) -> Column:
    """Similarity of two packed signatures (column prefixes, or structs with a dot), corrected for chance equality of two bits."""
    return ((1 - _different(left, right, 0, count) / count) - 0.25) / 0.75


def _different(left: str, right: str, first: int, last: int) -> Column:
    """How many of the minima first..last-1 differ in one of their two bits."""
    differ = F.lit(0)
    for i in range(first // 64, last // 64):
        s, t = (F.col(f"{left}{plane}{i}").bitwiseXOR(F.col(f"{right}{plane}{i}")) for plane in "st")
        differ = differ + F.bit_count(s.bitwiseOR(t))
    return differ


def least_estimate(percent: int, count: int) -> float:
    """Five deviations below the threshold's own estimate."""
    p = 0.25 + 0.75 * percent / 100
    return percent / 100 - 5 * math.sqrt(p * (1 - p) / count) / 0.75


def _may_link(left: str, right: str, percent: int, count: int = MINIMA) -> Column:
    """What both the sizes and the estimate allow."""
    a, b = F.col(f"{left}n"), F.col(f"{right}n")
    return (100 * F.least(a, b) >= percent * F.greatest(a, b)) & (estimate(f"{left}sig.", f"{right}sig.", count) >= least_estimate(percent, count))


def _prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*(F.col(c).alias(prefix + c) for c in df.columns))


def _sets_of(wanted):
    """(id, place in the filter, text) -> sets of the documents that the filter may hold."""

    def run(batches):
        bits = wanted.value
        for batch in _in_parts(batches):
            place = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            rows = np.flatnonzero((bits[place >> 3] >> (place & 7)) & 1)
            part = batch.take(pa.array(rows))
            yield {"id": part.column(0), "shingles": [shingle_set(t)[0].tobytes() for t in part.column(2).to_pylist()]}

    return run


def _filter_of(ids: DataFrame) -> np.ndarray:
    """A bitmap of fixed size that holds the hashed ids."""
    place = F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS))
    rows = ids.select(place.alias("p")).groupBy(F.floor(F.col("p") / _BITMAP).alias("k")).agg(F.bitmap_construct_agg(F.col("p") % _BITMAP).alias("bits")).collect()
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for row in rows:
        bits[row["k"] * _BITMAP // 8:(row["k"] + 1) * _BITMAP // 8] = np.frombuffer(bytes(row["bits"]), np.uint8)
    return bits


def shingle_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, shingles) of the wanted documents; docs has id and text."""
    wanted = docs.sparkSession.sparkContext.broadcast(_filter_of(ids))
    place = F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS))
    kind = docs.schema["id"].dataType
    found = map_batches(docs.where("id IS NOT NULL").select("id", place.alias("place"), "text"), _sets_of(wanted), T.StructType([
        T.StructField("id", kind), T.StructField("shingles", T.BinaryType())]))
    return found.join(ids, "id", "left_semi")


def _linked(percent: int):
    def run(batches):
        for batch in _in_parts(batches):
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            part = batch.filter(pa.array(keep))
            yield {"a": part.column(0), "b": part.column(1)}

    return run


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the (a, b) pairs whose full sets are similar enough."""
    kind = pairs.schema["a"].dataType
    paired = pairs.select(F.col("a").alias("id")).distinct().unionByName(pairs.select(F.col("b").alias("id")).distinct()).distinct()
    sets = sets.join(paired, "id", "left_semi")
    with_sets = pairs.join(_prefixed(sets, "a_"), F.col("a") == F.col("a_id")).join(_prefixed(sets, "b_"), F.col("b") == F.col("b_id"))
    return map_batches(with_sets.select("a", "b", "a_shingles", "b_shingles"), _linked(percent), T.StructType([T.StructField("a", kind), T.StructField("b", kind)]))


def _estimated(pairs: DataFrame, signed: DataFrame) -> DataFrame:
    """(a, b) pairs with both signatures."""
    return pairs.join(_prefixed(signed, "a_"), F.col("a") == F.col("a_id")).join(_prefixed(signed, "b_"), F.col("b") == F.col("b_id"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row; percent: least similarity of a link.

    Words are what stands between white space, A-Z lower-cased.  A text of fewer
    than five words has its whole sequence as its one shingle; null texts and
    texts without a word have none and are linked with nothing.  ``component_id``
    is the smallest id reachable over links; ``kept`` marks the rows with that
    id.

    Rows with one id are one document: its texts count as linked.  Rows with a
    null id are linked with nothing, have a null component and are kept.  Texts
    are taken whole.  Other columns are not read.  An empty table gives an empty
    result.
    """
    kind = docs.schema[id_col].dataType
    narrow = docs.select(F.col(f"`{id_col}`").alias("id"), text_of(docs, text_col).alias("text"))
    rows = cut(map_batches(narrow, _signatures, T.StructType([
        T.StructField("id", kind), T.StructField("key", T.BinaryType()), T.StructField("n", T.LongType(), False), T.StructField("bands", T.ArrayType(T.LongType())),
        *_fields(MINIMA)])))

    # equal word sequences: one node, named by its smallest id
    named = rows.where("n > 0 AND id IS NOT NULL")
    nodes = named.groupBy("key").agg(F.min("id").alias("node"))
    node = named.join(nodes.select(F.col("key").alias("k"), F.col("node").alias("m")), (F.col("key") == F.col("k")) & (F.col("id") == F.col("m")), "left_semi")
    buckets = node.select("id", F.explode("bands").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.count("*").alias("many")).where("many > 1")
    many = cut(buckets.join(shared, "bucket"))
    signed = cut(named.select("id", "n", _signature(MINIMA)).join(many.select("id").distinct(), "id", "left_semi"))

    # one comparison each: with the best, in another component, of the most central documents of its buckets
    central = many.groupBy("id").agg(F.sum("many").alias("weight"))
    pivots = cut(many.join(central, "id").groupBy("bucket").agg(F.max(F.struct("weight", "id")).alias("top")).select("bucket", F.col("top.id").alias("b")))
    sets = cut(shingle_sets(narrow, many.select("id").distinct()))
    held = joined = None
    for _ in range(PIVOT_ROUNDS):
        if joined is None:
            first = many.join(pivots, "bucket").where("id <> b").select(F.col("id").alias("a"), "b").distinct()
        else:
            there = pivots.join(joined, F.col("b") == F.col("node"), "left").select("bucket", "b", F.coalesce("component", "b").alias("other"))
            first = held.join(there, "bucket").where("component <> other").select(F.col("id").alias("a"), "b").distinct()
        first = _estimated(first, signed).where(_may_link("a_", "b_", percent)).groupBy("a").agg(F.max_by("b", F.struct(estimate("a_sig.", "b_sig."), "b")).alias("b"))
        joined = joined_by(joined, confirmed(cut(first), sets, percent))
        held = many.join(joined, F.col("id") == F.col("node"), "left").select("bucket", "id", F.coalesce("component", "id").alias("component"))

    # the rest: documents whose buckets hold several components
    mixed = held.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("bucket")
    left = cut(held.join(mixed, "bucket", "left_semi"))
    ids = left.select("id").distinct()
    longer = map_batches(sets.join(ids, "id", "left_semi"), _long_signatures, T.StructType([
        T.StructField("id", kind), *_fields(LONG_MINIMA)])).select("id", _signature(LONG_MINIMA))
    known = node.select("id", "n", "bands").join(ids, "id", "left_semi").join(longer, "id")
    here = left.join(known, "id")
    before = F.slice("bands", F.lit(1), F.array_position("bands", F.col("bucket")).cast("int") - 1)
    here = here.select("bucket", "id", "component", "n", before.alias("before"), "sig")
    second = _prefixed(here, "a_").join(_prefixed(here, "b_"), (F.col("a_bucket") == F.col("b_bucket")) & (F.col("a_id") < F.col("b_id")) & (F.col("a_component") != F.col("b_component"))
                                        & _may_link("a_", "b_", percent, LONG_MINIMA) & ~F.arrays_overlap("a_before", "b_before"))
    joined = joined_by(joined, confirmed(cut(second.select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))), sets, percent))

    of_node = nodes.join(joined.withColumnRenamed("node", "x"), F.col("node") == F.col("x"), "left").select("key", F.coalesce("component", "node").alias("c"))
    by_key = rows.select("id", "key", "n").join(of_node, "key", "left")
    return by_key.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
        F.when(F.col("id").isNotNull(), F.coalesce("c", "id")).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col(f"`{id_col}`") == F.col("component_id"), F.lit(True)))
