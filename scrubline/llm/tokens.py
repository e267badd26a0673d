"""Token counts: pieces are counted once per distinct pre-token and never per document.

A byte-level BPE tokenizer cuts a text into pre-tokens and encodes each one by
itself, so a document's token count is the sum over its pre-tokens of
frequency x pieces.  Documents are read in blocks.  A block turns into postings,
that is for each distinct pre-token the documents that hold it and how often;
postings are shuffled by pre-token in packed form, so every pre-token meets its
piece count in one place, and what comes back are sums per document.  No id is
stored for any document.

A pre-token that over an eighth of a block's documents hold is dealt by
(pre-token, block), so that a frequent word isn't one task's work; it's encoded
once in each task that it reaches.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import default_path, map_batches, shared_bytes, shuffle_partitions, text_of

#: pre-token pattern of byte-level BPE vocabularies of this family (fixed values)
PRETOKEN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
            r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")

BLOCK_DOCS, BLOCK_CHARS = 8192, 24_000_000
#: entries of running sums and of the memo of piece counts that a task keeps before it writes or clears them
SUMS_KEPT, COUNTS_KEPT = 4_000_000, 1_000_000

_LOADED: dict = {}


def _tokenizer(data: bytes):
    key = zlib.crc32(data), len(data)
    if key not in _LOADED:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _LOADED[key] = Tokenizer.from_buffer(data)
    return _LOADED[key]


def _check(data: bytes) -> list[str]:
    """Special strings of the vocabulary; refuses files whose texts aren't cut by PRETOKEN."""
    import json

    spec = json.loads(data)
    cut = spec.get("pre_tokenizer") or {}
    if spec.get("normalizer") or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True):
        raise ValueError("token counts by pre-token need a plain byte-level vocabulary")
    for added in spec.get("added_tokens") or []:
        if added["lstrip"] or added["rstrip"] or added["single_word"]:
            raise ValueError("special strings that take white space with them are not supported")
    return [added["content"] for added in spec.get("added_tokens") or []]


def _pack(n: list[int]) -> bytes:
    """Frequencies: nothing if all are 1, else bytes or 32-bit numbers."""
    top = max(n)
    return b"" if top == 1 else np.array(n, np.uint8 if top < 256 else np.uint32).tobytes()


def _unpack(data: bytes, size: int) -> np.ndarray:
    if not data:
        return np.ones(size, np.int64)
    return np.frombuffer(data, np.uint8 if len(data) == size else np.uint32).astype(np.int64)


def _postings(specials: list[str], buckets: int):
    """Blocks of documents -> one row per (block, bucket), and one header row per block."""

    def run(batches):
        import regex
        from pyspark import TaskContext

        cut = regex.compile(PRETOKEN).findall
        special = regex.compile("|".join(map(regex.escape, sorted(specials, key=len, reverse=True)))) if specials else None
        first = TaskContext.get().partitionId() << 32
        ids, texts, size, block = [], [], 0, first

        def close():
            where: dict[str, list[int]] = {}
            often: dict[str, list[int]] = {}
            extra = []
            for i, text in enumerate(texts):
                found = 0
                if special and special.search(text):
                    parts = special.split(text)
                    found = len(parts) - 1
                    words = Counter(w for part in parts for w in cut(part))
                else:
                    words = Counter(cut(text))
                extra.append(found)
                for word, n in words.items():
                    if word in where:
                        where[word].append(i)
                        often[word].append(n)
                    else:
                        where[word], often[word] = [i], [n]
            rows: dict[int, list[str]] = {}
            for word in where:
                h = zlib.crc32(word.encode("utf-8", "surrogatepass"))
                if 8 * len(where[word]) > len(texts) and len(texts) > 8:
                    h += zlib.crc32(str(block).encode())
                rows.setdefault(h % buckets, []).append(word)
            n = len(rows)
            out = {"bucket": list(rows), "block": [block] * n, "words": [], "sizes": [], "n_docs": [], "docs": [], "times": [],
                   "ids": [None] * n, "n_bytes": [None] * n, "extra": [None] * n}
            for words in rows.values():
                words.sort()
                raw = [w.encode("utf-8", "surrogatepass") for w in words]
                flat = [t for w in words for t in often[w]]
                out["words"].append(b"".join(raw))
                out["sizes"].append(np.array([len(r) for r in raw], np.uint32).tobytes())
                out["n_docs"].append(np.array([len(where[w]) for w in words], np.uint16).tobytes())
                out["docs"].append(np.array([d for w in words for d in where[w]], np.uint16).tobytes())
                out["times"].append(_pack(flat))
            for name in ("words", "sizes", "n_docs", "docs", "times"):
                out[name].append(None)
            out["bucket"].append(block % buckets)
            out["block"].append(block)
            out["ids"].append(list(ids))
            out["n_bytes"].append([len(t.encode("utf-8", "surrogatepass")) for t in texts])
            out["extra"].append(extra)
            return out

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(doc)
                texts.append(text)
                size += len(text)
                if len(texts) >= BLOCK_DOCS or size >= BLOCK_CHARS:
                    yield close()
                    ids, texts, size, block = [], [], 0, block + 1
        if texts:
            yield close()

    return run


def _counted(vocabulary):
    """Postings of whole buckets -> sums per block, written in packed form."""

    def run(batches):
        tokenizer = _tokenizer(vocabulary.value)
        pieces: dict[bytes, int] = {}
        sums: dict[int, np.ndarray] = {}

        def flush():
            out = {"block": list(sums), "sums": [s.astype(np.int64).tobytes() for s in sums.values()], "ids": [None] * len(sums),
                   "n_bytes": [None] * len(sums), "extra": [None] * len(sums)}
            sums.clear()
            return out

        for batch in batches:
            columns = {name: batch.column(name).to_pylist() for name in batch.schema.names}
            for k, block in enumerate(columns["block"]):
                if columns["ids"][k] is not None:
                    yield {"block": [block], "sums": [None], "ids": [columns["ids"][k]], "n_bytes": [columns["n_bytes"][k]], "extra": [columns["extra"][k]]}
                    continue
                ends = np.cumsum(np.frombuffer(columns["sizes"][k], np.uint32).astype(np.int64))
                data, start, words = columns["words"][k], 0, []
                for end in ends.tolist():
                    words.append(data[start:end])
                    start = end
                if len(pieces) > COUNTS_KEPT:
                    pieces.clear()
                new = [w for w in words if w not in pieces]
                for w, e in zip(new, tokenizer.encode_batch_fast([w.decode("utf-8", "surrogatepass") for w in new], add_special_tokens=False), strict=True):
                    pieces[w] = len(e)
                n_docs = np.frombuffer(columns["n_docs"][k], np.uint16).astype(np.int64)
                docs = np.frombuffer(columns["docs"][k], np.uint16)
                weights = np.repeat(np.array([pieces[w] for w in words], np.int64), n_docs) * _unpack(columns["times"][k], len(docs))
                found = np.bincount(docs, weights).astype(np.int64)
                have = sums.get(block)
                if have is None or len(have) < len(found):
                    grown = np.zeros(len(found), np.int64)
                    if have is not None:
                        grown[:len(have)] = have
                    have = sums[block] = grown
                have[:len(found)] += found
            if sum(map(len, sums.values())) > SUMS_KEPT:
                yield flush()
        yield flush()

    return run


def _documents(batches):
    """Sums of a block, sorted together, -> a row per document."""
    block, header, total = None, None, None

    def close():
        ids, n_bytes, extra = header
        n = np.array(extra, np.int64)
        if total is not None:
            n[:len(total)] += total
        return {"id": ids, "n_bytes": n_bytes, "n_tokens": n.tolist()}

    for batch in batches:
        columns = {name: batch.column(name).to_pylist() for name in batch.schema.names}
        for k, here in enumerate(columns["block"]):
            if here != block:
                if header is not None:
                    yield close()
                block, header, total = here, None, None
            if columns["ids"][k] is not None:
                header = columns["ids"][k], columns["n_bytes"][k], columns["extra"][k]
                continue
            more = np.frombuffer(columns["sums"][k], np.int64)
            if total is None or len(total) < len(more):
                total, more = more.copy(), total
            if more is not None:
                total[:len(more)] += more
    if header is not None:
        yield close()


def token_counts(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for every row, as the library counts them without special tokens added.

    ``path`` is a byte-level BPE file of the tokenizers library.  Special strings
    inside a text count as one token each, as is the library's default.

    Null and empty texts have no bytes and no tokens.  Rows are counted one by
    one: repeated rows and rows with equal or null ids stay apart.  Long texts
    are taken whole.  Other columns are not read.  An empty table gives an empty
    result.
    """
    spark = docs.sparkSession
    path = path or default_path("byte_bpe_50k.json")
    vocabulary = shared_bytes(spark, path)
    specials = _check(vocabulary.value)
    buckets = shuffle_partitions(spark)
    kind = docs.schema[id_col].dataType
    header = [T.StructField("ids", T.ArrayType(kind)), T.StructField("n_bytes", T.ArrayType(T.LongType())), T.StructField("extra", T.ArrayType(T.LongType()))]
    block = T.StructField("block", T.LongType())
    posted = map_batches(
        docs.select(F.col(f"`{id_col}`").alias("id"), text_of(docs, text_col).alias("text")), _postings(specials, buckets),
        T.StructType([T.StructField("bucket", T.IntegerType()), block, *(T.StructField(x, T.BinaryType()) for x in ("words", "sizes", "n_docs", "docs", "times")), *header]))
    summed = map_batches(
        posted.repartition(buckets, "bucket"), _counted(vocabulary), T.StructType([block, T.StructField("sums", T.BinaryType()), *header]))
    counted = map_batches(
        summed.repartition(buckets, "block").sortWithinPartitions("block"), _documents,
        T.StructType([T.StructField("id", kind), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())]))
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
