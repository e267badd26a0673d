"""SentencePiece encoding and decoding: an Aho-Corasick automaton drives a single-pass Viterbi.

The automaton holds all pieces of the model file.  It runs once over the text;
at each position its output links give every piece that ends there, and each one
relaxes the best score of that position: best(end) = max(best(start) + score).
The best path read back from the end is the encoding.  Characters without a
piece become byte pieces.

In a file of the unigram kind every step is admitted.  In a file of the merge
kind the scores are merge ranks, and a step is admitted only if its piece may
stand behind the piece that ends where it starts, that is if merging the two
pieces' characters by rank gives these two pieces again.  Merges that cross a
border depend on its two sides alone, so a path of admitted steps is the merge
encoding, and just one step is admitted at each position.  Either way the ids
are the library's.

No piece of such a file spans from a character to a following blank, so a text
falls apart, without loss, into chunks of blanks and what follows them, and the
best path of a chunk doesn't depend on the others.  A worker remembers chunks it
has seen, up to a bound.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import default_path, free_name, map_batches, shared_bytes, text_of

BLANK = "▁"
#: what an unknown character's score is below the lowest piece score (the library's value)
UNKNOWN_PENALTY = 10.0
#: chunks that a worker remembers in each of two generations, and how long a remembered one may be
CHUNKS_KEPT, CHUNK_CHARS = 200_000, 64

#: admitted and other pairs that a worker remembers
PAIRS_KEPT = 500_000

NORMAL, USER_DEFINED, BYTE = 1, 4, 6
UNIGRAM, MERGES = 1, 2

_LOADED: dict = {}


@dataclass
class Pieces:
    """Piece table of a model file with its automaton."""

    automaton: object
    singles: frozenset
    unknown: float
    ranks: dict[str, float] | None
    bytes_of: list[bytes]
    byte_ids: list[int]
    dummy_prefix: bool
    size: int
    memo: dict
    older: dict
    pairs: dict

    @staticmethod
    def load(data: bytes) -> Pieces:
        key = zlib.crc32(data), len(data)
        if key not in _LOADED:
            _LOADED[key] = Pieces._read(data)
        return _LOADED[key]

    @staticmethod
    def _read(data: bytes) -> Pieces:
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        model.ParseFromString(data)
        if model.normalizer_spec.precompiled_charsmap or model.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("only model files that keep texts as they are can be decoded exactly")
        automaton, singles, bytes_of, byte_ids = ahocorasick.Automaton(), set(), [], [0] * 256
        normal = [p.score for p in model.pieces if p.type == NORMAL]
        kind = model.trainer_spec.model_type
        if kind not in (UNIGRAM, MERGES) or kind == MERGES and any(p.type == USER_DEFINED for p in model.pieces):
            raise ValueError("the model file is neither a unigram nor a plain merge vocabulary")
        for i, p in enumerate(model.pieces):
            if p.type == BYTE:
                value = int(p.piece[3:5], 16)
                byte_ids[value] = i
                bytes_of.append(bytes([value]))
                continue
            bytes_of.append(p.piece.replace(BLANK, " ").encode())
            if p.type not in (NORMAL, USER_DEFINED):
                continue
            if BLANK in p.piece.lstrip(BLANK):
                raise ValueError(f"piece {p.piece!r} has a blank behind a character")
            score = p.score if p.type == NORMAL else len(p.piece) * max(normal) - 0.1
            automaton.add_word(p.piece, (i, len(p.piece), score))
            if len(p.piece) == 1:
                singles.add(p.piece)
        if kind == MERGES and not singles.issuperset(c for p in model.pieces if p.type == NORMAL for c in p.piece):
            raise ValueError("a piece holds a character that is no piece")
        if not all(byte_ids):
            raise ValueError("the model file has no byte pieces")
        automaton.make_automaton()
        ranks = {p.piece: p.score for p in model.pieces if p.type == NORMAL} if kind == MERGES else None
        return Pieces(automaton, frozenset(singles), min(normal) - UNKNOWN_PENALTY, ranks, bytes_of, byte_ids,
                      model.normalizer_spec.add_dummy_prefix, len(model.pieces), {}, {}, {})

    def admitted(self, before: str, piece: str) -> bool:
        """Whether merging by rank keeps the border between two pieces; ``before`` is empty at a chunk's start."""
        parts, ranks = list(before + piece), self.ranks
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank > best):
                    best, at = rank, i
            if best is None:
                return parts == ([before, piece] if before else [piece])
            parts[at:at + 2] = [parts[at] + parts[at + 1]]

    def best(self, chunk: str) -> tuple[int, ...]:
        """Ids of the best admitted segmentation of a chunk; ties go to the longer piece."""
        n = len(chunk)
        score: list = [None] * (n + 1)
        came: list = [None] * (n + 1)
        score[0], came[0] = 0.0, (self.size, 0)
        pairs, width = self.pairs, self.size + 1
        if len(pairs) > PAIRS_KEPT:
            pairs.clear()
        done, singles, unknown, merges = 0, self.singles, self.unknown, self.ranks is not None
        plain = singles.issuperset(chunk)
        for end, (piece, size, s) in chain(self.automaton.iter(chunk), ((n, (-1, 0, 0.0)),)):
            if not plain:
                # positions passed: a character without a piece of its own may take bytes
                while done < min(end, n):
                    if chunk[done] not in singles and (score[done + 1] is None or not merges and score[done] + unknown > score[done + 1]):
                        score[done + 1], came[done + 1] = score[done] + unknown, (-1, 1)
                    done += 1
            if not size:
                continue
            start, end = end + 1 - size, end + 1
            if merges:
                if score[end] is not None:
                    continue
                before, length = came[start]
                # behind a character without a piece nothing merges, as at the start
                key = (before if before >= 0 else self.size) * width + piece
                fits = pairs.get(key)
                if fits is None:
                    fits = pairs[key] = self.admitted(chunk[start - length:start] if before >= 0 else "", chunk[start:end])
                if not fits:
                    continue
            elif score[end] is not None and score[start] + s <= score[end]:
                continue
            score[end], came[end] = score[start] + s, (piece, size)
        ids, at = [], n
        while at:
            piece, size = came[at]
            if piece < 0:
                ids += [self.byte_ids[b] for b in reversed(chunk[at - 1].encode("utf-8", "surrogatepass"))]
            else:
                ids.append(piece)
            at -= size
        return tuple(reversed(ids))

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text.  The blank sign itself, if a text holds it, becomes bytes."""
        if not text:
            return []
        if BLANK in text:
            sign = [self.byte_ids[b] for b in BLANK.encode()]
            parts = text.split(BLANK)
            out = self._encode(parts[0], self.dummy_prefix)
            for part in parts[1:]:
                out += sign
                out += self._encode(part, False)
            return out
        return self._encode(text, self.dummy_prefix)

    def _encode(self, text: str, prefix: bool) -> list[int]:
        if len(self.memo) > CHUNKS_KEPT:
            # what is used again comes back from the older generation
            self.older, self.memo = self.memo, {}
        memo, older = self.memo, self.older
        chunks = (" " + text if prefix else text).split(" ")
        out: list[tuple[int, ...]] = []
        blanks = 0
        for k, word in enumerate(chunks):
            if k:
                blanks += 1
            if not word and k + 1 < len(chunks):
                continue
            chunk = BLANK * blanks + word
            blanks = 0
            if not chunk:
                continue
            ids = memo.get(chunk)
            if ids is None:
                ids = older.get(chunk)
                if ids is None:
                    ids = self.best(chunk)
                if len(chunk) <= CHUNK_CHARS:
                    memo[chunk] = ids
            out.append(ids)
        return list(chain.from_iterable(out))

    def decode(self, ids) -> str:
        table = self.bytes_of
        data = b"".join([table[i] for i in ids])
        if self.dummy_prefix and data[:1] == b" ":
            data = data[1:]
        return data.decode("utf-8", "surrogatepass")


def _lists(rows: list[list[int]]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.fromiter(chain.from_iterable(rows), np.int32, offsets[-1])))


#: texts that a worker turns into ids at once
_ROWS = 512


def _encoder(model, text_at: int, names: list[str], check: bool):
    def run(batches):
        pieces = Pieces.load(model.value)
        for whole in batches:
            for first in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(first, _ROWS)
                texts = [t or "" for t in batch.column(text_at).to_pylist()]
                ids = [pieces.encode(t) for t in texts]
                yield {**{n: batch.column(i) for i, n in enumerate(batch.schema.names)}, names[0]: _lists(ids), names[1]: [len(x) for x in ids],
                       names[2]: [pieces.decode(x) == t for x, t in zip(ids, texts, strict=True)] if check else [None] * len(ids)}

    return run


def encode(docs: DataFrame, path: str | None = None, text_col: str = "text", check: bool = True) -> DataFrame:
    """The table with ``piece_ids``, ``n_pieces`` and ``round_trip`` (decoding the ids gives the text back).

    Null and empty texts have no pieces, and decode to the empty text.  Texts are
    taken whole, rows one by one.  If the table has columns of these names, the
    new ones get leading underscores.  An empty table gives an empty result.
    """
    model = shared_bytes(docs.sparkSession, path or default_path("piece_bpe_32k.model"))
    names = [free_name(docs, x) for x in ("piece_ids", "n_pieces", "round_trip")]
    kinds = (T.ArrayType(T.IntegerType()), T.LongType(), T.BooleanType())
    return map_batches(docs, _encoder(model, docs.columns.index(text_col), names, check),
                       T.StructType([*docs.schema, *(T.StructField(n, k) for n, k in zip(names, kinds, strict=True))]))


def decode(encoded: DataFrame, path: str | None = None, ids_col: str = "piece_ids", out_col: str = "decoded") -> DataFrame:
    """The table with the text that each row's ids stand for; null ids give a null text.

    An id that the vocabulary hasn't makes the text null as well.
    """
    model = shared_bytes(encoded.sparkSession, path or default_path("piece_bpe_32k.model"))
    at, name = encoded.columns.index(ids_col), free_name(encoded, out_col)

    def run(batches):
        pieces = Pieces.load(model.value)
        good = range(pieces.size)
        for batch in batches:
            rows = batch.column(at).to_pylist()
            yield {**{n: batch.column(i) for i, n in enumerate(batch.schema.names)},
                   name: [None if r is None or not all(i in good for i in r) else pieces.decode(r) for r in rows]}

    return map_batches(encoded, run, T.StructType([*encoded.schema, T.StructField(name, T.StringType())]))


def encoded_documents(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_pieces, piece_ids, round_trip) for every row."""
    narrow = docs.select(F.col(f"`{id_col}`").alias("id"), text_of(docs, text_col).alias("text"))
    return encode(narrow, path).select(F.col("id").alias(id_col), "n_pieces", "piece_ids", "round_trip")
