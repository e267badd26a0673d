"""Split reading of delimited files whose quoted values hold line breaks.

A task that starts in the middle of a file can't tell whether its first line
begins a record or goes on inside quotes.  But a line is a function of that state:
it says whether the next line starts inside quotes, if this one did, and if it
didn't.  So one pass composes the functions of each split's lines; a scan over the
splits of each file gives every split its state at the start; and then each split
puts its own records together.  A record that runs over the end of a split is
joined from its pieces.
"""

from __future__ import annotations

import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: encodings in which a line break is the byte 10 and nothing else is
_LINE_SAFE = ("utf-8", "utf8", "us-ascii", "ascii", "iso-8859-1", "iso-8859-15", "latin1", "latin-1", "windows-1252", "cp1252")


def can_split(encoding: str | None, paths: list[str]) -> bool:
    """Whether lines can be found from any place of the files."""
    return (encoding or "utf-8").lower() in _LINE_SAFE and not any(re.search(r"\.(gz|zst|lz4|snappy|deflate)$", p) for p in paths)


def _lines(spark: SparkSession, paths: list[str], encoding: str | None, mark: str) -> DataFrame:
    """Lines with their split, and where each ends: inside quotes if it starts outside (``opens``), or inside (``stays``)."""
    value = F.col("value") if (encoding or "utf-8").lower() in ("utf-8", "utf8") else F.decode(F.col("value").cast("binary"), encoding)
    m = re.escape(mark)
    inner, rest = '(?:[^"]++|"")*+', f"[^{m}]*+"
    quoted = f'"{inner}'
    field = f'(?:{quoted}"{rest}|[^"{m}]{rest}|)'
    opened = f"(?:{field}{m})*+{quoted}$"
    return spark.read.option("lineSep", "\n").text(paths).select(
        value.alias("line"), F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")).withColumns({
            "opens": F.col("line").rlike(f"(?s)^{opened}"),
            "stays": F.col("line").rlike(f'(?s)^{inner}(?:$|"{rest}{m}{opened})')})


def _ends():
    """A function of (opens, stays, state before) that tells for each line in turn whether it ends inside quotes.

    Made inside a function so that it travels to workers by value.
    """
    import numpy as np

    def ends(opens, stays, state):
        n = len(opens)
        # a line that ends alike from either state settles it; between such lines others turn it or leave it
        place = np.maximum.accumulate(np.where(opens == stays, np.arange(n), -1))
        turns = np.cumsum(opens & ~stays)
        settled = np.where(place >= 0, opens[place], state)
        before = np.where(place >= 0, turns[place], 0)
        return settled ^ ((turns - before) % 2 == 1)

    return ends


def _split_parts():
    """A function that cuts a batch with the columns file, block first into its splits: (file, block, first row, rows)."""
    import numpy as np

    def cut(batch):
        files, blocks = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        if len(files):
            edges = np.flatnonzero((np.diff(files) != 0) | (np.diff(blocks) != 0)) + 1
            for first, last in zip([0, *edges.tolist()], [*edges.tolist(), len(files)], strict=True):
                yield (int(files[first]), int(blocks[first])), first, last - first

    return cut


def split_states(lines: DataFrame) -> tuple[dict[tuple[int, int], bool], dict[tuple[int, int], bool]]:
    """Whether each split, by (file, start), begins and whether it ends inside quotes.

    The driver gets one row for each split of the input.
    """
    ends, parts = _ends(), _split_parts()

    def composed(batches):
        found: dict = {}
        for batch in batches:
            opens, stays = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
            for split, first, n in parts(batch):
                rows = slice(first, first + n)
                found[split] = tuple(bool(ends(opens[rows], stays[rows], state)[-1]) for state in found.get(split, (False, True)))
        yield pa.RecordBatch.from_pydict({
            "file": pa.array([k[0] for k in found], pa.int64()), "block": pa.array([k[1] for k in found], pa.int64()),
            "outside": pa.array([v[0] for v in found.values()], pa.bool_()), "inside": pa.array([v[1] for v in found.values()], pa.bool_())})

    found = lines.select("file", "block", "opens", "stays").mapInArrow(composed, "file long, block long, outside boolean, inside boolean").collect()
    files = defaultdict(list)
    for r in found:
        files[r["file"]].append(r)
    start, end = {}, {}
    for file, splits in files.items():
        state = False
        for r in sorted(splits, key=lambda r: r["block"]):
            start[file, r["block"]] = state
            state = r["inside"] if state else r["outside"]
            end[file, r["block"]] = state
    return start, end


def _assembled(lines: DataFrame, start: dict[tuple[int, int], bool]) -> DataFrame:
    """(file, block, place, first, text): whole records have place 0; pieces of records that run over splits 1 at the end of one, -1 at the start."""
    known = lines.sparkSession.sparkContext.broadcast(start)
    ends, parts = _ends(), _split_parts()

    def assemble(batches):
        import numpy as np
        import pyarrow.compute as pc

        states = known.value
        split, held, state, fresh = None, [], False, True

        def rows(texts, places):
            n = len(texts)
            first = np.zeros(n, bool)
            first[:1] = fresh and split[1] == 0
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, split[0])), pa.array(np.full(n, split[1])), pa.array(places, pa.int32()), pa.array(first), texts], names=["file", "block", "place", "first", "text"])

        def rest():
            # a record that the split leaves open, or all of a split that one record fills
            return rows(pa.array(["\n".join(held)]), [-1 if fresh and states.get(split, False) else 1])

        for batch in batches:
            opens, stays = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
            for here, at, n in parts(batch):
                if here != split:
                    if held:
                        yield rest()
                    split, held, state, fresh = here, [], states.get(here, False), True
                inside = ends(opens[at:at + n], stays[at:at + n], state)
                state = bool(inside[-1])
                last = np.flatnonzero(~inside) + 1
                text = batch.column(4).slice(at, n)
                if not len(last):
                    held += text.to_pylist()
                    continue
                done = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], last]).astype(np.int32)), text.slice(0, int(last[-1])))
                texts = pc.binary_join(done, "\n")
                if held:
                    texts = pa.concat_arrays([pa.array(["\n".join([*held, texts[0].as_py()])]), texts.slice(1)])
                places = np.zeros(len(texts), np.int32)
                if fresh and states.get(split, False):
                    places[0] = -1
                yield rows(texts, places)
                fresh, held = False, text.slice(int(last[-1])).to_pylist()
        if held:
            yield rest()

    return lines.select("file", "block", "opens", "stays", "line").mapInArrow(assemble, "file long, block long, place int, first boolean, text string")


def records(lines: DataFrame, start: dict[tuple[int, int], bool]) -> DataFrame:
    """(first, text): every record of the files, as text; ``first`` marks each file's first one."""
    parts = _assembled(lines, start)
    whole = parts.where("place = 0").select("first", "text")
    # at most two pieces a split; a piece at a split's end begins a record
    order = W.partitionBy("file").orderBy("block", "place")
    pieces = parts.where("place <> 0").withColumn("record", F.sum((F.col("place") == 1).cast("int")).over(order))
    listed = F.array_sort(F.collect_list(F.struct("block", "place", "text")))
    joined = pieces.groupBy("file", "record").agg(F.max("first").alias("first"), F.array_join(F.transform(listed, lambda p: p["text"]), "\n").alias("text"))
    return whole.unionByName(joined.select("first", "text"))


def parsed(found: DataFrame, schema, options: dict[str, str], header: bool) -> DataFrame:
    """The records' values; blank records, and with ``header`` each file's first one, are left out."""
    text: Column = F.regexp_replace("text", "\r$", "")
    text = F.when(F.col("first"), F.regexp_replace(text, "^\ufeff", "")).otherwise(text)
    rows = found.where(~F.col("first")) if header else found
    rows = rows.select(text.alias("text")).where(F.trim("text") != "")
    ddl = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema)
    return rows.select(F.from_csv("text", F.lit(ddl), options).alias("r")).select("r.*")
