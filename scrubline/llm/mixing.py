"""Mixing sources to target weights by pivotal rounding of copies, in SQL functions only.

A source's target gives each of its documents the same share of copies: a whole
part and a fraction.  The fractions are rounded by pivotal sampling.  Two
documents meet; mass, counted in words, moves from one to the other in a random
direction until one of them is at none or at a whole copy, with chances that
leave both expectations as they were.  The settled one is done, the other goes
on to the next meeting.  As words are conserved at every meeting, a source's sum
stays within its last document of the target.

Documents meet in blocks of about ``FAN``, by hash; each block leaves one
document, and what the blocks leave meets in blocks again, up to one for each
source: a reduction tree whose tasks are small and alike however large a source
is.  Every draw is a hash of the two documents, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.cut import cut
from .common import free_name

WEIGHTS = (5.0, 2.0, 1.0)
MOST_COPIES = 3
FAN = 128


def word_count(text: Column) -> Column:
    """Words between ASCII white space; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _ranked(sources: DataFrame) -> DataFrame:
    """Sources with their rank (from 0) by code point, null last, without one task that sorts them all."""
    order = [F.col("source").isNull(), F.col("source")]
    ranged = cut(sources.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    counts = {r["part"]: r["count"] for r in ranged.groupBy("part").count().collect()}
    before, at = {}, 0
    for part in sorted(counts):
        before[part], at = at, at + counts[part]
    offset = F.lit(0)
    if before:
        offset = F.element_at(F.create_map(*(F.lit(x) for pair in before.items() for x in pair)), F.col("part"))
    return ranged.withColumn("rank", F.row_number().over(W.partitionBy("part").orderBy(*order)) - 1 + offset).drop("part")


def source_targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """(source, source_size, n, target) from (source, size) rows.

    All sizes together are shared by weight; a target stops at ``most`` times its
    source's size, and what is over is shared again by weight among the others.
    That is target = min(most * size, level * weight) with one level for all,
    found from below in a few rounds of one sum each.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    sources = cut(_ranked(sources).withColumn("weight", weight))
    cap = F.col("source_size") * float(most)
    level, total = 0.0, float(sources.agg(F.sum("source_size")).first()[0] or 0)
    while True:
        stopped = cap <= F.lit(level) * F.col("weight")
        row = sources.agg(F.sum(F.when(stopped, cap).otherwise(0.0)), F.sum(F.when(stopped, 0.0).otherwise(F.col("weight")))).first()
        higher = (total - (row[0] or 0.0)) / row[1] if row[1] else level
        if higher <= level:
            break
        level = higher
    return sources.select("source", "source_size", "n", F.least(cap, F.lit(level) * F.col("weight")).alias("target"))


_UNIT = "struct<h:bigint,id:{id},u:int,size:bigint,mass:double>"

#: One meeting of the document at hand (a.cur) with the next (x).  up: words that may go to cur, down: words that may leave it.
_MEET = """aggregate(units, named_struct('cur', cast(null as {unit}), 'out', cast(array() as array<struct<id:{id},u:int,size:bigint,take:int>>)),
 (a, x) -> if(a.cur is null, named_struct('cur', x, 'out', a.out),
  transform(array(named_struct('up', least(a.cur.size - a.cur.mass, x.mass), 'down', least(a.cur.mass, x.size - x.mass),
    'draw', pmod(xxhash64(a.cur.h, x.h, {seed}L), 9007199254740992L) / 9007199254740992D)), m ->
   if(m.draw * (m.up + m.down) < m.down,
    if(m.up = a.cur.size - a.cur.mass,
     named_struct('cur', named_struct('h', x.h, 'id', x.id, 'u', x.u, 'size', x.size, 'mass', x.mass - m.up), 'out', concat(a.out, array(named_struct('id', a.cur.id, 'u', a.cur.u, 'size', a.cur.size, 'take', 1)))),
     named_struct('cur', named_struct('h', a.cur.h, 'id', a.cur.id, 'u', a.cur.u, 'size', a.cur.size, 'mass', a.cur.mass + m.up), 'out', concat(a.out, array(named_struct('id', x.id, 'u', x.u, 'size', x.size, 'take', 0))))),
    if(m.down = a.cur.mass,
     named_struct('cur', named_struct('h', x.h, 'id', x.id, 'u', x.u, 'size', x.size, 'mass', x.mass + m.down), 'out', concat(a.out, array(named_struct('id', a.cur.id, 'u', a.cur.u, 'size', a.cur.size, 'take', 0)))),
     named_struct('cur', named_struct('h', a.cur.h, 'id', a.cur.id, 'u', a.cur.u, 'size', a.cur.size, 'mass', a.cur.mass - m.down), 'out', concat(a.out, array(named_struct('id', x.id, 'u', x.u, 'size', x.size, 'take', 1)))))))[0]))"""


def _rounded(units: DataFrame, blocks: int, seed: int) -> DataFrame:
    """(source, id, u, size, take) of all units (source, block, unit); blocks: the most blocks of a source."""
    kind = dict(units.select("unit.id").dtypes)["id"]
    meet = F.expr(_MEET.format(unit=_UNIT.format(id=kind), id=kind, seed=seed))
    settled = None
    while True:
        met = units.groupBy("source", "block").agg(F.sort_array(F.collect_list("unit")).alias("units"))
        met = cut(met.select("source", "block", meet.alias("met")))
        out = met.select("source", F.inline("met.out"))
        settled = out if settled is None else settled.unionByName(out)
        left = met.select("source", F.floor(F.col("block") / FAN).alias("block"), F.col("met.cur").alias("unit"))
        if blocks <= 1:
            break
        units, blocks = left, -(-blocks // FAN)
    draw = F.pmod(F.xxhash64("unit.h", F.lit(seed)), F.lit(1 << 53)) / float(1 << 53)
    last = left.select("source", "unit.id", "unit.u", "unit.size", (draw * F.col("unit.size") < F.col("unit.mass")).cast("int").alias("take"))
    return settled.unionByName(last)


def mix(units: DataFrame, weights=WEIGHTS, most: int = MOST_COPIES, seed: int = 7) -> DataFrame:
    """(source, id, u, size, copies, source_size, target) from (source, id, u, size) rows; u tells equal rows apart."""
    targets = source_targets(units, weights, most)
    share = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    whole = F.floor(share + 1e-12)
    plan = cut(targets.select("source", "source_size", "target", whole.cast("int").alias("whole"), F.greatest(share - whole, F.lit(0.0)).alias("part"),
                              F.ceil(F.col("n") / FAN).alias("blocks")))
    other = plan.select(F.col("source").alias("s"), *plan.columns[1:])
    # a word-poor source list meets all documents: Spark splits a hot source, or sends the list to all tasks if it's small
    dealt = units.join(other, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    loose = (F.col("part") > 0) & (F.col("size") > 0)
    h = F.xxhash64("id", "source", "u")
    meeting = dealt.where(loose).select("source", F.pmod(h, "blocks").alias("block"), F.struct(
        h.alias("h"), "id", "u", "size", (F.col("part") * F.col("size")).alias("mass")).alias("unit"))
    blocks = plan.agg(F.max("blocks")).first()[0] or 0
    taken = _rounded(meeting, int(blocks), seed)
    rest = dealt.where(~loose).select("source", "id", "u", "size", F.lit(0).alias("take"))
    return taken.unionByName(rest).join(other, F.col("source").eqNullSafe(F.col("s"))).select(
        "source", "id", "u", "size", (F.col("whole") + F.col("take")).alias("copies"), "source_size", "target")


def _units(docs: DataFrame, id_col: str, source_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(f"`{source_col}`").cast("string").alias("source"), F.col(f"`{id_col}`").alias("id"), word_count(F.col(f"`{text_col}`")).alias("size"))
    return rows.withColumn("u", F.row_number().over(W.partitionBy("id", "source", "size").orderBy("size")))


def mixed_sizes(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **given) -> DataFrame:
    """(id, size, source_size, target, taken) for every row: size in words, the source's size and target, and the words the mix takes of the row.

    A null or empty text has size 0 and none is taken.  Null is a source of its
    own, the last one.  Repeated rows are documents of their own.  No row is
    taken more often than ``most`` times.  Other columns are not read.  An empty
    table gives an empty result.
    """
    mixed = mix(cut(_units(docs, id_col, source_col, text_col)), **given)
    return mixed.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **given) -> DataFrame:
    """The rows of the table, each as often as the mix takes it; columns as they are."""
    names = {c: free_name(docs, c) for c in ("_size", "_u", "_copies")}
    size, u, copies = names["_size"], names["_u"], names["_copies"]
    key = [f"`{id_col}`", f"`{source_col}`", size]
    wide = docs.withColumn(size, word_count(F.col(f"`{text_col}`")))
    wide = wide.withColumn(u, F.row_number().over(W.partitionBy(*key).orderBy(F.xxhash64(F.col(f"`{text_col}`")))))
    mixed = mix(cut(_units(docs, id_col, source_col, text_col)), **given).where("copies > 0").select(
        F.col("source").alias("__source"), F.col("id").alias("__id"), F.col("u").alias("__u"), F.col("size").alias("__size"), F.col("copies").alias(copies))
    same = (F.col(f"`{id_col}`").eqNullSafe(F.col("__id")) & F.col(f"`{source_col}`").cast("string").eqNullSafe(F.col("__source"))
            & (F.col(size) == F.col("__size")) & (F.col(u) == F.col("__u")))
    often = wide.join(mixed, same)
    return often.select(*(f"`{c}`" for c in docs.columns), F.explode(F.sequence(F.lit(1), F.col(copies))).alias(copies)).drop(copies)
