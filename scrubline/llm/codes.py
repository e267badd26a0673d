"""Vector compression by product codes, learned on metric trees over the parts.

A vector is cut into parts, and each part position has a codebook that k-means
rounds improve.  Parts don't change between rounds, so each block of rows keeps
one metric tree per part position.  The trees grow middle-out, as anchors
hierarchies do: a set of n points gets about sqrt(n) anchors, each new one at the
point that is farthest from its own anchor and taking over the points that are
nearer to it (the triangle inequality spares most of the distances); anchors are
then merged upwards, two at a time by the smallest ball around both, and each
anchor's points are divided downwards in the same way.  Every ball caches the sum
and the number of its points.

A round walks each tree with the list of entries that may still own a point of
the ball.  A ball inherits its parent's list and strikes out the entries that are
farther than the best one from all of the ball, that is those whose bisector with
the best one lies beyond the ball's radius.  When one entry is left the ball is
wholly its own, and its cached sum and count are added without a look at the
points.  In leaves the points are compared with what is left of the list.

Entries are integers and squared distances exact, so results don't depend on
blocks, trees or partitions.  Each round sends one row per task and used entry to
the shuffle; the driver holds only the codebooks (entries x length numbers).
"""

from __future__ import annotations

import hashlib
import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.cut import cut
from .common import map_batches
from .vectors import Gathered, exact_in_doubles, whole_vector

PARTS, ENTRIES, ROUNDS = 4, 256, 4
#: rows of a block, and points up to which a ball isn't divided
BLOCK_ROWS, LEAF = 4096, 16


def part_bounds(dim: int, parts: int) -> list[int]:
    return [dim * i // parts for i in range(parts + 1)]


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows, as a matrix."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(y).max(initial=0)))
    if exact_in_doubles(most, x.shape[1]):
        a, b = x.astype(np.float64), y.astype(np.float64)
        return (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2.0 * (a @ b.T)
    a, b = x.astype(object), y.astype(object)
    return np.array([[sum((p - q) ** 2) for q in b] for p in a], object).reshape(len(a), len(b))


# ------------------------------------------------------------ trees

def _anchors(x: np.ndarray, count: int) -> list[np.ndarray]:
    """Positions in x by anchor, each anchor's farthest points first."""
    first = np.sqrt(((x - x[0]) ** 2).sum(axis=1))
    order = np.argsort(-first, kind="stable")
    own, far, pivots = [order], [first[order]], [x[0]]
    while len(own) < count:
        radii = np.array([d[0] for d in far])
        widest = int(radii.argmax())
        if radii[widest] == 0.0:
            break
        pivot = x[own[widest][0]]
        half = np.sqrt(((np.array(pivots) - pivot) ** 2).sum(axis=1)) / 2
        taken, at = [], []
        for j in np.flatnonzero(radii >= half * (1 - 1e-9)):
            # points nearer to their anchor than half the way to the new one can't be nearer to that
            seen = int(np.searchsorted(-far[j], -half[j] * (1 - 1e-9), side="right"))
            there = np.sqrt(((x[own[j][:seen]] - pivot) ** 2).sum(axis=1))
            moves = there < far[j][:seen]
            if moves.any():
                taken.append(own[j][:seen][moves])
                at.append(there[moves])
                stays = np.ones(len(own[j]), bool)
                stays[:seen] = ~moves
                own[j], far[j] = own[j][stays], far[j][stays]
        rows, there = np.concatenate(taken), np.concatenate(at)
        order = np.argsort(-there, kind="stable")
        own.append(rows[order])
        far.append(there[order])
        pivots.append(pivot)
        if any(not len(o) for o in own):
            keep = [i for i, o in enumerate(own) if len(o)]
            own, far, pivots = [own[i] for i in keep], [far[i] for i in keep], [pivots[i] for i in keep]
    return own


def _merged(x: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Pairs of balls to join, until one is left; sets are numbered first, then the pairs in turn."""
    k = len(sets)
    centres = np.zeros((2 * k - 1, x.shape[1]))
    radii, sizes = np.zeros(2 * k - 1), np.zeros(2 * k - 1)
    for i, rows in enumerate(sets):
        centres[i] = x[rows].mean(axis=0)
        radii[i] = np.sqrt(((x[rows] - centres[i]) ** 2).sum(axis=1)).max()
        sizes[i] = len(rows)

    def around(i: int, others: np.ndarray) -> np.ndarray:
        gap = np.sqrt(((centres[others] - centres[i]) ** 2).sum(axis=1))
        return np.maximum((gap + radii[others] + radii[i]) / 2, np.maximum(radii[others], radii[i]))

    cost = np.full((2 * k - 1, 2 * k - 1), np.inf)
    for i in range(k):
        cost[i, i + 1:k] = around(i, np.arange(i + 1, k))
    live, pairs = list(range(k)), []
    for new in range(k, 2 * k - 1):
        a, b = divmod(int(cost.argmin()), 2 * k - 1)
        pairs.append((a, b))
        sizes[new] = sizes[a] + sizes[b]
        centres[new] = (centres[a] * sizes[a] + centres[b] * sizes[b]) / sizes[new]
        radii[new] = max(np.sqrt(((centres[new] - centres[c]) ** 2).sum()) + radii[c] for c in (a, b))
        for c in (a, b):
            cost[c, :] = cost[:, c] = np.inf
            live.remove(c)
        cost[live, new] = around(new, np.array(live, np.int64))
        live.append(new)
    return pairs


def grow(points: np.ndarray) -> dict[str, np.ndarray]:
    """The metric tree of integer points: points in tree order, and for each ball its bounds there, children, centre, radius, sum."""
    x = points.astype(np.float64)
    children: list[tuple[int, int] | None] = []
    held: list[np.ndarray | None] = []

    def ball(rows, pair=None) -> int:
        held.append(rows)
        children.append(pair)
        return len(held) - 1

    def divide(rows: np.ndarray) -> int:
        sets = _anchors(x[rows], max(2, int(np.sqrt(len(rows))))) if len(rows) > LEAF else []
        if len(sets) < 2:
            return ball(rows)
        made = [divide(rows[s]) for s in sets]
        for a, b in _merged(x[rows], sets):
            made.append(ball(None, (made[a], made[b])))
        return made[-1]

    root = divide(np.arange(len(x)))
    n, order, at = len(held), [], 0
    first, last = np.zeros(n, np.int64), np.zeros(n, np.int64)
    stack = [(root, False)]
    while stack:
        node, seen = stack.pop()
        if seen:
            last[node] = at
        elif children[node] is None:
            first[node] = at
            order.append(held[node])
            at += len(held[node])
            last[node] = at
        else:
            first[node] = at
            stack += [(node, True), (children[node][1], False), (children[node][0], False)]
    order = np.concatenate(order)
    ordered = points[order]
    sums = np.array([ordered[a:b].sum(axis=0) for a, b in zip(first, last, strict=True)], np.int64).reshape(n, points.shape[1])
    centres = sums / (last - first)[:, None]
    radii = np.array([np.sqrt(((ordered[a:b] - c) ** 2).sum(axis=1)).max() for a, b, c in zip(first, last, centres, strict=True)])
    pairs = np.array([c or (-1, -1) for c in children], np.int64)
    return {"order": order, "points": ordered, "first": first, "last": last, "pairs": pairs, "centres": centres,
            "radii": radii * (1 + 1e-9), "sums": sums, "root": np.array([root])}


def owned(tree: dict[str, np.ndarray], entries: np.ndarray):
    """(entry, ball) for balls that one entry owns, and (entries, first, last) for the points of undecided leaves.

    Of entries equally far the one with the lower number owns a point.
    """
    e = entries.astype(np.float64)
    gaps = np.sqrt(((e[:, None, :] - e[None, :, :]) ** 2).sum(axis=2))
    centres, radii, pairs, first, last = (tree[k] for k in ("centres", "radii", "pairs", "first", "last"))
    stack = [(int(tree["root"][0]), np.arange(len(e)))]
    while stack:
        node, left = stack.pop()
        if len(left) > 1:
            far = ((e[left] - centres[node]) ** 2).sum(axis=1)
            best = int(far.argmin())
            # a bisector beyond the radius; a little more, for rounding
            left = left[far - far[best] <= 2 * radii[node] * gaps[left[best], left] + 1e-9 * (far + far[best])]
        if len(left) == 1:
            yield int(left[0]), node
        elif pairs[node, 0] >= 0:
            stack += [(int(pairs[node, 0]), left), (int(pairs[node, 1]), left)]
        else:
            a, b = int(first[node]), int(last[node])
            yield left[_squares(tree["points"][a:b], entries[left]).argmin(axis=1).astype(np.int64)], (a, b)


# ------------------------------------------------------------ Spark

def _packed(tree: dict[str, np.ndarray]) -> bytes:
    out = io.BytesIO()
    np.savez(out, **tree)
    return out.getvalue()


def _small(x: np.ndarray) -> np.ndarray:
    """The narrowest integers that hold the values."""
    most = int(np.abs(x).max(initial=0))
    return x.astype(np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.int64)


def _unpacked(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data)) as file:
        tree = {k: file[k] for k in file.files}
    tree["points"] = tree["points"].astype(np.int64)
    return tree


def _planted(parts: int):
    """(id, label, vector) rows -> blocks with a tree for each part position."""

    def rows(block):
        dim, (ids, labels, _), matrix = block
        bounds = part_bounds(dim, parts)
        trees = []
        for i in range(parts):
            tree = grow(matrix[:, bounds[i]:bounds[i + 1]])
            tree["points"], tree["order"] = _small(tree["points"]), tree["order"].astype(np.int32)
            trees.append(_packed(tree))
        whole = pa.array([0, len(ids)], pa.int32())
        return {"dim": [dim], "ids": pa.ListArray.from_arrays(whole, ids), "labels": pa.ListArray.from_arrays(whole, labels), "trees": [trees]}

    def run(batches):
        gathered = Gathered(BLOCK_ROWS)
        for batch in batches:
            for block in gathered.add(batch, 2):
                yield rows(block)
        for block in gathered.rest():
            yield rows(block)

    return run


def _sums(books):
    """Blocks -> (dim, part, entry, n, sums), one row per task and used entry."""

    def run(batches):
        total: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for dim, trees in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for part, data in enumerate(trees):
                    tree, entries = _unpacked(data), books.value[dim][part]
                    sums, counts = total.setdefault((dim, part), (np.zeros(entries.shape, np.int64), np.zeros(len(entries), np.int64)))
                    for entry, what in owned(tree, entries):
                        if isinstance(entry, int):
                            sums[entry] += tree["sums"][what]
                            counts[entry] += tree["last"][what] - tree["first"][what]
                        else:
                            np.add.at(sums, entry, tree["points"][what[0]:what[1]])
                            np.add.at(counts, entry, 1)
        for (dim, part), (sums, counts) in total.items():
            used = np.flatnonzero(counts)
            yield {"dim": [dim] * len(used), "part": [part] * len(used), "entry": used, "n": counts[used], "sums": sums[used].tolist()}

    return run


def _coded(books):
    """Blocks -> a row per vector with the entry of each part and the squared distances, summed."""

    def run(batches):
        for whole in batches:
            for k in range(whole.num_rows):
                batch = whole.slice(k, 1)
                dim, trees = batch.column(0)[0].as_py(), batch.column(3)[0].as_py()
                ids, labels = batch.column(1).flatten(), batch.column(2).flatten()
                code, error = np.zeros((len(ids), len(trees)), np.int64), np.zeros(len(ids), np.int64)
                for part, data in enumerate(trees):
                    tree, entries = _unpacked(data), books.value[dim][part]
                    of = np.zeros(len(ids), np.int64)
                    for entry, what in owned(tree, entries):
                        a, b = what if not isinstance(entry, int) else (tree["first"][what], tree["last"][what])
                        of[a:b] = entry
                    far = tree["points"] - entries[of]
                    code[tree["order"], part] = of
                    error[tree["order"]] += (far * far).sum(axis=1)
                yield {"id": ids, "label": labels, "code": code.tolist(), "error": error}

    return run


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = 1024,
             id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, dict[int, list[np.ndarray]]]:
    """((id, label, code, error) of every vector that takes part, codebooks by vector length).

    ``code`` holds the number of an entry for each part; ``error`` the squared
    distances between parts and entries, summed.  ``codebooks[length][part]`` is
    a matrix with a row per entry.

    Components become floor(scale * x).  Rows take no part if the vector is null,
    holds null or non-finite components, or components so large that an error
    might not fit a long (``whole_vector``).  Vectors of different lengths have
    codebooks of their own; a length that the number of parts doesn't divide is
    cut into parts whose lengths differ by one, and vectors without a component
    get entry 0 and error 0.  A codebook starts as the parts of the rows with the smallest
    ids (null ids last, rows with one id by their vectors); with fewer rows it is
    smaller, and equal entries may occur: the lower number then owns the points.
    Repeated rows count as often as they occur.  Other columns are not read.  An
    empty table gives an empty result and no codebook.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label"), whole_vector(F.col(f"`{vector_col}`"), scale).alias("v")).where("v IS NOT NULL")
    kinds = [rows.schema["id"].dataType, rows.schema["label"].dataType]
    blocks = cut(map_batches(rows, _planted(parts), T.StructType([
        T.StructField("dim", T.IntegerType()), T.StructField("ids", T.ArrayType(kinds[0])), T.StructField("labels", T.ArrayType(kinds[1])),
        T.StructField("trees", T.ArrayType(T.BinaryType()))])))

    books: dict[int, list[np.ndarray]] = {}
    for dim in sorted(r["dim"] for r in blocks.select("dim").distinct().collect()):
        first = rows.where(F.size("v") == dim).orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()
        matrix = np.array([r["v"] for r in first], np.int64).reshape(len(first), dim)
        bounds = part_bounds(dim, parts)
        books[dim] = [matrix[:, bounds[i]:bounds[i + 1]].copy() for i in range(parts)]

    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(books)
        used = map_batches(blocks.select("dim", "trees"), _sums(sent), T.StructType([
            T.StructField("dim", T.IntegerType()), T.StructField("part", T.IntegerType()), T.StructField("entry", T.IntegerType()),
            T.StructField("n", T.LongType()), T.StructField("sums", T.ArrayType(T.LongType()))]))
        each = used.select("dim", "part", "entry", "n", F.posexplode("sums").alias("at", "x"))
        summed = each.groupBy("dim", "part", "entry", "at").agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
        # at most entries x length numbers
        books = {dim: [book.copy() for book in of] for dim, of in books.items()}
        for r in summed.collect():
            books[r["dim"]][r["part"]][r["entry"], r["at"]] = int(r["x"]) // r["n"]

    coded = map_batches(blocks, _coded(spark.sparkContext.broadcast(books)), T.StructType([
        T.StructField("id", kinds[0]), T.StructField("label", kinds[1]), T.StructField("code", T.ArrayType(T.IntegerType())), T.StructField("error", T.LongType())]))
    return coded.select(F.col("id").alias(id_col), F.col("label").alias(label_col), "code", "error"), books


def vector_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, code, error, label_error, codebooks_sha256): codes as two hex digits a part.

    ``label_error`` sums the errors of the rows with one label, null labels
    together; it is null if the sum doesn't fit a long.
    """
    coded, books = compress(vectors, id_col=id_col, vector_col=vector_col, label_col=label_col)
    numbers = (str(x) for dim in sorted(books) for book in books[dim] for entry in book.tolist() for x in entry)
    digest = hashlib.sha256(",".join(numbers).encode()).hexdigest()
    coded = cut(coded.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label"), "code", "error"))
    by_label = coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("s")).select(F.col("label").alias("l"), F.expr("try_cast(s AS BIGINT)").alias("label_error"))
    code = F.array_join(F.transform("code", lambda x: F.lower(F.lpad(F.hex(x), 2, "0"))), "")
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("l"))).select(
        F.col("id").alias(id_col), code.alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
