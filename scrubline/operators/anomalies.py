"""Outliers, anomalous text, forests, clusters and time series."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..core import action, as_list, batches, chosen, col, is_numeric, is_temporal, numeric_columns, string_columns
from ..functions.dates import as_timestamp
from ..functions.numbers import to_number
from ..functions.stats import moments, quantiles
from ..plans.cut import cut
from .chunks import MARKS, overlapping
from .ordered import ROWS_PER_BUCKET, over_rows, running
from .profile import union_all
from .rows import fences
from .seasonal import stl


def _outliers(df: DataFrame, limits: dict[str, tuple], method: str) -> DataFrame:
    """``(column, method, outlier_count, lower, upper, severity)`` from one aggregate."""
    if not limits:
        return df.sparkSession.createDataFrame(
            [], "column string, method string, outlier_count long, lower_bound double, upper_bound double, severity string")
    exprs = []
    for i, (name, (low, high)) in enumerate(limits.items()):
        exprs += [F.count_if((col(name) < low) | (col(name) > high)).alias(f"o{i}"), F.count(col(name)).alias(f"n{i}")]
    items = [
        F.struct(F.lit(name).alias("column"), F.lit(method).alias("method"), F.col(f"o{i}").alias("outlier_count"),
                 F.lit(float(low)).alias("lower_bound"), F.lit(float(high)).alias("upper_bound"),
                 F.when(F.col(f"o{i}") > F.col(f"n{i}") * 0.05, "high").otherwise("medium").alias("severity"))
        for i, (name, (low, high)) in enumerate(limits.items())
    ]
    return df.agg(*exprs).select(F.inline(F.array(*items)))


def detect_outliers_iqr(df: DataFrame, columns=None, k: float = 3.0) -> DataFrame:
    """Counts outside the k-IQR fence; a column whose IQR is 0 is left out."""
    names = [c for c in chosen(df, columns, numeric_columns(df)) if is_numeric(df, c)]
    limits = {c: f for c, f in fences(df, names, "iqr", k).items() if f[0] < f[1]}
    return _outliers(df, limits, "IQR")


def detect_outliers_zscore(df: DataFrame, columns=None, threshold: float = 3.0, population: bool = True) -> DataFrame:
    """Counts beyond the threshold; ``population=False`` uses the sample deviation."""
    names = [c for c in chosen(df, columns, numeric_columns(df)) if is_numeric(df, c)]
    return _outliers(df, fences(df, names, "zscore", threshold, population), "Z-score" if population else "GrubbsTest")


@action("flag_anomalies", "detect_anomalies")
def flag_anomalies(df: DataFrame, columns, method: str = "iqr", threshold: float = 3, anomaly_column: str = "is_anomaly") -> DataFrame:
    names = [c for c in as_list(columns) if c in df.columns]
    flag = F.lit(False)
    for c, (low, high) in fences(df, names, method, threshold).items():
        flag = flag | F.coalesce((col(c) < low) | (col(c) > high), F.lit(False))
    return df.withColumn(anomaly_column, flag)


# -------------------------------------------------------------- isolation forest

def _grow(names: list[str], max_depth: int):
    """Function that grows one random isolation tree from its sample (a few hundred rows)."""
    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        tree = int(pdf["_tree"].iloc[0])
        data = pdf.sort_values("_h")[names].to_numpy(dtype=float)
        rng = np.random.default_rng(tree)
        nodes = []

        def split(rows, depth):
            at = len(nodes)
            nodes.append(None)
            spans = [j for j in range(data.shape[1]) if len(rows) > 1 and data[rows, j].min() < data[rows, j].max()]
            if depth >= max_depth or not spans:
                nodes[at] = (tree, at, -1, 0.0, -1, -1, len(rows))
                return at
            j = spans[rng.integers(len(spans))]
            cut_at = rng.uniform(data[rows, j].min(), data[rows, j].max())
            left = split(rows[data[rows, j] < cut_at], depth + 1)
            right = split(rows[data[rows, j] >= cut_at], depth + 1)
            nodes[at] = (tree, at, j, float(cut_at), left, right, len(rows))
            return at

        split(np.arange(len(data)), 0)
        return pd.DataFrame(nodes, columns=["tree", "node", "feature", "cut", "left", "right", "size"])

    return grow


# --- fixed values ------------------------------------------------------------
TREE_CELLS = 1 << 18    # cells of one tree's table; a tree with more is walked node by node
FOREST_CELLS = 1 << 24  # cells of all tables of a forest
TREES_PER_BLOCK = 128   # trees whose cuts are ranked together
MOST_BUCKETS = 20       # bits of the bucket that bounds a value's copies
# --- end of fixed values -----------------------------------------------------


def _expected(n):
    """Expected depth of a leaf that holds n rows."""
    import numpy as np

    n = np.asarray(n, dtype=float)
    big = np.maximum(n, 2.0)
    value = 2.0 * (np.log(np.maximum(big - 1.0, 1.0)) + 0.5772156649) - 2.0 * (big - 1.0) / big
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, value))


def _table(nodes: list[tuple], features: int, most: int):
    """``(cuts by feature, cells, depths)`` of a tree, or None if it has more than ``most`` cells.

    A row's rank in a feature is the number of the tree's cuts that are not above its value.  The cells hold the
    leaf that each combination of ranks leads to, the last feature's ranks side by side.
    """
    import numpy as np

    cuts = [np.unique([n[1] for n in nodes if n[0] == j]) for j in range(features)]
    shape = [len(c) + 1 for c in cuts]
    if math.prod(shape) > most:
        return None
    leaves = [n for n in nodes if n[0] < 0]
    cells = np.zeros(shape, dtype=np.min_scalar_type(len(leaves)))
    depths, sizes, todo = [], [], [(0, 0, [slice(0, n) for n in shape])]
    while todo:
        at, depth, box = todo.pop()
        feature, cut_at, left, right, size = nodes[at]
        if feature < 0:
            cells[tuple(box)] = len(depths)
            depths.append(depth)
            sizes.append(size)
            continue
        border, span = int(np.searchsorted(cuts[feature], cut_at)) + 1, box[feature]
        below, above = slice(span.start, min(span.stop, border)), slice(max(span.start, border), span.stop)
        todo += [(child, depth + 1, [*box[:feature], half, *box[feature + 1:]]) for child, half in ((left, below), (right, above))]
    return cuts, cells.ravel(), np.array(depths, dtype=float) + _expected(sizes)


def _walk(nodes: list[tuple]):
    """``(levels, features, cuts, children, depths)`` of a tree whose leaves are their own children."""
    import numpy as np

    feature, cut_at, left, right, size = (np.array(x) for x in zip(*nodes))
    here = np.arange(len(nodes))
    leaf = feature < 0
    children = np.column_stack([np.where(leaf, here, left), np.where(leaf, here, right)]).ravel()
    level = np.zeros(len(nodes), dtype=int)
    for at in np.nonzero(~leaf)[0]:     # a node comes before its children
        level[[left[at], right[at]]] = level[at] + 1
    return int(level.max()), np.where(leaf, 0, feature), cut_at, children, level + _expected(size)


def _scorer(trees: list[list[tuple]], sample: int):
    """Arrow batch function: anomaly score 2^(-mean depth / expected depth).

    Trees become tables: a value is ranked once among the cuts of a block of trees, small tables turn this rank into
    one tree's share of the cell's number, and numbers of several trees are added up as bit fields of one integer.
    """
    import numpy as np

    features = 1 + max((n[0] for nodes in trees for n in nodes), default=-1)
    most = min(TREE_CELLS, FOREST_CELLS // max(len(trees), 1))
    blocks = []
    for block in batches(trees, TREES_PER_BLOCK):
        tables = [_table(nodes, features, most) for nodes in block]
        cuts = [np.unique(np.concatenate([t[0][j] for t in tables if t] or [[]])) for j in range(features)]
        groups, bits = [], 64
        for nodes, table in zip(block, tables):
            if table is None:
                groups.append((None, [_walk(nodes)]))
                bits = 64
                continue
            own, cells, depths = table
            width = (len(cells) - 1).bit_length()
            if bits + width > 63:
                groups.append(([np.zeros(len(c) + 1, dtype=np.int64) for c in cuts], []))
                bits = 0
            step = 1
            for j in reversed(range(features)):
                groups[-1][0][j][1:] += (np.searchsorted(own[j], cuts[j], side="right") * step) << bits
                step *= len(own[j]) + 1
            groups[-1][1].append((bits, (1 << width) - 1, cells, depths))
            bits += width
        blocks.append((cuts, groups))
    scale = max(float(_expected(sample)), 1e-9)

    def score(*columns: pd.Series) -> pd.Series:
        data = [c.to_numpy(dtype=float) for c in columns]
        rows = len(data[0])
        depth, found = np.zeros(rows), np.zeros(rows)
        number, part = np.zeros(rows, dtype=np.int64), np.zeros(rows, dtype=np.int64)
        flat = row = None
        # trees are added in their order, so that rows of the same leaves get the same sum to the last bit
        for cuts, groups in blocks:
            rank = [np.searchsorted(c, x, side="right") for c, x in zip(cuts, data)]
            for shares, members in groups:
                if shares is None:
                    if flat is None:
                        flat, row = np.concatenate(data), np.arange(rows)
                    levels, feature, cut_at, children, depths = members[0]
                    at = np.zeros(rows, dtype=np.int64)
                    for _ in range(levels):
                        at = children[2 * at + ~(flat[feature[at] * rows + row] < cut_at[at])]
                    depth += depths[at]
                    continue
                for j in range(features):
                    np.take(shares[j], rank[j], out=part if j else number, mode="clip")
                    if j:
                        number += part
                for shift, mask, cells, depths in members:
                    np.right_shift(number, shift, out=part)
                    np.bitwise_and(part, mask, out=part)
                    np.take(depths, cells.take(part, mode="clip"), out=found, mode="clip")
                    depth += found
        result = 2.0 ** (-(depth / max(len(trees), 1)) / scale)
        result[np.isnan(data).any(axis=0)] = np.nan
        return pd.Series(result)

    return score


def _packed(score):
    """Arrow function over batches: one row with the scores of a batch, so that keeping them costs their bytes only."""
    def pack(parts):
        import pyarrow as pa

        for part in parts:
            scores = score(*[c.to_pandas() for c in part.columns]).to_numpy()
            ends = pa.array([0, len(scores)], pa.int32())
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, pa.array(scores))], ["s"])

    return pack


@action("isolation_forest")
def isolation_forest(df: DataFrame, columns=None, contamination: float = 0.05, trees: int = 100, sample: int = 256,
                     seed: int = 42, score_col: str = "anomaly_score", flag_col: str = "is_anomaly") -> DataFrame:
    """Score and flag of every row.

    Equal rows are counted, and each value is drawn in proportion to its count;
    its copies are dealt over the trees by hash.  Every tree is grown by one task
    from at most ``sample`` of them; the forest (at most trees * 2 * sample small
    nodes) scores all rows in Arrow batches: once for the cut, which is read from
    the kept scores, and once for the result.
    """
    names = [c for c in chosen(df, columns, numeric_columns(df)) if is_numeric(df, c)]
    values = df.select(*[col(c).cast("double").alias(c) for c in names]).dropna()
    # equal rows share a bucket, so that a bucket's rows bound the copies of each of its values
    hashed = F.xxhash64(*[col(c) for c in names], F.lit(seed), F.lit(0))
    buckets = 1 << min((8 * trees * sample - 1).bit_length(), MOST_BUCKETS)
    bucket = hashed.bitwiseAND(F.lit(buckets - 1))
    counts = cut(values.groupBy(bucket.alias("_b")).agg(F.count(F.lit(1)).alias("_most")))
    count, top = counts.agg(F.sum("_most"), F.max("_most")).first()
    if not count:
        return df.withColumns({score_col: F.lit(None).cast("double"), flag_col: F.lit(False)})
    sample = min(sample, count)
    # on average 1.3 * sample rows per tree are drawn, then cut to sample
    rate = min(trees * sample * 1.3 / count, float(trees))

    # a draw from [0, 1) by the value, so that it doesn't depend on how rows are dealt; a value with c rows is drawn
    # rate * c times, rounded up or down by the draw so that this holds on average
    chance = hashed.bitwiseAND(F.lit((1 << 53) - 1)) / float(1 << 53)
    # values that not even their bucket's rows would draw needn't be counted: about an eighth of many different ones is left
    hopeful = values.where(F.lit(rate) * F.lit(top) + chance >= 1).withColumn("_b", bucket).join(
        F.broadcast(counts), "_b").where(F.lit(rate) * F.col("_most") + chance >= 1)
    picked = hopeful.groupBy(*[col(c) for c in names]).agg(F.count(F.lit(1)).alias("_c")).withColumn(
        "_n", F.floor(F.lit(rate) * F.col("_c") + chance).cast("long")).where("_n > 0")
    drawn = picked.withColumn("_d", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n")))).withColumn(
        "_h", F.xxhash64(*[col(c) for c in names], F.lit(seed), F.col("_d"))).withColumn(
        "_tree", F.pmod("_h", F.lit(trees)).cast("int"))
    # by number, or the few rows would become one task, which grows all trees
    spread = min(trees, max(df.sparkSession.sparkContext.defaultParallelism, 1))
    ranked = drawn.repartition(spread, "_tree").withColumn(
        "_r", F.row_number().over(W.partitionBy("_tree").orderBy("_h"))).where(F.col("_r") <= sample)
    depth = max(1, (sample - 1).bit_length())
    grown = ranked.select("_tree", "_h", *[col(c) for c in names]).groupBy("_tree").applyInPandas(
        _grow(names, depth), "tree int, node int, feature int, cut double, left int, right int, size int")
    forest: dict[int, list[tuple]] = {}
    for r in sorted(grown.collect(), key=lambda r: (r.tree, r.node)):
        forest.setdefault(r.tree, []).append((r.feature, r.cut, r.left, r.right, r["size"]))
    scorer = _scorer(list(forest.values()), sample)
    kept = cut(values.mapInArrow(_packed(scorer), "s array<double>"))
    cut_at = quantiles(kept.select(F.explode("s").alias("s")), {"s": F.col("s")}, [1 - contamination])["s"][0]
    score = F.pandas_udf(scorer, "double")
    scored = df.withColumn(score_col, score(*[col(c).cast("double") for c in names]))
    return scored.withColumn(flag_col, F.coalesce(col(score_col) > F.lit(cut_at), F.lit(False)))


@action("cluster_anomalies")
def cluster_anomalies(df: DataFrame, column: str, k: int = 3, quantile: float = 0.95, seed: int = 42,
                      flag_col: str = "is_anomaly") -> DataFrame:
    """Rows far from the nearest k-means centre of the scaled column."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    m = moments(df, {"v": col(column)})["v"]
    if not m["pstd"]:
        return df.withColumn(flag_col, F.lit(False))
    scaled = (col(column).cast("double") - m["mean"]) / m["pstd"]
    vectors = VectorAssembler(inputCols=["_z"], outputCol="features").transform(
        df.select(scaled.alias("_z")).where("_z is not null"))
    centres = [float(c[0]) for c in KMeans(k=k, seed=seed).fit(vectors).clusterCenters()]
    gaps = [F.abs(scaled - c) for c in centres]
    distance = F.least(*gaps) if len(gaps) > 1 else gaps[0]
    limit = quantiles(df, {"d": distance}, [quantile])["d"][0]
    return df.withColumn(flag_col, F.coalesce(distance > limit, F.lit(False)))


# ------------------------------------------------------------------ text, domain

# --- fixed values ------------------------------------------------------------
SUSPICIOUS = r"(?i)[<>\"']|test|fake|sample"
REPEATED = r"^(.+?)\1{3,}"
# --- end of fixed values -----------------------------------------------------


def text_anomalies(df: DataFrame, columns=None) -> DataFrame:
    """``(column, type, count)``: unusual length (below 10 % of rows), suspicious content, repeats."""
    parts = []
    for name in as_list(columns) or string_columns(df):
        text = col(name)
        m = moments(df, {"l": F.length(text)})["l"]
        far = F.abs((F.length(text) - m["mean"]) / m["std"]) > 2 if m["std"] else F.lit(False)
        counted = df.agg(F.count(text).alias("n"), F.count_if(far).alias("l"), F.count_if(text.rlike(SUSPICIOUS)).alias("s"),
                         F.count_if(text.rlike(REPEATED)).alias("r"))
        items = F.array(*[F.struct(F.lit(name).alias("column"), F.lit(t).alias("type"), c.alias("count")) for t, c in (
            ("unusual_length", F.when(F.col("l") < F.col("n") * 0.1, F.col("l")).otherwise(0)),
            ("suspicious_content", F.col("s")), ("repeated_pattern", F.col("r")))])
        parts.append(counted.select(F.inline(items)))
    return union_all(parts).where(F.col("count") > 0)


def domain_anomalies(df: DataFrame, domain: str, as_of: str | None = None) -> DataFrame:
    """``(column, type, count)`` of format and amount checks of healthcare or financial tables, and future dates."""
    found = []
    now = F.lit(as_of).cast("timestamp_ntz") if as_of else F.current_timestamp().cast("timestamp_ntz")
    for name in df.columns:
        low, text = name.lower(), col(name).cast("string")
        if domain == "healthcare":
            if "icd" in low:
                found.append((name, "invalid_icd_code", ~text.rlike(r"^[A-Z]\d{2}(\.\d{1,2})?$")))
            if "ssn" in low or "social" in low:
                found.append((name, "invalid_ssn_format", ~text.rlike(r"^\d{3}-\d{2}-\d{4}$")))
        if domain == "financial" and any(w in low for w in ("amount", "price", "cost", "balance")):
            value = to_number(col(name), is_numeric(df, name))
            found.append((name, "negative_amount", value < 0))
            top = quantiles(df, {"v": value}, [0.99])["v"][0]
            if top is not None:
                found.append((name, "extreme_amount", value > top * 10))
        if "date" in low or "time" in low or is_temporal(df, name):
            found.append((name, "future_date", as_timestamp(df, name, False) > now))
    if not found:
        return df.sparkSession.createDataFrame([], "column string, type string, count long")
    counted = df.agg(*[F.count_if(test).alias(f"c{i}") for i, (_n, _t, test) in enumerate(found)])
    items = F.array(*[F.struct(F.lit(n).alias("column"), F.lit(t).alias("type"), F.col(f"c{i}").alias("count"))
                      for i, (n, t, _x) in enumerate(found)])
    return counted.select(F.inline(items)).where(F.col("count") > 0)


# ------------------------------------------------------------------ time series

def decompose(df: DataFrame, order_by, value_col: str, period: int, partition_by=None,
              rows_per_bucket: int | None = None) -> DataFrame:
    """Adds trend (centred moving mean), seasonal (mean detrended value per phase) and residual."""
    keys, order = as_list(partition_by), as_list(order_by)
    data = df.where(col(value_col).isNotNull())
    half = period // 2
    value = col(value_col).cast("double")
    numbered = running(data, keys, order, {"_row": ("count", F.lit(1))}, rows_per_bucket=rows_per_bucket)
    width = max(rows_per_bucket or ROWS_PER_BUCKET, 10 * half)
    copied = overlapping(numbered, keys, F.col("_row") - 1, width, half, [c for c in numbered.columns if c not in keys])
    near = W.partitionBy(*[col(k) for k in keys], F.col("_chunk")).orderBy("_at").rowsBetween(-half, half)
    trended = copied.withColumn("trend", F.avg(value).over(near)).where("_own").drop(*MARKS)
    # read by the means and by the result
    phased = cut(trended.withColumn("_phase", F.pmod(F.col("_row") - 1, F.lit(period))))
    means = phased.groupBy(*[col(k).alias(f"_g{i}") for i, k in enumerate(keys)], F.col("_phase").alias("_p")).agg(
        F.avg(value - F.col("trend")).alias("_s"))
    on = [F.col("_phase") == F.col("_p")] + [col(k).eqNullSafe(F.col(f"_g{i}")) for i, k in enumerate(keys)]
    joined = phased.join(means, on)
    out = joined.withColumns({"seasonal": F.col("_s"), "residual": value - F.col("trend") - F.col("_s")})
    return out.select(*[col(c) for c in df.columns], "_row", "trend", "seasonal", "residual")


def _decomposed(df: DataFrame, order_by, value_col: str, period: int, partition_by, rows_per_bucket: int | None, method: str) -> DataFrame:
    """Parts of the series, cut so that the statistics and the result may read them in turn."""
    if method == "means":
        return decompose(df, order_by, value_col, period, partition_by, rows_per_bucket)
    if method == "stl":
        return stl(df, order_by, value_col, period, partition_by, rows_per_bucket=rows_per_bucket).drop("weight").transform(cut)
    raise ValueError(f"unknown decomposition: {method}")


def timeseries_anomalies(df: DataFrame, order_by, value_col: str, period: int | None = None, partition_by=None,
                         k: float = 3.0, rows_per_bucket: int | None = None, method: str = "means") -> DataFrame:
    """Rows whose residual leaves the k-IQR fence, with residual and z-score.

    Trend and seasonal parts come from moving means, or with ``method`` "stl" from
    robust local regression, where a series without two whole periods has no anomalies.
    """
    period = period or infer_period(df, as_list(order_by)[0])
    parts = _decomposed(df, order_by, value_col, period, partition_by, rows_per_bucket, method)
    q1, q3 = quantiles(parts, {"r": F.col("residual")}, [0.25, 0.75])["r"]
    std = moments(parts, {"r": F.col("residual")})["r"]["std"] or 1.0
    if q1 is None:
        return parts.limit(0)
    low, high = q1 - k * (q3 - q1), q3 + k * (q3 - q1)
    return parts.where((F.col("residual") < low) | (F.col("residual") > high)).withColumn(
        "zscore", F.col("residual") / F.lit(std)).drop("_row")


def timeseries_summary(df: DataFrame, order_by, value_col: str, period: int | None = None, k: float = 3.0,
                       rows_per_bucket: int | None = None, method: str = "means") -> DataFrame:
    """One row: anomalies, their kind (level_shift, trending_anomaly, point_anomaly), severity, trend slope."""
    period = period or infer_period(df, as_list(order_by)[0])
    parts = _decomposed(df, order_by, value_col, period, None, rows_per_bucket, method)
    q1, q3 = quantiles(parts, {"r": F.col("residual")}, [0.25, 0.75])["r"]
    if q1 is None:
        q1 = q3 = float("nan")  # no row has a residual: no anomalies
    low, high = q1 - k * (q3 - q1), q3 + k * (q3 - q1)
    bad = (F.col("residual") < low) | (F.col("residual") > high)
    totals = parts.agg(F.count("*").alias("rows"), F.count_if(bad).alias("anomaly_count"),
                       F.regr_slope("trend", F.col("_row").cast("double")).alias("trend_slope"))
    share = F.try_divide("anomaly_count", "rows")
    kind = F.when(share > 0.15, "level_shift").when(F.abs("trend_slope") > 0.5, "trending_anomaly").otherwise("point_anomaly")
    return totals.withColumns({"anomaly_type": kind, "severity": F.when(share > 0.05, "high").otherwise("medium")})


def rolling_zscore_anomalies(df: DataFrame, order_by, value_col: str, window: int = 7, min_periods: int = 3, threshold: float = 3.0,
                             partition_by=None, rows_per_bucket: int | None = None) -> DataFrame:
    """Adds ``zscore`` against the centred window and ``is_anomaly``."""
    after = (window - 1) // 2
    before = window - 1 - after
    value = col(value_col).cast("double")

    def build(w) -> dict[str, Column]:
        frame = w.rowsBetween(-before, after)
        enough = F.count(value).over(frame) >= min_periods
        std = F.stddev_samp(value).over(frame)
        return {"zscore": F.when(enough & (std > 0), (value - F.avg(value).over(frame)) / std)}

    out = over_rows(df, partition_by, order_by, before, after, build, rows_per_bucket)
    return out.withColumn("is_anomaly", F.coalesce(F.abs("zscore") > threshold, F.lit(False)))


def infer_period(df: DataFrame, date_col: str, rows_per_bucket: int | None = None) -> int:
    """Season length from the most common gap: hours 24, days 7, weeks 4, months 12, quarters 4."""
    stamps = df.select(as_timestamp(df, date_col, False).alias("t")).where("t is not null").distinct()
    gaps = over_rows(stamps, None, ["t"], 1, 0, lambda w: {
        "gap": F.round((F.unix_micros(F.col("t").cast("timestamp")) - F.unix_micros(F.lag("t").over(w).cast("timestamp"))) / 3.6e9, 1)}, rows_per_bucket)
    row = gaps.where("gap is not null").groupBy("gap").count().orderBy(F.desc("count"), "gap").limit(1).collect()
    hours = row[0].gap if row else 24.0
    for limit, period in ((12, 24), (3 * 24, 7), (14 * 24, 4), (45 * 24, 12), (120 * 24, 4)):
        if hours <= limit:
            return period
    return 7
