"""Ranks, percentiles, weighted means, vectors, slopes, bins and distances between distributions."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import cut, joined, running, value_ranks


def percentiles(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Three percentiles within groups, over rows with a value: strict (share below), mid (below and half of ties) and average rank."""
    out = joined(df, value_ranks(df, by, value), [*by, value], by="merge")
    below, ties, n = F.col("below"), F.col("ties"), F.col("n")
    return out.withColumns({"pct_strict": 100.0 * below / n, "pct_mid": 100.0 * (below + ties / 2) / n, "pct_average": 100.0 * (below + (ties + 1) / 2) / n, "rank_desc": n - below - ties + 1}).drop("below", "ties", "n")


def quantiles(df: DataFrame, by: Sequence[str], value: str, wanted: dict[str, float]) -> DataFrame:
    """(by, names): exact quantiles (name -> share) of a group's values, straight between neighbours; groups without values have no row, and a table without any has nulls where nothing groups it.

    The rows at both sides of each place are picked from counts by value, whose running sums go by ranges: no task
    holds all distinct values of a group.
    """
    ranks = value_ranks(df, by, value)
    place = {n: (F.col("n") - 1) * p for n, p in wanted.items()}
    v = F.col(value).cast("double")
    pick = lambda at: F.max(F.when((F.col("below") <= at) & (at < F.col("below") + F.col("ties")), v))
    out = ranks.groupBy(*by).agg(F.max("n").alias("n"), *[c for n, at in place.items() for c in (pick(F.floor(at)).alias(f"_l_{n}"), pick(F.ceil(at)).alias(f"_h_{n}"))])
    between = {n: F.col(f"_l_{n}") + (F.col(f"_h_{n}") - F.col(f"_l_{n}")) * (at - F.floor(at)) for n, at in place.items()}
    return out.select(*by, *[c.alias(n) for n, c in between.items()])


def auc(df: DataFrame, by: Sequence[str], score: str, label: Column) -> DataFrame:
    """(by, auc, positives, negatives): the share of pairs of a positive and a negative in which the positive has the higher score, equal ones half; null without both. Exact, from counts by score."""
    rows = df.where(F.col(score).isNotNull() & label.isNotNull()).withColumn("_y", label.cast("long"))
    per = rows.groupBy(*by, score).agg(F.sum("_y").alias("_positives"))
    out = joined(value_ranks(rows, by, score), per, [*by, score], by="merge")
    p = F.sum("_positives")
    n = F.sum("ties") - p
    won = F.sum(F.col("_positives") * (F.col("below") + (F.col("ties") + 1) / 2)) - p * (p + 1) / 2
    return out.groupBy(*by).agg(F.try_divide(won, p * n).alias("auc"), p.alias("positives"), n.alias("negatives"))


def wavg(value: str | Column, weight: str | Column) -> Column:
    v, w = (F.col(x) if isinstance(x, str) else x for x in (value, weight))
    use = v.isNotNull() & w.isNotNull()
    return F.try_divide(F.sum(F.when(use, v * w)), F.sum(F.when(use, w)))


def zscored(df: DataFrame, values: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Population z-scores within groups; a spread of zero counts as one."""
    spread = df.groupBy(*by).agg(*[F.avg(v).alias(f"_m_{v}") for v in values], *[F.stddev_pop(v).alias(f"_s_{v}") for v in values])
    out = joined(df, spread, by)
    return out.withColumns({f"z_{v}": (F.col(v) - F.col(f"_m_{v}")) / F.coalesce(F.nullif(F.col(f"_s_{v}"), F.lit(0.0)), F.lit(1.0)) for v in values}).drop(*[f"_{x}_{v}" for x in "ms" for v in values])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 where one has no length."""
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def fit_score(cos: Column) -> Column:
    return F.least(F.greatest((cos + 1) * 50, F.lit(0.0)), F.lit(100.0))


#: Most rows of a block of vectors, and of a block of queries, that meet at once; and most bytes of either.
VECTOR_BLOCK, QUERY_BLOCK, BLOCK_BYTES = 4_096, 500, 4 << 20


def _blocks(rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            longest = pc.max(pc.list_value_length(b.column(1))).as_py() or 1
            step = max(1, min(rows, BLOCK_BYTES // (8 * longest)))
            for at in range(0, b.num_rows, step):
                part = b.slice(at, step)
                arrays = [pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), pa.concat_arrays([c])) for c in part.columns]
                yield pa.RecordBatch.from_arrays(arrays, names=b.schema.names)

    return packed


def _matrices(vectors: pa.ListArray) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Length -> (rows, values, squared lengths, unit vectors, odd) of the vectors without nulls; odd ones have no useful unit vector. Squares are added in the order of cosine()."""
    length = vectors.value_lengths().fill_null(0).to_numpy()
    flat = vectors.flatten()
    good = length > 0
    good[np.repeat(np.arange(len(length)), length)[flat.is_null().to_numpy(zero_copy_only=False)]] = False
    values, starts, out = flat.fill_null(0.0).to_numpy(), np.cumsum(length) - length, {}
    for n in np.unique(length[good]):
        rows = np.flatnonzero(good & (length == n))
        x = values[starts[rows][:, None] + np.arange(n)]
        square = np.zeros(len(rows))
        with np.errstate(all="ignore"):
            for d in range(n):
                square += x[:, d] * x[:, d]
            odd = ~np.isfinite(square) | (square < 1e-250) & x.any(axis=1)
            unit = np.where((odd | (square == 0))[:, None], 0.0, x / np.sqrt(square)[:, None])
        out[int(n)] = rows, x, square, unit, odd
    return out


def _cosines(q: np.ndarray, qq: np.ndarray, v: np.ndarray, vv: np.ndarray) -> np.ndarray:
    """cosine() of arrays of vectors that broadcast against each other, in its own order of additions, so to the last bit."""
    with np.errstate(all="ignore"):
        total = np.zeros(np.broadcast_shapes(q.shape[:-1], v.shape[:-1]))
        for d in range(q.shape[-1]):
            total += q[..., d] * v[..., d]
        size = np.sqrt(qq) * np.sqrt(vv)
        return np.where(size == 0, 0.0, total / size)


def _nearest_in_blocks(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of each block of queries and block of vectors the k best of every query: products of unit vectors leave what rounding could still bring among them, cosine() decides."""

    def one(names: pa.Array, vectors: pa.ListArray, queries: pa.Array, wanted: pa.ListArray) -> pa.RecordBatch:
        key, asked = (np.asarray(a.to_numpy(zero_copy_only=False)) for a in (names, queries))
        score = np.zeros((len(asked), len(key)))  # 0 where a vector is missing or lengths differ
        slack, exact = np.zeros(len(asked)), []
        left, right = _matrices(wanted), _matrices(vectors)
        for n in left.keys() & right.keys():
            (i, q, qq, qu, q_odd), (j, v, vv, vu, v_odd) = left[n], right[n]
            part = qu @ vu.T
            if q_odd.any():
                part[q_odd] = _cosines(q[q_odd][:, None], qq[q_odd][:, None], v[None], vv[None])
            if v_odd.any():
                part[:, v_odd] = _cosines(q[:, None], qq[:, None], v[v_odd][None], vv[v_odd][None])
            score[np.ix_(i, j)] = np.where(np.isnan(part), np.inf, np.maximum(part, -2.0))  # NaN counts as more than any number
            slack[i] = (n + 8) * 2e-15  # twice what both ways of rounding can differ by
            exact.append((i, q, qq, j, v, vv))
        order = np.unique(key, return_inverse=True)[1]
        place = {x: at for at, x in enumerate(key[np.unique(order, return_index=True)[1]])}
        code = np.array([place.get(x, -1) for x in asked])
        known = np.flatnonzero(np.isin(code, order))
        score[known] = np.where(order[None] == code[known][:, None], -np.inf, score[known])  # the query itself
        least = np.full(len(asked), -np.inf) if len(key) <= k else np.partition(score, len(key) - k, axis=1)[:, len(key) - k]
        a, b = np.nonzero((score >= (least - slack)[:, None]) & (score > -np.inf))
        value = np.zeros(len(a))
        for i, q, qq, j, v, vv in exact:
            row, col = np.full(len(asked), -1), np.full(len(key), -1)
            row[i], col[j] = np.arange(len(i)), np.arange(len(j))
            both = np.flatnonzero((row[a] >= 0) & (col[b] >= 0))
            for at in range(0, len(both), 100_000):
                some = both[at : at + 100_000]
                value[some] = _cosines(q[row[a[some]]], qq[row[a[some]]], v[col[b[some]]], vv[col[b[some]]])
        best = np.lexsort((order[b], np.where(np.isnan(value), -np.inf, -value), a))
        first = np.searchsorted(a, a[best])  # a rises, and so does a[best]
        best = best[np.arange(len(best)) - first < k]
        return pa.RecordBatch.from_arrays([queries.take(pa.array(a[best])), names.take(pa.array(b[best])), pa.array(value[best])], names=["query", "neighbour", "similarity"])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                yield one(*[batch.column(c)[at].values for c in ("_keys", "_vectors", "_queries", "_wanted")])

    return found


def nearest(vectors: DataFrame, queries: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """The k rows of highest cosine to each query row, itself left out, ties by key.

    Blocks of queries meet blocks of rows; of each two blocks only the k best of a query go on. All pairs are compared,
    so the work grows with queries times rows.
    """
    spark, kind = vectors.sparkSession, vectors.schema[key].dataType.simpleString()
    rows = lambda df: df.where(F.col(key).isNotNull()).select(F.col(key), F.col(vector).cast("array<double>"))
    tasks = spark.sparkContext.defaultParallelism
    of = cut(rows(vectors).mapInArrow(_blocks(VECTOR_BLOCK), f"_keys array<{kind}>, _vectors array<array<double>>").repartition(tasks))
    to = cut(rows(queries).mapInArrow(_blocks(QUERY_BLOCK), f"_queries array<{kind}>, _wanted array<array<double>>")).coalesce(3)
    out = of.crossJoin(to).mapInArrow(_nearest_in_blocks(k), f"query {kind}, neighbour {kind}, similarity double")
    w = Window.partitionBy("query").orderBy(F.desc("similarity"), "neighbour")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def trend(df: DataFrame, by: Sequence[str], x: str, y: str, threshold: float = 0.05) -> DataFrame:
    """Per group: slope, R2, first-to-last change and a label by that change relative to the mean. Groups of one x have no slope."""
    out = df.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_r2(y, x).alias("r2"), F.count("*").alias("n"), (F.max_by(y, x) - F.min_by(y, x)).alias("change"), F.avg(y).alias("mean"))
    rel = F.try_divide("change", F.abs("mean"))
    return out.withColumns({"slope": F.when(F.col("n") >= 2, F.col("slope")), "r2": F.when(F.col("n") >= 2, F.col("r2")), "label": F.when(rel > threshold, "increasing").when(rel < -threshold, "decreasing").otherwise("stable")})


def equal_bin(value: Column, low: float, high: float, n: int) -> Column:
    """The bin from 0 of n equal ones; the last holds its upper edge."""
    return F.least(F.greatest(F.floor((value - low) / ((high - low) / n)), F.lit(0)), F.lit(n - 1)).cast("int")


def quantile_bins(df: DataFrame, value: str, n: int, name: str = "bin") -> DataFrame:
    """Right-closed bins between the exact quantiles, equal edges merged; the first holds its lower edge. ntile() differs on ties."""
    ends = [f"_{i}" for i in range(n + 1)]
    edges = quantiles(df, [], value, {c: i / n for i, c in enumerate(ends)}).select(F.array_distinct(F.array(*ends)).alias("_edges"))
    return df.crossJoin(F.broadcast(edges)).withColumn(name, F.greatest(F.size(F.filter("_edges", lambda e: e < F.col(value))) - 1, F.lit(0))).drop("_edges")


def ks_distance(df: DataFrame, value: str, second: Column, by: Sequence[str] = ()) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov distance per group: values are counted first, and their running counts go by ranges."""
    per = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count_if(~second).alias("a"), F.count_if(second).alias("b"))
    per = running(per, by, [value], {"_a": F.col("a"), "_b": F.col("b")})
    whole = per.groupBy(*by).agg(F.sum("a").alias("n_a"), F.sum("b").alias("n_b"))
    gap = F.abs(F.try_divide("_a", "n_a") - F.try_divide("_b", "n_b"))
    return joined(per, whole, by).groupBy(*by).agg(F.max(gap).alias("ks"), F.max("n_a").alias("n_a"), F.max("n_b").alias("n_b"))


def spearman(df: DataFrame, by: Sequence[str], a: str, b: str) -> DataFrame:
    """Correlation of average ranks within groups, over rows that have both values."""
    out = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    for v, name in ((a, "_ra"), (b, "_rb")):
        ranks = value_ranks(out, by, v)
        out = joined(out, ranks.select(*by, v, (F.col("below") + (F.col("ties") + 1) / 2).alias(name)), [*by, v], by="merge")
    return out.groupBy(*by).agg(F.corr("_ra", "_rb").alias("spearman"), F.count("*").alias("n"))


def ranked(df: DataFrame, by: Sequence[str], value: str, name: str = "rank") -> DataFrame:
    """Rows with a value and their rank within the group, the highest first, equal values sharing the least rank."""
    ranks = value_ranks(df, by, value)
    return joined(df, ranks.select(*by, value, (F.col("n") - F.col("below") - F.col("ties") + 1).alias(name)), [*by, value], by="merge")


def shrunk(score: Column, weight: Column, prior: Column, reference: float) -> Column:
    """The score drawn to a prior by reference / (reference + weight); a weight that is null, no number, infinite or not positive means the prior alone."""
    good = weight.isNotNull() & ~F.isnan(weight.cast("double")) & (weight > 0) & (weight.cast("double") < float("inf"))
    w = F.when(good, reference / (reference + weight)).otherwise(1.0)
    return F.when(w == 1.0, prior).otherwise(w * prior + (1 - w) * score)


def median_imputed(df: DataFrame, by: Sequence[str], value: str, name: str) -> DataFrame:
    """value, or its exact median within the group where it is missing; medians are joined back as a small table."""
    return joined(df, quantiles(df, by, value, {"_median": 0.5}), by, "left").select(*df.columns, F.coalesce(value, "_median").alias(name))


def depth(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Per group: count, least, median, most, mean, population spread and quartiles."""
    v = F.col(value)
    out = df.groupBy(*by).agg(F.count(v).alias("n"), F.min(v).alias("low"), F.max(v).alias("high"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"))
    return joined(out, quantiles(df, by, value, {"median": 0.5, "p25": 0.25, "p75": 0.75}), by, "left")
