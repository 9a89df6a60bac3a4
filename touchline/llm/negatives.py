"""Hard negatives by angular triangle filtering.

Every vector keeps its angles to a few reference directions. For an anchor at angle x to such a direction and a vector
at angle y, the angle between the two is at least |x - y| and at most x + y (or 2 pi - x - y); the best of all
directions gives an interval of the cosine and, times both norms, of the score. Intervals are widened by more than all
rounding, so what lies outside a wanted window of scores needs no scoring; the rest is scored exactly in integers.

Rows are sorted by label, nearest direction and angle and packed into chunks of one label, in which equal vectors are one
entry with their least ids; a chunk has bounds of its angles and norms, by which it is skipped whole. Anchors are packed
into blocks alike. Chunks are dealt into parts and blocks into groups, both of bounded size whatever the input's, and
each group meets each part, so a label that holds a third of all rows is spread, and a task holds one group and one part
at a time. Both sides are shuffled, never broadcast. A first pass finds each anchor's positives, a second one, with the
windows of scores that follow from them, its negatives; the chunks that the windows of a block exclude are left out. A
task sends on the best few of each anchor and window alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Reference directions, and rows of the least hashes of the id among which they are chosen, far apart from each other.
DIRECTIONS, SAMPLE = 16, 256
#: Vectors of a chunk, anchors of a block.
CHUNK, BLOCK = 1024, 64
#: Most chunks of a part and blocks of a group, on average: a task holds those of one part and one group at a time.
HELD, GROUP = 64, 256
#: Angles are off by less than this; scores by less than this times both norms, and one.
SLACK = 1e-6
NONE = np.iinfo(np.int64).min
MET = ["row", "place", "score", "id"]
EMPTY = pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * len(MET), names=MET)
PACKED = "block long, label long, lo array<double>, hi array<double>, norm_lo double, norm_hi double, window_lo long, window_hi long, rows binary, ids binary, members binary, vectors binary, angles binary, norms binary, windows binary"
LIMITS = ["label", "lo", "hi", "norm_lo", "norm_hi", "window_lo"]
PAYLOAD = ["rows", "ids", "members", "vectors", "angles", "norms", "windows"]


def directions(sample: list[np.ndarray]) -> np.ndarray:
    """Unit vectors of some of the sample, each the farthest from those before."""
    d = max((len(v) for v in sample), default=0)
    full = np.zeros((len(sample), d))
    for i, v in enumerate(sample):
        full[i, : len(v)] = v
    norms = np.linalg.norm(full, axis=1)
    full = full[norms > 0] / norms[norms > 0, None]
    if not len(full):
        return np.zeros((0, d))
    chosen, near = [0], full @ full[0]
    while len(chosen) < min(DIRECTIONS, len(full)):
        chosen.append(int(np.argmin(near)))
        near = np.maximum(near, full @ full[chosen[-1]])
    return full[chosen]


def _measured(vectors: np.ndarray, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(norms, angles to the directions) of integer vectors; a zero vector is at right angles to all."""
    v = vectors.astype(np.float64)
    norms = np.sqrt((v * v).sum(axis=1))
    d = min(v.shape[1], units.shape[1])
    cosines = v[:, :d] @ units[:, :d].T / np.where(norms > 0, norms, 1)[:, None]
    return norms, np.arccos(np.clip(cosines, -1, 1))


def _dense(vectors: list[bytes]) -> np.ndarray:
    """Vectors of 32-bit integers, shorter ones with zeros behind."""
    own = [np.frombuffer(v, dtype="<i4") for v in vectors]
    out = np.zeros((len(own), max((len(v) for v in own), default=0)), dtype="<i4")
    for i, v in enumerate(own):
        out[i, : len(v)] = v
    return out


class Packed:
    """A block or chunk as arrays: n vectors; members are the (row, id) of each, in order of id."""

    def __init__(self, rows: bytes, ids: bytes, members: bytes, vectors: bytes, angles: bytes, norms: bytes, windows: bytes):
        self.members, self.norms = np.frombuffer(members, dtype="<i8"), np.frombuffer(norms, dtype="<f8")
        self.rows, self.ids = np.frombuffer(rows, dtype="<i8"), np.frombuffer(ids, dtype="<i8")
        n = len(self.norms)
        self.vectors = np.frombuffer(vectors, dtype="<i4").reshape(n, -1 if n and len(vectors) else 0)
        self.angles = np.frombuffer(angles, dtype="<f8").reshape(n, -1 if n and len(angles) else 0)
        self.end = np.cumsum(self.members)
        # of each anchor: (place of the positive, least score, greatest score), unused places are (-1, 0, -1)
        self.windows = np.frombuffer(windows, dtype="<i8").reshape(n, -1, 3) if len(windows) else np.zeros((n, 0, 3), dtype=np.int64)

    def expanded(self, which: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(scores, ids, rows) of all members of some vectors."""
        many = self.members[which]
        at = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + np.repeat(self.end[which] - many, many)
        return np.repeat(scores, many), self.ids[at], self.rows[at]


def bounds(angles: np.ndarray, norm: float | np.ndarray, chunk: Packed) -> tuple[np.ndarray, np.ndarray]:
    """(least, greatest) score that each vector of a chunk can have with an anchor, or with each of several (a row each)."""
    product = np.asarray(norm)[..., None] * chunk.norms
    near, far = np.zeros_like(product), np.full_like(product, np.pi)
    for d in range(angles.shape[-1]):
        x, y = angles[..., d, None], chunk.angles[:, d]
        np.maximum(near, np.abs(x - y), out=near)
        total = x + y
        np.minimum(far, np.minimum(total, 2 * np.pi - total), out=far)
    slack = SLACK * product + 1
    return product * np.cos(np.minimum(far + SLACK, np.pi)) - slack, product * np.cos(np.maximum(near - SLACK, 0)) + slack


def _scores(a: np.ndarray, vectors: np.ndarray, bound: float) -> np.ndarray:
    """Exact integer inner products, of one anchor or of several (a row each); doubles hold them where no sum can pass 2^53."""
    d, kind = min(a.shape[-1], vectors.shape[1]), np.float64 if bound < 2**52 else np.int64
    return (a[..., :d].astype(kind) @ vectors[:, :d].astype(kind).T).astype(np.int64)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k first by descending score and ascending id."""
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


class Best:
    """The best (score, id) so far of each anchor of a block, and for negatives of each of its windows."""

    def __init__(self, block: Packed, k: int, negative: bool):
        self.block, self.k, self.negative = block, k, negative
        places = block.windows.shape[1] if negative else 1
        self.scores, self.ids = np.full((len(block.norms), places, k), NONE, dtype=np.int64), np.zeros((len(block.norms), places, k), dtype=np.int64)

    def least(self) -> float:
        """The score below which nothing is better than what there is."""
        last = self.scores[:, :, -1]
        if self.negative:
            used = self.block.windows[:, :, 0] >= 0
            last = np.maximum(last, self.block.windows[:, :, 1])[used]
        return float(last.min()) if last.size else np.inf

    def take(self, chunk: Packed) -> None:
        b = self.block
        least, most = bounds(b.angles, b.norms, chunk)
        # what could be better than the last of the best so far, equal scores included; and not above the window
        last = self.scores[:, :, -1]
        low, high = last, np.full_like(last, np.iinfo(np.int64).max)
        if self.negative:
            used = b.windows[:, :, 0] >= 0
            # an unused place takes nothing
            low, high = np.where(used, np.maximum(last, b.windows[:, :, 1]), high), np.where(used, b.windows[:, :, 2], NONE)
        inside = (most >= low.min(axis=1).astype(np.float64)[:, None]) & (least <= high.max(axis=1).astype(np.float64)[:, None])
        which, of = np.flatnonzero(inside.any(axis=0)), np.flatnonzero(inside.any(axis=1))
        if not len(which):
            return
        scores = _scores(b.vectors[of], chunk.vectors[which], float(b.norms[of].max()) * float(chunk.norms[which].max()) + 1)
        for place in range(low.shape[1]):
            good = inside[np.ix_(of, which)] & (scores >= low[of, place, None]) & (scores <= high[of, place, None])
            for k in np.flatnonzero(good.any(axis=1)).tolist():
                s, ids, rows = chunk.expanded(which[good[k]], scores[k, good[k]])
                if not self.negative:
                    other = rows != b.rows[of[k]]
                    s, ids = s[other], ids[other]
                self._merge(int(of[k]), place, s, ids)

    def _merge(self, i: int, place: int, scores: np.ndarray, ids: np.ndarray) -> None:
        own = self.scores[i, place] > NONE
        s, d = _best(np.concatenate((self.scores[i, place][own], scores)), np.concatenate((self.ids[i, place][own], ids)), self.k)
        self.scores[i, place, : len(s)], self.ids[i, place, : len(d)] = s, d

    def rows(self) -> pa.RecordBatch:
        i, place, k = np.nonzero(self.scores > NONE)
        positive = self.block.windows[i, place, 0] if self.negative else np.zeros(len(i), dtype=np.int64)
        return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (self.block.rows[i], positive, self.scores[i, place, k], self.ids[i, place, k])], names=MET)


def reaches(block: dict, chunks: dict) -> np.ndarray:
    """The greatest score that anchors of a block can have with rows of each of several chunks, by their bounds alone."""
    near = np.maximum((block["lo"] - chunks["hi"]).max(axis=1, initial=0), (chunks["lo"] - block["hi"]).max(axis=1, initial=0))
    cosine = np.cos(np.clip(near - 2 * SLACK, 0, np.pi))
    most = block["norm_hi"] * chunks["norm_hi"]
    return np.where(cosine >= 0, most, block["norm_lo"] * chunks["norm_lo"]) * cosine + SLACK * most + 1


def _meet(k: int, negative: bool):
    """The best of each anchor of a group of blocks among a part of the chunks, those that can reach the highest scores first."""

    def limits(table: pa.Table) -> dict:
        wide = lambda c: np.array(table[c].to_pylist(), dtype=np.float64).reshape(table.num_rows, -1 if table.num_rows else 0)
        return {c: wide(c) for c in ("lo", "hi")} | {c: table[c].to_numpy() for c in ("norm_lo", "norm_hi", "label", "window_lo")}

    def one(table: pa.Table, at: int) -> Packed:
        return Packed(*(table[c][at].as_buffer() for c in PAYLOAD))

    def run(blocks: pa.Table, chunks: pa.Table) -> pa.Table:
        out, own, other = [EMPTY], limits(blocks), limits(chunks)
        packed: dict[int, Packed] = {}
        for i in range(blocks.num_rows if chunks.num_rows else 0):
            reach = reaches({c: v[i] for c, v in own.items()}, other)
            wanted = ((other["label"] != own["label"][i]) & (reach >= own["window_lo"][i])) if negative else other["label"] == own["label"][i]
            which = np.flatnonzero(wanted)
            best = Best(one(blocks, i), k, negative)
            for c in which[np.argsort(-reach[which], kind="stable")].tolist():
                if reach[c] < best.least():
                    break
                if c not in packed:
                    packed[c] = one(chunks, c)
                best.take(packed[c])
            out.append(best.rows())
        return pa.Table.from_batches(out)

    return run


def _packing(size: int, members: int, merge: bool, windows: int):
    """Packs sorted rows (row, id, label, vector, angles, windows) of one label each; with merge equal vectors become one, of the first ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0

        def packed(held: list) -> pa.RecordBatch:
            nonlocal made
            made += 1
            angles, vectors = np.array([h[1] for h in held], dtype="<f8"), _dense([h[0] for h in held])
            v = vectors.astype(np.float64)
            norms = np.sqrt((v * v).sum(axis=1))
            win = np.full((len(held), windows, 3), (-1, 0, -1), dtype="<i8")
            for i, h in enumerate(held):
                for j, w in enumerate(h[4] or []):
                    win[i, j] = (w["place"], w["low"], w["high"])
            used = win[..., 0] >= 0
            ids, rows = np.array([x for h in held for x in h[2]], dtype="<i8"), np.array([x for h in held for x in h[3]], dtype="<i8")
            values = (
                task << 32 | made, label, angles.min(axis=0).tolist(), angles.max(axis=0).tolist(), float(norms.min()), float(norms.max()),
                int(win[..., 1][used].min()) if used.any() else 1, int(win[..., 2][used].max()) if used.any() else 0,
                rows.tobytes(), ids.tobytes(), np.array([len(h[2]) for h in held], dtype="<i8").tobytes(), vectors.tobytes(), angles.tobytes(), norms.astype("<f8").tobytes(), win.tobytes(),
            )
            kinds = [pa.int64()] * 2 + [pa.list_(pa.float64())] * 2 + [pa.float64()] * 2 + [pa.int64()] * 2 + [pa.binary()] * 7
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(values, kinds, strict=True)], names=[x.split()[0] for x in PACKED.split(", ")])

        held, label = [], None
        for batch in batches:
            for row, i, own, vector, angles, w in zip(*(batch.column(c).to_pylist() for c in range(6)), strict=True):
                if held and (own != label or (len(held) >= size and not (merge and held[-1][0] == vector))):
                    yield packed(held)
                    held = []
                label = own
                if merge and held and held[-1][0] == vector:
                    if len(held[-1][2]) < members:
                        held[-1][2].append(i)
                        held[-1][3].append(row)
                else:
                    held.append((vector, np.frombuffer(angles, dtype="<f8"), [i], [row], w))
        if held:
            yield packed(held)

    return run


def parts_of(chunks: int, least: int) -> int:
    """Parts into which so many chunks are dealt: `least`, or more, so that a part doesn't grow with the input."""
    return max(16, least, -(-chunks // HELD))


def hard_negatives(
    rows: DataFrame, anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: float = 256.0, parts: int | None = None, chunk: int = CHUNK, block: int = BLOCK
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows for which anchor holds.

    Components are multiplied by scale and rounded down; a score is the inner product of two such vectors. An anchor's
    positives are the first other rows of its label by descending score and ascending id, its negatives with a positive
    the first rows of other labels with low * positive_score <= 100 * score <= high * positive_score.

    Rows without id, label or vector, and those with a null or non-finite component take no part. Vectors that are
    shorter than others count as if zeros followed. Repeated rows and rows that share an id are rows of their own: a
    copy of an anchor's row can be its positive, and is an anchor too. Without anchors or partners there are no rows.
    Vectors so long that a hundred times a score might pass a long are an error. Other columns are ignored, whatever their names.
    parts: parts into which chunks are dealt, parts_of() them and the shuffle partitions unless given.
    """
    spark = rows.sparkSession
    vector = F.col(vector_col)
    own = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), vector.alias("vector"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    whole = F.forall("vector", lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    own = own.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull()).where(whole)
    own = own.withColumn("vector", F.transform("vector", lambda x: F.floor(x.cast("double") * F.lit(scale))))

    def integers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(2)
            values, at = column.flatten().to_numpy(), np.concatenate(([0], np.cumsum(column.value_lengths().to_numpy())))
            squares = np.concatenate(([0], np.cumsum(values.astype(np.float64) ** 2)))
            if batch.num_rows and (squares[at[1:]] - squares[at[:-1]]).max() >= 2.0**55:
                raise ValueError("a vector is so long that a hundred times a score might not fit a long")
            vectors = [np.trim_zeros(values[a:b], "b").astype("<i4").tobytes() for a, b in zip(at.tolist(), at[1:].tolist(), strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(vectors, pa.binary()), batch.column(3)], names=["id", "label", "vector", "anchor"])

    whole_rows = written(own.mapInArrow(integers, "id long, label long, vector binary, anchor boolean").withColumn("row", F.monotonically_increasing_id()), "vectors")
    sample = whole_rows.where(F.octet_length("vector") > 0).orderBy(F.xxhash64("id"), "id", "row").limit(SAMPLE).select("vector").collect()
    units = directions([np.frombuffer(r.vector, dtype="<i4") for r in sample])

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                some = batch.slice(at, 2048)
                norms, angles = _measured(_dense(some.column(2).to_pylist()), units)
                near = angles.argmin(axis=1) if angles.shape[1] else np.zeros(some.num_rows, dtype=np.int64)
                least = angles.min(axis=1, initial=np.pi)
                extra = [pa.array(near.astype(np.int64)), pa.array(np.round(least, 6)), pa.array([a.astype("<f8").tobytes() for a in angles], pa.binary())]
                yield pa.RecordBatch.from_arrays([some.column(k) for k in (4, 0, 1, 2, 3)] + extra, names=["row", "id", "label", "vector", "anchor", "near", "angle", "angles"])

    points = written(whole_rows.select("id", "label", "vector", "anchor", "row").mapInArrow(measured, "row long, id long, label long, vector binary, anchor boolean, near long, angle double, angles binary"), "angles")

    def pack(table: DataFrame, size: int, merge: bool, windows: int, tag: str) -> DataFrame:
        # by id at last: a vector that is everywhere is dealt into several ranges
        order = ["label", "near", "angle", "vector", "id", "row"]
        ranged = table.repartitionByRange(*order).sortWithinPartitions(*order).select("row", "id", "label", "vector", "angles", "windows")
        return written(ranged.mapInArrow(_packing(size, positives + negatives + 1, merge, windows), PACKED), tag)

    no_windows = F.lit(None).cast("array<struct<place: long, low: long, high: long>>")
    chunks = pack(points.withColumn("windows", no_windows), chunk, True, 0, "chunks")
    parts = parts or parts_of(chunks.count(), int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = lambda n: F.pmod(F.xxhash64("block"), F.lit(n)).cast("long")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<long>"))
    anchors = points.where("anchor")

    def joined(blocks: DataFrame, k: int, negative: bool) -> DataFrame:
        groups = max(1, -(-blocks.count() // GROUP))
        held = [*LIMITS, *PAYLOAD]
        left = blocks.select(dealt(groups).alias("group"), each(parts).alias("part"), *held).groupBy("group", "part")
        right = chunks.select(each(groups).alias("group"), dealt(parts).alias("part"), *held).groupBy("group", "part")
        return left.cogroup(right).applyInArrow(_meet(k, negative), "row long, place long, score long, id long")

    first = joined(pack(anchors.withColumn("windows", no_windows), block, False, 0, "anchors"), positives, False)
    found = written(_ranked(first, ["row"], positives).select("row", "rank", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # exact in whole numbers, whatever the size of the scores
    least = F.when(F.pmod(F.col("positive_score") * low, F.lit(100)) == 0, F.expr(f"positive_score * {low} div 100")).otherwise(F.expr(f"positive_score * {low} div 100") + 1)
    window = F.struct(F.col("rank").cast("long").alias("place"), least.alias("low"), F.expr(f"positive_score * {high} div 100").alias("high"))
    windows = found.where("positive_score >= 0").groupBy(F.col("row").alias("_row")).agg(F.sort_array(F.collect_list(window)).alias("windows"))
    wanting = anchors.join(windows, F.col("row") == F.col("_row")).drop("_row")
    second = joined(pack(wanting, block, False, positives, "windows"), negatives, True)
    best = _ranked(second, ["row", "place"], negatives).select(F.col("row").alias("_row"), F.col("place").alias("_place"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    ids = anchors.select(F.col("row").alias("_anchor"), F.col("id").alias("anchor_id"))
    named = found.join(ids, F.col("row") == F.col("_anchor")).select("row", F.col("rank").alias("place"), "anchor_id", "positive_id", "positive_score")
    out = named.join(best, (F.col("row") == F.col("_row")) & (F.col("place") == F.col("_place")))
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _ranked(table: DataFrame, by: list[str], k: int) -> DataFrame:
    """The first k of each anchor by descending score and ascending id."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "id"))
    return table.withColumn("rank", rank).where(F.col("rank") <= k)
