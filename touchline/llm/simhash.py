"""SimHash near-duplicates by a Gray-order hierarchical index.

Fingerprints are made once per text and collapsed to distinct values. Upper nodes of the index are masked bit
patterns: the 64 bits are cut into five runs, and for each of the ten pairs of runs the bits of the pair are the
pattern that a node's members share. Two fingerprints at no more than three differing bits agree on at least two
runs, so some upper node holds both. Spark deals the nodes out; inside one, the fingerprints are sorted by Gray
rank and the lower nodes, again masked patterns, are runs of that order. A pair of lower nodes is dropped as a
whole as soon as the differences accumulated from the patterns exceed the bound.

A node with more members than BLOCK is cut at quantiles of the Gray rank, and its blocks meet pairwise in tasks of
bounded size. A task returns a forest of the links it found rather than all pairs, which keeps every component.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import apart, bitmap, bits_for, filled, marked, mixed, shingle_spans, slices, span_hashes, texts, written
from .components import components

#: Fingerprints at this many differing bits or fewer are linked.
MAX_BITS = 3
#: Words of a shingle, and the seed of its hash.
SHINGLE, SEED = 3, 42
#: Members of an index node that one task compares at once.
BLOCK = 1024
#: Fingerprints or nodes below one lower node.
FANOUT = 16
#: Quantile ranges of a large node.
CUTS = 64
#: The bits of the five runs, from the lowest: three differing bits leave two runs untouched.
RUNS = [(0, 13), (13, 13), (26, 13), (39, 13), (52, 12)]
MASKS = [sum(((1 << n) - 1) << at for at, n in pair) for pair in combinations(RUNS, 2)]
#: Minima of a sketch, and the chance at which a pair just similar enough may be missed by each bound derived from it.
MINIMA, MISS = 96, 1e-5
FACTORS = mixed(np.arange(1, MINIMA + 1, dtype=np.uint64)) | np.uint64(1)
#: Shingle hashes that one exact comparison holds, and columns of it that are multiplied at once.
HELD, COLUMNS = 1 << 20, 4096


def fingerprint(text: bytes) -> int:
    """The 64-bit SimHash of a text: bits set in over half of the hashes of its shingles, repeats included; zero without words."""
    joined = b" ".join(text.lower().split())
    if not joined:
        return 0
    gaps = np.flatnonzero(np.frombuffer(joined, dtype=np.uint8) == 32)
    if len(gaps) + 1 < SHINGLE:
        return xxhash.xxh64_intdigest(joined, SEED)
    starts = [0, *(gaps[: len(gaps) - SHINGLE + 2] + 1).tolist()]
    ends = [*gaps[SHINGLE - 1 :].tolist(), len(joined)]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends, strict=True)), dtype=np.uint64, count=len(ends))
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """The word whose bits are set in over half of the 64-bit hashes."""
    votes = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 4096):
        part = hashes[at : at + 4096]
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, fp): a row per document, fp as a signed long, text_key a hash of its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(x) for x in texts(batch.column(2))], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps)], names=["doc_id", "text_key", "fp"])

    text = filled(F.col(text_col))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text")).mapInArrow(run, "doc_id long, text_key long, fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The rank of 64-bit words in Gray order, where neighbours differ in one bit."""
    x = x.astype(np.uint64)
    for shift in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(shift))
    return x


def gray_column(fp: Column) -> Column:
    for shift in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, shift))
    return fp


def _levels(fps: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(pattern, mask) of the nodes of each level over fingerprints in Gray order, leaves first; mask: the bits all members share."""
    levels = [(fps, np.full(len(fps), ~np.uint64(0)))]
    while len(levels[-1][0]) > 1:
        pattern, mask = levels[-1]
        at = np.arange(0, len(pattern), FANOUT)
        first = np.repeat(pattern[at], np.diff(np.append(at, len(pattern))))
        shared = np.bitwise_and.reduceat(mask & ~(pattern ^ first), at)
        levels.append((pattern[at] & shared, shared))
    return levels


def close_pairs(fps: np.ndarray, max_bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs i < j of distinct fingerprints, given in Gray order, at max_bits differing bits or fewer."""
    levels = _levels(fps)
    i = j = np.zeros(1, dtype=np.int64)
    for depth in range(len(levels) - 2, -1, -1):
        pattern, mask = levels[depth]
        kids = np.arange(FANOUT)
        a = (i[:, None, None] * FANOUT + kids[None, :, None]).repeat(FANOUT, axis=2).ravel()
        b = (j[:, None, None] * FANOUT + kids[None, None, :]).repeat(FANOUT, axis=1).ravel()
        ok = (a < len(pattern)) & (b < len(pattern)) & ((a <= b) if depth else (a < b))
        a, b = a[ok], b[ok]
        near = np.bitwise_count((pattern[a] ^ pattern[b]) & mask[a] & mask[b]) <= max_bits
        i, j = a[near], b[near]
    return (i, j) if len(levels) > 1 else (i[:0], j[:0])


def forest(n: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(member, root) links of the components of the pairs, without the roots themselves."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[label]
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    at = np.flatnonzero(label != np.arange(n))
    return at, label[at]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """The fingerprints of one group after another; a partition's rows come sorted by group."""
    key, held = None, []
    for batch in batches:
        keys = np.stack([np.asarray(batch.column(k)) for k in range(3)], axis=1)
        fps = np.asarray(batch.column(3)).view(np.uint64) if batch.num_rows else np.zeros(0, np.uint64)
        if not len(fps):
            continue
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        for part, at in zip(np.split(fps, cuts), [0, *cuts], strict=True):
            now = tuple(keys[at])
            if now != key and held:
                yield np.concatenate(held)
                held = []
            key = now
            held.append(part)
    if held:
        yield np.concatenate(held)


def _links_within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a, b = [], []

    def out():
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a).view(np.int64)), pa.array(np.concatenate(b).view(np.int64))], names=["a", "b"])

    for fps in _runs(batches):
        if len(fps) == 2:
            if int(fps[0] ^ fps[1]).bit_count() <= MAX_BITS:
                a.append(fps[:1])
                b.append(fps[1:])
        elif len(fps) > 2:
            fps = fps[np.argsort(gray_rank(fps))]
            at, root = forest(len(fps), *close_pairs(fps))
            a.append(fps[at])
            b.append(fps[root])
        if len(a) > 2000:
            yield out()
            a, b = [], []
    if a:
        yield out()


def fingerprint_links(fps: DataFrame, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between distinct fingerprints, enough to join every component at MAX_BITS.

    fps: a column fp of distinct longs.
    """
    masked = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(k).alias("mask"), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)).alias("pattern")) for k, m in enumerate(MASKS)])).alias("x")).select("fp", "x.mask", "x.pattern")
    gray = gray_column(F.col("fp"))
    # sizes of the upper nodes; only those of two members or more go on, and the large ones are cut at quantiles of the Gray rank
    node = F.xxhash64("mask", "pattern")
    sizes = masked.groupBy("mask", "pattern").agg(F.count("*").alias("n")).where("n > 1").select("mask", "pattern", "n")
    rows = masked.withColumn("node", node).join(sizes.select(node.alias("_node"), "n"), F.col("node") == F.col("_node")).drop("_node")
    small = rows.where(F.col("n") <= block).select(F.col("node"), F.lit(0).alias("i"), F.lit(0).alias("j"), "fp")
    # a large node's rank range is cut by percentiles, whose state is of bounded size; ranges still too large are dealt out by hash
    big = rows.where(F.col("n") > block).withColumn("gray", gray)
    cuts = big.groupBy("node").agg(F.percentile_approx("gray", [k / CUTS for k in range(1, CUTS)], 2000).alias("cuts")).select(apart(F.col("node")).alias("_node"), "cuts")
    ranges, deals = F.least(F.ceil(F.col("n") / block), F.lit(CUTS)), F.ceil(F.col("n") / (block * CUTS))
    placed = big.join(cuts, apart(F.col("node")) == F.col("_node")).withColumn("range", F.floor(F.size(F.filter("cuts", lambda c: c < F.col("gray"))) * ranges / CUTS))
    placed = placed.withColumns({"i": (F.col("range") * deals + F.pmod(F.xxhash64("fp"), deals)).cast("int"), "blocks": (ranges * deals).cast("int")})
    pairs = placed.select("node", "fp", "i", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o"))
    pairs = pairs.select("node", F.least("i", "o").alias("i"), F.greatest("i", "o").alias("j"), "fp")
    groups = small.unionByName(pairs)
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return groups.repartition(n, "node", "i", "j").sortWithinPartitions("node", "i", "j").select("node", "i", "j", "fp").mapInArrow(_links_within, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable) and text_key (a hash of the text) of every row.

    Fingerprints at three differing bits or fewer are linked. Null, empty and blank texts have fingerprint zero,
    linked like any other. Rows that repeat a text share a fingerprint and so a component. A null id takes no
    part in the minimum; a component of null ids alone has component_id null. An empty table gives no rows;
    other columns are ignored, whatever their names.
    """
    own = written(fingerprints(docs, id_col, text_col), "fingerprints")
    distinct = own.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(fingerprint_links(distinct.select("fp")))
    of = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    of = written(of, "fingerprint-roots")
    least = of.groupBy("root").agg(F.min("least").alias("component_id")).select(apart(F.col("root")).alias("_root"), "component_id")
    named = of.join(least, apart(F.col("root")) == F.col("_root")).select(F.col("fp").alias("_fp"), "component_id")
    return own.join(named, F.col("fp") == F.col("_fp")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "text_key")


def shingle_sets(docs: list[bytes], shingle: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text without words has none."""
    data, starts, ends, of = shingle_spans(docs, shingle)
    hashes = span_hashes(data, starts, ends)
    order = np.lexsort((hashes, of))
    hashes, of = hashes[order], of[order]
    new = np.ones(len(of), dtype=bool)
    new[1:] = (of[1:] != of[:-1]) | (hashes[1:] != hashes[:-1])
    return np.split(hashes[new], np.cumsum(np.bincount(of[new], minlength=len(docs)))[:-1])


def bounds(similarity: float) -> tuple[int, int, int]:
    """(minima to a band, differing SimHash bits, equal minima) that a pair of just this Jaccard similarity meets but for a chance of MISS each."""
    rows = max((r for r in (1, 2, 3, 4, 6, 8) if (1 - similarity**r) ** (MINIMA // r) <= MISS), default=1)
    turned = math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi  # equal sizes have the widest angle
    chance = lambda n, p, k: math.comb(n, k) * p**k * (1 - p) ** (n - k)
    bits = next(k for k in range(65) if sum(chance(64, turned, i) for i in range(k + 1, 65)) <= MISS)
    equal = next(k for k in range(MINIMA, -1, -1) if sum(chance(MINIMA, similarity, i) for i in range(k)) <= MISS)
    return rows, bits, equal


def minima(own: np.ndarray) -> np.ndarray:
    """MINIMA minima over the shingle hashes of a text."""
    least = np.full(MINIMA, ~np.uint64(0))
    for at in range(0, len(own), 1024):
        np.minimum(least, (own[at : at + 1024, None] * FACTORS).min(axis=0), out=least)
    return least


def sketches(docs: DataFrame, id_col: str, text_col: str, shingle: int, rows: int) -> DataFrame:
    """(doc_id, text_key, fp, bits, least, bands): fp a hash of the lower-cased words, bits the SimHash of the distinct shingles, least 16 bits of each minimum."""
    n = MINIMA // rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in slices(texts(batch.column(2))):
                fps = np.array([xxhash.xxh64_intdigest(b" ".join(x.lower().split()), SEED) for x in part], dtype=np.uint64).view(np.int64)
                bits, least, bands = [], [], []
                for own in shingle_sets(part, shingle):
                    low = minima(own)
                    band = np.arange(n, dtype=np.uint64)
                    for k in range(rows):
                        band = mixed(band + low[k : n * rows : rows])
                    bits.append(majority(own) if len(own) else 0)
                    least.append((mixed(low) & np.uint64(0xFFFF)).astype("<u2").tobytes())
                    bands.append(band.view(np.int64) if len(own) else [])
                columns = [pa.array(fps), pa.array(np.array(bits, dtype=np.uint64).view(np.int64)), pa.array(least, pa.binary()), pa.array(bands, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), batch.column(1).slice(at, len(part)), *columns], names=["doc_id", "text_key", "fp", "bits", "least", "bands"])

    text = filled(F.col(text_col))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text")).mapInArrow(run, "doc_id long, text_key long, fp long, bits long, least binary, bands array<long>")


def _sets(rows: DataFrame, shingle: int) -> DataFrame:
    """(root, fp, own) of (root, fp, text): the distinct shingle hashes of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in slices(texts(batch.column(2))):
                own = pa.array([x.view(np.int64) for x in shingle_sets(part, shingle)], type=pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), batch.column(1).slice(at, len(part)), own], names=["root", "fp", "own"])

    return rows.mapInArrow(run, "root long, fp long, own array<long>")


def _met(rows: DataFrame, node: str, blocks: Column, values: list[str]) -> DataFrame:
    """The rows of (node, fp, ...) dealt out so that any two of a node meet in one group (node, i, j), sorted by it; a node of several blocks has a group for each pair of them."""
    placed = rows.withColumn("_blocks", blocks.cast("int")).withColumn("i", F.pmod(F.xxhash64("fp"), F.col("_blocks")).cast("int"))
    pairs = placed.withColumn("o", F.explode(F.sequence(F.when(F.col("_blocks") == 2, 1).otherwise(0), F.col("_blocks") - 1)))
    # of two blocks one group holds all; of more, the group of a block with itself is the part that its other groups hold already
    pairs = pairs.where("_blocks <= 2 or i <> o").withColumns({"_i": F.when(F.col("_blocks") == 2, 0).otherwise(F.least("i", "o")), "_j": F.when(F.col("_blocks") == 2, 1).otherwise(F.greatest("i", "o"))})
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pairs.repartition(n, node, "_i", "_j").sortWithinPartitions(node, "_i", "_j").select(F.col(node).alias("node"), F.col("_i").alias("i"), F.col("_j").alias("j"), "fp", *values)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows (node, i, j, ...) of one group after another, as one batch each; a partition's rows come sorted by group."""
    key, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([np.asarray(batch.column(k)) for k in range(3)], axis=1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            now = tuple(keys[a])
            if now != key and held:
                yield pa.concat_batches(held) if len(held) > 1 else held[0]
                held = []
            key = now
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.concat_batches(held) if len(held) > 1 else held[0]


def _forests(pairs_of):
    """A function for mapInArrow: per group a forest (a, b) of the pairs that pairs_of(group) gives as two index arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, size = [], [], 0
        out = lambda: pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])
        for group in _groups(batches):
            if group.num_rows < 2:
                continue
            fps = np.asarray(group.column(3))
            at, root = forest(len(fps), *pairs_of(group))
            a.append(fps[at])
            b.append(fps[root])
            size += len(at)
            if size > 10_000 or len(a) > 2000:
                yield out()
                a, b, size = [], [], 0
        if a:
            yield out()

    return run


def _alike(max_bits: int, equal: int):
    """Pairs of a group (node, i, j, fp, bits, least): a Gray tree over the SimHashes drops those of more than max_bits bits, equal minima the rest."""

    def pairs_of(group: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        bits = np.asarray(group.column(4)).view(np.uint64)
        least = np.frombuffer(b"".join(group.column(5).to_pylist()), dtype="<u2").reshape(-1, MINIMA)
        order = np.argsort(gray_rank(bits), kind="stable")
        i, j = close_pairs(bits[order], max_bits)
        i, j = order[i], order[j]
        keep = np.zeros(len(i), dtype=bool)
        for at in range(0, len(i), 1 << 16):
            keep[at : at + (1 << 16)] = (least[i[at : at + (1 << 16)]] == least[j[at : at + (1 << 16)]]).sum(axis=1) >= equal
        return i[keep], j[keep]

    return pairs_of


def _jaccard(similarity: float):
    """Pairs of a group (node, i, j, fp, own) whose sets of shingle hashes have at least this Jaccard similarity, exactly."""

    def pairs_of(group: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        own = group.column(4)
        sizes = np.asarray(own.value_lengths()).astype(np.int64)
        values = np.asarray(own.flatten())
        n = len(sizes)
        if n == 2:
            shared = len(np.intersect1d(values[: sizes[0]], values[sizes[0] :], assume_unique=True))
            hit = shared >= similarity * (sizes.sum() - shared) - 1e-9
            return np.zeros(int(hit), dtype=np.int64), np.ones(int(hit), dtype=np.int64)
        _, column, times = np.unique(values, return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(n), sizes)
        keep = times[column] > 1  # hashes of one member alone are shared with none
        row, column = row[keep], column[keep]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        column = np.cumsum(np.concatenate(([0], column[1:] != column[:-1]))) if len(column) else column
        shared = np.zeros((n, n), dtype=np.float32)
        for at in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
            a, b = np.searchsorted(column, [at, at + COLUMNS])
            part = np.zeros((n, COLUMNS), dtype=np.float32)
            part[row[a:b], column[a:b] - at] = 1
            shared += part @ part.T
        i, j = np.nonzero(np.triu(shared >= similarity * (sizes[:, None] + sizes[None, :] - shared) - 1e-4, 1))
        return i, j

    return pairs_of


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, block: int = BLOCK) -> DataFrame:
    """doc_id, component_id and text_key like near_duplicates(), with links between texts of a Jaccard similarity of their shingles.

    A SimHash of 64 bits can tell such texts only by a bound of some twenty bits, at which no pair of masked runs is
    sure to agree. So the upper nodes of this index are bands of minima over the shingles; within a node the
    SimHashes are searched by the same Gray-ordered tree, and the minima are compared. What is left joins texts into
    groups, and within a group every pair is judged on the whole shingle sets. Nodes and groups of more than a block
    are met block by block, and tasks return forests, so neither all pairs of a node nor a whole node go anywhere.
    The bounds come from the similarity, see bounds(). Texts of equal words are one; those without words likewise.
    """
    rows, max_bits, equal = bounds(similarity)
    own = written(sketches(docs, id_col, text_col, shingle, rows), "sketches")
    distinct = own.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.min("text_key").alias("text_key"), *[F.first(c).alias(c) for c in ("bits", "least", "bands")])
    distinct = written(distinct, "sketches-distinct")
    bands = distinct.select("fp", F.explode("bands").alias("band"))
    sizes = bands.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select(apart(F.col("band")).alias("_band"), "n")
    members = bands.join(sizes, apart(F.col("band")) == F.col("_band")).select("band", "n", F.col("fp").alias("_fp"))
    members = members.join(distinct.select("fp", "bits", "least"), F.col("fp") == F.col("_fp"))
    links = _met(members, "band", F.ceil(F.col("n") / block), ["bits", "least"]).mapInArrow(_forests(_alike(max_bits, equal)), "a long, b long")
    groups = components(links)
    wanted = written(distinct.select("fp", F.col("text_key").alias("_key")).join(groups, F.col("fp") == F.col("node")).select("root", "fp", "_key"), "groups")
    text = docs.select(F.xxhash64(filled(F.col(text_col))).alias("key"), filled(F.col(text_col)).alias("text"))
    size = bits_for(wanted.count())
    text = marked(text, F.col("key"), bitmap(wanted, "_key", size), "_maybe", size).where("_maybe").groupBy("key").agg(F.min("text").alias("text"))
    sets = written(_sets(text.join(wanted, F.col("key") == F.col("_key")).select("root", "fp", "text"), shingle), "shingle-sets")
    total = sets.groupBy("root").agg(F.count("*").alias("n"), F.sum(F.size("own")).alias("held")).select(apart(F.col("root")).alias("_root"), "n", "held")
    sized = sets.join(total, apart(F.col("root")) == F.col("_root")).select("root", "fp", "own", "n", "held")
    exact = _met(sized, "root", F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("held") / HELD)), ["own"]).mapInArrow(_forests(_jaccard(similarity)), "a long, b long")
    roots = components(exact)
    of = written(distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", F.col("least_id").alias("least"), F.coalesce("root", "fp").alias("root")), "sketch-roots")
    least = of.groupBy("root").agg(F.min("least").alias("component_id")).select(apart(F.col("root")).alias("_root"), "component_id")
    named = of.join(least, apart(F.col("root")) == F.col("_root")).select(F.col("fp").alias("_fp"), "component_id")
    return own.select("doc_id", "text_key", "fp").join(named, F.col("fp") == F.col("_fp")).select("doc_id", "component_id", "text_key")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float | None = None) -> DataFrame:
    """docs with one document of each near-duplicate component, that of the smallest doc_id; all columns stay as they are.

    With a similarity, components are those of similar_documents() at it; without one, those of near_duplicates().

    Of rows that share id and text one stays. Rows of one id with different texts are judged each by its text. Rows
    without an id stay only where their component has no id at all, one of each text. An empty table gives no rows.
    """
    found = near_duplicates(docs, id_col, text_col) if similarity is None else similar_documents(docs, id_col, text_col, shingle, similarity)
    stay = found.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    stay = written(stay.groupBy(F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key")).agg(F.count("*").alias("n")), "staying")
    rows = docs.select(F.struct("*").alias("_row"), F.col(id_col).cast("long").alias("_id"), F.xxhash64(filled(F.col(text_col))).alias("_text"))
    of = lambda side: rows.join(side.drop("n"), F.col("_id").eqNullSafe(F.col("_doc")) & (F.col("_text") == F.col("_key")), "left_semi")
    out, again = of(stay.where("n = 1")).select("_row"), stay.where("n > 1")
    if not again.isEmpty():
        out = out.union(of(again).groupBy("_id", "_text").agg(F.first("_row").alias("_row")).select("_row"))
    return out.select("_row.*")
