"""Removal of byte strings of LENGTH or more that occur again, by refining blocks of equal suffix beginnings.

Merging the Burrows-Wheeler transforms of shards by refining their interleave means: blocks of suffixes that agree on
their first bytes are split, round after round, until each holds one suffix or agrees on all LENGTH bytes; which round
splits a block is the length of its common prefix. One byte a round would be LENGTH passes over all suffixes, so here
the rounds go by content instead, and blocks are told apart by hashes, not by their place in an order:

1. phrases: minimisers cut every text at places that follow its content; phrases are counted over all shards, and
   suffixes that begin in a phrase met once are resolved at once (a bitmap of fixed size keeps the others);
2. cores: each run of starts whose strings have the same first and last minimiser is one cell; cells agree when
   what lies between the two is equal;
3. hulls: cells of a block whose whole extent, all strings that start in them, is equal elsewhere are repeated intervals;
4. pieces: where a block holds a cell that is no such interval, its cells are cut at fixed distances from the core, and
   pieces judged like cells, ever shorter ones to single strings; what all strings of a piece share tells who goes on.

Of the cells or pieces that are repeated already, one of each content goes on, so that others can be found equal to it.

Hulls and pieces are held equal only where a keyed 128-bit digest of their very bytes agrees, with a key drawn for each
run; the cheaper polynomial hashes, for which collisions can be made, only choose what is looked at further.

Every round counts with map-side aggregation and sends on only what is unresolved; no text is sorted, and no suffix
leaves its shard but as a hash. Equal strings always fall into cells with equal cores, so nothing is missed. A count of
contents holds one cell of each; those met once are thereby known by row and place, and all other cells are repeated.

Texts are short: those of GROUP bytes in all are hashed side by side, so that their bytes and not their number make the work.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterable, Iterator
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASE, INVERSE, _powers, apart, collect_bitmap, deleted, filled, hits, mixed, texts, written, written_at

#: Bytes of a string that counts; of a minimiser; and places that compete for one. Two windows of places fit into a string.
LENGTH, GRAM = 200, 16
PLACES = (LENGTH - GRAM + 1) // 2
#: Bytes of short texts, and starts of a long one, that are looked at together.
GROUP, STARTS = 1 << 17, 1 << 20
#: Starts of a piece, round by round.
PIECES = (16, 1)
CELL = ["first", "n", "lead", "core", "hull", "check"]


@cache
def _table(base: int, n: int) -> np.ndarray:
    return _powers(base, n)


class Block:
    """Parts of texts side by side, each of LENGTH bytes or more: hashes of their substrings, their minimisers and cells."""

    def __init__(self, parts: list[bytes]):
        self.data = b"".join(parts)
        n = len(self.data)
        self.ends = np.cumsum([len(x) for x in parts])
        self.begins = np.concatenate((np.zeros(1, dtype=np.int64), self.ends[:-1]))
        most = GROUP if n <= GROUP else STARTS + LENGTH
        each = np.frombuffer(self.data, dtype=np.uint8).astype(np.uint64)
        each += np.uint64(1)
        each *= _table(BASE, most)[:n]
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(each, out=self.sums[1:])
        self.back = _table(INVERSE, most)

    def hashes(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mixed((self.sums[b] - self.sums[a]) * self.back[a] + (b - a).astype(np.uint64))

    def digests(self, a: np.ndarray, b: np.ndarray, key: bytes) -> tuple[np.ndarray, np.ndarray]:
        """A keyed digest of each string's bytes as two longs."""
        data, fresh, found = self.data, hashlib.blake2b(digest_size=16, key=key).copy, []
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            made = fresh()
            made.update(data[x:y])
            found.append(made.digest())
        both = np.frombuffer(b"".join(found), dtype="<i8").reshape(-1, 2)
        return both[:, 0], both[:, 1]

    def part(self, at: np.ndarray) -> np.ndarray:
        """The part in which each place lies."""
        return np.searchsorted(self.ends, at, side="right")

    @cached_property
    def places(self) -> np.ndarray:
        """The place of least hash, the leftmost of equals, of every run of PLACES places; it means nothing where a run leaves its part."""
        low = self.sums[GRAM:] - self.sums[:-GRAM]
        low *= self.back[: len(low)]
        low ^= low >> np.uint64(32)
        low *= np.uint64(0xD6E8FEB86659FD93)
        low &= np.uint64(0xFFFFFFFF00000000)
        low |= np.arange(len(low), dtype=np.uint64)
        # by doubling
        reach = 1
        while 2 * reach <= PLACES:
            low = np.minimum(low[:-reach], low[reach:])
            reach *= 2
        low = np.minimum(low[: len(low) - (PLACES - reach)], low[PLACES - reach :])
        low &= np.uint64(0xFFFFFFFF)
        return low.view(np.int64)

    @cached_property
    def minimisers(self) -> np.ndarray:
        """The minimisers of all parts, in ascending order."""
        new = np.ones(len(self.places), dtype=bool)
        np.not_equal(self.places[1:], self.places[:-1], out=new[1:])
        new[self.begins] = True
        for end in self.ends[:-1].tolist():
            new[end - (PLACES + GRAM - 2) : end] = False
        return self.places[np.flatnonzero(new)]

    def phrases(self) -> np.ndarray:
        """Hashes of the phrases, from each minimiser to the end of the next of its part."""
        at = self.minimisers
        own = self.part(at)
        k = np.flatnonzero(own[1:] == own[:-1])
        return self.hashes(at[k], at[k + 1] + GRAM)

    def cells(self, bits: np.ndarray, key: bytes) -> tuple[np.ndarray, ...]:
        """(part, first start in it, starts, bytes from there to the core, core, hull, its check) of the cells all of whose phrases are marked."""
        starts = len(self.data) - LENGTH + 1
        first, last = self.places[:starts], self.places[LENGTH - GRAM + 1 - PLACES :][:starts]
        new = np.ones(starts, dtype=bool)
        np.not_equal(first[1:], first[:-1], out=new[1:])
        new[1:] |= last[1:] != last[:-1]
        new[self.begins] = True
        new[self.ends[:-1] - LENGTH + 1] = True
        at = np.flatnonzero(new)
        n = np.diff(np.append(at, starts))
        minimisers, part = self.minimisers, self.part(at)
        marked = np.concatenate((np.zeros(1, dtype=np.int64), np.cumsum(hits(bits, self.hashes(minimisers[:-1], minimisers[1:] + GRAM)))))
        keep = np.flatnonzero(at <= self.ends[part] - LENGTH)
        a, b = np.searchsorted(minimisers, first[at[keep]]), np.searchsorted(minimisers, last[at[keep]])
        keep = keep[marked[b] - marked[a] == b - a]
        at, n, part = at[keep], n[keep], part[keep]
        return part, at - self.begins[part], n, first[at] - at, self.hashes(first[at], last[at] + GRAM).view(np.int64), *self.digests(at, at + n - 1 + LENGTH, key)

    def pieces(self, at: np.ndarray, n: np.ndarray, lead: np.ndarray, size: int, key: bytes) -> tuple[np.ndarray, ...]:
        """Runs of starts, cut where their distance from the core is a multiple of size: (run, first start, starts, bytes from there to the core, core, hull, its check); core: what strings at these distances share."""
        core, low, high = at + lead, (lead - n + 1) // size, lead // size
        many = high - low + 1
        of = np.repeat(np.arange(len(at)), many)
        k = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many) + low[of]
        near, far = np.maximum((lead - n + 1)[of], k * size), np.minimum(lead[of], k * size + size - 1)
        start, shared = core[of] - far, core[of] - k * size
        return of, start, far - near + 1, far, self.hashes(shared, shared - size + 1 + LENGTH).view(np.int64), *self.digests(start, core[of] - near + LENGTH, key)


def blocks(found: Iterable[bytes]) -> Iterator[tuple[np.ndarray, Block]]:
    """Blocks of all texts of LENGTH bytes or more, and of each of their parts the text's number and the part's offset in it.

    A block holds short texts of GROUP bytes or less in all, or up to STARTS starts of one longer text.
    """
    held: list[bytes] = []
    of: list[tuple[int, int]] = []
    size = 0
    for k, text in enumerate(found):
        for at in range(0, len(text) - LENGTH + 1, STARTS):
            part = text[at : at + STARTS + LENGTH - 1]
            if held and size + len(part) > GROUP:
                yield np.array(of), Block(held)
                held, of, size = [], [], 0
            held.append(part)
            of.append((k, at))
            size += len(part)
    if held:
        yield np.array(of), Block(held)


def _contents(cells: DataFrame) -> tuple[DataFrame, str]:
    """Each content of cells: how many have it, and the row and first start of one of them. Starts, lead and core follow from the content. Written to the shared folder; and its path there."""
    one = [F.min("row").alias("row"), F.min_by("first", "row").alias("first"), *(F.min(c).alias(c) for c in ("n", "lead", "core"))]
    return written_at(cells.groupBy("hull", "check").agg(F.count("*").alias("same"), *one), "contents")


def _repeated(cells: DataFrame, contents: DataFrame) -> DataFrame:
    """(row, first, n) of the cells whose content another cell has too. Written to the shared folder.

    Counts by a hash are joined on a value made of it: both sides are dealt out for the join, and Spark can split a hash that is everywhere.
    """
    closed = contents.where("same > 1").select(apart(F.col("hull")).alias("_hull"), apart(F.col("check")).alias("_check"))
    return written(cells.join(closed, (apart(F.col("hull")) == F.col("_hull")) & (apart(F.col("check")) == F.col("_check")), "left_semi").select("row", "first", "n"), "repeated")


def _undecided(contents: DataFrame) -> DataFrame:
    """One cell of each content whose core another content has too, if one of these contents stands nowhere else."""
    cores = contents.groupBy("core").agg(F.count("*").alias("many"), F.min("same").alias("least")).where("many > 1 and least = 1").select(apart(F.col("core")).alias("_core"))
    return contents.join(cores, apart(F.col("core")) == F.col("_core"), "left_semi")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kept_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with kept_text the kept bytes) of every row.

    Each byte goes that a string of LENGTH bytes covers which also starts elsewhere, in the same or another row;
    strings are judged on the input. Rows are told apart by their place in a written table, so repeated rows and
    null ids are texts of their own, and a repeated row makes all its strings repeated. Null text counts as empty;
    texts shorter than LENGTH stay whole. An empty table gives no rows; other columns are ignored, whatever their names.
    """
    import zstandard

    spark = docs.sparkSession
    key = os.urandom(16)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), filled(F.col(text_col)).alias("text"))

    def phrase_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted(held: list[np.ndarray]) -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["hash", "n"])

        for batch in batches:
            held, size = [], 0
            for _, b in blocks(texts(batch.column(0))):
                held.append(b.phrases())
                size += len(held[-1])
                if size > 500_000:
                    yield counted(held)
                    held, size = [], 0
            if held:
                yield counted(held)

    again = rows.select("text").mapInArrow(phrase_counts, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n")).where("n > 1")
    bits = spark.sparkContext.broadcast(collect_bitmap(again, "hash"))

    def with_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                data = texts(part.column(1))
                found = []
                for of, b in blocks(data):
                    own, first, *rest = b.cells(bits.value, key)
                    found.append((of[own, 0], first + of[own, 1], *rest))
                own, *columns = (np.concatenate(x) for x in zip(*found, strict=True)) if found else [np.zeros(0, dtype=np.int64)] * 7
                many = np.bincount(own, minlength=len(data))
                ends = pa.array(np.concatenate(([0], np.cumsum(many))).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(v.astype(np.int32 if k < 3 else np.int64))) for k, v in enumerate(columns)]
                out = [(len(t), None, z.compress(t)) if n else (len(t), hashlib.sha256(t).hexdigest(), t if kept_text else None) for t, n in zip(data, many.tolist(), strict=True)]
                cols = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.binary()), strict=True)), *lists], names=["doc_id", "n_bytes", "sha256", "text", *CELL])

    work = written(rows.mapInArrow(with_cells, "doc_id long, n_bytes long, sha256 string, text binary, first array<int>, n array<int>, lead array<int>, core array<long>, hull array<long>, check array<long>").withColumn("row", F.monotonically_increasing_id()), "cells")
    cells = work.where("sha256 is null").select("row", F.explode(F.arrays_zip(*CELL)).alias("c")).select("row", "c.*")

    def pieces(size: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            z = zstandard.ZstdDecompressor()
            for batch in batches:
                probe = batch.column(2)
                rows, ends = batch.column(0).to_numpy(), np.append(0, np.cumsum(probe.value_lengths().to_numpy()))
                first, n, lead = (probe.flatten().field(k).to_numpy().astype(np.int64) for k in range(3))
                for of, b in blocks(z.decompress(text.as_py()) for text in batch.column(1)):
                    own = [x[(first[x] >= at) & (first[x] < at + STARTS)] for k, at in of.tolist() for x in [np.arange(ends[k], ends[k + 1])]]
                    many, own = [len(x) for x in own], np.concatenate(own)
                    shift = np.repeat(b.begins - of[:, 1], many)
                    cell, start, *rest = b.pieces(first[own] + shift, n[own], lead[own], size, key)
                    columns = [v.astype(np.int32 if k < 3 else np.int64) for k, v in enumerate((start - shift[cell], *rest))]
                    yield pa.RecordBatch.from_arrays([pa.array(v) for v in (rows[np.repeat(of[:, 0], many)][cell], *columns)], names=["row", *CELL])

        return run

    contents, path = _contents(cells)
    # cells are repeated but for these few, which need no join to be told from the others; of pieces those that are repeated are few
    found = written(contents.where("same = 1").select("row", "first", F.lit(0).alias("n")), "single")
    for size in PIECES:
        probed = _undecided(contents).groupBy("row").agg(F.collect_list(F.struct("first", "n", "lead")).alias("probe")).select(F.col("row").alias("_row"), "probe")
        cut = work.join(probed, F.col("row") == F.col("_row")).select("row", "text", "probe").mapInArrow(pieces(size), "row long, first int, n int, lead int, core long, hull long, check long")
        cut, here = written_at(cut if size > 1 else cut.drop("lead", "core"), "pieces")
        deleted(spark, path)
        if size > 1:
            contents, path = _contents(cut)
        else:
            contents = cut.groupBy("hull", "check").agg(F.count("*").alias("same"))
        found = found.unionByName(_repeated(cut, contents))
        deleted(spark, here)
    found = found.groupBy("row").agg(F.collect_list(F.struct("first", "n")).alias("gone")).select(F.col("row").alias("_row"), F.col("gone.first").alias("_first"), F.col("gone.n").alias("_n"))

    def keyed(first: pa.ListArray, n: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """All first starts, each with its row's number in the batch above it, and their n."""
        row = np.repeat(np.arange(len(first)), first.value_lengths().fill_null(0).to_numpy())
        return (row << 32) + first.flatten().to_numpy(), n.flatten().to_numpy()

    def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        for batch in batches:
            ids, sizes, shas, held = (batch.column(k).to_pylist() for k in range(4))
            (first, n), (more, more_n) = (keyed(*batch.columns[k : k + 2]) for k in (4, 6))
            closed = np.ones(len(first), dtype=bool)
            closed[np.searchsorted(first, more[more_n == 0])] = False
            first, n = np.concatenate((first[closed], more[more_n > 0])), np.concatenate((n[closed], more_n[more_n > 0]))
            order = np.argsort(first, kind="stable")
            first = first[order]
            last = np.maximum.accumulate(first - 1 + LENGTH + n[order])
            apart_from = first[1:] > last[:-1]
            begin, end = first[np.append(first[:1] >= 0, apart_from)], last[np.append(apart_from, first[:1] >= 0)]
            at = np.searchsorted(begin, np.arange(len(ids) + 1) << 32).tolist()
            begin, end = (begin & 0xFFFFFFFF).tolist(), (end & 0xFFFFFFFF).tolist()
            out = []
            for k, (doc, size, sha, text) in enumerate(zip(ids, sizes, shas, held, strict=True)):
                if sha is not None:
                    out.append((doc, size, 0, 0, sha, text))
                    continue
                data, own = z.decompress(text), slice(at[k], at[k + 1])
                left = b"".join(data[x:y] for x, y in zip([0, *end[own]], [*begin[own], size], strict=True))
                out.append((doc, size, size - len(left), len(begin[own]), hashlib.sha256(left).hexdigest(), left))
            cols = list(zip(*out, strict=True)) if out else [[]] * 6
            kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in list(zip(cols, kinds, strict=True))[: 5 + kept_text]], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 5 + kept_text])

    whole = work.join(found, F.col("row") == F.col("_row"), "left").select("doc_id", "n_bytes", "sha256", "text", "first", "n", "_first", "_n")
    return whole.mapInArrow(removed, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if kept_text else ""))
