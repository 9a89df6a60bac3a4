"""Cross-tokenizer alignment with corpus-wide counts of linked token pairs.

Two tokenizers cut the same bytes in different places; a token of the first is linked with each token of the second
whose bytes overlap its own, and places where both end cut a document into groups. How many documents hold a pair of
ids linked says how well the two tokens stand for each other. The pairs of a corpus are too many for a table of hash
rows in every task, so they are counted by a minimal perfect hash:

1. every text is encoded by both tokenizers once; the ids are written to the shared folder. Where no token of either
   reaches over a blank between words, the distinct words of some megabytes of text are encoded and put together;
2. the distinct pairs are gathered, dealt into buckets of some PER_BUCKET keys, and each bucket gets a minimal perfect
   hash by displacement: keys of a slot group share one number that sends them to free slots, lone keys are placed directly;
3. a first pass over the documents adds up, in each task, dense vectors of counts by slot; vectors of a bucket are
   summed in a tree, FAN at a time, whatever the number of tasks;
4. a second pass aligns every document again and looks its pairs up. A slot's key is held beside its count and
   compared each time, so a false hit is impossible.

Tables of hashes and counts are read from the shared folder by parts of at most some PARTS * PER_BUCKET pairs; a task
holds one part at a time and takes its links by parts, so its memory does not grow with the number of pairs.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as pads
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import LONG_WORD, codec
from .common import byte_rows, distinct_parts, filled, listed, portions, texts, work_dir, written

#: Keys of a bucket of the hash, on average; of a slot group; buckets of a part, which a task holds whole.
PER_BUCKET, PER_GROUP, PARTS = 4096, 2, 512
#: Count vectors that are added up at a time.
FAN = 64
#: Links of documents that a task gathers before it takes them through the parts of the table.
LINKS = 1 << 20
#: Bytes of texts whose words are encoded together, and words of a call.
PORTION, WORDS = 1 << 24, 4096
#: Bits of an id of the second tokenizer within a pair's key.
SHIFT = 32


#: Texts that are not cut into words: with white space other than blanks and line ends, several of these in a row, some before the text, a blank after it, or the mark of a blank.
UNCUT = r"[\x{9}\x{b}-\x{d}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{2581}]|[ \n][ \n]|\A[ \n]| \z"


class Pair:
    """Both tokenizers, with the bytes of their tokens."""

    def __init__(self, a: str, b: str):
        import sentencepiece

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a, self.b = codec(a), sentencepiece.SentencePieceProcessor(model_file=b)
        self.a_bytes = self.a.bytes
        self.b_bytes = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.a_lengths, self.b_lengths = (np.array([len(x) for x in t], dtype=np.int64) for t in (self.a_bytes, self.b_bytes))

        self.apart = self.a.fast is not None and self._apart()

    def _apart(self) -> bool:
        """Whether the second tokenizer takes texts as they are, and none of its pieces holds a line end, or a blank after something else."""
        from sentencepiece import sentencepiece_model_pb2

        m = sentencepiece_model_pb2.ModelProto.FromString(self.b.serialized_model_proto())
        n, mark = m.normalizer_spec, "▁"
        plain = not n.precompiled_charsmap and n.add_dummy_prefix and n.escape_whitespaces and not n.remove_extra_whitespaces and not m.trainer_spec.treat_whitespace_as_suffix
        normal = [p.piece for p in m.pieces if p.type == p.NORMAL]
        kinds = {p.type for p in m.pieces} <= {m.SentencePiece.NORMAL, m.SentencePiece.BYTE, m.SentencePiece.CONTROL, m.SentencePiece.UNKNOWN}
        return bool(plain and m.trainer_spec.model_type == m.trainer_spec.BPE and m.trainer_spec.byte_fallback and kinds) and not any("\n" in p or mark in p.lstrip(mark) or mark in p[1:] and p.strip(mark) for p in normal)

    def _piece(self, i: int) -> bytes:
        if self.b.is_byte(i):
            return bytes([int(self.b.id_to_piece(i)[3:-1], 16)])
        return self.b.id_to_piece(i).replace("▁", " ").encode()

    def encode_a(self, part: bytes) -> list[int]:
        """A special token's string is plain text."""
        c, text = self.a, part.decode()
        if c.fast is None or LONG_WORD.search(part):
            c.tokenizer.encode_special_tokens = True
            try:
                return c.tokenizer.encode(text, add_special_tokens=False).ids
            finally:
                c.tokenizer.encode_special_tokens = False
        return c.fast.encode_ordinary(text)

    def encode(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The ids of both; none where the text is empty or the bytes of the tokens are not those of a space and the text."""
        if text:
            spaced = b" " + text
            a, b = self.encode_a(spaced), self.b.encode(text.decode(), num_threads=1)
            if b"".join(map(self.a_bytes.__getitem__, a)) == spaced == b"".join(map(self.b_bytes.__getitem__, b)):
                return np.array(a, dtype="<u4"), np.array(b, dtype="<u4")
        return np.zeros(0, dtype="<u4"), np.zeros(0, dtype="<u4")


    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
        """(ids of the first, how many of each word, ids of the second, how many); None where bytes differ. A word is what follows a blank, or a line end with what follows it."""
        out: list[list[np.ndarray]] = [[], [], [], []]
        for at in range(0, len(words), WORDS):
            # a word of its own leads, so that the blank which the second tokenizer puts first is not a line end's
            some = [" a", *(w if w[:1] == "\n" else " " + w for w in words[at : at + WORDS])]
            text = "".join(some)
            data = text.encode()
            ends = np.cumsum([len(w.encode()) for w in some])
            for k, ids, of, lengths in ((0, self.encode_a(data), self.a_bytes, self.a_lengths), (2, self.b.encode(text[1:], num_threads=1), self.b_bytes, self.b_lengths)):
                if b"".join(map(of.__getitem__, ids)) != data:
                    return None
                ids = np.array(ids, dtype="<u4")
                until = np.cumsum(lengths[ids])
                last = np.searchsorted(until, ends)
                if not np.array_equal(until[last], ends):
                    return None
                out[k].append(ids[last[0] + 1 :])
                out[k + 1].append(np.diff(last))
        a, n_a, b, n_b = (np.concatenate([np.zeros(0, dtype=t), *v]) for t, v in zip(("<u4", np.int64) * 2, out, strict=True))
        return a, n_a, b, n_b

    def encode_all(self, column: pa.Array) -> tuple[np.ndarray, list[pa.Array]]:
        """(places of the texts that could be cut into words, the ids of both for these as bytes); other texts need encode()."""
        if not self.apart:
            return np.zeros(0, dtype=np.int64), []
        whole = pc.or_(pc.match_substring_regex(column, UNCUT), pc.equal(pc.binary_length(column), 0)).to_numpy(zero_copy_only=False).astype(bool)
        at = np.flatnonzero(~whole)
        words, codes, n = distinct_parts(pc.split_pattern(pc.replace_substring(column.take(pa.array(at)), "\n", " \n"), " "))
        known = listed(words)
        if not len(at) or (found := self._words([w for w in known if w != "\n"])) is None:
            return np.zeros(0, dtype=np.int64), []
        out = []
        row = np.repeat(np.arange(len(n)), n)
        alone = known.index("\n") if "\n" in known else -1  # a line end at the end of a text
        for ids, many, plain in ((found[0], found[1], self.encode_a(b"\n")), (found[2], found[3], self.b.encode("\n", num_threads=1)[1:])):
            if alone >= 0:
                ids, many = np.insert(ids, int(many[:alone].sum()), np.array(plain, dtype="<u4")), np.insert(many, alone, len(plain))
            begin, own = np.cumsum(many) - many, many[codes]
            out.append(byte_rows(ids[np.arange(own.sum()) + np.repeat(begin[codes] - np.cumsum(own) + own, own)], np.bincount(row, weights=own, minlength=len(n)).astype(np.int64)))
        return at, out


@cache
def pair(a: str, b: str) -> Pair:
    return Pair(a, b)


class Aligned:
    """Some documents' tokens: links (first and second id, document), groups, and the order in which a group listing names the tokens."""

    def __init__(self, p: Pair, a: list[np.ndarray], b: list[np.ndarray]):
        self.n_a, self.n_b = (np.array([len(x) for x in t], dtype=np.int64) for t in (a, b))
        self.a, self.b = (np.concatenate([np.zeros(0, dtype="<u4"), *t]).astype(np.int64) for t in (a, b))
        # offsets run on from document to document: each has as many bytes in both, and ends where both end
        self.a_end, self.b_end = np.cumsum(p.a_lengths[self.a]), np.cumsum(p.b_lengths[self.b])
        self.a_doc = np.repeat(np.arange(len(a)), self.n_a)
        low = np.searchsorted(self.b_end, self.a_end - p.a_lengths[self.a], "right")
        high = np.searchsorted(self.b_end - p.b_lengths[self.b], self.a_end, "left")
        many = high - low
        left = np.repeat(np.arange(len(self.a)), many)
        right = np.arange(len(left)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)
        self.link_a, self.link_b, self.doc = self.a[left], self.b[right], self.a_doc[left]
        self.keys = self.link_a << SHIFT | self.link_b
        self.n_links = np.bincount(self.doc, minlength=len(a))
        self.cuts = np.intersect1d(self.a_end, self.b_end, assume_unique=True)
        ends = np.cumsum(np.bincount(self.a_doc, weights=p.a_lengths[self.a], minlength=len(a)).astype(np.int64)) if len(a) else self.cuts
        self.n_groups = np.diff(np.searchsorted(self.cuts, ends, "right"), prepend=0)

    def per_document(self) -> np.ndarray:
        """Keys, each once for every document that has it."""
        n_a, n_b = (int(x.max(initial=0)) + 1 for x in (self.link_a, self.link_b))
        if len(self.n_a) * n_a * n_b < 1 << 62:  # document and pair in one number
            both = np.unique((self.doc * n_a + self.link_a) * n_b + self.link_b)
            return both // n_b % n_a << SHIFT | both % n_b
        order = np.lexsort((self.keys, self.doc))
        keys, doc = self.keys[order], self.doc[order]
        first = np.ones(len(keys), dtype=bool)
        first[1:] = (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])
        return keys[first]

    def listings(self, names: list[str], offset: int) -> list[str]:
        """`a1,a2|b1;a3|b2,b3` of each document, '' without tokens. names: by id and what follows it; see names_of()."""
        group_a, group_b = np.searchsorted(self.cuts, self.a_end), np.searchsorted(self.cuts, self.b_end)
        n = len(self.cuts)
        a_in, b_in = np.bincount(group_a, minlength=n), np.bincount(group_b, minlength=n)
        b_before, a_until = np.cumsum(b_in) - b_in, np.cumsum(a_in)
        out = np.zeros(len(self.a) + len(self.b), dtype=np.int64)
        last_a, last_b = np.append(group_a[1:] != group_a[:-1], True)[: len(self.a)], np.append(group_b[1:] != group_b[:-1], True)[: len(self.b)]
        out[np.arange(len(self.a)) + b_before[group_a]] = self.a + last_a * offset
        out[np.arange(len(self.b)) + a_until[group_b]] = self.b + (2 + last_b) * offset
        at, texts = 0, []
        for k in (self.n_a + self.n_b).tolist():
            texts.append("".join(map(names.__getitem__, out[at : at + k].tolist()))[:-1])
            at += k
        return texts


def names_of(p: Pair) -> tuple[list[str], int]:
    """(names, offset): decimal ids followed by , | , ; each offset after the one before."""
    n = max(len(p.a_bytes), len(p.b_bytes))
    return [f"{i}{mark}" for mark in ",|,;" for i in range(n)], n


# Minimal perfect hash


def _mix(x: np.ndarray, seed) -> np.ndarray:
    """Spreads keys over 64 bits, differently for each seed."""
    h = x.astype(np.uint64) + (np.atleast_1d(seed).astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (_mix(keys, 0) % np.uint64(buckets)).astype(np.int64)


def _groups(m: int) -> int:
    return max(1, -(-m // PER_GROUP))


def perfect_hash(keys: np.ndarray) -> np.ndarray:
    """The displacements of one bucket's distinct keys: of a group of several keys the seed that sends them to free slots, of a lone key -1 - its slot."""
    m = len(keys)
    of = (_mix(keys, 1) % np.uint64(_groups(m))).astype(np.int64)
    order = np.argsort(of, kind="stable")
    size = np.bincount(of, minlength=_groups(m))
    begin = np.cumsum(size) - size
    taken, out = np.zeros(m, dtype=bool), np.zeros(_groups(m), dtype=np.int32)
    for g in np.argsort(-size, kind="stable").tolist():
        own = keys[order[begin[g] : begin[g] + size[g]]]
        if len(own) < 2:
            break
        seed, step = 0, 16
        while True:
            slots = (_mix(own[None, :], np.arange(seed, seed + step)[:, None] + 2) % np.uint64(m)).astype(np.int64)
            good = ~taken[slots].any(axis=1)
            if len(own) == 2:
                good &= slots[:, 0] != slots[:, 1]
            elif good.any():
                s = np.sort(slots, axis=1)
                good &= (s[:, 1:] != s[:, :-1]).all(axis=1)
            if good.any():
                k = int(np.argmax(good))
                out[g], taken[slots[k]] = seed + k, True
                break
            seed, step = seed + step, min(4 * step, 1024)
    lone = np.flatnonzero(size == 1)
    out[lone] = -1 - np.flatnonzero(~taken)
    return out


def _placed(keys: np.ndarray, displacement: np.ndarray, m) -> np.ndarray:
    """The slot within its bucket of each key, from the displacement of its group and the keys m of its bucket."""
    tried = (_mix(keys, np.maximum(displacement, 0) + 2) % np.asarray(m).astype(np.uint64)).astype(np.int64)
    return np.where(displacement < 0, -1 - displacement, tried)


class Part:
    """Some successive buckets of the hash, with the keys of the slots and, in the second pass, their counts."""

    def __init__(self, buckets: int, first: int, displacements: list[np.ndarray], keys: list[np.ndarray], counts: list[np.ndarray] | None):
        self.buckets, self.first = buckets, first
        self.m = np.array([len(k) for k in keys], dtype=np.int64)
        self.base = np.cumsum(self.m) - self.m
        self.groups = np.array([_groups(x) for x in self.m.tolist()], dtype=np.int64)
        self.at = np.cumsum(self.groups) - self.groups
        self.displacement, self.keys = np.concatenate(displacements).astype(np.int64), np.concatenate(keys)
        self.counts = np.concatenate(counts) if counts is not None else None

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slots of keys of this part; each key is compared with that of its slot."""
        own = bucket_of(keys, self.buckets) - self.first
        d = self.displacement[self.at[own] + (_mix(keys, 1) % self.groups[own].astype(np.uint64)).astype(np.int64)]
        found = self.base[own] + _placed(keys, d, self.m[own])
        if not np.array_equal(self.keys[found], keys):
            raise ValueError("a pair is missing from the hash")
        return found


_held: dict = {}


def load(path: str, buckets: int, part: int, per_part: int, with_counts: bool) -> Part:
    """A part of the table below path; this process keeps the last one."""
    if _held.get("key") != (path, part):
        store, root = pafs.FileSystem.from_uri(path)
        found = pads.dataset(f"{root}/part={part}", filesystem=store, format="parquet").to_table().sort_by("bucket")
        column = lambda name, kind: [np.frombuffer(x.as_py(), dtype=kind) for x in found.column(name)]
        _held.clear()
        _held.update(key=(path, part), value=Part(buckets, part * per_part, column("displacements", "<i4"), column("keys", "<i8"), column("counts", "<i8") if with_counts else None))
    return _held["value"]


# Operator


def _ids(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, dtype="<u4") for x in listed(column)]


def _batches(batches: Iterator[pa.RecordBatch], a: int, b: int, links: int) -> Iterator[pa.RecordBatch]:
    """Slices of batches with some links / 2 tokens, or one document."""
    for batch in batches:
        size = np.cumsum(sum(pc.binary_length(batch.column(k)).to_numpy().astype(np.int64) for k in (a, b))) // (2 * links)
        cuts = [0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), batch.num_rows]
        for x, y in zip(cuts, cuts[1:], strict=False):
            if y > x:
                yield batch.slice(x, y - x)


def alignment(docs: DataFrame, tokenizer_a: str, tokenizer_b: str, id_col: str = "doc_id", text_col: str = "text", listings: bool = True, per_bucket: int = PER_BUCKET, per_part: int = PARTS, links: int = LINKS, fan: int = FAN) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, and with listings the groups) of every row.

    tokenizer_a: a byte-level file for the tokenizers library, applied to a space and the text; tokenizer_b: a
    sentencepiece file, applied to the text, before which it puts a space. A null or empty text, and one whose tokens'
    bytes are not those of a space and the text, has no tokens: zeros and ''. Repeated rows and rows without an id
    are documents like any other, and count as such. An empty table gives no rows; other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), filled(F.col(text_col)).alias("text"))

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pair(tokenizer_a, tokenizer_b)
        for batch in batches:
            for some in portions(batch, 1, PORTION):
                at, ids = p.encode_all(some.column(1))
                if len(at):
                    yield pa.RecordBatch.from_arrays([some.column(0).take(pa.array(at)), *ids], names=["doc_id", "a", "b"])
                some = some.take(pa.array(np.setdiff1d(np.arange(some.num_rows), at)))
                for at in range(0, some.num_rows, 256):
                    own = some.slice(at, 256)
                    found = [p.encode(t) for t in texts(own.column(1))]
                    yield pa.RecordBatch.from_arrays([own.column(0), *(pa.array([x[k].tobytes() for x in found], pa.binary()) for k in (0, 1))], names=["doc_id", "a", "b"])

    encoded = written(rows.mapInArrow(tokens, "doc_id long, a binary, b binary"), "tokens")

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, seen = pair(tokenizer_a, tokenizer_b), np.zeros(0, dtype=np.int64)
        for some in _batches(batches, 0, 1, links):
            new = np.setdiff1d(Aligned(p, _ids(some.column(0)), _ids(some.column(1))).keys, seen)
            seen = np.union1d(seen, new) if len(seen) < links else new
            yield pa.RecordBatch.from_arrays([pa.array(new)], names=["key"])

    pairs = written(encoded.select("a", "b").mapInArrow(distinct, "key long").distinct(), "pairs")
    buckets = max(1, -(-pairs.count() // per_bucket))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = bucket_of(batch.column(0).to_numpy(), buckets)
            yield pa.RecordBatch.from_arrays([pa.array(own), batch.column(0)], names=["bucket", "key"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each run of a bucket."""
        for bucket, (keys,) in _runs(batches):
            d = perfect_hash(keys)
            placed = np.empty_like(keys)
            placed[_placed(keys, d[(_mix(keys, 1) % np.uint64(len(d))).astype(np.int64)].astype(np.int64), len(keys))] = keys
            yield pa.RecordBatch.from_arrays([pa.array([bucket]), pa.array([d.astype("<i4").tobytes()], pa.binary()), pa.array([placed.astype("<i8").tobytes()], pa.binary())], names=["bucket", "displacements", "keys"])

    hashes = pairs.mapInArrow(dealt, "bucket long, key long").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(hashed, "bucket long, displacements binary, keys binary")
    part = F.expr(f"bucket div {per_part}")
    path = f"{work_dir(spark)}/hash-{os.urandom(8).hex()}"
    hashes.withColumn("part", part).repartition("part").write.partitionBy("part").option("compression", "zstd").parquet(path)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, vectors, gathered, size = pair(tokenizer_a, tokenizer_b), {}, [], 0
        task = TaskContext.get().partitionId()

        def flushed(last: bool) -> Iterator[pa.RecordBatch]:
            """Takes what is gathered into the vectors of its parts; sends vectors on when there are several, or at the end."""
            keys = np.concatenate([np.zeros(0, dtype=np.int64), *gathered])
            of = bucket_of(keys, buckets) // per_part
            order = np.argsort(of, kind="stable")
            keys, of = keys[order], of[order]
            found, cuts = np.unique(of, return_index=True)
            for g, x, y in zip(found.tolist(), cuts.tolist(), np.append(cuts, len(of))[1:].tolist(), strict=True):
                held = load(path, buckets, g, per_part, False)
                if g not in vectors:
                    vectors[g] = (np.zeros(len(held.keys), dtype=np.int64), held.base, held.m)
                vectors[g][0][:] += np.bincount(held.slots(keys[x:y]), minlength=len(held.keys))
                if len(vectors) > 2 or last:
                    yield from sent(vectors)
            if last:
                yield from sent(vectors)

        def sent(vectors: dict) -> Iterator[pa.RecordBatch]:
            while vectors:
                g, (v, base, m) = vectors.popitem()
                some = [(g * per_part + i, v[b : b + k]) for i, (b, k) in enumerate(zip(base.tolist(), m.tolist(), strict=True)) if v[b : b + k].any()]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in some], pa.int64()), pa.array([task] * len(some), pa.int64()), pa.array([x[1].astype("<i8").tobytes() for x in some], pa.binary())], names=["bucket", "leaf", "counts"])

        for some in _batches(batches, 0, 1, links):
            gathered.append(Aligned(p, _ids(some.column(0)), _ids(some.column(1))).per_document())
            size += len(gathered[-1])
            if size >= links:
                yield from flushed(False)
                gathered, size = [], 0
        yield from flushed(True)

    leaves = encoded.select("a", "b")
    vectors, n = leaves.mapInArrow(counted, "bucket long, leaf long, counts binary"), leaves.rdd.getNumPartitions()
    while True:
        vectors = vectors.withColumn("leaf", F.expr(f"leaf div {fan}")).repartition("bucket", "leaf").sortWithinPartitions("bucket", "leaf").mapInArrow(_added, "bucket long, leaf long, counts binary")
        n = -(-n // fan)
        if n <= 1:
            break
    keys = spark.read.schema("bucket long, displacements binary, keys binary").parquet(path).select(F.col("bucket").alias("_bucket"), "displacements", "keys")
    # some PER_BUCKET keys to a row; the first tokenizer's ids are the only thing that is collected, one number each
    table = written(vectors.join(keys, F.col("bucket") == F.col("_bucket")).select("bucket", "displacements", "keys", "counts"), "pair-counts")
    highest = np.zeros(_vocabulary(tokenizer_a), dtype=np.int64)
    for a, best in table.select("keys", "counts").mapInArrow(_best, "a long, best long").groupBy("a").agg(F.max("best").alias("best")).toLocalIterator():
        highest[a] = best
    top = spark.sparkContext.broadcast(highest)
    counts_path = f"{work_dir(spark)}/counts-{os.urandom(8).hex()}"
    table.withColumn("part", part).repartition("part").write.partitionBy("part").option("compression", "zstd").parquet(counts_path)

    fields = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string" + (", groups string" if listings else "")
    names = [x.split()[0] for x in fields.split(", ")]

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pair(tokenizer_a, tokenizer_b)
        marks, offset = names_of(p)
        for some in _batches(batches, 1, 2, links):
            x = Aligned(p, _ids(some.column(1)), _ids(some.column(2)))
            best, total = np.zeros(some.num_rows, dtype=np.int64), np.zeros(some.num_rows, dtype=np.int64)
            of = bucket_of(x.keys, buckets) // per_part
            for g in np.unique(of).tolist():
                own = of == g
                held = load(counts_path, buckets, g, per_part, True)
                n = held.counts[held.slots(x.keys[own])]
                np.add.at(total, x.doc[own], n)
                best += np.bincount(x.doc[own][n == top.value[x.link_a[own]]], minlength=some.num_rows)
            listed = x.listings(marks, offset)
            digests = [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in listed]
            columns = [some.column(0), *(pa.array(v.astype(np.int64)) for v in (x.n_a, x.n_b, x.n_groups, x.n_links, best, total)), pa.array(digests, pa.string())]
            yield pa.RecordBatch.from_arrays([*columns, *([pa.array(listed, pa.string())] if listings else [])], names=names)

    return encoded.mapInArrow(looked_up, fields)


@cache
def _vocabulary(tokenizer: str) -> int:
    return len(codec(tokenizer).bytes)


def _runs(batches: Iterator[pa.RecordBatch], key: int = 1) -> Iterator[tuple]:
    """(key, columns) of each run of rows with equal first `key` columns; a run may go over batches. Keys come as a tuple if there are several."""
    last, held = None, []
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, dtype=bool)
        for c in columns[:key]:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for x, y in zip(cuts, cuts[1:], strict=False):
            own = tuple(int(c[x]) for c in columns[:key])
            if held and own != last:
                yield (last if key > 1 else last[0]), [np.concatenate(v) for v in zip(*held, strict=True)]
                held = []
            last = own
            held.append([c[x:y] for c in columns[key:]])
    if held:
        yield (last if key > 1 else last[0]), [np.concatenate(v) for v in zip(*held, strict=True)]


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of each run of vectors of one bucket and leaf."""
    for (bucket, leaf), (vectors,) in _runs(batches, 2):
        total = np.sum([np.frombuffer(v, dtype="<i8") for v in vectors], axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([bucket]), pa.array([leaf]), pa.array([total.astype("<i8").tobytes()], pa.binary())], names=["bucket", "leaf", "counts"])


def _best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The highest count of each first id, bucket by bucket."""
    for batch in batches:
        for keys, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, n = np.frombuffer(keys, dtype="<i8") >> SHIFT, np.frombuffer(counts, dtype="<i8")
            ids, at = np.unique(a, return_inverse=True)
            most = np.zeros(len(ids), dtype=np.int64)
            np.maximum.at(most, at, n)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(most)], names=["a", "best"])
