"""Byte-level BPE with content-defined chunk reuse.

A rolling hash over bytes cuts every text into chunks whose boundaries follow the content, so texts that share a
passage share its inner chunks. Chunks that occur again are encoded once and their ids go to all their occurrences;
the rest of a text is encoded in place. Where two parts meet, tokens near the joint may be wrong: they are taken
away and the text around is encoded again, in a growing window, until the new tokens and those of the part to the
right begin a word at the same byte. As the splitter of this vocabulary looks only ahead, and no more than MARGIN
bytes past a word, all is then as if the whole text had been encoded at once.

The vocabulary file is a parameter: a file that driver and executors have at the same place, never trained here.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import collect_bitmap, filled, hits, slices, texts, written

#: Bytes of the rolling window; one boundary in so many places.
ROLL, SPACING = 16, 512
#: Bytes beyond a word that can change how it is split: the longest special token, and some.
MARGIN = 16
#: Chunk texts that a task sends once for itself, at most, before it forgets them.
SENT = 100_000

_GEAR = np.random.default_rng(20240229).integers(0, 1 << 32, 256, dtype=np.uint32)


#: Fixed value: the published pattern by which a byte-level tokenizer of this kind splits text into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A text with a longer word goes to the library that takes long words in less than quadratic time.
LONG_WORD = re.compile(rb"[^\x20\x09-\x0D]{1000}|[\x20\x09-\x0D]{1000}")


class Codec:
    """A tokenizer file with the bytes of each of its tokens.

    Where the file's merges come in the order of their ids, as in byte-level vocabularies of this kind, the tokens are
    those of the merge of least id each time, which tiktoken finds several times faster; tests hold both to be equal.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
        size = max(vocabulary.values()) + 1
        self.bytes = [b""] * size
        for token, i in vocabulary.items():
            self.bytes[i] = token.encode() if token in special else bytes(letters[c] for c in token)
        self.names = [str(i).encode() for i in range(size)]
        self.lengths = np.array([len(b) for b in self.bytes], dtype=np.int64)
        # a token of a space and a visible ASCII character can only begin a word
        self.begins = np.array([len(b) > 1 and b[0] == 32 and 32 < b[1] < 127 for b in self.bytes])
        self.fast = self._fast(json.loads(self.tokenizer.to_str()), special)

    def _fast(self, file: dict, special: dict[str, int]):
        split, model = file.get("pre_tokenizer") or {}, file["model"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model.get("merges", [])]
        made = [model["vocab"].get(a + b, -1) for a, b in pairs]
        if split.get("type") != "ByteLevel" or not split.get("use_regex") or split.get("add_prefix_space") or file.get("normalizer") or made != sorted(made) or -1 in made:
            return None
        import tiktoken

        ranks = {self.bytes[i]: i for t, i in model["vocab"].items() if t not in special}
        return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def encode(self, part: bytes) -> list[int]:
        text = part.decode()
        if self.fast is None or LONG_WORD.search(part):
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        return self.fast.encode(text, allowed_special="all")

    def decode(self, ids) -> str:
        """As the library's decode() that keeps special tokens."""
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


@cache
def codec(path: str) -> Codec:
    return Codec(path)


def chunk_bounds(docs: list[bytes]) -> list[list[int]]:
    """The boundaries of each text's chunks, 0 and its length included, on whole UTF-8 characters."""
    data = np.frombuffer(b"".join(docs), dtype=np.uint8)
    h = _GEAR[data]
    reach = 1
    while reach < ROLL:
        h[reach:] = (h[:-reach] << np.uint32(reach)) + h[reach:]
        reach *= 2
    # bits below the window's length hold few bytes, so the upper ones decide
    cut = np.flatnonzero((h >> np.uint32(16)) % np.uint32(SPACING) == 0) + 1
    cut = cut[cut < len(data)]
    cut = cut[(data[cut] & 0xC0) != 0x80] if len(cut) else cut
    ends = np.cumsum([len(d) for d in docs])
    out, at = [], 0
    for d, end in zip(docs, ends.tolist(), strict=True):
        own = cut[np.searchsorted(cut, at + ROLL) : np.searchsorted(cut, end)] - at
        out.append([0, *own.tolist(), len(d)] if d else [0])
        at = end
    return out


def chunk_keys(doc: bytes, bounds: list[int]) -> list[tuple[int, int]]:
    """A 128-bit hash of each chunk as two signed longs."""
    out = []
    for a, b in zip(bounds, bounds[1:], strict=False):
        h = xxhash.xxh3_128_digest(doc[a:b])
        out.append((int.from_bytes(h[:8], "little", signed=True), int.from_bytes(h[8:], "little", signed=True)))
    return out


def text_key(doc: bytes) -> tuple[int, int]:
    h = xxhash.xxh3_128_digest(doc, seed=1)
    return int.from_bytes(h[:8], "little", signed=True), int.from_bytes(h[8:], "little", signed=True)


class Part:
    """Tokens of a stretch of text: ids, which of them surely begin a word, and the byte where each begins, from the text's start."""

    def __init__(self, ids: np.ndarray, starts: np.ndarray, at: np.ndarray, end: int):
        self.ids, self.starts, self.at, self.end = ids, starts, at, end

    @classmethod
    def of(cls, c: Codec, ids, begin: int) -> Part:
        ids = np.asarray(ids, dtype=np.int64)
        ends = begin + np.cumsum(c.lengths[ids]) if len(ids) else np.zeros(0, dtype=np.int64)
        return cls(ids, c.begins[ids], ends - c.lengths[ids], int(ends[-1]) if len(ids) else begin)

    def until(self, byte: int) -> Part:
        n = int(np.searchsorted(self.at, byte))
        return Part(self.ids[:n], self.starts[:n], self.at[:n], byte)

    def since(self, byte: int) -> Part:
        n = int(np.searchsorted(self.at, byte))
        return Part(self.ids[n:], self.starts[n:], self.at[n:], self.end)

    def plus(self, other: Part) -> Part:
        return Part(np.concatenate((self.ids, other.ids)), np.concatenate((self.starts, other.starts)), np.concatenate((self.at, other.at)), other.end)


def joined(c: Codec, doc: bytes, parts: list[Part]) -> list[Part]:
    """Parts of successive stretches, repaired so that together they are the encoding of the whole text."""
    done = parts[:1]
    for right in parts[1:]:
        joint = done[-1].end
        while True:  # the last word start that nothing beyond the joint can move; else what came before joins in
            left = done[-1]
            safe = left.at[left.starts & (left.at <= joint - MARGIN)]
            if len(safe) or len(done) == 1:
                break
            done[-2:] = [done[-2].plus(done[-1])]
        begin = int(safe[-1]) if len(safe) else int(left.at[0]) if len(left.at) else 0
        reach = 64
        while True:
            stop = min(right.end, joint + reach)
            while stop < right.end and doc[stop] & 0xC0 == 0x80:
                stop += 1
            window = Part.of(c, c.encode(doc[begin:stop]), begin)
            if stop == right.end:
                middle, rest = window, None
                break
            fixed = window.at[window.starts & (window.at >= joint) & (window.at <= stop - MARGIN)]
            both = np.intersect1d(fixed, right.at[right.starts], assume_unique=True)
            if len(both):
                middle, rest = window.until(int(both[0])), right.since(int(both[0]))
                break
            reach *= 4
        done[-1] = left.until(begin).plus(middle)
        if rest is not None:
            done.append(rest)
    return done


def assembled(c: Codec, doc: bytes, bounds: list[int], keys: list[tuple[int, int]], known: dict) -> np.ndarray:
    """The ids of a text of which some chunks' ids are known."""
    plan = []
    for a, b, k in zip(bounds, bounds[1:], keys, strict=False):
        if k in known:
            plan.append((a, b, k))
        elif plan and plan[-1][2] is None:
            plan[-1] = (plan[-1][0], b, None)
        else:
            plan.append((a, b, None))
    parts = [Part.of(c, known[k] if k is not None else c.encode(doc[a:b]), a) for a, b, k in plan]
    return np.concatenate([p.ids for p in joined(c, doc, parts)]) if parts else np.zeros(0, dtype=np.int64)


def encode_decode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", id_lists: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded, ids_sha256, decoded_sha256) of every row; ids and decoded only with id_lists.

    Null text counts as empty: no tokens, and the decoded text is empty. Repeated rows and null ids are encoded like
    any other; an empty table gives no rows; other columns are ignored, whatever their names.
    """
    import zstandard

    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), filled(F.col(text_col)).alias("text"))
    batch_of = pa.RecordBatch.from_arrays
    long, binary = pa.int64(), pa.binary()

    def chunked(column: pa.Array):
        """(first row, texts, bounds, keys) of a column's texts, a few at a time."""
        for first, some in slices(texts(column)):
            bounds = chunk_bounds(some)
            yield first, some, bounds, [chunk_keys(d, b) for d, b in zip(some, bounds, strict=True)]

    def all_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for *_, keys in chunked(batch.column(0)):
                flat = [k for own in keys for k in own]
                yield batch_of([pa.array([k[0] for k in flat], long), pa.array([k[1] for k in flat], long)], names=["a", "b"])

    again = rows.select("text").mapInArrow(all_keys, "a long, b long").groupBy("a", "b").agg(F.count("*").alias("n")).where("n > 1")
    bits = spark.sparkContext.broadcast(collect_bitmap(again, "a"))

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set = set()
        for batch in batches:
            for _, some, bounds, keys in chunked(batch.column(0)):
                out = []
                for d, at, own in zip(some, bounds, keys, strict=True):
                    marked = hits(bits.value, np.array([k[0] for k in own], dtype=np.int64))
                    if marked.any():
                        t = text_key(d)
                        for i in np.flatnonzero(marked).tolist():
                            new = own[i] not in sent
                            sent.add(own[i])
                            out.append((*t, *own[i], d[at[i] : at[i + 1]] if new else None))
                if len(sent) > SENT:
                    sent = set()
                yield batch_of([pa.array([x[k] for x in out], long if k < 4 else binary) for k in range(5)], names=["t", "u", "a", "b", "chunk"])

    found = written(rows.select("text").mapInArrow(occurrences, "t long, u long, a long, b long, chunk binary"), "chunks")

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(tokenizer)
        for batch in batches:
            for at, some in slices(texts(batch.column(2))):
                ids = [np.array(c.encode(x), dtype="<u4").tobytes() for x in some]
                yield batch_of([batch.column(0).slice(at, len(some)), batch.column(1).slice(at, len(some)), pa.array(ids, binary)], names=["_a", "_b", "ids"])

    encoded = found.where("chunk is not null").groupBy("a", "b").agg(F.min("chunk").alias("chunk")).mapInArrow(once, "_a long, _b long, ids binary")
    # a text's known chunks, which stay where they are grouped for the join: copies of one text meet in one task, whose rows go by one at a time
    known = found.groupBy("t", "u", "a", "b").agg(F.lit(1).alias("_1")).join(encoded, (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b")))
    known = known.groupBy("t", "u").agg(F.collect_list(F.struct("a", "b", "ids")).alias("known")).select(F.col("t").alias("_t"), F.col("u").alias("_u"), "known")

    finals = "n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if id_lists else "")
    types = [long, pa.string(), pa.string()] + ([pa.list_(pa.int32()), pa.string()] if id_lists else [])
    names = [x.split()[0] for x in finals.split(", ")]

    def final(c: Codec, ids: list[int]) -> tuple:
        decoded = c.decode(ids)
        out = (len(ids), hashlib.sha256(b",".join(map(c.names.__getitem__, ids))).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
        return (*out, ids, decoded) if id_lists else out

    def columns(out: list[tuple | None]) -> list[pa.Array]:
        return [pa.array([x[k] if x else None for x in out], t) for k, t in enumerate(types)]

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Finishes the texts without shared chunks; the others go on, compressed."""
        c, z = codec(tokenizer), zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for at, some, _, keys in chunked(batch.column(1)):
                flags = [bool(hits(bits.value, np.array([k[0] for k in own], dtype=np.int64)).any()) if own else False for own in keys]
                out = [None if f else final(c, c.encode(d)) for d, f in zip(some, flags, strict=True)]
                key = [text_key(d) for d in some]
                yield batch_of([batch.column(0).slice(at, len(some)), pa.array([k[0] for k in key], long), pa.array([k[1] for k in key], long), pa.array([z.compress(d) if f else None for d, f in zip(some, flags, strict=True)], binary), *columns(out)], names=["doc_id", "t", "u", "text", *names])

    def last_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Puts the others together from their known chunks."""
        c, z = codec(tokenizer), zstandard.ZstdDecompressor()
        for batch in batches:
            done = list(zip(*(batch.column(k).to_pylist() for k in range(3, 3 + len(names))), strict=True))
            for i in range(batch.num_rows):
                if (text := batch.column(1)[i].as_py()) is not None:
                    doc = z.decompress(text)
                    known = {(k["a"], k["b"]): np.frombuffer(k["ids"], dtype="<u4") for k in batch.column(2)[i].as_py() or []}
                    bounds = chunk_bounds([doc])[0]
                    done[i] = final(c, assembled(c, doc, bounds, chunk_keys(doc, bounds), known).tolist())
            yield batch_of([batch.column(0), *columns(done)], names=["doc_id", *names])

    passed = rows.mapInArrow(first_pass, f"doc_id long, t long, u long, text binary, {finals}")
    whole = passed.join(known, (F.col("t") == F.col("_t")) & (F.col("u") == F.col("_u")), "left")
    return whole.select("doc_id", "text", "known", *names).mapInArrow(last_pass, f"doc_id long, {finals}")
