"""Token ids in files of range asymmetric numeral systems (rANS), a Spark data source.

The frequencies of all ids, summed by Spark, become one static table, which every file carries the checksum of. A file
is a row of independent blocks of whole documents in the order of their ids. In a block, id i belongs to lane i modulo
the number of lanes; all lanes share the table and one stream of 32-bit words, so that numpy codes a step of all lanes
at a time. Every SEGMENT ids or so a checkpoint keeps the lanes' states and the place in the stream: reading can begin
there, and a task that reads a segment returns the documents that begin in it. The payload and each segment's ids have
a CRC-32 of their own, which readers verify.

Writing: a task per range of document ids, files of bounded size under names that no other attempt uses; when the job
commits, the driver lists the files of the successful attempts, with their numbers of ids, documents and checkpoints,
in a manifest. From it follow the first position of each file and the tasks of a reader.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .common import byte_rows, distinct_parts, filled, listed, portions, work_dir, written
from .warc import _store

#: Bits of the scale of frequencies; a state stays from 2^31 to below 2^63.
SCALE, LOW = 20, np.uint64(1 << 31)
#: Lanes of a block at most, ids of a lane at least where a block has fewer; ids of a block and from checkpoint to checkpoint, about; bytes of a file, about.
LANES, STEPS, BLOCK, SEGMENT, FILE = 2048, 64, 1 << 20, 1 << 18, 1 << 28
#: Checkpoints that a task reads, at most.
PER_TASK = 256
MAGIC = b"TOKRANS1"
READ_SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long"
#: Bytes of texts whose words are encoded together.
PORTION = 1 << 24


# Coding


class Table:
    """Frequencies of ids, scaled to 2^SCALE so that every id that occurs has one at least."""

    def __init__(self, frequencies: np.ndarray):
        self.f = frequencies.astype(np.uint64)
        self.first = np.cumsum(self.f) - self.f
        self.crc = zlib.crc32(self.f.astype("<u4").tobytes())
        self._of = None

    @property
    def of(self) -> np.ndarray:
        """The id of each number below 2^SCALE."""
        if self._of is None:
            self._of = np.repeat(np.arange(len(self.f), dtype=np.uint32), self.f.astype(np.int64))
        return self._of


def scaled(counts: np.ndarray) -> np.ndarray:
    """Counts by id as frequencies that add up to 2^SCALE; 0 stays 0. More than 2^SCALE ids have no such table."""
    total, used = int(counts.sum()), counts > 0
    if not total:
        return np.zeros(len(counts), dtype=np.int64)
    if used.sum() > 1 << SCALE:
        raise ValueError(f"more than {1 << SCALE} different ids")
    out = np.maximum((counts.astype(np.float64) / total * (1 << SCALE)).astype(np.int64), used)
    order = np.argsort(-out, kind="stable")
    rest = (1 << SCALE) - int(out.sum())
    while rest:  # the most frequent ids take the difference, none falls below 1
        free = order[out[order] > 1] if rest < 0 else order[: int(used.sum())]
        share = np.sign(rest) * np.maximum(1, np.minimum(abs(rest) * out[free] // max(1, int(out[free].sum())), out[free] - 1 if rest < 0 else abs(rest)))
        share = share[np.cumsum(abs(share)) <= abs(rest)]
        out[free[: len(share)]] += share
        rest = (1 << SCALE) - int(out.sum())
    return out


class Coded:
    """A block's stream: words, and per checkpoint the step, words before it, states and the CRC-32 of the ids up to the next."""

    def __init__(self, n: int, lanes: int, words: np.ndarray, steps: np.ndarray, at: np.ndarray, states: np.ndarray, crcs: np.ndarray):
        self.n, self.lanes, self.words, self.steps, self.at, self.states, self.crcs = n, lanes, words, steps, at, states, crcs


def encoded(ids: np.ndarray, t: Table, segment: int = SEGMENT) -> Coded:
    n = len(ids)
    lanes = max(1, min(LANES, n // STEPS))
    last = max(1, -(-n // lanes))
    every = max(1, segment // lanes)
    f, first = t.f[ids], t.first[ids]
    x = np.full(lanes, LOW, dtype=np.uint64)
    most = f << np.uint64(63 - SCALE)
    words, counts, kept = [], np.zeros(last + 1, dtype=np.int64), []
    for step in range(last - 1, -1, -1):
        own = slice(step * lanes, min(n, step * lanes + lanes))
        y, g = x[: own.stop - own.start], f[own]
        full = y >= most[own]
        if full.any():
            words.append((y[full] & np.uint64(0xFFFFFFFF)).astype("<u4"))
            counts[step + 1] = len(words[-1])
            y[full] >>= np.uint64(32)
        q = y // g
        y[:] = (q << np.uint64(SCALE)) + (y - q * g) + first[own]
        if step % every == 0:
            kept.append((step, x.copy()))
    kept.reverse()
    steps = np.array([k for k, _ in kept], dtype=np.int64)
    crcs = [zlib.crc32(ids[k * lanes : (k + every) * lanes].astype("<u4").tobytes()) for k in steps.tolist()]
    return Coded(n, lanes, np.concatenate([np.zeros(0, dtype="<u4"), *words[::-1]]), steps, np.cumsum(counts)[steps], np.array([s for _, s in kept], dtype="<u8").reshape(len(kept), lanes), np.array(crcs, dtype="<u4"))


def decoded(c: Coded, t: Table, k: int) -> np.ndarray:
    """The ids from checkpoint k to the next, verified."""
    begin, end = int(c.steps[k]), int(c.steps[k + 1]) if k + 1 < len(c.steps) else -(-c.n // c.lanes)
    x, at = c.states[k].astype(np.uint64), int(c.at[k])
    out = np.empty(min(c.n, end * c.lanes) - begin * c.lanes, dtype=np.uint32)
    mask = np.uint64((1 << SCALE) - 1)
    for step in range(begin, end):
        low, high = step * c.lanes, min(c.n, step * c.lanes + c.lanes)
        y = x[: high - low]
        rest = y & mask
        ids = t.of[rest.astype(np.int64)]
        out[low - begin * c.lanes : high - begin * c.lanes] = ids
        y[:] = t.f[ids] * (y >> np.uint64(SCALE)) + rest - t.first[ids]
        short = np.flatnonzero(y < LOW)
        if len(short):
            y[short] = y[short] << np.uint64(32) | c.words[at : at + len(short)]
            at += len(short)
    if zlib.crc32(out.astype("<u4").tobytes()) != int(c.crcs[k]):
        raise ValueError("ids differ from their checksum")
    return out


# Files: MAGIC, checksum of the table, blocks, footer (JSON), its length and checksum, MAGIC


def block_bytes(docs: list[tuple[int | None, np.ndarray]], t: Table) -> tuple[bytes, int]:
    """(a block of documents, its checkpoints). A header of five numbers and a checksum leads, then what it counts."""
    c = encoded(np.concatenate([np.zeros(0, dtype=np.uint32), *(i for _, i in docs)]), t)
    body = b"".join(
        (
            np.array([d if d is not None else 0 for d, _ in docs], dtype="<i8").tobytes(),
            np.array([d is None for d, _ in docs], dtype="u1").tobytes(),
            np.array([len(i) for _, i in docs], dtype="<i8").tobytes(),
            *(v.astype("<i8").tobytes() for v in (c.steps, c.at)),
            c.states.tobytes(),
            c.crcs.tobytes(),
            c.words.tobytes(),
        )
    )
    return struct.pack("<5qI", len(docs), c.n, c.lanes, len(c.steps), len(c.words), zlib.crc32(body)) + body, len(c.steps)


def parsed(data: bytes) -> tuple[list[int | None], np.ndarray, Coded]:
    """(document ids, lengths, stream) of a block, verified."""
    docs, n, lanes, checkpoints, words, crc = struct.unpack_from("<5qI", data)
    at = struct.calcsize("<5qI")
    if zlib.crc32(memoryview(data)[at:]) != crc:
        raise ValueError("a block differs from its checksum")
    out = []
    for kind, k in (("<i8", docs), ("u1", docs), ("<i8", docs), ("<i8", checkpoints), ("<i8", checkpoints), ("<u8", checkpoints * lanes), ("<u4", checkpoints), ("<u4", words)):
        out.append(np.frombuffer(data, dtype=kind, count=k, offset=at))
        at += out[-1].nbytes
    ids, null, lengths, steps, places, states, crcs, stream = out
    return [None if x else i for i, x in zip(ids.tolist(), null.tolist(), strict=True)], lengths, Coded(n, lanes, stream, steps, places, states.reshape(checkpoints, lanes), crcs)


@cache
def read_table(folder: str) -> Table:
    store, root = _store(folder)
    with store.open_input_stream(f"{root}/_table", compression=None) as f:
        data = f.read()
    (crc,) = struct.unpack_from("<I", data)
    t = Table(np.frombuffer(data, dtype="<u4", offset=4))
    if t.crc != crc:
        raise ValueError("the table differs from its checksum")
    return t


def write_table(folder: str, frequencies: np.ndarray) -> None:
    store, root = _store(folder)
    store.create_dir(root, recursive=True)
    t = Table(frequencies)
    with store.open_output_stream(f"{root}/_table", compression=None) as f:
        f.write(struct.pack("<I", t.crc) + t.f.astype("<u4").tobytes())


class _Files(WriterCommitMessage):
    def __init__(self, files: list[dict]):
        self.files = files


class _Writer(DataSourceArrowWriter):
    """Rows (doc_id, ids) come in order; the number of the task is the place of its files."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.kind = options.get("idkind", "<u4")
        self.block, self.limit = int(options.get("blockids", BLOCK)), int(options.get("maxfilebytes", FILE))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, root = _store(self.path)
        t, task, files, out = read_table(self.path), TaskContext.get().partitionId(), [], None

        def ended() -> None:
            foot = json.dumps(blocks).encode()
            out.write(foot + struct.pack("<QI", len(foot), zlib.crc32(foot)) + MAGIC)
            out.close()

        held, size, blocks, at = [], 0, [], 0
        for doc, ids in _documents(iterator, self.kind):
            if ids is not None:
                held.append((doc, ids))
                size += len(ids)
            if held and (size >= self.block or ids is None):
                if out is None:
                    files.append({"name": f"{uuid.uuid4().hex}.rans", "task": task, "place": len(files), "n": 0, "docs": 0, "checkpoints": 0})
                    out, blocks = store.open_output_stream(f"{root}/{files[-1]['name']}", compression=None), []
                    out.write(MAGIC + struct.pack("<I", t.crc))
                    at = len(MAGIC) + 4
                data, checkpoints = block_bytes(held, t)
                out.write(data)
                # of each block: where it begins and ends, ids and checkpoints before it
                blocks.append([at, at + len(data), files[-1]["n"], files[-1]["checkpoints"]])
                at += len(data)
                for k, v in (("n", size), ("docs", len(held)), ("checkpoints", checkpoints)):
                    files[-1][k] += v
                held, size = [], 0
                if at >= self.limit:
                    ended()
                    out = None
        if out is not None:
            ended()
        return _Files(files)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, root = _store(self.path)
        with store.open_output_stream(f"{root}/_files-{uuid.uuid4().hex}.json") as f:
            f.write(json.dumps([x for m in messages if m for x in m.files]).encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, root = _store(self.path)
        for m in messages:
            for x in m.files if m else []:
                store.delete_file(f"{root}/{x['name']}")


def _documents(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[tuple]:
    """(id, ids) of every row, and (None, None) at the end."""
    for batch in batches:
        for doc, ids in zip(batch.column(0), batch.column(1), strict=True):
            yield doc.as_py(), np.frombuffer(ids.as_buffer() if ids.is_valid else b"", dtype=kind).astype(np.uint32)
    yield None, None


class _Segments(InputPartition):
    def __init__(self, name: str, start: int, first: int, last: int):
        self.name, self.start, self.first, self.last = name, start, first, last


class _Reader(DataSourceReader):
    def __init__(self, schema, options: dict):
        self.path, self.per_task = options["path"], int(options.get("checkpoints", PER_TASK))
        self.names = schema.fieldNames()

    def partitions(self) -> list[InputPartition]:
        store, root = _store(self.path)
        found = []
        for x in store.get_file_info(pafs.FileSelector(root)):
            if x.base_name.startswith("_files-"):
                with store.open_input_stream(x.path, compression=None) as f:
                    found += json.loads(f.read())
        out, start = [], 0
        for x in sorted(found, key=lambda x: (x["task"], x["place"])):
            out += [_Segments(x["name"], start, k, min(k + self.per_task, x["checkpoints"])) for k in range(0, x["checkpoints"], self.per_task)]
            start += x["n"]
        return out

    def read(self, partition: _Segments | None) -> Iterator[tuple]:
        if partition is None:
            return
        store, root = _store(self.path)
        t = read_table(self.path)
        with store.open_input_file(f"{root}/{partition.name}") as f:
            tail = struct.calcsize("<QI") + len(MAGIC)
            f.seek(f.size() - tail)
            end = f.read(tail)
            size, crc = struct.unpack_from("<QI", end)
            f.seek(f.size() - tail - size)
            foot = f.read(size)
            f.seek(0)
            head = f.read(len(MAGIC) + 4)
            if not end.endswith(MAGIC) or zlib.crc32(foot) != crc or head != MAGIC + struct.pack("<I", t.crc):
                raise ValueError(f"{partition.name} is no token file of this table")
            blocks = json.loads(foot)
            for i, (begin, stop, before, checkpoint) in enumerate(blocks):
                after = blocks[i + 1][3] if i + 1 < len(blocks) else partition.last
                if checkpoint < partition.last and after > partition.first:
                    f.seek(begin)
                    yield from self._block(f.read(stop - begin), t, partition.start + before, partition.first - checkpoint, partition.last - checkpoint)

    def _block(self, data: bytes, t: Table, start: int, low: int, high: int) -> Iterator[tuple]:
        """The documents that begin in a block's segments low to high, each as far as it goes."""
        docs, lengths, c = parsed(data)
        low, high = max(0, low), min(high, len(c.steps))
        edge = np.append(c.steps * c.lanes, c.n)
        ends = np.cumsum(lengths)
        begins = ends - lengths
        at, segment, held = int(edge[low]), low, np.zeros(0, dtype=np.uint32)
        for k in range(int(np.searchsorted(begins, edge[low])), int(np.searchsorted(begins, edge[high]) if high < len(c.steps) else len(docs))):
            while segment < len(c.steps) and at + len(held) < ends[k]:
                held = held[max(0, int(begins[k]) - at) :] if len(held) else held
                at = max(at, min(int(begins[k]), int(edge[segment])))
                held = np.concatenate((held, decoded(c, t, segment)))
                segment += 1
            ids = held[int(begins[k]) - at : int(ends[k]) - at]
            row = {"doc_id": docs[k], "start": start + int(begins[k]), "n_tokens": int(lengths[k]), "ids_crc32": zlib.crc32(ids.astype("<u4").tobytes()), "ids": ids.astype("<u4").tobytes()}
            yield tuple(row[n] for n in self.names)


class TokenFiles(DataSource):
    """spark.read / df.write .format("tokens"): options path, idKind (numpy type of the ids of a row), blockIds and maxFileBytes (writing), checkpoints a task and ids=true (reading)."""

    @classmethod
    def name(cls) -> str:
        return "tokens"

    def schema(self) -> str:
        return READ_SCHEMA + (", ids binary" if self.options.get("ids") == "true" else "")

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(dict(self.options))

    def reader(self, schema) -> DataSourceReader:
        return _Reader(schema, dict(self.options))


# Encoding


class Words:
    """The library's encoding of texts, put together from that of their distinct words between blanks.

    Only for tokenizers whose words never reach over a blank: blanks() says whether a file's parts are such. Words
    of ASCII and simple Latin letters, most of them, go through tiktoken, many in one call; the rest through the
    library. For tiktoken the end of a word is a byte that no such word has, and joins the last letter first, as the
    library's merges begin with letters of which the last is marked; tests hold both to be equal.
    """

    def __init__(self, tokenizer: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        file = json.loads(self.tokenizer.to_str())
        self.apart = blanks(file)
        #: Bytes of an id.
        self.width = 2 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.kind = f"<u{self.width}"
        if self.apart:
            self._simple(file["model"])

    def _simple(self, model: dict) -> None:
        import tiktoken

        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = [""] * 256
        for k, b in enumerate([*printable, *(x for x in range(256) if x not in printable)]):
            letters[b] = chr(b) if k < len(printable) else chr(256 + k - len(printable))
        byte, end, vocabulary = {c: bytes([b]) for b, c in enumerate(letters)}, model["end_of_word_suffix"], model["vocab"]
        ranks, ids = {bytes([b]): b for b in range(256)}, [vocabulary[c] for c in letters]
        for b, c in enumerate(letters):
            if b != END[0]:
                ranks[bytes([b]) + END] = len(ids)
                ids.append(vocabulary[c + end])
        for pair in model["merges"]:
            token = "".join(pair if isinstance(pair, list) else pair.split(" "))
            plain = token.removesuffix(end)
            content = b"".join(map(byte.__getitem__, plain)) + (END if plain != token else b"")
            if content not in ranks:
                ranks[content] = len(ids)
                ids.append(vocabulary[token])
        self.ids = np.array(ids, dtype=np.int64)
        self.ids[10] = -1  # a line end parts words
        self.fast = tiktoken.Encoding("words", pat_str=r"\n|[^\x01\n]*\x01", mergeable_ranks=ranks, special_tokens={})

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the words, how many of each)."""
        ids, many = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for at in range(0, len(words), 8192):
            own, simple = words[at : at + 8192], None
            text = "\n".join([*own, ""])
            if not SIMPLE_LINES.fullmatch(text) or "<|" in text:
                simple = np.array([SIMPLE.fullmatch(w) is not None and "<|" not in w for w in own])
                text = "\n".join([*(w for w, k in zip(own, simple.tolist(), strict=True) if k), ""])
            found = self.ids[self.fast.encode_to_numpy(_PIECE.sub("\\g<0>\x01", text.lower()), disallowed_special=())]
            n = np.diff(np.flatnonzero(found < 0), prepend=-1) - 1
            found = found[found >= 0]
            if simple is not None:
                others = self._ask([w for w, k in zip(own, simple.tolist(), strict=True) if not k])
                each = np.zeros(len(own), dtype=np.int64)
                each[simple], each[~simple] = n[: int(simple.sum())], [len(x) for x in others]
                mixed, of = np.zeros(int(each.sum()), dtype=np.int64), np.repeat(simple, each)
                mixed[of], mixed[~of] = found, [i for x in others for i in x]
                found, n = mixed, each
            ids.append(found)
            many.append(n)
        return np.concatenate(ids), np.concatenate(many)

    def _ask(self, some: list[str]) -> list[list[int]]:
        """The library's ids of each text."""
        return [e.ids for at in range(0, len(some), 4096) for e in self.tokenizer.encode_batch_fast(some[at : at + 4096], add_special_tokens=False)]

    def columns(self, texts: pa.Array, *ends: int) -> pa.Array:
        """The ids of each text, and after them ends, as numbers of width bytes."""
        if not self.apart:
            return pa.array([np.array([*x, *ends], dtype=self.kind).tobytes() for x in self._ask(listed(texts))], pa.binary())
        for c in "\n\t\r":
            texts = pc.replace_substring(texts, c, " ")
        words, codes, n = distinct_parts(pc.split_pattern(texts, " "))
        ids, many = self._words(listed(words))
        begin, own = np.cumsum(many) - many, many[codes]
        total = np.cumsum(np.concatenate(([0], own)))
        edges = total[np.concatenate(([0], np.cumsum(n)))]
        each = np.diff(edges)
        out = np.empty(int(edges[-1]) + len(ends) * len(each), dtype=self.kind)
        after = edges[1:] + len(ends) * np.arange(len(each))
        for k, end in enumerate(ends):
            out[after + k] = end
        place = np.arange(int(edges[-1]))
        out[place + np.repeat(len(ends) * np.arange(len(each)), each)] = ids.astype(self.kind)[place + np.repeat(begin[codes] - total[:-1], own)]
        return byte_rows(out, each + len(ends))

    def encode(self, some: list[str]) -> list[bytes]:
        """The ids of each text as numbers of width bytes."""
        return self.columns(pa.array(some, pa.string())).to_pylist()


#: Marks the end of a word for tiktoken; no simple word has it.
END = b"\x01"
#: Words whose normal form is their lower case, letter by letter, and the splitter's pattern for them.
SIMPLE, SIMPLE_LINES = re.compile("[!-~À-įı-ſ]*"), re.compile("[\\n!-~À-įı-ſ]*")
_PIECE = re.compile("[a-zÀ-ÖØ-öø-ſ]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^\\sa-zÀ-ÖØ-öø-ſ0-9]+")


def blanks(file: dict) -> bool:
    """Whether texts can be cut at blanks: the normalizer keeps them apart, the splitter removes them, and no added token holds one.

    NFC composes nothing with a blank, lower-casing goes by characters, and the pattern of the splitter matches no white space.
    """
    normal = [x["type"] for x in (file.get("normalizer") or {}).get("normalizers", [])]
    split = (file.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
    matches = split[0].get("pattern", {}).get("Regex") == _SPLIT and split[0].get("behavior") == "Removed" and split[0].get("invert")
    tokens = [t for t in file.get("added_tokens", []) if t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or any(c.isspace() for c in t["content"])]
    return normal == ["NFC", "Replace", "Lowercase"] and bool(matches) and [x["type"] for x in split[1:]] == ["ByteLevel"] and not split[1]["add_prefix_space"] and not tokens


#: Fixed value: the splitter pattern of the published word-end vocabulary, none of whose alternatives matches white space.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


@cache
def words(tokenizer: str) -> Words:
    return Words(tokenizer)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", **options) -> None:
    """Writes the ids of every text and end_id into files below path, in ascending order of the documents' ids.

    Null text counts as empty: end_id alone. Null ids come first; rows of one id keep some fixed order. An empty table
    gives a table of no frequencies and no files. Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    spark.dataSource.register(TokenFiles)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), filled(F.col(text_col)).alias("text"))
    kind = words(tokenizer).kind

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = words(tokenizer)
        for batch in batches:
            for some in portions(batch, 1, PORTION):
                yield pa.RecordBatch.from_arrays([some.column(0), w.columns(some.column(1), end_id)], names=["doc_id", "ids"])

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, dtype=np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                n = np.bincount(np.frombuffer(b"".join(batch.column(0).slice(at, 512).to_pylist()), dtype=kind), minlength=len(total))
                n[: len(total)] += total
                total = n
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["id", "n"])

    table = written(rows.mapInArrow(ids, "doc_id long, ids binary").withColumn("row", F.monotonically_increasing_id()), "ids")
    # a number for each id of the vocabulary
    found = table.select("ids").mapInArrow(counts, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    dense = np.zeros(int(found["id"].max()) + 1 if len(found) else 0, dtype=np.int64)
    dense[found["id"]] = found["n"]
    write_table(path, scaled(dense))
    # rows of one id are told apart by their place, so a repeated id is no group that must stay together
    ordered = table.repartitionByRange("doc_id", "row").sortWithinPartitions("doc_id", "row").select("doc_id", "ids")
    ordered.write.format("tokens").mode("append").options(**options).option("idKind", kind).option("path", path).save()


def read_tokens(spark: SparkSession, path: str, ids: bool = False, **options) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, with ids the ids as 32-bit little-endian numbers) of the documents below path; false checksums fail the job."""
    spark.dataSource.register(TokenFiles)
    return spark.read.format("tokens").options(**options).option("path", path).option("ids", str(ids).lower()).load()


def token_round_trip(docs: DataFrame, tokenizer: str, end_id: int = 1, **columns) -> DataFrame:
    """Writes documents into new files in this application's folder and reads them back."""
    spark = docs.sparkSession
    path = f"{work_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path, tokenizer, end_id, **columns)
    return read_tokens(spark, path)
