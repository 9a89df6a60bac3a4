"""A hidden Markov language model, trained by Baum-Welch over all training texts and scored by the exact forward recursion.

Symbols: the HEAD most frequent words, the end of a text, CLASSES classes of all other known words by their ending, and
one event for all unknown words. A word outside the head has the probability of its class's symbol times its share of
the class, from the counts of the whole training corpus; the unknown event has the base model's probability in every
state. So the model is a distribution over all known words and one unseen event, like the base. Word counts, class
masses, co-occurrences and the expected counts of Baum-Welch are summed across partitions by Spark; the driver holds
only what the model's size bounds. Texts are coded once as symbol numbers and written to the shared folder, and every
text is trained on whole: no transition is cut.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_rows, distinct_words, filled, listed, portions, written

#: Size of the model: words with symbols of their own, classes of the rest, hidden states.
HEAD, CLASSES, STATES = 32_768, 1024, 8
#: Largest head: symbols are written as 16-bit numbers.
MOST_HEAD = 60_000
#: Steps of word frequency to a doubling, by which the head is cut off.
STEPS = 64
#: Words whose co-occurrence in texts starts the states off; rounds of Baum-Welch.
SEEDS, ROUNDS = 256, 3
#: Training tokens that a task gathers before it works on them; cells (texts times the longest) that it works on at once; steps whose messages it keeps.
GATHERED, CELLS, SEGMENT = 1 << 22, 1 << 20, 2048
#: Bytes of texts or symbols that a task splits or counts at once.
PORTION = 1 << 23
#: Tokens that scoring's forward recursion takes as one stretch; rows it works on at once.
STRETCH, ROWS = 512, 4096
#: Weight of the corpus distribution in each state's emissions, and of each transition, in tokens.
PRIOR, STEP_PRIOR = 1000.0, 1.0
#: Bytes of texts whose words a task counts before it passes them on; classes of endings that it remembers.
COUNTED, ENDINGS = 1 << 25, 300_000
END = b"\n"


def ending(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % CLASSES


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row is kept from training: crc32 of its id as text modulo 10 is 0; so are rows without an id."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 10 == 0


def word_counts(rows: DataFrame) -> DataFrame:
    """(word, class, c) over the texts of rows (text), the end of each text included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = 0
        for batch in batches:
            ends += batch.num_rows
            for part in portions(batch, 0, COUNTED):
                words, codes, _ = distinct_words(part.column(0))
                n = np.bincount(codes, minlength=len(words))
                yield pa.RecordBatch.from_arrays([words.cast(pa.binary()).filter(pa.array(n > 0)), pa.array(n[n > 0], pa.int64())], names=["word", "c"])
        if ends:
            yield pa.RecordBatch.from_arrays([pa.array([END], pa.binary()), pa.array([ends], pa.int64())], names=["word", "c"])

    found = rows.mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))
    return found.select("word", F.pmod(F.crc32(F.substring("word", -3, 3)), F.lit(CLASSES)).cast("int").alias("class"), "c")


def coded(docs: DataFrame, symbols: dict[bytes, int]) -> DataFrame:
    """(doc_id, held_out, n_tokens, symbols, rare) of (doc_id, held_out, text): symbol numbers as 16-bit integers, words outside the head with class and count, and for held-out texts their places."""
    shared = docs.sparkSession.sparkContext.broadcast(symbols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, end, base = shared.value.get, shared.value[END], len(shared.value)
        classes: dict[bytes, int] = {}

        def class_of(word: bytes) -> int:
            tail = word[-3:]
            if (c := classes.get(tail)) is None:
                c = classes[tail] = ending(tail)
            return c

        for batch in batches:
            for part in portions(batch, 2, PORTION):
                found, codes, n = distinct_words(part.column(2))
                found = found.cast(pa.binary())
                words = listed(found)
                symbol = np.array([get(w, -1) for w in words], dtype=np.int64)
                unlisted = symbol < 0
                for i in np.flatnonzero(unlisted).tolist():
                    symbol[i] = base + class_of(words[i])
                if len(classes) > ENDINGS:
                    classes.clear()
                row = np.repeat(np.arange(len(n)), n)
                ids = np.full(len(codes) + len(n), end, dtype="<u2")
                ids[np.arange(len(codes)) + row] = symbol[codes]
                # a row for each text and word outside the head, with the places in the order of the text
                at = np.flatnonzero(unlisted[codes])
                key = row[at] * len(words) + codes[at]
                order = np.argsort(key, kind="stable")
                at, key = at[order], key[order]
                first = np.flatnonzero(np.diff(key, prepend=-1))
                times, of, word = np.diff(first, append=len(key)), row[at[first]], codes[at[first]]
                out = part.column(1).to_numpy(zero_copy_only=False).astype(bool)
                places = at - (np.cumsum(n) - n)[row[at]]
                cuts = np.concatenate(([0], np.cumsum(np.where(out[of], times, 0))))
                at_type = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(places[out[row[at]]], pa.int32()))
                cells = pa.StructArray.from_arrays([found.take(pa.array(word)), pa.array(symbol[word] - base, pa.int32()), pa.array(times, pa.int32()), at_type], names=["word", "class", "n", "at"])
                many = np.concatenate(([0], np.cumsum(np.bincount(of, minlength=len(n)))))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n + 1, pa.int64()), byte_rows(ids, n + 1), pa.ListArray.from_arrays(pa.array(many, pa.int32()), cells)], names=["doc_id", "held_out", "n_tokens", "symbols", "rare"])

    return docs.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, symbols binary, rare array<struct<word: binary, class: int, n: int, at: array<int>>>")


def _sequences(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, dtype="<u2") for x in listed(column)]


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, row of each) of all sequences."""
    return np.frombuffer(b"".join(listed(column)), dtype="<u2"), np.repeat(np.arange(len(column)), pc.binary_length(column).to_numpy() // 2)


def co_occurrence(train: DataFrame, seeds: np.ndarray) -> np.ndarray:
    """How many texts hold both of two seed symbols."""
    n = len(seeds)
    place = np.full(1 << 16, -1)
    place[seeds] = np.arange(n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n, n))
        for batch in batches:
            for part in portions(batch, 0, PORTION):
                s, row = _flat(part.column(0))
                at = place[s]
                seen = np.zeros((part.num_rows, n), dtype=np.float32)
                seen[row[at >= 0], at[at >= 0]] = 1
                total += seen.T @ seen
        a, b = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(a * n + b), pa.array(total[a, b])], names=["cell", "n"])

    out = np.zeros(n * n)
    for cell, k in train.select("symbols").mapInArrow(run, "cell long, n double").groupBy("cell").agg(F.sum("n")).collect():
        out[cell] = k
    return out.reshape(n, n)


def seed_clusters(pairs: np.ndarray, k: int, rounds: int = 30) -> np.ndarray:
    """(k, seeds): how seed words distribute in each of k clusters of words that occur together."""
    n = len(pairs)
    rows = pairs / np.maximum(1e-9, np.sqrt(np.outer(np.diag(pairs), np.diag(pairs))))
    rows = rows / np.maximum(1e-9, np.linalg.norm(rows, axis=1, keepdims=True))
    centres = [rows[0]] if n else []
    while n and len(centres) < k:  # the farthest from all so far
        centres.append(rows[int(np.argmin(np.max(rows @ np.array(centres).T, axis=1)))])
    of = np.zeros(n, dtype=int)
    for _ in range(rounds if n else 0):
        of = np.argmax(rows @ np.array(centres).T, axis=1)
        for j in range(k):
            if (of == j).any():
                c = rows[of == j].mean(axis=0)
                centres[j] = c / max(1e-9, np.linalg.norm(c))
    out = np.stack([pairs[of == j].sum(axis=0) if (of == j).any() else np.diag(pairs) for j in range(k)]) + 0.01 if n else np.ones((k, 1))
    return out / out.sum(axis=1, keepdims=True)


def _summed(counts: DataFrame, states: int, symbols: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(emission, transition, start) counts, summed across partitions."""
    emission, step, start = np.zeros((symbols, states)), np.zeros((states, states)), np.zeros(states)
    for kind, at, *x in counts.groupBy("kind", "at").agg(*[F.sum(f"s{k}") for k in range(states)]).collect():
        (emission if kind == 0 else step if kind == 1 else start[None])[at] = x
    return emission, step, start


def _counted(emission: np.ndarray, step: np.ndarray, start: np.ndarray) -> pa.RecordBatch:
    at = np.flatnonzero(emission.any(axis=1))
    kind = np.repeat([0, 1, 2], [len(at), len(step), 1])
    rows = np.concatenate((emission[at], step, start[None]))
    place = np.concatenate((at, np.arange(len(step)), [0]))
    return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(place, pa.int32()), *(pa.array(rows[:, k]) for k in range(rows.shape[1]))], names=["kind", "at", *(f"s{k}" for k in range(rows.shape[1]))])


def expected(seqs: list[np.ndarray], start: np.ndarray, step: np.ndarray, emit: np.ndarray, totals: tuple[np.ndarray, np.ndarray, np.ndarray], segment: int = SEGMENT) -> None:
    """Adds the expected counts of whole sequences, by scaled forward and backward recursions, to totals.

    Messages are kept for one segment of steps at a time: the forward pass notes those between segments, from which
    the backward pass makes each segment's again. They are of the model's precision, and scaled at each step.
    """
    order = np.argsort([-len(s) for s in seqs], kind="stable")
    lengths = np.array([len(seqs[i]) for i in order])
    longest, n, k = int(lengths[0]), len(seqs), len(start)
    obs = np.zeros((longest, n), dtype=np.uint16)
    for j, i in enumerate(order):
        obs[: lengths[j], j] = seqs[i]
    active = np.searchsorted(-lengths, -np.arange(longest), side="left")
    emission, steps, starts = totals
    onward = np.ascontiguousarray(step.T)

    def forward(low: int, high: int, before: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(emissions, messages, scales) of the steps low to high, after the messages before them; a state's sequences lie side by side."""
        width = active[low]
        alpha, scale = np.zeros((high - low, k, width), dtype=emit.dtype), np.ones((high - low, width), dtype=emit.dtype)
        b = np.empty_like(alpha)
        for t in range(low, high):
            a, i = active[t], t - low
            now = alpha[i, :, :a]
            b[i, :, :a] = emit.take(obs[t, :a], axis=0).T
            np.multiply(start[:, None] if before is None else onward @ before[:, :a], b[i, :, :a], out=now)
            now /= now.sum(axis=0, out=scale[i, :a])
            before = now
        return b, alpha, scale

    edges = [*range(0, longest, segment), longest]
    marks: list[np.ndarray | None] = [None]
    for low, high in zip(edges[:-2], edges[1:-1], strict=True):
        marks.append(forward(low, high, marks[-1])[1][-1].copy())
    beta = np.ones((k, n), dtype=emit.dtype)
    for low, high, before in zip(edges[-2::-1], edges[:0:-1], marks[::-1], strict=True):
        b, alpha, scale = forward(low, high, before)
        for t in range(high - 1, low - 1, -1):
            a, i = active[t], t - low
            alpha[i, :, :a] *= beta[:, :a]  # from here on the share of each state
            if t:
                back = b[i, :, :a] * beta[:, :a]
                back /= scale[i, :a]
                steps += step * ((alpha[i - 1, :, :a] if i else before[:, :a]) @ back.T)
                beta[:, :a] = step @ back
        if not low:
            starts += alpha[0].sum(axis=1, dtype=np.float64)
        where = obs[low:high, : alpha.shape[2]].ravel().astype(np.int64)
        for j in range(k):  # cells beyond a sequence's end weigh nothing
            emission[:, j] += np.bincount(where, weights=alpha[:, j].ravel(), minlength=len(emission))


def batched(seqs: list[np.ndarray]) -> Iterator[list[np.ndarray]]:
    """The sequences, longest first, in batches of about CELLS cells."""
    seqs = sorted(seqs, key=len, reverse=True)
    at = 0
    while at < len(seqs):
        n = max(1, CELLS // len(seqs[at]))
        yield seqs[at : at + n]
        at += n


def baum_welch(train: DataFrame, start: np.ndarray, step: np.ndarray, emit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The expected (emission, transition, start) counts of all training texts."""
    symbols, states = emit.shape
    shared = train.sparkSession.sparkContext.broadcast((start, step, emit))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, step, emit = (x.astype(np.float32) for x in shared.value)
        totals = np.zeros((symbols, states)), np.zeros((states, states)), np.zeros(states)
        held, size = [], 0
        for batch in batches:
            for s in _sequences(batch.column(0)):
                held.append(s)
                size += len(s)
                if size > GATHERED:
                    for part in batched(held):
                        expected(part, start, step, emit, totals)
                    held, size = [], 0
        for part in batched(held):
            expected(part, start, step, emit, totals)
        yield _counted(*totals)

    return _summed(train.select("symbols").mapInArrow(run, "kind int, at int, " + ", ".join(f"s{k} double" for k in range(states))), states, symbols)


def first_counts(train: DataFrame, seeds: np.ndarray, clusters: np.ndarray, symbols: int) -> np.ndarray:
    """Emission counts to begin with: each text's symbols, shared among the states by how well its seed words fit their clusters."""
    states = len(clusters)
    place = np.full(1 << 16, -1)
    place[seeds] = np.arange(len(seeds))
    log = np.log(clusters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((symbols, states))
        for batch in batches:
            for part in portions(batch, 0, PORTION):
                s, row = _flat(part.column(0))
                at = place[s]
                n = np.bincount(row[at >= 0] * len(seeds) + at[at >= 0], minlength=part.num_rows * len(seeds)).reshape(part.num_rows, -1)
                fit = n @ log.T if len(seeds) else np.zeros((part.num_rows, states))
                fit = np.exp(fit - fit.max(axis=1, keepdims=True))
                fit /= fit.sum(axis=1, keepdims=True)
                for k in range(states):
                    total[:, k] += np.bincount(s, weights=fit[row, k], minlength=symbols)
        yield _counted(total, np.zeros((states, states)), np.zeros(states))

    return _summed(train.select("symbols").mapInArrow(run, "kind int, at int, " + ", ".join(f"s{k} double" for k in range(states))), states, symbols)[0]


def log_likelihoods(seqs: list[np.ndarray], start: np.ndarray, step: np.ndarray, emit: np.ndarray) -> np.ndarray:
    """The natural log of the probability of each whole sequence, by the scaled forward recursion.

    Long sequences are taken in stretches side by side: a later stretch runs from every state it may begin in, and
    the results are chained, which is the same sum.
    """
    k = len(start)
    onward = np.ascontiguousarray(step.T)
    rows: list[tuple[np.ndarray, int]] = []  # symbols, and the state before them, or -1 at a text's start
    place = []
    for s in seqs:
        place.append(len(rows))
        rows.append((s[:STRETCH], -1))
        rows += [(s[at : at + STRETCH], j) for at in range(STRETCH, len(s), STRETCH) for j in range(k)]
    final, scale = np.zeros((len(rows), k)), np.zeros(len(rows))
    by_length = sorted(range(len(rows)), key=lambda i: -len(rows[i][0]))
    for at in range(0, len(rows), ROWS):
        own = by_length[at : at + ROWS]
        lengths = np.array([len(rows[i][0]) for i in own])
        obs = np.zeros((int(lengths[0]), len(own)), dtype=np.int64)
        for j, i in enumerate(own):
            obs[: lengths[j], j] = rows[i][0]
        active = np.searchsorted(-lengths, -np.arange(len(obs)), side="left")
        before = np.array([rows[i][1] for i in own])
        now = np.ascontiguousarray(np.where(before[:, None] < 0, start, step[np.maximum(before, 0)]).T)
        logs = np.zeros(len(own))
        for t in range(len(obs)):
            a = active[t]
            v = (onward @ now[:, :a] if t else now[:, :a]) * emit.take(obs[t, :a], axis=0).T
            z = v.sum(axis=0)
            np.divide(v, z, out=now[:, :a])
            logs[:a] += np.log(z)
        final[own], scale[own] = now.T, logs
    out = np.zeros(len(seqs))
    for i, s in enumerate(seqs):
        r = place[i]
        v, total = final[r], scale[r]
        for q in range(r + 1, r + 1 + k * (max(0, len(s) - 1) // STRETCH), k):
            top = scale[q : q + k].max()
            v = (v * np.exp(scale[q : q + k] - top)) @ final[q : q + k]
            z = v.sum()
            v, total = v / z, total + top + math.log(z)
        out[i] = total
    return out


def _normal(x: np.ndarray) -> np.ndarray:
    return x / x.sum(axis=-1, keepdims=True)


def emissions(counts: np.ndarray, corpus: np.ndarray) -> np.ndarray:
    """(symbols, states) probabilities: counts smoothed by the corpus distribution; the last symbol, the unknown event, as in the corpus."""
    x = counts[:-1] + PRIOR * corpus[:-1, None]
    total = x.sum(axis=0)
    return np.concatenate((x / np.where(total > 0, total, 1) * (1 - corpus[-1]), np.full((1, counts.shape[1]), corpus[-1])))


def headed(words: DataFrame, head: int) -> tuple[list[tuple[bytes, int]], DataFrame]:
    """(the head most frequent words with their counts, the other words): of equal counts those of least hash.

    The driver sees the sizes of frequency steps and the head alone.
    """
    step, hashed = F.floor(F.log2("c") * STEPS), F.xxhash64("word")
    sizes = sorted(((int(r[0]), int(r[1])) for r in words.groupBy(step).count().collect()), reverse=True)
    above = np.cumsum([n for _, n in sizes])
    over = next((f for (f, _), n in zip(sizes, above, strict=True) if n > head), -math.inf)  # the step that doesn't fit as a whole
    top = words.where(step > F.lit(float(over))).select("word", "c").collect()
    tail = words.where(step < F.lit(float(over)))
    if over > -math.inf:
        key = F.struct((-F.col("c")).alias("c"), hashed.alias("h"), "word")
        some = words.where(step == F.lit(float(over))).withColumn("_key", key)
        more = some.orderBy("_key").limit(head - len(top)).select("word", "c", "_key").collect()
        top += [(r[0], r[1]) for r in more]
        if more:
            c, h, word = more[-1][2]
            some = some.where(F.col("_key") > F.struct(F.lit(c).cast("long").alias("c"), F.lit(h).cast("long").alias("h"), F.lit(bytearray(word)).alias("word")))
        tail = tail.unionByName(some.drop("_key"))
    return sorted(((bytes(r[0]), int(r[1])) for r in top), key=lambda x: (-x[1], x[0])), tail


def unknown_places(code: DataFrame, counts: DataFrame) -> DataFrame:
    """(row, unknown): the places of words that training has not seen, of the held-out rows that have some."""
    rare = code.where("held_out").select("row", F.explode("rare").alias("x")).select("row", "x.word", "x.at")
    rare = rare.join(counts.select(F.col("word").alias("_word")), F.col("word") == F.col("_word"), "left_anti")
    return rare.groupBy("row").agg(F.flatten(F.collect_list("at")).alias("unknown"))


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", head: int = HEAD, states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row; see the module for the model.

    Learns from all rows that aren't held_out(). Words: runs of other than ASCII white space, A-Z lower-cased; the end of
    a text is one more token. base_score: log10 of the smoothed unigram probability. Null text counts as empty, which is its end alone.
    Repeated rows each count in training. Words of equal count enter the head by their hash, so a flat vocabulary fills it too.
    Without training rows every token has the unseen event's probability, and both scores are 0. An empty table gives
    no rows; other columns are ignored, whatever their names. head: at most MOST_HEAD.
    """
    if not 0 < head <= MOST_HEAD:
        raise ValueError(f"head must be 1 to {MOST_HEAD}")
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), filled(F.col(text_col)).alias("text"))
    counts = written(word_counts(rows.where("not held_out").select("text")), "word-counts")
    total, distinct = (int(x or 0) for x in counts.agg(F.sum("c"), F.count("*")).first())
    scale = total + 0.1 * (distinct + 1)

    top, tail = headed(counts.where(F.col("word") != F.lit(END)), head)
    ends = counts.where(F.col("word") == F.lit(END)).select("c").first()
    top.append((END, int(ends[0]) if ends else 0))
    symbols = {w: i for i, (w, _) in enumerate(top)}
    n_symbols = len(top) + CLASSES + 1
    # the classes' masses, in counts, are those of the words outside the head
    mass = np.zeros(CLASSES)
    for j, m in tail.groupBy("class").agg(F.sum(F.col("c") + F.lit(0.1))).collect():
        mass[j] = m
    corpus = np.concatenate(([c + 0.1 for _, c in top], mass, [0.1]))
    if not ends:
        corpus[len(top) - 1] = 0  # unknown like all else
    corpus = _normal(corpus)

    code = written(coded(rows, symbols).withColumn("row", F.monotonically_increasing_id()), "coded")
    train = code.where("not held_out")
    seeds = np.arange(min(SEEDS, len(top) - 1))
    clusters = seed_clusters(co_occurrence(train, seeds), states)
    emit = emissions(first_counts(train, seeds, clusters, n_symbols), corpus)
    step, start = _normal(np.full((states, states), 0.1 / states) + 0.9 * np.eye(states)), np.full(states, 1 / states)
    for _ in range(rounds):
        emission, steps, starts = baum_welch(train, start, step, emit)
        emit = emissions(emission, corpus)
        step, start = _normal(steps + STEP_PRIOR), _normal(starts + STEP_PRIOR)
    if not ends:
        emit[len(top) - 1] = emit[-1]

    base = np.array([math.log10((c + 0.1) / scale) for _, c in top])
    shared = spark.sparkContext.broadcast((start, step, emit, base, np.array([c > 0 for _, c in top])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, step, emit, base, seen = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                seqs = _sequences(part.column(4))
                own = [s[s < len(base)] for s in seqs]
                for i, places in enumerate(part.column(5).to_pylist()):
                    if places:
                        seqs[i] = seqs[i].copy()
                        seqs[i][places] = len(emit) - 1
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(k) for k in range(4)), pa.array([int(seen[s].sum()) for s in own], pa.int64()), pa.array([float(base[s].sum()) for s in own]), pa.array(log_likelihoods(seqs, start, step, emit) / math.log(10))],
                    names=["row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"],
                )

    columns = ["row", "doc_id", "held_out", "n_tokens", "symbols"]
    unknown = unknown_places(code, counts).select(F.col("row").alias("_row"), "unknown")
    coding = train.select(*columns, F.lit(None).cast("array<int>").alias("unknown")).unionByName(code.where("held_out").select(*columns).join(unknown, F.col("row") == F.col("_row"), "left").select(*columns, "unknown"))
    scored = coding.mapInArrow(run, "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")

    # words outside the head: their counts are joined, and their logs summed by text; unknown ones are whole in the score already
    masses = spark.createDataFrame([(j, float(mass[j])) for j in range(CLASSES)], "_class int, mass double")
    known = tail.join(F.broadcast(masses), F.col("class") == F.col("_class")).select(F.col("word").alias("_word"), "c", F.log10((F.col("c") + 0.1) / F.col("mass")).alias("share"))
    # hash tables of a partition's distinct words, each once, in place of a sort of all occurrences
    rare = code.select("row", F.explode("rare").alias("x")).select("row", "x.word", "x.n").join(known.hint("shuffle_hash"), F.col("word") == F.col("_word"), "left")
    n = F.col("n")
    rare = rare.groupBy("row").agg(F.sum(F.when(F.col("c").isNotNull(), n).otherwise(0)).alias("k"), F.sum(n * F.log10((F.coalesce("c", F.lit(0)) + 0.1) / F.lit(scale))).alias("b"), F.sum(n * F.coalesce("share", F.lit(0.0))).alias("s")).select(F.col("row").alias("_row"), "k", "b", "s")
    out = scored.join(rare, F.col("row") == F.col("_row"), "left")
    plus = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    return out.select("doc_id", "held_out", "n_tokens", plus("n_known", "k").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), plus("base_score", "b").alias("base_score"), plus("score", "s").alias("score"))
