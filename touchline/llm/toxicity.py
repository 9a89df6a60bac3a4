"""A counterfactual-regularised toxicity classifier.

A logistic model over the presence of words and word beginnings. Fitting minimises the log loss of labelled texts
plus, for labelled sentences that name a group of people, the squared change of their score when the group's term
is swapped for another or left out: so the model can lean neither on who is mentioned nor on a mention as such.

Fitting uses at most SAMPLE labelled rows (a documented bound: those whose ids have the least hashes); feature counts
over them are aggregated by Spark and at most FEATURES features are kept, and counterfactual pairs are counted by what
they change, which is identity terms alone, so what the driver holds is bounded. Every whole text is scored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filled, texts, written

#: Labelled rows that are used for fitting, at most; and features, at most.
SAMPLE, FEATURES = 20_000, 3_000
#: Fewest texts of the sample that a feature occurs in.
SUPPORT = 3
#: Least gain, half a likelihood-ratio statistic, of a feature: what chance makes of a million candidates stays below.
GAIN = 12.0
#: Weights of the counterfactual penalty and of the ridge, and steps of the fit.
COUNTERFACTUAL, RIDGE, STEPS = 1.0, 2e-5, 800
THRESHOLD = 0.7

#: A choice of terms for groups of people, swapped within their line.
IDENTITY = [
    "women men girls boys mothers fathers wives husbands",
    "woman man girl boy mother father wife husband",
    "muslims christians jews hindus buddhists atheists catholics protestants",
    "muslim christian jewish hindu buddhist atheist catholic protestant",
    "immigrants refugees foreigners natives citizens migrants",
    "gay lesbian straight bisexual transgender",
    "black white asian african european american latino arab",
    "old young elderly disabled blind deaf",
    "frauen männer mädchen jungen mütter väter",
    "muslime christen juden hindus buddhisten",
    "femmes hommes filles garçons mères pères",
    "musulmans chrétiens juifs hindous bouddhistes",
    "mujeres hombres chicas chicos madres padres",
    "musulmanes cristianos judíos hindúes budistas",
]
SWAPS: dict[bytes, bytes] = {a.encode(): b.encode() for line in IDENTITY for a, b in zip(line.split(), line.split()[1:] + line.split()[:1], strict=True)}

WORD = re.compile(rb"[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
SENTENCE = re.compile(rb"[.!?\n]+")


def lowered(text: bytes) -> bytes:
    """Lower case in all scripts."""
    return text.lower() if text.isascii() else text.decode("utf-8", "replace").lower().encode()


def features(text: bytes) -> set[bytes]:
    """The words of a text and the beginnings of its longer words, marked by a final *."""
    words = set(WORD.findall(lowered(text)))
    return words | {w[:5] + b"*" for w in words if len(w) > 5} | {w[:4] + b"*" for w in words if len(w) > 4}


def swapped(text: bytes) -> list[tuple[bytes, bytes]]:
    """(sentence, counterfactual) for the sentences that name a group: with other groups' terms, and without any."""
    out = []
    for s in SENTENCE.split(lowered(text)):
        words = WORD.findall(s)
        if any(w in SWAPS for w in words):
            whole = b" ".join(words)
            out.append((whole, b" ".join(SWAPS.get(w, w) for w in words)))
            out.append((whole, b" ".join(w for w in words if w not in SWAPS)))
    return out


def labelled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(text, toxic) of at most `sample` labelled training rows: ids whose crc32 modulo 3 isn't 1, those of the least hashes. Of rows that share an id, one counts."""
    train = labels.where("toxic is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("_id"), F.col("toxic").cast("int").alias("toxic"))
    train = train.where(F.crc32(F.col("_id").cast("string")) % 3 != 1).groupBy("_id").agg(F.max("toxic").alias("toxic"))
    # about twice the sample by the hash's value, then exactly those of the least hashes
    share = min(1.0, 2 * sample / max(1, train.count()))
    least = F.pmod(F.xxhash64("_id"), F.lit(1 << 62))
    few = train.where(least <= int(share * (1 << 62)))
    few = train if few.limit(sample).count() < sample else few
    picked = few.orderBy(least, "_id").limit(sample)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), filled(F.col("text")).alias("text")).join(F.broadcast(picked), F.col("doc_id") == F.col("_id")).groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, n_features: int = FEATURES) -> tuple[dict[bytes, float], float]:
    """(weights by feature, intercept). Without labels, or with one class only, every text gets the smoothed base rate."""
    rows = written(labelled(docs, labels, sample), "toxicity-sample")
    n, bad = (x or 0 for x in rows.agg(F.count("*"), F.sum("toxic")).first())
    base = float(np.log((bad + 0.5) / (n - bad + 0.5)))
    if not bad or bad == n:
        return {}, base

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, y in zip(texts(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                found = list(features(text))
                yield pa.RecordBatch.from_arrays([pa.array(found, type=pa.binary()), pa.array([y] * len(found), type=pa.int32())], names=["feature", "toxic"])

    counts = rows.mapInArrow(seen, "feature binary, toxic int").groupBy("feature").agg(F.count("*").alias("n"), F.sum("toxic").alias("bad")).where(F.col("n") >= SUPPORT)
    # signed root of the log-likelihood ratio of presence and label
    share = bad / n
    expected = F.col("n") * share
    part = lambda o, e: F.when(o > 0, o * F.log(o / e)).otherwise(0.0)
    gain = part(F.col("bad"), expected) + part(F.col("n") - F.col("bad"), F.col("n") - expected)
    kept = [bytes(r[0]) for r in counts.where(gain >= GAIN).orderBy(gain.desc(), "feature").limit(n_features).select("feature").collect()]
    index = {w: i for i, w in enumerate(sorted({*kept, *SWAPS}))}
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def rowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        at = lambda text: {index[w] for w in features(text) if w in index}
        for batch in batches:
            out = {"y": [], "x": [], "swaps": []}
            for text, y in zip(texts(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                out["y"].append(y)
                out["x"].append(sorted(at(text)))
                swaps: Counter = Counter()
                for a, b in swapped(text):
                    a, b = at(a), at(b)
                    swaps[tuple(sorted(b - a)), tuple(sorted(a - b))] += 1
                out["swaps"].append([{"plus": list(p), "minus": list(m), "n": k} for (p, m), k in swaps.items()])
            kinds = [pa.int32(), pa.list_(pa.int32()), pa.list_(pa.struct([("plus", pa.list_(pa.int32())), ("minus", pa.list_(pa.int32())), ("n", pa.int64())]))]
            yield pa.RecordBatch.from_arrays([pa.array(out[k], t) for k, t in zip(out, kinds, strict=True)], names=list(out))

    made = written(rows.mapInArrow(rowed, "y int, x array<int>, swaps array<struct<plus: array<int>, minus: array<int>, n: bigint>>"), "toxicity-rows")
    data = made.select("y", "x").collect()
    swaps = made.select(F.explode("swaps").alias("s")).groupBy("s.plus", "s.minus").agg(F.sum("s.n").alias("n")).orderBy("plus", "minus").collect()
    w, b = solve([r.x for r in data], np.array([r.y for r in data]), [(r.plus, r.minus) for r in swaps], len(index), times=np.array([float(r.n) for r in swaps]))
    return {f: float(w[i]) for f, i in index.items() if w[i]}, b


def solve(x: list[list[int]], y: np.ndarray, swaps: list[tuple[list[int], list[int]]], n: int, steps: int = STEPS, counterfactual: float = COUNTERFACTUAL, ridge: float = RIDGE, times: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Weights and intercept by accelerated gradient steps on mean log loss + counterfactual penalty + ridge.

    Both classes have the same weight in the loss, whatever their shares. times: how often each swap occurs, once by default.
    """
    times = np.ones(len(swaps)) if times is None else times
    y = y.astype(float)
    weight = np.where(y > 0, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    row, col = np.repeat(np.arange(len(x)), [len(r) for r in x]), np.fromiter((i for r in x for i in r), dtype=np.int64)
    srow = np.repeat(np.arange(len(swaps)), [len(p) + len(m) for p, m in swaps]) if swaps else np.zeros(0, dtype=np.int64)
    scol = np.fromiter((i for p, m in swaps for i in (*p, *m)), dtype=np.int64)
    sign = np.fromiter((s for p, m in swaps for s in (*[1.0] * len(p), *[-1.0] * len(m))), dtype=float)
    w, b = np.zeros(n), 0.0
    # a step size per weight, by the rows that it shares with others: a bound of its row of the curvature
    width = np.bincount(row, minlength=len(y)) + 1
    freq = np.bincount(col, (width * weight)[row], minlength=n) / 4
    if len(swaps):
        changed = np.bincount(srow, minlength=len(swaps))
        freq += counterfactual * 2 * np.bincount(scol, (changed * times)[srow], minlength=n) / times.sum()
    rate, brate = 1 / (freq + 2 * ridge + 1e-6), 4 / float(weight @ width)
    vw, vb, t = w.copy(), b, 1.0
    for _ in range(steps):
        z = np.bincount(row, vw[col], minlength=len(y)) + vb
        err = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) * weight
        g = np.bincount(col, err[row], minlength=n) + 2 * ridge * vw
        if len(swaps):
            d = np.bincount(srow, sign * vw[scol], minlength=len(swaps))
            g += counterfactual * 2 / times.sum() * np.bincount(scol, sign * (d * times)[srow], minlength=n)
        w2, b2 = vw - rate * g, vb - brate * err.sum()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        vw, vb = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2, b2, t2
    return w, b


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """docs with two more columns, toxicity (0 to 1) and toxic (whether it is at least THRESHOLD); all else stays as it is.

    docs needs doc_id and text, labels doc_id and toxic (0 or 1; of several labels of an id the highest counts; null
    labels and ids say nothing). Null and empty texts get the score of a text without features. Repeated rows are
    scored alike; an empty table gives no rows. Columns of docs named toxicity or toxic are replaced.
    """
    weights, base = fit(docs, labels, sample)
    shared = docs.sparkSession.sparkContext.broadcast((weights, base))

    @F.pandas_udf("double")
    def score(text):
        import pandas as pd

        weights, base = shared.value
        known = weights.keys()
        z = np.array([base + sum(weights[f] for f in sorted(features((t or "").encode()) & known)) for t in text], dtype=float)
        return pd.Series(1 / (1 + np.exp(-np.clip(z, -40, 40))))

    return docs.withColumn("toxicity", score(filled(F.col("text")))).withColumn("toxic", F.col("toxicity") >= THRESHOLD)
