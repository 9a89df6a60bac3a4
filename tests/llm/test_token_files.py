"""Token files: coding, checkpoints and checksums, and the round trip against the library and plain sums."""

import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from cases import EDGE, clashing, empty, table
from hypothesis import given, settings
from hypothesis import strategies as st

from touchline.llm import token_files as tf

tokenizers = pytest.importorskip("tokenizers")
P = pytest.importorskip("public_tokenizers")
TOKENIZER = str(P.path("word_bpe_49k.json"))


@pytest.mark.parametrize("n,vocabulary,segment", [(0, 5, 100), (1, 5, 100), (63, 5, 100), (5000, 3000, 700), (200_000, 40_000, 1 << 14), (70_000, 1, 1 << 12)])
def test_coding(n, vocabulary, segment):
    rng = np.random.default_rng(n + vocabulary)
    ids = np.minimum(rng.zipf(1.3, n) - 1, vocabulary - 1).astype(np.uint32)
    counts = np.bincount(ids, minlength=vocabulary)
    f = tf.scaled(counts)
    assert f.sum() == (1 << tf.SCALE if n else 0) and ((f > 0) == (counts > 0)).all()
    t = tf.Table(f)
    c = tf.encoded(ids, t, segment)
    for k in reversed(range(len(c.steps))):  # each segment alone
        part = tf.decoded(c, t, k)
        low = int(c.steps[k]) * c.lanes
        assert np.array_equal(part, ids[low : low + len(part)])
    assert sum(len(tf.decoded(c, t, k)) for k in range(len(c.steps))) == n
    if n > 100_000:
        p = counts[counts > 0] / n
        assert c.words.nbytes * 8 < 1.02 * n * -(p * np.log2(p)).sum() + 64 * c.lanes


def test_falsified_blocks_are_found():
    ids = np.arange(5000, dtype=np.uint32) % 50
    t = tf.Table(tf.scaled(np.bincount(ids)))
    data, _ = tf.block_bytes([(1, ids)], t)
    docs, lengths, c = tf.parsed(data)
    assert docs == [1] and lengths.tolist() == [5000]
    broken = bytearray(data)
    broken[-3] ^= 1
    with pytest.raises(ValueError):
        tf.parsed(bytes(broken))
    c.words = c.words.copy()
    c.words[0] ^= 1
    with pytest.raises(ValueError):
        tf.decoded(c, t, 0)


PIECES = st.sampled_from(["a", "B", "É", "é", "İ", "Σ", "ΟΔΟΣ", "ß", "́", " ", "\n", "\t", "\r\n", " ", " ", "\x1c", "\x85", "<|endoftext|>", "<|startoftext|>", "'s", "don't", "12", "数据", "🙂", "word", "!?", "K", "ᄀ", "ᅡ", "가"])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.one_of(PIECES, st.text(max_size=3)), max_size=12).map("".join), max_size=5))
def test_words_equal_the_library(some):
    some = [t.encode("utf-8", "ignore").decode() for t in some]
    plain = tokenizers.Tokenizer.from_file(TOKENIZER)
    w = tf.words(TOKENIZER)
    assert w.apart
    assert [np.frombuffer(x, w.kind).tolist() for x in w.encode(some)] == [plain.encode(t, add_special_tokens=False).ids for t in some]


def test_simple_words_equal_the_library():
    """Every token of the vocabulary as a word and with another letter, and random words of the letters that go through tiktoken."""
    plain, w, rng = tokenizers.Tokenizer.from_file(TOKENIZER), tf.Words(TOKENIZER), random.Random(6)
    back = {c: b for b, c in zip([*range(33, 127), *range(161, 173), *range(174, 256)], [chr(b) for b in [*range(33, 127), *range(161, 173), *range(174, 256)]], strict=True)}
    own = [bytes(back[c] for c in t.removesuffix("</w>") if c in back).decode("utf-8", "ignore") for t in plain.get_vocab()]
    letters = "etaoinshrdlucéèàßøſÉÄabcxyz0123456789.,'!-÷×"
    own += [rng.choice(letters) + t for t in own] + ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 25))) for _ in range(20_000)]
    own = [t for t in dict.fromkeys(own) if t.isprintable() and " " not in t]
    assert sum(bool(tf.SIMPLE.fullmatch(t)) for t in own) > 90_000
    want = [e.ids for e in plain.encode_batch(own, add_special_tokens=False)]
    wrong = [(t, a, b) for t, a, b in zip(own, want, (np.frombuffer(x, w.kind).tolist() for x in w.encode(own)), strict=True) if a != b]
    assert not wrong, (len(wrong), wrong[:5])


def brute(rows):
    plain = tokenizers.Tokenizer.from_file(TOKENIZER)
    own = {t: [*plain.encode(t or "", add_special_tokens=False).ids, 1] for t in {t for _, t in rows}}
    digest = lambda ids: zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))
    return {t: (len(x), digest(x)) for t, x in own.items()}


def held(got, rows):
    """Positions run on without a gap, in ascending order of ids, with the right ids of each document."""
    want, by = brute(rows), Counter()
    for i, t in rows:
        by[i, *want[t]] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == by
    at, last = 0, None
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        assert last is None or (r.doc_id is not None and r.doc_id >= last)
        at, last = at + r.n_tokens, r.doc_id


def test_round_trip(spark, tmp_path):
    rng = random.Random(2)
    rows = [*EDGE, *((i, " ".join(rng.choice(["tea", "coffee", "milk"]) + str(rng.randrange(30)) for _ in range(rng.randrange(60)))) for i in range(100, 400))]
    rng.shuffle(rows)
    got = tf.token_round_trip(clashing(spark, rows).repartition(3), TOKENIZER).collect()
    held(got, rows)


def test_small_blocks_and_files(spark, tmp_path, monkeypatch):
    rng = random.Random(4)
    rows = [(i % 150, " ".join(rng.choice("abcdefg") * rng.randrange(1, 4) for _ in range(rng.choice([0, 3, 40, 4000])))) for i in range(200)]
    path = str(tmp_path / "tokens")
    tf.write_tokens(table(spark, rows).repartition(4), path, TOKENIZER, 1, blockIds=500, maxFileBytes=20_000)
    df = tf.read_tokens(spark, path, ids=True, checkpoints=1)
    assert df.rdd.getNumPartitions() > 8
    got = df.collect()
    held(got, rows)
    assert all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.n_tokens for r in got)


@pytest.mark.parametrize("segment", [64, 300, 1000])
def test_documents_over_several_checkpoints(segment):
    rng = np.random.default_rng(segment)
    docs = [(k, rng.integers(0, 90, n).astype(np.uint32)) for k, n in enumerate([0, 5, 3000, 1, 0, 700, 2500, 12, 0])]
    ids = np.concatenate([d for _, d in docs])
    t = tf.Table(tf.scaled(np.bincount(ids)))
    original = tf.encoded
    tf.encoded = lambda ids, t: original(ids, t, segment)
    try:
        data, checkpoints = tf.block_bytes(docs, t)
    finally:
        tf.encoded = original
    reader = tf._Reader.__new__(tf._Reader)
    reader.names = ["doc_id", "start", "n_tokens", "ids"]
    for width in (1, 2, 100):
        got = [r for k in range(0, checkpoints, width) for r in reader._block(data, t, 10, k, k + width)]
        assert [(r[0], r[2], r[3]) for r in got] == [(k, len(d), d.astype("<u4").tobytes()) for k, d in docs]
        assert [r[1] for r in got] == [10 + sum(len(d) for _, d in docs[:k]) for k in range(len(docs))]


def test_empty(spark):
    assert tf.token_round_trip(empty(spark), TOKENIZER).count() == 0
    assert [tuple(r) for r in tf.token_round_trip(table(spark, [(5, None)]), TOKENIZER).collect()] == [(5, 0, 1, zlib.crc32(b"\1\0\0\0"))]


def test_columns_put_words_together():
    plain, w = tokenizers.Tokenizer.from_file(TOKENIZER), tf.words(TOKENIZER)
    some = ["", " ", "one", "One two\nTWO\t", "数据 one", "<|endoftext|> a", "Über ﬁ  x ", "é é"] * 3
    column = pa.array(["before", *some]).slice(1)
    want = [plain.encode(t, add_special_tokens=False).ids for t in some]
    for ends in ((), (1,), (1, 2)):
        assert [np.frombuffer(x, w.kind).tolist() for x in w.columns(column, *ends).to_pylist()] == [[*x, *ends] for x in want]
