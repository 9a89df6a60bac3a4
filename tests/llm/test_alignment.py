"""Cross-tokenizer alignment against plain loops over byte ranges."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from cases import EDGE, clashing, empty, table

from touchline.llm import alignment as al

tokenizers = pytest.importorskip("tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
P = pytest.importorskip("public_tokenizers")
A, B = str(P.path("byte_bpe_50k.json")), str(P.path("piece_bpe_32k.model"))
ROWS = [*EDGE, (30, "<|endoftext|> is plain text here <s>"), (31, "a▁b has the mark itself"), (32, "tabs\tand\n\nlines  two  spaces "), (33, " leading"), (34, "数据 Übermut 🙂🙂 naïve"), (35, "\x00\x01 control"), (36, "x" * 1500)]


def spans(tokens):
    at, out = 0, []
    for i, b in tokens:
        out.append((i, at, at + len(b)))
        at += len(b)
    return out


def plain(rows):
    """Per row: tokens as (id, begin, end) of both, by the libraries alone."""
    t, sp = tokenizers.Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    t.encode_special_tokens = True
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(b): b for b in printable}
    for k, b in enumerate(x for x in range(256) if x not in printable):
        back[chr(256 + k)] = b
    for _, text in rows:
        a = b = []
        if text:
            a = [(i, bytes(back[c] for c in t.id_to_token(i))) for i in t.encode(" " + text, add_special_tokens=False).ids]
            pieces = [(i, sp.id_to_piece(i)) for i in sp.encode(text)]
            b = [(i, bytes([int(x[3:-1], 16)]) if sp.is_byte(i) else x.replace("▁", " ").encode()) for i, x in pieces]
            want = (" " + text).encode()
            if b"".join(x for _, x in a) != want or b"".join(x for _, x in b) != want:
                a = b = []
        yield spans(a), spans(b)


def brute(rows):
    both = list(plain(rows))
    links = [[(x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2]] if len(a) < 5000 else sweep(a, b) for a, b in both]
    count = Counter(p for own in links for p in set(own))
    top = Counter()
    for (x, _), n in count.items():
        top[x] = max(top[x], n)
    for (i, _), (a, b), own in zip(rows, both, links, strict=True):
        cuts = sorted({x[2] for x in a} & {x[2] for x in b})
        groups, low = [], 0
        for c in cuts:
            groups.append(",".join(str(x[0]) for x in a if low < x[2] <= c) + "|" + ",".join(str(x[0]) for x in b if low < x[2] <= c)) if len(a) < 5000 else groups.append(None)
            low = c
        digest = None if None in groups else hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""
        yield i, len(a), len(b), len(cuts), len(own), sum(count[p] == top[p[0]] for p in own), sum(count[p] for p in own), digest


def sweep(a, b):
    out, j = [], 0
    for i, x, y in a:
        while b[j][2] <= x:
            j += 1
        k = j
        while k < len(b) and b[k][1] < y:
            out.append((i, b[k][0]))
            k += 1
    return out


def test_alignment_equals_plain_loops(spark):
    want = Counter(brute(ROWS))
    long = {w[:7] for w in want if w[7] is None}
    out = al.alignment(clashing(spark, ROWS).repartition(3), A, B).drop("groups").collect()
    got = Counter((*r[:7], None if tuple(r[:7]) in long else r[7]) for r in map(tuple, out))
    assert got == want
    assert any(w[1] == 0 and w[0] == 31 for w in want) and any(w[0] == 30 and w[1] > 6 for w in want)


def test_many_parts_and_flushes(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["alpha", "Βήτα", "gamma's", "δ", "12345", "x-ray", "zzzq"]) + str(rng.randrange(40)) for _ in range(30))) for i in range(60)]
    got = Counter(map(tuple, al.alignment(table(spark, rows).repartition(5), A, B, listings=False, per_bucket=8, per_part=3, links=200, fan=2).collect()))
    assert got == Counter(brute(rows))


def test_empty(spark):
    assert al.alignment(empty(spark), A, B).count() == 0
    assert {tuple(r)[1:] for r in al.alignment(table(spark, [(1, None), (2, "")]), A, B).collect()} == {(0, 0, 0, 0, 0, 0, "", "")}


@pytest.mark.parametrize("m", [1, 2, 3, 7, 100, 5000])
def test_perfect_hash_is_minimal(m):
    keys = np.random.default_rng(m).choice(1 << 40, m, replace=False).astype(np.int64)
    d = al.perfect_hash(keys)
    slots = al._placed(keys, d[(al._mix(keys, 1) % np.uint64(len(d))).astype(np.int64)].astype(np.int64), m)
    assert sorted(slots.tolist()) == list(range(m))


def test_a_strange_key_is_an_error():
    keys = np.arange(50, dtype=np.int64) * 977
    d = al.perfect_hash(keys)
    placed = np.empty_like(keys)
    placed[al._placed(keys, d[(al._mix(keys, 1) % np.uint64(len(d))).astype(np.int64)].astype(np.int64), 50)] = keys
    part = al.Part(1, 0, [d], [placed], None)
    assert sorted(part.slots(keys).tolist()) == list(range(50))
    with pytest.raises(ValueError):
        part.slots(np.array([5], dtype=np.int64))


def test_words_apart_equal_whole_texts():
    p, rng = al.pair(A, B), random.Random(5)
    letters = ["a", "B", "é", "ß", "数", "🙂", "'s", "1", "23", "--", "<|endoftext|>", "\x00", "\x1c", "ﬁ", "the", "　", "▁", "<0x0A>", "<s>", "한국", "क्षि"]
    some = ["", "a", "\n", "a\n", "a\nb", "a \nb", "a\n b", " a", "a ", "a\n\n", "\na", "A" * 3000, "\tb", *("".join(rng.choice([*letters, " ", "\n"]) for _ in range(rng.randint(1, 30))) for _ in range(2000))]
    at, (a, b) = p.encode_all(pa.array(some))
    assert len(at) > 300 and p.apart
    for i, x, y in zip(at.tolist(), a.to_pylist(), b.to_pylist(), strict=True):
        assert [v.tobytes() for v in p.encode(some[i].encode())] == [x, y], some[i]
    aligned = al.Aligned(p, *([np.frombuffer(x, dtype="<u4") for x in t.to_pylist()] for t in (a, b)))
    plain = sorted({(int(d), int(k)) for d, k in zip(aligned.doc, aligned.keys, strict=True)})
    assert sorted(k for _, k in plain) == sorted(aligned.per_document().tolist())
