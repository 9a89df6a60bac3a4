"""Pseudonyms, the language model, the toxicity classifier, BPE and WARC, each held against a plain version or an exact round trip."""

import base64
import datetime
import gzip
import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from cases import EDGE, clashing, empty, table
from pyspark.sql import functions as F

from touchline.llm import bpe, hmm, pii, warc
from touchline.llm import toxicity as tox

# Pseudonyms

VALUES = {
    "card": ["4111 1111 1111 1111", "4111-1111-1111-1111", "5500005555555559", "4111 1111 1111 1112"],
    "iban": ["DE89370400440532013000", "GB82 WEST 1234 5698 7654 32", "DE89370400440532013001"],
    "ssn": ["123-45-6789", "666-45-6789", "000-12-3456"],
    "phone": ["(415) 555-2671", "415-555-2671", "+1 415 555 2671", "115-555-2671"],
    "ip": ["192.168.1.1", "255.255.255.255", "256.1.1.1"],
    "date": ["2024-02-29", "2023-02-29", "31.12.1999", "1/2/2020", "12/31/1999", "1799-01-01"],
    "email": ["jane.doe42@example.com", "A_b-c9@mail.example.org"],
}
GOOD = {"card": 3, "iban": 2, "ssn": 1, "phone": 3, "ip": 2, "date": 4, "email": 2}


def luhn(d):
    d = [int(c) for c in d if c.isdigit()]
    return sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(reversed(d))) % 10 == 0


def iban_ok(s):
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def is_date(s):
    for f in ("%Y-%m-%d", "%d.%m.%Y", "%d/%m/%Y", "%m/%d/%Y"):
        try:
            datetime.datetime.strptime(s, f)
        except ValueError:
            continue
        return True
    return False


VALID = {
    "card": luhn,
    "iban": iban_ok,
    "ssn": lambda s: s[:3] not in ("000", "666") and s[0] != "9" and s[4:6] != "00" and s[7:] != "0000",
    "phone": lambda s: re.fullmatch("1?[2-9][0-9]{2}[2-9][0-9]{6}", re.sub("[^0-9]", "", s)) is not None,
    "ip": lambda s: all(int(x) < 256 for x in s.split(".")),
    "date": is_date,
    "email": lambda s: s.count("@") == 1,
}


def shape(s):
    return re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "0", s)))


def test_pseudonyms_stay_in_their_format(spark):
    flat = [(k, v, n < GOOD[k]) for k, vs in VALUES.items() for n, v in enumerate(vs)]
    flat = [(k, v, good if k != "date" else v not in ("2023-02-29", "1799-01-01")) for k, v, good in flat]
    rows = [(i, f"see <{v}> and again {v}, then {v}.") for i, (_, v, _) in enumerate(flat)]
    out = {r.doc_id: r for r in pii.pseudonymise(clashing(spark, rows), "k1").collect()}
    other = {r.doc_id: r.text for r in pii.pseudonymise(table(spark, rows), "k2").collect()}
    for i, (kind, v, good) in enumerate(flat):
        r = out[i].asDict()
        if not good:
            assert r["text"] == rows[i][1], v
            continue
        new = re.fullmatch(r"see <(.*?)> and again (.*), then (.*)\.", r["text"]).groups()
        assert len(set(new)) == 1 and new[0] != v and VALID[kind](new[0]), (v, new)
        assert r[f"n_{kind}"] == 3 and sum(r[f"n_{k}"] for k in pii.KINDS) == 3
        assert kind in ("date", "ip") or shape(new[0]) == shape(v)  # days and octets may have another number of digits
        assert other[i] != r["text"]


def test_cards_and_accounts_beside_other_groups(spark):
    card, iban = "4111 1111 1111 1111", "ES9121000418450200051332"
    rows = [f"{card} 12/27", "4111111111111111 123", "7 4111111111111111", f"123456 {card}", f"{card} 5500-0055-5555-5559", f"{card} 415-555-2671", f"{card} 2024-02-29", f"{iban} BIC", f"{iban} BANK NR"]
    out = [r for r in pii.pseudonymise(table(spark, list(enumerate(rows))), "k").orderBy("doc_id").collect()]
    for old, r in zip(rows, out, strict=True):
        assert card not in r.text and card.replace(" ", "") not in r.text and iban not in r.text, (old, r.text)
        assert shape(r.text) == shape(old), (old, r.text)
    assert [r.n_card for r in out] == [1, 1, 1, 1, 2, 1, 1, 0, 0] and [r.n_iban for r in out] == [0] * 7 + [1, 1]
    assert out[0].text.endswith(" 12/27") and out[3].text.startswith("123456 ") and out[5].n_phone == 1 and out[6].n_date == 1 and out[7].text.endswith(" BIC")


def plain_pseudonym(kind, v, key):
    """The same permutations by plain loops over digits, days and letters."""

    def prf(tag, i, x):
        return int(hashlib.sha256(f"{key}|{tag}|{i}|{x}".encode()).hexdigest()[:15], 16)

    def feistel(tag, l, r, nl, nr):  # noqa: E741
        for i in range(1, 9):
            if i % 2:
                l = (l + prf(tag, i, r) % nl) % nl  # noqa: E741
            else:
                r = (r + prf(tag, i, l) % nr) % nr
        return l, r

    def permuted(tag, d):
        u = len(d) // 2
        a, b = feistel(tag, int("0" + d[:u]), int(d[u:]), 10**u, 10 ** (len(d) - u))
        return str(a).zfill(u)[-u:] * (u > 0) + str(b).zfill(len(d) - u)

    def pour(form, new):
        it = iter(new)
        return "".join(next(it) if c.isalnum() else c for c in form)

    digits = "".join(c for c in v if c.isdigit())
    if kind == "card":
        body = digits[0] + permuted("card", digits[1:-1])
        return pour(v, body + next(c for c in "0123456789" if luhn(body + c)))
    if kind == "iban":
        a = v.replace(" ", "")
        new = iter(permuted("iban", "".join(c for c in a[4:] if c.isdigit())))
        rest = "".join(next(new) if c.isdigit() else c for c in a[4:])
        return pour(v, next(x for k in range(2, 99) if iban_ok(x := a[:2] + f"{k:02d}" + rest)))
    if kind == "phone" and v.startswith("+") and not v.startswith("+1 "):
        code = re.match(r"\+(\d{1,3})(?=[ .(-])", v)
        keep = (len(code[1]) if code else 2) + 1
        return pour(v, digits[:keep] + permuted("abroad", digits[keep:]))
    if kind == "phone":
        a, b = feistel("phone", int(digits[-10:-7]) - 200, int(digits[-7:]) - 2_000_000, 800, 8_000_000)
        return pour(v, f"{digits[:-10]}{a + 200}{b + 2_000_000}")
    if kind == "ssn":
        area = int(v[:3])
        a, b = feistel("ssn", area - 1 - (area > 666), (int(v[4:6]) - 1) * 9999 + int(v[7:]) - 1, 898, 99 * 9999)
        return f"{a + 1 + (a >= 665):03d}-{b // 9999 + 1:02d}-{b % 9999 + 1:04d}"
    if kind == "ip":
        p = [int(x) for x in v.split(".")]
        a, b = feistel("ip", p[0] * 256 + p[1], p[2] * 256 + p[3], 65536, 65536)
        return f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"
    if kind == "date":
        d, f = next((datetime.datetime.strptime(v, f), f) for f in ("%Y-%m-%d", "%d.%m.%Y", "%d/%m/%Y", "%m/%d/%Y") if is_date(v) and _parses(v, f))
        i = (d.date() - datetime.date(1800, 1, 1)).days
        a, b = feistel("date", i // 5411, i % 5411, 27, 5411)
        n = datetime.date(1800, 1, 1) + datetime.timedelta(days=a * 5411 + b)
        if f == "%Y-%m-%d":
            return n.isoformat()
        x, y = (n.month, n.day) if f == "%m/%d/%Y" and n.day > 12 else (n.day, n.month)
        w = [len(t) for t in re.split("[./]", v)]
        sign = "." if "." in v else "/"
        return f"{str(x).zfill(w[0])}{sign}{str(y).zfill(w[1])}{sign}{n.year}"
    local, domain = v.split("@")

    def shifted(half, other, i):
        out = ""
        for at, c in enumerate(half):
            add = prf("email", f"{i},{at}", other.lower())
            for base, n in ((48, 10), (97, 26), (65, 26)):
                if base <= ord(c) < base + n:
                    c = chr((ord(c) - base + add) % n + base)  # noqa: PLW2901
                    break
            out += c
        return out

    l, r = local[: len(local) // 2], local[len(local) // 2 :]  # noqa: E741
    for i in range(1, 5):
        l, r = (l, shifted(r, l, i)) if i % 2 else (shifted(l, r, i), r)  # noqa: E741
    return f"{l}{r}@{domain}"


def _parses(v, f):
    try:
        datetime.datetime.strptime(v, f)
    except ValueError:
        return False
    return True


def test_pseudonyms_equal_plain_permutations(spark):
    rng = random.Random(4)
    cases = [(k, v) for k, vs in VALUES.items() for v in vs if k == "date" and v not in ("2023-02-29", "1799-01-01") or k != "date" and v in vs[: GOOD[k]]]
    cases += [("date", f"{rng.randint(1, 12):02d}/{rng.randint(13, 28)}/{rng.randint(1900, 2020)}") for _ in range(20)] + [("phone", "+44 20 7946 0958"), ("phone", "+4930123456789"), ("ssn", "667-01-0001"), ("email", "JOHN.SMITH@x.org")]
    out = [r.text for r in pii.pseudonymise(table(spark, [(i, f"<{v}>") for i, (_, v) in enumerate(cases)]), "key").orderBy("doc_id").collect()]
    assert [(k, v, t[1:-1]) for (k, v), t in zip(cases, out, strict=True)] == [(k, v, plain_pseudonym(k, v, "key")) for k, v in cases]


def test_values_link_across_forms(spark):
    """A day in any order of its parts, and an address in any case, have one pseudonym; marked letters don't stay; a version is no address."""
    rows = ["1999-03-25", "25/03/1999", "25.03.1999", "03/25/1999", "john.smith@a.org", "JOHN.SMITH@a.org", "Ünal@example.com", "ver 1.2.3.4", "version 1.2.3.4", "at 1.2.3.4"]
    out = [r.text for r in pii.pseudonymise(table(spark, list(enumerate(rows))), "k").orderBy("doc_id").collect()]

    def day(t):
        return next(datetime.datetime.strptime(t, f).date() for f in ("%Y-%m-%d", "%d.%m.%Y", "%d/%m/%Y", "%m/%d/%Y") if _parses(t, f))

    assert len({day(t) for t in out[:4]}) == 1 and day(out[0]) != day(rows[0])
    assert out[4] == out[5].lower() and out[4] != rows[4] and out[5] != rows[5]
    assert out[6][0] != "Ü" and out[6].endswith("@example.com") and "nal@" not in out[6]
    assert out[7:9] == rows[7:9] and out[9] != rows[9]


def test_feistel_is_a_permutation(spark):
    pairs = spark.range(27 * 31).select(pii.feistel("k", "t", F.floor(F.col("id") / 31), F.col("id") % 31, 27, 31).alias("p")).collect()
    assert {(r.p.l, r.p.r) for r in pairs} == set(itertools.product(range(27), range(31)))


def test_equal_values_link_and_different_values_do_not(spark):
    rows = [(i, f"call 415-555-{i:04d} now") for i in range(300)] + [(i + 300, f"or 415-555-{i:04d}") for i in range(300)]
    new = {r.doc_id: re.search(r"\d{3}-\d{3}-\d{4}", r.text)[0] for r in pii.pseudonymise(table(spark, rows), "k").collect()}
    assert all(new[i] == new[i + 300] for i in range(300)) and len(set(new.values())) == 300


def test_pseudonyms_of_odd_rows(spark):
    df = clashing(spark, EDGE)
    got = pii.pseudonymise(df, "k")
    assert Counter((r.doc_id, r.text, r.n_card) for r in got.collect()) == Counter((i, t, 0) for i, t in EDGE)
    assert got.columns[: len(df.columns)] == df.columns and pii.pseudonymise(empty(spark), "k").count() == 0


# Language model


def random_model(rng, states, symbols):
    return rng.dirichlet(np.ones(states)), rng.dirichlet(np.ones(states), states), rng.dirichlet(np.ones(symbols), states).T.copy()


def test_forward_recursion_sums_over_all_paths(monkeypatch):
    start, step, emit = random_model(np.random.default_rng(0), 3, 5)
    seqs = [np.array(s) for s in ([0], [1, 4], [2, 2, 0, 1, 3, 4], [4, 3, 2, 1, 0, 1, 2])]
    plain = [math.log(sum(start[p[0]] * emit[s[0], p[0]] * math.prod(step[a, b] * emit[x, b] for a, b, x in zip(p, p[1:], s[1:], strict=False)) for p in itertools.product(range(3), repeat=len(s)))) for s in seqs]
    assert np.allclose(hmm.log_likelihoods(seqs, start, step, emit), plain)
    monkeypatch.setattr(hmm, "STRETCH", 2)  # whole sequences in chained stretches
    assert np.allclose(hmm.log_likelihoods(seqs, start, step, emit), plain)


@pytest.mark.parametrize("segment", [1, 2, 3, 4096])
def test_expected_counts_are_posteriors(segment):
    start, step, emit = random_model(np.random.default_rng(1), 2, 4)
    seqs = [np.array([0, 3, 1]), np.array([2]), np.array([1, 1, 0, 2])]
    totals = np.zeros((4, 2)), np.zeros((2, 2)), np.zeros(2)
    hmm.expected(seqs, start, step, emit, totals, segment)
    want = np.zeros((4, 2)), np.zeros((2, 2)), np.zeros(2)
    for s in seqs:
        paths = {p: start[p[0]] * emit[s[0], p[0]] * math.prod(step[a, b] * emit[x, b] for a, b, x in zip(p, p[1:], s[1:], strict=False)) for p in itertools.product(range(2), repeat=len(s))}
        z = sum(paths.values())
        for p, w in paths.items():
            want[2][p[0]] += w / z
            for x, k in zip(s, p, strict=True):
                want[0][x, k] += w / z
            for a, b in zip(p, p[1:], strict=False):
                want[1][a, b] += w / z
    for a, b in zip(totals, want, strict=True):
        assert np.allclose(a, b)


def topical(n, seed=0):
    rng = random.Random(seed)
    topics = [[f"{t}{k}" for k in range(40)] for t in ("sea", "sky", "town")]
    out = []
    for i in range(n):
        topic = topics[i % 3]
        out.append((i, " ".join(rng.choice(topic) if rng.random() < 0.9 else rng.choice(rng.choice(topics)) for _ in range(rng.randint(20, 120)))))
    return out


def test_scores(spark):
    rows = topical(240) + EDGE
    got = hmm.score(clashing(spark, rows), head=60, states=3).collect()
    held = lambda i: zlib.crc32(str(i).encode() if i is not None else b"") % 10 == 0
    split = lambda t: [*(t or "").encode().lower().split(), None]
    count = Counter(w for i, t in rows if not held(i) for w in split(t))
    total = sum(count.values())
    base = lambda t: sum(math.log10((count[w] + 0.1) / (total + 0.1 * (len(count) + 1))) for w in split(t))
    want = sorted((str(i), held(i), len(split(t)), sum(count[w] > 0 for w in split(t)), total, round(base(t), 6)) for i, t in rows)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    ours = [r for r in got if r.doc_id is not None and r.doc_id < 240 and r.held_out]
    assert sum(r.score for r in ours) > sum(r.base_score for r in ours)  # states know the topic, single words don't


def test_scores_without_training_rows(spark):
    out = [i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0]
    got = hmm.score(table(spark, [(i, "a b") for i in out])).collect()
    assert len(got) == len(out) and all(r.train_tokens == 0 and r.base_score == 0 and abs(r.score) < 1e-9 for r in got)
    assert hmm.score(empty(spark)).count() == 0


@pytest.mark.parametrize("head", [100, 4000, hmm.HEAD])
def test_scores_of_a_flat_vocabulary(spark, head):
    """Words of equal count fill the head by their hash, and unknown words have the base's probability: texts of once-only words score as the base does."""
    rows = [(i, " ".join(f"only{i}x{k}" for k in range(20))) for i in range(400)]
    got = hmm.score(table(spark, rows), head=head, states=3).collect()
    assert all(abs(r.score - r.base_score) < 0.5 for r in got if r.held_out)
    assert sum(r.score for r in got if not r.held_out) > sum(r.base_score for r in got if not r.held_out) - 0.02 * len(got)
    words = spark.createDataFrame([(f"w{k}".encode(), 0, 3 if k < 5 else 2) for k in range(50)], "word binary, class int, c long")
    top, tail = hmm.headed(words, 20)
    assert len(top) == 20 and [c for _, c in top] == [3] * 5 + [2] * 15
    assert {w for w, _ in top} | {bytes(r.word) for r in tail.collect()} == {f"w{k}".encode() for k in range(50)} and tail.count() == 30


# Toxicity


def labelled_texts():
    """Abuse names groups more often than other texts do."""
    rng = random.Random(7)
    filler = [f"filler{k}" for k in range(200)]
    rows, labels = [], []
    for i in range(900):
        bad = i % 3 == 0
        w = [rng.choice(filler) for _ in range(30)]
        w.insert(5, rng.choice(["vermin", "scum", "filth"]) if bad else rng.choice(["lovely", "gentle", "bright"]))
        if rng.random() < (0.8 if bad else 0.15):
            w.insert(9, rng.choice(["women", "muslims", "immigrants", "gay"]))
        rows.append((i, " ".join(w) + "."))
        labels.append((i, int(bad)))
    return rows, labels


def test_toxicity_generalises_and_leaves_neutral_mentions_alone(spark):
    rows, labels = labelled_texts()
    fresh = [(5000 + i, f"filler1 the {g} filler2 gentle filler3 home filler4.") for i, g in enumerate(["women", "muslims", "immigrants", "gay", "men", "cats"])]
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r for r in tox.toxicity(clashing(spark, rows + fresh), lab).collect()}
    held = [(i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    right = sum(got[i].toxic == bool(y) for i, y in held)
    assert len(held) > 200 and right >= 0.97 * len(held)
    scores = [got[i].toxicity for i, _ in fresh]
    assert max(scores) < tox.THRESHOLD and max(scores) - min(scores) < 0.05


def test_held_out_labels_teach_nothing(spark):
    rows, labels = labelled_texts()
    flipped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, y in labels]
    df = table(spark, rows)
    a, b = ({r.doc_id: r.toxicity for r in tox.toxicity(df, spark.createDataFrame(x, "doc_id long, toxic int")).collect()} for x in (labels, flipped))
    assert a == b


def test_counted_swaps_weigh_as_often_as_they_occur():
    x, y = [[0], [0, 1], [1], [2]], np.array([1, 1, 0, 0])
    swaps = [([1], [0]), ([1], [0]), ([2], [1])]
    a, b = tox.solve(x, y, swaps, 3), tox.solve(x, y, [([1], [0]), ([2], [1])], 3, times=np.array([2.0, 1.0]))
    assert np.allclose(a[0], b[0]) and math.isclose(a[1], b[1], rel_tol=1e-6)


def test_the_sample_is_exact_whatever_the_number_of_labels(spark):
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    n = sum(zlib.crc32(str(i).encode()) % 3 != 1 for i in range(500))
    assert [tox.labelled(docs, labels, k).count() for k in (1, 7, 100, 1000)] == [1, 7, 100, n]
    assert tox.features("MÜNCHEN Élan".encode()) >= {"münchen".encode(), "élan".encode()}


def test_counterfactual_penalty_shrinks_identity_weights():
    x = [[0, 1]] * 30 + [[1]] * 2 + [[2]] * 30 + [[1, 2]] * 2
    y = np.array([1] * 32 + [0] * 32)
    free, _ = tox.solve(x, y, [([3], [1])] * 20, 4, counterfactual=0.0)
    held, _ = tox.solve(x, y, [([3], [1])] * 20, 4, counterfactual=1.0)
    assert abs(held[1] - held[3]) < 0.2 * abs(free[1] - free[3]) and held[0] > 0


def test_toxicity_of_odd_rows(spark):
    lab = spark.createDataFrame([(1, 1), (4, 0), (None, 1), (6, None), (99, 1)], "doc_id long, toxic int")
    got = tox.toxicity(clashing(spark, EDGE), lab).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in EDGE) and all(0 <= r.toxicity <= 1 for r in got)
    nothing = spark.createDataFrame([], "doc_id long, toxic int")
    assert tox.toxicity(table(spark, EDGE), nothing).select("toxicity").distinct().count() == 1
    assert tox.toxicity(empty(spark), lab).count() == 0


# BPE


@pytest.fixture(scope="module")
def tokenizer():
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = str(P.path("byte_bpe_50k.json"))
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return path, t


def awkward():
    rng = random.Random(8)
    bits = ["don't", " we'll", "  ", "\n\n", "\t", " ", "数据", "🙂", "ſ", "<|endoftext|>", "<|endof", "1234567", "!!!", "ABC", "é", " ", "　", "word ", "the ", "'s", "\r\n", "\x00"]
    passages = ["".join(rng.choice(bits) for _ in range(1500)) for _ in range(3)]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(1, 400)))) for i in range(30)]
    for i in range(30, 60):
        p = rng.choice(passages)
        a = rng.randint(0, len(p) // 2)
        rows.append((i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) + p[a : a + 4000] + "".join(rng.choice(bits) for _ in range(rng.randint(0, 40)))))
    return rows + [(60, "a" * 30_000), (61, "a" * 30_000 + "b"), (62, " " * 20_000 + "x"), (63, passages[0]), (64, passages[0]), (65, passages[0] * 3)]


def test_bpe_equals_the_library(spark, tokenizer):
    path, t = tokenizer
    rows = EDGE + awkward()
    got = bpe.encode_decode(clashing(spark, rows), path).collect()
    want = []
    for i, x in rows:
        ids = t.encode(x or "", add_special_tokens=False).ids
        text = t.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), tuple(ids), text, hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert Counter((r.doc_id, r.n_tokens, tuple(r.ids), r.decoded, r.ids_sha256, r.decoded_sha256) for r in got) == Counter(want)
    assert bpe.encode_decode(empty(spark), path).count() == 0


def test_bpe_joints_are_repaired(tokenizer):
    """Every chunk is taken as known, so all tokens stand at a joint or beside one."""
    path, t = tokenizer
    c = bpe.codec(path)
    for _, x in awkward():
        doc = x.encode()
        bounds = bpe.chunk_bounds([doc])[0]
        keys = bpe.chunk_keys(doc, bounds)
        known = {k: np.array(c.encode(doc[a:b])) for k, a, b in zip(keys, bounds, bounds[1:], strict=False)}
        assert bpe.assembled(c, doc, bounds, keys, known).tolist() == t.encode(x, add_special_tokens=False).ids


# WARC


def page_rows():
    big = "<p>" + "same " * 400 + "</p>"
    return [(1, "http://a/1", big), (2, "http://a/2", big), (3, None, big), (3, None, big), (4, "http://b", "small"), (5, "http://b", "small"), (6, "http://c", None), (7, "http://d\r\nX: y", ""), (None, "http://e", big), (8, "http://f", "é" * 500), (9, "http://f", "é" * 500), (10, "http://g", "x" * 999), (11, "http://g", "x" * 999), (12, "http://h", "WARC/1.1\r\n\r\n" * 90)]


def test_warc_round_trip(spark):
    rows = page_rows()
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("payload", "_digest", "refers_to", "_last")})
    last = {}
    for i, _, h in rows:
        if len((h or "").encode()) >= 1000 and i is not None:
            last[h] = max(i, last.get(h, i))
    want = Counter()
    for i, _, h in rows:
        data = (h or "").encode()
        refers = last.get(h) if last.get(h) != i else None
        want[i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if refers else "response", refers] += 1
    got = warc.warc_round_trip(df).collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    assert warc.warc_round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_warc_payloads_and_members(spark, tmp_path):
    df = spark.createDataFrame(page_rows(), "page_id long, url string, html string").coalesce(1)
    warc.write_warc(df, str(tmp_path / "w"))
    got = warc.read_warc(spark, str(tmp_path / "w"), payload=True).where("record_type = 'response'").collect()
    assert {r.page_id: bytes(r.payload).decode() for r in got if r.page_id} == {i: h or "" for i, _, h in page_rows() if i not in (None, 1, 2, 8)}
    data = b"".join(p.read_bytes() for p in sorted((tmp_path / "w").glob("*.warc.gz")))
    members = 0
    while data:
        z = zlib.decompressobj(31)
        assert z.decompress(data).startswith(b"WARC/1.1\r\n") and z.eof
        data, members = z.unused_data, members + 1
    files = len(list((tmp_path / "w").glob("*.warc.gz")))
    assert members == len(page_rows()) + files  # a member per record, and one warcinfo per file


def changed(payload, digest=None, length=None, http_length=None):
    sha = base64.b32encode(hashlib.sha1(payload if digest is None else digest).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Length: {len(payload) if http_length is None else http_length}\r\n\r\n".encode()
    body = http + payload
    n = len(body) if length is None else length
    return gzip.compress(f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <x>\r\nWARC-Payload-Digest: sha1:{sha}\r\nContent-Length: {n}\r\n\r\n".encode() + body + b"\r\n\r\n")


@pytest.mark.parametrize("data", [changed(b"abc", digest=b"abd"), changed(b"abc", length=5), changed(b"abc", length=500), changed(b"abc", http_length=9), changed(b"abc")[:-12], b"no gzip"])
def test_warc_refuses_false_records(data):
    import io

    assert [r["payload_bytes"] for r in warc.records(io.BytesIO(changed(b"abc") * 3))] == [3, 3, 3]
    with pytest.raises((ValueError, zlib.error)):
        list(warc.records(io.BytesIO(data)))


def test_hmm_codes_words_as_a_plain_loop_and_joins_rare_ones_without_a_sort(spark):
    df = table(spark, [*EDGE, (10, " \x0bone ONE\x1ctwo \f"), (20, "one Über über ſ one\r\nrare rare")])
    rows = df.select("doc_id", hmm.held_out().alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    texts = [((r.text or "").encode().lower().split(), r.held_out) for r in rows.collect()]
    counts = Counter(w for words, _ in texts for w in [*words, hmm.END])
    assert {(bytes(r["word"]), r["class"], r["c"]) for r in hmm.word_counts(rows.select("text")).collect()} == {(w, hmm.ending(w), n) for w, n in counts.items()}
    symbols = {b"one": 0, b"hello": 1, hmm.END: 2}
    found = []
    for r in hmm.coded(rows, symbols).collect():
        rare = sorted((bytes(x["word"]), x["class"], x["n"], tuple(x["at"])) for x in r["rare"])
        found.append((r["held_out"], r["n_tokens"], bytes(r["symbols"]), rare))
    plain = []
    for words, out in texts:
        own = sorted({w for w in words if w not in symbols})
        coded = np.array([*(symbols.get(w, 3 + hmm.ending(w)) for w in words), 2], dtype="<u2")
        plain.append((out, len(words) + 1, coded.tobytes(), [(w, hmm.ending(w), words.count(w), tuple(i for i, x in enumerate(words) if x == w) if out else ()) for w in own]))
    assert sorted(found) == sorted(plain)
    plan = hmm.score(df, head=4)._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan
