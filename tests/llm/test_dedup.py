"""Duplicate, repeat and contamination operators against brute force, with the odd inputs each must stand."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
import xxhash
from cases import EDGE, clashing, empty, near, table
from pyspark.sql import functions as F

from touchline.llm.components import components
from touchline.llm.decontamination import candidates, contained, decontaminate, shingles_of, sketched
from touchline.llm.exact_dedup import exact_dedup
from touchline.llm.line_dedup import line_dedup
from touchline.llm.repeats import GROUP, LENGTH, STARTS, blocks, remove_repeats
from touchline.llm.simhash import close_pairs, fingerprint, fingerprint_links, gray_rank, near_duplicates


def lower(text):
    return (text or "").encode().lower().decode()


def words(text):
    return lower(text).encode().split()


# Exact


@pytest.mark.parametrize("digest_all", [False, True])
def test_exact_groups(spark, digest_all):
    rows = EDGE + [(20, "ÄB c"), (21, "Äb C"), (22, "äb c")]
    groups = defaultdict(list)
    for i, t in rows:
        groups[lower(t)].append(i)
    want = Counter()
    for i, t in rows:
        own = groups[lower(t)]
        keep = max((x for x in own if x is not None), default=None)
        want[i, keep, len(own), i == keep] += 1
    got = exact_dedup(clashing(spark, rows), digest_all=digest_all).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got) == want
    if digest_all:
        assert Counter((r.doc_id, r.text_sha256) for r in got) == Counter((i, hashlib.sha256(lower(t).encode()).hexdigest()) for i, t in rows)


def test_exact_separates_a_shared_prefix(spark):
    rows = [(i, "x" * 300 + c) for i, c in enumerate("aabb")]
    got = {r.doc_id: r.keep_id for r in exact_dedup(table(spark, rows)).collect()}
    assert got == {0: 1, 1: 1, 2: 3, 3: 3}


# SimHash


def plain_fingerprint(text):
    w = words(text)
    grams = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


@pytest.mark.parametrize("text", [None, "", " \t", "One", "one two", "a b a b a b a", "ünï Çode WORDS here again", "w " * 5000])
def test_fingerprint(text):
    assert fingerprint((text or "").encode()) == plain_fingerprint(text)


def plain_components(pairs, nodes):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_gray_tree_finds_every_pair():
    import numpy as np

    rng = random.Random(1)
    fps = {rng.getrandbits(64) for _ in range(60)}
    for f in list(fps):
        for _ in range(4):
            fps.add(f ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5))))
    fps = np.array(sorted(fps), dtype=np.uint64)
    fps = fps[np.argsort(gray_rank(fps))]
    i, j = close_pairs(fps)
    want = {(a, b) for a in range(len(fps)) for b in range(a + 1, len(fps)) if int(fps[a] ^ fps[b]).bit_count() <= 3}
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == want and len(i) == len(want)


@pytest.mark.parametrize("block", [4, 1024])
def test_links_keep_every_component(spark, block):
    """With a block of 4 the nodes are cut at quantiles of the Gray rank."""
    rng = random.Random(2)
    fps = {0, 1, (1 << 64) - 1}
    for _ in range(12):
        f = rng.getrandbits(64)
        for _ in range(9):
            f ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5)))
            fps.add(f)
    signed = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    pairs = [(a, b) for k, a in enumerate(signed) for b in signed[k + 1 :] if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 3]
    links = fingerprint_links(spark.createDataFrame([(f,) for f in signed], "fp long"), block=block).collect()
    assert plain_components([(r.a, r.b) for r in links], signed) == plain_components(pairs, signed)


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 160), 100)}


def test_near_duplicates(spark):
    rows = EDGE + near()
    got = near_duplicates(clashing(spark, rows)).collect()
    assert Counter((r.doc_id, r.fingerprint) for r in got) == Counter((i, f"{plain_fingerprint(t):016x}") for i, t in rows)
    fps = sorted({plain_fingerprint(t) for _, t in rows})
    root = plain_components([(a, b) for k, a in enumerate(fps) for b in fps[k + 1 :] if (a ^ b).bit_count() <= 3], fps)
    least = {}
    for i, t in rows:
        r = root[plain_fingerprint(t)]
        least[r] = min((x for x in (least.get(r), i) if x is not None), default=None)
    assert Counter((r.doc_id, r.component_id) for r in got) == Counter((i, least[root[plain_fingerprint(t)]]) for i, t in rows)
    assert near_duplicates(empty(spark)).count() == 0


# Repeated strings


def plain_repeats(rows, n=LENGTH):
    data = [(t or "").encode() for _, t in rows]
    seen = Counter(d[k : k + n] for d in data for k in range(len(d) - n + 1))
    out = []
    for (i, _), d in zip(rows, data, strict=True):
        gone = [False] * len(d)
        for k in range(len(d) - n + 1):
            if seen[d[k : k + n]] > 1:
                gone[k : k + n] = [True] * n
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        left = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        out.append((i, len(d), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    return Counter(out)


def test_repeats(spark):
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("abcdé fg") for _ in range(n))
    passage, other = text(450), text(230)
    rows = [r for r in EDGE if len(r[1] or "") < 5000]
    rows += [(30, text(300) + passage + text(90)), (31, passage + text(10)), (32, text(5) + passage[100:350] + text(400) + other), (33, other[15:] + text(20) + other[:190])]
    rows += [(34, "z" * 700), (35, "ab" * 180), (36, text(199)), (37, text(200)), (38, text(260)), (38, passage), (None, passage)]
    cut = text(201)
    rows += [(40, cut[:200]), (41, cut[1:]), (42, cut), (43, "q" + cut[1:200] + "q")]
    got = Counter(map(tuple, remove_repeats(clashing(spark, rows)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()))
    assert got == plain_repeats(rows)
    assert remove_repeats(empty(spark)).count() == 0


def test_repeats_at_random(spark):
    rng = random.Random(4)
    pool = ["".join(rng.choice("xyz") for _ in range(rng.choice([150, 210, 330]))) for _ in range(6)]
    rows = [(i, "".join(rng.choice(pool)[rng.randint(0, 40) :] + "xyz"[i % 3] * rng.randint(0, 3) for _ in range(rng.randint(1, 4)))) for i in range(40)]
    out = remove_repeats(table(spark, rows), kept_text=True).collect()
    assert Counter(tuple(r)[:5] for r in out) == plain_repeats(rows)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in out)


def test_repeats_of_texts_side_by_side(spark):
    """Short texts share a block, are cut as each alone would be, and no match crosses their borders, nor does the end of a block in a long text hide one."""
    import numpy as np

    rng = random.Random(14)
    text = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    own = [text(rng.choice([199, 200, 201, 260, 700])) for _ in range(300)]
    own += [own[k][-120:] + own[k + 1][:120] for k in range(40)] + own[50:60] + ["z" * 300, "z" * 250]
    data = [t.encode() for t in own]
    held = list(blocks(data))
    assert len(held) <= 2 * sum(map(len, data)) // GROUP + 1
    bits, key = np.full(1 << 17, 255, dtype=np.uint8), b"k" * 16
    cells = lambda of, b: {(int(of[part, 0]), int(first + of[part, 1]), *map(int, rest)) for part, first, *rest in zip(*b.cells(bits, key), strict=True)}
    alone = [(k, of, b) for k, t in enumerate(data) for of, b in blocks([t])]
    assert set().union(*(cells(of, b) for of, b in held)) == set().union(*(cells(of + [k, 0], b) for k, of, b in alone))
    assert Counter(int(h) for _, b in held for h in b.phrases()) == Counter(int(h) for _, _, b in alone for h in b.phrases())
    rows = list(enumerate(own))
    assert Counter(tuple(r)[:5] for r in remove_repeats(table(spark, rows).coalesce(1)).collect()) == plain_repeats(rows)
    passage = text(400)
    long = text(STARTS - 150) + passage + text(5000)
    got = {r.doc_id: tuple(r)[1:4] for r in remove_repeats(table(spark, [(1, long), (2, "#" + passage[:390] + "#"), (3, passage[190:] + "##")])).collect()}
    assert got == {1: (len(long), 400, 1), 2: (392, 390, 1), 3: (212, 210, 1)}


def test_repeats_keep_no_table_of_cells_or_pieces(spark):
    """What is left in the shared folder when the result can be read: texts with their cells, and the repeated or single places."""
    import os

    from touchline.llm.common import work_dir

    held = lambda: {x for x in os.listdir(at) if x[0] != "."} if os.path.isdir(at := work_dir(spark).removeprefix("file://")) else set()
    before = held()
    rng = random.Random(15)
    text = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    passage = text(500)
    rows = [(k, text(150) + passage[k : 300 + 7 * k] + text(150)) for k in range(20)]
    out = remove_repeats(table(spark, rows))
    assert sorted(x.rsplit("-", 1)[0] for x in held() - before) == ["cells", "repeated", "repeated", "single"]
    assert Counter(map(tuple, out.collect())) == plain_repeats(rows)


# Lines


def plain_lines(rows):
    """Chunks as the operator cuts them, compared and removed one by one."""
    chunks = []
    for i, t in rows:
        if t and "\n" in t:
            own = t.encode().split(b"\n")
            chunks += [((i is not None, i or 0), hash(t), k, 2, b"\n".join(own[k : k + 2]), i, t) for k in range(len(own) - 1)]
    where = defaultdict(set)
    for key, h, first, n, c, i, t in chunks:
        where[c].add((key, t, first))
    # a chunk that several texts of one id hold belongs to one of them; these cases have none such
    owner = {c: min(places, key=lambda p: (p[0], p[2])) for c, places in where.items()}
    count = Counter(c for *_, c, _, _ in chunks)
    out = []
    for i, t in rows:
        lines = t.split("\n") if t is not None else []
        gone = set()
        for key, _, first, n, c, j, u in chunks:
            if (j, u) == (i, t) and count[c] > 1 and owner[c] != (key, t, first):
                gone |= set(range(first, first + n))
        out.append((i, None if t is None else "\n".join(x for k, x in enumerate(lines) if k not in gone), len(lines), len(gone)))
    return Counter(out)


def test_line_dedup(spark):
    rng = random.Random(5)
    line = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(6))
    block = [line() for _ in range(30)]
    body = lambda n: [f"{line()} {rng.random()}" for _ in range(n)]
    rows = [r for r in EDGE if r[0] is not None]
    rows += [(40 + k, "\n".join([*body(k + 1), *block, *body(3)])) for k in range(6)] + [(50, "\n".join(block + body(2) + block)), (51, "only one\nunlike others"), (52, "\n\n\n\n"), (52, "\n\n\n\n")]
    got = line_dedup(clashing(spark, rows))
    assert Counter((r.doc_id, r.text, r.n_lines, r.n_lines_removed) for r in got.collect()) == plain_lines(rows)
    assert got.columns[:2] == ["doc_id", "text"] and "hash" in got.columns
    removed = {r.doc_id: r.n_lines_removed for r in got.collect()}
    assert removed[40] == 0 and min(removed[k] for k in range(41, 46)) >= 15 and removed[51] == 0
    assert line_dedup(empty(spark)).count() == 0


def plain_passages(rows):
    """Lines that go: those in any run of two or more that begins at an earlier place; runs are sought at every place."""
    texts = [t.split("\n") for _, t in sorted(rows)]
    out = []
    for d, own in enumerate(texts):
        gone = set()
        for k in range(len(own)):
            for e, other in enumerate(texts[: d + 1]):
                for j in range(len(other) if e < d else k):
                    n = 0
                    while k + n < len(own) and j + n < len(other) and own[k + n] == other[j + n]:
                        n += 1
                    if n >= 2:
                        gone |= set(range(k, k + n))
        out.append("\n".join(x for k, x in enumerate(own) if k not in gone))
    return out


def test_line_dedup_finds_every_repeated_passage(spark):
    """Passages of 1 to 8 lines inside otherwise different documents, parts of passages, and a text that repeats itself."""
    rng = random.Random(12)
    new = lambda n: [f"line {rng.random()}" for _ in range(n)]
    pool = [new(n) for n in (1, 2, 2, 3, 3, 4, 5, 8)]
    rows = [(k, "\n".join(new(rng.randint(1, 4)) + rng.choice(pool) + new(rng.randint(0, 3)) + rng.choice(pool)[rng.randint(0, 1) :] + new(1))) for k in range(40)]
    rows += [(40, "\n".join(["la"] * 5)), (41, "\n".join(pool[7] + ["x"] + pool[7][2:6]))]
    got = [r.text for r in line_dedup(table(spark, rows)).orderBy("doc_id").collect()]
    assert got == plain_passages(rows)


# Contamination


def plain_contained(docs, items):
    grams = lambda t: {b" ".join(w[i : i + 5]) for w in [words(t)] for i in range(max(1, len(w) - 4))} if words(t) else set()
    whole = defaultdict(set)
    for i, t in items:
        if i is not None:
            whole[i] |= grams(t)
    out = set()
    for i, t in docs:
        own = grams(t)
        out |= {(i, k, len(s), len(s & own)) for k, s in whole.items() if s and len(s & own) >= 0.8 * len(s)}
    return out


def test_contained(spark):
    rng = random.Random(6)
    text = lambda n: " ".join(f"w{rng.randint(0, 400)}" for _ in range(n))
    items = [(k, text(k % 40 + 1)) for k in range(1, 60)] + [(70, ""), (71, None), (72, "one"), (None, "one"), (5, text(6)), (73, "A b C"), (74, "p q r s t " * 30)]
    docs = list(EDGE)
    for k, (_, t) in enumerate(items[:59]):
        w = t.upper().split() if k % 2 else t.split()
        for _ in range(k % 4):
            w[rng.randrange(len(w))] = "other"
        docs.append((100 + k, " ".join([text(50), *w, text(rng.choice([0, 80]))])))
    docs += [(200, "a B\tc"), (201, "a b c d"), (202, "p q r s t p q r s t")]
    found = contained(clashing(spark, docs), table(spark, items, "item_id"))
    assert {(r.doc_id, r.item_id, r.n_shingles, r.n_shared) for r in found.collect()} == plain_contained(docs, items)
    bad = {i for i, *_ in plain_contained(docs, items)}
    left = decontaminate(clashing(spark, docs), table(spark, items, "item_id"))
    assert Counter((r.doc_id, r.text) for r in left.collect()) == Counter(d for d in docs if d[0] not in bad)
    assert left.columns == clashing(spark, docs).columns
    assert decontaminate(table(spark, docs), empty(spark).withColumnRenamed("doc_id", "item_id")).count() == len(docs)
    assert contained(empty(spark), table(spark, items, "item_id")).count() == 0


def test_sketches_choose_the_pairs(spark):
    """Shingles that all items and documents share make no pairs: only documents that hold an item are verified, and none of them is missed."""
    rng = random.Random(8)
    text = lambda n: " ".join(f"w{rng.randint(0, 4000)}" for _ in range(n))
    common = text(12)
    items = [(k, f"{common} {text(5 + 2 * k)}") for k in range(1, 30)]
    docs = [(k, f"{text(20)} {common} {text(20)}") for k in range(100)] + [(200 + k, f"{text(9)} {t} {text(30)}") for k, t in items]
    own = shingles_of(table(spark, items, "item_id").selectExpr("item_id as id", "0L as key", "text"), 5).drop("key")
    sized = sketched(own, 0.8)
    found = shingles_of(table(spark, docs).selectExpr("doc_id as id", "0L as key", "text"), 5)
    pairs = {(r.id, r.item) for r in candidates(found, sized).collect()}
    want = {(i, k) for i, k, *_ in plain_contained(docs, items)}
    assert {(200 + k, k) for k, _ in items} <= want <= pairs
    plain = found.join(own.selectExpr("id as item", "shingle as s"), F.col("shingle") == F.col("s")).select("id", "item").distinct().count()
    assert plain == len(docs) * len(items) and len(pairs) <= 2 * len(items)
    assert {(r.doc_id, r.item_id) for r in contained(table(spark, docs), table(spark, items, "item_id")).collect()} == want


def colliding():
    """Two different texts of LENGTH bytes that a polynomial hash modulo 2^64 cannot tell apart: a Thue-Morse pattern times a combination that vanishes too."""
    from touchline.llm.common import BASE

    pattern = [1 if bin(i).count("1") % 2 == 0 else -1 for i in range(128)]
    value = sum(c * pow(BASE, i, 1 << 64) for i, c in enumerate(pattern)) % (1 << 64)
    left = 1 << (64 - (value & -value).bit_length() + 1)
    powers, rng, seen = [pow(BASE, j, 1 << 64) for j in range(LENGTH - 128 + 1)], random.Random(9), {}
    while True:
        own = [rng.randrange(2) for _ in powers]
        h = sum(p for p, x in zip(powers, own, strict=True) if x) % left
        if h in seen and seen[h] != own:
            break
        seen[h] = own
    difference = [0] * LENGTH
    for j, (x, y) in enumerate(zip(own, seen[h], strict=True)):
        for i, c in enumerate(pattern):
            difference[i + j] += (x - y) * c
    base = [rng.randrange(60, 90) for _ in range(LENGTH)]
    return "".join(map(chr, base)), "".join(chr(b + d) for b, d in zip(base, difference, strict=True))


def test_colliding_texts_stay_whole(spark):
    import numpy as np

    from touchline.llm.common import span_hashes

    a, b = colliding()
    assert a != b and len(a) == len(b) == LENGTH and (a + b).isascii()
    for t in (a, b):
        assert span_hashes(np.frombuffer((a + b).encode(), np.uint8), np.array([0, LENGTH]), np.array([LENGTH, 2 * LENGTH]))[0] == span_hashes(np.frombuffer(t.encode(), np.uint8), np.array([0]), np.array([LENGTH]))[0]
    rows = [(1, a), (2, b), (3, "#" + a[1:]), (4, "#" + b[1:])]
    got = {r.doc_id: (r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(table(spark, rows)).collect()}
    assert got == {i: (0, 0, hashlib.sha256(t.encode()).hexdigest()) for i, t in rows}
