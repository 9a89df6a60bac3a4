"""The pipeline and its stages against plain versions, the registered queries against their SQL."""

import hashlib
import math
import os
import random
from collections import Counter

import pytest
from cases import EDGE, clashing, near, table
from pyspark.sql import functions as F
from test_dedup import plain_components, plain_contained, plain_fingerprint, plain_lines
from test_models import labelled_texts

import corpus_pipeline
from touchline.llm.queries import ORACLES, QUERIES
from touchline.llm.simhash import one_of_each, similar_documents

SF = "/root/testdata/sf0.001"


def plain_one_of_each(rows):
    fps = {r: plain_fingerprint(r[1]) for r in rows}
    nodes = sorted(set(fps.values()))
    root = plain_components([(a, b) for k, a in enumerate(nodes) for b in nodes[k + 1 :] if (a ^ b).bit_count() <= 3], nodes)
    least = {}
    for r, f in fps.items():
        if r[0] is not None:
            least[root[f]] = min(r[0], least.get(root[f], r[0]))
    return {r for r, f in fps.items() if r[0] == least.get(root[f])}


def test_one_of_each(spark):
    rows = EDGE + near() + [(None, "two of these have no id"), (None, "two of these have no id")]
    df = clashing(spark, rows)
    out = one_of_each(df)
    want = plain_one_of_each([(i, t or "") for i, t in rows])
    assert Counter((r.doc_id, r.text or "") for r in out.collect()) == Counter(want) and out.columns == df.columns


def plain_near_copies(rows):
    """The rows (id, text) that stay when one of each group of near copies does: 5-word shingles, Jaccard similarity of 0.8 or more, all pairs compared."""
    grams = {r: {tuple(w[i : i + 5]) for w in [(r[1] or "").encode().lower().split()] for i in range(max(1, len(w) - 4))} for r in rows}
    names = {r: k for k, r in enumerate(dict.fromkeys(rows))}
    pairs = [(names[a], names[b]) for a in names for b in names if names[a] < names[b] and len(grams[a] & grams[b]) / len(grams[a] | grams[b]) >= 0.8]
    root = plain_components(pairs, range(len(names)))
    least = {}
    for (i, _), k in names.items():
        if i is not None:
            least[root[k]] = min(i, least.get(root[k], i))
    return Counter({(i, t or "") for (i, t), k in names.items() if i == least.get(root[k])})


def test_near_copies_go_by_jaccard(spark):
    """The stage against brute force: copies of 0 to 60 changed words, chains, short and blank texts."""
    rng = random.Random(11)
    rows = [r for r in EDGE if r[0] is not None] + near()
    for g in range(12):
        own = [f"v{rng.randint(0, 900)}" for _ in range(rng.choice([8, 40, 200]))]
        for k in range(8):
            rows.append((5000 + 10 * g + k, " ".join(own)))
            for _ in range(rng.randint(0, max(1, len(own) // 30))):
                own[rng.randrange(len(own))] = f"x{rng.randint(0, 900)}"
    want = plain_near_copies(rows)
    df = clashing(spark, rows)
    out = corpus_pipeline.drop_near_copies(spark, df, SF)
    assert Counter((r.doc_id, r.text or "") for r in out.collect()) == want and out.columns == df.columns
    assert sum(i < 1100 for i, _ in want if i >= 1000) == 6  # one of each group of near()


def test_large_groups_of_near_copies(spark):
    """Nodes and groups of several blocks: copies of copies, of which many are alike only over others."""
    rng = random.Random(5)
    own, rows = [f"v{rng.randint(0, 900)}" for _ in range(60)], []
    for k in range(150):
        rows.append((k, " ".join(own)))
        own[rng.randrange(len(own))] = f"x{k}"
    grams = [{tuple(w[i : i + 5]) for w in [t.split()] for i in range(len(w) - 4)} for _, t in rows]
    pairs = [(a, b) for a in range(150) for b in range(a + 1, 150) if len(grams[a] & grams[b]) / len(grams[a] | grams[b]) >= 0.8]
    root = plain_components(pairs, range(150))
    for block in (1024, 40):
        found = {r.doc_id: r.component_id for r in similar_documents(table(spark, rows), block=block).collect()}
        assert found == {i: root[i] for i in range(150)}


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A folder of documents, labels and benchmark, with planted cases and odd rows."""
    rng = random.Random(9)
    rows, labels = labelled_texts()
    rows = [(i, t) for i, t in rows]
    lines = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "gentle"]) for _ in range(8)) for _ in range(25)]
    item = " ".join(f"item{rng.randint(0, 500)}" for _ in range(40))
    rows += near() + [r for r in EDGE if r[0] is not None] + [(None, "gentle words without an id")]
    rows += [(2000 + k, "\n".join([f"gentle start {rng.random()} of text {k}", *lines, f"lovely end {rng.random()}"])) for k in range(5)]
    rows += [(3000, f"gentle filler1 filler2 {item.upper()} filler3"), (3001, f"gentle filler9 filler8 {item[: len(item) // 3]} filler3")]
    d = f"file://{tmp_path_factory.mktemp('corpus')}"
    table(spark, rows).withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.char_length("text").cast("long")}).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{d}/labels.parquet")
    table(spark, [(1, item), (2, None)], "item_id").write.parquet(f"{d}/benchmark.parquet")
    return d, rows, item


def test_stages_and_result(spark, corpus):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    d, rows, item = corpus
    docs = spark.read.parquet(f"{d}/documents.parquet")
    kept = corpus_pipeline.drop_toxic(spark, docs, d)
    assert kept.columns == docs.columns
    kept = [(r.doc_id, r.text) for r in kept.collect()]
    gone = Counter(rows) - Counter(kept)
    bad = lambda t: t is not None and any(w in t.split() for w in ("vermin", "scum", "filth"))
    assert sum(bad(t) for _, t in gone) > 280 and not Counter(kept) - Counter(rows)
    cut = [(i, t) for (i, t, _, _), n in plain_lines(kept).items() for _ in range(n)]
    near_kept = list(plain_near_copies([(i, t or "") for i, t in cut]))
    leaks = {i for i, *_ in plain_contained(near_kept, [(1, item), (2, None)])}
    assert leaks == {3000}
    t = Tokenizer.from_file(str(P.path("byte_bpe_50k.json")))
    want = Counter()
    for i, x in near_kept:
        if i not in leaks:
            ids = t.encode(x, add_special_tokens=False).ids
            want[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()] += 1
    out = corpus_pipeline.run(spark, d)
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256) for r in out.collect()) == want


def test_stages_keep_clashing_columns(spark, corpus):
    d, _, _ = corpus
    df = clashing(spark, EDGE).withColumn("n_chars", F.char_length("text").cast("long"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, d)
        assert out.columns == df.columns and {r.toxicity for r in out.collect()} <= {"toxicity"}, name
        assert stage(spark, df.limit(0), d).count() == 0


def plain(v):
    return float(f"{v:.8g}") if isinstance(v, float) and not math.isnan(v) else v


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    r = con.execute(ORACLES[name])
    names = [x[0] for x in r.description]
    df = QUERIES[name](spark, SF)
    assert sorted(names) == sorted(df.columns)
    assert Counter(tuple(plain(x[c]) for c in names) for x in df.collect()) == Counter(tuple(map(plain, x)) for x in r.fetchall())
