"""Incremental ingest: isolated sources, rejected rows, batches that are played again."""

import json

from touchline.streaming import ingest as ing


def drop(folder, name, rows):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def sources(tmp_path):
    base = f"file://{tmp_path}/in"
    return [
        ing.Source("a", f"{base}/a", "id long, v string, at long", ["id"], order="at"),
        ing.Source("broken", f"{base}/missing", "id long", ["id"]),
        ing.Source("c", f"{base}/c", "id long, v string", ["id"], format="csv", options={"header": "true"}),
    ]


def test_sources_are_isolated(spark, tmp_path):
    a, broken, c = found = sources(tmp_path)
    root = f"file://{tmp_path}/out"
    drop(tmp_path / "in/a", "1.json", [{"id": 1, "v": "x", "at": 1}, {"id": 1, "v": "y", "at": 2}, {"id": 2, "v": "z", "at": 1}, "{no json", {"v": "keyless"}])
    drop(tmp_path / "in/c", "1.csv", ["id,v", "1,p", "no number,q"])
    got = {r.source: r for r in ing.ingest(spark, found, root).collect()}
    assert {k: r.status for k, r in got.items()} == {"a": "complete", "broken": "failed", "c": "complete"} and got["broken"].error
    assert (got["a"].n_new, got["a"].n_rejected, got["c"].n_new, got["c"].n_rejected) == (2, 2, 1, 1)
    assert rows(ing.read_table(spark, a, root)) == [(1, "y", 2), (2, "z", 1)] and rows(ing.read_table(spark, c, root)) == [(1, "p")]
    assert {(r.reason, r.record) for r in ing.read_rejects(spark, a, root).collect()} == {("malformed", "{no json"), ("no key", '{"v":"keyless"}')}
    assert rows(ing.read_table(spark, broken, root)) == [] and ing.read_rejects(spark, broken, root).count() == 0
    # only new files count, a later batch wins over a greater order, and the source that failed is there once its folder is
    drop(tmp_path / "in/a", "2.json", [{"id": 1, "v": "new", "at": 0}, {"id": 3, "v": None, "at": None}])
    drop(tmp_path / "in/missing", "1.json", [{"id": 7}])
    got = {r.source: r for r in ing.ingest(spark, found, root).collect()}
    assert {k: (r.status, r.n_new) for k, r in got.items()} == {"a": ("complete", 2), "broken": ("complete", 1), "c": ("complete", 0)}
    assert rows(ing.read_table(spark, a, root).where("id <> 3")) == [(1, "new", 0), (2, "z", 1)] and ing.read_table(spark, a, root).count() == 3


def test_replayed_batches_and_compaction(spark, tmp_path):
    a = sources(tmp_path)[0]
    root = f"file://{tmp_path}/out"
    for n, v in enumerate("xyz"):
        drop(tmp_path / "in/a", f"{n}.json", [{"id": 1, "v": v, "at": 9 - n}, {"id": 10 + n, "v": v, "at": 0}])
        ing.ingest(spark, [a], root).collect()
    before = rows(ing.read_table(spark, a, root))
    assert before == [(1, "z", 7), (10, "x", 0), (11, "y", 0), (12, "z", 0)]
    # the last batch is lost after it was written and before it was committed: it is played again
    commits = sorted((tmp_path / "out/checkpoints/a/commits").glob("[0-9]*"), key=lambda p: int(p.name))
    for p in (commits[-1], commits[-1].with_name(f".{commits[-1].name}.crc")):
        p.unlink(missing_ok=True)
    ing.ingest(spark, [a], root).collect()
    assert rows(ing.read_table(spark, a, root)) == before
    # a batch without its end is not read
    (tmp_path / "out/tables/a/00000002/_SUCCESS").unlink()
    assert rows(ing.read_table(spark, a, root)) == [(1, "y", 8), (10, "x", 0), (11, "y", 0)]
    (tmp_path / "out/tables/a/00000002/_SUCCESS").touch()
    ing.compact(spark, a, root)
    assert rows(ing.read_table(spark, a, root)) == before and len(list((tmp_path / "out/tables/a").iterdir())) == 1
    drop(tmp_path / "in/a", "9.json", [{"id": 1, "v": "after", "at": 0}])
    ing.ingest(spark, [a], root).collect()
    assert rows(ing.read_table(spark, a, root))[0] == (1, "after", 0)
    ing.compact(spark, a, root)
    assert rows(ing.read_table(spark, a, root))[0] == (1, "after", 0)
