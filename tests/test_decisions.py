"""Decisions over time against a replay of the ledger."""

import datetime as dt
import random

from touchline.operators import decisions


def test_state_equals_a_replay(spark):
    rng = random.Random(2)
    day = lambda: dt.date(2024, 1, 1) + dt.timedelta(days=rng.randrange(60))
    log = [(i, rng.randrange(5), rng.choice([1, None]), day(), rng.choice(["confirmed", "revoked"])) for i in range(80)]
    asked = [(k, rng.randrange(6), rng.choice([1, None]), day()) for k in range(60)]
    got = decisions.state_at(spark.createDataFrame(asked, "k int, p int, s int, at date"), spark.createDataFrame(log, "id int, p int, s int, recorded date, action string"), ["p", "s"], "at", "recorded", "id").collect()
    assert len(got) == 60
    for r in got:
        own = [x for x in log if (x[1], x[2]) == (r.p, r.s) and x[3] <= r["at"]]
        last = max(own, key=lambda x: (x[3], x[0]), default=None)
        assert (r.id, r.action, r.stands) == ((last[0], last[4], last[4] == "confirmed") if last else (None, None, False))


def test_revocations_take_back_unchanged_reviewed_labels_only(spark):
    labels = spark.createDataFrame([(1, "f1"), (2, "new"), (4, "f4"), (5, "f5"), (6, "f6"), (7, "f7")], "label int, fingerprint string")
    m = decisions.REVIEWED
    imports = spark.createDataFrame([(1, 1, "c1", m, "old"), (2, 1, "c1", m, "f1"), (3, 2, "c1", m, "f2"), (4, 3, "c1", m, "f3"), (5, 4, "c1", "exact", "f4"), (6, 5, "c2", m, "f5"), (7, 6, "c1", m, "f6"), (8, 6, "c2", m, "f6")], "n int, label int, context string, method string, fingerprint string")
    log = spark.createDataFrame([(1, "c1", "confirmed"), (2, "c1", "revoked"), (1, "c2", "revoked"), (2, "c2", "confirmed")], "n int, context string, action string")
    v = decisions.revocations(labels, imports, log, ["label"], ["context"], "n")
    assert {(r.label, r.verdict) for r in v.collect()} == {(1, "removable"), (2, "label_superseded_or_changed"), (3, "label_not_current")}
    assert sorted(r.label for r in decisions.reconciled(labels, v, ["label"]).collect()) == [2, 4, 5, 6, 7]
    assert decisions.revocations(labels, imports, log.limit(0), ["label"], ["context"], "n").collect() == []


def test_fingerprints_tell_missing_from_empty(spark):
    df = spark.createDataFrame([("a", None), ("a", ""), (None, "a"), ("", "a"), ("a|", "b"), ("a", "|b")], "x string, y string")
    assert df.select(decisions.fingerprint(["x", "y"]).alias("f")).distinct().count() == 6
