"""Hand-computed cases of the analytic operators."""

import datetime as dt
import math
from itertools import product

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from touchline.functions import scalar
from touchline.operators import actions, backtest, identity, joins, league, quality, stats, windows
from touchline.sources import tables
from touchline.streaming import state


def rows(df, *order):
    return [r.asDict() for r in df.orderBy(*order).collect()]


def d(day):
    return dt.datetime(2026, 8, day)


@pytest.fixture
def matches(spark):
    return spark.createDataFrame([("m1", d(1), "L", 2026, "t1", "t2", 2, 0), ("m2", d(8), "L", 2026, "t2", "t1", 1, 1), ("m3", d(20), "L", 2026, "t1", "t3", 3, 0)], "match_id string, match_date timestamp, league string, season int, home string, away string, home_goals int, away_goals int")


def test_unpivot_rest_days_and_as_of(spark, matches):
    t = joins.team_rows(matches)
    assert t.count() == 6
    rest = windows.rest_days(t, ["team"], ["match_date", "match_id"], "match_date")
    got = {(r.team, r.match_id): (r.points, r.rest_days) for r in rest.collect()}
    assert got["t1", "m1"] == (3, None) and got["t1", "m3"] == (3, 12.0) and got["t2", "m2"] == (1, 7.0)
    elo = spark.createDataFrame([("t1", d(1), 1500), ("t1", d(9), 1520), ("t2", d(2), 1450)], "team string, at timestamp, elo int")
    got = {(r.team, r.match_id): r.elo for r in joins.asof(t, elo, "team", "match_date", "at", ["elo"]).collect()}
    assert got["t1", "m1"] == 1500 and got["t1", "m3"] == 1520 and got["t2", "m1"] is None and got["t2", "m2"] == 1450 and got["t3", "m3"] is None
    strict = {(r.team, r.match_id): r.elo for r in joins.asof(t, elo, "team", "match_date", "at", ["elo"], allow_exact=False).collect()}
    assert strict["t1", "m1"] is None


def test_fixtures_come_back(matches):
    back = joins.fixtures_from_sides(joins.team_rows(matches))
    assert sorted(map(tuple, back.collect())) == sorted((r.match_id, r.home, r.away, r.home_goals, r.away_goals) for r in matches.collect())


def test_rolling_excludes_the_current_row(spark):
    df = spark.createDataFrame([("p", 1, 90.0), ("p", 2, 45.0), ("p", 3, 90.0)], "player string, i int, minutes double")
    got = rows(windows.rolling_prior(df, ["player"], ["i"], ["minutes"], 2), "i")
    assert [(r["prior_2_rows"], r["prior_2_minutes_sum"]) for r in got] == [(None, None), (1.0, 90.0), (2.0, 135.0)]


def test_rolling_is_the_same_for_any_input_order(spark):
    df = spark.createDataFrame([(i % 3, i, float(i * i % 17)) for i in range(200)], "k int, i int, v double")
    a = rows(windows.rolling_prior(df, ["k"], ["i"], ["v"], 5), "i")
    b = rows(windows.rolling_prior(df.repartition(7).orderBy(F.desc("v")), ["k"], ["i"], ["v"], 5), "i")
    assert a == b


def test_islands_and_null_sides(spark):
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate(["a", "a", None, None, "b", "a"])], "m int, i int, side string")
    assert [r["island"] for r in rows(windows.islands(df, ["m"], ["i"], "side"), "i")] == [1, 1, 2, 3, 4, 5]


def test_possession_labels(spark):
    df = spark.createDataFrame([(1, 1, "a", 0), (1, 2, "b", 0), (1, 3, "b", 1), (1, 4, "a", 0)], "m int, i int, side string, goal int")
    got = rows(windows.possession_labels(df, ["m"], ["i"], "side", F.col("goal") == 1), "i")
    assert [(r["scores"], r["concedes"]) for r in got] == [(0, 1), (1, 0), (1, 0), (0, 0)]


def test_percentiles_of_ties(spark):
    df = spark.createDataFrame([("g", v) for v in (1.0, 2.0, 2.0, 3.0)] + [("g", None)], "g string, v double")
    got = rows(stats.percentiles(df, ["g"], "v"), "v", "pct_mid")
    assert [r["pct_strict"] for r in got] == [0, 25, 25, 75]
    assert [r["pct_mid"] for r in got] == [12.5, 50, 50, 87.5]
    assert [r["pct_average"] for r in got] == [25, 62.5, 62.5, 100]


def test_quantile_bins_merge_equal_edges(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 1, 1, 1, 2, 3)], "v double")
    assert [r["bin"] for r in rows(stats.quantile_bins(df, "v", 4), "v")] == [0, 0, 0, 0, 1, 1]


def test_ks_and_trend(spark):
    df = spark.createDataFrame([(float(v), s) for v, s in ((1, False), (2, False), (3, True), (4, True))], "v double, s boolean")
    assert stats.ks_distance(df, "v", F.col("s")).first().ks == 1.0
    t = spark.createDataFrame([("a", 1, 10.0), ("a", 2, 20.0), ("b", 1, 5.0)], "k string, x int, y double")
    got = {r.k: (r.slope, r.label) for r in stats.trend(t, ["k"], "x", "y").collect()}
    assert got == {"a": (10.0, "increasing"), "b": (None, "stable")}


def test_nearest_in_blocks(spark, monkeypatch):
    v = spark.createDataFrame([(i, [math.cos(i), math.sin(i)]) for i in range(12)], "id int, v array<double>")
    one = rows(stats.nearest(v, v.where("id % 4 = 0"), "id", "v", 2), "query", "rank")
    monkeypatch.setattr(stats, "QUERY_BLOCK", 1)
    assert rows(stats.nearest(v, v.where("id % 4 = 0"), "id", "v", 2), "query", "rank") == one


def test_upsert_is_idempotent(spark, tmp_path):
    a = spark.createDataFrame([("m1", "t1", 1), ("m1", "t2", 2)], "m string, t string, v int")
    b = spark.createDataFrame([("m1", "t2", 3, "x")], "m string, t string, v int, extra string")
    path = f"file://{tmp_path}/t"
    tables.write_upsert(spark, a, path, ["m", "t"])
    tables.write_upsert(spark, a, path, ["m", "t"])
    got = rows(tables.write_upsert(spark, b, path, ["m", "t"]), "t")
    assert [(r["t"], r["v"], r["extra"]) for r in got] == [("t1", 1, None), ("t2", 3, "x")]
    with pytest.raises(Exception, match="null primary key"):
        tables.write_upsert(spark, spark.createDataFrame([(None, "t", 1)], "m string, t string, v int"), path, ["m", "t"])


def test_scores_of_a_certain_forecast(spark):
    df = spark.createDataFrame([(1.0, 0.0, 0.0, "home"), (0.0, 0.0, 1.0, "home")], "p_home double, p_draw double, p_away double, outcome string")
    got = backtest.scored(df).collect()
    assert (got[0].brier, got[0].rps, got[0].entropy, got[0].correct) == (0.0, 0.0, 0.0, 1)
    assert (got[1].brier, got[1].rps, got[1].correct) == (2.0, 1.0, 0) and got[1].log_loss == pytest.approx(-math.log(1e-12))


def test_score_matrix_sums_to_one(spark):
    f = spark.createDataFrame([(1, 1.4, 0.9)], "match_id int, lambda_home double, lambda_away double")
    p = league.outcome_probabilities(league.score_matrix(f, rho=-0.05)).first()
    assert p.p_home + p.p_draw + p.p_away == pytest.approx(1.0)


def test_standings(matches):
    got = [(r["team"], r["pts"], r["gd"]) for r in rows(league.standings(joins.team_rows(matches)), "rank")]
    assert got == [("t1", 7, 5), ("t2", 1, -2), ("t3", 0, -3)]


def test_season_shares_sum_to_one(spark):
    t = spark.createDataFrame([("L", 1, "a", 3), ("L", 1, "b", 1)], "league string, season int, team string, pts int")
    f = spark.createDataFrame([(1, "L", 1, "a", "b", 0.5, 0.3), (2, "L", 1, "b", "a", 0.5, 0.3)], "match_id int, league string, season int, home string, away string, p_home double, p_draw double")
    got = league.simulated_seasons(t, f, 50, 1).agg(F.sum("p_first")).first()[0]
    assert got == pytest.approx(1.0)


def test_threat_of_a_two_cell_chain(spark):
    r = spark.createDataFrame([(0, 0.0, None), (1, 1.0, 0.5)], "c int, shot_rate double, goal_rate double")
    m = spark.createDataFrame([(0, 1, 1.0)], "c int, to int, share double")
    assert actions.threat(r, m, "c", "c", "to") == {0: 0.5, 1: 0.5}


def test_scalars(spark):
    df = spark.createDataFrame([("€1.5m", "João Félix", "31/12/2025"), ("300k", "A & B / C", "2026-02-30"), ("x", None, None)], "m string, n string, d string")
    got = df.select(scalar.money(F.col("m")), scalar.name_key(F.col("n")), scalar.day_first(F.col("d"))).collect()
    assert [tuple(r) for r in got] == [(1.5e6, "joao felix", dt.date(2025, 12, 31)), (3e5, "a and b c", None), (None, "", None)]
    assert spark.range(1).select(scalar.csv_safe(F.lit("=1+1"))).first()[0] == "'=1+1"


def test_fuzzy_matching(spark):
    s = spark.createDataFrame([(1, "Joao Felix"), (2, "Jonathan Smithson"), (3, "Zed")], "sid int, name string")
    c = spark.createDataFrame([(10, "João Félix"), (11, "Jonathan Smithsen")], "cid int, cname string")
    got = {r.sid: (r.cid, r.method) for r in identity.matched(s, c, "sid", "name", "cid", "cname").collect()}
    assert got == {1: (10, "exact"), 2: (11, "review"), 3: (None, "unmatched")}


def test_profile(spark):
    df = spark.createDataFrame([(1, -1.0), (1, None), (None, 2.0)], "k int, v double")
    got = {r.check: r.failures for r in quality.profile(df, "t", ["k"], ["v"], ["v"], 5).collect()}
    assert got == {"null_keys": 1, "null_v": 1, "negative_v": 1, "missing_rows": 2, "repeated_keys": 1}


def test_flatten_and_csv(spark, tmp_path):
    df = spark.createDataFrame([(1, (2, ("x",)), [3.0, 4.0])], "a int, b struct<c:int,d:struct<e:string>>, location array<double>")
    flat = tables.coordinates(tables.flattened(df), "location").first().asDict()
    assert flat == {"a": 1, "b_c": 2, "b_d_e": "x", "location_x": 3.0, "location_y": 4.0, "location_z": None}
    (tmp_path / "f.csv").write_bytes("name,v\nJos\xe9,1\n".encode("latin-1"))
    assert tables.read_csv(spark, f"file://{tmp_path}/f.csv").first().name == "José"


def test_streams(spark, tmp_path):
    src = spark.createDataFrame([(1, d(1), 1.0), (2, d(1), 3.0), (1, d(3), 5.0)], "k int, at timestamp, v double")
    src.write.parquet(f"{tmp_path}/in")
    stream = state.files(spark, f"{tmp_path}/in", src.schema)
    q = state.latest_state(stream, "k", "at", ["v"]).writeStream.outputMode("complete").format("memory").queryName("latest").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.k: r.v for r in spark.table("latest").collect()} == {1: 5.0, 2: 3.0}
    state.upserting(state.files(spark, f"{tmp_path}/in", src.schema), f"file://{tmp_path}/out", ["k", "at"], f"{tmp_path}/ck").awaitTermination()
    assert tables.current(spark, f"file://{tmp_path}/out")[1].count() == 3
    w = state.tumbling(state.files(spark, f"{tmp_path}/in", src.schema), "at", "1 day", "1 day", "v").writeStream.outputMode("complete").format("memory").queryName("tumbling").trigger(availableNow=True).start()
    w.awaitTermination()
    assert sorted(r.n for r in spark.table("tumbling").collect()) == [1, 2]


def test_head_to_head_decides_only_between_teams_that_have_all_met(spark):
    from touchline.operators import tournament

    # a, b and c are level; a beat b, b beat c, c beat a by more
    rows_ = [("A", "a", "b", 1, 0), ("A", "b", "c", 1, 0), ("A", "c", "a", 1, 0), ("B", "x", "z", 1, 0), ("B", "y", "z", 1, 0), ("C", "p", "q", 2, 1), ("C", "q", "r", 1, 0), ("C", "r", "p", 1, 1)]
    m = spark.createDataFrame([(i, d(i + 1), g, 2026, *rest) for i, (g, *rest) in enumerate(rows_)], "match_id int, match_date timestamp, league string, season int, home string, away string, home_goals int, away_goals int")
    got = {(r.league, r.team): (r.place, r.head_to_head) for r in tournament.group_tables(joins.team_rows(m), ["league"]).collect()}
    assert [got["A", t] for t in "abc"] == [(1, True), (2, True), (3, True)]
    assert got["B", "x"] == (1, False) and got["B", "y"] == (2, False) and got["B", "z"] == (3, False)
    assert got["C", "p"] == (1, False)


def test_group_places_sum_to_one(spark):
    from touchline.operators import tournament

    df = spark.createDataFrame([("g", t, s) for t, s in zip("abcd", (0.9, 0.5, 0.5, 0.1), strict=True)] + [("h", "only", 1.0), ("z", "none", 0.0)], "g string, t string, s double")
    got = {r.t: r for r in tournament.group_places(df, "g", "t", "s").collect()}
    for p in ("p1", "p2", "p3", "p4"):
        assert math.isclose(sum(got[t][p] for t in "abcd"), 1.0, rel_tol=1e-9)
    assert got["a"].p_advance > got["b"].p_advance == got["c"].p_advance > got["d"].p_advance
    assert got["only"].p1 == 1.0 and got["none"].p1 == 0.0


def test_simulated_bracket_against_a_plain_loop(spark):
    import hashlib
    from collections import Counter

    from touchline.operators import tournament

    strength = {"a": 0.9, "b": 0.4, "c": 0.6, "d": 0.0}
    df = spark.createDataFrame([(i, t, s) for i, (t, s) in enumerate(strength.items())], "slot int, team string, strength double")
    won = Counter()
    for sim in range(50):
        alive = list(strength)
        for r in (1, 2):
            nxt = []
            for i in range(len(alive) // 2):
                a, b = alive[2 * i], alive[2 * i + 1]
                x, y = (max(strength[t], 1e-6) ** 2.8 for t in (a, b))
                u = int(hashlib.md5(f"5|{sim}|{r}|{i}".encode()).hexdigest()[:12], 16) / (1 << 48)
                nxt.append(a if u < x / (x + y) else b)
            alive = nxt
            won.update((t, r) for t in alive)
    got = {(r.team, r["round"]): r.share for r in tournament.simulated_bracket(df, 2, 50, 5).collect()}
    assert got == {k: n / 50 for k, n in won.items()}


def test_matching_equals_all_pairs(spark):
    """Blocking by rare letter pairs loses no pair that reaches the similarity: against SequenceMatcher on every pair."""
    import random
    from difflib import SequenceMatcher

    rng = random.Random(3)
    names = ["".join(rng.choice("abcde ") for _ in range(rng.randint(1, 24))).strip() or "x" for _ in range(60)] + ["aaaaaaaaaa", "aaaaaaaaab", "abababababab"]

    def typo(t):
        t = list(t)
        for _ in range(rng.randint(0, 2)):
            k = rng.randrange(len(t) + 1)
            t[k : k + rng.randint(0, 1)] = rng.choice(["", "b", "z"])
        return "".join(t)

    source, canonical = [(i, typo(n), i % 2) for i, n in enumerate(names)], [(100 + i, n, i % 2) for i, n in enumerate(names)]
    key = lambda t: " ".join("".join(c if c.isalnum() else " " for c in t.lower()).split())
    want = {}
    for i, t, g in source:
        own = [(cid, key(n)) for cid, n, h in canonical if h == g]
        same = [cid for cid, n in own if n == key(t) and n]
        if same:
            want[i] = (same[0], "exact") if len(same) == 1 else (None, "ambiguous")
            continue
        score, cid = max(((SequenceMatcher(None, key(t), n).ratio(), -cid) for cid, n in own if key(t)), default=(0, 0))
        want[i] = (-cid, "fuzzy" if score >= 0.97 else "review") if score >= 0.9 else (None, "unmatched")
    s = spark.createDataFrame(source, "sid int, name string, g int")
    c = spark.createDataFrame(canonical, "cid int, cname string, g int")
    got = {r.sid: (r.cid, r.method) for r in identity.matched(s, c, "sid", "name", "cid", "cname", ["g"]).collect()}
    assert got == want and {m for _, m in want.values()} >= {"exact", "review", "unmatched"}


def test_names_and_positions_fold_like_decomposed_text(spark):
    import unicodedata

    texts = ["Jose\u0301 Félix", "Mușat Țîru", "Ñandú & Co/Ltd", "ﬁne ǆ ½", "Ａｂｃ１", "Đorđe Øre ßen", "  Centre-Back ", "GK", "D M S", "unknown role", ""]

    def plain(t):
        t = unicodedata.normalize("NFKD", t.strip().lower())
        t = "".join(x for x in t if not unicodedata.combining(x)).replace("&", " and ")
        return " ".join("".join(x if x in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for x in t).split())

    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i")
    assert [r[0] for r in df.select(scalar.name_key(F.col("t"))).collect()][:3] + [r[0] for r in df.select(scalar.name_key(F.col("t"))).collect()][4:] == [plain(t) for t in texts[:3] + texts[4:]]
    assert [r[0] for r in df.select(scalar.position_group(F.col("t"))).collect()][6:] == ["cb", "gk", "fb", "unknown role", ""]


def test_ranges_give_what_whole_windows_give(spark):
    from pyspark.sql import Window

    from touchline.operators import ranges

    df = spark.range(3000).select((F.col("id") % 3).alias("g"), (F.pmod(F.xxhash64("id"), F.lit(200))).alias("v"), F.col("id").alias("k"), (F.col("id") % 7).cast("double").alias("x"))
    w = Window.partitionBy("g").orderBy("v", "k")
    want = {r.k: (r.s, r.i, r.m) for r in df.select("k", F.sum("x").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("s"), (F.row_number().over(w) - 1).alias("i"), F.avg("x").over(w.rowsBetween(-3, 0)).alias("m")).collect()}
    rows = ranges.running(df, ["g"], ["v", "k"], {"s": F.col("x")})
    few = ranges.in_blocks(rows, 3, block=50).withColumn("m", F.avg("x").over(Window.partitionBy("g", "_block").orderBy("_i").rowsBetween(-3, 0))).where("_own")
    assert {r.k: (r.s, r._i, r.m) for r in few.collect()} == want
    rank = Window.partitionBy("g").orderBy("v")
    want = {(r.g, r.v, r.b) for r in df.select("g", "v", (F.rank().over(rank) - 1).alias("b")).collect()}
    assert {(r.g, r.v, r.below) for r in ranges.value_ranks(df, ["g"], "v").collect()} == want


def test_zones_count_missing_values_as_zero(spark):
    df = spark.createDataFrame([(None, None), (84.0, 15.9), (66.7, 46.0), (float("nan"), 91.0)], "x double, m double")
    got = [tuple(r) for r in df.select(actions.zone(F.col("x")), actions.time_bucket(F.col("m"))).collect()]
    assert got[:3] == [("defensive_third", "0-15"), ("penalty_area", "0-15"), ("final_third", "46-60")] and got[3][1] == "76-90+"


def test_shrinkage_without_minutes_is_the_prior(spark):
    from touchline.operators import stats

    df = spark.createDataFrame([(None,), (-5.0,), (float("nan"),), (900.0,)], "m double")
    assert [r[0] for r in df.select(stats.shrunk(F.lit(10.0), F.col("m"), F.lit(2.0), 900.0)).collect()] == [2.0, 2.0, 2.0, 6.0]


# Rules of labels and reports on small cases


def test_label_rules(spark):
    from touchline.operators import labels

    truth = spark.createDataFrame([("award", "2324", "2024-05-31"), (" Award ", "2324", "2024-06-01"), ("expert_tier", "2324", "2024-01-01"), ("scouting_review", "2023-24", "2024-01-01"), ("manual_calibration", "2324", "soon"), ("transfermarkt_value", None, None)], "label_source string, season string, as_of string")
    r = labels.temporal(truth, "label_source", "season", "as_of").first()
    assert tuple(r) == (1, 2, 2, 1)
    assert labels.temporal(truth.limit(0), "label_source", "season", "as_of").first().post_season_rows == 0
    ledger = spark.createDataFrame([(1, "confirmed", None, "human_tier", "x", "2024-01-01/2024-02-01", 1, 2), (2, "confirmed", None, "future_outcome", " ", "2024", 1, 2), (3, "confirmed", None, "human_pairwise_preference", "x", None, 5, 5), (4, "revoked", None, "model_derived", "", None, 1, 1)], "decision_id int, action string, supersedes int, label_type string, evidence string, observation_window string, a int, b int")
    assert sorted(map(tuple, labels.independence(ledger).collect())) == [(2, "evidence_empty"), (2, "observation_window_invalid"), (3, "observation_window_invalid"), (3, "pairwise_self_comparison")]
    assert {x.decision_id for x in labels.eligible(ledger, "label_type", labels.ELIGIBLE).collect()} == {1, 2, 3}


def scored_rows(spark, rows):
    from touchline.operators import backtest

    return backtest.scored(spark.createDataFrame(rows, "match_id int, match_date date, home string, away string, home_goals int, away_goals int, p_home double, p_draw double, p_away double, outcome string"))


def test_drift_of_a_team_runs_from_its_own_first_match(spark):
    import datetime as dt

    from touchline.operators import reports

    good, bad = (0.8, 0.1, 0.1, "home"), (0.1, 0.1, 0.8, "home")
    days = [(0, good), (5, good), (20, good), (25, good), (41, bad), (45, bad)]
    rows = [(k, dt.date(2024, 3, 1) + dt.timedelta(days=d), "a", "b", 1, 0, *f) for k, (d, f) in enumerate(days)] + [(50, dt.date(2024, 1, 1), "c", "a", 1, 0, *good), (51, None, "a", "b", 1, 0, *good)]
    got = {r.team: r for r in reports.team_drift(scored_rows(spark, rows), 20, 2).collect()}
    low, high = 0.06, 0.9**2 + 0.1**2 + 0.8**2
    assert got["a"].windows == 3 and got["a"].n == 6 and got["a"].trend == "degrading" and got["a"].drifted
    assert got["a"].relative_change == pytest.approx((high - low) / low)
    assert (got["c"].windows, got["c"].trend, got["c"].drifted, got["c"].latest_brier) == (0, "insufficient_data", False, 0.0)


def test_profiles_take_the_best_from_correct_forecasts(spark):
    import datetime as dt

    from touchline.operators import reports

    day = dt.date(2024, 3, 1)
    rows = [(1, day, "a", "b", 2, 0, 0.5, 0.3, 0.2, "home"), (2, day, "a", "b", 0, 0, 0.4, 0.35, 0.25, "draw"), (3, day, "b", "a", 0, 2, 0.2, 0.2, 0.6, "away"), (4, day, "a", "c", 1, 1, 0.36, 0.33, 0.31, "draw")]
    got = {r.team: r for r in reports.team_profiles(scored_rows(spark, rows), 2, 1).collect()}
    a = got["a"]
    assert (a.best, a.worst) == ("3|1", "4|2")
    assert a.common_scores == "2-0:2|0-0:1|1-1:1" and (a.clean_sheets, a.both_scored, a.goals_for) == (0.75, 0.25, 1.25)
    assert a.overperformance == pytest.approx(0.5 - (0.5 + 0.4 + 0.6 + 0.36) / 4) and got["c"].best == ""


def test_folds_and_age(spark):
    import datetime as dt

    from touchline.operators import reports

    rows = [(k, dt.date(2024, 1, 1 + k), "a", "b", 1, 0, *((0.6, 0.2, 0.2) if k % 4 else (0.2, 0.2, 0.6)), "home") for k in range(8)]
    df = scored_rows(spark, rows).withColumn("fold", F.when(F.col("match_id") < 4, 1).otherwise(2))
    got = reports.fold_report(df, "fold", 2).collect()
    assert len(got) == 2 and {r.stability for r in got} == {"stable"} and got[0].accuracy == 0.75 and got[0].accuracy_std == 0
    age = reports.staleness(df, ["home"], "match_date", F.to_date(F.lit("2023-12-01")), 30, 90).first()
    assert (age.age_days, age.status) == (0, "fresh")
    assert reports.staleness(df, ["home"], "match_date", F.to_date(F.lit("2024-03-01")), 30, 90).first().status == "aging"


def test_no_match_left_is_dropped(spark):
    from touchline.operators import tournament

    played = spark.createDataFrame([("g", t, 0, 0, 0) for t in "abcd"], "group string, team string, pts int, gd int, gf int")
    left = spark.createDataFrame([(k, "g", *p) for k, p in enumerate(("ab", "ac", "ad", "bc", "bd", "cd"))], "match_id int, group string, home string, away string")
    got = tournament.qualification(tournament.scenarios(played, left)).collect()
    assert {r.scenarios for r in got} == {729} and {r.status for r in got} == {"open"} and sum(r.through for r in got) == 2 * 729


def test_cases_are_not_rows_that_move(spark):
    """Simulated seasons, simulated groups and scenarios: no case of a season or group is shuffled as a row of its own; a group without matches left is as it stands."""
    from touchline.operators import tournament

    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    t = spark.createDataFrame([(1, 1, x, 0) for x in range(4)], "league long, season long, team long, pts long")
    f = spark.createDataFrame([(f"{a}-{b}", 1, 1, a, b, 0.5, 0.2) for a in range(4) for b in range(4) if a != b], "match_id string, league long, season long, home long, away long, p_home double, p_draw double")
    seasons = league.simulated_seasons(t, f, 37, 1)
    assert "hashpartitioning(sim" not in plan(seasons)
    assert abs(seasons.agg(F.sum("mean_place")).first()[0] - 10) < 1e-9 and abs(seasons.agg(F.sum("p_first")).first()[0] - 1) < 1e-9
    played = spark.createDataFrame([("a", x, 3 - x, 0, 0) for x in range(3)] + [("b", 7, 1, 0, 0), ("b", 8, 1, 0, 0)], "group string, team long, pts long, gd long, gf long")
    left = spark.createDataFrame([(1, "a", 0, 1, 0.9), (2, "a", 1, 2, 0.5)], "match_id long, group string, home long, away long, p_home double")
    groups = tournament.simulated_groups(played, left, 20, 3, 1)
    assert "hashpartitioning(sim" not in plan(groups) and "hashpartitioning(scenario" not in plan(tournament.scenarios(played, left))
    got = {(r.group, r.team): (r.p_first, r.p_through) for r in groups.collect()}
    assert got["b", 7] == (1.0, 1.0) and got["b", 8] == (0.0, 0.0) and abs(sum(v[0] for k, v in got.items() if k[0] == "a") - 1) < 1e-9
    cases = {(r.group, r.team): (r.scenarios, r.through, r.best, r.worst) for r in tournament.scenarios(played, left, 1).collect()}
    want = {x: [] for x in range(3)}
    for s, u in product((1, 0, -1), repeat=2):
        end = {0: [3, 0, 0], 1: [2, 0, 0], 2: [1, 0, 0]}
        for home, away, z in ((0, 1, s), (1, 2, u)):
            for team, y in ((home, z), (away, -z)):
                end[team] = [end[team][0] + (3 if y > 0 else 1 if y == 0 else 0), end[team][1] + y, end[team][2] + max(y, 0)]
        for place, team in enumerate(sorted(end, key=lambda x: ([-v for v in end[x]], x)), 1):
            want[team].append(place)
    assert cases == {("a", x): (9, sum(p == 1 for p in v), min(v), max(v)) for x, v in want.items()}


def test_nearest_by_blocks_is_the_plain_form_to_the_last_bit(spark, monkeypatch):
    """Missing, empty, zero, infinite, huge and tiny vectors, repeated and missing keys, ties."""
    monkeypatch.setattr(stats, "VECTOR_BLOCK", 64, raising=False)
    monkeypatch.setattr(stats, "QUERY_BLOCK", 16)
    odd = [None, [1.0, None, 2.0], [], [1.0, 2.0], [0.0, 0.0, 0.0], [float("nan"), 1.0, 1.0], [float("inf"), 1.0, 1.0], [1e200, 1e200, -1e200], [1e-170, 1e-170, 0.0]]
    made = [(f"k{i % 180:03d}" if i % 41 else None, odd[i // 3 % 9] if i % 3 == 0 else [float(i * d % 7 - 3) for d in (1, 3, 5)]) for i in range(200)]
    v = spark.createDataFrame(made, "id string, v array<double>")
    q = v.where("id like '%0' or id like '%7'")
    got = stats.nearest(v, q, "id", "v", 5)
    assert "MapInArrow" in got._jdf.queryExecution().executedPlan().toString()  # no cosine of column expressions for each pair
    pairs = v.join(q.select(F.col("id").alias("query"), F.col("v").alias("_q")), F.col("id") != F.col("query")).select("query", F.col("id").alias("neighbour"), (stats.cosine(F.col("_q"), F.col("v")) + 0.0).alias("similarity"))
    want = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), "neighbour"))).where("rank <= 5")
    listed = lambda df: sorted(map(repr, df.select("query", "rank", "neighbour", F.col("similarity") + 0.0).collect()))
    assert listed(got) == listed(want)
