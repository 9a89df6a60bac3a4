"""Ratings of squads against the plain cascade, and strengths and depth of small squads."""

import random

from touchline.operators import squads

RATING = "name string, k int, season string, score double, league string"


def plain(name, ratings):
    if name is None:
        return None, None, None
    words = name.lower().split()
    for level, test in (("exact", lambda r: r == name), ("case", lambda r: r.lower() == name.lower()), ("last_name", lambda r: bool(words) and words[-1] in r.lower())):
        hits = [r for r in ratings if r[0] is not None and test(r[0])]
        if hits:
            best = min(hits, key=lambda r: (r[2] != "2526", r[1]))
            sure = None if best[3] is None else "high" if best[4] in squads.BIG else "medium"
            return level, best[3], sure
    return None, None, None


def test_cascade_equals_plain_loop(spark):
    rng = random.Random(5)
    syllables = ["an", "bo", "Ca", "de", "é", "Fu", "n", "ß", "İ"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3)))
    names = [" ".join(word() for _ in range(rng.randint(1, 3))) for _ in range(120)]
    ratings = [(rng.choice([*names, None]), k, rng.choice(["2425", "2526", None]), rng.choice([None, float(k)]), rng.choice(["Serie A", "HNL", None])) for k in range(150)]
    asked = [*names, *(n.upper() for n in names[:40]), *(f"x {n.split()[-1][1:]}" for n in names[:60]), "", "  ", None, "nobody at all", "word" * 2000]
    ratings = [r for r in ratings if r[0] is None or "İ" not in r[0]]  # Java and Python lower it to different lengths
    asked = [n for n in asked if n is None or "İ" not in n and "i̇" not in n]
    got = squads.rated(spark.createDataFrame([(i, n) for i, n in enumerate(asked)], "id int, name string"), spark.createDataFrame(ratings, RATING), "k", latest="2526").collect()
    assert len(got) == len(asked)
    for r in got:
        assert (r.match_level, r.rating, r.rating_confidence) == plain(r.name, ratings), r
    assert {r.match_level for r in got} == {"exact", "case", "last_name", None}


def test_no_ratings_and_repeated_players(spark):
    squad = spark.createDataFrame([("a b",), ("a b",), (None,)], "name string")
    none = spark.createDataFrame([], RATING)
    assert [r.match_level for r in squads.rated(squad, none, "k").collect()] == [None] * 3
    assert squads.rated(squad.limit(0), spark.createDataFrame([("a", 1, "x", 1.0, "l")], RATING), "k").count() == 0
    both = squads.rated(squad, spark.createDataFrame([("a b", 1, "x", float("nan"), "l")], RATING), "k").collect()
    assert sorted(str(r.match_level) for r in both) == ["None", "exact", "exact"] and all(r.rating is None for r in both)


def test_strength_and_depth(spark):
    squad = [("A", "GK", 70.0, "Serie A")] * 12 + [("A", "ST", None, "HNL")] * 8 + [("B", "CB", None, None)]
    df = spark.createDataFrame(squad, "team string, role string, rating double, league string")
    got = {r.team: r for r in squads.strengths(df, "team", "league", known={"HNL": 44.5}, chances={"A": 0.2}, hosts=["B"]).collect()}
    a, b = got["A"], got["B"]
    proxy = (12 * 58 + 8 * 44.5) / 20
    assert abs(a.core_avg_rating - 70) < 1e-9 and abs(a.depth_avg_rating - (70 + 6 * 44.5) / 7) < 1e-9 and abs(a.reserve_avg_rating - 44.5) < 1e-9
    quality = 0.55 * 70 + 0.2 * (70 + 6 * 44.5) / 7 + 4.45 + 0.15 * (0.6 * 70 + 0.4 * proxy)
    assert abs(a.strength - (0.46 * (quality - 30) / 40 + 0.24 + 0.18 * (proxy - 35) / 25 + 0.07 * 0.6**0.7 + 0.05)) < 1e-9
    assert (b.observed_avg_rating, b.reserve_avg_rating, b.rated_players) == (43.0, 42.0, 0)
    assert abs(b.strength - (0.46 * 0.3 + 0.24 / 16 + 0.18 * 0.28 + 0.04)) < 1e-9
    per = {(r.team, r.role): (r.n, r.depth_status, r.coverage) for r in squads.depth(df, "team", "role").collect()}
    assert len(per) == 16 and per["A", "GK"] == (12, "deep", 1.0) and per["B", "CB"] == (1, "thin", 0.0) and per["B", "W"] == (0, "missing", 0.0)
    assert {(r.team, r.unit): (r.n, r.n_rated) for r in squads.units(df, "team", "role").collect() if r.n} == {("A", "goalkeepers"): (12, 12), ("A", "attack"): (8, 0), ("B", "defense"): (1, 0)}
