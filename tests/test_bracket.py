"""Brackets against the enumeration of all outcomes, and replay and edits step by step."""

import itertools

import pytest

from touchline.operators import bracket as br

STRENGTH = [1.0, 2.0, 0.5, 3.0, 1.5, 0.0, 0.0, 2.5]
RESULTS = "bracket string, round int, tie long, home_goals int, away_goals int, penalties_winner string"


def entrants(spark, missing=()):
    return spark.createDataFrame([("x", k, f"t{k}", s) for k, s in enumerate(STRENGTH) if k not in missing], "bracket string, slot int, team string, strength double")


def p(a, b):
    a, b = STRENGTH[a], STRENGTH[b]
    x, y = max(a, 1e-6) ** 2.8, max(b, 1e-6) ** 2.8
    return 0.5 if a <= 0 and b <= 0 else x / (x + y)


def enumerated(known, missing=()):
    """Probability of winning each round by all 2 ** 7 outcomes of the ties; known: (round, tie) -> slot."""
    total = {}
    for sides in itertools.product((0, 1), repeat=7):
        alive, weight, at, won = [k if k not in missing else None for k in range(8)], 1.0, 0, []
        for r in (1, 2, 3):
            out = []
            for tie in range(len(alive) // 2):
                a, b = alive[2 * tie : 2 * tie + 2]
                first = sides[at] == 0
                at += 1
                if a is None or b is None:
                    weight *= 0.5
                    w = a if b is None else b
                elif (r, tie) in known:
                    weight *= 0.5
                    w = known[r, tie]
                else:
                    weight *= p(a, b) if first else 1 - p(a, b)
                    w = a if first else b
                out.append(w)
                won.append((r, w))
            alive = out
        for x in won:
            total[x] = total.get(x, 0.0) + weight
    return total


@pytest.mark.parametrize("games,known,missing", [([], {}, ()), ([("x", 1, 0, 0, 2, None), ("x", 1, 1, 1, 1, "t2"), ("x", 2, 0, 3, 0, None)], {(1, 0): 1, (1, 1): 2, (2, 0): 1}, ()), ([("x", 1, 3, 0, 0, "t6")], {(1, 3): 6}, (0, 4, 5))])
def test_chances_equal_enumeration(spark, games, known, missing):
    e = entrants(spark, missing)
    state = br.replayed(e, spark.createDataFrame(games, RESULTS), 3)
    want = enumerated(known, missing)
    got = {(r.round, int(r.team[1])): r.p for r in br.chances(e, state, 3).collect()}
    for key, value in got.items():
        assert value == pytest.approx(want.get(key, 0.0), abs=1e-12), key
    rows = br.scenarios(e, state, 3).collect()
    for r in rows:
        t = int(r.team[1])
        title = want.get((3, t), 0.0)
        assert r.title == pytest.approx(title) and r.title_if_win == pytest.approx(title / want[r.round, t]) and r.title_if_lose == 0
        assert (r.opponent is None) == (r.win_probability is None)
        if r.opponent:
            assert r.win_probability == pytest.approx(p(t, int(r.opponent[1])))
    if known and not missing:
        assert {(r.team, r.round) for r in rows if r.team in ("t0", "t1")} == {("t1", 3)}


def test_replay_says_what_is_wrong(spark):
    games = [("x", 1, 0, 1, 1, None), ("x", 1, 1, 2, 0, None), ("x", 2, 0, 1, 0, None), ("x", 1, 2, -1, 0, None), ("x", 1, 3, 1, 0, None), ("x", 1, 3, 0, 1, None), ("y", 1, 0, 1, 0, None)]
    got = {(r.round, r.tie): r for r in br.replayed(entrants(spark), spark.createDataFrame(games, RESULTS), 3).collect()}
    assert {k: v.problem for k, v in got.items() if v.problem} == {(1, 0): "no_winner", (2, 0): "not_ready", (1, 2): "negative_goals", (1, 3): "repeated"}
    assert got[1, 1].winner == "t2" and got[1, 1].status == "completed" and got[1, 0].status == "scheduled" and got[2, 0].status == "pending" and (got[2, 0].home, got[2, 0].away) == (None, "t2")
    assert br.replayed(entrants(spark).limit(0), spark.createDataFrame(games, RESULTS), 3).count() == 0


def test_an_edit_clears_all_later_ties(spark):
    games = [("x", r, t, 1, 0, None) for r, n in ((1, 4), (2, 2), (3, 1)) for t in range(n)] + [("y", 3, 0, 1, 0, None)]
    edits = spark.createDataFrame([("x", 1, 2)], "bracket string, round int, tie long")
    got = {tuple(r)[:3] for r in br.cleared(spark.createDataFrame(games, RESULTS), edits, 3).collect()}
    assert got == {("x", 1, 0), ("x", 1, 1), ("x", 1, 3), ("x", 2, 0), ("y", 3, 0)}
