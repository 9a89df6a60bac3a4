"""Group tables with head-to-head records, best third places, group forecasts and simulated knockout brackets."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .league import DRAW, knockout_probability, uniform

#: How strengths are spread before group places are forecast, and the third places that advance.
GROUP_POWER, THIRDS, GROUPS = 2.5, 8, 12
#: Cases, and places in all, that a task works out at a time.
CASES, CELLS = 4096, 1 << 18


def group_tables(teams: DataFrame, by: Sequence[str]) -> DataFrame:
    """Tables of team rows by group: played, pts, gd, gf, head_to_head and place.

    Places go by points, goal difference and goals; then, where all teams level on these have met each other, by the
    same three of the matches among them (head_to_head says so); then by name.
    """
    gd = F.col("goals_for") - F.col("goals_against")
    table = teams.groupBy(*by, "team").agg(F.count("*").alias("played"), F.sum("points").alias("pts"), F.sum(gd).alias("gd"), F.sum("goals_for").alias("gf"))
    level = Window.partitionBy(*by, "pts", "gd", "gf")
    table = table.withColumn("_n", F.count("*").over(level))
    tied = table.where("_n > 1").select(*by, "team", F.struct("pts", "gd", "gf").alias("_own"))
    other = tied.select(*by, F.col("team").alias("opponent"), F.col("_own").alias("_other"))
    among = teams.join(tied, [*by, "team"]).join(other, [*by, "opponent"]).where("_own = _other")
    among = among.groupBy(*by, "team").agg(F.sum("points").alias("_p"), F.sum(gd).alias("_d"), F.sum("goals_for").alias("_g"), F.count_distinct("opponent").alias("_met"))
    out = table.join(among, [*by, "team"], "left").withColumn("head_to_head", (F.col("_n") > 1) & (F.min(F.coalesce("_met", F.lit(0))).over(level) == F.col("_n") - 1))
    mini = [F.desc(F.when(F.col("head_to_head"), F.col(c)).otherwise(0)) for c in ("_p", "_d", "_g")]
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("pts"), F.desc("gd"), F.desc("gf"), *mini, "team"))
    return out.withColumn("place", place).select(*by, "team", "played", "pts", "gd", "gf", "head_to_head", "place")


def best_of_place(tables: DataFrame, group: str, by: Sequence[str], place: int, n: int) -> DataFrame:
    """The best n teams of one place across the groups of each edition, by points, goal difference, goals, group and name."""
    w = Window.partitionBy(*by).orderBy(F.desc("pts"), F.desc("gd"), F.desc("gf"), group, "team")
    return tables.where(F.col("place") == place).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def advancing(tables: DataFrame, group: str, by: Sequence[str], thirds: int) -> DataFrame:
    """Winners, runners-up and the best third places, with how each came through."""
    through = F.when(F.col("place") == 1, "winner").otherwise("runner-up")
    top = tables.where("place <= 2").select(*by, group, "team", through.alias("through"))
    return top.unionByName(best_of_place(tables, group, by, 3, thirds).select(*by, group, "team", F.lit("third").alias("through")))


def group_places(teams: DataFrame, group: str, team: str, strength: str, power: float = GROUP_POWER, thirds: float = THIRDS / GROUPS) -> DataFrame:
    """Chances of each place in a group when teams are drawn in turn by strength, and of advancing.

    Each team meets its group as one array, which a group's few teams bound. A third place advances in a share
    `thirds` of cases.
    """
    own = teams.select(group, team, strength, F.pow(F.col(strength), F.lit(power)).alias("_s"))
    own = own.withColumn("_g", F.collect_list(F.struct(F.col(team).alias("t"), F.col("_s").alias("s"))).over(Window.partitionBy(group)))
    others = F.filter("_g", lambda x: x["t"] != F.col(team))
    sum_of = lambda array, f: F.aggregate(array, F.lit(0.0), lambda acc, x: acc + f(x))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    own = own.withColumn("_o", others).withColumn("_t", sum_of(F.col("_g"), lambda x: x["s"]))
    s, total, rest = F.col("_s"), F.col("_t"), F.col("_o")
    second = sum_of(rest, lambda j: ratio(j["s"], total) * ratio(s, total - j["s"]))
    third = sum_of(rest, lambda j: sum_of(rest, lambda k: F.when(k["t"] == j["t"], 0.0).otherwise(ratio(j["s"], total) * ratio(k["s"], total - j["s"]) * ratio(s, total - j["s"] - k["s"]))))
    own = own.withColumns({"p1": ratio(s, total), "p2": second, "p3": third})
    return own.select(group, team, "p1", "p2", "p3", F.greatest(1 - F.col("p1") - F.col("p2") - F.col("p3"), F.lit(0.0)).alias("p4"), F.least(F.col("p1") + F.col("p2") + F.col("p3") * thirds, F.lit(1.0)).alias("p_advance"))


def tie_chance(home: Column, away: Column) -> Column:
    """The home side's chance in a tie without draws; even where neither has any strength."""
    least = F.lit(1e-6)
    return F.when((home <= 0) & (away <= 0), 0.5).otherwise(knockout_probability(F.greatest(home, least), F.greatest(away, least)))


def _winner(alive: str, r: int, seed: int) -> Callable[[Column], Column]:
    """Who wins tie i of round r among the teams still in."""

    def of(i: Column) -> Column:
        a, b = F.get(F.col(alive), i * 2), F.get(F.col(alive), i * 2 + 1)
        return F.when(uniform(F.lit(seed), F.col("sim"), F.lit(r), i) < tie_chance(a["strength"], b["strength"]), a).otherwise(b)

    return of


def simulated_bracket(bracket: DataFrame, rounds: int, sims: int, seed: int) -> DataFrame:
    """(team, round, share): the share of simulations in which each team wins so many rounds or more.

    bracket: slot (0 to 2 ** rounds - 1), team, strength; slots 2i and 2i + 1 meet, then the winners in order. A
    simulation is one row with the teams still in as an array, so rounds need no shuffle; the draws follow from seed,
    simulation, round and tie alone.
    """
    first = bracket.agg(F.transform(F.sort_array(F.collect_list(F.struct("slot", "team", F.col("strength").cast("double").alias("strength")))), lambda x: F.struct(x["team"].alias("team"), x["strength"].alias("strength"))).alias("alive"))
    runs = bracket.sparkSession.range(sims).select(F.col("id").alias("sim")).crossJoin(F.broadcast(first))
    for r in range(1, rounds + 1):
        ties = F.sequence(F.lit(0), F.lit((1 << (rounds - r)) - 1))
        runs = runs.withColumn(f"alive_{r}", F.transform(ties, _winner("alive" if r == 1 else f"alive_{r - 1}", r, seed)))
    alive = [F.col(f"alive_{r}") for r in range(1, rounds + 1)]
    by_round = runs.select(F.posexplode(F.array(*alive)).alias("_r", "_alive")).select((F.col("_r") + 1).alias("round"), F.explode("_alive.team").alias("team"))
    return by_round.groupBy("team", "round").agg((F.count("*") / sims).alias("share"))


def places(base: np.ndarray, home: np.ndarray, away: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """(groups, cases, teams): each team's place once a case of the matches left is over.

    base: (groups, teams, 3), points, goal difference and goals so far, teams by name. home, away: (groups, matches), the
    place of a team in its group from 1, or 0. signs: (groups or 1, cases, matches), 1, 0 or -1 for 1-0, 0-0 or 0-1.
    """
    g, teams = base.shape[:2]
    total = np.repeat(base[:, None], signs.shape[1], axis=1)
    signs = np.broadcast_to(signs, (g, *signs.shape[1:]))
    for m in range(home.shape[1]):
        for side, s in ((home[:, m], signs[..., m]), (away[:, m], -signs[..., m])):
            known = np.flatnonzero(side > 0)
            s = s[known]
            total[known, :, side[known] - 1] += np.stack((np.where(s > 0, 3, np.where(s == 0, 1, 0)), s, np.maximum(s, 0)), axis=-1)
    out = np.ones(total.shape[:3], dtype=np.int64)
    for t in range(teams):
        for u in range(teams):
            if u != t:
                better = np.full(total.shape[:2], u < t)
                for k in (2, 1, 0):
                    x, y = total[:, :, u, k], total[:, :, t, k]
                    better = (x > y) | ((x == y) & better)
                out[:, :, t] += better
    return out


def _counted(played: DataFrame, left: DataFrame, how: str, through: int, drawn: Sequence[str] = ()) -> DataFrame:
    """(group, team, _x): in how many cases a team is first, among the first `through`, its best and worst place, and the cases: those drawn, or all 3 ** n. A group is one row, so no case is a row of its own."""

    @F.pandas_udf("array<array<long>>")
    def counts(pts: pd.Series, gd: pd.Series, gf: pd.Series, home: pd.Series, away: pd.Series, cases: pd.Series) -> pd.Series:
        out = [None] * len(pts)
        shapes = {}
        for i, (p, h, c) in enumerate(zip(pts, home, cases, strict=True)):
            shapes.setdefault((len(p), len(h), len(c)), []).append(i)
        for (teams, matches, given), rows in shapes.items():
            n = (given // matches if given else 1) if drawn else 3**matches
            some, most = max(1, CELLS // (min(n, CASES) * teams)), min(n, CASES)
            for at in range(0, len(rows), some):
                own = rows[at : at + some]
                of = lambda c, k=float: np.array([np.asarray(c[i], dtype=k) for i in own], dtype=k)  # noqa: B023, E731
                base, h, a = np.stack((of(pts), of(gd), of(gf)), axis=-1), of(home, int).reshape(len(own), matches), of(away, int).reshape(len(own), matches)
                ends = np.zeros((len(own), teams, 5), dtype=np.int64)
                ends[..., 2] = teams
                for first in range(0, n, most):
                    last = min(first + most, n)
                    if drawn:
                        signs = of(cases, int).reshape(len(own), matches, -1)[:, :, first:last].transpose(0, 2, 1) if given else np.zeros((1, 1, 0), dtype=int)
                    else:
                        signs = 1 - (np.arange(first, last)[None, :, None] // 3 ** np.arange(matches)) % 3
                    place = places(base, h, a, signs)
                    ends[..., 0] += (place == 1).sum(axis=1)
                    ends[..., 1] += (place <= through).sum(axis=1)
                    ends[..., 2] = np.minimum(ends[..., 2], place.min(axis=1))
                    ends[..., 3] = np.maximum(ends[..., 3], place.max(axis=1))
                ends[..., 4] = n
                for i, x in zip(own, ends.tolist(), strict=True):
                    out[i] = x
        return pd.Series(out)

    number = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(float("-inf"))).alias(c)
    tables = played.groupBy("group").agg(F.sort_array(F.collect_list(F.struct("team", *[number(c) for c in ("pts", "gd", "gf")]))).alias("_t"))
    rest = left.groupBy("group").agg(F.sort_array(F.collect_list(F.struct("match_id", "home", "away", *drawn))).alias("_m"))
    both = tables.join(rest, "group", how)
    of = lambda c: F.transform("_t", lambda t: t[c])
    at = lambda side: F.coalesce(F.transform("_m", lambda m: F.coalesce(F.array_position(of("team"), m[side]), F.lit(0)).cast("long")), F.array().cast("array<long>"))
    cases = F.coalesce(F.flatten(F.transform("_m", lambda m: m[drawn[0]])), F.array().cast("array<byte>")) if drawn else F.array().cast("array<byte>")
    both = both.withColumn("_r", counts(of("pts"), of("gd"), of("gf"), at("home"), at("away"), cases))
    return both.select("group", F.explode(F.zip_with("_t", "_r", lambda t, r: F.struct(t["team"].alias("team"), r.alias("_x")))).alias("x")).select("group", "x.*")


def simulated_groups(played: DataFrame, left: DataFrame, sims: int, seed: int, through: int = 2) -> DataFrame:
    """(group, team, p_first, p_through): shares of simulations in which a team wins its group, and ends among the first `through`.

    played: group, team, pts, gd, gf so far of every team. left: match_id, group, home, away, p_home, the home side's
    chance without draws. A match left is drawn in DRAW of all cases, and ends 1-0, 0-0 or 0-1; level teams go by name.
    """
    u = lambda sim: uniform(F.lit(seed), sim, F.col("match_id"))
    win = F.col("p_home") * (1 - DRAW)
    signs = F.transform(F.sequence(F.lit(0), F.lit(sims - 1)), lambda sim: F.when(u(sim) < win, 1).when(u(sim) < win + DRAW, 0).otherwise(-1).cast("byte"))
    out = _counted(played, left.withColumn("_s", signs), "left", through, ["_s"])
    return out.select("group", "team", (F.col("_x")[0] / F.col("_x")[4]).alias("p_first"), (F.col("_x")[1] / F.col("_x")[4]).alias("p_through"))


def scenarios(played: DataFrame, left: DataFrame, through: int = 2) -> DataFrame:
    """(group, team, scenarios, through, best, worst): over all 3 ** n outcomes of a group's n matches left, how often a team ends among the first `through`, and its best and worst place. Groups without a match left have no rows; a round of four teams has six matches, 729 outcomes."""
    out = _counted(played, left, "inner", through)
    return out.select("group", "team", F.col("_x")[4].alias("scenarios"), F.col("_x")[1].alias("through"), F.col("_x")[2].alias("best"), F.col("_x")[3].alias("worst"))


def qualification(cases: DataFrame) -> DataFrame:
    """scenarios() with a status: through, out or open."""
    return cases.withColumn("status", F.when(F.col("through") == F.col("scenarios"), "through").when(F.col("through") == 0, "out").otherwise("open"))
