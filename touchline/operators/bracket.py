"""Knockout brackets, many at once: replay of results, edits with all that depends on them, exact chances round by round, and what-if scenarios.

entrants: bracket, slot, team, strength; slots 2i and 2i + 1 meet in tie i of round 1, the winners of ties 2i and 2i + 1
in tie i of the next round. A slot without a team gives a walkover. results: bracket, round, tie, home_goals,
away_goals, penalties_winner. Rounds are few, so a loop over them builds one plan; within it brackets are independent rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .league import KNOCKOUT_POWER

#: Fixed value: the least strength that counts.
LEAST = 1e-6


def chance(own: Column, other: Column, k: float = KNOCKOUT_POWER) -> Column:
    """The chance of a strength against another; even if neither is positive."""
    a, b = (F.pow(F.greatest(x, F.lit(LEAST)), F.lit(k)) for x in (own, other))
    return F.when((own <= 0) & (other <= 0), F.lit(0.5)).otherwise(a / (a + b))


def replayed(entrants: DataFrame, results: DataFrame, rounds: int) -> DataFrame:
    """(bracket, round, tie, home, away, winner, status, problem) of every tie in which a team can be.

    A result counts if both teams are known, no goals are negative, and a level score names one of the two as winner on
    penalties; else the tie stays open and problem says why: not_ready, negative_goals, no_winner, or repeated, where a
    tie has several results. status: completed, scheduled (both teams known), walkover, or pending.
    """
    alive = entrants.select("bracket", F.col("slot").cast("long").alias("slot"), "team")
    per_tie = results.groupBy("bracket", "round", "tie").agg(F.count("*").alias("_n"), *[F.first(c).alias(c) for c in ("home_goals", "away_goals", "penalties_winner")])
    places = entrants.select("bracket", F.col("slot").cast("long").alias("slot")).distinct()
    done = None
    for r in range(1, rounds + 1):
        ties = places.select("bracket", F.floor(F.col("slot") / (1 << r)).alias("tie"), (F.floor(F.col("slot") / (1 << (r - 1))) % 2).alias("_half")).groupBy("bracket", "tie").agg(F.max(F.when(F.col("_half") == 0, 1).otherwise(0)).alias("_l"), F.max(F.when(F.col("_half") == 1, 1).otherwise(0)).alias("_r"))
        side = lambda half, name: alive.where(F.col("slot") % 2 == half).select("bracket", F.floor(F.col("slot") / 2).alias("tie"), F.col("team").alias(name))
        t = ties.join(side(0, "home"), ["bracket", "tie"], "left").join(side(1, "away"), ["bracket", "tie"], "left").join(per_tie.where(F.col("round") == r).drop("round"), ["bracket", "tie"], "left")
        c = F.col
        ready, given = c("home").isNotNull() & c("away").isNotNull(), c("_n").isNotNull()
        named = F.when(c("home_goals") > c("away_goals"), c("home")).when(c("home_goals") < c("away_goals"), c("away")).when((c("penalties_winner") == c("home")) | (c("penalties_winner") == c("away")), c("penalties_winner"))
        problem = F.when(given, F.when(~ready, "not_ready").when(c("_n") > 1, "repeated").when((c("home_goals") < 0) | (c("away_goals") < 0), "negative_goals").when(c("home_goals").isNull() | c("away_goals").isNull() | named.isNull(), "no_winner"))
        alone = (c("_l") + c("_r") == 1) & (c("home").isNotNull() | c("away").isNotNull())
        t = t.withColumns({"problem": problem, "_alone": alone}).withColumn("winner", F.when(c("_alone"), F.coalesce("home", "away")).when(given & c("problem").isNull(), named))
        status = F.when(c("_alone"), "walkover").when(c("winner").isNotNull(), "completed").when(c("home").isNotNull() & c("away").isNotNull(), "scheduled").otherwise("pending")
        t = t.select("bracket", F.lit(r).alias("round"), "tie", "home", "away", "winner", status.alias("status"), "problem")
        done = t if done is None else done.unionByName(t)
        alive = t.where(c("winner").isNotNull()).select("bracket", c("tie").alias("slot"), c("winner").alias("team"))
    return done


def cleared(results: DataFrame, edits: DataFrame, rounds: int) -> DataFrame:
    """results without the ties of edits (bracket, round, tie) and all later ties that the winners of those lead to."""
    later = F.transform(F.sequence(F.lit(0), F.lit(rounds) - F.col("round")), lambda k: F.struct((F.col("round") + k).alias("_round"), F.floor(F.col("tie") / F.pow(F.lit(2.0), k)).alias("_tie")))
    gone = edits.where(F.col("round") <= rounds).select(F.col("bracket").alias("_bracket"), F.explode(later).alias("x")).select("_bracket", "x.*").distinct()
    return results.join(gone, (F.col("bracket") == F.col("_bracket")) & (F.col("round") == F.col("_round")) & (F.col("tie") == F.col("_tie")), "left_anti")


def chances(entrants: DataFrame, state: DataFrame, rounds: int) -> DataFrame:
    """(bracket, slot, team, round, p): the exact probability that a team wins its tie of each round, given the ties of replayed() that have a winner.

    Round by round: the chance to be there, times the chances of those who may come from the other half times that of
    beating them. No simulation, and no row but one per team, opponent and round.
    """
    now = entrants.select("bracket", F.col("slot").cast("long").alias("slot"), "team", F.col("strength").cast("double").alias("strength"), F.lit(1.0).alias("p"))
    known = state.where(F.col("status") == "completed").select("bracket", "round", F.col("tie").alias("_tie"), F.col("winner").alias("_winner"))
    out = None
    for r in range(1, rounds + 1):
        half = F.floor(F.col("slot") / (1 << (r - 1)))
        own = now.withColumn("_half", half)
        other = own.select(F.col("bracket").alias("_b"), (F.col("_half") + 1 - 2 * (F.col("_half") % 2)).alias("_meets"), F.col("strength").alias("_s"), F.col("p").alias("_q"))
        met = own.join(other, (F.col("bracket") == F.col("_b")) & (F.col("_half") == F.col("_meets")), "left").groupBy("bracket", "slot", "team", "strength", "p")
        met = met.agg(F.coalesce(F.sum(F.col("_q") * chance(F.col("strength"), F.col("_s"))), F.lit(0.0)).alias("_win"), F.coalesce(F.sum("_q"), F.lit(0.0)).alias("_there"))
        met = met.withColumn("_tie", F.floor(F.col("slot") / (1 << r))).join(known.where(F.col("round") == r).drop("round"), ["bracket", "_tie"], "left")
        free = F.col("p") * (F.col("_win") + 1 - F.col("_there"))
        now = met.select("bracket", "slot", "team", "strength", F.when(F.col("_winner").isNotNull(), (F.col("_winner") == F.col("team")).cast("double")).otherwise(free).alias("p"))
        one = now.select("bracket", "slot", "team", F.lit(r).alias("round"), "p")
        out = one if out is None else out.unionByName(one)
    return out


def scenarios(entrants: DataFrame, state: DataFrame, rounds: int) -> DataFrame:
    """(bracket, team, round, opponent, win_probability, title, title_if_win, title_if_lose) for each open tie on the way of a team that is still in.

    opponent and win_probability are known once the other side of the tie is; title is the chance to win the last round
    now, title_if_win that if the team wins every tie up to this one, which forces those winners and nothing else.
    """
    p = chances(entrants, state, rounds)
    wide = p.groupBy("bracket", "slot", "team").agg(F.sort_array(F.collect_list(F.struct("round", "p"))).alias("_p"))  # one row per round
    decided = state.where(F.col("winner").isNotNull()).select(F.col("bracket").alias("_b"), F.col("round").alias("_r"), F.col("tie").alias("_t"))
    rows = wide.withColumn("title", F.element_at("_p", -1)["p"]).select("bracket", "slot", "team", "title", F.explode("_p").alias("x")).select("bracket", "slot", "team", "title", "x.round", "x.p")
    rows = rows.where(F.col("p") > 0).withColumn("tie", F.floor(F.col("slot") / F.pow(F.lit(2.0), F.col("round"))))
    rows = rows.join(decided, (F.col("bracket") == F.col("_b")) & (F.col("round") == F.col("_r")) & (F.col("tie") == F.col("_t")), "left_anti")
    known = state.select(F.col("bracket").alias("_b"), F.col("round").alias("_r"), F.col("tie").alias("_t"), "home", "away")
    rows = rows.join(known, (F.col("bracket") == F.col("_b")) & (F.col("round") == F.col("_r")) & (F.col("tie") == F.col("_t")))
    c = F.col
    rows = rows.withColumn("opponent", F.when(c("home") == c("team"), c("away")).when(c("away") == c("team"), c("home")).otherwise(F.coalesce("home", "away")))
    s = entrants.select(c("bracket").alias("_sb"), c("team").alias("_st"), c("strength").cast("double").alias("_own"))
    o = entrants.select(c("bracket").alias("_ob"), c("team").alias("_ot"), c("strength").cast("double").alias("_other"))
    rows = rows.join(s, (c("bracket") == c("_sb")) & (c("team") == c("_st"))).join(o, (c("bracket") == c("_ob")) & (c("opponent") == c("_ot")), "left")
    return rows.select("bracket", "team", "round", "opponent", F.when(c("opponent").isNotNull(), chance(c("_own"), c("_other"))).alias("win_probability"), "title", (c("title") / c("p")).alias("title_if_win"), F.lit(0.0).alias("title_if_lose"))
