"""Double-elimination tournaments of candidates, all groups at once, a round at a time.

State: (grp, player, score, bracket, w_level, l_level). Each round pairs the
players of a bracket by a seeded hash, judges all matches in one pass, and
moves winners and losers. A bracket's level goes up when it has played. A player alone in a group is its champion. Votes are 0 for the
first player of a match and 1 for the second; more zeros than ones win for the
first, a tie wins for the second, and no votes at all for the first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize, release, replace, union_all

#: Code pairs that are shown to a judge per match.
MOST_PAIRS = 10
Judge = Callable[[DataFrame], DataFrame]


def larger_score(matches: DataFrame) -> DataFrame:
    """The default judge: adds first_wins by the players' scores, then by name."""
    return matches.withColumn("first_wins", F.struct("score1", F.col("player2")) > F.struct("score2", F.col("player1")))


def votes_to_winner(votes: DataFrame) -> DataFrame:
    """(match, first_wins) from (match, vote)."""
    return votes.groupBy("match").agg((F.count_if(F.col("vote") == 0) > F.count_if(F.col("vote") == 1)).alias("won"), F.count("vote").alias("n")).select("match", (F.col("won") | (F.col("n") == 0)).alias("first_wins"))


def code_pairs(first: DataFrame, second: DataFrame, seed: int = 0, most: int = MOST_PAIRS) -> DataFrame:
    """(match, func, code1, code2): up to ``most`` functions per match in the order of a seeded hash; matches whose functions differ have none.

    first, second: (match, func, code).
    """
    both = first.select("match", "func", F.col("code").alias("code1")).join(second.select("match", "func", F.col("code").alias("code2")), ["match", "func"], "full")
    unequal = both.where("code1 IS NULL OR code2 IS NULL").select("match").distinct()
    order = Window.partitionBy("match").orderBy(F.xxhash64("func", F.lit(seed)), "func")
    return both.join(unequal, "match", "left_anti").withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= most).drop("_rn")


def vote_judge(codes: DataFrame, ask: Callable[[DataFrame], DataFrame], seed: int = 0, most: int = MOST_PAIRS) -> Judge:
    """A judge by votes on code pairs.

    codes: (grp, player, func, code); ask turns (match, func, code1, code2)
    into (match, vote). Matches without code in common have no votes, so the
    first player wins.
    """
    def judge(matches: DataFrame) -> DataFrame:
        keyed = matches.withColumn("match", F.concat_ws("|", "grp", "bracket", "player1", "player2"))
        side = lambda player: keyed.select("match", "grp", F.col(player).alias("player")).join(codes, ["grp", "player"]).select("match", "func", "code")
        votes = ask(code_pairs(side("player1"), side("player2"), seed, most)).select("match", "vote")
        won = votes_to_winner(votes)
        return keyed.join(won, "match", "left").withColumn("first_wins", F.coalesce("first_wins", F.lit(True))).drop("match")

    return judge


def _pair(state: DataFrame, bracket: str, turn: int, seed: int) -> DataFrame:
    """Matches of a bracket; the odd one out has no second player."""
    order = Window.partitionBy("grp").orderBy(F.xxhash64("player", F.lit(seed), F.lit(turn)), "player")
    seats = state.where(F.col("bracket") == bracket).withColumn("_seat", F.row_number().over(order) - 1).withColumn("_table", (F.col("_seat") / 2).cast("long"))
    paired = seats.groupBy("grp", "_table").agg(F.min_by("player", "_seat").alias("player1"), F.min_by("score", "_seat").alias("score1"), F.max_by("player", "_seat").alias("p2"), F.max_by("score", "_seat").alias("score2"), F.count("*").alias("n"), F.first("w_level").alias("w_level"), F.first("l_level").alias("l_level"))
    return paired.select("grp", F.lit(bracket).alias("bracket"), "player1", "score1", F.when(F.col("n") == 2, F.col("p2")).alias("player2"), F.when(F.col("n") == 2, F.col("score2")).alias("score2"), "w_level", "l_level")


def run_tournaments(players: DataFrame, judge: Judge = larger_score, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(champions, matches): champions (grp, player, rounds); matches (round, grp, bracket, level, player1, player2, winner), in no order.

    players: (grp, player, score) with unique players per group.
    """
    state = materialize(players.select("grp", "player", "score", F.lit("w").alias("bracket"), F.lit(0).alias("w_level"), F.lit(0).alias("l_level")), "players")
    kind = dict(state.dtypes)["player"]
    played = [state.where("false").select(F.lit(0).alias("round"), "grp", "bracket", F.col("w_level").alias("level"), F.col("player").alias("player1"), F.col("player").alias("player2"), F.col("player").alias("winner"))]
    champions, turn = [], 0
    while True:
        left = state.groupBy("grp").agg(F.count("*").alias("n"), F.count_if(F.col("bracket") == "w").alias("w"))
        done = materialize(state.join(left.where("n = 1").select("grp"), "grp", "left_semi").select("grp", "player", F.lit(turn).alias("rounds")), "champions")
        champions.append(done)
        open_ = materialize(state.join(left.where("n > 1").select("grp", "n", "w"), "grp"), "open")
        if open_.isEmpty():
            release(open_, state)
            break
        turn += 1
        # One player in each bracket: the final, a single match.
        final = (F.col("n") == 2) & (F.col("w") == 1)
        ready = open_.withColumn("bracket", F.when(final, "final").otherwise(F.col("bracket")))
        pairs = union_all(_pair(ready, bracket, turn, seed) for bracket in ("w", "l", "final"))
        matches = materialize(judge(pairs.where("player2 IS NOT NULL")), "matches")
        first, second = (F.struct(F.col(f"player{k}").alias("player"), F.col(f"score{k}").alias("score")) for k in (1, 2))
        side, other = F.when(F.col("first_wins"), first).otherwise(second), F.when(F.col("first_wins"), second).otherwise(first)
        level = F.when(F.col("bracket") == "l", F.col("l_level")).otherwise(F.col("w_level"))
        played.append(matches.select(F.lit(turn).alias("round"), "grp", "bracket", level.alias("level"), "player1", "player2", side["player"].cast(kind).alias("winner")))
        # The brackets that have played go up a level, those who sit out with them.
        up = matches.groupBy("grp").agg(F.bool_or(F.col("bracket") == "w").cast("int").alias("w_up"), F.bool_or(F.col("bracket") == "l").cast("int").alias("l_up"))
        row = lambda x, bracket: (x.alias("x"), bracket, "w_level", "l_level")
        byes = pairs.where("player2 IS NULL").select("grp", *row(first, "bracket"))
        winners = matches.select("grp", *row(side, "bracket"))
        losers = matches.where("bracket = 'w'").select("grp", *row(other, F.lit("l").alias("bracket")))
        after = union_all((winners, losers, byes)).join(up, "grp")
        after = after.select("grp", "x.player", "x.score", "bracket", (F.col("w_level") + F.col("w_up")).alias("w_level"), (F.col("l_level") + F.col("l_up")).alias("l_level"))
        state = replace(state, after, "players")
        release(open_)
    return union_all(champions), union_all(played)


def bracket_order(matches: DataFrame) -> DataFrame:
    """Matches as a bracket is printed: by group, bracket and level."""
    return matches.orderBy("grp", "bracket", "level", "round", "player1")


def merge_ranges_of_champions(base: DataFrame, ranges: DataFrame, champions: DataFrame) -> DataFrame:
    """(c, offset, ...): a document's fields with those in each range replaced by the range's champion's.

    base: (c, offset, value); ranges: (c, start, end, player); champions: (c, player, offset, value).
    """
    won = ranges.join(champions, ["c", "player"]).where("offset >= start AND offset < `end`").select("c", "offset", "value").distinct()
    covered = base.join(ranges.select("c", "start", "end"), "c").where("offset >= start AND offset < `end`").select("c", "offset").distinct()
    return base.join(covered, ["c", "offset"], "left_anti").select("c", "offset", "value").unionByName(won)


def judge_kind(documents: DataFrame) -> DataFrame:
    """Adds kind: global, single or multi, by what a document offers (global_n candidates, range_n ranges)."""
    return documents.withColumn("kind", F.when(F.col("global_n") > 0, "global").when(F.col("range_n") == 1, "single").when(F.col("range_n") > 1, "multi"))
