"""Labelling games: votes, leaderboards, combos."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.operators.identity import numbered


def majority(votes: DataFrame, needed: int, voters: int) -> DataFrame:
    """status and label of each row: a label with ``needed`` votes wins (the first to get there); all votes in without
    one is a conflict; else open. ``votes``: row_id, label, at, voter."""
    counted = votes.withColumn("_k", F.row_number().over(Window.partitionBy("row_id", "label").orderBy("at", "voter")))
    won = counted.where(F.col("_k") == needed).groupBy("row_id").agg(F.min_by("label", F.struct("at", "voter", "label")).alias("label"))
    n = votes.groupBy("row_id").agg(F.count(F.lit(1)).alias("votes"))
    out = n.join(won, "row_id", "left")
    return out.select("row_id", F.when(F.col("label").isNotNull(), "done").when(F.col("votes") >= voters, "conflict").otherwise("open").alias("status"), "label", "votes")


def leaderboard(answers: DataFrame, by: str) -> DataFrame:
    """answers and distinct rows of each team or player, with its place (ties: by name)."""
    rows = answers.groupBy(by).agg(F.count(F.lit(1)).alias("answers"), F.countDistinct("row_id").alias("rows"))
    return numbered(rows, [F.desc("answers"), F.desc("rows"), F.col(by)]).withColumnRenamed("_k", "place")


def lead_changes(scores: DataFrame) -> DataFrame:
    """Teams whose new score passes the best of all others, which their old one didn't. ``scores``: team, old, new. The
    best of the others comes from the two best of all."""
    top = scores.orderBy(F.desc("old"), F.desc("team")).limit(2).agg(F.sort_array(F.collect_list(F.struct("old", "team")), False).alias("t"))
    rival = F.when(F.col("t")[0]["team"] == F.col("team"), F.try_element_at("t", F.lit(2))["old"]).otherwise(F.col("t")[0]["old"])
    rows = scores.crossJoin(F.broadcast(top)).withColumn("rival", rival)
    return rows.where("new > rival and old <= rival").select("team", "old", "new", "rival")


def combos(answers: DataFrame, timeout: str = "interval 5 minutes") -> DataFrame:
    """Runs of a team's answers: an answer at or after the last one's time plus the timeout starts a new run.
    ``answers``: team, at, amount, id. Gives team, combo (from 1), started_at, ended_at, amount, answers."""
    w = Window.partitionBy("team").orderBy("at", "id")
    fresh = F.col("at") >= F.lag("at").over(w) + F.expr(timeout)
    rows = answers.withColumn("_n", F.coalesce(fresh, F.lit(True)).cast("long"))
    rows = rows.withColumn("combo", F.sum("_n").over(w))
    return rows.groupBy("team", "combo").agg(F.min("at").alias("started_at"), F.max("at").alias("ended_at"), F.sum("amount").alias("amount"), F.count(F.lit(1)).alias("answers"))


def available(rows: DataFrame, leases: DataFrame, now) -> DataFrame:
    """Rows without a label and without a lease that still holds. ``rows``: row_id, label; ``leases``: row_id, expires_at."""
    held = leases.where(F.col("expires_at") > now).select("row_id").distinct()
    return rows.where("label is null").join(held, "row_id", "left_anti")


def claimed(claims: DataFrame) -> DataFrame:
    """The first claim of each milestone. ``claims``: team, milestone, at, id."""
    w = Window.partitionBy("team", "milestone").orderBy("at", "id")
    return claims.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
