"""Samples, edge estimation and online credit."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from causeway.functions import scoring as S
from causeway.operators.folds import clamped_sums

DEADBAND, LEAST, ABNORMAL_LEAST, SCALE = 0.002, 5, 2, 0.05


def returns(closes: DataFrame) -> DataFrame:
    """Adds the return on the session before of the same asset."""
    w = Window.partitionBy("asset_id").orderBy("session")
    return closes.withColumn("r", F.col("close") / F.lag("close").over(w) - 1)


def volatility(closes: DataFrame) -> DataFrame:
    """Population deviation of daily returns, 0 below two closes."""
    return returns(closes).groupBy("asset_id").agg(F.coalesce(F.stddev_pop("r"), F.lit(0.0)).alias("volatility"))


def estimate(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Learned edges of groups with enough samples: direction, weight, confidence, alpha, beta."""
    least = F.when(F.bool_or("is_abnormal"), min(ABNORMAL_LEAST, LEAST)).otherwise(LEAST)
    g = samples.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg("r").alias("mean"), F.count_if(F.col("r") > 0).alias("up"), F.count_if(F.col("r") < 0).alias("down"), least.alias("least")
    ).filter("n >= least")
    direction = F.when(F.col("mean") > DEADBAND, "UP").when(F.col("mean") < -DEADBAND, "DOWN").otherwise("NEUTRAL")
    agree = F.when(F.col("direction") == "UP", F.col("up")).when(F.col("direction") == "DOWN", F.col("down")).otherwise(0)
    g = g.withColumn("direction", direction).withColumn("agree", agree)
    return g.select(
        *keys, "n", "direction", F.least(F.lit(1.0), F.abs("mean") / SCALE).alias("weight"), (F.col("agree") / F.col("n")).alias("confidence"),
        (F.col("agree") + 1).cast("bigint").alias("alpha"), (F.col("n") - F.col("agree") + 1).cast("bigint").alias("beta"),
    )


def credits(contributions: DataFrame) -> DataFrame:
    """Share of each edge in its prediction's influence; equal shares where the sum isn't positive."""
    w = Window.partitionBy("prediction_id")
    total = F.sum("influence").over(w)
    return contributions.withColumn("credit", F.when(total > 0, F.col("influence") / total).otherwise(1.0 / F.count(F.lit(1)).over(w)))


def fold_weights(credited: DataFrame, pieces: int | None = None) -> DataFrame:
    """edge_id, weight after its scored predictions in order, n_steps: each step is clamped, so the order matters; a hot edge's steps are spread over tasks."""
    moved = credited.withColumn("_move", F.when(F.col("is_correct"), S.STEP).otherwise(-S.STEP) * F.col("credit"))
    folded = clamped_sums(moved, "edge_id", ["scored_at", "prediction_id", "credit"], "_move", "weight", S.FLOOR, 1.0, pieces)
    return folded.select("edge_id", F.col("value").alias("weight"), F.col("n").alias("n_steps"))


def source_credits(scored: DataFrame) -> DataFrame:
    """scored: prediction_id, source, is_correct. Each distinct source of a prediction, whatever its case, gets 1/n of it. source, alpha, beta above a prior of one each."""
    each = scored.select("prediction_id", F.lower(F.trim("source")).alias("source"), "is_correct").filter("source <> ''").distinct()
    share = each.withColumn("credit", 1.0 / F.count(F.lit(1)).over(Window.partitionBy("prediction_id")))
    won, lost = (F.sum(F.when(F.col("is_correct") == x, F.col("credit")).otherwise(0.0)) for x in (True, False))
    return share.groupBy("source").agg(S.posterior(F.lit(1.0), won).alias("alpha"), S.posterior(F.lit(1.0), lost).alias("beta"))


def claimed(messages: DataFrame, processed: DataFrame, key: str = "prediction_id") -> DataFrame:
    """Messages whose key is new, one for each; withdrawn ones are claimed, but not applied."""
    return messages.dropDuplicates([key]).join(processed.select(key), key, "left_anti").withColumn("applied", F.coalesce(F.col("status") != "WITHDRAWN", F.lit(True)))


def write_weights(edges: DataFrame, updates: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """edges: keys, weight; updates: keys, new_weight. The edges with their new weights, and the updates that meet no edge. Null keys equal each other."""
    e, u = edges.alias("e"), updates.alias("u")
    same = [F.col(f"e.{k}").eqNullSafe(F.col(f"u.{k}")) for k in keys]
    on = same[0]
    for c in same[1:]:
        on = on & c
    written = e.join(u, on, "left").select(*[F.col(f"e.{c}") for c in edges.columns if c != "weight"], F.coalesce("u.new_weight", "e.weight").alias("weight"))
    return written, u.join(e, on, "left_anti").select("u.*")


def learn_edges(samples: DataFrame, causes: DataFrame, pairs: DataFrame, correlations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A learner run: edges estimated from both kinds of samples that neither table has, and how many of each kind were created. Neutral and unconditional ones are left out."""

    def new(rows: DataFrame, have: DataFrame, keys: list[str], kind: str) -> DataFrame:
        got = estimate(rows.filter("condition is not null"), keys).filter("direction <> 'NEUTRAL'")
        return got.join(have.select(*keys), keys, "left_anti").select(F.lit(kind).alias("kind"), F.col(keys[0]).alias("source"), F.col(keys[1]).alias("condition"), F.col(keys[2]).alias("target"), "direction", "weight", "alpha", "beta")

    created = new(samples, causes, ["factor", "condition", "target"], "CAUSES").unionByName(new(pairs, correlations, ["source", "condition", "target"], "CORRELATES_WITH"))
    return created, created.groupBy("kind").agg(F.count(F.lit(1)).alias("created"))
