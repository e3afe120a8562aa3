"""Contexts, firing edges, decisions and propagation over the causal graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causeway.functions import scoring as S
from causeway.scratch import materialize

MINUTES = 15


def contexts(events: DataFrame, minutes: int = MINUTES) -> DataFrame:
    """(asset, window, factor): active tags and whether every event is a resolution. One shuffle on the grouping keys."""
    w = F.window("ts", f"{minutes} minutes")
    return (
        events.groupBy("asset_id", w.alias("w"), "factor")
        .agg(F.array_sort(F.collect_set("tag")).alias("tags"), F.bool_and(F.col("polarity") == "RESOLUTION").alias("resolved"), F.count(F.lit(1)).alias("n_events"))
        .select("asset_id", F.col("w.start").alias("window_start"), "factor", "tags", "resolved", "n_events")
    )


def gate(condition: Column, tags: Column) -> Column:
    return condition.isNull() | F.array_contains(tags, condition)


def own_edges(ctx: DataFrame, causes: DataFrame) -> DataFrame:
    """Edges from each context's factor to its asset that pass the condition gate."""
    e = causes.withColumnRenamed("target", "asset_id")
    return ctx.join(e, ["factor", "asset_id"]).filter(gate(F.col("condition"), F.col("tags"))).withColumn("inherited_from", F.lit(None).cast("string"))


def inherited_edges(ctx: DataFrame, causes: DataFrame, members: DataFrame, own: DataFrame) -> DataFrame:
    """Edges to the asset's groups, unless an own edge of the same factor and asset fires in the context."""
    e = causes.join(members, causes["target"] == members["group_id"]).drop("target").withColumnRenamed("group_id", "inherited_from")
    out = ctx.join(e, ["factor", "asset_id"]).filter(gate(F.col("condition"), F.col("tags")))
    return out.join(own.select("asset_id", "window_start", "factor").distinct(), ["asset_id", "window_start", "factor"], "left_anti")


def edge_lists(causes: DataFrame, members: DataFrame) -> DataFrame:
    """factor, asset_id and all edges between them, own ones and those of the asset's groups."""
    parts = ("direction", "weight", "alpha", "beta", "condition", "inherited_from")
    own = causes.withColumnRenamed("target", "asset_id").withColumn("inherited_from", F.lit(None).cast("string"))
    of_groups = causes.join(members, causes["target"] == members["group_id"]).drop("target").withColumnRenamed("group_id", "inherited_from")
    return own.unionByName(of_groups.select(*own.columns)).groupBy("factor", "asset_id").agg(F.collect_list(F.struct(*parts)).alias("_edges"))


def firing_edges(ctx: DataFrame, causes: DataFrame, members: DataFrame) -> DataFrame:
    """Edges of each context that pass the gate: own ones, or where none fires those of its asset's groups. One join with the graph; contexts are read once."""
    j = ctx.join(edge_lists(causes, members), ["factor", "asset_id"])
    passed = F.filter("_edges", lambda e: gate(e["condition"], F.col("tags")))
    own = F.filter("_passed", lambda e: e["inherited_from"].isNull())
    j = j.withColumn("_passed", passed).withColumn("_e", F.explode(F.when(F.exists("_passed", lambda e: e["inherited_from"].isNull()), own).otherwise(F.col("_passed"))))
    return j.select(*ctx.columns, "_e.*")


def forces(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Signed sums of weight times reliability over directional edges, per key: one partial and one final aggregate."""
    s = F.col("weight") * S.reliability(F.col("alpha"), F.col("beta"))
    up = F.col("direction") == "UP"
    return edges.filter(F.col("direction").isin("UP", "DOWN")).groupBy(*keys).agg(
        F.sum(S.sign(F.col("direction")) * s).alias("net"),
        F.sum(s).alias("total"),
        F.avg(F.when(up, F.col("weight"))).alias("up_weight"),
        F.avg(F.when(~up, F.col("weight"))).alias("down_weight"),
        F.avg("weight").alias("all_weight"),
        F.count(F.lit(1)).alias("n_edges"),
    )


def decide(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Direction, magnitude and confidence of each key's summed forces."""
    f = forces(edges, keys)
    confidence = F.round(F.least(F.lit(1.0), F.abs(F.col("net")) / F.col("total") * F.col("total") / (F.col("total") + S.HALF_MASS)), 4)
    f = f.withColumn("confidence", confidence)
    direction = F.when(F.col("confidence") < S.DECISION_DEADBAND, "NEUTRAL").when(F.col("net") > 0, "UP").otherwise("DOWN")
    f = f.withColumn("direction", direction)
    w = F.when(F.col("direction") == "UP", F.col("up_weight")).when(F.col("direction") == "DOWN", F.col("down_weight")).otherwise(F.col("all_weight"))
    return f.select(*keys, "direction", S.magnitude(w).alias("magnitude"), "confidence", "n_edges")


def resolve(edges: DataFrame) -> DataFrame:
    """Flips edges of factors whose events are all resolutions; a relief to DOWN needs an elevated price."""
    turned = F.when(F.col("resolved"), S.flip(F.col("direction"))).otherwise(F.col("direction"))
    return edges.withColumn("direction", turned).filter(~(F.col("resolved") & (F.col("direction") == "DOWN") & ~F.coalesce(F.col("elevated"), F.lit(False))))


def elevated(closes: DataFrame, lookback: int = 10, threshold: float = 0.01) -> DataFrame:
    """Per asset: whether the latest close exceeds the mean of up to ``lookback`` before it by the threshold. Older closes are cut off before the shuffle's sort ends."""
    k = F.row_number().over(Window.partitionBy("asset_id").orderBy(F.desc("session")))
    rows = closes.withColumn("k", k).filter(F.col("k") <= lookback + 1).groupBy("asset_id").agg(F.max(F.when(F.col("k") == 1, F.col("close"))).alias("latest"), F.avg(F.when(F.col("k") > 1, F.col("close"))).alias("mean"))
    return rows.select("asset_id", F.coalesce((F.col("mean") > 0) & (F.col("latest") > F.col("mean") * (1 + threshold)), F.lit(False)).alias("elevated"))


def propagate(direct: DataFrame, correlations: DataFrame, depth: int = 3, least: float = 0.30) -> DataFrame:
    """Level by level along correlation edges: forces that reach an unvisited asset are summed and decided once.

    direct: context_id, asset_id, direction, confidence. At most ``depth`` joins; assets decided directly count as visited. Each level is
    written, so that none is computed again for the next.
    """
    direct = materialize(direct.select("context_id", "asset_id", "direction", "confidence"), "direct")
    level = direct.filter(F.col("direction").isin("UP", "DOWN") & (F.col("confidence") >= least)).select("context_id", "asset_id", F.col("direction").alias("from_direction"))
    visited = direct.select("context_id", "asset_id")
    out = None
    for hop in range(1, depth + 1):
        e = correlations.withColumnRenamed("source", "asset_id")
        hit = level.join(e, "asset_id").filter(F.col("condition") == F.concat(F.lit("UPSTREAM_"), F.col("from_direction")))
        hit = hit.drop("asset_id").withColumnRenamed("target", "asset_id").join(visited, ["context_id", "asset_id"], "left_anti")
        # targets whose edges are all neutral have no decision, but count as visited
        decided = decide(hit, ["context_id", "asset_id"])
        reached = materialize(hit.select("context_id", "asset_id").distinct().join(decided, ["context_id", "asset_id"], "left"), "level")
        decided = reached.filter("direction is not null").withColumn("depth", F.lit(hop))
        out = decided if out is None else out.unionByName(decided)
        visited = visited.unionByName(reached.select("context_id", "asset_id"))
        level = decided.filter(F.col("direction").isin("UP", "DOWN")).select("context_id", "asset_id", F.col("direction").alias("from_direction"))
    return out
