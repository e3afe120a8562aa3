"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame operations alone.

Sources are ranked by code point (null last) and weigh 5, 2, 1, repeating. Targets share ``budget``
times all words by weight and stop at ``most`` times their source's words; the excess is shared again
among the rest until none is above. Each source's documents are shuffled by a hash and laid end to
end; the run of words is cut into blocks of ``block`` words. Slot k of the schedule falls at the
golden-ratio point, mapped through the sources' cumulative slot counts; slots are ranked
within their source, and rank r takes block r modulo the number of blocks, on pass r div that number.
Discrepancy leaves a source a few slots off; slots beyond its count fall away and missing ones follow
at the schedule's end, so the words taken differ from the target by less than a block.

No step gathers a source in one task: offsets and ranks are prefix sums on two levels, with about the
square root of all rows in each group.

Defined results: null or empty texts have size 0 and take nothing; a null source is a source of its
own. Repeated rows are laid out each on its own. An empty table gives an empty result. Reruns agree,
because the order depends on hashes of ids alone. Further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causeway.llm.common import materialize

WEIGHTS = (5, 2, 1)
BLOCK = 128
#: floor(2 ** 31 / phi), odd; products of two numbers below 2 ** 31 stay within a long.
GOLDEN, CYCLE = 1327217885, 1 << 31


def golden_point(k: Column) -> Column:
    """Point k of the schedule, in [0, 1): frac(k * phi) on a grid of 2 ** 31 cells. Each further cycle of 2 ** 31 slots
    moves its points within the cells by the golden ratio again, so none repeats below 2 ** 62 slots."""
    cell = (k % CYCLE * GOLDEN % CYCLE).cast("double")
    return (cell + (F.floor(k / CYCLE) * GOLDEN % CYCLE).cast("double") / CYCLE) / CYCLE


def word_count(text: str | Column) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def shuffle_key(doc_id: Column, seed: int) -> Column:
    """60 bits of the md5 of seed and id."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}-"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 15), 16, 10).cast("bigint")


def rank_sources(sources: DataFrame) -> DataFrame:
    """Adds ``sid``, the rank of ``source`` by code point, null last. The sort is distributed; the counts of its partitions reach the driver."""
    parts = materialize(sources.orderBy(F.col("source").asc_nulls_last()).withColumn("mid", F.monotonically_increasing_id()), "sources")
    pid = F.shiftright("mid", 33)
    counts = sorted((r.pid, r.n) for r in parts.groupBy(pid.alias("pid")).agg(F.count(F.lit(1)).alias("n")).collect())
    offsets, total = {}, 0
    for p, n in counts:
        offsets[p], total = total, total + n
    shift = F.lit(0).cast("bigint")
    if len(offsets) > 1:
        shift = F.create_map(*[F.lit(x).cast("bigint") for kv in offsets.items() for x in kv])[pid]
    return parts.select(*sources.columns, (shift + F.col("mid").bitwiseAND((1 << 33) - 1)).alias("sid"))


def weight(sid: Column) -> Column:
    out = F.lit(WEIGHTS[-1])
    for i, w in enumerate(WEIGHTS[:-1]):
        out = F.when(sid % len(WEIGHTS) == i, w).otherwise(out)
    return out.cast("double")


def water_level(sources: DataFrame, total: float, most: int) -> float:
    """The level x for which the sum of least(most * source_size, x * weight) is ``total``.

    Each round sums the capped sources and raises the level for the rest; capped sources stay capped.
    """
    level, capped = 0.0, -1
    while True:
        above = F.lit(most) * F.col("source_size") < F.lit(level) * F.col("weight")
        r = sources.agg(
            F.count(F.when(above, 1)).alias("n"),
            F.coalesce(F.sum(F.when(above, F.col("source_size") * most)), F.lit(0)).alias("cap"),
            F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0.0)).alias("w"),
        ).first()
        if r.n == capped or not r.w:
            return level
        level, capped = (total - float(r.cap)) / r.w, r.n


@dataclass(frozen=True)
class Mix:
    """``sources``: source, sid, source_size, weight, target, blocks, slots. ``pieces``: the carried columns, sid, start, size, block, words.
    ``empty``: the documents without words. ``schedule``: position, sid, block, pass."""

    sources: DataFrame
    pieces: DataFrame
    empty: DataFrame
    schedule: DataFrame

    def taken(self, carry: Sequence[str]) -> DataFrame:
        """The carried columns, sid, size and the words taken of each document."""
        uses = self.schedule.groupBy("sid", "block").agg(F.count(F.lit(1)).alias("uses"))
        got = self.pieces.join(uses, ["sid", "block"], "left")
        got = got.groupBy(*carry, "sid", "start", "size").agg(F.sum(F.col("words") * F.coalesce(F.col("uses"), F.lit(0))).alias("taken"))
        return got.drop("start").unionByName(self.empty.withColumn("taken", F.lit(0).cast("bigint")))


def _prefix(df: DataFrame, group: list[str], part: str, order: list[str], value: Column, name: str) -> DataFrame:
    """Adds the sum of ``value`` over earlier rows of ``group``, by ``part`` and then ``order``: within parts, then over parts."""
    inner = Window.partitionBy(*group, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(*group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    parts = df.groupBy(*group, part).agg(F.sum(value).alias("_sum"))
    parts = parts.select(*group, part, F.coalesce(F.sum("_sum").over(outer), F.lit(0)).alias("_before"))
    within = df.withColumn("_within", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    return within.join(parts, [*group, part]).withColumn(name, F.col("_within") + F.col("_before")).drop("_within", "_before")


def mix(
    docs: DataFrame, carry: Sequence[str] = ("doc_id",), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", budget: float = 1.5, most: int = 2, block: int = BLOCK, seed: int = 10
) -> Mix:
    """Schedule of the mix; see the module. ``carry``: columns of ``docs`` to keep with each document."""
    keep = [F.col(c).alias(f"c_{c}") for c in carry]
    sized = materialize(
        docs.select(*keep, F.col(source_col).alias("source"), word_count(text_col).alias("size"), shuffle_key(F.col(id_col), seed).alias("h")), "sizes"
    )
    names = [f"c_{c}" for c in carry]
    sources = rank_sources(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))).withColumn("weight", weight(F.col("sid")))
    sums = sources.agg(F.sum("source_size").alias("words"), F.sum("n_docs").alias("docs")).first()
    words, n_docs = sums.words or 0, sums.docs or 0
    level = water_level(sources, budget * words, most)
    target = F.least(F.col("source_size") * float(most), F.col("weight") * F.lit(level))
    blocks = F.ceil(F.col("source_size") / block).cast("bigint")
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("bigint")
    slots = (F.col("passes") * F.col("blocks") + F.floor((F.col("target") - F.col("passes") * F.col("source_size")) / block + 0.5)).cast("bigint")
    outer = Window.partitionBy("_p").orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)
    sources = sources.withColumn("target", target).withColumn("blocks", blocks).withColumn("passes", passes).withColumn("slots", slots)
    n_sources = sources.count()
    sources = sources.withColumn("_p", F.floor(F.col("sid") / math.ceil(math.sqrt(max(n_sources, 1)))))
    before = sources.groupBy("_p").agg(F.sum("slots").alias("_n"))
    before = before.select("_p", F.coalesce(F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    sources = sources.withColumn("_w", F.coalesce(F.sum("slots").over(outer), F.lit(0))).join(before, "_p").withColumn("first_slot", F.col("_w") + F.col("_b"))
    sources = materialize(sources.drop("_p", "_w", "_b", "mid"), "mix-sources")

    laid = sized.join(sources.select("source", "sid"), sized["source"].eqNullSafe(sources["source"])).drop("source", "source")
    parts = math.ceil(math.sqrt(max(n_docs, 1)))
    laid = laid.withColumn("part", F.shiftright(F.shiftright("h", 30) * parts, 30))
    full = _prefix(laid.filter("size > 0"), ["sid"], "part", ["h", *names, "size"], F.col("size"), "start")
    first, last = F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)
    pieces = full.withColumn("block", F.explode(F.sequence(first, last)))
    overlap = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block) - F.greatest(F.col("start"), F.col("block") * block)
    back = [F.col(f"c_{c}").alias(c) for c in carry]
    return Mix(
        sources,
        pieces.select(*back, "sid", "start", "size", "block", overlap.alias("words")),
        laid.filter("size = 0").select(*back, "sid", "size"),
        _schedule(sources),
    )


def _schedule(sources: DataFrame) -> DataFrame:
    """position, sid, block, pass of every slot."""
    spark = sources.sparkSession
    n = sources.agg(F.sum("slots")).first()[0] or 0
    step = 4096
    points = spark.range(n).select(F.col("id").alias("k")).withColumn("at", F.least(F.floor(golden_point(F.col("k")) * n), F.lit(n - 1))).withColumn("bin", F.floor(F.col("at") / step))
    spans = sources.filter("slots > 0").select("sid", "slots", "blocks", "first_slot")
    spans = spans.withColumn("bin", F.explode(F.sequence(F.floor(F.col("first_slot") / step), F.floor((F.col("first_slot") + F.col("slots") - 1) / step))))
    hit = (F.col("at") >= F.col("first_slot")) & (F.col("at") < F.col("first_slot") + F.col("slots"))
    slots = points.join(spans, "bin").filter(hit).select("k", "sid")
    chunk = math.ceil(math.sqrt(max(n, 1)))
    slots = slots.withColumn("chunk", F.floor(F.col("k") / chunk))
    ranked = _prefix(slots, ["sid"], "chunk", ["k"], F.lit(1), "rank").select(F.col("k").alias("position"), "sid", "rank")
    table = sources.select("sid", "slots", "blocks")
    got = slots.groupBy("sid").agg(F.count(F.lit(1)).alias("got"))
    short = table.join(got, "sid", "left").withColumn("got", F.coalesce("got", F.lit(0))).filter("got < slots")
    short = short.select("sid", F.explode(F.sequence(F.col("got"), F.col("slots") - 1)).alias("rank")).select((F.col("rank") + n).alias("position"), "sid", "rank")
    both = ranked.unionByName(short).join(table, "sid").filter("rank < slots")
    return both.select("position", "sid", (F.col("rank") % F.col("blocks")).alias("block"), F.floor(F.col("rank") / F.col("blocks")).alias("pass"))


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents with all their columns: each as often as the words taken go into its size, rounded. Documents without words are not taken."""
    rid, copies_, copy_ = "_mix_rid", "_mix_copies", "_mix_copy"
    while not {rid, copies_, copy_}.isdisjoint(docs.columns):
        rid, copies_, copy_ = rid + "_", copies_ + "_", copy_ + "_"
    numbered = materialize(docs.withColumn(rid, F.monotonically_increasing_id()), "mix-docs")
    taken = mix(numbered, carry=(rid,), **options).taken([rid]).filter("size > 0")
    copies = taken.select(F.col(rid), F.floor(F.col("taken") / F.col("size") + 0.5).cast("int").alias(copies_)).filter(F.col(copies_) > 0)
    out = numbered.join(copies, rid).withColumn(copy_, F.explode(F.sequence(F.lit(1), F.col(copies_))))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
