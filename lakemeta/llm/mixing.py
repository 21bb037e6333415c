"""Mixing sources to target token counts by entropy balancing.

Document rates should stay as close to 1 as the targets allow: minimise the sum of r * log(r) - r over a
source's documents, subject to sum(r * size) = target and r <= 3. The dual has one multiplier a
source; its solution tilts rates exponentially, r = min(3, exp(lambda * size / scale)). Newton steps,
kept inside a bracket, find all multipliers at once; a step is one grouped sum over the distinct
(source, size) pairs. Rates then become whole copies, the largest documents first; what rounding them
leaves over is made up for by smaller ones, so a source misses its target by about its smallest documents.
One task sees a source's distinct sizes, never its documents.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakemeta.llm.common import WORD, documents, numbered, saved

#: Rates are whole multiples of 2^-20, so rounding is exact and reruns agree.
_UNIT = 1 << 20
_GROUP = 1 << 16
_STEPS = 80


def water_level(sources: DataFrame, most: int) -> float:
    """The tokens a unit of weight gets once no source is above ``most`` times its size."""
    level = before = 0.0
    while True:
        capped = F.col("source_size") * most < F.col("weight") * F.lit(level)
        total, held, weight = sources.agg(
            F.sum("source_size"), F.sum(F.when(capped, F.col("source_size") * most).otherwise(0)),
            F.sum(F.when(capped, 0).otherwise(F.col("weight")))).first()
        if not weight or (level := (total - held) / weight) <= before:
            return max(level, before)
        before = level


def source_targets(sizes: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """(sk, source_size, scale, target) of each source."""
    sources = numbered(sizes.groupBy("sk", "source").agg(
        F.sum(F.col("n") * F.col("size")).alias("source_size"),
        F.sum(F.col("n").cast("double") * F.col("size") * F.col("size")).alias("squares")),
        [F.col("source").isNull(), F.col("source")], "sources")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    sources = saved(sources.withColumn("weight", weight).drop("place"), "weighted")
    level = water_level(sources, most)
    return sources.select("sk", "source_size", F.greatest(F.round(F.col("squares") / F.col("source_size"), 3), F.lit(1.0)).alias("scale"),
                          F.least(F.col("source_size") * F.lit(float(most)), F.col("weight") * F.lit(level)).alias("target"))


def multipliers(sizes: DataFrame, targets: DataFrame, most: int) -> DataFrame:
    """``targets`` with ``rate_log``: the multiplier per token, null where every document takes the most."""
    open_ = F.col("target") < F.col("source_size") * most * (1 - 1e-12)
    state = saved(targets.withColumn("step", F.lit(0.0)).withColumn("low", F.lit(None).cast("double"))
                  .withColumn("high", F.lit(None).cast("double")).withColumn("open", open_ & (F.col("source_size") > 0)), "duals")
    for _ in range(_STEPS):
        raw = F.exp(F.least(F.col("step") * F.col("size") / F.col("scale"), F.lit(50.0)))
        tokens = F.col("n") * F.col("size")
        sums = (sizes.join(state.filter("open").select("sk", "step", "scale"), "sk").groupBy("sk").agg(
            F.sum(tokens * F.least(raw, F.lit(float(most)))).alias("mixed"),
            F.sum(F.when(raw < most, tokens * raw * F.col("size") / F.col("scale")).otherwise(0.0)).alias("slope")))
        gap = F.col("mixed") - F.col("target")
        low = F.when(gap < 0, F.col("step")).otherwise(F.col("low"))
        high = F.when(gap > 0, F.col("step")).otherwise(F.col("high"))
        newton = F.col("step") - gap / F.col("slope")
        inside = (F.col("slope") > 0) & (F.col("low").isNull() | (newton > F.col("low"))) & (F.col("high").isNull() | (newton < F.col("high")))
        halved = F.when(F.col("high").isNull(), F.col("step") * 2 + 1).when(
            F.col("low").isNull(), F.col("step") * 2 - 1).otherwise((F.col("low") + F.col("high")) / 2)
        # A Newton step from far below overshoots: at most one unit further out at a time, or 2x.
        reach = F.greatest(F.lit(4.0), 2 * F.abs("step"))
        step = F.when(inside & (F.abs(newton - F.col("step")) <= reach), newton).otherwise(halved)
        done = F.abs(gap) <= 1e-10 * F.greatest("target", F.lit(1.0))
        state = saved(
            state.join(sums, "sk", "left").withColumn("low", low).withColumn("high", high)
            .select("sk", "source_size", "scale", "target",
                    F.when(F.col("open") & ~done, step).otherwise(F.col("step")).alias("step"),
                    "low", "high", (F.col("open") & ~done).alias("open"), (F.col("target") < F.col("source_size") * most * (1 - 1e-12)).alias("free")), "duals")
        if not state.filter("open").limit(1).count():
            break
    return state.select("sk", "source_size", "target",
                        F.when(F.col("free"), F.round(F.col("step") / F.col("scale"), 12)).alias("rate_log"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
          weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """(doc_id, key, size, source_size, target, copies): how often the mix takes each row of ``docs``.

    Sizes are words. Sources in code point order, null last, weigh ``weights`` over and over and share
    the sum of all sizes; a target stops at ``most`` times its source's size and the excess goes to
    the others by weight. ``key`` digests the whole row: equal rows are interchangeable, each with copies
    of its own. Null and empty texts have size 0 and one copy (no tokens); an empty table gives no rows.
    """
    named = F.when(F.col(source_col).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(source_col).cast("string")))
    rows = saved(docs.select(
        F.col(id_col).alias("doc_id"), F.xxhash64(*docs.columns).alias("key"), F.col(source_col).alias("source"),
        named.alias("sk"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("bigint").alias("size")), "sizes")
    sizes = saved(rows.groupBy("sk", "source", "size").agg(F.count("*").alias("n")), "histogram")
    duals = multipliers(sizes, source_targets(sizes, weights, most), most)
    rate = F.when(F.col("rate_log").isNull(), F.lit(float(most))).otherwise(
        F.least(F.lit(float(most)), F.exp(F.least(F.col("rate_log") * F.col("size"), F.lit(50.0)))))
    rated = sizes.join(duals, "sk").select("sk", "size", "n", "source_size", "target", F.round(rate * _UNIT).cast("bigint").alias("rate"))
    whole = saved(rated.groupBy("sk").applyInPandas(
        lambda group: _whole_copies(group, most), "sk STRING, size BIGINT, n BIGINT, source_size BIGINT, target DOUBLE, taken BIGINT"
    ).withColumn("parts", F.ceil(F.col("n") / _GROUP).cast("bigint")), "copies")

    placed = rows.join(whole, ["sk", "size"]).withColumn("part", F.pmod("key", "parts"))
    groups = placed.groupBy("sk", "size", "part").agg(F.count("*").alias("members"))
    before = F.sum("members").over(Window.partitionBy("sk", "size").orderBy("part")) - F.col("members")
    groups = saved(groups.select("sk", "size", "part", before.alias("before")), "offsets")
    place = F.col("before") + F.row_number().over(Window.partitionBy("sk", "size", "part").orderBy("key", "doc_id"))
    upto = lambda count: F.floor(count * F.col("taken") / F.col("n"))
    return placed.join(groups, ["sk", "size", "part"]).withColumn("place", place).select(
        "doc_id", "key", "size", "source_size", "target", (upto(F.col("place")) - upto(F.col("place") - 1)).alias("copies"))


def _whole_copies(group: pd.DataFrame, most: int) -> pd.DataFrame:
    """Copies of each size class of a source, ``taken`` for its ``n`` documents together. Large documents come first,
    and the words that rounding gave or took are made up for by the smaller ones that follow."""
    group = group.sort_values("size", ascending=False, kind="stable")
    carried, taken = 0, []
    for size, n, rate in zip(group["size"].tolist(), group["n"].tolist(), group["rate"].tolist(), strict=True):
        wanted = n * rate * size + carried
        unit = size * _UNIT
        copies = min(most * n, max(0, (2 * wanted + unit) // (2 * unit))) if size else n
        carried = wanted - copies * unit
        taken.append(copies)
    return group.drop(columns=["rate"]).assign(taken=taken)


def mixture(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as ``mixed`` says."""
    taken = mixed(docs, **options).groupBy("key").agg(F.sum("copies").alias("copies")).filter("copies > 0")
    rows = docs.select(F.struct("*").alias("row"), F.xxhash64(*docs.columns).alias("key"))
    one = rows.groupBy("key").agg(F.first("row").alias("row"))
    return one.join(taken, "key").select(F.explode(F.array_repeat("row", F.col("copies").cast("int"))).alias("row")).select("row.*")


def op3_source_mix(spark, sf_dir):
    found = mixed(documents(spark, sf_dir))
    return found.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
