"""Fusing scorer outputs into one confidence-weighted score per cell."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegrid import fixed
from lodegrid.functions.scalars import exact_sum, lookup, round_dp
from lodegrid.operators.ranking import best_per_key
from lodegrid.session import shuffled


def checked_weights(weights: dict[str, float]) -> None:
    if any(w < 0 for w in weights.values()):
        raise ValueError("scorer weights must not be negative")


def weights_table(spark, weights: dict[str, float]) -> DataFrame:
    checked_weights(weights)
    return spark.createDataFrame([(k, float(v)) for k, v in weights.items()], "agent_id string, weight double")


def latest_per_scorer(scores: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Last write per (cell, scorer); repeats collapse in each task before the shuffle. The scorer is the last key."""
    values = [c for c in scores.columns if c not in keys]
    last = F.max_by(F.struct(*values), F.struct(*order))
    return scores.groupBy(*keys).agg(last.alias("v")).select(*keys, "v.*")


def fuse(scores: DataFrame, cell_keys: list[str], weights: dict[str, float] | None = None,
         evidence: bool = False) -> DataFrame:
    """Score = S(w c s) / S(w c), confidence = S(w c) / S(w); both 0 when nothing carries weight.

    ``scores`` holds one row per cell and scorer. Scorers without a weight count 1.
    """
    checked_weights(weights or {})
    w = F.coalesce(lookup({k: float(v) for k, v in weights.items()}, F.col("agent_id")), F.lit(1.0)) if weights else F.lit(1.0)
    wc = w * F.col("confidence")
    aggs = [
        exact_sum(wc * F.col("score")).alias("_wcs"), exact_sum(wc).alias("_wc"), exact_sum(w).alias("_w"),
    ]
    out = scores.groupBy(*cell_keys).agg(*aggs)
    zero = F.lit(0.0)
    fused = out.withColumns({
        "score": F.when(F.col("_wc") > 0, round_dp(F.try_divide("_wcs", "_wc"), 4)).otherwise(zero),
        "confidence": F.when(F.col("_wc") > 0, round_dp(F.try_divide("_wc", "_w"), 4)).otherwise(zero),
    })
    fused = fused.drop("_wcs", "_wc", "_w")
    if not evidence:
        return fused
    # Lines are cut to the first ones of a cell before any list of them is made; sources are few by nature.
    lines = scores.select(*cell_keys, "agent_id", F.posexplode("evidence").alias("_i", "_line"))
    first = best_per_key(lines, cell_keys, [F.asc("agent_id"), F.asc("_i")], fixed.MAX_EVIDENCE, "_place")
    told = first.groupBy(*cell_keys).agg(F.array_sort(F.collect_list(F.struct(
        "_place", F.concat(F.lit("["), F.col("agent_id"), F.lit("] "), F.col("_line")).alias("line")))).alias("_ev"))
    named = scores.select(*cell_keys, F.explode("sources").alias("_source")).groupBy(*cell_keys).agg(F.sort_array(F.collect_set("_source")).alias("sources"))
    out = fused.join(shuffled(told), cell_keys, "left").join(shuffled(named), cell_keys, "left")
    empty = F.array().cast("array<string>")
    return out.withColumns({"evidence": F.coalesce(F.transform("_ev", lambda s: s["line"]), empty), "sources": F.coalesce("sources", empty)}).drop("_ev")


def fill_grid(cells: DataFrame, fused: DataFrame, keys: list[str]) -> DataFrame:
    """Every grid cell once: unscored cells get score and confidence 0, scores off the grid are ignored."""
    out = cells.select(*keys).join(shuffled(fused), keys, "left")
    return out.fillna(0.0, subset=["score", "confidence"])


def completed_only(results: DataFrame) -> DataFrame:
    return results.where(F.col("status") == "completed")


def fill_missing(cells: DataFrame, scored: DataFrame, keys: list[str]) -> DataFrame:
    """Cells a scorer skipped, as zero-confidence rows that carry no weight."""
    missing = cells.select(*keys).join(shuffled(scored.select(*keys)), keys, "left_anti")
    filler: dict[str, Column] = {
        "score": F.lit(0.0), "confidence": F.lit(0.0), "evidence": F.array(F.lit("Cell not scored by LLM")),
        "sources": F.array().cast("array<string>"),
    }
    missing = missing.withColumns({k: v for k, v in filler.items() if k in scored.columns})
    return scored.unionByName(missing)


def grounded_fraction(weights: DataFrame, keys: list[str]) -> DataFrame:
    """Share of weight from scorers with a knowledge file. Needs weight and grounded columns."""
    w = F.coalesce(F.col("weight"), F.lit(1.0))
    total, good = exact_sum(w), exact_sum(F.when(F.col("grounded"), w).otherwise(0.0))
    out = weights.groupBy(*keys).agg(total.alias("_t"), good.alias("_g"))
    share = F.when(F.col("_t") > 0, round_dp(F.try_divide("_g", "_t"), 4)).otherwise(F.lit(0.0))
    return out.select(*keys, share.alias("grounded_fraction"))


def breakdown_by_parent(display: DataFrame, agent_scores: DataFrame) -> DataFrame:
    """Scorer rows of a display cell, looked up through its analysis parent when interpolated."""
    key = F.coalesce(F.col("parent_cell_id"), F.col("cell_id"))
    right = agent_scores.withColumnRenamed("cell_id", "_lookup")
    return display.withColumn("_lookup", key).join(shuffled(right), "_lookup", "left").drop("_lookup")
