"""The analysis of areas of interest from end to end, as lazy plans over tables."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegrid import fixed
from lodegrid.functions import grid as g
from lodegrid.functions.scalars import round_dp
from lodegrid.operators import fusion, overlay, ranking, spatial, wofe
from lodegrid.session import materialise, shuffled


@dataclass
class Analysis:
    analysis_res: int = 1000
    display_res: int = 250
    mineral: str = "gold"
    weights: dict[str, float] | None = None


def with_ids(cells: DataFrame) -> DataFrame:
    return cells.withColumn("cell_id", g.cell_id(F.col("res"), F.col("col"), F.col("row")))


def analyse(rings: DataFrame, occurrences: DataFrame, scores: DataFrame, job: Analysis) -> DataFrame:
    """Cells of every area, fused from scorer rows, interpolated to the display grid, ranked and labelled by novelty.

    ``rings`` (aoi_id, rings), ``scores`` (aoi_id, col, row, agent_id, score, confidence, written) on the
    analysis grid.
    """
    keys = ["aoi_id", "col", "row"]
    edges = overlay.ring_edges(overlay.rings_in_range(rings), ["aoi_id"])
    cells = materialise(overlay.cover(edges, ["aoi_id"], job.analysis_res), "cells")
    weights = job.weights if job.weights is not None else fixed.SCORER_WEIGHTS.get(job.mineral, {})
    last = fusion.latest_per_scorer(scores, [*keys, "agent_id"], ["written"])
    fused = fusion.fill_grid(cells, fusion.fuse(last, keys, weights), keys)

    framed = spatial.framed_cells(cells, ["aoi_id"])
    reach = fixed.SEARCH_RADIUS_KM * 1000.0
    # Novelty hangs on the nearest record alone, which an empty layer leaves as unknown as ground without records.
    near = spatial.first_near(framed, spatial.near_squares(framed, occurrences, reach, job.analysis_res), reach, [([], 1)])
    nearest = near.groupBy(*keys).agg(F.min_by(F.struct("distance_m", "name"), F.struct("distance_m", "site_id")).alias("_n")).select(
        *keys, round_dp(F.col("_n.distance_m") / 1000.0, 2).alias("nearest_km"), F.col("_n.name").alias("nearest_name"))
    novelty = spatial.novelty_facts(cells.select(*keys).join(shuffled(nearest), keys, "left"), keys)

    if job.display_res == job.analysis_res:
        shown = fused.withColumns({"parent_col": F.lit(None).cast("int"), "parent_row": F.lit(None).cast("int")})
        up = novelty
        ranked = ranking.rank_relative(shown, ["aoi_id"])
        return ranked.join(shuffled(up), keys, "left").withColumn("res", F.lit(job.display_res))
    fine = overlay.cover(edges, ["aoi_id"], job.display_res)
    shown = spatial.interpolate(fine, fused, ["aoi_id"], job.display_res, job.analysis_res)
    ranked = ranking.rank_relative(shown, ["aoi_id"])
    # Facts were measured on the analysis cell, so a finer cell inherits them.
    up = novelty.withColumnsRenamed({"col": "parent_col", "row": "parent_row"})
    return ranked.join(shuffled(up), ["aoi_id", "parent_col", "parent_row"], "left").withColumn("res", F.lit(job.display_res))


def baseline(rings: DataFrame, wofe_cells: DataFrame, res: int = fixed.WOFE_RESOLUTION, mineral: str = "gold",
             trend: DataFrame | None = None) -> DataFrame:
    """Deterministic scores of every area, no scorer rows needed; refused cells carry their reason."""
    cells = materialise(overlay.cover(overlay.ring_edges(overlay.rings_in_range(rings), ["aoi_id"]), ["aoi_id"], res), "cells")
    size = wofe_cells.agg(F.count("*")).scalar()
    terms, prior, square = wofe.native_terms(wofe_cells), wofe.prior_logit(size), spatial.SQUARE
    if trend is None:
        # Nothing but the cell of the grid decides, so each is scored once for all areas that have it.
        request = cells.select(*square).distinct().withColumns({"_z": F.col("res"), "_c": F.col("col"), "_r": F.col("row")})
        scored = wofe.roll_up(request, terms, ["_z", "_c", "_r"], prior, None, mineral).drop("_z", "_c", "_r")
        return cells.join(shuffled(scored), square)
    request = cells.withColumns({"_c": F.col("col"), "_r": F.col("row")})
    return wofe.roll_up(request, terms, ["aoi_id", "_c", "_r"], prior, trend, mineral).drop("_c", "_r")
