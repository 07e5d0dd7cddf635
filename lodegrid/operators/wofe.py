"""Deterministic weights-of-evidence scores on the native 250 m cells, and their rollup.

Everything is keyed by integer cell indices. Neighbourhood and distance terms are written as short
exploded offsets that are min/max-combined before each shuffle, so cost is linear in the cells and no
group is ever collected. Offsets along a row are combined where the row lies, without a shuffle.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegrid import fixed
from lodegrid.functions import grid as g
from lodegrid.functions.scalars import exact_sum, lookup, round_dp, sentence
from lodegrid.operators.ranking import best_per_key
from lodegrid.session import materialise, shuffled

MAX_CONTRAST = max(v[0] for v in fixed.CONTRASTS.values())
LOGIT_SPAN = MAX_CONTRAST + fixed.FAULT_CONTRAST
REACH_CELLS = int(fixed.PLACER_BUFFER_M // fixed.WOFE_RESOLUTION)


def contrast(unit: Column) -> Column:
    """Published contrast; null for a unit without correlation, which is an answer and not a zero."""
    return lookup({k: v[0] for k, v in fixed.CONTRASTS.items()}, unit)


def describe_codes(cells: DataFrame) -> DataFrame:
    return cells.withColumns({
        "fault_type": lookup(fixed.FAULT_TYPES, F.col("fault_code")),
        "fold_type": lookup(fixed.FOLD_TYPES, F.col("fold_code")),
        "predictor_fault": F.coalesce(F.col("fault_code").isin(*fixed.PREDICTOR_FAULTS), F.lit(False)),
    })


def buffered_unit(cells: DataFrame) -> DataFrame:
    """Highest-contrast favourable unit among the eight neighbours of a position."""
    favourable = cells.select("col", "row", "geol_unit", contrast(F.col("geol_unit")).alias("_c")).where("_c is not null")
    offsets = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"))
                        for i in (-1, 0, 1) for j in (-1, 0, 1) if (i, j) != (0, 0)])
    around = favourable.withColumn("_o", F.explode(offsets)).select(
        (F.col("col") + F.col("_o.i")).alias("col"), (F.col("row") + F.col("_o.j")).alias("row"), "_c", "geol_unit")
    best = F.max(F.struct("_c", "geol_unit")).alias("_b")
    return around.groupBy("col", "row").agg(best).select("col", "row", F.col("_b.geol_unit").alias("buffer_unit"))


def fault_distance(cells: DataFrame, codes: tuple[int, ...] | None = None, reach: int = REACH_CELLS) -> DataFrame:
    """Exact distance to the nearest fault cell within ``reach`` cells, for every position in reach.

    The squared distance separates by axis: one minimum along columns, one along rows. That is
    2 * (2 * reach + 1) offsets per cell instead of all cells of the disc. Cells of one row are kept
    together for both, so only the offsets of fault cells are shuffled.
    """
    fault = F.col("fault_code").isNotNull() if codes is None else F.col("fault_code").isin(*codes)
    steps = F.explode(F.sequence(F.lit(-reach), F.lit(reach))).alias("_s")
    vertical = cells.where(fault).select("col", "row", steps).select(
        "col", (F.col("row") + F.col("_s")).alias("row"), (F.col("_s") * F.col("_s")).alias("_v")).repartition("row")
    vertical = vertical.groupBy("col", "row").agg(F.min("_v").alias("_v"))
    both = vertical.select("col", "row", "_v", steps).select(
        (F.col("col") + F.col("_s")).alias("col"), "row", (F.col("_v") + F.col("_s") * F.col("_s")).alias("_d2"))
    nearest = both.where(F.col("_d2") <= reach * reach).groupBy("col", "row").agg(F.min("_d2").alias("_d2"))
    return nearest.select("col", "row", (F.sqrt(F.col("_d2")) * fixed.WOFE_RESOLUTION).alias("fault_distance_m"))


def native_terms(cells: DataFrame, codes: tuple[int, ...] | None = None) -> DataFrame:
    """Lithology and structure terms of every native cell."""
    near = cells.join(shuffled(buffered_unit(cells)), ["col", "row"], "left").join(
        fault_distance(cells, codes), ["col", "row"], "left")
    own = F.when(contrast(F.col("geol_unit")).isNotNull(), F.col("geol_unit"))
    near = near.withColumns({"in_cell_unit": own, "_own": contrast(own), "_buf": contrast(F.col("buffer_unit"))})
    use_own = F.coalesce(F.col("_own"), F.lit(0.0)) >= F.coalesce(F.col("_buf"), F.lit(0.0))
    unit = F.when(F.col("_own").isNull() & F.col("_buf").isNull(), F.lit(None)).when(
        use_own, F.col("in_cell_unit")).otherwise(F.col("buffer_unit"))
    near = near.withColumns({
        "wofe_unit": unit,
        "contrast": F.greatest(F.coalesce(F.col("_own"), F.lit(0.0)), F.coalesce(F.col("_buf"), F.lit(0.0))),
        "favourable_frac": F.when(F.col("in_cell_unit").isNotNull(), F.coalesce("geol_unit_frac", F.lit(1.0))).otherwise(0.0),
        "fault_within_buffer": F.coalesce(F.col("fault_distance_m") <= fixed.FAULT_BUFFER_M, F.lit(False)),
    })
    return near.withColumn(
        "litho_buffer_only", F.col("in_cell_unit").isNull() & F.col("wofe_unit").isNotNull()).drop("_own", "_buf", "buffer_unit")


def prior_logit(footprint_cells: Column) -> Column:
    """Log-odds of the training-site density over the footprint."""
    p = F.lit(float(fixed.TRAINING_SITES)) / F.greatest(footprint_cells, F.lit(fixed.TRAINING_SITES + 1))
    return F.log(p / (1.0 - p))


def score_terms(terms: DataFrame, prior: Column, trend: Column | None = None) -> DataFrame:
    """Tract, score, logit and posterior. A missing trend drops out and the rest is renormalised."""
    trend = F.lit(None).cast("boolean") if trend is None else trend
    w_fault = F.when(F.col("fault_within_buffer"), fixed.FAULT_CONTRAST).otherwise(0.0)
    tract = F.when((F.col("contrast") > 0) & F.col("fault_within_buffer"), "favourable").when(
        F.col("contrast") > 0, "permissive").otherwise("non_permissive")
    evidence = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("contrast") + w_fault) / LOGIT_SPAN))
    close = F.coalesce(F.greatest(F.lit(0.0), 1.0 - F.col("fault_distance_m") / fixed.PLACER_BUFFER_M), F.lit(0.0))
    we, wc, wt = (fixed.BAND_WEIGHTS[k] for k in ("evidence", "closeness", "trend"))
    base = we * evidence + wc * close
    place = F.when(trend.isNull(), base / (we + wc)).otherwise(
        (base + wt * F.when(trend, 1.0).otherwise(0.0)) / (we + wc + wt))
    out = terms.withColumns({"tract": tract, "favourable_trend": trend, "_place": place,
                             "logit": prior + F.col("contrast") + w_fault})
    low = lookup({k: v[0] for k, v in fixed.TRACT_BANDS.items()}, F.col("tract"))
    high = lookup({k: v[1] for k, v in fixed.TRACT_BANDS.items()}, F.col("tract"))
    return out.withColumns({
        "score": round_dp(low + F.col("_place") * (high - low), 4),
        "posterior": 1.0 / (1.0 + F.exp(-F.col("logit"))),
    }).drop("_place")


def native_scores(cells: DataFrame, trend: Column | None = None) -> DataFrame:
    size = cells.agg(F.count("*")).scalar()
    return score_terms(native_terms(cells), prior_logit(size), trend)


# --- coarser and finer cells --------------------------------------------------------------------
def children(requested: DataFrame, keys: list[str]) -> DataFrame:
    """Native positions of requested cells (keys, res, col, row): all children, or the one parent."""
    base = fixed.WOFE_RESOLUTION
    k = F.greatest(F.lit(1), (F.col("res") / base).cast("int"))
    up = F.greatest(F.lit(1), F.floor(F.lit(base) / F.col("res")).cast("int"))
    sized = requested.withColumns({
        "_child_k": k, "_child_c": F.floor(F.col("col") / up).cast("int") * k, "_child_r": F.floor(F.col("row") / up).cast("int") * k})
    wide = sized.withColumn("_child_cc", F.explode(F.sequence(F.col("_child_c"), F.col("_child_c") + F.col("_child_k") - 1)))
    tall = wide.withColumn("_child_rr", F.explode(F.sequence(F.col("_child_r"), F.col("_child_r") + F.col("_child_k") - 1)))
    return tall.select(*keys, "res", F.col("_child_cc").alias("col"), F.col("_child_rr").alias("row"),
                       (F.col("_child_k") * F.col("_child_k")).alias("expected"))


def unit_facts(requested: DataFrame, cells: DataFrame, keys: list[str]) -> DataFrame:
    """Unit shares weighted by coverage, favourable ground, fault, fold and dike lists of each cell."""
    kids = children(requested, keys).join(shuffled(cells), ["col", "row"])
    kids = kids.withColumn("_w", F.when(F.col("geol_unit").isNotNull(), F.coalesce("geol_unit_frac", F.lit(1.0))))
    by_unit = kids.where("geol_unit is not null").groupBy(*keys, "geol_unit").agg(
        exact_sum(F.col("_w")).alias("_share"), F.min(F.struct("col", "row")).alias("_first"))
    totals = by_unit.groupBy(*keys).agg(
        exact_sum(F.col("_share")).alias("_total"),
        F.max_by("geol_unit", contrast(F.col("geol_unit"))).alias("favourable_unit"),
        F.max(contrast(F.col("geol_unit"))).alias("favourable_contrast"),
        exact_sum(F.when(contrast(F.col("geol_unit")).isNotNull(), F.col("_share"))).alias("_fav"),
    )
    totals = totals.withColumn("favourable_unit", F.when(F.col("favourable_contrast").isNotNull(), F.col("favourable_unit")))
    top = best_per_key(by_unit, keys, [F.desc("_share"), F.asc("_first")], 4).join(shuffled(totals.select(*keys, "_total")), keys)
    frac = round_dp(F.col("_share") / F.col("_total"), 3)
    units = top.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(
        "place", F.col("geol_unit").alias("unit"), frac.alias("frac"),
        contrast(F.col("geol_unit")).alias("contrast")))).alias("units"))
    # Code sets are small domains, so set collection stays bounded.
    codes = kids.groupBy(*keys).agg(
        F.count("*").alias("source_cells"), (F.first("res") < fixed.WOFE_RESOLUTION).alias("inherited"),
        F.slice(F.sort_array(F.collect_set("fault_code")), 1, 6).alias("fault_codes"),
        F.coalesce(F.bool_or(F.col("fault_code").isin(*fixed.PREDICTOR_FAULTS)), F.lit(False)).alias("has_predictor_fault"),
        F.slice(F.sort_array(F.collect_set("fold_code")), 1, 6).alias("fold_codes"),
        F.slice(F.sort_array(F.collect_set("dike_unit")), 1, 4).alias("dike_units"))
    first = F.try_element_at("units", F.lit(1))
    formation = lookup({k: v[3] for k, v in fixed.CONTRASTS.items()}, F.col("favourable_unit"))
    return codes.join(shuffled(units), keys, "left").join(shuffled(totals), keys, "left").select(
        *keys, "source_cells", "inherited", "units", first["unit"].alias("unit"), first["frac"].alias("unit_frac"),
        first["contrast"].alias("contrast"), "favourable_unit", "favourable_contrast",
        round_dp(F.try_divide("_fav", "_total"), 3).alias("favourable_frac"), formation.alias("formation"),
        "fault_codes", "has_predictor_fault", "fold_codes", "dike_units")


def roll_up(requested: DataFrame, terms: DataFrame, keys: list[str], prior: Column,
            trend: DataFrame | None = None, mineral: str = fixed.MODEL_MINERAL) -> DataFrame:
    """Scores of requested cells at any rung; every requested cell comes back, scored or refused.

    ``trend`` is keyed like ``requested`` with a nullable ``favourable_trend``.
    """
    kids = children(requested, keys)
    if trend is not None:
        kids = kids.join(shuffled(trend.select(*keys, F.col("favourable_trend").alias("_trend"))), keys, "left")
        scored = score_terms(kids.join(shuffled(terms), ["col", "row"]), prior, F.col("_trend"))
    else:
        scored = kids.join(shuffled(score_terms(terms, prior)), ["col", "row"])
    spot = F.struct(-F.col("col"), -F.col("row"))
    has_unit = F.col("wofe_unit").isNotNull()
    best_order = F.struct(
        has_unit, F.when(has_unit, F.col("contrast")).otherwise(F.col("score")), spot)
    best = F.struct("wofe_unit", "in_cell_unit", "contrast", "geol_unit", "geol_unit_frac", "litho_buffer_only",
                    "fault_distance_m", "fault_within_buffer", "favourable_trend", "posterior")
    tracts = [F.count_if(F.col("tract") == t).alias(f"_n_{t}") for t in fixed.TRACTS]
    agg = scored.groupBy(*keys).agg(
        F.count("*").alias("wofe_cells"), exact_sum(F.col("score"), 4).alias("_sum"),
        F.max("score").alias("score_max"), F.min("score").alias("score_min"), *tracts,
        round_dp(F.max("posterior"), 6).alias("posterior"), round_dp(F.max("logit"), 4).alias("logit"),
        exact_sum(F.col("favourable_frac")).alias("_fav"), F.max_by(best, best_order).alias("_best"),
        F.coalesce(F.bool_and(F.when(has_unit, F.col("litho_buffer_only"))), F.lit(False)).alias("litho_buffer_only"),
        round_dp(F.min("fault_distance_m"), 1).alias("fault_distance_m"),
        F.bool_or("fault_within_buffer").alias("fault_within_buffer"),
        F.slice(F.sort_array(F.collect_set("fault_code")), 1, 6).alias("fault_codes"),
        F.bool_or("favourable_trend").alias("favourable_trend"),
    )
    share = F.coalesce(F.nullif(F.col("geol_unit_frac"), F.lit(0.0)), F.lit(1.0))
    by_unit = kids.join(shuffled(terms.where("geol_unit is not null").select("col", "row", "geol_unit", "geol_unit_frac")), ["col", "row"])
    # One shuffle by request serves both steps; the first child is the least of numbers that grow with col and row.
    place = F.shiftleft(F.col("col").cast("bigint"), 32) + F.col("row") + 2**31
    units = by_unit.repartition(*keys).groupBy(*keys, "geol_unit").agg(exact_sum(share).alias("_a"), F.min(place).alias("_first"))
    modal = units.groupBy(*keys).agg(F.max_by(F.struct("geol_unit", "_a"), F.struct("_a", -F.col("_first"))).alias("_m"))
    res = F.col("res")
    expected = F.when(res > fixed.WOFE_RESOLUTION, (res / fixed.WOFE_RESOLUTION) * (res / fixed.WOFE_RESOLUTION)).otherwise(1.0)
    out = requested.join(shuffled(agg), keys, "left").join(shuffled(modal), keys, "left")
    n = F.coalesce(F.col("wofe_cells"), F.lit(0))
    out = out.withColumn("coverage_frac", n / expected)
    outside = F.lit(fixed.REFUSED_OUTSIDE)
    refused = F.when(n == 0, outside).when(F.col("coverage_frac") < fixed.MIN_COVERAGE, fixed.REFUSED_PARTIAL)
    if mineral.strip().lower() != fixed.MODEL_MINERAL:
        refused = F.lit(fixed.REFUSED_MINERAL % mineral.strip().lower())
    out = out.withColumn("refused", refused)
    ok = F.col("refused").isNull()
    counts = [F.struct(F.col(f"_n_{t}").alias("n"), F.lit(-i).alias("r"), F.lit(t).alias("t")) for i, t in enumerate(fixed.TRACTS)]
    out = out.withColumns({
        "tract": F.when(ok, F.greatest(*counts)["t"]),
        "score": F.when(ok, round_dp(F.col("_sum") / n, 4)),
        "tract_fracs": F.when(ok, F.map_from_arrays(
            F.array(*[F.lit(t) for t in fixed.TRACTS]), F.array(*[round_dp(F.col(f"_n_{t}") / n, 3) for t in fixed.TRACTS]))),
        "unit": F.when(ok, F.col("_m.geol_unit")), "unit_frac": F.when(ok, round_dp(F.col("_m._a") / n, 3)),
        "wofe_unit": F.when(ok, F.col("_best.wofe_unit")), "contrast": F.when(ok, round_dp(F.col("_best.contrast"), 3)),
        "favourable_frac": F.when(ok, round_dp(F.col("_fav") / n, 3)),
        "inherited_from_250m": F.when(ok & (res < fixed.WOFE_RESOLUTION), True),
    })
    for c in ("score_max", "score_min", "posterior", "logit", "fault_distance_m", "fault_within_buffer",
              "litho_buffer_only", "favourable_trend", "fault_codes"):
        out = out.withColumn(c, F.when(ok, F.col(c)))
    out = out.withColumns({"evidence": evidence_lines(n, expected), "coverage_frac": round_dp(F.col("coverage_frac"), 3)})
    trend_known = F.col("favourable_trend")
    sources = F.when(ok & trend_known, F.array(F.lit(fixed.CITE_RASTER), F.lit(fixed.CITE_MODEL), F.lit(fixed.CITE_GEOLOGY))).when(
        ok & trend_known.isNotNull(), F.array(F.lit(fixed.CITE_RASTER), F.lit(fixed.CITE_MODEL), F.lit(fixed.CITE_GEOLOGY))).when(
        ok, F.array(F.lit(fixed.CITE_RASTER), F.lit(fixed.CITE_MODEL))).otherwise(F.array().cast("array<string>"))
    return out.withColumn("data_sources_used", sources).drop(
        "_sum", "_fav", "_m", "_best", *[f"_n_{t}" for t in fixed.TRACTS])


def _whole(x: Column) -> Column:
    return F.floor(x + 0.5).cast("bigint").cast("string")


def evidence_lines(n: Column, expected: Column) -> Column:
    """The terms of the model that fired, as sentences. Reads the rolled-up columns and the best child."""
    res, best = F.col("res"), lambda c: F.col(f"_best.{c}")
    near, reach, far = (f"{int(v)} m" for v in (fixed.LITHOLOGY_BUFFER_M, fixed.FAULT_BUFFER_M, fixed.PLACER_BUFFER_M))
    native = res == fixed.WOFE_RESOLUTION
    place = F.when(native, "cell").otherwise("best 250 m sub-cell")
    of_unit = lambda i: lookup({k: v[i] for k, v in fixed.CONTRASTS.items()}, best("wofe_unit"))
    where = (
        F.when(best("litho_buffer_only"), sentence("unit_in_buffer_only", near, place))
        .when(best("wofe_unit") == best("in_cell_unit"),
              sentence("unit_in_cell", place, _whole(F.coalesce(best("geol_unit_frac"), F.lit(1.0)) * 100)))
        .otherwise(sentence("unit_beside", near, place, best("in_cell_unit")))
    )
    unit = (
        F.when(best("wofe_unit").isNotNull(), sentence(
            "unit_with_sites", best("wofe_unit"), of_unit(3), where, of_unit(0), of_unit(1), str(fixed.TRAINING_SITES)))
        .when(best("geol_unit").isNotNull(), sentence("unit_without_sites", best("geol_unit")))
        .otherwise(sentence("unit_unknown"))
    )
    metres = best("fault_distance_m")
    fault = (
        F.when(metres.isNull(), sentence("fault_none", far, reach))
        .when(best("fault_within_buffer"), sentence("fault_inside", _whole(metres), reach, str(fixed.FAULT_CONTRAST)))
        .otherwise(sentence("fault_outside", _whole(metres), reach))
    )
    turn = best("favourable_trend")
    trend = F.when(turn.isNull(), sentence("trend_unknown")).when(turn, sentence("trend_yes")).otherwise(sentence("trend_no"))
    guidance = lookup({k: f"{v[0]:.2f}-{v[1]:.2f}" for k, v in fixed.TRACT_BANDS.items()}, F.col("tract"))
    tract = sentence("tract", F.col("tract"), guidance, F.format_string("%.2e", best("posterior")))
    passed = F.when(res < fixed.WOFE_RESOLUTION, "inherited by").otherwise("averaged to")
    scaled = F.when(~native, sentence("scaled", n, passed, res))
    partial = F.when(n < expected, sentence("partial", _whole(n / expected * 100)))
    told = F.array_compact(F.array(unit, fault, trend, tract, scaled, partial))
    return F.when(F.col("refused").isNotNull(), F.array(sentence("refused", F.col("refused")))).otherwise(told)


def score_requests(ids: DataFrame, cells: DataFrame, mineral: str = fixed.MODEL_MINERAL,
                   trend: DataFrame | None = None) -> DataFrame:
    """Scores for bare cell ids, malformed ids refused rather than dropped."""
    unique = ids.select("cell_id").where("cell_id is not null").distinct()
    parsed = materialise(unique.withColumn("_p", g.parse_cell_id(F.col("cell_id"))), "requests")
    # The numbers in an id and its length tell it from all others, and are joined and sorted sooner than its text.
    keys = ["_r", "_c", "_z", "_length"]
    good = parsed.where("_p is not null").select(
        "cell_id", "_p.res", "_p.col", "_p.row", F.col("_p.row").alias("_r"), F.col("_p.col").alias("_c"), F.col("_p.res").alias("_z"),
        F.length("cell_id").alias("_length"))
    if trend is not None:
        trend = trend.join(shuffled(good.select("cell_id", *keys)), "cell_id")
    size = cells.agg(F.count("*")).scalar()
    scored = roll_up(good, materialise(native_terms(cells), "terms"), keys, prior_logit(size), trend, mineral).drop("res", "col", "row", *keys)
    reason = F.lit(fixed.REFUSED_BAD_ID if mineral.strip().lower() == fixed.MODEL_MINERAL
                   else fixed.REFUSED_MINERAL % mineral.strip().lower())
    bad = parsed.where("_p is null").select("cell_id", reason.alias("refused")).withColumn(
        "evidence", F.array(F.concat(F.lit("No WofE baseline: "), F.col("refused"))))
    return scored.unionByName(bad, allowMissingColumns=True)


# --- reports ------------------------------------------------------------------------------------
def refusal_report(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Cells, scored cells, coverage and tract counts per group; refusals are counted, never averaged."""
    return scored.groupBy(*keys).agg(
        F.count("*").alias("cells"), F.count("score").alias("scored"),
        round_dp(F.count("score") / F.count("*"), 4).alias("coverage"),
        F.count_if(F.col("refused") == fixed.REFUSED_OUTSIDE).alias("refused_outside"),
        F.count_if(F.col("refused") == fixed.REFUSED_PARTIAL).alias("refused_partial"),
        *[F.count_if(F.col("tract") == t).alias(t) for t in fixed.TRACTS])


def scored_only(scored: DataFrame) -> DataFrame:
    return scored.where(F.col("score").isNotNull())


def build_report(cells: DataFrame) -> DataFrame:
    return cells.agg(
        F.count("*").alias("cells"), F.count("geol_unit").alias("with_unit"), F.count("fault_code").alias("with_fault"),
        F.count("fold_code").alias("with_fold"), F.count("dike_unit").alias("with_dike"))


def unit_report(cells: DataFrame, top: int = 12) -> DataFrame:
    """Largest units by cells, with the area they cover and their contrast."""
    km2 = (fixed.WOFE_RESOLUTION / 1000.0) ** 2
    counts = cells.where("geol_unit is not null").groupBy("geol_unit").agg(F.count("*").alias("cells"))
    return counts.withColumns({"km2": F.col("cells") * km2, "contrast": contrast(F.col("geol_unit"))}).orderBy(
        F.desc("cells"), "geol_unit").limit(top)
