"""Fusion, ranking, tiers, correlation and usage queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from lodegrid import fixed
from lodegrid.catalog.registry import register
from lodegrid.catalog.views import table, view, with_views
from lodegrid.functions import scalars as sc
from lodegrid.operators import fusion, ranking

# Weights for the six scorer ids that occur in the view; 'NF' is left out to exercise the default of 1.
WEIGHTS = {"AF": 0.30, "NO": 0.25, "RF": 0.20, "AO": 0.15, "RO": 0.07}
_W = "CASE agent_id " + " ".join(f"WHEN '{k}' THEN {v}e0" for k, v in WEIGHTS.items()) + " ELSE 1e0 END"


def _fx(e, p=9):
    return f"CAST(floor(({e}) * 1e{p} + 0.5e0) AS BIGINT)"


def _fsum(e, p=9):
    return f"(CAST(sum({_fx(e, p)}) AS DOUBLE) / 1e{p})"


def _rd(e, p=4):
    return f"(floor(CAST(({e}) AS DOUBLE) * 1e{p} + 0.5e0) / 1e{p})"


_LAST = f"""{with_views('agent_score')}, last AS (
  SELECT * FROM agent_score QUALIFY row_number() OVER (
    PARTITION BY aoi_id, cell_key, agent_id ORDER BY ord1 DESC, ord2 DESC, ord3 DESC) = 1)"""
_FUSED = f"""{_LAST}, sums AS (
  SELECT aoi_id, cell_key, {_fsum(f'{_W} * confidence * score')} AS wcs, {_fsum(f'{_W} * confidence')} AS wc,
         {_fsum(_W)} AS w FROM last GROUP BY 1, 2), fused AS (
  SELECT aoi_id, cell_key, CASE WHEN wc > 0 THEN {_rd('wcs / wc')} ELSE 0e0 END AS score,
         CASE WHEN wc > 0 THEN {_rd('wc / w')} ELSE 0e0 END AS confidence FROM sums)"""
_RANKED = f"""{_FUSED}, pos AS (
  SELECT *, min(score) OVER p AS lo, max(score) OVER p AS hi, count(*) OVER p AS n,
         rank() OVER (PARTITION BY aoi_id ORDER BY score) - 1 AS below,
         count(*) OVER (PARTITION BY aoi_id, score) AS tied
  FROM fused WINDOW p AS (PARTITION BY aoi_id)), ranked AS (
  SELECT aoi_id, cell_key, score, confidence,
         CASE WHEN hi - lo > 1e-9 THEN {_rd('(score - lo) / (hi - lo)')} ELSE 0.5e0 END AS relative_score,
         {_rd('(below + tied / 2e0) / n')} AS percentile, hi - lo > 1e-9 AS varied FROM pos), tiered AS (
  SELECT aoi_id, cell_key, score, confidence, relative_score, percentile,
         CASE WHEN NOT varied THEN 'low' WHEN percentile >= 0.9e0 THEN 'high' WHEN percentile >= 0.65e0 THEN 'medium'
              WHEN percentile >= 0.35e0 THEN 'low' ELSE 'negligible' END AS tier FROM ranked)"""


def last_scores(spark, d):
    return fusion.latest_per_scorer(
        view(spark, d, "agent_score"), ["aoi_id", "cell_key", "agent_id"], ["ord1", "ord2", "ord3"]
    )


def fused_scores(spark, d):
    return fusion.fuse(last_scores(spark, d), ["aoi_id", "cell_key"], WEIGHTS)


@register("scores_last_write_wins", f"{_LAST} SELECT aoi_id, cell_key, agent_id, score, confidence FROM last")
def _(spark, d):
    return last_scores(spark, d).select("aoi_id", "cell_key", "agent_id", "score", "confidence")


@register("scores_fused", f"{_FUSED} SELECT * FROM fused")
def _(spark, d):
    return fused_scores(spark, d)


@register("cells_ranked", f"{_RANKED} SELECT * FROM tiered")
def cells_ranked(spark, d):
    return ranking.rank_relative(fused_scores(spark, d), ["aoi_id"])


@register("grid_filled", f"""{_FUSED}, grid AS (SELECT s_suppkey AS aoi_id, unnest(range(0, 100)) AS cell_key FROM supplier)
  SELECT g.aoi_id, g.cell_key, coalesce(f.score, 0e0) AS score, coalesce(f.confidence, 0e0) AS confidence
  FROM grid g LEFT JOIN fused f ON f.aoi_id = g.aoi_id AND f.cell_key = g.cell_key""")
def _(spark, d):
    keys = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(99).cast("bigint"))).alias("cell_key")
    grid = table(spark, d, "supplier").select(F.col("s_suppkey").alias("aoi_id"), keys)
    return fusion.fill_grid(grid, fused_scores(spark, d), ["aoi_id", "cell_key"])


@register("scores_unscored_filled", f"""{_LAST}, grid AS (SELECT DISTINCT aoi_id, cell_key FROM agent_score),
  one AS (SELECT * FROM last WHERE agent_id = 'AF')
  SELECT g.aoi_id, g.cell_key, coalesce(o.score, 0e0) AS score, coalesce(o.confidence, 0e0) AS confidence
  FROM grid g LEFT JOIN one o ON o.aoi_id = g.aoi_id AND o.cell_key = g.cell_key""")
def _(spark, d):
    keys = ["aoi_id", "cell_key"]
    grid = view(spark, d, "agent_score").select(*keys).distinct()
    one = last_scores(spark, d).where("agent_id = 'AF'").select(*keys, "score", "confidence")
    return fusion.fill_missing(grid, one, keys)


@register("fused_evidence_sources", f"""{_LAST}, lines AS (
  SELECT aoi_id, cell_key, agent_id, unnest([1, 2, 3, 4]) AS i, score, confidence FROM last)
  SELECT aoi_id, cell_key,
    array_to_string(list('[' || agent_id || '] note ' || i ORDER BY agent_id, i)[1:20], '|') AS evidence,
    array_to_string(list(DISTINCT 'src' || left(agent_id, 1) ORDER BY 'src' || left(agent_id, 1)), '|') AS sources
  FROM lines GROUP BY 1, 2""")
def _(spark, d):
    notes = F.array(*[F.lit(f"note {i}") for i in range(1, 5)])
    rows = last_scores(spark, d).withColumns({
        "evidence": notes, "sources": F.array(F.concat(F.lit("src"), F.substring("agent_id", 1, 1)))
    })
    out = fusion.fuse(rows, ["aoi_id", "cell_key"], WEIGHTS, evidence=True)
    return out.select("aoi_id", "cell_key", F.array_join("evidence", "|").alias("evidence"),
                      F.array_join("sources", "|").alias("sources"))


@register("tier_bands", f"""{_FUSED} SELECT aoi_id, cell_key,
  CASE WHEN score >= 0.65e0 THEN 'high' WHEN score >= 0.4e0 THEN 'medium' WHEN score >= 0.2e0 THEN 'low' ELSE 'negligible' END AS display_tier,
  CASE WHEN score >= 0.7e0 THEN 'high' WHEN score >= 0.45e0 THEN 'medium' WHEN score >= 0.2e0 THEN 'low' ELSE 'negligible' END AS documented_tier
  FROM fused""")
def _(spark, d):
    return fused_scores(spark, d).select(
        "aoi_id", "cell_key", sc.tier(F.col("score"), fixed.DISPLAY_TIERS).alias("display_tier"),
        sc.tier(F.col("score"), fixed.DOCUMENTED_TIERS).alias("documented_tier"))


@register("tier_counts", f"""{_RANKED} SELECT aoi_id, count(*) FILTER (tier = 'high') AS high,
  count(*) FILTER (tier = 'medium') AS medium, count(*) FILTER (tier = 'low') AS low,
  count(*) FILTER (tier = 'negligible') AS negligible FROM tiered GROUP BY 1""")
def _(spark, d):
    t = F.col("tier")
    return cells_ranked(spark, d).groupBy("aoi_id").agg(
        *[F.count_if(t == name).alias(name) for name in ("high", "medium", "low", "negligible")])


@register("cells_mid_rank", f"""{_FUSED} SELECT aoi_id, cell_key,
  rank() OVER (PARTITION BY aoi_id ORDER BY score) + (count(*) OVER (PARTITION BY aoi_id, score) - 1) / 2e0 AS mid_rank
  FROM fused""")
def _(spark, d):
    return ranking.mid_rank(fused_scores(spark, d), ["aoi_id"], "score", "mid_rank").select(
        "aoi_id", "cell_key", "mid_rank")


@register("rank_correlation", f"""{_FUSED}, r AS (SELECT aoi_id,
  rank() OVER (PARTITION BY aoi_id ORDER BY score) + (count(*) OVER (PARTITION BY aoi_id, score) - 1) / 2e0 AS a,
  rank() OVER (PARTITION BY aoi_id ORDER BY confidence) + (count(*) OVER (PARTITION BY aoi_id, confidence) - 1) / 2e0 AS b
  FROM fused), s AS (SELECT aoi_id, count(*) AS n, sum(2*a) AS sa, sum(2*b) AS sb, sum(4*a*b) AS sab, sum(4*a*a) AS saa,
  sum(4*b*b) AS sbb FROM r GROUP BY 1)
  SELECT aoi_id, n AS pairs, CASE WHEN n >= 3 AND n*saa-sa*sa > 0 AND n*sbb-sb*sb > 0 THEN
  {_rd('(n*sab-sa*sb) / (sqrt(n*saa-sa*sa) * sqrt(n*sbb-sb*sb))')} END AS rho FROM s""")
def _(spark, d):
    return ranking.spearman(fused_scores(spark, d), ["aoi_id"], "score", "confidence")


@register("grounded_weight_share", f"""{_LAST}, w AS (SELECT aoi_id, {_fx(_W)} AS w, agent_id LIKE 'A%' AS g FROM last)
  SELECT aoi_id, CASE WHEN sum(w) > 0 THEN {_rd('CAST(sum(CASE WHEN g THEN w ELSE 0 END) AS DOUBLE) / 1e9 / (CAST(sum(w) AS DOUBLE) / 1e9)')} ELSE 0e0 END
  AS grounded_fraction FROM w GROUP BY 1""")
def _(spark, d):
    weights = F.broadcast(fusion.weights_table(spark, WEIGHTS))
    rows = last_scores(spark, d).join(weights, "agent_id", "left").withColumn("grounded", F.col("agent_id").startswith("A"))
    return fusion.grounded_fraction(rows, ["aoi_id"])


@register("scorer_breakdown", f"""{_LAST}, disp AS (SELECT aoi_id, cell_key, unnest([0, 1]) AS sub FROM
  (SELECT DISTINCT aoi_id, cell_key FROM agent_score))
  SELECT aoi_id || '/' || cell_key || '/' || sub AS cell_id, l.agent_id, l.score, l.confidence
  FROM disp LEFT JOIN last l USING (aoi_id, cell_key)""")
def _(spark, d):
    parent = F.concat_ws("/", "aoi_id", "cell_key")
    display = view(spark, d, "agent_score").select(parent.alias("parent_cell_id")).distinct().select(
        F.explode(F.transform(F.array(F.lit("/0"), F.lit("/1")), lambda t: F.concat("parent_cell_id", t))).alias("cell_id"),
        "parent_cell_id")
    scores = last_scores(spark, d).select(parent.alias("cell_id"), "agent_id", "score", "confidence")
    return fusion.breakdown_by_parent(display, scores).select("cell_id", "agent_id", "score", "confidence")
