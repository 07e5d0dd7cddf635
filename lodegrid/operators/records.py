"""Curating source records: positions, documents, deduplication, filters, counters and upserts."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegrid import fixed
from lodegrid.functions import geo
from lodegrid.functions.scalars import accuracy_class, clean_number, odd_flag, round_dp, text_or_blank, yes_flag
from lodegrid.operators.ranking import best_per_key, first_per_key


# --- positions ----------------------------------------------------------------------------------
def resolve_position(rows: DataFrame, geom_lon: Column, geom_lat: Column, attr_lon: Column, attr_lat: Column) -> DataFrame:
    """Geometry first, attributes second, 0/0 unknown; the first candidate inside the envelope wins.

    Adds lon, lat, position_source and ``rejected`` (candidates tried before it that lie outside).
    """
    def candidate(source: str, lon: Column, lat: Column, usable: Column) -> Column:
        lon, lat = round_dp(clean_number(lon), 6), round_dp(clean_number(lat), 6)
        there = F.coalesce(usable & lon.isNotNull() & lat.isNotNull(), F.lit(False))
        return F.when(there, F.struct(F.lit(source).alias("source"), lon.alias("lon"), lat.alias("lat"),
                                      geo.in_envelope(lon, lat).alias("ok")))

    zero = (clean_number(attr_lon) == 0) & (clean_number(attr_lat) == 0)
    found = F.array_compact(F.array(
        candidate("geometry", geom_lon, geom_lat, F.lit(True)), candidate("attributes", attr_lon, attr_lat, ~zero)))
    out = rows.withColumn("_c", found).withColumn("_ok", F.filter("_c", lambda c: c["ok"]))
    best = F.try_element_at("_ok", F.lit(1))
    # Attributes are only tried, and so only rejected, when the geometry failed.
    tried = F.when(best["source"] == "geometry", F.slice("_c", 1, 1)).otherwise(F.col("_c"))
    return out.withColumns({
        "lon": best["lon"], "lat": best["lat"], "position_source": best["source"],
        "rejected": F.transform(F.filter(tried, lambda c: ~c["ok"]), lambda c: c.dropFields("ok")),
    }).drop("_c", "_ok")


def rejected_positions(resolved: DataFrame, key: str) -> DataFrame:
    return resolved.select(key, F.explode("rejected").alias("r")).select(key, "r.*")


# --- occurrences --------------------------------------------------------------------------------
def document_index(docs: DataFrame, per_site: int = fixed.DOCS_PER_SITE) -> DataFrame:
    """Full count and the newest documents of each site; undated last, the id settles ties."""
    rows = docs.where("site_id is not null")
    counts = rows.groupBy("site_id").agg(F.count("*").alias("doc_count"))
    newest = best_per_key(rows, ["site_id"], [F.desc_nulls_last("year"), F.asc("doc_id")], per_site)
    lists = newest.groupBy("site_id").agg(F.array_sort(F.collect_list(F.struct(
        "place", "doc_id", "title", "year"))).alias("docs"))
    return counts.join(lists, "site_id")


def attach_documents(sites: DataFrame, index: DataFrame) -> DataFrame:
    out = sites.join(index, "site_id", "left")
    empty = F.array().cast(index.schema["docs"].dataType)
    return out.withColumns({"doc_count": F.coalesce("doc_count", F.lit(0)), "docs": F.coalesce("docs", empty)})


def curate_occurrences(raw: DataFrame, order: str) -> DataFrame:
    """Raw layer rows (layer, site_id, text columns) to typed occurrences; the first row per site is kept."""
    kept = first_per_key(raw.where("site_id is not null"), ["layer", "site_id"], [order])
    return kept.withColumns({
        "uid": F.concat_ws("-", "prefix", F.col("site_id").cast("string")),
        "assays": yes_flag(F.col("assays")), "production": yes_flag(F.col("production")),
        "accuracy_class": accuracy_class(F.col("location_accuracy")), "name": text_or_blank(F.col("name")),
    })


def odd_values(raw: DataFrame, columns: list[str]) -> DataFrame:
    """Flag values that are neither 'yes' nor blank, with their counts."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.lower(text_or_blank(F.col(c))).alias("value"),
                                         odd_flag(F.col(c)).alias("odd")) for c in columns]))
    return raw.select(pairs.alias("p")).where("p.odd").groupBy("p.field", "p.value").agg(F.count("*").alias("n"))


def layer_counters(occ: DataFrame, keys: list[str]) -> DataFrame:
    return occ.groupBy(*keys).agg(
        F.count("*").alias("features"), F.count_if("assays").alias("assays"), F.count_if("production").alias("production"),
        F.count_if(F.col("doc_count") > 0).alias("with_docs"))


def class_counters(occ: DataFrame, layer: str, column: str) -> DataFrame:
    return occ.groupBy(layer, column).agg(F.count("*").alias("n"))


def artifact_checks(occ: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Positions inside the envelope, unique ids, all-null columns."""
    blank = lambda c: F.count_if(F.nullif(F.trim(F.col(c).cast("string")), F.lit("")).isNotNull()) == 0
    dup = occ.groupBy(key).agg(F.count("*").alias("_n")).agg(
        F.sum(F.when(F.col("_n") > 1, 1).otherwise(0)).alias("duplicate_ids"))
    main = occ.agg(
        F.count("*").alias("rows"), F.count_if(~F.coalesce(geo.in_envelope(F.col("lon"), F.col("lat")), F.lit(False))).alias("outside"),
        F.min("lon").alias("min_lon"), F.max("lat").alias("max_lat"), *[blank(c).alias(f"{c}_empty") for c in columns])
    return main.withColumn("duplicate_ids", dup.scalar())


def inherit(features: DataFrame, parents: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Parent fields on every feature; a missing parent gives blanks."""
    out = features.join(parents.select(key, *fields), key, "left")
    return out.withColumns({f: F.coalesce(f, F.lit("")) for f in fields})


def union_layers(layers: dict[str, DataFrame]) -> DataFrame:
    out = None
    for kind, df in layers.items():
        tagged = df.withColumn("kind", F.lit(kind))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def slim(occ: DataFrame, fields: tuple[str, ...] = fixed.PROMPT_FIELDS) -> Column:
    """JSON of the fields a description may carry; null and blank values are left out."""
    cols = []
    for f in fields:
        if f in occ.columns:
            is_text = dict(occ.dtypes)[f] == "string"
            cols.append((F.nullif(F.col(f), F.lit("")) if is_text else F.col(f)).alias(f))
    return F.to_json(F.struct(*cols, round_dp(F.col("km"), 2).alias("km")))


# --- queries over features ----------------------------------------------------------------------
def query_features(features: DataFrame, bbox: str | None = None, commodity: str | None = None, feature_type: str | None = None,
                   limit: int = 500, offset: int = 0, key: str = "site_id", most: int = 5000) -> DataFrame:
    """Box, commodity and type filters with paging; a malformed box is ignored. Ordered so pages are stable.

    A page holds ``most`` rows at most, whatever is asked for; the next page goes on where it ends.
    """
    out = features
    try:
        w, s, e, n = (float(v) for v in bbox.split(",")) if bbox else (None,) * 4
    except ValueError:
        w = None
    if w is not None:
        out = out.where(geo.in_bbox(F.col("lon"), F.col("lat"), w, s, e, n))
    if commodity:
        out = out.where(F.col("commodity_primary").ilike(f"%{commodity}%"))
    if feature_type:
        out = out.where(F.col("feature_type") == feature_type)
    return out.orderBy(key).offset(max(0, offset)).limit(min(most, max(1, limit)))


def capped(rows: DataFrame, order: list, cap: int) -> DataFrame:
    """At most ``cap`` rows, each flagged whether the cap cut anything."""
    total = rows.agg(F.count("*")).scalar()
    return rows.orderBy(*order).limit(cap).withColumn("truncated", total > cap)


def truncation_order() -> list[Column]:
    from lodegrid.operators.spatial import accuracy_rank

    return [F.when(F.col("production"), 0).otherwise(1), F.when(F.col("assays"), 0).otherwise(1),
            accuracy_rank(F.col("accuracy_class")), F.coalesce("name", F.lit("")), F.col("site_id")]


def best_occurrences(occ: DataFrame, keys: list[str], limit: int = 40) -> DataFrame:
    """Records that survive truncation: production, assays, trust in position, name."""
    order = truncation_order()
    if keys:
        return best_per_key(occ, keys, order, limit)
    return occ.orderBy(*order).limit(limit)


def visible_pins(pins: DataFrame, roles: tuple[str, ...] | None = None) -> DataFrame:
    """Evidence pins unless roles are named; unknown names ask for nothing, unknown roles count as display."""
    wanted = ("evidence",) if roles is None else tuple(r.strip().lower() for r in roles if r.strip().lower() in fixed.ROLES)
    role = F.lower(F.trim(F.col("role")))
    out = pins.withColumn("role", F.when(role.isin(*fixed.ROLES), role).otherwise("display"))
    return out.where(F.col("role").isin(*wanted)) if wanted else out.where(F.lit(False))


# --- upsert -------------------------------------------------------------------------------------
def latest_version(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    values = [c for c in rows.columns if c not in keys]
    last = F.max_by(F.struct(*values), F.struct(*order)).alias("v")
    return rows.groupBy(*keys).agg(last).select(*keys, "v.*")


def upsert(current: DataFrame, incoming: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The newest row of each key among current and incoming ones; of equally new rows the incoming one."""
    both = current.withColumn("_in", F.lit(0)).unionByName(incoming.withColumn("_in", F.lit(1)))
    return latest_version(both, keys, [*order, "_in"]).drop("_in")


# --- geology tables -----------------------------------------------------------------------------
def longest_description(units: DataFrame, key: str, text: str, order: str) -> DataFrame:
    """One row per label: the longest description, the first of equal length."""
    values = [c for c in units.columns if c != key]
    best = F.max_by(F.struct(*values), F.struct(F.length(F.coalesce(text, F.lit(""))), -F.col(order))).alias("v")
    return units.where(F.col(key).isNotNull()).groupBy(key).agg(best).select(key, "v.*")


def describe_units(polygons: DataFrame, units: DataFrame, key: str) -> DataFrame:
    """Unit name and lithology on polygons; the polygon's own lithology where the unit has none."""
    out = polygons.join(units.select(key, F.col("name").alias("unit_name"), F.col("lithology").alias("_l")), key, "left")
    return out.withColumn("lithology", F.coalesce(F.nullif("_l", F.lit("")), F.col("age_lithology"))).drop("_l")


def unit_summary(polygons: DataFrame, unit: str, limit: int = 40) -> DataFrame:
    return polygons.groupBy(unit).agg(F.count("*").alias("polygons")).orderBy(F.desc("polygons"), unit).limit(limit)


def unmatched_labels(rows: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """Labels without a dimension row, null labels included."""
    return rows.join(dimension.select(key).distinct(), key, "left_anti").groupBy(key).agg(F.count("*").alias("n"))


def coverage_tiles(boxes: DataFrame, quad: str, size: float = 0.125) -> DataFrame:
    """Occupied tiles, extent and distinct quads; distinct keys are reduced before they are counted."""
    tile = F.struct(F.floor(F.col("min_lon") / size), F.floor(F.col("min_lat") / size))
    return boxes.agg(
        F.countDistinct(tile).alias("tiles"), F.countDistinct(quad).alias("quads"), F.min("min_lon").alias("min_lon"),
        F.min("min_lat").alias("min_lat"), F.max("max_lon").alias("max_lon"), F.max("max_lat").alias("max_lat"))


def window_report(boxes: DataFrame, window: tuple[float, float, float, float], label: str) -> DataFrame:
    own = tuple(F.col(c) for c in ("min_lon", "min_lat", "max_lon", "max_lat"))
    return boxes.where(geo.boxes_overlap(own, window)).groupBy(label).agg(F.count("*").alias("n"))


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: do two queries give the same rows, counted both ways?"""
    extra = a.exceptAll(b).agg(F.count("*").alias("only_first"))
    return extra.withColumn("only_second", b.exceptAll(a).agg(F.count("*")).scalar()).withColumn(
        "equal", (F.col("only_first") == 0) & (F.col("only_second") == 0))
