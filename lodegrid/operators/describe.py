"""Evidence per cell: nine fact tables put together, and one line of text per domain made from them.

A line is a list of slots, a slot a list of alternatives, an alternative a text with named facts in it. Of a slot the
first alternative whose facts are all known is taken, and a slot without any is left out. ``{name:if}`` asks for a fact
without printing it. What the lines say is in ``LINES``; what a fact looks like as text is in the functions below it.
"""
from __future__ import annotations

from string import Formatter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegrid import fixed
from lodegrid.functions.scalars import lookup, round_dp
from lodegrid.session import scratch_path, shuffled

LINES: dict[str, tuple[tuple[str, ...], ...]] = {
    "lithology": (
        ("mapped rock: {units}",),
        ("ranked unit {ranked}: contrast {contrast}, {formation}, over {share}% of the cell", "ranked unit {ranked}: contrast {contrast}, {formation}",
         "raster unit {raster_unit} holds no training site"),
    ),
    "structure": (
        ("{count} mapped lines within {reach} km: {kinds}", "no mapped line within {reach} km, a {nearest_kind} is nearest at {nearest_km} km",
         "no mapped line within {reach} km, the nearest is {nearest_km} km away"),
        ("trends {trends}, favourable among them {favourable}", "trends {trends}, none of them favourable"),
        ("{crossings} pairs of faults meet in the cell",),
        ("names: {names}",),
        ("raster faults: {raster_faults}, a predicting kind among them{predicting:if}", "raster faults: {raster_faults}"),
        ("raster folds: {raster_folds}",),
        ("raster dikes: {raster_dikes}",),
        ("the raster tells presence only and no trend{raster_faults:if}",),
    ),
    "proximity": (
        ("nearest record {nearest_name}, {nearest_km} km, its position too rough to argue from{rough:if}", "nearest record {nearest_name}, {nearest_km} km",
         "no record within 5 km{empty:if}"),
        ("records: {in_cell} in the cell, {within_1} to 1 km, {within_2} to 2 km, {within_5} to 5 km",),
        ("{producers} of them produced, {assayed} were assayed",),
        ("in district {district}{in_district:if}", "district {district} at {district_km} km"),
        ("{workings} surveyed workings to 5 km",),
    ),
    "geochemistry": (
        ("ore minerals on record: {ores}",),
        ("gangue on record: {gangue}",),
        ("{assayed} sites to 5 km were assayed, the values are in their documents",),
        ("host rock: {host}",),
    ),
    "historical": (
        ("{within_5} recorded sites to 5 km, {in_cell} of them in the cell, {assayed} assayed, {producers} with production", "no recorded site within 5 km{empty:if}"),
        ("best documented: {best}",),
        ("in district {district}{in_district:if}", "district {district} at {district_km} km"),
        ("the district yielded {district_output} in {district_years}", "the district was worked in {district_years}"),
        ("surveyed workings: {working_list}",),
        ("seen in the field: {pins}",),
        ("place names: {names}",),
    ),
    "remote_sensing": (
        ("host rock: {hosts}",),
        ("volcanic host {ranked}, where alteration can be expected",),
        ("gangue on record: {gangue}",),
    ),
}


def render(domain: str, facts: dict[str, Column]) -> Column:
    """The line of a domain from facts as text; null where no slot has anything to say."""
    def filled(template: str) -> Column:
        parts = []
        for text, name, spec, _ in Formatter().parse(template):
            if text:
                parts.append(F.lit(text))
            if name:
                fact = facts.get(name, F.lit(None)).cast("string")
                parts.append(F.when(fact.isNotNull(), "") if spec == "if" else fact)
        return F.concat(*parts)

    slots = F.array_compact(F.array(*[F.coalesce(*[filled(t) for t in slot]) for slot in LINES[domain]]))
    return F.when(F.size(slots) > 0, F.array_join(slots, "; "))


def or_no_data(x: Column) -> Column:
    return F.coalesce(x, F.lit("no data"))


# --- facts as text ------------------------------------------------------------------------------
def some(x: Column) -> Column:
    """The text, if there is any."""
    return F.nullif(x.cast("string"), F.lit(""))


def listing(items: Column, text, most: int | None = None, between: str = ", ") -> Column:
    """Texts of the first ``most`` items (all by default), null where there are none."""
    chosen = items if most is None else F.slice(items, 1, most)
    return F.when(F.size(chosen) > 0, F.array_join(F.transform(chosen, text), between))


def spaced(*parts: Column) -> Column:
    return F.concat_ws(" ", *[some(p) for p in parts])


def percent(x: Column) -> Column:
    return F.floor(x * 100 + 0.5).cast("int")


def flag(condition: Column) -> Column:
    return F.when(condition, "yes")


def rock_facts(units: Column, wofe: Column) -> dict[str, Column]:
    """``units``: array of (unit, name, lithology, frac); ``wofe``: unit facts of the cell."""
    ranked = wofe["favourable_unit"]
    share = F.when(wofe["favourable_frac"] > 0, percent(wofe["favourable_frac"]))
    shown = lambda u: F.concat(spaced(u["unit"], u["name"], u["lithology"]), F.lit(" "), percent(u["frac"]).cast("string"), F.lit("%"))
    top = F.try_element_at(units, F.lit(1))
    return {
        "units": listing(units, shown), "hosts": listing(units, shown, 2), "host": some(spaced(top["unit"], top["lithology"])), "ranked": ranked,
        "contrast": wofe["favourable_contrast"], "formation": wofe["formation"], "share": share, "raster_unit": wofe["unit"],
    }


def line_facts(s: Column, wofe: Column) -> dict[str, Column]:
    """``s``: structure facts of the cell, null where nothing is mapped; ``wofe``: what the rasters hold."""
    kind = lambda k: F.concat(k["n"].cast("string"), F.lit(" "), k["kind"], F.lit(" from "), k["km"].cast("string"), F.lit(" km"))
    named = lambda table: lambda c: F.coalesce(lookup(table, c), F.concat(F.lit("code "), c.cast("string")))
    plain = lambda v: v.cast("string")
    near = s["count"] > 0
    return {
        "reach": F.when(s.isNotNull(), str(fixed.STRUCTURE_BUFFER_M / 1000)), "count": F.when(near, s["count"]), "kinds": listing(s["kinds"], kind),
        "nearest_kind": F.when(~near, s["nearest_kind"]), "nearest_km": F.when(~near, s["nearest_km"]),
        "trends": listing(s["azimuths"], plain), "favourable": listing(s["favourable_azimuths"], plain),
        "crossings": F.when(s["fault_intersections_in_cell"] > 0, s["fault_intersections_in_cell"]), "names": listing(s["named"], plain),
        "raster_faults": listing(wofe["fault_codes"], named(fixed.FAULT_TYPES)), "predicting": flag(wofe["has_predictor_fault"]),
        "raster_folds": listing(wofe["fold_codes"], named(fixed.FOLD_TYPES)), "raster_dikes": listing(wofe["dike_units"], plain),
    }


def site_facts(occ: Column) -> dict[str, Column]:
    """``occ``: occurrence facts; counts are zero and nearest null where nothing is in reach."""
    near = occ["nearest_km"].isNotNull()
    when = lambda name: F.when(near, occ[name])
    return {
        "nearest_name": F.when(near, F.coalesce(some(occ["nearest_name"]), F.lit("without a name"))), "nearest_km": occ["nearest_km"],
        "rough": flag(occ["nearest_accuracy"].isin(*fixed.ROUGH_POSITIONS)), "empty": flag(occ["n_near"].isNotNull() & ~near),
        "in_cell": when("n_in_cell"), "within_1": when("n_1km"), "within_2": when("n_2km"), "within_5": when("n_near"),
        "producers": when("with_production"), "assayed": when("with_assays"),
    }


def district_facts(d: Column) -> dict[str, Column]:
    """``d``: (name, inside, km) and, where known, production and years."""
    return {"district": d["name"].cast("string"), "in_district": flag(d["inside"]), "district_km": d["km"]}


def district_history(production: Column, first_year: Column, last_year: Column) -> dict[str, Column]:
    years = F.when(first_year.isNotNull(), F.concat_ws(" to ", first_year.cast("string"), F.when(last_year > first_year, last_year.cast("string"))))
    return {"district_output": some(production), "district_years": years}


def record_facts(records: Column, assayed: Column) -> dict[str, Column]:
    """Minerals of nearby records stand in for assays, whose values are in documents."""
    seen = lambda f, n: listing(F.array_distinct(F.filter(F.transform(records, lambda r: some(r[f])), lambda v: v.isNotNull())), lambda v: v, n)
    return {"ores": seen("ore_minerals", 3), "gangue": seen("gangue", 2), "assayed": F.when(assayed > 0, assayed)}


def record_text(name: Column, km: Column, production: Column, assays: Column, accuracy: Column, docs: Column) -> Column:
    known = F.concat_ws(", ", F.when(production, "produced"), F.when(assays, "assayed"),
                        lookup(fixed.POSITION_LABELS, F.coalesce(accuracy, F.lit("unknown")), "accuracy unknown"),
                        F.when(docs > 0, F.concat(docs.cast("string"), F.lit(" documents"))))
    return F.concat(F.coalesce(some(name), F.lit("without a name")), F.lit(" "), km.cast("string"), F.lit(" km ("), known, F.lit(")"))


def nearby_facts(workings: Column, pins: Column, toponyms: Column) -> dict[str, Column]:
    """Arrays of (name, km) and of (name, tier, corroboration)."""
    placed = lambda w: F.concat(F.coalesce(some(w["name"]), F.lit("without a name")), F.lit(" "), w["km"].cast("string"), F.lit(" km"))
    named = lambda t: F.concat(t["name"], F.lit(" (tier "), t["tier"].cast("string"), F.lit(", "), t["corroboration"], F.lit(")"))
    return {"workings": F.when(F.size(workings) > 0, F.size(workings)), "working_list": listing(workings, placed), "pins": listing(pins, placed),
            "names": listing(toponyms, named)}


# --- coordinates --------------------------------------------------------------------------------
def cell_line(label: Column, min_lon: Column, min_lat: Column, max_lon: Column, max_lat: Column) -> Column:
    four = lambda a, b: F.format_string("%.4f", round_dp((a + b) / 2.0, 4))
    return F.concat(F.lit("  - "), label, F.lit(": center ("), four(min_lat, max_lat), F.lit(", "), four(min_lon, max_lon), F.lit(")"))


def bbox_text(min_lon: Column, min_lat: Column, max_lon: Column, max_lat: Column) -> Column:
    four = lambda x: F.format_string("%.4f", round_dp(x, 4))
    return F.concat(F.lit("Bounding box: "), four(min_lat), F.lit("°N to "), four(max_lat), F.lit("°N, "), four(F.abs(min_lon)), F.lit("°W to "), four(F.abs(max_lon)), F.lit("°W"))


# --- assembly -----------------------------------------------------------------------------------
#: Buckets of stored fact tables; one number for all, so that they join without a shuffle.
BUCKETS = 16


def stored(facts: DataFrame, keys: list[str], name: str, buckets: int = BUCKETS) -> DataFrame:
    """A fact table (one row per cell) written in buckets of its cells, below the shared folder."""
    spark = facts.sparkSession
    path = scratch_path(spark, name)
    table = "facts_" + path.rsplit("-", 1)[-1]
    facts.write.bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(table)
    return spark.table(table)


def assemble(cells: DataFrame, keys: list[str], tables: dict[str, DataFrame]) -> DataFrame:
    """Fact tables as struct columns on the cells; absent facts are null and every cell is kept."""
    out = cells.select(*keys)
    for name, facts in tables.items():
        values = [c for c in facts.columns if c not in keys]
        out = out.join(shuffled(facts.select(*keys, F.struct(*values).alias(name))), keys, "left")
    return out


def census(assembled: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Cells in total and cells with each kind of fact."""
    return assembled.groupBy(*keys).agg(
        F.count("*").alias("cells_total"), *[F.count_if(F.col(n).isNotNull()).alias(f"cells_with_{n}") for n in names])
