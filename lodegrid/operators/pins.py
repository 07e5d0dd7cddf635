"""Field pins: stable ids, annotation overrides, counts and the blank template."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegrid import fixed
from lodegrid.functions.scalars import coerce_enum, iso_date, name_key, parse_flag, round_dp, slug, strict_enum
from lodegrid.operators.ranking import numbered
from lodegrid.session import materialise

#: An id that another name could reach by numbering: the name and the number.
_NUMBERED = r"^(.+)-([2-9]|[1-9][0-9]{1,8})$"


def assign_ids(pins: DataFrame, order: str, file: str = "source_file") -> DataFrame:
    """Slug of the name, numbered where an earlier pin of the file has it already: the first free of a, a-2, a-3 and so on.

    The k-th pin of a name takes the k-th number that no earlier pin of another name holds. Which numbers those are
    follows from the ids of the others, so ids are worked out for all pins at once and again until they stand; names that
    nothing else can reach, nearly all, stand at once. Pins are numbered by a prefix scan, so a file of equal names is
    spread over tasks; what is listed per name is the ids of other names that look like a number of it.
    """
    of = ["_file", "_base"]
    carried = F.nullif(F.trim("pin_id"), F.lit("")) if "pin_id" in pins.columns else F.lit(None).cast("string")
    placed = numbered(pins.withColumn("_file", F.coalesce(F.col(file), F.lit(""))), ["_file"], [F.col(order)], "_i").drop("n")
    base = F.coalesce(carried, F.nullif(slug(F.col("name")), F.lit("")), F.concat(F.lit("pin-"), F.col("_i").cast("string")))
    counted = materialise(numbered(placed.withColumn("_base", base), of, [F.col(order)], "_k").drop("n", "_i"), "pins")
    state = counted.select(*of, F.col(order).alias("_o"), F.col("_k").cast("int").alias("_k"))
    names, now = state.select(*of).distinct(), state.withColumn("_num", F.col("_k"))
    pin_id = F.when(F.col("_num") == 1, F.col("_base")).otherwise(F.concat_ws("-", "_base", F.col("_num").cast("string")))
    while True:
        held = now.select("_file", "_o", F.col("_base").alias("_owner"), pin_id.alias("_id"))
        plain = held.select("_file", "_o", "_owner", F.col("_id").alias("_base"), F.lit(1).alias("_n"))
        number = held.select("_file", "_o", "_owner", F.regexp_extract("_id", _NUMBERED, 1).alias("_base"), F.regexp_extract("_id", _NUMBERED, 2).try_cast("int").alias("_n"))
        others = plain.union(number.where("_base <> ''")).where("_owner <> _base").join(names, of, "left_semi")
        lists = others.groupBy(*of).agg(F.array_sort(F.collect_list(F.struct("_n", "_o"))).alias("_taken"))
        earlier = F.filter("_taken", lambda t: t["_o"] < F.col("_o"))
        free = F.aggregate(earlier, F.col("_k"), lambda m, t: F.when(t["_n"] <= m, m + 1).otherwise(m))
        again = state.join(lists, of, "left").withColumn("_num", F.coalesce(free, F.col("_k"))).drop("_taken")
        again = materialise(again, "pin-numbers")
        moved = again.join(now.select(*of, "_k", F.col("_num").alias("_was")), [*of, "_k"]).where("_num <> _was")
        now = again
        if moved.isEmpty():
            break
    ids = now.select(*of, F.col("_k").cast("bigint").alias("_k"), pin_id.alias("_pin"))
    out = counted.withColumn("_k", F.col("_k").cast("bigint")).join(ids, [*of, "_k"])
    return out.select(*[c for c in pins.columns if c != "pin_id"], F.col("_pin").alias("pin_id"))


def annotate(pins: DataFrame, annotations: DataFrame, defaults: dict[str, str], strict: bool = True,
             order: str | None = None) -> DataFrame:
    """Annotation over carried value over default; a blank cell keeps what is there.

    Rows match by id, else by normalised name; of several rows for one pin the last holds, by ``order`` (the order of
    the rows as read where none is given). With ``strict`` an unknown role, provenance or confidence
    stops the job.
    """
    fields = list(fixed.ANNOTATION_FIELDS)
    place = F.col(order) if order else F.monotonically_increasing_id()
    clean = annotations.select("pin_id", "name", place.alias("_at"), *[F.nullif(F.trim(f), F.lit("")).alias(f"_a_{f}") for f in fields])
    clean = clean.withColumn("_has", F.lit(True))
    cols = [f"_a_{f}" for f in fields] + ["_has"]
    by_id = clean.where(F.coalesce(F.trim("pin_id"), F.lit("")) != "").groupBy(F.trim("pin_id").alias("pin_id")).agg(
        F.max_by(F.struct(*cols), F.struct("_at", *cols)).alias("_id_row"))
    by_name = clean.withColumn("_key", name_key(F.col("name"))).where("_key <> ''").groupBy("_key").agg(
        F.max_by(F.struct(*cols), F.struct("_at", *cols)).alias("_name_row"))
    out = pins.withColumn("_key", name_key(F.col("name"))).join(by_id, "pin_id", "left").join(by_name, "_key", "left")
    out = out.withColumn("_row", F.coalesce("_id_row", "_name_row"))

    def pick(field: str) -> Column:
        own = F.nullif(F.col(field).cast("string"), F.lit("")) if field in pins.columns else F.lit(None).cast("string")
        return F.coalesce(F.col(f"_row._a_{field}"), own, F.lit(defaults.get(field)))

    enums = {"role": fixed.ROLES, "provenance": fixed.PROVENANCES, "position_confidence": fixed.POSITION_CONFIDENCES}
    weakest = {"role": "display", "provenance": "unknown", "position_confidence": "rough"}
    new = {}
    for f in fields:
        value = pick(f)
        if f in enums:
            new[f] = strict_enum(value, enums[f], f) if strict else coerce_enum(value, enums[f], weakest[f])
        elif f == "visited":
            visit = F.lower(F.trim(pick("provenance"))) == "field_visit"
            new[f] = F.when(value.isNull(), visit).otherwise(F.coalesce(parse_flag(value), visit))
        elif f == "date":
            new[f] = iso_date(value)
        else:
            new[f] = F.coalesce(value, F.lit(""))
    return out.withColumns(new).drop("_key", "_id_row", "_name_row", "_row")


def flag_new_sites(pins: DataFrame, nearest: DataFrame, key: str = "pin_id") -> DataFrame:
    """nearest_db_km, nearest_db_name and potentially_new of every pin.

    ``nearest`` has (key, nearest_km unrounded, nearest_name), as ``spatial.nearest_point`` gives it. Only a site that was
    visited in the field can be new. Without reference records distance and name stay null and nothing is claimed.
    """
    found = nearest.select(key, F.col("nearest_km").alias("_km"), F.col("nearest_name").alias("_name"))
    new = (F.col("_km") > fixed.NEW_SITE_KM) & (F.col("provenance") == "field_visit")
    return pins.join(found, key, "left").withColumns({
        "nearest_db_km": round_dp(F.col("_km"), 3), "nearest_db_name": F.col("_name"),
        "potentially_new": F.coalesce(new, F.lit(False))}).drop("_km", "_name")


def unused_annotations(pins: DataFrame, annotations: DataFrame) -> DataFrame:
    """Annotation rows that match no pin by id or by name."""
    keyed = annotations.withColumns({"_id": F.trim("pin_id"), "_key": name_key(F.col("name"))})
    ids = pins.select(F.col("pin_id").alias("_id")).distinct()
    names = pins.select(name_key(F.col("name")).alias("_key")).distinct()
    return keyed.join(ids, "_id", "left_anti").join(names, "_key", "left_anti").select(
        F.coalesce(F.nullif("name", F.lit("")), F.col("pin_id"), F.lit("?")).alias("row"))


def domain_counts(pins: DataFrame, column: str, domain: tuple[str, ...], weakest: str) -> DataFrame:
    """Count per value of a closed domain, zeros included."""
    values = pins.sparkSession.createDataFrame([(v,) for v in domain], f"{column} string")
    counts = pins.groupBy(coerce_enum(F.col(column), domain, weakest).alias(column)).agg(F.count("*").alias("n"))
    return F.broadcast(values).join(counts, column, "left").fillna(0, ["n"])


def template(pins: DataFrame) -> DataFrame:
    """Blank annotation sheet: handing it back unedited changes nothing."""
    filled = {"pin_id": "pin_id", "name": "name", "folder": "folder", "source_description": "description"}
    return pins.select(*[F.coalesce(F.col(filled[c]), F.lit("")).alias(c) if c in filled else F.lit("").alias(c)
                         for c in fixed.TEMPLATE_COLUMNS])
