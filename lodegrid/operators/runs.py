"""Score cache, model responses, usage telemetry and documents."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegrid import fixed
from lodegrid.functions.scalars import clamp_unit, exact_sum, once, round_dp, to_fixed, token_cost
from lodegrid.operators.ranking import numbered
from lodegrid.operators.records import latest_version


# --- hashing and cache --------------------------------------------------------------------------
def content_hash(**fields: Column) -> Column:
    """sha256 over JSON with sorted keys; maps must be given as sorted entries."""
    ordered = F.struct(*[fields[k].alias(k) for k in sorted(fields)])
    return F.sha2(F.to_json(ordered, {"ignoreNullFields": "false"}), 256)


def sorted_entries(m: Column) -> Column:
    return F.array_sort(F.map_entries(m))


CACHE_INPUTS = ("cell_id", "agent_id", "mineral", "model", "prompt_version", "knowledge_hash", "spatial_context_hash")


def cache_key(columns: tuple[str, ...] = CACHE_INPUTS) -> Column:
    """Hash of every input that could change the score; a separator that no input holds keeps parts apart."""
    return F.sha2(F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0002")) for c in columns]), 256)


def split_cached(cells: DataFrame, cache: DataFrame, key: str = "cache_key") -> tuple[DataFrame, DataFrame]:
    """(hits with cached score, misses). Cells without an id are never looked up and always missed."""
    has_id = F.coalesce(F.col("cell_id"), F.lit("")) != ""
    known = cache.select(key, *[c for c in ("score", "confidence") if c in cache.columns])
    hits = cells.where(has_id).join(known, key)
    misses = cells.where(has_id).join(known.select(key), key, "left_anti").unionByName(cells.where(~has_id))
    return hits, misses


def put_scores(cache: DataFrame, fresh: DataFrame, order: list[str], key: str = "cache_key") -> DataFrame:
    """Cache with fresh scores in place of old ones, whatever their order; of several fresh ones the newest by ``order``.

    Zero-confidence rows were never scored and are not kept.
    """
    newest = latest_version(fresh.where(F.col("confidence") > 0), [key], order)
    return cache.join(newest.select(key), key, "left_anti").unionByName(newest)


def cached_composite(cache: DataFrame, keys: list[str]) -> DataFrame:
    """Confidence-weighted mean per cell without scorer weights, since runs differ in those."""
    out = cache.groupBy(*keys).agg(
        exact_sum(F.col("score") * F.col("confidence")).alias("_sc"), exact_sum(F.col("confidence")).alias("_c"),
        F.count("*").alias("agent_count"), F.sort_array(F.collect_set("agent_id")).alias("agents"), F.max("created_at").alias("scored_at"))
    return out.select(
        *keys, F.when(F.col("_c") > 0, round_dp(F.try_divide("_sc", "_c"), 4)).otherwise(0.0).alias("score"),
        round_dp(F.col("_c") / F.col("agent_count"), 4).alias("confidence"), "agent_count", "agents", "scored_at")


def cache_stats(cache: DataFrame) -> DataFrame:
    return cache.agg(F.count("*").alias("rows"), F.countDistinct("cell_id").alias("cells"), F.countDistinct("agent_id").alias("agents"))


# --- batches ------------------------------------------------------------------------------------
def batches(cells: DataFrame, group: list[str], order: list[str], size: int = fixed.BATCH_SIZE) -> DataFrame:
    """Batch number and label c1..c50 per cell of a group, by its number in the group's order (a prefix scan)."""
    placed = numbered(cells, group, [F.col(c) for c in order], "_i")
    position = F.col("_i") - 1
    return placed.select(*cells.columns, F.floor(position / size).cast("int").alias("batch"), F.concat(F.lit("c"), (position % size + 1).cast("string")).alias("label"))


# --- model responses ----------------------------------------------------------------------------
_ITEM = "struct<cell_id:string,score:string,confidence:string,evidence:string,data_sources_used:string>"


_FENCE = r"(?s)```(?:json)?\s*(.*?)(?:```|\z)"
#: Strings whole, brackets one by one, what stands between them in one piece; a quote that is never closed by itself.
_TOKEN = r'(?s)"(?:[^"\\]++|\\.)*+"|[\[\]{}]|[^"\[\]{}]++|"'
_SCAN = "struct<at:int,square:int,ended:boolean,open:array<int>,found:array<struct<first:int,last:int>>>"


def _objects(tokens: Column) -> Column:
    """Token spans of all complete objects in the first array, nested ones too. Brackets inside strings are no brackets."""
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("square"), F.lit(False).alias("ended"), F.array().cast("array<int>").alias("open"),
                     F.array().cast("array<struct<first:int,last:int>>").alias("found"))

    def step(s: Column, t: Column) -> Column:
        at, within = s["at"] + 1, ~s["ended"] & (s["square"] > 0)
        square = s["square"] + F.when(s["ended"], 0).when(t == "[", 1).when((t == "]") & within, -1).otherwise(0)
        closes = within & (t == "}") & (F.size(s["open"]) > 0)
        opened = F.when(within & (t == "{"), F.concat(s["open"], F.array(at))).when(closes, F.slice(s["open"], F.lit(1), F.size(s["open"]) - 1)).otherwise(s["open"])
        found = F.when(closes, F.concat(s["found"], F.array(F.struct(F.element_at(s["open"], -1).alias("first"), at.alias("last"))))).otherwise(s["found"])
        ended = s["ended"] | (within & (square == 0))
        return F.struct(at.alias("at"), square.cast("int").alias("square"), ended.alias("ended"), opened.alias("open"), found.alias("found")).cast(_SCAN)

    return F.aggregate(tokens, start.cast(_SCAN), step)["found"]


def parse_responses(responses: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """Items of each response, in the order in which they stand.

    What is looked at is the first fenced block, or else the whole text, and of it the first array, whole or cut off:
    drafts before a fence and arrays after the first do not count. Complete objects of any depth are found in one
    scan. An object that names no cell is looked into for objects that do; one that names a cell is one item, whatever it holds.
    """
    fence = F.regexp_extract(F.col(text), _FENCE, 1)
    body = F.when(F.contains(F.col(text), F.lit("```")), fence).otherwise(F.col(text))
    found = responses.select(*keys, once(F.regexp_extract_all(body, F.lit(_TOKEN), 0)).alias("_t"))
    found = found.withColumn("_o", _objects(F.col("_t")))
    named = F.transform("_o", lambda o: F.struct(o["first"].alias("first"), o["last"].alias("last"), F.from_json(
        F.array_join(F.slice("_t", o["first"], o["last"] - o["first"] + 1), ""), _ITEM).alias("item")))
    found = found.withColumn("_n", F.filter(named, lambda o: o["item"]["cell_id"].isNotNull()))
    outer = F.filter("_n", lambda o: ~F.exists("_n", lambda p: (p["first"] < o["first"]) & (p["last"] > o["last"])))
    return found.select(*keys, F.posexplode(F.array_sort(outer)).alias("position", "_i")).select(*keys, "position", "_i.item.*")


def scored_from_items(items: DataFrame, batch_cells: DataFrame, keys: list[str]) -> DataFrame:
    """Items mapped to cells by label or id, first mention kept, values clamped with defaults."""
    names = batch_cells.select(*keys, F.col("cell_id").alias("canonical"), F.explode(
        F.array_distinct(F.array("label", "cell_id"))).alias("cell_id"))
    mapped = items.join(names, [*keys, "cell_id"])
    first = mapped.groupBy(*keys, "canonical").agg(F.min_by(F.struct("score", "confidence", "evidence"), "position").alias("v"))
    text = F.col("v.evidence")
    evidence = F.when(text.startswith("["), F.from_json(text, "array<string>")).when(text.isNotNull(), F.array(text))
    return first.select(
        *keys, F.col("canonical").alias("cell_id"), clamp_unit(F.col("v.score"), 0.0).alias("score"),
        clamp_unit(F.col("v.confidence"), 0.5).alias("confidence"), F.coalesce(evidence, F.array().cast("array<string>")).alias("evidence"))


def parse_health(requested: DataFrame, scored: DataFrame, responses: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """ok, partial or failed per batch, with the length and the head of the response."""
    want = requested.groupBy(*keys).agg(F.count("*").alias("requested"))
    got = scored.groupBy(*keys).agg(F.count("*").alias("scored"))
    out = want.join(got, keys, "left").fillna(0, ["scored"]).join(
        responses.select(*keys, F.length(text).alias("response_chars"), F.substring(text, 1, fixed.RESPONSE_PREVIEW_CHARS).alias("preview")), keys, "left")
    status = F.when(F.col("scored") == 0, "failed").when(F.col("scored") < F.col("requested"), "partial").otherwise("ok")
    return out.withColumn("parse_status", status)


# --- usage --------------------------------------------------------------------------------------
def usage_rollup(calls: DataFrame, keys: list[str]) -> DataFrame:
    """Calls, tokens and cost per group. The same function serves a batch and a stream."""
    return calls.groupBy(*keys).agg(
        F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
        (F.sum(to_fixed(token_cost(F.col("input_tokens"), F.col("output_tokens")), 6)).cast("double") / 1e6).alias("est_cost_usd"))


def usage_with_total(calls: DataFrame, group: str) -> DataFrame:
    """Per group and in total, in one pass."""
    sets = calls.select(group, "input_tokens", "output_tokens").groupingSets([[group], []], group).agg(
        F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
        F.grouping(group).alias("_g"))
    return sets.withColumn(group, F.when(F.col("_g") == 1, "total").otherwise(F.col(group))).drop("_g")


def ungrounded(agents: DataFrame, knowledge: DataFrame, mineral: str) -> DataFrame:
    """Knowledge file each scorer uses: the mineral's, else the default, else none."""
    own = knowledge.where(F.col("name") == mineral.lower().replace(" ", "_")).select("domain", F.col("file").alias("_own"))
    default = knowledge.where(F.col("name") == "default").select("domain", F.col("file").alias("_default"))
    out = agents.join(own, "domain", "left").join(default, "domain", "left")
    return out.withColumn("knowledge_file", F.coalesce("_own", "_default")).withColumn(
        "grounded", F.col("knowledge_file").isNotNull()).drop("_own", "_default")


# --- documents ----------------------------------------------------------------------------------
def triage(pages: DataFrame, sample: int = fixed.SAMPLE_PAGES) -> DataFrame:
    """Pages, characters in the sampled first pages, status and excerpt of each document."""
    early = F.col("page") <= sample
    has = F.length(F.coalesce("text", F.lit(""))) > 0
    # Only the first text page's head travels through the shuffle.
    head = F.when(early & has, F.struct("page", F.substring("text", 1, fixed.EXCERPT_CHARS).alias("head")))
    out = pages.groupBy("doc").agg(
        F.count("*").alias("pages"), F.coalesce(F.sum(F.when(early, F.length("text"))), F.lit(0)).alias("sample_chars"), F.min(head).alias("_h"))
    status = F.when(F.col("sample_chars") >= fixed.TEXT_LAYER_CHARS, "text-extractable").otherwise("scanned-needs-ocr")
    return out.select("doc", "pages", "sample_chars", status.alias("status"),
                      F.coalesce(F.trim(F.regexp_replace("_h.head", r"\s+", " ")), F.lit("")).alias("excerpt"))


def full_text(pages: DataFrame, max_pages: int | None = None) -> DataFrame:
    """Text of each document in page order with page markers. A document is one row by definition."""
    rows = pages if max_pages is None else pages.where(F.col("page") <= max_pages)
    chunk = F.concat(F.lit("\n[PAGE "), F.col("page").cast("string"), F.lit("]\n"), F.col("text"), F.lit("\n"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", chunk.alias("chunk")))), lambda s: s["chunk"]), "")
    out = rows.where(F.length("text") > 0).groupBy("doc").agg(text.alias("text"))
    if max_pages is None:
        return out
    cut = pages.groupBy("doc").agg((F.max("page") > max_pages).alias("_cut"))
    return out.join(cut, "doc").withColumn("text", F.concat("text", F.when(
        F.col("_cut"), f"\n[TRUNCATED after {max_pages} pages]\n").otherwise(""))).drop("_cut")


def status_counts(triaged: DataFrame) -> DataFrame:
    return triaged.groupBy("status").agg(F.count("*").alias("documents"))
