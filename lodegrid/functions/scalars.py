"""Number, text, date and coordinate helpers as native Column expressions."""
from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodegrid import fixed


# --- numbers ------------------------------------------------------------------------------------
def round_dp(x: Column, places: int) -> Column:
    """Half-up rounding on the binary value; the same in every engine and partitioning."""
    scale = float(10**places)
    return F.floor(x.cast("double") * scale + 0.5) / scale


def to_fixed(x: Column, places: int = 9) -> Column:
    """Integer number of 10^-places, so sums do not depend on row order."""
    return F.floor(x.cast("double") * float(10**places) + 0.5).cast("bigint")


def exact_sum(x: Column, places: int = 9) -> Column:
    return F.sum(to_fixed(x, places)).cast("double") / float(10**places)


def exact_avg(x: Column, places: int = 9) -> Column:
    return F.try_divide(F.sum(to_fixed(x, places)).cast("double"), F.count(x).cast("double")) / float(10**places)


def clean_number(x: Column) -> Column:
    """Number or null: blanks, junk and NaN are null."""
    number = x.try_cast("double")
    return F.when(~F.isnan(number), number)


def clean_int(x: Column) -> Column:
    number = clean_number(x)
    return F.when(number >= 0, F.floor(number)).otherwise(F.ceil(number)).cast("bigint")


def nonzero_number(x: Column) -> Column:
    """Source coordinates use 0.0 for 'unknown'."""
    return F.nullif(clean_number(x), F.lit(0.0))


def clamp_unit(x: Column, default: float) -> Column:
    value = F.coalesce(x.try_cast("double"), F.lit(default))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def never_null(x: Column) -> Column:
    """NaN for null, so that geometry expressions carry no null checks in generated code."""
    return F.coalesce(x, F.lit(float("nan")))


def once(x: Column) -> Column:
    """Generator of the one value ``x``: it is computed once and not copied into later filters."""
    return F.explode(F.array(x))


def holds(condition: Column) -> Column:
    """The condition with null read as false.

    For join-side comparisons: the optimizer then infers no null checks on the compared columns, which it
    would otherwise write out in full below the join.
    """
    return F.coalesce(condition, F.lit(False))


# --- text ---------------------------------------------------------------------------------------
def clean_text(x: Column) -> Column:
    """Trimmed text, null when blank."""
    return F.nullif(F.trim(x.cast("string")), F.lit(""))


def text_or_blank(x: Column) -> Column:
    return F.coalesce(F.trim(x.cast("string")), F.lit(""))


def yes_flag(x: Column, words: tuple[str, ...] = ("yes",)) -> Column:
    return F.lower(text_or_blank(x)).isin(*words)


def odd_flag(x: Column) -> Column:
    return ~F.lower(text_or_blank(x)).isin("", "yes")


def comma_list(x: Column) -> Column:
    """Trimmed non-blank parts; null when nothing is left."""
    parts = F.filter(F.transform(F.split(x, ","), lambda p: F.trim(p)), lambda p: p != "")
    return F.when(F.size(parts) > 0, parts)


def sentence(name: str, *values: Column | str) -> Column:
    """A fixed sentence with its gaps filled; null where a value is null."""
    texts = fixed.SENTENCES[name].split("{}")
    if len(texts) != len(values) + 1:
        raise ValueError(f"{name} has {len(texts) - 1} gaps")
    parts = [F.lit(texts[0])]
    for value, text in zip(values, texts[1:], strict=True):
        parts += [F.lit(value) if isinstance(value, str) else value.cast("string"), F.lit(text)]
    return F.concat(*parts)


def collapse_space(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def name_key(x: Column) -> Column:
    return F.lower(collapse_space(F.coalesce(x, F.lit(""))))


@lru_cache(maxsize=1)
def _folds() -> tuple[str, str, dict[str, str]]:
    """ASCII parts of compatibility decompositions: letters with one, what they become, and the longer ones.

    The table comes from the Unicode database of the interpreter, over the planes that hold letters.
    """
    one, plain, more = [], [], {}
    for point in (*range(0x80, 0xD800), *range(0xF900, 0x10000), *range(0x1D400, 0x1D800), *range(0x1F100, 0x1F200)):
        ascii_part = "".join(c for c in unicodedata.normalize("NFKD", chr(point)) if ord(c) < 128)
        if len(ascii_part) == 1:
            one.append(chr(point))
            plain.append(ascii_part)
        elif ascii_part:
            more[chr(point)] = ascii_part
    return "".join(one), "".join(plain), more


def fold_ascii(x: Column) -> Column:
    """Letters without their marks, ligatures and styled letters as plain ones; what has no ASCII part goes."""
    one, plain, more = _folds()
    single = F.translate(x, one, plain)
    pairs = F.create_map(*[F.lit(v) for kv in more.items() for v in kv])
    spelled = F.array_join(F.transform(F.split(single, ""), lambda c: F.when(c > "\x7f", F.coalesce(pairs[c], F.lit(""))).otherwise(c)), "")
    return F.when(single.rlike(r"[^\x00-\x7F]"), spelled).otherwise(single)


def slug(x: Column, max_length: int = 48) -> Column:
    """Runs of letters and digits, lower-cased and joined by dashes, cut to a length that does not end in a dash."""
    runs = F.regexp_extract_all(F.lower(fold_ascii(F.coalesce(x, F.lit("")))), F.lit("[a-z0-9]+"), 0)
    return F.rtrim(F.substring(F.array_join(runs, "-"), 1, max_length), F.lit("-"))


def document_slug(x: Column, max_length: int = 80) -> Column:
    """Slug of a file's name without its ending: words keep all their letters, marks inside them vanish.

    White space, dashes and underscores part words; those at either end count only where they are not white space.
    """
    stem = F.when(F.lower(F.substring(x, -4, 4)) == ".pdf", F.substring(x, F.lit(1), F.length(x) - 4)).otherwise(x)
    kept = F.array_join(F.regexp_extract_all(F.lower(stem), F.lit(r"[\w\s-]+"), 0), "")
    words = F.split(F.trim(kept), r"[\s_-]+")
    short = F.substring(F.array_join(words, "-"), 1, max_length)
    return F.coalesce(F.nullif(short, F.lit("")), F.lit("untitled"))


def iso_date(x: Column) -> Column:
    """Leading yyyy-MM-dd of a stamp; null for anything else."""
    return F.nullif(F.regexp_extract(F.trim(x), r"^(\d{4}-\d{2}-\d{2})", 1), F.lit(""))


def coerce_enum(x: Column, allowed: tuple[str, ...], default: str) -> Column:
    value = F.lower(F.trim(x))
    return F.when(value.isin(*allowed), value).otherwise(F.lit(default))


def strict_enum(x: Column, allowed: tuple[str, ...], field: str) -> Column:
    """The value, or an error that stops the job: an unknown role must never be guessed."""
    value = F.lower(F.trim(x))
    return F.when(value.isin(*allowed), value).otherwise(
        F.raise_error(F.concat(F.lit(f"{field}="), F.coalesce(x, F.lit("null")), F.lit(" is not allowed")))
    )


def parse_flag(x: Column) -> Column:
    """Yes/no words to boolean; null when the word is neither."""
    word = F.lower(text_or_blank(x))
    return F.when(word.isin(*fixed.TRUE_WORDS), True).when(word.isin(*fixed.FALSE_WORDS), False)


def lookup(mapping: dict, x: Column, default=None) -> Column:
    pairs = [F.lit(v) for kv in mapping.items() for v in kv]
    found = F.create_map(*pairs)[x]
    return found if default is None else F.coalesce(found, F.lit(default))


# --- tiers --------------------------------------------------------------------------------------
def tier(x: Column, steps: tuple = fixed.PERCENTILE_TIERS) -> Column:
    out = None
    for name, floor_value in steps:
        out = F.when(x >= floor_value, name) if out is None else out.when(x >= floor_value, name)
    return out.otherwise("negligible")


def novelty(km: Column) -> Column:
    return (
        F.when(km.isNull(), F.lit(None).cast("string"))
        .when(km <= fixed.NOVELTY_CONFIRMS_KM, "confirms")
        .when(km <= fixed.NOVELTY_EXTENDS_KM, "extends")
        .otherwise("lead")
    )


def favourable_trend(azimuth: Column) -> Column:
    folded = F.pmod(azimuth, F.lit(180.0))
    return F.coalesce((folded <= 30.0) | (folded >= 165.0), F.lit(False))


def accuracy_class(x: Column) -> Column:
    return lookup(fixed.ACCURACY_CLASSES, F.trim(F.coalesce(x, F.lit(""))), "unknown")


def evidence_weight(production: Column, assays: Column) -> Column:
    return F.when(production, 2).when(assays, 1).otherwise(0)


def token_cost(input_tokens: Column, output_tokens: Column, cache_read: Column | None = None,
               cache_write: Column | None = None) -> Column:
    """Dollars, exact to the sixth decimal: prices are whole cents per million tokens."""
    prices = {k: int(round(v * 100)) for k, v in fixed.TOKEN_PRICES.items()}
    cents = input_tokens * prices["input"] + output_tokens * prices["output"]
    if cache_read is not None:
        cents = cents + cache_read * prices["cache_read"]
    if cache_write is not None:
        cents = cents + cache_write * prices["cache_write"]
    return round_dp(cents.cast("double") / 1e8, 6)


# --- pasted coordinates -------------------------------------------------------------------------
def _numbers(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r"[-+]?\d+(?:\.\d+)?"), 0), lambda n: n.try_cast("double"))


def _angle(words: Column, letters: tuple[str, str]) -> Column:
    """Degrees of the first word that ends in one of ``letters``: one to three numbers, each a sixtieth of the one before."""
    word = F.try_element_at(F.filter(words, lambda w: F.right(w, F.lit(1)).isin(*letters)), F.lit(1))
    parts = _numbers(F.translate(word, "+-", "  "))
    value = F.aggregate(F.reverse(parts), F.lit(0.0), lambda total, n: total / 60.0 + n)
    return F.when(F.size(parts).between(1, 3), F.when(F.right(word, F.lit(1)) == letters[1], -value).otherwise(value))


def parse_coordinate(x: Column) -> Column:
    """Pasted position as struct(lon, lat): two decimal numbers in either order, or two angles with hemisphere letters.

    A number that no latitude can have is the longitude. A small ``s`` right after a digit marks seconds.
    """
    text = F.upper(F.regexp_replace(F.trim(x), r"(?<=\d)s", '"'))
    words = F.regexp_extract_all(text, F.lit("[^NSEW]*[NSEW]"), 0)
    lat, lon = _angle(words, ("N", "S")), _angle(words, ("E", "W"))
    pair = _numbers(text)
    plain = (F.size(pair) == 2) & F.regexp_replace(text, r"[-+]?\d+(?:\.\d+)?", "").rlike(r"^[\s,]+$")
    a, b = F.try_element_at(pair, F.lit(1)), F.try_element_at(pair, F.lit(2))
    first_is_lon = F.abs(a) > 90.0
    return F.when(plain, F.struct(
        F.when(first_is_lon, a).otherwise(b).alias("lon"), F.when(first_is_lon, b).otherwise(a).alias("lat"),
    )).when(lat.isNotNull() & lon.isNotNull(), F.struct(lon.alias("lon"), lat.alias("lat")))


def format_dms(value: Column, positive: str, negative: str) -> Column:
    """Degrees, minutes and seconds to a tenth; rounding carries over, so no part reaches sixty."""
    tenths = F.floor(F.abs(value) * 36000.0 + 0.5)
    part = lambda size, of, width: F.lpad(F.pmod(F.floor(tenths / size), F.lit(of)).cast("bigint").cast("string"), width, "0")
    return F.concat(
        F.floor(tenths / 36000).cast("string"), F.lit("°"), part(600, 60, 2), F.lit("'"), part(10, 60, 2), F.lit("."), part(1, 10, 1),
        F.lit('"'), F.when(value >= 0, positive).otherwise(negative))
