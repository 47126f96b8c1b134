"""Browser history: one shape for three browsers, domains, top lists, filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidlake.catalogs import lookups as L
from evidlake.functions.text import lookup
from evidlake.functions.times import chromium_time, core_foundation, unix_micros
from evidlake.operators.joins import lookup_join

HISTORY = [
    "browser", "url", "title", "visit_count", "typed_count", "last_visit", "hidden", "visit_type",
]


def _text(column: str, default: Column) -> Column:
    return F.coalesce(F.nullif(F.col(column), F.lit("")), default)


def _count(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(0)).cast("long")


def transition_label(value: Column) -> Column:
    core = value.cast("int").bitwiseAND(0xFF)
    other = F.concat(F.lit("Unknown ("), core.cast("string"), F.lit(")"))
    return F.when(value.isNull(), "Unknown").otherwise(lookup(L.CHROMIUM_TRANSITIONS, core, other))


def firefox_visit_label(value: Column) -> Column:
    other = F.concat(F.lit("Unknown ("), value.cast("string"), F.lit(")"))
    return F.when(value.isNull(), "Unknown").otherwise(
        lookup(L.FIREFOX_VISITS, value.cast("int"), other)
    )


def chromium_history(urls: DataFrame) -> DataFrame:
    """Chromium ``urls`` rows; a ``transition`` column, when exported, names the visit type."""
    transition = "transition" if "transition" in urls.columns else "typed_count"
    return urls.select(
        F.col("browser") if "browser" in urls.columns else F.lit("chrome").alias("browser"),
        F.coalesce("url", F.lit("")).alias("url"),
        _text("title", F.lit("No Title")).alias("title"),
        _count("visit_count").alias("visit_count"),
        _count("typed_count").alias("typed_count"),
        chromium_time(F.col("last_visit_time")).alias("last_visit"),
        F.coalesce(F.col("hidden") != 0, F.lit(False)).alias("hidden"),
        transition_label(F.col(transition)).alias("visit_type"),
    )


def firefox_history(places: DataFrame) -> DataFrame:
    """Firefox ``moz_places`` rows; the typed flag means a typed address.

    A ``visit_type`` column, when the visits are exported with their places, names the type.
    """
    typed = F.when(F.col("typed") > 0, "Typed").otherwise("Link")
    kind = firefox_visit_label(F.col("visit_type")) if "visit_type" in places.columns else typed
    return places.select(
        F.lit("firefox").alias("browser"),
        F.coalesce("url", F.lit("")).alias("url"),
        _text("title", F.lit("No Title")).alias("title"),
        _count("visit_count").alias("visit_count"),
        _count("typed").alias("typed_count"),
        unix_micros(F.col("last_visit_date")).alias("last_visit"),
        F.coalesce(F.col("hidden") != 0, F.lit(False)).alias("hidden"),
        kind.alias("visit_type"),
    )


def safari_history(items: DataFrame, visits: DataFrame) -> DataFrame:
    """Safari items with their visits; one popular item may own a third of the visits."""
    keyed = visits.select(
        F.col("history_item").alias("id"), "visit_time", F.col("title").alias("visit_title")
    )
    joined = lookup_join(keyed, items, "id", "inner")
    title = F.coalesce(
        F.nullif(F.col("visit_title"), F.lit("")),
        F.nullif(F.col("domain_expansion"), F.lit("")),
        F.lit("No Title"),
    )
    return joined.select(
        F.lit("safari").alias("browser"),
        F.coalesce("url", F.lit("")).alias("url"),
        title.alias("title"),
        _count("visit_count").alias("visit_count"),
        F.lit(0).cast("long").alias("typed_count"),
        core_foundation(F.col("visit_time")).alias("last_visit"),
        F.lit(False).alias("hidden"),
        F.lit("Safari Visit").alias("visit_type"),
    )


def unified_history(*parts: DataFrame) -> DataFrame:
    out = parts[0].select(*HISTORY)
    for part in parts[1:]:
        out = out.unionByName(part.select(*HISTORY))
    return out


def recent(history: DataFrame, as_of: Column, days_back: int = 365, limit: int | None = None):
    """Visits after the cutoff; with a limit, the newest ones (the feature of the reader)."""
    kept = history.filter(F.col("last_visit") >= as_of - F.make_dt_interval(F.lit(days_back)))
    return kept if limit is None else kept.orderBy(F.desc("last_visit"), "url").limit(limit)


def domain(url: Column) -> Column:
    """Host and port in lower case without ``www.``; local hosts keep the scheme."""
    site = F.coalesce(F.try_parse_url(url, F.lit("AUTHORITY")), F.lit(""))
    # A character the strict URL parser rejects must not lose the host.
    site = F.when(site == "", F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)).otherwise(site)
    bare = F.regexp_replace(F.lower(site), r"^www\.", "")
    local = F.contains(bare, F.lit("localhost")) | F.contains(bare, F.lit("127.0.0.1"))
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    return (
        F.when(local, F.concat(scheme, F.lit("://"), site))
        .when(bare == "", url)
        .otherwise(bare)
    )


def domain_visits(history: DataFrame, order: str = "last_visit") -> DataFrame:
    """Visits per domain with the URL of its last row by the order column."""
    return (
        history.filter(F.col("url") != "")
        .groupBy(domain(F.col("url")).alias("domain"))
        .agg(
            F.sum("visit_count").alias("visits"),
            F.max_by("url", F.struct(order, "url")).alias("sample_url"),
        )
    )


def url_visits(history: DataFrame) -> DataFrame:
    return (
        history.filter(F.col("url") != "")
        .groupBy("url")
        .agg(F.sum("visit_count").alias("visits"))
    )


def top_domains(history: DataFrame, n: int = 10, order: str = "last_visit") -> DataFrame:
    return domain_visits(history, order).orderBy(F.desc("visits"), "domain").limit(n)


def top_urls(history: DataFrame, n: int = 10) -> DataFrame:
    return url_visits(history).orderBy(F.desc("visits"), "url").limit(n)


def history_totals(history: DataFrame) -> DataFrame:
    return history.agg(
        F.count("*").alias("total_entries"),
        F.count_distinct("browser").alias("browsers_found"),
        F.sum(F.when(F.col("url") != "", F.col("visit_count")).otherwise(0)).alias("total_visits"),
    )


def filter_history(
    history: DataFrame, month: int | None = None, year: int | None = None, term: str = ""
) -> DataFrame:
    out = history.withColumns({"month": F.month("last_visit"), "year": F.year("last_visit")})
    if month is not None:
        out = out.filter(F.col("month") == month)
    if year is not None:
        out = out.filter(F.col("year") == year)
    needle = term.lower().strip()
    if needle:
        out = out.filter(
            F.contains(F.lower("url"), F.lit(needle)) | F.contains(F.lower("title"), F.lit(needle))
        )
    return out
