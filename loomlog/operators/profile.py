"""Counts, facets and summaries. All are partial-then-final hash aggregates over pruned columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import shared

FACETS = ("event_id", "provider", "computer", "channel")


def level_counts(events: DataFrame, archive_id: str | None = None) -> DataFrame:
    kept = events if archive_id is None else events.filter(F.col("archive_id") == archive_id)
    return kept.groupBy("level").agg(F.count(F.lit(1)).alias("n"))


def time_range(events: DataFrame) -> DataFrame:
    """First and last timestamp by text; empty ones do not count."""
    at = F.when(F.col("timestamp") != "", F.col("timestamp"))
    return events.agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("first"), F.max(at).alias("last"))


def facets(events: DataFrame, archive_id: str | None = None, columns: tuple[str, ...] = FACETS) -> DataFrame:
    """(facet, value) of the distinct values of each column, by facet and value.

    Distinct by hash aggregate over rows, not as collected sets: a facet may have as many values as it likes.
    """
    kept = events if archive_id is None else events.filter(F.col("archive_id") == archive_id)
    # values of a row meet as a combination first, so that the expansion works on few rows
    combined = kept.select(*columns).distinct()
    pairs = combined.select(F.explode(F.array(*(F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns))).alias("p")).select("p.*")
    return pairs.distinct().orderBy("facet", "value")


def filtered_of(events: DataFrame, kept: Column) -> DataFrame:
    """How many rows of all a predicate keeps."""
    return events.agg(F.count_if(kept).alias("shown"), F.count(F.lit(1)).alias("total"))


def archive_totals(files: DataFrame) -> DataFrame:
    """Of each archive: size, files, viewable files."""
    return files.groupBy("archive_id").agg(F.sum("size").cast("bigint").alias("total_size"), F.count(F.lit(1)).alias("file_count"), F.count_if(F.col("type") != "unknown").alias("viewable"))


def type_counts(files: DataFrame) -> DataFrame:
    """Of each archive, files by group: a known type, or other."""
    group = F.when(F.col("type").isin("evtx", "json", "txt", "xml"), F.col("type")).otherwise("other")
    return files.groupBy("archive_id", group.alias("group")).agg(F.count(F.lit(1)).alias("n"))


def storage_use(files: DataFrame, quota: int) -> DataFrame:
    used = F.coalesce(F.sum("size"), F.lit(0)).cast("bigint")
    return files.agg(used.alias("usage"), F.lit(quota).cast("bigint").alias("quota"), F.when(F.lit(quota) > 0, used * 100.0 / quota).otherwise(0.0).alias("usage_percent"))


def parse_verdict(summary: DataFrame, warnings: DataFrame) -> DataFrame:
    """Of each file: success without warnings and missing templates, else info; error where it could not be read (null counts)."""
    n = warnings.groupBy("file").agg(F.count(F.lit(1)).alias("warnings"))
    count = F.coalesce("warnings", F.lit(0)).cast("bigint")
    verdict = F.when(F.col("total_records").isNull(), "error").when((count == 0) & (F.col("missing_count") == 0), "success").otherwise("info")
    return summary.join(n, "file", "left").select("file", count.alias("warnings"), F.concat(count.cast("string"), F.lit(" notes")).alias("note"), verdict.alias("verdict"))


#: Parts that a round cuts the values of a group into.
_PARTS = 1024


def _narrowed(samples: DataFrame, state: DataFrame) -> DataFrame:
    """``state`` (_by, _low, _high, _k) after a round: of each group the part of its values that holds rank ``_k``, and the rank in it.

    A group's least and greatest value are parts of their own, so that each round narrows it, whatever the values.
    """
    v, low, high = F.col("_v"), F.col("_low"), F.col("_high")
    inside = samples.join(state, F.col("_g").eqNullSafe(F.col("_by"))).filter((v >= low) & (v <= high))
    share = (v - low).cast("double") / (high - low).cast("double") * _PARTS
    share = F.when(F.isnan(share) | (share < 0), 0).otherwise(F.least(share, F.lit(_PARTS - 1)))
    part = F.when(v == low, -1).when(v == high, _PARTS).otherwise(F.floor(share)).cast("int")
    counted = inside.groupBy("_by", "_k", part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high"))
    parts = counted.groupBy("_by", "_k").agg(F.sort_array(F.collect_list(F.struct("part", "n", "low", "high"))).alias("p"))  # at most _PARTS + 2
    # parts before the one of the rank: those whose running count stays within it
    start = F.struct(F.col("_k").alias("k"), F.lit(0).alias("i"), F.lit(False).alias("found"))
    at = F.aggregate("p", start, lambda a, x: F.when(a["found"] | (a["k"] < x["n"]), F.struct(a["k"].alias("k"), a["i"].alias("i"), F.lit(True).alias("found"))).otherwise(F.struct((a["k"] - x["n"]).alias("k"), (a["i"] + 1).alias("i"), F.lit(False).alias("found"))))
    told = parts.withColumn("at", at).withColumn("of", F.get("p", F.col("at.i")))
    return told.select("_by", F.col("of.low").alias("_low"), F.col("of.high").alias("_high"), F.col("at.k").alias("_k"))


def sample_statistics(samples: DataFrame, by: str, value: str) -> DataFrame:
    """avg, min, max and the upper middle value of the samples of each group (groups of a benchmark's runs).

    The middle is found exactly by counts: rounds cut each group's range into parts, count them by partial aggregates and go on with the
    part that holds the middle rank, until its values are one. No group is sorted or meets in one task.
    """
    spark = samples.sparkSession
    shared.shared_dir(spark)
    found = samples.groupBy(by).agg(F.avg(value).alias("avg"), F.min(value).alias("min"), F.max(value).alias("max"), F.count(value).alias("_n"))
    kept = samples.filter(F.col(value).isNotNull()).select(F.col(by).alias("_g"), F.col(value).alias("_v"))
    state = found.filter("_n > 0").select(F.col(by).alias("_by"), F.col("min").alias("_low"), F.col("max").alias("_high"), F.floor(F.col("_n") / 2).cast("bigint").alias("_k")).checkpoint()
    settled = state.filter("_low = _high")
    while not (state := state.filter("_low <> _high")).isEmpty():
        state = _narrowed(kept, state).checkpoint()  # a row a group
        settled = settled.unionByName(state.filter("_low = _high"))
    middle = settled.select("_by", F.col("_low").alias("median"))
    # null groups join too; a group without values has no middle
    return found.join(middle, F.col(by).eqNullSafe(F.col("_by")), "left").select(by, "avg", "min", "max", "median")


def long_tasks(trace: DataFrame, least_ms: float = 50.0) -> DataFrame:
    """Of a trace (name, dur in microseconds), the tasks over ``least_ms``, longest first."""
    return trace.select("name", (F.col("dur") / 1000.0).alias("ms")).filter(F.col("ms") > least_ms).orderBy(F.desc("ms"), "name")


def scripting_time(trace: DataFrame, names: tuple[str, ...] = ("FunctionCall", "EvaluateScript")) -> DataFrame:
    """Milliseconds of a trace's tasks of these names."""
    return trace.filter(F.col("name").isin(*names)).agg(F.coalesce(F.sum(F.col("dur") / 1000.0), F.lit(0.0)).alias("ms"))
