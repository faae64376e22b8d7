"""Season and episode rollups, tallies, facet counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinelake.functions.text import col
from cinelake.operators.spread import in_parts


def series_totals(episodes: DataFrame, parent: str, season: str) -> DataFrame:
    """Episodes of each parent and its distinct non-blank seasons."""
    told = episodes.select(parent, _told(season).alias("__season"))
    seasons = in_parts(told, parent, "__season").groupBy(parent, "__season").agg(F.count("*").alias("__n"))
    return in_parts(seasons, parent).groupBy(parent).agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("n_episodes"), F.count("__season").alias("n_seasons"))


def _told(c: str) -> Column:
    return F.nullif(F.col(c).cast("string"), F.lit(""))


def _each_once(episodes: DataFrame, parent: str, season: Column, episode: str) -> DataFrame:
    """The different (parent, __season, __episode), blank episodes as null. Large seasons are dealt over tasks too."""
    return in_parts(episodes.select(parent, season.alias("__season"), _told(episode).alias("__episode")), parent, "__season", "__episode").distinct()


def season_counts(episodes: DataFrame, parent: str, season: str, episode: str) -> DataFrame:
    """Distinct non-blank episodes of each parent's season, seasons compared as text."""
    each = _each_once(episodes, parent, F.col(season).cast("string"), episode)
    return in_parts(each, parent, "__season").groupBy(parent, F.col("__season").alias(season)).agg(F.count("__episode").alias("n_episodes"))


def latest_season(episodes: DataFrame, parent: str, season: str, episode: str) -> DataFrame:
    """The largest season above 0 of each parent (the digits that a season starts with count) and its distinct episodes."""
    each = _each_once(episodes.filter(_number(season) > 0), parent, _number(season), episode)
    return _latest(in_parts(each, parent).groupBy(parent, F.col("__season").alias("season")).agg(F.count("__episode").alias("n_episodes")), parent)


def _number(season: str) -> Column:
    return F.regexp_extract(F.col(season).cast("string"), r"^(\d+)", 1).try_cast("int")


def _latest(counted: DataFrame, parent: str) -> DataFrame:
    return counted.groupBy(parent).agg(F.max("season").alias("season"), F.max_by("n_episodes", "season").alias("n_episodes"))


def preferred_or_latest(wanted: DataFrame, episodes: DataFrame, parent: str, season: str, episode: str, preferred: str) -> DataFrame:
    """The preferred season where it has an episode, else the latest one; (null, 0) without either."""
    # both counts start from the same different episodes, which Spark finds once
    episodes = episodes.select(parent, F.col(season).cast("string").alias("__season"), _told(episode).alias("__episode")).distinct()
    by_season = episodes.groupBy(parent, "__season").agg(F.count_distinct("__episode").alias("__n")).filter("__n > 0")
    counted = episodes.withColumn("season", _number("__season")).filter("season > 0").groupBy(parent, "season").agg(F.count_distinct("__episode").alias("n_episodes"))
    latest = _latest(counted, parent)
    own = wanted.join(by_season, (wanted[parent] == by_season[parent]) & (F.col(preferred).cast("string") == F.col("__season")), "left").drop(by_season[parent])
    return own.join(latest, parent, "left").select(
        *wanted.columns,
        F.when(F.col("__n").isNotNull(), F.col(preferred).cast("int")).otherwise(F.col("season")).alias("season"),
        F.coalesce("__n", "n_episodes", F.lit(0)).alias("n_episodes"),
    )


def greatest_count(*counts: Column | str) -> Column:
    """The largest count, null where all are 0 or missing."""
    return F.nullif(F.greatest(*(F.coalesce(col(c), F.lit(0)) for c in counts), F.lit(0)), F.lit(0))


def tally(df: DataFrame, by: Column | str, name: str, blank: str = "Unknown") -> DataFrame:
    return df.groupBy(F.coalesce(F.nullif(col(by).cast("string"), F.lit("")), F.lit(blank)).alias(name)).agg(F.count("*").alias("n"))


def status_counts(df: DataFrame, status: str, statuses: list[str], rest: str | None = None) -> DataFrame:
    """One row with a count for each status; with `rest`, all others fall under it."""
    counts = [F.count_if(F.col(status) == s).alias(s.lower().replace(" ", "_")) for s in statuses]
    if rest is not None:
        counts.append(F.count_if(~F.coalesce(F.col(status).isin(statuses), F.lit(False))).alias(rest))
    return df.agg(*counts)


def top_counts(df: DataFrame, by: Column | str, order: list[Column | str], k: int, name: str) -> DataFrame:
    """The k commonest values, ties in the order in which the sorted rows first show them."""
    # the first row of each value by `order` stands for its place; counting needs no global sort
    counted = df.groupBy(col(by).alias(name)).agg(F.count("*").alias("n"), F.min(F.struct(*map(col, order))).alias("__first"))
    top = counted.orderBy(F.desc("n"), "__first").limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "__first"))).drop("__first")
