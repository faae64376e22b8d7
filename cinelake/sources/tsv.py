"""Catalogue dumps: gzip TSV files with `\\N` for missing values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinelake.functions.text import title_key

# Columns of the dumps, and the types that lookups are made for.
TITLE_COLUMNS = ["tconst", "titleType", "primaryTitle", "originalTitle", "isAdult", "startYear", "endYear", "runtimeMinutes", "genres"]
NAME_COLUMNS = ["nconst", "primaryName", "birthYear", "deathYear", "primaryProfession", "knownForTitles"]
EPISODE_COLUMNS = ["tconst", "parentTconst", "seasonNumber", "episodeNumber"]
LOOKUP_TYPES = ["movie", "tvMovie", "tvSeries", "tvMiniSeries", "videoGame"]
SERIES_TYPES = ["tvSeries", "tvMiniSeries"]


def _read(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    schema = ", ".join(f"{c} string" for c in columns)
    return spark.read.csv(path, schema=schema, sep="\t", header=True, quote="", nullValue="\\N", emptyValue="")


def _texts(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.select(*(F.coalesce(F.col(old), F.lit("")).alias(new) for old, new in names.items()))


def titles(spark: SparkSession, path: str) -> DataFrame:
    """Titles of the lookup types that aren't adult, with their two keys."""
    rows = _read(spark, path, TITLE_COLUMNS).filter(F.col("titleType").isin(LOOKUP_TYPES) & (F.coalesce("isAdult", F.lit("")) != "1"))
    named = _texts(rows, {"tconst": "tconst", "titleType": "title_type", "primaryTitle": "primary_title", "originalTitle": "original_title", "startYear": "start_year", "endYear": "end_year", "genres": "genres"})
    return named.withColumns({"normalized_primary": title_key("primary_title"), "normalized_original": title_key("original_title")})


def names(spark: SparkSession, path: str) -> DataFrame:
    rows = _texts(_read(spark, path, NAME_COLUMNS), {"nconst": "nconst", "primaryName": "primary_name", "birthYear": "birth_year", "deathYear": "death_year", "primaryProfession": "primary_profession", "knownForTitles": "known_for"})
    return rows.filter("primary_name != ''").withColumn("normalized_name", title_key("primary_name"))


def episodes(spark: SparkSession, path: str, series: DataFrame) -> DataFrame:
    """Episodes of known series; Spark broadcasts the ids if they are few."""
    rows = _texts(_read(spark, path, EPISODE_COLUMNS), {"parentTconst": "parent", "seasonNumber": "season", "episodeNumber": "episode"})
    return rows.join(series.select(F.col("tconst").alias("parent")), "parent", "left_semi")
