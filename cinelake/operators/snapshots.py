"""Whole snapshots out of the parts: calendar rows to series with codes, seasons with episodes and ends, candidates for a row, opening figures."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinelake.functions import classify, dates, scoring, seasons, text
from cinelake.operators import candidates, resolve, rollup
from cinelake.sources import lookups
from cinelake.sources.calendars import page_url

# Episodes of seasons that no source has right, by title key, season and year.
EPISODE_OVERRIDES = {("my two cents", 1, 2026): 6, ("due spicci", 1, 2026): 6}
#: Days back from today that a snapshot covers where no window is asked for.
SERIES_DAYS, SEASON_DAYS = 2, 7
# Fixed value: the score from which a calendar's row is taken for the asked one.
CALENDAR_SCORE = 45


def default_window(days: int, as_of: dt.date, start: dt.date | None = None, end: dt.date | None = None) -> tuple[dt.date, dt.date]:
    start, end = start or as_of - dt.timedelta(days=days), end or as_of
    if end < start:
        raise ValueError("the end of a window is before its start")
    return start, end


def without_rent_buy(rows: DataFrame, availability: str = "availability") -> DataFrame:
    return rows.filter(~F.contains(F.lower(F.coalesce(availability, F.lit(""))), F.lit("rent/buy")))


def without_specials(rows: DataFrame, title: str = "title") -> DataFrame:
    """Rows whose title has no word that marks a special or a live event."""
    return rows.filter(~F.coalesce(title, F.lit("")).rlike(r"(?i)\b(?:special|speical|live\s+event)\b"))


def eligible(calendar: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """Series of a calendar (title, release_type, content_format, availability, details, genre, release_date) in the window."""
    return calendar.filter(dates.in_window("release_date", start, end) & classify.series_eligible("title", "release_type", "content_format", "availability", "details"))


def told_season(title: Column | str, details: Column | str = "") -> Column:
    """The number after `Season` or `S` in a title or its details; null if neither has one."""
    said = F.concat_ws(" ", text.col(title), text.col(details) if isinstance(details, Column) or details else F.lit(""))
    return F.nullif(F.regexp_extract(said, r"(?i)\b(?:season\s+|s)0*(\d{1,3})\b", 1), F.lit("")).cast("int")


def bare_title(title: Column | str) -> Column:
    """A title without its season."""
    return F.trim(F.regexp_replace(text.col(title), r"(?i)\s*[-:,(]?\s*\b(?:season\s+\d+|s\d+)\b\)?\s*$", ""))


def matched_series(rows: DataFrame, catalogue: DataFrame) -> DataFrame:
    """rows with `code`, null where no series has the title: catalogue is (code, kind, primary_title, original_title, year).

    Distinct titles and years meet the catalogue on exploded keys; the arg-max is an aggregation.
    """
    asked = rows.withColumns({"key": text.title_key(bare_title("title")), "wanted": F.year("release_date"), "expected": F.when(F.lower("release_type").contains("limited"), "tvMiniSeries").otherwise("tvSeries")})
    keyed = catalogue.filter(F.col("kind").isin("tvSeries", "tvMiniSeries")).withColumns({"primary_key": text.title_key("primary_title"), "original_key": text.title_key("original_title")})
    score = lambda: F.when(F.col("code").isNotNull(), scoring.series_score(F.col("kind"), F.col("expected"), F.col("primary_key"), F.col("original_key"), F.col("key"), F.col("year").cast("int"), F.col("wanted")))
    best = resolve.best_match(asked.select("key", "wanted", "expected").distinct(), resolve.with_keys(keyed, "primary_key", "original_key"), ["key"], ["key", "wanted", "expected"], score, "code", least=1, keep=["code", "kind", "year"])
    found = best.select("key", "wanted", "expected", "code", F.col("kind").alias("matched_type"), F.col("year").cast("int").alias("matched_year"))
    return asked.join(found, ["key", "wanted", "expected"], "left").withColumnRenamed("expected", "expected_type").drop("key", "wanted")


def remarks() -> Column:
    """What a person should know of a row's match (code, matched_type, expected_type, matched_year, release_date); empty without a match."""
    year = F.year("release_date")
    return F.when(
        F.col("code").isNotNull() & (F.col("code").cast("string") != ""),
        F.concat_ws(
            " ", F.lit("The title's key is equal."),
            F.when(F.col("matched_type") != F.col("expected_type"), F.concat(F.lit("It is a "), "matched_type", F.lit(", "), "expected_type", F.lit(" was looked for."))),
            F.when(F.coalesce("matched_year", F.lit(0)) == 0, F.lit("No start year is known.")).when(F.col("matched_year") != year, F.concat(F.lit("It starts in "), "matched_year", F.lit(", not in "), year, F.lit("."))),
        ),
    ).otherwise("")


def series_snapshot(calendar: DataFrame, catalogue: DataFrame, episodes: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """Eligible calendar rows of the window with code, total_seasons, total_episodes, end_date, note and remarks; what no series matches is for a person to review.

    episodes is (code, season, episode). The end comes from what the row itself tells.
    """
    rows = matched_series(eligible(calendar, start, end), catalogue).withColumn("remarks", remarks()).drop("matched_type", "matched_year", "expected_type")
    totals = rollup.series_totals(episodes, "code", "season")
    said = F.concat_ws(" ", "details", "availability")
    days = F.concat(F.array("release_date"), seasons.episode_dates(said, "release_date"))
    end_date = F.coalesce(seasons.stated_end(said, "release_date"), dates.season_end(F.col("release_date"), days))
    joined = rows.join(totals, "code", "left")
    return joined.withColumns({
        "code": F.coalesce(F.col("code").cast("string"), F.lit("")), "total_seasons": F.nullif("n_seasons", F.lit(0)), "total_episodes": F.nullif("n_episodes", F.lit(0)),
        "end_date": end_date, "note": F.when(F.col("code").isNull(), "Manual review").otherwise("Matched"),
    }).drop("n_seasons", "n_episodes")


#: Score from which an answer of the first and of the second source is taken. Fixed values.
FIRST_SCORE, SECOND_SCORE = 45, 55


def best_answers(asked: DataFrame, answers: DataFrame, least: int) -> DataFrame:
    """(key, wanted, answer) of the questions (key, wanted: a year or null) that have an answer of score `least`: the best one, the first of equals, as a struct.

    answers is (key, place, name, year, …). The score is the similarity of the names by matching
    blocks, times 100, and 25 for the wanted year or 10 for the next one on either side.
    """
    rest = [c for c in answers.columns if c != "key"]
    bonus = lambda: F.coalesce(scoring.year_bonus(F.col("__year").cast("int"), F.col("wanted")), F.lit(0))
    probes = asked.select("key", "wanted").distinct().withColumn("probe", F.col("key"))
    named = answers.select("key", text.title_key("name").alias("answer"), F.col("year").alias("__year"), F.struct(*rest).alias("a"))
    scored = candidates.similar_pairs(probes, named, least, ["key"], bonus, 25)
    return scored.groupBy("key", "wanted").agg(F.min_by("a", F.struct((-F.col("score")).alias("s"), F.col("a.place").alias("p"))).alias("answer"))


def series_snapshot_of_answers(calendar: DataFrame, first: DataFrame, second: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """Eligible calendar rows of the window with code, total_seasons, total_episodes and note, from landed answers in place of the index.

    Both answers are (key, place, name, year, code, seasons, episodes) by the asked title's key. A
    row has what its best answer of the first source tells. Only where that has no code, the best of
    the second counts: its code, its note, and what the first left open, field by field.
    """
    rows = eligible(calendar, start, end).withColumns({"key": text.title_key(bare_title("title")), "wanted": F.year("release_date")})
    one, two = (best_answers(rows, a, least).withColumnRenamed("answer", n) for a, least, n in ((first, FIRST_SCORE, "one"), (second, SECOND_SCORE, "two")))
    joined = rows
    for found in (one, two):
        keyed = found.select(F.col("key").alias("__key"), F.col("wanted").alias("__wanted"), found.columns[-1])
        joined = joined.join(keyed, (F.col("key") == F.col("__key")) & F.col("wanted").eqNullSafe(F.col("__wanted")), "left").drop("__key", "__wanted")
    told = lambda c: F.nullif(F.coalesce(c, F.lit("")), F.lit(""))
    some = lambda c: F.nullif(c, F.lit(0))
    own, other = told(F.col("one.code")), told(F.col("two.code"))
    helped = own.isNull() & other.isNotNull()
    field = lambda n: F.coalesce(some(F.col(f"one.{n}")), F.when(helped, some(F.col(f"two.{n}"))))
    return joined.select(
        *calendar.columns, F.coalesce(own, other, F.lit("")).alias("code"), field("seasons").alias("total_seasons"), field("episodes").alias("total_episodes"),
        F.when(own.isNotNull(), "Matched").when(helped, "Matched by the second source").when(F.col("one").isNotNull(), "Matched without a code").otherwise("No confident match").alias("note"),
    )


def episode_override(title: Column | str, season: Column, year: Column) -> Column:
    out = F.lit(0)
    for (key, number, of_year), n in EPISODE_OVERRIDES.items():
        out = F.when((text.title_key(title) == key) & (season == number) & (year == of_year), n).otherwise(out)
    return out


def season_snapshot(calendar: DataFrame, catalogue: DataFrame, episodes: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """Eligible calendar rows of the window with code, season, season_episodes and end_date: the season that a row tells where it has episodes, else the latest.

    The count is the largest of the index's, the row's own words' and the fixed overrides'; 0 is null.
    """
    rows = matched_series(eligible(calendar, start, end), catalogue).withColumn("wanted", told_season("title", F.col("details")))
    found = rollup.preferred_or_latest(rows.select("code", "wanted").distinct().filter("code is not null"), episodes, "code", "season", "episode", "wanted")
    joined = rows.join(found.select("code", F.col("wanted").alias("__wanted"), F.col("season").alias("found_season"), "n_episodes").withColumnRenamed("code", "__code"), F.col("code").eqNullSafe(F.col("__code")) & F.col("wanted").eqNullSafe(F.col("__wanted")), "left")
    season = F.coalesce("found_season", "wanted")
    said = F.concat_ws(" ", "title", "details")
    count = rollup.greatest_count("n_episodes", seasons.told_episodes(said, F.coalesce(season, F.lit(0))), episode_override(bare_title("title"), season, F.year("release_date")))
    days = F.concat(F.array("release_date"), seasons.episode_dates(F.col("details"), "release_date"))
    return joined.select(*calendar.columns, F.coalesce(F.col("code").cast("string"), F.lit("")).alias("code"), season.alias("season"), count.alias("season_episodes"),
                         F.coalesce(seasons.stated_end(F.col("details"), "release_date"), dates.season_end(F.col("release_date"), days)).alias("end_date"))


def season_snapshot_of_answers(calendar: DataFrame, answers: DataFrame, pages: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """Eligible calendar rows of the window with code, season, season_episodes, start_date and end_date, from landed answers and season pages.

    answers is (key, place, name, year, code, body), a catalogue's details as JSON; pages is (key,
    season, text), what season and episode pages say. The season is the one that a row tells where
    the answer has it, else the answer's latest, else what the row tells. The pages of the told and
    of the found season add up. The start is the answer's, else the pages', else the calendar's; the
    count the largest of the answer's, the pages', the row's own words' and the fixed overrides'; the
    end is what the row states, else it follows from all days that are known.
    """
    rows = eligible(calendar, start, end).withColumns({"key": text.title_key(bare_title("title")), "wanted": F.year("release_date"), "told": told_season("title", F.col("details"))})
    asked = rows.select("key", "wanted", "told").distinct()
    best = best_answers(rows, answers, FIRST_SCORE)
    found = lookups.season_fields(asked.join(best, ["key", "wanted"]).select("key", "wanted", "told", F.col("answer.code").alias("code"), F.col("answer.body").alias("body")), "told").drop("body")
    same = F.col("told").eqNullSafe(F.col("__told"))
    seen = found.select(F.col("key").alias("__key"), F.col("wanted").alias("__wanted"), F.col("told").alias("__told"), "code", "season", "episodes", "season_date", "last_date")
    joined = rows.join(seen, (F.col("key") == F.col("__key")) & F.col("wanted").eqNullSafe(F.col("__wanted")) & same, "left").drop("__key", "__wanted", "__told")
    joined = joined.withColumn("season", F.coalesce("season", "told"))
    context = pages.groupBy("key", "season").agg(F.array_join(F.array_sort(F.collect_list("text")), "\n").alias("text")).select(F.col("key").alias("__key"), F.col("season").alias("__season"), seasons.season_context("text").alias("context"), seasons.page_episodes("text", "season").alias("numbered"))
    for name, number in (("told_page", "told"), ("own_page", "season")):
        page = context.select(F.col("__key"), F.col("__season"), F.struct("context", "numbered").alias(name))
        joined = joined.join(page, (F.col("key") == F.col("__key")) & (F.col(number) == F.col("__season")), "left").drop("__key", "__season")
    page = seasons.merged_context(F.col("told_page.context"), F.col("own_page.context"))
    merged = joined.withColumn("page", page).withColumn("begins", F.coalesce("season_date", "page.first", "release_date"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    count = rollup.greatest_count(
        zero(F.col("episodes")), zero(F.col("page.episodes")), zero(F.col("told_page.numbered")), zero(F.col("own_page.numbered")),
        seasons.told_episodes(F.concat_ws(" ", "title", "details"), zero(F.col("season"))), episode_override(bare_title("title"), F.col("season"), F.year("release_date")),
    )
    days = F.concat(F.array_compact(F.array("page.first", "page.last", "season_date", "last_date")), seasons.episode_dates(F.col("details"), "begins"))
    return merged.select(*calendar.columns, F.coalesce("code", F.lit("")).alias("code"), "season", count.alias("season_episodes"), F.col("begins").alias("start_date"),
                         F.coalesce(seasons.stated_end(F.col("details"), "begins"), dates.season_end(F.col("begins"), days)).alias("end_date"))


def calendar_candidates(asked: DataFrame, calendar: DataFrame) -> DataFrame:
    """(key, day, network, c) of asked shows (key, day, network): the calendar's row c with the best score by title, day and network, ties to the earlier day, then address.

    A title that only contains the asked one, or shares no word with it but starts on the same day in the same network, may win.
    """
    rows = calendar.select(text.title_key("title").alias("key"), F.col("release_date").alias("day"), F.col("availability").alias("network"), F.struct("release_date", "genre", "availability", "page_url", "title").alias("c"))
    tie = F.struct("c.release_date", "c.page_url", "c.title", F.coalesce("c.availability", F.lit("")))
    return candidates.best_titles(asked, rows, CALENDAR_SCORE, tie, ["c"])


def external_candidates(rows: DataFrame, catalogue: DataFrame, calendar: DataFrame, row_id: list[str]) -> DataFrame:
    """row_id, found_imdb, found_date, found_precision, found_genres, found_network, found_metacritic and found_source of rows (title, category, release_date, network).

    The catalogue (code, kind, title, year, genres) answers on the title's key by type and year; a
    calendar (title, release_date, genre, availability, page_url) answers for shows, its best row
    from a score of 45 on; films and shows without one get the address that their title makes. The
    two are merged field by field: what the calendar lacks doesn't hide what the catalogue has; the
    catalogue's day is a year only.
    """
    asked = rows.select(*row_id, "title", "category", "release_date", "network").withColumns({
        "key": text.title_key(text.dar_base("title")), "preferred": classify.preferred_types("category"), "wanted": F.year("release_date"), "network": F.coalesce("network", F.lit("")),
    })
    own = catalogue.withColumn("key", text.title_key("title")).select("key", "code", "kind", F.col("year").cast("int").alias("year"), F.col("genres").alias("known_genres"))
    fits = F.array_contains("preferred", F.col("kind"))
    score = lambda: F.when(F.col("code").isNotNull() & fits, scoring.lookup_score(F.col("kind"), F.col("preferred"), F.col("key"), F.lit(""), F.col("key"), F.col("year"), F.col("wanted")))
    probes = asked.select("key", "preferred", "wanted").distinct()
    best = resolve.best_match(probes, own, ["key"], ["key", "preferred", "wanted"], score, "code", keep=["code", "year", "known_genres"]).drop("score")
    shows = asked.filter(F.col("category") == "TV Shows").select("key", F.col("release_date").alias("day"), "network")
    of_calendar = calendar_candidates(shows, calendar).select(F.col("key").alias("ckey"), F.col("day").alias("cday"), F.col("network").alias("cnetwork"), "c")
    met = asked.join(best, (asked.key == best.key) & (asked.preferred == best.preferred) & asked.wanted.eqNullSafe(best.wanted), "left").drop(best.key).drop(best.preferred).drop(best.wanted)
    met = met.join(of_calendar, (F.col("key") == F.col("ckey")) & F.col("release_date").eqNullSafe(F.col("cday")) & (F.col("network") == F.col("cnetwork")) & (F.col("category") == "TV Shows"), "left")
    screen, film = F.col("category").isin("Movies", "TV Shows"), F.col("category") == "Movies"
    of = lambda t: page_url(t, F.lit(""), F.when(film, "Movie").otherwise("TV Series"), F.when(film, "Movie").otherwise("TV"), "tv")
    shown = F.coalesce(F.nullif(F.col("c.page_url"), F.lit("")), F.when(F.col("c").isNotNull(), of(F.col("c.title"))), F.when(screen, of(text.dar_base("title"))))
    dated = F.col("c.release_date").isNotNull()
    sources = F.array_compact(F.array(F.when(F.col("code").isNotNull(), "Index"), F.when(F.col("c").isNotNull(), "Calendar").when(screen, "Title URL")))
    told = F.when(F.coalesce(F.col("c.genre"), F.lit("")) != "", text.split_values("c.genre"))
    has_genres = F.size(F.coalesce("known_genres", F.array().cast("array<string>"))) > 0
    return met.select(
        *row_id, F.col("code").alias("found_imdb"), F.when(dated, F.col("c.release_date")).otherwise(F.make_date("year", F.lit(1), F.lit(1))).alias("found_date"),
        F.when(dated, "date").when(F.col("year").isNotNull(), "year").otherwise("").alias("found_precision"),
        F.coalesce(F.when(has_genres, F.col("known_genres")), told, F.array().cast("array<string>")).alias("found_genres"),
        F.coalesce("c.availability", F.lit("")).alias("found_network"), shown.alias("found_metacritic"), F.array_join(sources, " + ").alias("found_source"),
    )


def best_suggestion(items: Column) -> Column:
    """Of a suggestion answer's items (id, qid, …) the first film with an id, else the first with an id."""
    has = F.filter(items, lambda x: F.coalesce(x["id"], F.lit("")) != "")
    return F.coalesce(F.get(F.filter(has, lambda x: x["qid"] == "movie"), F.lit(0)), F.get(has, F.lit(0)))


SUGGESTIONS = "struct<d:array<struct<id:string,l:string,qid:string,y:int>>>"


def opening_figures(titles: DataFrame, suggestions: DataFrame, details: DataFrame) -> DataFrame:
    """(title, matched_title, year, code, opening, theaters, note) of asked titles: suggestions is (title, body), details (code, label, value) of the films' pages."""
    answered = suggestions.select("title", best_suggestion(F.from_json("body", SUGGESTIONS)["d"]).alias("s"))
    wide = details.filter(F.col("label").isin("Opening", "Widest Release")).groupBy("code").agg(*(F.max(F.when(F.col("label") == n, F.col("value"))).alias(a) for n, a in (("Opening", "told_opening"), ("Widest Release", "told_theaters"))))
    joined = titles.join(answered, "title", "left").withColumn("code", F.coalesce("s.id", F.lit(""))).join(wide, "code", "left")
    note = F.when(F.col("code") == "", "No matching film").when(F.col("told_opening").isNull(), "No opening figures on the page").otherwise("")
    return joined.select("title", F.coalesce(text.squash("s.l"), F.lit("")).alias("matched_title"), F.coalesce(F.col("s.y").cast("string"), F.lit("")).alias("year"), "code",
                         F.coalesce(text.money("told_opening"), F.lit("")).alias("opening"), F.coalesce(text.theaters("told_theaters"), F.lit("")).alias("theaters"), note.alias("note"))


def merged_snapshots(*runs: DataFrame, created: str = "created_at", run_id: str = "run_id") -> DataFrame:
    """Runs of several trackers, the latest first."""
    out = runs[0]
    for more in runs[1:]:
        out = out.unionByName(more)
    return out.orderBy(F.desc(created), F.desc(run_id))


def title_column(columns: list[str], rows: list[str] = ()) -> str:
    """The column that holds titles, among those declared, else those that rows have; empty if there is none."""
    # Fixed values.
    names = ("Title Name", "Input Title", "title", "Title")
    return next((n for known in (columns, rows) for n in names if n in known), "")


def summary(rows: DataFrame, matched: Column, start: dt.date, end: dt.date) -> DataFrame:
    """(summary): one row that tells the window and how many rows matched."""
    counts = rows.agg(F.count("*").alias("n"), F.count_if(matched).alias("m"))
    return counts.select(F.format_string(f"Rows from {start} through {end}: %d. Matched: %d. For review: %d.", "n", "m", F.col("n") - F.col("m")).alias("summary"))
