"""Ingest exports: declarative profiles that map report columns to template columns, and DAR twins."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TITLE, CATEGORY, SOCIAL = "title", "title_category", "twitter_handle"
BOTH = ("movies", "tv shows")


def _text(c: Column) -> Column:
    return F.trim(F.coalesce(c.cast("string"), F.lit("")))


def plain(c: Column) -> Column:
    return _text(c)


def imdb_page(c: Column) -> Column:
    code = F.regexp_extract(_text(c), r"(?i)(?:nm|tt)\d{5,}", 0)
    return F.when(code == "", "").otherwise(F.concat(F.lit("https://www.imdb.com/"), F.when(F.lower(code).startswith("nm"), "name/").otherwise("title/"), code))


def web_address(c: Column) -> Column:
    s = _text(c)
    return (
        F.when((s == "") | F.lower(s).isin("n/a", "na", "-", "none"), "").when(s.startswith("//"), F.concat(F.lit("https:"), s))
        .when(~s.startswith("http") & F.contains(s, F.lit(".")), F.concat(F.lit("https://"), s)).when(s.startswith("http"), s).otherwise("")
    )


def handle(c: Column) -> Column:
    s = F.ltrim(_text(c), F.lit("@"))
    last = F.when(F.contains(s, F.lit("/")), F.substring_index(F.rtrim(s, F.lit("/")), "/", -1)).otherwise(s)
    return F.substring_index(last, "?", 1)


def gender_line(c: Column) -> Column:
    s = F.lower(_text(c))
    return F.when(s.startswith("m"), "Gender - Man").when(s.rlike("^[fw]"), "Gender - Woman").otherwise("")


def iso_day(c: Column) -> Column:
    return F.regexp_extract(_text(c), r"\d{4}-\d{2}-\d{2}", 0)


def distributor(c: Column) -> Column:
    return F.when(F.lower(_text(c)).isin("n/a", "na", "unknown", "-", "tbd"), "").otherwise(_text(c))


def scale(c: Column) -> Column:
    s = F.initcap(_text(c))
    return F.when(s.isin("Wide", "Limited"), s).otherwise("")


def language(c: Column) -> Column:
    s = F.lower(_text(c))
    return F.when(s == "", "").when(F.contains(s, F.lit("english")), "en").otherwise("xx")


def first_of(c: Column) -> Column:
    s, out = _text(c), _text(c)
    for mark in (",", ";", "|"):
        out = F.when(F.contains(s, F.lit(mark)), F.trim(F.substring_index(s, mark, 1))).otherwise(out)
    return out


@dataclass
class Profile:
    """category, columns that may hold the title, and for each target the source columns and their normalizer."""

    category: str
    titles: list[str]
    columns: dict[str, tuple[list[str], Callable[[Column], Column]]] = field(default_factory=dict)
    mode: str = ""

    def twin_mode(self) -> str:
        """Movies and TV Shows have an owned row and a DAR twin, all else the DAR row only."""
        return self.mode or ("both" if self.category.strip().lower() in BOTH else "dar")


# Template columns and the report columns that feed them.
_DAY, _GENRE, _METACRITIC = (["Release Date"], iso_day), (["Genre"], plain), (["Metacritic URL"], web_address)
_CODE = (["IMDb ttcode", "IMDb URL", "ttcode"], imdb_page)
_SOCIAL = {
    "wikipedia_page": (["wikipedia", "Wikipedia", "Wikipedia URL"], web_address),
    "twitter_handle": (["twitter", "X / Twitter", "Twitter"], handle),
    "instagram_user": (["instagram", "Instagram"], handle),
    "facebook_page": (["facebook", "Facebook"], web_address),
    "youtube_channel_username": (["youtube", "YouTube"], web_address),
    "tiktok_user": (["tiktok", "TikTok"], handle),
}
_CLUB, _TEAM, _BRAND = ["club", "team", "Club", "Team"], ["team", "Team"], ["brand", "Brand", "Brand Name"]
TEAMS = {
    "premier-league": _CLUB, "saudi-pro-league": _CLUB, "nfl-teams": _TEAM, "nba-teams": _TEAM, "nhl-teams": _TEAM, "mlb-teams": _TEAM, "milb-teams": _TEAM,
    "mls-teams": _TEAM, "nwsl-teams": _TEAM, "wnba-teams": _TEAM, "brasileirao": _CLUB, "bundesliga": _CLUB, "laliga": _CLUB, "serie-a": _CLUB, "ligue1": _CLUB,
}
PROFILES = {
    "billboard-artist-100": Profile("Talent", ["Artist Name", "Artist"], {"imdb_id": (["IMDb URL"], imdb_page), "wikipedia_page": (["Wikipedia URL"], web_address), "profession": (["Occupations"], first_of), "gender": (["Gender"], gender_line)}),
    "tv-premiere-calendar": Profile("TV Shows", ["Title Name", "Title", "Show", "Series"], {"network": (["Availability / Network", "Studio/Publisher"], plain), "released_on": _DAY, "genre": _GENRE, "metacritic": _METACRITIC, "imdb_id": _CODE}),
    "tv-seasons": Profile(
        "TV Shows", ["title", "Title", "Title Name", "Series"],
        {"network": (["network_distributor", "Availability / Network", "Studio/Publisher"], distributor), "released_on": (["release_date", "Release Date"], iso_day), "imdb_id": (["imdb_id", "ttcode", "IMDb ttcode", "IMDb URL"], imdb_page),
         "program_type": (["program_type", "Release Type"], plain), "original_language": (["language_type", "Language Type"], language)},
    ),
    "movie-release-calendar": Profile("Movies", ["Title Name", "Title", "Movie", "Release"], {"network": (["Studio/Publisher", "Distributor"], plain), "released_on": _DAY, "genre": _GENRE, "metacritic": _METACRITIC, "imdb_id": _CODE}),
    "box-office": Profile("Movies", ["Title Name", "Title"], {"network": (["Distributor", "Studio/Publisher"], plain), "released_on": _DAY, "genre": _GENRE, "imdb_id": _CODE}),
    "upcoming-release-movies": Profile(
        "Movies", ["title", "Title", "Title Name"],
        {"imdb_id": (["imdb_url", "tt_code", "IMDb URL"], imdb_page), "released_on": (["release_date", "Release Date"], iso_day), "network": (["distributor_network", "Distributor"], distributor),
         "genre": (["genre", "Genre"], plain), "release_scale": (["release_scale", "Scale"], scale)},
    ),
    "game-release-calendar": Profile("Video Game", ["Title Name", "Title", "Game"], {"network": (["Studio/Publisher"], plain), "released_on": _DAY, "genre": _GENRE, "metacritic": _METACRITIC}),
    "twitch-streamers": Profile("Talent", ["channel", "Channel", "Streamer", "Name"], _SOCIAL | {"profession": (["channel", "Channel"], lambda c: F.when(_text(c) != "", "streamer").otherwise(""))}),
    "sephora-brands": Profile("Health & Beauty", _BRAND, _SOCIAL),
    "ulta-brands": Profile("Health & Beauty", _BRAND, _SOCIAL),
    "beauty-brands": Profile("Health & Beauty", _BRAND, {k: v for k, v in _SOCIAL.items() if k not in ("youtube_channel_username", "tiktok_user")}),
} | {slug: Profile("Sports Franchise", titles, _SOCIAL) for slug, titles in TEAMS.items()}
TRACKERS = {
    "billboard_artist_100": "billboard-artist-100", "tv": "tv-premiere-calendar", "tv_seasons": "tv-seasons", "movie": "movie-release-calendar", "game": "game-release-calendar",
    "boxoffice": "box-office", "boxoffice_recent_opening": "box-office", "release_schedule_changes": "movie-release-calendar",
}


def profile_for(tracker: str) -> Profile | None:
    """The profile of a tracker's rows; None where they are of several categories."""
    return PROFILES.get(TRACKERS.get(tracker.strip().lower(), ""))


def _candidates(df: DataFrame, names: list[str]) -> Column:
    """The first non-blank of the named columns, found without regard to case."""
    there = {c.strip().lower(): c for c in reversed(df.columns)}
    found = [c for n in names if (c := n if n in df.columns else there.get(n.strip().lower()))]
    return F.coalesce(*(F.nullif(_text(F.col(f"`{c}`")), F.lit("")) for c in found), F.lit(""))


def ingest_rows(df: DataFrame, profile: Profile, order: str | None = None) -> DataFrame:
    """Template rows: title, category, the profile's columns, a social column always. Rows without a title go; the owned row comes before its DAR twin."""
    place = [F.col(order)] if order else []
    base = F.trim(F.regexp_replace(_candidates(df, profile.titles), r"(?i)\s*-\s*DAR\s*$", ""))
    targets = {t: normal(_candidates(df, names)) for t, (names, normal) in profile.columns.items()}
    targets.setdefault(SOCIAL, F.lit(""))
    mapped = df.select(*place, base.alias(TITLE), F.lit(profile.category).alias(CATEGORY), *(c.alias(t) for t, c in targets.items())).filter(F.col(TITLE) != "")
    twin = F.concat(TITLE, F.lit(" - DAR"))
    titles = F.array(F.col(TITLE), twin) if profile.twin_mode() == "both" else F.array(twin)
    kept = ([order] if order else []) + ["twin"]
    return mapped.select(*([order] if order else []), F.posexplode(titles).alias("twin", "__t"), CATEGORY, *targets).select(*kept, F.col("__t").alias(TITLE), CATEGORY, *targets)
