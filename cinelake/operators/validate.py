"""Data-quality rules: which rules a row breaks are numbers; texts are only made for issues that are there, a row's in rule order."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinelake.functions import scoring
from cinelake.functions.dates import parse_date
from cinelake.functions.markers import holds_any
from cinelake.functions.text import (
    contains_either, dar_base, display, first_nonblank, imdb_code, is_blankish, is_dar, is_youtube, let, literals,
    shares_token, slug, social_handle, split_urls, split_values, squash, title_key, url_host, url_path,
)
from cinelake.operators.spread import spread

# Fixed values.
CORE_COLUMNS = ["title", "title_category", "title_sub_category", "genre", "primary_genre", "companies", "brand_set", "facebook_page"]
CATEGORIES = [
    "Airlines", "Automotive", "Car Rental", "Consumer Electronics", "CPG", "Health & Beauty", "Education", "Energy",
    "Venues, Events & Attractions", "Fashion", "Financial Services", "Food Products", "Health, Wellness, Fitness",
    "Hospital & Health Care", "Hospitality", "Insurance", "Internet Services", "IT, Internet, Computing", "Legal",
    "Government Entities", "Marketing, Advertising and Research", "Materials and Construction", "Media", "Movies",
    "Music and Entertainment", "TV Network", "Non-Profit/Charity/Philanthropy", "Pets", "Pet Foods & Pet Supplies",
    "Pharmaceuticals", "Radio", "Real Estate", "Restaurants", "Retail", "Beverages", "Sports Franchise",
    "Sports Organizations and Bodies", "Film Studio", "Supermarket, Grocery, Food & Convenience Stores", "Talent",
    "Tourism Boards", "Travel", "TV Shows", "Video Game", "Video Game Publishers", "Wireless and Telecom", "Publishers",
    "Podcasts", "Other", "Manufacturing & Infrastructure",
]
ALIASES = {
    "title": ["title", "title name", "name"],
    "title_category": ["title category", "category"],
    "title_sub_category": ["title sub category", "sub category", "subcategory"],
    "genre": ["genre", "genres"],
    "primary_genre": ["primary genre"],
    "companies": ["companies", "company"],
    "brand_set": ["brand set"],
    "facebook_page": ["facebook page", "facebook url", "facebook page url"],
    "release_date": ["release date", "start date", "air date"],
    "network": ["network", "network distributor", "availability / network", "availability network", "distributor"],
    "imdb_id": ["imdb id", "ttcode", "imdb ttcode"],
    "imdb_url": ["imdb url", "imdb link", "imdb title url", "imdb profile url"],
    "metacritic_url": ["metacritic url", "metacritic", "metacritic link"],
    "youtube_url": ["youtube url", "youtube", "trailer url"],
    "youtube_channel_username": ["youtube channel username", "youtube username", "youtube channel"],
    "youtube_channel_company": ["youtube channel company", "youtube company", "youtube channel company url"],
    "wikipedia_url": ["wikipedia url", "wikipedia", "wiki url", "wiki"],
    "twitter_search_terms": ["twitter search terms"],
    "twitter_search_term_keywords": ["twitter search term keywords", "twitter search keywords"],
    "url_managers": ["url managers", "url manager"],
    "instagram_account": ["instagram account", "instagram page", "instagram url", "instagram username"],
    "twitter_account": ["twitter account", "twitter page", "twitter url", "twitter username", "x twitter", "x/twitter", "x / twitter"],
    "tiktok_account": ["tiktok account", "tiktok page", "tiktok url", "tiktok username"],
    "threads_account": ["threads account", "thread account", "threads page", "thread page", "threads url", "thread url", "threads username", "thread username"],
}
GENRE_ALIASES = {"sci fi": "science fiction", "rom com": "romance", "doc": "documentary", "docs": "documentary"}
GENDER_TERMS = ["female", "male", "woman", "man", "women", "men", "non binary", "nonbinary"]
DAR_COMPANIES = ["Pristine Brand", "Pristine Talent", "Pristine Film"]
DAR_BRAND_SET, OTHER_BRAND_SET = "Pristine DAR Brands", "Competitive View"
BLOCKED_PATHS = ["/p/", "/php/", "/pages/"]
MANAGED = {"Facebook": "facebook_page", "YouTube": "youtube_channel_company", "Instagram": "instagram_account", "Twitter/X": "twitter_account", "TikTok": "tiktok_account", "Threads": "threads_account"}
UNMANAGED_COMPANIES = ["unknown", "pristine brand"]
SCREEN = ["Movies", "TV Shows"]

#: Columns that lookups may add to a row; rules that need one stay silent where it is null.
LOOKUPS = {
    "found_imdb": "string", "found_name": "string", "found_genres": "array<string>", "found_network": "string", "found_date": "date",
    "found_precision": "string", "found_source": "string", "found_metacritic": "string", "found_wikipedia": "string", "wikipedia_exists": "boolean",
    "channel_checks": "array<struct<value:string,state:string,note:string>>",
}


def logical_columns(df: DataFrame) -> DataFrame:
    """The logical columns by alias: of a row's alias columns the first non-blank value; columns no alias of which is there are null."""
    by_key: dict[str, str] = {}
    for c in df.columns:
        by_key.setdefault(c.replace("_", " ").strip().lower(), c)
    for c in [*by_key]:
        by_key.setdefault(" ".join(c.split()), by_key[c])
    found = {name: [by_key[a] for a in aliases if a in by_key] for name, aliases in ALIASES.items()}
    kept = [c for c in ("sheet", "row_no") if c in df.columns]
    extra = [F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in LOOKUPS.items()]
    return df.select(*kept, *(F.coalesce(*(first_nonblank(c) for c in cs), squash(cs[0])).alias(n) if cs else F.lit(None).cast("string").alias(n) for n, cs in found.items()), *extra)


def missing_columns(headers: list[str]) -> list[str]:
    """Core columns of which no alias is among a sheet's headers."""
    known = {" ".join(h.replace("_", " ").strip().lower().split()) for h in headers}
    return [c for c in CORE_COLUMNS if not known & set(ALIASES[c])]


def genre_key(c: Column) -> Column:
    key = title_key(c)
    return F.coalesce(_mapped(key, GENRE_ALIASES), key)


def _mapped(key: Column, table: dict[str, str]) -> Column:
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for a, b in table.items():
        out = out.when(key == a, b)
    return out


def canonical_category(c: Column | str) -> Column:
    """The approved category with the same key; empty if there is none."""
    # one array lookup instead of fifty comparisons
    at = F.array_position(literals([_plain_key(v) for v in CATEGORIES]), title_key(c))
    return F.coalesce(F.get(literals(CATEGORIES), (at - 1).cast("int")), F.lit(""))


def _plain_key(v: str) -> str:
    import re

    return " ".join(re.sub("[^a-z0-9]+", " ", v.lower().replace("&", " and ")).split())


def talent_complete(c: Column | str) -> Column:
    """A gender term somewhere, and words besides gender terms."""
    key = title_key(c)
    rest = F.regexp_replace(key, r"\b(" + "|".join(sorted(GENDER_TERMS, key=len, reverse=True)) + r")\b", " ")
    return holds_any(key, GENDER_TERMS) & (F.trim(rest) != "")


def _account(value: Column) -> Column:
    """An address without scheme and `www.`, or a name without `@`, in lower case."""
    host = url_host(value)
    return F.when(F.contains(host, F.lit(".")), F.concat(F.regexp_replace(host, r"^www\.", ""), F.lower(F.rtrim(url_path(value), F.lit("/"))))).otherwise(F.lower(F.ltrim(F.rtrim(F.trim(value), F.lit("/")), F.lit("@"))))


def unmanaged() -> Column:
    """`Kind: value, value | Kind: …` of the companies and accounts that url_managers does not name, by address or by handle."""
    of = lambda kind, values: F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))
    companies = F.filter(split_values("companies"), lambda v: ~is_blankish(v) & ~F.array_contains(literals(UNMANAGED_COMPANIES), title_key(v)))
    listed = F.concat(of("Companies", companies), *(of(kind, F.when(~blank(column), split_urls(column)).otherwise(F.array().cast("array<string>"))) for kind, column in MANAGED.items()))

    holds = lambda x: F.coalesce((x != "") & F.contains("managers", x), F.lit(False))

    def named(s: Column) -> Column:
        value = s["value"]
        return let(_account(value), holds) | let(F.when(value.rlike("^\\s*@|/"), social_handle(value)), holds)

    of_kind = lambda lacking: lambda k: F.concat(k, F.lit(": "), F.array_join(F.transform(F.filter(lacking, lambda s: s["kind"] == k), lambda s: s["value"]), ", "))
    texts = let(F.filter(listed, lambda s: ~named(s)), lambda lacking: F.transform(literals(["Companies", *MANAGED]), of_kind(lacking)))
    return F.array_join(F.filter(texts, lambda t: ~t.endswith(": ")), " | ")


def blank(name: str) -> Column:
    """Whether a logical column is blank, from the array that with_facts makes."""
    return F.col("blanks")[list(ALIASES).index(name)]


@dataclass(frozen=True)
class Issue:
    """What a rule says where it fires; texts that are not columns are the same for all rows."""

    rule: str
    column: str | Column
    level: str
    value: Column
    message: str
    suggestion: str | Column = ""


#: Rules of which a row gets the first that fires; None stays silent and ends the search.
Alternatives = list[tuple[Column, Issue | None]]


@dataclass(frozen=True)
class Each:
    """A rule for each value of an array: the alternatives for a value, which is the issue's own value where that is null."""

    values: Column
    alternatives: Callable[[Column], Alternatives]


def with_facts(logical: DataFrame) -> DataFrame:
    """What many rules ask of a row, once: which columns are blank, keys of titles and genres, codes."""
    first = logical.withColumns({
        "blanks": F.transform(F.array(*ALIASES), is_blankish), "category": canonical_category("title_category"), "dar": is_dar("title"), "base": dar_base("title"),
        "genres": F.transform(split_values("genre"), genre_key), "managers": F.array_join(F.transform(split_urls("url_managers"), _account), " "),
        **{f"{prefix}_{of}": imdb_code(f"imdb_{of}", prefix) for prefix in ("tt", "nm") for of in ("id", "url")},
        **{f"{site}_{part}": f(f"{site}_url") for site in ("metacritic", "wikipedia") for part, f in (("host", url_host), ("path", url_path))},
    })
    return first.withColumns({
        "title_name": title_key("title"), "base_key": title_key("base"), "screen": F.col("category").isin(SCREEN), "companies_key": title_key("companies"), "brands_key": title_key("brand_set"),
        "unmanaged": unmanaged(), "day": parse_date("release_date"),
    })


def row_rules() -> list[Alternatives | Each]:
    """All row rules in the order of their issues, over the columns of with_facts."""
    c = F.col
    kind, dar, screen = c("category"), c("dar"), c("screen")
    out: list[Alternatives | Each] = [
        [
            (blank("title"), Issue("Title required", "title", "error", c("title"), "The title is blank.", "Fill in the title; title rules wait for it.")),
            (dar & is_blankish("base"), Issue("DAR title required", "title", "error", c("title"), "Nothing but a placeholder stands before ` - DAR`.", "Put the real title before ` - DAR`.")),
        ],
        [
            (blank("title_category"), Issue("Approved category", "title_category", "error", c("title_category"), "The category is blank.", "Choose an approved category.")),
            (kind == "", Issue("Approved category", "title_category", "error", c("title_category"), "The category is not an approved one.", "Use one of: " + ", ".join(CATEGORIES))),
        ],
        [
            (blank("title_sub_category"), Issue("Sub-category required", "title_sub_category", "error", c("title_sub_category"), "The sub-category is blank.", "Add the most specific one.")),
            ((kind == "Talent") & ~talent_complete("title_sub_category"), Issue("Talent sub-category", "title_sub_category", "error", c("title_sub_category"), "A talent's sub-category needs a gender and a profession.", "For example `Female Actor`.")),
        ],
    ]
    # genres
    genres, found, in_genres = c("genres"), c("found_genres"), kind.isin("Media", *SCREEN)
    lacking = F.filter(found, lambda g: ~F.array_contains(genres, genre_key(g)))
    out += [
        [
            (in_genres & blank("genre"), Issue("Genre required", "genre", "error", c("genre"), "Media, Movies and TV Shows need a genre.", F.when(F.size(found) > 0, F.concat(F.lit("Suggested: "), F.array_join(found, ", "))).otherwise("Add the genre."))),
            (in_genres & (F.size(lacking) > 0), Issue("Genre completeness", "genre", "suggestion", c("genre"), "Some known genres are not listed.", F.concat(F.lit("Consider: "), F.array_join(lacking, ", ")))),
        ],
        [
            (~blank("genre") & blank("primary_genre"), Issue("Primary genre required", "primary_genre", "error", c("primary_genre"), "A genre without a primary one.", "Take the main value of genre.")),
            (~blank("genre") & ~F.array_contains(genres, genre_key(c("primary_genre"))), Issue("Primary genre consistency", "primary_genre", "suggestion", c("primary_genre"), "The primary genre is not among the genres.", "Choose one of them.")),
        ],
    ]
    # companies and brand sets
    holds = lambda key, value: F.contains(c(key), F.lit(_plain_key(value)))
    any_dar = holds("companies_key", DAR_COMPANIES[0]) | holds("companies_key", DAR_COMPANIES[1]) | holds("companies_key", DAR_COMPANIES[2])
    out += [
        [
            (dar & ~any_dar, Issue("DAR companies", "companies", "error", c("companies"), "A DAR title needs one of its companies.", "One of: " + ", ".join(DAR_COMPANIES))),
            (~dar & blank("companies"), Issue("Companies required", "companies", "error", c("companies"), "The companies are blank.", "Add the company.")),
        ],
        [
            (blank("brand_set"), Issue("Brand set required", "brand_set", "error", c("brand_set"), "The brand set is blank.", f"`{DAR_BRAND_SET}` for DAR titles, else `{OTHER_BRAND_SET}`.")),
            (dar & ~holds("brands_key", DAR_BRAND_SET), Issue("DAR brand set", "brand_set", "error", c("brand_set"), f"A DAR title needs `{DAR_BRAND_SET}`.", "Add it; others may stay.")),
            (~dar & ~holds("brands_key", OTHER_BRAND_SET), Issue("Competitive brand set", "brand_set", "error", c("brand_set"), f"The title needs `{OTHER_BRAND_SET}`.", "Add it.")),
        ],
    ]
    # one issue for each address of a cell
    blocked = lambda u: holds_any(F.lower(url_path(u)), BLOCKED_PATHS)
    out.append(
        Each(
            F.when(~blank("facebook_page"), split_urls("facebook_page")),
            lambda u: [
                (~F.contains(url_host(u), F.lit("facebook.com")), Issue("Facebook URL", "facebook_page", "error", c("facebook_page"), "Not a Facebook address.", "Use the official page or leave it blank.")),
                (blocked(u), Issue("Facebook URL path", "facebook_page", "error", c("facebook_page"), "The address has a post or pages path.", "Use the clean address of the page.")),
            ],
        )
    )
    # IMDb codes of titles and of people
    for who, prefix, here, needed, names in (
        ("screen", "tt", screen, c("found_imdb"), ("IMDb required", "IMDb format", "IMDb URL format", "IMDb consistency", "IMDb title.basics lookup")),
        ("talent", "nm", kind == "Talent", c("found_name"), ("IMDb name.basics lookup", "IMDb name format", "IMDb name URL format", "IMDb name consistency", "IMDb name.basics lookup")),
    ):
        by_id, by_url = c(f"{prefix}_id"), c(f"{prefix}_url")
        given = F.coalesce(F.nullif(by_id, F.lit("")), F.nullif(by_url, F.lit("")))
        nothing = blank("imdb_id") & blank("imdb_url")
        at_id = (by_id != "") | (~blank("imdb_id") & (by_url == ""))
        suggested = F.coalesce(F.concat(F.lit("Suggested: "), needed), F.lit("No suggestion was found."))
        fires_blank = nothing if who == "screen" else nothing & needed.isNotNull()
        level = "error" if who == "screen" else "suggestion"
        present = F.lit(True) if who == "screen" else (c("imdb_id").isNotNull() | c("imdb_url").isNotNull())
        out.append([
            (~(F.coalesce(here, F.lit(False)) & present), None),
            (fires_blank, Issue(names[0], "imdb_id", level, F.lit(""), "No IMDb code.", suggested)),
            (nothing, None),
            (~blank("imdb_id") & (by_id == ""), Issue(names[1], "imdb_id", "error", c("imdb_id"), f"No {prefix} code in imdb_id.", suggested)),
            (~blank("imdb_url") & (by_url == ""), Issue(names[2], "imdb_url", "error", c("imdb_url"), f"No {prefix} code in imdb_url.", suggested)),
            ((by_id != "") & (by_url != "") & (by_id != by_url), Issue(names[3], "imdb_url", "error", c("imdb_url"), "The two codes differ.", F.concat(F.lit("Use one for both: "), by_id))),
            (given != needed, Issue(names[4], F.when(at_id, "imdb_id").otherwise("imdb_url"), level, F.when(at_id, c("imdb_id")).otherwise(c("imdb_url")), "The code is not that of the lookup.", suggested)),
        ])
    # Metacritic
    page = F.regexp_extract("metacritic_path", r"(?i)/(?:movie|tv)/([^/]+)", 1)
    shown = F.coalesce("found_metacritic", F.concat(F.lit("https://www.metacritic.com/"), F.when(kind == "Movies", "movie/").otherwise("tv/"), slug("base"), F.lit("/")))
    same_page = F.lower(F.rtrim("metacritic_path", F.lit("/"))) == F.lower(F.rtrim(url_path(shown), F.lit("/")))
    hint = F.concat(F.lit("By title: "), shown)
    out.append([
        (~screen, None),
        (blank("metacritic_url"), Issue("Metacritic URL lookup", "metacritic_url", "suggestion", F.lit(""), "No Metacritic page.", hint)),
        (~c("metacritic_host").rlike(r"^(?:.*\.)?metacritic\.com$"), Issue("Metacritic URL format", "metacritic_url", "error", c("metacritic_url"), "Not a Metacritic address.", hint)),
        (page == "", Issue("Metacritic URL format", "metacritic_url", "error", c("metacritic_url"), "Not the page of a movie or show.", hint)),
        (~same_page & (scoring.key_score(c("base_key"), title_key(F.replace(page, F.lit("-"), F.lit(" ")))) < 60), Issue("Metacritic title match", "metacritic_url", "error", c("metacritic_url"), "The page's name is not the title.", hint)),
    ])
    # search terms and channels
    pair = F.split(c("youtube_url"), r"\|", 2)
    named = F.try_element_at(pair, F.lit(2))
    with_title = F.contains(c("youtube_url"), F.lit("|")) & is_youtube(pair[0]) & ~is_blankish(named)
    fits = with_title & (contains_either(c("title_name"), title_key(named)) | (c("title_name") == title_key(named)))
    plain = ~F.contains(c("youtube_url"), F.lit("|")) & F.forall(split_urls("youtube_url"), is_youtube)
    out += [
        [(screen & blank("twitter_search_terms"), Issue("Twitter terms required", "twitter_search_terms", "error", c("twitter_search_terms"), "Movies and TV Shows need search terms.", "Add the title and official names."))],
        [(screen & blank("twitter_search_term_keywords"), Issue("Twitter keywords required", "twitter_search_term_keywords", "error", c("twitter_search_term_keywords"), "Movies and TV Shows need keywords.", "Add names, hashtags, cast."))],
        [(~blank("youtube_url") & ~fits & ~plain, Issue("YouTube URL", "youtube_url", "error", c("youtube_url"), "Neither YouTube addresses nor `channel|title`.", "Use one of the two forms."))],
        [(~blank("youtube_channel_username") & F.contains(c("youtube_channel_username"), F.lit("%")), Issue("YouTube channel URL", "youtube_channel_username", "error", c("youtube_channel_username"), "An encoded address.", "Use the clean address or name."))],
        Each(
            c("channel_checks"),
            lambda x: [
                (x["state"] == "valid", None),
                (x["state"] == "failed", Issue("YouTube channel API verification", "youtube_channel_company", "suggestion", x["value"], "The channel could not be looked up.", x["note"])),
                (x["state"].isNotNull(), Issue("YouTube channel API verification", "youtube_channel_company", "error", x["value"], "There is no such channel.", x["note"])),
            ],
        ),
    ]
    # Wikipedia
    article = F.replace(F.try_url_decode(F.regexp_extract("wikipedia_path", "^/wiki/(.+)$", 1)), F.lit("_"), F.lit(" "))
    bare = title_key(F.regexp_replace(article, r"\s*\([^)]*\)$", ""))
    key_of = lambda path: F.lower(F.regexp_replace(F.coalesce(F.try_url_decode(path), F.lit("")), "[ _]+", "_"))
    out.append([
        (blank("wikipedia_url"), None),
        (~c("wikipedia_url").rlike("(?i)^https?://"), Issue("Wikipedia URL", "wikipedia_url", "error", c("wikipedia_url"), "Not a full address.", "Use an en.wikipedia.org article.")),
        (c("wikipedia_host") != "en.wikipedia.org", Issue("Wikipedia English URL", "wikipedia_url", "error", c("wikipedia_url"), "Not the English Wikipedia.", "Use the en.wikipedia.org article.")),
        (F.coalesce(article, F.lit("")) == "", Issue("Wikipedia article URL", "wikipedia_url", "error", c("wikipedia_url"), "Not an article under /wiki/.", "Use the article's address.")),
        (c("found_wikipedia").isNotNull() & (key_of("wikipedia_path") != key_of(url_path("found_wikipedia"))), Issue("Wikidata Wikipedia URL match", "wikipedia_url", "error", c("wikipedia_url"), "Not the article that Wikidata names.", F.concat(F.lit("Use "), c("found_wikipedia")))),
        (c("found_wikipedia").isNotNull(), None),
        (~((bare == c("base_key")) | contains_either(bare, c("base_key"))), Issue("Wikipedia title match", "wikipedia_url", "error", c("wikipedia_url"), "The article's name is not the title.", "Use the title's article.")),
        (~c("wikipedia_exists"), Issue("Wikipedia page verification", "wikipedia_url", "error", c("wikipedia_url"), "The page could not be read.", "Check that it exists.")),
    ])
    # accounts that url_managers should name
    out.append([(c("unmanaged") != "", Issue("URL managers completeness", "url_managers", "error", c("url_managers"), "Accounts of this row are not among its managers.", F.concat(F.lit("Add: "), "unmanaged")))])
    # release date and network against the lookup
    day, known = c("day"), c("found_date")
    year_only = c("found_precision") == "year"
    shown_day = F.coalesce(day.cast("string"), F.lit(""))
    told = F.coalesce("found_network", F.lit("")) != ""
    out += [
        [
            (year_only & known.isNotNull() & (F.year(day) != F.year(known)), Issue("IMDb release date", "release_date", "error", shown_day, "The year is not the lookup's.", F.concat(F.lit("Start year: "), F.year(known).cast("string")))),
            (year_only & known.isNotNull() & day.isNull(), Issue("IMDb release date", "release_date", "suggestion", F.lit(""), "The lookup has a start year.", F.concat(F.lit("Start year: "), F.year(known).cast("string")))),
            (year_only, None),
            (day != known, Issue("IMDb release date", "release_date", "error", shown_day, "The date is not the lookup's.", F.concat(F.lit("Use "), known.cast("string")))),
            (known.isNotNull() & day.isNull(), Issue("IMDb release date", "release_date", "error", F.lit(""), "The lookup has a date.", F.concat(F.lit("Use "), known.cast("string")))),
        ],
        [
            (told & ~blank("network") & ~shares_token("network", "found_network"), Issue("IMDb network/distributor", "network", "suggestion", c("network"), "The lookup has another network.", F.concat(F.lit("Suggested: "), c("found_network")))),
            (told & blank("network"), Issue("IMDb network/distributor", "network", "suggestion", F.lit(""), "The lookup has a network.", F.concat(F.lit("Suggested: "), c("found_network")))),
        ],
    ]
    return out


def first_of(alternatives: Alternatives, number: int) -> Column:
    """The number of the alternative that fires first, counted from `number`; null if none does or a silent one comes first."""
    out, at = None, number
    for fires, found in alternatives:
        value = F.lit(None).cast("int") if found is None else F.lit(at)
        out = F.when(fires, value) if out is None else out.when(fires, value)
        at += found is not None
    return out


def _spoken(alternatives: Alternatives) -> list[Issue]:
    return [found for _, found in alternatives if found is not None]


def _chosen(number: Column, by_number: list[str | Column]) -> Column:
    """Of texts and columns by number: texts are one constant, of the columns one branch is computed."""
    texts = F.get(literals([t if isinstance(t, str) else "" for t in by_number]), number)
    made = [(i, t) for i, t in enumerate(by_number) if not isinstance(t, str)]
    if not made:
        return texts
    out = F.when(number == made[0][0], F.coalesce(made[0][1], F.lit("")))
    for i, text in made[1:]:
        out = out.when(number == i, F.coalesce(text, F.lit("")))
    return out.otherwise(texts)


def report(rows: DataFrame, rules: Callable[[], list[Alternatives | Each]] = row_rules) -> DataFrame:
    """(sheet, row_no, title, issue_no, rule, column, level, value, message, suggestion): all issues of all rows, in rule order; the first two where the rows have them.

    What a row breaks is an array of rule numbers, with a place for rules of arrays; only then is a
    row exploded, and only an issue that is there gets its texts. Rows are dealt over all cores as they
    came in; nothing else is shuffled.
    """
    facts = with_facts(logical_columns(spread(rows)))
    single, placed, issues = [], [], []
    for group in rules():
        at = len(issues)
        if isinstance(group, Each):
            found = F.transform(group.values, lambda v, i: F.struct(first_of(group.alternatives(v), at).alias("rule_no"), i.alias("place")))  # noqa: B023
            placed.append(F.coalesce(F.filter(found, lambda s: s["rule_no"].isNotNull()), F.array().cast("array<struct<rule_no:int,place:int>>")))
            issues += _spoken(group.alternatives(F.get(group.values, F.col("place"))))
        else:
            single.append(first_of(group, at))
            issues += _spoken(group)
    broken = F.transform(F.array_compact(F.array(*single)), lambda n: F.struct(n.alias("rule_no"), F.lit(0).alias("place")))
    # outer: for an inner explode Spark would compute all rules a second time, to drop rows that break none
    found = facts.select("*", F.posexplode_outer(F.array_sort(F.concat(broken, *placed))).alias("issue_no", "__i")).filter("__i is not null").withColumns({"rule_no": F.col("__i.rule_no"), "place": F.col("__i.place")})
    keys = [c for c in ("sheet", "row_no") if c in rows.columns]
    parts = (_chosen(F.col("rule_no"), [getattr(i, name) for i in issues]).alias(name) for name in ("rule", "column", "level", "value", "message", "suggestion"))
    return found.select(*keys, display("title").alias("title"), "issue_no", *parts)


def issue_counts(issues: DataFrame, *by: str) -> DataFrame:
    return issues.groupBy(*by).agg(F.count_if(F.col("level") == "error").alias("errors"), F.count_if(F.col("level") == "suggestion").alias("suggestions"))
