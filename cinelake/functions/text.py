"""Text keys, cleaners, extractors and predicates."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
BLANKISH = ["", "#na", "#n/a", "n/a", "na", "nan", "none", "null"]
NEW_ENTRY_MARKS = ["-", "", "—", "–", "--"]
NUMBER_WORDS = ["one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen", "twenty"]


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def literals(values: list[str]) -> Column:
    """An array of fixed texts as one constant: a plan with a literal for each takes far longer to build."""
    return F.split(F.lit("\x1f".join(values)), "\x1f")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """What `use` makes of a value that is computed once a row; lambdas would else compute it again for each element that they see."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def squash(c: Column | str) -> Column:
    """White space of any script runs together to one space; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(col(c).cast("string"), F.lit("")), r"(?U)\s+", " "))


def title_key(c: Column | str) -> Column:
    r"""Lookup key of a title: lower case, `&` is `and`, bracketed parts go, the rest is words of a-z and 0-9. `\N` is empty."""
    text = F.lower(squash(F.when(col(c) == r"\N", "").otherwise(col(c))))
    text = F.regexp_replace(text, "&", " and ")
    text = F.regexp_replace(text, r"\[[^\]]+\]|\([^)]*\)", " ")
    return F.trim(F.regexp_replace(text, "[^a-z0-9]+", " "))


def box_office_key(c: Column | str) -> Column:
    """Key of a title in box-office listings: brackets' contents stay."""
    return F.trim(F.regexp_replace(F.lower(squash(c)), "[^a-z0-9]+", " "))


def header_key(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.trim(F.regexp_replace(F.coalesce(col(c), F.lit("")), "_", " "))), r"(?U)\s+", " "))


def display(c: Column | str) -> Column:
    """A cell as shown: dates in ISO form, numbers 0 and false blank, white space squashed."""
    text = col(c).cast("string")
    return squash(F.when(text.isin("0", "0.0", "false"), "").otherwise(text)) if not isinstance(c, str) else squash(text)


def is_blankish(c: Column | str) -> Column:
    return F.array_contains(literals(BLANKISH), F.replace(F.lower(squash(c)), F.lit(" "), F.lit("")))


def first_nonblank(*columns: Column | str) -> Column:
    """The first value that isn't blankish, squashed; null if there is none."""
    return F.coalesce(*(F.when(~is_blankish(c), squash(c)) for c in columns))


def first_text(*columns: Column | str) -> Column:
    """The first value that isn't empty after squashing; empty if there is none."""
    return F.coalesce(*(F.nullif(squash(c), F.lit("")) for c in columns), F.lit(""))


def join_nonblank(separator: str, *columns: Column | str) -> Column:
    return F.concat_ws(separator, *(F.nullif(squash(c), F.lit("")) for c in columns))


def split_values(c: Column | str, pattern: str = r"[,;/|]+") -> Column:
    """Trimmed, non-empty values of a cell."""
    return F.filter(F.transform(F.split(F.coalesce(col(c), F.lit("")), pattern), lambda x: F.trim(x)), lambda x: x != "")


def split_urls(c: Column | str) -> Column:
    return split_values(c, r"[\n;,]+")


def distinct_by_key(values: Column, key=F.lower) -> Column:
    """Array order kept, the first value of each key."""
    keep = lambda x, i: F.array_position(F.transform(values, key), key(x)) == i + 1
    return F.filter(values, keep)


def imdb_code(c: Column | str, prefix: str = "tt|nm") -> Column:
    return F.lower(F.regexp_extract(F.coalesce(col(c), F.lit("")), rf"(?i)\b(?:{prefix})\d{{7,12}}\b", 0))


def money(c: Column | str) -> Column:
    return F.regexp_extract(F.coalesce(col(c), F.lit("")), r"\$[\d,]+(?:\.\d+)?", 0)


def theaters(c: Column | str) -> Column:
    return F.regexp_extract(F.coalesce(col(c), F.lit("")), r"(?i)([\d,]+)\s*theaters?", 1)


def runtime(c: Column | str) -> Column:
    """`1 hr 45 min` and its parts, as written."""
    return F.regexp_extract(F.coalesce(col(c), F.lit("")), r"(?i)\b(?:\d+\s*hr(?:\s*\d+\s*min)?|\d+\s*min)\b", 0)


def release_id(c: Column | str) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(col(c), F.lit("")), r"(?i)/release/(rl\d+)", 1))


def year_text(c: Column | str, centuries: str = "19|20") -> Column:
    return F.regexp_extract(F.coalesce(col(c).cast("string"), F.lit("")), rf"\b((?:{centuries})\d{{2}})\b", 1)


def safe_int(c: Column | str) -> Column:
    return F.expr("try_cast(null as int)") if c is None else col(c).try_cast("int")


def number_word(c: Column | str) -> Column:
    """`three` or `3` as an integer."""
    word = F.lower(F.trim(col(c)))
    return F.coalesce(word.try_cast("int"), F.nullif(F.array_position(F.array(*map(F.lit, NUMBER_WORDS)), word).cast("int"), F.lit(0)))


def episode_count(c: Column | str) -> Column:
    """The largest `N episodes` of a text, N a number or a word."""
    words = "|".join(NUMBER_WORDS)
    found = F.regexp_extract_all(F.lower(F.coalesce(col(c), F.lit(""))), F.lit(rf"\b(\d{{1,3}}|{words})[\s-]+(?:new\s+)?episodes?\b"), F.lit(1))
    return F.array_max(F.transform(found, number_word))


def contains_either(a: Column, b: Column) -> Column:
    """One key holds the other; blank ones hold nothing."""
    return (a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a))


def holds_value(c: Column | str, value: str) -> Column:
    """The key of a text holds that of a fixed value."""
    return F.contains(title_key(c), title_key(F.lit(value)))


def holds_values(c: Column | str, values: list[str]) -> Column:
    """The key of a text holds that of any of fixed values."""
    key = title_key(c)
    return F.exists(F.transform(literals(values), title_key), lambda v: F.contains(key, v))


def tokens(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(c, " "), lambda x: x != ""))


def shares_token(a: Column | str, b: Column | str) -> Column:
    return F.coalesce(F.arrays_overlap(tokens(title_key(a)), tokens(title_key(b))), F.lit(False))


def slug(c: Column | str) -> Column:
    text = F.regexp_replace(F.regexp_replace(F.lower(squash(c)), "&", " and "), "['’]", "")
    return F.trim(F.regexp_replace(text, "[^a-z0-9]+", "-"), F.lit("-"))


def titleize(c: Column | str) -> Column:
    return F.initcap(F.replace(F.coalesce(col(c), F.lit("")), F.lit("_"), F.lit(" ")))


def is_dar(c: Column | str) -> Column:
    return F.coalesce(col(c), F.lit("")).rlike(r"(?i)\s-\s*dar\s*$")


def dar_base(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(col(c), F.lit("")), r"(?i)\s-\s*dar\s*$", ""))


def is_new_entry(c: Column | str) -> Column:
    return F.trim(F.coalesce(col(c), F.lit(""))).isin(NEW_ENTRY_MARKS)


# URLs


def with_scheme(c: Column | str) -> Column:
    text = F.trim(F.coalesce(col(c), F.lit("")))
    return F.when(text.rlike(r"(?i)^[a-z][a-z0-9+.-]*://"), text).otherwise(F.concat(F.lit("https://"), text))


def url_host(c: Column | str) -> Column:
    return F.lower(F.coalesce(F.try_parse_url(with_scheme(c), F.lit("HOST")), F.lit("")))


def url_path(c: Column | str) -> Column:
    return F.coalesce(F.try_parse_url(with_scheme(c), F.lit("PATH")), F.lit(""))


def last_segment(c: Column | str) -> Column:
    return F.coalesce(F.try_element_at(F.filter(F.split(url_path(c), "/"), lambda x: x != ""), F.lit(-1)), F.lit(""))


def host_is(c: Column | str, *domains: str) -> Column:
    """The address is one of a domain or of a part of it."""
    return url_host(c).rlike(rf"^(?:.*\.)?(?:{'|'.join(d.replace('.', chr(92) + '.') for d in domains)})$")


def is_youtube(c: Column | str) -> Column:
    return host_is(c, "youtube.com", "youtu.be")


def social_handle(c: Column | str) -> Column:
    """The account of a profile URL or `@name`."""
    text = F.trim(F.coalesce(col(c), F.lit("")))
    return F.lower(F.ltrim(F.when(text.rlike(r"(?i)^https?://|/"), last_segment(text)).otherwise(text), F.lit("@")))


def channel_reference(c: Column | str) -> Column:
    """(kind, value) of a channel: id, handle, user, or search; invalid where nothing fits."""
    text = F.trim(F.coalesce(col(c), F.lit("")))
    path = url_path(text)
    part = lambda pattern: F.regexp_extract(path, pattern, 1)
    pair = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    return (
        F.when(text == "", pair("invalid", F.lit("")))
        .when(is_youtube(text) & (part(r"^/channel/([^/]+)") != ""), pair("id", part(r"^/channel/([^/]+)")))
        .when(is_youtube(text) & (part(r"^/@([^/]+)") != ""), pair("handle", part(r"^/@([^/]+)")))
        .when(is_youtube(text) & (part(r"^/user/([^/]+)") != ""), pair("user", part(r"^/user/([^/]+)")))
        .when(is_youtube(text) & (part(r"^/c/([^/]+)") != ""), pair("search", part(r"^/c/([^/]+)")))
        .when(text.startswith("@"), pair("handle", F.ltrim(text, F.lit("@"))))
        .when(text.rlike(r"^UC[A-Za-z0-9_-]{22}$"), pair("id", text))
        .when(text.rlike(r"(?i)^https?://"), pair("invalid", text))
        .otherwise(pair("search", text))
    )


def release_identity(url: Column | str, title: Column | str) -> Column:
    """The path of a release page, or else the title's key."""
    path = url_path(url)
    return F.when(F.contains(path, F.lit("/release/")), F.rtrim(path, F.lit("/"))).otherwise(box_office_key(title))


# Letters with marks up to U+024F and the letter that they are without, by Unicode's decompositions.
_MARKED = {chr(c): base for c in range(0xC0, 0x250) if (base := unicodedata.normalize("NFKD", chr(c)).encode("ascii", "ignore").decode()) and len(base) == 1}


def ascii_slug(c: Column | str) -> Column:
    """A title in lower-case ASCII words joined by dashes: letters lose their marks, what has no ASCII letter goes."""
    plain = F.regexp_replace(F.translate(F.replace(squash(c), F.lit("&"), F.lit(" and ")), "".join(_MARKED), "".join(_MARKED.values())), r"[^\x00-\x7F]", "")
    return F.trim(F.regexp_replace(F.lower(plain), "[^a-z0-9]+", "-"), F.lit("-"))


def safe_filename(c: Column | str, suffix: str) -> Column:
    """A name for a file: letters, digits, dashes, dots and underscores, 90 characters at most; others become one dash."""
    name = F.substring(F.trim(F.regexp_replace(F.trim(col(c)), r"[^A-Za-z0-9._-]+", "-"), F.lit("-")), 1, 90)
    return F.concat(F.coalesce(F.nullif(name, F.lit("")), F.lit("export")), F.lit("." + suffix))


def safe_sheet_title(c: Column | str) -> Column:
    """A name for a sheet: without the signs that workbooks forbid, 31 characters at most."""
    name = F.trim(F.regexp_replace(F.coalesce(col(c), F.lit("")), r"[\[\]:*?/\\\\]", " "))
    return F.substring(F.coalesce(F.nullif(name, F.lit("")), F.lit("Sheet")), 1, 31)


def validated_filename(c: Column | str) -> Column:
    """The name of a validated workbook after that of its upload."""
    default = F.lit("validated_workbook")
    stem = F.coalesce(F.nullif(F.trim(F.regexp_replace(F.coalesce(col(c), F.lit("")), r"\.[^.]*$", "")), F.lit("")), default)
    return F.concat(F.coalesce(F.nullif(F.trim(F.regexp_replace(stem, "[^A-Za-z0-9_. -]+", "_"), F.lit(" ._")), F.lit("")), default), F.lit("_validated.xlsx"))
