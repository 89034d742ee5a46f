"""Text, date and number functions of the reports (F-05 to F-21)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Prefixes of identifiers.
DOI_URL, ARXIV_DOI = "https://doi.org/", "10.48550/arxiv."


def strip(col: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(col, "(?U)^\\s+|\\s+$", "")


def doi_url(doi: Column) -> Column:
    """Lower case, with the resolver in front unless it is there."""
    low = F.lower(doi)
    return F.when(low.startswith(DOI_URL), low).otherwise(F.concat(F.lit(DOI_URL), low))


def lookup_id(doi: Column) -> Column:
    """`arxiv:…` for DOIs of that archive, else the DOI."""
    low = F.lower(doi)
    return F.when(low.contains("arxiv"), F.concat(F.lit("arxiv:"), F.substring_index(low, "arxiv.", -1))).otherwise(doi)


def text_of_index(index: Column) -> Column:
    """The text of an inverted index map<word, array<position>>: words by position, gaps ignored, no length cap.

    Null stays null; an empty map gives an empty text.
    """
    placed = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("at"), e["key"].alias("word")))))
    return F.array_join(F.transform(F.array_sort(placed), lambda x: x["word"]), " ")


def index_of_text(text: Column) -> Column:
    """Inverted index of a text split at single blanks."""
    words = F.transform(F.split(text, " "), lambda w, i: F.struct(w.alias("word"), i.alias("at")))
    keys = F.array_distinct(F.transform(words, lambda x: x["word"]))
    return F.map_from_entries(F.transform(keys, lambda k: F.struct(k, F.transform(F.filter(words, lambda x: x["word"] == k), lambda x: x["at"]))))


def decoded(content: Column) -> Column:
    """UTF-8 text of base64; null where it can't be decoded."""
    raw = F.try_to_binary(F.regexp_replace(content, "\\s+", ""), F.lit("base64"))
    return F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string"))


def parsed_fields(col: Column) -> Column:
    """Map of a text `key: value;` per line; the value `None` becomes null."""
    pairs = F.str_to_map(F.regexp_replace(strip(col), ";\\s*\\n\\s*|;\\s*$", "\u0001"), F.lit("\u0001"), F.lit(":"))
    entries = F.filter(F.map_entries(pairs), lambda e: F.trim(e["key"]) != "")
    return F.map_from_entries(F.transform(entries, lambda e: F.struct(F.trim(e["key"]), F.nullif(F.trim(e["value"]), F.lit("None")))))


def mean_std(mean: Column, std: Column, digits: int = 1) -> Column:
    return F.concat(F.format_number(mean, digits), F.lit(" ± "), F.format_number(std, digits))


def percent(share: Column, digits: int = 1) -> Column:
    return F.concat(F.format_number(share * 100, digits), F.lit("%"))


def stars(p: Column) -> Column:
    """Significance at .05, .01 and .001."""
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")


def days_between(start: Column, end: Column) -> Column:
    """Whole days from start to end, rounded towards minus infinity."""
    micros = F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))
    return F.floor(micros / F.lit(86_400_000_000))


def years(days: Column) -> Column:
    return days / 365.25


def commits_url(owner: Column, name: Column, username: Column, host: str = "https://github.com") -> Column:
    return F.concat(F.concat_ws("/", F.lit(host), owner, name), F.lit("/commits?author="), username)


def titled(name: Column) -> Column:
    """Column-like name as a title."""
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))


def title_text(name: str) -> str:
    """A column name as a title: blanks for underscores, each word with a capital."""
    return " ".join(w[:1].upper() + w[1:] for w in name.replace("_", " ").split(" "))


def relisted(col: Column, old: str, new: str) -> Column:
    """A list in a text with another delimiter."""
    return F.array_join(F.transform(F.split(col, "\\Q" + old + "\\E"), lambda w: F.trim(w)), new)


def id_or_new(col: Column) -> Column:
    """The id, or a new one where there is none."""
    return F.coalesce(col, F.uuid())
