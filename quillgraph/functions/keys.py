"""Tidy forms of DOIs and repository addresses, as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillgraph.functions.codehost import let

# Opening and closing punctuation, and resolver hosts.
OPENING = "<(\\[{\"'`“”‘’«"
CLOSING = ".,;:!?)\\]}>\"'`“”’»/"
RESOLVERS = "(?:dx\\.|www\\.)?doi\\.(?:example|org)"

_ENCLOSED = f"[{OPENING}]|/"
_DOI = f"(?s)^(?:{_ENCLOSED}|https?:|{RESOLVERS}/|doi[:.]?|:)*(10\\.[0-9]+(?:\\.[0-9]+)*/.*)$"
_REPO_HEAD = f"^(?:{_ENCLOSED}|https?:|git:|www\\.)+"
_TAIL = f"[{CLOSING}]+$"


def bare(col: Column) -> Column:
    """Lower case, without white space and invisible characters of any kind."""
    return F.lower(F.regexp_replace(col, "[\\s\\p{Z}\\p{C}]+", ""))


def _doi_of(s: Column) -> Column:
    """The DOI in a bare value, empty if it names none."""
    return F.regexp_replace(F.regexp_replace(F.regexp_extract(s, _DOI, 1), "/{2,}", "/"), _TAIL, "")


def _repository_of(s: Column) -> Column:
    path = F.regexp_replace(F.regexp_replace(s, _REPO_HEAD, ""), "/{2,}", "/")
    return F.regexp_replace(F.regexp_replace(path, _TAIL, ""), "(?:\\.git)?/*$", "")


def _filled(s: Column) -> Column:
    return F.when(s != "", s)


def tidy_doi(col: Column) -> Column:
    """The DOI a value names, in lower case: no blanks, resolver address, `doi` prefix, enclosing or
    trailing punctuation, repeated slashes. Null if the value is null, blank or names no DOI."""
    return let(_doi_of(bare(col)), _filled)


def tidy_repository(col: Column) -> Column:
    """host/owner/name in lower case: no blanks, scheme, `www.`, enclosing or trailing punctuation,
    repeated slashes, final `.git`. Null if the value is null or blank."""
    return let(_repository_of(bare(col)), _filled)


def tidy_reference(col: Column) -> Column:
    """`doi:…` for a value that names a DOI, else `repo:…`; null for missing and blank values. Every
    step of the tidying stands once in the expression, and the address is only tidied where no DOI is found."""

    def named(s: Column) -> Column:
        repository = let(_repository_of(s), lambda r: F.when(r != "", F.concat(F.lit("repo:"), r)))
        return let(_doi_of(s), lambda d: F.when(d != "", F.concat(F.lit("doi:"), d)).otherwise(repository))

    return let(bare(col), named)
