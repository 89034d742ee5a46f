"""Names, handles and addresses of people as native expressions: words, index terms, what they say of a person."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillgraph.functions.codehost import let

# Letters that no decomposition reaches, digits standing for letters, titles.
LETTERS = {"ø": "o", "ł": "l", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe", "þ": "th", "ð": "d", "ı": "i"}
DIGITS = ("013457", "oieast")
TITLES = "\\b(?:dr|prof|phd|msc)\\b\\.?"
#: An attribute of more words than this is a sentence; it says nothing.
MOST_WORDS = 12
#: Surnames of fewer letters can't be misspelt: too many words are near them.
LEAST_SLIP = 5
# What an attribute says of a person: CONFLICT, nothing, one of the names, initial and surname, both names.
CONFLICT, NOTHING, ONE, INITIAL, FULL = -1, 0, 1, 2, 3


@lru_cache
def _base_letters() -> tuple[str, str]:
    """Letters with accents, of full width or of other fonts, and the one letter each is without them, by the Unicode tables."""
    found = {}
    for c in map(chr, [*range(0x80, 0x3000), *range(0xFB00, 0xFFF0)]):
        plain = "".join(x for x in unicodedata.normalize("NFKD", c.lower()) if not unicodedata.combining(x))
        if len(plain) == 1 and plain != c:
            found[c] = plain
    found |= {a: b for a, b in LETTERS.items() if len(b) == 1}
    return "".join(found), "".join(found.values())


def plain(text: Column) -> Column:
    """Lower case without accents; null as the empty text."""
    s = F.translate(F.lower(F.coalesce(text, F.lit(""))), *_base_letters())
    for a, b in LETTERS.items():
        if len(b) > 1:
            s = F.replace(s, F.lit(a), F.lit(b))
    return F.regexp_replace(s, "\\p{M}+", "")


def _words(s: Column) -> Column:
    return F.regexp_extract_all(s, F.lit("[a-z]+"), F.lit(0))


def _turned(s: Column) -> Column:
    """`surname, given` as `given surname`."""
    at = F.instr(s, ",")
    return F.when(at > 0, F.concat(F.substr(s, at + 1), F.lit(" "), F.substr(s, F.lit(1), at - 1))).otherwise(s)


def person(name: Column) -> Column:
    """struct<given, last> of a person: given name or its initial, surname; either may be empty."""
    none = F.lit("")
    return let(_words(let(plain(name), _turned)), lambda t: F.struct(
        F.when(F.size(t) > 1, t[0]).otherwise(none).alias("given"), F.when(F.size(t) > 0, F.element_at(t, -1)).otherwise(none).alias("last"),
    ))


def _bounded(words: Column) -> Column:
    return let(words, lambda w: F.when(F.size(w) <= MOST_WORDS, w).otherwise(F.slice(w, 1, 0)))


def handle_parts(s: Column) -> Column:
    """Words of a plain user name or local part of an address; digits at its ends go, others are read as letters."""
    s = F.regexp_replace(F.trim(s), "[0-9]+$|^[0-9]+(?=[a-z])(?![a-z][0-9])", "")
    return _bounded(_words(F.translate(s, *DIGITS)))


def has_digits(name: Column) -> Column:
    """A name with digits is a handle that stands in the wrong field."""
    return F.coalesce(name.rlike("[0-9]"), F.lit(False))


def name_parts(name: Column) -> Column:
    """Words of an account's name, given name first; what stands in brackets or behind a bar is left out."""
    def parts(s: Column) -> Column:
        words = _bounded(_words(let(F.regexp_replace(F.regexp_replace(s, TITLES, " "), "^[ ,]+|[ ,]+$", ""), _turned)))
        return F.when(s.rlike("[0-9]"), handle_parts(s)).otherwise(words)

    return let(F.regexp_replace(plain(name), "(?s)\\(.*?\\)|\\|.*", " "), parts)


def mail_parts(mail: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(plain(mail), "\\s*\\[dot\\]\\s*", "."), "\\s*\\[at\\]\\s*", "@")
    local = let(s, lambda x: F.when(F.instr(x, "@") > 0, F.substring_index(x, "@", 1)).otherwise(F.lit("")))
    return let(F.regexp_replace(local, "^[0-9]+\\+", ""), handle_parts)


def _first(word: Column) -> Column:
    return F.substring(word, 1, 1)


def _less(word: Column) -> Column:
    """The word and every form with one letter left out: two words of one slip of the pen share one of these."""
    cut = F.transform(F.sequence(F.lit(1), F.greatest(F.length(word), F.lit(1))), lambda i: F.concat(F.substr(word, F.lit(1), i - 1), F.substr(word, i + 1)))
    return F.when(F.length(word) >= LEAST_SLIP, F.concat(F.array(word), cut)).otherwise(F.array(word))


def person_terms(given: Column, last: Column) -> Column:
    """Index terms of a person: both names (n:), joined in either order, whole or as initial (k:), and initial with
    each form of the surname that lacks one letter (e:)."""
    g = _first(given)
    n = F.when(F.length(given) > 1, F.array(F.concat(F.lit("n:"), last), F.concat(F.lit("n:"), given))).otherwise(F.array(F.concat(F.lit("n:"), last)))
    k = F.array(*(F.concat(F.lit("k:"), a, b) for a, b in ((given, last), (last, given), (g, last), (last, g))))
    e = F.transform(_less(last), lambda w: F.concat(F.lit("e:"), g, F.lit("|"), w))
    return F.array_distinct(F.when(given != "", F.concat(n, k, e)).otherwise(n))


def attribute_terms(parts: Column, slips: bool = False) -> Column:
    """Query terms of one attribute; with `slips`, also those for a misspelt surname."""
    n = F.transform(F.filter(parts, lambda p: F.length(p) > 1), lambda p: F.concat(F.lit("n:"), p))
    alone = F.when((F.size(parts) == 1) & (F.length(parts[0]) > 3), F.array(F.concat(F.lit("k:"), F.get(parts, F.lit(0))))).otherwise(F.slice(n, 1, 0))

    def of_two(x: Column, y: Column) -> Column:
        k = F.concat(F.array(F.concat(F.lit("k:"), x, y), F.concat(F.lit("k:"), _first(x), y), F.concat(F.lit("k:"), x, _first(y))))
        if not slips:
            return k
        e = lambda a, b: F.transform(F.when(F.length(b) >= LEAST_SLIP, _less(b)).otherwise(F.slice(_less(b), 1, 0)), lambda w: F.concat(F.lit("e:"), _first(a), F.lit("|"), w))
        return F.concat(k, e(x, y), e(y, x))

    def with_later(x: Column, i: Column) -> Column:
        later = F.filter(F.slice(parts, i + 2, F.lit(MOST_WORDS)), lambda y: F.length(x) + F.length(y) > 2)
        return F.filter(F.flatten(F.transform(later, lambda y: of_two(x, y))), lambda t: F.length(t) > 4)

    return F.concat(n, alone, F.flatten(F.transform(parts, with_later)))


def cross_terms(words: Column, handles: Column) -> Column:
    """Query terms of a name that is one word, with each word of the handles as the surname to it."""
    def joined(whole: Column) -> Column:
        both = F.transform(handles, lambda p: F.concat(F.lit("k:"), F.get(whole, F.lit(0)), p))
        return F.when((F.size(whole) == 1) & (F.size(words) <= 2), both).otherwise(F.slice(handles, 1, 0))

    return let(F.filter(words, lambda p: F.length(p) > 1), joined)


def near(a: Column, b: Column) -> Column:
    """Equal, or one slip apart (a letter more, less or other, or two swapped) in words of LEAST_SLIP letters or more."""
    d = F.levenshtein(a, b, 2)
    letters = lambda w: F.array_sort(F.split(w, ""))
    swapped = (d == 2) & (F.length(a) == F.length(b)) & (letters(a) == letters(b))
    return (a == b) | (F.least(F.length(a), F.length(b)) >= LEAST_SLIP) & ((d == 1) | swapped)


def says(parts: Column, given: Column, last: Column, prose: Column) -> Column:
    """What the words of one attribute say about being the person (given, last). `prose`: it is a name,
    so words that aren't the person's are another's; a handle may be anything."""
    g, whole = _first(given), F.length(given) > 1
    both = F.when(whole, FULL).otherwise(INITIAL)

    def one(p: Column) -> Column:
        more = F.length(p) == F.length(last) + 1
        held = p.endswith(last) & p.startswith(given) | p.startswith(last) & (F.substr(p, F.length(last) + 1, F.lit(1)) == given)
        return (
            F.when((given != "") & ((p == F.concat(given, last)) | (p == F.concat(last, given))), both)
            .when((given != "") & ((p == F.concat(g, last)) | (p == F.concat(last, g))), INITIAL)
            .when((p == last) | (p == given) & whole, ONE)
            .when(F.length(p) == 1, F.when(prose & (p != g) & (p != _first(last)), CONFLICT).otherwise(NOTHING))
            .when(more & (p.endswith(last) | p.startswith(last)), CONFLICT)
            .when((F.length(given) == 1) & held, INITIAL)
            .otherwise(F.when(prose & whole, CONFLICT).otherwise(NOTHING))
        )

    def some(at: Column) -> Column:
        """`at`: place of the surname, null if there is none."""
        rest = F.filter(parts, lambda p, i: i != at)
        lone = F.exists(parts, lambda p: p == _first(last)) & (F.size(parts) == 2)
        none = F.when(whole & F.array_contains(parts, given), F.when(lone, ONE).otherwise(CONFLICT)).otherwise(F.when(prose, CONFLICT).otherwise(NOTHING))
        words = let(rest, lambda r: (
            F.when(given == "", ONE)
            .when(F.array_contains(r, given), both)
            .when(~whole, F.when(F.exists(r, lambda p: (F.length(p) > 1) & (_first(p) == given)), INITIAL).otherwise(CONFLICT))
            .when(F.exists(r, lambda p: F.length(p) > 1), CONFLICT)
            .otherwise(F.when(F.array_contains(r, g), INITIAL).otherwise(CONFLICT))
        ))
        return F.when(at.isNull(), none).otherwise(words)

    place = lambda fits: F.array_max(F.transform(parts, lambda p, i: F.when(fits(p), i)))
    at = F.coalesce(place(lambda p: p == last), F.when(prose, place(lambda p: near(p, last))))
    return F.when((F.size(parts) == 0) | (last == ""), NOTHING).when(F.size(parts) == 1, one(parts[0])).otherwise(let(at, some))
