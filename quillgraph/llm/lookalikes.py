"""Visually identical text with different characters (problem 9): one form by SQL inside Arrow partitions."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.operators.skew import skew_join
from quillgraph.runtime import Stage

# Fixed values, from the public table of confusable characters: letters of one shape and case. Left out are
# letters whose difference shows (dots, tails, strokes), small Greek letters but two, and of several
# letters of one script that would become the same one all but the nearest.
LETTERS = {
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Ү": "Y", "Х": "X", "І": "I", "Ӏ": "I", "Ј": "J", "Ѕ": "S", "Ѵ": "V", "Ԍ": "G", "Ԛ": "Q", "Ԝ": "W",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ӏ": "i", "ј": "j", "ѕ": "s", "ѵ": "v", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "Г": "Γ", "П": "Π", "Ф": "Φ",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϝ": "F", "Ϲ": "C", "Ϻ": "M", "Ϳ": "J",
    "ο": "o", "ν": "v", "ϲ": "c", "ϳ": "j", "µ": "μ", "∆": "Δ", "∑": "Σ", "Ʃ": "Σ", "∏": "Π",
    "Ս": "U", "Տ": "S", "Օ": "O", "հ": "h", "ո": "n", "ս": "u", "օ": "o",
    "ɡ": "g", "ᴄ": "c", "ᴏ": "o", "ᴠ": "v", "ᴡ": "w", "ᴢ": "z", "ꜱ": "s",
}
# Letters that look like another one in upper or lower case; for text whose case is ignored.
ANY_CASE = {
    "в": "b", "к": "k", "м": "m", "н": "h", "т": "t", "ү": "y", "ԍ": "g", "г": "γ", "п": "π", "ф": "φ", "տ": "s",
    "α": "a", "β": "b", "ε": "e", "ζ": "z", "η": "h", "ι": "i", "κ": "k", "μ": "m", "ρ": "p", "τ": "t", "υ": "y", "χ": "x", "ϝ": "f", "ϻ": "m", "ς": "σ", "ʃ": "σ", "∂": "δ",
}
BLANKS = "\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u202f\u205f\u3000"
HYPHENS = "\u2010\u2011\u2012\u2212\ufe63"
INVISIBLE = (
    "\\x{00AD}\\x{034F}\\x{061C}\\x{115F}\\x{1160}\\x{17B4}\\x{17B5}\\x{180B}-\\x{180F}\\x{200B}-\\x{200F}\\x{202A}-\\x{202E}"
    "\\x{2060}-\\x{206F}\\x{3164}\\x{FE00}-\\x{FE0F}\\x{FEFF}\\x{FFA0}\\x{E0000}-\\x{E0FFF}"
)
# Beginnings of the names of compatibility letters that look as their parts do.
LOOKS_AS_PARTS = ("LATIN SMALL LIGATURE", "LATIN CAPITAL LIGATURE", "LATIN CAPITAL LETTER DZ", "LATIN SMALL LETTER DZ", "LATIN CAPITAL LETTER L", "LATIN SMALL LETTER LJ", "LATIN CAPITAL LETTER N", "LATIN SMALL LETTER NJ", "ARMENIAN SMALL LIGATURE", "ROMAN NUMERAL", "SMALL ROMAN NUMERAL")
#: Bytes of text that a worker hands to SQL at once.
SLICE = 16_000_000
#: Texts of these characters only are their own NFC.
COMPOSED = "\\x{00}-\\x{2FF}\\x{384}-\\x{386}\\x{388}-\\x{482}\\x{48A}-\\x{52F}\\x{2002}-\\x{2027}\\x{202F}-\\x{205E}\\x{20A0}-\\x{20BF}\\x{FB00}-\\x{FB06}\\x{FF01}-\\x{FF5E}"


def widths() -> dict[str, str]:
    """Full- and half-width forms and the ordinary character each stands for, by the Unicode tables."""
    forms = {chr(c): unicodedata.normalize("NFKC", chr(c)) for c in range(0xFF01, 0xFFEF) if unicodedata.decomposition(chr(c)).startswith(("<wide>", "<narrow>"))}
    return {a: b for a, b in forms.items() if len(b) == 1 and b.strip()}


@lru_cache
def forms() -> dict[str, str]:
    """Ligatures, digraphs, numeral letters and letters of mathematical fonts, and the letters each stands for, by the Unicode tables."""
    out = {}
    for c in map(chr, range(0x80, 0x1F000)):
        kind = unicodedata.decomposition(c).partition(" ")[0]
        if kind == "<font>" or kind == "<compat>" and unicodedata.name(c, "").startswith(LOOKS_AS_PARTS):
            whole = unicodedata.normalize("NFKC", c)
            if whole.isalnum():
                out[c] = whole
    return out


@lru_cache
def tables(any_case: bool = False) -> tuple[dict[str, str], dict[str, str], dict[str, str]]:
    """Replacements of one character by one that are frequent, that are rare, and those of one character by several."""
    letters = LETTERS | ({k: v.lower() for k, v in LETTERS.items()} | ANY_CASE if any_case else {})
    letters = {a: letters.get(b, b) for a, b in letters.items()}
    # Letters with accents become the accents on what their letter becomes.
    accented = {}
    for c in map(chr, range(0x80, 0x2000)):
        if (d := unicodedata.normalize("NFD", c)) != c and d[0] in letters:
            whole = unicodedata.normalize("NFC", letters[d[0]] + d[1:])
            if len(whole) == 1 or d[0] in LETTERS:  # frequent Greek letters with accents stay as they are in text of any case
                accented[c] = whole
    found = {a: "".join(letters.get(x, x) for x in b) for a, b in (forms() | widths()).items()} | accented
    if any_case:
        found = {a: b.lower() for a, b in found.items()} | {"ß": "ss"}
    one = {a: b for a, b in found.items() if len(b) == 1}
    often = letters | {a: b for a, b in one.items() if a in widths() or a in accented} | {c: " " for c in BLANKS} | {c: "-" for c in HYPHENS}
    return often, {a: b for a, b in one.items() if a not in often}, {a: b for a, b in found.items() if len(b) > 1}


def table(any_case: bool = False) -> dict[str, str]:
    """Every replacement."""
    often, rare, long = tables(any_case)
    return often | rare | long


def _class(chars) -> str:
    """A class of regular expressions, with neighbours joined to ranges."""
    runs: list[list[int]] = []
    for c in sorted(map(ord, chars)):
        if runs and c == runs[-1][1] + 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in runs) + "]"


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def steps_sql(source: str, text: str, keep: str, any_case: bool = False) -> str:
    """SQL of (keep, s4), s4 the one form of `text`; with `any_case`, in lower case and folded across cases.

    A chain of subqueries, each step computed once a row: invisible characters go, NFC, ligatures, then
    look-alikes, widths, blanks and hyphens by `translate`, and NFC again where a combining mark now
    stands behind another letter. ASCII texts, texts composed by their characters, and texts without
    ligatures or rare forms skip what can't change them.
    """
    often, rare, long = tables(any_case)
    first = f"lower({text})" if any_case else text
    lig = "s1"
    for a, b in long.items():
        lig = f"replace({lig}, {_quoted(a)}, {_quoted(b)})"
    one = lambda s, t: f"translate({s}, {_quoted(''.join(t))}, {_quoted(''.join(t.values()))})"
    nfc = lambda s: f"CASE WHEN plain OR regexp_full_match({s}, '[{COMPOSED}]*') THEN {s} ELSE nfc_normalize({s}) END"
    return f"""
        SELECT {keep}, {nfc('s3')} AS s4 FROM (
        SELECT {keep}, plain, CASE WHEN plain THEN s2 ELSE {one('s2', often)} END AS s3 FROM (
        SELECT {keep}, plain, CASE WHEN NOT plain AND regexp_matches(s1, '{_class(long | rare)}') THEN {one(lig, rare)} ELSE s1 END AS s2 FROM (
        SELECT {keep}, plain, {nfc('sx')} AS s1 FROM (
        SELECT {keep}, plain, CASE WHEN plain THEN s0 ELSE regexp_replace(s0, '[{INVISIBLE}]+', '', 'g') END AS sx FROM (
        SELECT {keep}, s0, regexp_full_match(s0, '[\\x{{00}}-\\x{{7F}}]*') AS plain FROM (
        SELECT {keep}, {first} AS s0 FROM {source}))))))"""


def connect():
    """A DuckDB in the worker's memory: one thread, a limit, nothing on disk."""
    import duckdb

    con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "1GB"})
    con.execute("SET enable_external_access = false")
    return con


def slices(batch: pa.RecordBatch, column: int = 1, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batch in parts of at most `most` bytes of text, or of one row; no text is copied or cut."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        done = int(ends[at - 1]) if at else 0
        n = max(1, int(np.searchsorted(ends, done + most, "right")) - at)
        yield batch.slice(at, n)
        at += n


def run_sql(sql: str, out: pa.Schema):
    """Function for mapInArrow: `sql` over each batch, which it sees as the table `batch`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = connect()
        for b in batches:
            for part in slices(b):
                con.register("batch", pa.Table.from_batches([part]))
                yield from con.sql(sql).to_arrow_table().cast(out).to_batches()
                con.unregister("batch")

    return run


def canonical_texts(documents: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, text): every text in its one form; see `steps_sql`.

    Removed: invisible characters. Made one: kinds of blank and hyphen, full and half width, composed
    and separate accents, ligatures, look-alike letters. Kept, as they show: letter case, digits and
    superscripts, accents, punctuation, tabs and line breaks.
    Defined cases: null stays null, empty stays empty, texts are processed whole whatever their
    length, every row comes out once (repeated ids too), further columns are left out.
    """
    source = documents.select(F.col(id).alias("id"), F.col(text).alias("text"))
    kind = source.schema["id"].dataType
    out = pa.schema([("id", pa.int64() if kind.simpleString() == "bigint" else pa.string()), ("text", pa.string())])
    sql = f"SELECT id, s4 AS text FROM ({steps_sql('batch', 'text', 'id')})"
    return source.mapInArrow(run_sql(sql, out), f"id {kind.simpleString()}, text string").select(F.col("id").alias(id), F.col("text").alias(text))


def _digests(documents: DataFrame, id: str, text: str) -> DataFrame:
    """(id, look, raw): 128-bit digests of the one form and of the text as it is; null texts are left out."""
    source = documents.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")).where("id is not null and text is not null")
    out = pa.schema([("id", pa.int64()), ("look", pa.binary()), ("raw", pa.binary())])
    # A text that is its own form has one digest for both.
    sql = f"SELECT id, unhex(md5(s4)) AS look, CASE WHEN s4 = text THEN unhex(md5(s4)) ELSE unhex(md5(text)) END AS raw FROM ({steps_sql('batch', 'text', 'id, text')})"
    return source.mapInArrow(run_sql(sql, out), "id long, look binary, raw binary")


def look_classes(documents: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, class_id, n_forms) of the documents that look like another one of different characters;
    `class_id` is the least id of those that look the same, `n_forms` how many spellings they have.

    This is the form to use where groups are large: its size is linear. Only digests leave the
    Python workers, classes are combined before the shuffle, and hot ones are joined by broadcast.
    """
    stage = Stage(documents.sparkSession)
    rows = stage.save(_digests(documents, id, text))
    forms = rows.groupBy("look").agg(F.min("id").alias("class_id"), F.min("raw").alias("a"), F.max("raw").alias("b")).where("a <> b").select("look", "class_id")
    mixed = stage.save(skew_join(rows, forms, ["look"]))
    count = mixed.groupBy("class_id").agg(F.count_distinct("raw").alias("n_forms"))
    return skew_join(mixed.select("id", "class_id"), count, ["class_id"]).select(F.col("id").alias(id), "class_id", "n_forms")


def look_pairs(documents: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id_a, id_b), the smaller first: documents of different characters that look the same.

    Defined cases: null texts pair with nothing; empty texts, and texts of invisible characters only,
    look alike; rows of exactly the same text are no pair with each other but each is one with every
    other spelling; an id that repeats pairs once; further columns are ignored.
    """
    stage = Stage(documents.sparkSession)
    rows = stage.save(_digests(documents, id, text))
    forms = rows.groupBy("look").agg(F.min("raw").alias("a"), F.max("raw").alias("b")).where("a <> b").select("look")
    mixed = stage.save(skew_join(rows, forms, ["look"], "left_semi").distinct())
    a, b = (mixed.select("look", F.col("id").alias(f"{id}_{x}"), F.col("raw").alias(f"raw_{x}")) for x in "ab")
    return a.join(b, "look").where(f"raw_a <> raw_b and {id}_a < {id}_b").select(f"{id}_a", f"{id}_b").distinct()
