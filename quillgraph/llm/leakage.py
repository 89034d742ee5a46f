"""Evaluation texts leaking into training text (problem 8)."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.lookalikes import INVISIBLE, connect, slices, steps_sql, table
from quillgraph.runtime import Stage

#: Consecutive words of an item that make a leak.
WORDS = 10
#: Characters of item text whose n-grams are broadcast at once; a larger set is searched in blocks of about this size.
BLOCK_CHARS = 1_000_000
#: Words of an item that go into one block.
CHUNK_WORDS = 20_000

_BREAK = f"[-\\x{{2010}}\\x{{2011}}\\x{{FF0D}}\\x{{AD}}][{INVISIBLE}]*[ \\t]*\\r?\\n[ \\t>|]*"
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def words_sql(source: str, keep: str, joint: str | None) -> str:
    """SQL of (keep, words): runs of letters and digits of the folded `text`, with `joint` between the
    two parts of a word that a hyphen broke at a line end (None: no such parts are looked for)."""
    tx = "text" if joint is None else f"regexp_replace(text, '{_BREAK}', '{joint}', 'g')"
    whole = f"(SELECT {keep}, {tx} AS tx FROM {source})"
    return f"SELECT {keep}, string_split_regex(s4, '[^\\p{{L}}\\p{{M}}\\p{{N}}]+') AS words FROM ({steps_sql(whole, 'tx', keep, any_case=True)}) ORDER BY {keep}"


def _hashes(ids: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """64-bit hash of the n word numbers from each place of `at`."""
    h = np.zeros(len(at), np.uint64)
    for k in range(n):
        h = (h ^ (ids[at + k].astype(np.uint64) + np.uint64(1))) * _PRIME
        h ^= h >> np.uint64(29)
    return h


class Ngrams:
    """Hash set of the word n-grams of some items. It is what gets broadcast."""

    def __init__(self, items: list[tuple[int, list[str]]], n: int = WORDS):
        numbers: dict[str, int] = {}
        found: dict[tuple[int, ...], set[int]] = {}
        for item, words in items:
            ids = [numbers.setdefault(w, len(numbers)) for w in words if w]
            for i in range(len(ids) - n + 1):
                found.setdefault(tuple(ids[i : i + n]), set()).add(item)
        self.n, self.words, self.items = n, list(numbers), {g: sorted(s) for g, s in found.items()}
        flat = np.array(list(found), np.int64).reshape(-1)
        self.hashes = np.unique(_hashes(flat, np.arange(0, len(flat), n), n))

    def hits(self, ids: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, list[int]]]:
        """(place, items) of each window of `ids` (-1: a word of no item) that is one of the n-grams.

        Windows don't reach over the `ends` of texts. A window whose hash is in the set is verified
        word by word.
        """
        n = self.n
        if len(ids) < n or not len(self.hashes):
            return
        strange = np.concatenate([[0], np.cumsum(ids < 0)])
        at = np.flatnonzero(strange[n:] == strange[:-n])
        at = at[np.searchsorted(ends, at, "right") == np.searchsorted(ends, at + n - 1, "right")]
        at = at[np.isin(_hashes(ids, at, n), self.hashes)]
        for p in at.tolist():
            if items := self.items.get(tuple(ids[p : p + n].tolist())):
                yield p, items


def _flat(lists: pa.ListArray) -> tuple[pa.Array, np.ndarray]:
    """All non-empty words of a column of word lists, and where each list ends."""
    offsets = lists.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    values = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
    full = pc.greater(pc.binary_length(values), 0)
    kept = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    return values.filter(full), kept[offsets[1:] - offsets[0]]


def _words(con, rows: pa.Table, joint: str | None) -> pa.ListArray:
    con.register("rows_", rows)
    lists = con.sql(words_sql("rows_", "row", joint)).to_arrow_table()["words"].combine_chunks()
    con.unregister("rows_")
    return lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists


def _choose(joined: list[str], apart: list[str], known: set[str]) -> list[tuple[bool, int]]:
    """Which words to read, as (whether of `apart`, place): each broken one whole if the items know it so,
    else in parts if they know these."""
    out, k = [], 0
    for i, w in enumerate(joined):
        first, size = k, 0
        while k < len(apart) and size < len(w):
            size += len(apart[k])
            k += 1
        split = w not in known and k - first > 1 and all(p in known for p in apart[first:k])
        out += [(True, j) for j in range(first, k)] if split else [(False, i)]
    return out


def _scan(con, grams: Ngrams, values: pa.Array, texts: pa.Array) -> set[tuple[int, int]]:
    """(row, item) of the leaks in `texts`.

    A hyphen at a line end may break a word or stand between two. Texts that have such a one are read
    with all of them joined, all apart, and each as the items' own words say.
    """
    found: set[tuple[int, int]] = set()

    def look(rows: np.ndarray, lists: pa.ListArray) -> None:
        words, ends = _flat(lists)
        ids = pc.fill_null(pc.index_in(words, value_set=values), -1).to_numpy(zero_copy_only=False)
        for p, items in grams.hits(ids, ends):
            row = int(rows[np.searchsorted(ends, p, "right")])
            found.update((row, i) for i in items)

    all_rows = np.arange(len(texts))
    lists = _words(con, pa.table({"row": all_rows, "text": texts}), "")
    look(all_rows, lists)
    broken = pc.match_substring_regex(texts, _BREAK).to_numpy(zero_copy_only=False)
    if broken.any():
        rows = all_rows[broken]
        some = pa.table({"row": rows, "text": texts.filter(pa.array(broken))})
        apart = _words(con, some, " ")
        look(rows, apart)
        known = set(grams.words)
        pick = lambda x: [w for w in x if w]
        both = [(pick(j), pick(a)) for j, a in zip(lists.filter(pa.array(broken)).to_pylist(), apart.to_pylist())]
        look(rows, pa.array([[(a if is_apart else j)[k] for is_apart, k in _choose(j, a, known)] for j, a in both], pa.list_(pa.string())))
    return found


def _chunks(items: DataFrame, id: str, text: str, n: int) -> DataFrame:
    """(id, part, words) of the items, an item of more than CHUNK_WORDS words in several rows, which share n - 1 words."""
    rows = items.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")).where("id is not null and text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = connect()
        for b in (part for whole in batches for part in slices(whole)):
            lists = _words(con, pa.table({"row": range(b.num_rows), "text": b.column(1)}), "").to_pylist()
            for i, words in zip(b.column(0).to_pylist(), lists):
                words = [w for w in words if w]
                for k, at in enumerate(range(0, max(1, len(words) - n + 1), CHUNK_WORDS)):
                    yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([k], pa.int64()), pa.array([words[at : at + CHUNK_WORDS + n - 1]], pa.list_(pa.string()))], ["id", "part", "words"])

    return rows.mapInArrow(run, "id long, part long, words array<string>")


class _Blocks:
    """The n-grams of the items in blocks of about `block_chars` characters, one in the driver at a time."""

    def __init__(self, stage: Stage, items: DataFrame, id: str, text: str, n: int, block_chars: int):
        size = F.aggregate("words", F.lit(0).cast("long"), lambda s, w: s + F.length(w) + 1)
        self.rows, _, chars = stage.save_counted(_chunks(items, id, text, n).withColumn("size", size), F.sum("size"))
        self.n, self.number = n, math.ceil(chars / block_chars)

    def grams(self, k: int) -> Ngrams:
        part = self.rows if self.number == 1 else self.rows.where(F.pmod(F.xxhash64("id", "part", "words"), F.lit(self.number)) == k)
        return Ngrams([(r["id"], r["words"]) for r in part.collect()], self.n)

    def broadcast(self, k: int):
        return self.rows.sparkSession.sparkContext.broadcast(self.grams(k))


def _scanner(shared, job: Callable):
    """Function for mapInArrow: `job` over each part of a batch, with a block of n-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con, grams = connect(), shared.value
        values = pa.array(grams.words, pa.string())
        for b in (part for whole in batches for part in slices(whole)):
            yield from job(con, grams, values, b)

    return run


def _each_block(stage: Stage, documents: DataFrame, blocks: _Blocks, job: Callable, schema: str) -> DataFrame:
    """What `job` finds with every block. One block stays lazy; of several, each one's finds are written
    and its broadcast is destroyed before the next one is made, so memory doesn't grow with the items."""
    if blocks.number == 0:
        return documents.sparkSession.createDataFrame([], schema)
    if blocks.number == 1:
        return documents.mapInArrow(_scanner(blocks.broadcast(0), job), schema)
    parts = []
    for k in range(blocks.number):
        shared = blocks.broadcast(k)
        parts.append(stage.save(documents.mapInArrow(_scanner(shared, job), schema)))
        shared.destroy()
    return reduce(DataFrame.unionByName, parts)


def leaks(
    documents: DataFrame,
    items: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    n: int = WORDS,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """(doc_id, item_id) of every document that holds at least `n` consecutive words of an item's text.

    A word is an unbroken run of letters and digits. Letter case, white space, punctuation, hyphens
    that break a word at a line end, quote marks at line starts, and visually identical characters
    make no difference. The n-grams of the items are a broadcast hash set; each document's windows are
    looked up in it and every hit is verified word by word.

    Defined cases: null texts and ids leak nothing; items of fewer than `n` words can't leak; an item
    that repeats, or several items with the same words, are each reported; a document reports an item
    once; documents are read whole; empty tables give no rows; further columns are ignored.

    Scale: one scan of the documents, no shuffle of text; only hits are made distinct. The broadcast is
    bounded: items of more than `block_chars` characters in all are searched in blocks, a scan each, and
    only one block is held at a time, however many or long the items are.
    """
    source = documents.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")).where("id is not null and text is not null")

    def job(con, grams, values, b):
        found = sorted(_scan(con, grams, values, b.column(1)))
        ids = b.column(0)
        yield pa.RecordBatch.from_arrays([ids.take(pa.array([r for r, _ in found], pa.int64())), pa.array([i for _, i in found], pa.int64())], ["doc_id", "item_id"])

    stage = Stage(documents.sparkSession)
    return _each_block(stage, source, _Blocks(stage, items, item_id, item_text, n, block_chars), job, "doc_id long, item_id long").distinct()


@lru_cache
def _patterns():
    """Regular expressions of a line-end break, and of a piece of text that folds by itself into words."""
    import regex

    gone = INVISIBLE.replace("\\x{E0000}-\\x{E0FFF}", "\\U000E0000-\\U000E0FFF").replace("\\x{", "\\u").replace("}", "")
    brk = f"[-\\u2010\\u2011\\uFF0D\\u00AD][{gone}]*[ \\t]*\\r?\\n[ \\t>|]*"
    letters = "".join(k for k, v in table(any_case=True).items() if v.isalnum() and not k.isalnum())
    return regex.compile(brk), regex.compile(f"(?s:[\\p{{L}}\\p{{M}}\\p{{N}}{gone}{regex.escape(letters)}]|.(?=[{gone}]*+\\p{{M}}))+")


Word = tuple[str, int, int]


def _placed(con, texts: list[str], joint: str) -> list[list[Word]]:
    """(word, start, end) of the words that `_words` has for each text, with their places in it."""
    brk, piece = _patterns()
    pieces, owners = [], []
    for row, text in enumerate(texts):
        parts, places, at = [], [], 0
        for m in brk.finditer(text):
            parts += [text[at : m.start()], joint]
            places += [np.arange(at, m.start()), np.full(len(joint), m.start())]
            at = m.end()
        whole, place = "".join([*parts, text[at:]]), np.concatenate([*places, np.arange(at, len(text))]).tolist()
        for m in piece.finditer(whole):
            pieces.append(m.group())
            owners.append((row, place[m.start()], place[m.end() - 1] + 1))
    kinds = {p: k for k, p in enumerate(dict.fromkeys(pieces))}  # most pieces recur, each kind is folded once
    lists = _words(con, pa.table({"row": np.arange(len(kinds)), "text": pa.array(list(kinds), pa.string())}), None).to_pylist()
    out: list[list[Word]] = [[] for _ in texts]
    for p, (row, start, end) in zip(pieces, owners):
        out[row] += [(w, start, end) for w in lists[kinds[p]] if w]
    return out


def _spans(con, texts: list[str], grams: Ngrams, number: dict[str, int]) -> list[list[tuple[int, int]]]:
    """Where n-grams of the items stand in each text by any of the three readings of `_scan`, merged."""
    readings = [[j] for j in _placed(con, texts, "")]
    broken = [r for r, t in enumerate(texts) if _patterns()[0].search(t)]
    for r, apart in zip(broken, _placed(con, [texts[r] for r in broken], " ") if broken else []):
        joined = readings[r][0]
        chosen = _choose([w for w, _, _ in joined], [w for w, _, _ in apart], number.keys())
        readings[r] += [apart, [(apart if is_apart else joined)[k] for is_apart, k in chosen]]
    out = []
    for each in readings:
        spans: list[tuple[int, int]] = []
        for words in each:
            ids = np.array([number.get(w, -1) for w, _, _ in words], np.int64)
            spans += [(words[p][1], words[p + grams.n - 1][2]) for p, _ in grams.hits(ids, np.array([len(ids)]))]
        out.append(_merged(spans))
    return out


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    merged: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


def _cut(text: str, spans: list[tuple[int, int]]) -> str:
    ends = [0, *(b for _, b in spans)]
    return "".join(text[i:a] for i, a in zip(ends, [*(a for a, _ in spans), len(text)]))


def decontaminate(documents: DataFrame, items: DataFrame, *, remove: str = "spans", doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = WORDS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The documents as (doc_id, text, n_removed), without what leaked into them.

    `remove="spans"` cuts the leaked words out of the texts, from the first to the last word of each
    run, and counts the cut characters; `remove="documents"` leaves out every document with a leak.
    Null texts stay; documents without a leak stay as they are. What is cut is what `leaks` reads, in
    all its readings, and again until what is left has no leak, as the ends of a cut may form a new one.
    """
    if remove not in ("spans", "documents"):
        raise ValueError(remove)
    rest = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.lit(0).cast("long").alias("n_removed"))
    if remove == "documents":
        bad = leaks(documents, items, doc_id=doc_id, text=text, item_id=item_id, item_text=item_text, n=n, block_chars=block_chars)
        return rest.join(bad.select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id", "text", "n_removed")
    stage = Stage(documents.sparkSession)
    blocks = _Blocks(stage, items, item_id, item_text, n, block_chars)
    if blocks.number == 0:
        return rest
    if blocks.number == 1:
        return rest.mapInArrow(_scanner(blocks.broadcast(0), _cut_all), "doc_id long, text string, n_removed long")
    # Several blocks: places of all of them are found in the same text, merged, and cut at once; then again in what was cut.
    rows = stage.save(rest.withColumn("row", F.monotonically_increasing_id()))
    found = F.col("places").isNotNull()
    done = []
    while True:
        texts = rows.where("text is not null").select("row", "text")
        places, n_places = stage.save_counted(_each_block(stage, texts, blocks, _places, "row long, start long, end long"))
        if n_places == 0:
            return reduce(DataFrame.unionByName, [*done, rows]).select("doc_id", "text", "n_removed")
        per = places.groupBy("row").agg(F.collect_set(F.struct("start", "end")).alias("places"))  # within one text
        both = stage.save(rows.join(per, "row", "left"))
        done.append(both.where(~found).drop("places"))
        rows = stage.save(both.where(found).mapInArrow(_cut_places, "row long, doc_id long, text string, n_removed long"))


def _places(con, grams: Ngrams, values: pa.Array, b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """(row, start, end) of the leaks in (row, text)."""
    rows = sorted({r for r, _ in _scan(con, grams, values, b.column(1))})
    ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
    spans = _spans(con, [texts[r] for r in rows], grams, {w: i for i, w in enumerate(grams.words)}) if rows else []
    out = [(ids[r], i, j) for r, found in zip(rows, spans) for i, j in found]
    cols = list(zip(*out)) if out else [(), (), ()]
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["row", "start", "end"])


def _cut_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x = b.to_pydict()
        spans = [_merged([(p["start"], p["end"]) for p in found]) for found in x["places"]]
        texts = [_cut(t, found) for t, found in zip(x["text"], spans)]
        cut = [n + len(t) - len(new) for n, t, new in zip(x["n_removed"], x["text"], texts)]
        yield pa.RecordBatch.from_arrays([pa.array(x["row"], pa.int64()), pa.array(x["doc_id"], pa.int64()), pa.array(texts, pa.string()), pa.array(cut, pa.int64())], ["row", "doc_id", "text", "n_removed"])


def _cut_all(con, grams: Ngrams, values: pa.Array, b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, n_removed) without leaks."""
    texts = b.column(1)
    hit = {r for r, _ in _scan(con, grams, values, pc.fill_null(texts, ""))}
    if not hit:
        yield b
        return
    number = {w: i for i, w in enumerate(grams.words)}
    out, cut = texts.to_pylist(), b.column(2).to_pylist()
    while hit:
        rows = sorted(hit)
        for r, spans in zip(rows, _spans(con, [out[r] for r in rows], grams, number)):
            if not spans:
                raise RuntimeError("a leak has no place in its text")
            cut[r] += sum(j - i for i, j in spans)
            out[r] = _cut(out[r], spans)
        hit = {rows[r] for r, _ in _scan(con, grams, values, pa.array([out[r] for r in rows], pa.string()))}
    yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string()), pa.array(cut, pa.int64())], ["doc_id", "text", "n_removed"])
