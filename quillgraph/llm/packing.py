"""Filling fixed-capacity containers with texts (problem 7): lexical retrieval packing."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.lookalikes import slices
from quillgraph.runtime import Stage

CAPACITY = 2048
#: Vocabulary of a public byte-level tokenizer, as ranks.
RANKS = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: how that tokenizer splits text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes of such a file, at most.
MOST_RANKS = 64_000_000
#: Texts of one shard of the inverted index.
SHARD = 1024
# Usual BM25 parameters.
K1, B = 1.2, 0.75


def encoder(path: str):
    """The tokenizer of a file of ranks."""
    with open(path, "rb") as f:
        return encoder_of(f.read())


def encoder_of(content: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines()) if a}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class Bm25:
    """Inverted index of one shard: for each token the texts that hold it, with their BM25 weights.

    `idf` and the `mean` length are those of all texts, so a token weighs the same in every shard. A token
    that stands in more than half of all texts has no positive inverse document frequency in the
    Robertson form, so it weighs nothing and has no postings.
    """

    def __init__(self, doc: np.ndarray, token: np.ndarray, n_docs: int, lengths: np.ndarray, idf: np.ndarray, mean: float):
        keep = idf[token] > 0
        doc, token = doc[keep], token[keep]
        order = np.argsort(token.astype(np.int64) * n_docs + doc, kind="stable")
        key = token.astype(np.int64)[order] * n_docs + doc[order]
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        tf = np.diff(np.append(start, len(key)))
        key = key[start]
        token, doc = key // n_docs, key % n_docs
        heads = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.zeros(0, np.int64)
        df = np.diff(np.append(heads, len(token)))
        w = idf[token] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[doc] / max(1.0, mean)))
        self.n, self.doc, self.weight = n_docs, doc, w.astype(np.float32)
        ends = np.cumsum(df)
        self.first, self.last = ends - df, ends
        # The same by text: which postings lists it is in.
        number = np.repeat(np.arange(len(df)), df)
        by_doc = np.argsort(self.doc, kind="stable")
        self.lists, self.doc_end = number[by_doc], np.searchsorted(self.doc[by_doc], np.arange(n_docs), "right")

    def scores(self, d: int) -> np.ndarray:
        """BM25 of every text of the shard for the tokens of text d."""
        lists = self.lists[self.doc_end[d - 1] if d else 0 : self.doc_end[d]]
        a, size = self.first[lists], self.last[lists] - self.first[lists]
        if not len(a):
            return np.zeros(self.n)
        at = np.arange(size.sum()) + np.repeat(a - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
        return np.bincount(self.doc[at], self.weight[at], self.n)


def pack(sizes: np.ndarray, index: Bm25, capacity: int) -> list[list[int]]:
    """Texts of one shard (sizes from 1 to `capacity`) grouped into containers.

    The largest unused text is the seed of the next container; its unused neighbours fill it in the
    order of their score as long as they fit. What remains is filled with the largest unused texts
    that fit, so space stays unused only where no unused text is small enough.
    """
    n = len(sizes)
    unused = np.ones(n, bool)
    by_size = np.argsort(-sizes, kind="stable")
    out, at, smallest = [], 0, np.sort(sizes)
    while at < n:
        seed = int(by_size[at])
        if not unused[seed]:
            at += 1
            continue
        unused[seed] = False
        box, room = [seed], capacity - int(sizes[seed])
        if room >= smallest[0]:
            free = np.flatnonzero(unused & (sizes <= room))
            if len(free):
                score = index.scores(seed)[free]
                free = free[np.lexsort((free, -sizes[free], -score))][: np.count_nonzero(score > 0)]
                for d, size in zip(free.tolist(), sizes[free].tolist()):
                    if size <= room:
                        box.append(d)
                        room -= size
                        if room < smallest[0]:
                            break
                unused[box] = False
                while room >= smallest[0]:
                    free = np.flatnonzero(unused & (sizes <= room))
                    if not len(free):
                        break
                    d = int(free[np.argmax(sizes[free])])
                    box.append(d)
                    unused[d] = False
                    room -= int(sizes[d])
        out.append(box)
    return out


OUT = pa.schema([("container_id", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("n_pieces", pa.int32()), ("first_token", pa.int64()), ("n_tokens", pa.int64()), ("position", pa.int32())])
_OUT_SQL = "container_id long, doc_id long, piece int, n_pieces int, first_token long, n_tokens long, position int"
# A row per piece with its tokens, and rows of how many pieces of a task hold a token.
_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("n_pieces", pa.int32()), ("first_token", pa.int64()), ("n_tokens", pa.int64()), ("tokens", pa.binary()), ("token", pa.int32()), ("n_held", pa.int64())])
_PIECES_SQL = "doc_id long, piece int, n_pieces int, first_token long, n_tokens long, tokens binary, token int, n_held long"


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, schema)], schema=schema)


def _tokenised(ranks, capacity: int):
    """Function for mapInArrow: (id, text) to rows of _PIECES; `ranks` is the broadcast file of the tokenizer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder_of(ranks.value)
        held = np.zeros(0, np.int64)
        for b in (part for whole in batches for part in slices(whole)):
            rows, seen = [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                tokens = np.array(enc.encode_ordinary(t), np.uint32) if t else np.zeros(0, np.uint32)
                n = -(-len(tokens) // capacity)
                for k in range(max(1, n)):
                    part = tokens[k * capacity : (k + 1) * capacity]
                    rows.append((i, k, max(1, n), k * capacity, len(part), part.tobytes(), None, None))
                    seen.append(np.unique(part))
            if seen:
                counts = np.bincount(np.concatenate(seen).astype(np.int64), minlength=len(held))
                counts[: len(held)] += held
                held = counts
            yield _table(rows, _PIECES)
        at = np.flatnonzero(held)
        for k in range(0, len(at), 10_000):
            yield _table([(None,) * 6 + (int(t), int(held[t])) for t in at[k : k + 10_000]], _PIECES)

    return run


def _keyed(shared, mean: float):
    """Function for mapInArrow: pieces with `route`, the token that weighs most in the piece among those that other pieces hold too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, alone = shared.value
        for b in batches:
            routes = []
            for raw in b.column("tokens").to_pylist():
                token, tf = np.unique(np.frombuffer(raw, np.uint32), return_counts=True)
                w = np.where(alone[token], 0.0, idf[token]) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * tf.sum() / max(1.0, mean)))
                routes.append(int(token[np.argmax(w)]) if len(w) and w.max() > 0 else -1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(routes, pa.int32())], [*b.schema.names, "route"])

    return run


def _packed(shared, mean: float, capacity: int, shard: int):
    """Function for mapInArrow: containers of the pieces of a partition, shard by shard in their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        idf, base = shared.value[0], TaskContext.get().partitionId() << 36
        rows: list[dict] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal base
            parts = [np.frombuffer(r["tokens"], np.uint32) for r in rows]
            size = np.array([len(t) for t in parts], np.int64)
            index = Bm25(np.repeat(np.arange(len(parts)), size), np.concatenate(parts), len(parts), size.astype(np.float64), idf, mean)
            out = []
            for c, box in enumerate(boxes := pack(size, index, capacity)):
                out += [(base + c, rows[x]["doc_id"], rows[x]["piece"], rows[x]["n_pieces"], rows[x]["first_token"], rows[x]["n_tokens"], p) for p, x in enumerate(box)]
            base += len(boxes)
            return _table(out, OUT)

        for b in batches:
            for r in b.to_pylist():
                rows.append(r)
                held += r["n_tokens"]
                if len(rows) >= shard or held >= 2000 * capacity:
                    yield flush()
                    rows, held = [], 0
        if rows:
            yield flush()

    return run


def fill_containers(documents: DataFrame, *, capacity: int = CAPACITY, ranks: str = RANKS, shard: int = SHARD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Assignment of texts to containers of `capacity` tokens.

    Columns: container_id, doc_id, piece (0 unless the text is longer than a container), n_pieces,
    first_token and n_tokens of the piece in its text, position in the container. Only a text longer
    than a container is split, into full containers and a rest that is packed like a text. Inverse
    document frequencies and the mean length are counted over all pieces. Each piece is sent to the
    shard of the token that weighs most in it by BM25, among the tokens that other pieces hold too, so
    texts about the same rare thing meet; a shard of `shard` pieces has an inverted index over its
    tokens. The largest unused piece seeds a container, its unused neighbours fill it by score, and
    what room is left takes the largest unused pieces that fit.

    Defined cases: null and empty texts hold no tokens and come out once, with container_id null;
    rows whose id is null keep it; an id that repeats is packed as often; strings that name special
    tokens are ordinary text; an empty table gives no rows; further columns are ignored.

    Scale: texts are tokenised once and written as numbers, which one shuffle sorts by route; ranges are
    cut by route, id and piece, so a route that very many pieces have is split over tasks. A task
    holds one shard, which also ends at 2,000 containers' worth of tokens. The driver sees counts per
    token, as many as the vocabulary has, and sends them to the tasks, and the tokenizer's file, which
    only the driver reads (at most MOST_RANKS bytes).
    """
    spark = documents.sparkSession
    stage = Stage(spark)
    source = documents.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    if os.path.getsize(ranks) > MOST_RANKS:
        raise ValueError(f"{ranks} has more than {MOST_RANKS} bytes")
    with open(ranks, "rb") as f:
        file = spark.sparkContext.broadcast(f.read())
    full = F.col("token").isNull() & (F.col("n_tokens") > 0)
    rows, _, n_pieces, n_tokens = stage.save_counted(source.mapInArrow(_tokenised(file, capacity), _PIECES_SQL), F.sum(full.cast("long")), F.sum(F.when(full, F.col("n_tokens")).otherwise(0)))
    held = rows.where("token is not null").groupBy("token").agg(F.sum("n_held").alias("n")).collect()  # a row per token of the vocabulary at most
    df = np.zeros(max([r["token"] for r in held], default=0) + 1, np.int64)
    for r in held:
        df[r["token"]] = r["n"]
    mean = n_tokens / n_pieces if n_pieces else 1.0
    shared = spark.sparkContext.broadcast((np.log((n_pieces - df + 0.5) / (df + 0.5)), df < 2))
    pieces = rows.where("token is null").drop("token", "n_held")
    # Written, as cutting the ranges reads the routes once more.
    routed = stage.save(pieces.mapInArrow(_keyed(shared, mean), _PIECES_SQL.replace(", token int, n_held long", ", route int")))
    stage.drop(rows)
    none = routed.where("n_tokens = 0").select(F.lit(None).cast("long").alias("container_id"), "doc_id", "piece", "n_pieces", "first_token", "n_tokens", F.lit(0).alias("position"))
    tasks = max(1, -(-n_pieces // (4 * shard)))
    order = ["route", "doc_id", "piece", "first_token"]
    placed = routed.where("n_tokens > 0").repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    return placed.mapInArrow(_packed(shared, mean, capacity, shard), _OUT_SQL).unionByName(none)


def fill_report(assignment: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Number of containers, of pieces and of tokens, and the share of the room that is used."""
    held = assignment.where("container_id is not null")
    per = held.groupBy("container_id").agg(F.sum("n_tokens").alias("used"), F.count(F.lit(1)).alias("n_pieces"))
    return per.agg(
        F.count(F.lit(1)).alias("n_containers"), F.sum("n_pieces").alias("n_pieces"), F.sum("used").alias("n_tokens"),
        F.max("used").alias("fullest"), (F.sum("used") / (F.count(F.lit(1)) * F.lit(capacity))).alias("share_used"),
    )
