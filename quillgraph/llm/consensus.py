"""Consensus from several annotators' labels (problem 2): confidence-aware truth discovery."""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.codehost import let
from quillgraph.operators.skew import known_hot, skew_join
from quillgraph.runtime import Stage

# The tidy labels of each question.
LABELS = {"contrib_type": ["code", "docs", "other"], "is_actually_author": ["no", "unclear", "yes"]}
#: Quantile of the standard normal distribution at 1 - alpha/2 for alpha = 0.05.
Z = 1.959963984540054
#: Rounds end when less than this share of all answers changes between right and wrong.
TOLERANCE, MAX_ROUNDS = 0.0002, 50
#: What an annotator at chance level or below still weighs: units that only such ones answered go by their majority.
LEAST_WEIGHT = 1e-6
#: Up to so many annotators (of one question each) are numbered and their weights sent to every task; more are joined.
MOST_ANNOTATORS = 100_000
# Labels of a question, at most; numbers of votes are annotator * MOST_LABELS + label.
MOST_LABELS = 1024


def _letters(col: Column) -> Column:
    return F.regexp_replace(F.lower(col), "[^\\p{L}]", "")


def _fits(letters: Column, labels: list[str]) -> Column:
    """Number of the only label that begins with `letters`; null if none or several do."""
    fits = [F.lit(x).startswith(letters) for x in labels]
    n = reduce(lambda a, b: a + b, [f.cast("int") for f in fits])
    return F.when((letters != "") & (n == 1), F.coalesce(*(F.when(f, i) for i, f in enumerate(fits))))


def tidy_label(col: Column, labels: list[str]) -> Column:
    """The label that a loosely spelled answer begins, ignoring case and all but letters; null if none or several."""
    return let(_letters(col), lambda s: F.element_at(F.array(*map(F.lit, labels)), _fits(s, labels) + 1))


def votes(units: DataFrame, annotations: DataFrame, labels: dict[str, list[str]] | None = None) -> DataFrame:
    """(unit_id, question, annotator, answer): one row per unit, question and annotator, the latest tidy answer.

    `units` holds the answers of `eva` and `nic` in columns of their own, `annotations` those of the
    others as rows. Answers that are null, blank or fit no label are left out. Rows that repeat count
    once; if they differ, the latest one counts (times beyond the years 1830 to 2110 as these), then the
    last in order of labels. Each table is read once.
    """
    labels = {q: sorted(x) for q, x in (labels or LABELS).items()}
    wide = {"contrib_type": "contrib-type", "is_actually_author": "is_actually_author"}

    def number(q: str, raw: Column) -> Column:
        return let(_letters(raw), lambda s: _fits(s, labels[q]))

    # One long per answer: its time, then its number. The greatest one is the answer that counts.
    edge = 1 << 52
    at = F.coalesce(F.greatest(F.lit(-edge), F.least(F.lit(edge), F.unix_micros(F.col("labelled_datetime").cast("timestamp")))), F.lit(-edge))
    two = F.array(*(F.struct(F.lit(q).alias("question"), F.lit(who).alias("annotator"), number(q, F.col(f"`{who}-{wide[q]}`")).alias("y")) for q in labels for who in ("eva", "nic")))
    parts = units.select("unit_id", F.inline(two)).select("unit_id", "question", "annotator", (F.lit(-edge) * MOST_LABELS + F.col("y")).alias("code"))
    each = F.array(*(F.struct(F.lit(q).alias("question"), number(q, F.col(q)).alias("y")) for q in labels))
    rows = annotations.select("unit_id", "annotator", at.alias("at"), F.inline(each)).select("unit_id", "question", "annotator", (F.col("at") * MOST_LABELS + F.col("y")).alias("code"))
    every = parts.unionByName(rows).na.drop(subset=["unit_id", "annotator", "code"])
    latest = every.groupBy("unit_id", "question", "annotator").agg(F.max("code").alias("code"))
    name = F.create_map(*(c for q, x in labels.items() for c in (F.lit(q), F.array(*map(F.lit, x)))))
    return latest.select("unit_id", "question", "annotator", name[F.col("question")][F.pmod("code", F.lit(MOST_LABELS)).cast("int")].alias("answer"))


def chi_squared_low(n: float) -> float:
    """Lower alpha/2 quantile of the chi-squared distribution of n degrees (Wilson-Hilferty)."""
    return n * max(1 - 2 / (9 * n) - Z * math.sqrt(2 / (9 * n)), 0.02) ** 3


def error_bound(n: float, wrong: float) -> float:
    """Upper bound of an annotator's error variance: the summed distances, half an error smoothed in, over
    the lower chi-squared quantile of the number of answers. It is large where there are few answers."""
    return (wrong + 0.5) / chi_squared_low(n)


def log_odds(bound: float, k: int) -> float:
    """Log-odds of being right rather than wrong in one way of k - 1, at the bound: zero at chance level."""
    return max(LEAST_WEIGHT, math.log((1 - bound) * (k - 1) / bound)) if bound < 1 else LEAST_WEIGHT


def inverse(bound: float, k: int) -> float:
    """One over the bound."""
    return 1 / bound


class Consensus:
    """Result of `discover`: tables of labels and of annotators, the rounds it took and whether it settled."""

    def __init__(self, labels: DataFrame, annotators: DataFrame, rounds: int, settled: bool):
        self.labels, self.annotators, self.rounds, self.settled = labels, annotators, rounds, settled


def discover(
    answers: DataFrame,
    labels: dict[str, list[str]] | None = None,
    *,
    weigh: Callable[[float, int], float] = log_odds,
    tolerance: float = TOLERANCE,
    max_rounds: int = MAX_ROUNDS,
    most_annotators: int = MOST_ANNOTATORS,
) -> Consensus:
    """Consensus label per unit and question, and reliability per annotator and question.

    Alternates two steps, from equal weights: each unit's label is the one at the least weighted distance
    from its answers (distance 0 to the answer given, 1 to any other; ties go to the first label in
    alphabetical order); each annotator's weight follows from the chi-squared upper bound of its error
    variance against these labels (`error_bound`), so one of few answers weighs little however right it
    was. `weigh` makes the weight of a bound and the number of labels: `log_odds` (default) or
    `inverse`. Rounds end when the labels settle; if they do not within `max_rounds`, the last state is
    given with `settled` false and a warning.

    `answers` has (unit_id, question, annotator, answer), at most one row per unit, question and
    annotator. `labels` of the result: (unit_id, question, label, confidence, n_answers, agreement),
    agreement being the share of the answers equal to the label and confidence the label's share of
    exp(weight); a unit without an answer to a question doesn't come out. `annotators`: (question,
    annotator, n_answers, error_rate, error_bound, weight), the weight being the one the labels come
    from. No answers give no rows; null fields and unknown labels are left out.

    Scale: the answers of a unit are brought together once; then a round is one scan of them without a
    shuffle of rows, and the counts per annotator reach the driver if there are at most
    `most_annotators` of them. Units of very many answers stay rows and meet their label in a bounded
    broadcast; with more annotators than that, all rounds are joins of written tables.
    """
    labels = {q: sorted(x) for q, x in (labels or LABELS).items()}
    if any(len(x) > MOST_LABELS for x in labels.values()):
        raise ValueError(f"a question has more than {MOST_LABELS} labels")
    k = max(len(x) for x in labels.values())
    spark = answers.sparkSession
    stage = Stage(spark)
    place = F.create_map(*(c for q, x in labels.items() for c in (F.lit(q), F.array(*map(F.lit, x)))))
    y = F.array_position(place[F.col("question")], F.col("answer")).cast("int") - 1
    rows, total = stage.save_counted(answers.select("unit_id", "question", "annotator", y.alias("y")).na.drop().where("y >= 0"))
    sources, n_sources = stage.save_counted(rows.groupBy("question", "annotator").agg(F.count(F.lit(1)).alias("n")))
    hot_units = known_hot(rows, ["unit_id", "question"], total)
    way = _Numbered if n_sources <= most_annotators else _Joined
    run = way(stage, rows, sources, hot_units, labels, k, weigh)
    settled = total == 0
    rounds = 0
    while not settled and rounds < max_rounds:
        rounds += 1
        settled = run.step() <= tolerance * total
    if not settled:
        warnings.warn(f"labels still change after {max_rounds} rounds", RuntimeWarning, stacklevel=2)
    name = place[F.col("question")][F.col("y")]
    held = stage.save(run.labels())
    return Consensus(held.select("unit_id", "question", name.alias("label"), "confidence", "n_answers", "agreement"), run.annotators(), rounds, settled)


def _best(sums: list[Column]) -> tuple[Column, Column]:
    """(number of the greatest sum, the first of equals; its share of exp(sum))."""
    top = F.greatest(*sums, F.lit(-1.0))
    return F.coalesce(*(F.when(s == top, i) for i, s in enumerate(sums))), 1 / reduce(lambda a, b: a + b, [F.exp(s - top) for s in sums])


def _long_labels(rows: DataFrame, weights: DataFrame, k: int, hot_voices) -> DataFrame:
    """(unit_id, question, y, confidence) from rows of answers and a table of weights."""
    near = skew_join(rows, weights.select("question", "annotator", "weight"), ["question", "annotator"], hot=hot_voices)
    sums = near.groupBy("unit_id", "question").agg(*(F.sum(F.when(F.col("y") == t, F.col("weight")).otherwise(0.0)).alias(f"s{t}") for t in range(k)))
    best, confidence = _best([F.col(f"s{t}") for t in range(k)])
    return sums.select("unit_id", "question", best.alias("best"), confidence.alias("confidence"))


def _long_report(rows: DataFrame, best: DataFrame, hot_units) -> DataFrame:
    held = skew_join(rows, best, ["unit_id", "question"], hot=hot_units).groupBy("unit_id", "question").agg(
        F.first("best").alias("y"), F.first("confidence").alias("confidence"), F.count(F.lit(1)).alias("n_answers"), F.avg((F.col("y") == F.col("best")).cast("double")).alias("agreement")
    )
    return held.select("unit_id", "question", "y", "confidence", "n_answers", "agreement")


class _Numbered:
    """Rounds with a bounded number of annotators: their counts and weights are lists in the driver."""

    def __init__(self, stage: Stage, rows: DataFrame, sources: DataFrame, hot_units, labels: dict[str, list[str]], k: int, weigh):
        self.spark, self.stage, self.k, self.weigh, self.hot_units = stage.spark, stage, k, weigh, hot_units
        self.sources = [tuple(r) for r in sources.orderBy("question", "annotator").collect()]  # at most `most_annotators`
        self.sizes = [len(labels[q]) for q, _, _ in self.sources]
        self.wrong: list[int] | None = None
        self.weights = [1.0] * len(self.sources)
        self.used = self.weights
        numbers = self.spark.createDataFrame([(q, a, i) for i, (q, a, _) in enumerate(self.sources)], "question string, annotator string, i long")
        rows = rows.join(F.broadcast(numbers), ["question", "annotator"])  # as many rows as `sources`
        code = (F.col("i") * MOST_LABELS + F.col("y")).alias("v")
        self.long = None if hot_units is None else stage.save(rows.join(F.broadcast(hot_units), ["unit_id", "question"], "left_semi").select("unit_id", "question", code))
        cold = rows if hot_units is None else rows.join(F.broadcast(hot_units), ["unit_id", "question"], "left_anti")
        self.units = stage.save(cold.groupBy("unit_id", "question").agg(F.collect_list(code).alias("votes")))

    def _with_weights(self, df: DataFrame) -> DataFrame:
        return df.crossJoin(F.broadcast(self.spark.createDataFrame([(self.weights,)], "w array<double>")))  # one row

    def _labelled(self) -> DataFrame:
        def sum_of(t: int) -> Column:
            return F.aggregate("votes", F.lit(0.0), lambda s, v: s + F.when(v.bitwiseAND(F.lit(MOST_LABELS - 1)) == t, F.col("w")[F.shiftright(v, 10).cast("int")]).otherwise(0.0))

        sums = [sum_of(t).alias(f"s{t}") for t in range(self.k)]
        best, confidence = _best([F.col(f"s{t}") for t in range(self.k)])
        return self._with_weights(self.units).select("unit_id", "question", "votes", *sums).select("unit_id", "question", "votes", best.alias("best"), confidence.alias("confidence"))

    def _long_best(self) -> DataFrame:
        w = F.col("w")[F.shiftright("v", 10).cast("int")]
        y = F.col("v").bitwiseAND(F.lit(MOST_LABELS - 1))
        sums = self._with_weights(self.long).groupBy("unit_id", "question").agg(*(F.sum(F.when(y == t, w).otherwise(0.0)).alias(f"s{t}") for t in range(self.k)))
        best, confidence = _best([F.col(f"s{t}") for t in range(self.k)])
        return sums.select("unit_id", "question", best.alias("best"), confidence.alias("confidence"))

    def step(self) -> int:
        """One round; how many answers changed between right and wrong."""
        each = self._labelled().select("best", F.explode("votes").alias("v"))
        if self.long is not None:  # one row per hot unit
            each = each.unionByName(self.long.join(F.broadcast(self._long_best()), ["unit_id", "question"]).select("best", "v"))
        off = (F.col("v").bitwiseAND(F.lit(MOST_LABELS - 1)) != F.col("best")).cast("long")
        found = dict(each.groupBy(F.shiftright("v", 10).alias("i")).agg(F.sum(off).alias("wrong")).collect())
        wrong = [found.get(i, 0) for i in range(len(self.sources))]
        moved = sum(abs(a - b) for a, b in zip(wrong, self.wrong)) if self.wrong is not None else sum(wrong) + 1
        self.wrong, self.used = wrong, self.weights
        self.weights = [self.weigh(error_bound(n, w), k) for (_, _, n), w, k in zip(self.sources, wrong, self.sizes)]
        return moved if self.used != self.weights else 0

    def labels(self) -> DataFrame:
        n = F.size("votes")
        same = F.size(F.filter("votes", lambda v: v.bitwiseAND(F.lit(MOST_LABELS - 1)) == F.col("best")))
        out = self._labelled().select("unit_id", "question", F.col("best").alias("y"), "confidence", n.cast("long").alias("n_answers"), (same / n).alias("agreement"))
        if self.long is None:
            return out
        rows = self.long.select("unit_id", "question", F.col("v").bitwiseAND(F.lit(MOST_LABELS - 1)).cast("int").alias("y"))
        return out.unionByName(_long_report(rows, self._long_best(), self.hot_units))

    def annotators(self) -> DataFrame:
        wrong = self.wrong or []
        out = [(q, a, n, w / n, error_bound(n, w), self.weights[i]) for i, ((q, a, n), w) in enumerate(zip(self.sources, wrong))]
        return self.spark.createDataFrame(out, "question string, annotator string, n_answers long, error_rate double, error_bound double, weight double")


class _Joined:
    """Rounds with any number of annotators: weights are a written table, and both steps are joins."""

    def __init__(self, stage: Stage, rows: DataFrame, sources: DataFrame, hot_units, labels: dict[str, list[str]], k: int, weigh):
        self.stage, self.rows, self.hot_units, self.k = stage, rows, hot_units, k
        self.hot_voices = known_hot(rows, ["question", "annotator"])
        sizes = {q: len(x) for q, x in labels.items()}
        schema = "question string, annotator string, n long, wrong long, bound double, weight double"

        def weighed(batches):
            for b in batches:
                bounds = [error_bound(n, w) for n, w in zip(b["n"], b["wrong"])]
                yield b.assign(bound=bounds, weight=[weigh(x, sizes[q]) for x, q in zip(bounds, b["question"])])[["question", "annotator", "n", "wrong", "bound", "weight"]]

        self.weighed = lambda df: df.mapInPandas(weighed, schema)  # one row an annotator
        self.state = stage.save(sources.select("question", "annotator", "n", F.lit(-1).cast("long").alias("wrong"), F.lit(1.0).alias("bound"), F.lit(1.0).alias("weight")))

    def _best(self) -> DataFrame:
        return _long_labels(self.rows, self.state, self.k, self.hot_voices)

    def step(self) -> int:
        best = self.stage.save(self._best())
        told = skew_join(self.rows, best, ["unit_id", "question"], hot=self.hot_units)
        counts = told.groupBy("question", "annotator").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("y") != F.col("best")).cast("long")).alias("wrong"))
        new = self.stage.save(self.weighed(counts))
        both = new.join(self.state.select("question", "annotator", F.col("wrong").alias("_old"), F.col("weight").alias("_was")), ["question", "annotator"])
        moved = F.when(F.col("_old") < 0, F.col("wrong") + 1).otherwise(F.abs(F.col("wrong") - F.col("_old")))
        n = both.agg(F.sum(F.when(F.col("weight") == F.col("_was"), 0).otherwise(moved))).first()[0]
        self.stage.drop(best, self.state)
        self.state = new
        return n

    def labels(self) -> DataFrame:
        return _long_report(self.rows, self.stage.save(self._best()), self.hot_units)

    def annotators(self) -> DataFrame:
        return self.state.select("question", "annotator", F.col("n").alias("n_answers"), (F.col("wrong") / F.col("n")).alias("error_rate"), F.col("bound").alias("error_bound"), "weight")


def agreement(answers: DataFrame) -> DataFrame:
    """Krippendorff's alpha for nominal labels per question: (question, n_units, n_answers, observed, expected, alpha).

    Units with one answer say nothing about agreement and are left out. If only one label occurs, the
    expected disagreement is 0 and alpha is null.
    """
    by_label = answers.groupBy("question", "unit_id", "answer").agg(F.count(F.lit(1)).alias("n"))
    units = by_label.groupBy("question", "unit_id").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.col("n")).alias("same")).where("m > 1")
    seen = units.groupBy("question").agg(F.count(F.lit(1)).alias("n_units"), F.sum("m").alias("n_answers"), F.sum((F.col("m") * F.col("m") - F.col("same")) / (F.col("m") - 1)).alias("apart"))
    labels = answers.groupBy("question", "unit_id").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    totals = skew_join(by_label, labels, ["question", "unit_id"]).groupBy("question", "answer").agg(F.sum("n").alias("c"))
    chance = totals.groupBy("question").agg(F.sum(F.col("c") * F.col("c")).alias("cc"))
    both = seen.join(chance, "question")
    n = F.col("n_answers")
    observed, expected = F.col("apart") / n, (n * n - F.col("cc")) / (n * (n - 1))
    return both.select("question", "n_units", "n_answers", observed.alias("observed"), expected.alias("expected"), F.when(expected > 0, 1 - observed / expected).alias("alpha"))
