"""Matching entities across sources without keys (problem 3): BM25 retrieval of persons for accounts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.codehost import let
from quillgraph.llm import names as N
from quillgraph.llm.names import CONFLICT, FULL, INITIAL, NOTHING, ONE
from quillgraph.operators.skew import known_hot, skew_join
from quillgraph.runtime import Stage

#: Gaps between the best and the second score count up to this.
GAP_CAP = 12.0
#: Rows of the sample the calibration is fitted on, at most.
SAMPLE = 20_000
#: BM25: how fast repetitions saturate, and how much longer entries are marked down.
K1, B = 1.2, 0.75
#: Postings lists of more entries than this are read only where their bound leaves a chance.
SHORT_LIST = 64
#: Terms of accounts whose lists have more than two entries are broadcast up to this number of rows.
MOST_BROADCAST = 200_000
#: An account of less than this share of the score of its person's best account is no near one of that person.
NEAR_SHARE = 0.1
# Coefficients where the sample can't be fitted (fewer than 50 rows or one outcome only).
DEFAULT = (-1.0, 0.8)

_MAKES_PAIRS = ["k:", "e:"]


def _makes_pair(term: Column) -> Column:
    """Whether a term holds both names; a pair that shares no such term can't be eligible."""
    return F.substring(term, 1, 2).isin(_MAKES_PAIRS)


class _Index:
    """Inverted index over the persons, weighted by BM25, and the weighted terms of the accounts.

    `persons` has (id, name), `accounts` (account, u, name_words, m, as_handle).
    """

    def __init__(self, stage: Stage, persons: DataFrame, accounts: DataFrame, k1: float, b: float):
        self.accounts = accounts
        named = persons.select("id", N.person(F.col("name")).alias("p")).select("id", "p.*").where("last <> ''")
        # Persons of one given name and surname have the same terms, scores and levels: they are one entry of `n_same` persons, under the least id.
        length = F.when(F.col("given") == "", 1).otherwise(2)
        people = named.groupBy("given", "last").agg(F.min("id").alias("person"), F.count(F.lit(1)).alias("n_same"))
        self.people, _, total, words = stage.save_counted(people.withColumn("length", length), F.sum("n_same"), F.sum(F.col("n_same") * F.col("length")))
        mean = words / total if total else 1.0
        # A term stands once in an entry, so an entry's weight is idf times what its length leaves of it.
        self.left = (k1 + 1) / (1 + k1 * (1 - b + b * F.col("length") / mean))
        self.postings = stage.save(self.people.select("person", "n_same", "length", F.explode(N.person_terms(F.col("given"), F.col("last"))).alias("term")))
        makes = _makes_pair(F.col("term"))
        person = F.when(makes, F.col("person"))
        # Most lists that make pairs have one or two entries: these are the least and the greatest, and stand with the list.
        lists = self.postings.groupBy("term").agg(F.sum("n_same").alias("df"), F.min("length").alias("length"), F.count(person).alias("entries"), F.min(person).alias("one"), F.max(person).alias("other"))
        idf = F.log(1 + (F.lit(float(total)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        lists = lists.select("term", "entries", "one", "other", idf.alias("idf"), (idf * self.left).alias("bound"))  # the bound of a list: the weight of its shortest entry
        handle = F.array_distinct(F.concat(N.attribute_terms(F.col("u")), N.attribute_terms(F.col("m"))))
        name = F.concat(N.attribute_terms(F.col("name_words"), slips=True), N.cross_terms(F.col("name_words"), F.concat("u", "m")))
        asked = accounts.select("account", handle.alias("handle"), F.array_distinct(name).alias("name"))
        flagged = lambda terms, of: F.transform(terms, lambda t: F.struct(t.alias("term"), F.lit(of).alias("handle")))
        asked = asked.select("account", F.inline(F.concat(flagged("handle", True), flagged(F.array_except("name", "handle"), False))))
        asked, n_asked = stage.save_counted(asked)
        self.hot = known_hot(asked, ["term"], n_asked)
        over = lambda n: F.sum((F.col("entries") > n).cast("long"))
        self.weighted, _, self.n_many, self.n_long = stage.save_counted(skew_join(asked, lists, ["term"], hot=self.hot), over(2), over(SHORT_LIST))

    def found(self, terms: DataFrame) -> DataFrame:
        """(account, person) of the entries in the postings lists of `terms`, rows of `weighted`."""
        few = terms.where("entries <= 2").select("account", F.explode(F.array("one", "other")).alias("person"))
        many = terms.where("entries > 2").select("account", "term")
        lists = self.postings.where(_makes_pair(F.col("term"))).select("term", "person")
        rest = lists.join(F.broadcast(many), "term") if self.n_many <= MOST_BROADCAST else skew_join(many, lists, ["term"], hot=self.hot)
        return few.unionByName(rest.select("account", "person")).distinct()

    def scored(self, pairs: DataFrame) -> DataFrame:
        """The pairs with BM25 `score` and `score_handle`, and `level`, `level_name` and `level_handle`: what
        all attributes, the name, the handles say."""
        terms = self.weighted.groupBy("account").agg(F.collect_list(F.struct("term", "idf", "handle")).alias("asked"))  # terms of one account
        wide = pairs.join(self.people, "person").join(terms, "account").join(self.accounts, "account")
        given, last, u, m, words = (F.col(c) for c in ("given", "last", "u", "m", "name_words"))
        def score(rows: Column) -> Column:
            # One slip shares several forms: they count once, with the best.
            slip = lambda t: t["term"].startswith("e:")
            sure = F.aggregate(F.filter(rows, lambda t: ~slip(t)), F.lit(0.0), lambda s, t: s + t["idf"])
            return sure + F.coalesce(F.array_max(F.transform(F.filter(rows, slip), lambda t: t["idf"])), F.lit(0.0))

        def scores(common: Column) -> Column:
            return F.struct(score(common).alias("all"), score(F.filter(common, lambda t: t["handle"])).alias("handle"))

        nothing, no = F.lit(NOTHING), F.lit(False)
        wide = wide.select(
            "account", "person", "n_same", "length", let(N.person_terms(given, last), lambda e: let(F.filter("asked", lambda t: F.array_contains(e, t["term"])), scores)).alias("s"),
            F.when(F.col("as_handle") | (words == u), nothing).otherwise(N.says(words, given, last, F.lit(True))).alias("level_name"),
            N.says(u, given, last, no).alias("by_u"), N.says(m, given, last, no).alias("by_m"), F.when(F.col("as_handle"), N.says(words, given, last, no)).otherwise(nothing).alias("by_n"),
            # The given name as the name, and the surname inside a handle.
            ((F.length(given) > 1) & F.array_contains(words, given) & F.exists(F.concat(u, m), lambda p: F.contains(p, last))).alias("apart"),
        )
        conflict = F.lit(CONFLICT)
        wide = wide.withColumn("level_handle", F.when(F.least("by_u", "by_m", "by_n") == conflict, conflict).otherwise(F.greatest("by_u", "by_m", "by_n")))
        level = F.when(F.least("level_name", "level_handle") == conflict, conflict).otherwise(F.greatest("level_name", "level_handle"))
        wide = wide.withColumn("level", F.when((level == ONE) & F.col("apart"), FULL).otherwise(level))
        return wide.select("account", "person", "n_same", (self.left * F.col("s.all")).alias("score"), (self.left * F.col("s.handle")).alias("score_handle"), "level", "level_name", "level_handle")


def _nearest(rows: DataFrame, score: str) -> DataFrame:
    """The best person of each account with the score of the `next` one, namesakes being next to each other."""
    w = Window.partitionBy("account").orderBy(F.col(score).desc(), F.col("person"))
    second = F.when(F.col("n_same") > 1, F.col(score)).otherwise(F.coalesce(F.lead(score).over(w), F.lit(0.0)))
    return rows.withColumns({"rank": F.row_number().over(w), "next": second}).where("rank = 1").drop("rank")


def candidates(index: _Index, stage: Stage, short_list: int = SHORT_LIST) -> DataFrame:
    """All pairs, scored, that can be among the two best eligible persons of an account.

    An eligible pair shares a term of both names (k: or e:), so only these lists are read (the others
    count as empty): first the short ones. A pair in long lists only scores no more than the bounds of the account's long lists and
    single names together; where that is no more than the second best score found, the long lists
    can't change the two best, and are not read for that account. No eligible pair is lost by a cut.
    """
    first = stage.save(index.scored(index.found(index.weighted.where(F.col("entries").between(1, short_list)))))
    if not index.n_long and short_list == SHORT_LIST:
        return first
    second = _nearest(first.where(f"level >= {INITIAL}"), "score").select("account", F.col("next").alias("second"))
    slip = F.col("term").startswith("e:")
    open_ = index.weighted.where((F.col("entries") == 0) | (F.col("entries") > short_list)).groupBy("account").agg(
        (F.coalesce(F.sum(F.when(~slip, F.col("bound"))), F.lit(0.0)) + F.coalesce(F.max(F.when(slip, F.col("bound"))), F.lit(0.0))).alias("most"), F.max("entries").alias("long")
    )
    unsure = open_.where("long > 0").join(second, "account", "left").where("second is null or most > second").select("account")
    more = index.found(index.weighted.where(F.col("entries") > short_list).join(unsure, "account", "left_semi")).join(first.select("account", "person"), ["account", "person"], "left_anti")
    return first.unionByName(stage.save(index.scored(more)))


def _logistic(rows: np.ndarray) -> tuple[float, float]:
    """Intercept and slope of outcome (column 1) on gap (column 0), by Newton's method with a little shrinkage."""
    x, y = np.column_stack([np.ones(len(rows)), rows[:, 0]]), rows[:, 1]
    if len(rows) < 50 or y.min() == y.max():
        return DEFAULT
    b = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ b))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 1e-2 * np.eye(2), x.T @ (y - p) - 1e-2 * b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return float(b[0]), float(b[1])


def match_people(persons: DataFrame, accounts: DataFrame, *, least_confidence: float = 0.5, k1: float = K1, b: float = B, near_share: float = NEAR_SHARE, short_list: int = SHORT_LIST) -> DataFrame:
    """(researcher_id, developer_account_id, confidence, score, gap, level) of pairs that are one person.

    `persons` has (id, name), `accounts` (id, username, name, email). An account's nearest person is
    the best by BM25 over the terms of all attributes among those whom no attribute contradicts (a
    different given name, another initial) and with whom at least initial and surname agree. The pair
    is mutual if the account is also a near one of that person: of at least `near_share` of the score of
    its best account, however many it has. The gap to the next eligible person gives the confidence
    through a logistic curve that is fitted on the accounts that have both a name and a telling handle:
    what the handles alone would find is held against the name (at most SAMPLE rows, the first by hash).

    Defined cases: null or empty attributes say nothing, nor do those of more than MOST_WORDS words; a
    record with no name and no telling handle matches nobody; namesakes tie, so none of them is
    matched; repeated rows of one id count once; ties go to the smaller id; empty tables give no rows;
    further columns are ignored.

    Scale: words, terms and levels are native expressions; the index is over different names rather
    than persons; long postings lists are read only for accounts whose bound leaves them a chance
    (`candidates`); hot terms meet their lists in a bounded broadcast; nothing but the bounded sample,
    hot keys and counts reaches the driver.
    """
    stage = Stage(persons.sparkSession)
    persons = persons.select(F.col("id").cast("long").alias("id"), "name").where("id is not null").dropDuplicates(["id"])
    accounts = accounts.select(F.col("id").cast("long").alias("account"), "username", "name", "email").where("account is not null").dropDuplicates(["account"])
    parts = N.handle_parts(N.plain(F.col("username"))).alias("u"), N.name_parts(F.col("name")).alias("name_words"), N.mail_parts(F.col("email")).alias("m")
    accounts = stage.save(accounts.select("account", *parts, N.has_digits(F.col("name")).alias("as_handle")))
    checked = candidates(_Index(stage, persons, accounts, k1, b), stage, short_list)

    gap = F.greatest(F.least(F.col("score") - F.col("next"), F.lit(GAP_CAP)), F.lit(0.0))
    trial = _nearest(checked.where(f"level_handle >= {INITIAL}").withColumn("score", F.col("score_handle")), "score").where(f"level_name = {CONFLICT} or level_name >= {INITIAL}")
    sample = trial.select(gap.alias("gap"), (F.col("level_name") >= INITIAL).cast("double").alias("right")).orderBy(F.xxhash64("account", F.lit(7))).limit(SAMPLE)
    c0, c1 = _logistic(np.array([tuple(r) for r in sample.collect()], float).reshape(-1, 2))
    best, n_best = stage.save_counted(_nearest(checked.where(f"level >= {INITIAL}"), "score").withColumn("gap", gap))
    best_of = best.groupBy("person").agg(F.max("score").alias("top"))
    best = skew_join(best, best_of, ["person"], total=n_best).where(F.col("score") >= F.lit(near_share) * F.col("top"))
    best = best.withColumn("confidence", 1 / (1 + F.exp(-(F.lit(c0) + F.lit(c1) * F.col("gap")))))
    return best.where((F.col("gap") > 0) & (F.col("confidence") >= least_confidence)).select(
        F.col("person").alias("researcher_id"), F.col("account").alias("developer_account_id"), "confidence", "score", "gap", "level"
    )
