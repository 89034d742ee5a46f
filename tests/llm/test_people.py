"""Consensus of annotators and matching of people."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quillgraph.llm import consensus, matching
from quillgraph.llm import names as N
from quillgraph.runtime import Stage


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


UNIT = "unit_id long, `eva-contrib-type` string, `nic-contrib-type` string, `eva-is_actually_author` string, `nic-is_actually_author` string, question string"
ANN = "unit_id long, annotator string, contrib_type string, is_actually_author string, labelled_datetime timestamp_ntz, label string"


def test_votes_are_tidied_and_counted_once(spark):
    from datetime import datetime

    t1, t2 = datetime(2024, 1, 1), datetime(2024, 1, 2)
    units = spark.createDataFrame([(1, "Docs", " oth", "y", None, "q"), (2, None, "", "maybe", "NO ", "q"), (None, "code", "code", "no", "no", "q")], UNIT)
    ann = spark.createDataFrame([(1, "a", "code ", "unclear?", t1, "l"), (1, "a", "docs", "n", t2, "l"), (1, "b", "o", "?", None, "l"), (1, None, "code", "no", t1, "l"), (3, "a", "c", "yes", None, "l")], ANN)
    assert rows(consensus.votes(units, ann)) == [
        (1, "contrib_type", "a", "docs"), (1, "contrib_type", "b", "other"), (1, "contrib_type", "eva", "docs"), (1, "contrib_type", "nic", "other"), (1, "is_actually_author", "a", "no"), (1, "is_actually_author", "eva", "yes"),
        (2, "is_actually_author", "nic", "no"), (3, "contrib_type", "a", "code"), (3, "is_actually_author", "a", "yes"),
    ]


@pytest.fixture(scope="module")
def noisy(spark):
    r = random.Random(2)
    labels = consensus.LABELS["contrib_type"]
    truth = {u: r.choice(labels) for u in range(400)}
    care = {"good1": 0.05, "good2": 0.08, "mid": 0.3, "bad1": 0.65, "bad2": 0.66, "bad3": 0.66}
    votes = [(u, "contrib_type", a, r.choice([x for x in labels if x != t]) if r.random() < e else t) for u, t in truth.items() for a, e in care.items() if r.random() < 0.8]
    votes += [(u, "contrib_type", "rare", t) for u, t in list(truth.items())[:2]]
    return truth, care, spark.createDataFrame(votes, "unit_id long, question string, annotator string, answer string")


def test_consensus_beats_the_majority_and_finds_the_careful(noisy):
    truth, care, votes = noisy
    out = consensus.discover(votes)
    labels = {r["unit_id"]: r["label"] for r in out.labels.collect()}
    right = sum(labels[u] == truth[u] for u in labels) / len(labels)
    count = {}
    for r in votes.collect():
        count.setdefault(r["unit_id"], {}).setdefault(r["answer"], []).append(1)
    # The best that can be reached: votes weighted by the true error rates.
    weight = {a: math.log((1 - e) * 2 / e) for a, e in care.items()} | {"rare": 5.0}
    best: dict = {}
    for r in votes.collect():
        u = best.setdefault(r["unit_id"], {})
        u[r["answer"]] = u.get(r["answer"], 0) + weight[r["annotator"]]
    bound = sum(max(sorted(c), key=c.get) == truth[u] for u, c in best.items()) / len(best)
    majority = sum(max(sorted(c), key=lambda k: len(c[k])) == truth[u] for u, c in count.items()) / len(count)
    assert len(labels) == len(count) and right > bound - 0.02 and right > majority + 0.1
    people = {r["annotator"]: r for r in out.annotators.collect()}
    assert all(abs(people[a]["error_rate"] - e) < 0.12 for a, e in care.items())
    assert people["rare"]["weight"] < people["mid"]["weight"] < people["good1"]["weight"] and all(p["error_bound"] >= p["error_rate"] - 0.05 for p in people.values())


def _plain(votes, weigh, rounds):
    """The same method over a list of (unit, annotator, answer), one after the other."""
    labels = consensus.LABELS["contrib_type"]
    by, told = {}, {}
    for u, a, y in votes:
        by.setdefault(u, []).append((a, y))
        told.setdefault(a, []).append((u, y))
    weight = dict.fromkeys(told, 1.0)
    for _ in range(rounds):
        best = {u: max(labels, key=lambda t: (sum(weight[a] for a, y in vs if y == t), [-labels.index(t)])) for u, vs in by.items()}
        weight = {a: weigh(consensus.error_bound(len(vs), sum(best[u] != y for u, y in vs)), 3) for a, vs in told.items()}
    return {u: max(labels, key=lambda t: (sum(weight[a] for a, y in vs if y == t), [-labels.index(t)])) for u, vs in by.items()}, weight


@pytest.mark.parametrize("weigh", [consensus.log_odds, consensus.inverse])
def test_consensus_equals_the_plain_form_in_every_way(noisy, spark, weigh, monkeypatch):
    _, _, votes = noisy
    first = consensus.discover(votes, weigh=weigh)
    want, weight = _plain([(r["unit_id"], r["annotator"], r["answer"]) for r in votes.collect()], weigh, first.rounds)
    assert first.settled and {r["unit_id"]: r["label"] for r in first.labels.collect()} == want
    assert {r["annotator"]: pytest.approx(r["weight"]) for r in first.annotators.collect()} == weight
    joined = consensus.discover(votes, weigh=weigh, most_annotators=1)
    assert rows(joined.labels.select("unit_id", "label", "n_answers", "agreement")) == rows(first.labels.select("unit_id", "label", "n_answers", "agreement"))
    monkeypatch.setattr(consensus, "known_hot", lambda df, keys, total=None: df.where("unit_id < 20").select(*keys).distinct())
    hot = consensus.discover(votes, weigh=weigh)
    assert rows(hot.labels.select("unit_id", "label", "n_answers", "agreement")) == rows(first.labels.select("unit_id", "label", "n_answers", "agreement"))


def test_made_labels_with_a_long_tail(spark):
    """Annotators as in the real answers: careful, coarse, biased to one label, and two hundred of a few answers each."""
    r = random.Random(8)
    labels = consensus.LABELS["contrib_type"]
    truth = {u: r.choices(labels, (6, 2, 2))[0] for u in range(1500)}

    def answer(kind, t):
        if kind[0] == "biased":
            return kind[1] if r.random() < 0.8 else t
        return t if r.random() < kind[1] else r.choice([x for x in labels if x != t])

    kinds = {f"a{i}": k for i, k in enumerate([("even", 0.93)] * 3 + [("even", 0.75)] * 3 + [("biased", "code")] * 2 + [("biased", "other")] * 2 + [("even", 0.34)])}
    votes = [(u, "contrib_type", a, answer(k, t)) for u, t in truth.items() for a, k in kinds.items() if r.random() < (0.9 if a in ("a0", "a3") else 0.35)]
    tail = {f"t{i}": ("even", r.choice([0.4, 0.9])) for i in range(200)}
    votes += [(u, "contrib_type", a, answer(k, truth[u])) for a, k in tail.items() for u in r.sample(range(1500), 3)]
    df = spark.createDataFrame(votes, "unit_id long, question string, annotator string, answer string")

    def accuracy(weigh):
        out = consensus.discover(df, weigh=weigh)
        got = {x["unit_id"]: x["label"] for x in out.labels.collect()}
        return sum(got[u] == truth[u] for u in got) / len(got), out

    (named, out), (plain, _) = accuracy(consensus.log_odds), accuracy(consensus.inverse)
    majority, _ = accuracy(lambda bound, k: 1.0)
    assert named > 0.95 and named > majority + 0.03 and named >= plain - 0.005, (named, plain, majority)
    weight = {x["annotator"]: x["weight"] for x in out.annotators.collect()}
    assert max(weight[a] for a in tail) < min(weight[a] for a, k in kinds.items() if k == ("even", 0.93))


def test_consensus_of_little(spark):
    schema = "unit_id long, question string, annotator string, answer string"
    one = consensus.discover(spark.createDataFrame([(1, "contrib_type", "a", "docs")], schema)).labels.first()
    assert (one["label"], one["n_answers"], one["agreement"]) == ("docs", 1, 1.0)
    tie = consensus.discover(spark.createDataFrame([(1, "contrib_type", "a", "docs"), (1, "contrib_type", "b", "code")], schema)).labels.first()
    assert tie["label"] == "code"
    assert consensus.discover(spark.createDataFrame([], schema)).labels.count() == 0


def test_agreement(spark):
    schema = "unit_id long, question string, annotator string, answer string"
    same = spark.createDataFrame([(u, "q", a, "x" if u < 3 else "y") for u in range(6) for a in "ab"] + [(9, "q", "a", "x")], schema)
    r = consensus.agreement(same).first()
    assert (r["n_units"], r["n_answers"], r["observed"], r["alpha"]) == (6, 12, 0.0, 1.0)
    assert consensus.agreement(same.where("answer = 'x'")).first()["alpha"] is None


PEOPLE = [(1, "Harena Vegrozør"), (2, "Tothune Husadėnas"), (3, "Wumé Tuloböm"), (4, "Zivis Niminic"), (5, "Ann Samename"), (6, "Ann Samename"), (7, "B. Rikregen"), (8, "Yaldo Rezugell"), (9, "Yeldis Otherone"), (10, None), (11, ""), (12, "Xulo Kilovola")]
ACCOUNTS = [
    (1, "hvegrozor1993", "Harena Vegrozør", "harena.vegrozor@mail.example"), (2, "husadenast", "Husadėnas, Tothune", None), (3, "mossy-tapir332", "  Prof. Wumé Tulobböm 🌱", "w.tulobom@mail.example"), (4, "z1v1s_n1m1n1c", "brisk-ibis411", None),
    (5, "asamename", "Ann Samename", None), (6, "stray77", "B. Rikregen", None), (7, "yotherone", "Yaldo Otherone", None), (8, "build-crane-6", "The build ibis group", "root@localhost"), (9, "x", None, ""), (10, None, None, None), (11, "kilovolax", "X", None),
    (12, "tothune-husadenas", None, "tothune [dot] husadenas [at] mail.example"),
]


def test_matching(spark):
    p = spark.createDataFrame([(*x, 1.0) for x in PEOPLE], "id long, name string, account double")
    a = spark.createDataFrame([(*x, "t") for x in ACCOUNTS] + [(*ACCOUNTS[0], "t")], "id long, username string, name string, email string, person string")
    out = matching.match_people(p, a, least_confidence=0.0)
    assert rows(out.select("researcher_id", "developer_account_id")) == [(1, 1), (12, 11), (2, 12), (2, 2), (3, 3), (4, 4), (7, 6)]
    assert matching.match_people(p.where("false"), a).count() == 0 and matching.match_people(p, a.where("false")).count() == 0


def test_hot_terms_are_no_candidates_but_count(spark):
    p = spark.createDataFrame([(i, f"Ann Person{'abcdefghij'[i // 10]}{'abcdefghij'[i % 10]}") for i in range(100)] + [(i, f"Ann X{'abcdefghij'[i % 10]}y") for i in range(100, 105)], "id long, name string")
    a = spark.createDataFrame([(1, "q1", "Ann Personab", None), (2, "q2", "Ann", None)], "id long, username string, name string, email string")
    assert rows(matching.match_people(p, a, least_confidence=0.0).select("researcher_id", "developer_account_id")) == [(1, 1)]


def test_a_frequent_initial_and_surname_hides_nobody(spark):
    given = ["J" + a + b for a in "abcdefghijklm" for b in "nopqrstuvwxy"]
    p = spark.createDataFrame([(i, f"{g} Hollander") for i, g in enumerate(given)] + [(1000 + i, f"Jonas Samesame{'abc'[i % 3]}") for i in range(150)] + [(2000 + i, f"Fill Er{'abcdefghijklmnopqrstuvwxyz'[i % 26]}on{i // 26 * 'x'}") for i in range(2600)], "id long, name string")
    a = spark.createDataFrame([(1, "q1", f"{given[7]} Hollander", None), (2, "jhollander", None, None), (3, "q3", "Jonas Samesamea", None), (4, "hollander-77", given[9], None)], "id long, username string, name string, email string")
    out = matching.match_people(p, a, least_confidence=0.0)
    assert rows(out.select("researcher_id", "developer_account_id")) == [(7, 1), (9, 4)]


def test_a_person_may_have_many_accounts(spark):
    p = spark.createDataFrame([(1, "Harena Vegrozor"), (2, "Tothune Husadenas")], "id long, name string")
    a = spark.createDataFrame([(i, f"q{i}", "Harena Vegrozor", None) for i in range(5)] + [(9, "hvegrozor", None, None)], "id long, username string, name string, email string")
    assert rows(matching.match_people(p, a, least_confidence=0.0).select("researcher_id", "developer_account_id")) == [(1, i) for i in (0, 1, 2, 3, 4, 9)]


def _made(seed, n_people, n_bots):
    """(persons, accounts, truth): invented people of whom some own one or two accounts in several notations, and accounts of nobody."""
    r = random.Random(seed)
    part = lambda: r.choice("bdfgklmnprstvz") + r.choice("aeiou")
    word = lambda k: "".join(part() for _ in range(k)) + r.choice("nrslk")
    given, last = [word(2) for _ in range(60)], [word(3) for _ in range(n_people)]
    slip = lambda w: w[: (i := r.randrange(1, len(w)))] + r.choice(["", w[i], "x"]) + w[i + 1 :]
    people, accounts, truth, taken = [], [], set(), set()
    for i in range(n_people):
        g, n = r.choice(given), r.choice(last)
        people.append((i, r.choice([f"{g} {n}", f"{n}, {g}", f"{g} {r.choice('ABC')}. {n}"]).title()))
        unique = (g, n) not in taken
        taken.add((g, n))
        for _ in range(r.choice([0, 0, 1, 1, 2])):
            a = len(accounts)
            junk = f"{r.choice(['lunar', 'rusty', 'calm'])}-{r.choice(['fox', 'newt', 'ibis'])}{a}"
            forms = [(junk, f"{g} {n}", None), (f"{g}{n}", None, None), (f"{g[0]}{n}{a % 90}", f"{n}, {g}", None), (junk, f"{g} {slip(n)}", f"{g}.{n}@mail.example"), (f"{n}{g[0]}", f"{g}", ""), (f"{g}-{n}", junk, f"77+{junk}@users.example"), (junk, None, f"{g}.{n}@x.example"), (junk, f"{g.upper()} {n.upper()}, PhD", f"{n}.{g}@x.example")]
            accounts.append((a, *r.choice(forms)))
            if unique:
                truth.add((i, a))
    for _ in range(n_bots):
        a = len(accounts)
        accounts.append((a, f"{r.choice(['build', 'sync', 'quiet'])}-{r.choice(['crane', 'owl'])}-{a}", r.choice([None, "", "The build group", r.choice(given)]), r.choice([None, "root@localhost"])))
    return people, accounts, truth


def _frames(spark, people, accounts):
    return spark.createDataFrame(people, "id long, name string"), spark.createDataFrame(accounts, "id long, username string, name string, email string")


def test_planted_people_are_found(spark):
    people, accounts, truth = _made(5, 1500, 400)
    names = {}
    for i, n in people:
        names.setdefault(matching_key(n), []).append(i)
    same = {i for x in names.values() if len(x) > 1 for i in x}
    truth = {x for x in truth if x[0] not in same}
    p, a = _frames(spark, people, accounts)
    got = {(x[0], x[1]) for x in matching.match_people(p, a).select("researcher_id", "developer_account_id").collect()}
    assert len(truth) > 800 and len(got & truth) >= 0.95 * len(truth) and len(got & truth) >= 0.98 * len(got), (len(truth), len(got), len(got & truth))
    # Reading long lists by their bounds only, however short a list must be, changes nothing.
    k = ["researcher_id", "developer_account_id", "score", "gap"]
    want = rows(matching.match_people(p, a).select(*k))
    for short in (0, 1, 3):
        assert rows(matching.match_people(p, a, short_list=short).select(*k)) == want


def matching_key(name):
    first, last = name.lower().split(", ")[::-1] if "," in name else (name.lower().split()[0], name.lower().split()[-1])
    return first, last


def test_scores_and_pairs_equal_brute_force(spark):
    people, accounts, _ = _made(6, 150, 40)
    p, a = _frames(spark, [*people, (900, "J. Bell"), (901, "Bell"), (902, "Li, Bo"), (903, None)], [*accounts, (900, "jbell", None, None), (901, "bell", "Bo Li", None), (902, "boli", "Bol Lii", "li.bo@x.example")])
    index = matching._Index(stage := Stage(spark), p, _parts(a), 1.2, 0.75)
    entries = {r["person"]: r for r in index.people.collect()}
    terms = {i: set(r[0]) for i in entries for r in spark.createDataFrame([(entries[i]["given"], entries[i]["last"])], "g string, l string").select(N.person_terms(F.col("g"), F.col("l"))).collect()}
    asked = {}
    for r in index.accounts.select("account", F.concat(N.attribute_terms(F.col("u")), N.attribute_terms(F.col("m")), N.attribute_terms(F.col("name_words"), True), N.cross_terms(F.col("name_words"), F.concat("u", "m"))).alias("t")).collect():
        asked[r["account"]] = set(r["t"])
    total = sum(e["n_same"] for e in entries.values())
    df = {}
    for i, ts in terms.items():
        for t in ts:
            df[t] = df.get(t, 0) + entries[i]["n_same"]
    mean = sum(e["n_same"] * e["length"] for e in entries.values()) / total

    def score(account, person):
        common = asked[account] & terms[person]
        w = lambda t: math.log(1 + (total - df[t] + 0.5) / (df[t] + 0.5)) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * entries[person]["length"] / mean))
        return sum(w(t) for t in common if t[0] != "e") + max([w(t) for t in common if t[0] == "e"], default=0)

    got = {(r["account"], r["person"]): r["score"] for r in matching.candidates(index, stage).collect()}
    pairs = {(x, y) for x, ts in asked.items() for y in terms if any(t[0] in "ke" for t in ts & terms[y])}
    assert len(pairs) > 100 and set(got) == pairs
    assert all(got[x] == pytest.approx(score(*x)) for x in pairs)


def _parts(accounts):
    parts = N.handle_parts(N.plain(F.col("username"))).alias("u"), N.name_parts(F.col("name")).alias("name_words"), N.mail_parts(F.col("email")).alias("m")
    return accounts.select(F.col("id").alias("account"), *parts, N.has_digits(F.col("name")).alias("as_handle"))


SAYS = [
    (["ann", "bell"], "ann", "bell", True, N.FULL), (["a", "bell"], "ann", "bell", True, N.INITIAL), (["ada", "bell"], "ann", "bell", True, N.CONFLICT), (["annbell"], "ann", "bell", False, N.FULL),
    (["abell"], "ann", "bell", False, N.INITIAL), (["xbell"], "ann", "bell", False, N.CONFLICT), (["rusty", "newt"], "ann", "bell", False, N.NOTHING), (["ann", "grunimeau"], "ann", "gruniemau", True, N.FULL), ([], "ann", "bell", True, N.NOTHING),
    (["bell", "ann", "bell"], "ann", "bell", True, N.FULL), (["ann"], "ann", "bell", True, N.ONE), (["ann", "b"], "ann", "bell", True, N.ONE), (["j", "bell"], "j", "bell", True, N.INITIAL), (["jo", "bell"], "j", "bell", True, N.INITIAL), (["bell"], "", "bell", False, N.ONE),
    (["x", "bell"], "", "bell", True, N.ONE), (["ann", "kok"], "ann", "kokr", True, N.CONFLICT), (["ann", "kokrmbetti"], "ann", "kokrembetti", True, N.FULL),
]


def test_what_attributes_say(spark):
    df = spark.createDataFrame(SAYS, "parts array<string>, given string, last string, prose boolean, level int")
    assert df.select("*", N.says(F.col("parts"), F.col("given"), F.col("last"), F.col("prose")).alias("got")).where("got <> level").collect() == []


def test_words_of_attributes(spark):
    u = {"hvegrozor1993": ["hvegrozor"], "z1v1s_n1m1n1c": ["zivis", "niminic"], "30666073x": ["x"], "": [], None: [], "a-b--c": ["a", "b", "c"]}
    n = {"Prof. Wumé Tulobböm 🌱": ["wume", "tulobbom"], "Husadėnas, Tothune": ["tothune", "husadenas"], "B. Rikregen (she)": ["b", "rikregen"], "Ann Bell | Lab": ["ann", "bell"], "w " * 40: [], "Ｊøhn Łuß": ["john", "luss"], None: []}
    m = {"w.tulobom@mail.example": ["w", "tulobom"], "1234+q.x@users.example": ["q", "x"], "a [dot] b [at] c.example": ["a", "b"], "nobody": [], None: []}
    for given, f in ((u, lambda c: N.handle_parts(N.plain(c))), (n, N.name_parts), (m, N.mail_parts)):
        df = spark.createDataFrame([(k, v) for k, v in given.items()], "x string, want array<string>")
        assert df.select("*", f(F.col("x")).alias("got")).where("got <> want").collect() == []
    p = {"Ann B. Bell": ("ann", "bell"), "Bell, Ann": ("ann", "bell"), "Bell": ("", "bell"), "": ("", ""), None: ("", ""), "Ölaf Ünder-Straße": ("olaf", "strasse")}
    df = spark.createDataFrame(list(p.items()), "x string, want struct<given:string,last:string>")
    assert df.select("*", N.person(F.col("x")).alias("got")).where("got <> want").collect() == []


def test_an_account_far_below_its_persons_best_is_no_near_one(spark):
    p, a = _frames(spark, [(1, "Harena Vegrozor"), (2, "Tothune Husadenas")], [(1, "harena-vegrozor", "Harena Vegrozor", "harena.vegrozor@x.example"), (2, "vegrozorh", None, None)])
    assert rows(matching.match_people(p, a, least_confidence=0.0).select("developer_account_id")) == [(1,), (2,)]
    assert rows(matching.match_people(p, a, least_confidence=0.0, near_share=0.9).select("developer_account_id")) == [(1,)]
