"""Visual forms, leaks and packing."""

import random
import unicodedata

import pytest

from quillgraph.llm import leakage, lookalikes, packing


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def _docs(spark, texts):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, look string, id string")


SAME = [
    ("A plain sentence with café.", "A plain sentence with café."), ("figure of the official file", "ﬁgure of the oﬃcial ﬁle"), ("Kit costs 5 %", "Kit costs 5 ％"),
    ("source-based", "source‑based"), ("wide text", "ｗｉｄｅ ｔｅｘｔ"), ("problems", "prοblеms"), ("in­visible", "invi​sible﻿"), ("naïve Їжак", "naїve Їжак"), ("with μ set, ∆ too", "with µ set, Δ too"), ("", "​"),
]
DIFFERENT = [("Case", "case"), ("cafe", "café"), ("70 %", "⁷0 %"), ("a b", "a\nb"), ("a b", "ab"), ("x-y", "x–y"), ("Höfen", "Hofen")]


@pytest.mark.parametrize(("a", "b"), SAME)
def test_same_look(spark, a, b):
    assert rows(lookalikes.look_pairs(_docs(spark, [a, b]))) == [(0, 1)]


PROBES = ["օo", "սu", "հh", "ӏi", "ɡg", "ԚQ", "ԜW", "ҮY", "ѵv", "‒-", "−-", "ⅼl", "𝐀A", "ГΓ", "ПΠ", "ФΦ", "ϲc", "ＡA", "АA", "µμ", "КK"]
LONG_PROBES = [("ĳ", "ij"), ("ǆ", "dž"), ("Ⅳ", "IV"), ("a\u2065b", "ab"), ("a\u180fb", "ab"), ("ў", "y̆"), ("ﬓ", "մն"), ("ё", "e\u0308"), ("Ά", "A\u0301")]
SHOWS = ["ſs", "ßB", "ßβ", "²2", "ıi", "гr", "αa", "ρp", "x–", "lI", "l1", "O0", "éê", "’'", "ϑθ"]


def _forms(texts, any_case=False):
    con = lookalikes.connect()
    con.execute("CREATE TABLE b (id INTEGER, text VARCHAR)")
    con.executemany("INSERT INTO b VALUES (?, ?)", list(enumerate(texts)))
    return [x for _, x in sorted(con.sql(f"SELECT id, s4 FROM ({lookalikes.steps_sql('b', 'text', 'id', any_case=any_case)})").fetchall())]


def test_probes_of_the_letter_table():
    pairs = [*PROBES, *LONG_PROBES]
    left, right = _forms([a for a, _ in pairs]), _forms([b for _, b in pairs])
    assert [p for p, a, b in zip(pairs, left, right) if a != b] == []
    assert [p for p, a, b in zip(SHOWS, _forms([a for a, _ in SHOWS]), _forms([b for _, b in SHOWS])) if a == b] == []
    for any_case in (False, True):  # the form of a form is itself
        first = _forms(list(lookalikes.table(any_case)), any_case)
        assert _forms(first, any_case) == first
    assert sum(len(t) for t in lookalikes.tables()) > 1500


def test_letters_are_in_the_public_table_of_confusables(spark):
    checker = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    look = lambda text: checker.getSkeleton(0, text)
    assert {a for a, b in lookalikes.LETTERS.items() if look(a) != look(b)} == {"Ԛ"}  # the capital of a letter that is in it


def test_different_look_and_copies(spark):
    texts = [t for pair in DIFFERENT for t in pair] + [None, "A plain text", "A plain text", "A plain text"]
    n = len(texts)
    assert rows(lookalikes.look_pairs(_docs(spark, texts))) == [(n - 3, n - 1), (n - 2, n - 1)]
    assert rows(lookalikes.look_classes(_docs(spark, texts))) == [(i, n - 3, 2) for i in (n - 3, n - 2, n - 1)]
    assert lookalikes.look_pairs(_docs(spark, [])).count() == 0


def test_canonical_keeps_what_shows(spark):
    long = "Zeile ｅｉｎｓ\t\n" * 50_000
    got = dict(rows(lookalikes.canonical_texts(_docs(spark, [None, "", long, "A B² ﬁn"]))))
    assert got[0] is None and got[1] == "" and got[2] == "Zeile eins\t\n" * 50_000 and got[3] == "A B² fin"


def test_slices_lose_nothing():
    import pyarrow as pa

    texts = ["a" * n for n in (5, 0, 30, 1, 1, 1)] + [None, "b"]
    b = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(texts, pa.string())], ["id", "text"])
    parts = [p.column(1).to_pylist() for p in lookalikes.slices(b, most=7)]
    assert [t for p in parts for t in p] == texts and parts[:2] == [["a" * 5, ""], ["a" * 30]]
    assert list(lookalikes.slices(b.slice(0, 0))) == []


def test_skipping_nfc_changes_nothing():
    import regex

    plain = regex.compile("[" + lookalikes.COMPOSED.replace("\\x{", "\\u").replace("}", "").replace("\\u00-\\u2FF", "\\x00-\\u02FF").replace("\\u384", "\\u0384").replace("\\u386", "\\u0386").replace("\\u388", "\\u0388").replace("\\u482", "\\u0482").replace("\\u48A", "\\u048A").replace("\\u52F", "\\u052F") + "]")
    chars = [c for c in map(chr, range(0x10000)) if plain.fullmatch(c)]
    assert len(chars) > 1000 and all(unicodedata.normalize("NFC", c) == c and not unicodedata.combining(c) for c in chars)


ITEM = "Read the passage. When nine curators at Höfen inspected 1049 repositories about distillation, they saw that β had changed."


def _leak(spark, texts, items=((7, ITEM),), **k):
    df = spark.createDataFrame(list(items), "item_id long, text string")
    return [r[0] for r in rows(leakage.leaks(_docs(spark, texts), df, **k).select("doc_id"))]


def test_leaks(spark):
    texts = [
        "x " + ITEM + " y", "when NINE curators AT HÖFEN, inspected (1049) repositories: about distillation", "when nine curators at Höfen inspected 1049 repositories about",
        "> when nine cura-\n> tors at Höfen inspected 1049 repositories about distillation they", "when nine curators at Höfen inspected 1049 repositories about-\ndistillation they",
        "when nine curatоrs at Höfen inspected 1049 reposit​ories about distillation", "when nine curators at Hofen inspected 1049 repositories about distillation", None, "",
        "about distillation, they saw that B had changed. Read", "REPOSITORIES ABOUT DISTILLATION THEY SAW THAT Β HAD CHANGED 1049", "inspected 1049 repositories about distillation they saw that β had changed",
        "w" * 30_000 + " " + "filler " * 20_000 + ITEM,
    ]
    assert _leak(spark, texts) == [0, 1, 11, 12, 3, 4, 5]
    assert _leak(spark, texts, block_chars=10) == _leak(spark, texts)


def test_leaks_of_odd_items(spark):
    docs = [ITEM]
    assert _leak(spark, docs, [(1, "too short an item"), (2, None), (None, ITEM)]) == []
    assert rows(leakage.leaks(_docs(spark, docs * 2), spark.createDataFrame([(1, ITEM), (2, ITEM), (2, ITEM)], "item_id long, text string"))) == [(0, 1), (0, 2), (1, 1), (1, 2)]
    assert _leak(spark, [], [(1, ITEM)]) == [] and leakage.leaks(_docs(spark, docs), spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_leaks_equal_brute_force(spark):
    r = random.Random(3)
    words = [f"w{i}" for i in range(6)]
    items = [(i, " ".join(r.choices(words, k=30))) for i in range(5)]
    docs = [" ".join(r.choices(words, k=400) + items[r.randrange(5)][1].split()[5 : 5 + r.randrange(8, 14)]) for _ in range(40)]
    grams = [(i, {tuple(t.split()[k : k + 10]) for k in range(21)}) for i, t in items]
    want = sorted((d, i) for d, t in enumerate(docs) for i, g in grams if any(tuple(t.split()[k : k + 10]) in g for k in range(len(t.split()) - 9)))
    got = leakage.leaks(_docs(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(tuple(x) for x in got.collect()) == want and want


def test_decontaminate(spark):
    items = spark.createDataFrame([(7, ITEM), (8, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda")], "item_id long, text string")
    texts = ["Before. " + ITEM.upper() + " After.", "clean", None, "one alpha BETA gamma del-\nta epsilon zeta eta theta iota kappa lambda two"]
    for block in (10, 1000):
        got = {r[0]: r[1] for r in leakage.decontaminate(_docs(spark, texts), items, block_chars=block).collect()}
        assert got == {0: "Before. . After.", 1: "clean", 2: None, 3: "one  two"}
    assert [r[0] for r in rows(leakage.decontaminate(_docs(spark, texts), items, remove="documents"))] == [1, 2]


def test_overlapping_items_are_cut_alike_in_any_number_of_blocks(spark):
    w = [f"w{i}" for i in range(40)]
    items = spark.createDataFrame([(i, " ".join(w[i * 5 : i * 5 + 14])) for i in range(6)], "item_id long, text string")
    texts = [" ".join(["a", *w[3:30], "b"]), " ".join([*w[0:6], *w[0:14], *w[6:14]]), None, "fine", " ".join(w[2:12])] * 2
    docs = spark.createDataFrame([(1, t) for t in texts], "doc_id long, text string")
    one, many = (leakage.decontaminate(docs, items, block_chars=c) for c in (10_000, 60))
    assert rows(one) == rows(many) and leakage.leaks(many, items).count() == 0 and many.count() == 10


def test_a_long_item_is_read_in_parts(spark, monkeypatch):
    monkeypatch.setattr(leakage, "CHUNK_WORDS", 7)
    w = [f"w{i}" for i in range(40)]
    docs = [" ".join(["x", *w[i : i + 10], "y"]) for i in range(31)] + [" ".join(w[:9])]
    assert _leak(spark, docs, [(1, " ".join(w))]) == sorted(range(31), key=str)


def test_cut_documents_leak_no_more(spark):
    items = spark.createDataFrame([(7, "we saw a well known example of nine curators at work in Höfen today")], "item_id long, text string")
    texts = [
        "A. we saw a well-\nknown exam-\nple of nine curators at work B.", "A. a well known exam\u00ad\nple of nine curators at work in B.", "A. a well known exam-\u200b\nple of nine curators at work in B.",
        "A. a well-\n> known ex\u00adample of nine cu\u200brators at work in Ho\u0308fen B.", "known example of nine curators we saw a well known example of nine curators at work in Höfen today at work in Höfen today", "fine",
    ]
    docs = _docs(spark, texts)
    assert len(rows(leakage.leaks(docs, items))) == 5
    out = leakage.decontaminate(docs, items)
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in out.collect()}
    assert {i: got[i][0] for i in range(4)} == dict.fromkeys(range(4), "A.  B.") and got[5] == ("fine", 0)
    assert all(len(t) == len(got[i][0]) + got[i][1] for i, t in enumerate(texts)) and leakage.leaks(out, items).count() == 0


@pytest.mark.skipif(not __import__("os").path.exists(packing.RANKS), reason="no tokenizer files")
def test_packing(spark):
    r = random.Random(1)
    texts = [" ".join(r.choices(["alpha", "beta", "gamma", "delta", "repository", "curators"], k=r.randrange(1, 60))) for _ in range(500)] + ["long text " * 3000, None, "", "<|endoftext|>", "x"]
    out = packing.fill_containers(_docs(spark, texts), capacity=256, shard=200).collect()
    enc = packing.encoder(packing.RANKS)
    used, pieces = {}, {}
    for x in out:
        if x["container_id"] is not None:
            used[x["container_id"]] = used.get(x["container_id"], 0) + x["n_tokens"]
        pieces.setdefault(x["doc_id"], []).append((x["first_token"], x["n_tokens"], x["n_pieces"]))
    assert max(used.values()) <= 256 and sorted(pieces) == list(range(len(texts)))
    for i, t in enumerate(texts):
        n, at = len(enc.encode_ordinary(t)) if t else 0, 0
        for first, size, of in sorted(pieces[i]):
            assert first == at and of == len(pieces[i])
            at += size
        assert at == n and len(pieces[i]) == max(1, -(-n // 256))
    total = sum(used.values())
    assert total / (len(used) * 256) > 0.9
    report = packing.fill_report(packing.fill_containers(_docs(spark, texts), capacity=256, shard=200), 256).first()
    assert (report["n_containers"], report["n_tokens"]) == (len(used), total)
    assert packing.fill_containers(_docs(spark, [])).count() == 0
