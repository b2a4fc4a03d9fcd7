"""Leaks and abuse on small texts, and held-out accuracy of the abuse score."""

import random

import duckdb
import numpy as np

from reelspark.llm import abuse
from reelspark.llm.leaks import Spellings, best_stretch, can_hold, close, find_leaks, index_corpus, search_index
from reelspark.llm.text import plain, words

DOCS = "doc_id bigint, text string, item_id bigint, words string"
ITEMS = "item_id bigint, suite string, item_text string"


def passage(seed, n=40):
    r = random.Random(seed)
    names = ["".join(r.choice("bdfgklmnprst") + r.choice("aeiou") for _ in range(3)) for _ in range(30)]
    style = "the of then quietly before meanwhile opens carries near under with".split()
    return " ".join(r.choice(names) if k % 2 else r.choice(style) for k in range(n))


STOCK = "Read the following and answer the question."
ITEM_ROWS = [(k, "s", f"{STOCK} {passage(k)}. Who went where?") for k in range(12)] + [(100, "s", passage(3) + "."), (101, "s", None), (102, "s", "short one"), (3, "s", f"{STOCK} {passage(3)}. Who went where?")]


def leaks(spark, docs, items=ITEM_ROWS):
    d, i = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    got = find_leaks(d, i).collect()
    assert len({(g.doc_id, g.item_id) for g in got}) == len(got)
    return {(g.doc_id, g.item_id) for g in got}


def test_leaks(spark):
    p = passage(5).split()
    noise = " ".join(f"filler{k} word" for k in range(60))
    edited = list(p)
    for k in range(3, 40, 9):
        edited[k] = edited[k] + edited[k][-1]  # misspelt
    edited[8] = "other"
    del edited[20]
    texts = {
        1: noise + " " + " ".join(p) + " " + noise,
        2: " ".join(p[4:22]),  # eighteen words
        3: " ".join(p[4:17]),  # thirteen words are a short quotation
        4: " ".join(edited),
        5: " ".join(w.upper() + ("\n\n00:01:02,345 --> 00:01:04,000\n" if k % 6 == 5 else " ") for k, w in enumerate(p)),
        6: " ".join(w[0] + "​" + w[1:] for w in p).replace("a", "а"),  # zero width and look-alikes
        7: f"{STOCK} Who went where? " + noise,  # only stock
        8: " ".join(reversed(p)),
        9: None, 10: "", 11: "   ",
        12: passage(3),  # two items share it
        13: " ".join(w if k % 2 == 0 else "xyzzy" for k, w in enumerate(p)),  # the same style
        14: "x" * 200_000 + " " + " ".join(p) + " y" * 100_000,
    }
    docs = [(k, t, 7, "z") for k, t in texts.items()]
    want = {(k, 5) for k in (1, 2, 4, 5, 6, 14)} | {(12, 3), (12, 100)}
    assert leaks(spark, [*docs, docs[0], (None, texts[1], 1, "z")]) == want
    assert leaks(spark, []) == set()
    assert leaks(spark, docs, []) == set()


def test_stretch_like_brute_force():
    r = random.Random(2)

    def slow(item, doc):
        best = (0, 0)

        def go(i, d, start, matched):
            nonlocal best
            best = max(best, (i - start + 1, matched))
            for a in (1, 2):
                for b in (1, 2):
                    if i + a < len(item) and d + b < len(doc) and item[i + a] == doc[d + b]:
                        go(i + a, d + b, start, matched + 1)

        for i in range(len(item)):
            for d in range(len(doc)):
                if item[i] == doc[d]:
                    go(i, d, i, 1)
        return best

    for _ in range(200):
        item = [r.choice("abcd") for _ in range(r.randint(1, 8))]
        doc = [r.choice("abcd") for _ in range(r.randint(0, 9))]
        span, share = best_stretch(item, [1.0] * len(item), doc)
        want = slow(item, doc)
        assert span == want[0]
    assert close("shells", "shellss") and close("tannery", "tanneyr") and not close("41", "42") and not close("cat", "cut")


def test_plain_text():
    assert words("<p>Th​e &amp; cork-stop­pers</p> ＡＢＣ") == ["the", "corkstoppers", "abc"]
    assert plain("HOST: a\n- b\n1) c\nWARN 07:30:04.548 d").split() == ["a", "b", "c", "d"]


def test_automaton_against_edit_distance():
    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(row[-1] + 1, old[j] + 1, old[j - 1] + (x != y)))
        return row[-1]

    r = random.Random(4)
    terms = sorted({"".join(r.choice("abc") for _ in range(r.randint(2, 6))) for _ in range(40)})
    trie = abuse.Trie(terms)
    for _ in range(300):
        w = "".join(r.choice("abc") for _ in range(r.randint(1, 7)))
        for most in (0, 1, 2):
            near = [(edits(w, t), t) for t in terms if edits(w, t) <= most]
            assert trie.search(w, most) == (min(near)[1] if near else None)


def test_disguises():
    m = abuse.fit([])
    for form in ("you idiot", "you i d i o t", "you i.d.i.o.t", "you id*ot", "you 1d10t", "you idiooooot", "you іdіоt", "you idi​ot", "you idi0t", "you idoit", "you odiot", "you xidiot"):
        assert m.score(form)[0] > 0.2 and "idiot" in m.score(form)[1], form
    assert m.score("the editor checks the frame rate")[0] == 0.0
    assert m.score("You idiot, I kill you")[0] > m.score("the rules say the word idiot is removed")[0]


def rows_of(sf):
    return duckdb.sql(
        f"select any_value(text), avg(toxic) y from read_parquet('/root/testdata/{sf}/documents.parquet') d join read_parquet('/root/testdata/{sf}/doc_labels.parquet') using (doc_id) "
        "where text is not null and toxic is not null group by doc_id having avg(toxic) <> 0.5 order by doc_id"
    ).fetchall()


def test_held_out_accuracy():
    rows = rows_of("sf0.1")
    random.Random(1).shuffle(rows)
    m = abuse.fit(rows[: len(rows) // 2])
    score = np.array([m.score(t)[0] for t, _ in rows[len(rows) // 2 :]])
    y = np.array([v > 0.5 for _, v in rows[len(rows) // 2 :]])
    order = score.argsort()
    rank = np.empty(len(y))
    rank[order] = np.arange(len(y))
    auc = (rank[y].mean() - (y.sum() - 1) / 2) / (~y).sum()
    hit = score >= 0.5
    # some labels are wrong: about one in six bad ones stands on a harmless text, which bounds both figures
    assert auc > 0.8 and (hit & y).sum() / y.sum() > 0.6 and (hit & y).sum() / hit.sum() > 0.65


def test_scores_of_odd_rows(spark):
    m = abuse.fit([])
    rows = [(1, None, "a"), (2, "", "a"), (3, "  \n", None), (4, "you stupid idiot", "b"), (4, "you stupid idiot", "b"), (None, "nice", "b"), (5, "so " * 100_000 + "you idiot", "c")]
    got = abuse.score_documents(spark.createDataFrame(rows, "doc_id bigint, text string, source string"), m, ("source",)).collect()
    assert len(got) == len(rows) and {g.doc_id: g.score > 0 for g in got} == {1: False, 2: False, 3: False, 4: True, None: False, 5: True}
    empty = spark.createDataFrame([], "doc_id bigint, text string, toxic int")
    assert abuse.labelled_sample(empty, empty).count() == 0 and abuse.train(empty, empty).score("you idiot") == m.score("you idiot")


def test_labelled_texts_stay_whole(spark, monkeypatch):
    monkeypatch.setattr(abuse, "MAX_LABELLED", 30)
    texts = {i: "word " * (1_200 if i % 3 else 20) + f"end{i}" for i in range(60)}
    documents = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2 == 0) for i in texts], "doc_id bigint, toxic boolean")
    got = abuse.labelled_sample(documents, labels).collect()
    assert got and all(g.text == texts[g.doc_id] for g in got)
    assert 15 < len(got) < 45 and max(len(g.text) for g in got) > 5_000


def test_train_like_fit(spark, monkeypatch):
    rows = rows_of("sf0.01")
    documents = spark.createDataFrame([(i, t, "z") for i, (t, _) in enumerate(rows)] + [(999_999, None, "z")], "doc_id bigint, text string, y string")
    labels = spark.createDataFrame([(i, int(v > 0.5), 3) for i, (_, v) in enumerate(rows)] + [(0, None, 1), (999_999, 1, 1)], "doc_id bigint, toxic int, quality int")
    many = [(t, float(v > 0.5)) for t, v in rows] * 3  # enough bad ones for a fit
    documents, labels = (d.unionByName(d.withColumn("doc_id", d.doc_id + 10**6)).unionByName(d.withColumn("doc_id", d.doc_id + 10**7)) for d in (documents, labels))
    a, b = abuse.train(documents, labels), abuse.fit(many)
    assert a.terms == b.terms and a.known == b.known and len(a.terms) > len(abuse.SEEDS)
    assert abs(a.bias - b.bias) < 1e-6 and np.allclose(a.weights, b.weights, atol=1e-6)
    monkeypatch.setattr(abuse, "MAX_WINDOWS", 50)
    assert abuse.train(documents, labels).weights.any()


def test_misspelt_leaks_like_aligning_all(spark, monkeypatch):
    r = random.Random(9)
    vocabulary = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(5, 10))) for _ in range(500)]
    items = [(i, "s", " ".join(r.choice(vocabulary) for _ in range(24)) + ".") for i in range(40)]
    docs = []
    for i, (_, _, text) in enumerate(items * 3):
        said = words(text)[4:20]
        for at in r.sample(range(1, 16), 5 + i % 11):
            w = said[at]
            said[at] = w[:2] + ("z" if i % 2 else "") + w[3:]  # a letter replaced or dropped
        docs.append((i, " ".join([r.choice(vocabulary) for _ in range(12)] + said + [r.choice(vocabulary) for _ in range(12)])))
    monkeypatch.setattr("reelspark.llm.leaks.MAX_WORDS", 400)  # several parts
    got = {(a.doc_id, a.item_id) for a in find_leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, ITEMS)).collect()}
    used = {w: sum(w in words(t) for _, _, t in items) for w in vocabulary}
    want = set()
    for i, text in docs:
        for item, _, body in items:
            span, share = best_stretch(words(body), [np.log1p(40 / used[w]) for w in words(body)], words(text), 15, 0.85)
            if span >= 15 and share >= 0.85:
                want.add((i, item))
    assert got == want and len(want) >= 100


def test_spellings_like_close():
    r = random.Random(2)
    terms = {"".join(r.choice("abc") for _ in range(r.randint(2, 10))) for _ in range(400)} | {"1234", "12345"}
    known = Spellings(terms)
    for w in [*sorted(terms)[::5], "acbbacab", "12346", "ab"]:
        assert known.of(w) == {t for t in terms if close(t, w)}
    there = np.array([[False, True, True, True], [False, True, False, True]])
    assert can_hold(there, [1.0] * 4, 3, 0.9).tolist() == [True, False] and not can_hold(there[1:], [1.0] * 4, 3, 0.7).any()


def test_inner_stretch_of_a_looser_one():
    # fifteen unchanged words whose neighbours match loosely: the long stretch falls short, the inner one counts
    r = random.Random(5)
    item = ["".join(r.choice("abcdefghijklmnop") for _ in range(9)) for _ in range(30)]
    doc = ["x", *[w if k % 2 else f"other{k}" for k, w in enumerate(item[:8])], *item[8:23], *[w if k % 2 else f"other{k}" for k, w in enumerate(item[23:])]]
    assert best_stretch(item, [1.0] * 30, doc)[0] >= 28
    span, share = best_stretch(item, [1.0] * 30, doc, 15, 0.85)
    assert 15 <= span < 25 and share >= 0.85


def test_index_is_the_corpus(spark, monkeypatch):
    monkeypatch.setattr("reelspark.llm.leaks.SHARD_TOKENS", 50)
    texts = [f"{passage(k)} {passage(k)}" for k in range(6)] + [None, "", " ", passage(3).upper()]
    index = index_corpus(spark.createDataFrame([(k, t, "z", 1) for k, t in enumerate(texts)], "doc_id bigint, text string, terms string, pos int"))
    back: dict = {}
    for r in index.collect():
        for k, t in enumerate(r.terms):
            for p in range(r.starts[k], r.starts[k + 1]):
                back.setdefault(r.docs[r.doc[p]], {})[r.pos[p]] = t
    assert {d: [w[p] for p in sorted(w)] for d, w in back.items()} == {k: words(t) for k, t in enumerate(texts) if t and words(t)}
    items = spark.createDataFrame(ITEM_ROWS, ITEMS)
    got = {(r.doc, r.item_id): r.match for r in search_index(index, items).collect()}
    assert got == {(k, k): "phrase" for k in range(6)} | {(3, 100): "phrase", (9, 3): "phrase", (9, 100): "phrase"}
