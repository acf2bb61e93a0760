import zlib

import numpy as np
import pytest

from gridmill.llm import entries, langid, toxicity


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


DOCS = "doc_id long, text string, lang string, source string, score double, lang_pred string"


def frame(spark, rows):
    # columns named as results, to be ignored
    return spark.createDataFrame([(i, t, x, "s", 9.0, "zz") for i, t, x in rows], DOCS)


def test_language_of_the_given_table(spark, sf):
    got = entries.op9_language_id(spark, sf.replace("0.001", "0.01")).collect()
    truth = {r.doc_id: r.lang for r in entries.table(spark, sf.replace("0.001", "0.01"), "documents").collect()}
    assert len(got) == len(truth) and all(r.held_out == held_out(r.doc_id) and 0 <= r.score <= 1 for r in got)
    rated = [r.lang_pred == truth[r.doc_id] for r in got if r.held_out and truth[r.doc_id]]
    assert len(rated) > 100 and np.mean(rated) > 0.98


def test_languages_against_plain_vectors(spark):
    texts = [(i, "the cat and the dog " * 3, "en") for i in range(8)] + [(i, "der hund und die katze " * 3, "de") for i in range(8, 16)]
    rows = [*texts, (20, None, "en"), (21, "", "de"), (22, "123 !!", None), (23, "und der die", None), (None, "the and", None), (24, "the dog", None), (24, "the dog", None)]
    docs = frame(spark, rows)
    learned = langid.prototypes(docs)
    assert sorted(learned) == ["de", "en"]
    # brute force: add up bound vectors letter by letter
    codes, (a, b, c) = langid._codes(), langid._vectors()
    for lang in learned:
        total = np.zeros(langid.DIM)
        for i, t, x in texts:
            if x == lang and not held_out(i):
                s = [0, *(codes[ord(ch)] for ch in t), 0]
                s = [s[0]] + [y for x_, y in zip(s, s[1:], strict=False) if y or x_]
                for p, q, r in zip(s, s[1:], s[2:], strict=False):
                    total += a[p].astype(int) * b[q] * c[r]
        assert np.array_equal(total, learned[lang])
    got = langid.identify(docs, learned).collect()
    assert len(got) == len(rows)
    # every language and cosine again, one trigram after the other
    for r, (_, t, _) in zip(sorted(got, key=lambda r: (r.doc_id or -1, r.lang_pred)), sorted(rows, key=lambda r: r[0] or -1), strict=True):
        s = [0, *(codes[ord(ch)] for ch in t or ""), 0]
        s = [s[0]] + [y for x_, y in zip(s, s[1:], strict=False) if y or x_]
        v = sum((a[p].astype(int) * b[q] * c[x] for p, q, x in zip(s, s[1:], s[2:], strict=False)), np.zeros(langid.DIM))
        cos = {x: v @ y / (np.linalg.norm(v) * np.linalg.norm(y)) for x, y in learned.items()} if np.any(v) else {}
        assert r.lang_pred == (max(cos, key=cos.get) if cos else "und") and np.isclose(r.score, max(0.0, max(cos.values(), default=0.0)))
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert [by[i][0].lang_pred for i in (20, 21, 22, 23, 24)] == ["und", "und", "und", "de", "en"] and len(by[24]) == 2
    assert by[None][0].lang_pred == "en" and by[None][0].held_out and by[20][0].score == 0
    assert langid.identify(docs, {}).where("lang_pred <> 'und'").count() == 0
    assert langid.identify(docs.limit(0), learned).count() == 0 and langid.prototypes(docs.limit(0)) == {}


def test_long_texts_are_read_whole(spark):
    text = "the and of " * 400_000
    docs = frame(spark, [(1, text + "ä" * 5, "en"), (2, text, "en")])
    grams, counts = langid.trigrams(text)
    assert counts.sum() == len(text) - 1 and len(langid.trigrams(text + "ä" * 5)[0]) > len(grams)
    assert langid.identify(docs, langid.prototypes(docs)).count() == 2


def accuracy(rows, y):
    """Of a machine fitted on five sixths of the texts, on the rest."""
    cut = len(rows) * 5 // 6
    m = toxicity._fit(rows[:cut], np.array(y[:cut]))
    got = np.array([m.score(r) >= 0.5 for r in rows[cut:]])
    return m, (got == (np.array(y[cut:]) == 1)).mean()


def test_pairs_beyond_additive_weights():
    """Two words that are harmless alone and toxic together, as is another pair."""
    rng = np.random.default_rng(0)
    rows, y = [], []
    for _ in range(6000):
        words = {int(w) for w in rng.integers(100, 160, 8)}
        for w in range(4):
            if rng.random() < 0.5:
                words.add(w)
        y.append(float({0, 1} <= words or {2, 3} <= words))
        rows.append(np.array(sorted(words)))
    m, share = accuracy(rows, y)
    assert share > 0.97 and np.abs(m.vectors).max() > 0.3
    # the closed form of the pair sum
    at = m.places(rows[0])
    pairs = sum(m.vectors[i].astype(float) @ m.vectors[j] for i in at for j in at if i < j)
    assert np.isclose(m.score(rows[0]), toxicity._sigmoid(m.bias + m.weights[at].sum() + pairs))


def test_pairs_of_words_that_are_even_alone():
    """Toxic where two words are both there or both missing: neither says anything alone."""
    rng = np.random.default_rng(1)
    rows, y = [], []
    for _ in range(9600):
        words = {int(w) for w in rng.integers(100, 400, 10)}
        two = rng.random(2) < 0.5
        words |= {w for w in range(2) if two[w]}
        y.append(float(two[0] == two[1]))
        rows.append(np.array(sorted(words)))
    assert abs(np.mean(y) - np.mean([t for r, t in zip(rows, y, strict=True) if 0 in r])) < 0.03
    assert accuracy(rows, y)[1] > 0.9


def test_toxicity_of_the_given_table(spark, sf):
    sf = sf.replace("0.001", "0.1")
    got = {r.doc_id: r for r in entries.op3_toxicity(spark, sf).collect()}
    labels = {r.doc_id: r.toxic for r in entries.table(spark, sf, "labels").collect()}
    rated = [(got[i].score, t) for i, t in labels.items() if held_out(i)]
    pos, neg = [s for s, t in rated if t], [s for s, t in rated if not t]
    auc = np.mean([(a > b) + (a == b) / 2 for a in pos for b in neg])
    assert auc > 0.85 and np.mean([s >= 0.5 for s in neg]) < 0.01 and np.mean([s >= 0.5 for s in pos]) > 0.7
    assert all(r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 and r.held_out == held_out(i) for i, r in got.items())


def test_scores_are_those_of_the_machine_term_by_term(spark, sf):
    docs, labels = entries.table(spark, sf, "documents"), entries.table(spark, sf, "labels")
    m = toxicity.fit(docs, labels)
    place = {int(b): i for i, b in enumerate(m.buckets)}
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in toxicity.score(docs, m).collect():
        at = [place[b] for b in toxicity.terms(texts[r.doc_id]).tolist() if b in place]
        total = m.bias + sum(float(m.weights[i]) for i in at) + sum(float(m.vectors[i].astype(float) @ m.vectors[j]) for k, i in enumerate(at) for j in at[:k])
        assert np.isclose(r.score, toxicity._sigmoid(total), atol=1e-6) and r.predicted == (r.score >= 0.5)


def test_toxicity_edge_cases(spark):
    docs = frame(spark, [(i, f"plain text {i}", "en") for i in range(30)] + [(30, None, None), (31, "", None), (None, "x", None), (5, "again", None), (32, "word " * 300_000, None)])
    labels = spark.createDataFrame([(i, i % 2, 1, "x") for i in range(30)] + [(None, 1, 1, "x"), (3, None, 1, "x")], "doc_id long, toxic int, quality int, text string")
    for chosen in (labels, labels.where("toxic = 0"), labels.limit(0)):
        rows = toxicity.score(docs, toxicity.fit(docs, chosen)).collect()
        assert len(rows) == 35 and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.score(docs.limit(0), toxicity.fit(docs.limit(0), labels)).count() == 0
