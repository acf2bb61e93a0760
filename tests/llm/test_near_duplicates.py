import random
import re

import pytest

from gridmill.llm import entries, near_duplicates
from gridmill.llm.graph import components


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1)) if len(words) >= width else frozenset([tuple(words)])


def brute(rows, width, percent):
    sets = {}
    for i, t in rows:
        sets.setdefault(i, shingles(t, width))
    ids, parent = sorted(sets), {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                    x, y = sorted((find(a), find(b)))
                    parent[y] = x
    return {i: find(i) for i in ids}, {i: len(s) for i, s in sets.items()}


def frame(spark, rows):
    return spark.createDataFrame([(i, t, -1, False, "k") for i, t in rows], "doc_id long, text string, n int, kept boolean, digest string")


def families(seed, groups, copies, words):
    """Texts edited again and again, so that many pairs lie just above and below the threshold."""
    rng, out = random.Random(seed), []
    for g in range(groups):
        base = [f"w{rng.randrange(900)}" for _ in range(words)]
        chain = [base]
        for _ in range(copies):
            edited = [*rng.choice(chain)]
            for _ in range(rng.randrange(1, 5)):
                edited[rng.randrange(len(edited))] = f"e{rng.randrange(9000)}"
            chain.append(edited)
        out += [" ".join(x) for x in chain]
    rng.shuffle(out)
    return [*enumerate(out)]


@pytest.mark.parametrize(("width", "percent", "rows", "split"), [(3, 85, 7, 1024), (5, 80, 6, 8)])
def test_groups_equal_brute_force(spark, monkeypatch, width, percent, rows, split):
    monkeypatch.setattr(near_duplicates, "SPLIT", split)
    docs = families(width, 4, 40, 110)
    want, sizes = brute(docs, width, percent)
    assert len({*want.values()}) > 8
    got = near_duplicates.near_duplicates(frame(spark, docs), width, percent, rows).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert all(r.n_shingles == sizes[r.doc_id] and r.kept == (r.doc_id == r.component_id) for r in got)


def test_edge_cases(spark):
    long_ = " ".join(f"w{i}" for i in range(60_000))
    rows = [
        (1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "one  two"), (8, "two one"), (9, "Ä b c"), (10, "ä b c"),
        (11, long_), (12, long_ + " end"), (14, "a b c d e f g h"), (13, "a b c d e f g h"), (15, "same id"), (15, "same id"), (None, "a b c d e f g h"), (None, None),
    ]
    got = near_duplicates.near_duplicates(frame(spark, rows), 3, 85, 7).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    want = {1: 1, 2: 2, 3: 3, 4: 4, 5: 4, 6: 6, 7: 6, 8: 8, 9: 9, 10: 10, 11: 11, 12: 11, 13: 13, 14: 13, 15: 15}
    assert {i: r.component_id for i, r in by.items()} == want
    assert by[1].n_shingles == 0 and by[4].n_shingles == 1 and by[12].n_shingles == 59_999
    assert all(r.component_id is None and r.kept for r in got if r.doc_id is None)
    assert near_duplicates.near_duplicates(frame(spark, []), 3, 85, 7).count() == 0


def test_given_table_against_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in entries.table(spark, sf, "documents").collect()]
    want, _ = brute(docs, 3, 85)
    assert {r.doc_id: r.component_id for r in entries.op4_near_duplicates(spark, sf).collect()} == want


def test_components(spark):
    edges = [(5, 4), (4, 3), (3, 2), (2, 1), (9, 8), (8, 9), (7, 7), (10, 11), (11, 12), (12, 10)]
    got = {r.id: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 8: 8, 9: 8, 10: 10, 11: 10, 12: 10}
    chain = spark.range(60).selectExpr("id as a", "id + 1 as b")
    assert {r.label for r in components(chain).collect()} == {0}
    assert components(chain.limit(0)).count() == 0
