import hashlib
import math
import random

import numpy as np
import pytest

from gridmill.llm import decontaminate, entries, topk, warc


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 7, 1) for i, v in rows], "vec_id long, embedding array<float>, score int, rank int")


def brute_top(rows, k, every):
    good = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    asked = {}
    for i, v in good:
        if i % every == 0:
            asked[i] = min(asked.get(i, v), v)
    out = []
    for q, v in asked.items():
        found = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in good if i != q and len(w) == len(v))[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("block", [16, 4096])
def test_top_k_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "BLOCK", block)
    rng = np.random.default_rng(block)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(200)] + [(200 + i, [0.25] * 8) for i in range(40)]
    rows += [(300, None), (301, []), (302, [1.0, None] * 4), (303, [float("nan")] * 8), (304, [float("inf")] * 8), (None, [1.0] * 8), (17, [0.5] * 8), (17, [0.5] * 8), (350, [1.0, 2.0]), (351, [3.0, 4.0]), (400, [1.0])]
    got = sorted(tuple(r) for r in topk.top_k(vectors(spark, rows), 5, 50).select("query_id", "rank", "vec_id", "score").collect())
    assert got == brute_top(rows, 5, 50)
    assert topk.top_k(vectors(spark, []), 5, 50).count() == 0


def test_large_components_stay_exact(spark):
    rows = [(i, [float(10**7 + i), 3.0e6]) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r.rank): r.score for r in topk.top_k(df, 2, 29).collect()}
    assert got[0, 1] == 256 * 10**7 * 256 * (10**7 + 29) + (256 * 3 * 10**6) ** 2


def test_components_of_any_size_take_part(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=3).tolist()) for i in range(60)]
    rows += [(60, [1e17, 0.0, 0.0]), (61, [1e-3, 1e17, 0.0]), (62, [1e300, 0.0, 0.0]), (63, [1.7e308, 1.0, 0.0]), (64, [-1e17, 0.0, 1.0]), (70, [1e17, -1e17, 2.0]), (80, [2.0**53, 1.0, 0.0]), (81, [2.0**53 + 2, -1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in topk.top_k(df, 5, 10).select("query_id", "rank", "vec_id", "score").collect())
    whole = {i: [int(x) * 256 if abs(x) >= 2**53 else math.floor(256 * x) for x in v] for i, v in rows}
    want = []
    for qid in sorted(i for i in whole if i % 10 == 0):
        found = sorted((-sum(a * b for a, b in zip(whole[qid], w, strict=True)), i) for i, w in whole.items() if i != qid)[:5]
        want += [(qid, n + 1, i, min(max(-s, -(2**63)), 2**63 - 1)) for n, (s, i) in enumerate(found)]
    assert got == want


def test_bounds_hold():
    rng = np.random.default_rng(1)
    x = np.floor(rng.normal(size=(300, 6)) * 50)
    q = np.floor(rng.normal(size=(4, 6)) * 50)
    b = topk.Block(np.arange(300), x, topk.Block.ranks(x))
    exact = x @ q.T
    for depth in (1, 40, 299, 300):
        low, high = b.bounds(depth, q)
        assert (low <= exact).all() and (exact <= high).all()
    assert np.array_equal(b.bounds(300, q)[0], exact)


def test_reading_stops_on_clustered_vectors():
    """Queries of 8 clusters against blocks of one cluster each, as alike vectors share a block."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(8, 32)) * 100
    blocks = []
    for c in range(8):
        x = np.floor(centres[c] + rng.normal(size=(500, 32)) * 20)
        blocks.append(topk.Block(np.arange(500) + 1000 * c, x, topk.Block.ranks(x)))
    ids, q = np.array([1000 * c + i for c in range(8) for i in range(5)]), np.concatenate([b.x[:5] for b in blocks])
    every = np.concatenate([b.x for b in blocks]) @ q.T
    every[np.searchsorted(np.concatenate([b.ids for b in blocks]), ids), np.arange(40)] = -np.inf
    kth = np.sort(every, 0)[-5]
    # a query starts with the k-th best score of its own block
    floor = np.array([np.sort(np.delete(blocks[i // 5].x @ q[i], i % 5))[-5] for i in range(40)])
    read, found = [], set()
    for b in blocks:
        at, other, score, share = b.best(ids, q, 5, floor)
        read.append(share)
        found |= {(int(a), int(o)) for a, o, s in zip(at, other, score, strict=True) if s >= kth[a]}
    assert np.mean(read) < 0.2 and max(read) < 0.9
    row = np.concatenate([b.ids for b in blocks])
    assert found == {(j, int(row[c])) for c, j in zip(*np.nonzero(every >= kth), strict=True)}


def test_queries_meet_blocks_without_a_broadcast(spark, monkeypatch):
    """What a grid copies looks small to the planner; as a broadcast it fills the driver."""
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(300)]
    monkeypatch.setattr(topk, "HELD", 16, raising=False)  # several parts of queries
    got = topk.top_k(vectors(spark, rows), 5, 50)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "Join" not in plan
    assert sorted(tuple(r) for r in got.collect()) == brute_top(rows, 5, 50)


@pytest.mark.parametrize("number", [np.float32, np.float64])
def test_equal_scores_of_a_block_are_cut_to_the_smallest_ids(number):
    x = np.full((400, 8), 3, number)
    x[::100] = 4
    block = topk.Block(np.arange(400) * 7, x, topk.Block.ranks(x))
    at, ids, score, _ = block.best(np.array([0, 7 * 150]), x[:2], 5, np.full(2, -np.inf))
    got = {j: sorted((-s, int(i)) for a, i, s in zip(at, ids, score, strict=True) if a == j) for j in (0, 1)}
    assert got[0] == [(-128.0, 700), (-128.0, 1400), (-128.0, 2100), (-96.0, 7), (-96.0, 14)]
    assert got[1] == [(-96.0, 0), (-96.0, 700), (-96.0, 1400), (-96.0, 2100), (-72.0, 7)]


def arc_frame(spark, rows):
    return spark.createDataFrame([(i, u, h, -1, "x") for i, u, h in rows], "page_id long, url string, html string, payload_bytes int, record_type string")


def test_archives_round_trip(spark):
    big = "ü<p>" * 600
    rows = [
        (4, "http://a/ b\n", big), (3, None, big), (9, "", big), (5, "http://x", None), (6, "http://x", ""), (7, "http://y", "s" * 99), (8, "http://z", "s" * 99),
        (10, "u", "WARC/1.1\r\n\r\n\r\n\r\nHTTP/1.1 200\n\nhttp://x 0 0 0 5\n" * 5), (11, "u", "line\n" * 30), (11, "u", "line\n" * 30), (None, "u", big), (12, "v", "y" * 6_000_000),
    ]
    got = warc.archived(arc_frame(spark, rows)).collect()
    assert len(got) == len(rows)
    texts = {i: (h or "").encode() for i, _, h in rows}
    for r in got:
        payload = texts[r.page_id]
        assert (r.payload_bytes, r.payload_digest) == (len(payload), hashlib.sha256(payload).hexdigest())
    said = {r.page_id: (r.record_type, r.refers_to) for r in got}
    assert said[3] == ("response", None) and said[4] == ("revisit", 3) and said[9] == ("revisit", 3) and said[None] == ("response", None)
    assert all(said[i] == ("response", None) for i in (5, 6, 7, 8, 10, 11, 12))
    assert warc.archived(arc_frame(spark, [])).count() == 0


def test_arc_layouts_and_faults():
    note = b"1 0 x\nfields\n"
    v1 = b"filedesc://f 0.0.0.0 20200102 text/plain %d\n%s\nhttp://a 1.2.3.4 20200102030405 text/plain 5\nhello\n" % (len(note), note)
    assert [(r["fields"]["URL"], r["block"]) for r in warc.arc_records(v1)] == [("http://a", b"hello")]
    note = b"2 0 x\nfields\n"
    v2 = b"filedesc://f 0.0.0.0 20200102 text/plain 200 - - 0 f.arc %d\n%s\nhttp://b 1.2.3.4 20200102030405 text/html 200 c - 7 f.arc 3\nabc\n\n" % (len(note), note)
    last = [*warc.arc_records(v1 + v2)][-1]
    assert (last["fields"]["Result-code"], last["block"], last["truncated"]) == ("200", b"abc", False)
    assert [*warc.arc_records(v2[:-5])][0]["truncated"]
    with pytest.raises(ValueError, match="version 1 at byte"):
        list(warc.arc_records(v1 + b"no header\n"))
    row = {"record_id": "urn:uuid:1", "uri": "u", "date": "d", "mime": "text/plain", "digest": "0", "truncated": True}
    fields, block = next(warc.warc_records(warc._record("response", row, b"hello", None, None) + b"\r\n\r\n"))
    assert fields["warc-type"] == "resource" and fields["warc-truncated"] == "length" and block == b"hello"
    assert warc._identifier("a", "b") == warc._identifier("a", "b") != warc._identifier("a", "c")


def plain_alignment(item, text):
    rows = np.zeros((len(item) + 1, len(text) + 1))
    for i, a in enumerate(item, 1):
        for j, b in enumerate(text, 1):
            step = decontaminate.MATCH if a == b else decontaminate.DIFFER
            rows[i, j] = max(0, rows[i - 1, j - 1] + step, rows[i - 1, j] + decontaminate.GAP, rows[i, j - 1] + decontaminate.GAP)
    return rows.max()


def test_alignment_equals_the_plain_table():
    rng = np.random.default_rng(0)
    for _ in range(40):
        a, b = rng.integers(0, 6, rng.integers(1, 25)), rng.integers(0, 6, rng.integers(0, 40))
        assert decontaminate.align(a, b)[0] == plain_alignment(a, b)


def test_edited_copies_are_found(spark):
    rng = random.Random(2)
    words = [f"v{i}" for i in range(4000)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(12, 60)))) for i in range(30)]
    items += [(90, "quite a short item"), (94, "alone"), (95, "two words"), (91, None), (None, items[0][1]), (92, ""), (93, items[1][1])]
    docs, want = [], set()
    for n in range(120):
        body = [rng.choice(words) for _ in range(rng.randrange(30, 400))]
        if n % 3 == 0:
            i, text = items[n % 30]
            copy = text.split()
            for _ in range(len(copy) // 6):
                at = rng.randrange(len(copy))
                copy[at : at + 1] = rng.choice(([], [rng.choice(words)], [copy[at], rng.choice(words)]))
            at = rng.randrange(len(body))
            body[at:at] = copy
            want.add((n, i))
        docs.append((n, " ".join(body).upper() if n % 2 else " ".join(body)))
    docs += [(500, None), (501, ""), (None, items[3][1]), (502, items[4][1]), (502, items[4][1]), (503, " ".join(words * 20) + " " + items[5][1])]
    docs += [(504, "x Quite a short, item y"), (505, "quite a very short item"), (506, "it is Alone. so two  words"), (507, "words two"), (508, "two other words")]
    want |= {(502, 4), (503, 5), (504, 90), (505, 90), (506, 94), (506, 95)}
    want |= {(n, 93) for n, i in want if i == 1}
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, item_id string")
    b = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    for local in (1 << 20, 0):
        got = decontaminate.contaminated(d, b, local_seeds=local).collect()
        assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
    assert decontaminate.contaminated(d.limit(0), b).count() == 0 and decontaminate.contaminated(d, b.limit(0)).count() == 0


def found_by_alignment(item, text):
    # half of the full score; short items: all of it but for a word that differs; shortest ones all of it
    n = len(item)
    return decontaminate.align(item, text)[0] >= (n if n >= 8 else 2 * n - 3 if n >= 4 else 2 * n)


def test_given_table_against_full_alignment(spark, sf):
    """Every document is aligned with every item, without seeds."""
    items = [(r.item_id, decontaminate.hashed(r.text)) for r in entries.table(spark, sf, "benchmark").collect()]
    docs = [(r.doc_id, decontaminate.hashed(r.text)) for r in entries.table(spark, sf, "documents").collect()]
    # an item can't score more than its words that the document holds
    want = {(d, i) for d, h in docs for i, w in items if 2 * np.isin(w, h).sum() >= len(w) and found_by_alignment(w, h)}
    assert {(r.doc_id, r.item_id) for r in entries.op5_decontamination(spark, sf).collect()} == want


def aligned(spark, items, docs):
    """What the operator finds on both paths, and what full alignment of every pair finds."""
    want = {(n, i) for n, d in docs for i, t in items if found_by_alignment(decontaminate.hashed(t), decontaminate.hashed(d))}
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for local in (1 << 20, 0):
        yield {(r.doc_id, r.item_id) for r in decontaminate.contaminated(d, b, local_seeds=local).collect()}, want


def test_where_a_copy_begins(spark):
    rng = random.Random(3)
    words = [f"v{i}" for i in range(500)]
    item, body = rng.sample(words, 20), [f"other{i}" for i in range(200)]
    edited = [*item[:5], "new", *item[6:]]
    docs = [(n, " ".join(body[:at] + copy + body[at:])) for n, (at, copy) in enumerate([(50, item), (0, edited), (200, item), (7, item[:2])])]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(item)), (2, " ".join(item[:2]))], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.start for r in decontaminate.contaminated(d, b).collect()}
    assert got == {(0, 1): 50, (1, 1): 0, (2, 1): 200, (0, 2): 50, (1, 2): 0, (2, 2): 200, (3, 2): 7}


def test_items_that_share_a_template(spark):
    words = [f"t{i}" for i in range(40)]
    of = lambda x: " ".join(words[:20] + [x] + words[21:])
    items = [(i, of(f"name{i}")) for i in range(12)] + [(100 + i, of("name0")) for i in range(10)]
    for got, want in aligned(spark, items, [(1, "before " + of("other") + " after"), (2, "nothing of it")]):
        assert got == want and len(got) == 22


def test_edited_short_items_against_full_alignment(spark):
    rng = random.Random(11)
    words = [f"v{i}" for i in range(300)]
    items = [(i, " ".join(rng.choices(words, k=rng.choice((8, 9, 12, 16, 40))))) for i in range(60)]
    docs = []
    for n in range(400):
        copy = items[n % 60][1].split()
        for at in range(len(copy) - 1, -1, -1):
            if rng.random() < rng.choice((0.2, 0.3)):
                copy[at : at + 1] = rng.choice(([rng.choice(words)], [rng.choice(words)], [], [copy[at], rng.choice(words)]))
        docs.append((n, " ".join(rng.choices(words, k=30) + copy + rng.choices(words, k=30))))
    for k in range(60):
        own = items[k][1].split()
        docs.append((1000 + k, " ".join(x if i % 4 else "new" for i, x in enumerate(own))))
        docs.append((2000 + k, " new ".join(own)))
    for got, want in aligned(spark, items, docs):
        assert got == want and len(got) > 300


def test_edited_items_of_few_words_against_full_alignment(spark):
    rng = random.Random(12)
    words = [f"v{i}" for i in range(60)]
    items = [(i, " ".join(rng.choices(words, k=1 + i % 7))) for i in range(84)]
    docs = []
    for n in range(600):
        copy = items[n % 84][1].split()
        for _ in range(n % 3):
            at = rng.randrange(len(copy)) if copy else 0
            copy[at : at + 1] = rng.choice(([rng.choice(words)], [], [*copy[at : at + 1], "new"], ["new"]))
        docs.append((n, " ".join(rng.choices(words, k=8) + copy + rng.choices(words, k=8))))
    docs += [(1000 + i, t) for i, t in items]
    for got, want in aligned(spark, items, docs):
        assert got == want
    edited = {(n, i) for n, i in want if n < 1000 and n % 3 and len(items[i][1].split()) >= 4 and i == n % 84}
    assert len(edited) > 100


def test_a_pair_of_nearly_all_documents_is_joined_in_parts(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "HOT", 8)
    rng = random.Random(13)
    words = [f"v{i}" for i in range(2000)]
    items = [(i, " ".join(["common", "pair", "here", *rng.sample(words, 9)])) for i in range(20)] + [(50, "common pair"), (51, "common pair here now")]
    docs = [(n, " ".join([*rng.sample(words, 20), "common", "pair", "here", *rng.sample(words, 20)])) for n in range(300)]
    docs += [(1000 + n, "x " + items[n % 20][1] + " y") for n in range(60)] + [(2000, " ".join(["common pair here"] * 3000))]
    for got, want in aligned(spark, items, docs):
        assert got == want and len(got) > 400
