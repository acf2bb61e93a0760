import re
from functools import reduce

import corpus_pipeline
from gridmill.llm import decontaminate, entries, langid, toxicity
from gridmill.llm.common import table
from tests.llm.test_near_duplicates import brute


def test_stages_against_brute_force(spark, sf):
    docs = table(spark, sf, "documents")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "toxicity", "near duplicates", "decontamination", "codes"]
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept.append(stage(spark, kept[-1], sf).cache())
        assert kept[-1].columns == docs.columns
    texts = [{r.doc_id: r.text for r in k.collect()} for k in kept]
    assert {*texts[1]} == {i for i, t in texts[0].items() if t and re.search(r"[^\W\d_]", t)}
    scores = {r.doc_id: r.score for r in toxicity.score(kept[1], toxicity.fit(kept[1], table(spark, sf, "labels"))).collect()}
    assert {*texts[2]} == {i for i in texts[1] if scores[i] < 0.5}
    groups, _ = brute([*texts[2].items()], 5, 80)
    assert {*texts[3]} == {i for i, c in groups.items() if i == c} and len(texts[3]) < len(texts[2])
    leaks = {r.doc_id for r in decontaminate.contaminated(kept[3], table(spark, sf, "benchmark")).collect()}
    assert {*texts[4]} == {*texts[3]} - leaks and leaks
    last = {r.doc_id for r in corpus_pipeline.run(spark, sf).collect()}
    assert last == {*texts[4]}


def test_odd_rows(spark, sf):
    docs = table(spark, sf, "documents")
    odd = spark.createDataFrame([(None, "null id stays", "en", "s", 1), (90_001, None, None, None, None), (90_002, "1 2 3", "en", "s", 1), (90_003, "ab cd ef", "en", "s", 1), (90_003, "ab cd ef", "en", "s", 1), (90_004, "gh ij kl", None, None, None)], docs.schema)
    rows = docs.unionByName(odd).withColumn("kept", docs["doc_id"]).withColumn("digest", docs["text"])
    out = reduce(lambda d, s: s[1](spark, d, sf), corpus_pipeline.STAGES[:-1], rows)
    assert out.columns == rows.columns
    ids = [r.doc_id for r in out.where("doc_id is null or doc_id > 90000").select("doc_id").collect()]
    assert sorted(ids, key=lambda x: x or 0) == [None, 90_003, 90_004]
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0


def test_extra_columns_of_any_name_and_type(spark, sf):
    docs = table(spark, sf, "documents").limit(120)
    names = ["score", "lang_pred", "held_out", "predicted", "_score", "_lang", "place", "_place", "kept", "n", "node", "digest", "a.b", "file_words"]
    rows = docs.unionByName(docs.limit(3)).unionByName(docs.limit(3).withColumn("n_chars", docs["n_chars"] + 1))
    for i, n in enumerate(names):
        rows = rows.withColumn(n, rows["doc_id"] + i)
    rows = rows.selectExpr("*", "map('k', doc_id) as m", "array(named_struct('x', text)) as s")
    out = reduce(lambda d, s: s[1](spark, d, sf), corpus_pipeline.STAGES[:-1], rows)
    assert out.columns == rows.columns
    kept = out.collect()
    assert len(kept) > 60 and len({r.doc_id for r in kept}) == len(kept)
    for r in kept:
        assert all(r[n] == r.doc_id + i for i, n in enumerate(names)) and r.m == {"k": r.doc_id} and r.s[0].x == r.text
    assert corpus_pipeline.codes(spark, out, sf).count() == len(kept)


def test_long_texts_and_the_session(spark, sf):
    docs = table(spark, sf, "documents").limit(20)
    words = "the sea and the wind are on the way to a land "
    long_ = spark.createDataFrame([(i, None, "en", "s", 1) for i in range(80_001, 80_013)], docs.schema).selectExpr("doc_id", f"concat(repeat('{words}', 230000), doc_id) as text", "lang", "source", "n_chars")
    before = dict(spark.sparkContext.getConf().getAll()), spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    out = reduce(lambda d, s: s[1](spark, d, sf), corpus_pipeline.STAGES, docs.unionByName(long_))
    assert [r.doc_id for r in out.where("doc_id > 80000").collect()] == [80_001]
    assert (dict(spark.sparkContext.getConf().getAll()), spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) == before


def test_models_are_those_of_the_queries():
    assert corpus_pipeline.langid is langid and corpus_pipeline.VOCABULARY == entries.CODE_VOCABULARY
