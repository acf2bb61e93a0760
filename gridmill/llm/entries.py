"""Registered queries of the subpackage, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmill.llm import bpe, chat, decontaminate, langid, lexical, licenses, near_duplicates, quantize, sharding, token_counts, topk, toxicity, warc
from gridmill.llm.common import table

#: Vocabulary files; a caller of the operators passes its own paths.
COUNT_VOCABULARY, CODE_VOCABULARY = "byte_bpe_50k.json", "word_bpe_49k.json"


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole text, and whether they pass 1024."""
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(COUNT_VOCABULARY))


def _spans(mask: str) -> Column:
    """A mask as text: start:length:learned, joined by ;"""
    return F.array_join(F.transform(mask, lambda s: F.concat_ws(":", s["start"], s["length"], s["learned"].cast("string"))), ";")


def op2_chat_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation against its version with a worse last reply."""
    turns = table(spark, sf_dir, "conversations")
    chosen, rejected = (x.withColumnRenamed("conv_id", "pair_id") for x in (turns, chat.weakened(turns)))
    got = chat.preferences(chosen, rejected)
    return got.select(F.col("pair_id").alias("conv_id"), "prompt", "prompt_turns", "chosen", "rejected", _spans("chosen_mask").alias("chosen_mask"), _spans("rejected_mask").alias("rejected_mask"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text by the machine fitted on the learning folds."""
    docs = table(spark, sf_dir, "documents")
    machine = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, machine).select("doc_id", "held_out", "score", "predicted")


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose sets of three-word shingles are similar by 0.85 or more."""
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85, rows=7)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item or an edited copy, with the item and its similarity."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page taken through ARC and WARC files, as read back from the latter."""
    return warc.archived(table(spark, sf_dir, "pages"))


def op7_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of every whole text and of the text decoded from them."""
    return bpe.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path(CODE_VOCABULARY))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence of every document as a file in a tree of sources, thousands and hundreds of ids.

    One in ten lies right under its source, two in ten under the thousand, the others in the hundred."""
    docs = table(spark, sf_dir, "documents")
    last = F.col("doc_id") % 10
    thousand, hundred = F.floor(F.col("doc_id") / 1000).cast("string"), (F.floor(F.col("doc_id") / 100) % 10).cast("string")
    path = F.concat_ws("/", F.coalesce("source", F.lit("-")), F.when(last > 0, thousand), F.when(last > 2, hundred), F.col("doc_id").cast("string"))
    got = licenses.scan(docs.select(path.alias("path"), "text"))
    return got.select(F.regexp_extract("path", "[^/]*$", 0).cast("long").alias("doc_id"), "license", "similarity", "origin", "found_in")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text by the prototypes of the learning folds."""
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.prototypes(docs)).select("doc_id", "held_out", "lang_pred", "score")


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 highest inner products of every fiftieth vector with all others."""
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector as 16 entries of codebooks of 64, fitted in two rounds."""
    return quantize.compressed(table(spark, sf_dir, "embeddings"))


def op12_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 contiguous shards of near equal bytes."""
    return sharding.assigned(table(spark, sf_dir, "documents"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 documents that score highest for every benchmark item."""
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_QUERIES = (op1_token_counts, op2_chat_preferences, op3_toxicity, op4_near_duplicates, op5_decontamination, op6_warc, op7_bpe_round_trip, op8_licenses, op9_language_id, op10_top_k, op11_vector_codes, op12_shards, op13_lexical_search)
#: A round of the vector codes: assignment to the entries of bNOW, and the entries moved.
_ROUND = """
aNOW AS (SELECT r, part, arg_min(entry, row(d, entry)) AS entry FROM (SELECT r, part, entry, sum((x.c - b.c) * (x.c - b.c)) AS d FROM x JOIN bNOW b USING (part, pos) GROUP BY ALL) GROUP BY r, part),
mNOW AS (SELECT part, entry, pos, CAST(sum(c) AS BIGINT) AS t, count(*) AS n FROM x JOIN aNOW USING (r, part) GROUP BY ALL),
bNEXT AS MATERIALIZED (SELECT part, entry, pos, coalesce((t - ((t % n) + n) % n) // n, c) AS c FROM bNOW LEFT JOIN mNOW USING (part, entry, pos)),"""
_SQL: dict[str, str] = {
    "op11_vector_codes": """
WITH v AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label, embedding AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
u AS (SELECT r, unnest(range(len(e))) AS i, len(e) // 16 AS w, unnest(e) AS c FROM v),
x AS MATERIALIZED (SELECT r, i // w AS part, i % w AS pos, CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT) AS c FROM u),
b0 AS MATERIALIZED (SELECT part, r - 1 AS entry, pos, c FROM x WHERE r <= 64),
ROUNDS
a AS MATERIALIZED (SELECT r, part, min(d) AS d, arg_min(entry, row(d, entry)) AS entry FROM (SELECT r, part, entry, CAST(sum((x.c - b.c) * (x.c - b.c)) AS BIGINT) AS d FROM x JOIN b2 b USING (part, pos) GROUP BY ALL) GROUP BY r, part),
s AS (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM b2),
t AS (SELECT r, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM v JOIN t USING (r), s
""".replace("ROUNDS", "".join(_ROUND.replace("NEXT", str(i + 1)).replace("NOW", str(i)) for i in range(2))),
    "op12_shards": """
WITH RECURSIVE k AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, j: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END, i)) AS k),
h AS (SELECT doc_id, strlen(coalesce(text, '')) AS n, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT doc_id, n + 16 AS size, xor(list_reduce(list_transform(regexp_extract_all(h, '..'), lambda b: CAST('0x' || b AS BIGINT)), lambda c, b: xor(c // 256, k[xor(c, b) % 256 + 1]), 4294967295), 4294967295) AS text_crc32 FROM h, k),
o AS (SELECT *, sum(size) OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32 ROWS UNBOUNDED PRECEDING) - size AS before, sum(size) OVER () AS whole FROM c),
s AS (SELECT *, CAST((2 * before + size) * 40 // (2 * whole) AS INTEGER) AS shard FROM o)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY before) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard,
  row_number() OVER (ORDER BY before) - 1 AS place
FROM s
""",
    "op13_lexical_search": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
g AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(len(t)) AS BIGINT) AS total FROM d WHERE len(t) > 0),
tf AS (SELECT r, doc_id, len(t) AS n, term, count(*) AS tf FROM (SELECT r, doc_id, t, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM i) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, g GROUP BY term),
s AS (SELECT item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * n_docs) // total)))) AS BIGINT) AS score
  FROM i JOIN tf USING (term) JOIN w USING (term), g GROUP BY item_id, r, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 10
""",
    "op10_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.x AS DOUBLE[]), CAST(c.x AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.x) = len(c.x) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 5
""",
    "op6_warc": """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM f
""",
    "op2_chat_preferences": """
WITH t AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS pos,
    row_number() OVER (PARTITION BY conv_id, role = 'assistant' ORDER BY turn DESC, text DESC) AS left_,
    lag(text) OVER (PARTITION BY conv_id, role = 'assistant' ORDER BY turn, text) AS before FROM conversations),
b AS (SELECT conv_id, pos, role, text AS c, CASE WHEN role = 'assistant' AND left_ = 1 THEN coalesce(before, '') ELSE text END AS r FROM t),
p AS (SELECT *, coalesce(min(CASE WHEN c <> r THEN pos END) OVER (PARTITION BY conv_id) - 1, count(*) OVER (PARTITION BY conv_id)) AS prompt_turns,
    '<|im_start|>' || role || chr(10) AS head FROM b),
s AS (SELECT *, pos <= prompt_turns AS same, length(head) AS h, length(c) + 11 AS lc, length(r) + 11 AS lr,
    sum(length(head) + length(c) + 11) OVER (PARTITION BY conv_id ORDER BY pos) - length(head) - length(c) - 11 AS ac,
    sum(length(head) + length(r) + 11) OVER (PARTITION BY conv_id ORDER BY pos) - length(head) - length(r) - 11 AS ar FROM p)
SELECT conv_id, CAST(any_value(prompt_turns) AS INTEGER) AS prompt_turns,
  coalesce(string_agg(head || c || '<|im_end|>' || chr(10), '' ORDER BY pos) FILTER (same), '') AS prompt,
  coalesce(string_agg(head || c || '<|im_end|>' || chr(10), '' ORDER BY pos) FILTER (NOT same), '') AS chosen,
  coalesce(string_agg(head || r || '<|im_end|>' || chr(10), '' ORDER BY pos) FILTER (NOT same), '') AS rejected,
  coalesce(string_agg(ac || ':' || h || ':false;' || (ac + h) || ':' || lc || ':' || (role = 'assistant'), ';' ORDER BY pos) FILTER (NOT same), '') AS chosen_mask,
  coalesce(string_agg(ar || ':' || h || ':false;' || (ar + h) || ':' || lr || ':' || (role = 'assistant'), ';' ORDER BY pos) FILTER (NOT same), '') AS rejected_mask
FROM s GROUP BY conv_id
""",
    "op8_licenses": r"""
WITH template AS (SELECT * FROM (VALUES %s) AS t(template, license, text)),
tt AS (SELECT DISTINCT template, license, unnest(regexp_extract_all(lower(text), '[a-z0-9]+(?:[.-][a-z0-9]+)*')) AS term FROM template),
n AS (SELECT count(*) AS n FROM template),
idf AS (SELECT term, ln((1.0 + any_value(n)) / (1 + count(*))) + 1 AS idf FROM tt, n GROUP BY term),
weights AS (SELECT template, license, term, idf / sqrt(sum(idf * idf) OVER (PARTITION BY template)) AS weight, regexp_matches(term, 'VERSION') AS numbered FROM tt JOIN idf USING (term)),
versions AS (SELECT template, count(*) FILTER (numbered) AS versions FROM weights GROUP BY template),
f AS (SELECT doc_id, lower(coalesce(text, '')) AS text, coalesce(source, '-') AS s, coalesce(source, '-') || '/' || (doc_id // 1000) AS k,
  coalesce(source, '-') || '/' || (doc_id // 1000) || '/' || (doc_id // 100 %% 10) AS h, doc_id %% 10 AS last FROM documents),
g AS (SELECT *, CASE WHEN last = 0 THEN s WHEN last <= 2 THEN k ELSE h END AS folder FROM f),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM f),
lt AS (SELECT doc_id, pos, regexp_extract_all(line, '[a-z0-9]+(?:[.-][a-z0-9]+)*') AS terms FROM l),
r AS (SELECT *, sum(CASE WHEN len(terms) = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM lt),
full_ AS (SELECT * FROM r WHERE len(terms) > 0),
runs AS (SELECT doc_id, run, min(pos) AS place, count(*) AS lines, flatten(list(terms)) AS terms FROM full_ GROUP BY ALL),
every AS (
  SELECT doc_id, 0 AS level, pos AS place, terms FROM full_
  UNION ALL SELECT doc_id, 1, place, terms FROM runs WHERE lines > 1
  UNION ALL SELECT doc_id, 2, 0, flatten(list(terms)) FROM runs GROUP BY doc_id HAVING count(*) > 1),
units AS (SELECT * FROM every WHERE NOT regexp_matches(array_to_string(terms, ' '), 'DENIED')),
ut AS (SELECT DISTINCT doc_id, level, place, unnest(terms) AS term FROM units),
w AS (SELECT doc_id, level, place, term, coalesce(idf, ln(1.0 + (SELECT n FROM n)) + 1) AS w FROM ut LEFT JOIN idf USING (term)),
norm AS (SELECT doc_id, level, place, sqrt(sum(w * w)) AS norm, count(*) FILTER (regexp_matches(term, 'VERSION')) AS own_versions FROM w GROUP BY ALL),
d AS (SELECT doc_id, level, place, template, license, sum(w * weight) AS dot, count(*) FILTER (numbered) AS met FROM w JOIN weights USING (term) GROUP BY ALL),
e AS (SELECT doc_id, level, place, license, round(dot / norm, 6) AS similarity FROM d JOIN norm USING (doc_id, level, place) JOIN versions USING (template)
  WHERE round(dot / norm, 6) >= 0.75 AND (met = versions OR met = own_versions)),
m AS (SELECT doc_id, level, place, min(license) AS license, any_value(similarity) AS similarity, any_value(similarity) - CASE WHEN count(DISTINCT license) > 1 THEN 0.15 ELSE 0 END AS counted
  FROM (SELECT * FROM e QUALIFY similarity = max(similarity) OVER (PARTITION BY doc_id, level, place)) GROUP BY doc_id, level, place),
own AS (SELECT doc_id, arg_max(license, row(counted, -level, -place, license)) AS license, arg_max(similarity, row(counted, -level, -place, license)) AS similarity FROM m GROUP BY doc_id),
notice AS (SELECT doc_id, max(words) AS notice FROM (SELECT doc_id, level, sum(len(terms)) AS words FROM m JOIN units USING (doc_id, level, place) GROUP BY ALL) GROUP BY doc_id),
whole AS (SELECT doc_id, sum(len(terms)) AS words FROM full_ GROUP BY doc_id),
chief AS (SELECT folder, license, similarity FROM own JOIN g USING (doc_id) JOIN notice USING (doc_id) JOIN whole USING (doc_id) WHERE notice >= 0.1 * words
  QUALIFY row_number() OVER (PARTITION BY folder ORDER BY similarity DESC, folder || '/' || doc_id) = 1),
up AS (SELECT doc_id, s AS folder, 0 AS depth FROM g UNION ALL SELECT doc_id, k, 1 FROM g WHERE last > 0 UNION ALL SELECT doc_id, h, 2 FROM g WHERE last > 2),
near AS (SELECT doc_id, arg_max(chief, depth) AS near FROM up JOIN chief USING (folder) GROUP BY doc_id)
SELECT g.doc_id, coalesce(own.license, near.license) AS license, coalesce(own.similarity, near.similarity) AS similarity,
  CASE WHEN own.license IS NOT NULL THEN 'own' WHEN near.license IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
  CASE WHEN own.license IS NULL THEN near.folder END AS found_in
FROM g LEFT JOIN own USING (doc_id) LEFT JOIN near USING (doc_id)
""".replace("VERSION", r"^[0-9]{1,2}(\.[0-9]+)*$").replace("DENIED", "(^| )(not|never|longer)( [^ ]+){0,2} (licensed|released|available|covered|subject|permitted|granted|under)( |$)")
    .replace("%s", ", ".join(f"({i}, '{a}', '{b}')" for i, (a, b) in enumerate(licenses.templates()))).replace("%%", "%"),
    "op4_near_duplicates": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]) END) AS shingle
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)),
reach AS (SELECT doc_id AS id, doc_id AS other FROM documents UNION SELECT r.id, l.b FROM reach r JOIN links l ON r.other = l.a),
least_id AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN least_id ON least_id.id = d.doc_id
""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
