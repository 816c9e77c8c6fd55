"""Registered queries of this package (importing this module fills the registry)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablelens.llm import knn, language, quality
from tablelens.llm.decontam import decontaminate
from tablelens.llm.line_dedup import remove_repeated_chunks
from tablelens.llm.near_dedup import near_classes
from tablelens.llm.packing import pack
from tablelens.llm.registry import QUERIES, SQL, query, table
from tablelens.llm.sampling import held_out
from tablelens.llm.sharding import shard_documents
from tablelens.llm.simhash import near_components
from tablelens.llm.suffix_dedup import remove_repeats
from tablelens.llm.token_counts import length_histogram, with_suffix_sums
from tablelens.llm.turn_repair import damaged, repair
from tablelens.llm.whitening import whiten
from tablelens.session import materialize

__all__ = ["QUERIES", "SQL"]

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAM_SQL = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item, CAST(least(len(w), 10) AS BIGINT) AS n,
               array_to_string(w[g:g + 9], ' ') AS s
        FROM (SELECT item, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS g FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS g
       FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n),
occ AS (SELECT doc_id, g, n, item FROM (SELECT doc_id, g, n, array_to_string(w[g:g + n - 1], ' ') AS s FROM dw)
        JOIN win USING (n, s)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit
        FROM (SELECT doc_id, unnest(generate_series(g, g + n - 1)) AS p FROM occ) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS sha
       FROM (SELECT DISTINCT doc_id, item FROM occ) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(sha, sha256('')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""


@query("op8_decontaminate", DECONTAM_SQL)
def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against every benchmark item, windows of ten words."""
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op10_shard_best_fit_decreasing")
def op10_shard_best_fit_decreasing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into shards 0 to 7 of nearly equal bytes; equal texts share a shard."""
    dealt = shard_documents(table(spark, sf_dir, "documents"), n_shards=8)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                        F.lit(None).cast("int").alias("grown_shard"))


@query("op9_token_counts")
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact histogram of encoded lengths over all documents, with its suffix sums."""
    return with_suffix_sums(length_histogram(table(spark, sf_dir, "documents")))


@query("op4_pack_best_fit")
def op4_pack_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, as token pieces, in sequences of at most 2048 tokens."""
    return pack(table(spark, sf_dir, "documents"))


@query("op3_quality_classifier")
def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; learned from rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    scored = quality.add_scores(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


@query("op6_language_id")
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; learned from rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    found = language.add_languages(docs.select("doc_id", "text"), language.fit(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


KNN_SQL = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
             CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
      FROM e AS q JOIN e AS c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""


@query("op7_knn_voronoi_join", KNN_SQL)
def op7_knn_voronoi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best inner products of every fiftieth vector with all other vectors."""
    vectors = knn.quantized(table(spark, sf_dir, "embeddings"))
    return knn.top_k(vectors, vectors.where(F.col("id") % 50 == 0), k=5)


@query("op2_line_dedup")
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its repeated multi-line chunks (counts and a digest of what is kept)."""
    left = remove_repeated_chunks(table(spark, sf_dir, "documents").select("doc_id", "text"))
    text = F.coalesce("text", F.lit(""))
    return left.select("doc_id", "removed_lines", "removed_chunks", F.octet_length(text).cast("long").alias("kept_bytes"),
                       F.sha2(text, 256).alias("kept_sha256"))


@query("op5_near_dedup_bagminhash")
def op5_near_dedup_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document (weighted Jaccard of five-word shingles, 0.8)."""
    classes = near_classes(table(spark, sf_dir, "documents"))
    return classes.select(F.col("__id").alias("doc_id"), "class_id", "class_size", "kept")


@query("op1_suffix_dedup")
def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the 100-byte strings that also start earlier."""
    docs = table(spark, sf_dir, "documents")
    lost = materialize(remove_repeats(docs).select(
        F.col("__id").alias("__lost_id"), F.col("__h").alias("__lost_h"), "n_removed",
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("sha")))
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.xxhash64("text").alias("__h"), F.octet_length(text).cast("long").alias("n_bytes"),
                       F.sha2(text, 256).alias("whole"))
    on = F.col("doc_id").eqNullSafe(F.col("__lost_id")) & (F.col("__h") == F.col("__lost_h"))
    zero = F.lit(0).cast("long")
    return rows.join(lost, on, "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"),
        F.coalesce("sha", "whole").alias("kept_sha256"))


@query("op13_simhash_golay")
def op13_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash of every document and its component over links of at most two differing bits."""
    return near_components(table(spark, sf_dir, "documents"))


@query("op12_whitening")
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding on the 16 leading whitened components; a deviation that no long holds is null."""
    return whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").try_cast("long"))


# The least (cost, audit) of each state after each turn, with up to two inserts before it.
REPAIR_SQL = r"""
WITH RECURSIVE key AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
bytes AS (SELECT *, list_transform(range(1, len(k) + 1), lambda i: CAST(ascii(substr(k, CAST(i AS INTEGER), 1)) AS BIGINT)) AS b FROM key),
harm AS (SELECT *, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), b), lambda c, x: list_reduce(list_prepend(xor(c, x), range(8)),
  lambda y, i: xor(y >> 1, CASE WHEN y & 1 = 1 THEN CAST(3988292384 AS BIGINT) ELSE CAST(0 AS BIGINT) END))), CAST(4294967295 AS BIGINT)) % 20 AS h FROM bytes),
hurt AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
  CASE WHEN h = 1 THEN '' WHEN h = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
  unnest(generate_series(1, CASE WHEN h = 3 THEN 2 ELSE 1 END)) AS copy FROM harm WHERE h <> 0),
numbered AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i,
  NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS ended FROM hurt),
r AS (SELECT *, substr(role, 1, 1) AS initial, NOT blank AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS dup,
  lead(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS following FROM numbered),
counts AS (SELECT conv_id, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps, count(*) FILTER (WHERE blank) AS blank,
  count(*) FILTER (WHERE dup) AS duplicate, count(*) FILTER (WHERE NOT blank AND NOT dup AND NOT ended) AS truncated,
  count(*) FILTER (WHERE following IS NOT NULL AND initial || following NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM r GROUP BY conv_id),
takes(p, letter, q) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
due(p, q, due_role) AS (VALUES (0, 2, 'user'), (1, 2, 'user'), (2, 3, 'assistant'), (3, 2, 'user')),
inserts AS (SELECT p, p AS q, 0 AS cost, '' AS audit, CAST([] AS VARCHAR[]) AS lines FROM due
  UNION ALL SELECT p, q, 5, 'I', [due_role || ':'] FROM due
  UNION ALL SELECT a.p, b.q, 10, 'II', [a.due_role || ':', b.due_role || ':'] FROM due a JOIN due b ON a.q = b.p),
ways AS (SELECT conv_id, i, j.p, j.q, j.cost + 2 AS cost, j.audit || 'D' AS audit, j.lines FROM r, inserts j
  UNION ALL SELECT conv_id, i, j.p, t.q, j.cost + CASE WHEN ended THEN 0 ELSE 5 END, j.audit || 'K', list_append(j.lines, role || ':' || text)
  FROM r, inserts j JOIN takes t ON t.p = j.q WHERE NOT blank AND NOT dup AND t.letter = initial
  UNION ALL SELECT conv_id, i, j.p, d.q, j.cost + CASE WHEN ended THEN 1 ELSE 6 END, j.audit || 'R', list_append(j.lines, d.due_role || ':' || text)
  FROM r, inserts j JOIN due d ON d.p = j.q WHERE NOT blank AND NOT dup),
best AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, 0 AS p, 0 AS cost, '' AS audit, CAST([] AS VARCHAR[]) AS lines FROM counts
  UNION ALL SELECT conv_id, i, p, cost, audit, lines FROM (
    SELECT w.conv_id, w.i, w.q AS p, b.cost + w.cost AS cost, b.audit || w.audit AS audit, list_concat(b.lines, w.lines) AS lines,
      row_number() OVER (PARTITION BY w.conv_id, w.q ORDER BY b.cost + w.cost, b.audit || w.audit) AS nth
    FROM best b JOIN ways w ON w.conv_id IS NOT DISTINCT FROM b.conv_id AND w.i = b.i + 1 AND w.p = b.p) WHERE nth = 1),
ended AS (SELECT b.conv_id, b.cost + j.cost AS cost, b.audit || j.audit AS audit, list_concat(b.lines, j.lines) AS lines,
  row_number() OVER (PARTITION BY b.conv_id ORDER BY b.cost + j.cost, b.audit || j.audit) AS nth
  FROM best b JOIN counts c ON c.conv_id IS NOT DISTINCT FROM b.conv_id AND c.n = b.i JOIN inserts j ON j.p = b.p WHERE j.q IN (0, 3))
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit,
  coalesce(sha256(array_to_string(lines, chr(10))), sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN (SELECT * FROM ended WHERE nth = 1) e ON e.conv_id IS NOT DISTINCT FROM o.conv_id
"""


@query("op11_turn_repair", REPAIR_SQL)
def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every conversation, after its damage."""
    rows = table(spark, sf_dir, "conversations")
    found = repair(damaged(rows))
    counts, digests = found.counts.withColumnRenamed("conv_id", "__counted"), found.digests().withColumnRenamed("conv_id", "__told")
    every = rows.select("conv_id").distinct()
    both = every.join(counts, F.col("conv_id").eqNullSafe(F.col("__counted")), "left").join(digests, F.col("conv_id").eqNullSafe(F.col("__told")), "left")
    return both.select("conv_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
                       F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
