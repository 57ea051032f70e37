"""Queries over the driver's tables, one per operator, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import bpe, exact, lines, merkle, packing, runs, secrets, simhash, suffix, topk, toxicity, trie, urls
from corvane.llm.common import documents, table

K, QUERY_MODULUS = 5, 50


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.exact_topk(vectors.where(F.col("vec_id") % QUERY_MODULUS == 0), vectors, K)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffix.dedup(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op3_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.fingerprints(documents(table(spark, sf_dir, "documents")))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(secrets.scan(table(spark, sf_dir, "documents")))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.dedup(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digests(runs.find(runs.with_planted_runs(table(spark, sf_dir, "documents"))))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    seqs = trie.sequences(table(spark, sf_dir, "conversations"))
    c = F.col("conv_id")
    return trie.trie(trie.grafted(seqs, c - c % 20, F.crc32(c.cast("string").cast("binary")) % 4, 3))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.groups(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_exact_topk, op2_suffix_dedup, op3_merkle_fingerprints, op4_bpe, op5_secret_scan, op6_packing, op7_simhash, op8_toxicity, op9_line_dedup, op10_url_filter, op11_periodic_runs, op12_conversation_trie, op13_exact_dedup)
}

ORACLE_SQL = {
    "op1_exact_topk": f"""
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
                   WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND NOT list_contains(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)), true)),
             s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
                   FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % {QUERY_MODULUS} = 0)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= {K}""",
    "op9_line_dedup": f"""
        WITH l AS (SELECT doc_id, coalesce(source, '') AS site, unnest(range(len(x))) AS pos, unnest(x) AS line
                   FROM (SELECT doc_id, source, string_split(coalesce(text, ''), chr(10)) AS x FROM documents)),
             b AS (SELECT trim(line, ' ') AS t, min(doc_id) AS d FROM l WHERE trim(line, ' ') <> '' GROUP BY 1 HAVING count(DISTINCT site) >= {lines.MIN_SITES}),
             f AS (SELECT b.t, b.d, min(l.pos) AS a FROM b JOIN l ON trim(l.line, ' ') = b.t AND l.doc_id = b.d GROUP BY 1, 2),
             m AS (SELECT l.*, f.t IS NOT NULL AND NOT (l.doc_id = f.d AND l.pos = f.a) AS gone FROM l LEFT JOIN f ON trim(l.line, ' ') = f.t)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM m GROUP BY doc_id""",
    "op12_conversation_trie": r"""
        WITH own AS (SELECT conv_id, list(struct_pack(id := id, w := w) ORDER BY turn NULLS FIRST, id) AS t
                     FROM (SELECT conv_id, turn, md5(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS id,
                                  len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS w
                           FROM conversations WHERE conv_id IS NOT NULL) GROUP BY conv_id),
             h AS (SELECT conv_id, conv_id - conv_id % 20 AS base, t,
                          xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: [CAST(ascii(x) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))),
                              lambda c, v: xor(xor(c, v) >> 1, 3988292384 * (xor(c, v) & 1)))) % 4 AS h FROM own),
             r AS (SELECT h.conv_id AS c, list_concat(coalesce(o.t[1:h.h], []), h.t[h.h + 1:]) AS t FROM h LEFT JOIN own o ON o.conv_id = h.base),
             p AS (SELECT c, d, len(t) AS n, array_to_string(list_transform(t[1:d], lambda x: x.id), '') AS node, CASE WHEN d > 0 THEN array_to_string(list_transform(t[1:d - 1], lambda x: x.id), '') END AS up,
                          CASE WHEN d > 0 THEN t[d].w ELSE 0 END AS w
                   FROM (SELECT c, t, unnest(range(0, len(t) + 1)) AS d FROM r)),
             g AS (SELECT node, any_value(up) AS up, any_value(d) AS d, min(c) AS c, count(*) AS n, any_value(w) AS w,
                          sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE n = d), '')) AS ends FROM p GROUP BY node),
             k AS (SELECT up, count(*) AS n FROM g WHERE up IS NOT NULL GROUP BY up),
             a AS (SELECT g.*, coalesce(k.n, 0) AS kids FROM g LEFT JOIN k ON k.up = g.node),
             s AS (SELECT substr(node, 1, 32 * e) AS node, sum((n - 1) * w) AS saved, count(*) FILTER (WHERE kids = 0) AS leaves FROM (SELECT *, unnest(range(0, d + 1)) AS e FROM a) GROUP BY 1)
        SELECT a.c AS conv_id, CAST(a.d AS BIGINT) AS depth, b.c AS parent_conv_id, a.n AS n_convs, CAST(a.kids AS BIGINT) AS n_children, CAST(s.leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, a.ends AS ends_sha256
        FROM a JOIN s USING (node) LEFT JOIN a b ON b.node = a.up""",
    "op13_exact_dedup": r"""
        WITH x AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
             g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS n FROM x GROUP BY t)
        SELECT doc_id, keep_id, n AS group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(t) AS text_sha256 FROM x JOIN g USING (t)""",
}
