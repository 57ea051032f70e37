"""The registered queries over the smallest tables, and the pipeline's stages against brute force."""

from __future__ import annotations

import os
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corvane.llm import lines, packing, queries, secrets, toxicity

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "documents embeddings pages labels conversations".split()


def docs_of(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql_gives_the_same_rows(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df, rel = queries.QUERIES[name](spark, SF), con.sql(queries.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert sorted(map(tuple, df.select(*rel.columns).collect())) == sorted(rel.fetchall())


@pytest.mark.parametrize("name, table", [(q, "pages" if q.startswith("op10_") else "documents") for q in queries.QUERIES if not q.startswith(("op1_", "op6_", "op12_"))])
def test_a_row_for_each_row(spark, name, table):
    key = "page_id" if table == "pages" else "doc_id"
    out = sorted(r[0] for r in queries.QUERIES[name](spark, SF).select(key).collect())
    assert out == sorted(r[0] for r in spark.read.parquet(f"{SF}/{table}.parquet").select(key).collect())


def test_toxic_documents_go(spark):
    docs = docs_of(spark)
    kept = {r["doc_id"] for r in corpus_pipeline.drop_toxic(spark, docs, SF).collect()}
    assert kept == {r["doc_id"] for r in queries.op8_toxicity(spark, SF).where("predicted = 0").collect()}
    assert len(kept) > 100


def test_boilerplate_goes(spark):
    # every source takes part in the sites, so some passages of the small table are boilerplate
    docs = docs_of(spark).withColumn("text", F.concat("text", F.lit("\nAll rights reserved.")))
    rows = {r["doc_id"]: r for r in docs.collect()}
    sites, first = defaultdict(set), {}
    for i in sorted(rows):
        for n, line in enumerate(rows[i]["text"].split("\n")):
            if t := line.strip(" "):
                sites[t].add(rows[i]["source"])
                first.setdefault(t, (i, n))
    bad = {t for t in sites if len(sites[t]) >= lines.MIN_SITES}
    assert "All rights reserved." in bad
    want = {}
    for i, r in rows.items():
        parts = r["text"].split("\n")
        kept = [x for n, x in enumerate(parts) if x.strip(" ") not in bad or first[x.strip(" ")] == (i, n)]
        if len(kept) == len(parts) or "".join(kept).strip(" \t\r"):
            want[i] = "\n".join(kept)
    assert {r["doc_id"]: r["text"] for r in corpus_pipeline.dedup_lines(spark, docs, SF).collect()} == want


def test_near_duplicates_go(spark):
    docs = docs_of(spark)
    sets = {}
    for r in docs.collect():
        w = re.sub("[A-Z]", lambda m: m[0].lower(), r["text"]).encode().split()
        sets[r["doc_id"]] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()}
    like = lambda a, b: len(sets[a] & sets[b]) / max(1, len(sets[a] | sets[b]))
    ids = sorted(sets)
    alike = [(a, b) for a in ids for b in ids if a < b and like(a, b) >= 0.8]
    assert alike and not any(a in kept and b in kept for a, b in alike)
    # whatever goes has a like text with a smaller id
    assert all(i in kept or any(like(i, j) > 0.5 for j in ids if j < i) for i in ids)


def test_secrets_are_replaced(spark):
    docs = docs_of(spark)
    out = {r["doc_id"]: r["text"] for r in corpus_pipeline.redact_secrets(spark, docs, SF).collect()}
    for r in docs.collect():
        text = r["text"]
        for _, pattern, group, least in secrets.BASE:
            text = re.sub(pattern, lambda m, g=group, n=least: m[0][: len(m[0]) - len(m[g])] + "[SECRET]" if len(m[g]) >= n else m[0], text, flags=re.A)
        assert out[r["doc_id"]] == text
    assert any("[SECRET]" in t for t in out.values())


def test_run_is_its_stages(spark):
    docs = docs_of(spark)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    piece = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    run = corpus_pipeline.run(spark, SF)
    tokens = lambda df: sorted(map(tuple, df.select("doc_id", "doc_tokens").distinct().collect()))
    assert tokens(run) == tokens(docs) and run.columns == docs.columns and set(piece) <= set(run.columns)
    total = run.agg(F.sum("length")).first()[0]
    assert total == sum(n for _, n in tokens(run)) and packing.TIERS[0] >= run.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0]
    assert toxicity.AT == 0.3


def test_words_of_url_rules(spark):
    """Each rule's word is the contract's."""
    urls = {"x.com/en/1": ("com/en/", "block"), "example.com/en/7": ("example.com/en/7", "allow"), "x.net/de/7": ("net/de/", "allow"), "example.net/de/7": ("net/de/", "allow"), "a.example.net/de/8": ("example.net/de/8", "block"), "x.org/es/": ("org/es/", "block")}
    df = spark.createDataFrame([(i, f"http://{u}") for i, u in enumerate(urls)], "page_id long, url string")
    out = {r["page_id"]: (r["rule"], r["verdict"]) for r in queries.urls.judge(df).collect()}
    assert [out[i] for i in range(len(urls))] == list(urls.values())
