"""Every operator and stage on odd rows, on clashing columns and on empty tables."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidewell.llm import queries
from tidewell.llm.common import is_held_out
from tidewell.llm.ngram_join import ngram_components

CLASHING = ["key", "mark", "n", "id", "score", "held_out", "predicted", "spans", "label", "part"]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Null and empty texts, repeats, a very long text, a null id, extra columns."""
    word = "the reed thand eron whore and of tion "
    rows = [
        (0, None, None), (1, "", "en"), (2, " \n\t ", "en"), (3, "12 34 ... !", None),
        (4, word * 30, "en"), (5, word * 30, "en"), (6, word * 30 + "more", "fr"),
        (7, "été " + word * 9000, "fr"), (8, 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', "de"),
        (9, "short", None), (9, "short", None), (None, "no id " * 60, "es"),
    ]
    folder = str(tmp_path_factory.mktemp("odd"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    docs = docs.withColumn("source", F.lit("s")).withColumn("n_chars", F.length("text").cast("long"))
    for name in CLASHING:
        docs = docs.withColumn(name, F.lit("x"))
    docs.write.parquet(f"{folder}/documents.parquet")
    labels = [(i, i % 2, (i + 1) % 2) for i in range(4, 10)] + [(None, 1, 1), (3, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(
        [(1, word.strip() * 4), (2, None), (3, " "), (4, "xyz")], "item_id long, text string"
    ).write.parquet(f"{folder}/benchmark.parquet")
    vectors = [
        (0, [1.0, 0.0]), (50, [1.0, 0.0]), (1, [0.0, 1.0]), (2, None), (3, [0.0, 0.0]),
        (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [1.0, 2.0, 3.0]), (100, [2.0, 4.0, 6.0]),
        (7, [3.0, 0.0]), (None, [1.0, 1.0]), (8, []), (7, [3.0, 0.0]),
    ]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").withColumn(
        "d", F.lit(1)
    ).write.parquet(f"{folder}/embeddings.parquet")
    spark.createDataFrame(
        [(1, "http://a.b/x#y", "<p>"), (2, None, None), (3, "https://www.A.b:443/x/?utm_source=f", "<q>")],
        "page_id long, url string, html string",
    ).write.parquet(f"{folder}/pages.parquet")
    return folder


@pytest.fixture(scope="module")
def empty(spark, odd, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("empty"))
    for name in ("documents", "labels", "benchmark", "embeddings", "pages"):
        spark.read.parquet(f"{odd}/{name}.parquet").limit(0).write.parquet(f"{folder}/{name}.parquet")
    return folder


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_empty(spark, empty, name):
    assert queries.QUERIES[name](spark, empty).collect() == []


def by_id(rows):
    return {r["doc_id"]: r for r in rows}


@pytest.mark.parametrize("name", ["op2_quality", "op10_toxicity"])
def test_scores(spark, odd, name):
    rows = queries.QUERIES[name](spark, odd).collect()
    assert len(rows) == 12 and all(0 <= r["score"] <= 1 for r in rows)
    found = by_id(rows)
    assert found[0]["score"] == found[1]["score"] and found[4]["score"] == found[5]["score"]


def test_suffix(spark, odd):
    rows = queries.op3_suffix_dedup(spark, odd).collect()
    found = by_id(rows)
    assert len(rows) == 12
    assert found[0]["n_bytes"] == 0 and found[0]["kept_sha256"] == hashlib.sha256(b"").hexdigest()
    assert found[4]["n_removed"] == found[4]["n_bytes"] and found[4]["n_spans"] == 1
    assert found[8]["n_removed"] == 0 and found[None]["n_removed"] == found[None]["n_bytes"]


def test_language(spark, odd):
    rows = queries.op4_language(spark, odd).collect()
    found = by_id(rows)
    assert len(rows) == 12
    assert [found[i]["lang_pred"] for i in (0, 1, 2, 3)] == ["und"] * 4
    assert found[4]["lang_pred"] in ("en", "fr", "de", "es")


def test_secrets(spark, odd):
    found = by_id(queries.op5_secrets(spark, odd).collect())
    assert found[8]["spans"] == "assign:0:49,hex:9:49" and found[8]["n_hex"] == 1
    assert found[0]["spans"] == "" and found[0]["base_sha256"] == hashlib.sha256(b"").hexdigest()


def test_neighbours(spark, odd):
    rows = queries.op6_neighbours(spark, odd).collect()
    found = {q: [(r["vec_id"], round(r["score"], 6)) for r in sorted(rows, key=lambda r: r["rank"]) if r["query_id"] == q] for q in (0, 50, 100)}
    assert found[0] == [(7, 1.0), (7, 1.0), (50, 1.0), (1, 0.0)]
    assert found[50] == [(0, 1.0), (7, 1.0), (7, 1.0), (1, 0.0)]
    assert found[100] == [(6, 1.0)]


def test_packing(spark, odd):
    rows = queries.op7_packing(spark, odd).collect()
    assert sum(r["doc_id"] == 0 and r["length"] == 1 for r in rows) == 1
    used = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == used.get(r["sequence_id"], 0)
        used[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(used.values()) <= 4096 and len(used) == -(-sum(used.values()) // 4096)


def test_decontamination(spark, odd):
    rows = queries.op8_decontamination(spark, odd).collect()
    assert {r["doc_id"] for r in rows if r["item_id"] == 1} == {4, 5, 6, 7}
    assert not [r for r in rows if r["item_id"] in (2, 3)]


def test_ngrams(spark, odd):
    rows = queries.op9_ngram_join(spark, odd).collect()
    found = by_id(rows)
    assert len(rows) == 12 and found[0]["n_shingles"] == 0 and found[9]["n_shingles"] == 1
    assert [found[i]["component_id"] for i in (0, 1, 4, 5, 6, 9)] == [0, 1, 4, 4, 4, 9]


def test_ngrams_of_a_repeated_id(spark):
    one, two = (" ".join(f"{w}{i}" for i in range(60)) for w in "ab")
    docs = spark.createDataFrame(
        [(5, one), (5, two), (5, one), (3, one + " more")], "doc_id long, text string"
    )
    rows = ngram_components(docs).collect()
    found = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows)
    assert found == [(3, 57, 3), (5, 56, 3), (5, 56, 3), (5, 56, 5)]


def test_revisits(spark, odd):
    rows = queries.op1_revisits(spark, odd).collect()
    assert len(rows) == 6
    found = {r["record_id"]: r for r in rows}
    # Page 3's early revisit sees page 1, whose URL is the same, with another tag.
    assert found[11]["status"] == "validator_mismatch" and found[4]["status"] == "resolved"
    assert found[7]["status"] == "no_earlier_response"


def test_held_out(spark):
    import zlib

    rows = spark.range(50).select("id", is_held_out("id", 5, 0).alias("h")).collect()
    assert [r["h"] for r in rows] == [zlib.crc32(str(r["id"]).encode()) % 5 == 0 for r in rows]


def test_pipeline(spark, odd, empty):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, odd)
        assert got.columns == docs.columns, name
        got.collect()
    assert {r[0] for r in corpus_pipeline.keep_distinct(spark, docs, odd).select("doc_id").collect()} == {0, 1, 2, 3, 4, 8, 9, None}
    assert 0 < len(corpus_pipeline.run(spark, odd).collect())
    clean = corpus_pipeline.redact_secrets(spark, docs, odd).where("doc_id = 8").first()
    assert clean["text"] == "[SECRET]\"" or clean["text"].startswith("[SECRET]")
    assert clean["n_chars"] == len(clean["text"])
    assert corpus_pipeline.run(spark, empty).collect() == []


def kept(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return sorted((tuple(r) for r in corpus_pipeline.keep_distinct(spark, docs, "").collect()), key=repr)


def test_distinct_rows_of_repeated_and_null_ids(spark):
    a, b = (" ".join(f"{w}{i}" for i in range(60)) for w in "ab")
    more = a + " more"
    assert kept(spark, [(3, a), (7, more), (7, b)]) == [(3, a), (7, b)]
    assert len(kept(spark, [(3, a), (3, more)])) == 1
    assert kept(spark, [(None, a), (None, a)]) == [(None, a)]
    assert kept(spark, [(None, a), (None, b), (9, more)]) == [(9, more), (None, b)]
    assert kept(spark, [(1, ""), (1, ""), (None, None), (2, a), (2, a)]) == [(1, ""), (1, ""), (2, a), (None, None)]
