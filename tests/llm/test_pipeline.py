"""Each stage on its own input, and the pipeline from end to end."""

import zlib

import corpus_pipeline
from barloom.llm import jaccard, secrets
from barloom.llm.tokens import ChunkEncoder, tokenizer_path
from pyspark.sql import functions as F

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_one_after_another(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir).cache()
        assert docs.columns == COLUMNS, name
        assert 0.5 * before < docs.count() <= before, name
        before = docs.count()
    groups = jaccard.jaccard_groups(docs, words=5, percent=80)
    assert groups.where("id <> component").count() <= 1  # redaction may make two texts alike
    assert secrets.scan_secrets(docs).where(F.size("secret_spans") > 0).count() == 0
    enc = ChunkEncoder(tokenizer_path("byte_bpe_50k.json"), "kept")
    ids = {r["doc_id"]: enc.encode(r["text"]) + bytes(4) for r in docs.collect()}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert {p["doc_id"] for p in packed} == set(ids) and sum(p["length"] for p in packed) == sum(map(len, ids.values())) // 4
    assert all(p["ids_crc32"] == zlib.crc32(ids[p["doc_id"]][4 * p["start"] : 4 * (p["start"] + p["length"])]) for p in packed)


def test_clean_labelled_documents_are_kept(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    kept = corpus_pipeline.quality_stage(spark, docs, sf_dir)
    good = docs.join(labels.where("quality = 1"), "doc_id").where(F.size(F.split("text", r"\s+")) >= 40)
    assert good.join(kept, "doc_id", "left_anti").count() == 0
    assert corpus_pipeline.language_stage(spark, kept, sf_dir).count() == kept.count()


def odd_documents(spark, sf_dir):
    """Nulls in every column, empty and long texts, repeated rows, and columns that the operators use themselves."""
    base = spark.read.parquet(f"{sf_dir}/documents.parquet").where("lang is not null").limit(40)
    long = base.limit(1).withColumns({"doc_id": F.lit(10_001).cast("long"), "text": F.repeat(F.concat("text", F.lit(" ")), 60)})
    odd = spark.createDataFrame([(10_002, None, None, None, None), (10_003, "", "en", "s", 0), (None, "some words of a text without an id " * 5, None, "s", 9), (10_004, "12 34", "en", None, 5)], base.schema)
    docs = base.unionByName(base.limit(3)).unionByName(long).unionByName(odd)
    return docs.withColumns({k: F.lit("clash") for k in ("kept", "spans", "secret_spans", "lang_pred", "score", "rejected", "component", "id", "digest")})


def test_stages_take_odd_rows(spark, sf_dir):
    docs = odd_documents(spark, sf_dir).cache()
    total = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, sf_dir)
        rows = got.collect()
        assert got.columns == COLUMNS and 0 < len(rows) <= total, name
        if name in ("quality", "language"):
            assert not {r["doc_id"] for r in rows} & {10_002, 10_003, 10_004}, name
        if name == "near_duplicates":
            ids = [r["doc_id"] for r in rows if r["doc_id"] is not None]
            assert {10_002, 10_003} <= set(ids) and {i: ids.count(i) for i in ids} == {r[0]: r[1] for r in docs.where(F.col("doc_id").isin(ids)).groupBy("doc_id").count().collect()}
        if name == "secrets":
            assert len(rows) == total and all((r["text"] is None) == (r["doc_id"] == 10_002) for r in rows)


def test_packing_takes_odd_rows(spark, sf_dir):
    docs = odd_documents(spark, sf_dir)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs.where("doc_id is not null").dropDuplicates(["doc_id"]), sf_dir).collect()
    ends = {p["doc_id"]: p["doc_tokens"] for p in packed}
    assert ends[10_002] == ends[10_003] == 1 and sum(p["length"] for p in packed) == sum(ends.values())


def test_empty_documents_pass_through_all_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0, name
