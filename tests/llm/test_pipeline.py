import os
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from wavemill.llm import mixing, secret_scan

SF = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
def test_stages_do_the_work_of_their_operators(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / f"{i}"))
        docs = spark.read.parquet(str(tmp_path / f"{i}"))
        if name != "packing":
            assert docs.columns == columns
        if name == "simhash_near_dedup":
            assert docs.count() < before.count()
        if name == "secret_scan":
            assert docs.count() == before.count()
            assert secret_scan.scan_secrets(docs).where("n_access > 0 OR n_structural > 0").count() == 0
        if name == "mixing":
            size = mixing.word_count(F.col("text"))
            assert abs(docs.agg(F.sum(size)).first()[0] / before.agg(F.sum(size)).first()[0] - 1) < 0.05
    assert docs.count() > 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_near_dedup", "secret_scan", "mixing", "packing"]


ENGLISH = "the quick brown fox jumps over the lazy dog and then it runs away from the old man who lives here"
FRENCH = "le renard brun saute par dessus le chien paresseux et puis il court loin de la maison du vieil homme"


@pytest.fixture
def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows, and columns with the
    names that stages use inside."""
    def words(i):
        w = (ENGLISH if i % 2 else FRENCH).split()
        random.Random(i).shuffle(w)
        return " ".join(w)

    rows = [(i, words(i), "en" if i % 2 else "fr", f"s{i % 3}") for i in range(60)]
    rows += [(100, ENGLISH + " token = abcdef0123456789", "en", "s1")] * 3 + [(None, ENGLISH + " no id", "en", None), (101, None, "en", "s0"), (102, "", None, "s0"), (103, " \n\t", "fr", None)]
    rows += [(104, (ENGLISH + " ") * 5000, "en", "s2"), (None, None, None, None), (105, ENGLISH + " unlabelled", None, "s1")]
    full = [(i, t, lang, s, None if t is None else len(t), 1, "x", i, 2.0, None, "y", "z") for i, t, lang, s in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, doc int, hash string, c0 long, copies double, mark string, id string, `__id` string")


def test_stages_on_odd_tables(spark, odd):
    kept = STAGES["language_id"](spark, odd, "").cache()
    assert kept.columns == odd.columns and 40 < kept.count() < odd.count()
    assert kept.where("text IS NULL OR trim(text) = ''").count() == 0
    deduped = STAGES["simhash_near_dedup"](spark, odd, "").cache()
    assert deduped.columns == odd.columns and deduped.where("doc_id = 100").count() == 1 and deduped.where("doc_id = 104").count() == 1
    assert [r["doc_id"] for r in deduped.where("text IS NULL OR text RLIKE '^\\\\s*$'").collect()] == [101]
    clean = STAGES["secret_scan"](spark, odd, "").cache()
    assert clean.columns == odd.columns and clean.count() == odd.count()
    assert {r["text"][-8:] for r in clean.where("doc_id = 100").collect()} == {"<assign>"} and clean.where("n_chars <> length(text)").count() == 0
    assert "n_chars" not in STAGES["secret_scan"](spark, odd.drop("n_chars"), "").columns
    mixed = STAGES["mixing"](spark, odd, "").cache()
    assert mixed.columns == odd.columns
    assert mixed.agg(F.sum(mixing.word_count(F.col("text")))).first()[0] == mixing.mix_sources(odd).agg(F.sum("taken")).first()[0]
    packed = STAGES["packing"](spark, odd, "")
    assert packed.where("start = 0").count() == odd.count()


def test_stages_on_an_empty_table(spark, odd):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.limit(0), "").count() == 0, name
