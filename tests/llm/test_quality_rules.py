import os
import re

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wavemill.llm import queries, quality_rules
from wavemill.llm.common import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PROSE = "The quick brown fox jumps over the lazy dog while nobody looks at number {}."
CASES = {
    "": None,
    " \t ": None,
    "A sentence.": None,
    "He said “no.”  ": None,
    "a heading without an end": "punctuation",
    "THE!! END!! IS!! NEAR!!": "punctuation",
    "to### be&&& or*** not.": "punctuation",
    "It costs 5 $ & 6 $ in all of the shops that we went to.": None,
    "Home | News | Sport | About.": "navigation",
    "Read more": "navigation",
    "Sign in.": "navigation",
    "All rights reserved.": "boilerplate",
    "Licensed under CC BY-NC 4.0.": "boilerplate",
    "We read about a cookie policy " + "and more words follow it here " * 8 + "on.": None,
}


def brute(text):
    words = WORD.findall(text or "")
    full = [x for x in (text or "").split("\n") if WORD.search(x)]
    at = {}
    for i in range(len(words) - 2):
        at.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {j for places in at.values() if len(places) > 1 for i in places for j in (i, i + 1, i + 2)}
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(full) - len(set(full)), len(covered), failed


def test_lines_fail_by_rule(spark):
    got = spark.createDataFrame([(x,) for x in CASES], "x string").select("x", quality_rules.failing_rule(quality_rules.line_facts(quality_rules.F.col("x"))).alias("r")).collect()
    assert {r["x"]: r["r"] for r in got} == CASES


def test_documents(spark, docs):
    good = "\n".join(PROSE.format(i) for i in range(8))
    rows = [
        (1, good, "en", "a"), (2, None, "en", "a"), (3, "", None, None), (4, good.replace(".", ""), "en", "a"),
        (5, good + "\nAll rights reserved.\nHome | News | Sport | About\n", "en", "a"), (6, "word " * 100000 + "end.", "en", "a"),
        (6, "x y z", "en", "a"), (None, good, "en", "a"), (7, "\n".join([good] * 2), "en", "a"), (8, "a b c a b c a", "en", "a"), (9, "a a a a", "en", "a"),
        (10, " ".join(f"w{i}" for i in range(300_000)) + " w0 w1 w2.", "en", "a"),
    ]
    varied = " ".join(f"v{i}" for i in range(60)) + "."
    rows.append((11, varied, "en", "a"))
    rows.append((12, varied + "\n" + " ".join(f"u{i}" for i in range(40)), "en", "a"))
    rows.append((13, varied + "\n" + " ".join(f"u{i}" for i in range(80)), "en", "a"))
    got = quality_rules.clean_lines(docs(rows)).collect()
    assert len(got) == len(rows)
    found = [(r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in got]
    assert sorted(found, key=str) == sorted(((i, *brute(text)) for i, text, *_ in rows), key=str)
    by = {r["doc_id"]: r for r in got}
    assert by[11]["kept"] and by[12]["kept"] and not by[13]["kept"] and not by[13]["base_failed"] and by[13]["text"] == varied
    assert by[12]["n_failed_lines"] == 1 and by[12]["lost_chars"] == sum(len(f"u{i}") for i in range(40)) and by[12]["text"] == varied
    assert not by[1]["kept"] and by[5]["n_failed_lines"] == 2 and by[5]["text"] == good + "\n"
    assert not by[2]["kept"] and by[2]["text"] == ""
    assert quality_rules.clean_lines(docs([])).count() == 0


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="ab.\n \t#|\x0b", max_size=60), max_size=8))
def test_counts_equal_brute_force(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality_rules.clean_lines(df).collect():
        assert tuple(r)[1:7] == brute(texts[r["doc_id"]])


def test_no_python_and_no_shuffle(spark, docs):
    plan = quality_rules.clean_lines(docs([(1, "x", "en", "a")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="the driver's tables are not here")
def test_clean_documents_stay_and_junk_goes(spark):
    sf = "/root/testdata/sf0.01"
    out = queries.op13_line_first_cleaning(spark, sf)
    judged = out.where("n_words >= 50").join(table(spark, sf, "labels"), "doc_id").groupBy("quality").agg(quality_rules.F.avg(quality_rules.F.col("kept").cast("int")).alias("k"))
    share = {r["quality"]: r["k"] for r in judged.collect()}
    assert share[1] >= 0.97 and share[0] <= 0.02


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the driver's tables are not here")
def test_equals_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    rows = con.execute(quality_rules.ORACLE_SQL)
    names = [d[0] for d in rows.description]
    df = queries.op13_line_first_cleaning(spark, sf)
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*names).collect())) == sorted(rows.fetchall())
