import os

import pytest
from pyspark.sql import functions as F

from wavemill.recording import RecordingError
from wavemill.sources.text_writer import Layout, write_ordered


def test_parts_come_in_order(spark, tmp_path):
    path = str(tmp_path / "a.csv")
    rows = spark.range(0, 5000, 1, 7).select((F.col("id") / 4).alias("t"), F.when(F.col("id") % 3 > 0, F.col("id").cast("double")).alias("v"), F.concat(F.lit('a,"'), F.col("id")).alias("s"), "id")
    write_ordered(rows.orderBy("t"), path, "# note\nt,v,s,id\n")
    want = "# note\nt,v,s,id\n" + "".join(f"{i / 4:.17g},{i if i % 3 else ''},\"a,\"\"{i}\",{i}\n" for i in range(5000))
    assert open(path).read() == want and os.listdir(tmp_path) == ["a.csv"]
    write_ordered(rows.where("id < 0").orderBy("t"), path, "empty\n")
    assert open(path).read() == "empty\n"


def test_layouts():
    assert Layout("\t", "\r\n", 3, pairs=True).line((0.12345, 1.0, None)) == "0.123\t1\t0.123\t\t\r\n"
    assert Layout("\t").line(("a\tb", None, 2)) == "a b\t\t2\n" and Layout(raw=True).line(("x\ny",)) == "x\ny"


def test_a_failed_task_leaves_the_old_file(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("old")
    bad = spark.range(0, 100, 1, 4).select(F.when(F.col("id") == 77, F.raise_error(F.lit("no"))).otherwise(F.col("id")).alias("x"))
    with pytest.raises(Exception, match="no"):
        write_ordered(bad, str(path), "new")
    assert path.read_text() == "old" and os.listdir(tmp_path) == ["a.csv"]
    with pytest.raises(RecordingError):
        write_ordered(bad, str(path), source=str(path))
