import os

import pytest

from test_recording_ranges import sections_file
from wavemill.recording import RecordingError
from wavemill.sources import recording_file as R
from wavemill.streaming.recording_stream import RecordingStreamReader, stream_recording


def run(spark, stream, folder, out, name):
    query = stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/check").option("path", out).queryName(name).trigger(processingTime="0 seconds").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def rows(df):
    return sorted(tuple(r) for r in df.select("recording_id", "channel", "sample", "t", "raw_t", "value").collect())


def test_growing_files_give_the_rows_of_the_batch_source(spark, tmp_path):
    whole = open(sections_file(tmp_path / "whole.txt", 3, sections=20, rows=60)).read()
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    grown, late = src / "a.lvm", src / "b.csv"
    cut = [len(whole) // 3, len(whole) // 3 + 7, 2 * len(whole) // 3, len(whole)]
    grown.write_text(whole[: cut[0]])
    options = {"checkpoint": 40, "max_bytes": 3000}
    run(spark, stream_recording(spark, f"{src}/*", **options), tmp_path, out, "one")
    first = rows(spark.read.parquet(out))
    assert first and {r[0] for r in first} == {"a.lvm"}
    # Another start from the checkpoint: the file has grown by less than a line, then more; a new one is there.
    grown.write_text(whole[: cut[1]])
    run(spark, stream_recording(spark, f"{src}/*", **options), tmp_path, out, "two")
    grown.write_text(whole[: cut[2]])
    late.write_text("Time,A,B\n0,1,2\n1,2,")
    run(spark, stream_recording(spark, f"{src}/*", **options), tmp_path, out, "three")
    grown.write_text(whole)
    late.write_text('Time,A,B\n0,1,2\n1,2,3\n1,"4",5\n')
    run(spark, stream_recording(spark, f"{src}/*", **options), tmp_path, out, "four")
    assert rows(spark.read.parquet(out)) == rows(R.read_recording(spark, str(grown), str(late)))


def test_offsets_alone_carry_the_state(tmp_path):
    p = sections_file(tmp_path / "a.lvm", 5, sections=8, rows=40)
    text = open(p).read()
    whole = [r for s in R.RecordingReader({"path": p}).partitions() for b in R.read_stretch(s) for r in b.to_pylist()]
    got, at = [], RecordingStreamReader({"path": p}).initialOffset()
    for end in range(0, len(text) + 1, 701):
        open(p, "w").write(text[:end] if end + 701 <= len(text) else text)
        reader = RecordingStreamReader({"path": p})  # a new one each time, as after a restart
        reader.seen = at
        to = reader.latestOffset()
        again = RecordingStreamReader({"path": p, "checkpoint": "9"})
        got += [r for s in again.partitions(at, to) for b in again.read(s) for r in b.to_pylist()]
        at = to
    key = lambda r: (r["sample"], r["channel"])
    # B has no value in the first micro-batch, which settles the channels.
    assert sorted(got, key=key) == sorted((r for r in whole if r["channel"] == "A"), key=key) and {r["channel"] for r in whole} == {"A", "B"}


def test_half_lines_open_quotes_and_shrinking(tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('Time,A\n0,1\n1,"2')
    reader = RecordingStreamReader({"path": str(p)})
    one = reader.latestOffset()
    assert one["files"][str(p)]["rows"] == 1 and reader.latestOffset() == one and reader.partitions(one, one) == []
    p.write_text('Time,A\n0,1\n1,"2\n"\n2,3\n')
    two = reader.latestOffset()
    assert two["files"][str(p)]["rows"] == 3 and [s.rows for s in reader.partitions(one, two)] == [2]
    reader.commit(two)
    assert not reader.plans
    p.write_text("Time,A\n")
    with pytest.raises(RecordingError, match="SourceChanged"):
        reader.latestOffset()
    assert RecordingStreamReader({"path": str(tmp_path / "none.csv")}).latestOffset() == {"files": {}}


def test_a_line_longer_than_a_micro_batch(tmp_path):
    p = tmp_path / "a.txt"
    p.write_text("x\tA\n0\t" + "1" * 5 + "\n1\t" + "0" * 500 + "2\n2\t3\n")
    reader, rows_, at = RecordingStreamReader({"path": str(p), "max_bytes": "20"}), [], {"files": {}}
    while (to := reader.latestOffset()) != at:
        rows_ += [r["value"] for s in reader.partitions(at, to) for b in reader.read(s) for r in b.to_pylist()]
        at = to
    assert rows_ == [11111.0, 2.0, 3.0] and os.path.getsize(p) == at["files"][str(p)]["byte"]
