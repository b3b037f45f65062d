import io

import pytest

from wavemill.operators import spectrum
from wavemill.plans.recipe import run
from wavemill.recording import RecordingError
from wavemill.sources import export
from wavemill.sources.numeric import channel_label, parse_cell, split_csv
from wavemill.sources.recording_file import read_recording, scan, scan_time_bounds


def write(path, text):
    path.write_bytes(text.encode() if isinstance(text, str) else text)
    return str(path)


def wide(df, *channels):
    rows = df.groupBy("sample", "t").pivot("channel").max("value").orderBy("sample").collect()
    return [(r["t"], *(r[c] for c in channels)) for r in rows]


@pytest.mark.parametrize("text,value,number", [("1.5", 1.5, True), ("0x1.8p+1", 3.0, True), ("nan", None, True), ("-inf", None, True), ("1e9999", None, True), ("5e-324", 5e-324, True), ("--1", None, False), ("1.2.3", None, False), ("", None, False), ("1d", None, False), ("bad", None, False)])
def test_parse_cell(text, value, number):
    assert parse_cell(text) == (value, number)


def test_labels():
    assert channel_label(" Volts [V]", 1) == ("Volts", False)
    assert channel_label("Force (N)", 1) == ("Force", False)
    assert channel_label("X_Value", 3) == ("Channel_3", True)
    assert channel_label("[V]", 2) == ("[V]", False)


def test_csv_records():
    assert split_csv('a,"b, ""c""",d') == ["a", 'b, "c"', "d"]
    assert split_csv('a,"b') is None
    with pytest.raises(ValueError):
        split_csv('a,"b"c')


def test_lvm(spark, tmp_path):
    p = write(tmp_path / "a.lvm", "LabVIEW Measurement\n***End_of_Header***\nTime\tChannel_1[V]\tChannel_2[V]\n0.0\t1\t10\n0,1\t2\t20\n0.2\t3\t30\n")
    i = scan(p)
    assert (i.header_markers, i.data_sections, i.data_rows) == (1, 1, 3)
    assert wide(read_recording(spark, p), "Channel_1", "Channel_2") == [(0.0, 1, 10), (0.1, 2, 20), (0.2, 3, 30)]


def test_missing_cells_and_junk(spark, tmp_path):
    p = write(tmp_path / "a.lvm", "Date\t2024/01/01\nTime\t10:00:00\n***End_of_Header***\nTime\tCh1\tCh2\n0\t1\t2\n1\t\t4\n2\tbad\t6\njunk line\n\t5\t6\n")
    assert wide(read_recording(spark, p), "Ch1", "Ch2") == [(0, 1, 2), (1, None, 4), (2, None, 6)]


def test_sections_move_on_by_their_date(spark, tmp_path):
    head = "Date\t2024/01/01\nTime\t10:00:{}\nX0\t0\n***End_of_Header***\n"
    p = write(tmp_path / "a.lvm", head.format("00") + "Time\tA\n0\t1\n0.1\t2\n" + head.format("05,5") + "0\t3\n0.1\t4\n")
    assert [r[0] for r in wide(read_recording(spark, p), "A")] == pytest.approx([0, 0.1, 5.5, 5.6])


def test_equal_and_backward_times(spark, tmp_path):
    p = write(tmp_path / "a.txt", "0\t1\n0.1\t2\n0.05\t3\n0.15\t4\n")
    times = [r[0] for r in wide(read_recording(spark, p), "Channel_1")]
    assert all(a < b for a, b in zip(times, times[1:])) and len(times) == 4


def test_duplicate_time_column_goes(spark, tmp_path):
    p = write(tmp_path / "a.txt", "0\t0\t5\n1\t1\t6\n2\t2\t7\n")
    assert wide(read_recording(spark, p), "Channel_1") == [(0, 5), (1, 6), (2, 7)]
    assert read_recording(spark, p, keep_duplicate_time=True).select("channel").distinct().count() == 2


def test_quoted_csv(spark, tmp_path):
    p = write(tmp_path / "a.csv", '﻿Time,"A, volts","line one\nline two"\n"0",1,2\n1,3,4\n')
    assert wide(read_recording(spark, p), "A, volts", "line one\nline two") == [(0, 1, 2), (1, 3, 4)]
    with pytest.raises(RecordingError):
        scan(write(tmp_path / "b.csv", 'Time,A\n0,"1\n'))


def test_stretches_and_window_agree(spark, tmp_path):
    rows = [(0, 1), (1, 2), (11, 3), (0, 4), (1, 5), (2, 6), (2, 7)]
    p = write(tmp_path / "a.txt", "".join(f"{t}\t{v}\n" for t, v in rows))
    whole = wide(read_recording(spark, p), "Channel_1")
    assert wide(read_recording(spark, p, checkpoint=2), "Channel_1") == whole
    lo, hi = whole[2][0], whole[5][0]
    assert wide(read_recording(spark, p, checkpoint=2, start=lo, end=hi), "Channel_1") == whole[2:6]
    assert scan_time_bounds(p) == (whole[0][0], whole[-1][0])


def test_errors(spark, tmp_path):
    with pytest.raises(RecordingError, match="frequency response"):
        scan(write(tmp_path / "a.csv", "# data_kind=frf\nf,h\n1,2\n"))
    with pytest.raises(OSError):
        scan(str(tmp_path / "none.lvm"))


def test_round_trips(spark, tmp_path):
    long = spark.createDataFrame([("r", c, i, i * 0.5, v) for i in range(5) for c, v in (("A", i * 0.1), ("B, x", None if i == 2 else -float(i)))], "recording_id string, channel string, sample long, t double, value double")
    expected = [(i * 0.5, i * 0.1, None if i == 2 else -float(i)) for i in range(5)]
    for name in ("x.csv", "x.txt"):
        p = str(tmp_path / name)
        export.write_file(long, p, ["A", "B, x"], {"export": {"source_file": "é=1", "range_start": 0.5}})
        # In tab-separated text a line that begins with Time is metadata, so names are lost.
        names = ["A", "B, x"] if name == "x.csv" else ["Channel_1", "Channel_2"]
        assert wide(read_recording(spark, p), *names) == expected
        assert export.read_metadata(scan(p).comments) == {"export": {"source_file": "é=1", "range_start": "0.5"}}
    p = str(tmp_path / "x.lvm")
    export.write_lvm(long.replace("B, x", "B", "channel"), p, ["A", "B"])
    assert wide(read_recording(spark, p), "A", "B") == expected
    with pytest.raises(RecordingError):
        export.write_file(long, p, ["A"], source=p)


def test_stored_spectrum(spark, tmp_path):
    p = write(tmp_path / "s.csv", "Frequency,A,B\n0,0,3\n1,1,8\n2,2,5\n")
    long = read_recording(spark, p)
    assert long.where("channel = 'A'").count() == 3
    assert spectrum.import_spectrum(long).where("channel = 'B' AND amp = 8 AND freq = 1").count() == 1
    bad = read_recording(spark, write(tmp_path / "t.csv", "Frequency,A\n0,0\n2,1\n1,2\n"))
    with pytest.raises(RecordingError):
        spectrum.import_spectrum(bad)


def test_command_line(spark, tmp_path):
    import math

    p = write(tmp_path / "a.csv", "Time,A,B\n" + "".join(f"{i / 1000},{math.sin(2 * math.pi * 50 * i / 1000):.17g},{i}\n" for i in range(1000)))
    out = io.StringIO()
    assert run([p, "--stats", "--fft", "--peaks", "1", "--channels", "1", "-c", str(tmp_path / "o.csv"), "--fft-csv", str(tmp_path / "f.csv")], spark, out) == 0
    fields = out.getvalue().splitlines()[-1].split("\t")
    assert fields[0] == "A" and abs(float(fields[2]) - 50) < 1 and abs(float(fields[3]) - 1) < 0.05
    assert (tmp_path / "o.csv").read_text().startswith("Time,A\n0,0\n")
    assert (tmp_path / "f.csv").read_text().splitlines()[2] == "Frequency,A"
    assert run([p, "--start", "5", "--end", "6"], spark, out) == 1
    assert run([p, "--peaks", "0"], spark, out) == 2
    assert run([p, "--channels", "3"], spark, out) == 1


def test_ranges_of_bytes_give_the_index_of_one_pass(spark, tmp_path):
    from wavemill.sources import recording_file as R

    def lines(times):
        return "".join(f"{t}\t{i}\t{'' if i % 7 else -i}\n" for i, t in enumerate(times))

    even = [i / 100 for i in range(3000)]
    files = {
        "plain.txt": "Time\tA\tB\n" + lines(even),
        "dated.lvm": "Date\t2024/05/01\t\nTime\t10:00:00\t\nX0\t5\t\n***End_of_Header***\nX_Value\tA\tB\n" + lines(even),
        "back.txt": lines(even[:2000] + even[:1000]),
        "section.lvm": "X_Value\tA\tB\n" + lines(even[:2000]) + "***End_of_Header***\n" + lines(even[:500]),
        "comma.csv": "Time,A,B\n# a note\n" + lines(even).replace("\t", ","),
        "quoted.csv": 'Time,"A, B",B\n' + lines(even[:2500]).replace("\t", ",") + '30,"4",5\n31,"6\n",7\n' + lines([40, 41]).replace("\t", ","),
        "late.txt": lines(even[:2500]) + "30\t1\t2\t3\n# end\n",
    }
    paths = []
    for name, text in files.items():
        paths.append(str(tmp_path / name))
        (tmp_path / name).write_text(text)
    for monotonic in (True, False):
        folder = str(tmp_path / f"index{monotonic}")
        assert [p.rsplit("/", 1)[1] for p in R.make_indexes(spark, paths, folder, monotonic, 100, width=4000)] == ["quoted.csv"]
        for p in paths:
            got, one = R.load_index(folder, p, monotonic, 100), R.scan(p, monotonic, 100)
            assert got.counts() == one.counts() and got.channels() == one.channels() and got.bounds == one.bounds and sorted(got.comments) == sorted(one.comments)
            key = lambda i: [(b, r, t, c.offset, c.shift, c.placed if monotonic else None, m) for b, r, t, c, m in i.places]
            name = p.rsplit("/", 1)[1]
            if name == "quoted.csv":
                assert key(got) == key(one), name
            # Ranges begin places of their own; each place is one where a pass may go on.
            rows = [(r["sample"], r["t"], r["value"]) for r in R.read_recording(spark, p, monotonic=monotonic, checkpoint=100, index=folder).where("channel = 'A' OR channel LIKE 'Channel%1' OR channel LIKE 'A%'").orderBy("sample").collect()]
            seen = []
            R.scan(p, monotonic, 100, lambda raw, t, values: seen.append((len(seen), t, values[1])))
            assert rows == seen, name
        before = R.stamp(paths[0])
        assert not R.make_indexes(spark, paths, folder, monotonic, 100, width=4000)  # nothing is missing
        assert R.stamp(paths[0]) == before


def test_files_of_one_name_are_recordings_of_their_own(spark, tmp_path):
    from wavemill.sources import recording_file as R

    for folder in "ab":
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "x.csv").write_text("Time,A\n" + "".join(f"{i},{i * i + 1}\n" for i in range(5)))
    got = R.read_recording(spark, str(tmp_path / "a" / "x.csv"), str(tmp_path / "b" / "x.csv")).groupBy("recording_id").count().collect()
    assert {(r["recording_id"], r["count"]) for r in got} == {("a/x.csv", 5), ("b/x.csv", 5)}


def test_white_space_after_a_quote_and_other_digits():
    from wavemill.sources.numeric import parse_cell, split_csv

    assert split_csv('"a" ,1') == ["a", "1"] and split_csv('"a"\t') == ["a"]
    assert parse_cell("\u0663") == (None, False)
