import math
import random

import pytest

from wavemill.sources import recording_file as R


def sections_file(path, seed=0, sections=60, rows=80):
    """A file of dated and undated sections, headers of many lines, times that repeat and run back."""
    rng = random.Random(seed)
    out, clock = ["LabVIEW Measurement\t\n"], 0
    for k in range(sections):
        clock += rng.randrange(0, 90)
        if rng.random() < 0.8:
            out.append(f"Date\t2024/05/{1 + clock // 86400:02d}\t\n")
        if rng.random() < 0.9:
            out.append(f"Time\t{10 + clock // 3600:02d}:{clock // 60 % 60:02d}:{clock % 60:02d},25\t\n")
        out.append(f"Operator\t{'x' * rng.randrange(0, 300)}\t\n")
        if rng.random() < 0.8:
            out.append(f"X0\t{rng.choice(['0', '1,5', '-2'])}\t\n")
        out.append("***End_of_Header***\n" if k or rng.random() < 1 else "")
        out.append("X_Value\tA\tB\tComment\n" if not k else "# part\n" if rng.random() < 0.3 else "")
        t = rng.uniform(-3, 3)
        for i in range(rng.randrange(0, rows) if k else rows):
            t += rng.choice([0.1, 0.1, 0.1, 0.25, 0.0, -0.4]) if rng.random() < 0.1 else 0.1
            out.append(f"{t!r}\t{rng.random()!r}\t{rng.choice(['', 'bad', '7'])}\n")
    path.write_text("".join(out))
    return str(path)


@pytest.mark.parametrize("monotonic", [True, False])
def test_sections_are_indexed_by_ranges(spark, tmp_path, monotonic):
    paths = [sections_file(tmp_path / f"s{seed}.lvm", seed) for seed in range(6)]
    folder = str(tmp_path / "index")
    assert R.make_indexes(spark, paths, folder, monotonic, 50, width=3000) == []
    for p in paths:
        got, one, clocks = R.load_index(folder, p, monotonic, 50), R.scan(p, monotonic, 50), {}
        assert got.counts() == one.counts() and got.channels() == one.channels() and got.bounds == one.bounds and got.comments == one.comments
        assert (got.clock, got.pending, got.section_open, got.end) == (one.clock, one.pending, one.section_open, one.end)
        R.scan(p, monotonic, 1, lambda *_: None)
        fine = {row: (byte, t, clock, m) for byte, row, t, clock, m in R.scan(p, monotonic, 1).places}
        clocks = {row: (byte, t, clock, m) for byte, row, t, clock, m in got.places}
        assert len(clocks) > 10 and all(fine[row] == place for row, place in clocks.items())


def test_effects_compose_to_the_state_of_one_pass(tmp_path):
    p = sections_file(tmp_path / "s.lvm", 9)
    size = R.stamp(p)[0]
    for width in (37, 500, 4096):
        state, cuts = {"anchor": None, "shift": None, "pending": {}}, [0, *range(width, size, width), size]
        for a, b in zip(cuts[:-1], cuts[1:]):
            state = R.after_range(state, R.section_effect(p, max(a, 1), b))
            one = R.scan(p, False, until=b)
            assert state == {"anchor": one.clock.anchor, "shift": one.clock.shift, "pending": one.pending}, (width, b)


def test_times_that_hardly_increase_are_read_through(spark, tmp_path):
    p = tmp_path / "a.txt"
    p.write_text("x\tA\n" + "".join(f"{1e9 + i * 2.0**-23!r}\t1\n" for i in range(500)))
    assert R.make_indexes(spark, [str(p)], str(tmp_path / "i"), True, 100, width=2000) == [str(p)]


def test_filters_choose_stretches_and_cells(spark, tmp_path, monkeypatch):
    p = tmp_path / "a.csv"
    p.write_text("Time,A,B,C\n" + "".join(f"{i / 10},{i},{-i},{i * i}\n" for i in range(1000)))
    other = tmp_path / "b.csv"
    other.write_text("Time,A,B,C\n" + "".join(f"{i / 10},{i},{-i},{i * i}\n" for i in range(50)))
    long = R.read_recording(spark, str(p), str(other), checkpoint=100)
    assert long.rdd.getNumPartitions() == 11

    def chosen(where):
        return R.read_where(spark, where, str(p), str(other), checkpoint=100)

    def rows(where):
        return sorted(tuple(r) for r in chosen(where).select("recording_id", "channel", "sample", "t", "value").collect())

    everything = [(f"{n}.csv", c, i, i / 10, float(v)) for n, m in (("a", 1000), ("b", 50)) for i in range(m) for c, v in (("A", i), ("B", -i), ("C", i * i))]
    cases = {
        "t BETWEEN 20 AND 25.5": (1, lambda r: 20 <= r[3] <= 25.5),
        "t > 20 AND t < 30 AND channel = 'B'": (2, lambda r: 20 < r[3] < 30 and r[1] == "B"),
        "channel IN ('A', 'C') AND sample >= 990": (1, lambda r: r[1] != "B" and r[2] >= 990),
        "sample < 10 AND recording_id = 'a.csv'": (1, lambda r: r[2] < 10 and r[0] == "a.csv"),
        "t = 1.5 AND value > 0": (2, lambda r: r[3] == 1.5 and r[4] > 0),
        "t > 30 AND t < 20": (0, lambda r: False),
        "channel = 'nope'": (0, lambda r: False),
        "sample = 7 OR channel = 'B' AND t IS NOT NULL": (11, lambda r: r[2] == 7 or r[1] == "B"),
    }
    for where, (parts, keep) in cases.items():
        assert rows(where) == sorted(filter(keep, everything)), where
        assert chosen(where).rdd.getNumPartitions() in (parts, parts + (parts == 0)), where
    # Several conditions in one plan, and one result used in several ways.
    a, b = chosen("channel = 'A' AND t < 3"), chosen("channel = 'B' AND t >= 2")
    pairs = a.where("recording_id = 'a.csv'").alias("x").join(b.alias("y"), ["recording_id", "sample"]).select("sample", "x.value", "y.value")
    assert sorted(map(tuple, pairs.collect())) == [(i, float(i), float(-i)) for i in range(20, 30)]
    assert a.where("sample < 5").join(a.where("sample >= 3"), ["recording_id", "channel", "sample"]).count() == 4 and a.count() == 60
    plan = chosen("t BETWEEN 20 AND 25.5")._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan and "BatchScan" in plan

    parsed, parse = [], R.parse_cell
    monkeypatch.setattr(R, "parse_cell", lambda text: parsed.append(text) or parse(text))
    reader = R.RecordingReader({"path": str(p), "channels": "3"})
    part = reader.partitions()[0]
    parsed.clear()
    (batch,) = R.read_stretch(part)
    assert batch.column("value").to_pylist() == [float(i * i) for i in range(1000)] and 2000 <= len(parsed) <= 2010


def test_rows_are_admitted_by_any_two_numbers(tmp_path):
    p = tmp_path / "a.txt"
    p.write_text("x\tA\tB\tC\n0\t\t\t5\n1\tbad\t\t\n2\t\t6\t\n3\t4\tbad\tbad\n")
    for wanted in (None, [1], [2], [3], []):
        seen = []
        R.scan(str(p), on_row=lambda raw, t, values: seen.append(raw), wanted=wanted)
        assert seen == [0.0, 2.0, 3.0]


def test_bounds_take_over_only_what_they_can():
    b = R.Bounds()
    assert b.push(R.GreaterThan(("t",), 1)) and b.lo == math.nextafter(1.0, math.inf)
    assert not b.push(R.GreaterThan(("value",), 1)) and not b.push(R.LessThan(("t", "x"), 1)) and not b.push(R.EqualTo(("t",), math.nan))
    assert b.push(R.In(("channel",), ("a", "b"))) and b.push(R.EqualTo(("channel",), "b")) and b.channels == {"b"}
    assert b.push(R.LessThan(("sample",), 5)) and b.last == 4 and b.push(R.EqualTo(("t",), 3.0)) and (b.lo, b.hi) == (3.0, 3.0)


def test_an_index_holds_no_comments_however_many_lead_the_rows(spark, tmp_path):
    notes = [f"marker[{k}] label=a, x={k}, y=1, mode=time, snapped=0, channel=0" for k in range(2000)]
    (tmp_path / "a.lvm").write_text("﻿" + "".join(f"# {n}\n" for n in notes) + "\n" + "X_Value\tA\n" + "".join(f"{i}\t{-i}\n" for i in range(300)), encoding="utf-8")
    (tmp_path / "f.csv").write_text("# plot_mode=frequency\n" + "".join(f"# {n}\n" for n in notes) + "x,A\n" + "".join(f"{i},{-i}\n" for i in range(300)))
    (tmp_path / "late.csv").write_text("Time,A\n" + "".join(f"{i},{-i}\n" for i in range(300)) + "".join(f"# {n}\n" for n in notes))
    for name, checkpoint, rest in (("a.lvm", 500, []), ("a.lvm", 100, []), ("f.csv", 500, []), ("late.csv", 100, [])):
        p, folder = str(tmp_path / name), str(tmp_path / f"i{checkpoint}{name}")
        assert R.make_indexes(spark, [p], folder, True, checkpoint, width=4000) == rest
        got, one = R.load_index(folder, p, True, checkpoint), R.scan(p, True, checkpoint)
        assert (got.counts(), got.labels, got.frequency_axis, got.bounds, got.end) == (one.counts(), one.labels, one.frequency_axis, one.bounds, one.end)
        assert got.comments == (["plot_mode=frequency"] if name == "f.csv" else []) + notes
        assert len(R.to_json(got)) < 20_000
        values = R.read_recording(spark, p, checkpoint=checkpoint, index=folder).orderBy("sample").select("value").collect()
        assert [abs(r[0]) for r in values] == [float(i) for i in range(300)]


def test_neighbouring_stretches_of_many_places_are_one_part(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text("Time,A\n" + "".join(f"{i % 50},{-i}\n" for i in range(20_000)))
    long = R.read_recording(spark, str(p), monotonic=False, checkpoint=10)
    assert long.rdd.getNumPartitions() <= 70
    assert [(r["sample"], r["raw_t"], r["value"]) for r in long.orderBy("sample").collect()] == [(i, float(i % 50), -float(i)) for i in range(20_000)]
    reader = R.FilteringReader({"path": str(p), "checkpoint": "10"})
    list(reader.pushFilters([R.GreaterThanOrEqual(("sample",), 15), R.LessThan(("sample",), 35)]))
    assert [(s.first_row, s.rows) for s in reader.partitions()] == [(10, 30)]
