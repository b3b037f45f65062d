"""Typed metadata and projects: lines that don't fit, several files, settings that take effect, results kept."""

import math
import os

import pytest

from wavemill.operators import stats
from wavemill.operators.filters import FilterSettings
from wavemill.plans import project
from wavemill.recording import RecordingError
from wavemill.sources import metadata

NOTES = """# [export]
# text_encoding=percent_utf8
# PLOT_MODE = time
# range_start=1,5
# range_end=0x10
# source_file=a%2Fb %zz+c%C3%A9
# partial_fragment=7
# [unknown]
# marker[1] label=lost, x=1, y=1, mode=time, snapped=1, channel=0
# [Graph]
# auto_y=maybe
# auto_y=Yes
# auto_y=perhaps
# marker_color=300,2,+3,9
# play_speed=-1
# frf_reference_height_fraction=9
# point_display= dist=1, X=off,number=2,bogus=1,y
# y_lock_min=
# y_lock_max=nan
# analysis_interval=1
# analysis_start=1
# analysis_end=3
# [frf_settings]
# estimator=H1
# estimator=direct
# segment_length=6
# segment_length=7
# reference_threshold=1
# display_smoothing_octaves=1
# references=1
# responses=2,3
# [filter]
# enabled=on
# mode=band-stop
# topology=Linkwitz-Riley
# low_cutoff=30
# high_cutoff=-5
# [channels]
# channel[1] name=left %5Bmm%5D, visible=1, color=1,2,3
# channel[2] name=, visible=0, color=x
# channel[0] name=none, visible=0, color=1,1,1
# channel[99] name=far, visible=0, color=1,1,1
# channel[x] name=bad
# [formulas]
# global=2*x
# Channel[2]=upper case is another word
# channel[3]=x%2B1
# [point_groups]
# point[1] x=0, y=0
# group[7] name=first%2C visible%3D0, visible=no, color=0,0,255, mode=HZ, active=1, display=x=0
# point[1] x=1.5, y=-2e3
# point[2] x=oops, y=1
# point[1] x=.5, y=4.
# group[7] name=, visible=?, color=, mode=?, active=0, display=
# [point_groups]
# point[5] x=8, y=9
# [guides]
# guide[3] kind=Horizontal, value=-0.25, mode=frf
# guide[1] kind=slanted, value=?, mode=FREQUENCY
# guide[-1] kind=vertical, value=1, mode=time
# [point_groups]
# point[1] x=3, y=3
# group[1] name=third, visible=1, color=9,9,9, mode=frf_reference, active=0, display=number=0
# [markers]
# marker[2] label=a%2Cb, x=1e2, y=?, mode=frf, snapped=yes, channel=2
# marker[1] label=, x=1, y=2, mode=Time, snapped=0, channel=?
# markers are fine
"""
ROWS = "".join(f"{k}\t{k % 3}\t{k * k}\t{-k}\n" for k in range(6))


def at(tmp_path, name, text):
    path = str(tmp_path / name)
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write(text)
    return path


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    path = at(tmp_path_factory.mktemp("notes"), "n.lvm", "﻿" + NOTES.replace("\n", "\r\n") + ROWS)
    return metadata.Tables(spark, path)


def test_settings_keep_the_last_value_that_fits(tables):
    got = {(r["section"], r["key"]): (r["text"], r["number"], r["on"]) for r in tables["settings"].collect()}
    assert got == {
        ("export", "text_encoding"): ("percent_utf8", None, None), ("export", "plot_mode"): ("time", None, None), ("export", "source_file"): ("a/b %zz+cé", None, None), ("export", "partial_fragment"): (None, None, True),
        ("graph_settings", "auto_y"): (None, None, True), ("graph_settings", "marker_color"): (None, float(255 * 65536 + 2 * 256 + 3), None), ("graph_settings", "frf_reference_height_fraction"): (None, 0.55, None),
        ("graph_settings", "point_display"): ("number,y,dx,dy,inv_dt,dist", None, None), ("graph_settings", "analysis_interval"): (None, None, True), ("graph_settings", "analysis_start"): (None, 1.0, None),
        ("graph_settings", "analysis_end"): (None, 3.0, None), ("frf_settings", "estimator"): ("direct", None, None), ("frf_settings", "segment_length"): (None, 6.0, None), ("frf_settings", "display_smoothing_octaves"): (None, 1.0, None),
        ("frf_settings", "references"): ("1", None, None), ("frf_settings", "responses"): ("2,3", None, None), ("filter_settings", "enabled"): (None, None, True), ("filter_settings", "mode"): ("band_stop", None, None),
        ("filter_settings", "topology"): ("linkwitz_riley", None, None), ("filter_settings", "low_cutoff"): (None, 30.0, None), ("filter_settings", "high_cutoff"): (None, -5.0, None),
    }


def test_channels_and_formulas(tables):
    assert rows(tables["channels"], "position", "name", "visible", "color") == [(1, "left [mm]", True, 66051), (2, None, False, None), (99, "far", False, 65793)]
    assert rows(tables["formulas"], "position", "formula") == [(0, "2*x"), (2, "upper case is another word"), (3, "x+1")]


def test_groups_own_the_points_that_follow_until_another_section(tables):
    got = rows(tables["point_groups"], "grp", "name", "visible", "color", "mode", "reference_axis", "display", "active")
    assert got == [
        (1, "first, visible=0", False, 255, "frequency", False, "number,y,dx,dy,inv_dt", True),
        (2, "", True, metadata.rgb(*metadata.GROUP_COLOR), "time", False, "number,x,y,dx,dy,inv_dt", True),
        (3, "third", True, metadata.rgb(9, 9, 9), "frf", True, "x,y,dx,dy,inv_dt", True),
    ]
    assert rows(tables["points"], "grp", "point", "x", "y") == [(1, 1, 1.5, -2000.0), (1, 2, 0.5, 4.0), (2, 1, 8.0, 9.0)]


def test_markers_and_guides(tables):
    assert rows(tables["markers"], "marker", "label", "x", "y", "mode", "snapped", "channel") == [(1, "a,b", 100.0, 0.0, "frf", True, 2), (2, "", 1.0, 2.0, "time", False, -1)]
    assert rows(tables["guides"], "guide", "vertical", "value", "mode") == [(1, False, -0.25, "frf"), (2, True, 0.0, "frequency")]


def test_text_that_is_not_encoded_and_rows_that_are_processed(spark, tmp_path):
    plain = at(tmp_path, "plain.csv", "#[markers]\n#marker[1] label=50%25, x=1, y=2, mode=time, snapped=0, channel=0\nTime,A\n0,1\n1,2\n")
    done = at(tmp_path, "done.csv", "# [formulas]\n# global=2*x\n# [filter_settings]\n# enabled=1\n# [export]\n# data_mode=applied_to_data\nTime,A\n0,1\n1,2\n")
    bare = at(tmp_path, "bare.csv", "Time,A\n0,1\n1,2\n")
    got = metadata.Tables(spark, plain, done, bare)
    assert rows(got["markers"], "recording_id", "label") == [("plain.csv", "50%25")]
    assert rows(got["formulas"], "recording_id", "formula") == [("done.csv", "x")]
    assert rows(got["settings"].where("key = 'enabled'"), "recording_id", "on") == [("done.csv", False)]
    none = metadata.Tables(spark, bare)
    assert [none[name].count() for name in none] == [0] * len(none)


def test_any_text_survives_encoding(spark):
    texts = ["", " ", "a b", "~*+-_.%41%", "é漢\U0001f600", "x, y=1", "a=b;c\"d'", "tab\tline\nend"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", metadata.encode(metadata.F.col("t")).alias("e"))
    from wavemill.sources import export

    got = df.select("t", "e", metadata.decode(metadata.F.col("e"), metadata.F.lit(True)).alias("d")).collect()
    assert all(r["d"] == r["t"] and r["e"] == export.percent_text(r["t"]) for r in got)


def test_a_project_opens_as_it_was_written(spark, tmp_path, tables):
    path = at(tmp_path, "p.lvm", NOTES + ROWS)
    opened = project.open_project(spark, path)
    assert opened.channels == ("left [mm]", "Channel_2", "Channel_3") and opened.hidden == ("Channel_2",)
    assert opened.interval() == (1.0, 3.0)
    assert opened.filter(0.001) == FilterSettings("bandstop", "linkwitz_riley", 0.0, 30.0, 0.001)
    assert rows(opened.roles(), "role", "place", "position") == [("references", 1, 1), ("responses", 1, 2), ("responses", 2, 3)]
    copy = str(tmp_path / "copy.lvm")
    kept = {name: df.withColumn("recording_id", metadata.F.lit("p.lvm")) for name, df in opened.tables.items()}
    project.write_project(opened.recording, copy, list(opened.channels), kept)
    again = project.open_project(spark, copy)
    assert again.channels == opened.channels
    key = lambda t: sorted(map(str, t.drop("recording_id").collect()))
    for name in opened.tables:
        assert key(again.tables[name]) == key(opened.tables[name]), name
    assert rows(again.recording, "channel", "sample", "t", "value") == rows(opened.recording, "channel", "sample", "t", "value")
    before = open(copy, "rb").read()
    with pytest.raises(RecordingError):
        project.write_project(opened.recording.where("false"), copy, list(opened.channels), kept)
    assert open(copy, "rb").read() == before


def test_roles_need_both_lists_and_no_channel_twice(spark):
    counts = spark.createDataFrame([(k, 3) for k in "abcdef"], "recording_id string, n_channels int")
    given = {"a": ("1,2", "3"), "b": ("1,1", "2"), "c": ("1", "1,2"), "d": ("1", "4"), "e": ("", "2"), "f": ("1", None)}
    data = [(k, "frf_settings", key, v) for k, pair in given.items() for key, v in zip(("references", "responses"), pair) if v is not None]
    got = metadata.roles(spark.createDataFrame(data, "recording_id string, section string, key string, text string"), counts)
    assert rows(got, "recording_id", "role", "place", "position") == [("a", "references", 1, 1), ("a", "references", 2, 2), ("a", "responses", 1, 3), ("e", "responses", 1, 2)]


def test_a_result_is_kept_until_something_numerical_changes(spark, tmp_path):
    text = "# [formulas]\n# global=2*x\n# [markers]\n# marker[1] label=m, x=1, y=1, mode=time, snapped=0, channel=0\nTime,A\n0,1\n1,2\n2,6\n"
    path, folder, runs = at(tmp_path, "r.csv", text), str(tmp_path / "results"), []

    def compute(long):
        runs.append(1)
        return stats.channel_stats(long)

    first = project.open_project(spark, path).result("stats", compute, folder)
    assert first.first()["max_value"] == 12.0
    count = lambda: len(os.listdir(folder))
    project.open_project(spark, path).result("stats", compute, folder)
    assert count() == 1
    stamp = os.stat(path)
    at(tmp_path, "r.csv", text.replace("label=m", "label=n"))
    os.utime(path, ns=(stamp.st_atime_ns, stamp.st_mtime_ns))
    project.open_project(spark, path).result("stats", compute, folder)
    assert count() == 1
    at(tmp_path, "r.csv", text.replace("2*x", "3*x"))
    os.utime(path, ns=(stamp.st_atime_ns, stamp.st_mtime_ns))
    changed = project.open_project(spark, path).result("stats", compute, folder)
    assert count() == 2 and math.isclose(changed.first()["max_value"], 18.0)
