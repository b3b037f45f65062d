"""The metadata that recording files carry in their comments, as typed tables.

A comment line begins with ``#``; ``[name]`` begins a section, which ends where the next one begins,
and the lines within are ``key=value`` or numbered entries (``marker[1] label=..., x=..., ...``).
Everything is found for any number of files at once: sections, groups and the numbers of points
are running sums over a file's comments, and entries become columns by Spark's own functions.

Lines that don't fit are passed over, as are unknown sections and keys.  Of a key that is given more than once the last
value that fits holds; marker, guide, group and point entries are kept in the order of the file and
numbered anew from 1, whatever number they bear.  Text is percent-decoded where the file says that
it is encoded (a ``%`` without two hexadecimal digits stays as it is).  Numbers are finite decimal ones.
A quoted CSV field that goes on in a line with ``#`` in front reads as a comment here.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavemill.operators.blocks import running_sum
from wavemill.recording import RecordingError
from wavemill.scratch import settle
from wavemill.sources.recording_file import recording_ids

KEYS = ("recording_id",)
BLANKS = " \t\r\n\f\v"

# Names of sections and the short forms that are read, too.
SECTIONS = ("export", "graph_settings", "frf_settings", "workspace", "filter_settings", "channels", "formulas", "point_groups", "markers", "guides")
SHORT = {"graph": "graph_settings", "filter": "filter_settings"}

# Keys of settings by section and kind.
SETTINGS: dict[str, dict[str, tuple[str, ...]]] = {
    "export": {
        "text": ("schema_version", "document_kind", "text_encoding", "application_version", "exported_utc", "range_mode", "range_source", "data_mode", "plot_mode"),
        "encoded": ("source_file",),
        "number": ("range_start", "range_end"),
        "flag": ("partial_fragment",),
    },
    "graph_settings": {
        "encoded": ("axis_x_label", "axis_y_label", "time_axis_y_label", "fft_axis_x_label", "fft_axis_y_label", "frf_axis_x_label", "frf_axis_y_label"),
        "color": ("marker_color",),
        "flag": (
            "smoothing", "distinguish_curves", "show_channel_legend", "show_marker_values", "analysis_interval", "vertical_pan", "snap_to_data", "stitch_time_gaps",
            "auto_y", "auto_y_amp", "frf_apply_processing", "frf_auto_y", "frf_logarithmic_frequency_axis", "frf_show_reference_amplitude", "frf_reference_auto_y",
        ),
        "number": (
            "analysis_start", "analysis_end", "y_lock_min", "y_lock_max", "y_amp_max", "frf_y_min", "frf_y_max", "frf_frequency_start", "frf_frequency_end",
            "frf_reference_y_min", "frf_reference_y_max",
        ),
        "positive": ("play_speed",),
        "height": ("frf_reference_height_fraction",),
        "display": ("point_display",),
    },
    "frf_settings": {
        "estimator": ("estimator",),
        "length": ("segment_length",),
        "flag": ("remove_mean",),
        "open_fraction": ("reference_threshold",),
        "fraction": ("display_smoothing_octaves",),
        "text": ("window", "references", "responses"),
    },
    "workspace": {"text": ("mode",), "number": ("time_start", "time_end", "fft_start", "fft_end", "playhead"), "flag": ("annotations_locked", "playhead_active")},
    "filter_settings": {"flag": ("enabled",), "filter_mode": ("mode",), "topology": ("topology",), "number": ("low_cutoff", "high_cutoff")},
}

# What a point's label can show, and whether it does where nothing is said.
DISPLAY = {"number": True, "x": True, "y": True, "dx": True, "dy": True, "inv_dt": True, "dist": False}
FILTER_MODES = ("low_pass", "high_pass", "band_pass", "band_stop")
TOPOLOGIES = ("butterworth", "bessel", "chebyshev", "linkwitz_riley")
HEIGHT = (0.12, 0.55)  # bounds of the lower plot's share
GROUP_COLOR = (0, 120, 215)


# Cells -------------------------------------------------------------------------------------


def trim(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def whole(c: Column) -> Column:
    """A whole number of 32 bits, or null."""
    return F.when(trim(c).rlike(r"^[+-]?[0-9]+$"), trim(c).try_cast("int"))


def real(c: Column) -> Column:
    """A finite number, or null."""
    v = F.when(trim(c).rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), trim(c).try_cast("double"))
    return F.when(F.abs(v) < float("inf"), v)


def flag(c: Column) -> Column:
    word = F.lower(trim(c))
    return F.when(word.isin("1", "true", "yes", "on"), True).when(word.isin("0", "false", "no", "off"), False).otherwise(whole(word) != 0)


def color(c: Column) -> Column:
    """red * 65536 + green * 256 + blue of three numbers, each at most 255, or null."""
    parts = [F.regexp_extract(c, r"^\s*\+?([0-9]{1,9})[0-9]*,\s*\+?([0-9]{1,9})[0-9]*,\s*\+?([0-9]{1,9})", k).try_cast("int") for k in (1, 2, 3)]
    return sum((F.when(p > 255, 255).otherwise(p) * w for p, w in zip(parts, (65536, 256, 1))), F.lit(0))


def color_text(c: Column) -> Column:
    n = c.cast("long")
    return F.when(n.isNotNull(), F.format_string("%d,%d,%d", F.floor(n / 65536), F.floor(n / 256) % 256, n % 256))


def rgb(red: int, green: int, blue: int) -> int:
    return red * 65536 + green * 256 + blue


def encode(c: Column) -> Column:
    """UTF-8 bytes other than letters, digits, blank, _, - and . as % and two digits."""
    plain = F.url_encode(c)
    for mark, code in (("+", " "), ("*", "%2A")):
        plain = F.replace(plain, F.lit(mark), F.lit(code))
    return plain


def decode(c: Column, encoded: Column) -> Column:
    safe = F.replace(F.regexp_replace(c, "%(?![0-9A-Fa-f]{2})", "%25"), F.lit("+"), F.lit("%2B"))
    return F.when(encoded, F.coalesce(F.try_url_decode(safe), c)).otherwise(c)


def shown(c: Column) -> Column:
    """The parts that a point's label shows, in a fixed order, by commas; null if nothing is said."""
    said = F.transform(F.split(c, ","), lambda p: F.struct(F.lower(trim(F.substring_index(p, "=", 1))).alias("key"), F.when(F.contains(p, F.lit("=")), flag(p.substr(F.instr(p, "=") + 1, F.length(p)))).alias("on")))
    said = F.filter(said, lambda s: s["on"].isNotNull())
    last = lambda key: F.try_element_at(F.filter(said, lambda s: s["key"] == key), F.lit(-1))["on"]
    names = [F.when(F.coalesce(last(key), F.lit(default)), key) for key, default in DISPLAY.items()]
    return F.when(F.size(said) > 0, F.concat_ws(",", *names))


def display_text(c: Column) -> Column:
    return F.concat_ws(",", *(F.concat(F.lit(f"{key}="), F.array_contains(F.split(c, ","), key).cast("int")) for key in DISPLAY))


def between(text: Column, prefix: str, suffix: str | None = None) -> Column:
    """What stands after the first ``prefix``, up to the next ``suffix`` or the end; '' without the prefix."""
    at = F.instr(text, prefix)
    rest = text.substr(at + len(prefix), F.length(text))
    return trim(F.when(at > 0, F.substring_index(rest, suffix, 1) if suffix else rest).otherwise(""))


def numbered(text: Column, word: str) -> tuple[Column, Column]:
    """(number from 1 or null, what follows) of ``word[number] ...``."""
    pattern = rf"(?s)^{word}[^\[]*\[([^\]]+)\](.*)$"
    number = whole(F.regexp_extract(text, pattern, 1))
    return F.when(number > 0, number), trim(F.regexp_extract(text, pattern, 2))


# Lines -------------------------------------------------------------------------------------


def comments(spark, *paths: str) -> DataFrame:
    """(recording_id, line, text) of all comment lines of files; ``line`` grows along a file."""
    parts = []
    for path, name in recording_ids([p.removeprefix("file://") for p in paths]).items():
        raw = spark.read.option("lineSep", "\n").text(path).select(F.regexp_replace("value", r"^\x{FEFF}", "").alias("text"), F.col("_metadata.file_block_start").alias("start"))
        raw = raw.where(F.startswith("text", F.lit("#"))).withColumn("id", F.monotonically_increasing_id())
        parts.append(raw.select(F.lit(name).alias("recording_id"), "start", "id", trim(F.substring("text", 2, 1 << 30)).alias("text")))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    rows = settle(rows.where("text <> ''"))
    first = rows.groupBy("recording_id", "start").agg(F.min("id").alias("first"))
    return rows.join(first, ["recording_id", "start"]).select("recording_id", (F.col("start") + F.col("id") - F.col("first")).alias("line"), "text")


def sectioned(lines: DataFrame) -> DataFrame:
    """(recording_id, line, section, text, breaks, encoded, spectrum, processed): the lines within known sections;
    ``breaks`` counts headers of other sections than [point_groups] so far; the last three are
    facts of the file: text is encoded, the rows are a spectrum, formulas and filter have been applied."""
    head = F.col("text").rlike(r"(?s)^\[.*\]$")
    inner = trim(F.expr("substring(text, 2, length(text) - 2)"))
    name = F.lower(inner)
    for short, long in SHORT.items():
        name = F.when(name == short, long).otherwise(name)
    rows = lines.withColumn("name", F.when(head, name))
    rows = settle(running_sum(rows, {"sid": head.cast("long"), "breaks": (head & (F.col("name") != "point_groups")).cast("long")}, KEYS, order="line"))
    heads = rows.where(F.col("name").isin(*SECTIONS)).select("recording_id", "sid", F.col("name").alias("section"))
    said = lambda text: F.coalesce(F.max(F.col("text") == text), F.lit(False))
    facts = rows.groupBy(*KEYS).agg(said("text_encoding=percent_utf8").alias("encoded"), said("plot_mode=frequency").alias("spectrum"), said("data_mode=applied_to_data").alias("processed"))
    within = rows.where(F.col("name").isNull()).join(heads, ["recording_id", "sid"]).join(facts, "recording_id")
    return settle(within.select("recording_id", "line", "section", "text", "breaks", "encoded", "spectrum", (F.col("processed") | F.col("spectrum")).alias("processed")))


def _pairs(lines: DataFrame) -> DataFrame:
    at = F.instr("text", "=")
    rows = lines.where(at > 0)
    return rows.withColumn("key", F.lower(trim(F.col("text").substr(F.lit(1), at - 1)))).withColumn("raw", trim(F.col("text").substr(at + 1, F.length("text"))))


def _last(c: Column) -> Column:
    """The last value of a key that fits."""
    return F.max_by(c, F.when(c.isNotNull(), F.col("line")))


# Tables ------------------------------------------------------------------------------------


def settings(lines: DataFrame) -> DataFrame:
    """(recording_id, section, key, text, number, on): one row a key with a value that fits, in the column of its
    kind.  A filter that has been applied already is not on."""
    rows = _pairs(lines)

    def kind(name: str) -> Column:
        return F.coalesce(*(F.when((F.col("section") == s) & F.col("key").isin(*kinds[name]), True) for s, kinds in SETTINGS.items() if name in kinds), F.lit(False))

    raw, low = F.col("raw"), F.lower("raw")
    dashed = F.replace(low, F.lit("-"), F.lit("_"))
    mode = F.when(dashed == "bandpass", "band_pass").when(dashed == "bandstop", "band_stop").otherwise(dashed)
    v, n = real(raw), whole(raw)
    text = F.when(kind("text"), raw).when(kind("encoded"), decode(raw, F.col("encoded"))).when(kind("estimator") & raw.isin("h1", "direct"), raw).when(kind("filter_mode") & mode.isin(*FILTER_MODES), mode)
    text = text.when(kind("topology") & dashed.isin(*TOPOLOGIES), dashed).when(kind("display"), shown(raw))
    number = F.when(kind("number"), v).when(kind("positive") & (v > 0), v).when(kind("height"), F.greatest(F.lit(HEIGHT[0]), F.least(F.lit(HEIGHT[1]), v)))
    number = number.when(kind("open_fraction") & (v > 0) & (v < 1), v).when(kind("fraction") & v.between(0, 1), v).when(kind("color"), color(raw).cast("double"))
    number = number.when(kind("length") & ((n == 0) | (n.between(4, 100_000_000) & (n % 2 == 0))), n.cast("double"))
    on = F.when((F.col("section") == "filter_settings") & (F.col("key") == "enabled") & F.col("processed"), False).when(kind("flag"), flag(raw))
    rows = rows.select(*KEYS, "line", "section", "key", text.alias("text"), number.alias("number"), on.alias("on")).where("text IS NOT NULL OR number IS NOT NULL OR on IS NOT NULL")
    return rows.groupBy(*KEYS, "section", "key").agg(*(_last(F.col(c)).alias(c) for c in ("text", "number", "on")))


def channels(lines: DataFrame) -> DataFrame:
    """(recording_id, position from 1, name, visible, color); what is not given is null."""
    number, tail = numbered(F.col("text"), "channel")
    rows = lines.where("section = 'channels'").withColumn("position", number).withColumn("tail", tail).where("position IS NOT NULL")
    tail = F.col("tail")
    name = between(tail, "name=", ", visible=")
    rows = rows.withColumn("name", F.when(name != "", decode(name, F.col("encoded")))).withColumn("visible", flag(between(tail, "visible=", ", color="))).withColumn("color", color(between(tail, "color=")))
    return rows.groupBy(*KEYS, "position").agg(*(_last(F.col(c)).alias(c) for c in ("name", "visible", "color")))


def formulas(lines: DataFrame) -> DataFrame:
    """(recording_id, position, formula): position 0 for the formula of all channels.  Where the rows have
    gone through them already every formula is ``x``."""
    number, _ = numbered(F.col("key"), "channel")
    rows = _pairs(lines.where("section = 'formulas'")).withColumn("position", F.when(F.col("key") == "global", 0).otherwise(number)).where("position IS NOT NULL")
    text = F.when(F.col("processed"), "x").otherwise(decode(F.col("raw"), F.col("encoded")))
    return rows.withColumn("formula", text).groupBy(*KEYS, "position").agg(_last(F.col("formula")).alias("formula"))


def point_groups(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups (recording_id, grp from 1, name, visible, color, mode, reference_axis, display, active) and their points
    (recording_id, grp, point from 1, x, y).

    A group's points follow it, until a section of another name begins.  Of the groups of a
    mode the last one marked active is active, or else the last one."""
    rows = lines.where("section = 'point_groups'")
    number, tail = numbered(F.col("text"), "group")
    rows = rows.withColumn("is_group", number.isNotNull()).withColumn("tail", tail)
    number, tail = numbered(F.col("text"), "point")
    x, y = real(between(tail, "x=", ", y=")), real(between(tail, "y="))
    rows = rows.withColumn("x", F.when(number.isNotNull() & ~F.col("is_group"), x)).withColumn("y", y).withColumn("is_point", F.col("x").isNotNull() & F.col("y").isNotNull())
    rows = settle(running_sum(rows, {"grp": F.col("is_group").cast("long"), "placed": F.col("is_point").cast("long")}, KEYS, order="line"))
    heads = rows.where("is_group")
    tail, word = F.col("tail"), F.lower(between(F.col("tail"), "mode=", ", active="))
    mode = F.when(word.isin("frequency", "fft", "hz"), "frequency").when(word.isin("frf", "frf_reference"), "frf").when(word.isin("time", "seconds", "sec") | ~F.col("spectrum"), "time").otherwise("frequency")
    marked = F.coalesce(flag(between(tail, "active=", ", display=")), F.lit(False))
    groups = heads.select(
        *KEYS, "grp", decode(between(tail, "name=", ", visible="), F.col("encoded")).alias("name"), F.coalesce(flag(between(tail, "visible=", ", color=")), F.lit(True)).alias("visible"),
        F.coalesce(color(between(tail, "color=", ", display=")), F.lit(rgb(*GROUP_COLOR))).alias("color"), mode.alias("mode"), (word == "frf_reference").alias("reference_axis"),
        F.coalesce(shown(between(tail, "display=")), F.lit(",".join(k for k, on in DISPLAY.items() if on))).alias("display"), marked.alias("marked"),
    )
    chosen = groups.groupBy(*KEYS, "mode").agg(F.coalesce(F.max(F.when(F.col("marked"), F.col("grp"))), F.max("grp")).alias("chosen"))
    groups = groups.join(chosen, [*KEYS, "mode"]).select(*KEYS, "grp", "name", "visible", "color", "mode", "reference_axis", "display", (F.col("grp") == F.col("chosen")).alias("active"))
    owners = heads.select(*KEYS, "grp", F.col("breaks").alias("owner_breaks"), F.col("placed").alias("before"))
    points = rows.where("is_point").join(owners, [*KEYS, "grp"]).where("breaks = owner_breaks")
    return groups, points.select(*KEYS, "grp", (F.col("placed") - F.col("before")).alias("point"), "x", "y")


def _in_order(rows: DataFrame, name: str) -> DataFrame:
    """Numbers entries from 1 in the order of the file."""
    return running_sum(rows, {name: F.lit(1)}, KEYS, order="line")


def markers(lines: DataFrame) -> DataFrame:
    """(recording_id, marker from 1, label, x, y, mode, snapped, channel from 0 or -1); numbers that don't fit are 0."""
    number, tail = numbered(F.col("text"), "marker")
    rows = _in_order(lines.where("section = 'markers'").where(number.isNotNull()), "marker")
    word = F.lower(between(tail, "mode=", ", snapped="))
    number = lambda c: F.coalesce(real(c), F.lit(0.0))
    return rows.select(
        *KEYS, "marker", decode(between(tail, "label=", ", x="), F.col("encoded")).alias("label"), number(between(tail, "x=", ", y=")).alias("x"), number(between(tail, "y=", ", mode=")).alias("y"),
        F.when(word.isin("frf", "frequency"), word).otherwise("time").alias("mode"), F.coalesce(flag(between(tail, "snapped=", ", channel=")), F.lit(False)).alias("snapped"),
        F.coalesce(whole(between(tail, "channel=")), F.lit(-1)).alias("channel"),
    )


def guides(lines: DataFrame) -> DataFrame:
    """(recording_id, guide from 1, vertical, value, mode); a value that doesn't fit is 0."""
    number, tail = numbered(F.col("text"), "guide")
    rows = _in_order(lines.where("section = 'guides'").where(number.isNotNull()), "guide")
    word = F.lower(between(tail, "mode="))
    value = F.coalesce(real(between(tail, "value=", ", mode=")), F.lit(0.0))
    return rows.select(*KEYS, "guide", (F.lower(between(tail, "kind=", ", value=")) != "horizontal").alias("vertical"), value.alias("value"), F.when(word.isin("frf", "frequency"), word).otherwise("time").alias("mode"))


def roles(table: DataFrame, counts: DataFrame) -> DataFrame:
    """(recording_id, role, place from 1, position): references and responses of frequency responses, of ``settings`` and
    (recording_id, n_channels).  None at all unless both are given, each a list of different channels, and
    no channel has both roles."""
    rows = table.where("section = 'frf_settings' AND key IN ('references', 'responses')").join(counts, "recording_id")
    cells = F.when(F.col("text") == "", F.array().cast("array<string>")).otherwise(F.split("text", ","))
    rows = rows.withColumn("list", F.transform(cells, whole))
    good = F.forall("list", lambda p: F.coalesce((p > 0) & (p <= F.col("n_channels")), F.lit(False))) & (F.size(F.array_distinct("list")) == F.size("list"))
    both = rows.groupBy("recording_id").agg(
        F.min(good).alias("good"), F.max(F.when(F.col("key") == "references", F.col("list"))).alias("references"), F.max(F.when(F.col("key") == "responses", F.col("list"))).alias("responses")
    )
    both = both.where(F.col("good") & F.col("references").isNotNull() & F.col("responses").isNotNull() & ~F.arrays_overlap("references", "responses"))
    out = both.select("recording_id", F.explode(F.create_map(F.lit("references"), "references", F.lit("responses"), "responses")).alias("role", "list"))
    return out.select("recording_id", "role", F.posexplode("list").alias("place", "position")).withColumn("place", F.col("place") + 1)


class Tables(Mapping):
    """The tables of the comments of files by name, each made when it is first asked for."""

    def __init__(self, spark, *paths: str):
        self._paths, self._spark, self._held = paths, spark, {}

    @cached_property
    def lines(self) -> DataFrame:
        return sectioned(comments(self._spark, *self._paths))

    def __iter__(self):
        return iter(("settings", "channels", "formulas", "point_groups", "points", "markers", "guides"))

    def __len__(self):
        return 7

    def __getitem__(self, name: str) -> DataFrame:
        if name not in set(self):
            raise KeyError(name)
        if name not in self._held:
            if name in ("point_groups", "points"):
                self._held["point_groups"], self._held["points"] = point_groups(self.lines)
            else:
                self._held[name] = settle(SMALL[name](self.lines)) if name in SMALL else {"markers": markers, "guides": guides}[name](self.lines)
        return self._held[name]


# Tables of a row for each key or channel.
SMALL = {"settings": settings, "channels": channels, "formulas": formulas}


# Text --------------------------------------------------------------------------------------


def _ordinal(name: str) -> Column:
    """The number of an entry; readers pass over numbers below 1 and count entries themselves."""
    return F.greatest(F.col(name), F.lit(1)).cast("string")


def _number(c: Column) -> Column:
    """The shortest text that reads back as the same number."""
    return F.regexp_replace(c.cast("double").cast("string"), r"\.0$", "")


def _bit(c: Column) -> Column:
    return c.cast("int").cast("string")


def comment_text(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(recording_id, a, b, c, text): the comment lines of tables as ``Tables`` gives them (any may be left out),
    in the order of (a, b, c) within a recording."""
    order = {s: i for i, s in enumerate(SECTIONS)}
    parts = []

    def put(section: str, rows: DataFrame, b: Column, c: Column, *text) -> None:
        line = F.concat(F.lit("# "), *(F.lit(t) if isinstance(t, str) else t for t in text))
        parts.append(rows.select("recording_id", F.lit(order[section]).alias("a"), b.cast("long").alias("b"), c.cast("long").alias("c"), line.alias("text")))

    def title(section: str, rows: DataFrame) -> None:
        put(section, rows.select("recording_id").distinct(), F.lit(-1), F.lit(0), f"[{section}]")

    zero, col = F.lit(0), F.col
    if (rows := tables.get("settings")) is not None:
        keys = {(s, k): kind for s, kinds in SETTINGS.items() for kind, names in kinds.items() for k in names}
        place = F.create_map(*(F.lit(x) for i, (s, k) in enumerate(keys) for x in (f"{s}/{k}", i)))
        at = F.concat_ws("/", "section", "key")

        def among(kind: str) -> Column:
            return at.isin(*(f"{s}/{k}" for (s, k), v in keys.items() if v == kind))

        value = F.when(among("encoded"), encode(col("text"))).when(among("display"), display_text(col("text"))).when(among("color"), color_text(col("number")))
        value = F.coalesce(value, "text", _number(col("number")), _bit(col("on")), F.lit(""))
        for s in SETTINGS:
            own = rows.where(col("section") == s)
            title(s, own)
            put(s, own, place[at], zero, col("key"), "=", value)
    if (rows := tables.get("channels")) is not None:
        title("channels", rows)
        given = F.concat(F.lit("name="), encode(F.coalesce("name", F.lit(""))), F.lit(", visible="), F.coalesce(_bit(col("visible")), F.lit("")), F.lit(", color="), F.coalesce(color_text(col("color")), F.lit("")))
        put("channels", rows, col("position"), zero, "channel[", col("position").cast("string"), "] ", given)
    if (rows := tables.get("formulas")) is not None:
        title("formulas", rows)
        key = F.when(col("position") == 0, "global").otherwise(F.concat(F.lit("channel["), col("position").cast("string"), F.lit("]")))
        put("formulas", rows, col("position"), zero, key, "=", encode(F.coalesce("formula", F.lit(""))))
    if (rows := tables.get("point_groups")) is not None:
        title("point_groups", rows)
        mode = F.when((col("mode") == "frf") & col("reference_axis"), "frf_reference").otherwise(col("mode"))
        text = ("group[", _ordinal("grp"), "] name=", encode(col("name")), ", visible=", _bit(col("visible")), ", color=", color_text(col("color")), ", mode=", mode)
        put("point_groups", rows, col("grp"), zero, *text, ", active=", _bit(col("active")), ", display=", display_text(col("display")))
        if (dots := tables.get("points")) is not None:
            put("point_groups", dots, col("grp"), col("point"), "point[", _ordinal("point"), "] x=", _number(col("x")), ", y=", _number(col("y")))
    if (rows := tables.get("markers")) is not None:
        title("markers", rows)
        text = ("marker[", _ordinal("marker"), "] label=", encode(col("label")), ", x=", _number(col("x")), ", y=", _number(col("y")), ", mode=", col("mode"))
        put("markers", rows, col("marker"), zero, *text, ", snapped=", _bit(col("snapped")), ", channel=", col("channel").cast("string"))
    if (rows := tables.get("guides")) is not None:
        title("guides", rows)
        put("guides", rows, col("guide"), zero, "guide[", _ordinal("guide"), "] kind=", F.when(col("vertical"), "vertical").otherwise("horizontal"), ", value=", _number(col("value")), ", mode=", col("mode"))
    if not parts:
        raise RecordingError("InvalidOptions", "no table is given")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out

