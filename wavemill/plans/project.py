"""Projects: a recording's unchanged samples with everything that was set and marked in it, in one file.

The file is a LabVIEW measurement file whose comments hold the tables of ``wavemill.sources.metadata``, so
it can be read as a recording, too.  Tables, header and rows are written by executors in one sort.
Numerical results are kept beside it as Parquet, named by what they depend on: formulas, filter,
interval, frequency-response settings and the file itself, but neither names nor views nor marks.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavemill.operators.filters import FilterSettings
from wavemill.plans.recipe import Recipe
from wavemill.recording import RecordingError, long_to_wide
from wavemill.sources import export, metadata, recording_file
from wavemill.sources.text_writer import Layout, write_ordered


def write_project(long: DataFrame, path: str, channels: Sequence[str], tables: Mapping[str, DataFrame]) -> None:
    """One recording (channels in the order of the file) and its tables; rows of other recordings are left out."""
    spark = long.sparkSession
    wide = long_to_wide(long, list(dict.fromkeys(channels)))
    ids = [r[0] for r in long.select("recording_id").distinct().limit(2).collect()]
    if len(ids) != 1:
        raise RecordingError("InvalidOptions", "a project holds one recording")
    order = ("part", "a", "b", "c")
    notes = metadata.comment_text(tables).where(F.col("recording_id") == ids[0])
    notes = notes.select(F.lit(0).alias("part"), "a", "b", "c", F.concat("text", F.lit("\r\n")).alias("text"))
    head = spark.range(1).select(F.lit(1).alias("part"), *(F.lit(0).cast("long").alias(c) for c in "abc"), F.lit(export.lvm_head(channels)).alias("text"))
    time = F.coalesce(F.col("t").cast("string"), F.lit(""))
    cells = [x for c in channels for x in (time, F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")))]
    rows = wide.select(F.lit(2).alias("part"), F.col("sample").alias("a"), *(F.lit(0).cast("long").alias(c) for c in "bc"), F.concat(F.concat_ws("\t", *cells), F.lit("\t\r\n")).alias("text"))
    write_ordered(notes.unionByName(head).unionByName(rows).orderBy(*order).select("text"), path, layout=Layout(raw=True))


@dataclass(frozen=True)
class Project:
    """An opened project; ``channels`` are the names in the order of the file, as the project has them."""

    path: str
    recording: DataFrame
    channels: tuple[str, ...]
    tables: Mapping[str, DataFrame]

    @cached_property
    def _settings(self) -> dict[tuple[str, str], object]:
        """A few dozen values."""
        return {(r["section"], r["key"]): next((v for v in (r["text"], r["number"], r["on"]) if v is not None), None) for r in self.tables["settings"].collect()}

    def setting(self, section: str, key: str, default=None):
        return self._settings.get((section, key), default)

    @cached_property
    def hidden(self) -> tuple[str, ...]:
        """Names of the channels that aren't shown."""
        rows = self.tables["channels"].where("NOT visible").select("position").collect()
        return tuple(self.channels[r[0] - 1] for r in sorted(rows) if r[0] <= len(self.channels))

    def shown(self) -> DataFrame:
        """The samples of the channels that are shown, as they are in the file."""
        return self.recording.where(~F.col("channel").isin(*self.hidden)) if self.hidden else self.recording

    def interval(self) -> tuple[float, float] | None:
        """The interval chosen for analyses; None if there is none, or if it isn't an interval within the recording."""
        low, high = self.setting("graph_settings", "analysis_start", 0.0), self.setting("graph_settings", "analysis_end", 0.0)
        if self.setting("graph_settings", "analysis_interval") is not True or not low < high:
            return None
        start, end = self.recording.agg(F.min("t"), F.max("t")).first()
        return (low, high) if start is not None and start <= low and high <= end else None

    def filter(self, step: float) -> FilterSettings | None:
        """The filter for samples ``step`` seconds apart, if it is on; cutoffs that aren't given are 0, negative ones too,
        and the lower one comes first."""
        if self.setting("filter_settings", "enabled") is not True:
            return None
        low, high = sorted(max(0.0, self.setting("filter_settings", key, 0.0)) for key in ("low_cutoff", "high_cutoff"))
        mode = self.setting("filter_settings", "mode", "band_pass").replace("_", "")
        return FilterSettings(mode, self.setting("filter_settings", "topology", "butterworth"), low, high, step)

    def recipe(self, step: float = 0.0, interval: bool = True) -> Recipe:
        """What the project does to its samples before an analysis."""
        texts = {r["position"]: r["formula"] for r in self.tables["formulas"].collect()}
        own = {self.channels[k - 1]: text for k, text in texts.items() if 0 < k <= len(self.channels) and text not in ("", "x")}
        start, end = (self.interval() if interval else None) or (None, None)
        return Recipe(start, end, (), texts.get(0) or None, own, self.filter(step))

    def roles(self) -> DataFrame:
        counts = self.tables["settings"].select("recording_id").distinct().withColumn("n_channels", F.lit(len(self.channels)))
        return metadata.roles(self.tables["settings"], counts)

    def result(self, name: str, compute: Callable[[DataFrame], DataFrame], folder: str, step: float = 0.0) -> DataFrame:
        """``compute`` of the processed samples, kept in ``folder`` under ``name`` and opened again for as long as neither the file
        nor a setting that numbers depend on has changed."""
        recipe = self.recipe(step)
        roles = sorted(map(tuple, self.roles().select("role", "place", "position").collect()))
        response = sorted((k, v) for (s, k), v in self._settings.items() if s == "frf_settings" and k not in ("references", "responses", "display_smoothing_octaves"))
        if self.setting("graph_settings", "frf_apply_processing") is not None:
            response.append(("apply_processing", self.setting("graph_settings", "frf_apply_processing")))
        return export.store_result(compute(recipe.apply(self.recording)), folder, (name, recipe, roles, response), [self.path])


def open_project(spark, path: str, **options) -> Project:
    """Reads a project, or any recording file with metadata; channels bear the names given there."""
    plain = path.removeprefix("file://")
    labels = [name for _, name in recording_file.indexed(spark, plain).channels()]
    tables = metadata.Tables(spark, path)
    given = {r["position"]: r["name"] for r in tables["channels"].where("name IS NOT NULL").select("position", "name").collect()}
    names = [given.get(k, label) for k, label in enumerate(labels, 1)]
    if len(set(names)) != len(names):
        names = labels
    recording = recording_file.read_recording(spark, path, **options)
    changed = {a: b for a, b in zip(labels, names) if a != b}
    if changed:
        renamed = F.create_map(*(F.lit(x) for pair in changed.items() for x in pair))
        recording = recording.withColumn("channel", F.coalesce(renamed[F.col("channel")], "channel"))
    return Project(plain, recording, tuple(names), tables)

