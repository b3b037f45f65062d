"""Queries over projects: the tables of a project written and read again, and what opening one does."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wavemill.operators import annotations, stats
from wavemill.plans import project
from wavemill.plans.catalog import DAYS, R, daily, points, query, shared_file, tbl
from wavemill.scratch import settle
from wavemill.sources import metadata

NUMBERS = "nr AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS nr, date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE))::DOUBLE AS x FROM orders)"


def rid():
    return F.lit("r").alias("recording_id")


def order_groups(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """A group of points for each customer with orders, and its points in the order of their keys."""
    dots = points(spark, sf_dir)
    number = F.row_number().over(Window.partitionBy("grp").orderBy("idx")).cast("long")
    k = F.col("grp")
    groups = dots.select("grp").distinct().select(
        rid(), "grp", F.concat(F.lit("Customer #"), k.cast("string"), F.lit(", visible=0 (50 %)")).alias("name"), (k % 3 > 0).alias("visible"), (k % (1 << 24)).cast("int").alias("color"),
        F.when(k % 4 == 0, "frequency").when(k % 4 == 1, "frf").otherwise("time").alias("mode"), (k % 8 == 1).alias("reference_axis"),
        F.when(k % 2 == 0, "number,x,y").otherwise("dx,dist").alias("display"), (k % 10 == 0).alias("active"),
    )
    return groups, dots.select(rid(), "grp", number.alias("point"), "x", "y")


def reopened(spark, sf_dir, name: str, tables: dict[str, DataFrame]) -> project.Project:
    """A project of the daily recording with these tables, written and opened."""
    path = shared_file(spark, name)
    settings = settings_of(spark, {("export", "text_encoding"): "percent_utf8"})
    project.write_project(settle(daily(spark, sf_dir)), path, ["A", "N", "R"], tables | {"settings": settings})
    return project.open_project(spark, path, checkpoint=500)


def settings_of(spark, values: dict) -> DataFrame:
    """(section, key) -> text, number or flag, as a table of settings of the daily recording."""
    items = [F.struct(F.lit(s).alias("section"), F.lit(k).alias("key"), F.lit(v if isinstance(v, str) else None).cast("string").alias("text"), F.lit(v if isinstance(v, float) else None).cast("double").alias("number"), F.lit(v if isinstance(v, bool) else None).cast("boolean").alias("on")) for (s, k), v in values.items()]
    return spark.range(1).select(rid(), F.explode(F.array(*items)).alias("i")).select("recording_id", "i.*")


@query("""WITH pt AS (SELECT o_custkey AS cust, o_orderkey AS idx, date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE))::DOUBLE AS x, sqrt(o_totalprice) AS y FROM orders)
SELECT 'Customer #' || cust || ', visible=0 (50 %)' AS name, row_number() OVER (PARTITION BY cust ORDER BY idx) AS point, """ + f"{R('x')}, {R('y')} FROM pt")
def project_points_orders(spark, sf_dir):
    groups, dots = order_groups(spark, sf_dir)
    tables = reopened(spark, sf_dir, "points.lvm", {"point_groups": groups, "points": dots}).tables
    return tables["points"].join(tables["point_groups"].select("recording_id", "grp", "name"), ["recording_id", "grp"]).select("name", "point", "x", "y")


@query("""WITH g AS (SELECT DISTINCT o_custkey AS k FROM orders), m AS (SELECT *, CASE k % 4 WHEN 0 THEN 'frequency' WHEN 1 THEN 'frf' ELSE 'time' END AS mode FROM g),
c AS (SELECT mode, coalesce(max(k) FILTER (k % 10 = 0), max(k)) AS chosen FROM m GROUP BY mode)
SELECT row_number() OVER (ORDER BY k) AS grp, 'Customer #' || k || ', visible=0 (50 %)' AS name, k % 3 > 0 AS visible, CAST(k % 16777216 AS INT) AS color, mode, k % 8 = 1 AND mode = 'frf' AS reference_axis,
CASE WHEN k % 2 = 0 THEN 'number,x,y' ELSE 'dx,dist' END AS display, k = chosen AS active FROM m JOIN c USING (mode)""")
def project_groups_orders(spark, sf_dir):
    """Names that look like the next entry of a line come back whole; one group of each mode is active."""
    groups, dots = order_groups(spark, sf_dir)
    return reopened(spark, sf_dir, "groups.lvm", {"point_groups": groups, "points": dots}).tables["point_groups"].drop("recording_id")


@query(f"""WITH {NUMBERS} SELECT nr AS marker, o_orderpriority || ', x=9 %41+é' AS label, {R('x')}, {R('o_totalprice', 'y')},
CASE o_orderstatus WHEN 'O' THEN 'time' WHEN 'F' THEN 'frequency' ELSE 'frf' END AS mode, o_orderkey % 2 = 0 AS snapped, CAST(o_custkey % 4 - 1 AS INT) AS channel FROM nr""")
def project_markers_orders(spark, sf_dir):
    o = tbl(spark, sf_dir, "orders")
    marks = o.select(
        rid(), F.col("o_orderkey").alias("marker"), F.concat("o_orderpriority", F.lit(", x=9 %41+é")).alias("label"), F.datediff("o_orderdate", F.lit("1995-01-01")).cast("double").alias("x"),
        F.col("o_totalprice").alias("y"), F.when(F.col("o_orderstatus") == "O", "time").when(F.col("o_orderstatus") == "F", "frequency").otherwise("frf").alias("mode"),
        (F.col("o_orderkey") % 2 == 0).alias("snapped"), (F.col("o_custkey") % 4 - 1).cast("int").alias("channel"),
    )
    return reopened(spark, sf_dir, "markers.lvm", {"markers": marks}).tables["markers"].drop("recording_id")


@query(f"""WITH {NUMBERS}, k AS (SELECT DISTINCT o_orderstatus, x FROM nr) SELECT x % 2 <> 0 AS vertical, {R('x / 7', 'value')}, CASE o_orderstatus WHEN 'O' THEN 'time' WHEN 'F' THEN 'frequency' ELSE 'frf' END AS mode FROM k""")
def project_guides_orders(spark, sf_dir):
    days = tbl(spark, sf_dir, "orders").select("o_orderstatus", F.datediff("o_orderdate", F.lit("1995-01-01")).alias("d")).distinct()
    mode = F.when(F.col("o_orderstatus") == "O", "time").when(F.col("o_orderstatus") == "F", "frequency").otherwise("frf")
    lines = days.select(rid(), (F.col("d") + 10000).alias("guide"), (F.col("d") % 2 != 0).alias("vertical"), (F.col("d") / 7).alias("value"), mode.alias("mode"))
    return reopened(spark, sf_dir, "guides.lvm", {"guides": lines}).tables["guides"].select("vertical", "value", "mode")


def processed_project(spark, sf_dir) -> project.Project:
    """The daily recording with a channel of another name, one hidden, formulas and an interval."""
    long, path = settle(daily(spark, sf_dir)), shared_file(spark, "processed.lvm")
    place = F.when(F.col("channel") == "A", 1).when(F.col("channel") == "N", 2).otherwise(3)
    held = long.select("recording_id", "channel").distinct().withColumn("position", place)
    name = F.when(F.col("channel") == "A", "Accepted [units, 100 %]").otherwise(F.col("channel"))
    columns = held.select("recording_id", "position", name.alias("name"), (F.col("channel") != "R").alias("visible"), (F.col("position") * metadata.rgb(0, 60, 5)).alias("color"))
    texts = held.select("recording_id", "position", F.when(F.col("channel") == "A", "2*x+1").otherwise("x").alias("formula"))
    texts = texts.unionByName(held.select("recording_id", F.lit(0).alias("position"), F.lit("x/10").alias("formula")).distinct())
    values = {
        ("export", "text_encoding"): "percent_utf8", ("export", "data_mode"): "settings_only", ("graph_settings", "analysis_interval"): True,
        ("graph_settings", "analysis_start"): 86400.0 * 30, ("graph_settings", "analysis_end"): 86400.0 * 900,
    }
    project.write_project(long, path, ["A", "N", "R"], {"settings": settings_of(spark, values), "channels": columns, "formulas": texts})
    return project.open_project(spark, path, checkpoint=500)


PROCESSED = f"""WITH {DAYS}, pr AS (SELECT CASE channel WHEN 'A' THEN 'Accepted [units, 100 %]' ELSE channel END AS channel, sample, t,
CASE channel WHEN 'A' THEN 2 * (value / 10) + 1 ELSE value / 10 END AS value FROM ev WHERE t BETWEEN 86400 * 30 AND 86400 * 900)"""


@query(f"{PROCESSED} SELECT channel, CAST(sample AS BIGINT) AS sample, {R('t')}, {R('value')} FROM pr WHERE channel <> 'R'")
def project_processed_daily(spark, sf_dir):
    """A project opened: shown channels under their names, through its formulas, within its interval."""
    opened = processed_project(spark, sf_dir)
    return opened.recipe().apply(opened.shown()).select("channel", "sample", "t", "value")


@query(f"{PROCESSED} SELECT channel, count(*) AS n, {R('min(value)', 'min_value')}, {R('max(value)', 'max_value')}, {R('avg(value)', 'mean_value')} FROM pr GROUP BY channel")
def project_result_daily(spark, sf_dir):
    """A result of a project, kept once and opened from its folder."""
    opened, folder = processed_project(spark, sf_dir), shared_file(spark, "results")
    opened.result("stats", stats.channel_stats, folder)
    return opened.result("stats", stats.channel_stats, folder).drop("recording_id")


@query("""WITH pt AS (SELECT o_custkey AS cust, o_orderkey AS idx, date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE))::DOUBLE AS x, sqrt(o_totalprice) AS y FROM orders),
n AS (SELECT *, row_number() OVER (PARTITION BY cust ORDER BY idx) AS point, x - lag(x) OVER (PARTITION BY cust ORDER BY idx) AS dx FROM pt) SELECT dense_rank() OVER (ORDER BY cust) AS grp, point, """ + f"{R('x')}, {R('dx')} FROM n")
def project_point_deltas_orders(spark, sf_dir):
    """Steps between the points of an opened project."""
    groups, dots = order_groups(spark, sf_dir)
    held = reopened(spark, sf_dir, "deltas.lvm", {"point_groups": groups, "points": dots}).tables["points"]
    return annotations.point_deltas(held, ("grp",), "point").select("grp", "point", "x", "dx")
