"""Sensor report sources as one typed observation table.

Each source has a fixed schema; whatever a file lacks is null, and NaN becomes null, so that comparisons are
three-valued instead of ordering NaN above everything.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import SOURCES
from ..functions.geo import seconds_of_day
from .excel import read_excel

CANONICAL = T.StructType(
    [
        *[T.StructField(n, T.StringType()) for n in ("source", "target_id", "target_type", "uav_model_text")],
        *[T.StructField(n, T.DoubleType()) for n in ("time_sec", "lat", "lon", "alt_pressure", "alt_geom", "alt_rel", "heading", "speed", "climb_rate", "frequency")],
    ]
)

# File prefix, raw column of each canonical one, and columns without which a row is dropped.
LAYOUT = {
    "adsb": ("ad_adsb", {"icao": "target_id", "lng": "lon", "lat": "lat", "altitude": "alt_pressure", "height": "alt_geom", "heading": "heading", "speed": "speed", "ver_speed": "climb_rate"}, ("time_sec", "lat", "lon")),
    "remote_id": (
        "ad_remote_id",
        {"uas_id": "target_id", "longitude": "lon", "latitude": "lat", "altitude_pressure": "alt_pressure", "altitude_geodetic": "alt_geom", "height": "alt_rel", "direction": "heading", "speed_horizontal": "speed", "speed_vertical": "climb_rate"},
        ("time_sec", "lat", "lon"),
    ),
    "radar": ("ad_radar", {"track_number": "target_id", "longitude": "lon", "latitude": "lat", "height": "alt_geom", "heading_angle": "heading"}, ("time_sec", "lat", "lon")),
    "spectrum": ("ad_spectrum_detect", {"uav_id": "target_id", "sensor_longitude": "lon", "sensor_latitude": "lat", "sensor_altitude": "alt_geom", "frequency": "frequency", "uav_model_text": "uav_model_text"}, ("time_sec",)),
}
TEXT = frozenset(("icao", "uas_id", "track_number", "uav_id", "uav_model_text"))
VELOCITY = ("velocity_x", "velocity_y", "velocity_z")


def canonical(raw: DataFrame, source: str) -> DataFrame:
    """Raw rows of a source in canonical columns, typed, sorted out by the columns a row needs."""
    _, names, needed = LAYOUT[source]
    have = set(raw.columns)

    def number(name: str):
        c = F.col(name).try_cast("double") if name in have else F.lit(None).cast("double")
        return F.nullif(c, F.lit(float("nan")))

    out = {to: (F.col(n).cast("string") if n in have else F.lit(None).cast("string")) if n in TEXT else number(n) for n, to in names.items()}
    out["time_sec"] = seconds_of_day(F.col("rev_time").cast("string") if "rev_time" in have else F.lit(None).cast("string"))
    if source == "radar":
        x, y, z = map(number, VELOCITY)
        known = x.isNotNull() & y.isNotNull() & z.isNotNull()
        out |= {"speed": F.when(known, F.sqrt(x * x + y * y)), "climb_rate": F.when(known, z)}
    out |= {"source": F.lit(source), "target_type": F.lit("cooperative" if source in ("adsb", "remote_id") else "non_cooperative")}
    rows = raw.select(*[out.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in CANONICAL.fields])
    return rows.dropna(subset=list(needed))


def read_source(spark: SparkSession, folder: str, source: str, missing_ok: bool = False) -> DataFrame:
    """The source's Parquet, CSV or Excel file in ``folder``; an error if there is none, unless that is allowed.

    Columns go by their names, in whatever order the file has them; text that is no number is null.
    """
    prefix = LAYOUT[source][0]
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for ending in ("parquet", "csv", "xlsx"):
        file = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{prefix}.{ending}")
        if system.exists(file):
            if ending == "parquet":
                return canonical(spark.read.parquet(f"{folder}/{prefix}.parquet"), source)
            if ending == "xlsx":
                return canonical(read_excel(spark, f"{folder}/{prefix}.xlsx"), source)
            return canonical(spark.read.option("header", True).csv(f"{folder}/{prefix}.csv"), source)
    if missing_ok:
        return spark.createDataFrame([], CANONICAL)
    raise FileNotFoundError(f"{folder}/{prefix}.parquet, .csv or .xlsx")


def read_all(spark: SparkSession, folder: str) -> DataFrame:
    """All sources in one table, with source_rank (the order of the sources)."""
    out = read_source(spark, folder, SOURCES[0])
    for source in SOURCES[1:]:
        out = out.unionByName(read_source(spark, folder, source))
    return out.withColumn("source_rank", source_rank(F.col("source")))


def source_rank(source):
    return F.array_position(F.array(*map(F.lit, SOURCES)), source).cast("int") - 1


def read_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)
