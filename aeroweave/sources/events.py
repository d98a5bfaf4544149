"""The observation table made from the generic ``events`` table: a stand-in for sensor files.

Users fly on straight lines with some noise; every 97th report is an outlier; radar identifiers change every
20 minutes of the hour that the data are squeezed into.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Origin
from ..functions.geo import wgs84
from .readers import source_rank

COLUMNS = "obs_id source source_rank target_id user_id time_sec e n u speed heading climb_rate lat lon alt_geom sensor_id frequency uav_model_text target_type".split()

OBSERVATION_SQL = """
raw_obs as (
  select event_id as obs_id, user_id, event_type, value,
    cast(epoch_us(ts) - epoch_us(timestamp '2024-01-01 00:00:00') as double) / 1e6 / 720 as time_sec,
    cast(regexp_extract(props, '"k": *(-?[0-9]+)', 1) as double) as k
  from events),
obs as (
  select obs_id,
    case event_type when 'click' then 'adsb' when 'view' then 'remote_id' when 'purchase' then 'radar' else 'spectrum' end as source,
    case event_type when 'click' then 0 when 'view' then 1 when 'purchase' then 2 else 3 end as source_rank,
    case when event_type = 'purchase' then user_id || '_' || cast(trunc(time_sec / 1200) as bigint) else cast(user_id as varchar) end as target_id,
    user_id, time_sec,
    case when event_type in ('click', 'view', 'purchase')
      then ((user_id * 7919) % 4001 - 2000) + (((user_id * 31) % 21) - 10) * cast(0.05 as double) * time_sec + ((obs_id * 7907) % 41 - 20) * cast(0.5 as double) + case when obs_id % 97 = 0 then 50000 else 0 end
      else cast((obs_id % 5 - 2) * 1500 as double) end as e,
    case when event_type in ('click', 'view', 'purchase')
      then ((user_id * 104729) % 4001 - 2000) + (((user_id * 17) % 21) - 10) * cast(0.05 as double) * time_sec + ((obs_id * 6007) % 41 - 20) * cast(0.5 as double)
      else cast(((obs_id % 5) * 2 % 5 - 2) * 1500 as double) end as n,
    case when event_type in ('click', 'view', 'purchase') then cast(50 + (user_id % 12) * 60 + (obs_id % 7) * 3 as double) else cast(10 as double) end as u,
    case when event_type in ('click', 'view', 'purchase') then value / 5 end as speed,
    case when event_type in ('click', 'view', 'purchase') then k * cast(3.6 as double) end as heading,
    case when event_type in ('click', 'view', 'purchase') then case when obs_id % 89 = 0 then cast(60 as double) else ((obs_id % 5) - 2) * cast(0.5 as double) end end as climb_rate,
    case when event_type not in ('click', 'view', 'purchase') then cast(obs_id % 5 as integer) end as sensor_id,
    case when event_type not in ('click', 'view', 'purchase') then cast(case obs_id % 3 when 0 then 2440 when 1 then 5800 else 433 end as double) end as frequency,
    case when event_type not in ('click', 'view', 'purchase') then
      case (user_id + obs_id % 2) % 6 when 0 then 'DJI Mini 3' when 1 then 'DJI Air 2S' when 2 then 'Matrice M300' when 3 then 'Agras T40' when 4 then 'FPV racer' else 'other craft' end end as uav_model_text
  from raw_obs)"""


def observations(spark: SparkSession, sf_dir: str, origin: Origin = Origin()) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    start = F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").cast("timestamp"))
    t = (F.unix_micros(F.col("ts").cast("timestamp")) - start).cast("double") / 1e6 / 720
    user, event = F.col("user_id"), F.col("event_id")
    spatial = F.col("event_type").isin("click", "view", "purchase")
    source = F.when(F.col("event_type") == "click", "adsb").when(F.col("event_type") == "view", "remote_id").when(F.col("event_type") == "purchase", "radar").otherwise("spectrum")

    def line(user_step: int, drift: int, event_step: int):
        return ((user * user_step) % 4001 - 2000) + (((user * drift) % 21) - 10) * F.lit(0.05) * F.col("time_sec") + ((event * event_step) % 41 - 20) * F.lit(0.5)

    rows = events.select("*", t.alias("time_sec"), F.get_json_object("props", "$.k").cast("double").alias("k"), source.alias("source"))
    e = line(7919, 31, 7907) + F.when(event % 97 == 0, 50000).otherwise(0)
    sensor = event % 5
    out = {
        "obs_id": event,
        "source": F.col("source"),
        "source_rank": source_rank(F.col("source")),
        "target_id": F.when(F.col("event_type") == "purchase", F.concat(user.cast("string"), F.lit("_"), (F.col("time_sec") / 1200).cast("long").cast("string"))).otherwise(user.cast("string")),
        "user_id": user,
        "time_sec": F.col("time_sec"),
        "e": F.when(spatial, e).otherwise(((sensor - 2) * 1500).cast("double")),
        "n": F.when(spatial, line(104729, 17, 6007)).otherwise((((sensor * 2) % 5 - 2) * 1500).cast("double")),
        "u": F.when(spatial, (50 + (user % 12) * 60 + (event % 7) * 3).cast("double")).otherwise(10.0),
        "speed": F.when(spatial, F.col("value") / 5),
        "heading": F.when(spatial, F.col("k") * 3.6),
        "climb_rate": F.when(spatial, F.when(event % 89 == 0, 60.0).otherwise(((event % 5) - 2) * F.lit(0.5))),
        "sensor_id": F.when(~spatial, sensor.cast("int")),
        "frequency": F.when(~spatial, F.when(event % 3 == 0, 2440.0).when(event % 3 == 1, 5800.0).otherwise(433.0)),
        "uav_model_text": F.when(~spatial, F.element_at(F.array(*map(F.lit, ("DJI Mini 3", "DJI Air 2S", "Matrice M300", "Agras T40", "FPV racer", "other craft"))), ((user + event % 2) % 6 + 1).cast("int"))),
        "target_type": F.when(F.col("source").isin("adsb", "remote_id"), "cooperative").otherwise("non_cooperative"),
    }
    rows = rows.select(*[c.alias(n) for n, c in out.items()])
    lat, lon, alt = wgs84(F.col("e"), F.col("n"), F.col("u"), origin)
    return rows.withColumns({"lat": lat, "lon": lon, "alt_geom": alt}).select(*COLUMNS)
