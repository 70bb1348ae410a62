"""Text scans, hand-over and telemetry over texts made of the test tables."""

from __future__ import annotations

import socket

import pandas as pd
from pyspark.sql import functions as F

from boostlab.registry.base import query
from boostlab.registry.sqlparts import ORDER_FEATURES, TELEMETRY
from boostlab.sources import handover, relations, texts
from boostlab.streaming import spans, telemetry


def _polls(spark, sf_dir):
    """A poll per event: the device's line, another device's, a short line, at times a bad number."""
    device = (F.col("user_id") % 4).cast("string")
    util = F.when(F.col("event_type") == "error", "[N/A]").otherwise(
        F.least(F.lit(100), F.floor("value")).cast("string")
    )
    used = F.floor(F.col("value") * 10).cast("string")
    second = F.when(F.col("event_type") == "signup", device).otherwise(
        ((F.col("user_id") + 1) % 4).cast("string")
    )
    text = F.concat_ws(
        "\n",
        F.concat_ws(", ", device, util, used, F.lit("24570")),
        F.concat_ws(",", second, F.lit("7"), used, F.lit("24570"), F.lit("extra")),
        F.concat_ws(", ", device, F.lit("no reading")),
    )
    return relations.table(spark, sf_dir, "events").select("event_id", text.alias("text"))


@query("telemetry_parse", """WITH kept AS (SELECT * FROM events WHERE event_type <> 'error')
SELECT event_id, (user_id % 4)::INT AS device_id, least(100, floor(value))::INT AS util,
       floor(value * 10)::INT AS mem_used, 24570 AS mem_total
FROM kept WHERE event_type <> 'signup'
UNION ALL
SELECT event_id, ((user_id + CASE event_type WHEN 'signup' THEN 0 ELSE 1 END) % 4)::INT, 7,
       floor(value * 10)::INT, 24570 FROM kept""")
def q_telemetry_parse(spark, sf_dir):
    return texts.parse_samples(_polls(spark, sf_dir), "event_id")


@query("inventory_parse", """SELECT p_partkey, trim(p_name) AS name,
       CASE WHEN p_size % 7 = 0 THEN 0 ELSE p_size * 512 END AS memory_mb, p_brand AS driver
FROM part WHERE p_type <> 'SMALL'""")
def q_inventory_parse(spark, sf_dir):
    """Lines of parts; some name no memory, and small parts lack a field."""
    memory = F.when(F.col("p_size") % 7 == 0, "[N/A]").otherwise(
        F.concat((F.col("p_size") * 512).cast("string"), F.lit(" MiB"))
    )
    driver = F.when(F.col("p_type") != "SMALL", F.col("p_brand"))
    lines = relations.table(spark, sf_dir, "part").select(
        "p_partkey", F.concat_ws(", ", "p_name", memory, driver).alias("line")
    )
    return texts.parse_inventory(lines)


@query("kv_parse", """WITH lines AS (SELECT event_id, event_type, user_id FROM events)
SELECT event_id, 'cpu_model' AS key, 'model ' || user_id AS value FROM lines WHERE event_type = 'view'
UNION ALL
SELECT event_id, 'cpu_count', '' || user_id FROM lines WHERE event_type = 'click'""")
def q_kv_parse(spark, sf_dir):
    user = F.col("user_id").cast("string")
    line = (
        F.when(F.col("event_type") == "view",
               F.concat(F.lit("Model name:    model "), user, F.lit(" : rev 2")))
        .when(F.col("event_type") == "click", F.concat(F.lit("CPU(s):   "), user))
        .when(F.col("event_type") == "error", F.concat(F.lit("NUMA node0 CPU(s): 0-"), user))
        .when(F.col("event_type") == "signup", F.concat(F.lit("On-line CPU(s) list: 0-"), user))
        .otherwise(F.concat(F.lit("Vendor ID: "), user))
    )
    lines = relations.table(spark, sf_dir, "events").select("event_id", line.alias("line"))
    return texts.parse_key_values(lines)


@query("release_line", """WITH hits AS (
  SELECT user_id, min(event_id) FILTER (event_type IN ('view', 'click')) AS first_id FROM events GROUP BY user_id)
SELECT user_id, 'Cuda compilation tools, ' ||
       CASE event_type WHEN 'view' THEN 'Release ' ELSE 'release ' END || first_id AS cuda_version
FROM hits LEFT JOIN (SELECT event_id, event_type FROM events) e ON e.event_id = first_id""")
def q_release_line(spark, sf_dir):
    number = F.col("event_id").cast("string")
    line = (
        F.when(F.col("event_type") == "view",
               F.concat(F.lit("  Cuda compilation tools, Release "), number))
        .when(F.col("event_type") == "click",
              F.concat(F.lit("Cuda compilation tools, release "), number, F.lit("  ")))
        .otherwise(F.concat(F.lit("Built on "), number))
    )
    lines = relations.table(spark, sf_dir, "events").select("user_id", "event_id", line.alias("line"))
    return texts.first_release_line(lines, "user_id", "event_id")


@query("result_line_parse", """WITH firsts AS (
  SELECT user_id, min(event_id) FILTER (event_type = 'purchase' AND value > 30) AS first_id
  FROM events GROUP BY user_id)
SELECT f.user_id, first_id IS NOT NULL AS found, e.value AS time,
       floor(e.value) / 1000 AS accuracy, floor(e.value) / 500 AS auc
FROM firsts f LEFT JOIN events e ON e.event_id = first_id""")
def q_result_line_parse(spark, sf_dir):
    """The output of every user's runs; only large purchases report a result."""
    shows = (F.col("event_type") == "purchase") & (F.col("value") > 30)
    result = F.concat(
        F.lit("RESULT:time="), F.col("value").cast("string"),
        F.lit(",accuracy="), (F.floor("value") / 1000).cast("string"),
        F.lit(",auc="), (F.floor("value") / 500).cast("string"),
    )
    line = F.when(shows, result).otherwise(F.concat(F.lit("log RESULT: "), "props"))
    lines = relations.table(spark, sf_dir, "events").select("user_id", "event_id", line.alias("line"))
    return texts.parse_result_lines(lines, "user_id", "event_id")


@query("dataset_roundtrip", f"WITH {ORDER_FEATURES} SELECT row_id, f0, f1, f2, f3, label FROM train")
def q_dataset_roundtrip(spark, sf_dir):
    return handover.hand_over(relations.order_features(spark, sf_dir))


@query("telemetry_rollup", f"""WITH {TELEMETRY}
SELECT device_id, round(avg(util), 1) AS avg_util, max(util) AS max_util FROM telemetry GROUP BY device_id""")
def q_telemetry_rollup(spark, sf_dir):
    return telemetry.rollup(relations.telemetry(spark, sf_dir)).orderBy("device_id")


@query("device_set", f"WITH {TELEMETRY} SELECT DISTINCT device_id FROM telemetry ORDER BY device_id")
def q_device_set(spark, sf_dir):
    return telemetry.device_set(relations.telemetry(spark, sf_dir))


_WINDOWS_SQL = f"""WITH {TELEMETRY}
SELECT date_trunc('hour', ts) AS window_start, device_id, count(*) AS n_samples,
       round(avg(util), 1) AS avg_util, max(util) AS max_util
FROM telemetry GROUP BY ALL"""


def _naive(df):
    return df.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("telemetry_windows", _WINDOWS_SQL)
def q_telemetry_windows(spark, sf_dir):
    return _naive(telemetry.windowed(relations.telemetry(spark, sf_dir), "1 hour", "1 hour"))


@query("telemetry_stream", _WINDOWS_SQL)
def q_telemetry_stream(spark, sf_dir):
    """The same windows, from a stream over the events file."""
    schema = relations.table(spark, sf_dir, "events").schema
    files = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")
    return _naive(telemetry.drain(spark, relations.telemetry_columns(files)))


@query("telemetry_closed", f"""SELECT * FROM ({_WINDOWS_SQL}) WHERE window_start + INTERVAL 1 HOUR
  <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def q_telemetry_closed(spark, sf_dir):
    """The windows an append-mode stream over the events file has closed."""
    schema = relations.table(spark, sf_dir, "events").schema
    files = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")
    return _naive(telemetry.drain_closed(spark, relations.telemetry_columns(files)))


_SPANS_SQL = f"""WITH {TELEMETRY}, spans AS (
  SELECT event_id AS run, ts AS start, ts + to_minutes(floor(value)::BIGINT) AS stop
  FROM events WHERE event_type = 'purchase' AND event_id % 5 = 0)
SELECT run, device_id, round(avg(util), 1) AS avg_util, max(util) AS max_util
FROM spans JOIN telemetry t ON t.ts BETWEEN start AND stop GROUP BY run, device_id"""


@query("run_device_stats", _SPANS_SQL)
def q_run_device_stats(spark, sf_dir):
    """Device statistics of each run's own time span."""
    events = relations.table(spark, sf_dir, "events")
    return spans.run_stats(relations.telemetry_columns(events), relations.spans(events))


@query("run_device_stream", _SPANS_SQL)
def q_run_device_stream(spark, sf_dir):
    """The same from a stream of samples and a stream of runs that have stopped."""
    schema = relations.table(spark, sf_dir, "events").schema

    def files():
        return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")

    return spans.drain_runs(
        spark, relations.telemetry_columns(files()), relations.spans(files()))


@query("host_rows", "SELECT count(*) AS n_rows FROM events")
def q_host_rows(spark, sf_dir):
    """The rows that all hosts of the census saw together."""
    return q_host_census(spark, sf_dir).agg(F.sum("n_rows").alias("n_rows"))


@query("host_census")
def q_host_census(spark, sf_dir):
    """Hosts that ran tasks over the events, and rows they saw."""

    def seen(batches):
        for batch in batches:
            yield pd.DataFrame({"host": [socket.gethostname()], "n_rows": [len(batch)]})

    ids = relations.table(spark, sf_dir, "events").select("event_id")
    census = ids.mapInPandas(seen, "host string, n_rows long")
    return census.groupBy("host").agg(F.sum("n_rows").alias("n_rows"))
