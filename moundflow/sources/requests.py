"""Tables of requests, archetypes and at-bat logs derived from the driver's
tables, so recommendation and state operators run over whole inputs.

Like the pitch view, each is one SQL text run unchanged by Spark (tables bound
as DataFrames) and by the DuckDB oracle (tables named as views).
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from moundflow import constants as K
from moundflow.sources.pitch_view import read_table

# One recommendation request per order: pitcher ids run past the supplier
# range (id 0, and profile-less pitchers) so every fallback path is used.
# batter_query is what a user typed: an id, an absent id, part of a label or of
# any other value, something unknown, nothing.
REQUESTS_SQL = """
SELECT o_orderkey AS request_id,
  o_orderkey % (SELECT count(*) FROM {supplier}) AS pitcher,
  CASE WHEN o_custkey % 10 = 0 THEN 1000 + o_custkey ELSE o_custkey % 60 END AS batter,
  o_orderkey % 4 AS balls,
  o_orderkey % 3 AS strikes,
  o_orderkey % 3 AS outs,
  CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END AS on_1b,
  CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS on_2b,
  CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS on_3b,
  CASE WHEN o_custkey % 3 = 0 THEN 'L' ELSE 'R' END AS stand,
  1 + o_orderkey % 9 AS inning,
  o_orderkey % 5 - 2 AS score_diff,
  CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'FF' WHEN 2 THEN 'SL' ELSE 'CH' END AS last_pitch_type,
  1 + o_orderkey % 4 AS pitch_num_in_ab,
  CASE WHEN o_orderkey % 7 = 0 THEN 'bad' ELSE CAST(o_orderkey % 5 AS STRING) || '-' || CAST(o_orderkey % 4 AS STRING) END AS count_text,
  CASE WHEN o_orderkey % 9 >= 6 THEN TRUE ELSE FALSE END AS late_inning,
  CASE o_orderkey % 12 WHEN 1 THEN 'Patient' WHEN 3 THEN ' contact/PULL ' WHEN 5 THEN 'No Such Name'
    WHEN 7 THEN CAST(7000000 + o_custkey AS STRING) WHEN 9 THEN '0.' || CAST(o_custkey % 100 AS STRING)
    WHEN 10 THEN NULL WHEN 11 THEN CAST(100000 + o_custkey % 7 AS STRING)
    ELSE CAST(CASE WHEN o_custkey % 10 = 0 THEN 1000 + o_custkey ELSE o_custkey % 60 END AS STRING) END AS batter_query
FROM {orders}
"""

# Archetype per batter seen in the pitch log: cluster = id % 6 (5 has no
# name), label only for odd ids, hard-hit share from the id.
ARCHETYPES_SQL = """
SELECT batter, batter % 6 AS cluster,
  CASE WHEN batter % 2 = 0 THEN NULL
       WHEN batter % 6 = 0 THEN 'Power Hitter' WHEN batter % 6 = 1 THEN 'Contact Hitter'
       WHEN batter % 6 = 2 THEN 'Contact/Puller' WHEN batter % 6 = 3 THEN 'Patient Hitter'
       WHEN batter % 6 = 4 THEN 'Spray/Speed' ELSE NULL END AS label,
  (batter % 100) / 100E0 AS pct_hard_hit
FROM (SELECT DISTINCT batter FROM ({pitches}) p WHERE batter IS NOT NULL) b
"""

# At-bat log: session = user, events ordered by (ts, event_id), outcome by
# event id over the ten UI labels.  No per-user numbering here: a window over
# one user would put all of a hot user's events in one task.
def _outcome_case() -> str:
    whens = " ".join(f"WHEN {i} THEN '{o}'" for i, o in enumerate(K.ATBAT_OUTCOMES))
    return f"CASE event_id % 10 {whens} END"


ATBAT_LOG_SQL = f"""
SELECT user_id AS session_id,
  event_id AS seq,
  ts,
  CASE event_id % 5 WHEN 0 THEN 'FF' WHEN 1 THEN 'SL' WHEN 2 THEN 'CH' WHEN 3 THEN 'CU' ELSE 'SI' END AS pitch,
  {_outcome_case()} AS outcome
FROM {{events}}
WHERE user_id IS NOT NULL
"""


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(REQUESTS_SQL, orders=read_table(spark, sf_dir, "orders"),
                     supplier=read_table(spark, sf_dir, "supplier"))


def archetypes(spark: SparkSession, pitches: DataFrame) -> DataFrame:
    return spark.sql(ARCHETYPES_SQL, pitches=pitches)


def atbat_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(ATBAT_LOG_SQL, events=read_table(spark, sf_dir, "events"))


def requests_sql() -> str:
    return REQUESTS_SQL.replace("{orders}", "orders").replace("{supplier}", "supplier")


def archetypes_sql(pitches_sql: str) -> str:
    return ARCHETYPES_SQL.replace("{pitches}", pitches_sql)


def atbat_log_sql() -> str:
    return ATBAT_LOG_SQL.replace("{events}", "events")
