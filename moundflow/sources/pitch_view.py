"""Deterministic pitch log derived from the driver's ``lineitem`` and
``orders`` tables (one pitch per line item).

The same SQL text runs in Spark and DuckDB: integer arithmetic only, so both
engines produce identical rows.  ``{lineitem}`` / ``{orders}`` are table
placeholders: Spark binds DataFrames through ``spark.sql(..., lineitem=df)``,
the DuckDB oracle substitutes the view names.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PITCH_VIEW_SQL = """
SELECT
  src_key,
  gp AS game_pk,
  make_date(2024, CAST(3 + floor((gp % 180) / 28) AS INT), CAST(1 + gp % 28 AS INT)) AS game_date,
  ab + 1 AS at_bat_number,
  CAST(ln AS BIGINT) AS pitch_number,
  CAST(floor(ab / 6) AS BIGINT) + 1 AS inning,
  CASE WHEN CAST(floor(ab / 3) AS BIGINT) % 2 = 0 THEN 'Top' ELSE 'Bot' END AS inning_topbot,
  ab % 3 AS outs_when_up,
  sk AS pitcher,
  CASE WHEN ck % 10 = 0 THEN 1000 + ck ELSE ck % 60 END AS batter,
  CASE WHEN sk % 50 = 7 THEN (CASE WHEN ab % 2 = 0 THEN 'L' ELSE 'R' END)
       WHEN sk % 4 = 0 THEN 'L' ELSE 'R' END AS p_throws,
  CASE WHEN h1 % 97 = 0 THEN NULL WHEN ck % 3 = 0 THEN 'L' ELSE 'R' END AS stand,
  CASE WHEN h1 % 23 <= 6 THEN 'FF' WHEN h1 % 23 <= 9 THEN 'SI' WHEN h1 % 23 <= 11 THEN 'FC'
       WHEN h1 % 23 <= 14 THEN 'SL' WHEN h1 % 23 <= 16 THEN 'CU' WHEN h1 % 23 = 17 THEN 'ST'
       WHEN h1 % 23 <= 20 THEN 'CH' WHEN h1 % 23 = 21 THEN 'FS'
       WHEN pk % 2 = 0 THEN 'XX' ELSE NULL END AS pitch_type,
  description,
  CASE WHEN ip THEN (CASE h3 % 9 WHEN 0 THEN 'single' WHEN 1 THEN 'double' WHEN 2 THEN 'home_run'
                      WHEN 3 THEN 'grounded_into_double_play' WHEN 4 THEN 'sac_fly' WHEN 5 THEN 'triple'
                      ELSE 'field_out' END) ELSE NULL END AS events,
  CASE WHEN h2 % 14 + 1 = 10 THEN NULL ELSE h2 % 14 + 1 END AS zone,
  (d - 5) * 0.4E0 AS plate_x,
  t * 0.5E0 + 0.5E0 AS plate_z,
  75 + q * 0.5E0 AS release_speed,
  CASE WHEN h3 % 31 = 0 THEN NULL ELSE (1500 + q * 20 + d * 7) * 1E0 END AS release_spin_rate,
  (t - 4) * 0.25E0 AS pfx_x,
  (d - 5) * 0.2E0 AS pfx_z,
  h1 % 4 AS balls,
  h3 % 3 AS strikes,
  CASE WHEN (sk + ab) % 3 = 0 THEN ck ELSE NULL END AS on_1b,
  CASE WHEN (sk + ab) % 5 = 0 THEN ck ELSE NULL END AS on_2b,
  CASE WHEN (sk + ab) % 7 = 0 THEN ck ELSE NULL END AS on_3b,
  CASE WHEN ip THEN 60 + q * 1E0 ELSE NULL END AS launch_speed,
  CASE WHEN ip THEN (h3 % 70 - 25) * 1E0 ELSE NULL END AS launch_angle,
  CASE WHEN ip THEN (h3 % 100) / 100E0 ELSE NULL END AS estimated_woba_using_speedangle,
  CASE WHEN ip THEN (CASE h3 % 9 WHEN 0 THEN 0.9E0 WHEN 1 THEN 1.25E0 WHEN 2 THEN 2E0
                          WHEN 5 THEN 1.6E0 ELSE 0E0 END)
       WHEN description = 'hit_by_pitch' THEN 0.7E0 ELSE NULL END AS woba_value,
  CAST(floor(ab / 8) AS BIGINT) AS bat_score,
  sk % 6 AS fld_score,
  CAST(floor(ab / 8) AS BIGINT) + CASE WHEN ip AND h3 % 9 IN (2, 4) THEN 1 ELSE 0 END AS post_bat_score
FROM (
  SELECT *, COALESCE(description = 'hit_into_play', FALSE) AS ip
  FROM (
    SELECT *,
      CASE WHEN h2 % 20 <= 5 THEN 'ball' WHEN h2 % 20 = 6 THEN 'blocked_ball'
           WHEN h2 % 20 <= 9 THEN 'called_strike' WHEN h2 % 20 <= 11 THEN 'swinging_strike'
           WHEN h2 % 20 = 12 THEN 'foul_tip' WHEN h2 % 20 <= 15 THEN 'foul'
           WHEN h2 % 20 <= 18 THEN 'hit_into_play'
           WHEN pk % 3 = 0 THEN 'hit_by_pitch' WHEN pk % 3 = 1 THEN 'missed_bunt' ELSE NULL END AS description
    FROM (
      SELECT *,
        ok % 48 AS ab,
        CAST(floor(ok / 48) AS BIGINT) AS gp,
        pk * 7 + q * 13 + sk * 3 + ln * 5 + d * 11 + t * 17 AS h1,
        pk * 31 + q * 7 + ln * 3 + d AS h2,
        pk * 3 + q * 5 + t * 19 + ck AS h3,
        pk * 1000000000 + sk * 100000 + q * 1000 + d * 10 + t AS src_key
      FROM (
        SELECT l.l_orderkey AS ok, l.l_partkey AS pk, l.l_suppkey AS sk, l.l_linenumber AS ln,
               o.o_custkey AS ck,
               CAST(l.l_quantity AS BIGINT) AS q,
               CAST(round(l.l_discount * 100) AS BIGINT) AS d,
               CAST(round(l.l_tax * 100) AS BIGINT) AS t
        FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey
      ) b0
    ) b1
  ) b2
) b3
"""


def pitch_view_sql(lineitem: str = "lineitem", orders: str = "orders") -> str:
    """SQL text with concrete table names (used by the DuckDB oracle)."""
    return PITCH_VIEW_SQL.replace("{lineitem}", lineitem).replace("{orders}", orders)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def pitch_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw pitch log (duplicates, nulls and unknown types included)."""
    return spark.sql(
        PITCH_VIEW_SQL,
        lineitem=read_table(spark, sf_dir, "lineitem"),
        orders=read_table(spark, sf_dir, "orders"),
    )
