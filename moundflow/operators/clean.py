"""Required-field filter, coercion, base occupancy, de-duplication,
canonical order, per-job filters, clipping and minimum exposure."""
from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from moundflow.functions.pitch import occupied

PITCH_KEY = ["game_pk", "at_bat_number", "pitch_number"]
REQUIRED = ["pitcher", "batter", "pitch_type", "description"]
NUMERIC = ["balls", "strikes", "outs_when_up", "inning", "on_1b", "on_2b", "on_3b",
           "release_speed", "release_spin_rate", "plate_x", "plate_z", "zone",
           "launch_speed", "launch_angle", "estimated_woba_using_speedangle"]
ORDER = ["game_date", "game_pk", "at_bat_number", "pitch_number"]
TIEBREAK = "src_key"
#: Columns that de-duplication keeps as one value each, by the steps that read them:
#: every step, the run value, the last pitch and the outcome flags, who played; the rest is one more.
READ_TOGETHER = [["game_date", "pitch_type", "description"],
                 ["inning", "inning_topbot", "outs_when_up", "on_1b", "on_2b", "on_3b", "bat_score", "post_bat_score", "post_fld_score", "fld_score"],
                 ["release_speed", "zone", "events"], [TIEBREAK, "pitcher", "batter"]]
#: The same for who reads almost all columns: one value, but for what the outcome flags and the last result read.
READ_WHOLE = [["description", "events", TIEBREAK]]


def complete(df: DataFrame) -> Column:
    """C1's condition: pitcher, batter, pitch type and description are there
    (NaN is missing, too)."""
    types = dict(df.dtypes)
    have = [F.col(c).isNotNull() & ~F.isnan(c) if types[c] in ("float", "double") else F.col(c).isNotNull() for c in REQUIRED if c in types]
    return functools.reduce(lambda a, b: a & b, have, F.lit(True))


def required_fields(df: DataFrame) -> DataFrame:
    """Drop rows missing pitcher, batter, pitch type or description."""
    return df.where(complete(df))


def coerce_types(df: DataFrame) -> DataFrame:
    """Text columns that must be numbers or dates are parsed; bad values
    become null instead of failing (ANSI-safe)."""
    casts = {}
    types = dict(df.dtypes)
    for c in NUMERIC:
        if c in types and types[c] == "string":
            casts[c] = F.col(c).try_cast("double")
    if types.get("game_date") == "string":
        casts["game_date"] = F.try_to_date(F.col("game_date"))
    return df.withColumns(casts) if casts else df


def base_occupancy(df: DataFrame) -> DataFrame:
    """Runner id -> 0/1."""
    return df.withColumns({c: occupied(c) for c in ["on_1b", "on_2b", "on_3b"] if c in df.columns})


def with_tiebreak(df: DataFrame) -> DataFrame:
    """A total order for 'keep first' when the input has no file-order key.
    Parquet/CSV scans give a stable id per input split."""
    if TIEBREAK in df.columns:
        return df
    return df.withColumn(TIEBREAK, F.monotonically_increasing_id())


def dedup_pitches(df: DataFrame, key=PITCH_KEY, among: Column | None = None, together=READ_TOGETHER) -> DataFrame:
    """C4: keep the first row (lowest tie-break) per pitch key, of the rows for which
    ``among`` holds.

    Written as an aggregate with ``min_by``: the aggregate is partial (sort
    based, as its buffer is a row), so copies of one pitch collapse map-side
    before the shuffle and a key with a huge number of copies never lands whole
    in one task.  (``dropDuplicates``
    keeps an arbitrary row; a row_number window would sort every copy.)

    A ``min_by`` holds the columns of one group of ``together``; all of them see
    the same rows in the same order and judge by the tie-break alone, so they keep the
    same row, and the optimizer leaves out, with what it is computed from, a group
    that nobody reads.  Each moves its own tie-break, null bits and lengths, so who reads
    columns of all groups takes ``READ_WHOLE``.  ``among`` is judged in the aggregate: a filter would be pushed
    below the join of the pitch view with all that its columns are computed from, and
    a generated method of over 8,000 bytes is never compiled by the JVM.
    """
    df = with_tiebreak(df)
    among = F.lit(True) if among is None else among
    key = [k for k in key if k in df.columns]
    others = [c for c in df.columns if c not in key]
    named = {c for g in together for c in g}
    groups = [g for g in ([c for c in others if c in r] for r in together) if g]
    groups += [rest] if (rest := [c for c in others if c not in named]) else []
    kept = df.groupBy(*key).agg(F.count(F.when(among, 1)).alias("_n"), *[
        F.min_by(F.when(among, F.struct(*g)), F.when(among, F.col(TIEBREAK))).alias(f"_row{i}") for i, g in enumerate(groups)]).where(F.col("_n") > 0)
    row = {c: F.col(f"_row{i}.{c}").alias(c) for i, g in enumerate(groups) for c in g}
    return kept.select(*[row[c] if c in row else F.col(c) for c in df.columns])


def clean_pitches(raw: DataFrame, report: Observation | None = None, together=READ_TOGETHER) -> DataFrame:
    """C1-C4 in order; C5 (canonical order) is carried by the window specs
    downstream, not by a global sort.  ``report`` counts the rows read with no
    extra pass; ``cleaning_report`` has the counts before and after."""
    df = raw if report is None else raw.observe(report, F.count(F.lit(1)).alias("rows_in"))
    have = complete(df)
    df = coerce_types(df)
    df = base_occupancy(df)
    return dedup_pitches(df, among=have, together=together)


def cleaning_report(raw: DataFrame, key=PITCH_KEY) -> DataFrame:
    """One row: rows before, rows with the required fields, rows after
    de-duplication, and the difference of before and after."""
    key = [k for k in key if k in raw.columns]
    have = functools.reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in REQUIRED if c in raw.columns])
    # one row per pitch key: copies collapse map-side
    per = raw.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(have, 1)).alias("ok"))
    out = per.agg(F.sum("n").alias("rows_before"), F.sum("ok").alias("rows_complete"), F.count(F.when(F.col("ok") > 0, 1)).alias("rows_after"))
    return out.withColumn("rows_dropped", F.col("rows_before") - F.col("rows_after"))


def clip_columns(df: DataFrame, bounds: dict) -> DataFrame:
    """Clip named columns to [lo, hi] (documented by the reference, off by
    default); nulls stay null."""
    return df.withColumns({c: F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c), F.lit(lo)), F.lit(hi))) for c, (lo, hi) in bounds.items()})


def min_exposure(df: DataFrame, count_col: str, k: int) -> DataFrame:
    """Keep groups with at least k observations."""
    return df.filter(F.col(count_col) >= k)
