"""The batch pipeline as lazy DataFrame plans.

``Tables`` wires the operators together for one input folder.  Nothing is
computed until an action runs; shared intermediate tables are plain lazy
DataFrames (Catalyst re-uses exchanges inside one query), and ``persist``
or ``materialize`` write them out once when several jobs read them.
"""
from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from moundflow.operators import clean, features, profiles, runvalue, sequence
from moundflow.operators.clean import READ_TOGETHER, READ_WHOLE
from moundflow.session import written
from moundflow.sources.pitch_view import pitch_view, read_table


def pitches_with_rv(raw: DataFrame, re_table: DataFrame | None = None, together=READ_TOGETHER) -> DataFrame:
    """C1-C4 -> one hash shuffle on game -> W1-W3 -> W4-W8 -> E9-E14.

    The explicit ``repartition('game_pk')`` puts every game in one partition
    once; the half-inning and at-bat windows both partition by keys that
    start with ``game_pk``, so neither adds an Exchange (only local sorts).
    """
    df = clean.clean_pitches(raw, together=together)
    df = df.repartition("game_pk")
    df = runvalue.add_run_values(df, re_table)
    df = sequence.add_sequence_features(df)
    return sequence.add_outcome_features(df)


#: What the steps of ``pitches_with_rv`` read of the log.
STEP_COLUMNS = [*clean.PITCH_KEY, *clean.REQUIRED, clean.TIEBREAK, "game_date", "inning", "inning_topbot", "outs_when_up", "on_1b", "on_2b", "on_3b",
                "bat_score", "post_bat_score", "release_speed", "zone", "events"]


class Tables:
    """All derived tables for one input folder, built lazily."""

    def __init__(self, spark: SparkSession, sf_dir: str, strict_pitcher_join: bool = True,
                 raw: DataFrame | None = None):
        self.spark = spark
        self.sf_dir = sf_dir
        self.strict = strict_pitcher_join
        if raw is not None:
            self.raw = raw          # an already-materialised raw pitch log

    def materialize(self, name: str) -> DataFrame:
        """Compute a derived table once and keep it as a Parquet table in the
        shared folder; later tables read the columns they need of it instead of
        recomputing its plan — a pipeline step writing its output."""
        self.__dict__[name] = written(getattr(self, name), name)
        return self.__dict__[name]

    def table(self, name: str) -> DataFrame:
        return read_table(self.spark, self.sf_dir, name)

    @cached_property
    def raw(self) -> DataFrame:
        return pitch_view(self.spark, self.sf_dir)

    @cached_property
    def clean(self) -> DataFrame:
        return clean.clean_pitches(self.raw)

    @cached_property
    def pitches(self) -> DataFrame:
        return pitches_with_rv(self.raw)

    def pitches_with(self, *extra: str, together=READ_TOGETHER) -> DataFrame:
        """``pitches`` with no more columns of the log than its steps read and
        ``extra``.  De-duplication keeps a row as one value that the optimizer
        cannot look into, so what nobody reads is left out before it."""
        if "pitches" in self.__dict__:      # written or planned whole already
            return self.pitches
        names = {*STEP_COLUMNS, *extra}
        if "post_bat_score" not in self.raw.columns:        # runs come from the other side's score
            names |= {"post_fld_score", "fld_score"}
        return pitches_with_rv(self.raw.select(*[c for c in self.raw.columns if c in names]), together=together)

    @cached_property
    def batter_counts(self) -> DataFrame:
        return profiles.batter_category_counts(self.raw)

    @cached_property
    def batter_profiles(self) -> DataFrame:
        return profiles.batter_profiles_from_counts(self.batter_counts)

    @cached_property
    def batter_wide(self) -> DataFrame:
        return profiles.batter_profiles_wide(self.batter_profiles)

    @cached_property
    def pitcher_profiles(self) -> DataFrame:
        return profiles.pitcher_profiles(self.raw)

    @cached_property
    def pitcher_arsenals(self) -> DataFrame:
        return profiles.pitcher_arsenals(self.pitcher_profiles)

    @cached_property
    def zone_long(self) -> DataFrame:
        return profiles.batter_zone_long(self.raw)

    @cached_property
    def zone_wide(self) -> DataFrame:
        return profiles.batter_zone_wide(self.zone_long)

    @cached_property
    def league_zones(self) -> DataFrame:
        return profiles.league_zone_stats(profiles._zone_counts(self.raw))

    def _features(self, together) -> DataFrame:
        return features.build_features(self.pitches_with(*features.LOG_COLUMNS, together=together), self.batter_wide, self.pitcher_profiles,
                                       self.zone_long, strict=self.strict)

    @cached_property
    def features(self) -> DataFrame:
        return self._features(READ_TOGETHER)

    @cached_property
    def whole_features(self) -> DataFrame:
        """``features`` for who reads columns of all steps: a pitch is moved to its copies as one value."""
        return self._features(READ_WHOLE)
