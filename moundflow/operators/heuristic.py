"""The archetype-based heuristic recommender,
run over a table of requests.

Per request the work is bounded by the pitcher's arsenal (a handful of
types): candidates are exploded rows ranked with small windows, the
sequence is built with higher-order array functions on that short list.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moundflow import constants as K
from moundflow.functions.pitch import fill, literal_map
from moundflow.operators.runvalue import run_expectancy
from moundflow.session import written


# E23 / J12 -----------------------------------------------------------------
def archetype_label(df: DataFrame) -> Column:
    """Label column; else the cluster's name (cluster_N beyond 0-4); else
    'Power Hitter' when hard-hit share > .48; else 'Unknown'."""
    cols = set(df.columns)
    parts = []
    if "label" in cols:
        parts.append(F.col("label"))
    if "cluster" in cols:
        cl = F.col("cluster").cast("long")
        parts.append(F.coalesce(F.try_element_at(literal_map(K.ARCHETYPE_CLUSTERS), cl.cast("int")),
                                F.concat(F.lit("cluster_"), cl.cast("string"))))
    if "pct_hard_hit" in cols:
        parts.append(F.when(F.col("pct_hard_hit") > K.POWER_HARD_HIT, F.lit("Power Hitter")))
    parts.append(F.lit("Unknown"))
    return F.coalesce(*parts)


#: Queries of up to so many characters are looked up whole.
GRAM = 12


def _grams(text: Column, n: int | Column) -> Column:
    """Distinct runs of n characters."""
    size, n = F.length(text), F.lit(n)
    return F.when(size >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), size - (n - 1)), lambda i: F.substring(text, i, n)))) \
        .otherwise(F.array().cast("array<string>"))


def _cut_for(queries: DataFrame, rows: DataFrame, first: int, last: int) -> DataFrame:
    """The rows once for each length ``_n`` from first to last that some query
    has; longer queries count as GRAM + 1."""
    sizes = queries.select(F.least(F.length("_q"), F.lit(GRAM + 1)).alias("_n")).distinct()      # GRAM + 2 rows at most
    return rows.withColumn("_n", F.explode(F.sequence(F.lit(first), F.lit(last)))).join(F.broadcast(sizes), "_n")


def _runs(queries: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows' runs ``_q`` of the lengths that queries of up to GRAM
    characters have: a query is met by equality, rows grow with the texts alone."""
    return _cut_for(queries, rows, 1, GRAM).withColumn("_q", F.explode(_grams(F.col("_text"), F.col("_n")))).drop("_n", "_text")


def _long_hits(queries: DataFrame, rows: DataFrame) -> DataFrame:
    """(query, row) pairs of queries of more than GRAM characters whose text
    is in the row's: a query is looked up by its rarest run of GRAM, and what
    meets there is verified.  Queries with a run that no row has match nothing."""
    long = queries.where(F.length("_q") > GRAM)
    # read for the counts and for the look-up, so written once; without such queries nothing is cut
    index = written(_cut_for(queries, rows, GRAM + 1, GRAM + 1).drop("_n").select("*", F.explode(_grams(F.col("_text"), GRAM)).alias("_g")), "runs")
    often = index.groupBy("_g").agg(F.count(F.lit(1)).alias("_often"))
    runs = _grams(F.col("_q"), GRAM)
    rarest = (long.select("_q", F.size(runs).alias("_all"), F.explode(runs).alias("_g")).join(often, "_g")
              .groupBy("_q", "_all").agg(F.count(F.lit(1)).alias("_n"), F.min_by("_g", F.struct("_often", "_g")).alias("_g"))
              .where(F.col("_n") == F.col("_all")).select("_q", "_g"))
    return rarest.join(index, "_g").where(F.contains("_text", "_q"))


def first_containing(queries: DataFrame, rows: DataFrame, value: str, line: str) -> DataFrame:
    """For each distinct ``_q`` the ``value`` of the row with the smallest
    ``line`` whose ``_text`` contains it, without comparing all pairs.  For
    queries of up to GRAM characters the index holds the answer itself, the
    first row of each run, and no list of rows; longer ones go by ``_long_hits``."""
    r = rows.select(F.col(line).alias("_line"), "_text", F.col(value).alias("_value"))
    short = _runs(queries, r).groupBy("_q").agg(F.min_by("_value", "_line").alias("_value"))
    long = _long_hits(queries, r).groupBy("_q").agg(F.min_by("_value", "_line").alias("_value"))
    return queries.where(F.length("_q") <= GRAM).select("_q").join(short, "_q").unionByName(long)


def all_containing(queries: DataFrame, rows: DataFrame) -> DataFrame:
    """For each distinct ``_q`` the sorted set ``_values`` of the few distinct
    ``_value`` of all rows whose ``_text`` contains it: short queries by the sets
    of each run, aggregated into the index, longer ones by verified rows."""
    short = _runs(queries, rows.select("_value", "_text"))
    found = (queries.where(F.length("_q") <= GRAM).select("_q").join(short.groupBy("_q").agg(F.collect_set("_value").alias("_values")), "_q")
             .unionByName(_long_hits(queries, rows).groupBy("_q").agg(F.collect_set("_value").alias("_values"))))
    return found.withColumn("_values", F.sort_array("_values"))


def match_archetypes(requests: DataFrame, archetypes: DataFrame, key: str = "batter", line: str | None = None) -> DataFrame:
    """The first archetype row with exactly that id; for misses, the first
    row any of whose values contains the query, case-insensitive; else
    'unknown' (also for a null key).  "First" is by ``line``, the position
    column of the file the table came from; without it by batter id and the
    row's text."""
    arch = archetypes.withColumn("_label", archetype_label(archetypes))
    values = F.concat_ws("\n", *[F.col(c).cast("string") for c in archetypes.columns if c != line])
    place = F.col(line) if line else F.struct("batter", values)
    arch = arch.select(F.col("batter").cast("string").alias("_q"), F.lower(values).alias("_text"), "_label", place.alias("_line"))
    arch = written(arch, "archetypes")      # read for ids and for runs
    exact = arch.filter(F.col("_q").rlike("^[0-9]+$")).groupBy("_q").agg(F.min_by("_label", "_line").alias("_exact"))
    q = requests.withColumn("_q", F.trim(F.col(key).cast("string")))
    q = q.join(exact, "_q", "left")
    misses = q.filter(F.col("_exact").isNull() & F.col("_q").isNotNull()).select(F.lower("_q").alias("_q")).distinct()
    hits = first_containing(written(misses.filter("_q <> ''"), "misses"), arch, "_label", "_line")
    # every row contains the empty query
    hits = hits.unionByName(arch.agg(F.lit("").alias("_q"), F.min_by("_label", "_line").alias("_value")))
    hits = hits.select(F.col("_q").alias("_lq"), F.col("_value").alias("_fuzzy"))
    q = q.join(hits, F.lower("_q") == F.col("_lq"), "left")
    return q.withColumn("archetype", F.coalesce("_exact", "_fuzzy", F.lit("unknown"))).drop("_q", "_exact", "_fuzzy", "_lq")


# E22 -----------------------------------------------------------------------
def heuristic_location(pitch: Column, archetype: Column, risp: Column) -> Column:
    p = F.upper(pitch)
    base = F.coalesce(F.try_element_at(literal_map(K.HEURISTIC_BASE_LOCATION), p), F.lit(K.HEURISTIC_DEFAULT_LOCATION))
    power, contact, patient = archetype.contains("Power"), archetype.contains("Contact"), archetype.contains("Patient")
    return (F.when(power & p.isin(*K.BREAKING_SET), F.lit("low-away"))
            .when(power & p.isin("FF", "FT"), F.lit("up-in"))
            .when(contact & p.isin("FF", "CT"), F.lit("edge-away"))
            .when(contact, base)
            .when(patient & p.isin(*K.PATIENT_SET), F.lit("middle-strike"))
            .when(patient, base)
            .when(F.coalesce(risp, F.lit(False)), F.regexp_replace(base, "up", "low"))
            .otherwise(base))


def pitch_score(pitch: Column, archetype: Column, two_out_bonus: Column) -> Column:
    p = F.upper(pitch)
    s = F.lit(1.0)
    s = s + F.when(archetype.contains("Power") & p.isin(*K.BREAKING_SET), K.SCORE_POWER).otherwise(0.0)
    s = s + F.when(archetype.contains("Contact") & p.isin(*K.CONTACT_SET), K.SCORE_CONTACT).otherwise(0.0)
    s = s + F.when(archetype.contains("Patient") & p.isin(*K.PATIENT_SET), K.SCORE_PATIENT).otherwise(0.0)
    s = s + F.when(two_out_bonus & p.isin(*K.TWO_OUT_SET), K.SCORE_TWO_OUT).otherwise(0.0)
    return s


def _risp(df: DataFrame) -> Column:
    """Runner on 2nd or 3rd, or the API's 'risp' flag (Q16)."""
    cols = set(df.columns)
    on = None
    for c in ("on_2b", "on_3b"):
        if c in cols:
            x = F.coalesce(F.col(c).cast("int") != 0, F.lit(False))
            on = x if on is None else on | x
    if "risp" in cols:
        on = F.col("risp") if on is None else on | F.coalesce(F.col("risp"), F.lit(False))
    return on if on is not None else F.lit(False)


def pitcher_lists(arsenal: DataFrame) -> DataFrame:
    """Old-form arsenal (pitcher, pitch_type) -> alphabetical list per pitcher."""
    return arsenal.groupBy("pitcher").agg(F.sort_array(F.collect_list("pitch_type")).alias("pitches"))


def _with_pitches(requests: DataFrame, arsenal: DataFrame) -> DataFrame:
    """J12, arsenal side: the pitcher's own types; for a pitcher without any, the
    types of all rows that contain the text of the id, case-insensitive; else the
    default list."""
    arsenal = written(arsenal.select("pitcher", "pitch_type"), "arsenal")
    j = requests.join(pitcher_lists(arsenal), "pitcher", "left")
    misses = j.where(F.col("pitches").isNull() & F.col("pitcher").isNotNull()).select(F.lower(F.col("pitcher").cast("string")).alias("_q")).distinct()
    texts = arsenal.select(F.lower(F.concat_ws("\n", F.col("pitcher").cast("string"), "pitch_type")).alias("_text"), F.col("pitch_type").alias("_value"))
    found = all_containing(written(misses.where("_q <> ''"), "misses"), texts)
    j = j.withColumn("_key", F.when(F.col("pitches").isNull(), F.lower(F.col("pitcher").cast("string"))))
    j = j.join(found, F.col("_key") == F.col("_q"), "left")
    dflt = F.array(*[F.lit(t) for t in K.HEURISTIC_DEFAULT_ARSENAL])
    return j.withColumn("pitches", F.coalesce("pitches", "_values", dflt)).drop("_key", "_q", "_values")


# R10 / R13 / R14 -----------------------------------------------------------
def next_pitch_candidates(requests: DataFrame, archetypes: DataFrame, arsenal: DataFrame, key: str = "batter") -> DataFrame:
    """Ranked candidates with percentage share, suggested location, score,
    the current run expectancy as 'RE after' (the heuristic predicts none)
    and a flag on the top share."""
    r = match_archetypes(requests, archetypes, key)
    r = _with_pitches(r, arsenal)
    r = r.withColumns({"_risp": _risp(r),
                       "_bonus": F.coalesce(F.col("late_inning"), F.lit(False)) & (F.coalesce(F.col("outs"), F.lit(0)) >= 2)})
    # the pitches of a request stand in its row, so shares and ranks need neither
    # a shuffle nor a sort of candidates; best score first, then by pitch
    ranked = F.sort_array(F.transform("pitches", lambda p: F.struct((-pitch_score(p, F.col("archetype"), F.col("_bonus"))).alias("k"), p.alias("pitch"))))
    r = r.select("request_id", "archetype", "_risp", run_expectancy("outs", "on_1b", "on_2b", "on_3b").alias("_re"), ranked.alias("_ranked"))
    r = r.withColumn("_total", F.aggregate("_ranked", F.lit(0.0), lambda a, x: a - x["k"]))
    share = lambda x: F.when(F.col("_total") > 0, -x["k"] / F.col("_total")).otherwise(1.0 / F.greatest(F.size("_ranked"), F.lit(1)))
    r = r.withColumn("_pcts", F.transform("_ranked", lambda x: F.bround(share(x) * 100, 1)))
    r = r.withColumn("_top", F.array_max("_pcts"))
    c = r.select("request_id", "archetype", "_risp", "_re", "_top", F.posexplode(F.arrays_zip("_ranked", "_pcts")).alias("_place", "_c"))
    pitch, pct = F.col("_c._ranked.pitch"), F.col("_c._pcts")
    return c.select("request_id", (F.col("_place") + 1).alias("rank"), pitch.alias("pitch"), pct.alias("pct"),
                    heuristic_location(pitch, F.col("archetype"), F.col("_risp")).alias("location"), F.round(-F.col("_c._ranked.k"), 3).alias("score"),
                    "archetype", F.round("_re", 2).alias("expected_after_re"), (pct == F.col("_top")).alias("is_top"))


def degraded_candidates(requests: DataFrame, arsenal: DataFrame) -> DataFrame:
    """Without the heuristic every type of the pitcher, or of the default
    list, has the same share, in the middle; the run expectancy after is the
    current one."""
    j = requests.join(pitcher_lists(arsenal), "pitcher", "left")
    pitches = F.when(F.size("pitches") > 0, F.col("pitches")).otherwise(F.array(*[F.lit(t) for t in K.HEURISTIC_FILL_ARSENAL]))
    c = j.withColumn("_n", F.size(pitches)).select("request_id", "_n", run_expectancy("outs", "on_1b", "on_2b", "on_3b").alias("_re"),
                                                   F.posexplode(pitches).alias("arsenal_pos", "pitch"))
    return c.select("request_id", (F.col("arsenal_pos") + 1).alias("rank"), "pitch", F.bround(F.lit(100.0) / F.col("_n"), 1).alias("pct"),
                    F.lit("middle").alias("location"), F.round("_re", 2).alias("expected_after_re"))


# R11 / E25 -----------------------------------------------------------------
def strategy_notes(archetype: Column, pitches: Column, count: Column, risp: Column) -> Column:
    return F.concat_ws(
        " ",
        fill(K.NOTE_ARCHETYPE, archetype),
        fill(K.NOTE_ARSENAL, F.array_join(pitches, ", ")),
        F.when(archetype.contains("Power"), F.lit(K.NOTE_POWER)),
        F.when(archetype.contains("Contact"), F.lit(K.NOTE_CONTACT)),
        F.when(archetype.contains("Patient"), F.lit(K.NOTE_PATIENT)),
        F.when(risp, F.lit(K.NOTE_RISP)),
        fill(K.NOTE_COUNT, count),
    )


def recommend_sequence(requests: DataFrame, archetypes: DataFrame, arsenal: DataFrame, seq_len: int = 3,
                       randomize: bool = False, key: str = "batter") -> DataFrame:
    """Primary / secondary / breaking tertiary sequence per request.

    Deterministic by default.  With ``randomize`` the fill beyond three
    pitches and the 15 % that are shuffled draw from hashes of the request id, so a
    rerun (or a retried task) gives the same answer.
    """
    r = match_archetypes(requests, archetypes, key)
    r = _with_pitches(r, arsenal)
    r = r.withColumns({"_risp": _risp(r), "_bonus": F.coalesce(F.col("outs"), F.lit(0)) >= 2})
    arch = F.col("archetype")
    ranked = F.sort_array(F.transform(
        F.col("pitches"),
        lambda p, i: F.struct((-pitch_score(p, arch, F.col("_bonus"))).alias("k"), i.alias("i"), p.alias("p"))))
    r = r.withColumn("_scored", F.transform(ranked, lambda x: x["p"]))
    scored = F.col("_scored")
    primary = scored[0]
    rest = F.filter(F.slice(scored, F.lit(2), F.size(scored)), lambda p: p != primary)
    secondary = F.coalesce(F.try_element_at(rest, F.lit(1)), primary)
    r = r.withColumns({"_p1": primary, "_p2": secondary})
    tert_pool = F.filter(scored, lambda p: (p != F.col("_p1")) & (p != F.col("_p2")) & F.upper(p).isin(*K.TERTIARY_SET))
    fallback = F.element_at(scored, F.least(F.lit(3), F.size(scored)))
    r = r.withColumn("_p3", F.coalesce(F.try_element_at(tert_pool, F.lit(1)), fallback))
    seq = F.slice(F.array("_p1", "_p2", "_p3"), 1, seq_len)
    if seq_len > 3:
        seed = F.xxhash64(F.col("request_id"))
        extra = F.transform(F.sequence(F.lit(1), F.lit(seq_len - 3)),
                            lambda k: F.element_at(scored, (F.pmod(seed + k, F.size(scored)) + 1).cast("int")))
        seq = F.concat(seq, extra)
    if randomize:
        shuffle = F.pmod(F.xxhash64(F.col("request_id"), F.lit("shuffle")), F.lit(100)) < int(K.SHUFFLE_PROBABILITY * 100)
        drawn = F.transform(F.array_sort(F.transform(seq, lambda p, i: F.struct(F.xxhash64(F.col("request_id"), i).alias("k"), i.alias("i"), p.alias("p")))),
                            lambda x: x["p"])
        seq = F.when(shuffle, drawn).otherwise(seq)
    r = r.withColumn("_seq", seq)
    n = F.size("pitches")
    breaking = F.exists("pitches", lambda p: F.upper(p).isin(*K.BREAKING_SET))
    conf = (F.lit(K.CONFIDENCE_BASE) + F.lit(K.CONFIDENCE_STEP) * F.least(F.lit(3), n)
            + F.when(arch.contains("Power") & breaking, K.CONFIDENCE_POWER).otherwise(0.0))
    out = r.select(
        "request_id", F.col("archetype").alias("batter_archetype"),
        *[F.try_element_at(F.col("_seq"), F.lit(i + 1)).alias(f"seq_{i + 1}") for i in range(seq_len)],
        *[heuristic_location(F.try_element_at(F.col("_seq"), F.lit(i + 1)), arch, F.col("_risp")).alias(f"loc_{i + 1}")
          for i in range(seq_len)],
        F.round(F.least(conf, F.lit(K.CONFIDENCE_CAP)), 2).alias("confidence"),
        strategy_notes(arch, F.col("pitches"), F.col("count_text"), F.col("_risp")).alias("strategy_notes"),
    )
    return out
