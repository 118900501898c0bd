"""Per-pitch scalar rules as native Column expressions (no Python UDFs).

Every function takes Columns (or column names) and returns a Column, so the
rules run inside whole-stage codegen and can be shared by the batch, the
feature and the scoring paths.
"""
from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from moundflow import constants as K


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def fill(template: str, *values) -> Column:
    """A fixed text template with '{}' slots filled by Columns."""
    parts = template.split("{}")
    out = [F.lit(parts[0])]
    for v, p in zip(values, parts[1:]):
        out += [_c(v), F.lit(p)]
    return F.concat(*out)


def literal_map(d: dict) -> Column:
    """A literal MapType column from a small constant dict."""
    return F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in d.items()))


# E1 ------------------------------------------------------------------------
def pitch_category(pitch_type) -> Column:
    """FB / BR / OS from the pitch-type code (upper-cased); else UNKNOWN."""
    pt = F.upper(_c(pitch_type))
    return F.coalesce(F.try_element_at(literal_map(K.PITCH_CATEGORIES), pt), F.lit(K.UNKNOWN_CATEGORY))


def pitch_category_or_null(pitch_type) -> Column:
    """As ``pitch_category`` but null stays null (used for the previous pitch)."""
    return F.when(_c(pitch_type).isNotNull(), pitch_category(pitch_type))


# E2 ------------------------------------------------------------------------
def bases_state(on_1b, on_2b, on_3b) -> Column:
    """Three-character occupancy string, e.g. '101'; input is any 0/1 or null."""
    def occ(c):
        c = _c(c)
        return F.when(F.coalesce(c.cast("double"), F.lit(0.0)) != 0, F.lit("1")).otherwise(F.lit("0"))
    return F.concat(occ(on_1b), occ(on_2b), occ(on_3b))


def occupied(runner_id) -> Column:
    """Runner id -> 1 if present (id 0 counts as present) else 0."""
    return _c(runner_id).isNotNull().cast("int")


def clamp(col, lo, hi) -> Column:
    return F.least(F.greatest(_c(col), F.lit(lo)), F.lit(hi))


# E4 ------------------------------------------------------------------------
def count_delta(balls, strikes, outcome) -> Column:
    """Run-value delta of one pitch's count change (defined by the reference,
    never used by its run value)."""
    b = clamp(F.coalesce(_c(balls).cast("int"), F.lit(0)), 0, 3)
    s = clamp(F.coalesce(_c(strikes).cast("int"), F.lit(0)), 0, 2)
    key = F.concat_ws("-", b.cast("string"), s.cast("string"))
    ball = literal_map({f"{k[0]}-{k[1]}": v for k, v in K.COUNT_DELTA_BALL.items()})
    strike = literal_map({f"{k[0]}-{k[1]}": v for k, v in K.COUNT_DELTA_STRIKE.items()})
    o = _c(outcome)
    return (
        F.when(o == "ball", F.coalesce(F.try_element_at(ball, key), F.lit(0.03)))
        .when(o.isin(*K.STRIKE_WORDS), F.coalesce(F.try_element_at(strike, key), F.lit(-0.04)))
        .when((o == "foul") & (s < 2), F.coalesce(F.try_element_at(strike, key), F.lit(-0.04)))
        .otherwise(F.lit(0.0))
    )


# E5 / E6 -------------------------------------------------------------------
def regress_to_mean(observed, n, mean, threshold) -> Column:
    """k = threshold/4, w = n/(n+k); n <= 0 (or null) -> mean."""
    n = _c(n).cast("double")
    k = float(threshold) / 4.0
    w = n / (n + F.lit(k))
    m = mean if isinstance(mean, Column) else F.lit(float(mean))
    return F.when(F.coalesce(n, F.lit(0.0)) <= 0, m).otherwise(w * _c(observed) + (F.lit(1.0) - w) * m)


def safe_divide(num, den, default=0.0) -> Column:
    """default when the denominator is 0 or null (ANSI-safe)."""
    den = _c(den)
    return F.when(den.isNull() | (den == 0), F.lit(float(default))).otherwise(F.try_divide(_c(num), den))


# E7 ------------------------------------------------------------------------
def whiff_rate(whiffs, swings, default=0.0) -> Column:
    """Missed swings of all swings."""
    return safe_divide(whiffs, swings, default)


def chase_rate(chases, out_of_zone, default=0.0) -> Column:
    """Swings at pitches outside the zone of all such pitches."""
    return safe_divide(chases, out_of_zone, default)


def zone_contact_rate(zone_contact, zone_swings, default=0.0) -> Column:
    """Contacts of all swings at pitches in the zone."""
    return safe_divide(zone_contact, zone_swings, default)


# E8 ------------------------------------------------------------------------
def league_average(category, stat: str) -> Column:
    """League average of ``stat`` for a category; unknown category -> FB."""
    m = literal_map({c: v[stat] for c, v in K.LEAGUE_AVERAGES.items()})
    return F.coalesce(F.try_element_at(m, _c(category)), F.lit(K.LEAGUE_AVERAGES["FB"][stat]))


# E9 ------------------------------------------------------------------------
def outcome_class(description, events) -> Column:
    """Seven outcome classes, ordered substring rules (case-insensitive)."""
    d = F.lower(_c(description))
    e = F.lower(_c(events))
    hit = e.contains("single") | e.contains("double") | e.contains("triple") | e.contains("home_run")
    return (
        F.when(d.isNull(), F.lit("other"))
        .when(d.contains("ball") & ~d.contains("foul"), F.lit("ball"))
        .when(d.contains("called_strike"), F.lit("called_strike"))
        .when(d.contains("swinging_strike") | d.contains("missed_bunt"), F.lit("swinging_strike"))
        .when(d.contains("foul"), F.lit("foul"))
        .when(d.contains("in_play") | d.contains("hit_into"),
              F.when(F.coalesce(hit, F.lit(False)), F.lit("in_play_hit")).otherwise(F.lit("in_play_out")))
        .otherwise(F.lit("other"))
    )


def _contains_any(description, words) -> Column:
    d = F.lower(_c(description))
    cond = None
    for w in words:
        cond = d.contains(w) if cond is None else (cond | d.contains(w))
    return F.coalesce(cond, F.lit(False))


# E10 / E11 / E12 / E13 -----------------------------------------------------
def is_swing(description) -> Column:
    return _contains_any(description, ["swing", "foul", "in_play", "hit_into", "missed_bunt"])


def is_contact(description) -> Column:
    return _contains_any(description, ["foul", "in_play", "hit_into"])


def is_in_zone(zone) -> Column:
    # int(zone) in 1..9  <=>  1 <= zone < 10 (truncation toward zero)
    z = _c(zone).cast("string").try_cast("double")
    return F.coalesce((z >= 1) & (z < 10), F.lit(False))


def is_strike(description) -> Column:
    return F.coalesce(_c(description).rlike("(?i)strike|foul"), F.lit(False))


# E15 -----------------------------------------------------------------------
def is_groundball(launch_angle) -> Column:
    return F.coalesce(_c(launch_angle), F.lit(999.0)) < 10


def is_batted_ball(launch_speed) -> Column:
    return _c(launch_speed).isNotNull()


def outcome_flags(df, description="description", zone="zone"):
    """Swing / zone / contact / whiff / chase / zone-swing / zone-contact /
    called-strike flags, added in one projection."""
    sw, iz, ct = is_swing(description), is_in_zone(zone), is_contact(description)
    return df.withColumns({
        "is_swing": sw,
        "is_in_zone": iz,
        "is_contact": ct,
        "is_whiff": sw & ~ct,
        "is_chase": sw & ~iz,
        "is_zone_swing": sw & iz,
        "is_zone_contact": ct & iz,
    })


# E20 / E21 -----------------------------------------------------------------
def parse_count(text, clamp_values: bool = True):
    """'b-s' -> (balls, strikes); bad text -> (0, 0); clamped 0..3 / 0..2."""
    t = _c(text)
    ok = t.contains("-")
    parts = F.split(t, "-", 2)
    b = F.trim(F.element_at(parts, 1)).try_cast("int")
    s = F.trim(F.try_element_at(parts, F.lit(2))).try_cast("int")
    good = ok & b.isNotNull() & s.isNotNull()
    b = F.when(good, b).otherwise(F.lit(0))
    s = F.when(good, s).otherwise(F.lit(0))
    if clamp_values:
        b, s = clamp(b, 0, 3), clamp(s, 0, 2)
    return b, s


def count_adjusted_re(base_re, balls, strikes) -> Column:
    """Run expectancy nudged by count favourability."""
    re, b, s = _c(base_re), _c(balls), _c(strikes)
    adj = (F.when(s > b, -K.COUNT_ADJ_AHEAD * re * (s - b) / 2)
           .when(b > s, K.COUNT_ADJ_BEHIND * re * (b - s) / 3)
           .otherwise(F.lit(0.0)))
    adj = (F.when((b == 3) & (s < 2), K.COUNT_ADJ_EXTREME * re)
           .when((s == 2) & (b < 2), -K.COUNT_ADJ_EXTREME * re)
           .when((b == 3) & (s == 2), F.lit(0.0))
           .otherwise(adj))
    return re + adj
