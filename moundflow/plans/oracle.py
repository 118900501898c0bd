"""Independent SQL (DuckDB dialect) for the correctness oracle.

Each registered query's SQL is ``WITH <needed CTEs> SELECT <normalised
columns> FROM <final CTE>``.  The CTEs restate the published rules in plain
SQL — windows, grouped aggregates, CASE — separately from the DataFrame code,
so a mismatch points at a real difference.  Output columns are normalised the
same way on both sides (``moundflow.plans.spec``).
"""
from __future__ import annotations

from moundflow import constants as K
from moundflow.sources.pitch_view import pitch_view_sql


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_category(col: str) -> str:
    whens = " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in K.PITCH_CATEGORIES.items())
    return f"(CASE upper({col}) {whens} ELSE 'UNKNOWN' END)"


def sql_has(col: str, *words: str) -> str:
    return "coalesce(" + " OR ".join(f"strpos(lower({col}), {_q(w)}) > 0" for w in words) + ", false)"


def sql_swing(col="description"):
    return sql_has(col, "swing", "foul", "in_play", "hit_into", "missed_bunt")


def sql_contact(col="description"):
    return sql_has(col, "foul", "in_play", "hit_into")


def sql_in_zone(col="zone"):
    return f"coalesce({col} >= 1 AND {col} < 10, false)"


def sql_league(cat: str, stat: str) -> str:
    whens = " ".join(f"WHEN {_q(c)} THEN {v[stat]}" for c, v in K.LEAGUE_AVERAGES.items())
    return f"(CASE {cat} {whens} ELSE {K.LEAGUE_AVERAGES['FB'][stat]} END)"


def sql_outcome(d="description", e="events"):
    ld, le = f"lower({d})", f"lower({e})"
    hit = sql_has(e, "single", "double", "triple", "home_run")
    return (f"(CASE WHEN {d} IS NULL THEN 'other' "
            f"WHEN strpos({ld}, 'ball') > 0 AND strpos({ld}, 'foul') = 0 THEN 'ball' "
            f"WHEN strpos({ld}, 'called_strike') > 0 THEN 'called_strike' "
            f"WHEN strpos({ld}, 'swinging_strike') > 0 OR strpos({ld}, 'missed_bunt') > 0 THEN 'swinging_strike' "
            f"WHEN strpos({ld}, 'foul') > 0 THEN 'foul' "
            f"WHEN strpos({ld}, 'in_play') > 0 OR strpos({ld}, 'hit_into') > 0 THEN "
            f"(CASE WHEN {hit} THEN 'in_play_hit' ELSE 'in_play_out' END) ELSE 'other' END)")


def _re_values() -> str:
    return ", ".join(f"({o}, {_q(b)}, {v})" for (o, b), v in K.RUN_EXPECTANCY.items())


def sql_shrink(obs: str, n: str, mean: str, threshold: float) -> str:
    k = threshold / 4.0
    w = f"(({n}) / (({n}) + {k}))"
    return f"(CASE WHEN coalesce({n}, 0) <= 0 THEN {mean} ELSE {w} * ({obs}) + (1 - {w}) * {mean} END)"


def sql_safe_div(a: str, b: str, default: float = 0.0) -> str:
    return f"(CASE WHEN ({b}) IS NULL OR ({b}) = 0 THEN {default} ELSE ({a}) / ({b}) END)"


# ---------------------------------------------------------------------------
# CTE registry: name -> (sql, dependencies)
# ---------------------------------------------------------------------------
CTES: dict[str, tuple[str, list[str]]] = {}


def cte(name: str, deps: list[str], sql: str) -> None:
    CTES[name] = (sql, deps)


cte("raw", [], pitch_view_sql())
cte("re24", [], f"SELECT * FROM (VALUES {_re_values()}) AS t(o, b, v)")
cte("zones", [], "SELECT CAST(range AS INTEGER) AS zone FROM range(1, 15)")

# C1-C4
cte("clean", ["raw"], """
SELECT * EXCLUDE (rn) FROM (
  SELECT * REPLACE (
      CASE WHEN on_1b IS NULL THEN 0 ELSE 1 END AS on_1b,
      CASE WHEN on_2b IS NULL THEN 0 ELSE 1 END AS on_2b,
      CASE WHEN on_3b IS NULL THEN 0 ELSE 1 END AS on_3b),
    row_number() OVER (PARTITION BY game_pk, at_bat_number, pitch_number ORDER BY src_key) AS rn
  FROM raw
  WHERE pitcher IS NOT NULL AND batter IS NOT NULL AND pitch_type IS NOT NULL AND description IS NOT NULL
) WHERE rn = 1""")

# W1-W3, J6
cte("rv0", ["clean"], """
SELECT *, CAST(on_1b AS VARCHAR) || CAST(on_2b AS VARCHAR) || CAST(on_3b AS VARCHAR) AS bases_state,
       least(greatest(coalesce(CAST(outs_when_up AS INTEGER), 0), 0), 2) AS outs
FROM clean""")
cte("rv1", ["rv0"], """
SELECT *, lead(outs) OVER w AS nx_outs, lead(bases_state) OVER w AS nx_bases
FROM rv0 WINDOW w AS (PARTITION BY game_pk, inning, inning_topbot ORDER BY game_date, at_bat_number, pitch_number)""")
cte("rv", ["rv1", "re24"], """
SELECT rv1.* EXCLUDE (nx_outs, nx_bases), coalesce(rb.v, 0.0) AS re_before,
  CASE WHEN nx_outs IS NULL OR (outs = 2 AND nx_outs = 0) OR nx_outs >= 3 THEN 0.0 ELSE coalesce(ra.v, 0.0) END AS re_after,
  coalesce(CAST(post_bat_score - bat_score AS DOUBLE), 0.0) AS runs_on_play,
  (CASE WHEN nx_outs IS NULL OR (outs = 2 AND nx_outs = 0) OR nx_outs >= 3 THEN 0.0 ELSE coalesce(ra.v, 0.0) END)
    - coalesce(rb.v, 0.0) + coalesce(CAST(post_bat_score - bat_score AS DOUBLE), 0.0) AS run_value
FROM rv1 LEFT JOIN re24 rb ON rb.o = rv1.outs AND rb.b = rv1.bases_state
         LEFT JOIN re24 ra ON ra.o = rv1.nx_outs AND ra.b = rv1.nx_bases""")

# Streaks by the difference-of-row-numbers method
cte("sq0", ["rv"], f"""
SELECT *,
  lag(pitch_type) OVER a AS last_pitch_type,
  lag(description) OVER a AS last_pitch_result,
  lag(release_speed) OVER a AS last_pitch_speed,
  lag(zone) OVER a AS last_pitch_zone,
  row_number() OVER a AS pitch_num_in_ab,
  {sql_category('pitch_type')} AS pitch_category,
  row_number() OVER a - row_number() OVER (PARTITION BY game_pk, at_bat_number, pitch_type ORDER BY game_date, pitch_number) AS isl
FROM rv WINDOW a AS (PARTITION BY game_pk, at_bat_number ORDER BY game_date, pitch_number)""")
cte("seq", ["sq0"], f"""
SELECT * EXCLUDE (isl),
  CASE WHEN last_pitch_type IS NULL THEN NULL ELSE {sql_category('last_pitch_type')} END AS last_pitch_category,
  release_speed - last_pitch_speed AS speed_delta,
  {sql_in_zone('last_pitch_zone')} AS last_pitch_in_zone,
  sum(CASE WHEN pitch_category = 'FB' THEN 1 ELSE 0 END) OVER r AS FB_count_in_ab,
  sum(CASE WHEN pitch_category = 'BR' THEN 1 ELSE 0 END) OVER r AS BR_count_in_ab,
  sum(CASE WHEN pitch_category = 'OS' THEN 1 ELSE 0 END) OVER r AS OS_count_in_ab,
  CASE WHEN pitch_type = last_pitch_type THEN 1 ELSE 0 END AS same_as_last,
  row_number() OVER (PARTITION BY game_pk, at_bat_number, pitch_type, isl ORDER BY game_date, pitch_number) - 1 AS consecutive_same_pitch,
  {sql_outcome()} AS outcome_class,
  {sql_swing()} AS is_swing,
  {sql_in_zone()} AS is_in_zone,
  {sql_contact()} AS is_contact,
  {sql_swing()} AND NOT {sql_contact()} AS is_whiff,
  {sql_swing()} AND NOT {sql_in_zone()} AS is_chase,
  {sql_outcome()} = 'called_strike' AS is_called_strike
FROM sq0 WINDOW r AS (PARTITION BY game_pk, at_bat_number ORDER BY game_date, pitch_number
                      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")

# A1-A3
cte("b_in", ["raw"], f"""
SELECT *, {sql_category('pitch_type')} AS pitch_category, {sql_swing()} AS sw, {sql_contact()} AS ct,
       {sql_in_zone()} AS iz
FROM raw WHERE pitch_type IS NOT NULL AND batter IS NOT NULL""")
cte("bcounts", ["b_in"], """
SELECT batter, pitch_category, count(pitch_type) AS total_pitches,
  sum(CASE WHEN sw THEN 1 ELSE 0 END) AS swings,
  sum(CASE WHEN sw AND NOT ct THEN 1 ELSE 0 END) AS whiffs,
  sum(CASE WHEN NOT iz THEN 1 ELSE 0 END) AS out_of_zone,
  sum(CASE WHEN sw AND NOT iz THEN 1 ELSE 0 END) AS chases,
  sum(CASE WHEN sw AND iz THEN 1 ELSE 0 END) AS zone_swings,
  sum(CASE WHEN ct AND iz THEN 1 ELSE 0 END) AS zone_contact,
  sum(CASE WHEN launch_speed IS NOT NULL THEN 1 ELSE 0 END) AS batted_balls,
  sum(CASE WHEN coalesce(launch_angle, 999) < 10 THEN 1 ELSE 0 END) AS groundballs,
  coalesce(sum(estimated_woba_using_speedangle), 0.0) AS xwoba_sum,
  count(estimated_woba_using_speedangle) AS xwoba_count
FROM b_in WHERE pitch_category IN ('FB', 'BR', 'OS') GROUP BY batter, pitch_category""")
cte("bprof0", ["bcounts"], f"""
SELECT *,
  {sql_safe_div('whiffs', 'swings')} AS whiff_rate_raw,
  {sql_safe_div('chases', 'out_of_zone')} AS chase_rate_raw,
  {sql_safe_div('zone_contact', 'zone_swings')} AS zone_contact_rate_raw,
  {sql_safe_div('groundballs', 'batted_balls')} AS gb_rate_raw,
  {sql_safe_div('xwoba_sum', 'xwoba_count', K.XWOBA_RAW_DEFAULT)} AS xwoba_raw
FROM bcounts""")
cte("bprof1", ["bprof0"], f"""
SELECT *,
  {sql_shrink('whiff_rate_raw', 'swings', sql_league('pitch_category', 'whiff_rate'), 100)} AS whiff_rate,
  {sql_shrink('chase_rate_raw', 'out_of_zone', sql_league('pitch_category', 'chase_rate'), 100)} AS chase_rate,
  {sql_shrink('zone_contact_rate_raw', 'zone_swings', sql_league('pitch_category', 'zone_contact_rate'), 80)} AS zone_contact_rate,
  {sql_shrink('gb_rate_raw', 'batted_balls', sql_league('pitch_category', 'gb_rate'), 50)} AS gb_rate,
  {sql_shrink('xwoba_raw', 'xwoba_count', sql_league('pitch_category', 'xwoba'), 50)} AS xwoba
FROM bprof0""")
cte("bprof", ["bprof1"], """
SELECT batter, pitch_category, total_pitches, swings, whiff_rate, chase_rate, zone_contact_rate, gb_rate, xwoba,
  (1 - whiff_rate) * 0.3 + (1 - chase_rate) * 0.2 + zone_contact_rate * 0.2 + xwoba * 0.3 AS vulnerability_score,
  whiff_rate_raw, chase_rate_raw, zone_contact_rate_raw
FROM bprof1""")


def _bwide_sql() -> str:
    cols = []
    for s in ["whiff_rate", "chase_rate", "zone_contact_rate", "gb_rate", "xwoba", "vulnerability_score", "total_pitches"]:
        for c in K.CATEGORIES:
            v = f"max(CASE WHEN pitch_category = '{c}' THEN {s} END)"
            if s in K.PROFILE_STATS:
                v = f"coalesce({v}, {K.LEAGUE_AVERAGES[c][s]})"
            cols.append(f"{v} AS {s}_vs_{c}")
    return "SELECT batter, " + ", ".join(cols) + " FROM bprof GROUP BY batter"


cte("bwide", ["bprof"], _bwide_sql())

# A4-A7
cte("p_in", ["raw"], f"""
SELECT *, {sql_swing()} AS sw, {sql_contact()} AS ct, {sql_has('description', 'strike', 'foul')} AS st
FROM raw WHERE pitch_type IS NOT NULL AND pitcher IS NOT NULL AND p_throws IS NOT NULL""")
cte("pagg", ["p_in"], f"""
SELECT pitcher, p_throws, pitch_type, count(pitch_type) AS total_pitches,
  avg(release_speed) AS avg_velo, stddev_samp(release_speed) AS std_velo, avg(release_spin_rate) AS avg_spin,
  avg(pfx_x) AS avg_pfx_x, avg(pfx_z) AS avg_pfx_z,
  sum(CASE WHEN sw THEN 1 ELSE 0 END) AS swings, sum(CASE WHEN sw AND NOT ct THEN 1 ELSE 0 END) AS whiffs,
  sum(CASE WHEN st THEN 1 ELSE 0 END) AS strikes, avg(plate_x) AS avg_plate_x, avg(plate_z) AS avg_plate_z
FROM p_in GROUP BY pitcher, p_throws, pitch_type HAVING count(pitch_type) >= {K.MIN_PITCHES_PER_TYPE}""")
cte("pprof0", ["pagg"], f"""
SELECT *, {sql_safe_div('whiffs', 'swings')} AS whiff_rate, {sql_safe_div('strikes', 'total_pitches')} AS strike_rate,
  {sql_category('pitch_type')} AS pitch_category,
  total_pitches / sum(total_pitches) OVER (PARTITION BY pitcher) AS usage_rate,
  max(CASE WHEN {sql_category('pitch_type')} = 'FB' THEN avg_velo END) OVER (PARTITION BY pitcher) AS fb_velo
FROM pagg""")
cte("pprof", ["pprof0"], "SELECT *, fb_velo - avg_velo AS velo_diff_from_fb FROM pprof0")
cte("pars", ["pprof"], """
SELECT pitcher,
  first(p_throws ORDER BY usage_rate DESC, pitch_type, p_throws) AS p_throws,
  count(*) AS num_pitch_types,
  string_agg(pitch_type, ',' ORDER BY usage_rate DESC, pitch_type, p_throws) AS pitch_types,
  first(pitch_type ORDER BY usage_rate DESC, pitch_type, p_throws) FILTER (WHERE pitch_category = 'FB') AS primary_fb,
  max(avg_velo) FILTER (WHERE pitch_category = 'FB') AS fb_velo,
  first(pitch_type ORDER BY whiff_rate DESC, usage_rate DESC, pitch_type) FILTER (WHERE pitch_category <> 'FB') AS best_secondary,
  first(whiff_rate ORDER BY whiff_rate DESC, usage_rate DESC, pitch_type) FILTER (WHERE pitch_category <> 'FB') AS best_secondary_whiff
FROM pprof GROUP BY pitcher""")

# A8-A11
cte("z_in", ["raw"], f"""
SELECT *, {sql_swing()} AS sw, {sql_contact()} AS ct FROM raw WHERE zone IS NOT NULL AND batter IS NOT NULL""")
cte("zlg0", ["z_in"], """
SELECT zone, count(*) AS n, sum(CASE WHEN sw THEN 1 ELSE 0 END) AS swings,
  sum(CASE WHEN sw AND NOT ct THEN 1 ELSE 0 END) AS wh, sum(CASE WHEN sw AND ct THEN 1 ELSE 0 END) AS con,
  avg(estimated_woba_using_speedangle) AS xw
FROM z_in WHERE zone BETWEEN 1 AND 14 GROUP BY zone""")
cte("zlg", ["zones", "zlg0"], """
SELECT z.zone,
  CASE WHEN n > 100 AND swings > 0 AND wh / swings <> 0 THEN wh / swings ELSE 0.25 END AS lg_whiff_rate,
  CASE WHEN n > 100 AND swings > 0 AND con / swings <> 0 THEN con / swings ELSE 0.75 END AS lg_contact_rate,
  CASE WHEN n > 100 THEN swings / n ELSE 0.5 END AS lg_swing_rate,
  CASE WHEN n > 100 THEN xw ELSE 0.32 END AS lg_xwoba
FROM zones z LEFT JOIN zlg0 l ON l.zone = z.zone""")
cte("zb0", ["z_in"], """
SELECT batter, zone, count(*) AS n, sum(CASE WHEN sw THEN 1 ELSE 0 END) AS swings,
  sum(CASE WHEN sw AND ct THEN 1 ELSE 0 END) AS contacts, avg(estimated_woba_using_speedangle) AS xw
FROM z_in GROUP BY batter, zone""")
cte("zchase", ["z_in"], """
SELECT batter, count(*) AS cn, sum(CASE WHEN sw THEN 1 ELSE 0 END) AS csw
FROM z_in WHERE zone IN (11, 12, 13, 14) GROUP BY batter""")
cte("zlong", ["z_in", "zones", "zb0", "zlg", "zchase"], """
SELECT b.batter, z.zone,
  CASE WHEN coalesce(s.n, 0) < 5 THEN l.lg_whiff_rate
       ELSE (s.n / (s.n + 20.0)) * (CASE WHEN s.swings > 0 THEN 1 - s.contacts / s.swings ELSE 0.0 END)
            + (1 - s.n / (s.n + 20.0)) * l.lg_whiff_rate END AS whiff_rate,
  CASE WHEN coalesce(s.n, 0) < 5 THEN l.lg_contact_rate
       ELSE (s.n / (s.n + 20.0)) * (CASE WHEN s.swings > 0 THEN s.contacts / s.swings ELSE 0.0 END)
            + (1 - s.n / (s.n + 20.0)) * l.lg_contact_rate END AS contact_rate,
  CASE WHEN coalesce(s.n, 0) < 5 THEN l.lg_swing_rate
       ELSE (s.n / (s.n + 20.0)) * (s.swings / s.n) + (1 - s.n / (s.n + 20.0)) * l.lg_swing_rate END AS swing_rate,
  CASE WHEN coalesce(s.n, 0) < 5 THEN l.lg_xwoba
       ELSE (s.n / (s.n + 20.0)) * coalesce(s.xw, l.lg_xwoba) + (1 - s.n / (s.n + 20.0)) * l.lg_xwoba END AS xwoba,
  CASE WHEN coalesce(s.n, 0) < 5 THEN 0 ELSE s.n END AS pitches,
  CASE WHEN coalesce(c.cn, 0) > 0 THEN (c.cn / (c.cn + 20.0)) * (c.csw / c.cn) + (1 - c.cn / (c.cn + 20.0)) * 0.30
       ELSE 0.30 END AS chase_rate_overall
FROM (SELECT DISTINCT batter FROM z_in) b CROSS JOIN zones z
LEFT JOIN zb0 s ON s.batter = b.batter AND s.zone = z.zone
JOIN zlg l ON l.zone = z.zone
LEFT JOIN zchase c ON c.batter = b.batter""")


def _zwide_sql() -> str:
    cols = []
    for z in K.ZONES:
        for s in K.ZONE_STATS + ["pitches"]:
            cols.append(f"max(CASE WHEN zone = {z} THEN {s} END) AS zone_{z}_{s}")
    return "SELECT batter, " + ", ".join(cols) + ", max(chase_rate_overall) AS chase_rate_overall FROM zlong GROUP BY batter"


cte("zwide", ["zlong"], _zwide_sql())


# ---------------------------------------------------------------------------
def with_ctes(final_sql: str, needed: list[str]) -> str:
    """Assemble ``WITH`` + the needed CTEs (dependencies first) + final SQL."""
    order: list[str] = []

    def visit(n):
        if n in order:
            return
        for d in CTES[n][1]:
            visit(d)
        order.append(n)

    for n in needed:
        visit(n)
    head = "WITH RECURSIVE " if "fold" in order else "WITH "
    return head + ",\n".join(f"{n} AS ({CTES[n][0]})" for n in order) + "\n" + final_sql


# ---------------------------------------------------------------------------
# Feature table
# ---------------------------------------------------------------------------
def _this_cat(stat: str, cat: str = "f0.pitch_category") -> str:
    pick = " ".join(f"WHEN '{c}' THEN {stat}_vs_{c}" for c in K.CATEGORIES)
    return f"coalesce(CASE {cat} {pick} END, {sql_league(cat, stat)})"


def _bucket(col: str, edges, labels) -> str:
    parts = " ".join(f"WHEN {col} > {lo} AND {col} <= {hi} THEN '{lab}'"
                     for lo, hi, lab in zip(edges[:-1], edges[1:], labels))
    return f"(CASE {parts} ELSE NULL END)"


cte("f0", ["seq", "bwide"], "SELECT s.*, w.* EXCLUDE (batter) FROM seq s LEFT JOIN bwide w ON w.batter = s.batter")
cte("f1", ["f0", "pprof"], "SELECT f0.*, "
    + ", ".join(f"{_this_cat(s)} AS batter_{s}_vs_this_cat" for s in K.PROFILE_STATS) + ", "
    + ", ".join(f"p.{c} AS pitcher_{c}" for c in ["avg_velo", "std_velo", "avg_spin", "avg_pfx_x", "avg_pfx_z",
                                                 "whiff_rate", "strike_rate", "usage_rate", "velo_diff_from_fb"])
    + " FROM f0 LEFT JOIN pprof p ON p.pitcher = f0.pitcher AND p.p_throws = f0.p_throws AND p.pitch_type = f0.pitch_type")
cte("f2", ["f1", "zlong"], f"""
SELECT f1.*, {_bucket('plate_x', K.H_EDGES, K.H_LABELS)} AS loc_horizontal,
  {_bucket('plate_z', K.V_EDGES, K.V_LABELS)} AS loc_vertical,
  CASE WHEN f1.zone >= 1 AND f1.zone <= 9 THEN 1 ELSE 0 END AS in_zone,
  CASE WHEN f1.zone BETWEEN 1 AND 14 THEN zl.swing_rate ELSE 0.5 END AS batter_swing_rate_at_zone,
  CASE WHEN f1.zone BETWEEN 1 AND 14 THEN zl.whiff_rate ELSE 0.25 END AS batter_whiff_rate_at_zone,
  CASE WHEN f1.zone BETWEEN 1 AND 14 THEN zl.contact_rate ELSE 0.75 END AS batter_contact_rate_at_zone,
  CASE WHEN f1.zone BETWEEN 1 AND 14 THEN zl.xwoba ELSE 0.32 END AS batter_xwoba_at_zone
FROM f1 LEFT JOIN (SELECT batter, zone, swing_rate, whiff_rate, contact_rate, xwoba FROM zlong) zl
  ON zl.batter = f1.batter AND zl.zone = f1.zone""")
cte("f3", ["f2"], """
SELECT * REPLACE (least(greatest(coalesce(CAST(outs_when_up AS INTEGER), 0), 0), 2) AS outs),
  CASE WHEN stand = p_throws THEN 1 ELSE 0 END AS same_hand,
  CASE WHEN stand = p_throws THEN 0 ELSE 1 END AS platoon_advantage,
  coalesce(balls, 0) AS count_balls, coalesce(strikes, 0) AS count_strikes,
  CASE WHEN strikes > balls THEN 1 ELSE 0 END AS is_ahead_in_count,
  CASE WHEN balls > strikes THEN 1 ELSE 0 END AS is_behind_in_count,
  CASE WHEN strikes = 2 THEN 1 ELSE 0 END AS is_two_strikes,
  CASE WHEN balls = 3 THEN 1 ELSE 0 END AS is_three_balls,
  CASE WHEN balls = 3 AND strikes = 2 THEN 1 ELSE 0 END AS is_full_count,
  CASE WHEN balls = 0 AND strikes = 0 THEN 1 ELSE 0 END AS is_first_pitch,
  least(greatest(on_1b + on_2b + on_3b, 0), 3) AS runners_on,
  CASE WHEN on_2b = 1 OR on_3b = 1 THEN 1 ELSE 0 END AS risp,
  CASE WHEN on_1b + on_2b + on_3b = 0 THEN 1 ELSE 0 END AS bases_empty,
  CASE WHEN on_1b + on_2b + on_3b >= 3 THEN 1 ELSE 0 END AS bases_loaded,
  CASE WHEN least(greatest(coalesce(CAST(outs_when_up AS INTEGER), 0), 0), 2) = 2 THEN 1 ELSE 0 END AS is_two_outs,
  fld_score - bat_score AS score_diff,
  CASE WHEN abs(fld_score - bat_score) <= 2 THEN 1 ELSE 0 END AS is_close_game,
  coalesce(inning, 1) AS inning_num,
  CASE WHEN coalesce(inning, 1) >= 7 THEN 1 ELSE 0 END AS is_late_inning
FROM f2""")
cte("features", ["f3"], """
SELECT *,
  coalesce(batter_whiff_rate_vs_this_cat * pitcher_whiff_rate, 0.0) AS whiff_interaction,
  batter_chase_rate_vs_this_cat * is_ahead_in_count AS chase_opportunity,
  coalesce(abs(pitcher_velo_diff_from_fb), 0.0) AS speed_change_magnitude,
  is_two_strikes * batter_whiff_rate_vs_this_cat AS two_strike_whiff_boost
FROM f3""")


# ---------------------------------------------------------------------------
# A12-A21, J8
# ---------------------------------------------------------------------------
def sql_count_text(b="balls", s="strikes"):
    return f"(CAST(CAST({b} AS BIGINT) AS VARCHAR) || '-' || CAST(CAST({s} AS BIGINT) AS VARCHAR))"


def sql_outcome10(d="description", e="events"):
    oc = sql_outcome(d, e)
    return (f"(CASE WHEN {oc} IN ('ball', 'called_strike', 'swinging_strike', 'foul') THEN {oc} "
            f"WHEN {oc} IN ('in_play_hit', 'in_play_out') THEN (CASE lower({e}) WHEN 'single' THEN '1B' "
            f"WHEN 'double' THEN '2B' WHEN 'triple' THEN '3B' WHEN 'home_run' THEN 'HR' ELSE 'inplay_out' END) "
            f"WHEN lower({d}) = 'hit_by_pitch' THEN 'HBP' ELSE NULL END)")


cte("arsenal12", ["raw"], """
SELECT DISTINCT CAST(pitcher AS BIGINT) AS pitcher, pitch_type FROM raw
WHERE pitcher IS NOT NULL AND pitch_type IS NOT NULL""")
cte("matchup", ["seq"], """
SELECT batter, pitch_type, p_throws, avg(woba_value) AS batter_pitchtype_woba,
  CASE WHEN sum(CASE WHEN is_swing THEN 1 ELSE 0 END) = 0 THEN 0.0
       ELSE sum(CASE WHEN is_swing AND NOT is_contact THEN 1 ELSE 0 END) / sum(CASE WHEN is_swing THEN 1 ELSE 0 END) END
    AS batter_pitchtype_whiff_rate,
  avg(run_value) AS batter_pitchtype_run_value, count(*) AS n
FROM seq WHERE batter IS NOT NULL AND pitch_type IS NOT NULL AND p_throws IS NOT NULL
GROUP BY batter, pitch_type, p_throws""")
cte("top3", ["arsenal12"], """
SELECT * FROM (
  SELECT row_number() OVER (ORDER BY pitchers DESC, pitch_type) AS rank, pitch_type, pitchers
  FROM (SELECT pitch_type, count(*) AS pitchers FROM arsenal12 GROUP BY pitch_type) c
) WHERE rank <= 3
UNION ALL
SELECT * FROM (VALUES (1, 'FF', NULL), (2, 'SL', NULL), (3, 'CU', NULL)) d(rank, pitch_type, pitchers)
WHERE NOT EXISTS (SELECT 1 FROM arsenal12)""")
cte("summary", ["seq"], """
SELECT count(*) AS pitches, count(DISTINCT pitcher) AS pitchers, count(DISTINCT batter) AS batters,
  min(game_date) AS first_date, max(game_date) AS last_date, count(run_value) AS rv_count,
  avg(run_value) AS rv_mean, stddev_samp(run_value) AS rv_std, min(run_value) AS rv_min,
  quantile_cont(run_value, 0.25) AS rv_p25, quantile_cont(run_value, 0.5) AS rv_p50,
  quantile_cont(run_value, 0.75) AS rv_p75, max(run_value) AS rv_max
FROM seq""")
cte("rvstats", ["seq"], """
SELECT avg(run_value) AS rv_mean, stddev_samp(run_value) AS rv_std, sum(runs_on_play) AS runs_total,
  sum(CASE WHEN runs_on_play > 0 THEN 1 ELSE 0 END) AS scoring_plays FROM seq""")
cte("rvloc", ["features"], """
SELECT loc_horizontal, loc_vertical, GROUPING(loc_horizontal, loc_vertical) AS level,
  avg(run_value) AS mean_rv, count(*) AS pitches
FROM features GROUP BY GROUPING SETS ((loc_horizontal), (loc_vertical), (loc_horizontal, loc_vertical))""")
def _best_locations(features: str) -> str:
    return f"""
WITH cells AS (
  SELECT pitch_type, loc_horizontal || '-' || loc_vertical AS cell, avg(run_value) AS mean_rv
  FROM {features} WHERE loc_horizontal IS NOT NULL AND loc_vertical IS NOT NULL
  GROUP BY pitch_type, loc_horizontal, loc_vertical),
r AS (SELECT *, row_number() OVER (PARTITION BY pitch_type ORDER BY mean_rv, cell) AS rb,
             row_number() OVER (PARTITION BY pitch_type ORDER BY mean_rv DESC, cell) AS rw FROM cells)
SELECT b.pitch_type, b.cell AS best_location, b.mean_rv AS best_rv, w.cell AS worst_location, w.mean_rv AS worst_rv
FROM r b JOIN r w ON w.pitch_type = b.pitch_type AND w.rw = 1 WHERE b.rb = 1"""


cte("bestloc", ["features"], _best_locations("features"))
cte("baseline", ["seq"], f"""
SELECT CASE WHEN GROUPING("count") = 1 THEN '*' ELSE "count" END AS "count",
  CASE WHEN GROUPING(pitch_type) = 1 THEN '*' ELSE pitch_type END AS pitch_type,
  CASE WHEN GROUPING(zone) = 1 THEN '*' ELSE zone END AS zone,
  CASE WHEN GROUPING(p_throws) = 1 THEN '*' ELSE p_throws END AS p_throws,
  CASE WHEN GROUPING(stand) = 1 THEN '*' ELSE stand END AS stand,
  GROUPING("count", pitch_type, zone, p_throws, stand) AS level, avg(run_value) AS rv, count(*) AS n
FROM (SELECT {sql_count_text()} AS "count", pitch_type, CAST(CAST(zone AS BIGINT) AS VARCHAR) AS zone,
             p_throws, stand, run_value FROM seq) s
GROUP BY ROLLUP ("count", pitch_type, zone, p_throws, stand)""")


def sql_backoff(src: str, count: str, pitch: str, zone: str, hand: str, stand: str) -> str:
    """Four left joins against levels of the rollup table; first hit wins."""
    return f"""
SELECT {src}.*,
  coalesce(b0.rv, b3.rv, b7.rv, b15.rv) AS baseline_rv,
  CASE WHEN b0.rv IS NOT NULL THEN 'full' WHEN b3.rv IS NOT NULL THEN 'zone'
       WHEN b7.rv IS NOT NULL THEN 'pitch' WHEN b15.rv IS NOT NULL THEN 'count' END AS baseline_level
FROM {src}
LEFT JOIN (SELECT * FROM baseline WHERE level = 0) b0 ON b0."count" = {count} AND b0.pitch_type = {pitch}
  AND b0.zone = {zone} AND b0.p_throws = {hand} AND b0.stand = {stand}
LEFT JOIN (SELECT * FROM baseline WHERE level = 3) b3 ON b3."count" = {count} AND b3.pitch_type = {pitch} AND b3.zone = {zone}
LEFT JOIN (SELECT * FROM baseline WHERE level = 7) b7 ON b7."count" = {count} AND b7.pitch_type = {pitch}
LEFT JOIN (SELECT * FROM baseline WHERE level = 15) b15 ON b15."count" = {count}"""


cte("seqc", ["seq"], f"SELECT *, {sql_count_text()} AS \"count\", CAST(CAST(zone AS BIGINT) AS VARCHAR) AS zone_s FROM seq")
cte("backoff", ["seqc", "baseline"], sql_backoff("seqc", 'seqc."count"', "seqc.pitch_type", "seqc.zone_s",
                                                 "seqc.p_throws", "seqc.stand"))
cte("outcome_rv", ["seq"], f"""
SELECT outcome, "count", avg(run_value) AS rv, count(*) AS n FROM (
  SELECT {sql_outcome10()} AS outcome, {sql_count_text()} AS "count", run_value FROM seq) s
WHERE outcome IS NOT NULL GROUP BY outcome, "count" """)
cte("outcome_dist", ["seq"], f"""
SELECT "count", pitch_type, outcome, n, n / sum(n) OVER (PARTITION BY "count", pitch_type) AS p FROM (
  SELECT "count", pitch_type, outcome, count(*) AS n FROM (
    SELECT {sql_outcome10()} AS outcome, {sql_count_text()} AS "count", pitch_type FROM seq) s
  WHERE outcome IS NOT NULL GROUP BY "count", pitch_type, outcome) g""")


# ---------------------------------------------------------------------------
# Recommendations (no-model path), heuristic, count rules
# ---------------------------------------------------------------------------
from moundflow.sources.requests import archetypes_sql, requests_sql  # noqa: E402


def _d(v: float) -> str:
    """A DOUBLE literal with the exact bits of the Python float."""
    return f"{v!r}E0"


def sql_re(outs: str, b1: str, b2: str, b3: str) -> str:
    bases = f"(CASE WHEN coalesce({b1}, 0) <> 0 THEN '1' ELSE '0' END || CASE WHEN coalesce({b2}, 0) <> 0 THEN '1' ELSE '0' END || CASE WHEN coalesce({b3}, 0) <> 0 THEN '1' ELSE '0' END)"
    o = f"least(greatest(coalesce(CAST({outs} AS INTEGER), 0), 0), 2)"
    return f"coalesce((SELECT v FROM re24 WHERE re24.o = {o} AND re24.b = {bases}), 0.0)"


cte("req", [], requests_sql())
cte("ars", ["pprof"], "SELECT pitcher, list(pitch_type ORDER BY usage_rate DESC, pitch_type, p_throws) AS lst FROM pprof GROUP BY pitcher")
cte("rc", ["req", "ars"], f"""
SELECT * EXCLUDE (l), unnest(l) AS pitch_type, unnest(range(len(l))) AS arsenal_pos FROM (
  SELECT r.*, coalesce(a.lst, {['FF', 'SL', 'CH']}) AS l FROM req r LEFT JOIN ars a ON a.pitcher = r.pitcher) x""")


def _bstat(stat: str, cat: str) -> str:
    parts = " ".join(f"WHEN '{c}' THEN coalesce(w.{stat}_vs_{c}, {K.LEAGUE_AVERAGES[c][stat]})" for c in K.CATEGORIES)
    return f"(CASE {cat} {parts} ELSE {K.BATTER_THIS_CAT_DEFAULTS[stat]} END)"


cte("rb", ["rc", "bwide"], f"""
SELECT rc.*, {sql_category('rc.pitch_type')} AS category,
  {_bstat('whiff_rate', sql_category('rc.pitch_type'))} AS bw,
  {_bstat('chase_rate', sql_category('rc.pitch_type'))} AS bc,
  {_bstat('xwoba', sql_category('rc.pitch_type'))} AS bx
FROM rc LEFT JOIN bwide w ON w.batter = rc.batter""")


def _thr(key: str) -> str:
    from moundflow.operators.recommend import THRESHOLDS
    parts = " ".join(f"WHEN '{c}' THEN {_d(THRESHOLDS[c][key])}" for c in K.CATEGORIES)
    return f"(CASE category {parts} ELSE {_d(THRESHOLDS['FB'][key])} END)"


def sql_fill(template: str, *values: str) -> str:
    """A fixed text template with '{}' slots filled by SQL expressions."""
    parts = template.split("{}")
    out = [_q(parts[0])]
    for v, p in zip(values, parts[1:]):
        out += [f"({v})", _q(p)]
    return "(" + " || ".join(out) + ")"


def _pct(x: str) -> str:
    return f"(CAST(CAST(round_even({x} * 100, 0) AS BIGINT) AS VARCHAR) || '%')"


cte("rs", ["rb", "re24"], f"""
SELECT *, exp(-rv - max(-rv) OVER (PARTITION BY request_id)) AS e FROM (
  SELECT *, {_d(K.NO_MODEL_RV_INTERCEPT)} - bw * {_d(K.NO_MODEL_RV_SLOPE)} AS rv,
    {sql_re('outs', 'on_1b', 'on_2b', 'on_3b')} AS current_re FROM rb) s""")
cte("recommend", ["rs"], f"""
SELECT request_id, row_number() OVER (PARTITION BY request_id ORDER BY p DESC, arsenal_pos) AS rank,
  pitch_type, category, rv AS predicted_rv, current_re + rv AS expected_re_after,
  p AS probability, p * 100 AS probability_pct, bw AS batter_whiff_rate, bc AS batter_chase_rate, bx AS batter_xwoba,
  CASE WHEN txt = '' THEN {_q(K.REASON_DEFAULT)} ELSE txt END AS reasoning,
  0.0 AS loc_plate_x, 2.3E0 AS loc_plate_z, 8 AS loc_zone, TRUE AS loc_in_zone, 0.0 AS loc_expected_rv,
  'middle-mid' AS location_label
FROM (
  SELECT *, e / sum(e) OVER (PARTITION BY request_id) AS p,
    concat_ws('; ',
      CASE WHEN bw > {_thr('whiff_hi')} THEN {sql_fill(K.REASON_HIGH_WHIFF, 'category', _pct('bw'))}
           WHEN bw < {_thr('whiff_lo')} THEN {sql_fill(K.REASON_GOOD_CONTACT, 'category')} END,
      CASE WHEN bc > {_thr('chase_hi')} THEN {sql_fill(K.REASON_CHASES, 'category', _pct('bc'))} END,
      CASE WHEN bx < {_d(K.REASON_XWOBA_LOW)} THEN {sql_fill(K.REASON_WEAK_CONTACT, "printf('%.3f', bx)")}
           WHEN bx > {_d(K.REASON_XWOBA_HIGH)} THEN {sql_fill(K.REASON_DANGEROUS, "printf('%.3f', bx)")} END,
      CASE WHEN strikes = 2 AND category IN ('BR', 'OS') THEN {_q(K.REASON_PUT_AWAY)} END,
      CASE WHEN balls = 3 AND category = 'FB' THEN {_q(K.REASON_NEED_STRIKE)} END) AS txt
  FROM rs) t""")
cte("legacy", ["recommend"], """
SELECT g.*, m.predictions FROM (
  SELECT request_id, first(pitch_type ORDER BY rank) AS best_pitch, first(predicted_rv ORDER BY rank) AS best_rv,
    count(*) AS options FROM recommend GROUP BY request_id) g
JOIN (SELECT request_id, string_agg(pitch_type || ':' || CAST(CAST(floor(predicted_rv * 1000000.0 + 0.501) AS BIGINT) AS VARCHAR), ',' ORDER BY pitch_type)
  AS predictions FROM (SELECT DISTINCT request_id, pitch_type, predicted_rv FROM recommend) d GROUP BY request_id) m USING (request_id)""")


def _arch_label() -> str:
    names = " ".join(f"WHEN {k} THEN '{v}'" for k, v in K.ARCHETYPE_CLUSTERS.items())
    return (f"coalesce(label, CASE CAST(cluster AS BIGINT) {names} ELSE 'cluster_' || CAST(CAST(cluster AS BIGINT) AS VARCHAR) END, "
            f"CASE WHEN pct_hard_hit > {_d(K.POWER_HARD_HIT)} THEN 'Power Hitter' END, 'Unknown')")


cte("arch", ["raw"], archetypes_sql("SELECT batter FROM raw"))
cte("hreq", ["req", "arch"], f"""
SELECT r.*, coalesce(a.lbl, f.lbl, 'unknown') AS archetype,
  coalesce(r.on_2b <> 0, false) OR coalesce(r.on_3b <> 0, false) AS risp
FROM req r LEFT JOIN (SELECT CAST(batter AS VARCHAR) AS q, {_arch_label()} AS lbl FROM arch) a
  ON a.q = trim(r.batter_query)
LEFT JOIN (SELECT q, min_by(lbl, batter) AS lbl FROM (SELECT DISTINCT lower(trim(batter_query)) AS q FROM req) u
  JOIN (SELECT batter, {_arch_label()} AS lbl, lower(concat_ws(chr(10), CAST(batter AS VARCHAR), CAST(cluster AS VARCHAR), label,
    CAST(pct_hard_hit AS VARCHAR))) AS txt FROM arch) t ON contains(t.txt, u.q) GROUP BY q) f ON f.q = lower(trim(r.batter_query))""")
cte("hlist", ["arsenal12"], "SELECT pitcher, list(pitch_type ORDER BY pitch_type) AS pitches FROM arsenal12 GROUP BY pitcher")
cte("hfuzzy", ["hreq", "hlist", "arsenal12"], """
SELECT m.pitcher, list(DISTINCT a.pitch_type ORDER BY a.pitch_type) AS pitches
FROM (SELECT DISTINCT pitcher FROM hreq WHERE pitcher NOT IN (SELECT pitcher FROM hlist)) m
JOIN arsenal12 a ON contains(CAST(a.pitcher AS VARCHAR), CAST(m.pitcher AS VARCHAR)) OR contains(lower(a.pitch_type), CAST(m.pitcher AS VARCHAR))
GROUP BY m.pitcher""")
cte("hc", ["hreq", "hlist", "hfuzzy"], f"""
SELECT h.*, coalesce(l.pitches, y.pitches, {K.HEURISTIC_DEFAULT_ARSENAL}) AS pitches FROM hreq h LEFT JOIN hlist l ON l.pitcher = h.pitcher
LEFT JOIN hfuzzy y ON y.pitcher = h.pitcher""")


def _in(col: str, items) -> str:
    return f"upper({col}) IN (" + ", ".join(f"'{i}'" for i in items) + ")"


def _score(p: str, bonus: str) -> str:
    return (f"(1.0E0 + CASE WHEN strpos(archetype, 'Power') > 0 AND {_in(p, K.BREAKING_SET)} THEN {_d(K.SCORE_POWER)} ELSE 0.0E0 END"
            f" + CASE WHEN strpos(archetype, 'Contact') > 0 AND {_in(p, K.CONTACT_SET)} THEN {_d(K.SCORE_CONTACT)} ELSE 0.0E0 END"
            f" + CASE WHEN strpos(archetype, 'Patient') > 0 AND {_in(p, K.PATIENT_SET)} THEN {_d(K.SCORE_PATIENT)} ELSE 0.0E0 END"
            f" + CASE WHEN ({bonus}) AND {_in(p, K.TWO_OUT_SET)} THEN {_d(K.SCORE_TWO_OUT)} ELSE 0.0E0 END)")


def _hloc(p: str) -> str:
    base_parts = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in K.HEURISTIC_BASE_LOCATION.items())
    base = f"(CASE upper({p}) {base_parts} ELSE '{K.HEURISTIC_DEFAULT_LOCATION}' END)"
    return (f"(CASE WHEN strpos(archetype, 'Power') > 0 AND {_in(p, K.BREAKING_SET)} THEN 'low-away' "
            f"WHEN strpos(archetype, 'Power') > 0 AND {_in(p, ['FF', 'FT'])} THEN 'up-in' "
            f"WHEN strpos(archetype, 'Contact') > 0 AND {_in(p, ['FF', 'CT'])} THEN 'edge-away' "
            f"WHEN strpos(archetype, 'Contact') > 0 THEN {base} "
            f"WHEN strpos(archetype, 'Patient') > 0 AND {_in(p, K.PATIENT_SET)} THEN 'middle-strike' "
            f"WHEN strpos(archetype, 'Patient') > 0 THEN {base} "
            f"WHEN risp THEN replace({base}, 'up', 'low') ELSE {base} END)")


cte("hx", ["hc", "re24"], f"""
SELECT *, {_score('pitch', "coalesce(late_inning, false) AND coalesce(outs, 0) >= 2")} AS score,
  round({sql_re('outs', 'on_1b', 'on_2b', 'on_3b')}, 2) AS expected_after_re
FROM (SELECT *, unnest(pitches) AS pitch FROM hc) u""")
cte("hcand", ["hx"], f"""
SELECT *, pct = max(pct) OVER (PARTITION BY request_id) AS is_top FROM (
  SELECT request_id, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, pitch) AS rank, pitch,
    round_even(score / sum(score) OVER (PARTITION BY request_id) * 100, 1) AS pct, {_hloc('pitch')} AS location,
    round(score, 3) AS score, archetype, expected_after_re
  FROM hx) t""")
cte("hs", ["hc"], f"""
SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY {_score('pitch', 'coalesce(outs, 0) >= 2')} DESC, pos) AS r2,
  len(pitches) AS n
FROM (SELECT *, unnest(pitches) AS pitch, unnest(range(len(pitches))) AS pos FROM hc) u""")
cte("hseq1", ["hs"], """
SELECT request_id, max(CASE WHEN r2 = 1 THEN pitch END) AS p1 FROM hs GROUP BY request_id""")
cte("hseq2", ["hs", "hseq1"], """
SELECT hs.request_id, any_value(p1) AS p1,
  coalesce(first(pitch ORDER BY r2) FILTER (WHERE r2 > 1 AND pitch <> p1), any_value(p1)) AS p2
FROM hs JOIN hseq1 USING (request_id) GROUP BY hs.request_id""")
cte("hseq", ["hs", "hseq2", "hc"], f"""
SELECT h.request_id, h.archetype AS batter_archetype, s.p1 AS seq_1, s.p2 AS seq_2, s.p3 AS seq_3,
  {_hloc('s.p1')} AS loc_1, {_hloc('s.p2')} AS loc_2, {_hloc('s.p3')} AS loc_3,
  round(least({_d(K.CONFIDENCE_BASE)} + {_d(K.CONFIDENCE_STEP)} * least(3, len(h.pitches))
    + CASE WHEN strpos(h.archetype, 'Power') > 0
                AND len(list_filter(h.pitches, lambda x: upper(x) IN ('SL', 'CU', 'KC'))) > 0
           THEN {_d(K.CONFIDENCE_POWER)} ELSE 0.0E0 END, {_d(K.CONFIDENCE_CAP)}), 2) AS confidence,
  concat_ws(' ', {sql_fill(K.NOTE_ARCHETYPE, 'h.archetype')},
    {sql_fill(K.NOTE_ARSENAL, "array_to_string(h.pitches, ', ')")},
    CASE WHEN strpos(h.archetype, 'Power') > 0 THEN {_q(K.NOTE_POWER)} END,
    CASE WHEN strpos(h.archetype, 'Contact') > 0 THEN {_q(K.NOTE_CONTACT)} END,
    CASE WHEN strpos(h.archetype, 'Patient') > 0 THEN {_q(K.NOTE_PATIENT)} END,
    CASE WHEN h.risp THEN {_q(K.NOTE_RISP)} END,
    {sql_fill(K.NOTE_COUNT, 'h.count_text')}) AS strategy_notes
FROM hc h JOIN (
  SELECT x.request_id, any_value(x.p1) AS p1, any_value(x.p2) AS p2,
    coalesce(first(hs.pitch ORDER BY hs.r2) FILTER (WHERE hs.pitch <> x.p1 AND hs.pitch <> x.p2
                                                   AND upper(hs.pitch) IN ('SL', 'CU', 'KC', 'CH')),
             max(CASE WHEN hs.r2 = least(3, hs.n) THEN hs.pitch END)) AS p3
  FROM hseq2 x JOIN hs ON hs.request_id = x.request_id GROUP BY x.request_id) s ON s.request_id = h.request_id""")


def _parse_count(text: str, clamp: bool) -> tuple[str, str]:
    b = f"TRY_CAST(trim(split_part({text}, '-', 1)) AS INTEGER)"
    s = f"TRY_CAST(trim(split_part({text}, '-', 2)) AS INTEGER)"
    good = f"(strpos({text}, '-') > 0 AND {b} IS NOT NULL AND {s} IS NOT NULL)"
    bb, ss = f"(CASE WHEN {good} THEN {b} ELSE 0 END)", f"(CASE WHEN {good} THEN {s} ELSE 0 END)"
    if clamp:
        bb, ss = f"least(greatest({bb}, 0), 3)", f"least(greatest({ss}, 0), 2)"
    return bb, ss


_bc, _sc = _parse_count("count_text", True)
_bu, _su = _parse_count("count_text", False)
cte("countre", ["req", "re24"], f"""
SELECT request_id, count_text, bc AS balls_clamped, sc AS strikes_clamped, base_re,
  base_re + (CASE WHEN bu = 3 AND su < 2 THEN 0.15E0 * base_re
                  WHEN su = 2 AND bu < 2 THEN -0.15E0 * base_re
                  WHEN bu = 3 AND su = 2 THEN 0.0E0
                  WHEN su > bu THEN -0.1E0 * base_re * (su - bu) / 2
                  WHEN bu > su THEN 0.1E0 * base_re * (bu - su) / 3 ELSE 0.0E0 END) AS current_re
FROM (SELECT request_id, count_text, {_bc} AS bc, {_sc} AS sc, {_bu} AS bu, {_su} AS su,
        {sql_re('outs', 'on_1b', 'on_2b', 'on_3b')} AS base_re FROM req) t""")


def _delta_values() -> str:
    rows = [(f"{b}-{s}", v, K.COUNT_DELTA_STRIKE[(b, s)]) for (b, s), v in K.COUNT_DELTA_BALL.items()]
    return ", ".join(f"('{k}', {_d(vb)}, {_d(vs)})" for k, vb, vs in rows)


cte("cdelta", [], f"SELECT * FROM (VALUES {_delta_values()}) t(k, vb, vs)")
cte("countdelta", ["seq", "cdelta"], f"""
SELECT game_pk, at_bat_number, pitch_number, outcome_class,
  CASE WHEN outcome_class = 'ball' THEN coalesce(d.vb, 0.03E0)
       WHEN outcome_class IN ('strike', 'swinging_strike', 'called_strike') THEN coalesce(d.vs, -0.04E0)
       WHEN outcome_class = 'foul' AND least(greatest(coalesce(CAST(strikes AS INTEGER), 0), 0), 2) < 2 THEN coalesce(d.vs, -0.04E0)
       ELSE 0.0E0 END AS count_delta
FROM seq LEFT JOIN cdelta d ON d.k = CAST(least(greatest(coalesce(CAST(balls AS INTEGER), 0), 0), 3) AS VARCHAR) || '-'
                              || CAST(least(greatest(coalesce(CAST(strikes AS INTEGER), 0), 0), 2) AS VARCHAR)""")

cte("ecand", ["req", "arsenal12", "zones", "pars"], f"""
SELECT r.request_id, {sql_count_text('r.balls', 'r.strikes')} AS "count",
  CASE WHEN r.request_id % 13 = 0 AND z.zone = 1 THEN 'KN' ELSE a.pitch_type END AS pitch_type, z.zone,
  coalesce(pa.p_throws, 'R') AS p_throws, r.stand
FROM req r JOIN arsenal12 a ON a.pitcher = r.pitcher
CROSS JOIN (SELECT zone FROM zones WHERE zone <= 9) z
LEFT JOIN pars pa ON pa.pitcher = r.pitcher""")
cte("eprv", ["outcome_dist", "outcome_rv"], """
SELECT d."count", d.pitch_type, sum(d.p * coalesce(o.rv, 0.0)) AS raw_eprv
FROM outcome_dist d LEFT JOIN outcome_rv o ON o.outcome = d.outcome AND o."count" = d."count"
GROUP BY d."count", d.pitch_type""")
cte("eprv_count", ["outcome_dist", "outcome_rv"], """
SELECT g."count", sum(g.n * coalesce(o.rv, 0.0)) / sum(g.n) AS raw_eprv
FROM (SELECT "count", outcome, sum(n) AS n FROM outcome_dist GROUP BY "count", outcome) g
LEFT JOIN outcome_rv o ON o.outcome = g.outcome AND o."count" = g."count" GROUP BY g."count" """)
cte("ecand2", ["ecand", "eprv", "eprv_count"], """
SELECT c.*, coalesce(e.raw_eprv, ec.raw_eprv) AS raw_eprv, CAST(CAST(c.zone AS BIGINT) AS VARCHAR) AS zone_s
FROM ecand c LEFT JOIN eprv e ON e."count" = c."count" AND e.pitch_type = c.pitch_type
LEFT JOIN eprv_count ec ON ec."count" = c."count" """)
cte("ecand3", ["ecand2", "baseline"], sql_backoff("ecand2", 'ecand2."count"', "ecand2.pitch_type", "ecand2.zone_s",
                                                  "ecand2.p_throws", "ecand2.stand"))
cte("eprv_best", ["ecand3"], """
SELECT n.request_id, b.pitch_type AS best_pitch, b.zone AS best_zone, b.raw_eprv, b.baseline_rv, b.rvaa, n.candidates
FROM (SELECT request_id, count(*) AS candidates FROM ecand3 GROUP BY request_id) n
LEFT JOIN (
  SELECT * FROM (
    SELECT *, raw_eprv - baseline_rv AS rvaa,
      row_number() OVER (PARTITION BY request_id ORDER BY raw_eprv - baseline_rv, raw_eprv, pitch_type, zone) AS k
    FROM ecand3 WHERE raw_eprv - baseline_rv IS NOT NULL) s WHERE k = 1) b ON b.request_id = n.request_id""")
cte("mlookup", ["req", "arsenal12", "pars", "matchup"], """
SELECT r.request_id, a.pitch_type, coalesce(pa.p_throws, 'R') AS p_throws,
  coalesce(m.batter_pitchtype_woba, 0.0) AS batter_pitchtype_woba,
  coalesce(m.batter_pitchtype_whiff_rate, 0.0) AS batter_pitchtype_whiff_rate,
  coalesce(m.batter_pitchtype_run_value, 0.0) AS batter_pitchtype_run_value
FROM req r JOIN arsenal12 a ON a.pitcher = r.pitcher LEFT JOIN pars pa ON pa.pitcher = r.pitcher
LEFT JOIN matchup m ON m.batter = r.batter AND m.pitch_type = a.pitch_type AND m.p_throws = coalesce(pa.p_throws, 'R')""")


# ---------------------------------------------------------------------------
# W10, A22, A23, A26 (predictions from the deterministic no-model rule)
# ---------------------------------------------------------------------------
cte("w10", ["features"], f"""
SELECT *, CASE WHEN time_rank < floor(n_total * {_d(K.SPLIT_TRAIN)}) THEN 'train'
               WHEN time_rank < floor(n_total * {_d(K.SPLIT_TRAIN + K.SPLIT_VAL)}) THEN 'val' ELSE 'test' END AS split
FROM (SELECT *, row_number() OVER (ORDER BY game_date, game_pk, at_bat_number, pitch_number) - 1 AS time_rank,
             count(*) OVER () AS n_total
      FROM features WHERE run_value IS NOT NULL) t""")
cte("w10p", ["w10"], f"""
SELECT *, {_d(K.NO_MODEL_RV_INTERCEPT)} - batter_whiff_rate_vs_this_cat * {_d(K.NO_MODEL_RV_SLOPE)} AS prediction FROM w10""")
cte("a22", ["w10p"], """
SELECT split, count(*) AS n, avg((run_value - prediction) * (run_value - prediction)) AS mse,
  sqrt(avg((run_value - prediction) * (run_value - prediction))) AS rmse, avg(abs(run_value - prediction)) AS mae,
  1 - sum((run_value - prediction) * (run_value - prediction)) / sum((run_value - ybar) * (run_value - ybar)) AS r2,
  1 - sum((run_value - prediction - ebar) * (run_value - prediction - ebar)) / sum((run_value - ybar) * (run_value - ybar))
    AS explained_variance
FROM (SELECT *, avg(run_value) OVER (PARTITION BY split) AS ybar,
             avg(run_value - prediction) OVER (PARTITION BY split) AS ebar FROM w10p) t
GROUP BY split""")
cte("a23", ["w10p"], """
SELECT avg(CASE WHEN model_rv < avg_rv THEN 1.0E0 ELSE 0.0E0 END) * 100 AS pct_better_than_avg,
  avg(avg_rv - model_rv) AS avg_rv_improvement, count(*) AS at_bats
FROM (SELECT game_pk, at_bat_number, first(run_value ORDER BY prediction, pitch_number) AS model_rv,
        avg(run_value) AS avg_rv, count(*) AS n
      FROM w10p WHERE split = 'test' GROUP BY game_pk, at_bat_number) ab
WHERE n >= 2""")
cte("a26", ["seq", "pprof"], """
SELECT least(floor(p.whiff_rate * 10), 9) AS bin, avg(p.whiff_rate) AS mean_predicted,
  avg(CASE WHEN s.is_whiff THEN 1.0E0 ELSE 0.0E0 END) AS observed_rate, count(*) AS n
FROM seq s JOIN pprof p ON p.pitcher = s.pitcher AND p.p_throws = s.p_throws AND p.pitch_type = s.pitch_type
GROUP BY least(floor(p.whiff_rate * 10), 9)""")


# ---------------------------------------------------------------------------
# At-bat fold as a recursive CTE
# ---------------------------------------------------------------------------
from moundflow.sources.requests import atbat_log_sql  # noqa: E402


def _step_sql(pb: str, ps: str, po: str, p1: str, p2: str, p3: str) -> str:
    nb = f"(CASE WHEN outcome = 'Ball' THEN least(4, {pb} + 1) ELSE {pb} END)"
    ns = (f"(CASE WHEN outcome IN ('Called Strike', 'Swinging Strike') THEN least(3, {ps} + 1) "
          f"WHEN outcome = 'Foul' AND {ps} < 2 THEN {ps} + 1 ELSE {ps} END)")
    ip = "starts_with(outcome, 'In play')"
    out = "(strpos(outcome, 'out') > 0)"
    ended = f"({nb} >= 4 OR {ns} >= 3 OR {ip})"
    b = f"(CASE WHEN {ended} THEN 0 ELSE {nb} END)"
    s = f"(CASE WHEN {ended} THEN 0 ELSE {ns} END)"
    return (f"CAST({pb} AS VARCHAR) || '-' || CAST({ps} AS VARCHAR) AS count_before, "
            f"{b} AS b, {s} AS s, "
            f"least(2, {po} + CASE WHEN {ns} >= 3 THEN 1 ELSE 0 END + CASE WHEN {ip} AND {out} THEN 1 ELSE 0 END) AS outs_after, "
            f"CASE WHEN {ip} AND NOT {out} AND strpos(outcome, 'home run') > 0 THEN false "
            f"WHEN {ip} AND NOT {out} AND strpos(outcome, 'single') > 0 THEN true ELSE {p1} END AS on_1b, "
            f"CASE WHEN {ip} AND NOT {out} AND strpos(outcome, 'home run') > 0 THEN false "
            f"WHEN {ip} AND NOT {out} AND strpos(outcome, 'double') > 0 THEN true ELSE {p2} END AS on_2b, "
            f"CASE WHEN {ip} AND NOT {out} AND strpos(outcome, 'home run') > 0 THEN false ELSE {p3} END AS on_3b, "
            f"{ended} AS at_bat_ended, NOT {ended} AS at_bat_active")


cte("alog", [], f"""
SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts, seq) AS rn FROM ({atbat_log_sql()}) l""")
CTES["fold"] = (f"""
SELECT session_id, rn, seq, ts, pitch, outcome, {_step_sql('0', '0', '0', 'false', 'false', 'false')}
FROM alog WHERE rn = 1
UNION ALL
SELECT session_id, rn, seq, ts, pitch, outcome, {_step_sql('pb', 'ps', 'po', 'p1', 'p2', 'p3')}
FROM (SELECT l.*, f.b AS pb, f.s AS ps, f.outs_after AS po, f.on_1b AS p1, f.on_2b AS p2, f.on_3b AS p3
      FROM fold f JOIN alog l ON l.session_id = f.session_id AND l.rn = f.rn + 1) x""", ["alog"])
cte("trace", ["fold"], "SELECT *, CAST(b AS VARCHAR) || '-' || CAST(s AS VARCHAR) AS count_after FROM fold")
cte("atsum", ["trace"], """
SELECT session_id, count(*) AS n_pitches, arg_max(count_after, rn) AS "count", arg_max(outs_after, rn) AS outs,
  arg_max(on_1b, rn) AS on_1b, arg_max(on_2b, rn) AS on_2b, arg_max(on_3b, rn) AS on_3b,
  arg_max(at_bat_active, rn) AS atbat_active, sum(CASE WHEN at_bat_ended THEN 1 ELSE 0 END) AS at_bats_ended
FROM trace GROUP BY session_id""")


# ---------------------------------------------------------------------------
# W9, W14, E26, E27, S10, A24
# ---------------------------------------------------------------------------
cte("rv_old", ["rv0", "re24"], """
SELECT game_pk, at_bat_number, pitch_number, before_state,
  coalesce(lead(before_state) OVER (PARTITION BY game_pk ORDER BY game_date, at_bat_number, pitch_number), 0.0) AS after_state,
  coalesce(lead(before_state) OVER (PARTITION BY game_pk ORDER BY game_date, at_bat_number, pitch_number), 0.0)
    - before_state + coalesce(CAST(post_bat_score - bat_score AS DOUBLE), 0.0) AS run_value_v0
FROM (SELECT rv0.*, coalesce(r.v, 0.0) AS before_state FROM rv0
      LEFT JOIN re24 r ON r.o = CAST(rv0.outs_when_up AS INTEGER) AND r.b = rv0.bases_state) x""")
cte("seq_extra", ["seq"], """
SELECT game_pk, at_bat_number, pitch_number,
  lag(is_swing) OVER (PARTITION BY game_pk, at_bat_number ORDER BY game_date, pitch_number) AS last_pitch_swing,
  FB_count_in_ab / pitch_num_in_ab AS fastball_pct_this_ab
FROM seq""")


def _rule_sql() -> str:
    from moundflow.functions.location import RULE_DEFAULT, RULE_LOCATIONS
    h = " ".join(f"WHEN '{k}' THEN '{v[0]}'" for k, v in RULE_LOCATIONS.items())
    v = " ".join(f"WHEN '{k}' THEN '{v[1]}'" for k, v in RULE_LOCATIONS.items())
    hh = f"(CASE pitch_type {h} ELSE '{RULE_DEFAULT[0]}' END)"
    vv = f"(CASE pitch_type {v} ELSE '{RULE_DEFAULT[1]}' END)"
    return (f"(CASE WHEN {hh} = 'outside' THEN 'away-low' WHEN {hh} = 'inside' AND stand = 'L' THEN 'in-low' "
            f"WHEN {hh} = 'inside' THEN 'in-high' ELSE {hh} || '-' || {vv} END)")


cte("rule_loc", ["seq"], f"""
SELECT rule_location, rule_avoid, pitch_type, count(*) AS pitches, avg(run_value) AS mean_rv
FROM (SELECT *, {_rule_sql()} AS rule_location, CASE pitch_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in K.RULE_AVOID.items())} END AS rule_avoid
  FROM seq) s GROUP BY rule_location, rule_avoid, pitch_type""")
cte("search", ["raw"], """
SELECT pitcher, count(*) AS pitches FROM raw
WHERE strpos(lower(concat_ws('|', inning_topbot, p_throws, stand, pitch_type, description, events)), 'home_run') > 0
GROUP BY pitcher""")
cte("seasons", ["raw"], """
SELECT count(*) AS pitches, count(DISTINCT pitcher) AS pitchers, count(DISTINCT batter) AS batters,
  sum(CASE WHEN pitcher = 7 THEN 1 ELSE 0 END) AS pitcher_pitches
FROM (SELECT * FROM raw WHERE game_date < DATE '2024-06-01'
      UNION ALL SELECT * FROM raw WHERE game_date >= DATE '2024-06-01' OR game_date IS NULL) u""")
cte("players", ["raw"], "SELECT DISTINCT CAST(batter AS BIGINT) AS batter FROM raw WHERE batter IS NOT NULL")
_FITS = " OR ".join(f"(rule = '{n}' AND loc_horizontal IN ({', '.join(map(_q, h))}) AND loc_vertical IN ({', '.join(map(_q, v))}))"
                    for n, (h, v) in K.RULE_BUCKETS.items())
_LIST = "[" + ", ".join(f"'{h}-{v}'" for h in K.H_LABELS for v in K.V_LABELS) + "]"
cte("placed", ["features"], f"""
SELECT *, CASE WHEN loc_horizontal IS NOT NULL AND loc_vertical IS NOT NULL THEN loc_horizontal || '-' || loc_vertical END AS cell,
  {_rule_sql()} AS rule, game_pk % 2 AS fold FROM features""")


def _cross_fitted() -> str:
    """Best and worst cell of each fold's pitch types, by the rows of the other fold."""
    return """
WITH c AS (SELECT 1 - fold AS fold, pitch_type, cell, avg(run_value) AS m FROM placed WHERE cell IS NOT NULL AND run_value IS NOT NULL GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY fold, pitch_type ORDER BY round(m, 12), cell) AS rb,
             row_number() OVER (PARTITION BY fold, pitch_type ORDER BY round(m, 12) DESC, cell) AS rw FROM c)
SELECT b.fold, b.pitch_type, b.cell AS best_location, w.cell AS worst_location
FROM r b JOIN r w ON w.fold = b.fold AND w.pitch_type = b.pitch_type AND w.rw = 1 WHERE b.rb = 1"""


cte("crossfit", ["placed"], _cross_fitted())


def _weights() -> str:
    from moundflow.operators.analytics import POISSON, REPLICATES
    out = []
    for b in range(REPLICATES):
        key = f"(game_pk * 7919 + at_bat_number * 104729 + pitch_number * 1299709 + {b * 15485863})"
        u = f"((({key} * 48271 + 11) % 2147483647 * 69621 + 7) % 1000003 * 1000000 / 1000003)"
        out.append("(" + " + ".join(f"CASE WHEN {u} >= {p} THEN 1 ELSE 0 END" for p in POISSON) + f") AS w{b}")
    return ", ".join(out)


def _dq_sql() -> str:
    from moundflow.operators.analytics import REPLICATES
    draw = f"{_LIST}[1 + (game_pk * 31 + at_bat_number * 17 + pitch_number * 7) % {len(K.H_LABELS) * len(K.V_LABELS)}]"
    best = "p JOIN crossfit b ON b.fold = p.fold AND b.pitch_type = p.pitch_type"
    row = "p.game_pk, p.at_bat_number, p.pitch_number, p.run_value, p.in_zone"
    means = ", ".join(f"sum(run_value * w{b}) / nullif(sum(CASE WHEN run_value IS NOT NULL THEN w{b} END), 0)" for b in range(REPLICATES))
    return f"""
SELECT policy, mean_rv, list_stddev_samp(ms) AS se_rv, strike_share, n FROM (
SELECT policy, avg(run_value) AS mean_rv, avg(CAST(in_zone AS DOUBLE)) AS strike_share, count(*) AS n, [{means}] AS ms FROM (SELECT *, {_weights()} FROM (
  SELECT {row}, 'actual' AS policy FROM placed p
  UNION ALL SELECT {row}, 'recommended' FROM placed {best} WHERE p.cell = b.best_location
  UNION ALL SELECT {row}, 'worst' FROM placed {best} WHERE p.cell = b.worst_location
  UNION ALL SELECT {row}, 'rule_based' FROM placed p WHERE {_FITS}
  UNION ALL SELECT {row}, 'random' FROM placed p WHERE cell = {draw}
  UNION ALL SELECT {row}, 'model' FROM placed p JOIN pitchgrid g ON g.game_pk = p.game_pk AND g.at_bat_number = p.at_bat_number
    AND g.pitch_number = p.pitch_number WHERE p.cell = g.cell
  UNION ALL SELECT {row}, 'in_zone' FROM placed p WHERE in_zone = 1) u) v
GROUP BY policy) w"""


# --- text input, reports, clipping, exposure, geometry, names, location grid ---
def _bad(col: str, kind: str) -> str:
    return f"TRY_CAST(CASE WHEN src_key % 7 = 0 THEN 'n/a' ELSE CAST({col} AS VARCHAR) END AS {kind}) AS {col}"


cte("coerced", ["raw"], f"""
SELECT src_key, {_bad('release_speed', 'DOUBLE')}, {_bad('plate_x', 'DOUBLE')}, {_bad('zone', 'DOUBLE')}, {_bad('balls', 'DOUBLE')},
  {_bad('game_date', 'DATE')} FROM raw""")
cte("creport", ["raw", "clean"], """
SELECT (SELECT count(*) FROM raw) AS rows_before,
  (SELECT count(*) FROM raw WHERE pitcher IS NOT NULL AND batter IS NOT NULL AND pitch_type IS NOT NULL AND description IS NOT NULL) AS rows_complete,
  (SELECT count(*) FROM clean) AS rows_after, (SELECT count(*) FROM raw) - (SELECT count(*) FROM clean) AS rows_dropped""")


def _clip(col: str, lo: float, hi: float) -> str:
    return f"CASE WHEN {col} < {_d(lo)} THEN {_d(lo)} WHEN {col} > {_d(hi)} THEN {_d(hi)} ELSE {col} END AS {col}"


cte("clipped", ["raw"], f"SELECT src_key, {_clip('release_speed', 70.0, 95.0)}, {_clip('plate_x', -1.0, 1.0)}, {_clip('plate_z', 1.0, 4.0)} FROM raw")
cte("exposed", ["bcounts"], "SELECT batter, pitch_category, total_pitches FROM bcounts WHERE total_pitches >= 50")


def sql_zone_of(x: str, z: str) -> str:
    w, h = (K.SZ_RIGHT - K.SZ_LEFT) / 3, (K.SZ_TOP - K.SZ_BOTTOM) / 3
    column = f"least(greatest(floor(({x} - {_d(K.SZ_LEFT)}) / {_d(w)}), 0), 2)"
    row = f"least(greatest(2 - floor(({z} - {_d(K.SZ_BOTTOM)}) / {_d(h)}), 0), 2)"
    return (f"(CASE WHEN {x} BETWEEN {_d(K.SZ_LEFT)} AND {_d(K.SZ_RIGHT)} AND {z} BETWEEN {_d(K.SZ_BOTTOM)} AND {_d(K.SZ_TOP)} "
            f"THEN CAST({row} * 3 + {column} + 1 AS INTEGER) WHEN {z} > {_d(K.SZ_TOP)} THEN 11 WHEN {z} < {_d(K.SZ_BOTTOM)} THEN 12 "
            f"WHEN {x} < {_d(K.SZ_LEFT)} THEN 13 ELSE 14 END)")


def _steps(col: str, edges, labels) -> str:
    return "CASE " + " ".join(f"WHEN {col} < {_d(e)} THEN '{b}'" for e, b in zip(edges[1:-1], labels)) + f" ELSE '{labels[-1]}' END"


cte("locrules", ["clean"], f"""
SELECT game_pk, at_bat_number, pitch_number, {sql_zone_of('plate_x', 'plate_z')} AS zone_of_coords,
  {_steps('plate_x', K.H_EDGES, K.H_LABELS)} AS h_scoring, {_steps('plate_z', K.V_EDGES, K.V_LABELS)} AS v_scoring,
  CASE WHEN plate_x < {_d(-K.LABEL_X)} THEN 'inside' WHEN plate_x > {_d(K.LABEL_X)} THEN 'outside' ELSE 'middle' END || '-' ||
  CASE WHEN plate_z < {_d(K.LABEL_Z_LOW)} THEN 'low' WHEN plate_z > {_d(K.LABEL_Z_HIGH)} THEN 'high' ELSE 'mid' END AS label
FROM clean""")
cte("retable", ["seq", "re24"], """
SELECT outs, bases_state, pitches, v AS run_expectancy FROM (SELECT outs, bases_state, count(*) AS pitches FROM seq GROUP BY ALL) s
LEFT JOIN re24 ON o = outs AND b = bases_state""")
cte("resolved", [], """
SELECT request_id, who, player_id, player_id IS NOT NULL AS player_id_resolved FROM (
  SELECT o_orderkey AS request_id, CASE WHEN o_orderkey % 8 = 0 THEN 'Nobody ' ELSE 'Customer ' END || CAST(o_custkey AS VARCHAR) AS who FROM orders) r
LEFT JOIN (SELECT 'Customer ' || CAST(CASE WHEN c_custkey % 10 = 0 THEN c_custkey - 1 ELSE c_custkey END AS VARCHAR) AS name,
  max(c_custkey) AS player_id FROM customer GROUP BY name) n ON n.name = r.who""")
_CELLS = ", ".join(f"({i}, {_d(x)}, {_d(z)})" for i, (x, z) in enumerate((x, z) for x in K.GRID_X for z in K.GRID_Z))
cte("grid", ["rc", "zlong"], f"""
SELECT request_id, arsenal_pos, pitch_type, x AS plate_x, z AS plate_z, zone, CASE WHEN zone <= 9 THEN 1 ELSE 0 END AS in_zone, s AS expected_rv
FROM (SELECT *, row_number() OVER (PARTITION BY request_id, arsenal_pos ORDER BY s, cell) AS k FROM (
  SELECT rc.request_id, rc.arsenal_pos, rc.pitch_type, c.cell, c.x, c.z, c.zone,
    CASE WHEN l.batter IS NULL THEN 0.25E0 ELSE l.whiff_rate END * -0.2E0 + CASE WHEN l.batter IS NULL THEN 0.32E0 ELSE l.xwoba END * 0.1E0
      + abs(c.x) * 0.01E0 + CASE WHEN c.z > 1.8E0 AND c.z <= 2.5E0 THEN 0.004E0 ELSE 0.0E0 END AS s
  FROM rc CROSS JOIN (SELECT cell, x, z, {sql_zone_of('x', 'z')} AS zone FROM (VALUES {_CELLS}) v(cell, x, z)) c
  LEFT JOIN zlong l ON l.batter = rc.batter AND l.zone = c.zone) u) w WHERE k = 1""")

# --- untidy files, search over all columns ------------------------------------------
cte("untidy", ["raw"], """
SELECT src_key, pitcher, pitch_type, CASE WHEN src_key % 3 = 2 THEN NULL ELSE release_speed END AS speed
FROM raw WHERE src_key % 11 <> 0 AND src_key % 13 <> 0""")
cte("search12", ["raw"], f"""
SELECT pitcher, count(*) AS pitches FROM raw
WHERE {" OR ".join(f"contains(lower(CAST({c} AS VARCHAR)), '12')" for c in ("src_key", "game_pk", "pitcher", "batter", "zone", "description", "events"))}
GROUP BY pitcher""")
cte("atdocs", ["trace", "atsum"], """
SELECT a.session_id, a."count", a.outs, a.on_1b, a.on_2b, a.on_3b, a.n_pitches, a.atbat_active, t.rn AS place, t.seq, t.pitch, t.outcome, t.count_before
FROM trace t JOIN atsum a ON a.session_id = t.session_id""")


# --- M2: medians, means, deviations and levels of the training rows ----------------------
def _m02_sql() -> str:
    from moundflow.operators import features as FE
    numeric = [c for c in FE.ALL_FEATURES if c not in FE.CATEGORICAL_FEATURES]
    one = [f"""
SELECT '{c}' AS feature, 'numeric' AS kind, m AS median, avg(coalesce(x, m)) AS mean, stddev_samp(coalesce(x, m)) AS std, NULL AS levels
FROM (SELECT x, median(x) OVER () AS m FROM (SELECT CAST({c} AS DOUBLE) AS x FROM w10 WHERE split = 'train') a) b GROUP BY m""" for c in numeric]
    one += [f"""
SELECT '{c}' AS feature, 'categorical' AS kind, NULL AS median, NULL AS mean, NULL AS std, string_agg(x, ',' ORDER BY x) AS levels
FROM (SELECT DISTINCT coalesce(CAST({c} AS VARCHAR), 'missing') AS x FROM w10 WHERE split = 'train') a""" for c in FE.CATEGORICAL_FEATURES]
    return " UNION ALL ".join(one)


cte("m02", ["w10"], _m02_sql())


# --- A25 with the place a scorer prefers for each pitch -------------------------------------
cte("pitchgrid", ["features", "zlong"], f"""
SELECT game_pk, at_bat_number, pitch_number, {_bucket('x', K.H_EDGES, K.H_LABELS)} || '-' || {_bucket('z', K.V_EDGES, K.V_LABELS)} AS cell
FROM (SELECT *, row_number() OVER (PARTITION BY game_pk, at_bat_number, pitch_number ORDER BY s, cell_no) AS k FROM (
  SELECT f.game_pk, f.at_bat_number, f.pitch_number, c.cell AS cell_no, c.x, c.z,
    CASE WHEN l.batter IS NULL THEN 0.25E0 ELSE l.whiff_rate END * -0.2E0 + CASE WHEN l.batter IS NULL THEN 0.32E0 ELSE l.xwoba END * 0.1E0
      + abs(c.x) * 0.01E0 + CASE WHEN c.z > 1.8E0 AND c.z <= 2.5E0 THEN 0.004E0 ELSE 0.0E0 END AS s
  FROM features f CROSS JOIN (SELECT cell, x, z, {sql_zone_of('x', 'z')} AS zone FROM (VALUES {_CELLS}) v(cell, x, z)) c
  LEFT JOIN zlong l ON l.batter = f.batter AND l.zone = c.zone) u) w WHERE k = 1""")
cte("dq", ["placed", "crossfit", "pitchgrid"], _dq_sql())


# --- S10 by season, M6 by a shift in time -----------------------------------------------------
cte("stored", ["raw"], """
SELECT coalesce(s, 'all') AS seasons, pitches, pitchers, batters FROM (
  SELECT CASE WHEN game_date < DATE '2024-06-01' THEN 'early' ELSE 'late' END AS s, count(*) AS pitches, count(DISTINCT pitcher) AS pitchers,
    count(DISTINCT batter) AS batters FROM raw GROUP BY GROUPING SETS ((), (s))) u""")


def _shift_sql() -> str:
    rv = lambda c: f"{_d(K.NO_MODEL_RV_INTERCEPT)} - {c} * {_d(K.NO_MODEL_RV_SLOPE)}"
    used = "batter_whiff_rate_vs_this_cat"
    one = " UNION ALL ".join(f"""
SELECT '{c}' AS feature, avg((run_value - b) * (run_value - b)) AS mse_base, avg((run_value - {'s' if c == used else 'b'}) * (run_value - {'s' if c == used else 'b'})) AS mse_shifted
FROM (SELECT a.run_value, {rv('a.' + used)} AS b, {rv('z.' + used)} AS s FROM w10 a
      JOIN w10 z ON z.time_rank = (a.time_rank + CAST(floor(a.n_total * 0.381966E0) AS BIGINT) + 1) % a.n_total) j"""
                             for c in (used, "batter_xwoba_vs_this_cat", "count_balls"))
    return f"SELECT *, mse_shifted - mse_base AS importance FROM ({one}) u"


cte("shifted", ["w10"], _shift_sql())


# --- R13, R15, R4 ---------------------------------------------------------------------------------
cte("degraded", ["req", "hlist", "re24"], f"""
SELECT request_id, unnest(range(1, len(p) + 1)) AS rank, unnest(p) AS pitch, round_even(100.0E0 / len(p), 1) AS pct, 'middle' AS location, re AS expected_after_re
FROM (SELECT r.request_id, coalesce(l.pitches, {K.HEURISTIC_FILL_ARSENAL}) AS p, round({sql_re('outs', 'on_1b', 'on_2b', 'on_3b')}, 2) AS re
      FROM req r LEFT JOIN hlist l ON l.pitcher = r.pitcher) x""")
cte("modeltable", ["recommend"], """
SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY expected_after_re, pitch_type) AS place FROM (
  SELECT request_id, pitch_type, min(predicted_rv) AS expected_run_value, min(expected_re_after) AS expected_after_re FROM recommend GROUP BY ALL) x""")
cte("candfeat", ["rb"], f"""
SELECT *, CASE WHEN runners_on = 0 THEN 1 ELSE 0 END AS bases_empty, CASE WHEN runners_on = 3 THEN 1 ELSE 0 END AS bases_loaded,
  bc * is_ahead_in_count AS chase_opportunity, is_two_strikes * bw AS two_strike_whiff_boost FROM (
SELECT request_id, arsenal_pos, pitch_type, category AS pitch_category, bw, bc, bw AS batter_whiff_rate_vs_this_cat,
  CASE WHEN coalesce(last_pitch_type, '') <> '' THEN {sql_category('last_pitch_type')} END AS last_pitch_category,
  balls AS count_balls, strikes AS count_strikes, CASE WHEN strikes > balls THEN 1 ELSE 0 END AS is_ahead_in_count,
  CASE WHEN balls > strikes THEN 1 ELSE 0 END AS is_behind_in_count, CASE WHEN strikes = 2 THEN 1 ELSE 0 END AS is_two_strikes,
  CASE WHEN balls = 3 THEN 1 ELSE 0 END AS is_three_balls, CASE WHEN balls = 3 AND strikes = 2 THEN 1 ELSE 0 END AS is_full_count,
  CASE WHEN balls = 0 AND strikes = 0 THEN 1 ELSE 0 END AS is_first_pitch, outs, CASE WHEN outs = 2 THEN 1 ELSE 0 END AS is_two_outs,
  on_1b + on_2b + on_3b AS runners_on, CASE WHEN on_2b = 1 OR on_3b = 1 THEN 1 ELSE 0 END AS risp, inning AS inning_num,
  CASE WHEN inning >= 7 THEN 1 ELSE 0 END AS is_late_inning, score_diff, CASE WHEN abs(score_diff) <= 2 THEN 1 ELSE 0 END AS is_close_game,
  CASE WHEN last_pitch_type = pitch_type THEN 1 ELSE 0 END AS same_as_last, 0 AS consecutive_same_pitch FROM rb) x""")


# --- what is written and read back -----------------------------------------------------------------
cte("written", ["seq"], "SELECT game_pk, at_bat_number, pitch_number, game_date, pitch_type, run_value, year(game_date) AS game_year FROM seq")


def _metadata_sql() -> str:
    from moundflow.operators import features as FE
    return f"SELECT *, {len(FE.NUMERIC_FEATURES)} AS n_numeric, {len(FE.CATEGORICAL_FEATURES)} AS n_categorical FROM a22"


cte("metadata", ["a22"], _metadata_sql())
