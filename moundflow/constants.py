"""Fixed values that results depend on.

FIXED VALUES — these must stay exactly as written for results to match the
published pipeline this package re-implements (pitch categories, the default
run-expectancy matrix, count deltas, league averages, zone geometry,
default fallbacks, heuristic tables and thresholds).  They are data, not
logic; every rule that uses them lives in ``moundflow.functions`` and
``moundflow.operators``.
"""

# ---------------------------------------------------------------------------
# FIXED VALUES: pitch type -> category (FB fastball, BR breaking, OS offspeed)
# ---------------------------------------------------------------------------
PITCH_CATEGORIES = {
    "FF": "FB", "SI": "FB", "FC": "FB", "FT": "FB", "FA": "FB",
    "SL": "BR", "CU": "BR", "KC": "BR", "ST": "BR", "SV": "BR", "CS": "BR",
    "CH": "OS", "FS": "OS", "SC": "OS", "KN": "OS", "EP": "OS",
    "PO": "OS", "IN": "FB",
}
CATEGORIES = ["FB", "BR", "OS"]
UNKNOWN_CATEGORY = "UNKNOWN"

# ---------------------------------------------------------------------------
# FIXED VALUES: default run expectancy, (outs, bases "1B2B3B") -> runs
# ---------------------------------------------------------------------------
RUN_EXPECTANCY = {
    (0, "000"): 0.481, (0, "100"): 0.859, (0, "010"): 1.100, (0, "001"): 1.392,
    (0, "110"): 1.437, (0, "101"): 1.790, (0, "011"): 1.966, (0, "111"): 2.282,
    (1, "000"): 0.254, (1, "100"): 0.509, (1, "010"): 0.664, (1, "001"): 0.950,
    (1, "110"): 0.884, (1, "101"): 1.130, (1, "011"): 1.376, (1, "111"): 1.520,
    (2, "000"): 0.098, (2, "100"): 0.224, (2, "010"): 0.319, (2, "001"): 0.363,
    (2, "110"): 0.429, (2, "101"): 0.478, (2, "011"): 0.580, (2, "111"): 0.736,
}

# ---------------------------------------------------------------------------
# FIXED VALUES: run-value delta of adding a ball / a strike at (balls, strikes)
# ---------------------------------------------------------------------------
COUNT_DELTA_BALL = {
    (0, 0): 0.032, (1, 0): 0.039, (2, 0): 0.059, (3, 0): 0.0,
    (0, 1): 0.025, (1, 1): 0.032, (2, 1): 0.048, (3, 1): 0.0,
    (0, 2): 0.021, (1, 2): 0.027, (2, 2): 0.037, (3, 2): 0.0,
}
COUNT_DELTA_STRIKE = {
    (0, 0): -0.038, (1, 0): -0.043, (2, 0): -0.047, (3, 0): -0.051,
    (0, 1): -0.049, (1, 1): -0.056, (2, 1): -0.066, (3, 1): -0.078,
    (0, 2): 0.0, (1, 2): 0.0, (2, 2): 0.0, (3, 2): 0.0,
}
STRIKE_WORDS = ["strike", "swinging_strike", "called_strike"]

# ---------------------------------------------------------------------------
# FIXED VALUES: league averages by pitch category
# ---------------------------------------------------------------------------
LEAGUE_AVERAGES = {
    "FB": {"whiff_rate": 0.22, "chase_rate": 0.27, "zone_contact_rate": 0.87, "xwoba": 0.340, "gb_rate": 0.40},
    "BR": {"whiff_rate": 0.35, "chase_rate": 0.32, "zone_contact_rate": 0.78, "xwoba": 0.280, "gb_rate": 0.45},
    "OS": {"whiff_rate": 0.32, "chase_rate": 0.30, "zone_contact_rate": 0.82, "xwoba": 0.300, "gb_rate": 0.48},
}
PROFILE_STATS = ["whiff_rate", "chase_rate", "zone_contact_rate", "gb_rate", "xwoba"]

# Shrinkage thresholds of the batter-category profile (k = threshold / 4).
SHRINK_THRESHOLDS = {"whiff_rate": 100, "chase_rate": 100, "zone_contact_rate": 80, "gb_rate": 50, "xwoba": 50}
XWOBA_RAW_DEFAULT = 0.320
# vulnerability_score weights: (1-whiff), (1-chase), zone_contact, xwoba
VULNERABILITY_WEIGHTS = (0.3, 0.2, 0.2, 0.3)

# Pitcher profile: minimum pitches for a (pitcher, hand, type) to be kept.
MIN_PITCHES_PER_TYPE = 20

# ---------------------------------------------------------------------------
# FIXED VALUES: batter zone profiles
# ---------------------------------------------------------------------------
ZONES = list(range(1, 15))
ZONE_STATS = ["whiff_rate", "contact_rate", "swing_rate", "xwoba"]
ZONE_LEAGUE_DEFAULTS = {"whiff_rate": 0.25, "contact_rate": 0.75, "swing_rate": 0.5, "xwoba": 0.32}
ZONE_LEAGUE_MIN_ROWS = 100      # league zone rate needs more than this many pitches
ZONE_MIN_PITCHES = 5            # fewer batter pitches in a zone -> league value
ZONE_SHRINK_K = 20              # w = n / (n + 20)
CHASE_ZONES = [11, 12, 13, 14]
CHASE_PRIOR = 0.30

# ---------------------------------------------------------------------------
# FIXED VALUES: location geometry
# ---------------------------------------------------------------------------
SZ_LEFT, SZ_RIGHT, SZ_BOTTOM, SZ_TOP = -0.83, 0.83, 1.5, 3.5
GRID_X = [-1.2, -0.6, 0.0, 0.6, 1.2]
GRID_Z = [1.8, 2.3, 2.8, 3.3, 3.8]
# training buckets: right-closed (a, b], out of range -> null
H_EDGES = [-5.0, -1.0, -0.3, 0.3, 1.0, 5.0]
H_LABELS = ["inside_inside", "inside", "middle", "outside", "outside_outside"]
V_EDGES = [0.0, 1.8, 2.5, 3.5, 6.0]
V_LABELS = ["low", "mid_low", "mid_high", "high"]
# human-readable label thresholds
LABEL_X = 0.5
LABEL_Z_LOW, LABEL_Z_HIGH = 2.3, 3.2
# fallback location when no model is loaded (zone kept as published)
FALLBACK_LOCATION = {"plate_x": 0.0, "plate_z": 2.3, "zone": 8, "in_zone": 1, "expected_rv": 0.0}

# ---------------------------------------------------------------------------
# FIXED VALUES: scoring defaults
# ---------------------------------------------------------------------------
DEFAULT_ARSENAL = ["FF", "SL", "CH"]
PITCHER_DEFAULTS_BY_CATEGORY = {
    "FB": {"avg_velo": 94.0, "avg_spin": 2300.0, "velo_diff_from_fb": 0.0},
    "BR": {"avg_velo": 84.0, "avg_spin": 2600.0, "velo_diff_from_fb": 10.0},
    "OS": {"avg_velo": 86.0, "avg_spin": 1800.0, "velo_diff_from_fb": 8.0},
}
PITCHER_DEFAULTS_COMMON = {"avg_pfx_x": 0.0, "avg_pfx_z": 0.0, "whiff_rate": 0.25,
                           "strike_rate": 0.65, "usage_rate": 0.2, "p_throws": "R"}
# batter "vs this category" defaults when a profile column is missing
BATTER_THIS_CAT_DEFAULTS = {"whiff_rate": 0.25, "chase_rate": 0.30, "zone_contact_rate": 0.85,
                            "gb_rate": 0.45, "xwoba": 0.320}
NO_MODEL_RV_INTERCEPT, NO_MODEL_RV_SLOPE = 0.1, 0.4   # rv = 0.1 - 0.4 * whiff

# Reason text thresholds
REASON_WHIFF_MARGIN = 0.05
REASON_CHASE_MARGIN = 0.05
REASON_XWOBA_LOW, REASON_XWOBA_HIGH = 0.280, 0.360

# ---------------------------------------------------------------------------
# FIXED VALUES: heuristic recommender
# ---------------------------------------------------------------------------
HEURISTIC_BASE_LOCATION = {
    "FF": "up-in", "FT": "up-in", "SI": "low-in", "SL": "low-away", "CU": "low-middle",
    "CH": "low-away", "CT": "arm-side edge", "KC": "low-away", "FC": "low-in",
}
HEURISTIC_DEFAULT_LOCATION = "edge-low-away"
HEURISTIC_DEFAULT_ARSENAL = ["FF", "SL"]
HEURISTIC_FILL_ARSENAL = ["FF", "SL", "CU"]
ARCHETYPE_CLUSTERS = {0: "Power Hitter", 1: "Contact Hitter", 2: "Contact/Puller",
                      3: "Patient Hitter", 4: "Spray/Speed"}
POWER_HARD_HIT = 0.48
BREAKING_SET = ["SL", "CU", "KC"]
CONTACT_SET = ["FF", "CT", "FT"]
PATIENT_SET = ["FF", "FT"]
TWO_OUT_SET = ["SL", "CU"]
TERTIARY_SET = ["SL", "CU", "KC", "CH"]
SCORE_POWER, SCORE_CONTACT, SCORE_PATIENT, SCORE_TWO_OUT = 1.5, 0.5, 1.0, 0.7
CONFIDENCE_BASE, CONFIDENCE_STEP, CONFIDENCE_POWER, CONFIDENCE_CAP = 0.6, 0.1, 0.1, 0.99
SHUFFLE_PROBABILITY = 0.15

# ---------------------------------------------------------------------------
# FIXED VALUES: at-bat outcomes (UI labels) and EPRV outcome classes
# ---------------------------------------------------------------------------
ATBAT_OUTCOMES = ["Ball", "Called Strike", "Swinging Strike", "Foul", "In play - out",
                  "In play - single", "In play - double", "In play - triple",
                  "In play - home run", "Other (end)"]
EPRV_OUTCOMES = ["ball", "called_strike", "swinging_strike", "foul", "inplay_out",
                 "1B", "2B", "3B", "HR", "HBP"]

# Count-adjusted run expectancy factors
COUNT_ADJ_AHEAD, COUNT_ADJ_BEHIND, COUNT_ADJ_EXTREME = 0.10, 0.10, 0.15

# GBT defaults (depth 8, rate .05, <=200 iterations, 10 % early-stop holdout, seed 42)
GBT_MAX_DEPTH, GBT_STEP, GBT_MAX_ITER, GBT_VALIDATION_FRACTION, GBT_SEED = 8, 0.05, 200, 0.1, 42
GBT_PATIENCE = 10
# FIXED VALUES: inputs and settings of the older trainer (M4)
OLD_GBT_STEP, OLD_GBT_MAX_ITER = 0.06, 100
OLD_NUMERIC = ["balls", "strikes", "outs_when_up", "on_1b", "on_2b", "on_3b", "release_speed", "release_spin_rate", "zone",
               "plate_x", "plate_z", "last_pitch_speed_delta", "batter_pitchtype_woba", "batter_pitchtype_whiff_rate",
               "batter_pitchtype_run_value"]
OLD_CATEGORICAL = ["stand", "p_throws", "pitch_type", "last_pitch_type", "last_pitch_result"]
SPLIT_TRAIN, SPLIT_VAL = 0.70, 0.15

# ---------------------------------------------------------------------------
# FIXED VALUES: recommendation reason texts ({} = inserted value)
# ---------------------------------------------------------------------------
REASON_HIGH_WHIFF = "Batter has high whiff rate vs {} ({})"
REASON_GOOD_CONTACT = "Batter makes good contact vs {}"
REASON_CHASES = "Batter chases {} pitches ({})"
REASON_WEAK_CONTACT = "Weak contact expected ({} xwOBA)"
REASON_DANGEROUS = "Dangerous contact potential ({} xwOBA)"
REASON_PUT_AWAY = "Put-away count favors offspeed/breaking"
REASON_NEED_STRIKE = "Need strike - fastball for command"
REASON_DEFAULT = "Standard option"

# ---------------------------------------------------------------------------
# FIXED VALUES: heuristic strategy notes ({} = inserted value)
# ---------------------------------------------------------------------------
NOTE_ARCHETYPE = "Archetype detected: {}."
NOTE_ARSENAL = "Pitcher arsenal: {}."
NOTE_POWER = "Favor breaking balls low-and-away to induce chases and weak contact."
NOTE_CONTACT = "Mix speeds and work edges to induce weak contact and avoid predictable locations."
NOTE_PATIENT = "Attack early in the count with strikes; use harder-to-hit chase pitches later."
NOTE_RISP = "RISP: prefer low pitches to induce grounders and avoid big hits."
NOTE_COUNT = "Count considered: {}."

# ---------------------------------------------------------------------------
# FIXED VALUES: rule-based location by pitch type (horizontal, vertical)
# ---------------------------------------------------------------------------
RULE_LOCATIONS = {
    "FF": ("outside", "high"),
    "SI": ("inside-or-outside", "low"),
    "SL": ("outside", "low"),
    "CU": ("middle-outside", "low"),
    "CH": ("outside", "low"),
    "FS": ("outside", "low"),
}
RULE_DEFAULT = ("outside", "low")
# the cell each pitch type should stay out of (none for other types)
RULE_AVOID = {"FF": "middle-low", "SI": "high-middle", "SL": "middle", "CU": "middle-middle", "CH": "middle-high", "FS": "middle"}
# buckets that fit a rule-based location (horizontal, vertical)
RULE_BUCKETS = {
    "away-low": (["outside", "outside_outside"], ["low"]),
    "in-low": (["inside", "inside_inside"], ["low"]),
    "in-high": (["inside", "inside_inside"], ["high"]),
    "inside-or-outside-low": (["inside", "inside_inside", "outside", "outside_outside"], ["low"]),
    "middle-outside-low": (["middle", "outside"], ["low"]),
}
