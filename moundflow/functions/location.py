"""Location rules (zone geometry, buckets, labels) as Column expressions."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from moundflow import constants as K
from moundflow.functions.pitch import _c, literal_map

_X_THIRD = (K.SZ_RIGHT - K.SZ_LEFT) / 3
_Z_THIRD = (K.SZ_TOP - K.SZ_BOTTOM) / 3


def coords_to_zone(plate_x, plate_z) -> Column:
    """3x3 grid 1..9 inside the box (edges inclusive), else 11 high,
    12 low, 13 left, 14 right.  Null coordinates fall through to 14."""
    x, z = _c(plate_x), _c(plate_z)
    inside = (x >= K.SZ_LEFT) & (x <= K.SZ_RIGHT) & (z >= K.SZ_BOTTOM) & (z <= K.SZ_TOP)
    col = F.least(F.greatest(F.floor((x - F.lit(K.SZ_LEFT)) / F.lit(_X_THIRD)), F.lit(0)), F.lit(2))
    row = F.least(F.greatest(F.lit(2) - F.floor((z - F.lit(K.SZ_BOTTOM)) / F.lit(_Z_THIRD)), F.lit(0)), F.lit(2))
    return (F.when(inside, (row * 3 + col + 1).cast("int"))
            .when(z > K.SZ_TOP, F.lit(11))
            .when(z < K.SZ_BOTTOM, F.lit(12))
            .when(x < K.SZ_LEFT, F.lit(13))
            .otherwise(F.lit(14)))


def _right_closed(value: Column, edges, labels) -> Column:
    expr = None
    for lo, hi, lab in zip(edges[:-1], edges[1:], labels):
        cond = (value > F.lit(lo)) & (value <= F.lit(hi))
        expr = F.when(cond, F.lit(lab)) if expr is None else expr.when(cond, F.lit(lab))
    return expr


def _left_closed_open_ended(value: Column, edges, labels) -> Column:
    inner = edges[1:-1]
    expr = None
    for hi, lab in zip(inner, labels[:-1]):
        cond = value < F.lit(hi)
        expr = F.when(cond, F.lit(lab)) if expr is None else expr.when(cond, F.lit(lab))
    return expr.otherwise(F.lit(labels[-1]))


def loc_horizontal(plate_x) -> Column:
    """E17 (training): right-closed (a, b] buckets; outside [-5, 5] -> null."""
    return _right_closed(_c(plate_x), K.H_EDGES, K.H_LABELS)


def loc_vertical(plate_z) -> Column:
    return _right_closed(_c(plate_z), K.V_EDGES, K.V_LABELS)


def loc_horizontal_scoring(plate_x) -> Column:
    """E18 (scoring): left-closed thresholds, no range limit."""
    return _left_closed_open_ended(_c(plate_x), K.H_EDGES, K.H_LABELS)


def loc_vertical_scoring(plate_z) -> Column:
    return _left_closed_open_ended(_c(plate_z), K.V_EDGES, K.V_LABELS)


def location_label(plate_x, plate_z) -> Column:
    """E19: 'inside|middle|outside' - 'low|mid|high'."""
    x, z = _c(plate_x), _c(plate_z)
    h = F.when(x < -K.LABEL_X, "inside").when(x > K.LABEL_X, "outside").otherwise("middle")
    v = F.when(z < K.LABEL_Z_LOW, "low").when(z > K.LABEL_Z_HIGH, "high").otherwise("mid")
    return F.concat_ws("-", h, v)


def in_zone_flag(zone) -> Column:
    """F8: 1 if 1 <= zone <= 9 else 0 (null -> 0)."""
    z = _c(zone)
    return F.coalesce(((z >= 1) & (z <= 9)).cast("int"), F.lit(0))


RULE_LOCATIONS = K.RULE_LOCATIONS
RULE_DEFAULT = K.RULE_DEFAULT


def rule_based_location(pitch_type, stand) -> Column:
    """Design-table location, adjusted by batter hand."""
    pt = _c(pitch_type)
    h = F.coalesce(F.try_element_at(literal_map({k: v[0] for k, v in RULE_LOCATIONS.items()}), pt),
                   F.lit(RULE_DEFAULT[0]))
    v = F.coalesce(F.try_element_at(literal_map({k: v[1] for k, v in RULE_LOCATIONS.items()}), pt),
                   F.lit(RULE_DEFAULT[1]))
    lefty = F.coalesce(_c(stand) == "L", F.lit(False))
    return (F.when(h == "outside", F.lit("away-low"))
            .when((h == "inside") & lefty, F.lit("in-low"))
            .when(h == "inside", F.lit("in-high"))
            .otherwise(F.concat_ws("-", h, v)))


def rule_avoid(pitch_type) -> Column:
    """The location the design table warns of; null for other types."""
    return F.try_element_at(literal_map(K.RULE_AVOID), _c(pitch_type))


def fits_rule(location, horizontal, vertical) -> Column:
    """Whether location buckets are those a rule-based location asks for."""
    fit = F.lit(False)
    for name, (h, v) in K.RULE_BUCKETS.items():
        fit = fit | ((_c(location) == name) & _c(horizontal).isin(*h) & _c(vertical).isin(*v))
    return F.coalesce(fit, F.lit(False))


def location_grid(spark):
    """The 25 candidate cells (x-major), with zone and in-zone flag.
    A fixed 25-row table, safe to broadcast."""
    rows = []
    cell = 0
    for x in K.GRID_X:
        for z in K.GRID_Z:
            rows.append((cell, float(x), float(z)))
            cell += 1
    g = spark.createDataFrame(rows, "cell_no int, plate_x double, plate_z double")
    g = g.withColumn("zone", coords_to_zone("plate_x", "plate_z"))
    return g.withColumn("in_zone", in_zone_flag("zone"))
