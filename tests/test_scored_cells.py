"""R6 with a scorer: the cells are columns of the candidate's row."""
from pyspark.sql import functions as F

from moundflow.operators import recommend as RE


def test_scored_cells_make_no_rows(spark):
    cands = spark.createDataFrame([(1, 0, 5, "FF"), (2, 0, 6, "SL"), (3, 1, None, "CH")], "request_id long, arsenal_pos int, batter long, pitch_type string")
    zones = spark.createDataFrame([(5, z, 0.5, 0.3 if z == 9 else 0.1, 0.7, 0.3) for z in range(1, 15)],
                                  "batter long, zone long, swing_rate double, whiff_rate double, contact_rate double, xwoba double")
    got = RE.optimize_locations(cands, zones, carry=["pitch_type"], scorer=-F.col("batter_whiff_rate_at_zone"))
    assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()
    by = {r.request_id: r for r in got.collect()}
    assert by[1].location.zone == 9 and by[1].location.expected_rv == -0.3
    first = (RE.K.GRID_X[0], RE.K.GRID_Z[0])        # all cells equal: the first
    assert {(by[i].location.plate_x, by[i].location.plate_z) for i in (2, 3)} == {first} and by[3].pitch_type == "CH"
