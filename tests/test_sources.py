"""File sources and sinks: projected / tolerant CSV reads, reference tables,
name maps, versioned and partitioned writes, model persistence."""
import os
import tempfile

from pyspark.sql import functions as F

from moundflow.sources import files as FI


def _tmp():
    return tempfile.mkdtemp(prefix="moundflow-test-")


def test_read_pitch_log_projects_and_types(spark):
    d = _tmp()
    p = os.path.join(d, "log.csv")
    with open(p, "w") as f:
        f.write("game_pk,game_date,pitcher,batter,pitch_type,zone,description,extra\n")
        f.write("1,2024-04-01,10,20,FF,5,ball,x\n2,2024-04-02,11,21,SL,abc,foul,y\n")
    df = FI.read_pitch_log(spark, p)
    assert "extra" not in df.columns and "release_speed" in df.columns
    rows = {r.game_pk: r for r in df.collect()}
    assert rows[1].zone == 5.0 and rows[2].zone is None          # bad value -> null
    assert rows[1].release_speed is None and str(rows[1].game_date) == "2024-04-01"


def test_tolerant_csv(spark):
    d = _tmp()
    p = os.path.join(d, "ars.csv")
    with open(p, "w") as f:
        f.write("pitcher,pitch_type\n1,FF\npitcher,pitch_type\n2,SL,extra,cols\n3,CU\n")
    schema = "pitcher long, pitch_type string"
    from pyspark.sql.types import _parse_datatype_string
    st = _parse_datatype_string(schema)
    df = FI.read_tolerant_csv(spark, [os.path.join(d, "missing.csv"), p], st)
    assert sorted(r.pitcher for r in df.collect()) == [1, 3]
    empty = FI.read_tolerant_csv(spark, [os.path.join(d, "nope.csv")], st)
    assert empty.count() == 0 and empty.columns == ["pitcher", "pitch_type"]


def test_run_expectancy_table(spark):
    d = _tmp()
    p = os.path.join(d, "re.csv")
    with open(p, "w") as f:
        f.write("outs,bases_state,run_expectancy\n0,0,0.5\n1,11,0.9\n")
    got = {(r.outs, r.bases_state): r.run_expectancy for r in FI.run_expectancy_table(spark, p).collect()}
    assert got == {(0, "000"): 0.5, (1, "011"): 0.9}
    assert FI.run_expectancy_table(spark).count() == 24


def test_name_map_last_wins_and_resolve(spark):
    d = _tmp()
    p = os.path.join(d, "names.csv")
    with open(p, "w") as f:
        f.write("batter,name\n1,ann lee\n2,bo diaz\n3,ann lee\n")
    names = FI.name_map(spark, p)
    assert [(r.name, r.id) for r in names.collect()] == [("ann lee", "3"), ("bo diaz", "2")]
    req = spark.createDataFrame([("ann lee",), ("zed",)], "who string")
    got = {r.who: (r.batter_id, r.batter_id_resolved) for r in FI.resolve_names(req, names, "who", "batter_id").collect()}
    assert got == {"ann lee": (3, True), "zed": (None, False)}


def test_sinks(spark, small_dir):
    from moundflow.plans.tables import Tables
    t = Tables(spark, small_dir)
    d = _tmp()
    FI.write_pitch_table(t.pitches.select("game_pk", "game_date", "pitch_number", "run_value"), os.path.join(d, "p"))
    back = spark.read.parquet(os.path.join(d, "p"))
    assert back.filter(F.col("game_year") == 2024).count() == t.pitches.count()
    out = FI.write_csv_versioned(t.pitcher_arsenals.select("pitcher", "pitch_types"), os.path.join(d, "ars"), "r1")
    assert spark.read.option("header", True).csv(out).count() == t.pitcher_arsenals.count()
    m = spark.createDataFrame([("train", 0.1)], "split string, rmse double")
    FI.write_metadata(spark, os.path.join(d, "meta"), m, ["a", "b"], ["a"], ["b"])
    assert spark.read.json(os.path.join(d, "meta", "inference_config")).first().numeric_cols == ["a"]


def test_model_save_load(spark, small_dir):
    from moundflow.operators import model as ML
    from moundflow.plans.tables import Tables
    f = Tables(spark, small_dir).features
    model, _, _, df = ML.train(f, max_iter=3, max_depth=3)
    d = os.path.join(_tmp(), "model")
    ML.save_model(model, d)
    again = ML.load_model(d)
    a = ML.predict(model, df, "p").select("p").collect()
    b = ML.predict(again, df, "p").select("p").collect()
    assert a == b


def test_several_files_with_columns_in_other_order(spark):
    d = _tmp()
    with open(os.path.join(d, "a.csv"), "w") as f:
        f.write("game_pk,pitcher,batter,zone\n1,10,20,5\n")
    with open(os.path.join(d, "b.csv"), "w") as f:
        f.write("batter,extra,pitcher,game_pk\n21,x,11,2\n")
    for path in (d, [os.path.join(d, "b.csv"), os.path.join(d, "a.csv")], os.path.join(d, "*.csv")):
        got = sorted((r.game_pk, r.pitcher, r.batter, r.zone) for r in FI.read_pitch_log(spark, path).collect())
        assert got == [(1, 10, 20, 5.0), (2, 11, 21, None)]


def test_tolerant_csv_by_header_name_after_junk(spark):
    d = _tmp()
    p = os.path.join(d, "ars.csv")
    with open(p, "w") as f:
        f.write("version https://example.org/spec/v1\nnot,a header\npitch_type,note,pitcher\nFF,x,1\nSL,y,abc\npitch_type,note,pitcher\nCU,z,2\nCH\nFF,,3\n")
    from pyspark.sql.types import _parse_datatype_string
    df = FI.read_tolerant_csv(spark, [p], _parse_datatype_string("pitcher long, pitch_type string, hand string"))
    assert sorted((r.pitcher, r.pitch_type, r.hand) for r in df.collect()) == [(1, "FF", None), (2, "CU", None), (3, "FF", None)]


def test_name_map_last_line_by_file_and_place(spark):
    d = _tmp()
    for name, rows in (("b.csv", "5,zed\n6,amy\n"), ("a.csv", "1,zed\n2,amy\n3,amy\n")):
        with open(os.path.join(d, name), "w") as f:
            f.write("id,name\n" + rows)
    assert [(r.name, r.id) for r in FI.name_map(spark, d).collect()] == [("amy", "6"), ("zed", "5")]


def test_a_season_is_written_by_many_tasks(spark, small_dir):
    from moundflow.plans.tables import Tables
    d = os.path.join(_tmp(), "p")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        FI.write_pitch_table(Tables(spark, small_dir).pitches.select("game_pk", "game_date", "pitch_number"), d)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sum(x.endswith(".parquet") for x in os.listdir(os.path.join(d, "game_year=2024"))) > 1


def test_checkpoint_folder_is_not_local_on_a_cluster():
    import pytest
    from moundflow.session import ensure_checkpoint_dir

    class Conf:
        def get(self, *a):
            return None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(Session())
