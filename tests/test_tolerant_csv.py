"""S2's reader: files with headers of their own, quotes, junk, byte ranges."""
import json
import os
import random

import pytest
from pyspark.sql.types import _parse_datatype_string

from moundflow.sources import files as FI
from moundflow.sources import tolerant as TO

SCHEMA = "pitcher long, pitch_type string, speed double"


def _read(spark, *paths, **more):
    return sorted(((r.pitcher, r.pitch_type, r.speed) for r in FI.read_tolerant_csv(spark, paths, _parse_datatype_string(SCHEMA), **more).collect()), key=str)


def _write(folder, name, text):
    with open(os.path.join(folder, name), "w", newline="") as f:
        f.write(text)


def test_each_file_has_its_own_header(spark, tmp_path):
    _write(tmp_path, "a.csv", "pitcher,pitch_type,speed\n1,FF,90\n2,SL,85.5\n")
    _write(tmp_path, "b.csv", "speed,pitcher,pitch_type\n91,3,CU\n")
    _write(tmp_path, "c.csv", 'version 1\nsome,junk\n"name, full",pitcher,pitch_type\r\n"Lee, Ann",4,"F""F"\r\n"x",5\r\nBo,6,\r\n')
    _write(tmp_path, "d.csv", "no header here\n1,2,3\n")
    _write(tmp_path, "e.csv", "﻿pitch_type,pitcher\nCH,7\npitch_type,pitcher\nCH,abc\nFS,8")
    _write(tmp_path, "f.csv", "")
    want = [(1, "FF", 90.0), (2, "SL", 85.5), (3, "CU", 91.0), (4, 'F"F', None), (6, None, None), (7, "CH", None), (8, "FS", None)]
    assert _read(spark, str(tmp_path)) == sorted(want, key=str)


def test_a_stray_quote_costs_one_line(spark, tmp_path):
    _write(tmp_path, "a.csv", 'pitcher,pitch_type\n1,"FF\n2,SL\n3,"CU"\n')
    got = _read(spark, str(tmp_path))
    assert (2, "SL", None) in got and (3, "CU", None) in got and len(got) <= 3


@pytest.mark.parametrize("size", [1, 2, 7, 50, 1000])
def test_byte_ranges_lose_and_repeat_nothing(spark, tmp_path, size):
    rnd = random.Random(size)
    rows = [(i, rnd.choice(["FF", "Sé", None, "a,b", 'q"t']), round(rnd.random() * 90, 2)) for i in range(60)]
    cell = lambda v: "" if v is None else '"' + v.replace('"', '""') + '"' if isinstance(v, str) and set(v) & set(',"') else str(v)
    body = "".join(",".join(map(cell, r)) + rnd.choice(["\n", "\r\n"]) for r in rows)
    _write(tmp_path, "a.csv", "junk\npitcher,pitch_type,speed\n" + body)
    _write(tmp_path, "b.csv", "pitcher,pitch_type,speed\n" + body.rstrip("\r\n"))
    files = [(f"{tmp_path}/{n}", os.path.getsize(f"{tmp_path}/{n}")) for n in ("a.csv", "b.csv")]
    reader = TO.TolerantReader(["pitcher", "pitch_type", "speed"], files, size)
    got = []
    for split in reader.partitions():
        for b in reader.read(split):
            got += [(int(r["pitcher"]), r["pitch_type"], float(r["speed"])) for r in b.to_pylist()]
    assert sorted(got, key=str) == sorted(rows * 2, key=str)
    if size >= 50:
        assert _read(spark, str(tmp_path), split_bytes=size) == sorted(rows * 2, key=str)


def test_small_reads_join_lines(tmp_path, monkeypatch):
    monkeypatch.setattr(TO, "READ_BYTES", 3)
    _write(tmp_path, "a.csv", "pitcher,x\n1000001,long field\n2,y\n")
    reader = TO.TolerantReader(["pitcher"], [(f"{tmp_path}/a.csv", 33)], 10)
    assert [r["pitcher"] for s in reader.partitions() for b in reader.read(s) for r in b.to_pylist()] == ["1000001", "2"]


def test_small_files_share_a_task():
    splits = TO.deal([(f"f{i}", 10) for i in range(20)] + [("big", 250)], 100)
    assert sum(z - a for s in splits for _, a, z in s.ranges) == 450 and len(splits) == 5
    assert json.dumps([s.ranges for s in splits])


def test_headers_in_one_job(spark, tmp_path):
    for i in range(12):
        _write(tmp_path, f"{i:02d}.csv", f'game_pk,"a, b",x,x,\n{i},1,2,3,4\n')
    before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    got = FI.headers(spark, FI.list_files(spark, [str(tmp_path)]))
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - len(before) <= 2
    assert {h for _, h in got} == {("game_pk", "a, b", "x", "_c3", "_c4")}
    assert sorted(r.game_pk for r in FI.read_pitch_log(spark, str(tmp_path)).collect()) == list(range(12))
