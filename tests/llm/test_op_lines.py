import brute

from moundflow.llm import line_dedup as L

ROWS = [(1, "a\nb\nc\nd\ne"), (2, "x\nb\nc\nd\ny"), (3, "b\nc\nd\ne"), (4, None), (5, ""), (6, "a\nb"), (7, "q\n\n \nq\n\n \nq"), (8, "\n\n\n\n"),
        (9, "k\n" * 9), (10, "a\nb\nc\nd\ne"), (11, "long " * 30_000 + "\nb\nc\nd"), (0, "b \nc\nd"), (None, "x\nb\nc")]


def run(spark, rows, **more):
    out = L.dedup_lines(brute.frame(spark, rows), report=True, **more)
    return sorted(((r["doc_id"], r["__n_lines"], r["__n_removed"], r["text"]) for r in out.collect()), key=str)


def test_brute_force(spark):
    rows = sorted(ROWS + [(100 + i, t) for i, t in brute.awkward()], key=lambda r: (r[0] is None, r[0]))
    rows = list(dict.fromkeys(rows))
    want = [(i, n, k, t if k else dict(rows)[i] if i is not None else t) for i, n, k, t in brute.dedup_lines(rows)]
    want = [(i, n, k, None if t == "" and (i, None) in rows else t) for i, n, k, t in want]
    # two different texts under one id: their order is that of the row key
    ids = [i for i, _ in rows]
    assert [w for w in run(spark, rows) if ids.count(w[0]) == 1] == sorted((w for w in want if ids.count(w[0]) == 1), key=str)


def test_overlapping_windows_merge_and_the_first_stays(spark):
    out = {i: t for i, _, _, t in run(spark, ROWS[:3])}
    assert out == {1: ROWS[0][1], 2: "x\ny", 3: ""}


def test_equal_rows_are_one_document(spark):
    out = run(spark, [(1, "a\nb\nc"), (1, "a\nb\nc"), (2, "a\nb\nc")])
    assert [t for *_, t in out] == ["a\nb\nc", "a\nb\nc", ""]


def test_columns_and_empty_table(spark):
    docs = brute.frame(spark, ROWS)
    assert L.dedup_lines(docs).columns == docs.columns and L.dedup_lines(docs).count() == len(ROWS)
    assert L.dedup_lines(docs.where("false")).count() == 0


def test_python_free_plan(spark):
    plan = L.dedup_lines(brute.frame(spark, ROWS))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_report_names_do_not_clash(spark):
    from moundflow.llm import line_dedup as L
    df = spark.createDataFrame([(1, "a\nb\nc", 7, 8), (2, "a\nb\nc\nd", 7, 8)], "doc_id long, text string, __n_lines long, __n_removed long")
    out = L.dedup_lines(df, report=True)
    assert out.columns == [*df.columns, "___n_lines", "___n_removed"]
    assert sorted(tuple(r) for r in out.collect()) == [(1, "a\nb\nc", 7, 8, 3, 0), (2, "d", 7, 8, 4, 3)]
