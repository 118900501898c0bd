"""One column's text at a time, all columns."""
from moundflow.operators import analytics as AN


def test_search(spark):
    df = spark.createDataFrame([(1, "ab", "cd", 12, None), (2, "xB|C", None, 3, 1.5), (3, None, None, 120, None)], "id long, a string, b string, `n.o` long, d double")
    found = lambda q, cols=None: sorted(r.id for r in AN.text_search(df, q, cols).collect())
    assert found("b|c") == [2] and found("bc") == [] and found("12") == [1, 3] and found("1.5") == [2]
    assert found("12", ["a", "b"]) == [] and found("AB", ["a"]) == [1]
