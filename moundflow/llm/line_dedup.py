"""Line dedup on overlapping windows of three lines, with DataFrame functions
only: a window that also stands earlier covers its lines, covered lines go."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moundflow.llm.base import free, named, row_key, saved

WINDOW = 3


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n")


def line_windows(docs: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """id, r1, r2, s, a, b: a row for every run of ``window`` consecutive lines
    of a text (by the index s of its first line) that are not all blank; a and b
    are two hashes of the lines."""
    t = named(text_col).cast("string")
    d = docs.select(named(id_col).alias("id"), *row_key(named(id_col), t), _lines(t).alias("x"))
    shifted = [F.slice("x", j + 1, F.greatest(F.size("x") - j, F.lit(0))) for j in range(window)]
    d = d.where(F.size("x") >= window).select("id", "r1", "r2", F.posexplode(F.arrays_zip(*[c.alias(f"l{j}") for j, c in enumerate(shifted)])).alias("s", "z"))
    part = [F.col("z").getField(f"l{j}") for j in range(window)]
    full = F.trim(F.translate(F.concat(*part), "\t\r\v\f", "    ")) != ""
    return d.where(part[-1].isNotNull() & full).select(
        "id", "r1", "r2", "s", F.xxhash64(*part).alias("a"), F.xxhash64(F.lit(9), *reversed(part)).alias("b"))


def covered_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """r1, r2, later: for each text with a later copy of some window, an array
    that says for the window at each line whether it stands earlier too.

    The first place of a window is that with the smallest id, then row key,
    then line.  Windows are collapsed map-side before they are shuffled, and a
    window's row meets only that one first place, so a passage that a third of
    all texts share costs a row per text and no pairs."""
    w = line_windows(docs, id_col, text_col, window)
    place = F.struct(F.col("id").isNull().alias("z"), "id", "r1", "r2", "s")
    # written first: adaptive execution splits the hot keys of a join of plain shuffles
    first = saved(w.groupBy("a", "b").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    marked = w.join(first, ["a", "b"]).where(place > F.col("first"))
    return marked.groupBy("r1", "r2").agg(F.collect_set("s").alias("at")).select(
        "r1", "r2", _flags(F.col("at")).alias("later"))


def _flags(at: Column) -> Column:
    """Distinct indexes to an array that is true at each of them: a lambda looks
    them up by position instead of searching."""
    s = F.concat(F.array(F.lit(-1)), F.array_sort(at))
    n = F.size(s) - 1
    return F.flatten(F.zip_with(F.slice(s, 2, n), F.slice(s, 1, n), lambda b, a: F.concat(F.array_repeat(F.lit(False), b - a - 1), F.array(F.lit(True)))))


def _covered(later: str, i: Column, window: int) -> Column:
    """Whether any of the ``window`` windows that hold line i is marked."""
    hit = F.lit(False)
    for j in range(window):
        hit = hit | F.coalesce(F.when(i >= j, F.get(F.col(later), i - j)), F.lit(False))
    return hit


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                report: bool = False) -> DataFrame:
    """The documents, same columns, without the lines of windows that stand
    earlier (in a document with a smaller id, or above in the same text).
    Overlapping windows merge: a line goes if any window that holds it goes.

    Lines are what stands between line ends; a run of lines that are all blank
    makes no window.  A text of fewer lines than a window, empty and null ones
    included, is unchanged; a text that loses every line becomes empty and
    keeps its row.  Rows equal in id and text are one document: they get the same
    result.  Null ids come after all others.  With ``report``: adds __n_lines
    and __n_removed (more underscores where these are taken).  Texts are shuffled once, to meet their marks."""
    names = docs.columns
    k1, k2, later, lines, kept = (free(docs, x) for x in ("__r1", "__r2", "__later", "__lines", "__kept"))
    r1, r2 = row_key(named(id_col), named(text_col).cast("string"))
    marks = covered_lines(docs, id_col, text_col, window).select(F.col("r1").alias(k1), F.col("r2").alias(k2), F.col("later").alias(later))
    d = docs.withColumns({k1: r1, k2: r2}).join(marks, [k1, k2], "left").withColumn(lines, _lines(named(text_col)))
    d = d.withColumn(kept, F.when(F.col(later).isNull(), F.col(lines)).otherwise(F.filter(lines, lambda x, i: ~_covered(later, i, window))))
    text = F.when(F.col(later).isNull(), named(text_col)).otherwise(F.array_join(kept, "\n"))
    more = [F.size(lines).cast("long").alias(free(docs, "__n_lines")),
            (F.size(lines) - F.size(kept)).cast("long").alias(free(docs, "__n_removed"))] if report else []
    return d.select(*[text.alias(c) if c == text_col else named(c) for c in names], *more)


ORACLE = r"""
WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents),
w AS (SELECT doc_id, s, x[s] AS a, x[s + 1] AS b, x[s + 2] AS c FROM (SELECT doc_id, x, unnest(range(1, CAST(len(x) - 1 AS BIGINT))) AS s FROM l WHERE len(x) >= 3)
      WHERE trim(translate(x[s] || x[s + 1] || x[s + 2], chr(9) || chr(11) || chr(12) || chr(13), '    ')) <> ''),
m AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, s) AS k FROM w) WHERE k > 1),
p AS (SELECT DISTINCT doc_id, unnest([s, s + 1, s + 2]) AS p FROM m),
k AS (SELECT l.doc_id, count(*) AS n_lines, count(p.p) AS n_removed, string_agg(CASE WHEN p.p IS NULL THEN x END, chr(10) ORDER BY i) AS kept
      FROM (SELECT doc_id, unnest(x) AS x, unnest(range(1, CAST(len(x) + 1 AS BIGINT))) AS i FROM l) l LEFT JOIN p ON p.doc_id = l.doc_id AND p.p = i GROUP BY l.doc_id)
SELECT doc_id, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_removed AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM k
"""
