"""The pitch log as a folder of CSV files that keep to no common form: the input
of the query on the tolerant reader."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines at the head of each layout's files; the last one is the header.
HEADS = (
    ['pitcher,pitch_type,"note, free",src_key,speed'],
    ["exported log", "second line, of no use", "speed,src_key,pitch_type,extra,pitcher"],
    ["src_key, pitch_type ,pitcher"],
)


def write_untidy(raw: DataFrame, folder: str) -> None:
    """Text files of three layouts, by src_key: other columns in another order,
    junk before the header, quoted commas, repeated headers.  Every 11th row has a
    field too many, every 13th a pitcher that is no number."""
    key = F.col("src_key")
    text = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("src_key", "pitch_type", "release_speed")}
    text["pitcher"] = F.when(key % 13 == 0, "n/a").otherwise(F.coalesce(F.col("pitcher").cast("string"), F.lit("")))
    order = (("pitcher", "pitch_type", None, "src_key", "release_speed"), ("release_speed", "src_key", "pitch_type", None, "pitcher"),
             ("src_key", "pitch_type", "pitcher"))
    for layout, columns in enumerate(order):
        cells = [text[c] if c else F.lit('"said ""so"", twice"') for c in columns]
        line = F.concat(F.concat_ws(",", *cells), F.when(key % 11 == 0, ",surplus").otherwise(""),
                        F.when(key % 17 == 0, "\n" + HEADS[layout][-1]).otherwise(""))
        rows = raw.where(key % 3 == layout).select(line.alias("value"))
        _headed(rows, HEADS[layout]).write.text(f"{folder}/layout={layout}")


def _headed(lines: DataFrame, head: list[str]) -> DataFrame:
    """Each partition, and so each file, begins with the head."""
    def run(batches):
        import pyarrow as pa
        first = True
        for b in batches:
            if first and b.num_rows:
                first = False
                yield pa.RecordBatch.from_arrays([pa.array(head, b.schema.field(0).type)], schema=b.schema)
            yield b
    return lines.mapInArrow(run, "value string")
