"""A partitioned reader of CSV files that keep to no common form.

``TolerantCsv`` is a Python data source: each file has its own header (found
among its first lines, junk may stand before it), is cut into byte ranges that
tasks read on their own, and loses only the lines that do not fit its header."""
from __future__ import annotations

import csv
import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from moundflow.sources.store import open_store

#: Lines, and bytes, that are searched for a file's header.
HEADER_LINES, HEADER_BYTES = 50, 1 << 20
#: Bytes of a task's input, and of one read.
SPLIT_BYTES, READ_BYTES = 64 << 20, 4 << 20
#: Rows of an Arrow batch.
ROWS = 8192


def fields(line: str) -> list[str]:
    """The fields of one line; quotes may hold commas and doubled quotes, but not
    a line's end, so a stray quote costs its own line and no other."""
    return next(csv.reader([line]), []) if '"' in line else line.split(",")


@dataclass
class Layout:
    """Where a file's rows begin, how many fields they have, and the place of
    each wanted column (None where the file lacks it)."""

    start: int
    header: list[str]
    places: list[int | None]


def find_layout(head: bytes, wanted: list[str], lines: int = HEADER_LINES) -> Layout | None:
    """The first of the first lines that names a wanted column."""
    at = 0
    for line in head.split(b"\n")[:lines]:
        names = [c.strip() for c in fields(line.decode("utf-8", "replace").lstrip("﻿").rstrip("\r"))]
        at += len(line) + 1
        if set(names) & set(wanted):
            return Layout(at, names, [names.index(w) if w in names else None for w in wanted])
    return None


def lines_of(f, start: int, end: int) -> Iterator[bytes]:
    """Lines whose first byte is in [start, end) of an open file; a line may end beyond."""
    at, rest = start, b""
    while True:
        block = f.read_at(READ_BYTES, at + len(rest))
        parts = (rest + block).split(b"\n")
        rest = parts.pop()
        for p in parts:
            if at >= end:
                return
            yield p
            at += len(p) + 1
        if at >= end:
            return
        if not block:
            if rest:
                yield rest
            return


class Split(InputPartition):
    """Byte ranges (file, start, end) that one task reads; small files share a task."""

    def __init__(self, ranges: list[tuple[str, int, int]]):
        self.ranges = ranges


def deal(files: list[tuple[str, int]], split_bytes: int) -> list[Split]:
    out, some, size = [], [], 0
    for name, length in files:
        for a in range(0, length, split_bytes):
            z = min(length, a + split_bytes)
            if some and size + z - a > split_bytes:
                out.append(Split(some))
                some, size = [], 0
            some.append((name, a, z))
            size += z - a
    return [*out, Split(some)] if some else out


class TolerantCsv(DataSource):
    """Options: ``files`` (JSON list of [path, bytes]), ``split_bytes``.  The
    schema's columns are the wanted ones and are read as text; an empty field is
    null.  Dropped are lines before and like the header, and lines with another
    number of fields; a file without a header gives no rows."""

    @classmethod
    def name(cls) -> str:
        return "tolerant_csv"

    def schema(self):
        raise ValueError("name the wanted columns with schema()")

    def reader(self, schema):
        return TolerantReader(schema.names, json.loads(self.options["files"]), int(self.options.get("split_bytes", SPLIT_BYTES)))


class TolerantReader(DataSourceReader):
    def __init__(self, wanted: list[str], files: list, split_bytes: int):
        self.wanted, self.files, self.split_bytes = wanted, files, split_bytes

    def partitions(self) -> list[Split]:
        return deal([tuple(f) for f in self.files], self.split_bytes) or [Split([])]

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(w, pa.string()) for w in self.wanted])
        rows: list[list] = []

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)] if rows else [pa.array([], pa.string())] * len(schema), schema=schema)

        for name, start, end in partition.ranges:
            fs, path = open_store(name)
            with fs.open_input_file(path) as f:
                layout = find_layout(f.read_at(HEADER_BYTES, 0), self.wanted)
                if layout is None:
                    continue
                if start > layout.start:        # the line that a range cuts belongs to the range before
                    before = lines_of(f, start - 1, f.size())
                    start += len(next(before, b""))
                n = len(layout.header)
                for raw in lines_of(f, max(start, layout.start), end):
                    line = fields(raw.decode("utf-8", "replace").rstrip("\r"))
                    if len(line) == n and [c.strip() for c in line] != layout.header:
                        rows.append([(line[i] or None) if i is not None else None for i in layout.places])
                        if len(rows) >= ROWS:
                            yield batch()
                            rows.clear()
        yield batch()
