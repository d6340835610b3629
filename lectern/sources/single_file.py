"""One ordered file of a given name from a distributed table.

Rows are range-partitioned and sorted by Spark; each task writes its range as a part of its own and gives
its size; prefix sums over the parts' sizes (a row per task, never rows of the table) give offsets; tasks
then copy the parts to their offsets in one file, and a rename puts it in place. A part's name is of one
attempt, a copy writes the same bytes at the same place, and the rename comes last: a task that is lost
and run again, or twice, leaves the same file, and a job that fails leaves the old one.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator
from itertools import accumulate
from urllib.parse import unquote, urlparse

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

#: Bytes that a task copies at a time.
STEP = 4 << 20


def _local(path: str) -> str:
    """The path as the operating system names it; the file's folder must be one that driver and executors share."""
    got = urlparse(path)
    if got.scheme not in ("", "file") or got.netloc:
        raise ValueError(f"a single file can be written to a shared folder only, not to {path}")
    return unquote(got.path) if got.scheme else path


def csv_line(columns: list[str]) -> Column:
    """The columns as one CSV record; a field is quoted where it holds a comma, a quote or a line end. Null is an empty field."""
    fields = []
    for c in columns:
        text = F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
        quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
        odd = text.rlike('[",\r\n]') if len(columns) > 1 else text.rlike('[",\r\n]') | (text == "")
        fields.append(F.when(odd, quoted).otherwise(text))
    return F.concat_ws(",", *fields)


def write_lines(lines: DataFrame, path: str, order: list[str], line: str = "line", header: str | None = None, bom: bool = False, end: str = "\r\n") -> int:
    """Writes the column ``line`` as one UTF-8 file, ordered by ``order`` and then by the line itself; gives its size in bytes.

    ``header`` is the first line, ``bom`` puts a byte order mark before it. Rows with equal keys and lines stay, each as a
    line; a null line is an empty one; nulls in ``order`` come first. An empty table gives the header alone, or an empty
    file. An old file of this name is replaced at the end. Other columns are passed over.
    """
    target = _local(path)
    spark, folder = lines.sparkSession, os.path.dirname(target)
    work = os.path.join(folder, f".{os.path.basename(target)}.{uuid.uuid4().hex}")
    os.makedirs(work)
    text = F.coalesce(F.col(f"`{line}`").cast("string"), F.lit(""))
    keyed = lines.select(*(F.col(f"`{c}`").alias(f"key{i}") for i, c in enumerate(order)), text.alias("line"))
    ranged = keyed.repartitionByRange(*keyed.columns).sortWithinPartitions(*keyed.columns).select("line")

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place = TaskContext.get().partitionId()
        name = os.path.join(work, f"part-{place}-{uuid.uuid4().hex}")
        with open(name, "wb") as out:
            for batch in batches:
                out.write("".join(f"{x}{end}" for x in batch["line"]).encode("utf-8", "surrogatepass"))
            out.flush()
            os.fsync(out.fileno())
            size = out.tell()
        yield pd.DataFrame({"place": [place], "name": [name], "size": [size]})

    def copy(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, at in batch.itertuples(index=False):
                with open(name, "rb") as source, open(whole, "r+b") as out:
                    out.seek(at)
                    while piece := source.read(STEP):
                        out.write(piece)
                    out.flush()
                    os.fsync(out.fileno())
                yield pd.DataFrame({"name": [name]})

    try:
        parts = sorted(tuple(r) for r in ranged.mapInPandas(part, "place int, name string, size long").collect())  # a row per task
        head = (b"\xef\xbb\xbf" if bom else b"") + (b"" if header is None else f"{header}{end}".encode())
        ends = list(accumulate((size for _, _, size in parts), initial=len(head)))
        whole = os.path.join(work, "whole")
        with open(whole, "wb") as out:
            out.write(head)
            out.truncate(ends[-1])
        filled = [(name, at) for (_, name, size), at in zip(parts, ends) if size]
        if filled:
            todo = spark.createDataFrame(filled, "name string, at long").repartition(min(len(filled), spark.sparkContext.defaultParallelism))
            if todo.mapInPandas(copy, "name string").count() != len(filled):
                raise OSError(f"parts of {target} are missing")
        os.replace(whole, target)
    finally:
        shutil.rmtree(work, ignore_errors=True)  # parts of this call alone
    return ends[-1]


def write_csv(df: DataFrame, path: str, order: list[str], columns: list[str] | None = None, bom: bool = True) -> int:
    """``df`` as one CSV file with a header, ordered by ``order``, for spreadsheets (byte order mark, CR and LF); gives its size."""
    columns = columns or df.columns
    names = ",".join(f'"{c.replace(chr(34), chr(34) * 2)}"' if set(c) & set('",\r\n') else c for c in columns)
    rows = df.select(*(F.col(f"`{c}`").alias(f"order{i}") for i, c in enumerate(order)), csv_line(columns).alias("record"))
    return write_lines(rows, path, [f"order{i}" for i in range(len(order))], "record", names, bom)


def write_markdown(fragments: DataFrame, path: str) -> int:
    """Fragments (section int, place long, text) as one Markdown file, by section and place; gives its size."""
    return write_lines(fragments, path, ["section", "place"], "text", end="\n")
