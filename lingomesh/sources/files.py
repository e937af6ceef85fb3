"""Many exports at once (S5) and one-pass ingestion of a file.

:func:`probe_files` looks at all files in one job: every task reads its lines byte by byte and sends, per file, whether
they are UTF-8, whether windows-1252 leaves a byte undefined, how many there are, and the first non-blank lines
of the file's head.  Encoding, delimiter and header of a file are chosen by the same rules as for a single file, still on
the executors; a row per file reaches the driver, which holds the list of files anyway.  :func:`scan_files` then
reads all files of one layout (encoding, delimiter, header) with one scan, so the number of jobs and the size of the plan follow the number
of layouts, not of files.

:func:`ingest_delimited` reads a file once: counts of what decides the encoding and of bad lines are observed while its
fields are written, and the text is decoded when the written fields are read.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .. import labels as L
from .delimited import _PY_CODEC, CP1252_UNDEFINED, CSV_FIELDS, PROBE_LINES, Scan, _decoded, _plain, detect_delimiter, field_count, parse_lines

FILE_UNREADABLE = "Datei nicht lesbar."
_LINE = 33                # bits of a line's number in its task, as Spark's row ids have them


@dataclass
class FileLayout:
    """What the probe found in one file; ``problem`` is null for a readable one."""

    path: str
    code: str | None
    encoding: str | None
    delimiter: str | None
    columns: list[str] | None
    problem: str | None


@dataclass
class FilesScan:
    """``rows``: ``variant, file, pos`` and the columns of all layouts; ``bad_lines``: ``variant, file, pos`` of lines with too many fields;
    ``files``: a layout per listed file, in the order of the list."""

    rows: DataFrame | None
    bad_lines: DataFrame | None
    files: list[FileLayout]

    def problems(self) -> list[tuple[str, str | None, str]]:
        return [(f.path, f.code, f.problem) for f in self.files if f.problem]


def _file_name(path: Column) -> Column:
    """A file's path as the list has it: decoded, without scheme."""
    return F.regexp_replace(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), "^[a-z]+:/+", "/")


def _lines(spark: SparkSession, paths: list[str], header: bool) -> DataFrame:
    """``file, start, line_no, value``: lines byte by byte (ISO-8859-1), where their split begins and their number in the task."""
    return (
        spark.read.option("encoding", "ISO-8859-1").option("quote", "").option("header", str(header).lower()).option("enforceSchema", "true")
        .option("ignoreCorruptFiles", str(not header).lower()).schema("value string").csv(paths, sep="\u0000")
        .select(_file_name(F.col("_metadata.file_path")).alias("file"), F.col("_metadata.file_block_start").alias("start"),
                F.monotonically_increasing_id().bitwiseAND((1 << _LINE) - 1).alias("line_no"), "value")
    )


def _parts_of_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per run of lines of one file: ``file, lines, utf8, undefined, head``."""
    def done(file, lines, utf8, undefined, head):
        return pa.RecordBatch.from_arrays([pa.array([file]), pa.array([lines]), pa.array([utf8]), pa.array([undefined]), pa.array([head], pa.list_(pa.string()))],
                                          names=["file", "lines", "utf8", "undefined", "head"])

    state = None
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("file", "utf8", "undefined", "head")]
        for file, rows in groupby(zip(*columns), key=lambda r: r[0]):
            if state is None or state[0] != file:
                if state is not None:
                    yield done(*state)
                state = [file, 0, True, False, []]
            for _, utf8, undefined, head in rows:
                state[1] += 1
                state[2] &= utf8
                state[3] |= undefined
                if head is not None and head.strip() and len(state[4]) < PROBE_LINES:
                    state[4].append(head)
    if state is not None:
        yield done(*state)


def _encoding(utf8: bool, undefined: bool) -> str:
    return "UTF-8" if utf8 else "ISO-8859-1" if undefined else "windows-1252"


def _header(head: list[str], encoding: str) -> tuple[str, list[str]]:
    """Delimiter and column names from the first lines, read byte by byte."""
    lines = [x.encode("latin-1").decode(_PY_CODEC[encoding], errors="replace") for x in head]
    sep = detect_delimiter(lines)
    names = next(csv.reader([lines[0]], delimiter=sep, quotechar='"')) if sep != L.SINGLE_COLUMN_SEP else [lines[0]]
    return sep, [n.replace("\ufeff", "").strip() for n in names]


def _layouts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            encoding = _encoding(r["utf8"], r["undefined"])
            sep, names = _header(r["head"], encoding) if r["head"] else (None, None)
            out.append({"file": r["file"], "encoding": encoding, "sep": sep, "names": names})
        yield pa.RecordBatch.from_pylist(out, pa.schema([("file", pa.string()), ("encoding", pa.string()), ("sep", pa.string()), ("names", pa.list_(pa.string()))]))


def _sizes(spark: SparkSession, paths: list[str]) -> dict[str, int]:
    """Bytes of the listed files that are there: one listing per folder."""
    jvm, conf, found = spark._jvm, spark._jsc.hadoopConfiguration(), {}
    for folder in sorted({p.rpartition("/")[0] for p in paths}):
        try:
            path = jvm.org.apache.hadoop.fs.Path(folder or "/")
            for status in path.getFileSystem(conf).listStatus(path):
                if status.isFile():
                    found[f"{folder}/{status.getPath().getName()}"] = status.getLen()
        except Py4JJavaError:
            continue
    return {p: found[p] for p in paths if p in found}


def probe_files(spark: SparkSession, files: list[tuple[str, str | None]]) -> list[FileLayout]:
    """Layout or problem of each ``(path, code)``; every path names one file.  One job over all files, whatever their number
    (and one over those without a line, if there are any).

    A file that is not there or that the reader gives up on is reported, an empty or blank one too; none stops the others.
    """
    sizes = _sizes(spark, [p for p, _ in files])
    found = {}
    if readable := sorted(p for p, n in sizes.items() if n > 0):
        lines = _lines(spark, readable, header=False)
        utf8 = F.coalesce(F.is_valid_utf8(F.encode("value", "ISO-8859-1").cast("string")), F.lit(True))
        flags = lines.select("file", utf8.alias("utf8"), F.coalesce(F.col("value").rlike(CP1252_UNDEFINED), F.lit(False)).alias("undefined"),
                             F.when((F.col("start") == 0), F.col("value")).alias("head"))
        parts = flags.mapInArrow(_parts_of_files, "file string, lines long, utf8 boolean, undefined boolean, head array<string>")
        whole = parts.groupBy("file").agg(F.bool_and("utf8").alias("utf8"), F.bool_or("undefined").alias("undefined"),
                                          F.max_by("head", F.size("head")).alias("head"))
        rows = whole.mapInArrow(_layouts, "file string, encoding string, sep string, names array<string>").collect()    # a row per listed file
        found = {r["file"]: r for r in rows}
    blank = set()
    if silent := [p for p in sizes if sizes[p] > 0 and _plain(p) not in found]:       # no line but blank ones, or the reader gave up
        text = spark.read.option("ignoreCorruptFiles", "true").text(silent).select(_file_name(F.col("_metadata.file_path")).alias("file"))
        blank = {r["file"] for r in text.distinct().collect()}
    out = []
    for path, code in files:
        r = found.get(_plain(path))
        if r is not None and r["sep"] is not None:
            out.append(FileLayout(path, code, r["encoding"], r["sep"], r["names"], None))
        else:
            empty = r is not None or sizes.get(path) == 0 or _plain(path) in blank
            out.append(FileLayout(path, code, None, None, None, L.FILE_EMPTY if empty else FILE_UNREADABLE))
    return out


def scan_files(spark: SparkSession, files: list[tuple[str, str | None]]) -> FilesScan:
    """All rows of the listed files, ``variant`` being a file's code.  ``pos`` follows the order of the list, then of the lines.

    One scan per layout; the list (path, place, code) is broadcast, it is no larger than the list the caller holds.
    """
    layouts = probe_files(spark, files)
    place = {f.path: k for k, f in enumerate(layouts)}
    rows = bad = None
    key = lambda f: (f.encoding, f.delimiter, f.columns)                       # noqa: E731
    for (encoding, sep, names), group in groupby(sorted((f for f in layouts if not f.problem), key=key), key=key):
        group = list(group)
        listed = spark.createDataFrame([(_plain(f.path), place[f.path], f.code) for f in group], "__file string, __place long, variant string")
        lines = _lines(spark, [f.path for f in group], header=True).where(F.col("value").isNotNull())
        lines = lines.join(F.broadcast(listed), F.col("file") == F.col("__file"))
        pos = F.shiftleft("__place", 43) + F.col("start") + F.col("line_no")
        lines = lines.select("variant", "file", pos.alias("pos"), _decoded(F.col("value"), encoding).alias("line"))
        part, long = parse_lines(lines, names, sep, keep=["variant", "file", "pos"])
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
        long = long.drop("line")
        bad = long if bad is None else bad.unionByName(long)
    return FilesScan(rows, bad, layouts)


def ingest_delimited(spark: SparkSession, path: str, out: str, sep: str | None = None) -> tuple[Scan, dict[str, int]]:
    """Read a delimited file once, write its fields below ``out`` as Parquet and return the scan over what is written and the counts
    ``lines, bad_lines, not_utf8, undefined`` (of the lines below the header).

    Lines are split into fields byte by byte, which is the same in every encoding at hand (delimiters and quotes are ASCII).  The counts
    are observed on the way and give the encoding, by which the fields are decoded when they are read.  Only the header and the
    lines after it that tell the delimiter are looked at beforehand.
    """
    head = [r["value"] for r in _lines(spark, [path], header=False).select("value").limit(PROBE_LINES * 4).collect() if r["value"] and r["value"].strip()]
    if not head:
        raise ValueError(L.FILE_EMPTY)
    sep = sep or detect_delimiter(head[:PROBE_LINES])
    names = next(csv.reader([head[0]], delimiter=sep, quotechar='"')) if sep != L.SINGLE_COLUMN_SEP else [head[0]]
    lines = _lines(spark, [path], header=True).where(F.trim("value") != "")
    metrics = Observation("ingest")
    seen = lines.select((F.col("start") + F.col("line_no")).alias("pos"), "value", (field_count(F.col("value"), sep) > len(names)).alias("bad")).observe(
        metrics, F.count(F.lit(1)).alias("lines"), F.count_if("bad").alias("bad_lines"),
        F.count_if(~F.is_valid_utf8(F.encode("value", "ISO-8859-1").cast("string"))).alias("not_utf8"),
        F.count_if(F.col("value").rlike(CP1252_UNDEFINED)).alias("undefined"))
    fields = F.when(~F.col("bad"), F.from_csv("value", F.lit(", ".join(f"c{i} string" for i in range(len(names)))), {**CSV_FIELDS, "sep": sep}))
    seen.select("pos", "bad", fields.alias("f")).select("pos", "bad", "f.*").write.parquet(out)
    counts = metrics.get
    own = head[0].encode("latin-1")
    utf8 = counts["not_utf8"] == 0 and own.decode("utf-8", "ignore").encode() == own
    encoding = _encoding(utf8, counts["undefined"] > 0 or re.search(CP1252_UNDEFINED, head[0]) is not None)
    names = [n.encode("latin-1").decode(_PY_CODEC[encoding], errors="replace").replace("\ufeff", "").strip() for n in names]
    stored = spark.read.parquet(out)
    value = [_decoded(F.col(f"c{i}"), encoding) for i in range(len(names))]
    rows = stored.where("NOT bad").select("pos", *[F.when(~v.isin(*L.MISSING_WORDS), v).alias(n) for v, n in zip(value, names)])
    return Scan(rows=rows, bad_lines=stored.where("bad").select("pos"), delimiter=sep, encoding=encoding, columns=names), counts
