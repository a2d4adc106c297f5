"""Readers that find out encoding and delimiter, then let Spark read the file."""

from __future__ import annotations

import csv
import math
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.sources import records, workbook

EXTENSIONS = (".csv", ".tsv", ".txt", ".parquet", ".orc", ".json", ".xls", ".xlsx")
DELIMITERS = (",", ";", "\t", "|")
MAX_BYTES = 10 * 2**30
HEAD_BYTES = 65_536


def check_upload(name: str, size: int, most: int = MAX_BYTES) -> None:
    """Raise for files that are not taken: no name, another kind, empty, too large."""
    if not name or name.startswith(".") or "/" in name or "\\" in name:
        raise ValueError(f"bad file name {name!r}")
    if not name.lower().endswith(EXTENSIONS):
        raise ValueError(f"{name}: only {', '.join(EXTENSIONS)}")
    if not 0 < size <= most:
        raise ValueError(f"{name}: {size} bytes")


def head_bytes(spark: SparkSession, path: str, most: int = HEAD_BYTES) -> bytes:
    """The first bytes of a file, or of a folder's first file that has any, wherever Spark can read it: local disk, HDFS, an object store."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    if system.getFileStatus(hadoop).isDirectory():
        parts = sorted((s.getPath() for s in system.listStatus(hadoop) if s.isFile() and s.getLen() and not s.getPath().getName().startswith(("_", "."))), key=lambda p: p.getName())
        hadoop = parts[0] if parts else hadoop
    stream = system.open(hadoop)
    try:
        size = min(most, system.getFileStatus(hadoop).getLen())
        return bytes(stream.readNBytes(int(size)))
    finally:
        stream.close()


def sniff_encoding(head: bytes) -> str:
    """By byte-order mark, else UTF-8 if it decodes (a cut last character aside), else Latin-1."""
    for mark, name in ((b"\xef\xbb\xbf", "UTF-8"), (b"\xff\xfe", "UTF-16"), (b"\xfe\xff", "UTF-16")):
        if head.startswith(mark):
            return name
    for cut in range(4):
        try:
            head[: len(head) - cut].decode("utf-8")
            return "UTF-8"
        except UnicodeDecodeError:
            continue
    return "ISO-8859-1"


def unwrapped(line: str) -> str:
    """A line that is one quoted field with the real line in it, as spreadsheets write."""
    inner = line.strip()
    return inner[1:-1].replace('""', '"') if len(inner) > 1 and inner[0] == inner[-1] == '"' and len(next(csv.reader([inner]))) == 1 else line


def sniff_delimiter(text: str) -> tuple[str, bool]:
    """(delimiter, whether every line is wrapped in quotes): the delimiter that splits the sample into most equal columns."""
    lines = [x for x in text.splitlines() if x.strip()][:50]
    if not lines:
        raise ValueError("the file is empty")
    wrapped = all(unwrapped(x) != x for x in lines)
    lines = [unwrapped(x) for x in lines] if wrapped else lines
    best = (0.0, ",")
    for d in DELIMITERS:
        widths = Counter(len(r) for r in csv.reader(lines, delimiter=d))
        width, votes = widths.most_common(1)[0]
        if width > 1:
            best = max(best, (votes / len(lines) * width, d), key=lambda x: x[0])
    if not best[0]:
        raise ValueError("the file has a single column")
    return best[1], wrapped


def has_line_breaks(text: str, delimiter: str) -> bool:
    """Whether a quoted field of the sample goes on over a line's end."""
    whole = text[: text.rfind("\n") + 1] or text
    try:
        return any("\n" in field for record in csv.reader(whole.splitlines(keepends=True), delimiter=delimiter) for field in record)
    except csv.Error:
        return False


def clean_names(df: DataFrame) -> DataFrame:
    return df.toDF(*(c.strip().lstrip("﻿").strip('"').strip() for c in df.columns))


def read_csv(spark: SparkSession, path: str, tolerant: bool = False, infer: bool = True, multi_line: bool | None = None) -> DataFrame:
    """A delimited file with a header row.

    ``tolerant`` drops lines that do not fit. ``multi_line`` says whether fields hold line
    breaks; by default the file tells, of which all lines are looked at if its first 64 KB hold
    quotes. Such files are read in ranges as well (``records``), but for those in UTF-16 or with
    bare carriage returns. Lines wrapped in quotes as a whole are unwrapped and parsed again, on
    the executors like any other line.
    """
    head = head_bytes(spark, path)
    encoding = sniff_encoding(head)
    text = head.decode({"UTF-8": "utf-8-sig"}.get(encoding, encoding), errors="replace")
    delimiter, wrapped = sniff_delimiter(text)
    options = {"sep": delimiter, "header": "true", "encoding": encoding, "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true", "inferSchema": str(infer).lower(), "escape": '"', "mode": "DROPMALFORMED" if tolerant else "PERMISSIVE"}
    if not wrapped:
        split = encoding != "UTF-16" and "\n" in text
        broken = has_line_breaks(text, delimiter) or (split and '"' in text and records.line_breaks_in_fields(spark, path)) if multi_line is None else multi_line
        if broken and split:
            header = next(csv.reader(text.splitlines(keepends=True), delimiter=delimiter))
            out = records.parsed(records.records(spark, path, encoding), [h.strip() for h in header], delimiter, tolerant)
            return clean_names(narrowed(out, ("timestamp", "boolean")) if infer else out)
        return clean_names(spark.read.options(**options, multiLine=str(broken).lower()).csv(path))
    header = next(csv.reader([unwrapped(text.splitlines()[0])], delimiter=delimiter))
    schema = ", ".join(f"`{h.strip()}` STRING" for h in header)
    # one field a line by a separator that no text has: each file's header goes, quotes are taken off
    rows = spark.read.schema("line string").options(sep="\u0001", header="true", encoding=encoding, escape='"', ignoreLeadingWhiteSpace="true").csv(path)
    parsed = rows.select(F.from_csv("line", schema, {"sep": delimiter, "ignoreLeadingWhiteSpace": "true"}).alias("r")).select("r.*")
    return narrowed(parsed) if infer else parsed


def narrowed(df: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """Text columns as longs, doubles or ``more`` kinds, the first as which every value reads."""
    if not df.columns:
        return df
    kinds = ("bigint", "double", *more)
    row = df.agg(*(F.count(c).alias(f"n {c}") for c in df.columns), *(F.count(F.col(c).try_cast(k)).alias(f"{k} {c}") for c in df.columns for k in kinds)).first()
    kind = lambda c: next((k for k in kinds if row[f"n {c}"] and row[f"{k} {c}"] == row[f"n {c}"]), "string")
    return df.select(*(F.col(c).try_cast(kind(c)).alias(c) for c in df.columns))


def read_excel(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """A sheet of a workbook (.xlsx), the first by default: its first row has the names, dates come as timestamps."""
    if path.lower().rstrip("/").endswith(".xls"):
        raise ValueError(f"{path}: workbooks of the old binary format are not read; save it as .xlsx")
    return narrowed(workbook.named_columns(workbook.book_rows(spark, path, sheet)), ("timestamp", "boolean"))


def read_table(spark: SparkSession, path: str, **options) -> DataFrame:
    """By extension; an empty table is an error."""
    low = path.lower().rstrip("/")
    if low.endswith((".csv", ".tsv", ".txt")):
        df = read_csv(spark, path, **options)
    elif low.endswith((".xls", ".xlsx")):
        df = read_excel(spark, path, **options)
    elif low.endswith((".json", ".orc")):
        df = spark.read.format(low.rsplit(".", 1)[1]).load(path)
    else:
        df = spark.read.parquet(path)
    df = clean_names(df)
    if not df.columns or df.isEmpty():
        raise ValueError(f"{path} has no rows")
    return df


def read_jdbc(spark: SparkSession, url: str, name: str, column: str | None = None, low: int | None = None, high: int | None = None, parts: int = 8, **properties: str) -> DataFrame:
    """A database table; with a number column, in ``parts`` ranges of it.

    Between ``low`` and ``high`` the ranges are of equal width. Without them they are of about
    equal numbers of rows: the column alone is read first, and a sketch of its values in Spark
    gives the bounds. Rows without a value come with the first range.
    """
    reader = spark.read.format("jdbc").options(url=url, dbtable=name, **properties)
    if not column:
        return reader.load()
    if low is not None and high is not None:
        return reader.options(partitionColumn=column, lowerBound=low, upperBound=high, numPartitions=parts).load()
    least, most = reader.load().agg(F.min(column), F.max(column)).first()
    if least is None or least == most:
        return reader.load()
    spread = reader.options(partitionColumn=column, lowerBound=math.floor(least), upperBound=math.ceil(most), numPartitions=parts).load()
    cuts = spread.agg(F.percentile_approx(F.col(column).cast("double"), [i / parts for i in range(1, parts)], 10_000)).first()[0]
    field = next(f for f in spread.schema if f.name.lower() == column.lower())
    kind, quoted = field.dataType, spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url).quoteIdentifier(field.name)
    text = [str(int(c)) if isinstance(kind, T.IntegralType) else repr(c) for c in sorted(set(cuts)) if c > float(least)]
    ranges = [" AND ".join([*([f"{quoted} >= {a}"] if a else []), *([f"{quoted} < {b}"] if b else [])]) for a, b in zip([None, *text], [*text, None])]
    if not text:
        return reader.load()
    ranges[0] = f"({ranges[0]}) OR {quoted} IS NULL"
    return spark.read.jdbc(url, name, predicates=ranges, properties=properties)


def read_group(spark: SparkSession, paths: dict[str, str]) -> dict[str, DataFrame]:
    """All tables of a group by name."""
    return {name: read_table(spark, path) for name, path in paths.items()}


def find_dataset(spark: SparkSession, root: str, dataset_id: str) -> str:
    """The newest file or folder below ``root`` whose name starts with the data set's id."""
    place = spark._jvm.org.apache.hadoop.fs.Path
    system = place(root).getFileSystem(spark._jsc.hadoopConfiguration())
    found = [s for depth in ("", "*/", "*/*/", "*/*/*/") for s in system.globStatus(place(f"{root.rstrip('/')}/{depth}{dataset_id}*")) or []]
    if not found:
        raise FileNotFoundError(f"no data set {dataset_id} below {root}")
    return max(found, key=lambda s: (s.getModificationTime(), s.getPath().toString())).getPath().toString()


def preview(df: DataFrame, limit: int = 10) -> DataFrame:
    if not 1 <= limit <= 50:
        raise ValueError("a preview has 1 to 50 rows")
    return df.limit(limit)


def describe(df: DataFrame) -> dict:
    return {"rows": df.count(), "columns": len(df.columns), "column_names": df.columns}
