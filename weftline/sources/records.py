"""Delimited records whose quoted fields hold line breaks, read by many tasks.

Whether a line begins inside a quoted field follows from the number of quotes before it in its
file, of which only the parity matters. A first scan counts the quotes of each range of a file
that a task reads; prefix sums over a file's ranges give the parity at which each begins. Every
range is then cut into records from its first true record on. What a range holds of records
that begin or end in others is put together per file, a piece or two a range.

As RFC 4180 has it, quotes stand around fields and, doubled, inside them; a file that uses them
as plain characters is misread here as by any parser.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

PIECE = "file long, begin long, kind int, text string"
#: Kinds of pieces: a record, the rest of one from an earlier range, one that goes on, and a file's header that does.
RECORD, REST, OPEN, HEADER = range(4)


def quotes_of(line: Column) -> Column:
    return F.char_length(line) - F.char_length(F.replace(line, F.lit('"'), F.lit("")))


def raw_lines(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    """file (hash), begin (of the range), line."""
    lines = spark.read.text(path, lineSep="\n").select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("begin"), F.col("value").alias("line"))
    return lines if encoding.upper() == "UTF-8" else lines.withColumn("line", F.decode(F.col("line").cast("binary"), encoding))


def line_breaks_in_fields(spark: SparkSession, path: str) -> bool:
    """Whether any line of the file has an odd number of quotes."""
    return not raw_lines(spark, path, "UTF-8").filter(quotes_of(F.col("line")) % 2 == 1).isEmpty()


def parities(lines: DataFrame) -> dict[tuple[int, int], bool]:
    """For each range, one for some hundred megabytes of input, whether it begins inside a field."""
    counts = lines.groupBy("file", "begin").agg(F.sum(quotes_of(F.col("line"))).alias("n"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("begin").rowsBetween(Window.unboundedPreceding, -1))
    return {(r["file"], r["begin"]): bool(r["odd"]) for r in counts.select("file", "begin", (F.coalesce(before, F.lit(0)) % 2 == 1).alias("odd")).collect()}


def pieces(batches, inside: dict[tuple[int, int], bool]):
    """mapInArrow over lines in the order of the file: the records of each range, and its pieces of others."""
    now, held, kind, odd = None, [], RECORD, False
    out: list[tuple[int, int, int, str]] = []

    def close(last: bool):
        """Ends a record, or at a range's end what is left of one."""
        nonlocal held, kind
        if held:
            whole = kind if kind in (REST, HEADER) else RECORD
            done = "\n".join(held)
            if last and odd:
                out.append((*now, {RECORD: OPEN, HEADER: HEADER, REST: REST}[whole], done))
            elif whole == REST:
                out.append((*now, REST, done))
            elif whole == RECORD and done.strip():
                out.append((*now, RECORD, done))
        held, kind = [], RECORD

    def told() -> pa.RecordBatch:
        file, begin, kinds, texts = zip(*out) if out else ((), (), (), ())
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(file, pa.int64()), pa.array(begin, pa.int64()), pa.array(kinds, pa.int32()), pa.array(texts, pa.string())], ["file", "begin", "kind", "text"])

    for batch in batches:
        for file, begin, line in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if (file, begin) != now:
                if now is not None:
                    close(True)
                now, odd = (file, begin), inside[file, begin]
                kind = REST if odd else HEADER if begin == 0 else RECORD
            held.append(line[:-1] if line.endswith("\r") else line)
            odd ^= line.count('"') % 2 == 1
            if not odd:
                close(False)
        yield told()
    if now is not None:
        close(True)
        yield told()


def records(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """(text): every record of the file, or of the files of a folder, without the header of each."""
    lines = raw_lines(spark, path, encoding)
    inside = parities(lines)
    cut = lines.mapInArrow(lambda b: pieces(b, inside), PIECE)
    parts = cut.filter(F.col("kind") != RECORD)
    # in a file's order, the rest of an open record comes before the next that is opened
    order = Window.partitionBy("file").orderBy("begin", "kind")
    number = F.sum((F.col("kind") != REST).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    joined = parts.withColumn("number", number).groupBy("file", "number").agg(F.max("kind").alias("kind"), F.array_sort(F.collect_list(F.struct("begin", "kind", "text"))).alias("parts"))
    stitched = joined.filter(F.col("kind") != HEADER).select(F.array_join(F.transform("parts", lambda p: p["text"]), "\n").alias("text"))
    return cut.filter(F.col("kind") == RECORD).select("text").unionByName(stitched)


def parsed(rows: DataFrame, names: list[str], delimiter: str, tolerant: bool) -> DataFrame:
    """Records as text columns; ``tolerant`` drops those that do not fit."""
    quoted = ", ".join(f"`{n.replace('`', '``')}` STRING" for n in names)
    options = {"sep": delimiter, "escape": '"', "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true", "columnNameOfCorruptRecord": "_bad", "maxCharsPerColumn": "-1"}
    out = rows.select(F.from_csv("text", f"{quoted}, _bad STRING", options).alias("r"))
    return (out.filter("r._bad is null") if tolerant else out).select(*(F.col("r")[n].alias(n) for n in names))
