"""Writers: generated tables, batch checkpoints, metric reports."""

from __future__ import annotations

import html
import uuid
from datetime import date

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def counted(df: DataFrame, write) -> int:
    """The rows that ``write(df)`` wrote, counted by the job that wrote them."""
    seen = Observation()
    write(df.observe(seen, F.count("*").alias("rows")))
    return seen.get["rows"]


def save_generated(df: DataFrame, folder: str, name: str, model: str, kind: str = "parquet") -> dict:
    """Write under folder/gen_date=.../run=.../, in one job."""
    path = f"{folder}/{name}_{model}"
    own = f"{path}/gen_date={date.today().isoformat()}/run={uuid.uuid4().hex}"
    options = {"header": "true"} if kind == "csv" else {}
    rows = counted(df, lambda out: out.write.options(**options).format(kind).save(own))
    return {"path": path, "rows": rows, "columns": len(df.columns)}


def append_batch(df: DataFrame, path: str, first_row: int) -> int:
    """One batch in a folder of its own, and its rows: writing it again replaces it, so a retry does no harm."""
    return counted(df, lambda out: out.write.mode("overwrite").parquet(f"{path}/batch={first_row}"))


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_checkpoint(spark: SparkSession, path: str, rows: int | None = None) -> DataFrame:
    """The batches in order; of their rows the first ``rows``, where only the batch that passes the number is cut."""
    df = spark.read.parquet(path)
    if rows is not None:
        sizes, left, whole, cut = {r["batch"]: r["count"] for r in df.groupBy("batch").count().collect()}, rows, [], None  # one row a batch
        for b in sorted(sizes):
            if sizes[b] <= left:
                whole.append(b)
                left -= sizes[b]
            else:
                cut = df.filter(F.col("batch") == b).limit(left) if left else None
                break
        df = df.filter(F.col("batch").isin(whole)) if len(whole) < len(sizes) else df
        df = df.unionByName(cut) if cut is not None else df
    return df.orderBy("batch").drop("batch")


def checkpoint_rows(spark: SparkSession, path: str) -> int:
    return spark.read.parquet(path).count() if exists(spark, path) else 0


def save_tables(tables: dict[str, DataFrame], folder: str) -> DataFrame:
    """Every table as Parquet, in a job each, with a manifest (table_name, rows); the manifest is written last."""
    rows = []
    for name, df in tables.items():
        rows.append((name, counted(df, lambda out, at=f"{folder}/{name}": out.write.mode("overwrite").parquet(at))))
    manifest = next(iter(tables.values())).sparkSession.createDataFrame(rows, "table_name string, rows long")
    manifest.write.mode("overwrite").json(f"{folder}/_manifest")
    return manifest


def finite_json(df: DataFrame) -> DataFrame:
    """(json) of each row; NaN and infinities become null."""
    kinds = dict(df.dtypes)
    fixed = [F.when(F.isnan(c) | (F.abs(F.col(c)) == float("inf")), None).otherwise(F.col(c)).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in df.columns]
    return df.select(F.to_json(F.struct(*fixed)).alias("json"))


def write_report(metrics: DataFrame, folder: str) -> None:
    """Metric rows as JSON and CSV."""
    metrics.coalesce(1).write.mode("overwrite").json(f"{folder}/json")
    metrics.coalesce(1).write.mode("overwrite").option("header", "true").csv(f"{folder}/csv")


def html_report(title: str, metrics: DataFrame, most: int = 1000) -> str:
    """A page with a table of at most ``most`` metric rows."""
    cell = lambda tag, v: f"<{tag}>{html.escape('' if v is None else str(v))}</{tag}>"
    head = "".join(cell("th", c) for c in metrics.columns)
    body = "".join("<tr>" + "".join(cell("td", v) for v in row) + "</tr>" for row in metrics.limit(most).collect())
    return f"<!doctype html><meta charset='utf-8'><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1><table><tr>{head}</tr>{body}</table>"
