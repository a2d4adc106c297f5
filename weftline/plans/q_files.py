"""Reader and writer queries: tables go through files in the shared folder and come back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from weftline.functions.storage import shared_folder
from weftline.operators import profile, rules
from weftline.plans.registry import query, table
from weftline.sources import readers, sinks


def folder(spark) -> str:
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


def lines_of(df, sep: str = ","):
    """(line) of a delimited file without its header."""
    return df.select(F.to_csv(F.struct(*df.columns), {"sep": sep}).alias("line"))


@query("SELECT c_custkey::int AS c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def read_csv_semicolons(spark, d):
    path = f"{folder(spark)}/customer.csv"
    table(spark, d, "customer").write.options(sep=";", header="true").csv(path)
    return readers.read_table(spark, path).withColumn("c_custkey", F.col("c_custkey").cast("int"))


@query("SELECT s_suppkey, s_name, s_nationkey::bigint AS s_nationkey, s_acctbal FROM supplier")
def read_csv_wrapped_rows(spark, d):
    path, s = f"{folder(spark)}/supplier.csv", table(spark, d, "supplier")
    lines_of(s).withColumnRenamed("line", ",".join(s.columns)).write.options(header="true", quoteAll="true", escape='"').csv(path)
    return readers.read_table(spark, path)


@query("SELECT n_nationkey::bigint AS n_nationkey, 'Länder ' || n_name AS name FROM nation")
def read_csv_latin1(spark, d):
    path = f"{folder(spark)}/nation.csv"
    named = table(spark, d, "nation").select("n_nationkey", F.concat(F.lit("Länder "), "n_name").alias("name"))
    named.coalesce(1).write.options(header="true", encoding="ISO-8859-1").csv(path)
    return readers.read_table(spark, path).withColumn("n_nationkey", F.col("n_nationkey").cast("bigint"))


@query("SELECT p_partkey, p_name || chr(10) || p_type AS note, p_size FROM part")
def read_csv_line_breaks(spark, d):
    path = f"{folder(spark)}/part.csv"
    noted = table(spark, d, "part").select("p_partkey", F.concat_ws("\n", "p_name", "p_type").alias("note"), "p_size")
    noted.coalesce(1).write.options(header="true", escape='"').csv(path)
    return readers.read_table(spark, path).withColumn("p_partkey", F.col("p_partkey").cast("bigint"))


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def read_csv_tolerant(spark, d):
    path, s = f"{folder(spark)}/supplier.txt", table(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    head = spark.createDataFrame([("s_suppkey|s_name|s_acctbal",)], "line string")
    broken = s.filter("s_suppkey % 10 = 0").select(F.concat_ws("|", F.lit("broken"), "s_name", "s_acctbal", F.lit("1"), F.lit("2")).alias("line"))
    body = lines_of(s, "|").unionByName(broken).withColumn("place", F.lit(1))
    head.withColumn("place", F.lit(0)).unionByName(body).coalesce(1).sortWithinPartitions("place").select("line").write.text(path)
    typed = {"s_suppkey": "bigint", "s_acctbal": "double"}
    out = readers.read_table(spark, path, tolerant=True, infer=False)
    return out.select(*(F.col(c).cast(typed.get(c, "string")).alias(c) for c in s.columns))


@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def read_group_by_id(spark, d):
    root = folder(spark)
    for name, number in (("nation", 7), ("region", 8)):
        table(spark, d, name).write.parquet(f"{root}/2024/{number}_{name}.parquet")
    found = readers.read_group(spark, {n: readers.find_dataset(spark, root, i) for n, i in (("nation", "7_"), ("region", "8_"))})
    return found["nation"].join(found["region"], F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name")


@query("SELECT 'orders' AS name, (SELECT count(*) FROM orders) AS rows, 6 AS columns, 'o_orderkey,o_custkey,o_orderstatus,o_totalprice,o_orderdate,o_orderpriority' AS names, 10::bigint AS shown")
def describe_and_preview(spark, d):
    o = table(spark, d, "orders")
    about = readers.describe(o)
    return spark.createDataFrame([("orders", about["rows"], about["columns"], ",".join(about["column_names"]), readers.preview(o).count())], "name string, rows long, columns int, names string, shown long")


@query("""SELECT n_name, CASE n_nationkey % 5 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN false WHEN 3 THEN true ELSE false END AS taken FROM nation""")
def upload_checks(spark, d):
    kinds = [(".csv", 10), (".exe", 10), (".csv", 0), (".PARQUET", 10 * 2**30), (".csv", 10 * 2**30 + 1)]
    rows = []
    for r in table(spark, d, "nation").orderBy("n_nationkey").collect():  # file names of one upload form
        end, size = kinds[r["n_nationkey"] % 5]
        try:
            readers.check_upload(r["n_name"] + end, size)
            rows.append((r["n_name"], True))
        except ValueError:
            rows.append((r["n_name"], False))
    return spark.createDataFrame(rows, "n_name string, taken boolean")


@query("SELECT o_orderkey, o_totalprice FROM orders")
def checkpointed_batches(spark, d):
    path, o = f"{folder(spark)}/batches", table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    for part in range(3):
        sinks.append_batch(o.filter(F.pmod("o_orderkey", F.lit(3)) == part), path, part)
    sinks.append_batch(o.filter(F.pmod("o_orderkey", F.lit(3)) == 1), path, 1)  # a retry replaces its batch
    return sinks.read_checkpoint(spark, path)


@query("SELECT 'parquet' AS kind, count(*) AS rows, 5 AS columns, round(sum(c_acctbal), 2) AS total FROM customer UNION ALL SELECT 'csv', count(*), 5, round(sum(c_acctbal), 2) FROM customer")
def save_generated_tables(spark, d):
    root, rows = folder(spark), []
    for kind in ("parquet", "csv"):
        out = sinks.save_generated(table(spark, d, "customer"), root, f"customer_{kind}", "copula", kind)
        total = spark.read.options(header="true").format(kind).load(out["path"]).agg(F.round(F.sum(F.col("c_acctbal").cast("double")), 2)).first()[0]
        rows.append((kind, out["rows"], out["columns"], total))
    return spark.createDataFrame(rows, "kind string, rows long, columns int, total double")


@query("SELECT 'nation' AS table_name, count(*) AS rows FROM nation UNION ALL SELECT 'part', count(*) FROM part")
def save_tables_manifest(spark, d):
    root = folder(spark)
    sinks.save_tables({n: table(spark, d, n) for n in ("nation", "part")}, root)
    return spark.read.schema("table_name string, rows long").json(f"{root}/_manifest")


@query("""SELECT 'o_orderkey' AS column_name, 0::bigint AS missing_count, 0.0::double AS missing_percentage UNION ALL SELECT 'price', count(*) FILTER (o_orderkey % 10 = 0), round(100.0::double * count(*) FILTER (o_orderkey % 10 = 0) / count(*), 2) FROM orders""")
def report_files(spark, d):
    path = folder(spark)
    o = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 10 != 0, F.col("o_totalprice")).alias("price"))
    sinks.write_report(profile.missing_summary(o), path)
    schema = "column_name string, missing_count long, missing_percentage double"
    as_json, as_csv = spark.read.schema(schema).json(f"{path}/json"), spark.read.schema(schema).option("header", "true").csv(f"{path}/csv")
    return as_json.intersect(as_csv)


@query("SELECT event_id, CASE WHEN event_id % 7 <> 0 AND event_id % 11 <> 0 THEN value END AS value, event_type FROM events")
def strict_json_rows(spark, d):
    v = F.when(F.col("event_id") % 7 == 0, float("nan")).when(F.col("event_id") % 11 == 0, float("-inf")).otherwise(F.col("value"))
    lines = sinks.finite_json(table(spark, d, "events").select("event_id", v.alias("value"), "event_type"))
    return lines.select(F.from_json("json", "event_id long, value double, event_type string").alias("r")).select("r.*")


@query("SELECT l_orderkey, l_partkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity <= 25 AND l_discount >= 0.02")
def validated_stream(spark, d):
    from weftline.streaming import batches

    root = folder(spark)
    table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_discount").repartition(6).write.parquet(f"{root}/in")
    limits = [{"rule_type": "range", "column": "l_quantity", "max": 25}, {"rule_type": "range", "column": "l_discount", "min": 0.02}]
    batches.validate_stream(spark, f"{root}/in", f"{root}/out", f"{root}/state", rules.active(limits), 2).awaitTermination()
    return spark.read.parquet(f"{root}/out").drop("l_discount")
