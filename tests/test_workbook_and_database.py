"""Workbooks that the test writes, and tables of an embedded database."""

import zipfile
from datetime import datetime
from xml.sax.saxutils import escape

import pytest
from pyspark.sql import functions as F

from weftline.sources import readers, workbook

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def letters(i):
    return letters(i // 26 - 1) + chr(65 + i % 26) if i >= 26 else chr(65 + i)


def write_book(path, sheets, old=False):
    """sheets: {name: rows of values}; strings are shared, datetimes are numbers of a date style."""
    strings = []

    def cell(ref, v):
        if v is None:
            return f'<c r="{ref}"/>'
        if isinstance(v, bool):
            return f'<c r="{ref}" t="b"><v>{int(v)}</v></c>'
        if isinstance(v, datetime):
            days = (v - (datetime(1904, 1, 1) if old else datetime(1899, 12, 30))).total_seconds() / 86400
            return f'<c r="{ref}" s="{1 if v.hour else 2}"><v>{days!r}</v></c>'
        if isinstance(v, str) and v.startswith("inline"):
            return f'<c r="{ref}" t="inlineStr"><is><t>{escape(v)}</t></is></c>'
        if isinstance(v, str):
            strings.append(v)
            return f'<c r="{ref}" t="s"><v>{len(strings) - 1}</v></c>'
        return f'<c r="{ref}"><v>{v!r}</v></c>'

    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for k, rows in enumerate(sheets.values(), 1):
            body = "".join(f'<row r="{i}">' + "".join(cell(f"{letters(j)}{i}", v) for j, v in enumerate(r)) + "</row>" for i, r in enumerate(rows, 1))
            z.writestr(f"xl/worksheets/sheet{k}.xml", f"<worksheet {NS}><sheetData>{body}</sheetData></worksheet>")
        z.writestr("xl/workbook.xml", f'<workbook {NS}><workbookPr date1904="{int(old)}"/><sheets>' + "".join(f'<sheet name="{n}" sheetId="{k}" r:id="r{k}"/>' for k, n in enumerate(sheets, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{k}" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(sheets) + 1)) + "</Relationships>")
        z.writestr("xl/sharedStrings.xml", f"<sst {NS}>" + "".join(f"<si><r><t>{escape(s[:2])}</t></r><r><t>{escape(s[2:])}</t></r></si>" for s in strings) + "</sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {NS}><numFmts><numFmt numFmtId="170" formatCode="yyyy\\-mm\\-dd hh:mm"/><numFmt numFmtId="171" formatCode="0.0&quot;days&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="170"/><xf numFmtId="14"/><xf numFmtId="171"/></cellXfs></styleSheet>')


ROWS = [("id", "name", None, "when", "paid", "price"), (1, "Ann & Bob", "x", datetime(2026, 1, 2), True, 1.5), (2, "inline <text>", None, datetime(2026, 1, 3, 6, 30), False, 2), (None,) * 6, (3, None, "y", None, None, 1e-3)]


@pytest.mark.parametrize("old", [False, True])
def test_workbook(spark, tmp_path, old):
    path = str(tmp_path / "book.xlsx")
    write_book(path, {"First": ROWS, "Second": [("k", "v")] + [(i, f"v{i}") for i in range(12_000)]}, old)
    df = readers.read_table(spark, path)
    assert df.columns == ["id", "name", "Unnamed: 2", "when", "paid", "price"]
    assert [t for _, t in df.dtypes] == ["bigint", "string", "string", "timestamp", "boolean", "double"]
    found = sorted(tuple(r) for r in df.select("id", "name", "Unnamed: 2", F.date_format("when", "yyyy-MM-dd HH:mm").alias("when"), "paid", "price").collect())
    assert found == [(1, "Ann & Bob", "x", "2026-01-02 00:00", True, 1.5), (2, "inline <text>", None, "2026-01-03 06:30", False, 2.0), (3, None, "y", None, None, 0.001)]
    second = readers.read_table(spark, path, sheet="Second")
    assert second.count() == 12_000 and second.agg(F.sum("k")).first()[0] == sum(range(12_000))
    with pytest.raises(ValueError):
        readers.read_table(spark, path, sheet="Third")
    with pytest.raises(ValueError):
        readers.read_excel(spark, "book.xls")


def test_folder_of_workbooks_and_places(spark, tmp_path):
    for k in range(3):
        write_book(str(tmp_path / f"b{k}.xlsx"), {"s": [("a", "b"), (k, "t"), (k + 10, None)]})
    assert sorted(r["a"] for r in readers.read_excel(spark, str(tmp_path)).collect()) == [0, 1, 2, 10, 11, 12]
    assert [workbook.place(r) for r in ("A1", "Z9", "AA10", "BC3")] == [0, 25, 26, 54]


def test_database_in_even_ranges(spark, tmp_path):
    url = f"jdbc:derby:memory:{tmp_path.name};create=true"
    # half of all keys lie in a hundredth of the range, and some are missing
    df = spark.range(4000).select(F.when(F.col("id") % 100 == 7, None).when(F.col("id") % 2 == 0, F.col("id") % 1000).otherwise(F.col("id") * 25).alias("k"), F.col("id").alias("v"))
    df.write.format("jdbc").options(url=url, dbtable="t").save()
    found = readers.read_jdbc(spark, url, "t", "k", parts=8)
    sizes = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * 4000 / 8
    assert sorted(tuple(map(str, r)) for r in found.collect()) == sorted(tuple(map(str, r)) for r in df.collect())
    wide = readers.read_jdbc(spark, url, "t", "k", 0, 100_000, 4)
    assert wide.count() == 4000 and readers.read_jdbc(spark, url, "t").count() == 4000
    spark.range(5).select(F.lit(1).alias("k")).write.format("jdbc").options(url=url, dbtable="one").save()
    assert readers.read_jdbc(spark, url, "one", "k").count() == 5
