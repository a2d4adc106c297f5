"""Records with line breaks in their fields, cut from many ranges of a file."""

import csv
import io
import random

import pytest

from weftline.sources import readers, records


@pytest.fixture()
def small_ranges(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2500")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def rows_of(seed, n):
    pick = random.Random(seed)
    words = ["plain", 'a "quoted" word', "two\nlines", "\n", "three\n\nlines; ä", "x" * 700 + "\n" + "y" * 900, "", "semi;colon", "tail\n"]
    return [(str(i), pick.choice(words), pick.choice(words), str(pick.randint(0, 99))) for i in range(n)]


def write(path, rows, encoding="utf-8", end="\n"):
    text = io.StringIO()
    out = csv.writer(text, delimiter=";", lineterminator=end)
    out.writerow(("id", "note", "more\nnames", "size"))
    out.writerows(rows)
    path.write_bytes(text.getvalue().encode(encoding))


def found(df):
    return sorted((str(r[0]), r[1] or "", r[2] or "", str(r[3])) for r in df.collect())


def expected(rows):
    return sorted((a, b.strip(" "), c.strip(" "), d) for a, b, c, d in rows)


@pytest.mark.parametrize("encoding,end", [("utf-8", "\n"), ("latin-1", "\n"), ("utf-8", "\r\n"), ("utf-8-sig", "\n")])
def test_ranges_give_the_rows_of_the_whole(spark, tmp_path, small_ranges, encoding, end):
    rows = rows_of(7, 120)
    path = tmp_path / "notes.csv"
    write(path, rows, encoding, end)
    df = readers.read_csv(spark, str(path))
    assert df.columns == ["id", "note", "more\nnames", "size"] and dict(df.dtypes)["size"] == "bigint"
    assert found(df) == expected(rows)
    name = "UTF-8" if encoding.startswith("utf") else "ISO-8859-1"
    lines = records.raw_lines(spark, str(path), name)
    assert lines.rdd.getNumPartitions() > 10
    assert any(records.parities(lines).values())


def test_folder_of_files(spark, tmp_path, small_ranges):
    rows = rows_of(8, 60)
    write(tmp_path / "a.csv", rows[:25])
    write(tmp_path / "b.csv", rows[25:])
    assert found(readers.read_csv(spark, str(tmp_path))) == expected(rows)


def test_first_break_far_behind_the_head(spark, tmp_path):
    rows = [(str(i), '"', "plain", "1") for i in range(9000)] + [("9000", "two\nlines", "", "2")]
    write(tmp_path / "late.csv", rows)
    df = readers.read_csv(spark, str(tmp_path / "late.csv"))
    assert df.count() == 9001 and df.filter("id = 9000").first()["note"] == "two\nlines"


def test_tolerant_drops_what_does_not_fit(spark, tmp_path):
    (tmp_path / "odd.csv").write_text('a,b\n1,"x\ny"\n2,z,too,many\n3,"w"\n')
    strict, tolerant = (readers.read_csv(spark, str(tmp_path / "odd.csv"), tolerant=t) for t in (False, True))
    assert strict.count() == 3
    assert sorted(tuple(r) for r in tolerant.collect()) == [(1, "x\ny"), (3, "w")]


def test_open_quote_and_empty_file(spark, tmp_path):
    (tmp_path / "open.csv").write_text('a,b\n1,"x\ny"\n2,"never closed\n3,4\n')
    assert readers.read_csv(spark, str(tmp_path / "open.csv")).count() == 2
    (tmp_path / "head.csv").write_text('a,"b\nc"\n')
    assert readers.read_csv(spark, str(tmp_path / "head.csv"), multi_line=True).count() == 0
