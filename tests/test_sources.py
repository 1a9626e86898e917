"""Text readers, preparation and the report sink, on temporary files."""

import pytest
from pyspark.sql import functions as F

import keyloom
from keyloom.__main__ import main
from keyloom.sources import delimited, prepare, report


def write(folder, *files):
    for i, text in enumerate(files):
        (folder / f"part{i}.csv").write_text(text)
    return str(folder)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_comma_reader(spark, tmp_path):
    text = ' id , name,city\n1, ann ,\n2,bob\n3,c,d,e\n4,"q,z\n5,\t x\t,y\n'
    parsed = delimited.read_comma(spark, write(tmp_path, text))
    assert parsed.good.columns == ["id", "name", "city"]
    assert rows(parsed.good) == [("1", "ann", ""), ("4", '"q', "z"), ("5", "x", "y")]
    assert rows(parsed.rejects) == [("2,bob",), ("3,c,d,e",)]
    assert parsed.rejects.count() == 2 and parsed.good.count() == 3


def test_header_in_every_file(spark, tmp_path):
    parsed = delimited.read_comma(spark, write(tmp_path, "a,b\n1,2\n", "a,b\n3,4\n"))
    assert rows(parsed.good) == [("1", "2"), ("3", "4")]


def test_trailing_empty_fields_are_kept(spark, tmp_path):
    parsed = delimited.read_comma(spark, write(tmp_path, "a,b,c,d\nx,y,,\n"))
    assert rows(parsed.good) == [("x", "y", "", "")]


def test_first_columns_still_reject_ragged_rows(spark, tmp_path):
    parsed = delimited.read_comma(spark, write(tmp_path, "a,b,c\n1,2,3\n4,5\n"), n_columns=2)
    assert parsed.good.columns == ["a", "b"]
    assert rows(parsed.good) == [("1", "2")]
    with pytest.raises(ValueError):
        delimited.read_comma(spark, write(tmp_path, "a,b,c\n1,2,3\n"), n_columns=4)


def test_repeated_names(spark, tmp_path):
    parsed = delimited.read_comma(spark, write(tmp_path, "a,a,b\n1,2,3\n"))
    assert parsed.good.columns == ["a0", "a1", "b"]


def test_blank_lines(spark, tmp_path):
    one = delimited.read_comma(spark, write(tmp_path, "a\nx\n\ny\n\nz\n"))
    assert rows(one.good) == [("",), ("",), ("x",), ("y",), ("z",)] and one.rejects.count() == 0
    assert keyloom.minimal_keys(one.good).count() == 0
    (tmp_path / "two").mkdir()
    two = delimited.read_comma(spark, write(tmp_path / "two", "a,b\n1,2\n\n  \n3,4\n\n"))
    assert rows(two.good) == [("1", "2"), ("3", "4")]
    assert rows(two.rejects) == [("",), ("",), ("  ",)]
    (tmp_path / "tab").mkdir()
    tab = delimited.read_tab(spark, write(tmp_path / "tab", "a b\n\t\n\n1\t2\n"))
    assert rows(tab.good) == [("", ""), ("1", "2")] and rows(tab.rejects) == [("",)]


def test_headers_of_further_files(spark, tmp_path):
    with pytest.raises(ValueError):
        delimited.read_comma(spark, write(tmp_path, "a,b\n1,2\n", "b,a\n3,4\n"))
    (tmp_path / "same").mkdir()
    same = write(tmp_path / "same", "a,b\n1,2\na,b\n", " a , b\n3,4\n", "", "a,b\na,b\n a , b\n")
    assert rows(delimited.read_comma(spark, same).good) == [("1", "2"), ("3", "4"), *[("a", "b")] * 3]


def test_many_columns(spark, tmp_path):
    wide = ",".join(f"c{i}" for i in range(21_000))
    parsed = delimited.read_comma(spark, write(tmp_path, f"a,b\n1,2\n{wide}\n"))
    assert rows(parsed.good) == [("1", "2")] and rows(parsed.rejects) == [(wide,)]


def test_tab_reader(spark, tmp_path):
    parsed = delimited.read_tab(spark, write(tmp_path, "id name  city\n1\tann lee\t x \n2\tbob\n"))
    assert parsed.good.columns == ["id", "name", "city"]
    assert rows(parsed.good) == [("1", "ann lee", "x")]
    assert rows(parsed.rejects) == [("2\tbob",)]


def test_fixed_reader(spark, tmp_path):
    parsed = delimited.read_fixed(spark, write(tmp_path, "31, ann , cook,IT\n32,bob,,FR\nx\n"))
    assert parsed.good.columns == ["Age", "Name", "Job", "Country"]
    assert rows(parsed.good) == [("31", "ann", "cook", "IT"), ("32", "bob", "", "FR")]
    assert parsed.rejects.count() == 1
    other = delimited.read_fixed(spark, write(tmp_path, "1;2\n"), names=["a", "b"], sep=";")
    assert rows(other.good) == [("1", "2")]


def test_header_only(spark, tmp_path):
    parsed = delimited.read_comma(spark, write(tmp_path, "a,b\n"))
    assert parsed.good.count() == 0
    lines = report.key_report(keyloom.minimal_keys(parsed.good)).collect()
    assert [r.line for r in lines] == ["No unique column combinations found!"]
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty" / "x.csv").write_text("")
    with pytest.raises(ValueError):
        delimited.read_comma(spark, str(tmp_path / "empty"))


def test_keys_of_a_text_file(spark, tmp_path):
    good = delimited.read_comma(spark, write(tmp_path, "id,x,y\n1,a,p\n2,a ,q\n3,b,p\n")).good
    out = str(tmp_path / "out")
    report.save_report(keyloom.minimal_keys(good), out)
    lines = [r.value for r in spark.read.text(out).collect()]
    assert lines == ["ColumnCombinationBitset {0}", "ColumnCombinationBitset {1, 2}"]
    assert len([p for p in (tmp_path / "out").iterdir() if p.name.startswith("part")]) == 1


def test_report_of_nothing(spark, tmp_path):
    df = spark.createDataFrame([(1, 1), (1, 1)], "a int, b int")
    out = str(tmp_path / "out")
    report.save_report(keyloom.minimal_keys(df), out)
    assert [r.value for r in spark.read.text(out).collect()] == ["No unique column combinations found!"]


def test_trim(spark):
    df = spark.createDataFrame([(1, "\x00\t a b \n\r"), (2, " x "), (3, None)], "k int, s string")
    assert rows(prepare.trim_cells(df)) == [(1, "a b"), (2, " x "), (3, None)]


def test_text_mode(spark):
    df = spark.createDataFrame([(1, " 7"), (2, "7 ")], "k int, s string")
    assert rows(prepare.as_text(df)) == [("1", "7"), ("2", "7")]


def test_row_ids(spark):
    df = spark.range(1000, numPartitions=7).withColumn("v", F.col("id") * 2)
    loose = prepare.with_row_id(df)
    assert loose.select("row_id").distinct().count() == 1000
    assert rows(loose) == rows(loose)
    dense = prepare.with_row_id(df, dense=True)
    assert [r.row_id for r in dense.orderBy("id").collect()] == list(range(1000))
    assert prepare.with_row_id(df.where("id < 0"), dense=True).count() == 0


def test_first_n_reads_only_those_columns(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    few = delimited.first_n_columns(df, 2)
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint>" in plan
    assert delimited.first_n_columns(df, -1).columns == df.columns


def test_command_line(spark, tmp_path):
    (tmp_path / "in").mkdir()
    source = write(tmp_path / "in", "id,x,y\n1,a,p\n2,a,q\n3,b,p\n")

    def run(name, *options):
        main([source, str(tmp_path / name), *options], spark)
        return [r.value for r in spark.read.text(str(tmp_path / name)).collect()]

    assert run("all") == ["ColumnCombinationBitset {0}", "ColumnCombinationBitset {1, 2}"]
    assert run("first", "2") == ["ColumnCombinationBitset {0}"]
    assert run("near", "--tolerance", "1") == [f"ColumnCombinationBitset {{{i}}}" for i in range(3)]


def test_names_that_clash_after_numbering():
    names = delimited._unique(["a", "a", "a0", "A", "b", "a3_"])
    assert len({n.lower() for n in names}) == 6
    assert names[2] == "a0" and names[4] == "b" and names[5] == "a3_"


def test_blank_lines_under_a_header_in_one_scan(spark, tmp_path):
    path = write(tmp_path, "a,b\n\n1,2\n\na,b\n", "a,b\na,b\n\n3,\n")
    parsed = delimited.read_comma(spark, path)
    assert rows(parsed.good) == [("1", "2"), ("3", ""), ("a", "b"), ("a", "b")]
    assert rows(parsed.rejects) == [("",)] * 3
    for df in (parsed.good, parsed.rejects):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Relation [") == 1 and "Aggregate" not in plan


def test_files_without_a_header_are_refused(spark, tmp_path):
    path = write(tmp_path, "a,b\n1,2\n", *[f"{i},x\n" for i in range(30)])
    with pytest.raises(ValueError, match="headers differ"):
        delimited.read_comma(spark, path)
