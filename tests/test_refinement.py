"""Operators and the cleaning plan on small inputs with known results."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from lapidary import __main__ as cli
from lapidary import report
from lapidary.api import Cleaner
from lapidary.functions import convert, names, text, utils
from lapidary.operators import bi, categories, impute, numbers, rows, rules
from lapidary.plans import cleaning, drift, profile
from lapidary.sources import readers, writers


def column(df, c):
    return [r[c] for r in df.collect()]


def frame(spark, schema, *data):
    return spark.createDataFrame(list(data), schema)


def one(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return column(df.select("i", f(F.col("v")).alias("v")).orderBy("i"), "v")


# ---- names


def test_names():
    assert names.normalised(["Customer Name", "Revenue($)", "CITY", "__age__", "", "a" * 100]) == ["customer_name", "revenue", "city", "age", "col", "a" * 64]
    assert names.unique(["sales", "sales", "revenue", "sales"]) == ["sales", "sales_1", "revenue", "sales_2"]
    assert names.unique(["a", "a", "a_1"]) == ["a", "a_2", "a_1"]
    assert [names.bi_name(n) for n in ("Revenue ($)", "First Name", "A#B%C_", "A" * 70)] == ["Revenue", "First_Name", "ABC", "A" * 64]
    assert names.constraint_for("average_gross") is None and names.constraint_for("user_age")["max"] == 120
    assert names.constraint_for("average_gross", match="substring")["max"] == 120
    assert names.is_id("l_orderkey") and names.is_id("zipcode") and not names.is_id("city")
    assert names.skips_outliers("width") and not names.skips_outliers("salary")
    assert names.is_geo("platform") and names.is_bi_id("phone")


# ---- conversion


def test_conversions(spark):
    assert one(spark, ["$12.50", "₹150.00", " 1,500 € ", "n/k", None], convert.currency) == [12.5, 150.0, 1500.0, None, None]
    assert one(spark, ["10%", " 20 %", "x"], convert.percent) == [0.1, 0.2, None]
    assert one(spark, ["Yes", "no ", "TRUE", "2", None], convert.boolean) == [True, False, True, None, None]
    assert one(spark, ["1", " -2.5 ", "1e3", "1d", "12f", "nan", "inf", "1\xa0"], convert.number) == [1.0, -2.5, 1000.0, None, None, None, None, 1.0]
    days = one(spark, ["2025-05-12", "2025/05/13", "05/14/2025", "13/02/2025", "2025-02-30", "12:30", "x"], lambda c: convert.timestamp(c).cast("date"))
    assert days == [dt.date(2025, 5, 12), dt.date(2025, 5, 13), dt.date(2025, 5, 14), dt.date(2025, 2, 13), None, None, None]
    assert [round(x, 4) if x else x for x in one(spark, ["1.5kg", "500g", "2.0 lb", "10 oz", "7", "x"], convert.grams)] == [1500.0, 500.0, 907.184, 283.495, 7.0, None]
    assert one(spark, ["10sec", "5min", "1.5hr", "100ms", "2 Mins"], convert.seconds) == [10.0, 300.0, 5400.0, 0.1, 120.0]


def test_text(spark):
    assert one(spark, ["BeyoncÃ©", "2023â€“2024", "plain", "é", None], text.unicode_repair) == ["Beyoncé", "2023–2024", "plain", "é", None]
    assert one(spark, ["  john \t\xa0 doe​ ", ""], text.plain_space) == ["john doe", ""]
    assert one(spark, ["john DOE", "o'neil-smith 3rd", "a1b", None], text.title) == ["John Doe", "O'Neil-Smith 3Rd", "A1B", None]
    assert one(spark, ["mh", "DL", "Pune MH", "x y"], text.expand_state) == ["Maharashtra", "Delhi", "Pune Maharashtra", "x y"]
    assert one(spark, ["Mumbi", "Bangalor", "Delhi", "Paris"], text.city) == ["Mumbai", "Bangalore", "Delhi", "Paris"]
    assert one(spark, ["N/A", " unknown ", "-", "ok", None], text.null_hidden) == [None, None, None, "ok", None]
    assert one(spark, ["98765 43210", "+1-555-0199", "abc"], text.phone) == ["9876543210", "+15550199", None]
    assert one(spark, [" a@b.com ", "xyz.com", "", None], text.email) == ["a@b.com", None, "", None]
    assert one(spark, ["call 123-45-6789"], lambda c: text.mask(c, "ssn")) == ["call [SSN]"]
    assert one(spark, ["123-45-6789"], lambda c: text.mask(c, "ssn", "partial")) == ["*******6789"]


# ---- rows


def test_dedup(spark):
    df = frame(spark, "o int, id int, name string, val string", (0, 1, "A", "X"), (1, 2, "B", "Y"), (2, 2, "B", "Z"), (3, 3, None, "W"), (4, 3, None, "X"))
    assert sorted(column(rows.dedup(df, ["id", "name"], "first", ["o"]), "val")) == ["W", "X", "Y"]
    assert sorted(column(rows.dedup(df, ["id", "name"], "last", ["o"]), "val")) == ["X", "X", "Z"]
    assert column(rows.dedup(df, ["id", "name"], False), "val") == ["X"]
    apart = frame(spark, "o int, a string, b string", (0, "a", "bc"), (1, "ab", "c"), (2, None, "x"), (3, "", "x"))
    assert sorted(column(rows.hash_dedup(apart, ["a", "b"], ["o"]), "o")) == [0, 1, 2]


def test_union(spark):
    a, b = frame(spark, "a int, b string", (1, "x")), frame(spark, "b int, c int", (2, 3))
    got = rows.union_all([a, b])
    assert got.columns == ["a", "b", "c"] and sorted(map(tuple, got.collect()), key=str) == [(1, "x", None), (None, "2", 3)]
    assert rows.union_all([], spark).count() == 0 and rows.union_distinct([a, a]).count() == 1


def test_cross_rules_and_orphans(spark):
    df = frame(spark, "a int, b int", (1, 2), (3, 2), (None, 2))
    assert column(rows.where_all(df, {"order": lambda: F.col("a") <= F.col("b")}), "broken") == [[], ["order"], []]
    assert rows.orphans(df, frame(spark, "k int", (1,)), "a", "k").count() == 2


# ---- imputation


def test_fills(spark):
    df = frame(spark, "i int, v double, s string", (0, 10.0, "Apple"), (1, None, "Banana"), (2, 20.0, None), (3, 30.0, "Apple"), (4, None, None))
    assert column(impute.numeric_fill(df, ["v"]).orderBy("i"), "v") == [10.0, 20.0, 20.0, 30.0, 20.0]
    assert column(impute.numeric_fill(df, ["v"], "zero").orderBy("i"), "v") == [10.0, 0.0, 20.0, 30.0, 0.0]
    assert column(impute.text_fill(df, ["s"]).orderBy("i"), "s") == ["Apple", "Banana", "Apple", "Apple", "Apple"]
    assert column(impute.text_fill(df, ["s"], "Keep Case").orderBy("i"), "s")[2] == "Keep Case"
    none = df.withColumns({"v": F.lit(None).cast("double"), "s": F.lit(None).cast("string")})
    assert set(column(impute.numeric_fill(none, ["v"]), "v")) == {0.0} and set(column(impute.text_fill(none, ["s"]), "s")) == {"Unknown"}
    assert column(impute.group_interpolate(df, "v", [], ["i"]).orderBy("i"), "v") == [10.0, 15.0, 20.0, 30.0, 30.0]
    many = [(7 * i, float(i * i % 11) if i % 9 in (4, 5) and not 20 < i < 60 else None) for i in range(100)]
    holes = spark.createDataFrame(many, "i long, v double")
    want = column(impute.group_interpolate(holes, "v", [], ["i"]).orderBy("i"), "v")
    for rows in (1, 7, 1_000):
        assert column(impute.ordered_interpolate(holes, "v", "i", range_rows=rows).orderBy("i"), "v") == pytest.approx(want)
    none = holes.withColumn("v", F.lit(None).cast("double"))
    assert set(column(impute.ordered_interpolate(none, "v", "i", range_rows=9), "v")) == {0.0}
    assert impute.ordered_interpolate(holes.limit(0), "v", "i").count() == 0


@pytest.mark.parametrize("rows_per_range", [1, 3, 100])
@pytest.mark.parametrize("first", ["ffill", "bfill"])
def test_ordered_fill_over_any_ranges(spark, rows_per_range, first):
    values = [None, None, 1, None, None, None, 5, None, 7, None, None]
    df = spark.createDataFrame([(i * i, v) for i, v in enumerate(values)], "i long, v int").repartition(5)
    got = column(impute.ordered_fill(df, "v", "i", first, rows_per_range).orderBy("i"), "v")
    assert got == ([1, 1, 1, 1, 1, 1, 5, 5, 7, 7, 7] if first == "ffill" else [1, 1, 1, 5, 5, 5, 5, 7, 7, 7, 7])
    assert impute.ordered_fill(df.limit(0), "v", "i").count() == 0


# ---- numbers


def test_outliers(spark):
    df = spark.createDataFrame([(float(x),) for x in [49000, 50000, 51000] * 12 + [9999999, 100]], "salary double")
    found = numbers.bounds(df, ["salary"])
    assert (found["salary"].low, found["salary"].high) == (46000.0, 54000.0)
    got = column(numbers.treat_outliers(df, found), "salary")
    assert max(got) == 54000.0 and min(got) == 46000.0
    assert numbers.treat_outliers(df, found, "remove").count() == 36
    assert sum(column(numbers.treat_outliers(df, found, "flag"), "salary_outlier")) == 2
    assert max(column(numbers.treat_outliers(df, found, "replace"), "salary")) == 51000.0
    same = spark.createDataFrame([(25.0,)] * 35 + [(300.0,), (-50.0,), (None,)], "age double")
    assert numbers.bounds(same, ["age"])["age"].high == float("inf")
    assert {x for x in column(same.select(numbers.clamp_domain("age").alias("age")), "age")} == {25.0, 120.0, 0.0, None}


@pytest.mark.parametrize("method", ["minmax", "standard", "robust"])
def test_scaler(spark, method):
    df = frame(spark, "age double, income double, id_col int, flag int", (20.0, 10e3, 1, 0), (30.0, 50e3, 2, 1), (40.0, 90e3, 3, 1), (None, None, 4, 0))
    s = numbers.Scaler(method).fit(df)
    assert sorted(s.params) == ["age", "income"]
    out = s.transform(df)
    got = [x for x in column(out, "age_scaled") if x is not None]
    assert {"minmax": got == [0.0, 0.5, 1.0], "standard": abs(sum(got)) < 1e-9, "robust": got[1] == 0.0}[method]
    assert column(s.inverse(out), "age") == [20.0, 30.0, 40.0, None] and "age_scaled" not in s.inverse(out).columns


def test_narrow(spark):
    df = spark.createDataFrame([(i % 5, i * 1000, i + 0.5, float(i), 1234567.123456) for i in range(100)], "a long, b long, c double, d double, e double")
    assert dict(numbers.narrow(df).dtypes) == {"a": "tinyint", "b": "int", "c": "float", "d": "tinyint", "e": "double"}


# ---- rules and categories


def test_rules(spark):
    df = frame(
        spark, "user_email string, user_age int, user_name string, average_gross double",
        ("a@b.com", 25, "John Doe", 5e6), ("bad", 150, "Alice123", 6e6), ("c@d.org", 45, "Bob", -1.0),
    )
    got = df.select(*[rules.chunk_rule(f.name, f.dataType).alias(f.name) for f in df.schema.fields]).collect()
    assert [r.user_email for r in got] == ["a@b.com", None, "c@d.org"] and [r.user_age for r in got] == [25, None, 45]
    assert [r.user_name for r in got] == ["John Doe", None, "Bob"] and [r.average_gross for r in got] == [5e6, 6e6, -1.0]
    df = frame(spark, "age int, rating double, phone_number string", (25, 4.5, "98765 43210"), (150, 6.0, "abc123xyz"))
    got = df.select(*[rules.business_rule(f.name, f.dataType).alias(f.name) for f in df.schema.fields]).collect()
    assert tuple(got[1]) == (None, None, "123") and got[0].phone_number == "9876543210"


def test_categories(spark):
    words = ["mumbai", "Mumbai", "MUMBAI", "delhi", "delhi", "delhi", "Mumabi", "Bangalor", "Bangalore", "Bangalore"]
    df = spark.createDataFrame([(w,) for w in words], "city string")
    got = set(column(categories.standardise(df, "city", fuzzy=True), "city"))
    assert got == {"Mumbai", "Delhi", "Bangalore"}
    many = spark.createDataFrame([("A",)] * 600 + [(f"s{i}",) for i in range(501)] + [(None,)], "c string")
    got = {r.c: r.n for r in categories.value_counts(categories.rare_to_other(many, "c", share=0.005), "c").collect()}
    assert got == {"A": 600, "Other": 501}


# ---- the plan


def test_gate_of_nine_tenths(spark):
    for good, kind in ((9, "double"), (2, "string")):
        df = spark.createDataFrame([(f"${i + 1}.00",) for i in range(good)] + [("bad",)] * (10 - good), "revenue string")
        typed = cleaning.fit_types(df, cleaning.Config(), cleaning.Plan())
        assert dict(typed.dtypes)["revenue"] == kind


def test_clean_end_to_end(spark):
    df = frame(
        spark, "order_id string, user_email string, price string, weight string",
        ("101", "a@b.com", "$10.00", "1kg"), ("102", "xyz.com", "$20.00", "2kg"), ("102", "xyz.com", "$20.00", "2kg"), ("103", "c@d.com", "₹30.00", "3kg"),
    )
    got, plan = cleaning.clean(df)
    out = got.orderBy("_row_id").collect()
    assert plan.types == {"order_id": "id", "price": "currency", "weight": "weight"}
    assert [r.order_id for r in out] == ["101", "102", "103"] and [r.weight for r in out] == [1000, 2000, 3000]
    assert [r.price for r in out] == [10, 20, 30] and all(r.user_email for r in out)
    assert json.loads(plan.dump())["types"]["price"] == "currency"


def dirty(spark, n=12_000):
    rows_ = [(f"{i}", None if i % 7 == 0 else f"${i % 900}.50", ["Active", "active", " ACTIVE", "n/a"][i % 4], None if i % 11 == 0 else f"2024-01-{i % 28 + 1:02d}") for i in range(n)]
    return spark.createDataFrame(rows_, "order_id string, price string, status string, day string").withColumn("_row_id", F.col("order_id").cast("long"))


def test_result_does_not_depend_on_partitions(spark):
    outs = []
    for n in (1, 4, 13):
        got, _ = cleaning.clean(dirty(spark).repartition(n))
        outs.append([tuple(r) for r in got.orderBy("_row_id").collect()])
    assert outs[0] == outs[1] == outs[2] and len(outs[0]) == 12_000
    assert {r[2] for r in outs[0]} == {"Active"} or len({r[2] for r in outs[0]}) <= 2
    assert not any(v is None for r in outs[0] for v in r)


def test_cleaning_passes_complex_types_and_nulls(spark):
    df = frame(spark, "id int, tags array<string>, at timestamp, none string, ok boolean", (1, ["a"], dt.datetime(2024, 1, 1), None, True), (2, None, None, None, None), (3, ["b"], dt.datetime(2024, 1, 3), None, True))
    got, _ = cleaning.clean(df)
    out = got.orderBy("_row_id").collect()
    assert [r.tags for r in out] == [["a"], None, ["b"]] and out[1]["at"] == dt.datetime(2024, 1, 1) and out[1].ok is True
    empty, _ = cleaning.clean(df.limit(0))
    assert empty.count() == 0


def test_profile(spark):
    df = spark.createDataFrame([(i, None if i < 288 else "x", "k", f"Customer {i}") for i in range(300)], "id int, corrupted_col string, single_val string, name string")
    found = profile.column_profile(df)
    assert set(profile.corrupted(found)) == {"corrupted_col", "single_val"}
    assert profile.complexity(df) == "Complex" and profile.risk(profile.duplicate_share(df.select("single_val"))) == "High"
    assert profile.name_issues(["Customer Name", "Revenue ($)", "Age", "age"])["duplicates"] == ["Age", "age"]


def test_probes_see_all_rows(spark):
    late = spark.range(3000).select(F.when(F.col("id") >= 1500, F.lit(0)).otherwise(F.col("id")).alias("k"), F.when(F.col("id") >= 1500, F.lit("2024-01-02")).alias("day"))
    assert profile.duplicate_share(late) == pytest.approx(1499 / 3000)
    mixed = late.withColumn("no", F.when(F.col("k") == 7, F.lit("soon")).otherwise(F.lit("2024-01-02"))).withColumn("none", F.lit(None).cast("string"))
    assert bi.iso_columns(mixed) == ["day"]
    assert bi.iso_columns(mixed.limit(0)) == []


# ---- BI, drift, report, files


def test_bi(spark):
    days = [dt.datetime(2024, 1, d + 1, 5) for d in range(12)]
    df = spark.createDataFrame([(t, i * 1.5, i * 2.0, "AB"[i % 2], ["Pune", "Delhi", "Agra"][i % 3], i, "x" * 300, f"{i:032x}") for i, t in enumerate(days)], "order_date timestamp, sales double, profit double, category string, city string, customer_id int, huge_text string, hash_md5 string")
    out, schema = bi.power_bi(df)
    assert not {"huge_text", "hash_md5"} & set(out.columns) and schema["date_columns"] == ["order_date"]
    assert schema["measures"] == ["sales", "profit"] and schema["relationships"] == ["customer_id"]
    first = out.orderBy("order_date").first()
    assert (first.order_date_Year, first.order_date_WeekDay, first.order_date_Hour, first.customer_id) == (2024, "Monday", 5, "0")
    charts = [r["chart"] for r in bi.recommend(df.drop("huge_text", "hash_md5"))]
    assert {"Line", "Map", "Bar"} <= set(charts) and len(charts) == 5
    assert "Scatter" in [r["chart"] for r in bi.recommend(df.select("sales", "profit"))]
    ready, roles, fields = bi.tableau(df.select("city", "sales", "profit"))
    assert roles == {"city": "dimension", "sales": "measure", "profit": "measure"} and fields[0]["name"] == "Profit Margin"
    assert bi.useless(df.select("sales", F.lit("k").alias("k"), F.lit(None).cast("int").alias("n"))) == ["k", "n"]


def test_drift(spark, tmp_path):
    path = str(tmp_path / "s.json")
    df = frame(spark, "age int, city string, revenue double", (1, "x", 2.0))
    assert drift.detect(df, path)["first_run"]
    assert not drift.detect(df, path)["drift_detected"]
    with pytest.warns(drift.SchemaDriftWarning):
        found = drift.detect(df.withColumn("revenue", F.lit("x")).withColumn("country", F.lit("y")), path)
    assert found["changed_types"]["revenue"]["risk"] == "HIGH" and found["new_columns"] == ["country"]
    assert drift.detect(df.withColumnRenamed("age", "ag_e"), path)["renamed_columns"] == {"age": "ag_e"}


def test_readers(spark, tmp_path):
    f = tmp_path / "t.csv"
    f.write_bytes(b"\xef\xbb\xbfCustomer Name,Age,Age,Note\nAnn,5,6,\"a, \"\"b\"\"\nc\"\nNA,,7,null\n")
    df = readers.load(spark, str(f))
    assert df.columns == ["Customer Name", "Age", "Age.1", "Note"]
    assert [tuple(r) for r in df.collect()] == [("Ann", "5", "6", 'a, "b"\nc'), (None, None, "7", None)]
    (tmp_path / "e.csv").write_text("id,name,value\n")
    assert readers.load(spark, str(tmp_path / "e.csv")).count() == 0
    (tmp_path / "a.json").write_text('[{"a": 1}, {"a": null}]')
    (tmp_path / "l.json").write_text('{"a": 1}\n{"a": 2}\n')
    assert readers.load(spark, str(tmp_path / "a.json")).count() == readers.load(spark, str(tmp_path / "l.json")).count() == 2
    (tmp_path / "t.tsv").write_text("a\tb\n1\t2\n")
    assert readers.load(spark, str(tmp_path / "t.tsv")).collect()[0].b == "2"
    with pytest.raises(ValueError):
        Cleaner(spark, str(tmp_path / "x.doc"))
    with pytest.raises(FileNotFoundError):
        Cleaner(spark, str(tmp_path / "x.csv"))
    assert readers.detect_format("data.csv.gz") == "csv" and readers.detect_encoding("é".encode("latin-1") + b"x" * 9) == ("iso-8859-1", 0.5)
    assert [readers.recommend_engine(*x) for x in ((0.05, 50_000), (0.5, 1_200_000), (25, 10**7), (150, 10**8))] == ["Pandas", "Polars", "Dask", "Spark"]
    assert readers.recommend_engine(1, 1, "Polars") == "Polars" and readers.human_size(0) == "0 B" and readers.human_size(1536) == "1.50 KB"


def test_archives_fingerprints_and_checkpoints(spark, tmp_path):
    import hashlib
    import zipfile

    with zipfile.ZipFile(tmp_path / "t.zip", "w") as z:
        z.writestr("a.csv", "x,y\r\n1,2\n")
    assert [tuple(r) for r in readers.read_zip(spark, str(tmp_path / "t.zip")).collect()] == [("a.csv", "x,y"), ("a.csv", "1,2")]
    with zipfile.ZipFile(tmp_path / "u.csv.zip", "w") as z:
        z.writestr("one.csv", 'x,y\n1,"a\nb"\n')
        z.writestr("two.csv", "x,y\n2,c\n")
        z.writestr("notes.txt", "no table")
    assert {tuple(r) for r in readers.load(spark, str(tmp_path / "u.csv.zip")).collect()} == {("1", "a\nb"), ("2", "c")}
    (tmp_path / "f.csv").write_text("a\n1\n2\n")
    assert not readers.quoted_newlines(spark, str(tmp_path / "f.csv"), "utf-8")
    assert readers.fingerprint(spark, str(tmp_path / "f.csv")) == hashlib.md5(b"a\n1\n2\n").hexdigest()
    assert readers.row_estimate(spark, str(tmp_path / "f.csv")) == 2
    calls, key = [], writers.run_key("content", "plan")
    build = lambda df: calls.append(1) or df.limit(3)
    for _ in range(2):
        assert writers.checkpointed(spark.range(9), str(tmp_path), key, build).count() == 3
    assert len(calls) == 1 and key != writers.run_key("content", "other plan")


def test_helpers(spark):
    assert utils.flatten([1, [2, (3, [4])]]) == [1, 2, 3, 4] and utils.clamp(5, 0, 3) == 3 and utils.safe_divide(1, 0) == 0.0
    assert utils.format_number(1234567) == "1,234,567" and utils.bytes_to_gb(2**30) == 1.0
    log = utils.RunLog()
    with utils.timed("step", log) as t:
        log.success("done")
    log.skip("later")
    assert t["seconds"] >= 0 and [e["level"] for e in log.entries] == ["SUCCESS", "INFO", "SKIP"]
    df = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(40)], "i int, s string")
    assert rows.sample_rows(df, 5).collect() == rows.sample_rows(df.repartition(7), 5).collect()
    assert rows.partitioned(df, 4, "i").rdd.getNumPartitions() == 4


def test_export_round_trip(spark, tmp_path):
    df = frame(spark, "name string, age int", ("é", 1), (None, 2))
    paths = writers.export(df, str(tmp_path), "t", "all")
    assert {p.rpartition(".")[2] for p in paths} >= {"parquet", "csv", "json"}
    assert spark.read.parquet(str(tmp_path / "cleaned_t.parquet")).count() == 2
    assert (tmp_path / "cleaned_t.csv").read_bytes().startswith(b"\xef\xbb\xbfname,age")
    assert json.loads((tmp_path / "cleaned_t.json").read_text()) == [{"name": "é", "age": 1}, {"age": 2}]
    assert writers.export(df, str(tmp_path), "t", "nope") == []


def test_report():
    r = report.build({}, {}, {"nulls": 12}, {"before": 0.05, "after": 0.01}, {}, {"review_queue": [{"column": "<x>"}]}, [], [])
    assert r["memory"]["reduction_percent"] == 80.0
    page = report.to_html(r)
    assert "80.0% RAM Reduction" in page and "&lt;x&gt;" in page and "Review queue" in page


def test_fluent_chain_and_command_line(spark, tmp_path, capsys):
    f = tmp_path / "sample.csv"
    f.write_text("order_id,user_email,revenue,price,order_date,city\n" + "\n".join(f"{i},u{i}@x.org,${i * 10}.5,{i}.25,2024-01-{i % 28 + 1:02d},{['Pune', 'Delhi'][i % 2]}" for i in range(40)))
    c = Cleaner(spark, str(f), snapshot_dir=str(tmp_path)).scan().auto_clean().optimize_memory()
    assert c.shape() == (40, 6) and dict(c.table().dtypes)["order_date"] == "timestamp" and "40" in c.summary()
    c.prepare_for_powerbi(str(tmp_path / "p")).prepare_for_tableau(str(tmp_path / "t")).recommend_visualizations()
    c.generate_report(str(tmp_path / "r.html")).generate_report(str(tmp_path / "r.json"), "json").export("csv", str(tmp_path))
    for name in ("p/powerbi_ready_sample.parquet", "p/powerbi_schema.json", "t/tableau_ready_sample.csv", "r.html", "r.json", "cleaned_sample.csv"):
        assert (tmp_path / name).exists()
    with pytest.warns(UserWarning):
        Cleaner(spark, str(f)).export("csv", str(tmp_path))
    assert cli.main(["clean", str(f), "--output", str(tmp_path / "o"), "--report", str(tmp_path / "o.json")]) == 0
    assert (tmp_path / "o" / "cleaned_sample.parquet").exists()
    assert cli.main(["scan", str(tmp_path / "none.csv")]) == 1
    capsys.readouterr()
