import datetime as dt
import json

from pyspark.sql import functions as F

from tidemill.operators import budget, rolling
from tidemill.sources import audit, files
from tidemill.streaming import amounts


def test_ragged_rows_do_not_shift(spark, tmp_path):
    names = [f"c{i}" for i in range(26)]
    path = tmp_path / "x.csv"
    path.write_bytes((",".join(names) + "\n" + ",".join(str(i) for i in range(26)) + "\n" + ",".join(str(i) for i in range(26)) + ",,,,\n" + '1,"a,b\nc",3\n').encode() + b"\xff,2\n")
    rows = files.read_ragged(spark, str(path), names, line_breaks=True).collect()
    assert [r.c25 for r in rows] == ["25", "25", "", ""] and rows[2].c1 == "a,b\nc" and rows[2].c2 == "3" and rows[3].c0 == "�"
    assert files.read_ragged(spark, str(path), names, most_rows=2).count() == 2
    assert [r.c0 for r in files.read_ragged(spark, str(path), names).collect()] == ["0", "0", "1", 'c"', "�"]


def test_schema_map(tmp_path):
    p = tmp_path / "m.json"
    p.write_text(json.dumps({"columns": [{"position": 0, "name": "A"}, {"position": 2, "name": "C"}]}))
    assert files.column_names(files.load_schema_map(str(p)), 4) == ["A", "col_1", "C", "col_3"]


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([(1, "x")], "a int, b string")
    out = str(tmp_path / "out")
    files.export_csv(df, out, {"a": "ID", "b": "NAME"}, one_file=True)
    assert files.validate_export(spark, out, ["ID", "NAME"]) == {"missing": [], "extra": [], "rows": 1, "valid": True}
    assert files.validate_export(spark, out, ["ID", "X"])["missing"] == ["X"]
    files.write_table(df, str(tmp_path / "t"), ["b"])
    assert spark.read.parquet(str(tmp_path / "t")).count() == 1
    files.write_report({"at": dt.date(2021, 1, 1)}, str(tmp_path / "r" / "r.json"))
    assert json.loads((tmp_path / "r" / "r.json").read_text()) == {"at": "2021-01-01"}
    (tmp_path / "lim.csv").write_text("SERVICE_CODE,SEUIL_VIGILANCE_UNITAIRE_MRU,SEUIL_CUMUL_JOURNALIER_MRU\n service_01 ,5,\n")
    r = files.read_limits(spark, str(tmp_path / "lim.csv")).first()
    assert r.SERVICE_CODE == "SERVICE_01" and r.SEUIL_CUMUL_JOURNALIER_MRU is None


def test_audit(spark):
    lines = spark.createDataFrame([(1, 'TEL1,"a,b",1'), (2, "TEL2,,0"), (3, "12,01/01/21 00:00:00,1,x"), (4, None), (5, "")], "i int, line string")
    assert {(r.n_fields, r.n_lines) for r in audit.field_counts(lines, "line").collect()} == {(3, 2), (4, 1), (0, 1), (1, 1)}
    counts = audit.position_counts(lines, "line")
    p = {r.position: r for r in audit.position_profile(counts).collect()}
    assert (p[0].n_seen, p[0].n_tel, p[0].n_int, p[0].n_nonempty) == (4, 2, 1, 3) and p[1].n_date == 1 and p[1].n_other == 1
    assert [r.position for r in audit.binary_candidates(counts).collect()] == [2]
    assert {r.position: r["values"] for r in audit.samples(lines, "line", "i", 1).collect()} == {0: ["TEL1"], 1: ["a,b"], 2: ["1"], 3: ["x"]}
    assert {r.position: r["values"] for r in audit.low_cardinality(counts, 2).collect()}[2] == ["0", "1"]


def test_streams_agree_with_batches(spark, tmp_path, small):
    src = spark.read.parquet(f"{small}/transactions.parquet").filter("year(transaction_date) = 2021").repartition(3)
    src.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    q = (amounts.daily_amounts(stream, ["source_phone", "service_code"], "transaction_date", "transaction_amount", late="400 days")
         .writeStream.outputMode("complete").format("memory").queryName("daily").start())
    q.processAllAvailable()
    q.stop()
    got = {(r.source_phone, r.service_code, r.day): (r.units, r.n) for r in spark.table("daily").collect()}
    batch = rolling.daily_amounts(src, ["source_phone", "service_code"], "transaction_date", "transaction_amount")
    assert got == {(r.source_phone, r.service_code, r.day): (r.units, r.n) for r in batch.collect()}
    dims = budget.limits(spark.read.parquet(f"{small}/service_thresholds.parquet"), "service_code", ["seuil_cumul_journalier_mru"])
    assert amounts.level_alerts(spark.table("daily"), dims, "service_code", "seuil_cumul_journalier_mru").filter(F.col("level").isNull()).count() == 0


def test_stream_takes_a_code_once(spark, tmp_path):
    t = dt.datetime(2021, 1, 1)
    spark.createDataFrame([(1, t), (1, t), (2, t)], "code int, at timestamp").write.parquet(str(tmp_path / "in"))
    s = amounts.once(spark.readStream.schema("code int, at timestamp").parquet(str(tmp_path / "in")), "code", "at", "1 day")
    q = s.writeStream.format("memory").queryName("once").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.code for r in spark.table("once").collect()) == [1, 2]


def test_lines_without_a_number_are_counted(spark, tmp_path):
    from tidemill.plans import reference

    rows = [(1, 1, "a,b"), (2, 2, "1,2"), (3, None, "1,2,3")]
    spark.createDataFrame(rows, "line_id bigint, line_no int, line string").write.parquet(str(tmp_path / "raw_lines.parquet"))
    got = {r.n_fields: r.n_lines for r in reference.QUERIES["field_counts"](spark, str(tmp_path)).collect()}
    assert got == {2: 1, 3: 1}


def test_audit_of_any_line(spark):
    long = '"' + 'x""' * 20_000 + '",b'
    lines = spark.createDataFrame([(1, long), (2, 'a,"b,c'), (3, '"say ""hi""",2'), (4, None)], "i int, line string")
    values = {r.i: r.v for r in lines.select("i", audit.values_of("line").alias("v")).collect()}
    assert values[1] == ['x"' * 20_000, "b"] and values[2] == ["a", '"b,c'] and values[3] == ['say "hi"', "2"] and values[4] is None
    wide = {r.i: (r.a, r.b, r.c) for r in audit.padded(lines.filter("i > 1"), "line", ["a", "b", "c"]).collect()}
    assert wide == {2: ("a", '"b,c', ""), 3: ('say "hi"', "2", ""), 4: ("", "", "")}


def test_audit_report_is_json(spark, tmp_path):
    lines = spark.createDataFrame([(1, "a,1,x"), (2, "b,0"), (3, "a,,")], "i int, line string")
    report = audit.audit_report(lines, "line", "i", "here")
    assert report["lines"] == 3 and report["field_counts"] == {2: 1, 3: 2} and report["binary_candidates"] == [1]
    assert report["positions"][0]["sample_values"] == ["a", "b", "a"] and report["positions"][0]["distinct_values"] == ["a", "b"]
    files.write_report(report, str(tmp_path / "r.json"))
    assert json.loads((tmp_path / "r.json").read_text())["source"] == "here"
