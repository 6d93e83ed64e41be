import csv
import io
import os
import random
import tempfile
import zipfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from oddity.sources import files as SRC
from oddity.streaming.scoring import fit_frozen, score_stream
from tests.conftest import SF001


def test_csv_scan_types_na_and_quoted_newline(spark):
    d = tempfile.mkdtemp()
    with open(os.path.join(d, "a.csv"), "w") as f:
        f.write('id,amount,note,flag\n1,10.5,"two\nlines",True\n2,NA,plain,False\n3,7,,True\n')
    df = SRC.read_csv(spark, d)
    types = dict(df.dtypes)
    assert types["id"] == "bigint" and types["amount"] == "double" and types["flag"] == "boolean"
    rows = df.orderBy("row_id").collect()
    assert [r["row_id"] for r in rows] == [0, 1, 2]
    assert rows[0]["note"] == "two\nlines" and rows[1]["amount"] is None and rows[2]["note"] is None


def _write_rows(path, rows, end="\n"):
    with open(path, "w", newline="", encoding="utf-8") as f:
        w = csv.writer(f, lineterminator=end)
        w.writerow(["id", "note", "amount"])
        for r in rows:
            w.writerow(r)
            if rnd_blank.random() < 0.05:
                f.write(end)


rnd_blank = random.Random(1)


@pytest.mark.parametrize("split", [300, 1500, 1 << 20])
def test_csv_with_quoted_line_ends_is_read_by_splits(spark, split):
    rnd, d = random.Random(split), tempfile.mkdtemp()
    value = lambda: "".join(rnd.choice(['a', 'b ', ',', '"', '""', "\n", "\n\n", " \n", "é", "x" * 40]) for _ in range(rnd.randrange(6)))
    rows = [[str(k), value() + "z", str(k / 4)] for k in range(400)]
    rows[7][1] = "long\n" * 400 + "\"end"
    _write_rows(os.path.join(d, "b.csv"), rows[250:])
    _write_rows(os.path.join(d, "a.csv"), rows[:250])
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    try:
        df = SRC.read_csv(spark, d)
        tasks = df.rdd.getNumPartitions()
        got = df.orderBy("row_id").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert [(r["row_id"], r["id"], r["note"], r["amount"]) for r in got] == [(k, k, r[1], float(r[2])) for k, r in enumerate(rows)]
    assert split > 1500 or tasks > 5
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Scan ExistingRDD" not in plan and "InMemoryTableScan" not in plan


def test_csv_equals_the_reader_of_whole_files(spark):
    d = tempfile.mkdtemp()
    with open(os.path.join(d, "a.csv"), "w", newline="") as f:
        f.write("\ufeffa,b b,a,\r\n\r\n1,\"x\r\ny\",,4\r\n  \r\n,\"\"\"q\"\"\",3\r\n5,6,7,8,9\r\n\"open, never closed\r\n1,2,3,4\r\n")
    options = {"header": True, "multiLine": True, "escape": '"'}
    whole = SRC.na_to_null(spark.read.options(**options).csv(d))
    df = SRC.read_csv(spark, d, infer_types=False).orderBy("row_id")
    assert df.columns == ["row_id", *whole.columns]
    blank = [None] * 4  # lines of blanks only are rows of the plain reader, but not of the reference's
    clean = lambda r: [None if v is None or not v.strip() else v.replace("\r\n", "\n").strip() for v in r]
    assert [clean(r[1:]) for r in df.collect()] == [x for x in map(clean, whole.collect()) if x != blank]


def test_row_ids_of_several_xml_files_follow_the_paths(spark):
    d = tempfile.mkdtemp()
    for name, first, n in (("b", 30, 5), ("a", 0, 30), ("c", 35, 40)):
        with open(os.path.join(d, f"{name}.xml"), "w") as f:
            f.write("<records>" + "".join(f"<record><id>{k}</id></record>" for k in range(first, first + n)) + "</records>")
    df = SRC.read_xml(spark, d, "record")
    assert [(r["row_id"], r["id"]) for r in df.orderBy("row_id").collect()] == [(k, str(k)) for k in range(75)]


def test_csv_scan_refuses_empty_table(spark):
    d = tempfile.mkdtemp()
    with open(os.path.join(d, "a.csv"), "w") as f:
        f.write("a,b\n")
    with pytest.raises(SRC.EmptyTableError):
        SRC.read_csv(spark, d)


def test_xml_scan_flattens_records(spark):
    d = tempfile.mkdtemp()
    with open(os.path.join(d, "a.xml"), "w") as f:
        f.write('<?xml version="1.0"?><ns:records xmlns:ns="urn:x">'
                '<ns:record k="7"><ns:id>1</ns:id><originator t="P"><name>x</name></originator>'
                '<tag>a</tag><tag>b</tag><empty>  </empty></ns:record>'
                '<ns:record k="8"><ns:id>2</ns:id><originator t="Q"><name>y</name></originator>'
                '<tag>c</tag><empty>v</empty></ns:record></ns:records>')
    df = SRC.read_xml(spark, d, "record")
    rows = df.orderBy("row_id").collect()
    cols = set(df.columns)
    assert {"@k", "id", "originator_@t", "originator_name", "tag", "empty"} <= cols
    assert rows[0]["id"] == "1" and rows[0]["originator_name"] == "x" and rows[0]["originator_@t"] == "P"
    assert rows[0]["tag"] == "b"          # a repeated tag keeps its last value
    assert rows[0]["empty"] is None       # blank text is null


def test_archive_scan_skips_metadata_members(spark):
    d = tempfile.mkdtemp()
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as zf:
        zf.writestr("data/t.csv", "a,b\n1,x\n2,y\n")
        zf.writestr("__MACOSX/data/._t.csv", "junk")
        zf.writestr("data/.hidden.csv", "a,b\n9,z\n")
        zf.writestr("notes.txt", "no")
    with open(os.path.join(d, "one.zip"), "wb") as f:
        f.write(buf.getvalue())
    members = [r["member"] for r in SRC.archive_members(spark, d).collect()]
    assert members == ["data/t.csv"]
    df = SRC.read_archive(spark, d)
    assert [(r["a"], r["b"]) for r in df.orderBy("row_id").collect()] == [(1, "x"), (2, "y")]


def test_archives_with_only_a_header_and_members_larger_than_a_batch(spark, monkeypatch):
    d = tempfile.mkdtemp()
    lines = ['"x\ny",0'] + [f"v{i},{i}" for i in range(1, 23)]
    for name, body in (("a.zip", lines), ("b.zip", []), ("c.zip", ["last,23"])):
        with zipfile.ZipFile(os.path.join(d, name), "w") as zf:
            zf.writestr("t.csv", "\n".join(["a,b", *body, ""]))
    df = SRC.read_archive(spark, d)
    assert [(r["row_id"], r["a"], r["b"]) for r in df.orderBy("row_id").collect()] == [
        (i, "x\ny" if i == 0 else "last" if i == 23 else f"v{i}", i) for i in range(24)]
    monkeypatch.setattr(SRC, "ARCHIVE_ROWS", 5)
    with open(os.path.join(d, "a.zip"), "rb") as f:
        parts = list(SRC._archive_rows([pd.DataFrame({"path": ["a.zip"], "content": [f.read()]})]))
    assert [list(p["line"]) for p in parts] == [list(range(i, min(i + 5, 23))) for i in range(0, 23, 5)]


def test_archive_query_on_a_table_with_empty_partitions(spark):
    d = tempfile.mkdtemp()
    rows = spark.range(40).select(
        F.col("id").alias("o_orderkey"), (F.col("id") % 7).alias("o_custkey"), F.lit("O").alias("o_orderstatus"),
        (F.col("id") / 4).alias("o_totalprice"), F.lit("5-LOW").alias("o_orderpriority"))
    # three files of rows and one without, read by a task each
    rows.repartitionByRange(3, "o_orderkey").write.parquet(f"{d}/orders.parquet")
    rows.where("o_orderkey < 0").coalesce(1).write.mode("append").parquet(f"{d}/orders.parquet")
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        got = entry.queries()["archive_scan"](spark, d).orderBy("o_orderkey").collect()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert [(r["o_orderkey"], r["o_custkey"], r["o_totalprice"]) for r in got] == [(i, i % 7, i / 4) for i in range(40)]


def test_streaming_scoring_matches_batch(spark):
    ev = spark.read.parquet(f"{SF001}/events.parquet").select(
        F.col("event_id").alias("row_id"), "value", "user_id", "event_type")
    model = fit_frozen(ev, ["value", "user_id", "event_type"], 0.05, n_trees=30)
    batch = score_stream(ev, model).toPandas().set_index("row_id").sort_index()
    src = tempfile.mkdtemp()
    ev.write.mode("overwrite").parquet(src + "/in")
    stream = spark.readStream.schema(ev.schema).parquet(src + "/in")
    q = (score_stream(stream, model).writeStream.format("memory").queryName("oddity_scores")
         .option("checkpointLocation", src + "/ckpt").outputMode("append").start())
    q.processAllAvailable()
    q.stop()
    got = spark.sql("SELECT * FROM oddity_scores").toPandas().set_index("row_id").sort_index()
    assert len(got) == len(batch)
    assert np.allclose(got["score"], batch["score"])
    assert got["is_anomaly"].sum() == pytest.approx(0.05 * len(got), abs=3)


def test_entry_and_registry_contract(spark):
    import __spark_entry__ as E
    out = E.entry(spark)
    assert out.count() == 20
    q, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(q)
    assert {"isolation_forest", "semi_supervised"} <= set(sql) and {"ocsvm", "review_top"} <= set(q) - set(sql)
    assert len(q) >= 75


def test_checkpoints_go_to_the_configured_folder(spark):
    from oddity.session import ensure_checkpoint_dir
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    used = ensure_checkpoint_dir(spark)
    assert configured and configured.rstrip("/").split(":")[-1] in used
