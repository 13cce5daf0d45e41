"""Every query with SQL gives the rows that DuckDB gives; the others give rows with a stable schema."""

import importlib
import os
import subprocess
import sys

import duckdb
import pytest

from snapdelta import queries as Q
from snapdelta.streaming import releases

from .conftest import DATA

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def plain(rows, columns):
    value = lambda v: round(v, 6) if isinstance(v, float) else v
    return sorted([tuple(value(r[c]) for c in columns) for r in rows], key=repr)


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, duck, name):
    df = Q.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = plain([r.asDict() for r in df.collect()], columns)
    if name in Q.ORACLES:
        want = duck.sql(Q.ORACLES[name])
        assert sorted(want.columns) == columns
        assert got == plain([dict(zip(want.columns, r)) for r in want.fetchall()], columns)
    else:
        assert got


def test_new_capabilities_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    schema = "package string, version string, published_at timestamp, capability string"
    rows = lambda *r: spark.createDataFrame([(p, v, t, c) for p, v, t, c in r], "package string, version string, t string, capability string").selectExpr("package", "version", "cast(t as timestamp) as published_at", "capability")
    rows(("p", "1", "2024-01-01", "network"), ("q", "1", "2024-01-01", "dns")).coalesce(1).write.mode("append").parquet(source)
    stream = releases.new_capabilities(spark.readStream.schema(schema).parquet(source))

    def run():
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
        assert q.awaitTermination(120)

    run()
    rows(("p", "2", "2024-02-01", "network"), ("p", "2", "2024-02-01", "filesystem"), ("q", "0", "2023-01-01", "vm")).coalesce(1).write.mode("append").parquet(source)
    run()
    got = {(r["package"], r["capability"], r["late"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("p", "network", False), ("q", "dns", False), ("p", "filesystem", False), ("q", "vm", True)}


def test_stream_windows_and_replays(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([("p", "f", "high", "2024-01-01"), ("p", "f", "high", "2024-01-01"), ("p", "g", "low", "2024-01-02")], "package string, fingerprint string, severity string, t string").selectExpr("package", "fingerprint", "severity", "cast(t as timestamp) as published_at").coalesce(1).write.parquet(source)
    stream = spark.readStream.schema("package string, fingerprint string, severity string, published_at timestamp").parquet(source)
    for name, df, mode, n in (("replays", releases.deduplicated(stream), "append", 2), ("windows", releases.tumbling_counts(stream), "complete", 2)):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        assert q.awaitTermination(120) and spark.table(name).count() == n


def test_entry_works_without_the_corpus_operators(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for item in ("snapdelta", "__spark_entry__.py"):
        subprocess.run(["cp", "-r", f"{root}/{item}", str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", f"{tmp_path}/snapdelta/llm"], check=True)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert said.returncode == 0 and said.stdout.split() == [str(len(Q.QUERIES)), str(len(Q.ORACLES))], said.stderr


def test_entry(spark):
    entry = importlib.import_module("__spark_entry__")
    assert entry.entry(spark).count() > 0


def test_byte_size_label_of_long_documents(spark, tmp_path):
    sizes = {1: 1 << 20, 2: 3 * (1 << 20) + (1 << 19), 3: 20 << 20, 4: 1023}
    spark.createDataFrame(list(sizes.items()), "doc_id long, n int").selectExpr("doc_id", "repeat('x', n) as text").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["label"] for r in Q.byte_size_label(spark, str(tmp_path)).collect()}
    assert got == {1: "1.00 MB", 2: "3.50 MB", 3: "20.0 MB", 4: "1023 B"}
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert dict(c.sql(Q.ORACLES["byte_size_label"]).fetchall()) == got
