"""Scans and writers."""

import json

import pytest
from pyspark.sql import functions as F

from strandline.sources import files, sinks
from strandline.streaming import monitor


def test_json_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('// note\n{"id": "x", "n": 1}\n\n{"id": "é", "n": null}\n', encoding="utf-8")
    rows = files.json_lines(spark, str(tmp_path / "a.jsonl"), "id string, n int", comments=True)
    assert sorted(map(tuple, rows.collect()), key=str) == [("x", 1), ("é", None)]
    assert files.json_lines(spark, str(tmp_path / "none.jsonl"), "id string").collect() == []


def test_named_files(spark, tmp_path):
    for name in ("calibration_wiki_small_ctx50", "calibration_wiki_big"):
        (tmp_path / f"{name}.jsonl").write_text('{"v": [1.0]}\n{"v": []}\n')
    rows = files.named_json_lines(spark, str(tmp_path / "*.jsonl"), "v array<double>", r"^calibration_(?P<dataset>[^_]+)_(?P<model>[^_.]+)(?:_ctx(?P<ctx>\d+))?\.jsonl$")
    assert {tuple(x) for x in files.with_arrays(rows, "v").select("dataset", "model", "ctx").collect()} == {("wiki", "small", "50"), ("wiki", "big", None)}


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('text,label\nNA,x\n"",y\n"a ""q"", b",z\n')
    assert [x["text"] for x in files.csv_literal(spark, str(tmp_path / "a.csv"), "text string, label string").collect()] == ["NA", "", 'a "q", b']


def test_line_files(spark, tmp_path):
    (tmp_path / "greet.txt").write_text("# note\nhello\n\n hi \n")
    assert [tuple(x) for x in files.line_files(spark, str(tmp_path)).collect()] == [("greet", 2, "hello"), ("greet", 4, "hi")]


def test_cached_sample(spark, tmp_path):
    rows = spark.range(50).withColumnRenamed("id", "item")
    first = files.cached_sample(rows, "item", 5, 1, str(tmp_path / "s")).collect()
    assert sorted(first) == sorted(files.cached_sample(rows.limit(0), "item", 5, 1, str(tmp_path / "s")).collect())


def test_writers(spark, tmp_path):
    rows = spark.createDataFrame([("é_1", 0.12345), ("b", None)], "name string, v double")
    sinks.write_json(rows, str(tmp_path / "j"))
    assert sorted(json.loads(x)["name"] for f in (tmp_path / "j").glob("*.json") for x in f.read_text().splitlines()) == ["b", "é_1"]
    sinks.write_csv(rows, str(tmp_path / "c"), digits=4, quote_all=True, one_file=True)
    (out,) = (tmp_path / "c").glob("*.csv")
    assert '"0.1235"' in out.read_text() and '"None"' in out.read_text()
    assert r"é\_1 & 0.12345" in sinks.latex(rows, "A & B") and "| b | -- |" in sinks.markdown(rows, "T", "made up")
    with pytest.raises(ValueError, match="more than"):
        sinks.latex(rows, "x", most=1)


def test_stream(spark, tmp_path):
    rows = spark.range(200).select((F.lit(1_700_000_000) + F.col("id") * 3600).cast("timestamp").alias("ts"), (F.col("id") >= 100).cast("double").alias("value"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = monitor.watch(monitor.windowed_means(stream, "ts", "value"), 0.0, 0.1, str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination(120)
    found = spark.read.parquet(str(tmp_path / "out"))
    assert 0 < found.count() and found.filter("mean = 0").count() == 0


def test_lines_of_many_files(spark, tmp_path):
    (tmp_path / "a.b.txt").write_bytes(b"one\r\n\r\n  two \n# no\nlast")
    (tmp_path / "c").write_bytes("é\n".encode() + b"\xff\n")
    (tmp_path / ".hidden").write_text("x")
    (tmp_path / "empty.txt").write_text("")
    got = sorted(tuple(x) for x in files.line_files(spark, f"file://{tmp_path}").collect())
    assert got == [("a.b", 1, "one"), ("a.b", 3, "two"), ("a.b", 5, "last"), ("c", 1, "é"), ("c", 2, "�")]
    assert {x["label"] for x in files.line_files(spark, f"{tmp_path}/a*.txt").collect()} == {"a.b"}
    assert files.line_files(spark, f"{tmp_path}/none*").count() == 0


def test_lines_of_a_store_that_only_spark_reads(spark, tmp_path, monkeypatch):
    from strandline.sources import lines

    assert lines.known(f"file://{tmp_path}") and not lines.known("viewfs://store/in")
    (tmp_path / "a.b.txt").write_bytes(b"one\r\n\n# no\n two")
    whole = sorted(tuple(x) for x in files.line_files(spark, str(tmp_path)).collect())
    monkeypatch.setattr(lines, "known", lambda path: False)
    assert sorted(tuple(x) for x in files.line_files(spark, str(tmp_path)).collect()) == whole == [("a.b", 1, "one"), ("a.b", 4, "two")]


def test_lines_in_bounded_memory():
    """A 200 MB file goes through a reader that never asks for more than a chunk, whose batches are small."""
    import io

    import pyarrow as pa

    from strandline.sources import lines

    class Stream(io.RawIOBase):
        left, asked = 200 << 20, 0

        def read(self, n):
            self.asked = max(self.asked, n)
            n = min(n, self.left)
            self.left -= n
            return (b"0123456789abcde\n" * (n // 16 + 1))[:n]

    stream, count, before = Stream(), 0, pa.total_allocated_bytes()
    for number, text in lines.numbered_lines(stream):
        count += 1
    assert count == number == (200 << 20) // 16 and text == "0123456789abcde" and stream.asked <= 1 << 20 and pa.total_allocated_bytes() == before


def test_document_sink(spark, tmp_path):
    path = tmp_path / "out.json"
    rows = spark.range(1000).select("id", F.when(F.col("id") % 3 > 0, F.concat(F.lit('é "'), "id")).alias("text")).repartition(4)
    sinks.write_document(rows, str(path))
    found = json.loads(path.read_text(encoding="utf-8"))
    assert sorted(x["id"] for x in found) == list(range(1000)) and found[0].keys() == {"id", "text"} and [x.name for x in tmp_path.iterdir()] == ["out.json"]
    sinks.write_document(rows.limit(0), str(path))
    assert json.loads(path.read_text()) == []


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    bad = spark.range(100).repartition(3).select(F.when(F.col("id") == 50, F.raise_error(F.lit("no"))).otherwise(F.col("id")).alias("x"))
    with pytest.raises(Exception, match="no"):
        sinks.write_document(bad, str(tmp_path / "out.json"))
    assert list(tmp_path.iterdir()) == []


def test_both_families_of_curves(spark):
    rows = spark.createDataFrame([("a", [1.0, 2.0], None), ("b", [], {"10": 3.0, "9": 4.0}), ("c", None, {}), ("d", [5.0], {"1": 6.0})], "id string, er array<double>, er_by_prefix map<string,double>")
    got = sorted(tuple(x) for x in files.with_curves(rows, ["er"], ["er_by_prefix"]).select("id", "family", "er").collect())
    assert got == [("a", "layers", [1.0, 2.0]), ("b", "rolling", [4.0, 3.0]), ("d", "layers", [5.0]), ("d", "rolling", [6.0])]


def test_bundle_runs_each_plan_once(spark, tmp_path):
    runs = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def counted(x):
        runs.add(1)
        return int(x)

    sinks.write_bundle({"t": spark.range(5).repartition(1).select(counted("id").alias("x"))}, str(tmp_path / "b"))
    assert runs.value == 5
