from pyspark.sql import functions as F

from tekstara.streaming.store import counts_by_window, first_seen, upsert_stream


def stream(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(path))


def write(path, name, lines):
    (path / name).write_text("\n".join(lines))


def test_upserts(spark, tmp_path):
    (src := tmp_path / "in").mkdir()
    write(src, "1.json", ['{"word": "a", "v": 1, "n": 1}', '{"word": "b", "v": 1, "n": 1}'])
    q = upsert_stream(stream(spark, src, "word string, v int, n int"), str(tmp_path / "t"), "word", "n", str(tmp_path / "c"), availableNow=True)
    q.awaitTermination()
    write(src, "2.json", ['{"word": "a", "v": 2, "n": 2}', '{"word": "b", "v": 0, "n": 0}'])
    upsert_stream(stream(spark, src, "word string, v int, n int"), str(tmp_path / "t"), "word", "n", str(tmp_path / "c"), availableNow=True).awaitTermination()
    last = sorted(p.name for p in (tmp_path / "t").iterdir())[-1]
    assert {r["word"]: r["v"] for r in spark.read.parquet(str(tmp_path / "t" / last)).collect()} == {"a": 2, "b": 1}


def test_windows_and_first_rows(spark, tmp_path):
    (src := tmp_path / "in").mkdir()
    write(src, "1.json", ['{"ts": "2024-01-01T00:10:00", "k": "x"}', '{"ts": "2024-01-01T00:20:00", "k": "x"}', '{"ts": "2024-01-01T09:00:00", "k": "y"}'])
    events = stream(spark, src, "ts timestamp, k string")
    q = counts_by_window(events, "ts", "k").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r["k"], r["n"]) for r in spark.table("w").collect()) == [("x", 2), ("y", 1)]
    q = first_seen(events, "ts", "k").writeStream.format("memory").queryName("f").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("f").where(F.col("k") == "x").count() == 1
