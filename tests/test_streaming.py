from sparkweft.streaming.edges import IncrementalComponents, running_degrees, session_counts, windowed_counts


def test_degrees_and_windows(spark, tmp_path):
    rows = [("2024-01-01 00:00:00", 1, 2), ("2024-01-01 00:00:30", 1, 3), ("2024-01-01 00:05:00", 2, 3)]
    spark.createDataFrame(rows, "t string, src long, dst long").selectExpr("cast(t as timestamp) as t", "src", "dst").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema("t timestamp, src long, dst long").parquet(f"{tmp_path}/in")
    found = {}
    for name, df in (("deg", running_degrees(stream())), ("win", windowed_counts(stream(), "t", "1 minute")), ("ses", session_counts(stream(), "t", "2 minutes"))):
        q = df.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
        q.awaitTermination()
        found[name] = spark.table(name).collect()
    assert {tuple(r) for r in found["deg"]} == {(1, 2), (2, 2), (3, 2)}
    assert sorted((r["id"], r["n"]) for r in found["win"]) == [(1, 2), (2, 1)]
    assert sorted((r["id"], r["n"]) for r in found["ses"]) == [(1, 2), (2, 1)]


def test_components_by_batch(spark, tmp_path):
    merge = IncrementalComponents(f"{tmp_path}/c")
    batch = lambda *e: spark.createDataFrame(list(e), "src long, dst long")
    merge(batch((1, 2), (3, 4), (9, 9)), 0)
    merge(batch((2, 3), (7, 8)), 1)
    merge(batch((2, 3), (7, 8)), 1)
    assert {tuple(r) for r in spark.read.parquet(merge.path).collect()} == {(1, 1), (2, 1), (3, 1), (4, 1), (7, 7), (8, 7), (9, 9)}
