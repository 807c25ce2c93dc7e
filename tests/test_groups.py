import pytest
from pyspark.sql import functions as F

from stranda.operators import islands
from stranda.streaming import reads as streaming

ROWS = [(1, "a", 1, 5, "+"), (2, "a", 1, 9, "+"), (3, "a", 7, 9, "-"), (4, "a", 10, 12, "+"), (5, "b", 1, 5, "+"), (6, "a", 1, 5, "+")]


@pytest.mark.parametrize("strategy,want", [("start", [[1, 2, 6], [3], [4], [5]]), ("end", [[1, 6], [2, 3], [4], [5]]), ("both", [[1, 6], [2], [3], [4], [5]]), ("overlap", [[1, 2, 3, 6], [4], [5]])])
def test_groups_and_their_members(spark, strategy, want):
    df = spark.createDataFrame(ROWS, "uid long, chrom string, start_ long, end_ long, strand string")
    got = islands.groups(df, strategy, ["uid"]).collect()
    assert sorted(sorted(m.uid for m in r.members) for r in got) == want and all(r.n == len(r.members) for r in got)
    assert all(r.start_ == min(m.start_ for m in r.members) and r.end_ == max(m.end_ for m in r.members) for r in got)
    if strategy == "overlap":
        assert islands.groups(df, strategy, ["uid"], adjacent=True).count() == 2
        assert sorted(sorted(m.uid for m in r.members) for r in islands.groups(df, strategy, ["uid"], ["chrom", "strand"]).collect()) == [[1, 2, 6], [3], [4], [5]]
    with pytest.raises(ValueError):
        islands.groups(df, "middle", [])


def test_every_mode_of_steps(spark):
    lists = {"up": [1, 2, 4], "flat": [3, 3], "one": [7], "down": [5, 4, 3], "mixed": [1, 0, 2]}
    df = spark.createDataFrame([(k, i, x) for k, xs in lists.items() for i, x in enumerate(xs)], "k string, i long, x long")
    got = {r.k: {m for m in islands.STEPS if r[m]} for r in islands.steps(df, ["k"], ["i"], "x", list(islands.STEPS)).collect()}
    assert got == {"up": {"inc", "inceq"}, "flat": {"inceq", "deceq", "eq"}, "one": set(islands.STEPS), "down": {"dec", "deceq", "dec1"}, "mixed": set()}


def test_reads_of_a_stream_are_filtered_and_counted(spark, tmp_path):
    schema = "flag int, mapq int, start_ long, end_ long, ts timestamp"
    rows = [(0, 30, 1, 9, "2024-01-01 00:00:01"), (4, 30, 1, 9, "2024-01-01 00:00:02"), (0, 5, 1, 9, "2024-01-01 00:00:03"), (0, 30, 1, 900, "2024-01-01 00:00:04"), (0, 30, 1, 9, "2024-01-01 00:01:30")]
    spark.createDataFrame(rows, schema.replace("timestamp", "string")).withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    counts = streaming.windowed_counts(streaming.filter_reads(stream, least_mapq=10, longest=100), "ts", "1 minute", "0 seconds")
    query = counts.writeStream.format("memory").queryName("counted").outputMode("complete").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted((str(r.start), r.n) for r in spark.table("counted").collect()) == [("2024-01-01 00:00:00", 1), ("2024-01-01 00:01:00", 1)]
