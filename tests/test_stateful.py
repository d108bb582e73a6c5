"""Streams with timers against the same rows as a table; nothing stays in the state store."""

import pytest
from pyspark.sql import functions as F

from windloom.streaming import lockout, staging, stateful

SF = "/root/testdata/sf0.001"
HOUR = 3_600_000


@pytest.fixture()
def rocks(spark):
    before = spark.conf.get(stateful.STATE_STORE[0])
    spark.conf.set(*stateful.STATE_STORE)
    yield spark
    spark.conf.set(stateful.STATE_STORE[0], before)


def run(spark, rows, at, operator, path, state):
    """The operator's rows over the table in five files, and the state that is left when much later rows have come."""
    bounds = [float(x) for x in rows.stat.approxQuantile(at, [0.2, 0.4, 0.6, 0.8], 0.0)]
    for k, (low, high) in enumerate(zip([float("-inf"), *bounds], [*bounds, float("inf")])):
        rows.where((F.col(at) > low) & (F.col(at) <= high)).coalesce(1).write.parquet(f"{path}/in/part={k}")
    found = []
    stream = operator(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in/*"))
    query = stream.writeStream.option("checkpointLocation", f"{path}/state").foreachBatch(lambda df, _: found.extend(tuple(r) for r in df.collect())).trigger(availableNow=True).start()
    query.awaitTermination()
    return sorted(found), spark.read.format("statestore").option("stateVarName", state).load(f"{path}/state")


def test_staged_imports(rocks, tmp_path):
    table = rocks.read.parquet(f"{SF}/events.parquet")
    kind = F.col("event_type")
    rows = table.select((F.col("user_id") % 7).alias("handle"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").alias("id"), (F.col("event_id") % 2).alias("project"), kind.isin("view", "click", "signup").alias("staged"))
    end = rows.agg(F.max("at")).first()[0] + 48 * HOUR * 1000
    late = rocks.createDataFrame([(-1, end + k * HOUR * 1000, -k, 0, False) for k in range(3)], rows.schema)
    want = sorted(tuple(r) for r in staging.settle(rows.unionByName(late)).select("handle", "id", "at", "result").collect())
    got, left = run(rocks, rows.unionByName(late), "at", stateful.staged_commits, tmp_path, "staged")
    assert got == want
    assert {r[3] for r in want} == {"COMMITTED", "EXPIRED", "OTHER_PROJECT"}
    assert left.count() == 0


def test_login_locks(rocks, tmp_path):
    rows = lockout.attempts(rocks.read.parquet(f"{SF}/events.parquet").withColumn("user_id", F.col("user_id") % 5), lockout.SPEED)
    end = rows.agg(F.max("at")).first()[0] + 48 * HOUR
    late = rocks.createDataFrame([(-1, end + k * HOUR, False, -k) for k in range(3)], rows.schema)
    want = sorted(tuple(r) for r in lockout.refused_attempts(rows.unionByName(late)).collect())
    got, left = run(rocks, rows.unionByName(late), "at", stateful.locked_attempts, tmp_path, "lock")
    assert got == want and len(want) > 10
    assert left.count() == 0
