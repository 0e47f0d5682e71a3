import collections
import json
import os
import statistics
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from outpulse.operators import joins
from outpulse.operators.joins import is_small, lookup_join


REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="module")
def sides(spark):
    # A third of the facts has key 0, another third has no key, and some keys have no match.
    facts = spark.range(3000).select(
        F.col("id").alias("fact"),
        F.when(F.col("id") % 3 == 0, F.lit(0)).when(F.col("id") % 3 == 2, F.col("id") % 97).alias("k"),
    )
    lookup = spark.range(80).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    return facts, lookup


@pytest.mark.parametrize("how", ["left", "inner"])
@pytest.mark.parametrize("cells", [1, 5, 1000])
def test_salted_join_equals_plain_join(sides, how, cells, monkeypatch):
    monkeypatch.setattr(joins, "CELLS_PER_PIECE", cells)
    facts, lookup = sides
    salted = lookup_join(facts, lookup, "k", spread_by="fact", how=how, max_broadcast_rows=0)
    plain = facts.join(lookup, "k", how)
    assert sorted(map(str, salted.select("fact", "k", "v").collect())) == sorted(
        map(str, plain.select("fact", "k", "v").collect())
    )


def test_small_lookup_is_broadcast_and_large_is_not(spark, sides):
    facts, lookup = sides
    assert is_small(lookup, 80) and not is_small(lookup, 79)
    plan = lookup_join(facts, lookup, "k", spread_by="fact")._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan
    plan = lookup_join(facts, lookup, "k", spread_by="fact", max_broadcast_rows=10)._jdf.queryExecution().optimizedPlan()
    assert "_salt" in plan.toString()


def test_composite_keys_and_repeated_lookup_keys(spark, sides):
    facts, _ = sides
    facts = facts.withColumn("j", F.col("fact") % 2)
    lookup = spark.createDataFrame([(0, 0, "a"), (0, 0, "b"), (5, 1, "c")], "k long, j long, v string")
    for limit in (0, 100):
        joined = lookup_join(facts, lookup, ["k", "j"], spread_by="fact", how="inner", max_broadcast_rows=limit)
        assert joined.count() == facts.join(lookup, ["k", "j"]).count()


def test_the_largest_task_reads_little_more_than_the_others(tmp_path):
    """A key with half of the rows, a lookup too large to be broadcast, rows read by the join's tasks from an event log."""
    script = f"""
import sys
sys.path.insert(0, {REPO!r})
from pyspark.sql import functions as F
from outpulse.operators.joins import lookup_join
from outpulse.session import build_session
spark = build_session(master="local[4]", app_name="skew", **{{
    "spark.ui.enabled": "false", "spark.eventLog.enabled": "true", "spark.eventLog.dir": {str(tmp_path)!r}, "spark.eventLog.rolling.enabled": "false",
    "spark.eventLog.compress": "false", "spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.adaptive.skewJoin.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}})
facts = spark.range(400_000).select(F.col("id").alias("fact"), F.when(F.col("id") % 2 == 0, F.lit(7)).otherwise(F.col("id")).alias("k"))
lookup = spark.range(200_000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
joined = lookup_join(facts, lookup, "k", spread_by="fact", max_broadcast_rows=1000)
assert joined.agg(F.count("v")).first()[0] == 300_000
spark.stop()
"""
    subprocess.run([sys.executable, "-c", script], check=True, timeout=300, capture_output=True)
    (log,) = [p for p in tmp_path.iterdir() if p.is_file() and "skew" not in p.name]
    read = collections.defaultdict(list)
    for line in log.read_text().splitlines():
        event = json.loads(line)
        if event["Event"] == "SparkListenerTaskEnd":
            read[event["Stage ID"]].append(event["Task Metrics"]["Shuffle Read Metrics"]["Total Records Read"])
    # The join's stage reads the most.
    records = max(read.values(), key=sum)
    assert len(records) == 16 and sum(records) > 600_000
    assert max(records) <= 2 * statistics.median(records)
