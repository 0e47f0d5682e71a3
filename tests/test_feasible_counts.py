"""Feasible events counted over blocks of thresholds, against every scope beside every event."""

import random

import pytest
from pyspark.sql import functions as F

from outpulse.operators import matching

SCOPES = """request_id string, category_key string, max_cost double, solo_required boolean, date date, after_seconds double,
 hours_free double, origin_known boolean"""
EVENTS = """event_id string, category_key string, start_date date, solo_ok boolean, cost double, start_seconds double,
 duration_hours double"""



def draw_rows(spark, seed, n_scopes, n_events, thresholds):
    draw = random.Random(seed)
    days = ["2026-07-21", "2026-07-22", "2026-07-23"]
    bounds = [[draw.choice([draw.uniform(0, 50), float(draw.randrange(50))]) for _ in range(thresholds)] for _ in range(3)]
    some = lambda values: draw.choice(values) if values and draw.random() < 0.7 else None
    value = lambda values: draw.choice([some(values), draw.uniform(-5, 60), None])
    scopes = [
        (f"r{i}", some(["a", "b", "*"]), some(bounds[0]), draw.random() < 0.4, some(days), some(bounds[1]), some(bounds[2]), False)
        for i in range(n_scopes)
    ]
    events = [
        (f"e{i}", draw.choice(["a", "b", "*", None]), draw.choice(days), draw.random() < 0.5, *[value(b) for b in bounds])
        for i in range(n_events)
    ]
    typed = lambda df, column: df.withColumn(column, F.col(column).cast("date"))
    text = lambda schema, column: schema.replace(f"{column} date", f"{column} string")
    wishes = typed(spark.createDataFrame(scopes, text(SCOPES, "date")), "date")
    wishes = wishes.withColumn("scope_key", F.md5(F.to_json(F.struct(*wishes.columns[1:]))))
    return scopes, events, wishes, typed(spark.createDataFrame(events, text(EVENTS, "start_date")), "start_date")


def allows(scope, event):
    _, category, max_cost, solo, date, after, hours, _ = scope
    _, own, day, solo_ok, cost, start, length = event
    return (
        category in (None, own)
        and date in (None, day)
        and (not solo or solo_ok)
        and (max_cost is None or (cost is not None and cost <= max_cost))
        and (after is None or (start is not None and start >= after))
        and (hours is None or length is None or length <= hours)
    )


@pytest.mark.parametrize("thresholds", [0, 1, 2, 7, 8, 33])
def test_counts_equal_all_pairs(spark, thresholds):
    scopes, events, wishes, offered = draw_rows(spark, thresholds, 60, 300, thresholds)
    got = {r["request_id"]: r["feasible_events"] for r in matching.feasible_counts(wishes, offered).collect()}
    assert got == {s[0]: sum(allows(s, e) for e in events) for s in scopes}


def test_nothing_to_count(spark):
    _, _, wishes, offered = draw_rows(spark, 1, 5, 5, 3)
    assert {r["feasible_events"] for r in matching.feasible_counts(wishes, offered.limit(0)).collect()} == {0}
    assert matching.feasible_counts(wishes.limit(0), offered).count() == 0


def widest_join(df):
    """The most rows that a join of the executed plan gave."""
    rows = df.collect()
    found, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        elif "QueryStage" in name:
            todo.append(node.plan())
        if "Join" in name:
            metric = node.metrics().get("numOutputRows")
            if metric.isDefined():
                found.append(metric.get().value())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    assert rows and found
    return max(found)


def test_joins_do_not_grow_with_scopes_times_events(spark):
    few = draw_rows(spark, 5, 150, 400, 6)
    many = draw_rows(spark, 5, 150, 4000, 6)
    widths = [widest_join(matching.feasible_counts(w, e)) for _, _, w, e in (few, many)]
    # The widest join gives every event the row of thresholds; scopes times events would be 600,000.
    assert widths[1] <= 4000 + widths[0]


def test_copies_of_an_event_meet_the_scopes_a_few_times(spark):
    _, _, wishes, _ = draw_rows(spark, 9, 40, 1, 5)
    scopes = wishes.drop("request_id").distinct()
    columns = f"{EVENTS}, tags_text string, confidence_text string, spot string, tile string".replace("date date", "date string")
    same = ("a", "2026-07-21", True, 5.0, 100.0, 1.0, "x|y", "0.5", "1,1", "t")
    rows = [(f"e{i:04d}", *same) for i in range(2000)] + [("other", *same[:6], "z", *same[7:])]
    kept = matching._first_of_class(spark.createDataFrame(rows, columns), scopes, 10).select("event_id").collect()
    assert sorted(r["event_id"] for r in kept) == [f"e{i:04d}" for i in range(10)] + ["other"]
