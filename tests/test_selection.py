import random
import statistics

import pytest

from outpulse.operators.selection import exact_median


@pytest.mark.parametrize("ranges", [1, 3, 4096])
def test_medians_of_groups(spark, ranges):
    draw = random.Random(ranges)
    groups = {
        "even": [1.0, 9.0],
        "odd": [3.0, 1.0, 2.0],
        "one": [7.5],
        "same": [4.0] * 9,
        "hot": [0.0] * 400 + [draw.uniform(-5, 5) for _ in range(399)],
        "wide": [draw.choice([-1e9, 1e-9, 1e12, draw.gauss(0, 1)]) for _ in range(500)],
        "far": [0.1] * 50 + [1e6] * 50,
    }
    rows = [(g, v) for g, values in groups.items() for v in [*values, None]] + [("unknown", None), (None, None)]
    draw.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v double").repartition(3)
    got = {r["g"]: r["median"] for r in exact_median(df, "g", "v", ranges).collect()}
    assert got == {g: pytest.approx(statistics.median(v), rel=1e-12) for g, v in groups.items()}


def test_no_values(spark):
    assert exact_median(spark.createDataFrame([], "g string, v double"), "g", "v").count() == 0
