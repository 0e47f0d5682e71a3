import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from outpulse import schemas  # noqa: E402
from outpulse.clock import Clock  # noqa: E402
from outpulse.session import build_session  # noqa: E402

from helpers import EVENTS, SOURCES, ZIPS, day, events_frame  # noqa: E402

# Noon in the city on 20 July 2026.
CLOCK = Clock("2026-07-20 16:00:00")


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        master="local[8]",
        app_name="tests",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "6g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def clock():
    return CLOCK


@pytest.fixture(scope="session")
def sources(spark):
    rows = [(s, n, c, ch, f"https://{s}.example.org", cad, day(d), notes, act, None) for s, n, c, ch, cad, d, notes, act in SOURCES]
    return spark.createDataFrame(rows, schemas.SOURCES)


@pytest.fixture(scope="session")
def curated(spark):
    return events_frame(spark, EVENTS)


@pytest.fixture(scope="session")
def zips(spark):
    return spark.createDataFrame(ZIPS, schemas.ZIP_CENTROIDS)


@pytest.fixture(scope="session")
def no_feed(spark):
    return spark.createDataFrame([], schemas.FEED)


@pytest.fixture(scope="session")
def enriched(curated, no_feed, sources, zips, clock):
    from outpulse.plans import enrich, staging

    return enrich.enrich(
        staging.all_events(curated, no_feed), staging.all_sources(sources, no_feed), zips, clock
    ).cache()


@pytest.fixture(scope="session")
def feed_frame(spark):
    names = [part.split()[0] for part in schemas.FEED.split(",")]

    def build(*rows):
        return spark.createDataFrame([tuple(row[name] for name in names) for row in rows], schemas.FEED)

    return build
