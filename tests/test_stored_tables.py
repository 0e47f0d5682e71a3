"""Tables as bases and deltas, and what a reader sees of a run that dies."""

import functools
import json
import random

import pytest
from helpers import feed_row
from pyspark.sql import functions as F
from test_upsert_history import random_batches, rows_of

from outpulse import registry
from outpulse.operators import history, upsert
from outpulse.clock import Clock
from outpulse.plans import refresh
from outpulse.sources import adapters, commits, keyed, tables
from outpulse.streaming import feed_stream

CLOCK = Clock("2026-07-20 16:00:00")

DECLARED = "k string, a int, b string"


class Stored:
    """A keyed table beside a dictionary that does the same."""

    def __init__(self, spark, root, buckets=4):
        self.spark, self.root, self.meta, self.batch = spark, root, keyed.new(buckets), -1
        self.declared = spark.createDataFrame([], DECLARED).schema
        self.expected = {}

    def append(self, rows, schema=DECLARED):
        self.batch += 1
        df = self.spark.createDataFrame(rows, schema)
        new = {r[0] for r in rows} - set(self.expected)
        self.meta, counts = keyed.append(self.root, "t", self.meta, self.declared, df, ["k"], self.batch)
        assert counts == {"inserted": len(new), "updated": len(rows) - len(new)}
        for row in df.collect():
            self.expected.setdefault(row["k"], {}).update(row.asDict())
        json.dumps(self.meta)

    def compact(self, buckets):
        self.meta = keyed.compact(self.spark, self.root, "t", self.meta, self.declared, ["k"], self.batch, buckets)

    def read(self, **options):
        return keyed.read(self.spark, self.root, self.meta, self.declared, ["k"], **options)

    def check(self):
        got = self.read()
        want = [{c: r.get(c) for c in got.columns} for r in self.expected.values()]
        assert sorted(map(str, (r.asDict() for r in got.collect()))) == sorted(map(str, want))


def test_deltas_merge_like_upserts(spark, tmp_path):
    draw = random.Random(3)
    t = Stored(spark, str(tmp_path))
    t.check()
    for batch in range(5):
        keys = draw.sample(range(12), 5)
        if batch == 2:
            t.append([(f"k{k}", f"only b {batch}") for k in keys], "k string, b string")
        elif batch == 3:
            t.append([(f"k{k}", None, None, batch / 2) for k in keys], f"{DECLARED}, extra double")
        else:
            t.append([(f"k{k}", batch, draw.choice([None, "x"])) for k in keys])
        t.check()
    t.append([])
    before = dict(t.meta["base"])
    due = sorted({b for d in t.meta["deltas"] for b in d["rows"]})[:1]
    t.compact(due)
    t.check()
    assert all(t.meta["base"][b] == before[b] for b in before if b not in due), "other buckets stay where they are"
    t.compact([str(b) for b in range(4)])
    t.check()
    assert t.meta["deltas"] == []
    t.append([("k1", 77, "after")])
    t.check()


def test_a_batch_writes_what_it_brings(spark, tmp_path):
    t = Stored(spark, str(tmp_path), buckets=8)
    t.append([(f"k{i}", i, "x" * 50) for i in range(4000)])
    t.append([("k7", -1, "y")])

    def size(folder):
        return sum(p.stat().st_size for p in (tmp_path / folder).rglob("*.parquet"))

    folders = [t.meta["deltas"][0]["folder"], next(iter(t.meta["base"].values()))["folder"]]
    assert size(folders[0]) < size(folders[1]) / 10
    assert keyed.due(t.meta) == [], "one row in a bucket of hundreds"
    for _ in range(keyed.MAX_DELTAS - 1):
        t.append([("k7", -2, "y")])
    assert len(keyed.due(t.meta)) == 1
    t.compact(keyed.due(t.meta))
    t.check()
    assert len({v["folder"] for v in t.meta["base"].values()}) == 2


def test_a_few_keys_are_read_without_shuffling_the_table(spark, tmp_path):
    t = Stored(spark, str(tmp_path))
    t.append([(f"k{i}", i, "x") for i in range(100)])
    t.append([("k5", 500, "y"), ("k6", 600, "y")])
    few = spark.createDataFrame([("k5",), ("k90",), ("none",)], "k string")
    got = t.read(only=F.broadcast(few))
    assert sorted(tuple(r) for r in got.collect()) == [("k5", 500, "y"), ("k90", 90, "x")]


class Dies(Exception):
    pass


def feed_state(spark, root):
    batch = commits.last_batch(spark, root, "feed")
    if batch < 0:
        return batch, [], [], []
    return (
        batch,
        rows_of(tables.state(spark, root, "feed", batch)),
        rows_of(tables.whole_history(spark, root, batch)),
        rows_of(tables.observations(spark, root)),
    )


def test_a_run_that_dies_between_any_two_writes(spark, tmp_path, feed_frame, monkeypatch):
    """A reader sees all of the batch before, or all of this one. Repeating the run gives what an undisturbed one gives."""
    root = str(tmp_path)
    days = [feed_frame(*rows) for rows in random_batches(5, days=2, keys=5)]
    refresh.load_feed_batch(spark, root, 0, days[0])
    before = feed_state(spark, root)
    write, commit = commits.write_folder, commits.commit
    writes = 0

    def dying_after(n):
        def guarded(call):
            def run(*args):
                nonlocal writes
                if writes >= n:
                    raise Dies
                result = call(*args)
                writes += 1
                return result

            return run

        monkeypatch.setattr(commits, "write_folder", guarded(write))
        monkeypatch.setattr(commits, "commit", guarded(commit))

    done = False
    for n in range(20):
        writes = 0
        dying_after(n)
        try:
            refresh.load_feed_batch(spark, root, 1, days[1])
            done = True
        except Dies:
            assert feed_state(spark, root) == before
        if done:
            break
    assert done and n >= 4, "state, open and closed versions, observations, commit"
    everything = feed_frame(*sum(random_batches(5, days=2, keys=5), []))
    batch, feed, versions, observed = feed_state(spark, root)
    assert batch == 1
    assert feed == rows_of(upsert.last_per_key(everything, ["source_record_id"], ["ingested_at"]))
    assert versions == rows_of(history.history_from_batches(everything))
    assert observed == rows_of(history.observe(everything))


def test_a_draft_is_no_commit(spark, tmp_path):
    root = str(tmp_path)
    commits.commit(spark, root, "feed", 0, {"a": 1})
    (tmp_path / commits.FOLDER / "feed" / ".draft-x").write_text('{"a": ')
    assert commits.last_batch(spark, root, "feed") == 0 and commits.latest(spark, root, "feed") == {"a": 1}
    commits.commit(spark, root, "feed", 0, {"a": 2})
    assert commits.read(spark, root, "feed", 0) == {"a": 2} and commits.last_batch(spark, root, "none") == -1


def test_expired_folders_are_those_that_nobody_reads(spark, tmp_path, feed_frame):
    root = str(tmp_path)
    days = random_batches(6, days=3, keys=4)
    for batch, rows in enumerate(days):
        refresh.load_feed_batch(spark, root, batch, feed_frame(*rows))
    # A run of an earlier batch that died, and one of the next batch under way.
    for batch in (1, 3):
        commits.write_folder(feed_frame(*days[0]), root, "feed", batch)
    before = feed_state(spark, root)
    deleted = tables.expire(spark, root, "feed", keep=1)
    assert deleted and not any("batch=3/" in folder for folder in deleted)
    assert any(folder.startswith("feed/batch=1/") for folder in deleted)
    assert feed_state(spark, root) == before
    assert tables.expire(spark, root, "feed", keep=1) == []
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        tables.state(spark, root, "feed", 0)


def test_marts_are_published_together(spark, tmp_path, feed_frame, sources, curated, zips, clock, monkeypatch):
    root = str(tmp_path)
    inputs = refresh.Inputs(sources.replace("api", "website", ["channel_type"]), curated, zips)
    refresh.refresh(spark, root, 0, feed_frame(feed_row("1", "2026-07-18 12:00:00")), inputs, clock)
    first = rows_of(refresh.mart(spark, root, "candidates"))
    refresh.load_feed_batch(spark, root, 1, feed_frame(feed_row("2", "2026-07-19 12:00:00")))
    write = commits.write_folder

    def fails(df, root, name, *rest):
        if name == "reliability":
            raise Dies
        return write(df, root, name, *rest)

    monkeypatch.setattr(commits, "write_folder", fails)
    with pytest.raises(Dies):
        refresh.build_marts(spark, root, 1, inputs, clock)
    assert rows_of(refresh.mart(spark, root, "candidates")) == first
    monkeypatch.setattr(commits, "write_folder", write)
    refresh.build_marts(spark, root, 1, inputs, clock)
    assert "parks-2" in {r["event_id"] for r in refresh.mart(spark, root, "candidates").collect()}
    assert rows_of(refresh.mart(spark, root, "candidates", 0)) == first


def test_a_stream_of_pages_equals_batches(spark, tmp_path):
    """A page that is delivered twice changes nothing, and every micro-batch counts what a batch of its pages counts."""
    record = {"title": "Class", "startdate": "2026-07-25T00:00:00.000", "starttime": "2026-07-20 18:30:00"}
    pages = [
        [{**record, "guid": "a"}, {**record, "guid": "b", "starttime": "2026-07-20 29:99:00"}, {**record, "guid": 0}],
        [{**record, "guid": "a", "title": "Class, moved"}, {**record, "guid": "c", "startdate": "soon"}],
        {"no": "list"},
    ]
    landed, root, plain = tmp_path / "landed", str(tmp_path / "stream"), str(tmp_path / "plain")
    landed.mkdir()
    captured = [CLOCK.now_utc(), F.lit("2026-07-21 16:00:00").cast("timestamp_ntz"), F.lit("2026-07-22 16:00:00").cast("timestamp_ntz")]
    for number, page in enumerate(pages):
        (landed / f"p{number}.json").write_text(json.dumps(page))
        alone = tmp_path / f"alone{number}"
        alone.mkdir()
        (alone / "p.json").write_text(json.dumps(page))
        stream = feed_stream.landed_pages(spark, str(landed))
        feed_stream.follow_pages(stream, root, str(tmp_path / "checkpoint"), captured[number]).awaitTermination()
        refresh.load_landed_batch(spark, plain, number, str(alone), captured[number])
        assert refresh.landed_counts(spark, root, number).collect() == refresh.landed_counts(spark, plain, number).collect()
        assert tables.batch_counts(spark, root, "feed", number) == tables.batch_counts(spark, plain, "feed", number)
    assert tables.batch_counts(spark, root, "feed", 0)["feed_rows"] == {"bad_starttime": 1, "bad_endtime": 0}
    assert [tuple(r) for r in refresh.landed_counts(spark, root, 0).collect()] == [(2, 0, 1, 0)]
    assert [tuple(r) for r in refresh.landed_counts(spark, root, 2).collect()] == [(0, 0, 0, 1)]
    assert feed_state(spark, root) == feed_state(spark, plain)
    # The last batch delivered again, as after a failure before the stream noted it.
    refresh.load_pages(spark, root, 1, feed_pages(spark, landed / "p1.json"), captured[1])
    assert rows_of(tables.whole_history(spark, root, 1)) == rows_of(tables.whole_history(spark, plain, 1))


def feed_pages(spark, path):
    from outpulse.sources import landed

    return landed.pages(spark, str(path))


def test_loads_read_their_own_folder_and_not_the_events(spark, monkeypatch):
    taken = []
    monkeypatch.setattr(refresh, "load_feed_batch", lambda spark, root, batch, rows: taken.append(rows))
    _, last = registry._stored_feed(spark, "/root/testdata/sf0.001")
    assert len(taken) == last + 1
    assert all(f"/landed/load={batch}/" in path for batch, rows in enumerate(taken) for path in rows.inputFiles())
    batches = adapters.feed_batches(spark, "/root/testdata/sf0.001")
    together = functools.reduce(lambda a, b: a.union(b), taken)
    assert together.columns == batches.columns and together.exceptAll(batches).count() == 0 and batches.exceptAll(together).count() == 0
