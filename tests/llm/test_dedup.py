"""Suffix and near-duplicate removal against brute force."""

import collections
import hashlib
import itertools
import random

import numpy as np
import pytest

from outpulse.llm import near_dedup, suffix_dedup
from outpulse.llm.common import numbered


def plain_repeats(texts, size):
    counted = collections.Counter(t[i : i + size] for t in texts for i in range(len(t) - size + 1))
    return [np.array([counted[t[i : i + size]] > 1 for i in range(len(t) - size + 1)], bool) for t in texts]


@pytest.mark.parametrize("seed", range(60))
def test_extension_finds_the_repeated_windows(seed):
    draw = random.Random(seed)
    size, letters = draw.choice([3, 5, 8, 20]), draw.choice([b"ab", b"abc", bytes(range(256))])
    shared = bytes(draw.choice(letters) for _ in range(60))
    texts = []
    for _ in range(draw.randint(1, 6)):
        text = bytes(draw.choice(letters) for _ in range(draw.randint(0, 40)))
        at = draw.randint(0, 40)
        texts.append(text + shared[at : at + draw.randint(0, 30)] + text[:5])
    for got, want in zip(suffix_dedup.repeated_windows(texts, size), plain_repeats(texts, size)):
        assert (got == want).all()


def test_each_window_is_in_one_piece_with_a_telling_anchor():
    draw = random.Random(4)
    texts = [bytes(draw.choice(b"abc") for _ in range(draw.randint(0, 3000))) for _ in range(20)] + [b"a" * 5000, b"", b"ab" * 150_000]
    texts.append(texts[3])
    anchor_of, covered = {}, [np.zeros(max(0, len(t) - 199), int) for t in texts]
    for which, start, count, anchor, _ in suffix_dedup.pieces_of(texts):
        for w, s, n, a in zip(which, start, count, anchor):
            covered[w][s : s + n] += 1
            for i in range(s, s + n):
                window = texts[w][i : i + 200]
                assert anchor_of.setdefault(window, a) == a
    assert all((c == 1).all() for c in covered)


def plain_removed(texts, size):
    for text, flags in zip(texts, plain_repeats(texts, size)):
        hit = np.zeros(len(text), bool)
        for i in np.flatnonzero(flags):
            hit[i : i + size] = True
        kept = bytes(np.frombuffer(text, np.uint8)[~hit])
        yield len(text), int(hit.sum()), len(suffix_dedup.runs_of(hit)) // 2, hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("hot", [suffix_dedup.HOT_PIECES, 2])
def test_dedup_equals_the_definition(as_table, hot):
    draw = random.Random(9)
    prose = lambda n: "".join(draw.choice("abcdé fg\n") for _ in range(n))
    passage, line = prose(400), prose(120)
    texts = [prose(draw.randint(0, 900)) for _ in range(30)]
    texts += [prose(50) + passage[:300] + prose(50), passage, prose(300) + passage[100:], "z" * 3000, "z" * 250, None, "", "x", "ab" * 700]
    texts += [prose(90) + line + prose(90) for _ in range(20)] + [texts[3]] * 4
    rows = [(None if i % 7 == 0 else i, t, "clash") for i, t in enumerate(texts)]
    docs = as_table(rows, "doc_id bigint, text string, kept_text string")
    got = suffix_dedup.dedup(docs, hot=hot).select("n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(plain_removed([(t or "").encode() for t in texts], 200))


def splits_change(monkeypatch, spark, module):
    """From now on the files are split otherwise for each written table, as when executors come and go."""
    setting, written = "spark.sql.files.maxPartitionBytes", module.written
    before, sizes = spark.conf.get(setting), itertools.cycle(["2k", "700"])

    def split_anew(df, name):
        result = written(df, name)
        spark.conf.set(setting, next(sizes))
        return result

    monkeypatch.setattr(module, "written", split_anew)
    return lambda: spark.conf.set(setting, before)


def test_dedup_when_splits_change_between_jobs(spark, as_table, monkeypatch):
    draw = random.Random(10)
    prose = lambda n: "".join(draw.choice("abcdefg ") for _ in range(n))
    passage = prose(300)
    texts = [prose(draw.randint(0, 900)) + (passage if i % 5 == 0 else "") + prose(60) for i in range(60)]
    docs = as_table(list(enumerate(texts)), "doc_id bigint, text string")
    restore = splits_change(monkeypatch, spark, suffix_dedup)
    try:
        got = suffix_dedup.dedup(docs).select("n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    finally:
        restore()
    assert sorted(map(tuple, got)) == sorted(plain_removed([t.encode() for t in texts], 200))


def test_groups_when_splits_change_between_jobs(spark, as_table, monkeypatch):
    draw = random.Random(11)
    texts = [" ".join(f"w{draw.randint(0, 3000)}" for _ in range(80)) for _ in range(40)]
    rows = list(enumerate(texts + [t + " almost" for t in texts[::2]]))
    docs = as_table(rows, "doc_id bigint, text string")
    restore = splits_change(monkeypatch, spark, near_dedup)
    try:
        got = near_dedup.near_duplicates(docs, words=3, percent=85).collect()
    finally:
        restore()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == plain_groups(rows, 3, 85)


def test_row_numbers_of_paths_with_special_characters(spark, tmp_path):
    path = str(tmp_path / "a b%20é+x")
    spark.range(100).repartition(3).write.parquet(path)
    rows = numbered(spark.read.parquet(path)).collect()
    assert len({r.row_no for r in rows}) == len({r.id for r in rows}) == 100


def test_pieces_that_all_have_copies_are_not_searched(as_table, monkeypatch):
    draw = random.Random(3)
    copied, single = ("".join(draw.choice("abcdefgh") for _ in range(3000)) for _ in range(2))
    kept, write = {}, suffix_dedup.written
    monkeypatch.setattr(suffix_dedup, "written", lambda df, name: kept.setdefault(name, write(df, name)))
    texts = [copied, single, copied, copied]
    rows = suffix_dedup.dedup(as_table(list(enumerate(texts)), "doc_id bigint, text string")).select("doc.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    want = list(plain_removed([t.encode() for t in texts], 200))
    assert [tuple(r)[1:] for r in sorted(rows)] == want
    assert kept["distinct-pieces"].count() > 0 and kept["searched-pieces"].count() == 0


def test_dedup_of_nothing(as_table):
    assert suffix_dedup.dedup(as_table([], "doc_id bigint, text string")).count() == 0


def test_characters_stay_whole():
    text = "aé" * 10
    raw = text.encode()
    for a, b in itertools.combinations(range(len(raw) + 1), 2):
        suffix_dedup.kept_bytes(raw, suffix_dedup.whole_characters(raw, [(a, b)])).decode()


def plain_groups(rows, words, percent):
    def shingles(text):
        parts = (text or "").encode().lower().split()
        return frozenset(tuple(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))) if parts else frozenset()

    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))
    for a, b in itertools.combinations(range(len(rows)), 2):
        common = len(sets[a] & sets[b])
        if common and 100 * common >= percent * len(sets[a] | sets[b]):
            old, new = group[b], group[a]
            group = [new if g == old else g for g in group]
    least = {g: min((rows[i][0] for i in range(len(rows)) if group[i] == g and rows[i][0] is not None), default=None) for g in group}
    return sorted(((rows[i][0], len(sets[i]), least[group[i]]) for i in range(len(rows))), key=str)


@pytest.mark.parametrize("region,block", [(near_dedup.REGION, near_dedup.BLOCK), (2, 7)])
@pytest.mark.parametrize("words,percent", [(3, 85), (5, 80)])
def test_groups_equal_the_definition(as_table, monkeypatch, words, percent, region, block):
    monkeypatch.setattr(near_dedup, "REGION", region)
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    draw = random.Random(words)
    base = [[f"w{draw.randint(0, 3000)}" for _ in range(120)] for _ in range(6)]
    rows = []
    for i in range(120):
        parts = list(draw.choice(base))
        for _ in range(draw.randint(0, 6)):
            parts[draw.randrange(len(parts))] = f"n{draw.randint(0, 9)}"
        rows.append((i, " ".join(parts).replace("w1", "W1") if i % 3 else "\n".join(parts)))
    rows += [(500, None), (501, ""), (502, " \n"), (503, "one two"), (504, "ONE  two"), (505, "one"), (None, rows[0][1]), (506, rows[5][1]), (506, rows[5][1])]
    docs = as_table([(d, t, 1) for d, t in rows], "doc_id bigint, text string, component_id int")
    got = near_dedup.near_duplicates(docs, words=words, percent=percent).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == plain_groups(rows, words, percent)
    kept = near_dedup.grouped(numbered(docs), words=words, percent=percent).filter("keeper = row_no")
    assert kept.count() == len({g for *_, g in plain_groups(rows, words, percent)})


def test_blocks_find_links_of_a_text_that_stands_apart(as_table):
    words = [f"w{i}" for i in range(100)]
    chain = [" ".join(words[:100] + [f"x{k}" for k in range(3 * i)]) for i in range(12)] + ["other " + " ".join(words[50:90])]
    texts = as_table(list(enumerate(chain)), "row_no bigint, text string")
    regions = as_table([(i, 7, 100) for i in range(13)], "node bigint, p0 bigint, n0 bigint", "r")
    roots = as_table([(i, 0) for i in range(1, 6)], "node bigint, root bigint", "o")
    links = near_dedup._dense_links(regions, roots, texts, 3, 85)
    all_links = links.union(as_table([(i, 0) for i in range(1, 6)], "a bigint, b bigint", "k"))
    got = {r.node: r.root for r in near_dedup.components(all_links).collect()}
    want = {d: c for d, _, c in plain_groups(list(enumerate(chain)), 3, 85)}
    assert all(got.get(d, d) == c for d, c in want.items()) and want[11] == 0 and want[12] == 12


def test_a_dense_region_of_one_group_is_not_parted(as_table, monkeypatch):
    words = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join([*words, f"end{i}"])) for i in range(150)]
    sized = []
    write = near_dedup.written
    monkeypatch.setattr(near_dedup, "written", lambda df, name: sized.append(name) or write(df, name))
    found = near_dedup.near_duplicates(as_table(rows, "doc_id long, text string")).collect()
    assert {r.component_id for r in found} == {0}
    # Regions of the shortest prefix only.
    assert sized.count("region-sizes") == 1


def test_no_texts(as_table):
    assert near_dedup.near_duplicates(as_table([], "doc_id bigint, text string")).count() == 0


def test_components_of_a_long_chain(spark):
    links = spark.range(60).selectExpr("id as a", "id + 1 as b").union(spark.createDataFrame([(100, 99), (99, 98), (5, 5)], "a long, b long"))
    got = {r.node: r.root for r in near_dedup.components(links).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 99: 98, 100: 98}
