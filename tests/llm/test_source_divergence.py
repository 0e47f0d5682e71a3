"""Divergence of sources against a plain version with exact integers."""

import collections
import random
import re

import pyarrow as pa
import pytest

from outpulse.llm import source_divergence

SCHEMA = "lang string, source string, text string, term string, p int"


def plain(rows, min_docs, top):
    terms = collections.defaultdict(collections.Counter)
    docs = collections.defaultdict(collections.Counter)
    for lang, source, text, *_ in rows:
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        found = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", lower)
        terms[lang or "", source or ""].update(found)
        docs[lang or ""].update(set(found))
    out = set()
    for lang in docs:
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        sources = [s for g, s in terms if g == lang]
        counts = {s: terms[lang, s] for s in sources}
        whole = sum(counts.values(), collections.Counter())

        def p(count, term):
            return 1 + 10**9 * (count[term] + 5) // (sum(count[t] for t in kept) + 5 * len(kept))

        for s in sources:
            pairs = [(sum(abs(p(counts[s], t) - p(counts[o], t)) for t in kept), o) for o in sources if o != s]
            above = [(p(counts[s], t) - p(whole, t), t) for t in kept if counts[s][t]]
            for part, values in (("pair", pairs), ("term", [v for v in above if v[0] > 0])):
                ranked = sorted(values, key=lambda v: (-v[0], v[1].encode()))
                out |= {(lang, s, part, item, f, i) for i, (f, item) in enumerate(ranked[: None if part == "pair" else top], 1)}
    return out


def rows_of(seed, n):
    draw = random.Random(seed)
    words = ["the", "The", "É", "é", "ßx", "run", "a1b", "x\x00y", "漢字", "n'est"] + [f"w{c}" for c in "abcdefgh"]
    rows = []
    for _ in range(n):
        text = draw.choice([" ", "-", "\n"]).join(draw.choices(words, k=draw.choice([0, 1, 5, 40])))
        source = draw.choice(["hot", "hot", "a", "b", "B", "ü", "", None, *"cdefgh"])
        rows.append((draw.choice(["en", "en", "de", None, ""]), source, draw.choice([text, text, text, None]), "x", 1))
    return rows + rows[:20] + [("en", "long", "the run " * 60_000, "x", 1), ("xx", "alone", "only", "x", 1), ("xx", "mute", None, "x", 1)]


@pytest.mark.parametrize("blocks", [(128, 32_768, 256, 200_000), (2, 10, 3, 15)])
def test_equals_the_plain_version(as_table, monkeypatch, blocks):
    for name, value in zip(("BLOCK_SOURCES", "SHARD_COUNTS", "TERMS_AT_ONCE", "HELD_COUNTS"), blocks):
        monkeypatch.setattr(source_divergence, name, value)
    rows = rows_of(blocks[0], 300)
    got = [tuple(r) for r in source_divergence.audit(as_table(rows, SCHEMA), 12, 4).collect()]
    assert len(got) == len(set(got))
    assert set(got) == plain(rows, 12, 4)


def test_no_documents(as_table):
    assert source_divergence.audit(as_table([], SCHEMA)).count() == 0


def test_small_batches_are_added_up():
    """What the workers hold is handed on in parts, and no part is lost."""
    import pyarrow as pa

    rows = rows_of(3, 60)
    batches = [
        pa.record_batch({k: pa.array([r[i] for r in rows[at : at + 7]], pa.string()) for i, k in enumerate(("lang", "source", "text"))})
        for at in range(0, len(rows), 7)
    ]
    whole = collections.Counter()
    for held in (10**6, 1):
        source_divergence.HELD_COUNTS, before = held, source_divergence.HELD_COUNTS
        try:
            found = collections.Counter()
            for part in source_divergence._partial_counts(iter(batches)):
                for lang, source, term, n, docs in zip(*(part[c].to_pylist() for c in part.schema.names)):
                    found[lang, source, term] += n + 1000 * docs
        finally:
            source_divergence.HELD_COUNTS = before
        whole = whole or found
        assert found == whole


def test_small_batches_are_counted_together(monkeypatch):
    counted, count = [], source_divergence.batch_counts
    monkeypatch.setattr(source_divergence, "batch_counts", lambda batch: counted.append(batch.num_rows) or count(batch))
    rows = [("en", "a", "one two two"), ("de", "b", None), (None, "a", "Drei")]
    small = [pa.RecordBatch.from_pylist([dict(zip(("lang", "source", "text"), row))], pa.schema([(n, pa.string()) for n in ("lang", "source", "text")])) for row in rows * 20]
    found = {tuple(r[n] for n in ("lang", "source", "term")): (r["n"], r["docs"]) for b in source_divergence._partial_counts(iter(small)) for r in b.to_pylist()}
    assert counted == [60]
    assert found == {("en", "a", "one"): (20, 20), ("en", "a", "two"): (40, 20), ("en", "a", ""): (0, 20), ("de", "b", ""): (0, 20), ("", "a", "drei"): (20, 20), ("", "a", ""): (0, 20)}
