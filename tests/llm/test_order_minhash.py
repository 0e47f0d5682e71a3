"""Order MinHash against a plain version with the same hash function."""

import random
import re

import xxhash

from outpulse.llm import order_minhash
from outpulse.llm.order_minhash import SIGNATURES

SCHEMA = "doc_id bigint, text string, n_chars int, units string, whole string, place int"
MASK = (1 << 28) - 1


def spark_hash(*values):
    seed = 42
    for value in values:
        raw = value.encode() if isinstance(value, str) else value.to_bytes(4 if isinstance(value, Int) else 8, "little", signed=True)
        seed = xxhash.xxh64_intdigest(raw, seed=seed)
    return seed - (1 << 64) if seed >> 63 else seed


class Int(int):
    pass


def plain(text):
    units = re.findall("[^\x20\x09-\x0d⺀-\U0010ffff]{1,32}|[⺀-\U0010ffff]", text or "")
    kmers = [spark_hash(*units[i : i + 2]) for i in range(len(units))]
    seen, ring = {}, []
    for place, kmer in enumerate(kmers):
        short = kmer >> 28
        number = seen[short] = seen.get(short, -1) + 1
        ring.append((spark_hash(short, Int(number)) & ~MASK) | place)
    ring.sort()
    out = []
    for signature in range(SIGNATURES):
        offset = (signature - SIGNATURES // 2) << 58
        if not ring:
            out.append(0)
            continue
        at = next((i for i, v in enumerate(ring) if v >= offset), 0)
        places = sorted((ring[at] & MASK, ring[(at + 1) % len(ring)] & MASK))
        out.append(spark_hash(*(kmers[p] for p in places)) & 0xFFFFFFFE | 1)
    return "".join(f"{v:08x}" for v in out)


def alike(a, b):
    return sum(a[i : i + 8] == b[i : i + 8] for i in range(0, 8 * SIGNATURES, 8)) / SIGNATURES


def random_text(draw, n):
    words = ["a", "the", "né", "漢字漢", "x" * 70, "😀", "end.", " "] + [f"w{i}" for i in range(30)]
    return "".join(draw.choice(words) + draw.choice([" ", "\n", "  ", "\t"]) for _ in range(n))


def rows_of(seed):
    draw = random.Random(seed)
    texts = [random_text(draw, draw.choice([0, 1, 2, 3, 8, 60, 300])) for _ in range(60)]
    texts += ["", None, "  \n", "one", "two words", "a " * 5000, "漢" * 300, "𝒳" * 99, "x" * 5001]
    rows = [(3 * i - 40, t, 0, "x", "y", 1) for i, t in enumerate(texts)]
    return rows + rows[10:14] + [(None, "of no id", 0, "x", "y", 1), (None, None, 0, "x", "y", 1)]


def test_equals_the_plain_version(as_table, monkeypatch):
    monkeypatch.setattr(order_minhash, "BUCKET", 8)
    rows = rows_of(1)
    got = order_minhash.fingerprints(as_table(rows, SCHEMA)).select("doc.doc_id", "doc.text", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next").collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted(((r[0], r[1]) for r in rows), key=str)
    by_id = {}
    for doc_id, text, *_ in rows:
        by_id.setdefault(doc_id, []).append(text or "")
    ids = sorted(by_id, key=lambda i: (i is None, -(i or 0)))
    after = dict(zip(ids, ids[1:] + ids[:1]))
    for r in got:
        text = r.text or ""
        half = len(text) // 2
        assert r.n_chars == len(text) and r.fingerprint == plain(text) and r.edited_fingerprint == plain(r.edited)
        # Rows with equal ids follow each other in some order.
        following = by_id[after[r.doc_id]] + (by_id[r.doc_id] if len(by_id[r.doc_id]) > 1 else [])
        assert any(r.edited == text[: len(text) - half] + t[:half] and r.near_next == alike(plain(text), plain(t)) for t in following)
        assert r.near_edited == alike(plain(text), plain(r.edited))


def test_every_document_has_one_next(as_table, monkeypatch):
    monkeypatch.setattr(order_minhash, "BUCKET", 4)
    for n in (1, 4, 5, 9):
        rows = [(i % 3, f"text {i}", 0, "x", "y", 1) for i in range(n)]
        got = order_minhash.with_next(as_table(rows, SCHEMA, f"t{n}"), "doc_id", lambda d: d.withColumn("whole", d["doc.text"]), ["whole"]).collect()
        follow = {r.whole: r.next_whole for r in got}
        assert len(got) == n and sorted(follow.values()) == sorted(t for _, t, *_ in rows)
        at, met = "text 0", set()
        while at not in met:
            met.add(at)
            at = follow[at]
        assert len(met) == n, "one circle through all"


def test_no_documents(as_table):
    assert order_minhash.fingerprints(as_table([], SCHEMA)).count() == 0


def test_likeness_follows_edits_and_order(spark):
    draw = random.Random(5)
    words = [f"w{draw.randrange(5000)}" for _ in range(800)]
    few = list(words)
    for at in range(0, 800, 100):
        few[at] = "changed"
    blocks = [words[i : i + 4] for i in range(0, 800, 4)]
    draw.shuffle(blocks)
    texts = {"same": words, "few": few, "half": words[:400] + [f"v{i}" for i in range(400)], "moved": sum(blocks, []), "other": [f"u{i}" for i in range(800)]}
    df = spark.createDataFrame([(k, " ".join(v)) for k, v in texts.items()], "name string, t string")
    prints = {r.name: r.f for r in order_minhash.fingerprinted(df, "t", "f").collect()}
    like = {k: sum(a == b for a, b in zip(prints["same"], f)) / SIGNATURES for k, f in prints.items()}
    assert like["same"] == 1 and like["other"] == 0
    assert like["few"] > 0.8 > 0.45 > like["half"] > 0
    # The multiset of words is the same, and most pairs of words are, but not their order.
    assert like["moved"] < 0.6 * like["few"]


def test_halves_and_wrap(as_table):
    """The next of the last document is the first; half of one character is none."""
    rows = [(2, "abcdé", 0, "x", "y", 1), (1, "Z", 0, "x", "y", 1)]
    got = {r.doc.doc_id: r.edited for r in order_minhash.fingerprints(as_table(rows, SCHEMA)).collect()}
    assert got == {2: "abcZ", 1: "Z"}
