"""Archives, URL verdicts, token counts and packing."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from outpulse.llm import packing, token_counts, url_filter, warc
from outpulse.llm.queries import URL_RULES, vocabulary

PAGES = "page_id bigint, url string, html string, digest string"


def test_archives_round_trip(spark, as_table, tmp_path):
    big = "".join(map(chr, range(32, 127))) * 200_000  # beyond 16 MiB
    rows = [(1, "http://a", "same", "x"), (5, None, "same", "x"), (3, "http://b\r\nEvil: 1", "same", "x"), (2, "u", "other\0é", "x")]
    rows += [(7, "u", None, "x"), (8, "u", "", "x"), (None, "u", "same", "x"), (9, "u", "twice", "x"), (9, "u", "twice", "x"), (10, "u", big, "x")]
    pages = as_table(rows, PAGES)
    warc.write_archives(pages, str(tmp_path / "warc"))
    got = warc.read_archives(spark, str(tmp_path / "warc")).collect()
    assert len(got) == len(rows) and all(r.problem is None for r in got)
    sha = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    heads = {"same": 5, "": 8}
    want = []
    for page, _, html, _ in rows:
        head = heads.get(html or "")
        revisits = head is not None and page != head
        want.append((page, len((html or "").encode()), sha(html), "revisit" if revisits else "response", head if revisits else None))
    key = lambda r: (str(r[0]), r[1])
    assert sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got], key=key) == sorted(want, key=key)
    assert next(bytes(r.payload) for r in got if r.page_id == 10) == big.encode()


def test_no_pages(spark, as_table):
    assert warc.round_trip(spark, as_table([], PAGES)).count() == 0


def test_small_payloads_are_all_responses(spark, as_table):
    got = warc.round_trip(spark, as_table([(1, "u", "ab", "x"), (2, "u", "ab", "x")], PAGES), min_bytes=3).collect()
    assert {r.record_type for r in got} == {"response"}


def test_broken_records_are_named():
    good = zlib.compress(warc.record(1, "u", b"text", False, None), wbits=31)
    wrong = zlib.compress(warc.record(2, "u", b"text", False, None).replace(b"text", b"texd"), wbits=31)
    short = zlib.compress(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc\r\n\r\n", wbits=31)
    rows = list(warc.read_file(good + wrong + zlib.compress(b"", wbits=31) + short + good + good[:-9]))
    assert [r["problem"] is None for r in rows] == [True, False, False, True, False]


def test_url_verdicts(as_table):
    urls = ["https://www.A.com/x/", "http://a.com/x.html?q=1", "a.com/x", None, "ftp://b.example.org/es/1", "x://example.org/en/12", "x://org", "x://z.com/fr/", "x://z.com/de/?p", "http://q.org/fr/", "x://", "http://A.com", "x://notcom/de/", "x://c.com/de/e://z"]
    rows = [(i, u, "keep", 1) for i, u in enumerate(urls)] + [(0, urls[0], "keep", 1)]
    pages = as_table(rows, "page_id bigint, url string, verdict string, h int")
    listed = as_table([("a.com/x",), ("a.com/x",), (None,)], "canonical_url string", "l")
    for blocks in (1, url_filter.MAX_BLOCKS):
        got = url_filter.judge_urls(pages, listed, URL_RULES, blocks=blocks).collect()
        assert len(got) == len(rows)
        by_id = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got}
        assert by_id == {
            0: ("www.a.com", "/x/", None, "block"), 1: ("a.com", "/x.html", None, "block"), 2: ("", "", None, "allow"), 3: ("", "", None, "allow"),
            4: ("b.example.org", "/es/1", "example.org/es/", "block"), 5: ("example.org", "/en/12", "example.org/en/1", "block"),
            6: ("org", "", None, "allow"), 7: ("z.com", "/fr/", "com/fr/", "allow"), 8: ("z.com", "/de/", "com/de/", "block"),
            9: ("q.org", "/fr/", "org/", "allow"), 10: ("", "", None, "allow"), 11: ("a.com", "", None, "allow"),
            12: ("notcom", "/de/", None, "allow"), 13: ("c.com", "/de/e://z", "com/de/", "block"),
        }
    none = as_table([], "canonical_url string", "n")
    assert url_filter.judge_urls(pages, none, URL_RULES).filter("verdict = 'block'").count() == 4


@pytest.mark.parametrize("seed", range(150))
def test_edited_counts_equal_a_full_count(seed, monkeypatch):
    monkeypatch.setattr(token_counts, "LEAF", 3)
    counter = token_counts.Counter(*vocabulary())
    draw = random.Random(seed)
    letters = draw.choice(["ab 1", "a  \n'st", "ab é!?\n\t 12"])
    some = lambda n: "".join(draw.choice(letters) for _ in range(draw.randint(0, n)))
    text = some(60)
    chars, tokens = counter.build(text)
    assert sum(chars) == len(text) and sum(tokens) == counter.count(text)
    cuts = sorted(draw.randint(0, len(text)) for _ in range(2 * draw.randint(0, 4)))
    edits = [(a, b, some(6)) for a, b in zip(cuts[::2], cuts[1::2])]
    want, at = "", 0
    for a, b, put in edits:
        want, at = want + text[at:a] + put, b
    want += text[at:]
    after, chars, tokens, _ = counter.edit(text, chars, tokens, edits)
    assert after == want and sum(chars) == len(want) and sum(tokens) == counter.count(want)


def test_edit_encodes_its_surroundings_only(as_table):
    text = "word " * 20_000 + "me@mail.example.org" + " more" * 20_000
    rows = [(1, text), (2, None), (3, ""), (3, "no edit")]
    trees = token_counts.build_trees(as_table(rows, "doc_id bigint, text string"), *vocabulary())
    edits = F.arrow_udf(token_counts.redactions, token_counts.EDITS_DDL)
    got = token_counts.apply_edits(trees.withColumn("edits", edits("text")), *vocabulary()).collect()
    counter = token_counts.Counter(*vocabulary())
    assert len(got) == 4 and all(r.tokens_after == counter.count(r.text) for r in got)
    one = next(r for r in got if r.doc_id == 1)
    assert one.text == text.replace("me@mail.example.org", "<mail>") and one.n_edits == 1 and one.chars_encoded < 2000


def test_tree_finds_the_leaf():
    tree = token_counts.Tree([3, 1, 4, 2, 5], [1] * 5)
    want = [0] * 3 + [1] + [2] * 4 + [3] * 2 + [4] * 5 + [4]
    assert [tree.find(i)[0] for i in range(16)] == want and int(tree.tokens[1]) == 5


def test_packing_of_whole_documents(as_table):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    draw = random.Random(6)
    texts = [" ".join(draw.choice(["tea", "Über", "'s", "12", "\n", "x<|endoftext|>y"]) for _ in range(draw.randint(0, 500))) for _ in range(80)]
    texts += [None, "", "long " * 5000, "a" * 3000, texts[0], texts[0]]
    rows = [(i, t, 1) for i, t in enumerate(texts[:-1])] + [(0, texts[0], 1)]
    docs = as_table(rows, "doc_id bigint, text string, sequence_id int")
    got = packing.pack(docs, *vocabulary()).toPandas()
    ids = {i: tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for i, t, _ in rows}
    for doc_id, pieces in got.groupby("doc_id"):
        own, copies = ids[doc_id], 2 if doc_id == 0 else 1
        assert pieces.length.sum() == copies * len(own)
        for p in pieces.itertuples():
            assert p.ids_crc32 == zlib.crc32(np.array(own[p.start : p.start + p.length], "<u4").tobytes())
        assert len(pieces) == copies * -(-len(own) // 1024)
    filled = got.sort_values(["sequence_id", "offset"])
    assert ((filled.groupby("sequence_id").length.cumsum() - filled.length) == filled.offset).all()
    assert filled.groupby("sequence_id").length.sum().max() <= 1024
    assert packing.pack(as_table([], "doc_id bigint, text string", "e"), *vocabulary()).count() == 0


def test_best_fit_takes_the_fullest_and_closes_it_first():
    bins = packing.BestFit(10, 2)
    assert [bins.place(n) for n in (6, 7, 3, 4)] == [(0, 0), (1, 0), (1, 7), (0, 6)]
    bins = packing.BestFit(10, 2)
    # Two are open; the third closes the one with seven, so three go to the one with six.
    assert [bins.place(n) for n in (6, 7, 5, 3)] == [(0, 0), (1, 0), (2, 0), (0, 6)]
