"""Quality rules, benchmark passages, languages and perplexity against plain definitions."""

import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from outpulse.llm import decontaminate, language_id, perplexity, quality_rules
from outpulse.llm.common import numbered

DOCS = "doc_id bigint, text string, source string, n_words string, kept int"


def plain_measures(text):
    words = re.findall("[^\x20\x09-\x0d]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counted = collections.Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if counted[w] > 1 for k in range(3)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            again += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), again, len(covered)


def test_measures_equal_the_definition():
    draw = random.Random(1)
    for _ in range(500):
        text = "".join(draw.choice("ab é#\n\t\x1c\u00a0") for _ in range(draw.randint(0, 80)))
        assert quality_rules.measure(text.encode()) == plain_measures(text)


def test_host_verdicts(as_table):
    good = " ".join(f"w{i}" for i in range(60))
    rows = [(i, good, "fine", "x", 1) for i in range(30)] + [(100 + i, "short", "bad", "x", 1) for i in range(200)]
    rows += [(500, good, "bad", "x", 1), (501, good, None, "x", 1), (None, None, "fine", "x", 1), (502, "", "fine", "x", 1)]
    rows += [(503, good, "other", "x", 1)] * 2
    got = quality_rules.judge(as_table(rows, DOCS)).select("doc.doc_id", "doc.n_words", "base_failed", "host_rejected", "kept").collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    assert by_id[0].kept and by_id[501].kept and by_id[503].kept
    assert by_id[500].host_rejected and not by_id[500].kept and not by_id[500].base_failed
    assert by_id[None].base_failed and by_id[502].base_failed and not by_id[502].host_rejected


def test_hosts_with_equal_rates(as_table):
    rows = [(i, "short", f"h{i % 3}", "x", 1) for i in range(6)]
    assert quality_rules.judge(as_table(rows, DOCS)).filter("kept").count() == 0


def test_no_documents(as_table):
    empty = as_table([], DOCS)
    assert quality_rules.judge(empty).count() == 0
    assert decontaminate.scanned(empty, as_table([], "item_id bigint, text string", "b")).count() == 0


def plain_words(text):
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", folded)


def plain_hits(docs, items, size):
    owners = collections.defaultdict(set)
    for item, text in items:
        words = plain_words(text)
        for i in range(max(1, len(words) - size + 1) if words else 0):
            owners[tuple(words[i : i + size])].add(item)
    for doc_id, text in docs:
        words, hit, found = plain_words(text), set(), set()
        for window, ids in owners.items():
            for i in range(len(words) - len(window) + 1):
                if tuple(words[i : i + len(window)]) == window:
                    hit |= set(range(i, i + len(window)))
                    found |= ids
        yield doc_id, len(words), len(hit), sorted(x for x in found if x is not None)


@pytest.mark.parametrize("automaton_bytes", [1 << 19, 40])
def test_hits_equal_the_definition(as_table, automaton_bytes):
    draw = random.Random(5)
    word = lambda: draw.choice(["a", "B", "é", "9", "x-y", "a,b"])
    text = lambda n: draw.choice([" ", "\n", ", "]).join(word() for _ in range(draw.randint(0, n)))
    items = [(i, text(7)) for i in range(12)] + [(None, "nine a nine a"), (3, None), (4, "..."), (5, "nine")]
    docs = [(i, text(40)) for i in range(40)] + [(90, None), (91, "nine a nine a nine"), (91, "nine a nine a nine")]
    found = decontaminate.scanned(
        as_table([(d, t, 1) for d, t in docs], "doc_id bigint, text string, items int"),
        as_table([(i, t, "x") for i, t in items], "item_id bigint, text string, doc_id string", "b"),
        size=3,
        automaton_bytes=automaton_bytes,
    )
    got = [
        (r.doc_id, r.n_words, r.n_hit, r["items"], r.sha, r.runs)
        for r in found.select("doc.doc_id", "doc.text", "n_words", decontaminate.n_hit(F.col("runs")).alias("n_hit"), "items", decontaminate.items_digest(F.col("items")).alias("sha"), "runs").collect()
    ]
    want = list(plain_hits(docs, items, 3))
    assert sorted(r[:4] for r in map(tuple, [(a, b, c, list(d)) for a, b, c, d, _, _ in got])) == sorted((a, b, c, d) for a, b, c, d in want)
    for _, _, _, ids, sha, _ in got:
        assert sha == hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()


def test_spans_point_into_the_original_text():
    scanner = decontaminate.Scanner([(7, b"red fox runs")], 3)
    text = "É - Red,  FOX\nruns; red fox".encode()
    n, runs, items = scanner.scan(text)
    assert (n, items) == (6, [7]) and [text[a:b].decode() for *_, a, b in runs] == ["Red,  FOX\nruns"]


def test_gradients_are_those_of_the_loss():
    net = language_id.Network(["a", "b", "c"], hidden=3, embedded=2)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    codes, _ = language_id.padded([b"abc", b"de", b"cabd "])
    labels = np.array([0, 1, 2])
    _, grads = net.gradients(codes, labels)
    for name, w in net.w.items():
        flat = w.ravel()
        for i in np.random.default_rng(0).integers(0, flat.size, 5):
            at = flat[i]
            flat[i] = at + 1e-2
            up, _ = net.gradients(codes, labels)
            flat[i] = at - 1e-2
            down, _ = net.gradients(codes, labels)
            flat[i] = at
            assert abs((up - down) / 2e-2 - grads[name].ravel()[i]) < 2e-4


def test_languages_are_learned(as_table):
    draw = random.Random(2)
    text = lambda parts: " ".join("".join(draw.choice(parts) for _ in range(2)) for _ in range(60))
    parts = {"xa": ["the", "ing", "on"], "xb": ["über", "ich", "ß"]}
    rows = [(i, text(parts[lang]), lang) for i in range(60) for lang in parts]
    rows += [(900, None, "xa"), (901, " 12 ,.", "xa"), (902, "", None), (903, "q" * 50_000, None), (903, "q" * 50_000, None)]
    docs = as_table(rows, "doc_id bigint, text string, lang string")
    network = language_id.train(language_id.sample(docs, F.col("doc_id") < 40), epochs=1)
    got = language_id.identify(docs, network).select("doc.doc_id", "doc.lang", "lang_pred", "score").collect()
    held = [r for r in got if 40 <= r.doc_id < 60]
    assert all(r.lang_pred == r.lang for r in held)
    assert {r.doc_id for r in got if r.lang_pred == "und"} == {900, 901, 902}
    assert all(0 <= r.score <= 1 for r in got) and len(got) == len(rows)
    labels = dict(language_id.position_labels(network, "the ich".encode()))
    assert sorted(labels) == [0, 1, 2, 4, 5, 6]


def plain_model(texts):
    """Probability of a word after two others, by the definition of interpolated modified Kneser-Ney smoothing."""
    triples = collections.Counter()
    for text in texts:
        words = ["<s>", "<s>", *text.lower().split(), "</s>"]
        triples.update(zip(words, words[1:], words[2:]))
    pairs = collections.Counter(t[1:] for t in triples)
    levels = [(collections.Counter(p[1:] for p in pairs)), pairs, triples]
    off = []
    for level in levels:
        n = [sum(c == i for c in level.values()) for i in range(5)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else None
        usual = [i - (i + 1) * y * n[i + 1] / n[i] if y is not None and n[i] else 0.75 for i in (1, 2, 3)]
        off.append([min(i, max(perplexity.LEAST_DISCOUNT, d)) for i, d in enumerate(usual, 1)])

    def probability(gram):
        if not gram:
            return 1 / (len(levels[0]) + 1)
        level, d = levels[len(gram) - 1], off[len(gram) - 1]
        after = [c for g, c in level.items() if g[:-1] == gram[:-1]]
        if not after:
            return probability(gram[1:])
        taken = sum(d[min(c, 3) - 1] for c in after)
        own = level[gram] - d[min(level[gram], 3) - 1] if gram in level else 0
        return (own + taken * probability(gram[1:])) / sum(after)

    return probability, [w for (w,) in levels[0]]


@pytest.mark.parametrize("frequent", [perplexity.FREQUENT, 0, 25])
def test_perplexity_equals_the_definition(as_table, monkeypatch, frequent):
    monkeypatch.setattr(perplexity, "FREQUENT", frequent)
    draw = random.Random(8)
    prose = lambda n: " ".join(draw.choice("the cat sat on a mat and The dog ran far away".split()) for _ in range(n))
    texts = [(i % 2, prose(draw.randint(1, 25))) for i in range(24)]
    other = [(None, prose(12) + " unheard words here"), (None, "x"), (None, ""), (None, None), (None, " \n"), (None, prose(400))]
    docs = numbered(as_table(texts + other, "fold int, text string"))
    model, unknown = perplexity.fit(docs.filter("fold is not null").select("fold", "text"))
    got = {r.row_no: r.perplexity for r in perplexity.perplexities(docs, model, unknown).collect()}
    plain = [plain_model([t for f, t in texts if f != held])[0] for held in (0, 1, 2)]
    for row in docs.collect():
        words = ["<s>", "<s>", *(row.text or "").lower().split(), "</s>"]
        if len(words) == 3:
            assert got[row.row_no] is None
            continue
        probability = plain[2 if row.fold is None else row.fold]
        logs = [np.log2(probability(tuple(words[i - 2 : i + 1]))) for i in range(2, len(words))]
        assert got[row.row_no] == pytest.approx(2 ** -np.mean(logs), rel=1e-9)


@pytest.mark.parametrize("sent", [0, 6])
def test_perplexity_is_the_same_however_tokens_are_dealt(as_table, monkeypatch, sent):
    draw = random.Random(9)
    rare = [f"w{i}" for i in range(40)]
    prose = lambda n: " ".join(draw.choice(["the", "the", "cat", "sat", "日本", *rare]) for _ in range(n))
    texts = [(i % 3 if i % 3 < 2 else None, prose(draw.randint(1, 40))) for i in range(40)] + [(None, "the")]
    docs = numbered(as_table(texts, "fold int, text string"))
    found = []
    for shards, rounds, frequent in ((1, 1, 10_000), (7, 3, 20)):
        monkeypatch.setattr(perplexity, "LEAST_SHARDS", shards)
        monkeypatch.setattr(perplexity, "COUNT_ROUNDS", rounds)
        monkeypatch.setattr(perplexity, "SCORE_ROUNDS", rounds)
        monkeypatch.setattr(perplexity, "FREQUENT", frequent)
        monkeypatch.setattr(perplexity, "SENT_WORDS", perplexity.SENT_WORDS if shards == 1 else sent)
        dealt = perplexity.dealing(docs)
        assert dealt.shards == shards and (len(dealt.busy) > 0) == (frequent == 20)
        model, unknown = perplexity.fit(docs.filter("fold is not null").select("fold", "text"), dealt)
        found.append({r.row_no: r.perplexity for r in perplexity.perplexities(docs, model, unknown).collect()})
    assert found[0] == pytest.approx(found[1], rel=1e-12) and len(found[0]) == len(texts)


def test_no_shuffled_files_are_left_behind(spark, as_table):
    def shuffled():
        manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
        files = manager.getAllFiles()
        names = (files.apply(i).getName() for i in range(files.size()))
        return {n for n in names if n.startswith("shuffle_") and n.endswith(".data")}

    docs = numbered(as_table([(i % 2, f"the cat sat on mat {i}") for i in range(30)], "fold int, text string"))
    before = shuffled()
    model, unknown = perplexity.fit(docs.select("fold", "text"))
    scores = perplexity.perplexities(docs, model, unknown)
    assert not shuffled() - before
    assert scores.count() == 30


def test_plain_model_is_a_distribution():
    probability, words = plain_model(["a b a c", "a b b", "c"])
    for before in (("a", "b"), ("<s>", "<s>"), ("z", "a"), ("z", "z")):
        assert sum(probability((*before, w)) for w in [*words, "unknown"]) == pytest.approx(1)


def test_words_of_scripts_without_blanks():
    assert len(perplexity.tokens("ab 日本語x y".encode())) == 6
    assert len(perplexity.tokens("日".encode())) == 1 and len(perplexity.tokens(b" ")) == 0
    assert (perplexity.tokens(b"The cat") == perplexity.tokens(b"the\n CAT ")).all()


def test_junk_is_not_kept(as_table):
    draw = random.Random(3)
    prose = lambda: " ".join(draw.choice(["the", "cat", "sat", "on", "mat", "and"]) for _ in range(60)) + "."
    rows = [(i, prose(), "en", 1) for i in range(80)] + [(200, "#$% " * 40, "en", 1), (201, None, "en", 1), (202, prose(), None, 1), (202, prose(), None, 1)]
    labels = [(i, 1, 0) for i in range(40)] + [(200, 1, 1), (None, 1, 0)]
    docs = as_table(rows, "doc_id bigint, text string, lang string, perplexity int")
    got = perplexity.classify(docs, as_table(labels, "doc_id bigint, quality int, toxic int", "l"), quantile=1.0).collect()
    kept = {r.doc_id: r.kept for r in got}
    assert not kept[200] and not kept[201] and kept[202]
    assert sum(kept[i] for i in range(80)) >= 76 and len(got) == len(rows)
    nothing = perplexity.classify(docs, as_table([], "doc_id bigint, quality int, toxic int", "n")).collect()
    assert all(r.kept == (r.perplexity is not None) for r in nothing)


def test_only_words_that_may_be_frequent_are_looked_up(monkeypatch):
    draw = random.Random(3)
    texts = [" ".join(draw.choice(["the", "The", f"w{draw.randrange(3000)}"]) for _ in range(draw.randrange(90))) for _ in range(300)]
    frequent = perplexity.tokens(b"the")
    asked, find = [], perplexity._find
    monkeypatch.setattr(perplexity, "_find", lambda keys, wanted: asked.extend(wanted) or find(keys, wanted))
    monkeypatch.setattr(perplexity, "CACHED_TOKENS", 64, raising=False)
    batch = pa.record_batch([pa.array(range(300)), pa.array([2] * 300), pa.array(texts)], ["row_no", "model", "text"])
    dealt = perplexity.Dealing(7, frequent, np.array([3], np.uint64))
    found = [r for turn in range(2) for b in perplexity._deal_batches(dealt, turn, 2)(iter([batch])) for r in b.to_pylist()]
    grams = []
    for row in found:
        words = np.cumsum(perplexity._unpacked(row["words"], np.uint64), dtype=np.uint64)
        grams += words[perplexity._unpacked(row["grams"], np.int32).reshape(3, -1)].T.tolist()
    begin, end = perplexity._BEGIN, perplexity._END
    padded = [[begin, begin, *perplexity.tokens(t.encode()), end] for t in texts if t]
    assert sorted(grams) == sorted([int(w) for w in p[i : i + 3]] for p in padded for i in range(len(p) - 2))
    assert 0 < len(asked) < 0.8 * 2 * len(grams), "in none of the two turns all words are looked up among the frequent ones"
    # Texts with and without scripts that have no blanks are parted in two ways.
    assert perplexity.tokens(" ab  C\td".encode()).tolist() == perplexity.tokens(" ab  C\td日".encode()).tolist()[:-1]


def test_perplexity_of_no_documents(as_table):
    docs = as_table([], "doc_id bigint, text string, lang string")
    assert perplexity.classify(docs, as_table([(1, 1, 0)], "doc_id bigint, quality int, toxic int", "l")).count() == 0


def test_a_host_that_stands_out_goes_and_junk_counts(as_table):
    good, junk = " ".join(f"w{i}" for i in range(60)), " ".join(f"w{i}$$%" for i in range(60))
    rows = [(100 * h + i, "short" if i < 3 else good, f"h{h}", "x", 1) for h in range(20) for i in range(30)]
    rows += [(5000 + i, junk if i < 24 else good, "odd", "x", 1) for i in range(30)] + [(9000, junk, "h0", "x", 1)]
    got = {r.doc_id: r for r in quality_rules.judge(as_table(rows, DOCS)).select("doc.doc_id", "base_failed", "junk", "host_rejected", "kept").collect()}
    assert not got[5029].kept and got[5029].host_rejected and not got[5029].base_failed
    assert got[9000].junk and not got[9000].kept and not got[9000].base_failed
    assert all(got[100 * h + i].kept for h in range(20) for i in range(3, 30)), "hosts that are much alike stay"
