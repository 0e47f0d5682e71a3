"""The pipeline on small tables, each stage against what it must do."""

import random

import corpus_pipeline

from outpulse.llm.common import ROW  # noqa: F401
from outpulse.llm.queries import QUERIES


def words(draw, n):
    return " ".join("".join(draw.choice("abcdefgh") for _ in range(5)) for _ in range(n))


def tables(spark, tmp_path, rows, items):
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_stages_take_effect(spark, tmp_path):
    draw = random.Random(8)
    passage, question = words(draw, 60), words(draw, 20)
    texts = [words(draw, 80) for _ in range(12)]
    texts[1] = texts[0] + " almost"  # a near copy
    texts[2] += " " + passage
    texts[3] = passage + " " + texts[3]
    texts[4] += " " + question
    texts += ["too short", None, texts[5]]
    rows = [(i, t, "en", "host", len(t or ""), "extra") for i, t in enumerate(texts)]
    sf_dir = tables(spark, tmp_path, rows, [(1, question)])
    docs, seen = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{number}")
        after = spark.read.parquet(f"{tmp_path}/{number}")
        assert after.columns == docs.columns
        docs = after
        seen.append({r.doc_id: r for r in docs.collect()})
    assert set(seen[0]) == set(range(15)) - {12, 13}
    assert set(seen[1]) == set(range(12)) - {1}
    assert passage not in seen[2][2].text and passage not in seen[2][3].text and seen[2][6].text == texts[6]
    assert seen[2][2].n_chars == len(seen[2][2].text) and set(seen[2]) == set(seen[1])
    assert set(seen[3]) == set(seen[2]) - {4}
    packed = corpus_pipeline.run(spark, sf_dir)
    assert {r.doc_id for r in packed.collect()} == set(seen[3])


def test_junk_is_dropped_and_counts_for_its_host(spark, tmp_path):
    good = " ".join(f"w{i}" for i in range(60))
    junk = " ".join(f"w{i}$$%" for i in range(60))
    texts = [(good, "fine")] * 30 + [(junk, "fine"), (good + " $$", "fine")] + [(junk, "bad")] * 200 + [(good, "bad")]
    rows = [(i, t, "en", host, len(t), "extra") for i, (t, host) in enumerate(texts)]
    sf_dir = tables(spark, tmp_path, rows, [])
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert {r.doc_id for r in corpus_pipeline.quality(spark, docs, sf_dir).collect()} == {*range(30), 31}


def test_nothing_goes_through(spark, tmp_path):
    assert corpus_pipeline.run(spark, tables(spark, tmp_path, [], [])).count() == 0


def test_every_operator_has_a_query():
    assert [name.split("_")[0] for name in QUERIES] == [f"op{n}" for n in range(1, 14)]
