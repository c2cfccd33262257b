"""The pipeline's stages, one after another, against their operators."""

from collections import Counter

import corpus_pipeline
from tests.llm.conftest import MID
from tests.llm.test_models import brute_spans
from tests.llm.test_joins import brute
from tests.llm.test_tables import brute_rules
from tracefold.llm import bpe, quality


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{MID}/documents.parquet")
    before = None
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, MID)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == before.columns if before is not None else out.columns == docs.columns
        path = str(tmp_path / name)
        out.write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        was, now = before.collect(), docs.collect()
        if name == "quality_classifier":
            scores = {r["doc_id"]: r["predicted"] for r in quality.classify(before, spark.read.parquet(f"{MID}/labels.parquet")).collect()}
            assert {r["doc_id"] for r in now} == {i for i, p in scores.items() if p}
            assert Counter(now) <= Counter(was)
        elif name == "quality_rules":
            assert Counter(now) == Counter(r for r in was if not any_rule(r["text"]))
        elif name == "near_duplicates":
            named = brute([(r["doc_id"], r["text"]) for r in was])
            assert Counter(now) == Counter(r for r in was if any(i == r["doc_id"] and i == c for i, _, c in named))
        elif name == "personal_data":
            text = {r["doc_id"]: r["text"] for r in was}
            assert len(now) == len(was)
            for r in now:
                assert r["text"] == text[r["doc_id"]] or "<" in r["text"]
                assert not brute_spans(text[r["doc_id"]]) or r["text"] != text[r["doc_id"]]
                assert not brute_spans(r["text"]) and r["n_chars"] == len(r["text"])
        else:
            enc = bpe.WordBpe(open(bpe.default_vocabulary(), encoding="utf-8").read())
            ids = enc.encode([r["text"] for r in was])
            assert sum(r["length"] for r in now) == sum(len(x) + 1 for x in ids)
            assert max(r["offset"] + r["length"] for r in now) <= 4096


def any_rule(text) -> bool:
    return not brute_rules(text)[-1]


def test_run(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0
    assert corpus_pipeline.ORACLE_SQL is None


def test_sequences_have_their_ids(spark):
    docs = spark.createDataFrame([(1, "some words to pack, write to <EMAIL>"), (2, None)], "doc_id long, text string")
    enc = bpe.WordBpe(open(bpe.default_vocabulary(), encoding="utf-8").read())
    rows = {r["doc_id"]: r for r in corpus_pipeline.pack(spark, docs, MID).collect()}
    want = dict(zip((1, 2), enc.encode(["some words to pack, write to <EMAIL>", ""])))
    assert all(rows[i]["ids"][:-1] == list(x) and len(rows[i]["ids"]) == rows[i]["length"] for i, x in want.items())
