import re

import pytest

import corpus_pipeline
from tests.llm.conftest import SF
from tests.llm.test_exact_and_quality import W
from tests.llm.test_exact_and_quality import brute as quality_of
from tests.llm.test_near_dedup import brute as near
from tidewright.llm import quality

pytest.importorskip("public_tokenizers")


def test_stages_equal_brute_force(spark, docs):
    df, kept = docs, {r.doc_id: r for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, df, SF)
        got = out.collect()
        if k < 4:
            assert out.columns == docs.columns, name
        if name == "quality_rules":
            verdict = {r.doc_id for r in quality.judge_repetition(df).collect() if r.kept}
            assert all(i not in verdict for i, r in kept.items() if quality_of(r.text)[-1])
            kept = {i: r for i, r in kept.items() if i in verdict}
        elif name == "exact_duplicates":
            best = {}
            for i, r in sorted(kept.items(), key=lambda x: (-len(x[1].text), x[0])):
                best.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r.text), i)
            kept = {i: kept[i] for i in best.values()}
        elif name == "near_duplicates":
            comp, _ = near([(i, r.text) for i, r in kept.items()], 5)
            kept = {i: kept[i] for i in set(comp.values())}
        if k < 3:
            assert sorted(r.doc_id for r in got) == sorted(kept)
            assert all(r.text == kept[r.doc_id].text for r in got)
        elif name == "source_mix":
            assert {r.doc_id for r in got} <= set(kept)
            words = sum(len(W.findall(r.text)) for r in got)
            assert words == pytest.approx(1.5 * sum(len(W.findall(r.text)) for r in kept.values()), rel=0.03)
        else:
            assert all(r.round_trip and r.n_tokens == len(r.token_ids) for r in got)
        df = spark.createDataFrame(got, out.schema)


def brute_run(spark, df):
    """What the first three stages leave, by brute force: doc_ids of documents with words that stay."""
    rows = df.select("doc_id", "text").collect()
    verdict = {(r.doc_id, r.n_words) for r in quality.judge_repetition(df).collect() if r.kept}
    good = [(r.doc_id, r.text or "") for r in rows if (r.doc_id, len(W.findall(r.text or ""))) in verdict]
    best = {}
    for i, t in sorted(good, key=lambda x: (-len(x[1]), x[0] is None, x[0] or 0)):
        best.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t), (i, t))
    comp, _ = near(list(best.values()), 5)
    return {i for i, _ in best.values() if i is None or comp[i] == i}


def saved(df, path):
    df.coalesce(2).write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_run(spark, docs):
    out = corpus_pipeline.run(spark, SF)
    left = brute_run(spark, docs)
    got = {r.doc_id for r in out.select("doc_id").collect()}
    assert got <= left and len(got) > 0.5 * len(left)  # the mix takes some of them not at all
    assert out.where("NOT round_trip").count() == 0 and out.columns == [*docs.columns, "token_ids", "n_tokens", "round_trip"]


def test_run_on_odd_tables(spark, odd, none, clashing, tmp_path):
    """Nulls, blank and long texts, ties, repeated rows; no rows at all; clashing names."""
    out = corpus_pipeline.run(spark, saved(odd, tmp_path / "odd"))
    assert {r.doc_id for r in out.collect()} <= brute_run(spark, odd)
    assert corpus_pipeline.run(spark, saved(none, tmp_path / "none")).count() == 0
    from pyspark.sql import functions as F

    out = corpus_pipeline.run(spark, saved(clashing.withColumn("token_ids", F.lit("own")), tmp_path / "clashing"))
    assert out.columns == [*clashing.columns, "token_ids", "_token_ids", "n_tokens", "round_trip"] and out.count() > 0
