from __future__ import annotations

import random

import corpus_pipeline
import numpy as np
from odd_corpus import SCHEMA
from test_operators import _base, _components, _hits, _tokens

from tidebook.llm import _store, minhash_dedup


def _tables(spark, rows, folder):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    bench = [(1, " ".join((rows[9][1] or "").split()[:14])), (2, " ".join((rows[7][1] or "").split()[:40])), (3, None)]
    spark.createDataFrame(bench, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return bench


def test_stages_in_order_against_brute_force(spark, rows, tmp_path):
    rng = random.Random(2)
    extra = [(7000 + k, f"{rows[k][1]} mail me{k}@x{k}.org or +33 1 23 45 67 8{k % 10} {rng.random()}", "en", None, None, *[None] * 10) for k in range(12)]
    everything = [*rows, *extra]
    bench = _tables(spark, everything, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "decontamination", "pii", "packing"]
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, _store.save(stage(spark, docs, str(tmp_path)), f"test-{name}")
        seen[name] = docs
        if name != "packing":
            assert docs.columns == before.columns and [t for _, t in docs.dtypes] == [t for _, t in before.dtypes]
    one = seen["language_id"].collect()
    gone = {r[0] for r in everything} - {r["doc_id"] for r in one}
    letterless = {r[0] for r in everything if r[1] is None or not any(c.isalpha() for c in r[1])}
    assert letterless <= gone and all(len(r[1] or "") < 400 or r[1][0] in "xé" for r in everything if r[0] in gone)
    want = _components({r["doc_id"]: r["text"] for r in one if r["doc_id"] is not None}, 80)
    two = seen["near_duplicates"].collect()
    assert sorted(r["doc_id"] for r in two if r["doc_id"] is not None) == sorted(k for k, (_, c) in want.items() if k == c)
    assert sum(r["doc_id"] is None for r in two) == 1
    hits = _hits([r["text"] for r in two], bench)
    three = seen["decontamination"].collect()
    assert sorted(map(str, (r["doc_id"] for r in three))) == sorted(str(r["doc_id"]) for r, (_, hit, _) in zip(two, hits, strict=True) if not hit)
    four = {r["doc_id"]: r for r in seen["pii"].collect()}
    assert len(four) == len(three)
    for r in three:
        got = four[r["doc_id"]]
        assert got["n_chars"] == len(got["text"]) and got["terms"] == r["terms"] and not _base(got["text"])
        if not _base(r["text"]):
            assert got["text"] == r["text"]
    total = {}
    for r in seen["packing"].collect():
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["length"]
    assert total == {k: len(_tokens(r["text"])) for k, r in four.items()}


def test_run_equals_its_stages_and_takes_empty_tables(spark, rows, tmp_path):
    _tables(spark, rows[:20], tmp_path / "some")
    assert corpus_pipeline.run(spark, str(tmp_path / "some")).count() > 0
    spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "none/documents.parquet"))
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(str(tmp_path / "none/benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_bands_propose_pairs_at_the_threshold_of_the_stage():
    rng, p = np.random.RandomState(5), getattr(corpus_pipeline, "NEAR", minhash_dedup.Params())
    assert p.percent == 80
    missed = 0
    for _ in range(2000):
        both, x, y = np.split(rng.randint(0, 1 << 64, 2000, dtype=np.uint64), [1600, 1800])
        sets = [np.sort(np.concatenate([both, one])) for one in (x, y)]
        a, b = minhash_dedup.registers_of(np.concatenate(sets), np.array([0, 1800, 3600]), p).reshape(2, p.bands, p.rows)
        missed += not ((a == b) & (a > 0)).all(-1).any()
    assert missed == 0


def test_a_unique_text_stays_where_another_row_of_its_id_is_a_copy(spark):
    text = lambda c, cut=0: " ".join([f"{c}{k}" for k in range(90)][cut:])
    rows = [(5, text("x")), (5, text("y")), (3, text("y", 1)), (4, text("z")), (4, text("z")), (None, text("z")), (6, None), (6, "")]
    got = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), "").collect()
    assert sorted(map(str, got)) == sorted(map(str, spark.createDataFrame([rows[0], rows[2], rows[3], rows[5], rows[6], rows[7]], "doc_id bigint, text string").collect()))
