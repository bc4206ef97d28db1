"""Nulls, empty and very long texts, ties, repeated rows, empty tables, clashing column names: defined results everywhere."""

import collections

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.conftest import ODD
from tidemark.llm import brown, decontaminate, language, packing, pii, quality, secrets, sharding, simhash, token_counts
from tidemark.llm.common import fold, pick

N = len(ODD)
IDS = collections.Counter(r[0] for r in ODD)
OPERATORS = {
    "language": lambda d, b: language.identify(d, "doc_id", "text", "lang", fold(F.col("doc_id"), 4) == 2),
    "secrets": lambda d, b: secrets.scan(d, "doc_id", "text"),
    "brown": lambda d, b: brown.scores(d, "doc_id", "text", fold(F.col("doc_id"), 10) == 0, classes=3, clustered=10, rounds=1),
    "pii": lambda d, b: pii.protect(d, "doc_id", "text", "k"),
    "quality": lambda d, b: quality.judge(d, "doc_id", "text", "source"),
    "sharding": lambda d, b: sharding.shards(d, "doc_id", "text", "source", 3),
    "simhash": lambda d, b: simhash.classes(d, "doc_id", "text"),
    "decontaminate": lambda d, b: decontaminate.report(d, "doc_id", "text", b, "item_id", "text"),
    "token_counts": lambda d, b: token_counts.count(d, "doc_id", "text"),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(odd, benchmark, name):
    got = OPERATORS[name](odd, benchmark).collect()
    assert collections.Counter(r["doc_id"] for r in got) == IDS
    by = collections.defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    one = {k: v[0] for k, v in by.items()}
    if name == "language":
        assert [one[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and all(r["score"] == 0 for i in (1, 2, 3) for r in by[i])
    elif name == "secrets":
        assert one[1]["spans"] == one[2]["spans"] == "" and (one[10]["n_assign"], one[10]["n_access"], one[10]["n_hex"]) == (1, 1, 1)
    elif name == "brown":
        assert [one[i]["n_tokens"] for i in (1, 2, 3, 4, 8)] == [1, 1, 1, 2, 30_001]
        assert all(r["score"] < 0 and r["base_score"] < 0 for r in got)
    elif name == "pii":
        assert one[1]["text"] is None and one[2]["text"] == "" and one[9]["text"] == "x" * 100_000
    elif name == "quality":
        assert one[1]["base_failed"] and one[2]["n_words"] == 0 and one[8]["n_repeat_words"] == 30_000 and not one[8]["kept"]
        assert one[2]["host_verdict"] == "strict" and not one[2]["kept"]
    elif name == "sharding":
        counts = collections.Counter(r["shard"] for r in got)
        assert max(counts.values()) - min(counts.values()) <= 1 and one[1]["size"] == 1 and one[1]["text_crc32"] == 0
    elif name == "simhash":
        assert {one[i]["component_id"] for i in (1, 2, 3)} == {1} and one[1]["fingerprint"] == "0" * 16
        assert one[5]["component_id"] == one[6]["component_id"] == 5 and [r["component_id"] for r in by[4]] == [4, 4]
        assert one[None]["component_id"] is None
    elif name == "decontaminate":
        assert one[1]["n_words"] == one[2]["n_words"] == 0 and not one[1]["contaminated"]
        assert one[10]["n_hit"] == 1 and one[5]["n_hit"] == 11 and one[8]["n_words"] == 30_000
    elif name == "token_counts":
        assert one[1]["n_tokens"] == one[2]["n_tokens"] == 0 and one[8]["over_limit"] and one[8]["fitting_chars"] < 150_000


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(none, benchmark, name):
    assert OPERATORS[name](none, benchmark).count() == 0


def test_empty_benchmark(odd, benchmark):
    assert not any(r["contaminated"] for r in decontaminate.report(odd, "doc_id", "text", benchmark.limit(0), "item_id", "text").collect())


def test_packing_odd_rows(odd, none):
    got = packing.pack(odd, "doc_id", "text", run_tokens=5000).collect()
    starts = collections.Counter(r["doc_id"] for r in got if r["start"] == 0)
    assert starts == IDS and next(r for r in got if r["doc_id"] == 1)["doc_tokens"] == 1
    total = collections.defaultdict(int)
    for r in got:
        total[r["sequence_id"]] += r["length"]
    assert max(total.values()) <= 4096
    assert packing.pack(none, "doc_id", "text").count() == 0


def test_columns_by_name(odd):
    assert pick(odd, "text").where("text = 'extra'").count() == 0
    with pytest.raises(KeyError):
        pick(odd, "nowhere")


@pytest.fixture(scope="module")
def folder(spark, benchmark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    benchmark.write.parquet(f"{path}/benchmark.parquet")
    return str(path)


@pytest.mark.parametrize("stage", range(5))
def test_stage_on_odd_and_empty_rows(spark, odd, none, folder, stage):
    name, f = corpus_pipeline.STAGES[stage]
    got = f(spark, odd, folder)
    rows = got.collect()
    if name == "packing":
        assert {r["doc_id"] for r in rows} == set(IDS)
    else:
        assert got.columns == odd.columns
        kept = collections.Counter(r["doc_id"] for r in rows)
        if name == "simhash":
            assert kept == {1: 1, 4: 1, None: 1, 5: 1, 7: 1, 8: 1, 9: 1, 10: 1}
        elif name == "decontaminate":
            assert 5 not in kept and 6 not in kept and kept[4] == 2 and kept[1] == 1
        elif name == "pii":
            assert kept == IDS
        else:
            assert not kept
    assert f(spark, none, folder).count() == 0
