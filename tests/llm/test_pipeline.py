"""The pipeline against the same stages in plain Python, each on what its predecessor kept."""

import collections
import zlib

import numpy as np
import public_tokenizers
from tests.llm.test_brute import brute_quality, brute_windows, words
from tokenizers import Tokenizer

import corpus_pipeline
from tidemark.llm.common import documents

SF = "/root/testdata/sf0.001"


def table(df):
    return {r["doc_id"]: r.asDict() for r in df.collect()}


def test_stages_in_turn(spark):
    docs = documents(spark, SF)
    have, columns, frame = table(docs), docs.columns, docs
    kept = {}
    for name, f in corpus_pipeline.STAGES[:4]:
        frame = f(spark, frame, SF).cache()
        assert frame.columns == columns and frame.dtypes == docs.dtypes
        kept[name] = table(frame)
        assert len(kept[name]) == frame.count()

    good = {}
    for d, r in have.items():
        n, chars, symbols, again, rep = brute_quality(r["text"])
        lines = sum(bool(x.strip(" \t\n\x0b\x0c\r")) for x in (r["text"] or "").split("\n"))
        if n >= 50 and 100 * rep <= 50 * n and 10 * symbols <= n and (again < 5 or 10 * again <= 3 * lines) and 2 * n <= chars <= 15 * n:
            good[d] = r
    assert kept["quality"] == good  # hosts here differ no more than chance has it, so all are strict

    sets = {d: {tuple(words(r["text"])[i : i + 5]) for i in range(max(1, len(words(r["text"])) - 4))} for d, r in good.items()}
    left = kept["simhash"]
    likeness = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    ids = sorted(left)
    assert not [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if likeness(a, b) >= 0.8]
    for d in set(good) - set(left):
        assert max(likeness(d, o) for o in good if o != d) >= 0.6
    assert all(left[d] == good[d] for d in left)

    items = [g for (t,) in spark.read.parquet(f"{SF}/benchmark.parquet").select("text").collect() for g in brute_windows(t)[1]]
    index = collections.defaultdict(list)
    for g in items:
        index[g[0]].append(g)
    clean = kept["decontaminate"]
    for d, r in left.items():
        w, _ = brute_windows(r["text"])
        hit = {p for i, x in enumerate(w) for g in index[x] if tuple(w[i : i + len(g)]) == g for p in range(i, i + len(g))}
        if not hit:
            assert clean[d] == r
        elif 2 * len(hit) >= len(w):
            assert d not in clean
        else:
            assert brute_windows(clean[d]["text"])[0] == [x for i, x in enumerate(w) if i not in hit]

    private = kept["pii"]
    assert set(private) == set(clean)
    for d, r in clean.items():
        if "@" in r["text"]:
            assert r["text"] != private[d]["text"]
        if not any(c.isdigit() or c == "@" for c in r["text"]):
            assert private[d] == r

    pieces = corpus_pipeline.STAGES[4][1](spark, frame, SF).collect()
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    total = collections.Counter()
    for r in pieces:
        ids = [*library.encode(private[r["doc_id"]]["text"], add_special_tokens=False).ids, 2]
        part = ids[r["start"] : r["start"] + r["length"]]
        total[r["doc_id"]] += len(part)
        assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes()) and r["doc_tokens"] == len(ids)
    assert all(total[d] == len(library.encode(r["text"], add_special_tokens=False).ids) + 1 for d, r in private.items())


def test_run_is_the_last_stage(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert got.count() > 0
