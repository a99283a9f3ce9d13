"""Toxicity and language models by held-out accuracy; registered queries and the pipeline."""

import random
import zlib

import pytest

import corpus_pipeline
from tarmac.llm import language_id, queries, toxicity

SF = "/root/testdata/sf0.01"


def syllables(rng, kind, n):
    return "".join(rng.choice(kind) for _ in range(n))


@pytest.fixture(scope="module")
def labelled():
    rng = random.Random(6)
    vocabulary = [syllables(rng, ["ta", "ri", "mo", "ne", "lu", "ska", "é"], rng.randrange(1, 4)) for _ in range(600)]
    bad = ["grobzak", "Pfuiwort", "xyloklotz"]
    rows = []
    for i in range(900):
        text = [rng.choice(vocabulary) for _ in range(rng.randrange(20, 200))]
        toxic = int(rng.random() < 0.15)
        if toxic:
            text[:: max(1, len(text) // 4)] = [rng.choice(bad)] * len(text[:: max(1, len(text) // 4)])
        rows.append((i, " ".join(text), toxic))
    return rows


def test_toxicity_held_out(spark, labelled):
    docs = spark.createDataFrame([(i, t, "x", 0.5) for i, t, _ in labelled] + [(10**6, None, "x", 0.5), (10**6 + 1, "", "x", 0.5),
                                 (None, "grobzak", "x", 0.5), (0, labelled[0][1], "x", 0.5)], "doc_id bigint, text string, toxic string, score double")
    labels = spark.createDataFrame([(i, y) for i, _, y in labelled] + [(3, None), (None, 1), (10**7, 1)], "doc_id bigint, toxic int")
    got = toxicity.score_documents(docs, labels).collect()
    assert len(got) == len(labelled) + 4 and all(0 <= r.score <= 1 for r in got)
    by_id = {r.doc_id: r for r in got}
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [(by_id[i].predicted, y) for i, _, y in labelled if by_id[i].held_out]
    assert sum(p == y for p, y in held) / len(held) > 0.97


def test_held_out_labels_are_never_learned(spark, labelled):
    docs = spark.createDataFrame([(i, t) for i, t, _ in labelled[:200]], "doc_id bigint, text string")
    score = lambda flip: {r.doc_id: r.score for r in toxicity.score_documents(docs, spark.createDataFrame(
        [(i, 1 - y if flip and zlib.crc32(str(i).encode()) % 4 == 2 else y) for i, _, y in labelled[:200]],
        "doc_id bigint, toxic int")).collect()}
    assert score(False) == score(True)


@pytest.mark.parametrize("labels", [[], [(1, 0), (3, 0)], [(1, 1)]])
def test_toxicity_without_both_classes(spark, labels):
    docs = spark.createDataFrame([(1, "a b"), (3, None)], "doc_id bigint, text string")
    got = toxicity.score_documents(docs, spark.createDataFrame(labels, "doc_id bigint, toxic int")).collect()
    assert len(got) == 2 and len({r.predicted for r in got}) == 1


def test_toxicity_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert toxicity.score_documents(docs, spark.createDataFrame([], "doc_id bigint, toxic int")).count() == 0


def test_large_model_as_a_table_gives_the_same_scores(spark, labelled, monkeypatch):
    monkeypatch.setattr(toxicity, "FREQUENT_WORDS", 100)
    odd = [(10**6, None), (10**6 + 1, ""), (0, labelled[0][1]), (10**6 + 2, "12 34"), (10**6 + 3, "zzqqj " * 3_000)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in labelled[:400]] + odd, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in labelled], "doc_id bigint, toxic int")
    counts = toxicity.ngram_counts(toxicity.training_rows(docs, labels))
    assert counts.count() > 300 and toxicity.ratio_table(counts).count() == counts.count()  # no n-gram is left out
    want, got = (sorted((r.doc_id, r.held_out, r.predicted, r.ratio, r.score) for r in toxicity.score_documents(docs, labels, most).collect())
                 for most in (toxicity.BROADCAST_NGRAMS, 300))
    assert len(got) == 405 and [r[:3] for r in got] == [r[:3] for r in want]
    assert [x for r in got for x in r[3:]] == pytest.approx([x for r in want for x in r[3:]], abs=1e-5)
    assert toxicity.score_documents(docs.limit(0), labels, -1).count() == 0


def test_language_fusion(spark):
    rng = random.Random(2)
    kinds = {"aa": ["ta", "ri", "mo"], "bb": ["ské", "gr", "öl"]}
    docs = spark.createDataFrame([(i, " ".join(syllables(rng, kinds[l], 3) for _ in range(60)), l, "x") for i in range(40)
                                  for l in kinds] + [(99, None, "aa", "x"), (98, "zz", None, "x")],
                                 "doc_id bigint, text string, lang string, host string")
    page = lambda l, n: f"<html lang='{l}'><script>{'ta ri mo ' * 50}</script><p>{' '.join(syllables(rng, kinds[l], 3) for _ in range(n))}</p>"
    rows = [(i, f"http://{l}host.org/{l}/1", page(l, 50)) for i in range(20) for l in kinds]
    hard = [(100, "http://bbhost.org/bb/", None), (101, None, page("aa", 40)), (102, "http://bbhost.org/x", ""),
            (103, "http://aahost.org/", "<html lang=bb><p>12 34</p>"), (104, None, None), (None, "://", "<p>&amp;</p>")]
    pages = spark.createDataFrame([(*r, "h", "l") for r in rows + hard], "page_id bigint, url string, html string, host string, lang string")
    got = language_id.identify(pages, docs).collect()
    assert len(got) == len(rows) + len(hard)
    by_id = {}
    for r in got:
        by_id.setdefault(r.page_id, set()).add(r.lang)
    assert all(by_id[i] == {"aa", "bb"} for i in range(20))
    assert by_id[100] == {"bb"} and by_id[101] == {"aa"} and by_id[102] == {"bb"} and by_id[104] <= {"aa", "bb"}
    assert all(r.lang == ("aa" if r.host.startswith("aa") else "bb") for r in got if r.page_id is not None and r.page_id < 20)


def test_word_likelihoods_equal_plain_python():
    import math
    from collections import Counter

    import pyarrow as pa

    from tarmac.llm.byte_ngrams import weighted_counts
    rng = random.Random(4)
    langs = [f"l{k:03}" for k in range(600)]  # more than a dense table was allowed
    words = {l: Counter(syllables(rng, ["ta", "ri", "mo", "né", "xu"], 2).encode() for _ in range(4)) for l in langs}
    rows = [(l, int(k), int(n)) for l in langs for k, n in zip(*weighted_counts(words[l], language_id.ORDER))]
    model = language_id.TrigramModel(pa.table({"lang": [r[0] for r in rows], "key": pa.array([r[1] for r in rows], pa.int64()),
                                               "n": [r[2] for r in rows]}))
    grams = lambda w: [(b" " + w + b" ")[max(0, i - 2):i + 1] for i in range(1, len(w) + 2)]
    counts = {l: Counter(g for w, n in words[l].items() for g in grams(w) * n) for l in langs}
    known = set().union(*counts.values())
    tried = [b"tari", "moné".encode(), b"zzz", b"xuxuxu"]
    for w, got in zip(tried, model.of_words(tried)):
        for l, x in zip(langs, got):
            whole = lambda g: sum(n for h, n in counts[l].items() if h[:-1] == g[:-1] and len(h) == len(g))
            want = sum(math.log((counts[l][g] + language_id.ALPHA) / (whole(g) + language_id.ALPHA * 64)) for g in grams(w) if g in known)
            assert x == pytest.approx(want, abs=1e-3)


def test_language_without_labels_or_pages(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, lang string")
    pages = spark.createDataFrame([(1, "http://a.org/", "<p>x</p>")], "page_id bigint, url string, html string")
    assert language_id.identify(pages, docs).first().lang is None
    assert language_id.identify(pages.limit(0), docs).count() == 0


def test_registered_queries():
    names = [n.split("_")[0] for n in queries.QUERIES]
    assert sorted(names) == sorted(f"op{k}" for k in range(1, 14))
    assert set(queries.ORACLE) <= set(queries.QUERIES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "n-gram Jaccard join",
                                                      "benchmark decontamination", "SentencePiece"]


def test_language_accuracy_on_pages(spark):
    rows = queries.QUERIES["op5_language_id"](spark, SF).collect()
    right = sum(r.lang == r.suffix and r.text_lang == r.suffix for r in rows)
    assert right / len(rows) > 0.95


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_queries_equal_their_sql(spark, name):
    import os
    import sys
    sys.path.insert(0, os.path.join(os.path.dirname(corpus_pipeline.__file__), "tools"))
    from oracle_check import compare, duck_connect
    got = compare(spark, duck_connect(SF), name, queries.QUERIES[name], queries.ORACLE[name], SF)
    assert got["status"] == "ok", got


def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(7)
    fresh = lambda n: " ".join(syllables(rng, ["ta", "ri", "mo", "ne", "lu", "ska"], 3) for _ in range(n))
    item = fresh(30)
    clean = [(i, f"{fresh(30)}\n{fresh(30)}", "en", "s", 1) for i in range(30)]
    one = " ".join(w + "\n" if k % 2 else w for k, w in enumerate(fresh(60).split()))  # short lines: no line copies
    odd = [(50, one, "en", "s", 1), (51, one.replace("\n", " \n", 1), "en", "t", 1), (52, f"{item}\n{fresh(20)}", "en", "s", 1),
           (53, "too short", "en", "s", 1), (54, None, "en", "s", 1), (55, clean[3][1].split("\n")[0] + "\n" + fresh(25), None, None, None)]
    spark.createDataFrame(clean + odd, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(
        f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(out) == {*range(30), 50, 55} and all(r.round_trip for r in out.values())
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs.schema, stage(spark, docs, str(tmp_path))
        assert [(f.name, f.dataType) for f in docs.schema] == [(f.name, f.dataType) for f in before]
    empty = spark.createDataFrame([], before)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
