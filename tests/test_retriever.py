"""Contracts of the class, the readers and the formulas, with small values worked out by hand."""

import json
import math

import pytest
from pyspark.sql import functions as F

from lexispark.functions.text import tokens, windows
from lexispark.operators import grid, index, metrics, predict, scoring
from lexispark.retriever import Retriever
from lexispark.sources import readers, sinks

PAIR = ["Slow tasks hold up a stage until the last partition ends.", "Salting spreads one hot key over many small partitions evenly."]


def test_tokens_split_at_unicode_space(spark):
    df = spark.createDataFrame([("  Alpha\tALPHA\nBeta\u001cGamma  　x",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(tokens(F.col("t"))).collect()] == [["alpha", "alpha", "beta", "gamma", "x"], [], []]
    got = spark.range(1).select(windows(F.array(*map(F.lit, "abcde")), 3, 2)).first()[0]
    assert got == [["a", "b", "c"], ["c", "d", "e"], ["e"]]


def test_two_texts(spark):
    """11 and 10 tokens, none repeated inside a text; 'partition' and 'partitions' differ."""
    r = Retriever(spark, PAIR)
    f = r.features
    assert f["avgdl"] == 10.5 and f["vocab_size"] == 21 and f["len_skew"] == 0 and "avg_query_len" not in f
    std = math.sqrt(0.5)
    assert f["std_len"] == pytest.approx(std) and f["hapax_ratio"] == 1 and f["len_p90"] == pytest.approx(10.9) and f["avg_ttr"] == 1
    assert f["stopword_density"] == pytest.approx(5 / 21)  # up, a, until, the; over
    b = round(0.5 - 0.3 * std / 10.5, 4)
    assert (r.params.k1, r.params.b, r.params.k3, r.params.delta, r.params.idf_type) == (0.5, b, 0.0, round(std / 10.5, 4), "smoothed")
    [(doc, score)] = r.search("hot key")
    weight, saturated = math.log(3 / 2), 1.5 / (1 + 0.5 * (1 - b + b * 10 / 10.5))
    assert doc == "1" and score == pytest.approx(2 * weight * (saturated + r.params.delta), abs=1e-6)
    assert r.search("document") == [] and r.search("hot", 0) == []
    assert (r.doc_count, r.total_tokens, r.avgdl, r.vocab_size, r.doc_freq("hot"), r.doc_freq("cold")) == (2, 21, 10.5, 21, 1, 0)
    assert r.idf("hot") == pytest.approx(weight) and r.idf("cold") == 0
    r.set_params(1.2, 0.75, 0.0, 0.0, "rsj")
    assert r.search("hot key") == [] and r.idf("hot") == 0  # half of the documents hold each word


def test_negative_scores_stay_and_ties_go_by_position(spark):
    r = Retriever(spark, ["alpha alpha beta", "alpha gamma", "delta"]).set_params(1.2, 0.75, 0.0, 0.0, "rsj")
    assert [(d, round(s, 6)) for d, s in r.search("alpha beta")] == [("0", -0.191708), ("1", -0.510826)]
    tied = Retriever(spark, [{"id": "a", "text": "alpha"}, {"id": "b", "text": "alpha"}, {"id": "c", "text": "gamma"}])
    got = tied.search("alpha", 2)
    assert [d for d, _ in got] == ["a", "b"] and got[0][1] == got[1][1]
    assert r.score_doc("nothing", 0) == 0.0


def test_errors(spark):
    with pytest.raises(ValueError, match="must not be empty"):
        Retriever(spark, [])
    with pytest.raises(TypeError, match="document 0"):
        Retriever(spark, [{"text": "x"}])
    with pytest.raises(RuntimeError, match="no index yet"):
        Retriever(spark).search("x")
    r = Retriever(spark, "one text")
    with pytest.raises(TypeError, match="integer"):
        r.search("x", 1.5)
    with pytest.raises(ValueError):
        r.search("x", -1)
    assert [d["doc_id"] for d in Retriever(spark, {"id": 7, "text": "x"}).docs.collect()] == ["7"]


def test_degenerate_corpora(spark):
    one = Retriever(spark, [""]).features
    assert one["avgdl"] == 0 and one["vocab_size"] == 0 and one["zipf_alpha"] == 0 and one["heaps_beta"] == 0
    equal = Retriever(spark, ["a b", "c d", "e f"], ["zzz"]).features
    assert equal["len_skew"] == 0 and equal["length_tf_corr"] == 0 and equal["query_oov_ratio"] == 1 and equal["query_idf_std"] == 0


def test_formulas():
    f = dict(avg_ttr=1, avg_max_tf=20, length_tf_corr=0, cv_len=0.5, avg_query_max_tf=2, query_repeat_ratio=0, heaps_beta=0.8, hapax_ratio=0)
    p = predict.predict(f)
    assert (p.k1, p.b, p.delta, p.k3, p.idf_type, p.model_variant) == (0.5, 0.35, 0.5, 0.5, "smoothed", "bm25+")


def test_metrics(spark):
    hits = spark.createDataFrame([(0, 1, "x"), (0, 2, "a"), (1, 1, "b"), (1, 2, "y")], "q_idx long, rank int, doc_id string")
    qs = spark.createDataFrame([(0, "q1"), (1, "q2"), (2, "none")], "q_idx long, qid string")
    rel = spark.createDataFrame([("q1", "a", 1), ("q2", "b", 1), ("none", "c", 0)], "qid string, doc_id string, relevance int")
    r = metrics.evaluate(hits, qs, rel).first()
    assert r["mrr@10"] == 0.75 and r["recall@100"] == 1 and r["num_queries"] == 2
    assert r["ndcg@10"] == pytest.approx((1 / math.log2(3) + 1) / 2)


def test_layouts(spark, tmp_path):
    a, b = tmp_path / "a", tmp_path / "b"
    a.mkdir()
    (b / "qrels").mkdir(parents=True)
    (a / "docs.jsonl").write_text('{"id": 1, "text": "alpha beta"}\n\n{"id": 2}\n')
    (a / "queries.jsonl").write_text('{"qid": "q1", "query": "alpha"}\n')
    (a / "qrels.jsonl").write_text('{"qid": "q1", "doc_id": 1, "relevance": 2}\n')
    (b / "corpus.jsonl").write_text('{"_id": "d1", "title": "Title", "text": "alpha beta"}\n{"_id": "d2", "text": "gamma"}\n{"_id": "d3", "text": "delta"}\n')
    (b / "queries.jsonl").write_text('{"_id": "q1", "text": "alpha"}\n')
    (b / "qrels" / "test.tsv").write_text("query-id\tcorpus-id\tscore\r\nq1\td1\t1\r\nq1\td2\t0\nshort\n")
    docs, qs, rel = readers.dataset(spark, str(a))
    assert [tuple(r) for r in docs.orderBy("doc_idx").collect()] == [(0, "1", "alpha beta"), (1, "2", "")]
    assert [tuple(r)[:3] for r in rel.collect()] == [("q1", "1", 2)] and qs.first()["query"] == "alpha"
    docs, qs, rel = readers.dataset(spark, str(b))
    assert docs.orderBy("doc_idx").first()["text"] == "Title alpha beta"
    assert [tuple(r)[:3] for r in rel.collect()] == [("q1", "d1", 1)]
    docs, _, rel = readers.dataset(spark, str(b), max_docs=2)
    assert docs.count() == 2 and docs.orderBy("doc_idx").first()["doc_id"] == "d1" and rel.count() == 1
    r = Retriever.from_dataset(spark, str(b))
    sinks.write_results(r.search_many(r.queries, 5), r.queries, str(tmp_path / "out"))
    lines = [json.loads(x) for f in (tmp_path / "out").glob("*.json") for x in f.read_text().splitlines()]
    assert lines[0]["qid"] == "q1" and lines[0]["results"][0]["rank"] == 1


def test_table_lookup(spark):
    rows = [("a", {"avgdl": 10.0, "avg_ttr": 0.5}, (1.0, 0.5, 0.0, 0.0, "rsj")), ("b", {"avgdl": 20.0, "avg_ttr": 0.7}, (2.0, 0.7, 0.0, 1.0, "smoothed"))]
    t = predict.ParamTable(spark.createDataFrame(rows, predict.ENTRY))
    targets = spark.createDataFrame([("x", "avgdl", 10.0), ("x", "avg_ttr", 0.5), ("far", "avgdl", 900.0), ("far", "avg_ttr", 9.0)], "corpus_id string, key string, value double")
    [r] = t.lookup(targets).collect()
    assert r["corpus_id"] == "x" and r["dict_match"] == "a" and r["dict_distance"] == 0 and r["model_variant"] == "bm25"
    assert {r["corpus_id"]: r["oov"] for r in t.probe(targets).collect()} == {"x": False, "far": True}


def test_grid_equals_single_searches(spark):
    docs = readers.corpus(spark, ["alpha alpha beta", "alpha gamma", "delta alpha beta beta", "beta"])
    ix = index.build(docs)
    qs = readers.query_set(spark, ["alpha alpha beta", "gamma"])
    space = grid.Space((0.5, 1.2), (0.3,), (0.0, 4.0), (0.0, 1.0), ("rsj", "smoothed"))
    got = {(r["combo_id"], r["q_idx"], r["doc_idx"]): r["score"] for r in grid.combo_scores(ix, index.query_terms(qs), space).collect()}
    for i, *p in space.combos():
        want = {(i, r["q_idx"], r["doc_idx"]): r["score"] for r in scoring.scores(ix, index.query_terms(qs), scoring.Params(*p)).collect()}
        assert {k: v for k, v in got.items() if k[0] == i and abs(v) > 1e-12}.keys() == {k for k, v in want.items() if abs(v) > 1e-12}
        assert all(got[k] == pytest.approx(v, abs=1e-9) for k, v in want.items() if abs(v) > 1e-12)


def test_whole_grid_equals_brute_force(spark, tmp_path):
    from collections import Counter
    from itertools import product

    from lexispark.plans import catalog

    texts = ["alpha beta", "alpha alpha alpha gamma delta epsilon zeta", "beta beta gamma one two three four five", "delta", "alpha beta beta one two"]
    asked = ["alpha beta", "one two", "delta"]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(asked)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(i, i % 3) for i in range(5)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    rel = [{i: 1 + i % 3 for i, t in enumerate(texts) if q in t} for q in asked]
    assert all(rel)
    bags, n = [Counter(t.split()) for t in texts], len(texts)
    avg = sum(sum(b.values()) for b in bags) / n
    df = Counter(w for b in bags for w in b)
    idf = {"rsj": lambda w: math.log((n - df[w] + 0.5) / (df[w] + 0.5)), "smoothed": lambda w: math.log((n + 1) / (df[w] + 1))}

    def ndcg(k1, b, k3, delta, kind):  # no query repeats a word, so k3 has no effect
        out = 0.0
        for q, grade in zip(asked, rel):
            score = {}
            for i, bag in enumerate(bags):
                x = sum(idf[kind](w) * ((k1 + 1) * bag[w] / (k1 * (1 - b + b * sum(bag.values()) / avg) + bag[w]) + delta) for w in q.split() if w in bag)
                if x:
                    score[i] = round(x, 9)
            ranked = sorted(score, key=lambda i: (-score[i], i))[:10]
            gain = lambda g: sum(x / math.log2(r + 2) for r, x in enumerate(g))
            out += gain([grade.get(i, 0) for i in ranked]) / gain(sorted(grade.values(), reverse=True)[:10])
        return out / len(asked)

    values = ((0.5, 0.8, 1.0, 1.2, 1.5, 2.0, 2.5, 3.0), (0.0, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.75, 0.8, 0.9, 1.0), (0.0, 0.5, 1.2, 2.0, 4.0, 8.0), (0.0, 0.3, 0.5, 0.7, 1.0, 1.5), ("rsj", "smoothed"))
    want = [(i, *c, round(ndcg(*c), 6)) for i, c in enumerate(product(*values))]
    got = sorted(tuple(r)[:6] + (r["ndcg@10"],) for r in catalog.queries()["grid_search"](spark, str(tmp_path)).collect())
    assert len(got) == 6336 and [r[:6] for r in got] == [r[:6] for r in want]
    assert [r[6] for r in got] == pytest.approx([r[6] for r in want], abs=2e-6)
    top = max(r[6] for r in want)
    assert catalog.queries()["grid_search_best"](spark, str(tmp_path)).first()["combo_id"] == next(r[0] for r in want if r[6] == top)
