"""Index store, statistics, judgements, grid bounds, samples, settings, files and the command line, against plain Python."""

import json
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import lexispark
from lexispark import staging
from lexispark.__main__ import main
from lexispark.config import Coefficients, from_dict, load_config
from lexispark.functions.text import read_stop_words, stop_words, tokens, truncated, windows
from lexispark.operators import containment, grid, index, metrics, predict, ranks, sampling, scoring
from lexispark.operators import features as feat
from lexispark.sources import readers, sinks
from lexispark.streaming import ingest

TEXTS = ["the salt of the sea", "salt salt and pepper", "", "a hot key in one task", "one task one key", "the last of the tasks"]


def corpus(spark, texts, first=0):
    return spark.createDataFrame([(first + i, f"d{first + i}", t) for i, t in enumerate(texts)], "doc_idx long, doc_id string, text string")


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


def test_index_counts_inside_the_row(spark):
    ix = index.build(corpus(spark, [*TEXTS, None]))
    want = sorted((i, len(t.split()), w, n) for i, t in enumerate(TEXTS) for w, n in Counter(t.split()).items())
    assert rows(ix.postings, "doc_idx", "dl", "term", "tf") == want
    stop = set(stop_words(spark))
    assert len(stop) == 175
    for r in ix.document_stats.collect():
        bag = Counter((TEXTS[r["doc_idx"]] if r["doc_idx"] < len(TEXTS) else "").split())
        assert (r["uniq"], r["max_tf"], r["stop_tokens"]) == (len(bag), max((n for w, n in bag.items() if w not in stop), default=0), sum(n for w, n in bag.items() if w in stop))
    assert rows(ix.ids(spark.createDataFrame([("d3", 1), ("no", 1)], "doc_id string, g int")), "doc_id", "doc_idx") == [("d3", 3)]
    plan = scoring.scores(ix.persist(), index.query_terms(readers.query_set(spark, ["one key"])), scoring.Params())._jdf.queryExecution().executedPlan().toString()
    ix.unpersist()
    assert plan.count("Exchange hashpartitioning(q_idx") == 0  # a document's postings are summed up where they are


def test_saved_index_keeps_everything_that_is_appended(spark, tmp_path):
    at, inbox = str(tmp_path / "ix"), tmp_path / "inbox"
    index.build(corpus(spark, TEXTS[:2])).save(at)
    corpus(spark, TEXTS[2:], 2).coalesce(1).write.json(str(inbox))
    stream = spark.readStream.schema("doc_idx long, doc_id string, text string").json(str(inbox))
    q = ingest.ingest(stream, at, str(tmp_path / "progress"))
    q.processAllAvailable()
    q.stop()
    ingest.append_to(at)(corpus(spark, ["one more text"], 6), 9)
    ingest.append_to(at)(corpus(spark, ["one more text"], 6), 9)  # a batch that is repeated
    back, whole = index.Index.load(spark, at), index.build(corpus(spark, [*TEXTS, "one more text"]))
    assert rows(back.postings, "doc_idx", "dl", "term", "tf") == rows(whole.postings, "doc_idx", "dl", "term", "tf")
    assert rows(back.terms, "term", "df", "cf", "first_doc") == rows(whole.terms, "term", "df", "cf", "first_doc")
    assert back.scalars == whole.scalars and back.scalars["doc_count"] == 7 and back.stop == whole.stop
    q = readers.query_set(spark, ["one key task", "salt"])
    assert rows(scoring.search_many(back, q, scoring.Params())) == rows(scoring.search_many(whole, q, scoring.Params()))
    got, want = (feat.features(x).drop(*feat.QUERY_KEYS).first() for x in (back, whole))
    assert list(got) == pytest.approx(list(want))
    with pytest.raises(Exception, match="(?i)exists"):
        whole.save(at)


def test_many_corpora_without_reading_texts_again(spark):
    docs = corpus(spark, TEXTS).withColumn("side", F.expr("case when doc_idx < 3 then 'x' when doc_idx < 5 then 'y' end"))
    parts = {r["corpus_id"]: r for r in feat.features(index.build(docs, carry=("side",)).by("side")).collect()}
    assert sorted(parts) == ["x", "y"]  # the last document is in none
    for side, texts in (("x", TEXTS[:3]), ("y", TEXTS[3:5])):
        want = feat.features(index.build(corpus(spark, texts))).first()
        assert all(parts[side][k] == pytest.approx(want[k], abs=1e-12) for k in feat.CORPUS_KEYS)


def test_ordinals_are_dense_in_any_group(spark):
    df = spark.createDataFrame([(k, v) for k in ("a", "b", None) for v in [3, 1, 1, 1, None, 2]], "k string, v int").repartition(5)
    got = rows(staging.ordinals(df, "n", ["k"], ["v"], staging.Stage(spark, "test")).fillna({"k": "", "v": 0}), "k", "n", "v")
    assert got == [(k, n, v) for k in ("", "a", "b") for n, v in enumerate([0, 1, 1, 1, 2, 3])]
    assert staging.ordinals(df.limit(0), "n", ["k"], ["v"], staging.Stage(spark, "test")).count() == 0


def test_staged_tables_go(spark):
    stage = staging.Stage(spark, "test")
    stage.table(spark.range(3))
    assert readers.exists(spark, stage.root)
    staging.clear(spark)
    assert not readers.exists(spark, stage.root)


def test_zipf_sums(spark):
    rng = random.Random(1)
    freq = sorted((int(rng.paretovariate(0.7)) for _ in range(5000)), reverse=True)
    terms = spark.createDataFrame([(f"t{i}", 1, n, 0) for i, n in enumerate(freq)], "term string, df long, cf long, first_doc long")
    got = feat.zipf(index.Index(spark.range(0), [], [], None, terms)).first()["zipf_alpha"]
    x, y = [math.log(i + 1) for i in range(5000)], [math.log(n) for n in freq]
    mx, my = sum(x) / 5000, sum(y) / 5000
    assert got == pytest.approx(-sum((a - mx) * (b - my) for a, b in zip(x, y)) / sum((a - mx) ** 2 for a in x), abs=1e-10)


def test_own_stop_list_and_growth_points(spark, tmp_path):
    (tmp_path / "stop.txt").write_text("Salt\n\nkey \r\n")
    stop = read_stop_words(spark, str(tmp_path / "stop.txt"))
    assert stop == ["key", "salt"]
    f = feat.features(index.build(corpus(spark, TEXTS), stop), heaps_points=2).first()
    assert f["stopword_density"] == pytest.approx(5 / 24) and f["avg_max_tf"] == pytest.approx((2 + 1 + 0 + 1 + 2 + 2) / 6)
    assert f["heaps_beta"] == pytest.approx(math.log(14 / 4) / math.log(24 / 5))  # the first and the last document


def test_containment_equals_comparing_all_pairs(spark):
    rng = random.Random(3)
    docs = [" ".join(rng.choice(("Red", "red,", "green", "blue", "sky")) for _ in range(rng.randrange(9))) for _ in range(60)] + ["", "ΟΔΟΣ ΣΟΦΟΣ", "x  y"]
    asked = ["red, green", "Red", "een blu", "ed, green sk", "blue sky red,", "sky sky sky sky", "", "  ", "nowhere at all", "ΟΔΟΣ Σ", "ΔΟ", "x  y", "x y"]
    ix = index.build(corpus(spark, docs))
    q = spark.createDataFrame(list(enumerate(asked)), "q_idx long, query string")
    got = rows(containment.containing(ix, corpus(spark, docs), q))
    assert got == sorted((i, j) for i, a in enumerate(asked) for j, d in enumerate(docs) if a.strip() and a in d)
    assert "NestedLoop" not in containment.containing(ix, corpus(spark, docs), q.where("q_idx > 3 and q_idx < 6"))._jdf.queryExecution().executedPlan().toString().split("BroadcastExchange")[0]


def test_bound_of_the_grid_loses_no_hit(spark):
    rng = random.Random(8)
    docs = [" ".join(f"w{int(rng.paretovariate(0.6))}" for _ in range(rng.randrange(1, 40))) for _ in range(300)] + ["w2 w3 w4"] * 5
    ix = index.build(corpus(spark, docs)).persist()
    terms = index.query_terms(readers.query_set(spark, ["w2 w3 w4 w2", "w9 w9 w30", "w1 w2 w5 w6 w7 w8 w11", "zz w1"]))
    space = grid.Space((0.5, 3.0), (0.0, 1.0), (0.0, 4.0), (0.0, 1.5), ("rsj", "smoothed"))
    keys = ("combo_id", "q_idx")
    top = lambda df: rows(scoring.ranked(df, 7, keys), "combo_id", "q_idx", "rank", "doc_idx")
    bounded, whole = grid.top_scores(ix, terms, space, 7).persist(), grid.combo_scores(ix, terms, space).persist()
    assert top(bounded) == top(whole) and bounded.count() < whole.count()
    ix.unpersist()


@pytest.mark.parametrize("crowded", [0, 2])
def test_contenders_of_the_grid_lose_no_rank(spark, monkeypatch, crowded):
    monkeypatch.setattr(grid, "CROWDED", crowded)  # with and without the best documents as a second bound
    rng = random.Random(9)
    docs = [" ".join(f"w{int(rng.paretovariate(0.6))}" for _ in range(rng.randrange(1, 40))) for _ in range(300)] + ["w2 w3 w4"] * 5
    ix = index.build(corpus(spark, docs)).persist()
    terms = index.query_terms(readers.query_set(spark, ["w2 w3 w4 w2", "w9 w9 w30", "w1 w2 w5 w6 w7 w8 w11", "zz w1", "w2 w4"]))
    best = rows(scoring.ranked(scoring.scores(ix, terms.where("q_idx in (0, 1, 2)"), scoring.Params()), 12), "q_idx", "doc_idx")
    pairs = rng.sample(best, 12) + [(2, 7), (3, 0), (3, 305)]  # also bad ones; a query without any (4)
    wanted = spark.createDataFrame(pairs, "q_idx long, doc_idx long")
    space = grid.Space((0.5, 3.0), (0.0, 1.0), (0.0, 4.0), (0.0, 1.5), ("rsj", "smoothed"))
    found = lambda df: rows(scoring.ranked(df, 7, ("combo_id", "q_idx")).join(wanted, ["q_idx", "doc_idx"]), "combo_id", "q_idx", "rank", "doc_idx")
    few, whole = grid.top_scores(ix, terms, space, 7, wanted).persist(), grid.combo_scores(ix, terms, space).persist()
    assert found(few) == found(whole) and found(few)
    assert few.where("q_idx = 4").isEmpty() and few.count() < whole.count()
    ix.unpersist()


@pytest.mark.parametrize("bounded", [True, False])
def test_grid_ranks_equal_lists_of_all_scores(spark, monkeypatch, bounded):
    monkeypatch.setattr(ranks, "CELLS", 40)  # blocks of few documents
    monkeypatch.setattr(grid, "QUERIES_AT_ONCE", 3)
    rng = random.Random(5)
    docs = [" ".join(f"w{int(rng.paretovariate(0.6))}" for _ in range(rng.randrange(1, 40))) for _ in range(300)] + ["w2 w3 w4"] * 9 + ["", "w1"]
    ix = index.build(corpus(spark, docs)).persist()
    q = readers.query_set(spark, ["w2 w3 w4 w2 w2", "w9 w9 w30", "w1 w2 w5 w6 w7 w8 w11", "zz zz", "w1", "w2 w4", "w3"])
    hits = rows(scoring.ranked(scoring.scores(ix, index.query_terms(q.select("q_idx", "query")), scoring.Params()), 9), "q_idx", "doc_idx")
    rel = {*rng.sample(hits, 14), (0, 300), (0, 305), (2, 7), (4, 310), (5, 309), (3, 1)}  # copies, bad ones, no hit; nothing for the last query
    rel = spark.createDataFrame([(str(a), f"d{b}", 1 + (a + b) % 2) for a, b in sorted(rel) if a < 6], "qid string, doc_id string, relevance int")
    space = grid.Space((3.0, 0.5), (-0.5 if not bounded else 0.0, 0.5, 1.0), (0.0, 4.0), (0.0, 1.5), ("rsj", "smoothed"))

    def no_list(*_):
        raise AssertionError("a row was made for each combination and document")

    everything = scoring.ranked(grid.combo_scores(ix, index.query_terms(q.select("q_idx", "query")), space), 7, ("combo_id", "q_idx"))
    ids = everything.join(ix.documents.select("doc_idx", "doc_id"), "doc_idx").collect()
    monkeypatch.setattr(grid, "_spread", no_list)
    got = {r["combo_id"]: r for r in grid.grid_search(ix, q, rel, space, top_k=7).collect()}
    grades = {(int(r["qid"]), r["doc_id"]): r["relevance"] for r in rel.collect()}
    judged = sorted({a for a, _ in grades})
    for i in got:
        mrr = ndcg = recall = 0.0
        for a in judged:
            own = {r["rank"]: grades.get((a, r["doc_id"]), 0) for r in ids if r["combo_id"] == i and r["q_idx"] == a}
            good = sorted((g for (x, _), g in grades.items() if x == a), reverse=True)
            mrr += max([1 / k for k, g in own.items() if g], default=0)
            ndcg += sum(g / math.log2(k + 1) for k, g in own.items()) / sum(g / math.log2(k + 2) for k, g in enumerate(good[:10]))
            recall += sum(g > 0 for g in own.values()) / len(good)
        assert (got[i]["mrr@10"], got[i]["ndcg@10"], got[i]["recall@100"]) == pytest.approx((mrr / len(judged), ndcg / len(judged), recall / len(judged)), abs=1e-9)
    assert len(got) == len(space.combos()) and {r["num_queries"] for r in got.values()} == {len(judged)}
    ix.unpersist()


def test_limit_of_queries_and_table_entry(spark):
    docs = corpus(spark, TEXTS)
    ix = index.build(docs).persist()
    q = readers.query_set(spark, ["salt", "one key", "tasks"])
    rel = spark.createDataFrame([("0", "d1", 1), ("1", "d4", 2), ("2", "d5", 1)], "qid string, doc_id string, relevance int")
    space = grid.Space((1.2,), (0.75,), (0.0,), (0.0,), ("rsj",))
    assert grid.grid_search(ix, q, rel, space, limit_queries=2).first()["num_queries"] == 2
    best = grid.best(grid.grid_search(ix, q, rel, space), "unknown").first()
    want = lexispark.evaluate(spark, docs, q, rel, {"k1": 1.2, "b": None}).first()
    assert best["ndcg@10"] == pytest.approx(want["ndcg@10"]) and best["num_queries"] == want["num_queries"] == 3
    assert sinks.grid_report(grid.grid_search(ix, q, rel, space), grid.best(grid.grid_search(ix, q, rel, space)))["best"]["combo_id"] == 0
    f = feat.features(ix).first().asDict()
    entry = grid.table_entry("t", f, ix, q, rel, space)
    assert entry[0] == "t" and entry[1]["avgdl"] == f["avgdl"] and "avg_query_len" not in entry[1]  # and no query statistics: none were given
    assert entry[2][:4] == (1.2, 0.0, 0.0, 0.0) or entry[2][:4] == (1.2, 0.75, 0.0, 0.0)
    ix.unpersist()


def test_entries_are_their_own_nearest_neighbours(spark, tmp_path):
    entries = [{"name": f"e{i}", "features": {"avgdl": 10.0 * i, "avg_ttr": 0.1 * i, "none": None}, "params": {"k1": 0.5 + i, "b": 0.1 * i, "k3": 0, "delta": 0, "idf_type": "rsj"}} for i in range(1, 5)]
    (tmp_path / "t.json").write_text(json.dumps({"entries": entries, "match_threshold": 1.5}, indent=1))
    t = predict.ParamTable.load(spark, str(tmp_path / "t.json"))
    assert t is predict.ParamTable.load(spark, str(tmp_path / "t.json"))
    assert (t.k_neighbors, t.match_threshold, t.normalize, t.reject_oov, t.oov_margin, t.oov_min_features) == (1, 1.5, True, True, 0.5, 2)
    targets = spark.createDataFrame([(e["name"], k, float(v)) for e in entries for k, v in e["features"].items() if v], "corpus_id string, key string, value double")
    assert [(r["dict_match"], r["dict_distance"], r["k1"]) for r in t.lookup(targets).orderBy("corpus_id").collect()] == [(f"e{i}", 0.0, 0.5 + i) for i in range(1, 5)]


def test_samples(spark):
    docs = corpus(spark, [f"w {'x ' * (i % 10)}" for i in range(400)])
    part = sampling.random_share(docs, 0.5, 7)
    assert 140 < part.count() < 260 and rows(part) == rows(sampling.random_share(docs.repartition(3), 0.5, 7))
    assert rows(part) != rows(sampling.random_share(docs, 0.5, 8)) and sampling.random_share(docs, 0.0, 1).count() == 0
    lengths = sampling.length_buckets(index.build(docs).documents, 2)
    cut = {r["bucket"]: (r["lo"], r["hi"]) for r in lengths.groupBy("bucket").agg(F.min("dl").alias("lo"), F.max("dl").alias("hi")).collect()}
    assert cut[1][1] < cut[2][0] and cut[1][0] == 1 and cut[2][1] == 10
    t = spark.createDataFrame([("a b c d e",), ("a",), ("",)], "t string").select(tokens(F.col("t")).alias("t"))
    assert [r[0] for r in t.select(truncated(F.col("t"), 2)).collect()] == [["a", "b"], ["a"], []]
    assert [r[0] for r in t.select(windows(F.col("t"), 2, 1)).collect()][0] == [["a", "b"], ["b", "c"], ["c", "d"], ["d", "e"], ["e"]]


def test_settings(tmp_path):
    assert load_config().space.combos()[-1][0] == 6335
    (tmp_path / "c.json").write_text(json.dumps({"coefficients": {"k1_base": 2.0, "b_max": 0.4}, "default_params": {"k1": 0.9}, "grid_search": {"b": [0.5], "metric": "mrr@10", "top_k": 50}}))
    c = load_config(str(tmp_path / "c.json"))
    assert c.coefficients == Coefficients(k1_base=2.0, b_max=0.4) and c.default_params.k1 == 0.9 and c.space.b == (0.5,) and (c.metric, c.top_k) == ("mrr@10", 50)
    f = dict(avg_ttr=0.5, avg_max_tf=10, length_tf_corr=1, cv_len=0, heaps_beta=0.1, hapax_ratio=0.1)
    p = predict.predict(f, c.coefficients)
    assert (p.k1, p.b, p.k3, p.idf_type) == (1.4, 0.4, 0.0, "rsj")
    with pytest.raises(ValueError, match="unknown settings: nonsense"):
        from_dict({"coefficients": {"nonsense": 1}})
    yaml = pytest.importorskip("yaml")
    (tmp_path / "c.yaml").write_text(yaml.safe_dump({"grid_search": {"k1": [1.0]}}))
    assert load_config(str(tmp_path / "c.yaml")).space.k1 == (1.0,)


def test_json_forms():
    assert sinks.json_text({"a": [1, 0.1], "b": "é"}, False) == '{"a":[1,0.1],"b":"é"}'
    assert sinks.json_text({"a": [1]}) == '{\n  "a": [\n    1\n  ]\n}'


def test_lossy_lines(spark, tmp_path):
    (tmp_path / "docs.jsonl").write_bytes(b'{"id": "a", "text": "ok \xff\xfe bytes"}\r\n\r\n{"id": "b", "text": "two"}\r\n')
    got = readers.documents(spark, str(tmp_path)).orderBy("doc_idx").collect()
    assert [r["doc_id"] for r in got] == ["a", "b"] and got[0]["text"].startswith("ok ") and got[0]["text"].endswith(" bytes")


def test_command_line(spark, tmp_path, capsys):
    data = tmp_path / "set"
    (data / "qrels").mkdir(parents=True)
    (data / "corpus.jsonl").write_text("".join(json.dumps({"_id": f"d{i}", "text": t}) + "\n" for i, t in enumerate(TEXTS)))
    (data / "queries.jsonl").write_text('{"_id": "q1", "text": "salt pepper"}\n{"_id": "q2", "text": "one task"}\n')
    (data / "qrels" / "test.tsv").write_text("query-id\tcorpus-id\tscore\nq1\td1\t1\nq2\td4\t2\n")
    (tmp_path / "config.json").write_text(json.dumps({"grid_search": {"k1": [1.2], "b": [0.75], "k3": [0.0], "delta": [0.0, 1.0]}}))
    (tmp_path / "stopwords.txt").write_text("the\nof\n")
    out, given = str(tmp_path / "out"), ["--dataset", str(data), "--data-dir", str(tmp_path), "--quiet", "--topk", "5"]
    assert main(["batch", *given, "--out-dir", out]) == 0
    report = json.loads((tmp_path / "out" / "evaluation.json").read_text())
    assert report["dataset"] == "set" and report["default"]["mrr@10"] == 1 and report["adaptive"]["num_queries"] == 2 and report["default_params"]["k1"] == 1.2
    lines = [json.loads(x) for f in sorted((tmp_path / "out" / "results.jsonl").glob("*.json")) for x in f.read_text().splitlines()]
    assert [x["qid"] for x in lines] == ["q1", "q2"] and lines[0]["results"][0]["doc_id"] == "d1"
    assert main(["features", *given, "--json", str(tmp_path / "f.json")]) == 0
    assert json.loads((tmp_path / "f.json").read_text())["stopword_density"] == pytest.approx(6 / 24)
    assert main(["eval", *given, "--out-dir", out, "--grid", "--json", str(tmp_path / "e.json")]) == 0
    e = json.loads((tmp_path / "e.json").read_text())
    assert e["reach_grid_mrr@10"] == 100 and "improve_vs_default_ndcg@10" in e
    assert main(["grid", *given, "--json", str(tmp_path / "g.json")]) == 0
    g = json.loads((tmp_path / "g.json").read_text())
    assert len(g["results"]) == 4 and g["best"]["combo_id"] == 0 and g["results"][3]["idf_type"] == "smoothed"
    capsys.readouterr()
    assert main(["sample", *given, "--out-dir", out, "--queries", "1"]) == 0 and main(["demo"]) == 0
    shown = capsys.readouterr().out
    assert "q1: salt pepper" in shown and "salt salt and pepper" in shown and "broadcast join" in shown
    assert lexispark.backend_info(spark)["backend"] == "spark"
    assert metrics.NAMES == ("mrr@10", "ndcg@10", "recall@100")
