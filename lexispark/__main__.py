"""``python -m lexispark {batch,interactive,features,eval,grid,sample,demo} --dataset FOLDER``"""

from __future__ import annotations

import argparse
import os
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lexispark.config import load_config
from lexispark.functions.text import read_stop_words, snippet
from lexispark.operators import grid
from lexispark.operators.predict import ParamTable
from lexispark.retriever import Retriever
from lexispark.sources import sinks
from lexispark.sources.readers import exists

DEMO = [
    {"id": "n1", "text": "Partitioned tables let a reader skip the files that a filter rules out."},
    {"id": "n2", "text": "A broadcast join sends the small table to every executor and spares a shuffle."},
    {"id": "n3", "text": "Skewed keys make one task slow while the others wait for it."},
    {"id": "n4", "text": "Adaptive execution splits skewed partitions and joins small ones."},
    {"id": "n5", "text": "A window function ranks the rows of each group without losing any of them."},
    {"id": "n6", "text": "Columnar files hold statistics that let a scan skip row groups."},
]
DEMO_QUERIES = ["skewed partitions", "broadcast join", "skip files with a filter"]


DATA_DIR = "LEXISPARK_DATA_DIR"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lexispark", description=__doc__)
    p.add_argument("mode", choices=("batch", "interactive", "features", "eval", "grid", "sample", "demo"))
    p.add_argument("--dataset", "-d")
    p.add_argument("--topk", "-k", type=int, default=100)
    p.add_argument("--max-docs", type=int)
    p.add_argument("--data-dir", default=os.environ.get(DATA_DIR), help="folder of param_dictionary.json, config.yaml or config.json, and stopwords.txt")
    p.add_argument("--config", help="settings, JSON or YAML")
    p.add_argument("--dictionary", help="JSON parameter table")
    p.add_argument("--no-dict", action="store_true")
    p.add_argument("--out-dir", default="results")
    p.add_argument("--json", metavar="FILE", help="features, eval and grid: write JSON there")
    p.add_argument("--metric")
    p.add_argument("--limit-queries", type=int)
    p.add_argument("--queries", type=int, default=5, help="sample: queries to show")
    p.add_argument("--grid", action="store_true", help="with eval: also how much of the grid's best is reached")
    p.add_argument("--quiet", "-q", action="store_true")
    p.add_argument("--threads", "-j", type=int, help="threads of a local session")
    p.add_argument("--master")
    return p


def settings(spark: SparkSession, a: argparse.Namespace) -> dict:
    """Parameter table, settings and stop list: what is named, else what the data folder has."""
    inside = lambda *names: next((f"{a.data_dir}/{n}" for n in names if a.data_dir and exists(spark, f"{a.data_dir}/{n}")), None)
    table, words = a.dictionary or inside("param_dictionary.json"), inside("stopwords.txt")
    return {
        "table": ParamTable.load(spark, table) if table and not a.no_dict else None, "config": load_config(a.config or inside("config.yaml", "config.json")),
        "stop": read_stop_words(spark, words) if words else None,
    }


def show(r: Retriever, query: str, top_k: int) -> None:
    """A query's hits with the beginnings of their texts."""
    hits = r.search_many([query], top_k).join(r.docs.select("doc_idx", snippet(F.col("text")).alias("snippet")), "doc_idx").orderBy("rank").collect()  # top_k rows
    for h in hits:
        print(f"{h['rank']:3d}  {h['score']:10.4f}  {h['doc_id']:<12} {h['snippet']}")
    if not hits:
        print("     no hit")


def main(args: list[str] | None = None) -> int:
    p = parser()
    a = p.parse_args(args)
    master = a.master or (f"local[{a.threads}]" if a.threads else None)
    builder = SparkSession.builder.appName("lexispark")
    spark = (builder.master(master) if master else builder).getOrCreate()
    say = (lambda *x: None) if a.quiet else print
    if a.mode == "demo":
        r = Retriever(spark, DEMO, DEMO_QUERIES)
        print(r.params)
        for q in DEMO_QUERIES:
            print(q)
            show(r, q, 3)
        return 0
    if not a.dataset:
        p.error("--dataset is needed")
    began = time.time()
    r = Retriever.from_dataset(spark, a.dataset, a.max_docs, **settings(spark, a))
    metric = a.metric or r.config.metric
    say(f"indexed {r.features['doc_count']} documents in {time.time() - began:.1f} s; {r.params} ({r.params_source})")
    queries = r.queries if a.limit_queries is None else r.queries.where(F.col("q_idx") < a.limit_queries)
    scored = lambda params=None: r.evaluate(queries, top_k=a.topk, params=params).persist()
    searched = lambda: grid.grid_search(r._ready(), r.queries, r.qrels, r.config.space, a.topk, a.limit_queries).persist()
    if a.mode == "features":
        if a.json:
            sinks.write_json(spark, r.features, a.json)
        else:
            print(sinks.json_text(r.features))
    elif a.mode == "interactive":
        while query := input("query> ").strip():
            show(r, query, min(a.topk, 10))
    elif a.mode == "sample":
        for row in r.queries.where(F.col("q_idx") < a.queries).orderBy("q_idx").collect():
            began = time.time()
            print(f"{row['qid']}: {row['query']}")
            show(r, row["query"], min(a.topk, 10))
            say(f"     {time.time() - began:.2f} s")
    elif a.mode == "batch":
        sinks.write_results(r.search_many(r.queries, a.topk), r.queries, f"{a.out_dir}/results.jsonl")
    if a.mode in ("batch", "eval", "sample") and not r.qrels.isEmpty():
        default, adaptive = scored(r.config.default_params), scored()
        sinks.write_json(spark, sinks.evaluation(a.dataset.rstrip("/").rsplit("/", 1)[-1], r.params, r.config.default_params, default, adaptive), f"{a.out_dir}/evaluation.json")
        report = sinks.report(default, adaptive, grid.best(searched(), metric) if a.grid else None)
        if a.json:
            sinks.write_json(spark, report.first().asDict(True), a.json)
        if not a.quiet:
            report.show(truncate=False)
    elif a.mode == "grid":
        results = searched()
        best = grid.best(results, metric)
        sinks.write_json(spark, sinks.grid_report(results, best), a.json or f"{a.out_dir}/grid.json")
        if not a.quiet:
            best.show()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
