"""Writers of results and reports."""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.config import Params


def nested(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """(q_idx, qid, results): each query's ranked list in one row, empty where nothing was found."""
    one = F.struct(F.col("rank").cast("int").alias("rank"), F.col("doc_id"), F.col("score"))
    lists = hits.groupBy("q_idx").agg(F.array_sort(F.collect_list(one)).alias("results"))  # at most k of a query
    none = F.array().cast("array<struct<rank:int,doc_id:string,score:double>>")
    return queries.select("q_idx", "qid").join(lists, "q_idx", "left").withColumn("results", F.coalesce("results", none))


def write_results(hits: DataFrame, queries: DataFrame, path: str) -> None:
    """JSON lines ``{"qid", "results": [{"rank", "doc_id", "score"}]}`` in the order of the queries."""
    nested(hits, queries).orderBy("q_idx").select("qid", "results").write.mode("overwrite").json(path)


def report(default: DataFrame, adaptive: DataFrame, best: DataFrame | None = None) -> DataFrame:
    """One row: both evaluations, the improvement in percent, and how much of the grid's best is reached."""
    from lexispark.operators.metrics import NAMES, improvement

    pack = lambda df, name: df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name))
    out = pack(default, "default").join(F.broadcast(pack(adaptive, "adaptive"))).join(F.broadcast(improvement(default, adaptive)))
    if best is not None:
        out = out.join(F.broadcast(pack(best.select(*[f"`{n}`" for n in NAMES]), "grid_best")))
        for n in NAMES:
            out = out.withColumn(f"reach_grid_{n}", F.coalesce(F.try_divide(F.col(f"adaptive.`{n}`") * 100, F.col(f"grid_best.`{n}`")), F.lit(0.0)))
    return out


def json_text(value, pretty: bool = True) -> str:
    """JSON with two spaces of indent, or in one line."""
    return json.dumps(value, ensure_ascii=False, indent=2) if pretty else json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def write_json(spark: SparkSession, value, path: str, pretty: bool = True) -> None:
    """A small value (a report, a list of combinations) as one JSON file, on any file system that Spark writes to."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray((json_text(value, pretty) + "\n").encode()))
    finally:
        out.close()


def evaluation(dataset: str, adaptive_params: Params, default_params: Params, default: DataFrame, adaptive: DataFrame) -> dict:
    """The value of ``evaluation.json``."""
    one = lambda df: df.first().asDict()  # noqa: E731  one row
    return {"dataset": dataset, "adaptive_params": asdict(adaptive_params), "default_params": asdict(default_params), "default": one(default), "adaptive": one(adaptive)}


def grid_report(results: DataFrame, best: DataFrame) -> dict:
    """The value of ``grid.json``: the best combination, and all of them in order (some thousand rows)."""
    return {"best": best.first().asDict(), "results": [r.asDict() for r in results.orderBy("combo_id").collect()]}
