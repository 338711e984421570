"""lexispark: lexical retrieval and corpus analytics on Spark DataFrames."""

import pyspark

from lexispark.config import Config, Params, Space, load_config
from lexispark.operators.features import features
from lexispark.operators.grid import grid_search, table_entry
from lexispark.operators.index import Index, build
from lexispark.operators.predict import ParamTable, predict
from lexispark.retriever import Retriever, evaluate
from lexispark.sources.readers import dataset

__version__ = "0.2.0"


def backend_info(spark) -> dict:
    """What runs the queries: the Spark version and where."""
    return {"backend": "spark", "version": pyspark.__version__, "master": spark.sparkContext.master, "parallelism": spark.sparkContext.defaultParallelism}


__all__ = [
    "Config", "Index", "ParamTable", "Params", "Retriever", "Space", "backend_info", "build", "dataset", "evaluate", "features", "grid_search",
    "load_config", "predict", "table_entry", "__version__",
]
