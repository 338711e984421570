"""Length buckets with least padding, and batches of a token budget inside each bucket.

A histogram of the token counts of all documents is taken in one aggregation. Dynamic programming over it
chooses at most ``buckets`` upper bounds so that padding every document to its bucket's bound costs the fewest
tokens. Batches of ``floor(budget / bound)`` documents then form inside each bucket, in the order of doc_id.

The histogram is exact: one row for each token count that occurs. D different counts need at least D * D / 2 tokens, so
it grows at most with the root of the corpus (some millions of rows for 10^13 tokens), and only it reaches the driver.

Defined results: null and empty texts have 0 tokens and are packed like others; a document longer than the
budget is a batch of its own, uncut; equal bounds cannot occur, and of equally good plans the one with the lowest
bounds from the top down is taken; rows without an id come first in their bucket; repeated rows get slots of their own;
an empty table gives an empty result; other columns, whatever their names, pass unread.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexispark.llm.runtime import Stage, ordinals

BUCKETS = 16
#: Tokens, padding included, of a batch.
BUDGET = 16_384


def token_count(text: Column) -> Column:
    """Runs of characters other than ASCII white space; null counts 0."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"[\t-\r ]+"), lambda x: x != "")).cast("long")


def best_bounds(size: np.ndarray, count: np.ndarray, buckets: int) -> list[int]:
    """The upper bounds, ascending, of at most ``buckets`` groups of the sorted sizes with the least padding.

    ``f[j]`` is the least cost (padded tokens) of the first j sizes. One more bucket ends at j and starts after i, at
    the cost ``f[i] - rows[i] * size[j] + rows[j] * size[j]``: a line for each i, of which the lowest at size[j] is
    wanted. Slopes fall with i and sizes grow with j, so the lower hull is walked once in each layer. Whole numbers
    throughout; of equal costs the least i wins.
    """
    m = len(size)
    if not m:
        return []
    x, rows = [0, *map(int, size)], [0, *np.cumsum(np.asarray(count, dtype=object)).tolist()]
    f = [a * b for a, b in zip(x, rows)]
    cuts = []
    for _ in range(min(buckets, m) - 1):
        new, cut, hull, head = [0] * (m + 1), [0] * (m + 1), [], 0
        for j in range(1, m + 1):
            c = j - 1
            while len(hull) > 1:
                a, b = hull[-2], hull[-1]
                if (f[c] - f[a]) * (rows[b] - rows[a]) > (f[b] - f[a]) * (rows[c] - rows[a]):
                    break
                hull.pop()  # nowhere below both of its neighbours
            hull.append(c)
            head = min(head, len(hull) - 1)
            at = x[j]
            while head + 1 < len(hull) and f[hull[head + 1]] - rows[hull[head + 1]] * at < f[hull[head]] - rows[hull[head]] * at:
                head += 1
            i = hull[head]
            new[j], cut[j] = f[i] + (rows[j] - rows[i]) * at, i
        cuts.append(cut)
        f = new
    bounds, j = [x[m]], m
    for cut in reversed(cuts):
        j = cut[j]
        if not j:
            break
        bounds.append(x[j])
    return bounds[::-1]


def histogram(lengths: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The token counts that occur, ascending, and the rows of each."""
    got = lengths.groupBy("n_tokens").agg(F.count("*").alias("rows")).toArrow().sort_by("n_tokens")
    return got.column("n_tokens").to_numpy(), got.column("rows").to_numpy()


def pack(lengths: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """Bucket, batch and slot of each row of ``lengths`` (doc_id, n_tokens).

    Rows are numbered in their bucket by ranges of (bucket, doc_id), so a bucket that has most of the rows, or a row
    that repeats often, is numbered by many tasks.
    """
    stage = Stage(lengths.sparkSession, "packing")
    lengths = stage.table(lengths.select("doc_id", "n_tokens", F.monotonically_increasing_id().alias("_row")))
    bounds = best_bounds(*histogram(lengths), buckets) or [0]
    number = F.lit(len(bounds) - 1)
    for i in reversed(range(len(bounds) - 1)):
        number = F.when(F.col("n_tokens") <= bounds[i], i).otherwise(number)
    numbered = ordinals(lengths.withColumn("bucket", number.cast("int")), "_at", ["bucket"], ["doc_id", "n_tokens"], stage, "_row")
    bound = F.element_at(F.array(*[F.lit(b).cast("long") for b in bounds]), F.col("bucket") + 1)
    fits = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(budget) / F.greatest(F.col("bucket_tokens"), F.lit(1))).cast("long"))
    return (
        numbered.withColumn("bucket_tokens", bound).withColumn("_fits", fits)
        .select(
            "doc_id", "n_tokens", "bucket", "bucket_tokens",
            F.floor(F.col("_at") / F.col("_fits")).cast("long").alias("batch"),
            (F.col("_at") % F.col("_fits")).cast("long").alias("slot"),
            (F.col("bucket_tokens") - F.col("n_tokens")).alias("padding"),
        )
    )


def packed_documents(docs: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """Every document's bucket, batch (numbered inside the bucket), slot in the batch, and padding."""
    return pack(docs.select("doc_id", token_count(F.col("text")).alias("n_tokens")), buckets, budget)


#: DuckDB's form of ``packed_documents``: every split of every layer is tried.
SQL = rf"""
with recursive doc as (
  select doc_id, len(list_filter(string_split_regex(coalesce(text, ''), '[\t-\r ]+'), lambda x: x <> ''))::bigint as n_tokens from documents
),
hist as (
  select row_number() over (order by n_tokens) as j, n_tokens as size, sum(n) over (order by n_tokens)::bigint as rows
  from (select n_tokens, count(*) as n from doc group by n_tokens)
),
plan(layer, j, cost, bounds) as (
  select 1, j, size * rows, [size] from hist
  union all
  select layer + 1, k, cost, bounds from (
    select p.layer, h.j as k, p.j as i, p.cost + (h.rows - g.rows) * h.size as cost, list_append(p.bounds, h.size) as bounds
    from plan p join hist g on g.j = p.j join hist h on h.j > p.j where p.layer < {BUCKETS}
    union all
    select distinct p.layer, h.j, 0, h.size * h.rows, [h.size] from (select distinct layer from plan) p cross join hist h where p.layer < {BUCKETS}
  ) qualify row_number() over (partition by k order by cost, i) = 1
),
best as (select bounds from plan where layer = {BUCKETS} order by j desc limit 1),
bound as (select unnest(bounds) as bucket_tokens, unnest(range(0, len(bounds)))::int as bucket from best),
placed as (select doc_id, n_tokens, min(bucket_tokens) as bucket_tokens, min(bucket) as bucket from (select d.doc_id, d.n_tokens, d.place, b.* from (select *, row_number() over () as place from doc) d join bound b on b.bucket_tokens >= d.n_tokens) group by doc_id, n_tokens, place),
numbered as (select *, row_number() over (partition by bucket order by doc_id nulls first, n_tokens) - 1 as place, greatest(1, {BUDGET} // greatest(bucket_tokens, 1)) as fits from placed)
select doc_id, n_tokens, bucket, bucket_tokens, (place // fits)::bigint as batch, (place % fits)::bigint as slot, bucket_tokens - n_tokens as padding from numbered
"""
