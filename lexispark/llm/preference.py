"""Preference formatting, with DataFrame functions only.

A pair has a chosen and a rejected conversation. Their longest common prefix of turns (equal role and text) is
rendered once as the prompt; what follows in each is a completion, with a mask of the spans that are trained on:
the assistant's words and the end mark after them. Offsets are code points in the completion, the end exclusive.

Defined results: a null text is empty and a null role is ``unknown``; ``<|`` in a text becomes ``< |``, so that no
text can forge a mark; equal conversations have empty completions; null or empty conversations have no turns.
In ``pairs_from_conversations`` rows without conv_id or turn belong to no conversation, repeated rows count once,
turns of equal number follow in the order of role and text, and other columns pass unread. An empty table gives
an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The marks of the chat format.
BEGIN, END = "<|im_start|>", "<|im_end|>"

TURNS = "array<struct<role:string,text:string>>"


def _turn(x: Column) -> Column:
    return F.concat(F.lit(BEGIN), x["role"], F.lit("\n"), x["text"], F.lit(END + "\n"))


def render(turns: Column) -> Column:
    """The turns as one string."""
    return F.array_join(F.transform(turns, _turn), "")


def mask(turns: Column) -> Column:
    """Spans of the assistant's texts and their end marks in the rendered turns."""
    none = F.struct(F.lit(0).cast("int").alias("pos"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def add(acc: Column, x: Column) -> Column:
        start = acc["pos"] + F.lit(len(BEGIN) + 1) + F.length(x["role"])
        end = start + F.length(x["text"]) + F.lit(len(END))
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct((end + F.lit(1)).alias("pos"), F.when(x["role"] == "assistant", F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, none, add)["spans"]


def clean(turns: Column) -> Column:
    """Turns with neither nulls nor forged marks."""
    return F.transform(
        F.coalesce(turns, F.array().cast(TURNS)),
        lambda x: F.struct(F.replace(F.coalesce(x["role"], F.lit("unknown")), F.lit("<|"), F.lit("< |")).alias("role"), F.replace(F.coalesce(x["text"], F.lit("")), F.lit("<|"), F.lit("< |")).alias("text")),
    )


def common_turns(a: Column, b: Column) -> Column:
    """How many turns two conversations have in common from the start."""
    least = F.least(F.size(a), F.size(b))
    apart = F.filter(F.sequence(F.lit(0), least - 1), lambda i: F.get(a, i) != F.get(b, i))
    return F.when(least > 0, F.coalesce(F.array_min(apart), least)).otherwise(F.lit(0))


def format_pairs(pairs: DataFrame) -> DataFrame:
    """``pairs`` has pair_id and the turns ``chosen`` and ``rejected``; no shuffle, one row for each pair."""
    turned = pairs.select("pair_id", clean(F.col("chosen")).alias("_a"), clean(F.col("rejected")).alias("_b"))
    split = turned.withColumn("n_prefix", common_turns(F.col("_a"), F.col("_b")))
    rest = lambda c: F.slice(F.col(c), F.col("n_prefix") + 1, F.size(c))
    split = split.select("pair_id", "n_prefix", F.slice("_a", F.lit(1), F.col("n_prefix")).alias("_p"), rest("_a").alias("_a"), rest("_b").alias("_b"))
    return split.select(
        "pair_id",
        F.col("n_prefix").cast("long").alias("n_prefix"),
        render(F.col("_p")).alias("prompt"),
        render(F.col("_a")).alias("chosen"),
        render(F.col("_b")).alias("rejected"),
        mask(F.col("_a")).alias("chosen_mask"),
        mask(F.col("_b")).alias("rejected_mask"),
    )


def pairs_from_conversations(turns: DataFrame) -> DataFrame:
    """A preference pair for each conversation of a (conv_id, turn, role, text) table.

    Conversations 2i and 2i+1 are partners. The chosen conversation is the whole one; in the rejected one the
    partner's last answer stands in place of the last assistant turn (or after the last turn, if there is none) and
    ends it. Without an answer of a partner the rejected conversation ends before that turn. One shuffle, by pair.
    """
    rows = turns.where("conv_id is not null and turn is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    both = rows.groupBy(F.shiftright("conv_id", 1).alias("_pair")).agg(F.array_sort(F.collect_set(F.struct("conv_id", "turn", "role", "text"))).alias("_all"))
    each = both.select("_all", F.explode(F.array_distinct(F.transform("_all", lambda x: x["conv_id"]))).alias("pair_id"))
    answer = F.try_element_at(F.filter("_all", lambda x: (x["conv_id"] != F.col("pair_id")) & (x["role"] == "assistant")), F.lit(-1))
    own = F.transform(F.filter("_all", lambda x: x["conv_id"] == F.col("pair_id")), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    each = each.select("pair_id", answer.alias("_answer"), own.alias("chosen"))
    last = F.array_max(F.filter(F.sequence(F.lit(0), F.size("chosen") - 1), lambda i: F.get("chosen", i)["role"] == "assistant"))
    each = each.withColumn("_last", F.coalesce(last, F.size("chosen")))
    reply = F.when(F.col("_answer").isNotNull(), F.array(F.struct(F.lit("assistant").alias("role"), F.col("_answer.text").alias("text")))).otherwise(F.array().cast(TURNS))
    return each.select("pair_id", "chosen", F.concat(F.slice("chosen", F.lit(1), F.col("_last")), reply).alias("rejected"))


def preference_rows(turns: DataFrame) -> DataFrame:
    """The formatted pairs of a conversation table, with the masks as ``start:end`` lists."""
    flat = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string"))), ",")
    out = format_pairs(pairs_from_conversations(turns))
    return out.select(F.col("pair_id").alias("conv_id"), "n_prefix", "prompt", "chosen", "rejected", flat("chosen_mask").alias("chosen_mask"), flat("rejected_mask").alias("rejected_mask"))


#: DuckDB's form of ``preference_rows``.
SQL = """
with rows_ as (
  select distinct conv_id, turn, coalesce(role, 'unknown') as role, coalesce(text, '') as text
  from conversations where conv_id is not null and turn is not null
),
own as (select conv_id, role, text, row_number() over (partition by conv_id order by turn, role, text) - 1 as i from rows_),
conv as (select conv_id, count(*) as n, coalesce(max(i) filter (role = 'assistant'), count(*)) as k, max_by(text, i) filter (role = 'assistant') as answer from own group by conv_id),
sides as (
  select conv_id, 'c' as side, i, role, text from own
  union all
  select o.conv_id, 'r', o.i, o.role, o.text from own o join conv c using (conv_id) where o.i < c.k
  union all
  select c.conv_id, 'r', c.k, 'assistant', p.answer from conv c join conv p on p.conv_id = xor(c.conv_id, 1) where p.answer is not null
),
cleaned as (select conv_id, side, i, replace(role, '<|', '< |') as role, replace(text, '<|', '< |') as text from sides),
agree as (
  select c.conv_id, least(count(*), coalesce(max(r.n), 0)) as shorter,
    min(c.i) filter (r2.i is not null and (r2.role <> c.role or r2.text <> c.text)) as apart
  from cleaned c
  left join (select conv_id, count(*) as n from cleaned where side = 'r' group by conv_id) r on r.conv_id = c.conv_id
  left join cleaned r2 on r2.side = 'r' and r2.conv_id = c.conv_id and r2.i = c.i
  where c.side = 'c' group by c.conv_id
),
prefix as (select conv_id, coalesce(apart, shorter) as n_prefix from agree),
drawn as (
  select t.*, n_prefix, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) as s
  from cleaned t join prefix using (conv_id)
),
placed as (
  select *, coalesce(sum(length(s)) over (partition by conv_id, side order by i rows between unbounded preceding and 1 preceding), 0) + 13 + length(role) as at_
  from drawn where i >= n_prefix
),
done as (
  select conv_id, side, string_agg(s, '' order by i) as body,
    string_agg(at_::bigint || ':' || (at_ + length(text) + 10)::bigint, ',' order by i) filter (role = 'assistant') as spans
  from placed group by conv_id, side
)
select p.conv_id, p.n_prefix::bigint as n_prefix,
  coalesce((select string_agg(s, '' order by i) from drawn d where d.conv_id = p.conv_id and d.side = 'c' and d.i < d.n_prefix), '') as prompt,
  coalesce(c.body, '') as chosen, coalesce(r.body, '') as rejected, coalesce(c.spans, '') as chosen_mask, coalesce(r.spans, '') as rejected_mask
from prefix p
left join done c on c.conv_id = p.conv_id and c.side = 'c'
left join done r on r.conv_id = p.conv_id and r.side = 'r'
"""
