"""Prompt chains made of the conversations table."""

from __future__ import annotations

from pyspark.sql import functions as F

from burstlens.operators import prompts
from burstlens.session import scratch_path
from burstlens.sources import sinks, tables
from table_queries.adapters import table
from table_queries.registry import query


def bank(spark, sf):
    """User texts per conversation; every fifth category and model is missing.

    A chain is one conversation; a conversation of any length is stored in
    pieces of 128 turns, so that no list is unbounded.
    """
    users = table(spark, sf, "conversations").where("role = 'user'")
    piece = F.floor(F.col("turn") / 128).cast("long").alias("piece")
    chains = users.groupBy("conv_id", piece).agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("_p"))
    n = F.col("conv_id") % 5
    return chains.select(
        "conv_id", "piece", F.when(n != 0, F.concat(F.lit("Cat"), n.cast("string"))).alias("category"),
        F.when(n != 1, F.lit("m1")).alias("model"), F.col("_p.text").alias("prompts"), F.size("_p").alias("chain_length"))


_BANK = """u AS (SELECT conv_id, turn // 128 AS piece, text, row_number() OVER (PARTITION BY conv_id, turn // 128 ORDER BY turn) AS step,
  CASE WHEN conv_id % 5 <> 0 THEN 'Cat' || (conv_id % 5) ELSE 'uncategorized' END AS category,
  CASE WHEN conv_id % 5 <> 1 THEN 'm1' ELSE 'unknown' END AS model FROM conversations WHERE role = 'user')"""


@query(f"WITH {_BANK} SELECT dense_rank() OVER (ORDER BY conv_id, piece) AS chain_id, category, model, CAST(step AS INTEGER) AS step, text FROM u")
def prompt_steps(spark, sf):
    return prompts.prompt_steps(bank(spark, sf), order=["conv_id", "piece"])


@query(f"""WITH {_BANK} SELECT dense_rank() OVER (ORDER BY conv_id, piece) AS chain_id, category, model, CAST(step AS INTEGER) AS step, text
FROM u WHERE category IN ('Cat2', 'uncategorized')""")
def prompt_steps_filtered(spark, sf):
    some = prompts.filter_chains(bank(spark, sf), ["CAT2", "Uncategorized"])
    return prompts.prompt_steps(some, order=["conv_id", "piece"], target_rows=10)


@query(f"WITH {_BANK} SELECT conv_id, piece FROM (SELECT DISTINCT conv_id, piece FROM u) ORDER BY conv_id, piece LIMIT 15")
def first_chains(spark, sf):
    return prompts.first_chains(bank(spark, sf), 15, order=["conv_id", "piece"]).select("conv_id", "piece")


@query(f"""WITH {_BANK} SELECT conv_id, piece FROM (SELECT DISTINCT conv_id, piece FROM u)
ORDER BY md5('7:' || conv_id || ':' || piece) LIMIT 15""")
def shuffled_chains(spark, sf):
    return prompts.first_chains(bank(spark, sf), 15, order=["conv_id", "piece"], shuffle_seed=7).select("conv_id", "piece")


_QUOTED = """replace(replace(replace(text, chr(92), chr(92) || chr(92)), '"', chr(92) || '"'), chr(10), chr(92) || 'n')"""


@query(f"""WITH t AS (SELECT conv_id, turn, replace(text, chr(13), ' ') AS text FROM conversations),
l AS (SELECT conv_id, turn, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM t),
c AS (SELECT conv_id, turn, k, ltrim(line, '-0123456789. ') AS line FROM (SELECT * REPLACE (trim(line) AS line) FROM l)
  WHERE line <> '' AND line[1] NOT IN ('[', '{{') AND NOT regexp_full_match(line, '[\\[\\]{{}}.,]+')),
g AS (SELECT conv_id, turn, string_agg(line, '|' ORDER BY k) AS prompts FROM c GROUP BY 1, 2)
SELECT t.conv_id, t.turn, CASE t.turn % 3 WHEN 0 THEN coalesce(g.prompts, '') ELSE t.text || '|two' END AS prompts
FROM t LEFT JOIN g ON g.conv_id = t.conv_id AND g.turn = t.turn""")
def normalize_chain(spark, sf):
    """Answers in three forms: plain lines, a JSON list, a JSON list inside prose."""
    c = table(spark, sf, "conversations").withColumn("text", F.replace("text", F.lit("\r"), F.lit(" ")))
    as_list = F.to_json(F.array(F.col("text"), F.lit("two")))
    n = F.col("turn") % 3
    raw = F.when(n == 0, F.col("text")).when(n == 1, as_list).otherwise(F.concat(F.lit("Sure: "), as_list, F.lit(" done.")))
    return c.select("conv_id", "turn", F.array_join(prompts.normalize_chain(raw), "|").alias("prompts"))


@query(f"WITH {_BANK} SELECT conv_id % 5 AS kind, count(DISTINCT (conv_id, piece)) AS chains, count(*) AS prompts FROM u GROUP BY 1")
def bank_roundtrip(spark, sf):
    """Two halves of the bank appended to one store and read back."""
    path = scratch_path(spark, "bank")
    whole = bank(spark, sf)
    for half in (0, 1):
        sinks.append_bank(whole.where(F.col("conv_id") % 2 == half).drop("conv_id", "piece"), path)
    back = tables.read_prompt_bank(spark, path, multi_line=False)
    kind = F.coalesce(F.substr("category", F.lit(4)).cast("long"), F.lit(0))
    return back.groupBy(kind.alias("kind")).agg(
        F.count(F.lit(1)).alias("chains"), F.sum("chain_length").alias("prompts"))
