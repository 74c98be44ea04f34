"""Registered query: chat formatting of ``conversations``."""

from pyspark.sql import functions as F

from parasift.sources.tables import read_table

from . import chat
from .registry import register

#: Conversation -7: template markers inside texts, part of the query's contract.
TRICKY = "\\### Assistant: </turn> ok"


@register("op4_chat_windows", oracle=r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (
  SELECT *, replace(replace(replace(text, '\', '\s'), '<', '\l'), '>', '\g') AS body,
         '<turn ' || replace(replace(replace(role, '\', '\s'), '<', '\l'), '>', '\g') || '>' AS head FROM t),
c AS (
  SELECT *, length(head) + length(body) + 8 AS chars, CAST(ceil((strlen(head) + strlen(body) + 8) / 4.0) AS BIGINT) AS cost FROM e),
n AS (
  SELECT *, row_number() OVER w AS pos, sum(cost) OVER (w ROWS UNBOUNDED PRECEDING) AS upto FROM c
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
s AS (
  SELECT *, first(CASE WHEN role = 'system' THEN cost END) OVER (PARTITION BY conv_id ORDER BY pos) AS sc,
         first(CASE WHEN role = 'system' THEN chars END) OVER (PARTITION BY conv_id ORDER BY pos) AS sch FROM n),
k AS (SELECT *, greatest(1, floor((1792 - coalesce(sc, 0)) / 2.0)) AS stride FROM s),
w AS (SELECT *, 2 * floor((upto - 1) / stride) + CASE WHEN cost > stride THEN 0 ELSE 1 END AS win FROM k),
x AS (SELECT *, max(upto) OVER (PARTITION BY conv_id, win) AS fin, min(pos) OVER (PARTITION BY conv_id, win) AS p0,
             max(win) OVER (PARTITION BY conv_id) AS last_win FROM w)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY pos), '')) AS loss_sha256,
       CAST(sum(chars) + sum(CASE WHEN win < last_win AND fin - upto + cost <= 256 AND NOT (sc IS NOT NULL AND pos = 1) THEN chars ELSE 0 END)
            + sum(CASE WHEN sc IS NOT NULL AND pos = p0 AND pos > 1 THEN sch ELSE 0 END) AS BIGINT) AS formatted_chars
FROM x GROUP BY conv_id
""")
def op4_chat_windows(spark, sf_dir):
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(TRICKY).alias("text"),
    )
    back = chat.read_back(chat.windows(turns.unionByName(extra)))
    own = back.select(
        "conv_id", "window", "formatted_chars", F.size("new_turns").alias("n"),
        F.array_join(F.transform("new_turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "").alias("turns"),
        F.array_join("loss_texts", "").alias("loss"),
    )
    whole = own.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("window", "turns", "loss"))).alias("w"),
        F.sum("n").alias("n_turns"), F.sum("formatted_chars").alias("formatted_chars"),
        F.sum(F.char_length("loss")).alias("loss_chars"),
    )
    joined = lambda f: F.array_join(F.transform("w", lambda x: x[f]), "")
    return whole.select(
        "conv_id", "n_turns", F.sha2(joined("turns").cast("binary"), 256).alias("turns_sha256"),
        "loss_chars", F.sha2(joined("loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars",
    )
