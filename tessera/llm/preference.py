"""Preference formatting of chat pairs.

Of a chosen and a rejected conversation the longest common prefix of turns
(same role, same text) is found and rendered once as the prompt; what follows
in each is rendered as its completion, with the spans (code points, end
exclusive) that a loss is taken over: what assistant turns say and the mark
that ends it. Headers, and turns of others, are masked.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n``; ``<|`` inside a role or a
text gets a space between its signs, so that a text can't fake a turn.

Pairs are part of the input. The registered query makes them from all
conversations: those on one first turn (their prompt) are paired by conv_id, 1st
and 2nd, 3rd and 4th, ...; what is left of odd prompts is paired in the order of
the prompts' digests; an odd last one has an empty rejected side.

Plan: turns are gathered by conversation, one row each - a conversation is what
one training example holds - then numbered by a range partitioning of (digest
of the first turn, id) alone, and joined by pair; all joins are of freshly
exchanged tables. A place within a prompt is the global number less the prompt's
first (a partial aggregate), so no task holds a prompt. Prefix and rendering are
array expressions in the JVM.

Defined cases: null text or role is empty text; very long texts and conversations are rendered whole; null turn comes first; null
conv_id is one conversation; turns that repeat a turn number follow each other
by role and text; identical conversations have empty completions; an empty
table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import discard_all, materialise, written
from tessera.llm.sharding import number_rows

START, END = "<|im_start|>", "<|im_end|>"


def gather(turns: DataFrame) -> DataFrame:
    """conv_id and ``turns``, an array of (turn, role, text) in order."""
    safe = lambda c: F.replace(F.coalesce(F.col(c), F.lit("")), F.lit("<|"), F.lit("< |")).alias(c)
    rows = turns.select("conv_id", F.struct("turn", safe("role"), safe("text")).alias("t"))
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))


def common_turns(a: Column, b: Column) -> Column:
    """Number of turns at the start that are the same in both."""
    n = F.least(F.size(a), F.size(b))
    same = F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: (x["role"] == y["role"]) & (x["text"] == y["text"]))
    at = F.array_position(same, F.lit(False))
    return F.when(at == 0, n).otherwise(at - 1).cast("int")


def _turn(t: Column) -> Column:
    return F.concat(F.lit(START), t["role"], F.lit("\n"), t["text"], F.lit(END + "\n"))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _turn), "")


def loss_spans(turns: Column) -> Column:
    """Spans of what assistant turns say within the rendered turns."""
    where = "array<struct<start:int,end:int>>"
    first = F.struct(F.lit(0).alias("at"), F.array().cast(where).alias("spans"))

    def step(done: Column, t: Column) -> Column:
        start = done["at"] + F.char_length(t["role"]) + (len(START) + 1)
        end = start + F.char_length(t["text"]) + len(END)
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        spans = F.when(t["role"] == "assistant", F.concat(done["spans"], span)).otherwise(done["spans"])
        return F.struct((end + 1).alias("at"), spans.alias("spans"))

    return F.aggregate(turns, first, step)["spans"]


def format_pairs(pairs: DataFrame) -> DataFrame:
    """pairs: pair_id, chosen_id, rejected_id, chosen_turns, rejected_turns (as from :func:`gather`)."""
    empty = F.coalesce(F.col("rejected_turns"), F.array().cast(pairs.schema["chosen_turns"].dataType))
    rows = pairs.withColumn("rejected_turns", empty).withColumn("n_common", common_turns(F.col("chosen_turns"), F.col("rejected_turns")))
    rest = lambda c: F.slice(c, F.col("n_common") + 1, F.greatest(F.size(c) - F.col("n_common"), F.lit(0)))
    rows = rows.withColumns({"_c": rest("chosen_turns"), "_r": rest("rejected_turns")})
    return rows.select(
        "pair_id",
        "chosen_id",
        "rejected_id",
        "n_common",
        render(F.slice("chosen_turns", 1, F.col("n_common"))).alias("prompt"),
        render(F.col("_c")).alias("chosen"),
        loss_spans(F.col("_c")).alias("chosen_spans"),
        render(F.col("_r")).alias("rejected"),
        loss_spans(F.col("_r")).alias("rejected_spans"),
    )


def pair_by_prompt(turns: DataFrame) -> DataFrame:
    """pair_id, chosen and rejected conversations (ids and turns); pair_id: the number of the chosen one in the global order."""
    before = written()
    convs = materialise(gather(turns), "conversations")
    first = F.col("turns")[0]
    keys = convs.select("conv_id", F.md5(F.concat_ws("\n", first["role"], first["text"]).cast("binary")).alias("_first"))
    numbered, _ = number_rows(keys, ["_first", "conv_id"])
    prompts = numbered.groupBy("_first").agg(F.min("row_number").alias("_start"), F.count("*").alias("_n"))
    ranked = numbered.join(prompts, "_first").withColumn("_rank", F.col("row_number") - F.col("_start"))
    ranked = materialise(ranked.withColumn("_left", (F.col("_n") % 2 == 1) & (F.col("_rank") == F.col("_n") - 1)), "ranked")
    inside = ranked.filter(~F.col("_left")).select("conv_id", F.expr("row_number - _rank % 2").alias("pair_id"), F.expr("_rank % 2").alias("side"))
    rest, _ = number_rows(ranked.filter("_left").select("conv_id", F.col("row_number").alias("_place")), ["_place"])
    rest = rest.select("conv_id", "_place", F.expr("row_number div 2").alias("_pair"), F.expr("row_number % 2").alias("side"))
    heads = rest.filter("side = 0").select("_pair", F.col("_place").alias("pair_id"))
    paired = inside.union(rest.join(heads, "_pair").select("conv_id", "pair_id", "side")).withColumnRenamed("conv_id", "_id")
    placed = materialise(convs.join(paired, F.col("conv_id").eqNullSafe(F.col("_id"))).select("conv_id", "turns", "pair_id", "side"), "placed")
    discard_all(but=before | {placed._shared_path})
    chosen = placed.filter("side = 0").select("pair_id", F.col("conv_id").alias("chosen_id"), F.col("turns").alias("chosen_turns"))
    rejected = placed.filter("side = 1").select("pair_id", F.col("conv_id").alias("rejected_id"), F.col("turns").alias("rejected_turns"))
    return chosen.join(rejected, "pair_id", "left")


def op1_preference_pairs(turns: DataFrame) -> DataFrame:
    """All conversations in pairs; spans as text (``start-end`` joined by commas) and digests beside the rendered texts."""
    out = format_pairs(pair_by_prompt(turns))
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["start"], s["end"])), ",")
    return out.withColumns({"chosen_spans": text("chosen_spans"), "rejected_spans": text("rejected_spans")})


OP1_SQL = r"""
WITH s AS (SELECT conv_id, turn, replace(coalesce(role, ''), '<|', '< |') AS role, replace(coalesce(text, ''), '<|', '< |') AS text FROM conversations),
t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM s),
g AS (SELECT conv_id, md5(role || chr(10) || text) AS digest FROM t WHERE i = 1),
h AS (SELECT *, row_number() OVER (ORDER BY digest, conv_id NULLS FIRST) - 1 AS rn, row_number() OVER (PARTITION BY digest ORDER BY conv_id NULLS FIRST) - 1 AS k, count(*) OVER (PARTITION BY digest) AS m FROM g),
e AS (SELECT *, m % 2 = 1 AND k = m - 1 AS odd FROM h),
w AS (SELECT *, row_number() OVER (PARTITION BY odd ORDER BY rn) - 1 AS j FROM e),
f AS (SELECT conv_id, CASE WHEN odd THEN min(rn) OVER (PARTITION BY odd, j // 2) ELSE rn - k % 2 END AS pair_id, CASE WHEN odd THEN j % 2 ELSE k % 2 END AS side FROM w),
p AS (SELECT t.*, f.pair_id, f.side FROM t JOIN f ON t.conv_id IS NOT DISTINCT FROM f.conv_id),
n AS (SELECT pair_id, max(conv_id) FILTER (side = 0) AS chosen_id, max(conv_id) FILTER (side = 1) AS rejected_id,
             least(count(*) FILTER (side = 0), count(*) FILTER (side = 1)) AS m FROM p GROUP BY pair_id),
d AS (SELECT a.pair_id, min(a.i) AS first_other FROM p a JOIN p b ON a.pair_id = b.pair_id AND a.i = b.i AND a.side = 0 AND b.side = 1
      WHERE a.role <> b.role OR a.text <> b.text GROUP BY a.pair_id),
c AS (SELECT n.*, coalesce(first_other - 1, m) AS n_common FROM n LEFT JOIN d USING (pair_id)),
r AS (SELECT p.pair_id, p.side, p.i, p.role, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS x, c.n_common, i > n_common AS own FROM p JOIN c USING (pair_id)),
o AS (SELECT *, coalesce(sum(length(x)) OVER (PARTITION BY pair_id, side, own ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at0 FROM r),
q AS (SELECT *, CAST(at0 + 13 + length(role) AS VARCHAR) || '-' || CAST(at0 + length(x) - 1 AS VARCHAR) AS span FROM o)
SELECT c.pair_id, c.chosen_id, c.rejected_id, c.n_common,
  coalesce(string_agg(x, '' ORDER BY i) FILTER (side = 0 AND NOT own), '') AS prompt,
  coalesce(string_agg(x, '' ORDER BY i) FILTER (side = 0 AND own), '') AS chosen,
  coalesce(string_agg(span, ',' ORDER BY i) FILTER (side = 0 AND own AND role = 'assistant'), '') AS chosen_spans,
  coalesce(string_agg(x, '' ORDER BY i) FILTER (side = 1 AND own), '') AS rejected,
  coalesce(string_agg(span, ',' ORDER BY i) FILTER (side = 1 AND own AND role = 'assistant'), '') AS rejected_spans
FROM c JOIN q USING (pair_id) GROUP BY ALL
"""
