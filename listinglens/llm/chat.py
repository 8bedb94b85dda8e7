"""Preference formatting of conversation pairs. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How a turn is written, and the role whose turns are trained on.
OPEN, CLOSE, END, TRAINED = "<|", "|>\n", "\n<|end|>\n", "assistant"


def paired_turns(conversations: DataFrame) -> DataFrame:
    """Rows (pair_id, side, turn, role, text): neighbouring conversations 2k and 2k + 1 as chosen and rejected."""
    return conversations.where("conv_id is not null").select(
        F.floor(F.col("conv_id") / 2).cast("long").alias("pair_id"),
        F.when(F.pmod(F.col("conv_id"), F.lit(2)) == 0, "chosen").otherwise("rejected").alias("side"),
        "turn",
        "role",
        "text",
    )


def _rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit(CLOSE), text, F.lit(END))


def _written(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: _rendered(t["role"], t["text"])), "")


def _masked(turns: Column, before: Column) -> Column:
    """start-end of the text of each trained turn in the written turns, in code points, comma-joined.

    Each turn knows where it ends in its whole conversation; before is where the written turns begin there.
    """

    def span(t: Column) -> Column:
        end = t["at"] - before - len(END)
        return F.concat_ws("-", (end - F.length(t["text"])).cast("string"), end.cast("string"))

    return F.array_join(F.transform(F.filter(turns, lambda t: t["role"] == TRAINED), span), ",")


def _side(turns: Column, side: str) -> Column:
    """The turns of one side, without those that it lacks."""
    return F.transform(F.filter(turns, lambda t: t[side].isNotNull()), lambda t: t[side])


def format_preferences(turns: DataFrame) -> DataFrame:
    """Rows (pair_id, n_prompt_turns, prompt, chosen, rejected, chosen_mask, rejected_mask), one per pair with both sides.

    turns has (pair_id, side, turn, role, text). The prompt is the longest run
    of first turns that both sides share, role and text alike; it is written
    once. The completions are the turns after it; a mask lists the spans of
    the completion that are trained on, those of assistant text. Null roles
    and texts count as empty; rows that repeat a turn of one side count once,
    the least by role and text if they differ; rows without a pair, side or
    turn are left out, and pairs that lack a side give no row; other columns are
    ignored.
    """
    clean = turns.where("pair_id is not null and side in ('chosen', 'rejected') and turn is not null").select(
        "pair_id", "side", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    said = F.struct("role", "text")
    by_turn = clean.groupBy("pair_id", "turn").agg(
        F.min(F.when(F.col("side") == "chosen", said)).alias("c"), F.min(F.when(F.col("side") == "rejected", said)).alias("r")
    )
    # where each turn ends in its side's conversation: running sums of one sort, not a fold that copies what it has gathered
    so_far = Window.partitionBy("pair_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = {f"{s}_at": F.sum(F.coalesce(F.length(_rendered(F.col(f"{s}.role"), F.col(f"{s}.text"))), F.lit(0))).over(so_far) for s in "cr"}
    placed = by_turn.withColumns(ends)
    sides = [F.when(F.col(s).isNotNull(), F.struct(f"{s}.role", f"{s}.text", F.col(f"{s}_at").alias("at"))).alias(s) for s in "cr"]
    packed = placed.groupBy("pair_id").agg(
        F.min(F.when(~F.col("c").eqNullSafe(F.col("r")), F.col("turn"))).alias("split"),
        F.array_sort(F.collect_list(F.struct("turn", *sides))).alias("turns"),
        F.count("c").alias("n_c"),
        F.count("r").alias("n_r"),
    )
    shared = F.filter("turns", lambda t: F.col("split").isNull() | (t["turn"] < F.col("split")))
    later = F.coalesce(F.filter("turns", lambda t: t["turn"] >= F.col("split")), F.slice("turns", 1, 0))
    cut = packed.where("n_c > 0 and n_r > 0").select(
        "pair_id",
        F.transform(shared, lambda t: t["c"]).alias("p"),
        _side(later, "c").alias("c"),
        _side(later, "r").alias("r"),
    )
    cut = cut.withColumn("before", F.coalesce(F.try_element_at("p", F.lit(-1))["at"], F.lit(0)))
    return cut.select(
        "pair_id",
        F.size("p").cast("long").alias("n_prompt_turns"),
        _written(F.col("p")).alias("prompt"),
        _written(F.col("c")).alias("chosen"),
        _written(F.col("r")).alias("rejected"),
        _masked(F.col("c"), F.col("before")).alias("chosen_mask"),
        _masked(F.col("r"), F.col("before")).alias("rejected_mask"),
    )


ORACLE_SQL = """
WITH t AS (
  SELECT conv_id // 2 AS pair_id, conv_id % 2 AS side, turn, min({'role': coalesce(role, ''), 'text': coalesce(text, '')}) AS m
  FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL),
w AS (
  SELECT pair_id, side, turn, m.role AS role, m.text AS text,
         '<|' || m.role || '|>' || chr(10) || m.text || chr(10) || '<|end|>' || chr(10) AS piece FROM t),
both_sides AS (SELECT pair_id FROM w GROUP BY pair_id HAVING count(DISTINCT side) = 2),
cut AS (
  SELECT pair_id, min(CASE WHEN a.piece IS DISTINCT FROM b.piece THEN turn END) AS split
  FROM (SELECT * FROM w WHERE side = 0) a FULL JOIN (SELECT * FROM w WHERE side = 1) b USING (pair_id, turn)
  WHERE pair_id IN (SELECT pair_id FROM both_sides) GROUP BY pair_id),
p AS (
  SELECT cut.pair_id, count(turn)::BIGINT AS n_prompt_turns, coalesce(string_agg(piece, '' ORDER BY turn), '') AS prompt
  FROM cut LEFT JOIN w ON w.pair_id = cut.pair_id AND side = 0 AND (split IS NULL OR turn < split) GROUP BY cut.pair_id),
c AS (
  SELECT w.*, coalesce(sum(length(piece)) OVER (PARTITION BY w.pair_id, side ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT
         + length(role) + 5 AS begin_at
  FROM w JOIN cut USING (pair_id) WHERE turn >= split),
s AS (
  SELECT pair_id, side, string_agg(piece, '' ORDER BY turn) AS body,
         coalesce(string_agg(begin_at || '-' || (begin_at + length(text)), ',' ORDER BY turn) FILTER (role = 'assistant'), '') AS mask
  FROM c GROUP BY pair_id, side)
SELECT p.pair_id, n_prompt_turns, prompt, coalesce(a.body, '') AS chosen, coalesce(b.body, '') AS rejected,
       coalesce(a.mask, '') AS chosen_mask, coalesce(b.mask, '') AS rejected_mask
FROM p LEFT JOIN s a ON a.pair_id = p.pair_id AND a.side = 0 LEFT JOIN s b ON b.pair_id = p.pair_id AND b.side = 1
"""
