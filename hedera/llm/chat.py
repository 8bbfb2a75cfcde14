"""Chat formatting: conversations that are the start of longer ones go, the rest is rendered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

_LOW = (1 << 40) - 1


def _turn_hash(seed: int) -> Column:
    """40 bits of (position, role, text), nulls apart from empty strings."""
    return F.xxhash64(F.lit(seed), F.col("at"), F.col("role").isNull(), F.coalesce("role", F.lit("")), F.col("text").isNull(), F.coalesce("text", F.lit(""))).bitwiseAND(F.lit(_LOW))


def _hashed(turns: DataFrame, piece: int) -> DataFrame:
    """Each turn with its position in its conversation (at, from 0) and rolling hashes a, b of the turns up to it.

    Turns are summed in pieces of `piece` turn numbers, and pieces in turn, so that no conversation need be in one task.
    """
    part = F.floor(F.coalesce(F.col("turn"), F.lit(0)) / piece)
    t = turns.withColumn("part", part)
    order = [F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first()]
    inside = Window.partitionBy("conv_id", "part").orderBy(*order)
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = t.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n")).withColumn("off", F.coalesce(F.sum("n").over(before), F.lit(0)))
    null_safe = lambda a, b: a["conv_id"].eqNullSafe(b["conv_id"]) & (a["part"] == b["part"])
    t = t.withColumn("rank", F.row_number().over(inside))
    t = t.join(sizes, null_safe(t, sizes)).select(t["conv_id"], t["part"], t["turn"], t["role"], t["text"], (F.col("off") + F.col("rank") - 1).alias("at"))
    t = written(t.withColumn("x", _turn_hash(1)).withColumn("y", _turn_hash(2)))
    run = Window.partitionBy("conv_id", "part").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    sums = t.groupBy("conv_id", "part").agg(F.sum("x").alias("sx"), F.sum("y").alias("sy"))
    sums = sums.select("conv_id", "part", F.coalesce(F.sum("sx").over(before), F.lit(0)).alias("ox"), F.coalesce(F.sum("sy").over(before), F.lit(0)).alias("oy"))
    t = t.withColumn("rx", F.sum("x").over(run)).withColumn("ry", F.sum("y").over(run))
    return t.join(sums, null_safe(t, sums)).select(t["conv_id"], t["part"], "at", "role", "text", (F.col("rx") + F.col("ox")).alias("a"), (F.col("ry") + F.col("oy")).alias("b"))


def collapsed(turns: DataFrame, piece: int = 1024) -> tuple[DataFrame, DataFrame]:
    """(turns with position and rolling hashes, conversations that stay with n_turns and n_same).

    A conversation goes if its turns are the first turns of a longer one; of equal conversations the smallest conv_id stays
    and n_same counts them. Prefixes and whole conversations meet as distinct hashes, never as rows of a hot first turn.
    """
    h = written(_hashed(turns.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text"), piece))
    last = h.groupBy("conv_id").agg(F.max(F.struct("at", "a", "b")).alias("l")).select("conv_id", (F.col("l.at") + 1).alias("n"), F.col("l.a").alias("a"), F.col("l.b").alias("b"))
    last = written(last)
    one = last.groupBy("n", "a", "b").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_same"))
    ends = last.select("conv_id", F.col("n").alias("m"))
    starts = h.join(ends, h["conv_id"].eqNullSafe(ends["conv_id"])).where("at + 1 < m").select((F.col("at") + 1).alias("n"), "a", "b").distinct()
    return h, one.join(starts, ["n", "a", "b"], "left_anti").select("conv_id", F.col("n").alias("n_turns"), "n_same")


def rendered(turns: DataFrame, piece: int = 1024) -> DataFrame:
    """Maximal conversations as text: conv_id, part, n_turns, n_same, text.

    turns: conv_id, turn, role, text; other columns are ignored. A turn is rendered as "<|role|>", a newline, its text and
    a newline; a null role is "unknown", a null text is empty. Turns stand in order of turn (null first), equal turns by
    role and text. A conversation is one row, or one row for each `piece` turn numbers if it is longer, so no row grows
    without bound. Rows with a null conv_id are one conversation. Repeated rows are turns of their own; an empty table
    gives an empty result.
    """
    h, keep = collapsed(turns, piece)
    keep = keep.withColumnRenamed("conv_id", "_id")
    t = h.join(keep, F.col("conv_id").eqNullSafe(F.col("_id")))
    line = F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"), F.coalesce("text", F.lit("")), F.lit("\n"))
    parts = t.groupBy("conv_id", "part", "n_turns", "n_same").agg(F.array_sort(F.collect_list(F.struct("at", line.alias("line")))).alias("ls"))
    return parts.select("conv_id", "part", "n_turns", "n_same", F.array_join(F.transform("ls", lambda x: x["line"]), "").alias("text"))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rendered(table(spark, sf_dir, "conversations"))
    return r.select("conv_id", F.col("part").cast("long").alias("part"), "n_turns", "n_same", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))


OP5_SQL = """
WITH t AS (
  SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS k,
         '<|' || coalesce(role, 'unknown') || '|>' || chr(10) || coalesce(text, '') || chr(10) AS line,
         coalesce('r' || role, '') || chr(1) || coalesce('t' || text, '') || chr(2) AS raw
  FROM conversations
), p AS (
  SELECT *, string_agg(raw, '') OVER (PARTITION BY conv_id ORDER BY k) AS pre, count(*) OVER (PARTITION BY conv_id) AS n FROM t
), whole AS (
  SELECT pre, min(conv_id) AS conv_id, count(*) AS n_same, any_value(n) AS n_turns FROM p WHERE k = n GROUP BY pre
), keep AS (
  SELECT * FROM whole WHERE pre NOT IN (SELECT pre FROM p WHERE k < n)
)
SELECT keep.conv_id, CAST(0 AS BIGINT) AS part, n_turns, n_same, sum(length(t.line))::BIGINT AS n_chars, md5(string_agg(t.line, '' ORDER BY t.k)) AS text_md5
FROM keep JOIN t ON t.conv_id = keep.conv_id GROUP BY keep.conv_id, n_turns, n_same
"""
