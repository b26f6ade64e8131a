"""Operator 1: multi-party chat formatting by perspective rotation. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint

#: A dialogue of up to so many turns is one row per speaker; longer ones come in parts of so many.
MAX_TURNS = 1024
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _safe(c: Column) -> Column:
    """Text that can't forge a marker: a zero-width space parts `<|`."""
    return F.replace(c, F.lit("<|"), F.lit("<​|"))


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def _ranked(large: DataFrame) -> DataFrame:
    """Rows of long dialogues with the number of the part that each one's rank puts it in.

    The rows are range-sorted over all tasks into files in the shared folder; a row's rank is its
    place in its file, plus what is before that file, less the dialogue's first place. No task holds a dialogue.
    """
    order = ["conv_id", "turn", "role", "text"]
    sorted_rows = checkpoint(large.repartitionByRange(*order).sortWithinPartitions(*order))
    f = sorted_rows.select(*order, F.col("_metadata.file_path").alias("_f"), F.col("_metadata.row_index").alias("_i"))
    files = f.groupBy("_f").agg(F.count("*").alias("n"))
    before = files.select("_f", (F.sum("n").over(Window.orderBy("_f")) - F.col("n")).alias("before"))  # a row per file
    f = f.join(F.broadcast(before), "_f").withColumn("place", F.col("before") + F.col("_i"))
    first = f.groupBy("conv_id").agg(F.min("place").alias("first")).withColumnRenamed("conv_id", "_c")
    j = f.join(first, _same("conv_id", "_c"))
    return j.select(*order, F.floor((F.col("place") - F.col("first")) / MAX_TURNS).alias("part"))


def rotate(turns: DataFrame, system_role: str = "system") -> DataFrame:
    """One row per (conv_id, speaker, part): the dialogue as seen with that speaker as assistant.

    turns: conv_id, turn, role, text. Every distinct role of a conversation but system_role is a
    speaker in turn: its turns get the header `assistant`, system turns `system`, all others
    `user name=<role>`. text holds the turns in order, mask the [start, end) code-point
    spans of the speaker's own words with their end marker, the tokens to train on.

    Turns are ordered by (turn, role, text); repeated rows are turns of their own. A null turn counts
    as -1, a null text as empty; a null role is rendered as `user` without a name and is no speaker;
    a null conv_id is a conversation. A conversation whose only roles are system or null has no rows,
    an empty table none. Markers in texts are broken up by a zero-width space. Other columns are not
    read. A dialogue is one row (part 0) per speaker; only one of more than MAX_TURNS turns is cut,
    every MAX_TURNS turns in order, and its later parts begin with the system turns of part 0, not
    counted in n_turns.
    """
    t = turns.select(F.col("conv_id").alias("conv_id"), F.coalesce(F.col("turn").cast("long"), F.lit(-1).cast("long")).alias("turn"), F.col("role").cast("string").alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    long = t.groupBy("conv_id").agg(F.count("*").alias("n")).where(F.col("n") > MAX_TURNS).select(F.col("conv_id").alias("_c"), F.lit(True).alias("long"))
    some = not long.isEmpty()
    all_at = F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns")
    none = F.array().cast("array<struct<turn:bigint,role:string,text:string>>")
    marked = t.join(long, _same("conv_id", "_c"), "left").drop("_c") if some else t
    parts = (marked.where("long is null") if some else t).groupBy("conv_id").agg(all_at).select("conv_id", F.lit(0).cast("long").alias("part"), "turns", none.alias("again"))
    if some:
        cut = checkpoint(_ranked(marked.where("long").drop("long")).groupBy("conv_id", "part").agg(all_at))
        system = cut.where("part = 0").select(F.col("conv_id").alias("_c"), F.filter("turns", lambda x: x["role"] == system_role).alias("again"))
        cut = cut.join(system, _same("conv_id", "_c")).select("conv_id", "part", "turns", F.when(F.col("part") > 0, F.col("again")).otherwise(none).alias("again"))
        parts = parts.unionAll(cut)
    speakers = t.where(F.col("role").isNotNull() & (F.col("role") != system_role)).select(F.col("conv_id").alias("_c"), F.col("role").alias("speaker")).distinct()
    j = parts.join(speakers, _same("conv_id", "_c")).drop("_c")

    def header(x: Column) -> Column:
        name = F.when(x["role"] == F.col("speaker"), F.lit("assistant")).when(x["role"] == system_role, F.lit(system_role)).when(x["role"].isNull(), F.lit("user")).otherwise(F.concat(F.lit("user name="), _safe(x["role"])))
        return F.concat(F.lit(OPEN), name, F.lit("\n"))

    pieces = F.transform(F.concat("again", "turns"), lambda x: F.struct(header(x).alias("head"), F.concat(_safe(x["text"]), F.lit(CLOSE)).alias("body"), F.coalesce(x["role"] == F.col("speaker"), F.lit(False)).alias("own")))
    j = j.withColumn("pieces", pieces)
    span = "array<struct<start:bigint,end:bigint>>"
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(span).alias("spans"))

    def step(a: Column, x: Column) -> Column:
        begin = a["at"] + F.length(x["head"])
        end = begin + F.length(x["body"])
        own = F.array(F.struct(begin.cast("long").alias("start"), end.cast("long").alias("end")))
        return F.struct((end + 1).cast("long").alias("at"), F.when(x["own"], F.concat(a["spans"], own)).otherwise(a["spans"]).alias("spans"))

    return j.select("conv_id", "speaker", "part", F.size("turns").cast("long").alias("n_turns"), F.array_join(F.transform("pieces", lambda x: F.concat(x["head"], x["body"], F.lit("\n"))), "").alias("text"), F.aggregate("pieces", start, step, lambda a: a["spans"]).alias("mask"))
