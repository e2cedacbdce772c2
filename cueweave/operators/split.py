"""Splitting bilingual tracks and assigning inputs to merge roles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueweave.functions.text import line_class, strip_html, strip_ws


def split_bilingual(cues: DataFrame, strip_formatting: bool = False) -> DataFrame:
    """``media_id, side, cue_idx, start_ms, end_ms, text`` with side ``cjk`` or ``latin``.

    Lines of neither script go to both sides; a side without lines gets no cue.
    """
    def prepare(line: Column) -> Column:
        t = strip_ws(line)
        return strip_html(t) if strip_formatting else t

    lines = F.filter(F.transform(F.split("text", "\n"), prepare), lambda x: strip_ws(x) != "")
    tagged = F.transform(lines, lambda x: F.struct(line_class(x).alias("k"), x.alias("line")))

    def side(kind: str) -> Column:
        mine = F.filter("_lines", lambda s: s["k"].isin(kind, "other"))
        return F.struct(
            F.lit(kind).alias("side"), F.array_join(F.transform(mine, lambda s: s["line"]), "\n").alias("text"),
            F.size(mine).alias("n"),
        )

    return (
        cues.withColumn("_lines", tagged)
        .select("media_id", "cue_idx", "start_ms", "end_ms", F.explode(F.array(side("cjk"), side("latin"))).alias("s"))
        .where("s.n > 0")
        .select("media_id", "s.side", "cue_idx", "start_ms", "end_ms", "s.text")
    )


def input_roles(inputs: DataFrame) -> DataFrame:
    """``media_id, foreign_input, english_input`` of at most two inputs per media.

    ``inputs`` is ``media_id, input_no, name, lang`` with input_no 0 and 1.
    The first input takes its language's slot (unknown: the foreign one); the
    second takes its own slot if free, else the other one.
    """
    want = F.when(F.col("lang").isin("zh", "ja", "ko", "chinese", "japanese", "korean"), "foreign").when(
        F.col("lang").isin("en", "english"), "english"
    )
    slot = inputs.where("input_no < 2").groupBy("media_id").agg(
        F.max(F.when(F.col("input_no") == 0, F.coalesce(want, F.lit("foreign")))).alias("slot0"),
        F.max(F.when(F.col("input_no") == 0, F.col("name"))).alias("name0"),
        F.max(F.when(F.col("input_no") == 1, F.coalesce(want, F.lit("foreign")))).alias("want1"),
        F.max(F.when(F.col("input_no") == 1, F.col("name"))).alias("name1"),
    )
    slot1 = F.when(F.col("slot0").isNull(), F.col("want1")).when(F.col("slot0") == "foreign", "english").otherwise("foreign")

    def role(kind: str) -> Column:
        return F.when(F.col("slot0") == kind, F.col("name0")).when(slot1 == kind, F.col("name1"))

    return slot.select("media_id", role("foreign").alias("foreign_input"), role("english").alias("english_input"))
