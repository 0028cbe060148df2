"""Text edits: fixes of findings applied to files without conflicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def edit(start: Column, end: Column, replacement: Column) -> Column:
    return F.struct(start.cast("int").alias("start_offset"), end.cast("int").alias("end_offset"), replacement.alias("replacement"))


def insert_before(replacement: Column) -> Column:
    return edit(F.col("start_offset"), F.col("start_offset"), replacement)


def insert_after(replacement: Column) -> Column:
    return edit(F.col("end_offset"), F.col("end_offset"), replacement)


def delete() -> Column:
    return edit(F.col("start_offset"), F.col("end_offset"), F.lit(""))


def replace() -> Column:
    return edit(F.col("start_offset"), F.col("end_offset"), F.col("fix"))


EDIT = "struct<start_offset:int,end_offset:int,replacement:string>"


def order_edits(edits: Column) -> Column:
    """Edits from the last to the first: by start, then end, then text."""
    return F.reverse(F.array_sort(edits))


def choose(edits: Column, size: Column, overlapping: bool = False) -> Column:
    """struct(applied, skipped): edits taken from the last to the first.

    An edit outside the text, or that reaches past the start of one taken before, is skipped with a
    reason. With `overlapping` only offsets are checked.
    """
    none = F.array().cast(f"array<{EDIT}>")
    no_skips = F.array().cast("array<struct<start_offset:int,end_offset:int,replacement:string,reason:string>>")
    start = F.struct(none.alias("applied"), no_skips.alias("skipped"), F.lit(2**31 - 1).alias("limit"))

    def step(acc: Column, e: Column) -> Column:
        wrong = F.coalesce((e["start_offset"] < 0) | (e["end_offset"] < e["start_offset"]) | (e["end_offset"] > size), F.lit(True))
        clash = F.lit(False) if overlapping else e["end_offset"] > acc["limit"]
        reason = F.when(wrong, "offsets outside the text").when(clash, "overlaps a later edit")
        skip = F.struct(e["start_offset"].alias("start_offset"), e["end_offset"].alias("end_offset"), e["replacement"].alias("replacement"), reason.alias("reason"))
        return F.struct(
            F.when(reason.isNull(), F.array_append(acc["applied"], e)).otherwise(acc["applied"]).alias("applied"),
            F.when(reason.isNull(), acc["skipped"]).otherwise(F.array_append(acc["skipped"], skip)).alias("skipped"),
            F.when(reason.isNull(), e["start_offset"]).otherwise(acc["limit"]).alias("limit"),
        )

    return F.aggregate(order_edits(edits), start, step)


def splice(text: Column, applied: Column) -> Column:
    """The text with edits applied from the last to the first; offsets are bytes of UTF-8."""
    raw = F.encode(text, "utf-8")

    def step(acc: Column, e: Column) -> Column:
        head = F.substring(acc, F.lit(1), e["start_offset"])
        tail = F.substring(acc, e["end_offset"] + 1, F.greatest(F.octet_length(acc) - e["end_offset"], F.lit(0)).cast("int"))
        return F.concat(head, F.encode(F.coalesce(e["replacement"], F.lit("")), "utf-8"), tail)

    return F.decode(F.aggregate(applied, raw, step), "utf-8")


def apply_fixes(findings: DataFrame, files: DataFrame, overlapping: bool = False) -> DataFrame:
    """file_id, new_content, n_applied, n_skipped, has_changes, skipped of every file with fixes.

    `findings` has file_id, start_offset, end_offset, fix; null fixes are left out, and equal edits
    count once. All edits of one file are put together, since they depend on each other; a file's
    edits are bounded by its own size. Files without text have no row. Nothing is written back: the
    new text is a column.
    """
    edits = findings.where("fix is not null").select("file_id", replace().alias("e")).groupBy("file_id").agg(F.collect_set("e").alias("edits"))
    both = files.where("content is not null").select("file_id", "content").join(edits, "file_id")
    chosen = both.select("file_id", "content", choose(F.col("edits"), F.octet_length(F.col("content")), overlapping).alias("c"))
    new = splice(F.col("content"), F.col("c.applied"))
    return chosen.select("file_id", new.alias("new_content"), F.size("c.applied").alias("n_applied"), F.size("c.skipped").alias("n_skipped"), (new != F.col("content")).alias("has_changes"), F.col("c.skipped").alias("skipped"))
