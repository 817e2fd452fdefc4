"""Line dedup by the number of distinct sites a line is on.

A line is known by two 64-bit hashes of its text without outer blanks. For every line a
HyperLogLog sketch of its sites is built and merged by aggregation. Lines whose estimate
is clearly above ``min_sites`` are boilerplate; lines whose estimate is within ``BAND``
of it get an exact distinct count. A boilerplate line stays where it comes first (least
id, then least position) and goes elsewhere.

Boilerplate lines meet the lines of all texts in a join that is broadcast while they are
few (``few_join``) and salted beyond. Only texts that lose lines are shuffled, and lines
are taken out by array functions.

Defined results: blank lines always stay; a null site counts for no line; a null
text stays null with no lines; rows without an id never hold the copy that stays;
repeated rows are treated alike; an empty table gives no rows. Other columns are
carried along by ``remove_boilerplate`` (those named as in ``out_cols`` are replaced)
and ignored by the rest, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtally.llm.common import cut, few_join, perhaps_in

MIN_SITES = 10
BAND = 0.25  # far above the sketch's error (1.6 %)
LG_K = 12
ROW, LINE = ["row", "row2"], ["h", "h2"]


def _row_keys(id_col: str, text_col: str) -> list[Column]:
    return [F.xxhash64(id_col, text_col).alias("row"), F.xxhash64(F.lit(1), F.col(text_col), F.col(id_col)).alias("row2")]


def line_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """row, row2 (hashes of id and text), id, site, pos, h, h2: a row per line that
    isn't blank."""
    lines = docs.select(
        *_row_keys(id_col, text_col), F.col(id_col).alias("id"), F.col(site_col).cast("string").alias("site"),
        F.posexplode(F.split(text_col, "\n")).alias("pos", "line"),
    )
    line = F.trim("line")
    return lines.where(line != "").select(*ROW, "id", "site", "pos", F.xxhash64(line).alias("h"), F.xxhash64(F.lit(1), line).alias("h2"))


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """h, h2, keep_id, keep_pos: lines on ``min_sites`` or more distinct sites."""
    sketched = lines.groupBy(*LINE).agg(
        F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch"),
        F.min(F.when(F.col("id").isNotNull(), F.struct("id", "pos"))).alias("first"),
    )
    spread = sketched.select(*LINE, F.hll_sketch_estimate("sketch").alias("sites"), F.col("first.id").alias("keep_id"), F.col("first.pos").alias("keep_pos"))
    likely = cut(spread.where(F.col("sites") >= min_sites * (1 - BAND)))
    sure = F.col("sites") > min_sites * (1 + BAND)
    near = likely.where(~sure).select(*LINE)
    exact = few_join(lines.select(*LINE, "site"), near, LINE, "site").distinct().groupBy(*LINE).agg(F.count("site").alias("n"))
    confirmed = exact.where(F.col("n") >= min_sites).select(*LINE)
    return likely.where(sure).unionByName(likely.where(~sure).join(confirmed, LINE, "left_semi")).select(*LINE, "keep_id", "keep_pos")


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """row, row2, removed: the positions to remove, in order, in each text that loses
    lines."""
    lines = line_rows(docs, id_col, text_col, site_col)
    found = few_join(lines.drop("site"), cut(boilerplate(lines, min_sites)), LINE, "row")
    stays = F.col("id").eqNullSafe(F.col("keep_id")) & F.col("pos").eqNullSafe(F.col("keep_pos")) & F.col("id").isNotNull()
    return found.where(~stays).groupBy(*ROW).agg(F.sort_array(F.collect_set("pos")).alias("removed"))


def without_lines(text: Column, removed: Column) -> Column:
    """``text`` without the lines at the positions in ``removed`` (in order), in time
    that grows with their number: a mask of what stays is laid out between them."""
    before = lambda i: F.coalesce(F.get(removed, i - 1), F.lit(-1))
    mask = F.flatten(F.transform(removed, lambda p, i: F.concat(F.array_repeat(F.lit(True), p - before(i) - 1), F.array(F.lit(False)))))
    return F.array_join(F.filter(F.split(text, "\n"), lambda x, i: F.coalesce(F.get(mask, i), F.lit(True))), "\n")


def remove_boilerplate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES, out_cols: tuple[str, str] = ("n_lines", "n_removed")) -> DataFrame:
    """``docs`` with the lines removed from ``text_col``, and two counts per row."""
    gone = cut(removals(docs, id_col, text_col, site_col, min_sites))
    rows = docs.select(F.struct("*").alias("doc"), *_row_keys(id_col, text_col))
    perhaps = perhaps_in(rows, gone, "row")
    same = perhaps.where("NOT perhaps").select("doc", F.lit(None).cast("array<int>").alias("removed"))
    # The order of lines is that of the text, so a text is one row from here to its end.
    fewer = perhaps.where("perhaps").join(gone, ROW, "left").select("doc", "removed")
    every = same.unionByName(fewer)
    text = F.col("doc").getField(text_col)
    left = F.when(F.col("removed").isNull(), text).otherwise(without_lines(text, F.col("removed")))
    n_lines = F.when(text.isNull(), 0).otherwise(F.size(F.split(text, "\n"))).cast("long")
    kept = [left.alias(c) if c == text_col else F.col("doc").getField(c).alias(c) for c in docs.columns if c not in out_cols]
    return every.select(*kept, n_lines.alias(out_cols[0]), F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias(out_cols[1]))
