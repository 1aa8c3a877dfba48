"""Whole documents: what a user asks of PDF files, as relations keyed by doc_id and page.

``files`` is a DataFrame of doc_id and content (``sources.pdf_files`` gives paths and content; ``numbered`` gives them ids)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import operators as op
from .operators import blocks, steps
from .operators.lookups import midpoints
from .pdf import relations as rel
from .sources import pdf_files

PAGE = ["doc_id", "page"]
#: The frame that pages of any size are laid out in.
WIDTH, HEIGHT = 612, 792


def numbered(files: DataFrame) -> DataFrame:
    """doc_id (a hash of the path), path, content."""
    return files.select(F.xxhash64("path").alias("doc_id"), "path", "content")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    return numbered(pdf_files(spark, path))


def words(files: DataFrame, pages: list[int] | None = None) -> DataFrame:
    """Words with their fonts and edge flags. Of letters that stand twice at a place one counts."""
    letters = rel.glyphs(files, pages).withColumn("row", F.lit(0)).withColumn("k", F.lit(0)).withColumn("i", F.col("seq"))
    found = op.over_pages(letters, steps.dedupe_letters, steps.words_from_letters, steps.edge_flags)
    return found.withColumn("row", F.lit(0)).withColumn("k", F.lit(0))


def page_frames(files: DataFrame, elements: DataFrame) -> DataFrame:
    """left, bottom, right, top of each page, a side moved by ten where text sticks out of it."""
    text = (
        elements.groupBy(*PAGE)
        .agg(F.min("left").alias("l"), F.min("bottom").alias("b"), F.max("right").alias("r"), F.max(F.col("bottom") + F.col("size")).alias("t"))
    )
    boxes = rel.page_boxes(files).withColumn("page", F.col("page").cast("long")).join(text, PAGE)
    grown = lambda c, out, by: (F.col(c) + F.when(out, by).otherwise(0)).alias(c)
    return boxes.select(*PAGE, grown("left", F.col("l") < F.col("left"), -10), grown("bottom", F.col("b") < F.col("bottom"), -10), grown("right", F.col("r") > F.col("right"), 10), grown("top", F.col("t") > F.col("top"), 10))


def _framed(elements: DataFrame, frames: DataFrame) -> DataFrame:
    """Elements with their pages stretched to the frame; the ratio of gaps to sizes stays."""
    f = frames.select(*PAGE, F.col("left").alias("x0"), F.col("bottom").alias("y0"), (WIDTH / (F.col("right") - F.col("left"))).alias("fx"), (HEIGHT / (F.col("top") - F.col("bottom"))).alias("fy"))
    x = lambda c: ((F.col(c) - F.col("x0")) * F.col("fx")).alias(c)
    y = lambda c: ((F.col(c) - F.col("y0")) * F.col("fy")).alias(c)
    others = [c for c in elements.columns if c not in ("left", "right", "bottom", "top", "size", *PAGE)]
    return elements.join(f, PAGE).select(*PAGE, *others, x("left"), x("right"), y("bottom"), y("top"), (F.col("size") * F.col("fy")).alias("size"))


def boxes(files: DataFrame, pages: list[int] | None = None) -> DataFrame:
    """xmin, ymin, xmax, ymax, box of the text blocks of each page."""
    found = words(files, pages)
    frames = page_frames(files, found)
    inside = blocks.text_boxes(_framed(found, frames), WIDTH, HEIGHT)
    f = frames.select(*PAGE, F.col("left").alias("x0"), F.col("bottom").alias("y0"), ((F.col("right") - F.col("left")) / WIDTH).alias("fx"), ((F.col("top") - F.col("bottom")) / HEIGHT).alias("fy"))
    side = lambda c: (F.col(c) * F.col("fx" if c[0] == "x" else "fy") + F.col("x0" if c[0] == "x" else "y0")).alias(c)
    return inside.join(f, PAGE).select(*PAGE, side("xmin"), side("ymin"), side("xmax"), side("ymax"), "box")


def _rounded(rows: DataFrame, *more: str) -> DataFrame:
    one = [F.round(c, 1).alias(c) for c in ("left", "right", "bottom")]
    return rows.select(*PAGE, "text", *one, "top", *more, F.round("size", 1).alias("size")).orderBy(*PAGE, F.desc("bottom"), "left")


def page_text(files: DataFrame, pages: list[int] | None = None, atomic: bool = False) -> DataFrame:
    """Text blocks of the given pages (all if None), or with ``atomic`` their letters, from the top, then from the left."""
    if atomic:
        return _rounded(rel.glyphs(files, pages), "font")
    found = words(files, pages)
    lines = blocks.greedy_lines(found)
    return _rounded(blocks.text_blocks(lines, boxes(files, pages)))


def document_text(files: DataFrame) -> DataFrame:
    """Lines of all pages."""
    return _rounded(blocks.greedy_lines(words(files)), "font")


def plotted(files: DataFrame, pages: list[int] | None = None, atomic: bool = False) -> DataFrame:
    """Text elements with the places to plot them at: their middles."""
    return midpoints(page_text(files, pages, atomic), WIDTH, HEIGHT)
