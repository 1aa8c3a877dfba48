"""Layout operators from DataFrame to DataFrame, keyed by (doc_id, page). Rules of whole pages are steps over Arrow batches
(``steps``); ``over_pages`` runs several of them on a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame

from . import steps
from .pages import PAGE, over_pages  # noqa: F401 - PAGE is used with the operators
from .steps import STRIPS  # noqa: F401


def dedupe_letters(glyphs: DataFrame) -> DataFrame:
    """Of equal letters at the same place the first by row, k and i stays."""
    return over_pages(glyphs, steps.dedupe_letters)


def edge_table(words: DataFrame, side: str, least: int = 4) -> DataFrame:
    """Places (tenths) where at least ``least`` words of a page have their left or right side or middle."""
    return over_pages(words, steps.edge_table(side, least))


def edge_flags(words: DataFrame) -> DataFrame:
    """left_edge and right_edge of each word; a word that is aligned by its middle has both."""
    return over_pages(words, steps.edge_flags)


def words_from_letters(glyphs: DataFrame) -> DataFrame:
    """Adjoining letters of a line as words: a gap of a hundredth of the size or more begins a new one. Bottoms may differ by
    less than a tenth of the size."""
    return over_pages(glyphs, steps.words_from_letters)


def lines_from_words(flagged: DataFrame) -> DataFrame:
    """Words of a line (bottoms less than 0.7 of the size apart) joined from left to right while they do not overlap, are at
    most half the size apart, and no edge forbids it: a right or middle edge of the left word, a left edge of the right one.
    ``blocks.greedy_lines`` has the rule that decides where lines overlap."""
    return over_pages(flagged, steps.lines_from_words)


def upper_median_size(words: DataFrame) -> DataFrame:
    """The width at place n / 2 of the sorted widths of a page's words."""
    return over_pages(words, steps.upper_median_size)


def page_bounds(words: DataFrame, width: int = 612, height: int = 792) -> DataFrame:
    """Page boxes, grown by ten where text sticks out."""
    return over_pages(words, steps.page_bounds(width, height))


def strip_gaps(words: DataFrame, width: int = 612, height: int = 792) -> DataFrame:
    """White space of each of 200 vertical strips that have words: strip, top, bottom. Words are dealt to strips by number,
    not compared."""
    return over_pages(words, steps.strip_gaps(width, height))


def strip_islands(gaps: DataFrame) -> DataFrame:
    """Runs of neighbouring strips with the same white space as one box."""
    return over_pages(gaps, steps.strip_islands)


def engulfed(boxes: DataFrame, slack: float = 0.1) -> DataFrame:
    """Boxes that no other box of the page holds within itself (an equal, earlier one does)."""
    return over_pages(boxes, steps.engulfed(slack))


def reading_order(words: DataFrame) -> DataFrame:
    """The place of each word on its page, from 1: from the top, then from the left."""
    return over_pages(words, steps.reading_order)


def indent_breaks(lines: DataFrame) -> DataFrame:
    """Lines that stand below and to the right of the line before: paragraphs begin there."""
    return over_pages(lines, steps.indent_breaks)


def paste_lines(lines: DataFrame) -> DataFrame:
    """The text of each page in reading order, hyphenated lines joined."""
    return over_pages(lines, steps.paste_lines)
