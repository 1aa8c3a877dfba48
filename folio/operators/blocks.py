"""From white space to text blocks: boxes of white space, their outline, the boxes that it encloses, and the text in them.

Coordinates along x are strip numbers (0 to 200) until a result leaves, so that neighbouring
boxes meet exactly. All is keyed by (doc_id, page)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import PAGE, steps
from .pages import over_pages


def white_boxes(words: DataFrame, width: int = 612, height: int = 792, least: float = 0.3) -> DataFrame:
    """left, right (strip numbers), top, bottom of the white boxes that touch the page's edge or are at least ``least`` of
    the page's upper median size tall. A strip without words is white from top to bottom."""
    return over_pages(words, steps.white_boxes(width, height, least))


def vertices(boxes: DataFrame) -> DataFrame:
    """x, y, flags of the different corners of boxes: which of the four quarters around each is white."""
    return over_pages(boxes, steps.vertices)


def corners(points: DataFrame) -> DataFrame:
    """The vertices where an outline turns, with the directions into (``ins``) and out of (``outs``) them. Those with all or
    no, or two neighbouring white quarters are no corners."""
    return over_pages(points, steps.corners)


def next_corners(turns: DataFrame) -> DataFrame:
    """Adds next_x, next_y, next_flags: the nearest corner that the way out leads into, looked up along columns and rows; no
    corner is compared with another."""
    return over_pages(turns, steps.next_corners)


def polygons(linked: DataFrame) -> DataFrame:
    """Adds ``polygon``: corners that lead to one another have the number of the first of them (by x, then y from the top)."""
    return over_pages(linked, steps.polygons)


def polygon_boxes(outlined: DataFrame) -> DataFrame:
    """left, right (strip numbers), top, bottom of each polygon."""
    return over_pages(outlined, steps.polygon_boxes)


def text_boxes(words: DataFrame, width: int = 612, height: int = 792) -> DataFrame:
    """xmin, ymin, xmax, ymax, box of the boxes that white space encloses: the outermost, without the page itself, numbered
    from 0 by left, then from the top."""
    return over_pages(words, steps.text_boxes(width, height))


def contains(slack: float = 0.1) -> Column:
    """Whether a text box holds an element within it, to a tenth, and is not equal to it."""
    held = (F.col("left") > F.col("xmin") - slack) & (F.col("right") < F.col("xmax") + slack) & (F.col("top") < F.col("ymax") + slack) & (F.col("bottom") > F.col("ymin") - slack)
    return held & ~((F.col("left") == F.col("xmin")) & (F.col("right") == F.col("xmax")) & (F.col("top") == F.col("ymax")) & (F.col("bottom") == F.col("ymin")))


def assign_boxes(elements: DataFrame, boxes: DataFrame) -> DataFrame:
    """Elements with the box that holds them; one in several boxes stands in each, one in none goes. A page has few boxes."""
    return elements.join(boxes, list(PAGE)).where(contains())


def text_blocks(elements: DataFrame, boxes: DataFrame) -> DataFrame:
    """box, part, text, left, right, bottom, top, size: the text of each box in reading order, a new part beginning with a
    line that is indented against the one above. A block has its box's sides; where a box is parted, the last line's bottom
    and the first one's top. The size is that of the first element."""
    return over_pages(assign_boxes(elements, boxes), steps.text_blocks)


def greedy_lines(words: DataFrame) -> DataFrame:
    """Lines by the exact rule, page by page: in order of left each word takes, again and again, the first later one that
    stands right of it on its line (bottoms less than 0.7 of the other's size apart), no further than half the size, unless
    an edge forbids it (a right edge of the left one or a left edge of the right one, and a gap). The left word's size and
    font stay, its top is the larger size above its bottom."""
    return over_pages(words, steps.greedy_lines)


def adjacent_letters(glyphs: DataFrame) -> DataFrame:
    """seq, next_seq: for each letter the nearest one to its right that adjoins it: it begins right of the letter's left,
    bottoms differ by less than a tenth of the size, and the gap is less than a hundredth of it, or they overlap. Letters
    are looked up by their bottoms, so that no page is compared with itself."""
    return over_pages(glyphs, steps.adjacent_letters)
