"""Look-ups, orderings and decoders as relations: encodings and widths of fonts, ranks, offsets, sums by row, trees."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .pages import ROWS, begins, numbered, whole_groups

#: The width of a glyph that has none (fixed value).
DEFAULT_WIDTH = 500


def encoded(codes: DataFrame, encoding: DataFrame) -> DataFrame:
    """``codes`` (font, raw) with ``unicode``: by the font's encoding (font, raw, unicode), else the code itself."""
    return codes.join(encoding, ["font", "raw"], "left").withColumn("unicode", F.coalesce("unicode", "raw"))


def with_widths(codes: DataFrame, widths: DataFrame, key: str = "raw", default: float = DEFAULT_WIDTH) -> DataFrame:
    """Adds ``width`` by (font, ``key``): the code, or the character of a standard font."""
    return codes.join(widths.select("font", F.col("code").alias(key), "width"), ["font", key], "left").withColumn("width", F.coalesce("width", F.lit(default).cast("double")))


def glyph_table(encoding: DataFrame, widths: DataFrame) -> DataFrame:
    """font, raw, unicode, width of each encoded code."""
    return with_widths(encoding, widths).select("font", "raw", "unicode", "width")


def glyph_lookup(codes: DataFrame, glyphs: DataFrame) -> DataFrame:
    """Codes that the font's glyph table has; others go."""
    return codes.join(glyphs, ["font", "raw"])


def with_fallback_fonts(uses: DataFrame, fonts: DataFrame) -> DataFrame:
    """``uses`` (doc_id, name, ...) with ``found``: the font of that name, else the first font of the document."""
    first = fonts.groupBy("doc_id").agg(F.min("name").alias("any_font"))
    own = fonts.select("doc_id", "name", F.col("name").alias("own")).distinct()
    return uses.join(own, ["doc_id", "name"], "left").join(first, "doc_id", "left").withColumn("found", F.coalesce("own", "any_font")).drop("own", "any_font")


def named_glyphs(names: DataFrame, table: DataFrame) -> DataFrame:
    """``names`` (raw, name) with ``unicode``: by the table of glyph names, else the number in uniXXXX (five or six
    digits that nothing more follows count whole) or Gxx, else ``raw``."""
    number = F.coalesce(*[F.conv(F.nullif(F.regexp_extract("name", p, 1), F.lit("")), 16, 10).cast("int") for p in ("^/uni([0-9A-Fa-f]{5,6}(?![0-9A-Fa-f])|[0-9A-Fa-f]{4})", "^/G([0-9A-Fa-f]{2})$")])
    return names.join(table, "name", "left").withColumn("unicode", F.coalesce("unicode", number, "raw"))


def differences(entries: DataFrame) -> DataFrame:
    """font, raw, name of the entries (font, pos, entry) of /Differences: a number sets the code of the name that follows,
    each further name has the next code."""
    order = Window.partitionBy("font").orderBy("pos")
    number = F.expr("try_cast(entry AS INT)")
    marked = entries.withColumn("at", F.last(F.when(number.isNotNull(), F.col("pos")), ignorenulls=True).over(order)).withColumn("first", F.last(number, ignorenulls=True).over(order))
    return marked.where(number.isNull()).select("font", (F.coalesce("first", F.lit(0)) + F.col("pos") - F.coalesce("at", F.lit(-1)) - 1).cast("long").alias("raw"), F.col("entry").alias("name"))


def bfrange(ranges: DataFrame) -> DataFrame:
    """font, raw, unicode of the ranges (font, lo, hi, start)."""
    return ranges.select("font", "lo", "start", F.explode(F.sequence("lo", "hi")).alias("raw")).select("font", "raw", (F.col("start") + F.col("raw") - F.col("lo")).alias("unicode"))


def bfchar(maps: DataFrame) -> DataFrame:
    """font, raw, unicode of the pairs of hexadecimal numbers between beginbfchar and endbfchar of a map (font, text)."""
    bodies = maps.select("font", F.explode(F.regexp_extract_all("text", F.lit("(?s)beginbfchar(.*?)endbfchar"), 1)).alias("body"))
    pair = F.regexp_extract_all("body", F.lit(r"<\s*([0-9A-Fa-f]+)\s*>\s*<\s*[0-9A-Fa-f]+\s*>"), 1), F.regexp_extract_all("body", F.lit(r"<\s*[0-9A-Fa-f]+\s*>\s*<\s*([0-9A-Fa-f]+)\s*>"), 1)
    rows = bodies.select("font", F.explode(F.arrays_zip(pair[0].alias("raw"), pair[1].alias("unicode"))).alias("p"))
    return rows.select("font", *[F.conv(f"p.{c}", 16, 10).cast("long").alias(c) for c in ("raw", "unicode")])


def simple_widths(fonts: DataFrame) -> DataFrame:
    """font, code, width of (font, first_char, widths)."""
    return fonts.select("font", "first_char", F.posexplode("widths").alias("i", "width")).select("font", (F.col("first_char") + F.col("i")).alias("code"), F.col("width").cast("double").alias("width"))


def cid_widths(runs: DataFrame) -> DataFrame:
    """font, code, width of the two forms of /W: (font, first, widths) and (font, first, last, width)."""
    by_list = runs.where("widths IS NOT NULL").select("font", "first", F.posexplode("widths").alias("i", "width")).select("font", (F.col("first") + F.col("i")).alias("code"), "width")
    by_range = runs.where("widths IS NULL").select("font", F.explode(F.sequence("first", "last")).alias("code"), "width")
    return by_list.unionByName(by_range)


def ranked(rows: DataFrame, value: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``rank``: how many values of the group are smaller."""
    return rows.withColumn("rank", (F.rank().over(Window.partitionBy(*keys).orderBy(value)) - 1).cast("long"))


def gathered(rows: DataFrame, value: str, by: str, key: str) -> DataFrame:
    """(key, place, value): of each group the values in order of ``by``; of equal ones the first by value."""
    order = Window.partitionBy(key).orderBy(by, value)
    return rows.select(key, (F.row_number().over(order) - 1).cast("long").alias("place"), value)


def lengths(rows: DataFrame, key: str, offset: str, end: str) -> DataFrame:
    """Adds ``length``: up to the next offset of the group, of the last one up to ``end``."""
    order = Window.partitionBy(key).orderBy(offset)
    return rows.withColumn("length", F.coalesce(F.lead(offset).over(order), F.col(end)) - F.col(offset))


def undone_up(bytes_: DataFrame, key: str, row: str, column: str, value: str) -> DataFrame:
    """Undoes the predictor Up: each byte is the sum, modulo 256, of those above it in its column."""
    order = Window.partitionBy(key, column).orderBy(row).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return bytes_.withColumn("byte", (F.sum(value).over(order) % 256).cast("long"))


def big_endian(values: Column) -> Column:
    """An array of bytes as one number."""
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, b: a * 256 + b)


def bits_of(value: Column, at: Column, n: Column) -> Column:
    """``n`` bits of a number from bit ``at``, the lowest first."""
    return F.call_function("shiftrightunsigned", value, at).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), n) - 1)


def flipped(value: Column, n: int) -> Column:
    """The lowest ``n`` bits of a number in reverse order."""
    return sum((F.shiftleft(F.shiftright(value, i).bitwiseAND(1), n - 1 - i) for i in range(n)), F.lit(0))


def checksum(words: Column) -> Column:
    """The sum of 32-bit words, modulo 2**32."""
    return F.aggregate(words, F.lit(0).cast("long"), lambda a, b: (a + b) % 4294967296)


def latest(entries: DataFrame, key: tuple[str, ...], section: str) -> DataFrame:
    """Of the cross-reference entries of each object that of the newest section; free ones go."""
    first = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(section)))
    return entries.withColumn("r", first).where("r = 1 AND kind = 'n'").drop("r", "kind", section)


def page_leaves(nodes: DataFrame) -> DataFrame:
    """doc_id, node, page: the leaves of page trees (doc_id, node, parent, place) in order, walked document by document. What
    leads back into a tree is cut; a node that no root leads to has no page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ("doc_id",), ROWS):
            starts = np.flatnonzero(begins(numbered(table["doc_id"])))
            rows = list(zip(*(table[c].to_pylist() for c in ("place", "node", "parent")), strict=True))
            leaves = [walked(rows[a:b]) for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(rows)], strict=True)]
            each = np.fromiter(map(len, leaves), np.int64, len(leaves))
            ids = table["doc_id"].combine_chunks().take(pa.array(np.repeat(starts, each)))
            nodes_, pages = [n for found in leaves for n in found], [k for n in each.tolist() for k in range(1, n + 1)]
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(nodes_, pa.int64()), pa.array(pages, pa.int64())], names=["doc_id", "node", "page"])

    def walked(rows: list[tuple]) -> list[int]:
        below: dict = defaultdict(list)
        for place, node, parent in rows:
            below[parent].append((place, node))
        todo, seen, out = [n for _, n in sorted(below[None], reverse=True)], set(), []
        while todo:
            node = todo.pop()
            if node in seen:
                continue
            seen.add(node)
            if node in below:
                todo += [n for _, n in sorted(below[node], reverse=True)]
            else:
                out.append(node)
        return out

    nodes = nodes.select("doc_id", "node", "parent", "place").repartition("doc_id").sortWithinPartitions("doc_id")
    return nodes.mapInArrow(run, "doc_id long, node long, page long")


def shares_edge(a: Column, b: Column) -> Column:
    """Whether two boxes (structs of left, right, top, bottom) have a side in common."""
    return (a["left"] == b["left"]) | (a["right"] == b["right"]) | (a["top"] == b["top"]) | (a["bottom"] == b["bottom"])


def adjacent(a: Column, b: Column) -> Column:
    """Whether ``a`` begins where ``b`` ends, at the same height."""
    return (a["left"] == b["right"]) & (a["top"] == b["top"]) & (a["bottom"] == b["bottom"])


def encroaches(a: Column, b: Column) -> Column:
    return (a["left"] < b["right"]) & (a["right"] > b["left"]) & (a["bottom"] < b["top"]) & (a["top"] > b["bottom"])


def engulfs(a: Column, b: Column, slack: float = 0.1) -> Column:
    """Whether ``a`` holds ``b``, to a tenth, and is not equal to it."""
    held = (a["left"] < b["left"] + slack) & (a["right"] > b["right"] - slack) & (a["top"] > b["top"] - slack) & (a["bottom"] < b["bottom"] + slack)
    return held & ~((a["left"] == b["left"]) & (a["right"] == b["right"]) & (a["top"] == b["top"]) & (a["bottom"] == b["bottom"]))


def about_equal(a: Column, b: Column, slack: float = 0.1) -> Column:
    """Whether all sides are within a tenth of one another."""
    near = [F.abs(a[c] - b[c]) < slack for c in ("left", "right", "top", "bottom")]
    return near[0] & near[1] & near[2] & near[3]


def quadrants(box: Column, x: Column, y: Column) -> Column:
    """Which quarters around a point the box fills: 8 north-west, 4 north-east, 2 south-east, 1 south-west."""
    reach = (x >= box["left"]) & (x <= box["right"]) & (y >= box["bottom"]) & (y <= box["top"])
    west, east, low, high = x > box["left"], x < box["right"], y > box["bottom"], y < box["top"]
    return F.when(reach, sum((F.when(a & b, n).otherwise(0) for a, b, n in ((west, high, 8), (east, high, 4), (east, low, 2), (west, low, 1))), F.lit(0))).otherwise(0)


def same_line(a: Column, b: Column, b_size: Column) -> Column:
    """Whether an element ``b`` (right of ``a``) is on the line of ``a``: bottoms less than 0.7 of its size apart."""
    return F.abs(a - b) < 0.7 * b_size


def midpoints(rows: DataFrame, width: float, height: float) -> DataFrame:
    """Adds the middle of each element, and its share of the page."""
    x, y = (F.col("left") + F.col("right")) / 2, (F.col("bottom") + F.col("top")) / 2
    return rows.select("*", x.alias("x"), y.alias("y"), (x / width).alias("x_share"), (y / height).alias("y_share"))


def live(rows: DataFrame, consumed: str = "consumed") -> DataFrame:
    """Elements that no other has taken in."""
    return rows.where(~F.col(consumed)).drop(consumed)
