"""PDF bytes as relations: each function takes a DataFrame with doc_id and content. Files that cannot be read give no
rows, and one row with their error in ``errors``; so do single pages and objects of a file, and the others keep their
rows. Python only decodes; all layout is done by the DataFrame operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import functions as fn
from .. import operators as op
from ..operators import steps
from ..operators.pages import ROWS, begins, codes, same_values, whole_groups
from ..operators.steps import joined
from .content import content_tokens, interpret
from .cos import Document, spelt
from .writer import write_pdf


def _sound(items: Iterable, of: Callable[..., Iterable[tuple]]) -> Iterator[tuple]:
    """The rows of each item, of a page or object, that can be read to its end."""
    for item in items:
        try:
            found = list(of(item))
        except Exception:  # noqa: BLE001
            continue
        yield from found


KINDS = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "array<double>": pa.list_(pa.float64()), "array<int>": pa.list_(pa.int32()), "map<string,string>": pa.map_(pa.string(), pa.string())}


def _decoded(files: DataFrame, rows: Callable[[int, Document], Iterator[tuple]], schema: str, at_once: int = 50_000) -> DataFrame:
    fields = pa.schema([(name, KINDS[kind]) for name, kind in (c.split() for c in schema.split(", "))])

    def batch_of(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), fields.types, strict=True)], schema=fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []
        for batch in batches:
            for doc_id, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    for row in rows(doc_id, Document(content.as_py() or b"")):
                        found.append(row)
                        if len(found) >= at_once:
                            yield batch_of(found)
                            found = []
                except Exception:  # noqa: BLE001, S112
                    continue
        if found:
            yield batch_of(found)

    return files.select("doc_id", "content").mapInArrow(run, schema)


def xref(files: DataFrame) -> DataFrame:
    return _decoded(files, lambda d, doc: ((d, n, e[0] if not e[1] else None, e[1]) for n, e in sorted(doc.xref.items()) if e), "doc_id long, object int, start_byte long, in_object int")


def objects(files: DataFrame) -> DataFrame:
    """The dictionary of each object, its values as a file spells them (parse_refs, parse_ints and the like read them), and
    its decoded stream. What is no dictionary stands under an empty key."""
    def rows(d: int, doc: Document) -> Iterator[tuple]:
        def of(n: int) -> Iterator[tuple]:
            value, stream = doc.fetch(n)
            if value is not None:
                header = value.items() if isinstance(value, dict) else [("", value)]
                yield d, n, [(k, spelt(v)) for k, v in header], stream

        return _sound(sorted(doc.xref), of)

    return _decoded(files, rows, "doc_id long, object int, header map<string,string>, stream binary")


def page_programs(files: DataFrame) -> DataFrame:
    return _decoded(files, lambda d, doc: _sound(enumerate(doc.pages(), 1), lambda at: [(d, at[0], doc.program(at[1]).decode("latin-1"))]), "doc_id long, page int, program string")


def tokens(files: DataFrame) -> DataFrame:
    """The tokens of each page's program in order, with their kinds: number, string, name or operator. Brackets of arrays
    stand for themselves; inline images have none."""
    def rows(d: int, doc: Document) -> Iterator[tuple]:
        def of(at: tuple[int, dict]) -> Iterator[tuple]:
            for seq, (token, kind) in enumerate(content_tokens(doc.program(at[1]))):
                yield d, at[0], seq, token, kind

        return _sound(enumerate(doc.pages(), 1), of)

    return _decoded(files, rows, "doc_id long, page int, seq int, token string, type string")


def page_boxes(files: DataFrame) -> DataFrame:
    def rows(d: int, doc: Document) -> Iterator[tuple]:
        return _sound(enumerate(doc.pages(), 1), lambda at: [(d, at[0], *map(float, doc.box(at[1])))])

    return _decoded(files, rows, "doc_id long, page int, left double, bottom double, right double, top double")


def glyphs(files: DataFrame, pages: list[int] | None = None) -> DataFrame:
    """Atomic text elements: doc_id, page, seq, text, left, right, bottom, top, font, size. ``pages`` is asked for before the
    programs are run."""
    def rows(d: int, doc: Document) -> Iterator[tuple]:
        fonts: dict = {}
        wanted = [(i, p) for i, p in enumerate(doc.pages(), 1) if pages is None or i in pages]
        return _sound(wanted, lambda at: ((d, at[0], seq, *g) for seq, g in enumerate(interpret(doc, at[1], fonts)[0])))

    return _decoded(files, rows, "doc_id long, page long, seq long, text string, left double, right double, bottom double, top double, font string, size double")


def glyph_map(files: DataFrame) -> DataFrame:
    """font, codepoint, unicode, width of the fonts that page programs use."""
    def rows(d: int, doc: Document) -> Iterator[tuple]:
        fonts: dict = {}
        for p in doc.pages():
            try:
                interpret(doc, p, fonts)
            except Exception:  # noqa: BLE001, PERF203
                continue
        for (_, name), font in fonts.items():
            for code, char in sorted(font.unicode.items() if font else ()):
                yield d, name, code, ord(char[0]) if char else None, font.widths.get(code, font.missing)

    return _decoded(files, rows, "doc_id long, font string, codepoint int, unicode int, width double")


def paths(files: DataFrame) -> DataFrame:
    """Painted vector paths of each page."""
    def rows(d: int, doc: Document) -> Iterator[tuple]:
        def of(at: tuple[int, dict]) -> Iterator[tuple]:
            for n, g in enumerate(interpret(doc, at[1])[1]):
                yield d, at[0], n, g["x"], g["y"], g["subpath"], g["filled"], g["stroked"], g["colour"], g["fill"], g["size"]

        return _sound(enumerate(doc.pages(), 1), of)

    return _decoded(files, rows, "doc_id long, page int, path int, x array<double>, y array<double>, subpath array<int>, filled boolean, stroked boolean, colour array<double>, fill array<double>, size double")


def graphic_objects(files: DataFrame) -> DataFrame:
    """Painted paths and glyphs of each page in the order of painting: place, kind (path or text), x, y, subpath, filled,
    stroked, colour, fill, size, text, and the page's box."""
    def rows(d: int, doc: Document) -> Iterator[tuple]:
        fonts: dict = {}

        def of(at: tuple[int, dict]) -> Iterator[tuple]:
            marks: list = []
            found, drawn = interpret(doc, at[1], fonts, marks)
            box = doc.box(at[1])
            size = box[2] - box[0], box[3] - box[1]
            for g in drawn:
                yield d, at[0], g["place"], "path", g["x"], g["y"], g["subpath"], g["filled"], g["stroked"], g["colour"], g["fill"], g["size"], "", *size
            for (text, left, _, bottom, _, _, scale), (place, colour, fill) in zip(found, marks, strict=True):
                yield d, at[0], place, "text", [left], [bottom], [0], False, True, colour, fill, scale, text, *size

        return _sound(enumerate(doc.pages(), 1), of)

    return _decoded(files, rows, "doc_id long, page int, place int, kind string, x array<double>, y array<double>, subpath array<int>, filled boolean, stroked boolean, colour array<double>, fill array<double>, size double, text string, width double, height double")


def _hex(colour: str) -> Column:
    """#rrggbb of one, three or no components (black)."""
    c = F.col(colour)
    rgb = [F.coalesce(F.get(c, F.when(F.size(c) >= 3, F.lit(i)).otherwise(F.lit(0))), F.lit(0.0)) for i in range(3)]
    return fn.rgb_hex(*rgb)


def drawables(files: DataFrame) -> DataFrame:
    """What each page draws, in order: kind (polyline, polygon or text), x and y as shares of the page, subpath numbers, fill,
    col, lwd (2 at most), fontsize, label. A fill or colour that is not used is null."""
    g = graphic_objects(files)
    text = F.col("kind") == "text"
    kind = F.when(text, "text").when(F.col("filled"), "polygon").otherwise("polyline")
    share = lambda c, whole: F.transform(c, lambda v: v / F.col(whole))
    return g.select(
        "doc_id", "page", F.col("place").alias("shape"), kind.alias("kind"), share("x", "width").alias("x"), share("y", "height").alias("y"), "subpath",
        F.when(F.col("filled"), _hex("fill")).alias("fill"), F.least(F.abs(F.when(text, F.lit(1.0)).otherwise(F.col("size"))), F.lit(2.0)).alias("lwd"),
        F.when(F.col("stroked") | text, _hex("colour")).alias("col"), F.when(text, F.col("size")).alias("fontsize"), F.when(text, F.col("text")).alias("label"),
    )


def graphics(files: DataFrame, scale: float = 1.0, furthest: float = 800.0) -> DataFrame:
    """The points of all shapes that stay on the page (no x or y beyond ``furthest``): poly, seq, x, y, stroke, fill, size,
    filled, has_text, text, text_size."""
    g = graphic_objects(files).where(~F.exists("x", lambda v: v > furthest) & ~F.exists("y", lambda v: v > furthest))
    has_text = F.length("text") > 0
    g = g.withColumn("poly", F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("place")))
    each = g.select("doc_id", "page", "poly", F.posexplode(F.arrays_zip("x", "y")).alias("seq", "p"), _hex("colour").alias("stroke"), _hex("fill").alias("fill"), F.abs("size").alias("size"), "filled", has_text.alias("has_text"), "text")
    return each.select("doc_id", "page", "poly", "seq", "p.x", "p.y", "stroke", "fill", "size", "filled", "has_text", "text", F.when(F.col("has_text"), scale * F.col("size") / 3).alias("text_size"))


def path_boxes(paths_: DataFrame) -> DataFrame:
    """left, right, top, bottom of each path."""
    sides = [F.array_min("x").alias("left"), F.array_max("x").alias("right"), F.array_max("y").alias("top"), F.array_min("y").alias("bottom")]
    return paths_.select("doc_id", "page", "path", *sides)


def errors(files: DataFrame) -> DataFrame:
    """doc_id, page and error of the files, pages and objects that cannot be read; page is null for what is no page."""
    def found(content: bytes) -> Iterator[tuple[int | None, str]]:
        def tried(page: int | None, what: str, run: Callable[[], object]) -> Iterator[tuple[int | None, str]]:
            try:
                run()
            except Exception as e:  # noqa: BLE001
                yield page, f"{what}{type(e).__name__}: {e}"

        try:
            doc = Document(content)
            pages = doc.pages()
        except Exception as e:  # noqa: BLE001
            yield None, f"{type(e).__name__}: {e}"
            return
        fonts: dict = {}
        for i, p in enumerate(pages, 1):
            yield from tried(i, "", lambda p=p: (doc.box(p), doc.program(p), interpret(doc, p, fonts)))
        for n in sorted(doc.xref):
            yield from tried(None, f"object {n}: ", lambda n=n: doc.fetch(n))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for doc_id, content in zip(batch["doc_id"], batch["content"], strict=True):
                if rows := [(doc_id, *r) for r in found(bytes(content) if content is not None else b"")]:
                    yield pd.DataFrame(rows, columns=["doc_id", "page", "error"]).astype({"page": "Int64"})

    return files.select("doc_id", "content").mapInPandas(run, "doc_id long, page int, error string")


def document_text(files: DataFrame) -> DataFrame:
    """Lines of all pages, in order of page, -bottom, left, rounded to a tenth."""
    letters = glyphs(files).withColumn("row", F.lit(0)).withColumn("k", F.lit(0)).withColumn("i", F.col("seq"))
    lines = op.over_pages(letters, steps.dedupe_letters, steps.words_from_letters, steps.edge_flags, steps.lines_from_words)
    return lines.select("doc_id", "page", "text", *[F.round(c, 1).alias(c) for c in ("left", "right", "bottom")], "top", F.round("size", 1).alias("size")).orderBy("doc_id", "page", F.desc("bottom"), "left")


def as_files(words: DataFrame, flate: bool = True, stream_xref: bool = True, encrypt: int = 3, together: bool = False) -> DataFrame:
    """One PDF file for each document of the words relation. ``together``: the words of each document already stand one after
    the other in one partition."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ("doc_id",), ROWS):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*written(table), strict=True), (pa.int64(), pa.binary()), strict=True)], names=["doc_id", "content"])

    def written(table: pa.Table) -> Iterator[tuple]:
        of = same_values(table["doc_id"])
        page, row, k, left, bottom = (table[c].to_numpy() for c in ("page", "row", "k", "left", "bottom"))
        order = np.lexsort((k, row, page, of))
        _, first, which = np.unique(codes(*(c[order] for c in (of, page, bottom))), return_index=True, return_inverse=True)
        line = np.argsort(first[which], kind="stable")  # lines in order of their first words
        order, line = order[line], first[which][line]
        starts = np.flatnonzero(begins(line))
        at = order[starts]
        texts = joined(table["text"].combine_chunks().take(pa.array(order)), starts, " ").to_pylist()
        pages: list[list] = []
        ids, place = table["doc_id"], of[at].tolist()
        for n, (doc, number, text, x, y) in enumerate(zip(place, page[at].tolist(), texts, left[at].astype(float).tolist(), bottom[at].astype(float).tolist(), strict=True)):
            pages.extend([] for _ in range(number - len(pages)))
            pages[number - 1].append((text, x, y))
            if n + 1 == len(place) or place[n + 1] != doc:
                yield ids[doc].as_py(), write_pdf(pages, 10, flate, stream_xref, encrypt)
                pages = []

    if not together:
        words = words.repartition("doc_id").sortWithinPartitions("doc_id")
    return words.mapInArrow(run, "doc_id long, content binary")


def roundtrip(words: DataFrame, flate: bool = True, stream_xref: bool = True, encrypt: int = 3, together: bool = False) -> DataFrame:
    """Words written as files (compressed and encrypted or not), read back as glyphs, and joined to rows: one for each
    written line. Files are written in cp1252: other characters come back as question marks. Files and glyphs follow one another
    page by page, so that nothing but the words is shuffled, and that not if they stand ``together``."""
    back = glyphs(as_files(words, flate, stream_xref, encrypt, together)).withColumn("i", F.col("seq"))
    rounded = back.withColumn("left", F.round("left", 3)).withColumn("right", F.round("right", 3))
    return op.over_pages(rounded, steps.words_from_letters, steps.rows_of_bottoms, together=True)
