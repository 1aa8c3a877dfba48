"""Sources: PDF files as bytes, and the layout relation that sets plain texts as pages of positioned words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_type

from ..operators.pages import ROWS as PAGE_ROWS
from ..operators.pages import Pages, Step, begins, same_values, since, sliced, through, whole_groups

#: Bytes of text that are laid out at a time; a longer text is laid out whole.
AT_ONCE = 1 << 19
#: Bytes of input, as Spark has them, that a task sorts and lays out; with more of these than ``spark.sql.shuffle.partitions``
#: there are more tasks, up to MOST, and what one of them holds does not grow with the input.
TASK_BYTES, MOST = 1 << 23, 1 << 13
SIZE, GLYPH, SPACE, WRAP, ROWS = 10, 5, 3, 90, 60


def pdf_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of all PDF files below ``path``."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").option("recursiveFileLookup", "true").load(path).select("path", "content")


def sample_files(spark: SparkSession, count: int = 9) -> DataFrame:
    """(name, path, content) of sample files, one for each number: pages of fonts, forms, paths and the like."""
    from ..pdf.samples import sample

    def run(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in rows:
            yield pd.DataFrame({"name": [f"sample{k}" for k in b["id"]], "path": [f"memory:/sample{k}.pdf" for k in b["id"]], "content": [sample(int(k)) for k in b["id"]]})

    return spark.range(count).mapInPandas(run, "name string, path string, content binary")


def words_of(docs: DataFrame, *steps: Step, wrap: int = WRAP, columns: int = 1, longest: int | None = None) -> DataFrame:
    """doc_id, page, row, k, text, left, right, bottom, top, size of each word, in whole numbers. Only the texts are shuffled,
    by ranges of doc_id: words come in order of doc_id, row and k, so that pages stand together. With several ``columns`` a page
    has as many times ROWS rows; words of more than ``longest`` letters are left out. With ``steps`` the words stay in Python, and
    what the steps make of their pages comes back."""
    kind = to_arrow_type(docs.schema["doc_id"].dataType)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ("doc_id",), AT_ONCE, lambda t: pc.binary_length(t["text"]).to_numpy()):
            doc_id, text = (pa.concat_arrays(table[c].chunks) for c in ("doc_id", "text"))
            for pages in _laid_out(doc_id, text).parts(PAGE_ROWS):
                yield from sliced(through(pages, steps).batch())

    def _laid_out(doc_id: pa.Array, text: pa.Array) -> Pages:
        doc, t, line = _split(text, "\n")
        at, word, w = _split(t, " ")
        length = pc.utf8_length(word).to_numpy()
        kept = np.flatnonzero((length > 0) & (length <= longest) if longest else length > 0)
        # Rows of one doc_id, which stand together, are one document.
        same = same_values(doc_id)
        doc, line, length = same[doc[at[kept]]], line[at[kept]], length[kept]
        if (same != np.arange(len(same))).any():
            by = np.lexsort((w[kept], line, doc))
            kept, doc, line, length = kept[by], doc[by], line[by], length[by]
        n = len(kept)
        before = np.cumsum(length + 1) - length - 1
        vrow = (before - before[since(begins(doc, line))]) // wrap
        new = begins(doc, line, vrow)
        first, number = since(new), np.cumsum(new) - 1
        row = number - number[since(begins(doc))]
        k = np.arange(n) - first
        left = 36 + GLYPH * (before - before[first] - k) + SPACE * k + 270 * (row % (columns * ROWS) // ROWS)
        bottom = 770 - 12 * (row % ROWS)
        page = row // (columns * ROWS) + 1
        new = begins(doc, page)
        keys = {"doc_id": doc_id.take(pa.array(doc[new])), "page": pa.array(page[new])}
        held = {"row": row, "k": k, "text": word.take(pa.array(kept)), "left": left, "right": left + GLYPH * length, "bottom": bottom, "top": bottom + SIZE, "size": np.full(n, SIZE)}
        return Pages(keys, np.cumsum(new) - 1, held)

    texts = docs.where("text IS NOT NULL").select("doc_id", "text")
    texts = texts.repartitionByRange(_tasks(texts), "doc_id").sortWithinPartitions("doc_id")
    none = _laid_out(pa.array([], kind), pa.array([], pa.string()))
    return texts.mapInArrow(run, from_arrow_schema(through(none, steps).batch().schema))


def _tasks(rows: DataFrame) -> int:
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    needed = -(-size // TASK_BYTES) if size < 1 << 50 else 0  # a size that is not known counts as endless
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(needed, MOST))


def _split(texts: pa.Array, by: str) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """The parts of all texts, with the place of the text and, in it, of the part."""
    lists = pc.split_pattern(texts, by)
    start = lists.offsets.to_numpy().astype(np.int64)
    n = np.diff(start)
    return np.repeat(np.arange(len(texts)), n), lists.flatten(), np.arange(int(n.sum())) - np.repeat(start[:-1] - start[0], n)


def glyphs_of(words: DataFrame) -> DataFrame:
    """One row for each letter of each word."""
    letters = words.select("*", F.posexplode(F.split("text", "")).alias("i", "glyph"))
    left = F.col("left") + GLYPH * F.col("i")
    return letters.select("doc_id", "page", "row", "k", F.col("i").cast("long").alias("i"), F.col("glyph").alias("text"), left.alias("left"), (left + GLYPH).alias("right"), "bottom", "top", "size")


def letters(p: Pages) -> Pages:
    """``glyphs_of`` as a step over pages: only words cross from Spark."""
    n = pc.utf8_length(p["text"]).to_numpy().astype(np.int64)
    word = np.repeat(np.arange(len(p)), n)
    i = np.arange(len(word)) - np.repeat(np.cumsum(n) - n, n)
    held, which = np.unique(np.frombuffer("".join(p["text"].to_pylist()).encode("utf-32-le"), np.uint32), return_inverse=True)
    text = pa.array(map(chr, held.tolist()), p["text"].type).take(pa.array(which))
    row, k, left, bottom, top, size = (p[c][word] for c in ("row", "k", "left", "bottom", "top", "size"))
    left = left + GLYPH * i
    return p.of_columns(p.of[word], row=row, k=k, i=i, text=text, left=left, right=left + GLYPH, bottom=bottom, top=top, size=size)
