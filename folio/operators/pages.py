"""Whole pages in Arrow batches: rules that look at a page as a whole run as numpy steps over many pages at once.

A step takes ``Pages`` and gives ``Pages``. Nothing is shuffled, sorted or spilled by Spark where the rows of a page already stand
one after the other in one partition, and a task holds some pages at a time. ``sources.words_of`` runs steps on the pages that it
lays out, so that their words do not cross from Python to Spark and back."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

PAGE = ("doc_id", "page")
#: About as many rows are taken at a time; a page of more is taken whole.
ROWS = 1 << 16


class Pages:
    """Rows of some pages in order of page: ``of`` numbers the page of each row, ``keys`` has doc_id and page of each number.
    Numbers are numpy arrays, other columns, and numbers with nulls, Arrow ones."""

    def __init__(self, keys: dict[str, pa.Array], of: np.ndarray, columns: dict) -> None:
        self.keys, self.of, self.columns = keys, of, columns

    @property
    def count(self) -> int:
        return len(self.keys["page"])

    def __getitem__(self, name: str):
        return self.columns[name]

    def __len__(self) -> int:
        return len(self.of)

    def take(self, at: np.ndarray, **more) -> Pages:
        return Pages(self.keys, self.of[at], {k: taken(v, at) for k, v in self.columns.items()} | more)

    def of_columns(self, of: np.ndarray, **columns) -> Pages:
        return Pages(self.keys, of, columns)

    def only(self, *names: str) -> Pages:
        return Pages(self.keys, self.of, {c: self.columns[c] for c in names})

    def parts(self, limit: int) -> Iterator[Pages]:
        """Whole pages, about ``limit`` rows at a time."""
        starts = np.flatnonzero(begins(self.of))
        part = starts // limit
        ends = [*starts[1:][part[1:] != part[:-1]].tolist(), len(self)]
        for a, b in zip([0, *ends], ends, strict=False):
            if b > a:
                low, high = int(self.of[a]), int(self.of[b - 1]) + 1
                keys = {k: v.slice(low, high - low) for k, v in self.keys.items()}
                yield Pages(keys, self.of[a:b] - low, {k: v[a:b] if isinstance(v, np.ndarray) else v.slice(a, b - a) for k, v in self.columns.items()})

    def batch(self) -> pa.RecordBatch:
        at = pa.array(self.of)
        held = {k: self.keys[k].take(at) for k in PAGE} | self.columns
        return pa.RecordBatch.from_arrays([pa.array(v) if isinstance(v, np.ndarray) else v for v in held.values()], names=list(held))


Step = Callable[[Pages], Pages]


def taken(values, at: np.ndarray):
    return values[at] if isinstance(values, np.ndarray) else values.take(pa.array(at))


def _plain(column: pa.Array):
    number = pa.types.is_integer(column.type) or pa.types.is_floating(column.type) or pa.types.is_boolean(column.type)
    return column.to_numpy(zero_copy_only=False) if number and not column.null_count else column


def begins(*keys: np.ndarray) -> np.ndarray:
    """Whether a row differs from the one before in any of the keys."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return new


def since(new: np.ndarray) -> np.ndarray:
    """For each row the place of the last one at or before it that begins something."""
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0)) if len(new) else np.empty(0, np.int64)


def codes(*keys: np.ndarray) -> np.ndarray:
    """One whole number for each row, equal where all keys are and ordered as they are."""
    code, size = np.zeros(len(keys[0]), np.int64), 1
    if not len(code):
        return code
    for k in keys:
        if k.dtype.kind in "iu" and int(k.max()) - int(k.min()) < 1 << 31:
            part, span = k.astype(np.int64) - int(k.min()), int(k.max()) - int(k.min()) + 1
        else:
            held, part = np.unique(k, return_inverse=True)
            span = len(held)
        if size * span > 1 << 62:
            held, code = np.unique(code, return_inverse=True)
            size = len(held)
        code, size = code * span + part, size * span
    return code


def whole_array(column: pa.ChunkedArray) -> pa.Array:
    return column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def numbered(column: pa.ChunkedArray) -> np.ndarray:
    """A number for each value of a key column, null included."""
    whole = whole_array(column)
    if pa.types.is_integer(whole.type) and not whole.null_count:
        return whole.to_numpy()
    return pc.fill_null(whole.dictionary_encode().indices, -1).to_numpy()


def same_values(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """For each row the place of the first of the neighbouring rows that have its value."""
    return since(begins(numbered(column if isinstance(column, pa.ChunkedArray) else pa.chunked_array([column]))))


def whole_groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], limit: int, weigh: Callable[[pa.Table], np.ndarray] | None = None) -> Iterator[pa.Table]:
    """The batches dealt anew, so that rows of equal keys that stand together stay together: about ``limit`` rows each, or as
    much by ``weigh``."""
    held: list[pa.RecordBatch] = []
    weight, needed = 0, limit

    def cut(last: bool) -> Iterator[pa.Table]:
        t = pa.Table.from_batches(held).combine_chunks()
        starts = np.flatnonzero(begins(*[numbered(t[k]) for k in keys]))
        before = np.concatenate([[0], np.cumsum(weigh(t))]) if weigh else np.arange(len(t) + 1)
        part = before[starts] // limit
        ends = [*starts[1:][part[1:] != part[:-1]].tolist(), int(starts[-1]), *([len(t)] if last else [])]
        at = 0
        for end in ends:
            if end > at:
                yield t.slice(at, end - at)
                at = end
        held[:] = [] if last else t.slice(at).to_batches()
        return int(before[-1] - before[at])

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        weight += int(weigh(pa.Table.from_batches([batch])).sum()) if weigh else batch.num_rows
        if weight >= needed:
            weight = yield from cut(False)
            needed = max(limit, 2 * weight)
    if held:
        yield from cut(True)


def pages_of(table: pa.Table) -> Pages:
    new = begins(*[numbered(table[k]) for k in PAGE])
    first = pa.array(np.flatnonzero(new))
    plain = {k: _plain(whole_array(table[k])) for k in table.column_names if k not in PAGE}
    return Pages({k: whole_array(table[k]).take(first) for k in PAGE}, np.cumsum(new) - 1, plain)


def through(pages: Pages, steps: Iterable[Step]) -> Pages:
    for step in steps:
        pages = step(pages)
    return pages


def sliced(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, ROWS):
        yield batch.slice(at, ROWS)


def over_pages(rows: DataFrame, *steps: Step, together: bool = False) -> DataFrame:
    """The steps over all pages. ``together``: the rows of each page already stand one after the other in one partition;
    otherwise they are brought together."""
    into = to_arrow_schema(rows.schema)

    def stepped(table: pa.Table) -> pa.RecordBatch:
        return through(pages_of(table), steps).batch()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, PAGE, ROWS):
            yield from sliced(stepped(table))

    schema = from_arrow_schema(stepped(pa.Table.from_arrays([pa.array([], f.type) for f in into], schema=into)).schema)
    if not together:
        rows = rows.repartition(*PAGE).sortWithinPartitions(*PAGE)
    return rows.mapInArrow(run, schema)
