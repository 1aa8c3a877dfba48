"""Toxicity categories by a chain of linear models.

Categories are predicted one after another, each by a logistic model over the presence of
telling words and beginnings of words, a few figures of style, and the probabilities of all earlier categories.
While a model is trained, those are out-of-fold: no row sees a prediction of a model that
its own label went into. The labels at hand name two categories, low quality and toxic.

The models are fitted on at most ``sample`` labelled rows (a parameter, the lowest by a
hash of doc_id); whole texts of all documents are scored. Which words tell is found from
counts that are added up in Spark, for each category without each fold and with all; only
those words' places in the labelled rows come to the driver, so that its memory is bounded
by the sample and not by the texts. A document is rejected when its last category's
probability reaches the threshold that was best (F1) on out-of-fold predictions, half at
least.

Null text counts as empty, texts of any length are read whole. Null labels and labels of a
null doc_id are left out; a doc_id with several labels has the highest, and if several rows
have it, all of them are fitted on. Documents without a label, or with a null doc_id, are
scored like others. Without labels of both kinds a category's probability is its share and
rejects nothing. Of words that tell equally the first in order counts. Repeated rows give
repeated results. An empty table gives no rows. Columns of the same names as the
probabilities are replaced; others pass through.
"""

from __future__ import annotations

import gc
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import Scratch, give_back, table

WORDS = re.compile(r"[^\W\d_]+")
UPPER, SYMBOLS = bytes(range(65, 91)), bytes([*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)])
#: Category and the SQL that reads it from a label row, in the order of the chain.
CATEGORIES = (("low_quality", "CAST(quality = 0 AS INT)"), ("toxic", "CAST(toxic = 1 AS INT)"))
FOLDS = 5
#: Letters of the beginnings of words that count as features.
STARTS = (4, 5)
STYLES = 4


def features(text: str | None) -> tuple[set[str], list[float]]:
    """Distinct lower-case words and their beginnings (inflections share those), and figures of style between 0 and 1."""
    words = WORDS.findall((text or "").lower())
    distinct, raw = set(words), (text or "").encode()
    starts = {w[:k] + "*" for k in STARTS for w in distinct}
    size = max(1, len(raw))
    return distinct | starts, [min(1.0, np.log1p(len(words)) / 12), len(distinct) / max(1, len(words)), 1 - len(raw.translate(None, UPPER)) / size, 1 - len(raw.translate(None, SYMBOLS)) / size]


@dataclass
class Linear:
    """A logistic model: weights of words, then of style and earlier categories, and the bias."""

    words: dict[str, float] = field(default_factory=dict)
    dense: list[float] = field(default_factory=list)
    bias: float = 0.0

    def of(self, words: set[str], dense: list[float]) -> float:
        z = self.bias + sum(map(self.words.__getitem__, self.words.keys() & words)) + sum(w * x for w, x in zip(self.dense, dense, strict=False))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def newton(x: np.ndarray, y: np.ndarray, l2: float = 1.0, steps: int = 30) -> np.ndarray:
    """Weights of the penalised logistic model with a bias as last column."""
    x = np.c_[x, np.ones(len(x))]
    w, penalty = np.zeros(x.shape[1]), np.r_[np.full(x.shape[1] - 1, l2), 1e-6]
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


class Sample:
    """The labelled rows: places of the words that tell for some category, figures of style, labels and folds."""

    def __init__(self, rows: pa.Table, names: list[str], told: dict[tuple[str, int], list[str]], categories: list[str]) -> None:
        self.names, self.told = np.array(names, object), told
        lists = rows["places"].combine_chunks()
        self.word = lists.flatten().to_numpy()
        self.row = np.repeat(np.arange(len(rows)), pc.list_value_length(lists).to_numpy())
        self.dense = np.array(rows["style"].to_pylist(), float).reshape(len(rows), STYLES)
        self.y = {c: rows[c].to_numpy().astype(float) for c in categories}
        self.fold = rows["fold"].to_numpy()
        self.place = {w: i for i, w in enumerate(names)}

    def telling(self, category: str, without: int) -> np.ndarray:
        return np.array([self.place[w] for w in self.told.get((category, without), [])], int)

    def matrix(self, words: np.ndarray, more: np.ndarray) -> np.ndarray:
        place = np.full(len(self.names), -1)
        place[words] = np.arange(len(words))
        x = np.zeros((len(self.dense), len(words)))
        hit = place[self.word] >= 0
        x[self.row[hit], place[self.word[hit]]] = 1
        return np.c_[x, self.dense, more]


#: Stands for no fold: the words that tell in all rows.
NONE = -1


def fit_chain(sample: Sample, categories: list[str]) -> tuple[list[tuple[str, Linear]], float, dict[str, np.ndarray]]:
    """The models in order, the last one's threshold, and out-of-fold probabilities."""
    chain, held, n = [], {}, len(sample.dense)
    for c in categories:
        y, more = sample.y[c], np.column_stack(list(held.values())) if held else np.empty((n, 0))
        if n < 2 * FOLDS or y.min() == y.max():
            share = float(y.mean()) if n else 0.0
            chain.append((c, Linear(bias=float(np.log((share + 1e-9) / (1 - share + 1e-9))))))
            held[c] = np.full(n, share)
            continue
        guess = np.zeros(n)
        for k in range(FOLDS):
            train = sample.fold != k
            if train.all() or not train.any() or y[train].min() == y[train].max():
                guess[~train] = y[train].mean() if train.any() else y.mean()
                continue
            x = sample.matrix(sample.telling(c, k), more)
            w = newton(x[train], y[train])
            guess[~train] = 1 / (1 + np.exp(-np.clip(x[~train] @ w[:-1] + w[-1], -30, 30)))
        words = sample.telling(c, NONE)
        w = newton(sample.matrix(words, more), y)
        chain.append((c, Linear(dict(zip(sample.names[words].tolist(), w[: len(words)].tolist(), strict=True)), w[len(words) : -1].tolist(), float(w[-1]))))
        held[c] = guess
    y, p = sample.y[categories[-1]], held[categories[-1]]
    best = max((2 * (y * (p >= t)).sum() / max(1, y.sum() + (p >= t).sum()), -abs(t - 0.5), t) for t in np.arange(0.5, 0.96, 0.05)) if n else (0, 0, 0.5)
    return chain, float(best[2]) if best[0] else 1.1, held


def _telling(rows: DataFrame, categories: list[str], most: int = 256, least: int = 4) -> DataFrame:
    """category, without, words: those whose presence tells most (chi square) about a category in the rows of other folds."""
    folds = [NONE, *range(FOLDS)]
    sizes = rows.agg(*[F.count_if(F.col("fold") != k).alias(f"n{k}") for k in folds], *[F.sum(F.when(F.col("fold") != k, F.col(c))).alias(f"y{k}_{c}") for k in folds for c in categories]).head().asDict()
    # One more pass of numbers: for each word the rows and positive rows of each training set.
    words = rows.select(F.explode("words").alias("word"), "fold", *categories)
    counts = (
        words.groupBy("word")
        .agg(*[F.count_if(F.col("fold") != k).alias(f"n{k}") for k in folds], *[F.sum(F.when(F.col("fold") != k, F.col(c))).alias(f"y{k}_{c}") for k in folds for c in categories])
    )
    gains = []
    for c in categories:
        for k in folds:
            share = (sizes[f"y{k}_{c}"] or 0) / max(1, sizes[f"n{k}"] or 0)
            n, positive = F.col(f"n{k}"), F.coalesce(F.col(f"y{k}_{c}"), F.lit(0))
            gain = F.when(n >= least, F.pow(positive - n * share, 2) / F.greatest(n * (share * (1 - share)), F.lit(1e-9)))
            gains.append(F.struct(F.lit(c).alias("category"), F.lit(k).alias("without"), gain.alias("gain")))
    each = counts.select("word", F.explode(F.array(*gains)).alias("g")).select("word", "g.*").where("gain > 6")
    first = Window.partitionBy("category", "without").orderBy(F.desc("gain"), "word")  # kept first by each task, so little is shuffled
    return (
        each.withColumn("r", F.row_number().over(first))
        .where(F.col("r") <= most)
        .groupBy("category", "without")
        .agg(F.sort_array(F.collect_list("word")).alias("words"))
    )


def labelled(docs: DataFrame, labels: DataFrame, categories: tuple[tuple[str, str], ...], sample: int) -> Sample:
    ids = (
        labels.select("doc_id", *[F.expr(sql).alias(c) for c, sql in categories]).dropna()
        .groupBy("doc_id")
        .agg(*[F.max(c).alias(c) for c, _ in categories])
    )
    ids = F.broadcast(ids.orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id").limit(sample))  # bound: ``sample`` rows of numbers
    names, scratch = [c for c, _ in categories], Scratch(docs.sparkSession, "labelled")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([sorted(w) for w, _ in found], pa.list_(pa.string())), pa.array([s for _, s in found], pa.list_(pa.float64())), *batch.columns[2:]], ["doc_id", "words", "style", *names, "fold"])

    rows = (
        docs.select(F.col("doc_id").cast("long"), "text")
        .join(ids, "doc_id")
        .select("doc_id", "text", *names, F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(FOLDS)).cast("int").alias("fold"))
    )
    rows = scratch.keep(rows.mapInArrow(read, f"doc_id long, words array<string>, style array<double>, {', '.join(c + ' int' for c in names)}, fold int"), "rows")
    told = {(r.category, r.without): r.words for r in _telling(rows, names).collect()}  # 256 words of each of a dozen sets at most
    words = sorted({w for found in told.values() for w in found})

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = {w: i for i, w in enumerate(words)}
        for batch in batches:
            places = [[index[w] for w in found if w in index] for found in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(places, pa.list_(pa.int16())), *batch.columns[2:]], ["doc_id", "places", "style", *names, "fold"])

    found = rows.mapInArrow(placed, f"doc_id long, places array<short>, style array<double>, {', '.join(c + ' int' for c in names)}, fold int").toArrow()
    scratch.drop(rows)
    return Sample(found.sort_by("doc_id"), words, told, names)


def toxicity_model(docs: DataFrame, labels: DataFrame, categories: tuple[tuple[str, str], ...] = CATEGORIES, sample: int = 6000) -> tuple[list[tuple[str, Linear]], float]:
    model = fit_chain(labelled(docs, labels, categories, sample), [c for c, _ in categories])[:2]
    gc.collect()
    give_back()  # the driver keeps the model only
    return model


def probabilities(chain: list[tuple[str, Linear]], text: str | None) -> list[float]:
    words, dense = features(text)
    out: list[float] = []
    for _, model in chain:
        out.append(model.of(words, dense + out))
    return out


def scored(docs: DataFrame, chain: list[tuple[str, Linear]]) -> DataFrame:
    """``docs`` with a column p_<category> for each category."""
    names = [f"p_{c}" for c, _ in chain]
    docs = docs.drop(*names)
    columns, at = docs.columns, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = np.array([probabilities(chain, t.as_py()) for t in batch.column(at)]).reshape(batch.num_rows, len(chain))
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(p[:, k]) for k in range(len(chain))]], [*columns, *names])
        give_back()

    schema = StructType([*docs.schema.fields, *[StructField(n, DoubleType()) for n in names]])
    return docs.mapInArrow(run, schema)


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without those that the chain rejects."""
    chain, threshold = toxicity_model(docs, labels)
    return scored(docs, chain).where(F.col(f"p_{chain[-1][0]}") < threshold).select(docs.columns)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    chain, threshold = toxicity_model(docs, table(spark, sf_dir, "labels"))
    return (
        scored(docs, chain)
        .select("doc_id", *[F.round(f"p_{c}", 6).alias(f"p_{c}") for c, _ in chain], (F.col(f"p_{chain[-1][0]}") >= threshold).alias("rejected"))
    )
