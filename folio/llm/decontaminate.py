"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

Fixed masks pick some tokens of every window of a document and of a benchmark item, and
hashes of what they pick are joined; the positions that a mask ignores may differ. Each
hit fixes an ungapped alignment of item and document. Hits are reduced to the distinct
alignments of each text and item before any token is compared; the alignments are then
verified over the whole item: +1 for an equal token, -2 for another, best run (Kadane).
A best run of half the item, or of ``full`` tokens, is an overlap; substitutions inside
it are allowed.

Items too short for a mask (fewer than SPAN tokens) are joined exactly: those of WHOLE to
SPAN - 1 tokens overlap where all their tokens stand in a row, shorter ones where they
are all the tokens that a document has. An item without tokens overlaps nothing.

Tokens are runs of letters and digits in lower case. Null or empty texts have none. Each
row is judged by its own text, whatever its doc_id: repeated rows each report, and a null
doc_id is reported as null. Repeated items report once, equal item_ids of other texts each
on their own. Of alignments with the best score and most equal tokens the first counts.
Texts of any length are read whole; in a text that repeats itself only the first of a run
of hits on one alignment is kept. Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table, text_or_empty

#: Of each window of ten tokens the masks compare six.
MASKS = ("1101100101", "1011010011", "1110001101")
SPAN, WHOLE = 10, 5
#: Seeds that may be broadcast: about 100 MB of hash table. More are joined by shuffle.
BROADCAST_SEEDS = 2_000_000
#: Columns that tell texts apart: the second makes an accidental drop by equal hashes out of the question.
KEYS = ("key", "check")


def _tokens(text: Column) -> Column:
    """Tokens, and an empty one before or after them if the text begins or ends with none."""
    return F.split(F.lower(text), r"[^\p{L}\p{N}]+")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("key", F.xxhash64(F.lit(3), "doc_id", "text")).withColumn("check", F.xxhash64(F.lit(5), "text", "doc_id"))


def _seed(k: int, at: str) -> Column:
    return F.xxhash64(F.lit(k), *[F.expr(f"get(tokens, {at} + {i})") for i, bit in enumerate(MASKS[k]) if bit == "1"])


def _seeds(at: str) -> Column:
    return F.array(*[_seed(k, at) for k in range(len(MASKS))])


def _run(n: int, at: str) -> Column:
    """A hash of n tokens in a row."""
    return F.xxhash64(F.lit(-n), *[F.expr(f"get(tokens, {at} + {i})") for i in range(n)])


def _alignments(read: DataFrame, wanted: DataFrame, broadcast_seeds: int) -> DataFrame:
    """(key, item, at): where an item that some window of it hits would begin in the tokens of a text."""
    places = F.expr(f"IF(size(tokens) >= {SPAN}, sequence(0, size(tokens) - {SPAN}), array())")
    each = wanted.select("item", "tokens", F.explode(places).alias("j")).select("item", "tokens", "j", F.posexplode(_seeds("j")).alias("k", "seed"))
    before = F.when(F.col("j") > 0, F.get(_seeds("(j - 1)"), F.col("k")))
    seeds = each.select("seed", "item", "j", "k", before.alias("before"))
    small = seeds.limit(broadcast_seeds + 1).count() <= broadcast_seeds
    windows = read.select("key", "tokens", F.explode(places).alias("i"))
    # A hit whose left neighbour is a hit of the same mask lies on an alignment that is known already.
    if small:
        # One stage of generated code up to the join: windows are read by position and never become rows of their own.
        seeds = F.broadcast(seeds)
        hits = windows.select("key", "tokens", "i", F.explode(_seeds("i")).alias("seed")).join(seeds, "seed")
        left = F.coalesce(*[F.when(F.col("k") == k, _seed(k, "(i - 1)")) for k in range(len(MASKS))])
    else:
        # Only numbers are shuffled; texts are read again for the hits.
        pairs = F.arrays_zip(_seeds("i").alias("seed"), _seeds("(i - 1)").alias("left"))
        hits = windows.select("key", "i", F.explode(pairs).alias("s")).select("key", "i", "s.seed", "s.left").join(seeds.hint("merge"), "seed")
        left = F.col("left")
    first = F.col("before").isNull() | (F.col("i") == 0) | (F.col("before") != left)
    return hits.where(first).select("key", "item", (F.col("i") - F.col("j")).alias("at")).distinct()


def _short_alignments(read: DataFrame, short: DataFrame) -> DataFrame | None:
    """The same for items shorter than a mask; None if there are none."""
    sizes = sorted(r.n for r in short.select(F.size("tokens").alias("n")).distinct().collect())  # SPAN - 1 at most
    parts = []
    for n in sizes:
        seeds = short.where(F.size("tokens") == n).select(_run(n, "0").alias("seed"), "item")
        if n < WHOLE:
            here = read.select("key", F.filter("tokens", lambda w: w != "").alias("tokens"), (F.col("tokens")[0] == "").cast("int").alias("i")).where(F.size("tokens") == n).select("key", "i", _run(n, "0").alias("seed"))
        else:
            starts = F.expr(f"IF(size(tokens) >= {n}, sequence(0, size(tokens) - {n}), array())")
            here = read.select("key", "tokens", F.explode(starts).alias("i")).select("key", "i", _run(n, "i").alias("seed"))
        parts.append(here.join(seeds, "seed").select("key", "item", F.col("i").alias("at")).distinct())
    out = parts[0] if parts else None
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _found(docs: DataFrame, items: DataFrame, full: int, broadcast_seeds: int) -> DataFrame:
    """One row for each row of ``docs`` and each item that it overlaps."""
    scratch = Scratch(docs.sparkSession, "decontaminate")
    wanted = items.select("item_id", "text").distinct().select("item_id", F.xxhash64("item_id", "text").alias("item"), F.filter(_tokens(text_or_empty()), lambda w: w != "").alias("tokens"))
    wanted = scratch.keep(wanted.where(F.size("tokens") > 0), "items")
    docs = _keyed(docs.select("doc_id", "text"))
    read = docs.select("key", _tokens(text_or_empty()).alias("tokens"))
    hits = _alignments(read, wanted.where(F.size("tokens") >= SPAN), broadcast_seeds)
    short = _short_alignments(read, wanted.where(F.size("tokens") < SPAN))
    hits = scratch.keep(hits if short is None else hits.unionByName(short), "hits")

    # Joined by the size of the written tables: hits are few unless the corpus is full of them.
    places = scratch.keep(hits.groupBy("key", "item").agg(F.collect_list("at").alias("ats")), "places")
    lined = docs.join(places, "key").join(wanted.withColumnRenamed("tokens", "of_item"), "item")

    def step(s: Column, ok: Column) -> Column:
        here = s.here + F.when(ok, 1).otherwise(-2)
        return F.struct(F.greatest(here, F.lit(0)).alias("here"), F.greatest(s.best, here).alias("best"), (s.matched + ok.cast("int")).alias("matched"))

    def best(tokens: Column) -> Column:
        skipped = F.when(tokens[0] == "", 1).otherwise(0)

        def judged(at: Column) -> Column:
            same = F.transform("of_item", lambda w, k: F.coalesce(F.get(tokens, at + k), F.lit("")) == w)
            zero = F.lit(0)
            return F.aggregate(same, F.struct(zero.alias("here"), zero.alias("best"), zero.alias("matched")), step, lambda s: F.struct(s.best.alias("score"), s.matched.alias("matched"), (skipped - at).alias("back")))

        return F.struct(F.array_max(F.transform("ats", judged)).alias("b"), F.size(F.filter(tokens, lambda w: w != "")).alias("size"))

    # The tokens are bound once, not split anew for each alignment.
    scored = lined.select("doc_id", *KEYS, "item_id", F.size("of_item").alias("item_tokens"), F.transform(F.array(_tokens(text_or_empty())), best)[0].alias("x"))
    scored = scored.select("doc_id", *KEYS, "item_id", (-F.col("x.b.back")).alias("doc_start"), "x.b.score", "x.b.matched", "item_tokens", "x.size")
    exact = (F.col("matched") == F.col("item_tokens")) & ((F.col("item_tokens") >= WHOLE) | (F.col("size") == F.col("item_tokens")))
    return scored.where(F.when(F.col("item_tokens") < SPAN, exact).otherwise(F.col("score") >= F.least(F.lit(full), F.ceil(F.col("item_tokens") / 2))))


def overlaps(docs: DataFrame, items: DataFrame, full: int = 12, broadcast_seeds: int = BROADCAST_SEEDS) -> DataFrame:
    """doc_id, item_id, doc_start, score, matched, item_tokens: the best alignment of each document with each item that
    overlaps. ``doc_start`` is where the item's first token would stand in the document, from 0."""
    return _found(docs, items, full, broadcast_seeds).drop(*KEYS, "size")


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without those that overlap an item."""
    bad = _found(docs, items, 12, BROADCAST_SEEDS).select(*[F.col(k).alias("bad_" + k) for k in KEYS]).distinct()
    bad = Scratch(docs.sparkSession, "contaminated").keep(bad, "bad")  # its size is known to the join, which spares texts a shuffle
    mine = [F.xxhash64(F.lit(3), "doc_id", "text"), F.xxhash64(F.lit(5), "text", "doc_id")]
    return docs.join(bad, (mine[0] == F.col("bad_key")) & (mine[1] == F.col("bad_check")), "left_anti")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _sql_seeds(of: str, id_: str) -> str:
    """Words of the masks' places, of each window of the tokens ``t`` of a table."""
    words = [" || ' ' || ".join(f"t[i + {n}]" for n, bit in enumerate(mask) if bit == "1") for mask in MASKS]
    return " UNION ALL ".join(f"SELECT {id_}, i, {k} AS k, {w} AS seed FROM {of}, unnest(range(1, len(t) - {SPAN - 2})) r(i)" for k, w in enumerate(words))


#: The items of the given tables have ten tokens or more; shorter ones have no part here.
OP1_SQL = rf"""
WITH d AS MATERIALIZED (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '') AS t FROM documents),
b AS MATERIALIZED (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '') AS t FROM benchmark),
ds AS ({_sql_seeds("d", "doc_id")}), bs AS ({_sql_seeds("b", "item_id")}),
hits AS MATERIALIZED (SELECT DISTINCT doc_id, item_id, ds.i - bs.i AS at_ FROM ds JOIN bs ON ds.k = bs.k AND ds.seed = bs.seed),
each AS (SELECT doc_id, item_id, at_, p, coalesce(CASE WHEN at_ + p >= 1 THEN d.t[at_ + p] END = b.t[p], false) AS same, len(b.t) AS n FROM hits JOIN d USING (doc_id) JOIN b USING (item_id), unnest(range(1, len(b.t) + 1)) r(p)),
summed AS (SELECT *, sum(CASE WHEN same THEN 1 ELSE -2 END) OVER (PARTITION BY doc_id, item_id, at_ ORDER BY p) AS s FROM each),
low AS (SELECT *, least(0, coalesce(min(s) OVER (PARTITION BY doc_id, item_id, at_ ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS least_ FROM summed),
runs AS (SELECT doc_id, item_id, at_, max(s - least_) AS score, count(*) FILTER (WHERE same) AS matched, any_value(n) AS item_tokens FROM low GROUP BY ALL)
SELECT doc_id, item_id, at_::INT AS doc_start, greatest(score, 0)::INT AS score, matched::INT AS matched, item_tokens::INT AS item_tokens
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY score DESC, matched DESC, at_) AS r FROM runs) WHERE r = 1 AND score >= least(12, ceil(item_tokens / 2))
"""
