"""Mixing sources to target weights by Sainte-Lague apportionment, in DataFrame functions only.

A source's documents stand in a seeded order, twice over, as one stream of words; the
stream is cut into blocks of equal size. Blocks are seats: each goes to the source with
the highest quotient target / (2 * seats + 1). A source's quota is split over shards of
consecutive blocks in whole numbers, and each shard takes its quota of blocks in seeded
order. What is taken of a document is what its two places in the stream share with taken
blocks, so no document gives more than twice its size.

A null source is a source of its own and comes last. Null or empty texts have size 0 and
give nothing. Repeated rows are documents of their own, and so are rows of equal or null
doc_id. Sources of equal quotients win seats in order of their code points. A document of
any length is cut into as many blocks as it fills. An empty table gives no rows. Blocks
have 128 words, or as many as the smallest positive target where that is less, and double
while the table would have more than 2**30 of them (137 billion words): a source's words
come within about a block of its target whatever the size. Other columns are ignored, also
those of the same names as results, but in ``mixed_documents``, which returns them all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, Scratch, numbered, table, text_or_empty

WEIGHTS, SHARE, REPEATS = (5, 2, 1), 1.5, 2
#: Documents of a source whose places one task adds up, and blocks of a shard.
BUCKET, SHARD = 2000, 1024


def block_words(total: int, least: int = 128, most_blocks: int = 1 << 30, smallest: float = 128) -> int:
    """Words of a block: 128, or the smallest positive target where that is less (a source with less than half a block may
    win no seat), doubled while the whole table would have more than 2**30 blocks."""
    block = max(1, min(least, int(smallest)))
    while total > block * most_blocks:
        block *= 2
    return block


def seeded_hash(seed: int, *of: str | Column) -> Column:
    """60 bits that seed and values fix; other engines compute them alike."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), *of)), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, docs, weight, target. Sources in order of source_size / weight are filled to twice their size as
    long as the level that the rest would share is above that (one row for each source in these windows)."""
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    sources = sources.withColumn("number", rank).withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), F.col("number") % len(WEIGHTS) + 1))
    every, order = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), Window.orderBy(F.col("source_size") / F.col("weight"), "number").rowsBetween(Window.unboundedPreceding, -1)
    cap = F.col("source_size") * REPEATS
    sources = (
        sources.withColumn("rest", F.sum("source_size").over(every) * SHARE - F.coalesce(F.sum(cap).over(order), F.lit(0)))
        .withColumn("open", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(order), F.lit(0)))
    )
    sources = sources.withColumn("full", cap <= F.col("weight") * F.col("rest") / F.col("open"))
    # 'full' holds for a prefix of the order; the level of the others is that of the first of them.
    level = (
        F.max(F.when(~F.col("full"), F.struct((-F.col("source_size") / F.col("weight")).alias("k"), (-F.col("number")).alias("n"), (F.col("rest") / F.col("open")).alias("level"))))
        .over(every)["level"]
    )
    return (
        sources.withColumn("target", F.when(F.col("full"), cap.cast("double")).otherwise(F.col("weight") * level))
        .select("source", "number", "source_size", "docs", "weight", "target")
    )


def apportion(sources: DataFrame, block: int) -> DataFrame:
    """Adds ``blocks`` (of the source's stream) and ``quota`` (seats of highest quotients)."""
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sources = (
        sources.withColumn("all", F.sum("target").over(every))
        .withColumn("n", F.sum(F.when(F.col("target") > 0, 1).otherwise(0)).over(every))
        .withColumn("seats", F.floor(F.col("all") / block + 0.5))
    )
    # The first seats of each source are certain: at a divisor that seats fewer than all, n below the total.
    sure = F.when((F.col("seats") > F.col("n")) & (F.col("target") > 0), F.floor(F.col("target") * (F.col("seats") - F.col("n")) / F.col("all") + 0.5)).otherwise(0).cast("long")
    sources = sources.withColumn("sure", sure).withColumn("open", F.col("seats") - F.sum("sure").over(every))
    more = F.ceil(F.col("n") * 1.5 * F.col("target") / F.col("all")) + 2
    quotients = sources.where("target > 0").select("number", "open", F.explode(F.sequence("sure", F.col("sure") + more)).alias("k"), "target")
    won = (
        quotients.withColumn("r", F.row_number().over(Window.orderBy((F.col("target") / (2 * F.col("k") + 1)).desc(), "number")))
        .where("r <= open")
        .groupBy("number")
        .agg(F.count("*").alias("won"))
    )
    blocks = F.ceil(F.col("source_size") * REPEATS / block)
    return (
        sources.join(won, "number", "left")
        .withColumn("blocks", blocks)
        .withColumn("quota", F.least(F.col("sure") + F.coalesce("won", F.lit(0)), blocks))
        .select("source", "number", "source_size", "docs", "target", "blocks", "quota")
    )


def mix(docs: DataFrame, seed: int = 11, keys: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, and ``spans``: an array of (round, from, to) words to take. Columns
    ``keys`` of ``docs`` come along."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    sizes = scratch.keep(docs.select("doc_id", "source", F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long").alias("size"), F.xxhash64("text").alias("t"), *keys), "sizes")
    total, rows = sizes.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).head()
    targets = scratch.keep(source_targets(sizes), "targets")
    block = block_words(total, smallest=targets.where("target > 0").agg(F.coalesce(F.min("target"), F.lit(128.0))).head()[0])
    sources = scratch.keep(apportion(targets, block), "sources")

    # Places in the stream: sums within (source, hash range), then over a source's ranges.
    bits = max(0, (rows // BUCKET).bit_length())
    hashed = (
        sizes.join(sources.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
        .drop("s")
        .withColumn("h", seeded_hash(seed, F.coalesce("doc_id", "t")))
    )
    hashed = hashed.withColumn("range", F.shiftright("h", 60 - bits) if bits else F.lit(0).cast("long"))
    inner = Window.partitionBy("number", "range").orderBy("h", "doc_id", "size", "t", *keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = (
        hashed.groupBy("number", "range")
        .agg(F.sum("size").alias("s"))
        .withColumn("base", F.sum("s").over(Window.partitionBy("number").orderBy("range")) - F.col("s"))
        .drop("s")
    )
    placed = (
        hashed.withColumn("local", F.sum("size").over(inner) - F.col("size"))
        .join(before, ["number", "range"])
        .withColumn("at", F.col("base") + F.col("local"))
        .select("doc_id", "source", "number", "size", "source_size", "target", "at", *keys)
    )

    shards = (
        sources.where("quota > 0")
        .select("number", "blocks", "quota", F.explode(F.expr(f"sequence(0L, (blocks - 1) div {SHARD})")).alias("shard"))
        .withColumn("lo", F.col("shard") * SHARD)
        .withColumn("hi", F.least(F.col("blocks"), F.col("lo") + SHARD))
    )
    shards = shards.withColumn("share", F.expr("quota * hi div blocks - quota * lo div blocks"))
    seeded = Window.partitionBy("number", "shard").orderBy(seeded_hash(seed, "number", "block"), "block")
    taken = (
        shards.select("number", "shard", "share", F.explode(F.expr("sequence(lo, hi - 1)")).alias("block"))
        .withColumn("r", F.row_number().over(seeded))
        .where("r <= share")
        .select("number", "block")
    )

    turns = (
        placed.where("size > 0")
        .select("*", F.explode(F.array(*[F.lit(r) for r in range(REPEATS)])).alias("round"))
        .withColumn("from", F.col("at") + F.col("round") * F.col("source_size"))
    )
    pieces = turns.select("*", F.explode(F.expr(f"sequence(from div {block}, (from + size - 1) div {block})")).alias("block"))
    # A place tells documents with words apart, as doc_id may not.
    got = (
        pieces.join(taken.hint("merge"), ["number", "block"])
        .select("number", "at", F.struct("round", (F.greatest(F.col("from"), F.col("block") * block) - F.col("from")).alias("lo"), (F.least(F.col("from") + F.col("size"), (F.col("block") + 1) * block) - F.col("from")).alias("hi")).alias("span"))
    )
    got = (
        got.groupBy("number", "at")
        .agg(F.sum(F.col("span.hi") - F.col("span.lo")).alias("taken"), F.sort_array(F.collect_list("span")).alias("spans"))
    )
    none = (
        placed.where("size = 0")
        .select("doc_id", "source", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"), F.lit(None).cast(got.schema["spans"].dataType).alias("spans"), *keys)
    )
    some = (
        placed.where("size > 0")
        .join(got, ["number", "at"], "left")
        .select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"), "spans", *keys)
    )
    return some.unionByName(none)


def mixed_documents(docs: DataFrame, seed: int = 11) -> DataFrame:
    """The documents of the mix, with the columns of ``docs``: the words taken of each, first those of the first round. Whole
    documents keep their white space."""
    rows = numbered(docs, Scratch(docs.sparkSession, "mixed"))
    spans = mix(rows, seed, ("_row",)).where("taken > 0").select("_row", "size", "taken", "spans")
    whole = "taken = size AND size(filter(spans, s -> s.round <> spans[0].round)) = 0"
    words = F.split(F.trim(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " ")), " ")
    # The words are bound once, not split anew for each span.
    cut = F.transform(F.array(words), lambda w: F.array_join(F.flatten(F.transform("spans", lambda s: F.slice(w, (s.lo + 1).cast("int"), (s.hi - s.lo).cast("int")))), " "))[0]
    out = rows.join(spans.hint("merge"), "_row").withColumn("text", F.when(F.expr(whole), F.col("text")).otherwise(cut))
    return (out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out).select(docs.columns)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


#: Seats are dealt to the highest of all quotients, and words are placed and cut in one window; no shortcut is shared with the above.
OP10_SQL = r"""
WITH z AS MATERIALIZED (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, ('0x' || substr(md5('11:' || doc_id), 1, 15))::BIGINT AS h FROM documents),
s AS (SELECT *, [5, 2, 1][number % 3 + 1] AS weight FROM (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS number FROM z GROUP BY source)),
o AS (SELECT *, sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE - coalesce(sum(2 * source_size) OVER w, 0)::DOUBLE AS rest, sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS open_
  FROM s WINDOW w AS (ORDER BY source_size::DOUBLE / weight, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, 2 * source_size <= weight * rest / open_ AS full_ FROM o),
t AS MATERIALIZED (SELECT source, number, source_size, CASE WHEN full_ THEN 2.0::DOUBLE * source_size ELSE weight * (SELECT rest / open_ FROM f WHERE NOT full_ ORDER BY source_size::DOUBLE / weight, number LIMIT 1) END AS target FROM f),
b AS MATERIALIZED (SELECT greatest(1, least(128, floor(min(target))))::BIGINT AS b FROM t WHERE target > 0),
q AS (SELECT number, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, number) AS r FROM t, b, LATERAL (SELECT unnest(range(0, (target / b)::BIGINT + 100)) AS k) WHERE target > 0),
c AS MATERIALIZED (SELECT t.*, b, ceil(2 * source_size / b)::BIGINT AS blocks, least(ceil(2 * source_size / b)::BIGINT, coalesce(won, 0)) AS quota FROM t, b LEFT JOIN (SELECT number AS n, count(*) AS won FROM q WHERE r <= (SELECT floor(sum(target) / any_value(b) + 0.5) FROM t, b) GROUP BY n) ON n = t.number),
every AS (SELECT number, block, block // 1024 AS shard, blocks, quota, ('0x' || substr(md5('11:' || number || ':' || block), 1, 15))::BIGINT AS h FROM c, LATERAL (SELECT unnest(range(0, blocks)) AS block) WHERE quota > 0),
taken AS MATERIALIZED (SELECT number, block FROM (SELECT *, row_number() OVER (PARTITION BY number, shard ORDER BY h, block) AS r FROM every) WHERE r <= quota * least(blocks, shard * 1024 + 1024) // blocks - quota * (shard * 1024) // blocks),
placed AS MATERIALIZED (SELECT doc_id, size, number, source_size, target, b, sum(size) OVER (PARTITION BY number ORDER BY h, doc_id ROWS UNBOUNDED PRECEDING) - size AS at_ FROM z JOIN c ON z.source IS NOT DISTINCT FROM c.source),
spans AS (SELECT doc_id, number, b, size, (at_ + turn * source_size)::BIGINT AS lo FROM placed, (VALUES (0), (1)) v(turn) WHERE size > 0),
cut AS (SELECT doc_id, sum(least(lo + size, (p.block + 1) * b) - greatest(lo, p.block * b)) AS words FROM (SELECT *, unnest(range(lo // b, (lo + size - 1) // b + 1)) AS block FROM spans) p JOIN taken USING (number, block) GROUP BY doc_id)
SELECT p.doc_id, p.size, p.source_size, p.target, coalesce(words, 0)::BIGINT AS taken FROM placed p LEFT JOIN cut USING (doc_id)
"""
