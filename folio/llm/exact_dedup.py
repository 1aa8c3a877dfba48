"""Exact deduplication over a log-structured merge index, in DataFrame functions only.

Memtables: each task's share of a batch is digested and flushed as a sorted run of rows.
Flushed runs are compacted in generations to entries (digest, smallest identifier, number
of rows), and entries of several generations to one level, where the smallest identifier
of each digest stays. Each generation has a Bloom filter. An entry that no other
generation's filter knows is settled and not merged at all; the others are merged. Batches
can be appended later: ``lookup`` asks the filters first, and reads entries only for what
they let through. A row whose digest has another row is a hit, and its bytes are compared
with those of the digest's keeper before it goes.

Null text counts as empty; texts are equal after each run of white space is one space.
Rows that differ from the keeper of their digest form groups by their whole text. Rows of
equal text and equal doc_id all stay. A null doc_id loses to any other; of a text whose
rows all lack one, all stay. Texts of any length are read whole. An empty table gives no
rows. Other columns are ignored, also those of the same names as results.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, Scratch, table, text_or_empty

#: Rows of one group of copies that a task compares with their keeper.
SHARE = 512
#: Generations that one batch is flushed to, bits of a filter's block, bits for each digest, and hashed ones of these.
GENERATIONS, BLOCK, BITS, HASHES = 4, 32768, 16, 4


def normalised(name: str = "text") -> Column:
    return F.regexp_replace(text_or_empty(name), SPACE, " ")


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


class DigestIndex:
    """Sorted runs of rows (digest, doc_id and what comes along), and the entries that they are compacted to."""

    def __init__(self, scratch: Scratch) -> None:
        self.scratch, self.runs, self.open, self.generations = scratch, [], [], 0

    def append(self, rows: DataFrame) -> None:
        """Flushes a batch of (digest, doc_id, ...) and compacts its runs by generation."""
        generation = F.pmod(F.spark_partition_id(), F.lit(GENERATIONS)) + self.generations
        self.generations += GENERATIONS
        run = self.scratch.keep(rows.withColumn("generation", generation).sortWithinPartitions("generation", "digest", "doc_id"), "runs")
        self.runs.append(run)
        entries = run.groupBy("generation", "digest").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"), F.min("sha").alias("sha"))
        self.open.append(self.scratch.keep(entries.sortWithinPartitions("digest"), "entries"))

    def rows(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self.runs)

    def entries(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self.open)

    def _filters(self) -> tuple[DataFrame, int]:
        """(block, known: generation and bits) of a blocked Bloom filter for each generation, and the number of blocks."""
        blocks = max(1, -(-self.entries().count() * BITS // BLOCK))
        places = self.entries().select("generation", _block(blocks).alias("block"), F.explode(F.array(*map(_place, range(HASHES)))).alias("at"))
        bits = places.groupBy("block", "generation").agg(F.bitmap_construct_agg("at").alias("bits"))
        return self.scratch.keep(bits.groupBy("block").agg(F.collect_list(F.struct("generation", "bits")).alias("known")), "filters"), blocks

    def _probed(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``maybe``: whether the filter of a generation other than their own knows their digest."""
        filters, blocks = self._filters()

        def has(known: Column) -> Column:
            byte = [F.conv(F.hex(F.substring(known["bits"], F.floor(_place(i) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int") for i in range(HASHES)]
            hit = [F.call_function("shiftright", byte[i], (_place(i) % 8).cast("int")).bitwiseAND(1) == 1 for i in range(HASHES)]
            return (known["generation"] != F.col("generation")) & reduce(Column.__and__, hit)

        return rows.withColumn("block", _block(blocks)).join(filters, "block", "left").withColumn("maybe", F.coalesce(F.exists("known", has), F.lit(False))).drop("block", "known")

    def compact(self) -> DataFrame:
        """Merges all generations to one: generation, digest, keep_id, group_size, sha."""
        if len(self.open) == 1 and self.generations == 1:
            return self.open[0]
        probed = self.scratch.keep(self._probed(self.entries()), "probed")
        merged = probed.where("maybe").groupBy("digest").agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"), F.min("sha").alias("sha"))
        names = ("digest", "keep_id", "group_size", "sha")
        level = probed.where("NOT maybe").select(*names).unionByName(merged.select(*names)).select(F.lit(0).alias("generation"), *names)
        level = self.scratch.keep(level.sortWithinPartitions("digest"), "level")
        self.scratch.drop(probed, *self.open)
        self.open, self.generations = [level], 1
        return level

    def lookup(self, digests: DataFrame) -> DataFrame:
        """digest, keep_id, group_size of those of the given digests that the index has."""
        asked = self.scratch.keep(self._probed(digests.select("digest", F.lit(-1).alias("generation")).distinct()).where("maybe").select("digest"), "asked")
        return self.entries().join(asked, "digest").groupBy("digest").agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))


def _block(blocks: int) -> Column:
    return F.pmod(F.xxhash64("digest", F.lit(17)), F.lit(blocks))


def _place(i: int) -> Column:
    return F.pmod(F.xxhash64("digest", F.lit(i)), F.lit(BLOCK))


def exact_groups(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row. ``digest`` only finds the hits."""
    scratch = Scratch(docs.sparkSession, "dedup")
    index = DigestIndex(scratch)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("key", F.xxhash64("doc_id", "text"))
    text = normalised()
    sha = F.lit(None).cast("string") if digest is sha256 else sha256(text)  # null: the digest
    index.append(docs.select(digest(text).alias("digest"), "doc_id", "key", sha.alias("sha")))
    level = index.compact()
    shared = scratch.keep(level.where("group_size > 1").select("digest", "keep_id", "group_size"), "shared")
    hits = scratch.keep(index.rows().select("digest", "doc_id", "key", "sha").join(shared, "digest"), "hits")

    # The texts of hits are compared with their keeper's in shares, so that no group needs one task.
    members = docs.join(hits.select("key", "digest", "keep_id", "group_size").distinct(), "key").withColumn("text", normalised()).where(digest(F.col("text")) == F.col("digest"))
    members = scratch.keep(members.withColumn("share", F.pmod(F.xxhash64("doc_id", F.rand(3)), F.ceil(F.col("group_size") / SHARE).cast("long"))), "members")
    keepers = members.where("doc_id <=> keep_id").groupBy("digest", "group_size").agg(F.min("text").alias("kept_text"))
    keepers = keepers.select("digest", "kept_text", F.explode(F.expr(f"sequence(0L, CAST(ceil(group_size / {SHARE}) AS LONG) - 1)")).alias("share"))
    other = scratch.keep(members.join(keepers, ["digest", "share"]).where("text <> kept_text").select("digest").distinct(), "other")

    alone = level.where("group_size = 1").select(F.col("keep_id").alias("doc_id"), "keep_id", "group_size", F.coalesce("sha", "digest").alias("sha"))
    copies = hits.select("doc_id", "keep_id", "group_size", F.coalesce("sha", "digest").alias("sha"), "digest")
    if not other.isEmpty():  # one digest for several texts: those go by their whole text
        by_text = members.join(other, "digest", "left_semi").groupBy("digest", sha256(F.col("text")).alias("sha"), "text").agg(F.min("doc_id").alias("keep"), F.count("*").alias("size"))
        by_text = scratch.keep(by_text.drop("text").withColumn("found", F.lit(True)), "by_text")
        own = lambda new, old: F.when(F.col("found"), F.col(new)).otherwise(F.col(old)).alias(old)
        copies = copies.join(by_text, ["digest", "sha"], "left").select("doc_id", own("keep", "keep_id"), own("size", "group_size"), "sha")
    result = alone.unionByName(copies.select(alone.columns))
    scratch.drop(members)
    return result.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


OP6_SQL = r"""
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = min(doc_id) OVER same AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
WINDOW same AS (PARTITION BY t)
"""
