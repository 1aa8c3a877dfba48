"""Exact n-gram Jaccard join by parity sketches.

A document's set of word shingles toggles bits of a sketch, one hashed bit for each
shingle, so that the Hamming distance of two sketches is at most the symmetric
difference of the sets. The sketch is cut into words by the leading hash bits; a word,
sparse and very wide, is named by the exclusive or of its bits' hashes.

With similarity 0.75 or more, sets of at most n and 4n/3 shingles differ in at most
n/3 of them. Of m words, all but that many are equal: each document keeps its n//3 + 1
rarest non-empty words and a similar document shares one of them (pigeonhole, then the
prefix-filter argument with words in order of frequency). Words are counted within a
size band; documents in the top quarter of a band enter the next band as well. A word
that no other document has is rarest of all, so a document with n//3 + 1 such words is
alone and leaves at once: what is left is little more than the true near-copies.

Candidates are verified on whole sets. Links are found by rounds of one candidate a
document, the nearest by sketch of those that lead its words; then all candidates that are
still in different components are tested, those with too distant sketches excepted.

Null or empty text has an empty set and no links: its component is its own doc_id. Each
row is linked by its own text, whatever its doc_id: rows of a null doc_id link like others
and repeated rows and texts too (equal sets link). A component's id is the smallest doc_id
in it, null if all of them are. Texts of any length are read whole; documents of equal
distance are taken in order of their hashes, which does not change components. An empty
table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, give_back, table
from .graph import components

U = np.uint64
PRIMES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], U)
MASK = (1 << 64) - 1
#: Longs of the bit sketch that tests a candidate before its sets are read.
SKETCH = 16
#: Numbered words of a family that a pair's first common word is looked for in.
WORD_BITS = 512
#: Bits of a word's name besides those of its bucket; a clash costs a candidate, never a link.
LOW = 40
ENTRY = np.dtype([("low", "<u4"), ("high", "u1"), ("id", "<i8")])


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 60_000:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def shingles(text: str | None, hashes: WordHashes, k: int = 5) -> np.ndarray:
    """Sorted hashes of the distinct k-word shingles of a whole text; fewer words are one shingle, none give none."""
    words = (text or "").encode().lower().split()  # for bytes: A-Z only, and the six ASCII white space characters
    n = len(words)
    if not n:
        return np.empty(0, U)
    one = np.fromiter(map(hashes.__getitem__, words), U, n)
    if n < k:
        return mix(np.array([(int((one * PRIMES[:n]).sum()) + n) & MASK], U))
    many = one[: n - k + 1] * PRIMES[0]
    for i in range(1, k):
        many += one[i : n - k + 1 + i] * PRIMES[i]
    many = mix(many)
    many.sort()
    return many[np.r_[True, many[1:] != many[:-1]]]


def words_of_band(band: int) -> int:
    """Sketch words in the band of 2**band to 2**(band + 1) - 1 shingles: enough that non-empty ones outnumber n // 3."""
    top = 2 << band
    return 64 if band < 4 else int(0.42 * top + 2.2 * top**0.5) + 1


def sketch_words(s: np.ndarray, band: int) -> np.ndarray:
    """Names of the non-empty sketch words."""
    m = words_of_band(band)
    part = ((s >> U(32)) * U(m)) >> U(32)
    first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
    return mix(np.bitwise_xor.reduceat(mix(s + U(1)), first) + part[first] * PRIMES[1] + U(band * int(PRIMES[2]) & MASK))


def set_name(s: np.ndarray) -> int:
    """Equal sets have equal names, other sets (but for 64-bit accidents) have others."""
    x = (int(mix(s ^ PRIMES[3]).sum()) + len(s) * int(PRIMES[4])) & MASK
    return x - (x >> 63 << 64)


def _shared_words(docs: DataFrame, buckets: int) -> DataFrame:
    """One pass and one shuffle: rows for documents (doc_id, n, name, and the id and words of each band),
    and rows (word, id) for each sketch word that several sets have."""
    bits = buckets.bit_length() - 1
    schema = "bucket int, doc_id long, key long, n long, name long, id1 long, words1 int, id2 long, words2 int, blob binary"
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    types = pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in schema.split(", "))])
    about = list(types)[1:9]

    def blobs(words: list[np.ndarray], ids: list[tuple[int, int]]) -> Iterator[tuple[int, bytes]]:
        word = np.concatenate(words) >> U(64 - LOW - bits)
        own = np.repeat(np.array([i for i, _ in ids], np.int64), [n for _, n in ids])
        order = np.argsort(word, kind="stable")
        word, own = word[order], own[order]
        first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        rank = np.arange(len(word)) - np.repeat(first, np.diff(np.r_[first, len(word)]))
        known = rank >= 2  # two tell every other task that the word is shared; the rest needn't meet in one place
        entry = np.empty(len(word), ENTRY)
        entry["low"], entry["high"], entry["id"] = (word & U(0xFFFFFFFF)), ((word >> U(32)) & U(0xFF)), own
        bucket = (word >> U(LOW)).astype(np.int64)
        for side, at in ((~known, 0), (known, buckets)):
            e, b = entry[side], bucket[side]
            if not len(b):
                continue
            cuts = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
            for lo, hi in zip(cuts, [*cuts[1:], len(b)], strict=True):
                yield int(b[lo]) + at, e[lo:hi].tobytes()

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen, words, ids = WordHashes(), {}, [], []

        def flush() -> list[tuple]:
            rows = [(b, *[None] * len(about), blob) for b, blob in blobs(words, ids)] if words else []
            words.clear()
            ids.clear()
            return rows

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types.types, strict=True)], schema=types)

        for batch in batches:
            rows, size = [], 0
            for i, (doc_id, key, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(1), strict=True)):
                s = shingles(text.as_py(), hashes)
                if not len(s):
                    rows.append((-1 - i % 997, doc_id, key, 0, *[None] * 6))
                    continue
                name = set_name(s)
                if name not in seen:
                    if len(seen) > 20_000:
                        seen.clear()
                    n, own = len(s), []
                    band = n.bit_length() - 1
                    for k in (band, band + 1)[: 1 + (4 * n >= 3 * (2 << band))]:
                        w = sketch_words(s, k)
                        own += [(name ^ (k * 0x5851F42D4C957F2D)) & 0x7FFFFFFFFFFFFFFF, len(w)]
                        words.append(w)
                        ids.append((own[-2], len(w)))
                        size += len(w)
                    seen[name] = (n, name, *own, *[None] * (4 - len(own)))
                rows.append((-1 - i % 997, doc_id, key, *seen[name], None))
                if size >= 1 << 19:
                    yield batch_of(rows + flush())
                    rows, size = [], 0
            rows += flush()
            if rows:
                yield batch_of(rows)
        give_back()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = pa.schema([*about, ("word", pa.int64()), ("id", pa.int64())])

        def shared(bucket: int, data: list[bytes]) -> pa.RecordBatch:
            e = np.frombuffer(b"".join(data), ENTRY)
            word = e["low"].astype(np.int64) | (e["high"].astype(np.int64) << 32) | ((bucket % buckets) << LOW)
            own = e["id"]
            if bucket < buckets:
                order = np.lexsort((own, word))
                word, own = word[order], own[order]
                new = np.r_[True, (word[1:] != word[:-1]) | (own[1:] != own[:-1])]
                word, own = word[new], own[new]
                first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
                size = np.diff(np.r_[first, len(word)])
                kept = np.repeat(size > 1, size)
                word, own = word[kept], own[kept]
            return pa.RecordBatch.from_arrays([*[pa.nulls(len(word), f.type) for f in about], pa.array(word), pa.array(own)], schema=out)

        at, data = None, []
        for batch in batches:
            docs_here = batch.filter(pa.compute.less(batch.column(0), 0))
            if docs_here.num_rows:
                nothing = pa.nulls(docs_here.num_rows, pa.int64())
                yield pa.RecordBatch.from_arrays([*docs_here.columns[1:9], nothing, nothing], schema=out)
            for b, blob in zip(batch.column(0).to_pylist(), batch.column(9), strict=True):
                if b >= 0:
                    if b != at and data:
                        yield shared(at, data)
                        data = []
                    at = b
                    data.append(blob.as_py())
        if data:
            yield shared(at, data)
        give_back()

    dealt = (
        docs.select(F.col("doc_id").cast("long"), "text", text_key())
        .mapInArrow(sketch, schema).repartition("bucket")
        .sortWithinPartitions("bucket")
    )
    return dealt.mapInArrow(meet, schema.replace("bucket int, ", "").replace("blob binary", "word long, id long"))


def text_key() -> Column:
    """Tells the texts of a doc_id apart; texts that share a key by accident are only read in vain."""
    return F.xxhash64("text", F.col("doc_id").cast("long")).alias("key")


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """name, whole set and bit sketch of the texts with the wanted keys. Names come from the texts themselves."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                found = [s for t in part.column(0) if len(s := shingles(t.as_py(), hashes))]
                yield pa.RecordBatch.from_arrays([pa.array([set_name(s) for s in found], pa.int64()), pa.array([s.tobytes() for s in found], pa.binary()), pa.array([bit_sketch(s) for s in found], pa.list_(pa.int64()))], ["name", "shingles", "sketch"])
        give_back()

    return (
        docs.select("text", text_key())
        .join(wanted.select("key").distinct().hint("merge"), "key")
        .select("text")
        .mapInArrow(of, "name long, shingles binary, sketch array<long>")
    )


def bit_sketch(s: np.ndarray) -> np.ndarray:
    """Parity of the shingles that hash to each of the bits of SKETCH longs."""
    odd = np.bincount((s & U(64 * SKETCH - 1)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def apart(a: str, b: str) -> str:
    """The Hamming distance of two sketches, in SQL."""
    return " + ".join(f"bit_count({a}[{i}] ^ {b}[{i}])" for i in range(SKETCH))


def _far(a: str, b: str, percent: int) -> str:
    """The largest symmetric difference of a link between sets of a and b shingles, in SQL."""
    return f"({100 - percent} * ({a} + {b}) div {100 + percent})"


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b, ca, cb), those whose whole sets have ``percent`` or more in common."""

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["ca", "cb"]).filter(pa.array(good, pa.bool_()))

    left = sets.select(F.col("name").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("name").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("ca", "cb", "x", "y").mapInArrow(test, "ca long, cb long")


def _candidates(found: DataFrame) -> DataFrame:
    """(word, name, n): for each set that may have a partner, its rarest shared words, as many as the pigeonhole needs."""
    known = found.where("n > 0")
    sides = (
        known.select("name", "n", F.explode(F.array(F.struct(F.col("id1").alias("id"), F.col("words1").alias("words")), F.struct(F.col("id2").alias("id"), F.col("words2").alias("words")))).alias("s"))
        .select("name", "n", "s.*")
        .where("id IS NOT NULL")
        .distinct()
    )
    shared = found.where("word IS NOT NULL").select("word", "id").distinct()
    counts = shared.groupBy("id").agg(F.count("*").alias("shared"))
    # A set with n div 3 + 1 words of its own shares none of its prefix.
    room = sides.join(counts, "id").withColumn("room", F.expr("n div 3 + 1 - (words - shared)")).where("room > 0").select("id", "name", "n", "words")
    kept = shared.join(room, "id")
    often = kept.groupBy("word").agg(F.count("*").alias("often")).where("often > 1")
    rows = kept.join(often, "word")
    ranked = (
        rows.groupBy("id", "name", "n", "words")
        .agg(F.sort_array(F.collect_list(F.struct("often", "word"))).alias("by"))
        .withColumn("room", F.expr("n div 3 + 1 - (words - size(by))"))
        .where("room > 0")
    )
    return (
        ranked.select("name", "n", F.explode(F.slice("by", F.lit(1), F.col("room").cast("int"))).alias("w"))
        .select("w.word", "name", "n")
        .distinct()
    )


def _uncovered(words: DataFrame) -> DataFrame:
    """Without words whose sets all have another word in common: that one meets every pair of them already. Each set names
    its most frequent word; a word whose sets all name the same other one is covered by it."""
    often = words.groupBy("word").agg(F.count("*").alias("c"))
    named = words.join(often, "word").groupBy("name").agg(F.max(F.struct("c", "word"))["word"].alias("top"))
    kept = (
        words.join(named, "name")
        .groupBy("word")
        .agg(F.min("top").alias("lo"), F.max("top").alias("hi"))
        .where("lo <> hi OR lo = word")
        .select("word")
    )
    return words.join(kept, "word")


def _open_pairs(still: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """All pairs (a, b) from different components (ca, cb) that share a word and whose sketches are near enough.

    Near-copies share many words, but a pair is wanted once: at the first word that both have. Words are numbered within a
    family (sets connected through words), frequent ones first, and each set has a bitmap of its first WORD_BITS numbers.
    A pair without a common word among those is met at each later one."""
    own = scratch.keep(_uncovered(still.select("word", "name", "n", "component")).select("word", "name", "n", "component"), "own")
    heads = scratch.keep(own.groupBy("word").agg(F.min("name").alias("head"), F.count("*").alias("c")), "heads")
    family = components(own.join(heads, "word").select(F.col("name").alias("a"), F.col("head").alias("b")), scratch)
    order = Window.partitionBy("family").orderBy(F.desc("c"), "word")
    numbers = heads.join(family.toDF("head", "family"), "head", "left").select("word", "c", F.coalesce("family", "head").alias("family"))
    numbers = scratch.keep(numbers.select("word", (F.row_number().over(order) - 1).alias("i")), "numbers")
    parts = range(WORD_BITS // 64)
    # Every long has a column of its own: the test of a pair then reads no arrays.
    below = [F.expr(f"CASE WHEN i >= {64 * k + 64} THEN -1L WHEN i <= {64 * k} THEN 0L ELSE ~shiftleft(-1L, i - {64 * k}) END").alias(f"below{k}") for k in parts]
    bits = (
        own.join(numbers, "word")
        .groupBy("name")
        .agg(*[F.expr(f"bit_or(CASE WHEN i div 64 = {k} THEN shiftleft(1L, CAST(i % 64 AS INT)) ELSE 0L END)").alias(f"bits{k}") for k in parts])
    )
    sketch = [F.col("sketch")[k].alias(f"s{k}") for k in range(SKETCH)]
    own = (
        own.join(numbers, "word")
        .join(bits, "name")
        .join(sets.select("name", "sketch"), "name")
        .select("word", "name", "n", "component", *[f"bits{k}" for k in parts], *below, *sketch)
    )
    own = scratch.keep(own, "numbered")  # else the optimizer would join pairs first
    x, y = (own.toDF("word", *[c + v for c in own.columns[1:]]) for v in "ab")
    first = " AND ".join(f"(bits{k}a & bits{k}b & below{k}a) = 0" for k in parts)
    # The distance of the first longs is at most that of all: most pairs are told apart by few of them.
    near = " AND ".join("(" + " + ".join(f"bit_count(s{k}a ^ s{k}b)" for k in range(upto)) + f") <= {_far('na', 'nb', percent)}" for upto in (SKETCH // 4, SKETCH))
    pairs = (
        x.join(y.select("word", *[c for c in y.columns if not c.startswith("below")]), "word")
        .where(f"namea < nameb AND componenta <> componentb AND abs(na - nb) <= {_far('na', 'nb', percent)} AND {first} AND {near}")
    )
    return (
        pairs.select(F.col("namea").alias("a"), F.col("nameb").alias("b"), F.col("componenta").alias("ca"), F.col("componentb").alias("cb"))
        .distinct()
    )


def link_components(docs: DataFrame, percent: int = 75, rounds: int = 3) -> DataFrame:
    """doc_id, n_shingles, component_id for each row; documents of a component are linked through Jaccard similarities of
    ``percent`` or more. The sketch is laid out for 75 and finds all links at that or more."""
    if percent < 75:
        raise ValueError("sketch words are laid out for similarities of 75 percent and more")
    spark = docs.sparkSession
    scratch = Scratch(spark, "parity")
    # A task holds the words of one bucket, so of some ten thousand documents however many there are.
    buckets = 1 << min(64 - LOW, max(8, (docs.count() // 8192).bit_length()))
    found = scratch.keep(_shared_words(docs, buckets), "found")
    base = scratch.keep(found.where("n IS NOT NULL").select("doc_id", "key", "n", "name"), "base")
    prefixes = scratch.keep(_candidates(found), "prefixes")
    scratch.drop(found)
    words = scratch.keep(_uncovered(prefixes).withColumn("component", F.col("name")), "words")
    scratch.drop(prefixes)
    # Of each set its smallest doc_id (null if there is none), and a text that has it.
    first = base.where("name IS NOT NULL").groupBy("name").agg(F.min("doc_id").alias("doc_id"), F.min("key").alias("key"))
    sets = scratch.keep(_sets(docs, words.select("name").distinct().join(first, "name")).dropDuplicates(["name"]), "sets")
    merges, tried, linked = [], 0, 0
    for turn in range(rounds + 1):
        heads = (
            words.groupBy("word")
            .agg(F.min(F.struct(F.xxhash64("component", F.lit(turn)).alias("o"), "component", "name")).alias("h"), F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("c"))
            .where("lo < hi")
            .select("word", "h", "c")
        )
        still = scratch.keep(words.join(heads, "word"), "open")  # words that meet several components
        scratch.drop(words)
        rows, size = still.agg(F.count("*"), F.sum(F.expr("c - 1"))).head()
        if not rows:
            break
        last = turn == rounds or size <= 4 * rows or 20 * linked < tried  # few pairs, or most that share words aren't linked
        if last:
            pairs = _open_pairs(still, sets, percent, scratch)
        else:
            # each set tries the head whose sketch is nearest to its own
            own, other = sets.select("name", F.col("sketch").alias("x")), sets.select(F.col("name").alias("head"), F.col("sketch").alias("y"))
            met = (
                still.where("component <> h.component")
                .select("name", "component", "c", "h", F.col("h.name").alias("head"))
                .join(own, "name")
                .join(other, "head")
            )
            nearest = met.groupBy("name", "component").agg(F.min(F.struct(F.expr(apart("x", "y")).alias("d"), "c", "h")).alias("m"))
            pairs = nearest.select(F.col("name").alias("a"), F.col("m.h.name").alias("b"), F.col("component").alias("ca"), F.col("m.h.component").alias("cb"))
        pairs = scratch.keep(pairs, "pairs")
        links = scratch.keep(_verified(pairs, sets, percent), "links")
        tried, linked = pairs.count(), links.count()
        merges.append(scratch.keep(components(links.toDF("a", "b"), scratch), "merge"))
        if last:
            break
        moved = merges[-1].toDF("component", "to")
        words = scratch.keep(still.select("word", "name", "n", "component").join(moved, "component", "left").select("word", "name", "n", F.coalesce("to", "component").alias("component")), "words")
        scratch.drop(still, pairs, links)
    names = first.withColumn("component", F.col("name"))
    for merge in merges:
        names = (
            names.join(merge.toDF("component", "to"), "component", "left")
            .select("name", "doc_id", F.coalesce("to", "component").alias("component"))
        )
    least = names.groupBy("component").agg(F.min("doc_id").alias("least"))
    names = names.join(least, "component").select("name", "least")
    result = scratch.keep(base.join(names, "name", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("name").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id")), "result")
    scratch.keep_only(result)
    return result


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_components(table(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS t FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(t[i:i + 4], ' ') AS g FROM w, unnest(range(1, greatest(len(t) - 4, 1) + 1)) r(i) WHERE len(t) > 0),
n AS MATERIALIZED (SELECT w.doc_id, count(g) AS n FROM w LEFT JOIN s ON w.doc_id = s.doc_id GROUP BY w.doc_id),
links AS MATERIALIZED (SELECT x, y FROM (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL) JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT n.doc_id, n.n AS n_shingles, least_ AS component_id FROM n JOIN (SELECT x, min(y) AS least_ FROM reach GROUP BY x) ON x = n.doc_id
"""
