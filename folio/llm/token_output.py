"""Token-ID output: zstandard frames, one per document, under one shared trained dictionary.

A shard is a binary file::

    header   b"TOKSHARD" | u8 version | u8 bytes per id | 32 bytes SHA-256 of the dictionary | \\n
    frame    one zstandard frame of little-endian ids for each document, in ascending doc_id order, | \\n
    footer   zstandard frame of the index rows | u64 its length | b"TOKINDEX" | \\n

An index row is (doc_id, offset, length, ids); any document is one seek and one
small decompression away. ``dictionary/`` beside ``shards/`` holds the dictionary.

The number of shards follows the bytes of text, so that a shard stays far below what one
file row may hold however large the corpus is.

Null text counts as empty and gives the end id alone. A null doc_id sorts first
and is kept. Rows with equal (or null) doc_id are all kept, in order of a hash of
their text, and may spread over several shards. Texts of any length are one frame.
An empty table gives no shards and no rows. Other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import struct
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, give_back, table

MAGIC, END, VERSION = b"TOKSHARD", b"TOKINDEX", 1
HEADER, HEADER_BYTES = "<8sBB32s", struct.calcsize("<8sBB32s")
NO_ID = -(1 << 63)  # stands for a null doc_id in the index


#: The normaliser and pre-tokeniser under which text may be encoded word by word (fixed values).
BY_WORD = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
)
#: Words of printable Latin-1, and the same split for them in lower case, with letters and numbers written out.
PLAIN = r"^[\x21-\x7E\x{A1}-\x{AC}\x{AE}-\x{FF}]*$"
LATIN = r"'(?:s|t|re|ve|m|ll|d)|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|[^\sa-zªµºß-öø-ÿ0-9²³¹¼½¾]+"


class _Pieces(dict):
    """Ids of pieces as bytes: of what the pre-tokeniser leaves whole by the tokenizer's own model, of anything odd by the
    whole tokenizer. They are made once and remembered; of two generations, the older one goes when the younger is full."""

    def __init__(self, tokenizer: object, width: int, held: int) -> None:
        super().__init__()
        keep = {*range(33, 127), *range(161, 173), *range(174, 256)}
        spare = iter(range(256, 512))
        byte = {b: chr(b if b in keep else next(spare)) for b in range(256)}
        self.tokenizer, self.model, self.held, self.old = tokenizer, tokenizer.model, held, {}
        self.bytes = {c: "".join(byte[b] for b in chr(c).encode()) for c in range(128, 256)}
        self.of_id = [i.to_bytes(width, "little") for i in range(tokenizer.get_vocab_size())]

    def make(self, piece: str) -> bytes:
        of_id, odd = self.of_id, "<|" in piece or not piece.isprintable()
        if not odd and piece.isascii():
            return b"".join([of_id[t.id] for t in self.model.tokenize(piece)])
        if not odd and max(piece) <= "ÿ":
            return b"".join([of_id[t.id] for t in self.model.tokenize(piece.translate(self.bytes))])
        return b"".join([of_id[i] for i in self.tokenizer.encode(piece, add_special_tokens=False).ids])

    def all(self, pieces: list[str]) -> list[bytes]:
        young, old, of_id, tokenize, out = self, self.old, self.of_id, self.model.tokenize, []
        for p in pieces:
            ids = young.get(p)
            if ids is None:
                ids = old.get(p)
                if ids is None:  # letters and digits alone are the common case
                    ids = b"".join([of_id[t.id] for t in tokenize(p)]) if p.isascii() and p.isalnum() else self.make(p) if p else b""
                young[p] = ids
            out.append(ids)
        if len(young) >= self.held:
            self.old = young.copy()
            young.clear()
        return out


def _strung(values: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of values that begin at ``first``, one after another, and where each ends up."""
    upto = np.r_[0, np.cumsum(size)]
    return values[np.repeat(first - upto[:-1], size) + np.arange(upto[-1])], upto


@functools.cache  # a worker's later tasks find the pieces of the earlier ones
def encoder(tokenizer_path: str, width: int, held: int = 60_000) -> Callable[[pa.Array], list[bytes]]:
    """Whole texts to ids as little-endian bytes, ``width`` for each id, without special tokens. A tokenizer that drops
    white space gets each distinct piece of a batch's distinct words once, and its ids are remembered; any other gets
    whole texts."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer, kind = Tokenizer.from_file(tokenizer_path), "H" if width == 2 else "I"
    made = json.loads(tokenizer.to_str())
    if (made["normalizer"], made["pre_tokenizer"]) != BY_WORD or any(t["lstrip"] or t["rstrip"] or t["single_word"] or not t["content"].startswith("<|") for t in made["added_tokens"]):
        return lambda texts: [array(kind, e.ids).tobytes() for e in tokenizer.encode_batch(texts.fill_null("").to_pylist(), add_special_tokens=False)]
    known = _Pieces(tokenizer, width, held)

    def encode(texts: pa.Array) -> list[bytes]:
        rows = pc.split_pattern(pc.replace_substring(texts.fill_null(""), "\n", " "), " ")
        words = pc.dictionary_encode(rows.flatten())
        plain = pc.and_(pc.match_substring_regex(words.dictionary, PLAIN), pc.invert(pc.match_substring(words.dictionary, "<|")))
        split = pc.split_pattern(pc.if_else(plain, pc.replace_substring_regex(pc.utf8_lower(words.dictionary), LATIN, r"\0 "), words.dictionary), " ")
        pieces = pc.dictionary_encode(split.flatten())
        ids = known.all(pieces.dictionary.to_pylist())
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // width
        which = pieces.indices.to_numpy()
        of_words, upto = _strung(np.frombuffer(b"".join(ids), f"<u{width}"), (np.cumsum(size) - size)[which], size[which])
        upto = upto[np.r_[0, np.cumsum(pc.list_value_length(split).to_numpy())]]
        which = words.indices.to_numpy()
        data, ends = _strung(of_words, upto[:-1][which], np.diff(upto)[which])
        data, ends = data.tobytes(), (ends[np.r_[0, np.cumsum(pc.list_value_length(rows).to_numpy())]] * width).tolist()
        return [data[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]

    return encode


def _groups(texts: pa.Array, chars: int = 1_500_000) -> Iterator[slice]:
    """Runs of texts of about so many characters together."""
    upto = np.cumsum(pc.utf8_length(texts).fill_null(0).to_numpy(zero_copy_only=False)) // chars
    cuts = [0, *(np.flatnonzero(np.diff(upto)) + 1).tolist(), len(texts)]
    yield from (slice(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if a < b)


def train_dictionary(docs: DataFrame, tokenizer_path: str, width: int, sample_docs: int = 1024, max_chars: int = 8192, size: int = 65_536) -> bytes:
    """From the documents of at most ``max_chars`` characters among the ``sample_docs`` lowest by a hash of doc_id: shared
    context pays on short documents. It only steers compression; the ids that come back do not depend on it."""
    ids = [r.doc_id for r in docs.where("doc_id IS NOT NULL").select("doc_id").distinct().orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").limit(sample_docs).collect()]
    rows = docs.where(F.col("doc_id").isin(ids) & F.length("text").between(1, max_chars)).select("text").orderBy(F.xxhash64("text"), "text").limit(sample_docs).collect() if ids else []
    samples = encoder(tokenizer_path, width)(pa.array([r.text for r in rows], pa.string()))
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on: they are the dictionary
        return b"".join(samples)[-size:]


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    kind = zstandard.DICT_TYPE_AUTO if data[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
    return zstandard.ZstdCompressionDict(data, dict_type=kind) if data else None


def shard_count(docs: DataFrame, shard_bytes: int, least_bytes: int = 4 << 20) -> int:
    """Shards of at most about ``shard_bytes`` of text; of less, while there are fewer than eight for each core."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).head()[0]
    return max(1, -(-size // shard_bytes), min(8 * docs.sparkSession.sparkContext.defaultParallelism, -(-size // least_bytes)))


def write_shards(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, level: int = 1, shard_bytes: int = 256 << 20) -> None:
    """Writes ``docs`` (doc_id, text) under ``path``. One range shuffle orders them."""
    from tokenizers import Tokenizer

    spark, docs = docs.sparkSession, docs.select(F.col("doc_id").cast("long"), "text")
    width = 2 if max(Tokenizer.from_file(tokenizer_path).get_vocab_size(), end_id + 1) <= 1 << 16 else 4
    dictionary = train_dictionary(docs, tokenizer_path, width)
    spark.createDataFrame([(bytearray(dictionary), hashlib.sha256(dictionary).hexdigest(), str(tokenizer_path).rsplit("/", 1)[-1])], "dictionary binary, sha256 string, tokenizer string").coalesce(1).write.parquet(f"{path}/dictionary")
    end = array("H" if width == 2 else "I", [end_id]).tobytes()

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, zstd, index, at = encoder(tokenizer_path, width), zstandard.ZstdCompressor(level=level, dict_data=_dictionary(dictionary)), [], 0
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for part in _groups(texts):
                out = []
                if not index:
                    out.append(struct.pack(HEADER, MAGIC, VERSION, width, hashlib.sha256(dictionary).digest()))
                    at = len(out[0]) + 1
                for doc_id, data in zip(ids[part], encode(texts[part]), strict=True):
                    out.append(zstd.compress(data + end))
                    index.append((NO_ID if doc_id is None else doc_id, at, len(out[-1]), len(data) // width + 1))
                    at += len(out[-1]) + 1
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])
        if index:
            rows = zstandard.compress(array("q", [x for row in index for x in row]).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([rows + struct.pack("<Q8s", len(rows), END)], pa.binary())], ["record"])
        give_back()

    tie = F.xxhash64("text")
    ordered = docs.repartitionByRange(shard_count(docs, shard_bytes), "doc_id", tie).sortWithinPartitions("doc_id", tie)
    # The text sink writes a string's bytes as they are: Spark's committer thereby covers binary files on any file system.
    ordered.mapInArrow(records, "record binary").select(F.col("record").cast("string")).write.option("lineSep", "\n").text(f"{path}/shards")


def read_index(data: bytes | memoryview) -> list[tuple[int | None, int, int, int]]:
    """(doc_id, offset, length, ids) of each document of a shard."""
    size, end = struct.unpack("<Q8s", data[-17:-1])
    if end != END or bytes(data[:8]) != MAGIC:
        raise ValueError("not a whole token shard")
    rows = array("q", zstandard.decompress(bytes(data[-17 - size : -17])))
    return [(None if rows[i] == NO_ID else rows[i], *rows[i + 1 : i + 4]) for i in range(0, len(rows), 4)]


def read_document(data: bytes | memoryview, offset: int, length: int, dictionary: bytes) -> array:
    """The ids of one document of a shard, by its index row."""
    _, version, width, sha = struct.unpack(HEADER, data[:HEADER_BYTES])
    if version != VERSION or sha != hashlib.sha256(dictionary).digest():
        raise ValueError("the shard was written with another version or dictionary")
    frame = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary)).decompress(bytes(data[offset : offset + length]))
    return array("I", array("H" if width == 2 else "I", frame))


def _shards(spark: SparkSession, path: str) -> tuple[DataFrame, bytes]:
    head = spark.read.parquet(f"{path}/dictionary").head()
    dictionary = bytes(head.dictionary)
    if hashlib.sha256(dictionary).hexdigest() != head.sha256:
        raise ValueError("the dictionary is damaged")
    return spark.read.format("binaryFile").load(f"{path}/shards").where("length > 0").select("path", "content"), dictionary


def read_shards(spark: SparkSession, path: str, doc_ids: list[int] | None = None, with_ids: bool = True) -> DataFrame:
    """shard, seq, doc_id, local_start, n_tokens, ids_crc32 and (``with_ids``) token_ids of all documents, or of those named."""
    files, dictionary = _shards(spark, path)
    wanted = None if doc_ids is None else frozenset(doc_ids)
    schema = "shard string, seq long, doc_id long, local_start long, n_tokens long, ids_crc32 long" + ", token_ids array<long>" * with_ids

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zstd = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                data, start = memoryview(content.as_buffer()), 0
                _, version, width, sha = struct.unpack(HEADER, data[:HEADER_BYTES])
                if version != VERSION or sha != hashlib.sha256(dictionary).digest():
                    raise ValueError("the shard was written with another version or dictionary")
                rows: list[tuple] = []
                for seq, (doc_id, offset, length, n) in enumerate(read_index(data)):
                    if wanted is None or doc_id in wanted:
                        ids = zstd.decompress(bytes(data[offset : offset + length]))
                        ids = np.frombuffer(ids, f"<u{width}").astype("<u4")
                        if len(ids) != n:
                            raise ValueError(f"document {doc_id} is damaged")
                        rows.append((name.as_py(), seq, doc_id, start, n, zlib.crc32(ids), *([ids.tolist()] if with_ids else [])))
                    start += n
                    if len(rows) >= 2000:
                        yield _batch(rows, with_ids)
                        rows = []
                if rows:
                    yield _batch(rows, with_ids)

    return files.mapInArrow(decode, schema)


def _batch(rows: list[tuple], with_ids: bool) -> pa.RecordBatch:
    kinds = [pa.string(), *[pa.int64()] * 5, *[pa.list_(pa.int64())] * with_ids]
    names = ["shard", "seq", "doc_id", "local_start", "n_tokens", "ids_crc32", "token_ids"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names[: len(kinds)])


def token_digest(docs: DataFrame, tokenizer_path: str, end_id: int = 2, path: str | None = None) -> DataFrame:
    """Writes the shards, reads them back, and gives doc_id, start, n_tokens, ids_crc32, shard, seq for each document."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "tokens")
    path = path or scratch.path("corpus")
    write_shards(docs, path, tokenizer_path, end_id)
    index = scratch.keep(read_shards(spark, path, with_ids=False), "index")
    # One row for each shard: the order of their first documents is the order of the corpus.
    totals = index.groupBy("shard").agg(F.sum("n_tokens").alias("ids"), F.min("doc_id").alias("first"))
    base = totals.select("shard", (F.sum("ids").over(Window.orderBy(F.col("first").asc_nulls_first(), "shard")) - F.col("ids")).alias("base"))
    return index.join(base, "shard").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32", "shard", "seq")


def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_digest(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2).drop("shard", "seq")
