"""Token-ID / binary output: canonical length-limited Huffman coding of token ids.

A token store is a folder of three Parquet tables, so any file system that Spark reads can hold it and a
lost task is simply written again:

* ``codebook(id, length)``: the code length of every id that occurs. Codes are canonical: ascending by
  (length, id), each the next number at its length, so lengths alone give the codes.
* ``blocks(shard, block, start_in_shard, n_ids, doc_ids, doc_lens, payload, checkpoints)``: whole documents
  in ascending order of doc_id, about BLOCK_IDS ids a block. payload is the bit string of their codes, most
  significant bit first; checkpoints has the bit offset of every CHECKPOINT-th id, so decoding may begin at
  any of them, and all stretches of a block are decoded side by side through one lookup table.
* ``shards(shard, shard_start)``: ids before each shard.

Every document, null text (taken as empty) included, ends with the end id. Null doc_ids come first; rows with
equal doc_id follow in order of their text, so repeated rows are kept, each with its own place.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm.common import bounded_batches, drop_stored, lean, scratch_dir, stored

BLOCK_IDS = 1 << 18
CHECKPOINT = 256
MAX_LENGTH = 18
#: Pieces of text whose ids a Python worker remembers, and the longest of them in characters.
MEMO_PIECES, MEMO_CHARS = 400_000, 48

_ENCODERS: dict[str, "PieceEncoder"] = {}


class Memo(dict):
    """Remembers the ids that make() gives for short pre-tokens; starts anew when full."""

    def __init__(self, make: Callable[[str], bytes]):
        self.make = make

    def __missing__(self, key: str) -> bytes:
        ids = self.make(key)
        if len(key) <= MEMO_CHARS:
            if len(self) >= MEMO_PIECES:
                self.clear()
            self[key] = ids
        return ids


# The letters and digits of texts up to U+024F, for which Python's own expressions split like the tokenizer's pattern.
_L, _N = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
_FAST = re.compile(rf" ?[{_L}]+| ?[{_N}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[^\s{_L}{_N}]+|\s+(?!\S)|\s+")
_OTHER = re.compile("[\x1c-\x1f\u0250-\U0010ffff]")


class PieceEncoder:
    """Ids of whole texts under a byte-level BPE of the tokenizers library, which remembers the ids of pre-tokens.

    Pre-tokens are coded independently of each other, so the ids of a text are those of its pre-tokens one after the other.
    Texts that hold a special token's string go through the library as a whole.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.split = regex.compile(public_tokenizers.PATTERN).findall
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in printable]
        self.letters = {b: b for b in printable} | {b: 256 + k for k, b in enumerate(hidden)}
        self.packed = "H" if self.dtype.itemsize == 2 else "I"
        self.memo = Memo(self.encode_word)

    def encode_word(self, word: str) -> bytes:
        """Ids of one pre-token."""
        mapped = word.encode().decode("latin-1").translate(self.letters)
        return array(self.packed, [t.id for t in self.tokenizer.model.tokenize(mapped)]).tobytes()

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()
        split = self.split if _OTHER.search(text) else _FAST.findall
        return b"".join(map(self.memo.__getitem__, split(text)))


def encoder(path: str) -> PieceEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


def code_lengths(counts: np.ndarray, max_length: int = MAX_LENGTH) -> np.ndarray:
    """Optimal code lengths of at most max_length bits for positive counts (package-merge)."""
    n = len(counts)
    if n <= 1:
        return np.ones(n, np.int64)
    if n > 1 << max_length:
        raise ValueError(f"{n} symbols need codes of more than {max_length} bits")
    order = np.argsort(counts, kind="stable")
    leaves = counts[order].astype(np.float64)
    level, is_leaf = leaves, [np.ones(n, bool)]
    for _ in range(max_length - 1):
        packages = level[: len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
        merged = np.concatenate([leaves, packages])
        by = np.argsort(merged, kind="stable")
        level = merged[by]
        is_leaf.append(by < n)
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for flags in reversed(is_leaf):
        own = int(flags[:take].sum())
        lengths[:own] += 1
        take = 2 * (take - own)
    out = np.empty(n, np.int64)
    out[order] = lengths
    return out


class Codec:
    """Canonical codes from (ids, lengths); encodes and decodes arrays of ids."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray):
        order = np.lexsort((ids, lengths))
        ids, lengths = np.asarray(ids)[order], np.asarray(lengths)[order]
        self.width = int(lengths.max()) if len(lengths) else 1
        step = np.left_shift(1, self.width - lengths).astype(np.int64)
        first = np.cumsum(step) - step
        size = int(ids.max()) + 1 if len(ids) else 1
        self.code, self.length = np.zeros(size, np.uint64), np.zeros(size, np.int64)
        self.code[ids] = (first >> (self.width - lengths)).astype(np.uint64)
        self.length[ids] = lengths
        self.table = np.full(1 << self.width, 1 << 24, np.uint32)
        filled = np.repeat((lengths.astype(np.uint32) << np.uint32(24)) | ids.astype(np.uint32), step)
        self.table[: len(filled)] = filled

    def encode(self, ids: np.ndarray, every: int = CHECKPOINT) -> tuple[bytes, np.ndarray]:
        """The bit string, and the bit offset of every every-th id."""
        if not len(ids):
            return b"", np.zeros(0, np.uint32)
        code, length = self.code[ids], self.length[ids]
        end = np.cumsum(length)
        begin = end - length
        word, rest = begin >> 6, 64 - (begin & 63) - length
        left, over = np.maximum(rest, 0).astype(np.uint64), np.maximum(-rest, 0).astype(np.uint64)
        starts = np.flatnonzero(np.diff(word, prepend=-1))
        out = np.zeros(int(end[-1] >> 6) + 2, np.uint64)
        out[word[starts]] = np.bitwise_or.reduceat((code << left) >> over, starts)
        cut = np.flatnonzero(rest < 0)
        out[word[cut] + 1] |= code[cut] << (64 + rest[cut]).astype(np.uint64)
        return out.byteswap().tobytes()[: int(end[-1] + 7) // 8], begin[::every].astype(np.uint32)

    def decode(self, payload: bytes, n_ids: int, checkpoints: np.ndarray, every: int = CHECKPOINT) -> np.ndarray:
        """All stretches between checkpoints at once, one id of each at a step."""
        if not n_ids:
            return np.zeros(0, np.uint32)
        b = np.frombuffer(payload + bytes(4 * every + 8), np.uint8).astype(np.uint32)
        window = (b[:-3] << 24) | (b[1:-2] << 16) | (b[2:-1] << 8) | b[3:]
        at = checkpoints.astype(np.int64)
        out = np.empty((every, len(at)), np.uint32)
        down = np.uint32(32 - self.width)
        for k in range(min(every, n_ids)):
            entry = self.table[(window[at >> 3] << (at & 7).astype(np.uint32)) >> down]
            out[k] = entry & 0xFFFFFF
            at += entry >> 24
        return out.T.reshape(-1)[:n_ids]


_RAW = "shard int, block int, start_in_shard long, n_ids long, doc_ids array<long>, doc_lens array<long>, ids binary"


def _tokenise(path: str, end_id: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, shard = encoder(path), TaskContext.get().partitionId()
        end = np.array([end_id], enc.dtype).tobytes()
        width = enc.dtype.itemsize
        docs, lens, parts, n, start, block = [], [], [], 0, 0, 0

        def packed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([start], pa.int64()), pa.array([n], pa.int64()),
                    pa.array([docs], pa.list_(pa.int64())), pa.array([lens], pa.list_(pa.int64())), pa.array([b"".join(parts)], pa.binary()),
                ],
                ["shard", "block", "start_in_shard", "n_ids", "doc_ids", "doc_lens", "ids"],
            )

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = enc.encode(text.as_py() or "") + end
                docs.append(doc)
                lens.append(len(ids) // width)
                parts.append(ids)
                n += lens[-1]
                if n >= BLOCK_IDS:
                    yield packed()
                    start, block = start + n, block + 1
                    docs, lens, parts, n = [], [], [], 0
        if docs:
            yield packed()
        enc.memo.clear()

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", max_length: int = MAX_LENGTH) -> None:
    """Writes a token store of docs to path (see the module's text).

    Documents are dealt by ranges of (doc_id, text hash), so that even a third of all rows under one id spreads
    over tasks; each range is tokenised in order. Global counts come from the tokenised blocks: per-task sums of
    at most one row for each id of the vocabulary, which also bounds what the driver gathers for the code.
    """
    spark = docs.sparkSession
    enc = encoder(tokenizer)
    vocab, dtype = enc.tokenizer.get_vocab_size(), enc.dtype.str
    if end_id >= vocab:
        vocab = end_id + 1
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    tie = F.xxhash64("text")
    ranged = keyed.repartitionByRange(F.col("doc_id"), tie).sortWithinPartitions("doc_id", tie, "text")
    with bounded_batches(spark):
        raw = stored(ranged.mapInArrow(lean(_tokenise(tokenizer, end_id)), _RAW))

    def tally(batches):
        total = np.zeros(vocab, np.int64)
        for batch in batches:
            for x in batch.column(0):
                total += np.bincount(np.frombuffer(x.as_buffer(), dtype), minlength=vocab)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen], pa.int64())], ["id", "n"])

    found = raw.select("ids").mapInArrow(lean(tally), "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas().sort_values("id")
    lengths = code_lengths(found["n"].to_numpy(), max(max_length, int(np.ceil(np.log2(max(2, len(found)))))))
    book = (found["id"].to_numpy(np.int64), lengths)
    spark.createDataFrame([(int(i), int(n)) for i, n in zip(*book)], "id int, length int").coalesce(1).write.parquet(f"{path}/codebook")
    shared = spark.sparkContext.broadcast(book)

    def pack(batches):
        codec = Codec(*shared.value)
        for batch in batches:
            for k in range(batch.num_rows):
                bits, marks = codec.encode(np.frombuffer(batch.column("ids")[k].as_buffer(), dtype))
                row = batch.slice(k, 1)
                yield pa.RecordBatch.from_arrays([*row.columns[:-1], pa.array([bits], pa.binary()), pa.array([marks.astype("<u4").tobytes()], pa.binary())], [*row.schema.names[:-1], "payload", "checkpoints"])

    schema = _RAW.replace("ids binary", "payload binary, checkpoints binary")
    raw.mapInArrow(lean(pack), schema).write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    drop_stored(raw)
    shards = spark.read.parquet(f"{path}/blocks").groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    shards.select("shard", F.coalesce(before, F.lit(0)).alias("shard_start")).write.parquet(f"{path}/shards")


def read_tokens(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, if asked for, ids (array of int) of every document of a token store.

    The shards table has one row for each range partition of the write, which bounds its broadcast; the
    codebook has at most one row for each id of the vocabulary.
    """
    codebook = spark.read.parquet(f"{path}/codebook").toPandas()
    shared = spark.sparkContext.broadcast((codebook["id"].to_numpy(np.int64), codebook["length"].to_numpy(np.int64)))
    blocks = spark.read.schema(_RAW.replace("ids binary", "payload binary, checkpoints binary")).parquet(f"{path}/blocks")
    shards = spark.read.parquet(f"{path}/shards")

    def unpack(batches):
        codec = Codec(*shared.value)
        for batch in batches:
            for k in range(batch.num_rows):
                x = {c: batch.column(c)[k] for c in batch.schema.names}
                ids = codec.decode(x["payload"].as_py(), x["n_ids"].as_py(), np.frombuffer(x["checkpoints"].as_buffer(), "<u4")).astype("<u4")
                lens = np.array(x["doc_lens"].as_py(), np.int64)
                ends = np.cumsum(lens)
                begins = ends - lens
                raw = memoryview(ids.tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist())]
                base = x["shard_start"].as_py() + x["start_in_shard"].as_py()
                cols = [x["doc_ids"].values, pa.array(base + begins, pa.int64()), pa.array(lens, pa.int64()), pa.array(crc, pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.append(begins, ends[-1:]), pa.int32()), pa.array(ids.astype(np.int32), pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    return blocks.join(F.broadcast(shards), "shard").mapInArrow(lean(unpack), schema)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents tokenised, coded, written, and read back."""
    path = scratch_dir(spark)
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, default_tokenizer(), end_id=2)
    return read_tokens(spark, path, with_ids=False)


QUERIES = {"op10_token_output": op10_token_output}
