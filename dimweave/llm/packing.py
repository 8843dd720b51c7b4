"""Packing: concatenate and cut.

All documents' token ids, each document's closed by a separator, form one
stream that is cut every `window` ids.  Pass one turns texts into ids, with
each document's place within its partition; partition totals are summed up to
every partition's place in the stream; pass two cuts each document at the
windows' borders, from global offsets, so that any document or window may span
partitions.  Only the stream's last window can be shorter.

Defined results: null and empty texts have the separator only; repeated rows
are packed repeatedly, each as its own document; an empty table gives an empty
table.  The stream's order is that of the input's partitions.
"""

from __future__ import annotations

import json
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import Scratch, table, text_blocks

WINDOW = 2048
SEPARATOR = 1
#: How byte-level BPE cuts texts before merging (a fixed value of the public GPT-2 scheme).
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_ranks(spec: dict) -> dict[bytes, int] | None:
    """Ids by the bytes of each token, of a byte-level BPE whose merges stand in the order of their ids; None of any other tokenizer."""
    model, cut = spec["model"], spec["pre_tokenizer"] or {}
    odd = [model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")]
    plain = cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True)
    if model["type"] != "BPE" or any(odd) or spec["normalizer"] or not plain:
        return None
    solid = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # bytes that stand for themselves; the others follow from 256 on
    byte_of = {chr(b): b for b in solid} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in solid)}
    added, vocabulary = {t["content"] for t in spec["added_tokens"]}, model["vocab"]
    merged = [vocabulary.get("".join(m.split(" ") if isinstance(m, str) else m), -1) for m in model["merges"]]
    tokens = {t: i for t, i in vocabulary.items() if t not in added}
    if any(x >= y for x, y in zip([-1, *merged], merged, strict=False)) or not all(c in byte_of for t in tokens for c in t):
        return None
    return {bytes(byte_of[c] for c in t): i for t, i in tokens.items()}


class Encoder:
    """Ids of whole texts by a `tokenizers` file, whose special tokens are read as such.

    Where the file is a plain byte-level BPE, tiktoken merges by the file's own
    ranks, which gives the same ids several times faster and keeps nothing
    between texts.  Texts that hold a special token's string, and all texts of
    other kinds of tokenizers, go through `tokenizers` itself.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.path, self.whole, self.fast = path, None, None
        self.special = [t["content"] for t in spec["added_tokens"]]
        ranks = byte_ranks(spec)
        if ranks:
            import tiktoken

            self.fast = tiktoken.Encoding(path, pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})

    def _slow(self, text: str) -> list[int]:
        if self.whole is None:
            from tokenizers import Tokenizer

            self.whole = Tokenizer.from_file(self.path)
        return self.whole.encode(text, add_special_tokens=False).ids

    def encode(self, texts: list[str], end: bytes = b"") -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text, and `end` after each."""
        for text in texts:
            fast = self.fast and not any(s in text for s in self.special)
            ids = array("I", self.fast.encode_ordinary(text) if fast else self._slow(text))
            if sys.byteorder == "big":
                ids.byteswap()
            yield ids.tobytes() + end


def tokenize(docs: DataFrame, tokenizer: str, text: str = "text", separator: int | None = SEPARATOR) -> DataFrame:
    """`docs` without the text, with part, place (ids before it in its part), doc_tokens and ids (binary)."""
    rest = docs.drop(text).columns
    names, end = docs.columns, b"" if separator is None else np.array([separator], "<u4").tobytes()
    schema = StructType([*docs.drop(text).schema.fields, *StructType.fromDDL("part int, place long, doc_tokens long, ids binary").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, place = Encoder(tokenizer), TaskContext.get().partitionId(), 0
        for batch in text_blocks(batches, text):
            ids = list(encoder.encode([t or "" for t in batch.column(names.index(text)).to_pylist()], end))
            sizes = np.array([len(x) // 4 for x in ids], np.int64)
            places = place + np.cumsum(sizes) - sizes
            place += int(sizes.sum())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(names.index(c)) for c in rest), pa.array(np.full(len(ids), part, np.int32)), pa.array(places), pa.array(sizes), pa.array(ids, pa.binary())],
                names=schema.names,
            )

    return docs.mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, key: str = "doc_id", text: str = "text", separator: int | None = SEPARATOR, ids: bool = False) -> DataFrame:
    """One row per piece: (key, start, length, ids_crc32, doc_tokens, sequence_id, offset), and with `ids` its ids (binary).

    sequence_id numbers windows of the stream from 0, offset is the piece's
    place in its window.  Windows are full, but for the last.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    coded = scratch.keep(tokenize(docs.select(F.col(key).alias("key_"), F.col(text).alias("text_")), tokenizer or default_tokenizer(), "text_", separator))
    # one row of 20 bytes for each partition of the input, so this window's single task and the broadcast stay small
    totals = coded.groupBy("part").agg(F.sum("doc_tokens").alias("total"))
    base = totals.select(F.col("part").alias("part_"), (F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("total")).alias("base"))
    at = F.col("at")
    placed = coded.join(F.broadcast(base), F.col("part") == F.col("part_")).withColumn("at", F.col("base") + F.col("place")).where("doc_tokens > 0")
    w = F.lit(window)
    last = F.floor((at + F.col("doc_tokens") - 1) / w).cast("long")
    cut = lambda i: F.greatest(F.lit(0), i * w - at)
    piece = lambda i: F.struct(
        cut(i).cast("long").alias("start"),
        (F.least(F.col("doc_tokens"), (i + 1) * w - at) - cut(i)).cast("long").alias("length"),
        i.alias("sequence_id"),
        F.substring("ids", (cut(i) * 4 + 1).cast("int"), ((F.least(F.col("doc_tokens"), (i + 1) * w - at) - cut(i)) * 4).cast("int")).alias("piece_ids"),
    )
    crc = lambda p: F.struct(p["start"].alias("start"), p["length"].alias("length"), p["sequence_id"].alias("sequence_id"), F.crc32(p["piece_ids"]).alias("ids_crc32"), *([p["piece_ids"].alias("piece_ids")] if ids else []))
    pieces = placed.select("key_", "doc_tokens", "at", F.explode(F.transform(F.transform(F.sequence(F.floor(at / w).cast("long"), last), piece), crc)).alias("p"))
    return pieces.select(
        F.col("key_").alias(key), "p.start", "p.length", "p.ids_crc32", "doc_tokens", "p.sequence_id", (at + F.col("p.start") - F.col("p.sequence_id") * w).cast("long").alias("offset"), *(["p.piece_ids"] if ids else [])
    )


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


QUERIES = {"op3_packing": op3_packing}
ORACLE: dict[str, str] = {}
