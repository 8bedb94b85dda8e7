"""Packing by power-of-two decomposition: every piece of a document is a whole sequence of 2^k tokens."""

from __future__ import annotations

import base64
import functools
import json
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from listinglens.llm.common import small_batches

#: The token that closes each document, the longest sequence, and the tokens of a batch of equal lengths.
END_TOKEN, MAX_TOKENS, BATCH_TOKENS = 1, 2048, 65_536
#: White space in a row from which a text goes to the exact tokenizer: tiktoken's regex keeps a state for each blank of a
#: run and fails near a million.
LONG_BLANK = 100_000
_LONG_BLANK = re.compile(r"\s{%d}" % LONG_BLANK)
#: Tokens of one output batch of a task, about.
FLUSH = 4_000_000


@functools.cache
def exact_tokenizer(vocabulary: str) -> Tokenizer:
    """The tokenizer whose ids are wanted, as its file has it. One per worker."""
    return Tokenizer.from_file(public_tokenizers.path(vocabulary))


@functools.cache
def encoder(vocabulary: str) -> tuple[tiktoken.Encoding, dict[str, int], re.Pattern | None]:
    """The same vocabulary as ranks, several times as fast; and its added tokens, which are parted from a text first. One per worker."""
    with open(public_tokenizers.path(vocabulary.removesuffix(".json") + ".tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    with open(public_tokenizers.path(vocabulary), encoding="utf-8") as file:
        added = {t["content"]: t["id"] for t in json.load(file)["added_tokens"]}
    parts = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), added, parts


def encode(text: str, vocabulary: str) -> list[int]:
    """Token ids of a text, those of the exact tokenizer without special tokens around them."""
    if len(text) >= LONG_BLANK and _LONG_BLANK.search(text):
        return exact_tokenizer(vocabulary).encode(text, add_special_tokens=False).ids
    ranks, added, parts = encoder(vocabulary)
    plain = ranks._core_bpe.encode_ordinary
    if parts is None or not any(token in text for token in added):
        return plain(text)
    ids: list[int] = []
    for i, part in enumerate(parts.split(text)):  # every second part is an added token
        ids += [added[part]] if i % 2 else plain(part)
    return ids


def piece_lengths(n: int, most: int = MAX_TOKENS) -> list[int]:
    """Powers of two that sum to n, longest first, none over most (itself a power of two)."""
    rest = n % most
    return [most] * (n // most) + [1 << bit for bit in range(most.bit_length() - 2, -1, -1) if rest >> bit & 1]


class Buckets:
    """Batches of equal lengths: a number for each of the pieces that a task meets."""

    def __init__(self, task: int, most: int):
        self.base, self.size = task << 40, max(BATCH_TOKENS, most)
        self.seen = np.zeros(most.bit_length(), np.int64)

    def place(self, lengths: np.ndarray) -> np.ndarray:
        batch = np.empty(len(lengths), np.int64)
        bits = np.log2(lengths).astype(int)
        for bit in np.unique(bits).tolist():
            at = np.flatnonzero(bits == bit)
            batch[at] = self.base + (bit << 34) + (self.seen[bit] + np.arange(len(at))) // (self.size >> bit)
            self.seen[bit] += len(at)
        return batch


def _pieces(vocabulary: str, most: int):
    def made(batch: pa.RecordBatch, rows: list[int], documents: list[np.ndarray], buckets: Buckets) -> pa.RecordBatch:
        totals = np.array([len(d) for d in documents], np.int64)
        cuts = [piece_lengths(n, most) for n in totals.tolist()]
        owner = np.repeat(np.arange(len(cuts)), [len(c) for c in cuts])
        lengths = np.concatenate([np.array(c, np.int64) for c in cuts])
        ends = np.cumsum(lengths)
        first = np.concatenate(([0], np.cumsum(totals)[:-1]))
        offsets = np.concatenate(([0], ends * 4)).astype(np.int64)
        data = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.concatenate(documents))])
        ids = data.cast(pa.binary())
        cells = [batch.column(0).take(pa.array(np.array(rows)[owner])), pa.array(ends - lengths - first[owner]), pa.array(lengths), ids, pa.array(totals[owner]), pa.array(buckets.place(lengths))]
        return pa.RecordBatch.from_arrays(cells, ["doc_id", "start", "length", "ids", "doc_tokens", "batch_id"])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = Buckets(TaskContext.get().partitionId(), most)
        for batch in batches:
            rows, documents, size = [], [], 0
            for row, text in enumerate(batch.column(1)):
                tokens = encode(text.as_py(), vocabulary) if text.is_valid else []
                tokens.append(END_TOKEN)
                rows.append(row), documents.append(np.array(tokens, dtype="<u4"))
                size += len(tokens)
                if size >= FLUSH:
                    yield made(batch, rows, documents, buckets)
                    rows, documents, size = [], [], 0
            if rows:
                yield made(batch, rows, documents, buckets)

    return pieces


def pack(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", most: int = MAX_TOKENS) -> DataFrame:
    """Rows (doc_id, start, length, ids, doc_tokens, batch_id, sequence_id, offset), one per piece.

    A document is its token ids and END_TOKEN. It is cut along the binary
    digits of its length into pieces of 2^k ids, at most `most`; a piece is a
    sequence of its own, so none crosses documents and none needs padding.
    Pieces of equal length share a bucket: those with one batch_id have one
    length and BATCH_TOKENS ids at most together, so a batch is a matrix. ids
    are little-endian unsigned 32-bit integers, those of the named vocabulary.
    Null and empty texts are the end token alone; null ids stay null; repeated
    rows are packed each; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    schema = "doc_id long, start long, length long, ids binary, doc_tokens long, batch_id long"
    out = columns.mapInArrow(_pieces(vocabulary, most), schema)
    return out.withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))


def piece_digests(pieces: DataFrame) -> DataFrame:
    """The pieces with the CRC-32 of their ids in place of the ids."""
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "batch_id"
    )
