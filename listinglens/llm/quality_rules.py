"""Quality rules: compression bands over whole texts and fixed chunks, beside plain word counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listinglens.llm.common import small_batches

#: Bytes from which a band holds, and the least and greatest ratio of compressed to raw bytes. A frame's
#: header outweighs what it saves in a short text, so short texts have wider bands and the shortest none. Encoded data,
#: such as base64 with its six bits a byte, stays above the upper limits, and written text of any script below; under
#: 128 bytes the two overlap.
BANDS = ((0, 0.0, 99.0), (128, 0.35, 0.96), (256, 0.30, 0.95), (1024, 0.25, 0.75), (4096, 0.20, 0.70), (65536, 0.15, 0.68))
#: Bytes of a chunk, the band of its ratio, and the share of a text in chunks outside it that rejects the text.
CHUNK, CHUNK_BAND, CHUNK_SHARE = 4096, (0.20, 0.72), 0.25
#: Fewest bytes of a last chunk of its own; fewer join the chunk before.
FEWEST_BYTES = 128
LEVEL = 3
SYMBOLS, SPACES = b"#*$%&|<>", b" \t\n\x0b\x0c\r"
#: The base rule: fewest words, and the most per cent of words in repeated windows of WINDOW words.
FEWEST_WORDS, MOST_REPEATED, WINDOW = 10, 20, 5


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows that occur at least twice in the text, the first occurrence included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    code = np.array([ids.setdefault(w, len(ids)) for w in words], np.int64)
    if len(ids) == len(words):
        return 0
    key = code[:n]
    most = len(ids)
    for step in range(1, window):  # each key stands for one sequence of words exactly
        if most > 2**62 // len(ids):
            most, key = n, np.unique(key, return_inverse=True)[1]
        key = key * len(ids) + code[step : step + n]
        most *= len(ids)
    _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
    at = np.flatnonzero(counts[inverse] > 1)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int((np.cumsum(edge) > 0).sum())


def base_counts(raw: bytes, chars: int) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of UTF-8 bytes holding that many code points."""
    words = raw.split()
    lines = [line for line in raw.split(b"\n") if line.translate(None, SPACES)]
    bare = len(raw.translate(None, SPACES))
    return (
        len(words),
        chars - (len(raw) - bare),
        len(raw) - len(raw.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def band(size: int, bands=BANDS) -> tuple[float, float]:
    """The least and greatest allowed ratio of a text of that many bytes."""
    return next((low, high) for start, low, high in reversed(bands) if size >= start)


def chunk_starts(size: int) -> list[int]:
    """Where the chunks of that many bytes begin; the last one ends with the text and may be partial, or hold a short rest."""
    starts = list(range(0, size, CHUNK))
    return starts[:-1] if len(starts) > 1 and size - starts[-1] < FEWEST_BYTES else starts


def compression(raw: bytes, squeeze: zstandard.ZstdCompressor) -> tuple[float, float, bool]:
    """Ratio of the whole text, share of its bytes in chunks outside their band, and whether the bands accept it.

    Chunks cover every byte. One of CHUNK bytes or more has CHUNK_BAND, a shorter one the band of its length.
    """
    if not raw:
        return 1.0, 0.0, True
    ratio = len(squeeze.compress(raw)) / len(raw)
    low, high = band(len(raw))
    starts, bad = chunk_starts(len(raw)), 0
    for start, end in zip(starts, [*starts[1:], len(raw)], strict=True):
        size = end - start
        least, most = CHUNK_BAND if size >= CHUNK else band(size)
        part = ratio if size == len(raw) else len(squeeze.compress(raw[start:end])) / size
        bad += 0 if least <= part <= most else size
    share = bad / len(raw)
    return ratio, share, low <= ratio <= high and share <= CHUNK_SHARE


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "ratio", "bad_chunks", "in_band"]


def _rates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    squeeze = zstandard.ZstdCompressor(level=LEVEL)
    kinds = [pa.int64()] * 5 + [pa.float64()] * 2 + [pa.bool_()]
    for batch in batches:
        rows = []
        for text in batch.column(1).to_pylist():
            text = text or ""
            raw = text.encode("utf-8", "surrogatepass")
            rows.append((*base_counts(raw, len(text)), *compression(raw, squeeze)))
        cells = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *cells], ["doc_id", *NAMES])


def rate(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, counts, base_failed, kept, ratio, bad_chunks), one per input row.

    Words are runs without ASCII white space. base_failed: under ten words, or
    over 20 per cent of words in repeated 5-word windows. kept: the base rule
    and the compression bands both accept the text; bad_chunks is the share of
    bytes in chunks outside their band. Null is a text without words, which
    fails; a null id stays null; repeated rows are each rated; other columns
    are ignored.
    """
    small_batches(docs.sparkSession)
    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, ratio double, bad_chunks double, in_band boolean"
    rated = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).mapInArrow(_rates, schema)
    failed = (F.col("n_words") < FEWEST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    rated = rated.withColumn("base_failed", failed)
    return rated.select("doc_id", *counts, "base_failed", (~F.col("base_failed") & F.col("in_band")).alias("kept"), "ratio", "bad_chunks")
