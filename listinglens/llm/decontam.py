"""Benchmark decontamination: the q-gram lemma over diagonal bands, then banded alignment."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listinglens.llm.common import small_batches

#: Characters of a q-gram, and edits allowed for each character of a passage.
Q, EDIT_RATE = 8, 0.1
#: Code points of passages that one broadcast block holds at most; a larger benchmark is searched block by block.
BLOCK_CHARS = 2_000_000
#: Bits of the table that rules out most q-grams of a text with one look-up.
FILTER_BITS = 22
#: Places of a q-gram in the benchmark from which it is common: passages that can spare theirs are not looked up by them.
COMMON = 32
#: Hits that are sorted at a time, and cells of a row of alignments.
HITS, CELLS = 2_000_000, 1 << 18
#: Candidates from which equal regions are looked for.
MANY = 2000
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


@functools.cache
def _folds() -> np.ndarray:
    """For each code point of the basic plane its lower case, or a space for what is no letter or digit."""
    table = np.arange(0x10000, dtype=np.uint32)
    for i in range(0x10000):
        c = chr(i)
        if not c.isalnum():
            table[i] = 32
        elif len(low := c.lower()) == 1:
            table[i] = min(ord(low), 0xFFFF)
    return table


def normalise(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts folded into one array of code points, a zero after each, and where each starts.

    Letters are lower-cased; each run of other characters is one space.
    """
    joined = "\0".join([t.replace("\0", " ") for t in texts]) + "\0"
    raw = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    folded = np.where(raw < 0x10000, _folds()[np.minimum(raw, 0xFFFF)], raw)
    folded[raw == 0] = 0
    blank = folded == 32
    keep = np.ones(len(folded), bool)
    keep[1:] = ~(blank[1:] & (blank[:-1] | (folded[:-1] == 0)))
    keep[:1] = folded[:1] != 32
    folded = folded[keep]
    ends = np.flatnonzero(folded == 0)
    return folded, np.concatenate(([0], ends[:-1] + 1))


def qgram_codes(chars: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial code of the Q characters from each position; equal q-grams have equal codes."""
    code, step, power = chars.astype(np.uint64), 1, MULTIPLIER
    with np.errstate(over="ignore"):
        while step < Q:
            code = code[:-step] * power + code[step:] if len(code) > step else code[:0]
            power, step = power * power, step * 2
    return code


def edit_budget(length: int) -> int:
    """Edits that a passage of that many characters may have, such that the lemma asks for a shared q-gram still."""
    return max(0, min(int(EDIT_RATE * length), (length - Q) // Q))


class Passages:
    """The q-grams of a block of benchmark passages, ready for look-up."""

    def __init__(self, ids: list[int], texts: list[str]):
        chars, starts = normalise(texts) if texts else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        stops = np.concatenate((starts[1:] - 1, [len(chars) - 1])) if texts else starts
        found = [(i, chars[a:b] if b == a or chars[b - 1] != 32 else chars[a : b - 1]) for i, a, b in zip(ids, starts, stops, strict=True)]
        self.items = [(i, c) for i, c in found if len(c)]
        self.edits = np.array([edit_budget(len(c)) for _, c in self.items], np.int64)
        self.short = [k for k, (_, c) in enumerate(self.items) if len(c) < Q]
        self.needs = np.array([max(1, len(c) + 1 - Q * (1 + e)) for (_, c), e in zip(self.items, self.edits, strict=True)], np.int64)
        codes = [qgram_codes(c) for _, c in self.items]
        item = np.repeat(np.arange(len(codes)), [len(c) for c in codes])
        place = np.concatenate([np.arange(len(c)) for c in codes]) if codes else item
        every = np.concatenate(codes) if codes else np.zeros(0, np.uint64)
        _, kind, times = np.unique(every, return_inverse=True, return_counts=True)
        common = times[kind] > COMMON if len(every) else np.zeros(0, bool)
        lost = np.bincount(item[common], minlength=len(self.items))
        spared = lost < self.needs  # of so many shared q-grams some are not among the common ones
        self.needs = self.needs - np.where(spared, lost, 0)
        keep = ~(common & spared[item]) if len(every) else common
        every, item, place = every[keep], item[keep], place[keep]
        self.flat = np.concatenate([np.zeros(0, np.uint32), *[c for _, c in self.items]])
        self.sizes = np.array([len(c) for _, c in self.items], np.int64)
        self.heads = np.cumsum(self.sizes) - self.sizes
        order = np.argsort(every, kind="stable")
        self.item, self.place = item[order], place[order]
        self.codes, self.first, self.count = np.unique(every[order], return_index=True, return_counts=True)
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[self._slot(self.codes)] = True

    @staticmethod
    def _slot(codes: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((codes ^ (codes >> np.uint64(29))) * MULTIPLIER) >> np.uint64(64 - FILTER_BITS)

    def known(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions whose q-gram a passage has, and the q-gram's number."""
        at = np.flatnonzero(self.filter[self._slot(codes)])
        where = np.searchsorted(self.codes, codes[at])
        same = self.codes[np.minimum(where, len(self.codes) - 1)] == codes[at] if len(self.codes) else np.zeros(len(at), bool)
        return at[same], where[same]

    def hits(self, at: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Every (position, passage, position in it) of known q-grams."""
        many = self.count[where]
        pick = np.repeat(self.first[where] - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum()) if len(at) else at
        return np.repeat(at, many), self.item[pick], self.place[pick]


def banded_distances(chars: np.ndarray, low: np.ndarray, high: np.ndarray, diagonal: np.ndarray, items: np.ndarray, heads: np.ndarray, sizes: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(edits, end) of each candidate: the best alignment of a whole passage inside chars[low:high]; (-1, -1) if none has `most` edits or fewer.

    A candidate's passage is items[head : head + size]. A diagonal is a
    position in chars less one in the passage; 3 * most + 2 of them are tried,
    from the given one on. What passes its edits is left out of further rows.
    """
    cost, end = np.full(len(diagonal), -1), np.full(len(diagonal), -1)
    big, ramp = int(most.max(initial=0)) + 1, np.arange(3 * int(most.max(initial=0)) + 2, dtype=np.int64)
    who, at = np.arange(len(diagonal)), diagonal[:, None] + ramp
    beyond = ramp >= 3 * most[:, None] + 2
    row = np.where((at >= low[:, None]) & (at <= high[:, None]) & ~beyond, 0, big)
    for i in range(int(sizes.max(initial=0))):
        inside = (at >= low[who, None]) & (at < high[who, None])
        step = np.where(inside, row + (chars[np.clip(at, 0, len(chars) - 1)] != items[heads[who] + i][:, None]), big)
        step[:, :-1] = np.minimum(step[:, :-1], row[:, 1:] + 1)
        at += 1
        step[(at < low[who, None]) | (at > high[who, None])] = big
        row = np.minimum(np.minimum.accumulate(step - ramp, axis=1) + ramp, big)
        row[beyond] = big
        least = row.min(axis=1)
        over, well = sizes[who] == i + 1, least <= most[who]
        if over.any():
            fit = np.flatnonzero(over & well)
            cost[who[fit]] = least[fit]
            end[who[fit]] = at[fit, row[fit].argmin(axis=1)]
        stay = ~over & well
        if not stay.all():
            who, row, at, beyond = who[stay], row[stay], at[stay], beyond[stay]
            if not len(who):
                break
    return cost, end


def search(passages: Passages, texts: list[str], at_once: int = 1_000_000) -> Iterator[tuple[int, int, int, int, int]]:
    """(text index, passage index, start, end, edits) of the best region for each text and passage, in folded characters.

    About at_once code points are worked on at a time, so that many long texts in a batch do not add up.
    """
    first = size = 0
    for last, text in enumerate(texts, 1):
        size += len(text)
        if size >= at_once or last == len(texts):
            yield from ((first + i, *rest) for i, *rest in _search(passages, texts[first:last]))
            first, size = last, 0


def _windows(at: np.ndarray, many: np.ndarray, reach: int) -> Iterator[slice]:
    """Slices of positions that together have about HITS hits, each going on for `reach` characters into the next."""
    before, first = np.cumsum(many) - many, 0
    while first < len(at):
        last = max(int(np.searchsorted(before, before[first] + HITS)), int(np.searchsorted(at, at[first] + reach)))
        yield slice(first, int(np.searchsorted(at, at[min(last, len(at)) - 1] + reach, "right")))
        first = last


def _candidates(passages: Passages, starts: np.ndarray, position: np.ndarray, item: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, passage, band) where a band of diagonals and its upper neighbour share enough q-grams of the passage, each counted once."""
    text = np.searchsorted(starts, position, "right") - 1
    band = (position - place) // (passages.edits[item] + 1)
    low = int(band.min(initial=0))
    tall = int(band.max(initial=0)) - low + 1
    key = (text * len(passages.items) + item) * tall + (band - low)
    for exact in (False, True):  # by all hits first, then with each q-gram of the passage once, where that leaves something
        if exact:
            order = np.lexsort((place, key))
            key, place = key[order], place[order]
            fresh = np.ones(len(key), bool)
            fresh[1:] = (key[1:] != key[:-1]) | (place[1:] != place[:-1])
            group, both = np.unique(key[fresh], return_counts=True)
        else:
            group, which, both = np.unique(key, return_inverse=True, return_counts=True)
        t, k, b = group // tall // len(passages.items), group // tall % len(passages.items), group % tall + low
        next_to = (t[1:] == t[:-1]) & (k[1:] == k[:-1]) & (b[1:] == b[:-1] + 1)
        both[:-1] += np.where(next_to, both[1:], 0)  # every span of edits + 1 diagonals lies in one such pair
        enough = both >= passages.needs[k]
        if not exact:
            keep = enough.copy()
            keep[1:] |= enough[:-1] & next_to
            key, place = key[keep[which]], place[keep[which]]
    return t[enough], k[enough], b[enough]


def _marks(chars: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """A hash of each chars[low:high], equal for equal strings wherever they stand."""
    with np.errstate(over="ignore"):
        mixed = (chars.astype(np.uint64) + np.uint64(1)) * MULTIPLIER
        mixed ^= mixed >> np.uint64(32)
        powers = np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(len(chars), MULTIPLIER))))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed * powers[:-1])))
        return (sums[high] - sums[low]) * powers[len(chars) - low]


def _aligned(passages: Passages, chars: np.ndarray, starts: np.ndarray, stops: np.ndarray, t: np.ndarray, k: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
    """(text, passage, start, end, edits) of the candidates within their budget.

    If there are many, equal regions meet a passage once; passages that stand
    there unaltered need no alignment.
    """
    edits, size = passages.edits[k], passages.sizes[k]
    diagonal = b * (edits + 1) - edits
    low, high = np.maximum(starts[t], diagonal), np.minimum(stops[t], diagonal + 4 * edits + 1 + size)
    low = np.minimum(low, high)
    one = group = np.arange(len(t))
    if len(t) > MANY:
        same = np.stack((_marks(chars, low, high), high - low, low - diagonal, k), axis=1).astype(np.uint64)
        _, one, group = np.unique(same, axis=0, return_index=True, return_inverse=True)
    cost, end = np.full(len(one), -1), np.full(len(one), -1)
    for n, g in enumerate(one.tolist()):
        at = chars[low[g] : high[g]].tobytes().find(passages.items[k[g]][1].tobytes())
        if at >= 0 and at % 4 == 0:
            cost[n], end[n] = 0, at // 4 + size[g]
    rest = np.flatnonzero(end < 0)
    rest = rest[np.argsort(edits[one[rest]], kind="stable")]  # alike in width
    while len(rest):
        g = one[rest]
        n = max(1, int(np.searchsorted(np.arange(1, len(rest) + 1) * (3 * edits[g] + 2), CELLS)))
        part, rest, g = rest[:n], rest[n:], g[:n]
        found = banded_distances(chars, low[g], high[g], diagonal[g], passages.flat, passages.heads[k[g]], size[g], edits[g])
        cost[part], end[part] = found[0], np.where(found[1] < 0, -1, found[1] - low[g])
    cost, end = cost[group.ravel()], end[group.ravel()]
    for g in np.flatnonzero(end >= 0).tolist():
        stop = int(low[g] + end[g] - starts[t[g]])
        yield int(t[g]), int(k[g]), stop - int(size[g]), stop, int(cost[g])


def _search(passages: Passages, texts: list[str]) -> list[tuple[int, int, int, int, int]]:
    chars, starts = normalise(texts)
    stops = np.concatenate((starts[1:] - 1, [len(chars) - 1]))
    found = []
    if len(passages.codes):
        at, where = passages.known(qgram_codes(chars))
        reach = int((passages.sizes + 4 * passages.edits).max()) + 2
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for part in _windows(at, passages.count[where], reach):
            t, k, b = _candidates(passages, starts, *passages.hits(at[part], where[part]))
            for i, j, start, end, cost in _aligned(passages, chars, starts, stops, t, k, b):
                best[i, j] = min(best.get((i, j), (cost, start, end)), (cost, start, end))
        found += [(i, j, max(0, s), e, c) for (i, j), (c, s, e) in best.items()]
    for j in passages.short:
        want = "".join(map(chr, passages.items[j][1]))
        for i, (a, b) in enumerate(zip(starts.tolist(), stops.tolist(), strict=True)):
            at = f" {''.join(map(chr, chars[a:b]))} ".find(f" {want} ")
            if at >= 0:
                found.append((i, j, at, at + len(want), 0))
    return found


def _searcher(shared: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(search(shared.value, [t or "" for t in batch.column(1).to_pylist()]))
            own = batch.column(0).take(pa.array([r[0] for r in rows], pa.int64()))
            items = pa.array([shared.value.items[r[1]][0] for r in rows], pa.int64())
            spans = [pa.array([r[i] for r in rows], pa.int64()) for i in (2, 3, 4)]
            yield pa.RecordBatch.from_arrays([own, items, *spans], ["doc_id", "item_id", "start", "end", "edits"])

    return run


def blocks(benchmark: DataFrame, most: int = BLOCK_CHARS) -> Iterator[Broadcast]:
    """The passages in blocks of at most `most` code points or one passage, each broadcast: Spark keeps it in files, the driver holds one at a time."""
    context = benchmark.sparkSession.sparkContext
    ids, texts, size = [], [], 0
    narrow = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    for row in narrow.orderBy("item_id", "text").toLocalIterator():
        if ids and size + len(row["text"]) > most:
            yield context.broadcast(Passages(ids, texts))
            ids, texts, size = [], [], 0
        ids.append(row["item_id"]), texts.append(row["text"])
        size += len(row["text"])
    yield context.broadcast(Passages(ids, texts))


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows (doc_id, item_id, start, end, edits): documents that hold a benchmark passage within its edit budget.

    Text and passages are compared with letters lower-cased and every run of
    other characters as a space; start and end count folded characters. One
    row, the best region, for each document row and passage row. Passages
    shorter than a q-gram must stand there whole. Null and empty texts and
    passages match nothing; null ids of either table stay null; repeated rows
    are each searched; empty tables give no rows. The benchmark is the stated
    query set: each block of it is one pass over docs.
    """
    small_batches(docs.sparkSession)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    found = None
    for shared in blocks(benchmark):
        part = narrow.mapInArrow(_searcher(shared), "doc_id long, item_id long, start long, end long, edits long")
        found = part if found is None else found.unionByName(part)
    return found


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that hold no benchmark passage; a map over the rows, without a shuffle. Null texts stay."""
    small_batches(docs.sparkSession)
    for shared in blocks(benchmark):
        docs = docs.where(_clean(shared)(F.col("text")))
    return docs


def _clean(shared: Broadcast):
    @F.pandas_udf("boolean")
    def clean(texts: pd.Series) -> pd.Series:
        hit = {row[0] for row in search(shared.value, [t or "" for t in texts])}
        return pd.Series([i not in hit for i in range(len(texts))], dtype=bool)

    return clean
