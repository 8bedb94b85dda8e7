"""Removal of long strings that stand in a corpus twice or more, by suffix arrays with common-prefix intervals.

Texts are bytes; a string counts as repeated if it has `length` bytes and also
starts anywhere else, in the same document or another, overlaps included.

A suffix array over all bytes would shuffle each suffix with what follows it.
Here it is sparse, and still exact: every window of `length` bytes has one
anchor, its 2**GRAM_BITS-byte gram of least hash (the first of equals), and
equal windows have it at the same place. An anchor comes with its context: the
bytes of the windows that it is the anchor of. Anchors whose gram occurs once
go at once; equal contexts under one gram count as one kind with a number of
occurrences. What is left of a gram is a bucket: a suffix array of the kinds
from the anchor on, with the common prefixes of neighbours. A stack turns these
into the tree of common-prefix intervals, a second one each interval's left
sides into intervals that a further byte to the left would part. So every
maximal repeat around the anchor comes out once, with all its occurrences.

A bucket of over LIMIT kinds is parted: windows go by the place of the anchor
in them, in ranges whose common core is longer than the gram, until a bucket is
small enough or its core is the window itself, where counting suffices. No
bucket is cut, and no task has to hold a large one.

Null texts count as empty, texts under `length` bytes have no repeats, and rows
stand for themselves whatever their ids: null, repeated and clashing ids are
fine. Equal documents of `length` bytes or more repeat each other whole. An
empty table gives no rows.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from listinglens.llm.common import HOT, fresh_path, join_hot, remove, small_batches, stage_table

#: Bytes of a repeat, and the doublings that make a gram from a byte.
LENGTH, GRAM_BITS = 200, 6
#: Bytes that are hashed at a time.
SEGMENT = 1 << 20
#: Kinds of a bucket that one suffix array holds.
LIMIT = 400
#: Anchor places that a parted bucket has in one range: 1 << shift of them.
SHIFTS = (4, 0)
#: Text in one file of the staged documents, and anchors of the sample that finds hot grams.
FILE_BYTES, SAMPLED = 256 << 20, 1 << 20
#: Times that a gram is in the sample at least to count as hot.
SURE = 100

SPANS = "array<struct<start:int,end:int>>"


def _mixers() -> tuple[np.ndarray, list[np.uint64]]:
    """A number for each byte and a multiplier for each doubling, from one sequence of odd steps."""
    step = np.uint64(0x9E3779B97F4A7C15)
    x = (np.arange(1, 256 + GRAM_BITS + 1, dtype=np.uint64)) * step
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x[:256], [m | np.uint64(1) for m in x[256:]]


BYTE, MULTIPLIERS = _mixers()


def grams(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the gram at each place that has one."""
    h = BYTE[data]
    for k, m in enumerate(MULTIPLIERS):
        n = len(h) - (1 << k)
        if n <= 0:
            return h[:0]
        h = h[:n] * m + h[-n:]
        h ^= h >> np.uint64(29)
    return h


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> Iterator[tuple[np.ndarray, ...]]:
    """(first, last, place, hash) of the runs of window starts with one anchor; data holds texts that begin at offsets.

    Windows lie inside texts. The last run of one part may go on in the next.
    """
    width = length - (1 << GRAM_BITS) + 1
    step, bits = SEGMENT - width, np.uint64(SEGMENT.bit_length() - 1)
    for at in range(0, len(data) - length + 1, step):
        end = min(at + step, len(data) - length + 1)
        h = grams(data[at : end + length - 1])
        least = (h >> bits << bits) | np.arange(len(h), dtype=np.uint64)  # the first of equal hashes is the least
        span = 1
        while span * 2 <= width:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < width:
            least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
        place = (least[: end - at] & np.uint64((1 << int(bits)) - 1)).astype(np.int64)
        owner = np.searchsorted(offsets, [at, end], "right") - 1
        ends = np.repeat(offsets[owner[0] + 1 : owner[1] + 2], np.diff(np.clip(offsets[owner[0] : owner[1] + 2], at, end)))
        inside = np.flatnonzero(np.arange(at, end) + length <= ends)
        if not len(inside):
            continue
        place = place[inside]
        new = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        last = np.concatenate([new[1:] - 1, [len(place) - 1]])
        yield inside[new] + at, inside[last] + at, place[new] + at, h[place[new]]


def _joined(parts: Iterable[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """The runs of all parts, those that a part's end cut made one again."""
    parts = list(parts)
    if not parts:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    first, last, place, h = (np.concatenate(x) for x in zip(*parts, strict=True))
    new = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    ends = np.concatenate([new[1:] - 1, [len(place) - 1]])
    return first[new], last[ends], place[new], h[new]


def _context_hash(context: bytes | memoryview, left: int) -> int:
    """A signed 64-bit hash of a context and the anchor's place in it."""
    x = xxhash.xxh3_64_intdigest(context, seed=left)
    return x - (1 << 64) if x >> 63 else x


def _find_anchors(length: int):
    """mapInArrow's function: rows (rid, start, place, size, h, c) of rows (rid, bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            _, at, held = texts.buffers()
            if held is None or not len(texts):
                continue
            offsets = np.frombuffer(at, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
            base, view = int(offsets[0]), memoryview(held)
            data = np.frombuffer(held, np.uint8)[base : int(offsets[-1])]
            offsets -= base
            first, last, place, h = _joined(anchors(data, offsets, length))
            owner = np.searchsorted(offsets, first, "right") - 1
            size, left = last - first + length, place - first
            c = [_context_hash(view[base + a : base + a + n], p) for a, n, p in zip(first.tolist(), size.tolist(), left.tolist(), strict=True)]
            columns = [
                pa.array(batch.column(0).to_numpy()[owner]), pa.array(first - offsets[owner]), pa.array(left.astype(np.int32)),
                pa.array(size.astype(np.int32)), pa.array(h.view(np.int64)), pa.array(c, pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["rid", "start", "place", "size", "h", "c"])

    return run


ANCHORS = "rid long, start long, place int, size int, h long, c long"


def common(a: bytes, b: bytes) -> int:
    """Bytes of the common prefix."""
    n = min(len(a), len(b))
    a, b = a[:n], b[:n]
    if a == b:
        return n
    return n - ((int.from_bytes(a) ^ int.from_bytes(b)).bit_length() + 7) // 8


def intervals(shared: list[int]) -> Iterator[tuple[int, int, int]]:
    """(value, first, last) of the intervals of a sorted list, shared[i] what its members i - 1 and i have in common; leaves left out."""
    stack: list[tuple[int, int]] = []
    for i in range(1, len(shared) + 1):
        value, first = (shared[i] if i < len(shared) else -1), i - 1
        while stack and stack[-1][0] > value:
            high, first = stack.pop()
            yield high, first, i - 1
        if i < len(shared) and (not stack or stack[-1][0] < value):
            stack.append((value, first))


def maximal_repeats(contexts: list[bytes], places: list[int], counts: list[int], length: int) -> Iterator[tuple[int, int, list[int]]]:
    """(left, right, members): the maximal repeats of `length` bytes or more around the anchors of different contexts.

    A repeat reaches `left` bytes before the anchor and `right` from it on in
    each of its members, and neither side can grow in all of them.
    """
    for i, n in enumerate(counts):
        if n > 1:
            yield places[i], len(contexts[i]) - places[i], [i]
    suffixes = [c[p:] for c, p in zip(contexts, places, strict=True)]
    prefixes = [c[:p][::-1] for c, p in zip(contexts, places, strict=True)]
    order = sorted(range(len(contexts)), key=suffixes.__getitem__)
    rank = {m: i for i, m in enumerate(sorted(range(len(contexts)), key=prefixes.__getitem__))}
    shared = [0] + [common(suffixes[a], suffixes[b]) for a, b in zip(order, order[1:], strict=False)]
    longest = max(places, default=0)
    for right, first, last in intervals(shared):
        if right + longest < length:
            continue
        child, of = 0, {}
        for i in range(first, last + 1):
            child += i > first and shared[i] == right
            of[order[i]] = child  # members of one child go on alike to the right
        members = sorted(order[first : last + 1], key=rank.__getitem__)
        before = [0] + [common(prefixes[a], prefixes[b]) for a, b in zip(members, members[1:], strict=False)]
        for left, low, high in intervals(before):
            if left + right >= length and len({of[m] for m in members[low : high + 1]}) > 1:
                yield left, right, members[low : high + 1]


def merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans, those that touch made one."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """The rows (h, c, n, place, context) of one h after the other; they come sorted."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if held and held[-1][0] != row[0]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _scan(length: int, groups: bool):
    """mapInArrow's function over rows sorted by h: rows (h, c, n, repeat, spans).

    With groups a row for each maximal repeat and kind that it is in, else one
    for each kind with the parts of its context that repeats cover.
    """

    def found(rows: list[tuple]) -> Iterator[tuple]:
        covered: list[list] = [[] for _ in rows]
        for left, right, members in maximal_repeats([r[4] for r in rows], [r[3] for r in rows], [r[2] for r in rows], length):
            for m in members:
                covered[m].append((rows[m][3] - left, rows[m][3] + right))
                if groups:
                    a, b = covered[m][-1]
                    yield (*rows[m][:3], xxhash.xxh3_128_hexdigest(rows[m][4][a:b]), [{"start": a, "end": b}])
        if not groups:
            for row, spans in zip(rows, covered, strict=True):
                if spans:
                    yield (*row[:3], None, [{"start": a, "end": b} for a, b in merged(spans)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 3 + [pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))]
        every = (row for rows in _buckets(batches) for row in found(rows))
        while out := list(itertools.islice(every, 2000)):
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], ["h", "c", "n", "repeat", "spans"])

    return run


def parted(context: bytes, place: int, shift: int, length: int) -> Iterator[tuple[int, int, int, int, bytes]]:
    """(h, c, start, place, context) of the parts of a context: its windows by the anchor's place in them, 1 << shift places to a part.

    h hashes the core that all windows of such a range have in common.
    """
    most = length - (1 << GRAM_BITS)
    for b in range((place - (len(context) - length)) >> shift, (place >> shift) + 1):
        low, high = b << shift, min(most, ((b + 1) << shift) - 1)
        first, last = max(0, place - high), min(len(context) - length, place - low)
        part = context[first : last + length]
        core = context[place - low : place + length - high]
        yield _context_hash(core, b), _context_hash(part, place - first), first, place - first, part


def _part(shift: int, length: int):
    """mapInArrow's function: the parts of rows (h, c, n, place, context)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for h, c, n, place, context in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                out += [(h, c, n, *part) for part in parted(context, place, shift, length)]
            columns = list(zip(*out, strict=True)) if out else [[]] * 8
            kinds = [pa.int64()] * 3 + [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], ["h", "c", "n", "h2", "c2", "start", "place", "context"])

    return run


def _sized(kinds: DataFrame) -> DataFrame:
    """Staged kinds with `d`, the number of kinds that have the same h."""
    sizes = kinds.groupBy("h").agg(F.count("*").alias("d"))
    return join_hot(kinds, sizes.withColumn("_d", F.col("d")), "h", "_d", kinds.count())


class Repeats:
    """One search: documents with a row number, the anchors that repeat, their kinds, and what is staged for it."""

    def __init__(self, docs: DataFrame, text: str, length: int):
        self.spark, self.length = docs.sparkSession, length
        self.paths: dict[str, str] = {}
        self.table = f"repeats_{uuid.uuid4().hex}"
        small_batches(self.spark)
        self.docs = self._staged_docs(docs, text)
        self.live = self._live()
        kinds = self.live.groupBy("h", "c").agg(F.count("*").alias("n"), *[F.first(x).alias(x) for x in ("rid", "start", "place", "size")])  # all firsts are of one row
        self.kinds = self._stage(_sized(self._stage(kinds, "repeat-counts")), "repeat-kinds")
        self._drop("repeat-counts")

    def _stage(self, df: DataFrame, name: str) -> DataFrame:
        self.paths[name] = fresh_path(self.spark, name)
        return stage_table(df, name, self.paths[name])

    def _drop(self, name: str) -> None:
        remove(self.spark, self.paths.pop(name))

    def close(self) -> None:
        """Remove what was staged."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        for name in list(self.paths):
            self._drop(name)

    def _staged_docs(self, docs: DataFrame, text: str) -> DataFrame:
        """Documents in buckets of their row number: the joins that need texts shuffle none."""
        held = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
        files = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), held // FILE_BYTES + 1)
        row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text])
        body = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
        rows = docs.select(F.monotonically_increasing_id().alias("rid"), row.alias("row"), body.alias("body"))
        self.paths["repeat-docs"] = fresh_path(self.spark, "repeat-docs")
        rows.repartition(files, "rid").write.bucketBy(files, "rid").option("path", self.paths["repeat-docs"]).option("compression", "zstd").saveAsTable(self.table)
        return self.spark.table(self.table)

    def _live(self) -> DataFrame:
        """Anchors whose gram occurs more than once.

        A gram with over a thousandth of the anchors, as a sample shows, is
        known to repeat; the others meet in a window over their gram.
        """
        long_enough = self.docs.select("rid", "body").where(F.octet_length("body") >= self.length)
        every = self._stage(long_enough.mapInArrow(_find_anchors(self.length), ANCHORS), "repeat-anchors")
        total = every.count()
        share = min(1.0, SAMPLED / max(1, total))
        some = every.where(F.pmod(F.xxhash64("rid", "start"), F.lit(1 << 30)) < int(share * (1 << 30))).groupBy("h").agg(F.count("*").alias("n"))
        hot = self._stage(some.where(F.col("n") > max(SURE, total * share / HOT)).select("h", F.lit(True).alias("hot")), "repeat-hot")  # fewer than HOT grams
        met = every.join(F.broadcast(hot), "h", "left")
        salt = F.when(F.col("hot"), F.xxhash64("rid", "start")).otherwise(F.lit(0))  # hot rows are known to repeat and may go anywhere
        met = met.withColumn("salt", salt).withColumn("_n", F.count("*").over(Window.partitionBy("h", "salt")))
        live = self._stage(met.where("hot or _n > 1").drop("hot", "salt", "_n"), "repeat-live")
        self._drop("repeat-anchors")
        self._drop("repeat-hot")
        return live

    def contexts(self) -> DataFrame:
        """Rows (h, c, n, place, context) of the grams that have several kinds."""
        wanted = F.collect_list(F.struct("h", "c", "n", "place", "start", "size"))  # of one document
        met = self.docs.select("rid", "body").join(self.kinds.where("d > 1").groupBy("rid").agg(wanted.alias("k")), "rid")
        cut = F.transform("k", lambda k: F.struct(k["h"].alias("h"), k["c"].alias("c"), k["n"].alias("n"), k["place"].alias("place"), F.substring(F.col("body"), k["start"].cast("int") + 1, k["size"]).alias("context")))
        return self._stage(met.select(F.explode(cut).alias("k")).select("k.*"), "repeat-contexts")

    def covered(self, kinds: DataFrame, groups: bool = False, shifts: tuple[int, ...] = SHIFTS) -> DataFrame:
        """Rows (h, c, n, repeat, spans) of staged kinds (h, c, n, place, context), as _scan has them."""
        cells = ["h", "c", "n", "place", "context"]
        sized = self._stage(_sized(kinds), f"repeat-sized-{len(shifts)}") if shifts else kinds.withColumn("d", F.lit(1))
        small = sized.where(F.col("d") <= LIMIT).select(*cells).repartition("h").sortWithinPartitions("h")
        found = small.mapInArrow(_scan(self.length, groups), f"h long, c long, n long, repeat string, spans {SPANS}")
        large = sized.where(F.col("d") > LIMIT).select(*cells)
        if not shifts or large.isEmpty():
            return found
        parts = large.mapInArrow(_part(shifts[0], self.length), "h long, c long, n long, h2 long, c2 long, start int, place int, context binary")
        parts = self._stage(parts, f"repeat-parts-{len(shifts)}")
        inner = parts.groupBy(F.col("h2").alias("h"), F.col("c2").alias("c")).agg(F.sum("n").alias("n"), F.first("place").alias("place"), F.first("context").alias("context"), F.count("*").alias("_rows"))
        inner = self._stage(inner, f"repeat-inner-{len(shifts)}")
        below = self.covered(inner.select(*cells), groups, shifts[1:]).select(F.col("h").alias("h2"), F.col("c").alias("c2"), "repeat", "spans")
        below = below.join(inner.select(F.col("h").alias("h2"), F.col("c").alias("c2"), "_rows"), ["h2", "c2"])
        back = join_hot(parts.drop("place", "context"), below, ["h2", "c2"], "_rows", parts.count())
        moved = F.transform("spans", lambda s: F.struct((s["start"] + F.col("start")).alias("start"), (s["end"] + F.col("start")).alias("end")))
        back = back.select("h", "c", "n", "repeat", moved.alias("spans")).groupBy("h", "c", "n", "repeat").agg(F.flatten(F.collect_set("spans")).alias("spans"))
        return found.unionByName(back)

    def placed(self, covered: DataFrame) -> DataFrame:
        """Rows (rid, repeat, start, end): the spans of the kinds at all their occurrences."""
        met = join_hot(self.live.select("rid", "start", "h", "c"), covered, ["h", "c"], "n", self.live.count())
        each = met.select("rid", "start", "repeat", F.explode("spans").alias("s"))
        return each.select("rid", "repeat", (F.col("start") + F.col("s.start")).alias("start"), (F.col("start") + F.col("s.end")).alias("end"))

    def spans(self) -> DataFrame:
        """Rows (rid, spans): the maximal removed runs of each document that has some, in order."""
        whole = F.array(F.struct(F.lit(0).alias("start"), F.col("size").alias("end")))
        alone = self.kinds.where("d = 1").select("h", "c", "n", F.lit(None).cast("string").alias("repeat"), whole.alias("spans"))  # one kind, several times
        each = self.placed(self._stage(self.covered(self.contexts()).unionByName(alone), "repeat-covered"))
        order = Window.partitionBy("rid").orderBy("start", "end")
        reached = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
        runs = each.withColumn("new", F.when(F.col("start") > reached, 1).otherwise(0)).withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        runs = runs.groupBy("rid", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
        return runs.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))


@F.pandas_udf(T.BinaryType())
def _without(bodies: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
    """What is left of each text; null for null."""

    def rest(body: bytes | None, starts, ends) -> bytes | None:
        if body is None:
            return None
        return b"".join(body[a:b] for a, b in zip([0, *ends], [*starts, len(body)], strict=True))

    return pd.Series([rest(*row) for row in zip(bodies, starts, ends, strict=True)], dtype=object)


def remove_repeats(docs: DataFrame, text: str = "text", length: int = LENGTH) -> DataFrame:
    """docs with `removed`, the runs of bytes (start, end) that go, and `kept`, the bytes that stay, in place of the text.

    The rows are staged; docs has a column besides the text.
    """
    search = Repeats(docs, text, length)
    body = F.when(F.col("spans").isNotNull(), F.col("body"))  # other texts do not pass Python
    kept = _without(body, F.transform("spans", lambda s: s["start"]), F.transform("spans", lambda s: s["end"]))
    none = F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)")
    rows = search.docs.join(search.spans(), "rid", "left").select("row.*", F.coalesce("spans", none).alias("removed"), F.coalesce(kept, "body").alias("kept"))
    done = stage_table(rows, "without-repeats")
    search.close()
    return done


def removal_digests(rows: DataFrame) -> DataFrame:
    """Rows (doc_id, n_bytes, n_removed, n_spans, kept_sha256) of remove_repeats' rows."""
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return rows.select(
        "doc_id", (F.octet_length("kept") + gone).alias("n_bytes"), gone.alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


def repeat_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """Rows (repeat, doc_id, start, end): the maximal repeats around each anchor with all their occurrences, in bytes.

    `repeat` names a string by its hash. Where a repeat is longer than the
    context of an anchor, or its bucket was parted, it comes in pieces that
    overlap. The rows are staged.
    """
    search = Repeats(docs, text, length)
    met = search.docs.select("rid", "body").join(search.kinds.where("d = 1"), "rid")
    alone = met.select("h", "c", "n", "place", F.substring(F.col("body"), F.col("start").cast("int") + 1, F.col("size")).alias("context"))
    kinds = search._stage(search.contexts().unionByName(alone), "repeat-all-contexts")
    places = search.placed(search._stage(search.covered(kinds, groups=True), "repeat-groups"))
    rows = places.join(search.docs.select("rid", F.col(f"row.{doc_id}").alias("doc_id")), "rid").select("repeat", "rid", "doc_id", "start", "end").distinct()
    done = stage_table(rows.drop("rid"), "repeats")
    search.close()
    return done
