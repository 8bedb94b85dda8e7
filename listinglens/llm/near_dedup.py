"""SimHash near-duplicates: fingerprints, a Gray-order hierarchical index, and the components of the links."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from listinglens.llm.common import HOT, fresh_path, join_hot, remove, small_batches, stage_table

#: Differing bits that link at most. Of m blocks of a fingerprint, two linked ones agree in m - DISTANCE at least, so they
#: meet in one of C(m, DISTANCE) tables keyed by so many blocks: 5 tables of 12 bits, 15 of 20, 35 of 27 or 70 of 32.
DISTANCE, MOST_BLOCKS = 4, 8
#: Rows up to which the table of large groups is broadcast.
BROADCAST_ROWS = 100_000
#: Distinct fingerprints that one index task should hold on average, and the most it takes before its group is split.
GROUP_TARGET, GROUP_MOST = 2048, 6000
#: Leaves under the lowest inner node, node pairs expanded at a time, and Gray neighbours linked before the search.
LEAF, FRONTIER, NEIGHBOURS = 8, 200_000, 8


def simhash(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """Unsigned 64-bit fingerprint of a text; zero for null or no words.

    A-Z are lower-cased, words are runs without ASCII white space. Each run of
    `shingle` words, repeats included, votes with the bits of its XXH64; a bit
    is one if over half of the votes have it. Fewer words are one shingle.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    joined = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a:b], seed) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)]
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8192):
        part = np.array(hashes[at : at + 8192], dtype="<u8")
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (votes * 2 > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, fp): one per input row, fp as a signed long with the fingerprint's bits."""
    small_batches(docs.sparkSession)

    @F.pandas_udf(T.LongType())
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([simhash(t) for t in texts], dtype=np.uint64).view(np.int64))

    return docs.select(F.col(key), fp(F.col(text)).alias("fp"))


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of each code in the reflected Gray sequence (prefix XOR of its bits)."""
    r = x.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        r ^= r >> np.uint64(shift)
    return r


def _merge(roots: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Component labels after linking i and j; a label is the smallest position of its component."""
    while True:
        a, b = roots[i], roots[j]
        apart = a != b
        if not apart.any():
            return roots
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(roots, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = roots[roots]
            if (up == roots).all():
                break
            roots = up


def index_links(codes: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """(codes, roots): component roots of distinct codes under links of at most `distance` bits.

    The codes are sorted by Gray rank and form the leaves of a binary tree. A
    node holds the bits that all its leaves share; the bits its parent shares
    already are factored out. A search descends pairs of nodes, adding the
    differences in newly shared bits, and drops a pair, with all leaves below,
    once they exceed the distance. Pairs inside one component need no search.
    """
    leaves = codes[np.argsort(gray_rank(codes), kind="stable")]
    n = len(leaves)
    roots = np.arange(n)
    for step in range(1, min(NEIGHBOURS, n - 1) + 1):
        near = np.flatnonzero(np.bitwise_count(leaves[:-step] ^ leaves[step:]) <= distance)
        roots = _merge(roots, near, near + step)
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    height = max(0, math.ceil(math.log2(max(1, n) / LEAF)))
    width = -(-n // 2**height)
    starts = np.minimum(np.arange(2**height) * width, n)
    ends = np.minimum(starts + width, n)
    used = starts < ends
    starts, ends = starts[used], ends[used]
    conj, disj = np.bitwise_and.reduceat(leaves, starts), np.bitwise_or.reduceat(leaves, starts)
    levels = [(starts, ends, conj, full ^ (conj ^ disj))]
    while len(levels[0][0]) > 1:  # parents of two; an odd last node stands alone
        s, e, c, m = levels[0]
        d = c | (full ^ m)
        pair = np.arange(0, len(s), 2)
        last = np.minimum(pair + 1, len(s) - 1)
        c2, d2 = c[pair] & c[last], d[pair] | d[last]
        levels.insert(0, (s[pair], e[last], c2, full ^ (c2 ^ d2)))
    zero = np.zeros(1, np.int64)
    work = [(0, zero, zero, np.bitwise_count(np.zeros(1, np.uint64)), np.zeros(1, np.uint64))]
    while work:
        depth, a, b, acc, seen = work.pop()
        if len(a) > FRONTIER:
            for at in range(0, len(a), FRONTIER):
                cut = slice(at, at + FRONTIER)
                work.append((depth, a[cut], b[cut], acc[cut], seen[cut]))
            continue
        s, e, c, m = levels[depth]
        low, high = np.minimum.reduceat(roots, s), np.maximum.reduceat(roots, s)
        shared = m[a] & m[b]
        acc = acc + np.bitwise_count((c[a] ^ c[b]) & (shared & ~seen))
        keep = (acc <= distance) & ~((low[a] == high[a]) & (low[b] == high[b]) & (low[a] == low[b]))
        a, b, acc, shared = a[keep], b[keep], acc[keep], shared[keep]
        if not len(a):
            continue
        if depth == len(levels) - 1:
            size = int((e - s).max())
            for x in range(size):
                i = s[a] + x
                for y in range(size):
                    j = s[b] + y
                    ok = (i < e[a]) & (j < e[b]) & (i < j)
                    p, q = i[ok], j[ok]
                    hit = np.bitwise_count(leaves[p] ^ leaves[q]) <= distance
                    roots = _merge(roots, p[hit], q[hit])
            continue
        below = len(levels[depth + 1][0])
        na, nb, nacc, nseen = [], [], [], []
        for x, y in ((0, 0), (0, 1), (1, 0), (1, 1)):
            ca, cb = 2 * a + x, 2 * b + y
            ok = (ca < below) & (cb < below) & (ca <= cb)
            na.append(ca[ok]), nb.append(cb[ok]), nacc.append(acc[ok]), nseen.append(shared[ok])
        work.append((depth + 1, np.concatenate(na), np.concatenate(nb), np.concatenate(nacc), np.concatenate(nseen)))
    return leaves, roots


def _group_links(distance: int):
    def links(part: pd.DataFrame) -> pd.DataFrame:
        codes = np.unique(part["fp"].to_numpy(np.int64)).view(np.uint64)
        leaves, roots = index_links(codes, distance)
        tied = roots != np.arange(len(roots))
        signed = leaves.view(np.int64)
        return pd.DataFrame({"a": signed[tied], "b": signed[roots[tied]]})

    return links


def block_tables(bits: int, distance: int = DISTANCE) -> list[list[tuple[int, int]]]:
    """Tables of (first bit from the left, width) parts whose values key the groups: the fewest blocks whose keys can hold `bits`."""
    m = distance + 1
    while m < MOST_BLOCKS and (64 // m) * (m - distance) < bits:
        m += 1
    width = 64 // m
    used = min(width, -(-bits // (m - distance)))
    return [[(block * width, used) for block in picked] for picked in itertools.combinations(range(m), m - distance)]


def similar_links(distinct: DataFrame, n_distinct: int, distance: int = DISTANCE) -> DataFrame:
    """Links (a, b) that connect exactly the distinct fingerprints within `distance` bits, spanning edges only.

    Each fingerprint goes to one group of every block table; keys have as many
    bits as keep groups near GROUP_TARGET, so tables grow with the input and
    groups do not. A group over GROUP_MOST is dealt into segments, and each
    two segments meet in one task of their own, so that no task holds an
    unbounded group.
    """
    bits = max(1, math.ceil(math.log2(max(2, n_distinct / GROUP_TARGET))))
    keys = []
    for number, parts in enumerate(block_tables(bits, distance)):
        key = F.lit(number).cast("long")
        for at, width in parts:
            value = F.shiftrightunsigned(F.col("fp"), 64 - at - width).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
            key = F.shiftleft(key, width).bitwiseOR(value)
        keys.append(key)
    keyed = distinct.select("fp", F.explode(F.array(*keys)).alias("bucket"))
    large = keyed.groupBy("bucket").count().where(F.col("count") > GROUP_MOST)
    large = stage_table(large.select("bucket", "count", F.ceil(F.col("count") * 2 / GROUP_MOST).cast("int").alias("parts")), "large-groups")
    parts = large.drop("count")
    if large.count() <= BROADCAST_ROWS:
        dealt = keyed.join(F.broadcast(parts), "bucket", "left")
    else:  # fewer than HOT groups have over a share of the rows: they are broadcast, and the shuffle meets none of them
        hot = large.where(F.col("count") * HOT > F.lit(n_distinct * len(keys))).drop("count")
        rest = keyed.join(F.broadcast(hot.select("bucket")), "bucket", "left_anti").join(parts, "bucket", "left")
        dealt = keyed.join(F.broadcast(hot), "bucket").unionByName(rest)
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    meets = F.when(F.col("parts").isNull(), F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))
    dealt = dealt.select("fp", "bucket", "own", F.explode(meets).alias("other")).where("other = -1 or own <> other")
    alone = F.col("other") == -1
    tasks = dealt.select(
        "fp",
        "bucket",
        F.when(alone, -1).otherwise(F.least("own", "other")).alias("low"),
        F.when(alone, -1).otherwise(F.greatest("own", "other")).alias("high"),
    )
    return tasks.groupBy("bucket", "low", "high").applyInPandas(_group_links(distance), "a long, b long")


def connected(edges: DataFrame, name: str = "stars", rounds: int = 60) -> DataFrame:
    """Rows (node, root): the smallest node of each component, for nodes with an edge in `edges` (a, b).

    Alternating large-star and small-star steps; each round is written to the
    shared folder, where the round before it goes, and the rounds end when the
    edges no longer change. The hub of a large star meets its edges in a
    broadcast, so that no task holds them all.
    """
    spark = edges.sparkSession
    lower = F.least("a", "b").alias("b")
    path = fresh_path(spark, name)
    stars = stage_table(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), lower).distinct(), name, path)
    n, mark = stars.count(), None
    for _ in range(rounds):
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        nearest = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count_if(F.col("b") > F.col("a")).alias("n"))
        large = join_hot(both.where("b > a"), nearest, "a", "n", n).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.unionByName(stars.where("a > b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        moved = join_hot(large, least, "a", "n", 2 * n).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        old, path = path, fresh_path(spark, name)
        stars = stage_table(moved.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), name, path)
        remove(spark, old)
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            return stars.select(F.col("a").alias("node"), F.col("b").alias("root"))
        n, mark = now[0], now
    raise RuntimeError("components did not settle")


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, fp, component_id), one per input row.

    Texts whose fingerprints differ in at most `distance` bits are linked;
    component_id is the smallest key that can be reached, null if no row of the
    component has one. Null and empty texts have fingerprint zero and link like
    any other; repeated rows and rows that share a key are each reported; an
    empty table gives none. Other columns of docs are not read, so clashing
    names do no harm.
    """
    fps = stage_table(fingerprints(docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))), "fps")
    distinct = fps.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("copies"))
    distinct = stage_table(distinct, "distinct-fps")
    n_distinct = distinct.count()
    links = similar_links(distinct.select("fp"), n_distinct, distance)
    roots = connected(links)
    rooted = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least_id", "copies", F.coalesce("root", "fp").alias("root"))
    rooted = stage_table(rooted, "rooted-fps")
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"), F.count("*").alias("members"))
    named = join_hot(rooted, least, "root", "members", n_distinct).select("fp", "copies", "component_id")
    return join_hot(fps, named, "fp", "copies", fps.count()).select(F.col("doc_id").alias(key), "fp", "component_id")


def hex_fingerprint(column):
    """16 lower-case hex digits of a signed long."""
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that stay: one of each near-duplicate component, all columns kept.

    The row with the smallest key stays, null keys last; among equal keys the
    first by content. Rows are told apart by their place in a staged copy, not
    by the key, so a key may be null or repeated, and no column of docs can
    clash with a helper's.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = stage_table(docs.select(F.monotonically_increasing_id().alias("row"), whole.alias("doc")), "rows")
    own = F.col("doc").getField(key)
    content = F.xxhash64(*[F.col("doc").getField(c).cast("string") for c in docs.columns])
    order = F.struct(own.isNull().alias("no_key"), own.alias("key"), content.alias("content"), F.col("row").alias("row"))
    found = near_duplicates(rows.select(order.alias("order"), F.col("doc").getField(text).alias("text")), key="order")
    kept = found.where("order.row = component_id.row").select(F.col("order.row").alias("row"))
    return rows.join(kept, "row", "left_semi").select(*[F.col("doc").getField(c).alias(c) for c in docs.columns])
