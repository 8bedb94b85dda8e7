"""Features: TF-IDF, term loadings, imputation, one-hot, scaling, payload checks, token display."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import keyword_only
from pyspark.ml import Pipeline, Transformer
from pyspark.ml.feature import PCA, OneHotEncoder, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from listinglens.functions.parse import normalize_string, room_count
from listinglens.functions.text import ascii_fold, collapse_ws
from listinglens.operators.quantiles import exact_quantiles
from listinglens.operators.ranks import global_rank
from listinglens.session import Scratch, require_columns, rounded, stage_table

#: Levels of a column that are broadcast.
LEVELS = 100_000
#: Words of documents whose terms are counted at a time, and documents of an Arrow batch.
WORDS, BATCH = 1 << 18, 500
#: Sparse rows that are multiplied at a time, as a dense matrix if it has no more than DENSE places for each cell.
BLOCK, DENSE = 128, 48

# -- tables ----------------------------------------------------------------------------------------------------------


def clean_tabular(df: DataFrame, text: Sequence[str] = (), numeric: Sequence[str] = (), rooms: Sequence[str] = ()) -> DataFrame:
    """The named columns in a fixed order: texts normalised, room labels counted, numbers coerced."""
    require_columns(df, [*text, *numeric, *rooms])
    cells = [normalize_string(F.col(c).cast("string")).alias(c) for c in text]
    cells += [room_count(F.col(c)).alias(c) for c in rooms]
    cells += [F.col(c).try_cast("double").alias(c) for c in numeric]
    return df.select(*[c for c in df.columns if c not in {*text, *numeric, *rooms}], *cells)


class TabularCleaner(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """clean_tabular as a pipeline stage, so that a saved bundle takes raw rows."""

    text = Param(Params._dummy(), "text", "columns to normalise", TypeConverters.toListString)
    numeric = Param(Params._dummy(), "numeric", "columns to read as numbers", TypeConverters.toListString)
    rooms = Param(Params._dummy(), "rooms", "room labels to count", TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, text: Sequence[str] = (), numeric: Sequence[str] = (), rooms: Sequence[str] = ()):
        super().__init__()
        self._setDefault(text=[], numeric=[], rooms=[])
        self._set(**{k: list(v) for k, v in self._input_kwargs.items()})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return clean_tabular(dataset, *[self.getOrDefault(p) for p in (self.text, self.numeric, self.rooms)])


def normalize_payload(df: DataFrame, expected: Mapping[str, str]) -> DataFrame:
    """The expected columns, null where absent, and `warnings`: missing, unexpected and blank ones."""
    lacking = [c for c in expected if c not in df.columns]
    extra = sorted(set(df.columns) - set(expected))
    notes = [F.lit(f"missing: {c}") for c in lacking] + [F.lit(f"unexpected: {c}") for c in extra]
    notes += [F.when(F.trim(c) == "", F.lit(f"blank: {c}")) for c, kind in expected.items() if kind == "string" and c in df.columns]
    cells = [F.col(c).cast(kind).alias(c) if c in df.columns else F.lit(None).cast(kind).alias(c) for c, kind in expected.items()]
    return df.select(*cells, F.array_compact(F.array(*notes)).alias("warnings") if notes else F.expr("cast(array() as array<string>)").alias("warnings"))


def median_fill(train: DataFrame, df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """df with nulls as the exact training median of their column."""
    medians = {r["field"]: r["quantiles"][0] for r in exact_quantiles(train, columns, (0.5,)).collect()}  # a row for each column
    return df.fillna({c: float(v) for c, v in medians.items() if v is not None})


def mode_fill(train: DataFrame, df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """df with nulls as the most frequent training text, the smallest one of ties."""
    modes = train.agg(*[F.mode(c, True).alias(c) for c in columns]).first().asDict()
    return df.fillna({c: v for c, v in modes.items() if v is not None})


def level_dictionary(train: DataFrame, column: str, scratch: Scratch) -> DataFrame:
    """Rows (level, at): the levels of a column and their places in order."""
    return global_rank(train.where(F.col(column).isNotNull()).select(F.col(column).alias("level")).distinct(), ["level"], "at", scratch)


def one_hot(train: DataFrame, df: DataFrame, column: str) -> DataFrame:
    """df with `<column>_hot`: a sparse vector with a cell for each training level in order, all zero for unseen ones and nulls.

    Levels are a table, so there may be millions; one of up to LEVELS rows is broadcast.
    """
    scratch = Scratch(df.sparkSession)
    levels = level_dictionary(train, column, scratch)
    n = levels.count()
    if not n:
        scratch.clear()
        return df.withColumn(f"{column}_hot", array_to_vector(F.expr("cast(array() as array<double>)")))
    encoder = OneHotEncoder(inputCol="_at", outputCol=f"{column}_hot", dropLast=True, handleInvalid="keep")  # the place after the last is dropped: all zero
    encoder = encoder.fit(levels.agg(F.max("at").cast("double").alias("_at")))
    known = levels.select(F.col("level").alias("_level"), F.col("at").cast("double").alias("_at"))
    met = df.join(F.broadcast(known) if n <= LEVELS else known, F.col(column) == F.col("_level"), "left")
    return encoder.transform(met.fillna(float(n), ["_at"])).drop("_level", "_at")


def standard_scale(train: DataFrame, df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns less the training mean over the population deviation; a constant column becomes zero."""
    stats = train.agg(*[F.struct(F.avg(c).alias("m"), F.nullif(F.stddev_pop(c), F.lit(0.0)).alias("s")).alias(f"_{c}") for c in columns])
    wide = df.crossJoin(F.broadcast(stats))  # one row
    return wide.withColumns({c: F.coalesce((F.col(c) - F.col(f"_{c}.m")) / F.col(f"_{c}.s"), F.lit(0.0)) for c in columns}).drop(*[f"_{c}" for c in columns])


def weight_features(c: Column, weights: Sequence[float]) -> Column:
    return F.transform(F.arrays_zip(c.alias("x"), F.array(*map(F.lit, weights)).alias("w")), lambda z: z["x"] * z["w"])


# -- text ------------------------------------------------------------------------------------------------------------


def ngrams(words: Column) -> Column:
    """Words and neighbouring pairs, repeats included."""
    pairs = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return F.concat(words, pairs)


def _document_terms(words: pa.ListArray, known_left: pa.Array | None = None, known_right: pa.Array | None = None, pairs: bool = True) -> Iterator[tuple[int, int, pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """The terms (words and neighbouring pairs) of documents, in runs of about WORDS words: first row, rows, terms, and the cells in order of their term: number of the term, row in the run, occurrences.

    Words become numbers first, so a pair is one number too and only different
    terms are written out. With known words there are only pairs, of such a
    left and such a right word.
    """
    words = words.combine_chunks() if isinstance(words, pa.ChunkedArray) else words
    ends = np.concatenate([[0], np.cumsum(np.nan_to_num(pc.list_value_length(words).to_numpy(zero_copy_only=False)).astype(np.int64))])
    flat, first = words.flatten(), 0
    while first < len(words):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + WORDS, side="right")) - 1)
        coded = flat.slice(ends[first], ends[last] - ends[first]).dictionary_encode()
        code, known, rows = coded.indices.to_numpy().astype(np.int64), coded.dictionary, last - first
        row = np.repeat(np.arange(rows), np.diff(ends[first : last + 1]))
        paired = np.flatnonzero(row[1:] == row[:-1])
        if not pairs:
            paired = paired[:0]
        if known_left is not None:
            left, right = (pc.is_in(known.cast(pa.string()), value_set=x).to_numpy(zero_copy_only=False) for x in (known_left, known_right))
            paired = paired[left[code[paired]] & right[code[paired + 1]]]
        alone = code if known_left is None else code[:0]
        term = np.concatenate([alone, (code[paired] + 1) * len(known) + code[paired + 1]])
        cells, n = np.unique(term * rows + np.concatenate([row[: len(alone)], row[paired]]), return_counts=True)
        terms, at = np.unique(cells // rows, return_inverse=True)
        single = terms < len(known)
        left, right = known.take(pa.array(terms[~single] // max(len(known), 1) - 1)), known.take(pa.array(terms[~single] % max(len(known), 1)))
        written = pa.concat_arrays([known.take(pa.array(terms[single])), pc.binary_join_element_wise(left, right, " ")])  # numbers of words come before those of pairs
        yield first, rows, written, at, cells % rows, n
        first = last


def _short_batches(df: DataFrame) -> None:
    """From now on an Arrow batch has BATCH rows at most: their words are long lists."""
    name, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession.conf
    if not 0 < int(conf.get(name)) <= BATCH:
        conf.set(name, str(BATCH))


def _term_counts(left: list[str] | None = None, right: list[str] | None = None):
    """mapInArrow's function: rows (term, df, n) of each run of documents, of its words alone or of the pairs of known words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [] if left is None else [pa.array(x, pa.string()) for x in (left, right)]
        for batch in batches:
            for _, _, terms, at, _, n in _document_terms(batch.column(0), *known, pairs=left is not None):
                counts = [np.bincount(at, weights=w, minlength=len(terms)).astype(np.int64) for w in (None, n)]
                yield pa.RecordBatch.from_arrays([terms.cast(pa.string()), *map(pa.array, counts)], ["term", "df", "n"])

    return run


def vocabulary(docs: DataFrame, words: str, most: int, least_df: int) -> DataFrame:
    """Rows (term, df, n): the `most` commonest terms of those in least_df documents or more.

    A pair is no more frequent than its words. So single words are counted
    first, and then only pairs that can still be among the `most`: the left
    word is one of the `most` commonest words itself, as a pair comes after its
    left word, and the right word is as frequent as the last of those.
    """
    _short_batches(docs)
    docs = docs.select(words).where(F.col(words).isNotNull())

    def counted(run) -> DataFrame:
        counts = docs.mapInArrow(run, "term string, df long, n long")
        return counts.groupBy("term").agg(F.sum("df").alias("df"), F.sum("n").alias("n")).where(F.col("df") >= least_df)

    scratch = Scratch(docs.sparkSession)
    single = scratch.stage(counted(_term_counts()), "words")
    left = single.orderBy(F.desc("n"), "term").limit(most).collect()  # `most` rows
    ties = single.where((F.col("n") == left[-1]["n"]) if len(left) == most else F.lit(False)).select("term").collect()  # words as frequent as the last
    known = [r["term"] for r in left]
    pairs = counted(_term_counts(known, sorted({*known, *[r["term"] for r in ties]})))
    return scratch.result(single.unionByName(pairs).orderBy(F.desc("n"), "term").limit(most), "vocabulary")


def tfidf(docs: DataFrame, key: str, words: str, most: int = 2000, least_df: int = 3) -> DataFrame:
    """Rows (key, term, weight): smooth idf over terms in least_df documents or more, the `most` commonest of them, rows of unit length.

    The vocabulary is known before terms are counted by document; the documents
    are dealt by key, so neither these counts nor the norms shuffle a term.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # stated, as few bytes of words become many terms
    docs = stage_table(docs.select(key, words).repartition(parts, key), "documents-words")  # words are made once, for the vocabulary and for the weights
    total = docs.agg(F.count("*").alias("total"))
    idf = vocabulary(docs, words, most, least_df).crossJoin(F.broadcast(total)).select("term", (F.log((1 + F.col("total")) / (1 + F.col("df"))) + 1).alias("idf"))  # one row
    terms = docs.repartition(parts, key).select(key, F.explode(ngrams(F.col(words))).alias("term")).join(F.broadcast(idf), "term")  # `most` rows at most
    raw = terms.groupBy(key, "term").agg((F.count("*") * F.first("idf")).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return raw.select(key, "term", (F.col("w") / norm).alias("weight"))


#: A sparse row: its length, and the indices and values of its cells.
SPARSE = "struct<size:int,indices:array<int>,values:array<double>>"


def tfidf_vectors(train: DataFrame, df: DataFrame, words: str, most: int = 5000, least_df: int = 3, out: str = "text_vector") -> tuple[DataFrame, list[str]]:
    """df with normalised TF-IDF vectors of the training vocabulary as sparse rows, and the vocabulary; a null text has no cells."""
    told = vocabulary(train, words, most, least_df).collect()  # `most` rows at most
    total, terms = train.count(), [r["term"] for r in told]
    idf = np.array([math.log((1 + total) / (1 + r["df"])) + 1 for r in told])

    @F.arrow_udf(SPARSE)
    def weigh(texts: pa.Array) -> pa.Array:
        known, parts = pa.array(terms, pa.string()), [pa.array([], pa.struct([("size", pa.int32()), ("indices", pa.list_(pa.int32())), ("values", pa.list_(pa.float64()))]))]
        for _, rows, written, at, row, n in _document_terms(texts):
            index = pc.index_in(written.cast(pa.string()), value_set=known).fill_null(-1).to_numpy()[at]
            kept = np.flatnonzero(index >= 0)
            kept = kept[np.lexsort((index[kept], row[kept]))]
            index, row, value = index[kept], row[kept], n[kept] * idf[index[kept]]
            value = value / np.sqrt(np.bincount(row, weights=value * value, minlength=rows))[row]
            ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=rows))]).astype(np.int32))
            held = [pa.array(np.full(rows, len(terms), np.int32)), pa.ListArray.from_arrays(ends, pa.array(index.astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(value))]
            parts.append(pa.StructArray.from_arrays(held, ["size", "indices", "values"]))
        return pa.concat_arrays(parts)

    return df.withColumn(out, weigh(F.col(words))), terms


def sparse_cells(df: DataFrame, column: str) -> tuple[Column, Column, Column]:
    """Indices and values, as arrays, and the size of a column of vectors or sparse rows."""
    if isinstance(df.schema[column].dataType, StructType):
        return F.col(column)["indices"], F.col(column)["values"], F.col(column)["size"]
    held = F.unwrap_udt(column)
    indices = F.coalesce(held["indices"], F.sequence(F.lit(0), F.size(held["values"]) - 1))
    return F.when(F.size(held["values"]) == 0, F.expr("cast(array() as array<int>)")).otherwise(indices), held["values"], held["size"]


def _read_sparse(batch: pa.RecordBatch, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers, indices and values of the sparse rows in two columns of a batch."""
    indices, values = batch.column(at), batch.column(at + 1)
    row = np.repeat(np.arange(len(batch)), np.diff(indices.offsets.to_numpy()))
    return row, indices.flatten().to_numpy(), values.flatten().to_numpy()


def _times(row: np.ndarray, column: np.ndarray, value: np.ndarray, dense: np.ndarray, rows: int) -> np.ndarray:
    """The sparse matrix of these cells, with so many rows, times a dense one."""
    return np.stack([np.bincount(row, weights=value * dense[column, c], minlength=rows) for c in range(dense.shape[1])], axis=1)


def _sparse_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow's function: BLOCK sparse rows as one row of bytes, which the rounds read as they are."""
    for batch in batches:
        for at in range(0, len(batch), BLOCK):
            part = batch.slice(at, BLOCK)
            row, column, value = _read_sparse(part, 0)
            held = [x.tobytes() for x in (row.astype(np.int32), column.astype(np.int32), value.astype(float))]
            yield pa.RecordBatch.from_arrays([pa.array([len(part)], pa.int32()), *[pa.array([x], pa.binary()) for x in held]], ["n", "rows", "indices", "values"])


def _gram_times(dense, terms: int):
    """mapInArrow's function: a task's part of A'A times a dense matrix, a row for each term that it has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = dense.value
        total = np.zeros((terms, q.shape[1]))
        for batch in batches:
            for n, *held in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                row, column, value = (np.frombuffer(x, t) for x, t in zip(held, (np.int32, np.int32, float), strict=True))
                if n * terms <= DENSE * len(value):  # zeros cost less than single cells
                    filled = np.zeros((n, terms))
                    filled[row, column] = value
                    total += filled.T @ (filled @ q)
                else:
                    total += _times(column, row, value, _times(row, column, value, q, n), terms)
        there = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(there), *map(pa.array, total[there].T)], ["j", *[f"c{c}" for c in range(q.shape[1])]])

    return run


def truncated_svd(df: DataFrame, column: str, k: int, spare: int = 16, tolerance: float = 1e-9, most_rounds: int = 40, seed: int = 42) -> np.ndarray:
    """The right singular vectors (terms x k) of the rows of a vector column, without centring, by a randomised block Krylov space.

    Rows of a column that is not staged are made twice, for their size and for
    the blocks that the rounds read.
    Each round reads the rows once and multiplies A'A with a block of k + spare
    vectors; tasks add up their parts, and the driver keeps the space, which has
    a row for each vocabulary term. It ends when the residual of each wanted
    vector is under the tolerance, by the largest eigenvalue. The largest
    loading of a vector is positive.
    """
    spark, scratch = df.sparkSession, Scratch(df.sparkSession)
    rows = df.where(F.col(column).isNotNull()).select(*[c.alias(n) for c, n in zip(sparse_cells(df, column), ("indices", "values", "size"), strict=True)])
    terms = rows.agg(F.coalesce(F.max("size"), F.max(F.size("values")), F.lit(0))).first()[0]
    rows = scratch.stage(rows.select("indices", "values").mapInArrow(_sparse_blocks, "n int, rows binary, indices binary, values binary"), "svd-rows")
    k = min(k, terms)
    width = min(terms, k + spare)
    block = np.linalg.qr(np.random.default_rng(seed).normal(size=(terms, width)))[0]
    basis, image = np.zeros((terms, 0)), np.zeros((terms, 0))
    vectors = np.zeros((terms, k))
    for _ in range(most_rounds):
        dense = spark.sparkContext.broadcast(block)
        names = [f"c{c}" for c in range(block.shape[1])]
        parts = rows.mapInArrow(_gram_times(dense, terms), "j long, " + ", ".join(f"{n} double" for n in names))
        summed = parts.groupBy("j").agg(*[F.sum(n).alias(n) for n in names]).toPandas()  # a row for each term
        product = np.zeros(block.shape)
        product[summed["j"].to_numpy(np.int64)] = summed[names].to_numpy()
        dense.unpersist()
        basis, image = np.hstack([basis, block]), np.hstack([image, product])
        values, turn = np.linalg.eigh(basis.T @ image)
        values, turn = values[::-1][:k], turn[:, ::-1][:, :k]
        vectors = basis @ turn
        off = np.linalg.norm(image @ turn - vectors * values, axis=0)
        if not len(values) or off.max() <= tolerance * max(values[0], np.finfo(float).tiny) or basis.shape[1] >= terms:
            break
        fresh = product
        for _ in range(2):  # once more for what rounding left
            fresh = fresh - basis @ (basis.T @ fresh)
        block, size, _ = np.linalg.svd(fresh, full_matrices=False)
        block = block[:, size > 1e-13 * max(values[0], np.finfo(float).tiny)][:, : terms - basis.shape[1]]
        if not block.shape[1]:
            break
    scratch.clear()
    top = vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])] if vectors.size else np.ones(vectors.shape[1])
    return vectors * np.where(top < 0, -1.0, 1.0)


def project(df: DataFrame, column: str, v: np.ndarray, out: str) -> DataFrame:
    """df with the vector column times v, which has a row for each vocabulary term; only the cells that a row has are multiplied."""
    loadings = df.sparkSession.sparkContext.broadcast(np.asarray(v, float))

    @F.pandas_udf("array<double>")
    def multiply(indices: pd.Series, values: pd.Series) -> pd.Series:
        sizes = [0 if x is None else len(x) for x in indices]
        row = np.repeat(np.arange(len(sizes)), sizes)
        cells = [np.concatenate([np.zeros(0, t), *[x for x in s if x is not None]]).astype(t) for s, t in ((indices, np.int64), (values, float))]
        done = _times(row, *cells, loadings.value, len(sizes))
        return pd.Series([None if x is None else d for x, d in zip(indices, done, strict=True)], dtype=object)

    return df.withColumn(out, multiply(*sparse_cells(df, column)[:2])).withColumn(out, F.when(F.col(out).isNotNull(), array_to_vector(out)))


def component_tokens(spark, v: np.ndarray, vocabulary: Sequence[str], n: int = 8) -> DataFrame:
    """Rows (component, term, loading, rank): the n terms of greatest loading of each component."""
    rows = []
    for c in range(v.shape[1]):
        size = np.round(np.abs(v[:, c]), 12)
        top = sorted(range(len(vocabulary)), key=lambda i: (-size[i], vocabulary[i]))[:n]
        rows += [(c, vocabulary[i], float(v[i, c]), r + 1) for r, i in enumerate(top)]
    return spark.createDataFrame(rows, "component int, term string, loading double, rank int")


def token_display(df: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (key, token, raw): the first raw spelling of each folded token of a text."""
    raw = F.filter(F.split(collapse_ws(F.col(text)), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    spelled = df.select(key, F.posexplode(raw).alias("pos", "raw"))
    folded = spelled.withColumn("token", ascii_fold(F.col("raw"))).where("length(token) >= 2")
    return folded.groupBy(key, "token").agg(F.min_by("raw", "pos").alias("raw"))


def token_contributions(weights: DataFrame, loadings: DataFrame, key: str, n: int = 3) -> DataFrame:
    """The n strongest terms of each sign of a row: weight times the term's attributed loading."""
    scored = weights.join(loadings, "term").groupBy(key, "term").agg(F.sum(F.col("weight") * F.col("loading")).alias("score"))
    sign = F.when(F.col("score") >= 0, "positive").otherwise("negative")
    rank = F.row_number().over(Window.partitionBy(key, "sign").orderBy(F.desc(F.abs("score")), "term"))
    return scored.withColumn("sign", sign).withColumn("rank", rank).where(F.col("rank") <= n)


def feature_space_summary(df: DataFrame, clean: str, sizes: Mapping[str, int]) -> DataFrame:
    """Long rows (measure, value): rows, blank texts and their share, and the sizes of the feature blocks."""
    blank = F.count_if(F.col(clean) == "").cast("double")
    facts = {"rows": F.count("*").cast("double"), "blank": blank, "blank_share": rounded(100 * blank / F.count("*"))}
    facts |= {k: F.lit(float(v)) for k, v in sizes.items()}
    rows = [F.struct(F.lit(k).alias("measure"), v.alias("value")) for k, v in facts.items()]
    return df.agg(F.array(*rows).alias("r")).select(F.explode("r").alias("r")).select("r.*")


# -- blocks ----------------------------------------------------------------------------------------------------------


def vector_reducer(column: str, k: int, out: str) -> Pipeline:
    """Centred and scaled principal components of a vector column."""
    scaled = StandardScaler(inputCol=column, outputCol=f"{column}_scaled", withMean=True, withStd=True)
    return Pipeline(stages=[scaled, PCA(k=k, inputCol=f"{column}_scaled", outputCol=out)])


def fuse(df: DataFrame, blocks: Sequence[str], out: str = "features") -> DataFrame:
    """The blocks as one vector; a null block fails the job."""
    return VectorAssembler(inputCols=list(blocks), outputCol=out, handleInvalid="error").transform(df)
