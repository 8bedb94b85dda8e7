"""Language identification by word-first backoff."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listinglens.llm.common import held_out, sampled, small_batches, stage_table

#: Fold that is never learned from, of FOLDS.
FOLDS, HELD_OUT = 5, 0
#: Documents, and bytes of them, that the model is fitted on, in expectation; longest n-gram.
FIT_DOCS, FIT_BYTES, LONGEST = 20_000, 200_000_000, 4
#: Least share of a language's words, or of its n-grams of one length, that a known one has: so a language knows at most
#: 1 / LEAST_SHARE words and as many n-grams of each length, however much text it is fitted on.
LEAST_SHARE = 1e-5
UNKNOWN = "und"
#: Runs of letters, and of numbers that are no decimal digits.
RUNS = re.compile(r"[^\W\d_]+")
#: Unseen words remembered, letters of the longest remembered, and n-grams that one piece of a word begins.
CACHE, CACHE_LETTERS, PIECE = 100_000, 64, 1024


def letter_runs(text: str) -> list[str]:
    """Runs of letters, the category L as in the JVM's \\p{L}."""
    runs = RUNS.findall(text)
    if all(map(str.isalpha, runs)):
        return runs
    return [word for run in runs for word in "".join([c if c.isalpha() else " " for c in run]).split(" ") if word]


@dataclass
class Model:
    """Log frequencies by language: a row of `rates` for each known word or n-gram (marked ends: ^word$)."""

    langs: list[str]
    prior: np.ndarray
    words: dict[str, int]
    grams: dict[str, int]
    rates: np.ndarray
    seen: dict[str, tuple[int, ...]] = field(default_factory=dict)

    def backoff(self, word: str) -> tuple[int, ...]:
        """Rows of the longest n-grams of an unseen word of which any is known; () if none."""
        found = self.seen.get(word)
        if found is None:
            marked = f"^{word}$"
            for n in range(min(LONGEST, len(marked)), 0, -1):
                found = tuple([r for i in range(len(marked) - n + 1) if (r := self.grams.get(marked[i : i + n])) is not None])
                if found:
                    break
            if len(word) <= CACHE_LETTERS:
                if len(self.seen) >= CACHE:
                    self.seen.clear()
                self.seen[word] = found
        return found

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, posterior); (UNKNOWN, 0) without letters."""
        words = letter_runs(text.lower()) if text else []
        if not words or not self.langs:
            return UNKNOWN, 0.0
        rows, weights = [], []
        get = self.words.get
        for word in words:
            row = get(word)
            if row is not None:
                rows.append(row), weights.append(1.0)
            elif found := self.backoff(word):
                rows += found
                weights += [1.0 / len(found)] * len(found)
        total = self.prior.copy()
        for at in range(0, len(rows), 100_000):
            total += np.asarray(weights[at : at + 100_000]) @ self.rates[rows[at : at + 100_000]]
        odds = np.exp(total - total.max())
        best = int(odds.argmax())
        return self.langs[best], float(odds[best] / odds.sum())


def fit(docs: DataFrame) -> Model:
    """Count words and n-grams of the learning folds by language.

    A sample of about FIT_DOCS rows is counted in Spark. A term is known if it
    has LEAST_SHARE of its language's words, or n-grams of its length: no
    ranking, so no task holds a language, and the floor bounds what the driver
    gathers. There is a column for each language of the sample. Rows without
    id, text or language are left out.
    """
    learn = docs.where("lang is not null and text is not null and doc_id is not null").where(~held_out(F.col("doc_id"), FOLDS, HELD_OUT))
    sample = sampled(learn.select("doc_id", "lang", "text"), FIT_DOCS, FIT_BYTES)
    words = sample.select("lang", F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("term")).where("term <> ''")
    words = stage_table(words.groupBy("lang", "term").agg(F.count("*").alias("n")), "lang-words")
    # long words go in pieces, each with the letters that its last n-grams need: a position in a string is found from its start
    marked = F.concat(F.lit("^"), "term", F.lit("$"))
    pieces = words.select("lang", "n", marked.alias("marked")).withColumn("at", F.explode(F.sequence(F.lit(1), F.length("marked"), F.lit(PIECE))))
    left = F.length("marked") - F.col("at") + 1
    pieces = pieces.select("lang", "n", "at", left.alias("left"), F.substr("marked", F.col("at"), F.lit(PIECE + LONGEST - 1)).alias("piece"))

    def cut(n: int):
        count = F.least(F.col("left") - n + 1, F.lit(PIECE))
        starts = F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.expr("cast(array() as array<int>)"))
        return F.transform(starts, lambda i: F.substr("piece", i, F.lit(n)))

    cuts = [cut(n) for n in range(1, LONGEST + 1)]
    grams = pieces.select("lang", "n", F.explode(F.concat(*cuts)).alias("term")).groupBy("lang", "term").agg(F.sum("n").alias("n"))
    grams = stage_table(grams, "lang-grams")
    table = known(words, "word").unionByName(known(grams, "gram")).toArrow().to_pandas()
    langs = sorted(table["lang"].unique())
    of = {lang: i for i, lang in enumerate(langs)}
    maps: dict[str, dict[str, int]] = {"word": {}, "gram": {}}
    parts, base, prior = [np.zeros((0, len(langs)))], 0, np.zeros(len(langs))
    for kind, rows in maps.items():
        part = table[table["kind"] == kind].sort_values(["term", "lang"])
        for term in part["term"]:
            rows.setdefault(term, base + len(rows))
        counts = np.zeros((len(rows), len(langs)))
        np.add.at(counts, (part["term"].map(rows).to_numpy(int) - base, part["lang"].map(of).to_numpy(int)), part["n"].to_numpy(float))
        size = np.zeros(len(rows))
        size[part["term"].map(rows).to_numpy(int) - base] = part["size"]
        for n in np.unique(size):  # n-grams of one length share a distribution
            at = size == n
            total = counts[at].sum(axis=0)
            counts[at] = np.log((counts[at] + 0.5) / (total + 0.5 * at.sum()))
            if kind == "word":
                prior = np.log((total + 1) / (total + 1).sum())
        parts.append(counts)
        base += len(rows)
    return Model(langs, prior, maps["word"], maps["gram"], np.concatenate(parts).astype(np.float32))


def known(rows: DataFrame, kind: str) -> DataFrame:
    """Rows (kind, lang, size, term, n) of the terms with LEAST_SHARE of all n of their language and size, 0 for words."""
    size = F.length("term") if kind == "gram" else F.lit(0)
    rows = rows.select(F.lit(kind).alias("kind"), "lang", size.alias("size"), "term", "n")
    totals = rows.groupBy("lang", "size").agg(F.sum("n").alias("total"))  # LONGEST rows a language of the sample at most
    return rows.join(F.broadcast(totals), ["lang", "size"]).where(F.col("n") >= LEAST_SHARE * F.col("total")).select(*rows.columns)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """Rows (doc_id, held_out, lang_pred, score), one per input row.

    A known word adds its log frequency in each language; an unseen one the
    mean of its longest known n-grams, from LONGEST characters down. score is
    the posterior of lang_pred. Null texts and texts without letters are
    UNKNOWN with score 0; a null id stays null and is not held out; repeated
    rows are each predicted; only the text is read.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.predict(t) for t in batch.column(1).to_pylist()]
            langs, scores = pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), langs, scores], ["doc_id", "lang_pred", "score"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    found = narrow.mapInArrow(run, "doc_id long, lang_pred string, score double")
    return found.select("doc_id", held_out(F.col("doc_id"), FOLDS, HELD_OUT).alias("held_out"), "lang_pred", "score")
