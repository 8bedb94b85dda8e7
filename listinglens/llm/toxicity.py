"""Toxicity by weak supervision: voters, a generative label model, and a linear classifier on its posteriors."""

from __future__ import annotations

import functools
import re
import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listinglens.llm.common import fresh_path, held_out, remove, sampled, small_batches, stage_table, without_keys
from listinglens.llm.hashed import minimise

#: Fold that is never learned from, of FOLDS; labelled rows and their bytes, in expectation, that voters are mined from and
#: the classifier is fitted on. The label model is fitted on all rows, the classifier on all rows without a label too.
FOLDS, HELD_OUT, FIT_LABELLED, FIT_BYTES = 4, 2, 6_000, 50_000_000
#: Scores from here on are rejected.
REJECT = 0.3
#: Everyday insults in four languages, one voter each.
LEXICON = (
    "idiot stupid moron dumb fool loser clown scum trash garbage pathetic worthless disgusting ugly imbecile jerk bastard bitch "
    "dumm dumme dummkopf abschaum versager widerlich wertlos arschloch trottel "
    "imbécile stupide crétin connard ordure minable dégoûtant salaud "
    "idiota estúpido estúpida imbécil basura escoria asqueroso inútil payaso"
).split()
#: Pattern voters: masked profanity, and an insult aimed at the reader.
MASKED = re.compile(r"\b\w\*{2,}\w*")
AIMED = re.compile(r"\b(?:you|you're|du|tu|tú|eres|es)\s+(?:are\s+|bist\s+|es\s+|un\s+|una\s+|a\s+|an\s+|so\s+|such\s+)*(?:" + "|".join(LEXICON) + r")\b", re.I)
#: A term is a whole word or a word beginning of 2 to LONGEST letters. Mined voters are terms, each with a share of the text's
#: words from RATES; a voter needs so many positive texts that no voter before it marks, and so high a share of positives.
#: The classifier reads the terms of TERM_TEXTS sample texts or more.
LONGEST, MINED_TEXTS, MINED_SHARE, TERM_TEXTS = 6, 5, 0.8, 20
RATES = (0.0, 0.01, 0.015, 0.02, 0.025, 0.03, 0.04)
#: Rounds of the label model at most, change of its rates under which it has settled, smoothing of its rates, correlation
#: from which voters share their weight, share of given labels taken to be wrong, ridge of the classifier.
ROUNDS, SETTLED, SMOOTH, CORRELATED, WRONG, RIDGE = 25, 1e-4, 1.0, 0.25, 0.01, 2.0
#: Rounds in which the label model looks for correlated voters.
RESHARED = (8, 16)
#: Kinds of ballots that one task adds up in a round.
TASK_BALLOTS = 20_000
#: Partitions of the sample's terms: each is a small task result.
SAMPLE_PARTS = 32
#: Tasks that add up the gradient over all rows without a label: each sends one, of SIZE numbers at most, to the driver.
GRADIENT_PARTS = 32
#: Cells of texts that are staged as one row, and bytes of a row group of such rows: each round reads all of them.
BLOCK, GROUP_BYTES = 1 << 16, 16 << 20
#: Bits of a term's slot in the classifier; code points read at a time.
BITS, AT_ONCE = 18, 1_000_000
SIZE = 1 << BITS
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _pieces(n: int, size: int = 1 << 19) -> Iterator[slice]:
    """Slices of an array of n elements, so that what is made of it on the way stays small."""
    return (slice(at, at + size) for at in range(0, n, size))


@functools.cache
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(sys.maxunicode + 1)])


@functools.cache
def _powers() -> np.ndarray:
    return np.array([pow(int(FACTOR), k, 2**64) for k in range(64)], dtype=np.uint64)


def _mixed(code: np.ndarray, kind: int) -> np.ndarray:
    """Hash of a term of one kind: 0 a whole word, else the letters of a beginning."""
    code = (code + np.uint64(kind)) * FACTOR
    return (code ^ (code >> np.uint64(31))) * FACTOR


@dataclass
class Terms:
    """The words of some texts: how many each text has, and hash and text of every term occurrence."""

    n_words: np.ndarray
    hashes: np.ndarray
    texts: np.ndarray
    whole: int  # the first so many occurrences are whole words


def read_terms(texts: list[str]) -> Terms:
    """Words are runs of letters, lower-cased."""
    joined = "\0".join([t.lower().replace("\0", " ") for t in texts]) + "\0"
    chars = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _letters()[chars]
    edge = np.diff(letter.astype(np.int8), prepend=0)
    starts = np.flatnonzero(edge == 1)
    lengths = np.flatnonzero(edge == -1) - starts
    owner = np.searchsorted(np.flatnonzero(chars == 0), starts)
    at = np.flatnonzero(letter)
    place = at - np.repeat(starts, lengths)
    codes = chars.astype(np.uint64)
    with np.errstate(over="ignore"):
        parts = codes[at] * _powers()[place % 64]
        first = np.cumsum(lengths) - lengths
        whole = np.add.reduceat(parts, first) if len(starts) else np.zeros(0, np.uint64)
        hashes, owners = [_mixed(whole, 0)], [owner]
        code, known = codes[starts], np.arange(len(starts))
        for n in range(2, LONGEST + 1):
            more = lengths[known] >= n
            known, code = known[more], code[more]
            code = code * FACTOR + codes[starts[known] + n - 1]
            hashes.append(_mixed(code, n))
            owners.append(owner[known])
    return Terms(np.bincount(owner, minlength=len(texts)), np.concatenate(hashes), np.concatenate(owners), len(starts))


def _cut(texts: list[str]) -> Iterator[list[str]]:
    """The texts in order, about AT_ONCE code points at a time."""
    part, size = [], 0
    for text in texts:
        part.append(text)
        size += len(text)
        if size >= AT_ONCE:
            yield part
            part, size = [], 0
    if part:
        yield part


def word_hashes(words: list[str]) -> np.ndarray:
    """The hash of each word as a whole term."""
    terms = read_terms(words)
    return terms.hashes[: terms.whole]


def _slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BITS)).astype(np.int64)


@dataclass
class Detector:
    """Voters, each a term's hash and the least share of words that have it, and a logistic model over votes and terms."""

    voters: np.ndarray
    least: np.ndarray
    weights: np.ndarray
    votes: np.ndarray
    bias: float

    def fired(self, terms: Terms) -> np.ndarray:
        """(text, voter) cells: whether a voter's term has its share of the text's words."""
        hashes, n_words = terms.hashes, terms.n_words
        order = np.argsort(self.voters, kind="stable")
        wanted = np.zeros(SIZE, bool)
        wanted[_slots(self.voters)] = True
        maybe = np.flatnonzero(wanted[_slots(hashes)])
        hits = np.zeros((len(n_words), len(self.voters)))
        known = self.voters[order]
        left, right = np.searchsorted(known, hashes[maybe], "left"), np.searchsorted(known, hashes[maybe], "right")
        while (more := left < right).any():  # voters may share a term
            maybe, left, right = maybe[more], left[more], right[more]
            np.add.at(hits, (terms.texts[maybe], order[left]), 1)
            left = left + 1
        return (hits > 0) & (hits >= self.least * np.maximum(n_words, 1)[:, None])

    def read(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For each text the weight of its terms per hundred words, and its votes.

        Voters come in order: terms, then patterns, then one for texts on which no term votes.
        """
        terms = read_terms(texts)
        linear = 100.0 * np.bincount(terms.texts, self.weights[_slots(terms.hashes)], len(texts)) / np.maximum(terms.n_words, 1)
        return linear, self.cast(texts, terms)

    def cast(self, texts: list[str], terms: Terms) -> np.ndarray:
        """The votes on texts of these terms."""
        fired = self.fired(terms)
        return ballot(fired, *patterns(texts, fired.any(axis=1)))

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Probability of label 1 for each text; a null text is an empty one."""
        found = []
        for part in _cut([t or "" for t in texts]):
            linear, votes = self.read(part)
            found.append(1 / (1 + np.exp(-np.clip(self.bias + linear + votes @ self.votes, -40, 40))))
        return np.concatenate(found) if found else np.zeros(0)


def patterns(texts: list[str], asked: np.ndarray) -> tuple[list[bool], list[bool]]:
    """The votes of the two pattern voters; the second is asked where a term voter fires, since it holds one."""
    masked = [bool("**" in t and MASKED.search(t)) for t in texts]
    return masked, [bool(a and AIMED.search(t)) for a, t in zip(asked, texts, strict=True)]


def ballot(fired: np.ndarray, masked: list[bool], aimed: list[bool]) -> np.ndarray:
    """(text, voter) votes: 1 toxic, 0 abstains, -1 clean; the last voter says clean where no term voter fires."""
    none = ~fired.any(axis=1)
    return np.column_stack((fired, masked, np.asarray(aimed, bool) & ~none, -1 * none)).astype(np.int8)


def mine_voters(row: np.ndarray, slot: np.ndarray, share: np.ndarray, labels: np.ndarray) -> list[tuple[int, float]]:
    """(slot, least share) pairs that mark positive texts, chosen one by one for the positives not yet marked.

    row, slot and share are parallel. A pair must hold in MINED_TEXTS positive
    texts or more and in few others, and mark MINED_TEXTS new ones. labels are
    0, 1 or -1 for unknown.
    """
    label = labels.astype(np.int8)
    good_pairs = []
    for least in RATES:
        every, good = np.zeros(SIZE, np.int64), np.zeros(SIZE, np.int64)
        for at in _pieces(len(slot)):
            over, own = share[at] >= least, label[row[at]]
            every += np.bincount(slot[at][over & (own >= 0)], minlength=SIZE)
            good += np.bincount(slot[at][over & (own == 1)], minlength=SIZE)
        good_pairs += [(s, least) for s in np.flatnonzero((good >= MINED_TEXTS) & (good >= MINED_SHARE * (every + 1))).tolist()]
    wanted = np.zeros(SIZE, bool)
    wanted[[s for s, _ in good_pairs]] = True
    few = np.flatnonzero(wanted[slot])  # the common terms of all texts are not among them
    few = few[label[row[few]] >= 0]
    few = few[np.argsort(slot[few], kind="stable")]
    row, slot, share = row[few], slot[few], share[few]
    members: dict[tuple[int, float], np.ndarray] = {}
    for s, least in good_pairs:
        a, b = np.searchsorted(slot, [s, s + 1])
        members[s, least] = row[a:b][share[a:b] >= least]
    chosen, marked = [], np.zeros(len(labels), bool)
    while members:
        gain = {k: int((labels[r][~marked[r]] == 1).sum()) - 2 * int((labels[r] == 0).sum()) for k, r in members.items()}
        best = max(gain, key=lambda k: (gain[k], k[1], -k[0]))
        if gain[best] < MINED_TEXTS:
            break
        chosen.append(best)
        marked[members.pop(best)] = True
    return chosen


# -- the label model -------------------------------------------------------------------------------------------------


@dataclass
class LabelModel:
    """rates[c, j, v]: how often voter j says v - 1 of a text of class c; share: how much it counts; prior of class 1.

    The last voter is the given label, wrong in a share WRONG of either class;
    where there is one, it alone decides. Without rates a first guess stands in.
    """

    rates: np.ndarray | None
    share: np.ndarray
    prior: float
    told: float = 0.0  # rows with a given label

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """P(class 1) of each row of votes; a given label stands against the other voters."""
        gold = votes[:, -1]
        if self.rates is None:
            guess = np.where((votes[:, :-2] == 1).any(axis=1), 0.8, 0.05)
            return np.where(gold != 0, np.where(gold > 0, 1 - WRONG, WRONG), guess)
        ratio = (np.log(self.rates[1]) - np.log(self.rates[0])) * self.share[:, None]
        odds = np.log(self.prior / (1 - self.prior)) + ratio[np.arange(votes.shape[1]), votes + 1].sum(axis=1)
        free = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        return np.where(gold != 0, np.where(gold > 0, 1 - WRONG, WRONG), free)


def vote_sums(model: LabelModel, votes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """[c, j, v] sums over weighted rows: how often voter j says v - 1, by the posterior of class c."""
    post = model.posterior(votes)
    sides = np.stack((weights * (1 - post), weights * post))
    return np.stack([sides @ (votes == v) for v in (-1, 0, 1)], axis=2)


def vote_moments(model: LabelModel, rates: np.ndarray, votes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """[j, j] sums over weighted rows of the products of whether voters vote, less how often they do in the row's class."""
    post = model.posterior(votes)
    rest = (votes != 0) - np.stack((1 - post, post), axis=1) @ (1 - rates[:, :, 1])
    return (rest * weights[:, None]).T @ rest


def fit_label_model(n_voters: int, add_up: Callable) -> LabelModel:
    """EM for the rates of each voter's three votes in either class.

    add_up(f) sums f(votes, weights) over all rows. Given labels fix what the
    classes mean, or the larger part of the rows, which has none, would. Voters
    that agree within a class beyond chance are correlated; each counts for one
    over the number of voters that it stands for.
    """
    model, settled = LabelModel(None, np.ones(n_voters), 0.1), False
    for step in range(ROUNDS):
        sums = add_up(functools.partial(vote_sums, model))
        total = sums[:, 0].sum()
        if step == 0:  # the share of label 1 among the given ones
            gold = sums[:, -1].sum(axis=0)
            prior = (gold[2] + 1) / (gold[0] + gold[2] + 2) if gold[0] + gold[2] else 0.1
        else:
            prior = float(np.clip(sums[1, 0].sum() / max(total, 1e-9), 1e-4, 1 - 1e-4))
        rates = sums + SMOOTH
        rates /= rates.sum(axis=2, keepdims=True)
        silent = rates[:, -1, 1].mean()
        rates[:, -1] = np.array([[1 - WRONG, 0, WRONG], [WRONG, 0, 1 - WRONG]]) * (1 - silent) + np.array([0, silent, 0])
        share = model.share
        if step in RESHARED:
            square = add_up(functools.partial(vote_moments, model, rates)) / max(total, 1e-9)
            spread = np.sqrt(np.diag(square)) + 1e-9
            tied = np.where(square / np.outer(spread, spread) > CORRELATED, square / np.outer(spread, spread), 0.0)
            np.fill_diagonal(tied, 1.0)
            tied[-1, :-1] = tied[:-1, -1] = 0.0
            share = 1.0 / tied.sum(axis=1)
        settled = step > RESHARED[-1] and np.abs(rates - model.rates).max() < SETTLED
        model = LabelModel(rates, share, prior, float(sums[:, -1, [0, 2]].sum()))
        if settled:
            break
    return model


def unpacked(packed: list[bytes], gold: np.ndarray, n_terms: int) -> np.ndarray:
    """Votes, the given label last, of rows whose toxic votes are packed as numbers of voters."""
    votes = np.zeros((len(packed), n_terms + 4), np.int8)
    for i, cell in enumerate(packed):
        votes[i, np.frombuffer(cell, "<u2")] = 1
    votes[:, n_terms + 2] = -1 * ~votes[:, :n_terms].any(axis=1)
    votes[:, -1] = np.where(gold < 0, 0, 2 * gold - 1)
    return votes


def ballots(docs: DataFrame, reader: Detector) -> DataFrame:
    """Rows (doc_id, votes): the numbers of the term and pattern voters that say toxic of a text, packed."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(Detector(reader.voters, reader.least, reader.weights[:0], reader.votes, 0.0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = []
            for part in _cut([t or "" for t in batch.column(1).to_pylist()]):
                packed += [np.flatnonzero(row).astype("<u2").tobytes() for row in shared.value.cast(part, read_terms(part))[:, :-1] == 1]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], ["doc_id", "votes"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, votes binary")


def label_all(docs: DataFrame, given: DataFrame, reader: Detector) -> LabelModel:
    """The label model over all rows of docs: equal ballots are counted once, and each round of EM adds up sums in the tasks.

    The rows of an id that repeats are its kinds of ballots by the time they
    meet its label, so an id, null or not, may have any share of the rows.
    """
    voted = ballots(docs, reader).groupBy("doc_id", "votes").agg(F.count("*").alias("n")).join(given, "doc_id", "left")
    kinds = voted.groupBy("votes", F.coalesce("label", F.lit(-1)).alias("gold")).agg(F.sum("n").cast("double").alias("n"))
    kinds = stage_table(kinds, "ballots")
    kinds = kinds.coalesce(1 + kinds.count() // TASK_BALLOTS)
    n_terms = len(reader.voters)

    def add_up(f) -> np.ndarray:
        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                if batch.num_rows:
                    votes = unpacked(batch.column(0).to_pylist(), batch.column(1).to_numpy(), n_terms)
                    found = f(votes, batch.column(2).to_numpy())
                    total = found if total is None else total + found
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total.astype("<f8").tobytes()], pa.binary())], ["sums"])

        total = f(np.zeros((0, n_terms + 4), np.int8), np.zeros(0))
        for r in kinds.mapInArrow(part, "sums binary").collect():  # a row for each task
            total = total + np.frombuffer(bytes(r["sums"]), "<f8").reshape(total.shape)
        return total

    return fit_label_model(n_terms + 4, add_up)


# -- fitting ---------------------------------------------------------------------------------------------------------


@dataclass
class Sample:
    """Distinct texts to mine and fit on: their labels (-1 unknown); parallel arrays of text, slot and share of words; hashes of positive texts."""

    labels: np.ndarray
    row: np.ndarray
    slot: np.ndarray
    share: np.ndarray
    hashes: np.ndarray


READ = "mark long, label int, slots binary, shares binary, hashes binary"


def _read_sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For rows (mark, label, text) those of READ: the slots of each text's terms, their shares, and in positive texts all hashes; packed arrays."""
    for batch in batches:
        labels, cells = batch.column(1).to_pylist(), []
        for part in _cut([t or "" for t in batch.column(2).to_pylist()]):
            terms = read_terms(part)
            key, counts = np.unique(terms.texts * SIZE + _slots(terms.hashes), return_counts=True)
            text, slot = key // SIZE, (key % SIZE).astype("<i4")
            shares = (counts / terms.n_words[text]).astype("<f4")
            ends = np.searchsorted(text, np.arange(len(part) + 1))
            order = np.argsort(terms.texts, kind="stable")
            stops = np.searchsorted(terms.texts[order], np.arange(len(part) + 1))
            for i in range(len(part)):
                hashes = terms.hashes[order[stops[i] : stops[i + 1]]].tobytes() if labels[len(cells)] == 1 else b""
                cells.append((slot[ends[i] : ends[i + 1]].tobytes(), shares[ends[i] : ends[i + 1]].tobytes(), hashes))
        packed = [pa.array([c[i] for c in cells], pa.binary()) for i in range(3)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *packed], ["mark", "label", "slots", "shares", "hashes"])


def gathered(rows: Iterator) -> tuple[Sample, list[int]]:
    """Rows of READ as arrays, and their marks. The cells of a row are added to one buffer each, so they are held once."""
    marks, labels, lengths = [], [], []
    slots, shares, hashes = bytearray(), bytearray(), bytearray()
    for r in rows:
        marks.append(r["mark"]), labels.append(r["label"]), lengths.append(len(r["slots"]) // 4)
        slots += r["slots"]
        shares += r["shares"]
        hashes += r["hashes"]
    row = np.repeat(np.arange(len(marks), dtype=np.int32), np.array(lengths, int))
    return Sample(np.array(labels, int), row, np.frombuffer(slots, "<i4"), np.frombuffer(shares, "<f4"), np.frombuffer(hashes, "<u8")), marks


def common_terms(sample: Sample) -> Sample:
    """The sample with the slots of TERM_TEXTS texts or more: rarer terms say little about other texts. Its arrays are overwritten."""
    often = np.zeros(SIZE, np.int64)
    for at in _pieces(len(sample.slot)):
        often += np.bincount(sample.slot[at], minlength=SIZE)
    often, n = often >= TERM_TEXTS, 0
    for at in _pieces(len(sample.slot)):
        keep = often[sample.slot[at]]
        end = n + int(keep.sum())
        for cells in (sample.row, sample.slot, sample.share):
            cells[n:end] = cells[at][keep]
        n = end
    return Sample(sample.labels, sample.row[:n], sample.slot[:n], sample.share[:n], np.zeros(0, np.uint64))


def voters_of(sample: Sample) -> Detector:
    """A detector without weights, that has the lexicon's and the mined voters; a mined slot stands for the hash that positive texts have most."""
    voters = list(word_hashes(LEXICON))
    least = [0.0] * len(voters)
    slots = _slots(sample.hashes)
    for slot, share in mine_voters(sample.row, sample.slot, sample.share, sample.labels):
        values, counts = np.unique(sample.hashes[slots == slot], return_counts=True)
        voters.append(values[counts.argmax()])
        least.append(share)
    return Detector(np.array(voters, np.uint64), np.array(least), np.zeros(SIZE), np.zeros(len(voters) + 3), -4.0)


def used_slots(sample: Sample) -> np.ndarray:
    """The slots that the sample's texts have, ascending: the classifier's columns."""
    there = np.zeros(SIZE, bool)
    there[sample.slot] = True
    return np.flatnonzero(there)


def column_of(used: np.ndarray) -> np.ndarray:
    """The column of each slot, or -1."""
    column = np.full(SIZE, -1, np.int32)
    column[used] = np.arange(len(used))
    return column


def classifier(sample: Sample, votes: np.ndarray, reader: Detector, model: LabelModel) -> Detector:
    """The logistic model of terms and votes, fitted on the label model's posteriors of the sample's texts; votes end with the given labels."""
    if not len(sample.labels):
        return reader
    used = used_slots(sample)
    loss = logistic_loss(sample.row, column_of(used)[sample.slot], sample.share, len(used), votes[:, :-1].astype(float), model.posterior(votes))
    return with_weights(reader, used, minimise(loss, np.zeros(len(used) + votes.shape[1]), rounds=40))


def with_weights(reader: Detector, used: np.ndarray, x: np.ndarray) -> Detector:
    """The reader with the weights x: of the used slots, of the votes, and the bias."""
    weights = np.zeros(SIZE)
    weights[used] = x[: len(used)]
    return Detector(reader.voters, reader.least, weights, x[len(used) : -1], float(x[-1]))


def cross_entropy(x: np.ndarray, row: np.ndarray, col: np.ndarray, value: np.ndarray, scale: np.ndarray | float, n_cols: int, dense: np.ndarray, post: np.ndarray) -> tuple[float, np.ndarray]:
    """Cross-entropy of soft labels under sparse weights of the values times their row's scale, dense ones and a bias, and its gradient."""
    w, v, b = x[:n_cols], x[n_cols:-1], x[-1]
    z, gw = np.zeros(len(post)), np.zeros(n_cols)
    for at in _pieces(len(row)):
        z += np.bincount(row[at], w[col[at]] * value[at], len(post))
    z = z * scale + dense @ v + b
    off = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - post
    scaled = off * scale
    for at in _pieces(len(row)):
        gw += np.bincount(col[at], scaled[row[at]] * value[at], n_cols)
    return float((np.logaddexp(0, z) - post * z).sum()), np.concatenate((gw, dense.T @ off, [off.sum()]))


def logistic_loss(row: np.ndarray, col: np.ndarray, share: np.ndarray, n_cols: int, dense: np.ndarray, post: np.ndarray, times: float = 1.0) -> Callable[[np.ndarray], tuple[float, np.ndarray]]:
    """Cross-entropy under weights of a hundred times the shares, with ridge, and its gradient; each row counts so many times."""
    ridge = np.concatenate((np.full(n_cols, 10 * RIDGE), np.full(dense.shape[1], RIDGE), [0.0]))

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        value, grad = cross_entropy(x, row, col, share, 100.0, n_cols, dense, post)
        return times * value + float(ridge @ (x * x)) / 2, times * grad + ridge * x

    return loss


CELLS = "post binary, n_words binary, votes binary, lengths binary, cols binary, counts binary"


def narrowed(values: np.ndarray) -> bytes:
    """Numbers from 0 on, in 1, 2 or 4 bytes each."""
    most = int(values.max(initial=0))
    return values.astype("<u1" if most < 1 << 8 else "<u2" if most < 1 << 16 else "<u4").tobytes()


def widened(packed: pa.Buffer, n: int) -> np.ndarray:
    """The n numbers of narrowed."""
    return np.frombuffer(packed, f"<u{packed.size // n}") if n else np.zeros(0, np.uint8)


def soft_rows(docs: DataFrame, reader: Detector, model: LabelModel, used: np.ndarray) -> DataFrame:
    """Rows of CELLS for texts without a label: neighbouring texts are a row, with BLOCK cells and those of its last text at most.

    Packed are, for each text, the label model's posterior, its words and how
    many columns it has; the places of the votes that are not 0, text by text;
    and, one text after the other, its columns and how often it has each.
    """
    small_batches(docs.sparkSession)
    lean = Detector(reader.voters, reader.least, reader.weights[:0], reader.votes, 0.0)
    shared = docs.sparkSession.sparkContext.broadcast((lean, model, column_of(used)))
    most = BLOCK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean, model, column = shared.value
        for batch in batches:
            for part in _cut([t or "" for t in batch.column(0).to_pylist()]):
                terms = read_terms(part)
                votes = lean.cast(part, terms)
                post = model.posterior(np.column_stack((votes, np.zeros(len(part), np.int8))))
                cols = column[_slots(terms.hashes)]
                key, counts = np.unique((terms.texts * SIZE + cols)[cols >= 0], return_counts=True)
                ends = np.searchsorted(key, np.arange(len(part) + 1) * SIZE)
                cols, words, lengths = key % SIZE, terms.n_words.astype("<i8"), np.diff(ends).astype("<i4")
                edges = [0, *(np.flatnonzero(np.diff(ends[:-1] // most)) + 1).tolist(), len(part)]
                blocks = []
                for a, b in zip(edges[:-1], edges[1:]):
                    cells = slice(ends[a], ends[b])
                    voted = np.flatnonzero(votes[a:b]).astype("<i4")
                    blocks.append([*(v.tobytes() for v in (post[a:b].astype("<f8"), words[a:b], voted, lengths[a:b])), narrowed(cols[cells]), narrowed(counts[cells])])
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*blocks)], ["post", "n_words", "votes", "lengths", "cols", "counts"])

    return docs.select("text").mapInArrow(run, CELLS)


def summed_entropy(rows: DataFrame, n_cols: int, n_terms: int) -> Callable[[np.ndarray], tuple[float, np.ndarray]]:
    """The cross-entropy over all rows of CELLS, and its gradient, added up in GRADIENT_PARTS tasks."""
    rows = rows.coalesce(GRADIENT_PARTS)

    def entropy(x: np.ndarray) -> tuple[float, np.ndarray]:
        shared = rows.sparkSession.sparkContext.broadcast(x)

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(n_cols + n_terms + 5)
            for batch in batches:
                for block in zip(*batch.columns):
                    post, n_words, voted, lengths, cols, counts = (cell.as_buffer() for cell in block)
                    post, lengths = np.frombuffer(post, "<f8"), np.frombuffer(lengths, "<i4")
                    n = int(lengths.sum())
                    votes = np.zeros((len(post), n_terms + 3))
                    votes.flat[np.frombuffer(voted, "<i4")] = 1
                    votes[:, -1] *= -1
                    row, col = np.repeat(np.arange(len(post)), lengths), widened(cols, n).astype(np.int64)
                    scale = 100 / np.maximum(np.frombuffer(n_words, "<i8"), 1)
                    value, grad = cross_entropy(shared.value, row, col, widened(counts, n).astype(float), scale, n_cols, votes, post)
                    total[:-1] += grad
                    total[-1] += value
            yield pa.RecordBatch.from_arrays([pa.array([total.astype("<f8").tobytes()], pa.binary())], ["sums"])

        total = np.zeros(n_cols + n_terms + 5)
        for sums in rows.mapInArrow(part, "sums binary").toArrow()["sums"]:  # a row for each task
            total += np.frombuffer(sums.as_buffer(), "<f8")
        shared.destroy()
        return float(total[-1]), total[:-1]

    return entropy


def fit_further(start: Detector, rows: DataFrame, sample: Sample, votes: np.ndarray, model: LabelModel) -> Detector:
    """The logistic model of start, fitted on the sample's texts, which stand for all labelled rows, and on all rows of CELLS.

    The sample's slots are overwritten by their columns, so that the driver holds them once.
    """
    used = used_slots(sample)
    column = column_of(used)
    for at in _pieces(len(sample.slot)):
        sample.slot[at] = column[sample.slot[at]]
    times = max(1.0, model.told / max(1, len(sample.labels)))
    known = logistic_loss(sample.row, sample.slot, sample.share, len(used), votes[:, :-1].astype(float), model.posterior(votes), times)
    others = summed_entropy(rows, len(used), len(start.voters))

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        (value, grad), (more, way) = known(x), others(x)
        return value + more, grad + way

    return with_weights(start, used, minimise(loss, np.concatenate((start.weights[used], start.votes, [start.bias])), rounds=40))


def fit_rows(texts: list[str], labels: np.ndarray) -> Detector:
    """Fit voters, label model and classifier on some texts; labels are 0, 1 or -1 for unknown."""
    mark = pa.array(np.arange(len(texts), dtype=np.int64))
    batch = pa.RecordBatch.from_arrays([mark, pa.array(labels.astype(np.int32)), pa.array(texts, pa.string())], ["mark", "label", "text"])
    sample, _ = gathered(r for part in _read_sample(iter([batch])) for r in part.to_pylist())
    reader = voters_of(sample)
    sample = common_terms(sample)
    toxic = [reader.read(part)[1] for part in _cut(texts)] or [np.zeros((0, len(reader.votes)), np.int8)]
    votes = np.column_stack((np.concatenate(toxic), np.where(labels < 0, 0, 2 * labels - 1))).astype(np.int8)
    model = fit_label_model(votes.shape[1], lambda f: f(votes, np.ones(len(votes))))
    return classifier(sample, votes, reader, model)


def fit(docs: DataFrame, labels: DataFrame) -> Detector:
    """Fit on the documents outside the held-out fold; of a document's labels the highest counts.

    Voters are mined from about FIT_LABELLED labelled rows; the label model
    counts the votes on every row; the classifier learns the labels of those
    labelled rows first, and then these and the posteriors of every row that
    has no label. Equal texts count once in the sample, which is taken after
    the join, so an id that repeats brings in no more. Null ids and texts are
    left out.
    """
    small_batches(docs.sparkSession)
    learn = ~held_out(F.col("doc_id"), FOLDS, HELD_OUT)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null").where(learn)
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").where(learn)
    given = labels.where("doc_id is not null and toxic is not null").where(learn)
    given = given.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("label"))
    given = stage_table(given, "given-labels")
    few = sampled(given.withColumn("text", F.lit("")), FIT_LABELLED, FIT_BYTES).drop("text")  # about FIT_LABELLED ids
    labelled = sampled(narrow.join(F.broadcast(few), "doc_id"), FIT_LABELLED, FIT_BYTES)
    texts = labelled.groupBy("text").agg(F.max("label").cast("int").alias("label"))
    texts = stage_table(texts.select(F.xxhash64("text").alias("mark"), "label", "text"), "toxicity-sample")
    terms = texts.repartition(SAMPLE_PARTS, "mark").mapInArrow(_read_sample, READ)
    sample, marks = gathered(terms.toLocalIterator())  # one part after the other
    reader = voters_of(sample)
    sample = common_terms(sample)
    model = label_all(narrow, given, reader)
    told = ballots(texts.select(F.col("mark").alias("doc_id"), "text"), reader).toArrow()
    packed = dict(zip(told["doc_id"].to_pylist(), told["votes"].to_pylist(), strict=True))
    votes = unpacked([packed[m] for m in marks], sample.labels, len(reader.voters))
    start = classifier(sample, votes, reader, model)
    path = fresh_path(docs.sparkSession, "toxicity-cells")
    plain = without_keys(narrow, given.select("doc_id"), "doc_id", ids)
    groups = {"parquet.block.size": GROUP_BYTES, "parquet.block.size.row.check.min": 8, "parquet.page.size.row.check.min": 8}
    soft_rows(plain, reader, model, used_slots(sample)).write.options(compression="zstd", **groups).parquet(path)
    rows = docs.sparkSession.read.schema(CELLS).parquet(path)
    found = start if rows.isEmpty() else fit_further(start, rows, sample, votes, model)
    remove(docs.sparkSession, path)
    return found


def score(docs: DataFrame, detector: Detector) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted), one per input row; only the text is read.

    Null and empty texts have no word and score by the bias and the clean
    vote; a null id stays null and is not held out; repeated rows are each
    scored.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(detector)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.scores(batch.column(1).to_pylist()))], ["doc_id", "score"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    found = narrow.mapInArrow(run, "doc_id long, score double")
    held = held_out(F.col("doc_id"), FOLDS, HELD_OUT).alias("held_out")
    return found.select("doc_id", held, "score", (F.col("score") >= REJECT).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, detector: Detector) -> DataFrame:
    """The rows of docs, all columns, that score below REJECT; a map over the rows, without a shuffle. Null texts score as empty ones."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(detector)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.scores(texts.tolist()))

    return docs.where(scored(F.col("text")) < REJECT)
