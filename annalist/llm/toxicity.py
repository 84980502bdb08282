"""Toxicity of whole texts, scored after a noisy-channel restoration of disguised words.

A writer's word passes a channel that swaps letters for look-alikes (``1d10t``), repeats letters
(``idiooot``) and puts separators between them (``i d i o t``, ``i.d.i.o.t``). The readings of a
disguised word form a lattice over characters: a sign is a letter or left out, a repeated letter
is kept or left out, each at a cost. The Viterbi path under a character trigram model is the
restored word; scores also look at the paths that leave out or keep as much as they can. A word
of letters alone without repeats has one reading, itself, and digits without a letter or another
sign are a number.

The character model counts the words of all documents. The terms that mark toxic text are learned
from a bounded sample of labelled rows: whole words after different words, and word beginnings by
the different words they open, weighed by their odds, so that copies of a text count once. A
document's evidence is calibrated by a logistic curve.

A word is decoded only if some path of its lattice spells a learnt term or goes on from a learnt
beginning: the lattice is walked together with a tree of the terms, which ends after a few
characters for nearly all words. The readings that count are paths of that lattice, so a word that
is not decoded has the weight that decoding would give it, none.

Defined cases: of equally likely paths the first found wins; very long words and texts are read
whole; null text is empty; an empty text has no evidence and gets the curve's value for
none; equal rows get equal scores; null ids count as the empty text in the split; labels that
are null or without a document are not used; without usable
labels of both kinds every score is 0; an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from annalist.llm import common

#: Labelled rows that the model is fitted on, at most (in expectation).
MOST_LABELLED = 20_000
PREFIXES = (4, 5)
LEAST_CONTEXTS = 5
LEAST_WEIGHT = 3.0
#: Triples that a task gathers before it passes them on.
MOST_TRIPLES = 100_000
#: Words remembered by a worker: a matter of speed and memory only.
MOST_WORDS = 150_000

# Letters that a sign may stand for.
LOOKS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b",
    "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l",
}
EDGES = ".,;:?!()[]{}\"'`«»“”’…-_*&%#~^=/\\<>"
#: Signs at the edges of a word that stand for no letter.
BARE_EDGES = "".join(c for c in EDGES if c not in LOOKS)
CURRENCY = "$€£"
SPACED = re.compile(r"(?<!\S)\S(?: \S){2,}(?!\S)")
REPEATED = re.compile(r"(.)\1\1|(.)\2(.)\3", re.DOTALL)
DOUBLED = re.compile(r"(.)\1", re.DOTALL)
# Cost of reading a sign as a letter.
SWAP = 0.5
# Cost of leaving out a repeated letter or a sign that may be one; the readings of a disguised
# word that scores look at are those of this cost, of none and of the highest.
DROP = 1.5
MOST_DROP = 6.0
# Cost of taking a space between single letters for one between words.
KEEP = 4.0

EDGE, OTHER, SIZE = 0, 27, 28


def code(char: str) -> int:
    n = ord(char) - 96
    return n if 1 <= n <= 26 else EDGE if char == " " else OTHER


def places(word: str) -> list[int]:
    """Where the trigrams of a word are counted."""
    c = [EDGE, EDGE, *map(code, word), EDGE]
    return [(a * SIZE + b) * SIZE + x for a, b, x in zip(c, c[1:], c[2:])]


def trigrams_of(words: list[str], times: list[int]) -> np.ndarray:
    """How often each trigram stands in the words, each taken as often as told."""
    letters = np.frombuffer("".join([f"  {w} " for w in words]).encode("utf-32-le"), np.uint32)
    codes = letters.astype(np.int64) - 96
    codes[(codes < 1) | (codes > 26)] = OTHER
    codes[letters == 32] = EDGE
    # A word of n letters has n + 1 trigrams; the two that would begin at its end are none.
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 3
    weight = np.repeat(np.array(times, np.float64), sizes)
    ends = np.cumsum(sizes)
    weight[ends - 1] = weight[ends - 2] = 0
    at = (codes[:-2] * SIZE + codes[1:-1]) * SIZE + codes[2:]
    return np.bincount(at, weight[:-2], SIZE**3).astype(np.int64)


def legible(word: str) -> bool:
    """Whether a word has a letter, or a sign that may be one and is no part of a number or a price."""
    if any(x.isalpha() for x in word):
        return True
    return any(x in LOOKS and not x.isdigit() for x in word.strip("!(+").lstrip(CURRENCY))


class Channel:
    """Restores words under a character trigram model: log probabilities by two codes and the next."""

    def __init__(self, trigrams: np.ndarray):
        counts = trigrams.reshape(SIZE, SIZE, SIZE).astype(np.float64)
        pairs = counts.sum(0) + 0.1
        backoff = pairs / pairs.sum(1, keepdims=True)
        seen = counts.sum(2, keepdims=True)
        self.lm = np.log((counts + 5.0 * backoff[None]) / (seen + 5.0)).ravel().tolist()

    def readings(self, word: str, drop: float = DROP) -> list[list[tuple[str, float]]]:
        """Per character what it may stand for, ``""`` for nothing, each with its cost."""
        out = []
        for at, char in enumerate(word):
            repeats = at > 0 and word[at - 1] == char
            if char == " ":
                choices = [("", 0.0), (" ", KEEP)]
            elif char.isalpha():
                choices = [(char, 0.0), ("", drop)] if repeats else [(char, 0.0)]
            else:
                choices = [(x, SWAP) for x in LOOKS.get(char, "")]
                if not choices:
                    choices.append(("", 0.0))
                elif repeats or not char.isdigit():
                    choices.append(("", drop))
            out.append(choices)
        return out

    def viterbi(self, word: str, drop: float = DROP) -> str:
        """The likeliest reading of a word or of spaced letters."""
        lm = self.lm
        paths: dict[tuple[int, int], tuple[float, tuple | None]] = {(EDGE, EDGE): (0.0, None)}
        for choices in [*self.readings(word, drop), [(" ", 0.0)]]:
            new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (score, path) in paths.items():
                for char, cost in choices:
                    if char:
                        c = code(char)
                        state, value, way = (b, c), score + lm[(a * SIZE + b) * SIZE + c] - cost, (path, char)
                        if c == EDGE:
                            state = (EDGE, EDGE)
                    else:
                        state, value, way = (a, b), score - cost, path
                    if state not in new or value > new[state][0]:
                        new[state] = (value, way)
            paths = new
        path = max(paths.values(), key=lambda x: x[0])[1]
        chars = []
        while path:
            path, char = path
            chars.append(char)
        return "".join(reversed(chars)).strip()

    def word(self, word: str) -> str:
        """A lower-case word restored; words with one reading stay as they are."""
        core = word.strip(EDGES)
        if core.isalpha() and not self.leads(word, core):
            return self.viterbi(core) if REPEATED.search(core) else core
        whole = word.strip(BARE_EDGES)
        if not legible(whole):
            return core
        return self.viterbi(whole)

    @staticmethod
    def leads(word: str, core: str) -> bool:
        """Whether a sign other than a bracket that may be a letter stands before a word."""
        return any(c in LOOKS and c != "(" for c in word[: word.index(core)])

    def forms(self, word: str) -> list[str]:
        """The readings of a lower-case word: restored, with all that may go left out, with all kept."""
        first = self.word(word)
        whole = word.strip(BARE_EDGES)
        if (whole.isalpha() and not DOUBLED.search(whole)) or not legible(whole):
            return [first]
        return list(dict.fromkeys([first, self.viterbi(whole, 0.0), self.viterbi(whole, MOST_DROP)]))

    def words(self, text: str, one) -> list:
        """``one`` of every restored word of a text, spaced letters put together first."""
        text = text.lower()
        words = text.split()
        found = [one(x) for x in words]
        if sum(len(x) == 1 for x in words) > 2:
            for span in SPACED.findall(" ".join(words)):
                found.extend(one(x) for x in self.viterbi(span).split() if len(x) > 1)
        return found


def terms(word: str) -> list[str]:
    """The whole word and its beginnings, which are marked."""
    return [word, *(word[:n] + "+" for n in PREFIXES if len(word) > n)] if word else []


@dataclass
class Model:
    trigrams: np.ndarray
    weights: dict[str, float]
    slope: float = 1.0
    base: float = 0.0

    def score(self, evidence: float) -> float:
        if self.base == -math.inf:
            return 0.0
        return 1.0 / (1.0 + math.exp(-max(min(self.slope * evidence + self.base, 500.0), -500.0)))


# Marks in the tree of terms: here a term ends, here a learnt beginning.
WHOLE, OPENING = "", "+"


class Scorer:
    """Evidence of texts under a model, with the weights of words seen before."""

    def __init__(self, model: Model):
        self.channel, self.model, self.known = Channel(model.trigrams), model, {}
        self.tree: dict = {}
        for term in model.weights:
            opening = term.endswith("+") and len(term) - 1 in PREFIXES
            node = self.tree
            for char in term[:-1] if opening else term:
                node = node.setdefault(char, {})
            node[OPENING if opening else WHOLE] = {}

    def spells(self, word: str) -> bool:
        """Whether some path of the word's lattice is a term or goes on from a learnt beginning."""
        nodes = [self.tree]
        before = ""
        for char in word:
            if char.isalpha():
                choices, skip = char, char == before
            else:
                choices, skip = LOOKS.get(char, ""), True
            new = [node[c] for node in nodes for c in choices if c in node]
            if skip:
                new += nodes
            if not new:
                return False
            if any(OPENING in node for node in new):
                return True
            nodes, before = new, char
            if len(nodes) > 64:
                nodes = list({id(n): n for n in nodes}.values())
        return any(WHOLE in node for node in nodes)

    def weight(self, word: str) -> float:
        value = self.known.get(word)
        if value is None:
            if len(self.known) >= MOST_WORDS:
                self.known.clear()
            value, weights = 0.0, self.model.weights
            # Readings are paths over the word without its edges, or without those that are no letters.
            core, whole = word.strip(EDGES), word.strip(BARE_EDGES)
            if (
                self.spells(core)
                or (whole != core and self.spells(whole))
                or (not core.isalpha() and any(t in weights for t in terms(core)))
            ):
                forms = self.channel.forms(word)
                value = max((weights.get(t, 0.0) for form in forms for t in terms(form)), default=0.0)
            self.known[word] = value
        return value

    def evidence(self, text: str) -> float:
        """Weights of the words that speak for toxicity, the strongest two counted in full."""
        found = sorted((x for x in self.channel.words(text, self.weight) if x), reverse=True)
        return sum(found[:2]) + math.log1p(sum(found[2:]))


def _sample(docs: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """Labelled rows outside the held-out part, at most about ``MOST_LABELLED``, with their texts."""
    fit = labels.select("doc_id", F.col(label).cast("int").alias("y")).where("doc_id IS NOT NULL AND y IS NOT NULL")
    fit = fit.where(common.crc_mod(F.col("doc_id"), 4) != 2).groupBy("doc_id").agg(F.max("y").alias("y"))
    share = min(1.0, MOST_LABELLED / max(fit.count(), 1))
    picked = fit.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < math.ceil(share * (1 << 20)))
    return common.text_column(docs).join(common.by_size(docs.sparkSession, picked, 2 * MOST_LABELLED), "doc_id")


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Model:
    """Learn the character model, the term weights and the curve from the labelled sample."""
    common.ship(docs.sparkSession)
    rows = common.stage(_sample(docs, labels, label), "toxicity-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SIZE**3, np.int64)
        for batch in common.slices(batches):
            words: Counter[str] = Counter()
            for text in common.raw_texts(batch):
                words.update(text.decode(errors="replace").lower().split())
            plain = [(w, n) for w, n in ((w.strip(EDGES), n) for w, n in words.items()) if w.isalpha()]
            if plain:
                total += trigrams_of(*map(list, zip(*plain)))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "n"])

    trigrams = np.zeros(SIZE**3, np.int64)
    for row in common.text_column(docs).select("text").mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        trigrams[row["at"]] = row["n"]

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        channel = Channel(trigrams)
        found: set[tuple[str, str, int]] = set()

        def flush() -> pa.RecordBatch:
            terms_, befores, ys = zip(*found)
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(terms_), pa.array(befores), pa.array(ys)], ["term", "before", "y"])

        for batch in common.slices(batches):
            for text, y in zip(common.raw_texts(batch), batch.column("y").to_pylist()):
                words = channel.words(text.decode(errors="replace"), channel.word)
                for before, word in zip(["", *words], words):
                    # A word counts once for each word before it, a beginning for each whole word.
                    found.update((t, before if t == word else word, y) for t in terms(word))
                    if len(found) >= MOST_TRIPLES:
                        yield flush()
        if found:
            yield flush()

    seen = rows.select("text", F.col("y").cast("long").alias("y")).mapInArrow(contexts, "term string, before string, y long")
    odds = seen.distinct().groupBy("term").agg(F.sum("y").alias("yes"), F.sum(1 - F.col("y")).alias("no"))
    sizes = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.sum(F.length("text")).alias("n")).collect()}
    yes_size, no_size = sizes.get(1) or 0, sizes.get(0) or 0
    if not yes_size or not no_size:
        return Model(trigrams, {}, 0.0, -math.inf)
    weight = F.log((F.col("yes") + 0.5) / (F.col("no") + 1.5)) - math.log(yes_size / no_size)
    strong = odds.where(F.col("yes") >= LEAST_CONTEXTS).withColumn("w", weight).where(F.col("w") >= LEAST_WEIGHT)
    # The sample bounds them: each has five contexts in it at least.
    kept = strong.select("term", "w").orderBy("term").collect()
    # The model of characters knows the learnt words too, with a hundredth of its weight, so
    # that of two readings of a disguised word the learnt one is the likelier.
    learnt = [r["term"] for r in kept if not r["term"].endswith("+")]
    share = -(-int(trigrams.sum()) // (100 * max(sum(len(w) + 1 for w in learnt), 1)))
    for word in learnt:
        for at in places(word):
            trigrams[at] += share
    model = Model(trigrams, {r["term"]: r["w"] for r in kept})
    fitted = _evidence(rows.select("y", "text"), "y", "int", model).collect()
    model.slope, model.base = logistic(
        np.array([r["evidence"] for r in fitted]), np.array([r["y"] for r in fitted], np.float64)
    )
    return model


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.01) -> tuple[float, float]:
    """Slope and base of a logistic curve through labelled numbers, by Newton's method."""
    design = np.stack([x, np.ones_like(x)], 1)
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        step = design.T @ (y - p) - ridge * beta
        change = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + ridge * np.eye(2), step)
        beta += np.clip(change, -5, 5)
        if np.abs(change).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1])


def _evidence(df: DataFrame, key: str, kind: str, model: Model) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in common.slices(batches):
            found = [scorer.evidence(x.decode(errors="replace")) for x in common.raw_texts(batch)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), pa.array(found, pa.float64()), pa.array(map(model.score, found), pa.float64())],
                [key, "evidence", "score"],
            )
        scorer.known.clear()
        common.give_back()

    return df.mapInArrow(run, f"{key} {kind}, evidence double, score double")


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, evidence, score`` of every row; the text is all that a score depends on."""
    common.ship(docs.sparkSession)
    source = common.text_column(docs)
    return _evidence(source, "doc_id", source.schema["doc_id"].dataType.simpleString(), model)


def reject(docs: DataFrame, model: Model, least: float, text: str = "text") -> DataFrame:
    """The rows that score below ``least``, with all their columns."""
    common.ship(docs.sparkSession)

    names = common.plain_names(docs)
    place = names[docs.columns.index(text)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in common.slices(batches, place):
            scores = (model.score(scorer.evidence(x.decode(errors="replace"))) for x in common.raw_texts(batch, place))
            yield batch.filter(pa.array([x < least for x in scores], pa.bool_()))
        scorer.known.clear()
        common.give_back()

    rows = docs.toDF(*names)
    return rows.mapInArrow(run, rows.schema).toDF(*docs.columns)


def restore(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, restored``: the words of every row, disguised ones restored."""
    common.ship(docs.sparkSession)
    source = common.text_column(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        channel = Channel(model.trigrams)
        for batch in common.slices(batches):
            texts = [" ".join(filter(None, channel.words(x.decode(errors="replace"), channel.word))) for x in common.raw_texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "restored"])

    key = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {key}, restored string")
