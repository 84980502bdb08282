"""Token counts of whole texts by rank-synchronous merging of ragged arrays.

A byte-pair tokenizer joins the adjacent pair of lowest rank until no pair of a pre-token is in
its list. Here the distinct pre-tokens of a batch lie end to end in one array of symbols. In each
round every pre-token finds its own lowest rank and joins all places of that pair at once, from
the left where they overlap; pre-tokens without a pair leave the arrays. The symbols that survive
are counted, and a text's count is the sum over its pre-tokens and special strings. A pre-token of
more than ``LONG`` bytes goes through the same rounds alone, with its places queued by rank, so
that a round costs what it joins and not the whole length.

Rounds are exact because a vocabulary lists each merge after those that make its parts: what a
round joins can only give pairs of higher rank. ``Merges`` refuses a file where that is not so.

Defined cases: a null text is empty, an empty text has no tokens; special strings count as one
token each, wherever they stand and in exactly their case; equal rows are counted one by one; an
empty table gives no rows; other columns are left out. Very long texts are counted whole, in
pieces that end at white space, where no token crosses.
"""

from __future__ import annotations

import heapq
import json
import os
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from annalist.llm import common
from annalist.llm.tokens import LETTERS

# Bytes of a pre-token above which it is merged alone.
LONG = 1_000

# Characters of a text that are split at once.
PIECE = 1_000_000

# No pair, or none that may be joined.
NONE = np.iinfo(np.int32).max

_known: dict[str, "Counter"] = {}
common.KEPT["token_counts"] = _known.clear


class Merges:
    """The merge list of a byte-level vocabulary, as arrays: a hash table of pairs with their ranks."""

    SLOTS = 20  # bits; the table stays under a tenth full for the vocabularies it is meant for
    FACTOR = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, model: dict):
        odd = {k for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges") if model.get(k)}
        if model["type"] != "BPE" or odd:
            raise ValueError(f"not a plain byte-pair vocabulary: {model['type']} {sorted(odd)}")
        vocab, end = model["vocab"], model.get("end_of_word_suffix") or ""
        self.inner = np.array([vocab[x] for x in LETTERS], np.int32)
        self.final = np.array([vocab[x + end] for x in LETTERS], np.int32)
        self.width = max(vocab.values()) + 1
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        made = {*LETTERS, *(x + end for x in LETTERS)}
        for a, b in pairs:
            # Letters are there from the start; all else must come from an earlier merge, once.
            if a + b in made or a not in made or b not in made:
                raise ValueError("the merges are not in the order of their making")
            made.add(a + b)
        self.joined = np.array([vocab[a + b] for a, b in pairs], np.int32)
        if len(pairs) << 3 > 1 << self.SLOTS:
            self.SLOTS = (len(pairs) << 3).bit_length()
        self.keys = np.full(1 << self.SLOTS, -1, np.int64)
        self.ranks = np.full(1 << self.SLOTS, NONE, np.int32)
        todo = np.array([vocab[a] * self.width + vocab[b] for a, b in pairs], np.int64)
        rank = np.arange(len(pairs), dtype=np.int32)
        slot = self._slot(todo)
        while len(todo):
            free = self.keys[slot] < 0
            _, first = np.unique(np.where(free, slot, -1), return_index=True)
            placed = np.zeros(len(todo), bool)
            placed[first] = True
            placed &= free
            self.keys[slot[placed]], self.ranks[slot[placed]] = todo[placed], rank[placed]
            todo, rank, slot = todo[~placed], rank[~placed], (slot[~placed] + 1) & (len(self.keys) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * self.FACTOR) >> np.uint64(64 - self.SLOTS)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of symbols, ``NONE`` where it is no merge."""
        keys = left.astype(np.int64) * self.width + right
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.ranks[slot], NONE)
        open_ = np.flatnonzero((found != keys) & (found >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & (len(self.keys) - 1)
            found = self.keys[slot[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.ranks[slot[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out

    def symbols(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The letters of all words end to end, and the length of each word."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer(b"".join(words), np.uint8)
        out = self.inner[flat]
        last = np.cumsum(lengths) - 1
        out[last] = self.final[flat[last]]
        return out, lengths

    def survivors(self, words: list[bytes]) -> np.ndarray:
        """How many symbols are left of each word, none of which may be empty."""
        symbols, lengths = self.symbols(words)
        left = lengths.copy()
        starts = np.cumsum(lengths) - lengths
        for i in np.flatnonzero(lengths > LONG):
            left[i] = self._alone(symbols[starts[i] : starts[i] + lengths[i]])
        name = np.flatnonzero((lengths <= LONG) & (lengths > 1))
        owner = np.repeat(np.arange(len(words)), lengths)
        inside = np.zeros(len(words), bool)
        inside[name] = True
        symbols, owner = symbols[inside[owner]], owner[inside[owner]]
        if not len(symbols):
            return left
        rank = np.full(len(symbols), NONE, np.int32)
        same = np.flatnonzero(owner[1:] == owner[:-1])
        rank[same] = self.rank(symbols[same], symbols[same + 1])
        while True:
            heads = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            sizes = np.diff(np.r_[heads, len(owner)])
            left[owner[heads]] = sizes
            lowest = np.minimum.reduceat(rank, heads)
            going = lowest < NONE
            if not going.any():
                return left
            if not going.all():
                stay = np.repeat(going, sizes)
                symbols, owner, rank = symbols[stay], owner[stay], rank[stay]
                lowest, sizes = lowest[going], sizes[going]
            at = np.flatnonzero(rank == np.repeat(lowest, sizes))
            at = at[_alternate(at, at[1:] == at[:-1] + 1)]
            symbols[at] = self.joined[rank[at]]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            symbols, owner, rank = symbols[keep], owner[keep], rank[keep]
            at -= np.arange(len(at))
            for spot in (at, at[at > 0] - 1):
                inner = spot[spot + 1 < len(owner)]
                fits = owner[inner] == owner[inner + 1]
                rank[spot] = NONE
                rank[inner[fits]] = self.rank(symbols[inner[fits]], symbols[inner[fits] + 1])

    def _alone(self, symbols: np.ndarray) -> int:
        """Survivors of one long sequence: its places are queued by rank, rounds go up the ranks."""
        symbols, n = symbols.copy(), len(symbols)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        rank = np.full(n, NONE, np.int32)
        rank[:-1] = self.rank(symbols[:-1], symbols[1:])
        queue: dict[int, list[np.ndarray]] = {}
        ranks: list[int] = []

        def add(places: np.ndarray) -> None:
            places = places[rank[places] < NONE]
            places = places[np.argsort(rank[places], kind="stable")]
            if not len(places):
                return
            cuts = np.flatnonzero(np.diff(rank[places])) + 1
            for part in np.split(places, cuts):
                r = int(rank[part[0]])
                if r not in queue:
                    heapq.heappush(ranks, r)
                queue.setdefault(r, []).append(part)

        add(np.arange(n))
        left = n
        while ranks:
            r = heapq.heappop(ranks)
            at = np.unique(np.concatenate(queue.pop(r)))
            at = at[rank[at] == r]
            at = at[_alternate(at, after[at[:-1]] == at[1:])]
            gone = after[at]
            symbols[at] = self.joined[r]
            rank[gone] = NONE
            after[at] = after[gone]
            inner = after[at] < n
            before[after[at[inner]]] = at[inner]
            left -= len(at)
            changed = np.unique(np.concatenate([at, before[at][before[at] >= 0]]))
            rank[changed] = NONE
            inner = changed[after[changed] < n]
            rank[inner] = self.rank(symbols[inner], symbols[after[inner]])
            add(changed)
        return left


def _alternate(at: np.ndarray, touches: np.ndarray) -> np.ndarray:
    """Every second place of each run of overlapping places, from the left."""
    index = np.arange(len(at))
    opens = np.r_[True, ~touches][: len(at)]
    return (index - np.maximum.accumulate(np.where(opens, index, 0))) % 2 == 0


class Counter:
    """Counts by one tokenizer file; keeps the counts of the pre-tokens that it has met."""

    # Pre-tokens remembered by a worker: a matter of speed and memory only.
    MOST_WORDS = 400_000

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        steps = spec["normalizer"]["normalizers"], spec["pre_tokenizer"]["pretokenizers"]
        if [x["type"] for x in steps[0] + steps[1]] != ["NFC", "Replace", "Lowercase", "Split", "ByteLevel"]:
            raise ValueError("the steps before the merges are not those of a word vocabulary")
        specials = spec["added_tokens"]
        if any(x["normalized"] or x["single_word"] or x["lstrip"] or x["rstrip"] for x in specials):
            raise ValueError("special strings that are matched in another way than letter by letter")
        self.specials = regex.compile("|".join(regex.escape(x["content"]) for x in specials)) if specials else None
        self.pattern = regex.compile(steps[1][0]["pattern"]["Regex"])
        self.merges = Merges(spec["model"])
        self.tokenizer = Tokenizer.from_file(path)
        self.counts: dict[str, int] = {}
        self.assigned: dict[str, bool] = {}

    @classmethod
    def of(cls, path: str) -> "Counter":
        if path not in _known:
            _known[path] = cls(path)
        return _known[path]

    def words(self, text: str) -> list[str]:
        """The pre-tokens of a text without special strings."""
        if not text.isascii():
            # Characters that are younger than this Python's tables may be letters for one
            # library and none for the other; such texts are split by the tokenizer's own steps.
            for c in set(text).difference(self.assigned):
                self.assigned[c] = unicodedata.category(c) != "Cn"
            if not all(map(self.assigned.__getitem__, set(text))):
                own = self.tokenizer
                pairs = own.pre_tokenizer.pre_tokenize_str(own.normalizer.normalize_str(text))
                bytes_of = {x: b for b, x in enumerate(LETTERS)}
                return [bytes(map(bytes_of.__getitem__, x)).decode() for x, _ in pairs]
            # The tokenizer lowers letter by letter, without the form at the end of a word.
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return self.pattern.findall(text.lower())

    def split(self, text: str) -> tuple[list[str], int]:
        """The pre-tokens of a text and the number of its special strings."""
        if self.specials is None or not (special := len(self.specials.findall(text))):
            return self.words(text), 0
        return [w for part in self.specials.split(text) for w in self.words(part)], special

    def learn(self, words: set[str]) -> None:
        fresh = [w for w in words if w not in self.counts]
        if fresh:
            left = self.merges.survivors([w.encode() for w in fresh])
            self.counts.update(zip(fresh, left.tolist()))

    def count(self, texts: list[str]) -> list[int]:
        """The number of tokens of each text."""
        if len(self.counts) > self.MOST_WORDS:
            self.counts.clear()
        out, parts = [0] * len(texts), []
        for row, text in enumerate(texts):
            for piece in pieces(text):
                words, out_special = self.split(piece)
                out[row] += out_special
                parts.append((row, words))
            # Long texts are counted as they are split, short ones together.
            if len(text) > PIECE:
                self._add(out, parts)
                parts = []
        self._add(out, parts)
        return out

    def _add(self, out: list[int], parts: list[tuple[int, list[str]]]) -> None:
        self.learn(set().union(*(words for _, words in parts)))
        for row, words in parts:
            out[row] += sum(map(self.counts.__getitem__, words))


def pieces(text: str) -> Iterator[str]:
    """A text in pieces of about ``PIECE`` characters that end before white space."""
    start = 0
    while len(text) - start > PIECE:
        cut = regex.compile(r"[ \t\n]").search(text, start + PIECE)
        if not cut:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:] if start else text


def count(docs: DataFrame, tokenizer: str, limit: int = 2048, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's key, ``n_bytes``, ``n_tokens`` and whether it is ``over_limit``. No shuffle."""
    common.ship(docs.sparkSession)
    source = common.text_column(docs, key, text).withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter.of(tokenizer)
        for batch in common.slices(batches, keep="token_counts"):
            texts = [t.decode(errors="replace") for t in common.raw_texts(batch)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array(counter.count(texts), pa.int64())],
                ["doc_id", "n_bytes", "n_tokens"],
            )

    counted = source.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
