"""Token ids of whole texts by a public tokenizer, fast enough for corpora.

The tokenizer of words drops white space and never merges across it, so a text's ids are the
ids of its white-space separated words in order; it also always cuts between a plain letter and one
of some signs. So texts are cut at both, each distinct piece ("word" below) is encoded once and then
looked up, once for all the texts that a task has in hand.
The tokenizer's special strings are found first, in the raw text and in exactly their case, and
have their own ids; in any other case they are text.
"""

from __future__ import annotations

import os
import re
import unicodedata
from array import array
from itertools import filterfalse

import numpy as np
import pyarrow as pa

from annalist.llm import common

def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    letters = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [letters[b] for b in range(256)]


LETTERS = _byte_letters()

_known: dict[str, "WordIds"] = {}
common.KEPT["tokens"] = _known.clear

SPACE = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
# Between a letter and one of these signs the tokenizer's own pattern always cuts.
LETTER = np.isin(np.arange(256), list(b"abcdefghijklmnopqrstuvwxyz"))
SIGN = np.isin(np.arange(256), list(b".,;:!?*%$&#|"))


class WordIds:
    """Ids of words as little-endian unsigned 32-bit bytes, looked up or encoded on first sight."""

    # Words remembered by a worker: a matter of speed and memory only.
    MOST_WORDS = 400_000

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # Words are lowered when they come to the tokenizer, so none of them is a special string.
        self.tokenizer.encode_special_tokens = True
        added = self.tokenizer.get_added_tokens_decoder()
        if any(x.normalized or x.single_word or x.lstrip or x.rstrip for x in added.values()):
            raise ValueError("special strings that are matched in another way than letter by letter")
        self.special = {x.content.encode(): np.array([i], "<u4").tobytes() for i, x in added.items()}
        found = b"|".join(re.escape(x) for x in self.special)
        self.marks = re.compile(b"(" + found + b")") if found else None
        self.words: dict[bytes, bytes] = {}

    @classmethod
    def of(cls, path: str) -> "WordIds":
        """One instance per worker and file."""
        if path not in _known:
            _known[path] = cls(path)
        return _known[path]

    def learn(self, fresh: list[bytes]) -> None:
        tokenize, other = self.tokenizer.model.tokenize, []
        for core in fresh:
            # A word of lower-case letters alone is one run of the tokenizer's pattern and
            # already in its normal form, so its merges can be applied to it at once.
            if core.isalpha():
                self.words[core] = array("I", [x.id for x in tokenize(core.decode())]).tobytes()
                continue
            word = core.decode(errors="replace")
            if not word.isalpha() or word.lower() != word or not unicodedata.is_normalized("NFC", word):
                other.append((core, word))
                continue
            if not word.isascii():
                word = "".join([LETTERS[b] for b in core])
            self.words[core] = array("I", [x.id for x in tokenize(word)]).tobytes()
        coded = self.tokenizer.encode_batch_fast([w for _, w in other], add_special_tokens=False)
        for (core, _), code in zip(other, coded):
            self.words[core] = np.array(code.ids, "<u4").tobytes()

    def known(self, words: list[bytes]) -> dict[bytes, bytes]:
        """The table of ids, with all of these words in it."""
        fresh = list(filterfalse(self.words.__contains__, words))
        if len(self.words) + len(fresh) > self.MOST_WORDS:
            # The others make room; those of these texts are likely to come again.
            self.words = {w: self.words[w] for w in words if w in self.words}
        self.learn(fresh)
        return self.words

    def documents(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text. A-Z are lowered first, as the tokenizer does by itself."""
        marked = [row for row, text in enumerate(texts) if self.marks and self.marks.search(text)]
        if not marked:
            return self._plain(texts)
        pieces = [self.marks.split(texts[row]) for row in marked]
        # What stands between special strings is text; they themselves stand at the odd places.
        found = iter(self._plain([x for parts in pieces for x in parts[::2]]))
        out = dict(zip(marked, (b"".join([self.special[x] if n % 2 else next(found) for n, x in enumerate(p)]) for p in pieces)))
        rest = [row for row in range(len(texts)) if row not in out]
        out.update(zip(rest, self._plain([texts[row] for row in rest])))
        return [out[row] for row in range(len(texts))]

    def _plain(self, texts: list[bytes]) -> list[bytes]:
        """The same of texts without special strings. Each word of them all is looked up once."""
        letters = np.frombuffer(b" " + b" ".join(texts).lower() + b" ", np.uint8)
        inside = ~SPACE[letters]
        letter, sign = LETTER[letters], SIGN[letters]
        cut = letter[:-1] & sign[1:] | sign[:-1] & letter[1:]
        begins = np.flatnonzero(inside[1:] & (~inside[:-1] | cut)) + 1
        if not len(begins):
            return [b""] * len(texts)
        sizes = np.flatnonzero(inside[:-1] & (~inside[1:] | cut)) + 1 - begins
        ends = np.concatenate([[0], np.cumsum(sizes)])
        words = pa.Array.from_buffers(
            pa.large_binary(), len(begins), [None, *(pa.py_buffer(np.ascontiguousarray(x)) for x in (ends, letters[inside]))]
        ).dictionary_encode()
        distinct = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        codes = words.indices.to_numpy()
        ids = [*map(self.known(distinct).__getitem__, distinct)]
        counts = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        first = np.cumsum(counts) - counts
        # The ids of all words in turn: where each word's begin among the distinct words', and on from there.
        many = counts[codes]
        upto = np.cumsum(many)
        at = np.repeat(first[codes] - upto + many, many)
        at += np.arange(len(at))
        data = np.frombuffer(b"".join(ids), "<u4")[at].tobytes()
        # Words before the end of each text, then ids.
        stops = np.cumsum([len(t) + 1 for t in texts])
        cuts = np.concatenate([[0], upto])[np.searchsorted(begins, stops)] * 4
        return [data[x:y] for x, y in zip([0, *cuts.tolist()], cuts.tolist())]
