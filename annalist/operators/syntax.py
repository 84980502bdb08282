"""Comments in source text: line, block and nested block comments, and what strings hide.

A file is read marker by marker: the earliest of a language's markers decides what comes next, up
to the end of that comment or string. Strings end with their line unless their kind may go on;
what is open at the end of the file is open to its end. A line is a comment if it has text in
comments and none outside, blank if it has no text at all, inside comments too, and code else.

Numpy classifies the lines of a batch of files at once from the spans of their comments; only the
markers are looked at one by one, by a compiled pattern of each language.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import lru_cache

import numpy as np

# The block comments and strings of the languages, by lower-case name. A block is
# its opening and closing marker, with ``+`` in front where blocks nest. A string is its marker,
# with ``+`` in front where it may go on over lines and ``!`` where a backslash escapes nothing.
# ``'.'`` stands for literals of one character.
_C_BLOCK = ("/* */",)
_NESTED_C = ("+/* */",)
_CHARS = ('"', "'.'")
_TEXTS = ('"', "'")
_LONG = ('+"""', *_CHARS)
_FORMS = (
    ("c c++ c++_header c_header cuda objective-c objective-c++ verilog", _C_BLOCK, _CHARS),
    ("c# java", _C_BLOCK, _LONG),
    ("go", _C_BLOCK, ("+!`", *_CHARS)),
    ("javascript jsx typescript tsx", _C_BLOCK, ("+`", *_TEXTS)),
    ("groovy gradle", _C_BLOCK, ('+"""', "+'''", *_TEXTS)),
    ("less sass css protocol_buffers solidity json_with_comments", _C_BLOCK, _TEXTS),
    ("rust", _NESTED_C, ('+"', "'.'")),
    ("kotlin scala swift", _NESTED_C, _LONG),
    ("dart", _NESTED_C, ('+"""', "+'''", *_TEXTS)),
    ("php", _C_BLOCK, _TEXTS),
    ("terraform", _C_BLOCK, ('"',)),
    ("nix", _C_BLOCK, ("+!''", '+"')),
    ("sql", _C_BLOCK, ("!'",)),
    ("python", (), ('+"""', "+'''", *_TEXTS)),
    ("toml elixir graphql", (), ('+"""', "+'''", *_TEXTS)),
    ("julia", ("+#= =#",), ('+"""', '"')),
    ("nim", ("+#[ ]#",), ('+"""', '"')),
    ("ruby", ("=begin =end",), _TEXTS),
    ("powershell", ("<# #>",), _TEXTS),
    ("coffeescript", ("### ###",), _TEXTS),
    ("cmake", ("#[[ ]]",), ('"',)),
    ("html xml svg vue svelte", ("<!-- -->",), ()),
    ("lua", ("--[[ ]]",), _TEXTS),
    ("haskell elm", ("+{- -}",), ('"',)),
    ("emacs_lisp lisp scheme", ("+#| |#",), ('+"',)),
    ("clojure clojurescript erlang", (), ('+"',)),
    ("ocaml f#", ("+(* *)",), ('+"',)),
    ("pascal", ("{ }", "(* *)"), ("!'",)),
)
BLOCKS_AND_STRINGS = {
    name.replace("_", " "): (blocks, strings) for names, blocks, strings in _FORMS for name in names.split()
}
# Line markers that begin a comment in the middle of a line only after white space.
_WORDS = ("#", "%", ";", "!", "rem ", '"', "::")

WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True


class Syntax:
    """How comments and strings look in one language."""

    def __init__(self, line: Sequence[str], blocks: Sequence[str], strings: Sequence[str], prose: bool = False):
        self.prose = prose
        openers: dict[bytes, tuple] = {}
        for text in strings:
            goes_on, raw, mark = text.startswith("+"), "!" in text[:2], text.lstrip("+!").encode()
            if mark == b"'.'":
                continue
            end = re.escape(mark) + (b"" if goes_on else b"|\n")
            openers[mark] = ("string", re.compile(end if raw else rb"\\[\s\S]|" + end), mark)
        for text in blocks:
            start, end = text.lstrip("+").encode().split(b" ")
            both = re.compile(re.escape(start) + b"|" + re.escape(end)) if text.startswith("+") else None
            openers[start] = ("block", both, end)
        # What may hide the beginnings of lines; a file without any needs no further look.
        self.deep = [m for m, (kind, *_) in openers.items() if kind == "block"]
        self.deep += [x.lstrip("+!").encode() for x in strings if x.startswith("+")]
        if any(x[0] not in "+!" and x != "'.'" for x in strings):
            self.deep.append(b"\\\n")
        starts = [x.encode() for x in line if x.encode() not in openers]
        self.heads = re.compile(rb"^[ \t\r\f\v]*(?:" + b"|".join(map(re.escape, starts)) + rb")[^\n]*", re.M) if starts else None
        openers.update({mark: ("line", None, None) for mark in starts})
        # The longest marker first, so that a block is not taken for a line comment.
        parts = [rb"'(?:\\[^\n]|[^'\\\n])[^'\n]{0,8}?'"] if "'.'" in strings else []
        for mark in sorted(openers, key=len, reverse=True):
            word = openers[mark][0] == "line" and mark.decode() in _WORDS
            parts.append((rb"(?<![^ \t\r\f\v\n])" if word else b"") + re.escape(mark))
        self.marks = re.compile(b"|".join(parts)) if parts else None
        self.openers = openers

    def comments(self, text: bytes) -> list[tuple[int, int]]:
        """The spans of all comments that matter for the kinds of lines."""
        if not any(mark in text for mark in self.deep):
            return [m.span() for m in self.heads.finditer(text)] if self.heads else []
        spans, at, size = [], 0, len(text)
        while found := self.marks.search(text, at):
            kind, pattern, end = self.openers.get(found[0], ("character", None, None))
            at = found.end()
            if kind == "string":
                while found := pattern.search(text, at):
                    at = found.end()
                    if found[0][:1] != b"\\":
                        break
                else:
                    at = size
            elif kind == "line":
                stop = text.find(b"\n", at)
                at = size if stop < 0 else stop
                spans.append((found.start(), at))
            elif kind == "block":
                start, depth = found.start(), 1
                while depth:
                    if pattern is None:
                        stop = text.find(end, at)
                        at, depth = (size if stop < 0 else stop + len(end)), 0
                    elif found := pattern.search(text, at):
                        at = found.end()
                        depth += -1 if found[0] == end else 1
                    else:
                        at, depth = size, 0
                spans.append((start, at))
        return spans


@lru_cache(maxsize=512)
def of(language: str, line: tuple[str, ...], prose: bool) -> Syntax:
    """The syntax of a language with its line markers; unknown ones have no blocks."""
    blocks, strings = BLOCKS_AND_STRINGS.get(language, ((), ()))
    return Syntax(line, blocks, strings, prose)


def count(texts: Sequence[bytes], syntaxes: Sequence[Syntax]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lines in all, comment lines and blank lines of each text; none may be empty."""
    starts, stops, sizes, base = [], [], [], 0
    whole = []
    for text, syntax in zip(texts, syntaxes):
        # The line break that ends a file starts no further line.
        text = text if text.endswith(b"\n") else text + b"\n"
        for start, stop in [(0, len(text))] if syntax.prose else syntax.comments(text):
            starts.append(base + start)
            stops.append(base + stop)
        whole.append(text)
        sizes.append(len(text))
        base += len(text)
    data = np.frombuffer(b"".join(whole), np.uint8)
    edge = np.zeros(base + 1, np.int8)
    edge[starts] += 1
    edge[stops] -= 1
    inside = np.cumsum(edge[:-1], dtype=np.int8) > 0
    text = ~WHITE[data]
    ends = np.flatnonzero(data == 10)
    lines = np.r_[0, ends[:-1] + 1]
    has_text = np.logical_or.reduceat(text, lines)
    has_code = np.logical_or.reduceat(text & ~inside, lines)
    heads = np.searchsorted(ends, np.cumsum([0, *sizes[:-1]]))
    number = np.diff(np.r_[heads, len(ends)])
    comments = np.add.reduceat((has_text & ~has_code).astype(np.int64), heads)
    blanks = np.add.reduceat((~has_text).astype(np.int64), heads)
    return number, comments, blanks
