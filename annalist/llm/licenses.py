"""License notices in documents, by conditional compression.

The words around each cue are the candidate blocks, one of each size that templates have, whatever
lines and sentences they stand in. Each block is compressed alone and with every template of its
size as a raw zstandard dictionary, and the templates are ranked by the bytes they save. From the
first on, each one that saves a share of its own compressed size is confirmed by the exact
differences in wording, punctuation at the edges of words aside. A confirmed winner takes its words:
a template that ranks behind it cannot claim them for another license, so the longer of two wordings
that contain each other wins, while a second license in the same block is found in its own words.
Words that tell licenses or versions apart may not differ. A notice that is negated is none.

The wordings, some fifty licenses with their titles, notices and conditions, are in
``license_texts``. Every template holds a cue, so no notice is passed over. The block of a row is
the notice's sentence, or else the lines it stands on.

Defined cases: null text is empty; a text without a cue gives no rows; a notice that a text
repeats gives one row with its number of occurrences; of equal savings the first license by name
wins, of equally different places the first; equal rows each give theirs; an empty table gives no
rows; other columns are left out; very long texts are read whole, paragraph by paragraph.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from annalist.llm import common, license_texts

TEMPLATES = license_texts.templates()
CUE = re.compile(
    rb"licen[sc]e|permission (?:is hereby granted|to use|is granted)|redistribution and use|creative commons"
    rb"|\bcc[ -]by|\bcc0\b|public domain|mozilla public|\b(?:a|l)?gpl|\bcddl\b",
    re.IGNORECASE,
)
CUE_TEXT = re.compile(CUE.pattern.decode(), re.IGNORECASE)
PARAGRAPH_END = re.compile(r"\n\s*\n")
SENTENCE_END = re.compile(r"(?<=[.!?:])\s+(?=[A-Z(])")
#: Share of its own compressed size that a template must save to be compared in wording.
LEAST_SAVED = 0.3
#: Share of a template's words that may differ; words with digits or names of licenses never may.
MOST_DIFFERENT = 0.1
EDGES = ".,;:?!()[]{}\"'`«»“”’‘…*_|<>/\\"
SPELT = {"licence": "license", "licences": "licenses", "licenced": "licensed"}
# Verbs that say the same before "under".
VERBS = frozenset("released distributed available published provided offered".split())
#: Words that turn a notice into its opposite, up to ``NEAR`` words before it.
NOT = frozenset("not never longer isn't aren't wasn't weren't nor neither cannot".split())
NEAR = 3
# Words that tell licenses apart: all of their titles but those that say nothing alone.
COMMON = frozenset(
    "license licensed under the of a an and or to in version v public software general terms free project you want what do"
    " source code form open data new university".split()
)
# A level that stores letters as they are, so that a size tells the matches alone.
LEVEL = -1
SIZES = (16, 32, 64, 128, 256, 512)


def wording(text: str) -> list[str]:
    """Lower-case words without the punctuation at their edges; signs alone are none."""
    words = (x.strip(EDGES) for x in text.lower().split())
    kept = (w for w in words if w and any(map(str.isalnum, w)))
    return [SPELT.get(w, w).replace("noderivs", "noderivatives") for w in kept]


def canonical(text: str) -> list[str]:
    """``wording`` with one verb for all that say "under this license"."""
    words = wording(text)
    for at in range(len(words) - 1):
        if words[at] in VERBS and words[at + 1] == "under":
            words[at] = "licensed"
    return words


def _names() -> frozenset[str]:
    titles = [t for texts in license_texts.TITLES.values() for t in texts]
    titles += [f"cc {kind} {words}" for kind, words in license_texts.CC_KINDS.items()] + ["creative commons library lesser"]
    parts = {p for t in titles for w in wording(t) for p in re.split("[-/]", w)}
    return frozenset(parts - COMMON)


NAMES = _names()


def telling(word: str) -> bool:
    """Whether a word tells licenses or their versions apart."""
    return any(c.isdigit() for c in word) or not NAMES.isdisjoint(re.split("[-/]", word))


def possible(block: list[str], template: list[str]) -> bool:
    """Whether the words that a block lacks leave a chance that it holds the template."""
    lacking = Counter(template) - Counter(block)
    return lacking.total() <= MOST_DIFFERENT * len(template) and not any(map(telling, lacking))


def differences(block: list[str], template: list[str]) -> tuple[int, int, int] | None:
    """The least number of words of the template that the block lacks, replaces or puts between, and from
    and to which word of the block; nothing if telling words would have to differ or too many do.

    Words before and after the notice do not count.
    """
    if not possible(block, template):
        return None
    most = int(MOST_DIFFERENT * len(template))
    never = most + 1
    cost = [never if telling(w) else 1 for w in block]
    # Least cost of the template's beginning that ends at each word of the block, and where it starts.
    row, start = [0] * (len(block) + 1), list(range(len(block) + 1))
    for word in template:
        own = never if telling(word) else 1
        new, begin = [row[0] + own], [0]
        for j, other in enumerate(block):
            ways = (
                (row[j] + (0 if word == other else max(own, cost[j])), -start[j]),
                (row[j + 1] + own, -start[j + 1]),
                (new[j] + cost[j], -begin[j]),
            )
            least, at = min(ways)
            new.append(least)
            begin.append(-at)
        row, start = new, begin
    count, end = min((n, j) for j, n in enumerate(row))
    return (count, start[end], end) if count <= most else None


class Scanner:
    """Compressors with each template as their dictionary, by the size of their blocks."""

    def __init__(self, templates: dict[str, list[str]] = TEMPLATES):
        import zstandard

        self.alone = zstandard.ZstdCompressor(level=LEVEL)
        self.given: dict[int, list[tuple[str, list[str], object, int]]] = {}
        for name, texts in sorted(templates.items()):
            for text in texts:
                if not CUE.search(text.encode()):
                    raise ValueError(f"no cue in a template of {name}: {text}")
                words = canonical(text)
                data = " ".join(words).encode()
                own = len(self.alone.compress(data))
                given = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                given.precompute_compress(level=LEVEL)
                reach = len(words) + int(MOST_DIFFERENT * len(words)) + 1
                size = next(s for s in (*SIZES, reach) if s >= reach)
                self.given.setdefault(size, []).append((name, words, zstandard.ZstdCompressor(level=LEVEL, dict_data=given), own))

    def ranked(self, words: list[str], cue: int) -> list[tuple[int, float, int, str, list[str]]]:
        """The templates that save enough around a cue, the most bytes first.

        Bytes, their share of the template's own compressed size, where the block begins, and the
        license and words of the template.
        """
        found = []
        for size, templates in self.given.items():
            begin = max(cue - size, 0)
            block = words[begin : cue + size]
            data = " ".join(block).encode()
            alone = len(self.alone.compress(data))
            for name, template, given, own in templates:
                saved = alone - len(given.compress(data))
                if saved >= LEAST_SAVED * own:
                    found.append((saved, saved / own, begin, name, template))
        return sorted(found, key=lambda x: (-x[0], x[3], -len(x[4])))

    def scan(self, text: str) -> dict[str, tuple[float, int, int, str]]:
        """Per license the share saved, words that differ, occurrences of the block, and the block."""
        best: dict[str, tuple[float, int, int, str]] = {}
        breaks = [(0, 0), *(m.span() for m in PARAGRAPH_END.finditer(text)), (len(text), 0)]
        for (_, offset), (stop, _) in zip(breaks, breaks[1:]):
            paragraph = text[offset:stop]
            if not CUE_TEXT.search(paragraph):
                continue
            words, places = [], []
            for found in re.finditer(r"\S+", paragraph):
                for word in wording(found[0]):
                    words.append(word)
                    places.append((offset + found.start(), offset + found.end()))
            words = canonical(" ".join(words))
            for saved, share, count, name, a, b in self.confirmed(words, self.cues(paragraph, offset, places)):
                block = around(text, places[a][0], places[b - 1][1])
                old = best.get(name)
                if old is None or (share, -count, -len(block)) > (old[0], -old[1], -len(old[3])):
                    best[name] = (share, count, text.count(block), block)
        return best

    def confirmed(self, words: list[str], cues: list[int]) -> list[tuple[int, float, int, str, int, int]]:
        """The winners of a paragraph's cues: bytes and share saved, words that differ, license, from and to."""
        checked: dict[tuple, tuple | None] = {}
        claims = []
        for cue in cues:
            for saved, share, begin, name, template in self.ranked(words, cue):
                reach = len(template) + int(MOST_DIFFERENT * len(template)) + 1
                first = max(cue - reach, 0)
                key = (id(template), first, cue + reach)
                if key not in checked:
                    checked[key] = differences(words[first : cue + reach], template)
                if (steps := checked[key]) is not None:
                    count, a, b = steps
                    if NOT.isdisjoint(words[max(first + a - NEAR, 0) : first + a]):
                        claims.append((saved, share, count, name, first + a, first + b))
        won: list[tuple[int, float, int, str, int, int]] = []
        for claim in sorted(claims, key=lambda x: (-x[0], x[3])):
            a, b = claim[4:]
            if all(other[3] == claim[3] or min(b, other[5]) <= max(a, other[4]) for other in won):
                won.append(claim)
        return won

    @staticmethod
    def cues(paragraph: str, offset: int, places: list[tuple[int, int]]) -> list[int]:
        """The words at which cues of a paragraph begin."""
        starts = [a for a, _ in places]
        return sorted({max(bisect_right(starts, offset + m.start()) - 1, 0) for m in CUE_TEXT.finditer(paragraph)})


def around(text: str, start: int, end: int) -> str:
    """The sentence of a notice, or else the lines it stands on."""
    first, last = text.rfind("\n", 0, start) + 1, text.find("\n", end)
    block = text[first : last if last >= 0 else len(text)]
    at = first
    for sentence in SENTENCE_END.split(block):
        at = text.index(sentence, at)
        if at <= start and end <= at + len(sentence):
            return sentence
        at += len(sentence)
    return block


def scan(docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES) -> DataFrame:
    """``doc_id, license, saved, different_words, occurrences, block`` for each license in each row."""
    common.ship(docs.sparkSession)
    source = common.text_column(docs)
    key = source.schema["doc_id"].dataType.simpleString()
    names = ["license", "saved", "different_words", "occurrences", "block"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        kinds = (pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.string())
        for batch in common.slices(batches):
            rows, found = [], []
            for row, data in enumerate(common.raw_texts(batch)):
                if CUE.search(data):
                    for name, values in sorted(scanner.scan(data.decode(errors="replace")).items()):
                        rows.append(row)
                        found.append((name, *values))
            columns = list(zip(*found)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(rows, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                ["doc_id", *names],
            )

    return source.mapInArrow(run, f"doc_id {key}, license string, saved double, different_words int, occurrences int, block string")
