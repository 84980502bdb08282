"""Comment spans against a reader that goes character by character."""

import random

import pytest

from annalist.operators import linecount, syntax

LINE = {name: prefixes for _, name, prefixes, prose in linecount.LANGUAGES if not prose}


def kinds(language, text):
    """Code, comment and blank lines of a text, read character by character."""
    blocks, strings = syntax.BLOCKS_AND_STRINGS.get(language, ((), ()))
    pairs = [(*b.lstrip("+").split(" "), b.startswith("+")) for b in blocks]
    openers = {p[0] for p in pairs}
    line_marks = [x for x in LINE[language] if x not in openers]
    marks = [(o, "block", c, n) for o, c, n in pairs] + [(x, "line", "\n", False) for x in line_marks]
    marks += [(x.lstrip("+!"), "string", x, False) for x in strings if x.lstrip("+!") != "'.'"]
    marks.sort(key=lambda m: -len(m[0]))
    state, depth, i, lines, now = None, 0, 0, [], set()
    text = text if text.endswith("\n") else text + "\n"
    while i < len(text):
        step, kind = 1, "code"
        if state is None:
            for mark, name, end, nests in marks:
                free = i == 0 or text[i - 1].isspace() or mark not in syntax._WORDS
                if text.startswith(mark, i) and (name != "line" or free):
                    state, depth, step = (mark, name, end, nests), 1, len(mark)
                    kind = "code" if name == "string" else "comment"
                    break
        else:
            mark, name, end, nests = state
            kind = "code" if name == "string" else "comment"
            if name == "line":
                if text[i] == "\n":
                    state = None
            elif name == "string":
                if text[i] == "\\" and "!" not in end[:2]:
                    step = 2
                elif text.startswith(mark, i):
                    state, step = None, len(mark)
                elif text[i] == "\n" and not end.startswith("+"):
                    state = None
            elif text.startswith(end, i):
                depth, step = depth - 1, len(end)
                state = state if depth else None
            elif nests and text.startswith(mark, i):
                depth, step = depth + 1, len(mark)
        for c in text[i : i + step]:
            if c == "\n":
                lines.append("code" if "code" in now else "comment" if now else "blank")
                now = set()
            elif c not in " \t\r\f\v":
                now.add(kind)
        i += step
    return tuple(lines.count(k) for k in ("code", "comment", "blank"))


LANGUAGES = ["javascript", "css", "rust", "sql", "python", "html", "haskell", "ocaml", "pascal", "julia",
             "coffeescript", "lua", "powershell", "nix", "clojure", "shell", "go", "cmake", "php"]


@pytest.mark.parametrize("language", LANGUAGES)
def test_lines_of_random_texts(language):
    rng = random.Random(language)
    blocks, strings = syntax.BLOCKS_AND_STRINGS.get(language, ((), ()))
    bits = [" ", "\n", "\n", "a", "x y", "\\", "\t", "//", "#", "*", "-"] + list(LINE[language])
    bits += [m for b in blocks for m in b.lstrip("+").split(" ")] * 2 + [x.lstrip("+!") for x in strings if x != "'.'"]
    if language in ("rust", "go"):
        bits = [b for b in bits if b != "'"]
    texts = ["".join(rng.choices(bits, k=rng.randrange(1, 60))) for _ in range(1500)]
    own = syntax.of(language, tuple(LINE[language]), False)
    lines, comments, blanks = syntax.count([t.encode() for t in texts], [own] * len(texts))
    for text, got in zip(texts, zip(lines - comments - blanks, comments, blanks)):
        assert tuple(map(int, got)) == kinds(language, text), text


CASES = [
    ("rust", "fn f<'a>(x: &'a str) {} /* c\n*/\n'\"' /* d */\n/* e */", (2, 2, 0)),
    ("c", "char c = '\"'; /* open\n x */\nchar d = '\\'';\n/* y */", (2, 2, 0)),
    ("java", 'String s = """\n// text /*\n""";\n/* c */ // d\n', (3, 1, 0)),
    ("go", "s := `a\n// raw\n`\n// c", (3, 1, 0)),
    ("c", "/*\n\n\t\n*/\n\n", (0, 2, 3)),
    ("vim script", '" c\nlet s = "x"\n', (1, 1, 0)),
    ("json", '{"a": "// no"}\n\n', (1, 0, 1)),
    ("javascript", "a /* b */ c // d\n/* e */ /* f */\n/*/ g\n*/", (1, 3, 0)),
]


@pytest.mark.parametrize("language, text, want", CASES)
def test_lines_of_cases(language, text, want):
    line = tuple(next(p for _, n, p, _ in linecount.LANGUAGES if n == language))
    n, comments, blanks = (int(x[0]) for x in syntax.count([text.encode()], [syntax.of(language, line, False)]))
    assert (n - comments - blanks, comments, blanks) == want


def test_every_language_can_be_read():
    for _, name, prefixes, prose in linecount.LANGUAGES:
        own = syntax.of(name, tuple(prefixes), prose)
        assert [int(x[0]) for x in syntax.count([b"a\n \n" * 3], [own])] == [6, 3 if prose else 0, 3]
    assert set(syntax.BLOCKS_AND_STRINGS) - {n for _, n, _, _ in linecount.LANGUAGES} <= {"gradle", "svg"}


def test_a_long_file_is_read_once_through():
    text = b'x = "' + b"\\n" * 200_000 + b'"; /* ' + b"a /* " * 100_000 + b"*/\n"
    assert [int(x[0]) for x in syntax.count([text], [syntax.of("c", ("//",), False)])] == [1, 0, 0]
