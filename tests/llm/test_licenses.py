"""License notices with other punctuation, beside each other, embedded and wrapped."""

import random
import textwrap

import pytest

from annalist.llm import license_texts, licenses

WORDED = [
    ("Released under the MIT License", {"MIT"}),
    ("Released under the MIT License, see below", {"MIT"}),
    ("This work is licensed under the GNU General Public License, version 3", {"GPL-3.0"}),
    ("(Licensed under CC BY 4.0)", {"CC-BY-4.0"}),
    ("Licensed under the MIT License and released under the CC0 1.0 Universal license.", {"MIT", "CC0-1.0"}),
    ("This work is licensed under the GNU Lesser General Public License, version 2.", set()),
    ("This work is licensed under the GNU Lesser General Public License, version 3.", {"LGPL-3.0"}),
    ("Licensed under CC BY-SA 4.0", {"CC-BY-SA-4.0"}),
]


@pytest.mark.parametrize("text, want", WORDED)
def test_wording(text, want):
    assert set(licenses.Scanner().scan(text)) == want


GPL = [t for t in licenses.TEMPLATES["GPL-3.0"] if t.startswith("This program")][0]

EMBEDDED = [
    ("Home | About | Contact | Imprint | Privacy | Terms | Newsletter | Jobs | Press | Released under the MIT License.", "MIT"),
    ("All of the figures and the tables of this page, unless stated otherwise, are licensed under CC BY 4.0.", "CC-BY-4.0"),
    ("Some first words of a paragraph that goes on for a while and is released\nunder the MIT\nLicense. More words follow here,\nand more.", "MIT"),
    ("\n".join(" ".join(GPL.split()[i : i + 4]) for i in range(0, len(GPL.split()), 4)), "GPL-3.0"),
    ("word " * 300 + "licensed under the Apache License, Version 2.0, " + "other " * 300, "Apache-2.0"),
]


@pytest.mark.parametrize("text, want", EMBEDDED)
def test_embedded_and_wrapped(text, want):
    found = licenses.Scanner().scan(text)
    assert set(found) == {want} and found[want][2] == 1 and found[want][3] in text


def test_templates_with_all_differences_allowed_save_enough():
    scanner = licenses.Scanner()
    for name, texts in licenses.TEMPLATES.items():
        for text in texts:
            words, left = text.split(), int(licenses.MOST_DIFFERENT * len(text.split()))
            plain = [i for i, w in enumerate(words) if i > 3 and not licenses.CUE.search(w.encode()) and not licenses.telling(w.strip('.,()"').lower())]
            for i in plain[:: max(len(plain) // left, 1)][:left] if left else []:
                words[i] = "other"
            assert name in scanner.scan("Before it. " + " ".join(words) + " After it.")


@pytest.fixture(scope="module")
def scanner():
    return licenses.Scanner()


NAMED = [(name, text) for name, texts in licenses.TEMPLATES.items() for text in texts]


def test_some_fifty_licenses():
    assert len(licenses.TEMPLATES) >= 50


@pytest.mark.parametrize("dress", ["plain", "wrapped", "commented", "upper"])
def test_every_wording_is_its_own_license(scanner, dress):
    """Each notice in running text, wrapped and commented, gives its license and no other."""
    for name, text in NAMED:
        body = {
            "plain": text,
            "wrapped": textwrap.fill(text, 44, break_on_hyphens=False),
            "commented": "\n".join("# " + x for x in textwrap.wrap(text, 60, break_on_hyphens=False)),
            "upper": text.upper(),
        }[dress]
        found = scanner.scan(f"Some words stand before it, then: {body} And other words follow after that.")
        assert set(found) == {name}, (text, found)


OTHER = [
    ("This code is not licensed under the MIT License.", set()),
    ("It was never released under the MIT License, but licensed under the ISC License.", {"ISC"}),
    ("It isn't under the terms of the Apache License 2.0", set()),
    ("It is no longer released under the MIT License.", set()),
    ("A text without an end\nReleased under the MIT License.", {"MIT"}),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", {"CC-BY-SA-4.0"}),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivs 3.0 Unported License.", {"CC-BY-NC-ND-3.0"}),
    ("Content is available under CC BY 4.0 unless noted.", {"CC-BY-4.0"}),
    ("Distributed under the Boost Software License, Version 1.0. (See the file)", {"BSL-1.0"}),
    ("This work is licensed under the GNU General Public License, version 2 only.", {"GPL-2.0"}),
    ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public"
     " License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.", {"LGPL-2.1"}),
    ("Licensed under the BSD 2-Clause License.\n" + license_texts.BODIES["BSD-2-Clause"][0], {"BSD-2-Clause"}),
    ("Licensed under the MIT License and under the terms of the Apache License 2.0.", {"MIT", "Apache-2.0"}),
    ("The license of my driver was renewed under the terms of the new law, version 2.", set()),
    ("Redistribution and use in source and binary forms is a matter of the conditions.", set()),
]


@pytest.mark.parametrize("text, want", OTHER)
def test_near_and_negated_wordings(scanner, text, want):
    assert set(scanner.scan(text)) == want


def test_the_own_template_ranks_first(scanner):
    """Of all templates of its block, the one that a notice repeats saves the most bytes."""
    for name, text in NAMED:
        words = licenses.canonical(f"Some words stand before it here. {text} And other words follow after that.")
        cues = [i for i, w in enumerate(words) if licenses.CUE_TEXT.search(w)] or [6]
        ranked = [scanner.ranked(words, cue) for cue in cues]
        first = {r[0][3] for r in ranked if r}
        assert name in first, (text, [r[:2] for r in ranked])


def test_differences_equal_all_alignments():
    """Against the plain edit distance of the template to every part of the block."""

    def distance(part, template):
        row = list(range(len(part) + 1))
        for i, a in enumerate(template):
            new = [i + 1]
            for j, b in enumerate(part):
                new.append(min(row[j] + (a != b), row[j + 1] + 1, new[-1] + 1))
            row = new
        return row[-1]

    rng = random.Random(7)
    stock = "any words that tell nothing of it here and there so they may well change".split()
    seen = 0
    for _ in range(300):
        template = rng.choices(stock, k=rng.randrange(10, 25))
        changed = list(template)
        for _ in range(rng.randrange(0, 4)):
            at = rng.randrange(len(changed))
            changed[at : at + rng.randrange(0, 2)] = rng.choices(stock, k=rng.randrange(0, 2))
        block = rng.choices(stock, k=4) + changed + rng.choices(stock, k=4)
        least = min(distance(block[a:b], template) for a in range(len(block)) for b in range(a, len(block) + 1))
        got = licenses.differences(block, template)
        assert (got and got[0]) == (least if least <= int(licenses.MOST_DIFFERENT * len(template)) else None)
        if got:
            seen += 1
            assert distance(block[got[1] : got[2]], template) == least
    assert seen > 50
