"""Doubled signs, signs at the edges and doubled letters are read by the lattice."""

import numpy as np
import pytest

from annalist.llm import toxicity

TERMS = ["idiot", "stupid", "asshole", "pussy", "ass"]


@pytest.fixture(scope="module")
def scorer():
    counts = np.zeros(toxicity.SIZE**3, np.int64)
    for w in (TERMS + "loser the there then that weather house hidden simple people table will see".split()) * 20:
        for at in toxicity.places(w):
            counts[at] += 1
    return toxicity.Scorer(toxicity.Model(counts, {w: 5.0 for w in TERMS}, 1.0, -3.0))


@pytest.mark.parametrize(
    "word", ["a$$hole", "pu$$y", "!diot", "4$$", "iddiot", "stuupid", "(stupid)", "stupid!", "!idiot!", "a$$", "@sshole", "$tupid", "1d!!ot", "stuppidd"]
)
def test_disguises_keep_their_term(scorer, word):
    assert scorer.weight(word) == 5.0


@pytest.mark.parametrize("word", ["hidden", "people!", "(house)", "455", "$455", "$1,000", "45!", "12:30", "100+", "(4)", "", "!!", "will", "see..."])
def test_plain_words_and_numbers_have_none(scorer, word):
    assert scorer.weight(word) == 0.0


def test_characters_of_unlabelled_rows_count(spark):
    docs = spark.createDataFrame([(1, "plain text"), (2, "zyzzyva"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    trigrams = toxicity.fit(docs, labels).trigrams
    want = np.zeros_like(trigrams)
    for word in ("plain", "text", "zyzzyva"):
        np.add.at(want, toxicity.places(word), 1)
    assert trigrams.tolist() == want.tolist()


def every_path(channel, word, drop):
    """All readings of a word with their costs under the character model."""
    paths = [("", 0.0)]
    for choices in channel.readings(word, drop):
        paths = [(text + c, cost + more) for text, cost in paths for c, more in choices]
    out = {}
    for text, cost in paths:
        codes = [toxicity.EDGE, toxicity.EDGE, *map(toxicity.code, text), toxicity.EDGE]
        for a, b, c in zip(codes, codes[1:], codes[2:]):
            cost -= channel.lm[(a * toxicity.SIZE + b) * toxicity.SIZE + c]
        out[text] = min(cost, out.get(text, cost))
    return out


@pytest.mark.parametrize("drop", [0.0, toxicity.DROP, toxicity.MOST_DROP])
def test_viterbi_finds_the_least_of_all_paths(scorer, drop):
    rng = np.random.default_rng(3)
    for _ in range(400):
        word = "".join(rng.choice(list("aiosstpu105$!@+-."), rng.integers(1, 9)))
        paths = every_path(scorer.channel, word, drop)
        best = scorer.channel.viterbi(word, drop)
        assert paths[best] == pytest.approx(min(paths.values())), word


def test_words_that_are_not_decoded_have_no_weight(scorer):
    """The weight is that of all readings, whether or not the tree of terms lets a word through."""
    rng, skipped = np.random.default_rng(4), 0
    model = toxicity.Model(scorer.model.trigrams, {"idiot": 5.0, "stup+": 4.0, "pussy": 3.5, "a+b": 3.0, "losin+": 3.0}, 1.0, -3.0)
    own = toxicity.Scorer(model)
    seeds = ["idiot", "stupidity", "stup", "pussy", "a+b", "losing", "house", "letter", "!!", "(ass)"]
    for _ in range(4000):
        word = list(rng.choice(seeds))
        for _ in range(rng.integers(0, 4)):
            at = rng.integers(0, len(word) + 1)
            word[at : at + rng.integers(0, 2)] = rng.choice(list("aeiostl1$!@0+(.5x"), rng.integers(0, 3))
        word = "".join(word)
        forms = own.channel.forms(word)
        want = max((model.weights.get(t, 0.0) for f in forms for t in toxicity.terms(f)), default=0.0)
        assert own.weight(word) == want, word
        skipped += not (own.spells(word.strip(toxicity.EDGES)) or own.spells(word.strip(toxicity.BARE_EDGES)))
    assert skipped > 1000
