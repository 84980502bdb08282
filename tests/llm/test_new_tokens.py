"""Token counts and the alignment of two tokenizers, against the libraries themselves."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from annalist.llm import alignment, token_counts
from annalist.llm.queries import tokenizer
from tests.llm.conftest import SCHEMA, sentence

PATH = tokenizer()
A, B = tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model")
ALPHABETS = ["ab", "aae", "lo", "the ", "ing s", "ABCabc 123'ts", ".,!?$'s'", "hå¨öé日本😀 ", "ab \n\t"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def random_texts(seed, n, most):
    rng = random.Random(seed)
    return ["".join(rng.choices(rng.choice(ALPHABETS), k=rng.randrange(most))) for _ in range(n)]


def test_counts_equal_the_library(library):
    rng = random.Random(3)
    texts = random_texts(1, 5000, 80) + [
        "", " ", "hello <|endoftext|> world", "<|ENDOFTEXT|>", "mid<|startoftext|>word", "<|endoftext|><|endoftext|>",
        "ΣΑΣ İstanbul ﬁ don't they'll Ⅷ x² 日本語。", "x" * 150_000, "ab" * 3000, "é" * 3000,
        "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=60_000)), "new letters ՘ ꟢\U000107bb end",
        sentence(rng, 3000, 9000),
    ]
    want = [len(x.ids) for x in library.encode_batch_fast(texts, add_special_tokens=False)]
    assert token_counts.Counter(PATH).count(texts) == want


def test_counts_of_every_character(library):
    letters = [chr(c) for c in range(1, 0x30000) if not 0xD800 <= c < 0xE000]
    texts = [f"a{c}b {c}" for c in letters]
    want = [len(x.ids) for x in library.encode_batch_fast(texts, add_special_tokens=False)]
    assert token_counts.Counter(PATH).count(texts) == want


def test_long_pre_tokens_take_the_same_rounds(monkeypatch):
    words = [w.encode() for w in random_texts(7, 800, 90) if w and not set(w) & set(" \n\t")]
    counter = token_counts.Counter(PATH)
    want = counter.merges.survivors(words).tolist()
    monkeypatch.setattr(token_counts, "LONG", 1)
    assert counter.merges.survivors(words).tolist() == want


def test_pieces_of_long_texts(library, monkeypatch):
    monkeypatch.setattr(token_counts, "PIECE", 50)
    texts = random_texts(11, 300, 900) + ["no space " * 30 + "x" * 400 + " <|endoftext|> y"]
    want = [len(x.ids) for x in library.encode_batch_fast(texts, add_special_tokens=False)]
    assert token_counts.Counter(PATH).count(texts) == want


def test_other_vocabularies_are_refused():
    letters = {x: i for i, x in enumerate(token_counts.LETTERS)}
    model = {"type": "BPE", "vocab": letters | {"ab": 256, "abc": 257}, "merges": [["ab", "c"], ["a", "b"]]}
    with pytest.raises(ValueError):
        token_counts.Merges(model)
    with pytest.raises(ValueError):
        token_counts.Merges(model | {"type": "Unigram"})
    assert token_counts.Merges(model | {"merges": [["a", "b"], ["ab", "c"]]}).survivors([b"abcab", b"a"]).tolist() == [2, 1]


def test_counts_of_tables(library, odd, odd_rows, none):
    got = token_counts.count(odd, PATH, limit=40).collect()
    want = []
    for doc_id, text, *_ in odd_rows:
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        want.append((doc_id, len((text or "").encode()), n, n > 40))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert token_counts.count(none, PATH).count() == 0


def by_hand(text):
    """Tokens, groups and links of one text, from the sets of ends."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    if "a" not in by_hand.known:
        by_hand.known["a"] = Tokenizer.from_file(A)
        by_hand.known["a"].encode_special_tokens = True
        by_hand.known["b"] = SentencePieceProcessor(model_file=B)
        by_hand.known["letters"] = {x: b for b, x in enumerate(alignment.LETTERS)}
    first, second, letters = (by_hand.known[x] for x in ("a", "b", "letters"))
    if not text:
        return 0, 0, [], ""
    code = first.encode(" " + text, add_special_tokens=False)
    a, b = code.ids, second.encode(text)
    a_bytes = [bytes(letters[c] for c in x) for x in code.tokens]
    b_bytes = []
    for i in b:
        x = second.id_to_piece(i)
        b_bytes.append(bytes([int(x[3:5], 16)]) if second.is_byte(i) else x.replace("▁", " ").encode())
    if not b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
        return 0, 0, [], ""
    a_end = {int(e): i for i, e in enumerate(np.cumsum([len(x) for x in a_bytes]))}
    b_end = {int(e): i for i, e in enumerate(np.cumsum([len(x) for x in b_bytes]))}
    links, groups, i, j = [], [], 0, 0
    for end in sorted(set(a_end) & set(b_end)):
        links.append((a[a_end[end]], b[b_end[end]]))
        groups.append(",".join(map(str, a[i : a_end[end] + 1])) + "|" + ",".join(map(str, b[j : b_end[end] + 1])))
        i, j = a_end[end] + 1, b_end[end] + 1
    return len(a), len(b), links, ";".join(groups)


by_hand.known = {}


@pytest.mark.parametrize("lane", [3, 64, 2048])
def test_alignment_equals_sets_of_ends(lane, monkeypatch):
    monkeypatch.setattr(alignment, "LANE", lane)
    own = alignment.Aligner.of(A, B)
    texts = random_texts(lane, 500, 200) + [
        "", "a", "▁", "a▁b", "<|endoftext|> </s> <s>x", "x" * 9000, "\0\x01", "  \n ", "a b" * 2000, "new ՘ \U000107bb",
    ]
    for text, got in zip(texts, own.align([t.encode() for t in texts])):
        n_a, n_b, links, groups = by_hand(text)
        keys = own.pairs.keys[got[3]]
        assert (got[0], got[1], got[2], got[4].decode()) == (n_a, n_b, len(links), groups), text[:60]
        assert list(zip((keys >> 32).tolist(), (keys & 0xFFFFFFFF).tolist())) == links


def test_every_character_is_encoded_as_by_the_library():
    own = alignment.ByteLevel(A)
    texts = [f" a{chr(c)}b {chr(c)} {chr(c)}{chr(c)}" for c in range(1, 0x30000) if not 0xD800 <= c < 0xE000]
    want = [x.ids for x in own.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    assert own.fast is not None and own.encode(texts) == want


def test_fast_encoder_on_runs():
    own = alignment.ByteLevel(A)
    texts = random_texts(23, 8000, 60) + ["lol" * 50, "aaaaaaaaab" * 20, "------=====" * 9, "0000001111" * 9, " " * 77 + "x"]
    assert own.encode(texts) == [x.ids for x in own.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def test_alignment_of_tables(spark, odd, odd_rows, none):
    rows = odd_rows + [(20 + i, t, *odd_rows[0][2:]) for i, t in enumerate(["a▁b", "two words two words", "\x00"])]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = alignment.judge(docs.repartition(3), A, B).collect()
    found = [(r[0], by_hand(r[1])) for r in rows]
    counts = Counter(x for _, (_, _, links, _) in found for x in links)
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(most.get(b, 0), n)
    want = []
    for doc_id, (n_a, n_b, links, groups) in found:
        digest = hashlib.sha256(groups.encode()).hexdigest() if groups else ""
        best = sum(counts[x] == most[x[1]] for x in links)
        want.append((doc_id, n_a, n_b, len(links), len(links), digest, best, sum(counts[x] for x in links)))
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]
    assert sorted((tuple(r[c] for c in names) for r in got), key=repr) == sorted(want, key=repr)
    assert alignment.judge(none, A, B).count() == 0
    texts = {r["doc_id"]: r["groups"] for r in alignment.align(docs, A, B, keep_groups=True).collect()}
    assert texts[21] == by_hand("two words two words")[3]


def test_counts_of_pairs_are_whole(spark):
    docs = spark.createDataFrame([(i, "one text of a few words") for i in range(50)], "doc_id long, text string").repartition(7)
    counts = alignment.pair_counts(alignment.align(docs, A, B), A, B).collect()
    want = Counter(by_hand("one text of a few words")[2])
    assert {(r["a_id"], r["b_id"]): r["n"] for r in counts} == {k: 50 * n for k, n in want.items()}
