"""Packing, training order, decontamination and licenses."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from annalist.llm import decontaminate, licenses, packing, training_order
from annalist.llm.queries import tokenizer
from annalist.llm.tokens import WordIds
from tests.llm.conftest import sentence

PATH = tokenizer()


def plain_ids(text):
    from tokenizers import Tokenizer

    return [*Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids, 1]


def test_ids_equal_the_tokenizers(odd_rows):
    texts = [r[1] or "" for r in odd_rows if len(r[1] or "") < 100_000]
    texts += ["İstanbul ΣΑΣ ﬁ don't they'll 12 3.5 été. Ⅷ x² 日本語。 end", "l'été, ÉTÉ! naïve—yes … €5 $x$ a.b,c"]
    texts += ["hello <|endoftext|> world", "mid<|startoftext|>word", "<|ENDOFTEXT|> <|EndOfText|>", "<|endoftext|><|endoftext|>"]
    texts += ["<|endoftext|", "A<|endoftext|>B <|startoftext|>", "<|<|endoftext|>|>"]
    got = WordIds.of(PATH).documents([t.encode() for t in texts])
    for text, data in zip(texts, got):
        assert np.frombuffer(data, "<u4").tolist() == plain_ids(text)[:-1], text[:80]


def test_ids_after_the_words_are_forgotten(monkeypatch):
    monkeypatch.setattr(WordIds, "MOST_WORDS", 3)
    own = WordIds(PATH)
    for text in ["a b c <|endoftext|>", "d e <|endoftext|> f", "g <|startoftext|> h"]:
        assert np.frombuffer(own.documents([text.encode()])[0], "<u4").tolist() == plain_ids(text)[:-1]


def test_a_word_is_learned_once_whatever_closes_it(monkeypatch):
    """Cut at signs like the tokenizer does: in any mixture the ids are its own, and those met again stay."""
    own = WordIds(PATH)
    own.documents([b"and, and. AND and!?"])
    assert set(own.words) == {b"and", b",", b".", b"!?"}
    rng = random.Random(5)
    signs = [*".,;:!?*%$&#|'-(<=", "'s", "'.", "ab", "z", "é", "É", "1", " ", "\n", "\u0301", "\u0338", "<|endoftext|>", "日"]
    texts = ["".join(rng.choices(signs, k=rng.randrange(30))) for _ in range(2000)]
    from tokenizers import Tokenizer

    want = Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)
    for text, data, code in zip(texts, own.documents([t.encode() for t in texts]), want):
        assert np.frombuffer(data, "<u4").tolist() == code.ids, repr(text)
    monkeypatch.setattr(WordIds, "MOST_WORDS", 4)
    own, learned = WordIds(PATH), []
    plain = own.learn
    own.learn = lambda fresh: (learned.extend(fresh), plain(fresh))
    for text in [b"a b c", b"a d e", b"a f g"]:
        own.documents([text])
    assert learned.count(b"a") == 1


def check_sequences(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append(r)
    for items in by.values():
        at = 0
        for r in sorted(items, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    return len(by)


def test_packed_pieces(odd, odd_rows):
    rows = packing.pack_documents(odd, PATH, 64, keep_ids=True).collect()
    want = []
    for doc_id, text, *_ in odd_rows:
        ids = np.array(plain_ids(text), "<u4")
        for n, at in enumerate(range(0, len(ids), 64)):
            part = ids[at : at + 64].tobytes()
            want.append((doc_id, n, at, len(part) // 4, zlib.crc32(part), part))
    got = [(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"], bytes(r["ids"])) for r in rows]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert check_sequences(rows, 64) >= sum(len(w[5]) // 4 for w in want) / 64


def test_bounds_and_bins():
    rng = random.Random(2)
    for _ in range(200):
        capacity = rng.randrange(4, 60)
        lengths = np.array([rng.randrange(1, capacity) for _ in range(rng.randrange(1, 40))])
        bins, offsets, free = packing.best_fit_decreasing(lengths, capacity)
        used = np.bincount(bins, lengths, minlength=len(free))
        assert (used + free == capacity).all() and (free >= 0).all()
        assert -(-lengths.sum() // capacity) <= packing.least_bins(lengths, capacity) <= len(free)


def test_bound_beyond_volume():
    # Three lengths over half a bin need three bins, though their volume fits in two.
    assert packing.least_bins(np.array([6, 6, 6]), 10) == 3
    # Seven thirds and a bit fit twice in a bin at most.
    assert packing.least_bins(np.array([35] * 7), 100) == 4


def test_groups_with_gaps_exchange(spark):
    rng = random.Random(4)
    lengths = [rng.choice([51, 52, 34, 35, 33, 17, 48, 49]) for _ in range(400)]
    items = spark.createDataFrame(list(enumerate(lengths)), "doc_id long, length long")
    rows = packing.pack(items, 100, rows_in_group=40).collect()
    assert sorted((r["doc_id"], r["length"]) for r in rows) == list(enumerate(lengths))
    one = packing.pack(items, 100, rows_in_group=40, rounds=1).collect()
    assert check_sequences(rows, 100) <= check_sequences(one, 100)
    assert check_sequences(rows, 100) >= packing.least_bins(np.array(lengths), 100)


def test_packing_of_nothing(none):
    assert packing.pack_documents(none, PATH).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 100, 1000, 4097])
def test_feistel_is_a_permutation(n):
    slots = training_order.feistel(np.arange(n), n, 11)
    assert sorted(slots.tolist()) == list(range(n))
    if n > 50:
        assert slots.tolist() != training_order.feistel(np.arange(n), n, 12).tolist() != list(range(n))


def test_training_order_round_trip(odd, odd_rows, monkeypatch):
    monkeypatch.setattr(training_order, "IN_ROW", 3)
    monkeypatch.setattr(training_order, "IN_BLOCK", 20)
    order, placed = training_order.materialise(odd.repartition(3), PATH, key=5, length=32, per_shard=50)
    rows = placed.collect()
    stored = np.array(list(training_order.read(order, 0, order.sequences)))
    assert stored.shape == (order.sequences, 32)
    assert (np.array(list(training_order.read(order, 45, 60))) == stored[45:105]).all()
    by = {}
    for r in rows:
        assert r["shard"] == r["slot"] // 50 and r["byte"] == (r["slot"] % 50 * 32 + r["offset"]) * 2
        by.setdefault(r["doc_id"], []).append((r["start"], stored[r["slot"], r["offset"] : r["offset"] + r["count"]].tolist()))
    for doc_id, text, *_ in odd_rows:
        if doc_id not in (None, 4):
            pieces = sorted(by[doc_id])
            assert [x for _, ids in pieces for x in ids] == plain_ids(text)
    assert sum(r["count"] for r in rows) == sum(len(plain_ids(r[1])) for r in odd_rows)
    spots = {(r["slot"], r["offset"] + k) for r in rows for k in range(r["count"])}
    assert len(spots) == sum(r["count"] for r in rows)


def test_training_order_of_nothing(none):
    order, placed = training_order.materialise(none, PATH)
    assert order.sequences == 0 and placed.count() == 0


def distance(passage, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(passage):
        new = [i + 1]
        for j, b in enumerate(text):
            new.append(min(row[j] + (a != b), row[j + 1] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_matches_equal_edit_distance():
    rng = random.Random(8)
    items = [(n, sentence(rng, rng.randrange(8, 30), 60).encode()) for n in range(6)]
    index = decontaminate.Index(items)
    for _ in range(60):
        n = rng.randrange(6)
        changed = bytearray(items[n][1])
        for _ in range(rng.randrange(0, int(1.6 * decontaminate.budget(len(changed))) + 1)):
            at, kind = rng.randrange(len(changed)), rng.randrange(3)
            changed[at : at + (kind < 2)] = b"" if kind == 0 else bytes([rng.choice(b"abcdefg ")])
        text = sentence(rng, 20, 60).encode() + b" " + bytes(changed) + b" " + sentence(rng, 20, 60).encode()
        got = {(row, item): edits for row, item, edits, _, _ in index.matches([b"", text, b"short"])}
        for item, passage in items:
            least = distance(passage, text)
            assert got.get((1, item)) == (least if least <= decontaminate.budget(len(passage)) else None)
        assert {row for row, _ in got} <= {1}


def test_passages_in_documents(spark, odd, odd_rows, none):
    rng = random.Random(3)
    passage = odd_rows[7][1].split("\n")[1]
    short, other = "abc", sentence(rng, 20)
    bench = spark.createDataFrame([(1, passage.upper().replace(" ", ", ")), (2, short), (3, None), (4, other), (5, passage)], "item_id long, text string")
    found = decontaminate.find(odd, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(d, i) for d in (6, 7) for i in (1, 5)}
    assert {r["edits"] for r in found} == {0}
    clean = decontaminate.clean(odd, bench)
    assert clean.columns == odd.columns and clean.count() == len(odd_rows) - 2
    assert decontaminate.find(none, bench).count() == 0
    assert decontaminate.find(odd, bench.limit(0)).count() == 0
    assert decontaminate.clean(odd, bench.limit(0)).count() == len(odd_rows)


def test_blocks_of_passages_cover_all(spark, monkeypatch):
    bench = spark.createDataFrame([(i, f"passage number {i} " * 3) for i in range(20)], "item_id long, text string")
    parts = list(decontaminate.blocks(bench, "item_id", "text", 200))
    assert len(parts) > 3 and sorted(k for p in parts for k, _ in p) == list(range(20))


CASES = [
    ("Some text.\nLicensed under the Apache License, Version 2.0.\nMore.", {"Apache-2.0"}),
    ("Some text. Released under the MIT License. And on it goes.", {"MIT"}),
    ("licensed under  CC BY-NC 4.0.", {"CC-BY-NC-4.0"}),
    ("Licensed under CC BY 4.0.", {"CC-BY-4.0"}),
    ("Licensed under CC BY 3.0.", {"CC-BY-3.0"}),
    ("Licensed under CC BY 7.0.", set()),
    ("This work is licensed under the GNU General Public License, version 3.", {"GPL-3.0"}),
    ("This work is licensed under the GNU General Public License, version 2.", {"GPL-2.0"}),
    ("Licensed under the Apache License, Version 1.1.", {"Apache-1.1"}),
    ("Licensed under the Apache License, Version 1.7.", set()),
    ("A driving license is needed for cars and for lorries, they said.", set()),
    ("\n".join(["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and",
     "associated documentation files (the \"Software\"), to deal in the Software without restriction,",
     "including without limitation the rights to use, copy, modify, merge, publish, distribute,",
     "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is",
     "furnished to do so, subject to the following conditions:", "", "rest"]), {"MIT"}),
    ("", set()),
]


@pytest.mark.parametrize("text, want", CASES)
def test_notices(text, want):
    assert set(licenses.Scanner().scan(text)) == want


def test_notices_of_tables(odd, none):
    assert licenses.scan(odd).count() == 0
    assert licenses.scan(none).count() == 0
    with_notice = odd.withColumn("text", F.concat(F.col("text"), F.lit("\nReleased under the MIT License.")))
    assert licenses.scan(with_notice).count() == odd.where("text IS NOT NULL").count()


def test_exchange_ends_by_itself(spark):
    rng = random.Random(12)
    lengths = [rng.choice([26, 27, 37, 38, 51, 52, 74, 75, 23, 24]) for _ in range(1200)]
    rows = packing.pack(spark.createDataFrame(list(enumerate(lengths)), "doc_id long, length long"), 100, rows_in_group=30).collect()
    assert sorted((r["doc_id"], r["length"]) for r in rows) == list(enumerate(lengths))
    four = packing.pack(spark.createDataFrame(list(enumerate(lengths)), "doc_id long, length long"), 100, rows_in_group=30, rounds=1).collect()
    assert check_sequences(rows, 100) <= check_sequences(four, 100)
    assert sum(r["certified"] for r in rows) >= sum(r["certified"] for r in four)


def test_wide_vocabularies_are_refused(none, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(Tokenizer, "get_vocab_size", lambda self: 70_000, raising=False)
    try:
        with pytest.raises(ValueError):
            training_order.stream(none, PATH)
    except TypeError:
        pytest.skip("the class cannot be changed")
