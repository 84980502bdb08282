"""SimHash groups and repeated passages against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F

from annalist.llm import components, golay, phrases
from tests.llm.conftest import WORDS, sentence


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute_fingerprint(text):
    words = WORDS.findall(lower(text))
    if not words:
        return 0
    n = max(len(words) - 3, 1)
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(n)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > n)


def brute_groups(fps):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(fps))]


def test_code_is_perfect():
    ranges = golay._code()[3]
    assert (ranges[:, 1] - ranges[:, 0] == 1).all()


def test_keys_find_all_pairs_up_to_four_bits():
    rng = np.random.default_rng(3)
    x = rng.integers(-(2**63), 2**63 - 1, 600, dtype=np.int64)
    y = x.view(np.uint64).copy()
    for i in range(len(y)):
        for b in rng.choice(64, i % 4 + 1, replace=False):
            y[i] ^= np.uint64(1) << np.uint64(b)
    y = y.view(np.int64)

    def sets(keys):
        out = [set() for _ in x]
        for k, o in zip(*keys):
            out[o].add(int(k))
        return out

    px, py, ox, oy = (sets(f(v)) for f, v in ((golay.probe_keys, x), (golay.probe_keys, y), (golay.own_keys, x), (golay.own_keys, y)))
    for i in range(len(x)):
        one, two = px[i] & oy[i], py[i] & ox[i]
        assert any(k % 2 for k in one | two) or any(k % 2 == 0 for k in (one if x[i] < y[i] else two))


def test_links_of_a_dense_ball(spark):
    rng = random.Random(1)
    base = rng.getrandbits(64)
    values = {base ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(4))) for _ in range(150)}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    got = {tuple(r) for r in golay.links(spark.createDataFrame([(v,) for v in signed], "fp long")).collect()}
    want = {(min(a, b), max(a, b)) for a in signed for b in signed if a != b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 4}
    assert got == want


def test_groups_match_brute_force(odd, odd_rows):
    got = golay.near_duplicates(odd).collect()
    fps = [brute_fingerprint(r[1]) for r in odd_rows]
    roots = brute_groups(fps)
    ids = {}
    for (i, *_), r in zip(odd_rows, roots):
        if i is not None:
            ids[r] = min(ids.get(r, i), i)
    want = [(r[0], f - (1 << 64) if f >> 63 else f, ids.get(g)) for r, f, g in zip(odd_rows, fps, roots)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_one_of_each_group_stays(odd, odd_rows):
    left = golay.drop_near_duplicates(odd)
    assert left.columns == odd.columns
    kept = [(r["doc_id"], r["text"]) for r in left.collect()]
    roots = brute_groups([brute_fingerprint(r[1]) for r in odd_rows])
    assert len(kept) == len(set(roots))
    assert (4, odd_rows[4][1]) in kept and 5 not in [k[0] for k in kept]


def test_empty_tables(none):
    assert golay.near_duplicates(none).count() == 0
    assert golay.drop_near_duplicates(none).count() == 0
    assert phrases.remove_repeats(none.select("doc_id", "text")).count() == 0


def test_components_of_long_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 260)] + [(5, 5), (None, 3)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, 7: 7, **{i: 7 for i in range(200, 260)}}


def brute_removal(rows, size):
    split = [WORDS.findall(t or "") for _, t in rows]
    count = Counter(tuple(w[i : i + size]) for w in split for i in range(len(w) - size + 1))
    out = []
    for (i, _), w in zip(rows, split):
        gone = [False] * len(w)
        for s in range(len(w) - size + 1):
            if count[tuple(w[s : s + size])] > 1:
                gone[s : s + size] = [True] * size
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((i, len(w), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_passages_match_brute_force(odd, odd_rows):
    got = phrases.remove_repeats(odd.select("doc_id", "text"))
    assert sorted(map(tuple, got.collect()), key=repr) == brute_removal([r[:2] for r in odd_rows], 35)


def test_overlapping_partners_and_self_overlap(spark):
    rng = random.Random(9)
    long = sentence(rng, 200).split()
    rows = [
        (1, " ".join(long)),
        (2, "a " + " ".join(long[:70]) + " b"),
        (3, "c " + " ".join(long[50:120]) + " d"),
        (4, " ".join(long[100:134])),
        (5, "q " * 36 + "r"),
        (6, "q " * 34 + "s"),
        (7, " ".join(long[150:190] + ["x"] + long[150:185])),
    ]
    got = phrases.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=repr) == brute_removal(rows, 35)


def test_cut_text_keeps_other_columns_and_white_space(odd, odd_rows):
    cut = phrases.remove_repeats(odd, "text")
    assert sorted(cut.columns) == sorted(odd.columns)
    texts = {r["doc_id"]: r["text"] for r in cut.where(F.col("doc_id") >= 6).collect()}
    assert texts[13] == "one two three" and texts[14] == odd_rows[15][1]
    assert texts[6].split("\n")[0] == odd_rows[7][1].split("\n")[0]


def test_repeated_rows_spread_over_buckets(spark, monkeypatch):
    """3,000 equal rows with one id are as large as 3,000 rows with their own ids."""
    one = [(a, 7, 1, 1_000) for a in (11, 12)] * 3_000
    own = [(a, 100 + k, 1, 1_000) for a in (21, 22) for k in range(3_000)]
    anchors = spark.createDataFrame(one + own + [(31, 8, 2, 500), (32, 9, 1, 500)], "anchor long, key long, n long, size long")
    lists = phrases.anchor_lists(anchors)
    sizes = {r["key"]: (r["least"], r["size"]) for r in lists.collect()}
    assert sizes[7] == (11, 3_000_000) and sizes[100] == (21, 1_000) and sizes[8] == (31, 500) and 9 not in sizes
    assert {r["least"]: r["parts"] for r in phrases.bucket_parts(lists).collect()} == {11: 3, 21: 3, 31: 1}
    text = " ".join(f"w{k}" for k in range(60))
    docs = spark.createDataFrame([(5, text)] * 300 + [(6, text + " end"), (8, "other words")], "doc_id long, text string")
    monkeypatch.setattr(phrases, "BUCKET_BYTES", 5_000)
    got = phrases.remove_repeats(docs.repartition(4)).groupBy("doc_id", "n_words", "n_removed").count().collect()
    assert sorted(map(tuple, got)) == [(5, 60, 60, 300), (6, 61, 60, 1), (8, 2, 0, 1)]
