"""Near copies by five-word shingles against brute force, planted edits included."""

import random

import corpus_pipeline
from annalist.llm import near_copies
from tests.llm.conftest import WORDS, sentence


def brute_set(text):
    words = WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def brute_kept(rows):
    sets, root = [brute_set(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or both * 5 >= len(sets[i] | sets[j]) * 4:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return len({find(i) for i in range(len(rows))})


def edited(rng, words, edits):
    words = list(words)
    for at in rng.sample(range(len(words)), edits):
        words[at] = f"new{rng.randrange(10**6)}"
    return words


def planted():
    """Originals, copies with a few words changed (near) and with many (not near), and a chain."""
    rng, rows = random.Random(4), []
    for g in range(40):
        words = sentence(rng, 200, 5000).split()
        rows.append((10 * g, " ".join(words)))
        rows += [(10 * g + k, " ".join(edited(rng, words, k))) for k in (1, 3, 4)]
        rows.append((10 * g + 9, " ".join(edited(rng, words, 16))))
    chain = sentence(rng, 200, 5000).split()
    for k in range(8):
        rows.append((1000 + k, " ".join(chain)))
        chain = edited(rng, chain, 3)
    return rows


def test_edited_copies_leave_one(spark):
    rows = planted()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()}
    assert kept == {10 * g for g in range(40)} | {10 * g + 9 for g in range(40)} | {1000}
    assert len(kept) == brute_kept(rows)


def test_one_of_each_group_stays(odd, odd_rows, none):
    left = near_copies.drop_near_copies(odd)
    assert left.columns == odd.columns
    assert left.count() == brute_kept([r[:2] for r in odd_rows])
    assert near_copies.drop_near_copies(none).count() == 0


def test_keys_of_pairs_at_the_bound():
    rng, missed = random.Random(8), 0
    for _ in range(300):
        shared = [rng.getrandbits(64) for _ in range(160)]
        a, b = (near_copies.np.unique(near_copies.np.array(shared + [rng.getrandbits(64) for _ in range(20)], "<u8")) for _ in "ab")
        assert near_copies.similar(a, b)
        missed += not set(near_copies.band_keys(a)) & set(near_copies.band_keys(b))
    assert missed == 0


def test_forest_links_what_is_similar():
    rng = random.Random(5)
    for _ in range(60):
        base = [rng.getrandbits(64) for _ in range(rng.randrange(1, 60))]
        sets = []
        for _ in range(rng.randrange(1, 30)):
            own = [x for x in base if rng.random() < rng.choice([0.5, 0.9, 0.97])] + [rng.getrandbits(64)]
            sets.append(near_copies.np.unique(near_copies.np.array(own, "<u8")))
        root = list(range(len(sets)))
        for a, b in near_copies.forest(sets):
            assert near_copies.similar(sets[a], sets[b])
            root = [root[a] if x == root[b] else x for x in root]
        for i in range(len(sets)):
            for j in range(i):
                assert not near_copies.similar(sets[i], sets[j]) or root[i] == root[j]
        assert len(near_copies.forest(sets)) == len(sets) - len(set(root))


def test_a_large_group_without_a_common_member(spark, monkeypatch):
    """Copies far from each other and near to one that is not the least; a chain; few of it linked at first."""
    rng = random.Random(9)
    base = sentence(rng, 200, 5000).split()
    rows = [(500, " ".join(base))] + [(k, " ".join(edited(rng, base, 3))) for k in range(120)]
    rows += [(200 + k, " ".join(edited(rng, base, rng.choice([4, 5, 6])))) for k in range(60)]
    chain = base
    for k in range(30):
        chain = edited(rng, chain, 3)
        rows.append((300 + k, " ".join(chain)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    wanted = brute_kept(rows)
    monkeypatch.setattr(near_copies, "OFTEN", 5)
    monkeypatch.setattr(near_copies, "CHUNK_ROWS", 25)
    monkeypatch.setattr(near_copies, "SLAB", 64)
    assert corpus_pipeline.drop_near_duplicates(spark, docs, "").count() == wanted
    monkeypatch.setattr(near_copies, "SMALL", 10_000)
    assert corpus_pipeline.drop_near_duplicates(spark, docs, "").count() == wanted


def test_pairs_of_linked_fingerprints_are_candidates(spark, monkeypatch):
    rows = [(1, 5, 0b0), (2, 5, 0b1111), (3, 5, 0b11111111), (9, 5, 0b0), (4, 0, 0b0), (1, 5, 1 << 40 | 0b11111)]
    sets = spark.createDataFrame(rows, "fp long, n long, simhash long")
    assert {tuple(r) for r in near_copies._linked(sets).collect()} == {(1, 2), (2, 3), (1, 3), (1, 9)}
    asked = []
    links = near_copies.golay.links
    monkeypatch.setattr(near_copies.golay, "links", lambda *a: asked.append(a) or links(*a))
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a b  c d e f"), (3, "x")], "doc_id long, text string")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()
    assert sorted(r["doc_id"] for r in kept) == [1, 3] and asked
