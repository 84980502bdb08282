"""Repair of conversations against all edits of small ones, and against SQL."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from annalist.llm import conversations, queries
from checks import compare

BLANK, WHOLE, FORM = re.compile(r"[\x20\x09-\x0D]*"), re.compile(r"[.!?][\x20\x09-\x0D]*\Z"), re.compile(r"(s?(ua)+)?")


def rows_after_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fault = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        role = "user" if fault == 4 else role
        out += [(turn, role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        if BLANK.fullmatch(text):
            out.append("b")
        elif (role, text) in seen:
            out.append("d")
        else:
            out.append("" if WHOLE.search(text) else "t")
        seen.add((role, text))
    return out


def every_repair(rows, found, most_inserts=2):
    """All edits of a few rows, with up to two rows inserted in a place."""
    state = [(0, "", ())]
    for (_, role, text), fault in [*zip(rows, found), ((None, None, None), "end")]:
        grown = list(state)
        for _ in range(most_inserts):
            state = [(c + 3, a + "I", t + ((r, ""),)) for c, a, t in state for r in ("user", "assistant")]
            grown += state
        if fault == "end":
            state = grown
            break
        extra = 3 if fault == "t" else 0
        state = [(c + 4, a + "D", t) for c, a, t in grown]
        if fault not in ("b", "d"):
            state += [(c + extra, a + "K", t + ((role, text),)) for c, a, t in grown]
            state += [(c + 3 + extra, a + "R", t + ((r, text),)) for c, a, t in grown for r in ("user", "assistant")]
        # What cannot begin the form any more is left out.
        state = [x for x in state if re.fullmatch(r"s?(ua)*u?", "".join(r[:1] or "-" for r, _ in x[2]))]
        least = min(c for c, _, _ in state)
        state = [x for x in state if x[0] <= least + 14]
    good = [x for x in state if FORM.fullmatch("".join(r[:1] or "-" for r, _ in x[2]))]
    return min(good)


def wanted(rows, repairer):
    found = faults(rows)
    if not rows:
        return 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest()
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    roles = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:]))
    cost, audit, text = repairer(rows, found)
    digest = hashlib.sha256("\n".join(f"{r}:{x}" for r, x in text).encode()).hexdigest()
    return gaps, found.count("b"), found.count("d"), found.count("t"), illegal, cost, audit, digest


def by_pairs(rows, found):
    """The same for any length: tuples of cost, audit and text, compared as they are."""
    then = {0: 2, 1: 2, 2: 3, 3: 2}
    names = {2: "user", 3: "assistant"}
    best = {0: (0, "", ())}

    def least(steps):
        out = {}
        for state, x in steps:
            out[state] = min(out.get(state, x), x)
        return out

    def inserted(best):
        more = [(then[s], (c + 3, a + "I", (t, (names[then[s]], "")))) for s, (c, a, t) in best.items()]
        return least([*best.items(), *more])

    for (_, role, text), fault in zip(rows, found):
        steps = []
        for s, (c, a, t) in inserted(best).items():
            steps.append((s, (c + 4, a + "D", t)))
            if fault in ("b", "d"):
                continue
            extra = 3 if fault == "t" else 0
            steps.append((then[s], (c + 3 + extra, a + "R", (t, (names[then[s]], text)))))
            if role[:1] == "s" and s == 0:
                steps.append((1, (c + extra, a + "K", (t, (role, text)))))
            elif role[:1] == names[then[s]][0]:
                steps.append((then[s], (c + extra, a + "K", (t, (role, text)))))
        best = least(steps)
    cost, audit, chain = min(x for s, x in inserted(best).items() if s in (0, 3))
    text = []
    while chain:
        chain, line = chain
        text.append(line)
    return cost, audit, text[::-1]


def random_conversation(rng, conv, n):
    texts = ["Yes.", "No!", "cut", "", " \n", "Who?  ", "more", "ends…", "a. "] + [f"text {k}." for k in range(40)]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, ""]
    turns = [rng.choice([None, *range(-3, 3 * n)]) if rng.random() < 0.2 else k for k in range(n)]
    return [(conv, t, rng.choice(roles[: rng.choice([4, 8])]), rng.choice(texts) if rng.random() < 0.95 else None) for t in turns]


def check(spark, data, repairer):
    frame = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: tuple(r)[1:] for r in conversations.repair(conversations.damage(frame.repartition(4))).collect()}
    assert set(got) == {r[0] for r in data}
    for conv in got:
        rows = rows_after_damage([r for r in data if r[0] == conv])
        assert got[conv] == wanted(rows, repairer), (conv, rows)


def test_cheapest_of_all_edits(spark):
    rng = random.Random(1)
    data = [row for conv in range(400) for row in random_conversation(rng, conv, rng.randrange(1, 6))]
    check(spark, data + [(None, 0, "user", "Hello."), (None, None, None, None)], every_repair)


@pytest.mark.parametrize("block", [1, 2, 32])
def test_long_conversations_in_blocks(spark, block, monkeypatch):
    rng = random.Random(block)
    rows = [[(t, r or " ", x or " ") for _, t, r, x in random_conversation(rng, 0, n)] for n in [1, 2, 9, 40, 150, 400] * 4]
    rows.append([(k, "user", f"text {k}.") for k in range(300)])
    monkeypatch.setattr(conversations, "BLOCK", block)
    places = 2 * block + 2
    monkeypatch.setattr(conversations, "PLACES", places)
    monkeypatch.setattr(conversations, "PLACE", [3 * (places - 1 - k) for k in range(places)])
    monkeypatch.setattr(conversations, "HIGH", 3 * places)
    for conv in rows:
        conv.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        own = conversations.Repair()
        for turn, role, text in conv:
            own.add(turn, role, text, bool(BLANK.fullmatch(text)), bool(WHOLE.search(text)))
        assert own.result() == wanted(conv, by_pairs)


def test_seen_keeps_all(monkeypatch):
    monkeypatch.setattr(conversations.Seen, "LATEST", 7)
    rng, seen, known = random.Random(4), conversations.Seen(), set()
    for _ in range(3000):
        digest = bytes(rng.choices(b"\0\1\2\xff", k=4)) + bytes(11) + bytes(rng.choices(b"\0\1", k=1))
        assert seen.add(digest) == (digest in known)
        known.add(digest)
    assert sum(map(len, seen.runs)) + len(seen.latest) == len(known)


def test_one_conversation_with_most_rows(spark):
    rng = random.Random(8)
    data = [row for conv in range(30) for row in random_conversation(rng, conv, 4)] + random_conversation(rng, 99, 3000)
    data += [(None, 5, "assistant", "Same.")] * 500
    check(spark, data, by_pairs)


def test_repeated_rows_empty_tables_and_more_columns(spark):
    frame = spark.createDataFrame([(1, 0, "user", "x" * 200_000 + "."), (1, 1, "assistant", None)] * 2, "conv_id long, turn long, role string, text string")
    wide = frame.withColumns({"gaps": F.lit("z"), "gone": F.lit("z"), "fault": F.lit(1), "text.a": F.lit(2)})
    assert conversations.repair(conversations.damage(wide)).collect() == conversations.repair(conversations.damage(frame)).collect()
    assert conversations.repair(conversations.damage(frame.limit(0))).count() == 0
    dropped = [t for t in range(400) if zlib.crc32(f"3:{t}".encode()) % 20 == 0]
    gone = spark.createDataFrame([(3, t, "user", "Yes.") for t in dropped], frame.schema)
    row = conversations.repair(conversations.damage(gone)).collect()
    assert [tuple(r) for r in row] == [(3, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]


def test_repair_equals_sql(spark, duck, sf):
    name = "op13_conversation_repair"
    assert compare.differences(spark, duck, sf, queries.queries()[name], queries.oracle_sql()[name]) is None
