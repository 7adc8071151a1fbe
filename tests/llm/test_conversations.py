"""Conversation repair against an exhaustive search over all edits."""

import hashlib
import random
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from fluxgauge.llm import conversations

SPACE = " \t\n\x0b\x0c\r"
CONVS = "conv_id bigint, turn bigint, role string, text string, place string, copies string, audit string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "7", "x") for r in rows], CONVS)


def kinds(rows):
    seen, found = set(), []
    for role, text in rows:
        bare = text.strip(SPACE)
        found.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return found


def exhaustive(rows):
    """The best of all edits by a plain table over rows and the last initials: (cost, audit, repaired rows)."""
    faults = kinds(rows)
    best = {("", ""): (0, "", ())}  # by what was said last: nothing, a system row, a user row, an assistant row

    def fits(last, c):
        return {"": c in "su", "s": c == "u", "u": c == "a", "a": c == "u"}[last] and c != ""

    def put(into, key, value):
        if key not in into or value < into[key]:
            into[key] = value

    def inserted(now):
        for _ in range(3):
            for (last, _), (cost, audit, said) in list(now.items()):
                for role in ("user", "assistant"):
                    if fits(last, role[0]):
                        put(now, (role[0], ""), (cost + 2, audit + "I", (*said, (role, ""))))
        return now

    best = inserted(best)
    for (role, text), fault in zip(rows, faults, strict=True):
        after = {}
        for (last, _), (cost, audit, said) in best.items():
            put(after, (last, ""), (cost + 3, audit + "D", said))
            if fault in ("blank", "duplicate"):
                continue
            more = fault == "truncated"
            if fits(last, role[:1]):
                put(after, (role[:1], ""), (cost + more, audit + "K", (*said, (role, text))))
            for to in ("user", "assistant"):
                if fits(last, to[0]):
                    put(after, (to[0], ""), (cost + 2 + more, audit + "R", (*said, (to, text))))
        best = inserted(after)
    return min(v for (last, _), v in best.items() if last in ("", "a"))


def expected(rows):
    """One conversation's report from its damaged rows (turn, role, text), in order."""
    flat = [(r, t) for _, r, t in rows]
    faults, (cost, audit, said) = kinds(flat), exhaustive(flat)
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    pairs = [a[0][:1] + b[0][:1] for a, b in zip(flat, flat[1:], strict=False)]
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in said).encode()).hexdigest()
    return (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, digest)


def damaged(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if fault == 1 else "".join(c for c in text if c not in ".!?") if fault == 2 else text
        out[conv] += [(turn, "user" if fault == 4 else role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2])) for c, r in out.items()}


def by_id(df):
    return {r[0]: tuple(r[1:]) for r in df.collect()}


ROLES = ["user", "assistant", "user", "assistant", "system", "tool", "", "usher"]
TEXTS = ["Yes.", "No!", "cut off", "", " \t", "Why?", "ends. ", "more", "\x1c"]


def test_random_conversations_equal_the_exhaustive_search(spark):
    rng = random.Random(3)
    rows = [(c, t, rng.choice(ROLES), rng.choice(TEXTS)) for c in range(300) for t in sorted(rng.choices(range(12), k=rng.randint(1, 9)))]
    got = by_id(conversations.report(frame(spark, rows)))
    plain = defaultdict(list)
    for c, t, r, x in rows:
        plain[c].append((t, r, x))
    assert got == {c: expected(sorted(v)) for c, v in plain.items()}


def test_damage_is_that_of_the_contract(spark):
    rng = random.Random(4)
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice([*TEXTS, None])) for c in [*range(150), None] for t in [None, *range(rng.randint(0, 6))]]
    got = by_id(conversations.report(conversations.damage(frame(spark, rows)), F.col("copies")))
    assert got == {c: expected(v) for c, v in damaged(rows).items()}
    assert None in got


def test_small_segments_change_nothing(spark):
    rng = random.Random(6)
    for _ in range(200):
        rows = [(rng.choice(ROLES), rng.choice(TEXTS)) for _ in range(rng.randint(0, 40))]
        for segment in (1, 2, 5, 64):
            said = []
            one = conversations.Repair(lambda role, text, edit, said=said: said.append((role, text)), segment)
            for i, (role, text) in enumerate(rows):
                one.add(i, role, text)
            *_, cost, audit = one.end()
            assert (cost, audit, tuple(said)) == exhaustive(rows)


def test_long_conversations_commit_as_they_go(spark):
    """What waits for a decision stays small, whatever the length."""
    held = 0
    one = conversations.Repair(lambda *_: None)
    rng = random.Random(8)
    for i in range(20_000):
        one.add(i, rng.choice(["user", "assistant", "system"]), f"{i}." if rng.random() < 0.8 else "")
        held = max(held, len(one.rows))
    assert held < 1000 and len(one.end()[-1]) >= 20_000


def test_dropped_conversations_and_empty_tables(spark):
    assert conversations.report(frame(spark, [])).count() == 0
    assert conversations.repaired(frame(spark, [])).count() == 0
    got = by_id(conversations.report(frame(spark, [(5, 1, "user", "Hi.")]), F.lit(0)))
    assert got == {5: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    # Only rows that must go.
    assert by_id(conversations.report(frame(spark, [(5, 1, "user", ""), (5, 3, "assistant", " ")])))[5][:7] == (1, 2, 0, 0, 0, 6, "DD")


def test_repaired_rows(spark):
    rows = [(1, 0, "assistant", "Hello."), (1, 1, "user", "Hi"), (1, 2, "user", "Hi"), (1, 3, "assistant", "Well. " * 50_000)]
    got = [(r.conv_id, r.place, r.role, len(r.text), r.edit) for r in conversations.repaired(frame(spark, rows)).orderBy("place").collect()]
    assert got == [(1, 0, "user", 0, "I"), (1, 1, "assistant", 6, "K"), (1, 2, "user", 2, "K"), (1, 3, "assistant", 300_000, "K")]


def test_one_conversation_of_most_rows(spark):
    rng = random.Random(9)
    rows = [(7, i, rng.choice(ROLES[:5]), rng.choice(["a.", "b", "", f"{i}!"])) for i in range(600)] + [(i, 0, "user", "x.") for i in range(8, 60)]
    got = by_id(conversations.report(frame(spark, rows).repartition(6)))
    assert got[7] == expected([(t, r, x) for c, t, r, x in rows if c == 7]) and len(got) == 53
