import hashlib
import itertools
import random
import re
import zlib

import pytest

from fitloom.llm import conversations
from fitloom.llm.conversations import Walk

ROLE = {"u": "user", "a": "assistant", "s": "system"}


def every_way(rows):
    """(cost, edits, roles left) of every edit of (initial, must go, truncated) rows with up to two insertions anywhere."""
    ways = [(0, "", "")]
    for k, (initial, gone, cut) in enumerate([*rows, (None, False, False)]):
        grown = []
        for cost, edits, left in ways:
            for inserted in ("", "u", "a", "ua", "au"):
                c, e, r = cost + 3 * len(inserted), edits + "I" * len(inserted), left + inserted
                if k == len(rows):
                    grown.append((c, e, r))
                    continue
                grown.append((c + 4, e + "D", r))
                if not gone:
                    held = 3 if cut else 0
                    grown += [(c + held, e + "K", r + initial), (c + 3 + held, e + "R", r + "u"), (c + 3 + held, e + "R", r + "a")]
        ways = [w for w in grown if re.fullmatch(r"(s?(ua)*u?)?", w[2])] if k < len(rows) else [w for w in grown if re.fullmatch(r"(s?(ua)+)?", w[2])]
        least = {}
        for c, e, r in ways:  # a dearer way to the same roles can't win, whatever follows
            least[r] = min(least.get(r, c), c)
        ways = [w for w in ways if w[0] <= least[w[2]] and w[0] <= 4 * len(rows)]
    return ways


def cheapest(rows):
    return min((c, e) for c, e, _ in every_way(rows))


def symbol(initial, gone, cut):
    initial = initial if initial in ("s", "u", "a") else "o"
    return "x" if gone else initial.upper() if cut else initial


def test_walk_equals_every_way_of_short_signatures():
    kinds = [(i, False, c) for i in "suao" for c in (False, True)] + [("u", True, False)]
    walk = Walk()
    turn = random.Random(2)
    short = [rows for n in range(3) for rows in itertools.product(kinds, repeat=n)]
    long = [[turn.choice(kinds) for _ in range(turn.randint(3, 5))] for _ in range(150)]
    for rows in sorted(map(list, [*short, *long]), key=lambda rows: "".join(symbol(*r) for r in rows)):
        assert walk.take("".join(symbol(*r) for r in rows)) == cheapest(rows), rows


def test_shared_prefixes_do_not_change_answers():
    turn = random.Random(7)
    signatures = sorted({"".join(turn.choice("suaoSUAOx") for _ in range(turn.randint(0, 40))) for _ in range(400)})
    walk = Walk()
    assert [walk.take(s) for s in signatures] == [Walk().take(s) for s in signatures]


def plain(rows):
    """The row of each conv_id by the words of the contract."""
    out = []
    for conv in {r[0] for r in rows}:
        after = []
        for _, t, role, text in (r for r in rows if r[0] == conv):
            role, text = " " if role is None else role, " " if text is None else text
            c = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if t is None else t}".encode()) % 20
            text = "" if c == 1 else re.sub("[.!?]", "", text) if c == 2 else text
            after += [(t, "user" if c == 4 else role, text)] * (0 if c == 0 else 2 if c == 3 else 1)
        after.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
        seen, counts, states = set(), {"blank": 0, "duplicate": 0, "truncated": 0}, []
        for _, role, text in after:
            bare = text.rstrip(" \t\n\x0b\x0c\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            states.append((role[:1] or "o", fault in ("blank", "duplicate"), fault == "truncated"))
        turns = [t for t, _, _ in after if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        initials = [r[1][:1] for r in after]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit = Walk().take("".join(symbol(*s) for s in states)) if len(states) > 7 else cheapest(states)
        said, last, at = [], "", iter(after)
        for letter in audit:
            _, role, text = (None, "", "") if letter == "I" else next(at)
            if letter != "D":
                role = role if letter == "K" else "assistant" if last == "u" else "user"
                said.append(f"{role}:{text}")
                last = role[0]
        out.append((conv, gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest()))
    return sorted(out, key=repr)


ROWS = [
    (1, 0, "system", "Be kind."), (1, 1, "user", "Hi?"), (1, 2, "assistant", "Hello."), (1, 3, "user", "Go on"), (2, None, "user", "First."), (2, 5, "user", None), (2, 9, "assistant", "  \t"), (3, None, None, None),
    (None, 1, "user", "No id!"), (None, 2, "assistant", "None."), (4, 2, "tool", "Weird."), (4, 3, "", "Empty role."), (4, 3, "user", "Tie."), (4, 3, "user", "Tie too."), (5, 7, "user", "Same."), (5, 7, "user", "Same."), (5, 8, "assistant", "Same."),
    (5, 9, "user", "Same."), (6, -(2**62), "user", "Far."), (6, 2**62 - 1, "assistant", "Away."), (7, 1, "user", "long " * 200_000 + "."), (7, 2, "assistant", "Ünïcode ends…"), (8, 0, "userland", "Ends in spaces.  \n"), (8, 1, "ärger", "Odd initial."), (8, 2, "assistant", "x\ny:z!"),
]


def test_repair_equals_a_plain_version(spark):
    rows = ROWS + [(c, t, random.Random(c * 50 + t).choice(["user", "assistant", "user", "system"]), random.Random(c * 50 + t).choice(["Yes.", "No!", "what", "", "Fine. "])) for c in range(10, 60) for t in range(c % 6)]
    frame = spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, Turn long, ROLE string, text string, digest string, cost int").repartition(3)
    got = sorted(map(tuple, conversations.repair(frame).collect()), key=repr)
    assert got == plain(rows)
    assert conversations.repair(frame.limit(0)).count() == 0


def test_long_conversations_come_in_spans(spark, monkeypatch):
    monkeypatch.setattr(conversations, "SPAN", 16)
    turn = random.Random(5)
    rows = [(1, t, turn.choice(["user", "assistant"]), f"Turn {t % 90}" + turn.choice([".", ""])) for t in range(-100, 400)]
    got = sorted(map(tuple, conversations.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()))
    assert got == plain(rows)


@pytest.mark.parametrize("signature, answer", [("", (0, "")), ("ua", (0, "KK")), ("sua", (0, "KKK")), ("s", (4, "D")), ("u", (3, "KI")), ("uu", (3, "KR")), ("x", (4, "D")), ("UA", (6, "KK"))])
def test_known_answers(signature, answer):
    assert Walk().take(signature) == answer
