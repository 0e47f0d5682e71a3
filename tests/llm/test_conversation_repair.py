"""Repair of conversations against a search over all cheapest edits, row by row."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from outpulse.llm import conversation_repair
from outpulse.llm.conversation_repair import Rope, joined, less, matrices, re_pair

SCHEMA = "conv_id bigint, turn bigint, role string, text string, copies string, kind int"
ROLES = {"u": "user", "a": "assistant"}


def best_edits(rows):
    """(cost, audit) by trying every edit: state by state, whole audits kept. ``rows``: (initial, has to go, truncated)."""

    def closed(ways):
        todo = list(ways.items())
        while todo:
            initials, (cost, audit) = todo.pop()
            if len(audit) - len(audit.rstrip("I")) < 2:
                role = "a" if initials == "u" else "u"
                way = (cost + 2, audit + "I")
                if role not in ways or way < ways[role]:
                    ways[role] = way
                    todo.append((role, way))
        return ways

    def better(ways, last, way):
        if last not in ways or way < ways[last]:
            ways[last] = way

    # The state is the last role initial, "" at the start.
    ways = {"": (0, "")}
    for initial, gone, cut in rows:
        after = {}
        for last, (cost, audit) in closed(ways).items():
            better(after, last, (cost + 3, audit + "D"))
            if not gone:
                needed = "a" if last == "u" else "u"
                better(after, needed, (cost + 2 + cut, audit + "R"))
                if initial == needed or (initial == "s" and last == ""):
                    better(after, initial, (cost + cut, audit + "K"))
        ways = after
    ways = closed(ways)
    return min(ways[last] for last in ("", "a") if last in ways)


def plain(rows):
    out, convs = {}, {}
    for conv, turn, role, text, *_ in rows:
        role, text = " " if role is None else role, " " if text is None else text
        named = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(named.encode()) % 20
        kept = convs.setdefault(conv, [])
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        kept += [(turn, role, text)] * (2 if kind == 3 else 1)
    for conv, kept in convs.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0))
        seen, symbols, counts = set(), [], [0, 0, 0]
        for _, role, text in kept:
            solid = re.sub("[\x20\x09-\x0d]", "", text)
            fault = 0 if not solid else 1 if (role, text) in seen else 2 if solid[-1] not in ".!?" else None
            if fault is not None:
                counts[fault] += 1
            symbols.append((role[:1], fault in (0, 1), fault == 2))
            seen.add((role, text))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(kept, kept[1:]))
        turns = {t for t, *_ in kept if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        cost, audit = best_edits(symbols)
        lines, last, at = [], "", 0
        for edit in audit:
            if edit != "I":
                _, role, text = kept[at]
                at += 1
            if edit == "D":
                continue
            needed = "a" if last == "u" else "u"
            last = role[:1] if edit == "K" else needed
            lines.append(f"{role if edit == 'K' else ROLES[last]}:{'' if edit == 'I' else text}")
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[conv] = (gaps, *counts, illegal, cost, audit, digest)
    return out


def rows_of(seed, n):
    draw = random.Random(seed)
    rows = []
    for conv in range(n):
        length = draw.choice([0, 1, 2, 3, 6, 9, 14])
        for turn in range(length):
            role = draw.choice(["user", "assistant"]) if draw.random() < 0.4 else ("user", "assistant")[turn % 2]
            if draw.random() < 0.15:
                role = draw.choice(["system", "tool", None, "", "s"])
            text = draw.choice(["Yes.", "no", "What? \n", "\t ", "", None, "é!", "long. " * 3, f"t{turn}."])
            rows.append((conv * 7, draw.choice([turn, turn, turn, turn + 5, None]), role, text, "x", 1))
    return rows


@pytest.mark.parametrize("segment,symbols", [(1024, 1 << 16), (3, 40)])
def test_equals_the_plain_version(as_table, monkeypatch, segment, symbols):
    monkeypatch.setattr(conversation_repair, "SEGMENT", segment)
    monkeypatch.setattr(conversation_repair, "GRAMMAR_SYMBOLS", symbols)
    if segment == 3:
        monkeypatch.setattr(conversation_repair, "BROADCAST_SYMBOLS", 0)
    # Rows of one turn keep their order in the files, so the expected result is of the rows as read.
    table = as_table(rows_of(segment, 250) + [(None, t, "user", "Hm.", "x", 1) for t in (None, 1, 1, 4)], SCHEMA)
    rows = [tuple(r) for r in conversation_repair.numbered(table).orderBy(conversation_repair.ROW).drop(conversation_repair.ROW).collect()]
    got = {r.conv_id: tuple(r)[1:] for r in conversation_repair.repair(table).collect()}
    assert got == plain(rows)


def test_one_very_long_conversation(as_table):
    draw = random.Random(9)
    rows = [(1, t // 2, draw.choice(["user", "assistant", "system"]), f"t{draw.randrange(3000)}" + draw.choice([".", ""]), "x", 1) for t in range(6000)]
    table = as_table(rows, SCHEMA)
    read = [tuple(r) for r in conversation_repair.numbered(table).orderBy(conversation_repair.ROW).drop(conversation_repair.ROW).collect()]
    (got,) = conversation_repair.repair(table).collect()
    assert tuple(got)[1:] == plain(read)[1]


def test_no_rows(as_table):
    assert conversation_repair.repair(as_table([], SCHEMA)).count() == 0


def test_all_rows_dropped(as_table):
    dropped = next((c, t) for c in range(99) for t in range(9) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0)
    (got,) = conversation_repair.repair(as_table([(*dropped, "user", "x", "x", 1)], SCHEMA)).collect()
    assert tuple(got) == (dropped[0], 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_edits_of_every_short_string():
    """Against a search over all edits of up to two insertions in a place, without states."""
    strings = ["".join(p) for n in range(1, 5) for p in itertools.product("xsuaUo", repeat=n)]
    for string, matrix in zip(strings, matrices(strings)):
        ways = conversation_repair.product(matrix[:1], conversation_repair.INSERTIONS)[0]
        got = min((w[0], str(w[1])) for w in (ways[0], ways[3]) if w)
        assert got == best_edits([(c.lower(), c == "x", c.isupper()) for c in string])


def test_best_edits_against_all_audits():
    """The plain version itself, against every audit of short conversations."""
    pattern = re.compile("(s?(ua)+)?")
    for rows in itertools.product("xsuaUo", repeat=3):
        found = []
        for edits in itertools.product("KRD", repeat=3):
            for inserts in itertools.product(range(3), repeat=4):
                audit = "".join("I" * i + e for i, e in zip(inserts, (*edits, "")))
                cost = 2 * sum(inserts)
                # Every choice of roles for reroled and inserted rows.
                slots = []
                at = 0
                ok = True
                for edit in audit:
                    if edit == "I":
                        slots.append("ua")
                        continue
                    row = rows[at]
                    at += 1
                    if edit == "D":
                        cost += 3
                        continue
                    ok &= row != "x"
                    cost += row.isupper() + (2 if edit == "R" else 0)
                    slots.append("ua" if edit == "R" else row.lower())
                if ok and cost <= 9 and any(pattern.fullmatch("".join(c)) for c in itertools.product(*slots)):
                    found.append((cost, audit))
        assert min(found) == best_edits([(c.lower(), c == "x", c.isupper()) for c in rows])


def test_grammar_gives_the_strings_back():
    draw = random.Random(2)
    strings = ["".join(draw.choice("uaUx") for _ in range(draw.randint(1, 40))) for _ in range(80)] + ["u" * n for n in range(1, 30)] + ["ua" * 300]
    rules, left = re_pair(strings)
    assert rules

    def spelled(symbol):
        n = len(conversation_repair.SYMBOLS)
        return conversation_repair.SYMBOLS[symbol] if symbol < n else "".join(map(spelled, rules[symbol - n]))

    assert ["".join(map(spelled, rest)) for rest in left] == strings
    assert max(map(len, left)) < 80


def test_ropes():
    draw = random.Random(4)
    for _ in range(300):
        ropes = []
        for _ in range(2):
            rope = Rope(None, None, "")
            for _ in range(draw.randint(0, 9)):
                part = Rope(None, None, "".join(draw.choice("DI") for _ in range(draw.randint(0, 2))))
                rope = joined(rope, part) if draw.random() < 0.5 else joined(part, rope)
            ropes.append(rope)
        assert less(*ropes) == (str(ropes[0]) < str(ropes[1]))
