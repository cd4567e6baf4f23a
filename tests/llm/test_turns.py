"""Conversation repair against all edit sequences (short conversations) and a plain search over states (longer ones)."""

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict
from itertools import product

import pytest

from plumewalk.llm import queries, turns

SCHEMA = "conv_id long, turn long, role string, text string, _k string, pos long, code string, copy string"
WHITE = " \t\n\x0b\x0c\r"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "k", 1, "c", "d") for r in rows], SCHEMA)


def after_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        seed = ":".join(" " if x is None else str(x) for x in (conv, turn))
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(seed.encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return sorted(out, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))


def judged(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        end = text.rstrip(WHITE)
        out.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def exhaustive(rows, kinds, most_inserts=2):
    """(cost, audit, lines) over all edits and insertions."""
    inserts = [x for n in range(most_inserts + 1) for x in product("ua", repeat=n)]
    best = None
    choices = [["D"] if k in ("blank", "duplicate") else ["K", "Ru", "Ra", "D"] for k in kinds]
    for slots in product(inserts, repeat=len(rows) + 1):
        for edits in product(*choices):
            cost, audit, lines = 0, "", []
            for i, slot in enumerate(slots):
                for x in slot:
                    cost, audit = cost + 3, audit + "I"
                    lines.append((turns.ROLES[x], ""))
                if i < len(rows):
                    e, (_, _, role, text) = edits[i], rows[i]
                    cost += {"K": 0, "R": 3, "D": 4}[e[0]] + 3 * (kinds[i] == "truncated" and e != "D")
                    audit += e[0]
                    if e != "D":
                        lines.append((turns.ROLES[e[1]] if e[0] == "R" else role, text))
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in lines)) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, lines)
    return best


def searched(rows, kinds):
    """The same by the cheapest path over (rows done, place in the pattern)."""
    step = {("0", "s"): "s", ("0", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    heap, done = [(0, "", 0, "0", ())], set()
    while heap:
        cost, audit, i, state, lines = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows) and state in "0a":
            return cost, audit, list(lines)
        for x in "ua":
            if (state, x) in step:
                heapq.heappush(heap, (cost + 3, audit + "I", i, step[state, x], (*lines, (turns.ROLES[x], ""))))
        if i < len(rows):
            _, _, role, text = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, state, lines))
            if kinds[i] not in ("blank", "duplicate"):
                more = 3 * (kinds[i] == "truncated")
                for e, extra, own in (("K", 0, role), ("R", 3, "user"), ("R", 3, "assistant")):
                    if own and (state, own[0]) in step:
                        heapq.heappush(heap, (cost + extra + more, audit + e, i + 1, step[state, own[0]], (*lines, (own, text))))


def brute(rows, solve=None):
    given = defaultdict(list)
    for r in rows:
        given[r[0]].append(r)
    out = {}
    for conv, own in given.items():
        left = after_damage(own)
        kinds = judged(left)
        cost, audit, lines = (solve or searched)(left, kinds)
        known = {r[1] for r in left} - {None}
        initials = [r[2][:1] for r in left]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()
        out[conv] = (max(known) - min(known) + 1 - len(known) if known else 0, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest)
    return out


def conversations(rng, n, most):
    rows = []
    for conv in range(n):
        for turn in range(rng.randint(1, most)):
            rows.append((conv, turn + 3 * (rng.random() < 0.1), rng.choice(["user", "assistant", "user", "assistant", "system", "tool"]), rng.choice(["Yes.", "Well\n", "no", "Why? ", "", "Ünd so!\n\n", "é"])))
    return rows


ODD = [
    (-1, None, None, None), (-1, None, "user", "a."), (-1, 5, "user", None), (None, 0, "user", "Null id."), (None, 1, "assistant", "Fine."), (-2, None, "", "x."), (-2, None, "Sys", "x."),
    (-3, 4, "system", "S."), (-3, 4, "user", "same turn."), (-3, 4, "user", "same turn."), (-4, 2**62, "user", "far."), (-4, -(2**62), "assistant", "far."), (-5, 1, "user", "w " * 30_000 + "."),
]


def test_short_conversations_match_all_edits(spark):
    rows = conversations(random.Random(1), 70, 3)
    want = {c: v for c, v in brute(rows, lambda r, k: exhaustive(r, k) if len(r) <= 2 else searched(r, k)).items()}
    got = {r["conv_id"]: tuple(r)[1:] for r in turns.repair(turns.damaged(frame(spark, rows)), frame(spark, rows)).collect()}
    assert got == want and len({v[6] for v in want.values()}) > 20


def test_query_on_a_folder(spark, tmp_path):
    rows = conversations(random.Random(2), 150, 12) + ODD
    frame(spark, rows).write.parquet(f"{tmp_path}/conversations.parquet")
    found = queries.op12_turns(spark, str(tmp_path))
    assert dict(found.dtypes) == {"conv_id": "bigint", "audit": "string", "repaired_sha256": "string"} | {c: "bigint" for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    got = found.collect()
    assert {r["conv_id"]: tuple(r)[1:] for r in got} == brute(rows) and len(got) == len({r[0] for r in rows})
    assert turns.repair(turns.damaged(frame(spark, rows)).limit(0)).count() == 0


def test_a_hot_conversation_in_chunks(spark, monkeypatch, few_rows):
    """Chunks of a few rows, positions over several ranges."""
    monkeypatch.setattr(turns, "CHUNK", 4)
    rng = random.Random(3)
    rows = [(7, t, rng.choice(["user", "assistant", "system"]), rng.choice([f"Turn {t}.", "Same?", f"cut {t}", ""])) for t in range(120)] + conversations(rng, 12, 9)
    got = {r["conv_id"]: tuple(r)[1:] for r in turns.repair(turns.damaged(frame(spark, rows))).collect()}
    want = brute(rows)
    assert got == {c: v for c, v in want.items() if c in got} and got[7] == want[7]


@pytest.mark.parametrize("codes", ["", "uaua", "sua", "xX01", "UASu2a", "aaaa", "ssuu", "au" * 40])
def test_tables_of_parts_join(codes):
    known = turns.stacks()
    assert len(known.tops) == 8
    whole = known.ended(known.run({0: (0, "")}, codes))
    for cut in range(len(codes) + 1):
        tops = known.run({0: (0, "")}, codes[:cut])
        after = {}
        for start, (cost, audit) in tops.items():
            for to, c, a in turns.chunk_table(start, codes[cut:]):
                after[to] = min(after.get(to, (9**9, "")), (cost + c, audit + a))
        assert known.ended(after) == whole


def test_repaired_rows():
    rows = [("assistant", "A."), ("system", "S."), ("user", "U.")]
    assert list(turns.repaired_rows("IKDKI", iter(rows))) == [("user", ""), ("assistant", "A."), ("user", "U."), ("assistant", "")]
