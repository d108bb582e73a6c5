"""Conversation repair against all edits tried in order, and its defined results for odd input."""

import hashlib
import random
import re
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from windloom.llm import conversation

EMPTY = hashlib.sha256(b"").hexdigest()
TEXTS = ["a.", "b!", "c", "d?", "", "  ", "e. ", "g,", "same."]


def with_insertions(best):
    for _ in range(3):
        for p, (cost, audit, lines) in list(best.items()):
            q = 3 if p == 2 else 2
            way = (cost + 3, audit + "I", (*lines, "user:" if q == 2 else "assistant:"))
            best[q] = min(best.get(q, way), way)
    return best


def by_brute_force(rows):
    """All ways over the rows (turn, role, text) at once, with their whole audits: what ``repair`` returns after conv_id."""
    follows = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    seen, faults, best = set(), [], {0: (0, "", ())}
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        fault = "b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else ""
        seen.add((role, text))
        faults.append(fault)
        after = {}
        for p, (cost, audit, lines) in with_insertions(dict(best)).items():
            q = 3 if p == 2 else 2
            more = 3 * (fault == "t")
            ways = [(p, (cost + 4, audit + "D", lines))]
            if fault not in ("b", "d"):
                ways.append((q, (cost + 3 + more, audit + "R", (*lines, f"{'user' if q == 2 else 'assistant'}:{text}"))))
                if (p, role[:1]) in follows:
                    ways.append((follows[p, role[:1]], (cost + more, audit + "K", (*lines, f"{role}:{text}"))))
            for to, way in ways:
                after[to] = min(after.get(to, way), way)
        best = after
    best = with_insertions(dict(best))
    cost, audit, lines = min(best[q] for q in (0, 3) if q in best)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def damage(rows):
    """conv_id to its rows after damage, in order."""
    found, text_of = {}, lambda v: " " if v is None else str(v)
    for conv_id, turn, role, text in rows:
        fate = zlib.crc32(f"{text_of(conv_id)}:{text_of(turn)}".encode()) % 20
        kept = found.setdefault(conv_id, [])
        role, text = "user" if fate == 4 else text_of(role), "" if fate == 1 else re.sub("[.!?]", "", text_of(text)) if fate == 2 else text_of(text)
        kept += [(turn, role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    for kept in found.values():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
    return found


def check(spark, rows, **options):
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, md5 string, n int")
    got = [tuple(r) for r in conversation.repair(conversation.damaged(table), **options).collect()]
    want = [(conv_id, *by_brute_force(kept)) for conv_id, kept in damage(rows).items()]
    order = lambda r: (r[0] is not None, r[0])
    assert sorted(got, key=order) == sorted(want, key=order)


def test_repair_of_odd_rows(spark):
    rnd = random.Random(5)
    roles = [None, "", "tool", "system", "user", "user", "user", "assistant", "assistant", "u", "User"]
    texts = [None, *TEXTS, *[f"t{k}." for k in range(40)], "long word. " * 30_000]
    check(spark, [(rnd.choice([None, *range(30)]), rnd.choice([None, *range(25)]), rnd.choice(roles), rnd.choice(texts)) for _ in range(600)])


def test_repair_of_a_conversation_that_holds_most_rows(spark):
    rnd = random.Random(6)
    row = lambda c: (c, rnd.randrange(400), rnd.choice(["user", "assistant", "system"]), rnd.choice(TEXTS) + (str(rnd.random()) if rnd.random() < 0.7 else "") + rnd.choice([".", ""]))
    rows = [row(1 if rnd.random() < 0.4 else c) for c in range(40) for _ in range(30)]
    rows += [(7, 3, "user", "hot")] * 300 + [(7, k, "user", "hot") for k in range(200)]
    rnd.shuffle(rows)
    check(spark, rows, held_rows=5)
    check(spark, rows)


def test_repair_of_empty_and_fully_dropped_tables(spark):
    check(spark, [])
    dropped = [(c, t, "user", "a.") for c in range(200) for t in range(2) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0]
    table = spark.createDataFrame(dropped, "conv_id long, turn long, role string, text string")
    got = conversation.repair(conversation.damaged(table)).collect()
    assert len(got) == len({c for c, *_ in dropped}) > 5
    assert {tuple(r)[1:] for r in got} == {(0, 0, 0, 0, 0, 0, "", EMPTY)}


def test_repair_takes_ids_of_other_types(spark):
    rows = [(c, t, ("user", "assistant")[t % 2], f"{c} {t}.") for c in "ab" for t in range(4)]
    table = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")
    got = {r["conv_id"]: tuple(r)[1:] for r in conversation.repair(conversation.damaged(table)).collect()}
    assert got == {c: by_brute_force(kept) for c, kept in damage(rows).items()}


@settings(max_examples=300, deadline=None)
@given(st.text("dsuaoSUAO", max_size=14), st.integers(0, 14))
def test_least_audit_and_any_cut(kinds, cut):
    cut = min(cut, len(kinds))
    whole = conversation.audit(kinds)
    best = {0: (0, "")}
    for kind in kinds:
        ways = [(q, (best[p][0] + c, best[p][1] + e)) for q, options in enumerate(conversation.EDITS[kind]) for p, c, e in options if p in best]
        best = {q: min(w for s, w in ways if s == q) for q, _ in ways}
    assert (conversation.replay(whole, kinds, 0)[1], whole) == min((c + 3 * len(conversation.ENDING[q]), a + conversation.ENDING[q]) for q, (c, a) in best.items())
    tables = [conversation.EDITS[k] for k in kinds]
    states = conversation.crossings(tables, 0, conversation.last_state(*conversation.forward(tables, 0, len(tables), 0)))
    left, right = conversation.audit(kinds[:cut], 0, states[cut]), conversation.audit(kinds[cut:], states[cut], states[-1])
    assert whole == left + right + conversation.ENDING[states[-1]]
