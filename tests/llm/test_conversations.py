"""Conversation repair against an exhaustive search and a plain forward search over whole conversations."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from rillflow.llm import agenda
from rillflow.llm.conversations import damaged, digested, intact, op12_conversation_repair, repaired

SOLID = re.compile("[^\x20\x09-\x0d]")


def shape_ok(roles):
    return re.fullmatch("(s?(ua)+)?", "".join(roles)) is not None


def exhaustive(rows):
    """Least (cost, audit) over all edits with at most two insertions before each row and at the end."""
    best = None
    per_row = []
    for initial, gone, truncated, _ in rows:
        options = [("D", 4, ())]
        if not gone:
            options += [("K", 3 * truncated, (initial,)), ("R", 3 + 3 * truncated, ("u",)), ("R", 3 + 3 * truncated, ("a",))]
        per_row.append(options)
    inserts = [("", 0, ())] + [("I" * n, 3 * n, c) for n in (1, 2) for c in itertools.product("ua", repeat=n)]
    for choice in itertools.product(*[x for options in per_row for x in (inserts, options)], inserts):
        if shape_ok([r for c in choice for r in c[2]]):
            weight = (sum(c[1] for c in choice), "".join(c[0] for c in choice))
            best = weight if best is None else min(best, weight)
    return best


@pytest.mark.parametrize("seed", range(12))
def test_agenda_against_all_edits(seed):
    draw = random.Random(seed)
    rows = [(draw.choice("suax"), draw.random() < 0.25, draw.random() < 0.25, 0) for _ in range(3)]
    assert agenda.repaired(rows) == exhaustive(rows)


@pytest.mark.parametrize("seed", range(30))
def test_stretches_join_to_the_whole(seed):
    draw = random.Random(seed)
    rows = [(draw.choice("suauax"), draw.random() < 0.2, draw.random() < 0.2, draw.choice((0, 0, 1))) for _ in range(draw.randint(1, 12))]
    cuts = sorted(draw.sample(range(len(rows) + 1), 2))
    parts = [agenda.stretch(x) for x in (rows[: cuts[0]], rows[cuts[0] : cuts[1]], rows[cuts[1] :])]
    (cost, audit), = agenda.joined(parts, True).values()
    assert (cost, "".join(audit)) == agenda.repaired(rows) == plain([r for i, g, t, m in rows for r in [(i, g, t)] + [(i, True, False)] * m])


def plain(rows):
    """Row by row, the least weight of every last role; a role of None is the empty start."""
    after = {None: "u", "s": "u", "u": "a", "a": "u"}
    best = {None: (0, "")}

    def inserted(best):
        out = dict(best)
        for _ in range(3):
            for state, (cost, audit) in list(out.items()):
                to = after[state]
                out[to] = min(out.get(to, (1 << 60, "")), (cost + 3, audit + "I"))
        return out

    for initial, gone, truncated in rows:
        new = {}
        for state, (cost, audit) in inserted(best).items():
            options = [(state, 4, "D")]
            if not gone:
                options.append((after[state], 3 + 3 * truncated, "R"))
                if initial == after[state] or (initial == "s" and state is None):
                    options.append((initial, 3 * truncated, "K"))
            for to, more, edit in options:
                new[to] = min(new.get(to, (1 << 60, "")), (cost + more, audit + edit))
        best = new
    last = inserted(best)
    return min(w for s, w in last.items() if s in (None, "a"))


def brute(rows, damage=True):
    """The stated result for (conv, turn, role, text) rows."""
    convs = {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, [])
        role, text, copies = " " if role is None else role, " " if text is None else text, 1
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fault = zlib.crc32(key.encode()) % 20 if damage else 9
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        convs[conv] += [(turn is not None, turn or 0, "user" if fault == 4 else role, text)] * {0: 0, 3: 2}.get(fault, 1)
    out = []
    for conv, turns in convs.items():
        turns.sort(key=lambda t: (t[0], t[1], t[2].encode(), t[3].encode()))
        faults, seen, edits = [], set(), []
        for _, _, role, text in turns:
            solid = SOLID.findall(text)
            fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else None
            seen.add((role, text))
            faults.append(fault)
            edits.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        cost, audit = plain(edits)
        known = {t[1] for t in turns if t[0]}
        gaps = max(known) - min(known) + 1 - len(known) if known else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))
        lines, at, state = [], iter(turns), None
        for edit in audit:
            row = next(at) if edit != "I" else None
            if edit == "D":
                continue
            to = "s" if edit == "K" and state is None and row[2][:1] == "s" else {None: "u", "s": "u", "u": "a", "a": "u"}[state]
            role = row[2] if edit == "K" else {"u": "user", "a": "assistant"}[to]
            lines.append(f"{role}:{row[3] if row else ''}")
            state = to
        sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out.append((conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha))
    return sorted(out, key=str)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


def rows_of(spark, sf_dir):
    return [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]


def test_query(spark, sf_dir):
    assert got(op12_conversation_repair(spark, sf_dir)) == brute(rows_of(spark, sf_dir))


SCHEMA = "conv_id long, turn long, role string, text string, seq long, piece long, copies long, salt string, audit string"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, "x", "y") for r in rows], SCHEMA)


def hot(n=700):
    """One conversation with most rows: odd roles, many copies, a turn with many rows, nulls; and small ones beside it."""
    draw = random.Random(5)
    texts = ["ok", "Yes.", " ", "", None, "no stop", "Fine!", "é? "] + [f"text {i}." for i in range(300)]
    rows = [(7, draw.choice([None, 5, 5, *range(400)]), draw.choice(["user", "assistant", "system", "tool", None, ""]), draw.choice(texts)) for _ in range(n)]
    rows += [(7, 50, "user", "again and again.")] * 60
    rows += [(c, t, r, x) for c in (None, 1, 2, 3, 8) for t, r, x in ((1, "user", "a."), (2, "assistant", "b"), (None, "user", None), (9, "assistant", "b"))]
    rows += [(9, -(1 << 63), "user", "a."), (9, (1 << 62), "assistant", "b."), (10, 1, "user", "long. " * 50_000), (10, 2, "assistant", "c" * 300_000)]
    return rows


@pytest.mark.parametrize("limits", [{}, {"block_rows": 7, "block_chars": 1000, "fan": 2}])
@pytest.mark.parametrize("damage", [True, False])
def test_long_conversations_and_edges(spark, limits, damage):
    rows = hot()
    df = (damaged if damage else intact)(table(spark, rows))
    assert got(digested(repaired(df, **limits))) == [(*r[:1], wrapped(r[1]), *r[2:]) for r in brute(rows, damage)]


def wrapped(x):
    return (x + (1 << 63)) % (1 << 64) - (1 << 63)


def test_pieces_hold_the_turns(spark):
    rows = [(1, t, "user" if t % 2 else "assistant", f"text {t}.") for t in range(1, 101)]
    out = repaired(intact(table(spark, rows)), block_rows=8).where("piece >= 0").orderBy("piece").collect()
    assert [(t.role, t.text) for r in out for t in r.turns] == [r[2:] for r in rows]


def test_all_rows_dropped_and_empty(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:1".encode()) % 20 == 0)
    rows = [(gone, 1, "user", "a."), (gone + 1000, 3, "user", "b.")]
    assert got(digested(repaired(damaged(table(spark, rows))))) == brute(rows)
    nothing = (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert nothing in got(digested(repaired(damaged(table(spark, rows)))))
    assert digested(repaired(damaged(table(spark, rows).limit(0)))).count() == 0
