import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest

from cadence.llm import conversation_repair as cr
from cadence.llm import queries

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
SPACES = " \t\n\v\f\r"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        hit = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if hit == 0:
            continue
        text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
        out += [(conv, turn, "user" if hit == 4 else role, text)] * (2 if hit == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        bare = text.strip(SPACES)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, found):
    """(cost, audit, lines) over all lists of edits, by every path forward."""
    best = {(): (0, "", [])}  # the initials so far, as far as they matter, to the least (cost, audit)

    def state(initials):
        return initials if len(initials) < 2 else initials[-1]

    after = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "A", ("A", "u"): "u"}
    best = {"": (0, "", [])}

    def put(into, q, x):
        if q not in into or x[:2] < into[q][:2]:
            into[q] = x

    def insert(now):
        for _ in range(4):
            for q, (c, a, out) in list(now.items()):
                for role in ("user", "assistant"):
                    if (q, role[0]) in after:
                        put(now, after[q, role[0]], (c + 2, a + "I", [*out, role + ":"]))
        return now

    for (role, text), fault in zip(rows, found, strict=True):
        new = {}
        for q, (c, a, out) in insert(best).items():
            put(new, q, (c + 3, a + "D", out))
            if fault in ("blank", "duplicate"):
                continue
            more = fault == "truncated"
            if (q, role[:1]) in after:
                put(new, after[q, role[:1]], (c + more, a + "K", [*out, f"{role}:{text}"]))
            for other in ("user", "assistant"):
                if (q, other[0]) in after:
                    put(new, after[q, other[0]], (c + 2 + more, a + "R", [*out, f"{other}:{text}"]))
        best = new
    best = insert(best)
    return min((best[q] for q in ("", "A") if q in best), key=lambda x: x[:2])


def plain(rows):
    out = []
    after = damaged(rows)
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in after if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, hashlib.sha256(f"{len(r[2])}:{r[2]}{r[3]}".encode()).hexdigest()))
        turns = {r[1] for r in mine if r[1] is not None}
        found = faults([r[2:] for r in mine])
        cost, audit, lines = cheapest([r[2:] for r in mine], found)
        illegal = sum((a[2][:1] + b[2][:1]) not in ("su", "ua", "au") for a, b in itertools.pairwise(mine))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out.append((conv, gaps, *(found.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def made(seed, convs=60, longest=14):
    draw = random.Random(seed)
    rows = []
    for c in range(convs):
        turn = draw.randrange(3)
        for _ in range(draw.randrange(1, longest)):
            role = draw.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "s"])
            text = draw.choice(["Hi.", "So it is!", "cut of", "", " \t\n", None, "é?", "x\n", "End. ", str(draw.random()), ". \u0085", "."])
            rows.append((c if c else None, draw.choice([turn, turn, turn, None]), role, text))
            turn += draw.choice([0, 1, 1, 1, 5])
    return rows


def test_whole_query_against_brute_force(spark, tmp_path):
    rows = made(1)
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    assert got(queries.op11_conversation_repair(spark, str(tmp_path))) == plain(rows)


@pytest.mark.parametrize(("chunk", "fan"), [(1, 2), (3, 2), (5, 3), (7, 1000)])
def test_pieces_of_any_size_give_the_same_repair(spark, chunk, fan):
    rows = [(5, k, r, t) for k, (_, _, r, t) in enumerate(made(2, 12, 9))] + made(3, 10, 20)
    turns = queries.damaged_conversations(spark.createDataFrame(rows, SCHEMA))
    fixed, report = cr.repair(turns, chunk=chunk, fan=fan)
    audits = {r["conv"]: r for r in cr.conversation_audits(fixed).collect()}
    found = {r["conv"]: r for r in report.collect()}
    for row in plain(rows):
        if row[0] not in found:  # no row was left
            continue
        a, r = audits[row[0]], found[row[0]]
        assert (r["conv"], r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], a["audit"], a["repaired_sha256"]) == row


def test_tables_against_every_list_of_edits():
    """Whole symbol strings: costs and edits as found by trying all."""
    draw = random.Random(4)
    initials = {"s": "system", "u": "user", "a": "assistant", "?": "tool"}
    for _ in range(400):
        n = draw.randrange(0, 13)
        symbols = [draw.randrange(cr.SYMBOLS) for _ in range(n)]
        rows = [(initials[cr.INITIALS[(s - 1) // 2]] if s else "user", "x") for s in symbols]
        found = ["blank" if not s else "truncated" if (s - 1) % 2 else "" for s in symbols]
        edits, q = cr.tables().trace(np.array(symbols, dtype=np.int64), 0, cr.EMPTY)
        audit = "".join(edits) + cr._TRAILING[q]
        assert audit == cheapest(rows, found)[1]


def test_maps_compose():
    draw = random.Random(6)
    symbols = np.array([draw.randrange(cr.SYMBOLS) for _ in range(50)], dtype=np.int64)
    t = cr.tables()
    cuts = [0, 3, 4, 17, 49, 50]
    parts = [t.transfer(symbols[a:b]) for a, b in itertools.pairwise(cuts)]
    assert cr.compose(parts) == t.transfer(symbols)
    whole, end = t.trace(symbols, 0, cr.EMPTY)
    pieces = []
    for (a, b), (q, v) in zip(itertools.pairwise(cuts), cr.handed_down(parts, cr.EMPTY, 0), strict=True):
        edits, last = t.trace(symbols[a:b], v, q)
        pieces += edits
    assert pieces == whole and last == end
    assert len(t.vectors) < 200


def test_rows_and_lines_of_a_small_repair(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "assistant", "Hello."), (1, 2, "user", "Bye"), (1, 2, "user", "Bye"), (1, 3, "user", "")]
    turns = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA + ", conv string, pos string")
    fixed, report = cr.repair(turns)
    out = fixed.orderBy("pos").collect()
    assert "".join(r["edits"] for r in out) == cheapest([r[2:] for r in rows], faults([r[2:] for r in rows]))[1]
    assert [r["duplicate"] for r in out] == [False, False, False, True, False]
    assert report.first()["cost"] == cheapest([r[2:] for r in rows], faults([r[2:] for r in rows]))[0]


def test_empty_table(spark):
    fixed, report = cr.repair(spark.createDataFrame([], SCHEMA))
    assert fixed.count() == 0 and report.count() == 0 and cr.conversation_audits(fixed).count() == 0


def test_very_long_texts(spark):
    rows = [(1, 0, "user", "a" * 400_000), (1, 1, "assistant", " " * 400_000), (1, 2, "assistant", "b " * 200_000 + ".")]
    fixed, report = cr.repair(spark.createDataFrame(rows, SCHEMA))
    r = report.first()
    assert (r["blank"], r["truncated"], r["cost"]) == (1, 1, 4)
