import hashlib
import random
import zlib
from collections import defaultdict
from functools import cache
from itertools import pairwise

import pytest

from gatherline.llm import conversations as C
from gatherline.llm.conversations import Repair, damaged, repair_report

SPACE = " \t\n\x0b\x0c\r"


def cheapest(kinds):
    """(cost, audit) by costs to go over all rows and states: edits are compared from their first letter on."""

    @cache
    def best(i, state):
        ways = []
        if i < len(kinds):
            initial, fault = kinds[i] // 4, kinds[i] % 4
            extra = 5 if fault == C.CUT else 0
            c, a = best(i + 1, state)
            ways.append((c + 2, "D" + a))
            if fault < C.BLANK:
                nxt = {0: {0: 1}, 1: {0: 2, 1: 2, 3: 2}, 2: {2: 3}}.get(initial, {}).get(state)
                if nxt:
                    c, a = best(i + 1, nxt)
                    ways.append((c + extra, "K" + a))
                c, a = best(i + 1, 3 if state == 2 else 2)
                ways.append((c + extra + 1, "R" + a))
        elif state in (0, 3):
            ways.append((0, ""))
        for n in (1, 2):  # insertions, then a row's edit or the end
            s = state
            for _ in range(n):
                s = 3 if s == 2 else 2
            if i == len(kinds):
                if s == 3:
                    ways.append((5 * n, "I" * n))
            else:
                ways += [(c + 5 * n, "I" * n + a) for c, a in row_ways(i, s)]
        return min(ways)

    def row_ways(i, state):
        initial, fault = kinds[i] // 4, kinds[i] % 4
        extra = 5 if fault == C.CUT else 0
        c, a = best(i + 1, state)
        out = [(c + 2, "D" + a)]
        if fault < C.BLANK:
            nxt = {0: {0: 1}, 1: {0: 2, 1: 2, 3: 2}, 2: {2: 3}}.get(initial, {}).get(state)
            if nxt:
                c, a = best(i + 1, nxt)
                out.append((c + extra, "K" + a))
            c, a = best(i + 1, 3 if state == 2 else 2)
            out.append((c + extra + 1, "R" + a))
        return out

    return best(0, 0)


def solved(kinds, cuts):
    """The operator's answer with the rows in blocks that end at ``cuts``."""
    parts = [bytes(kinds[a:b]) for a, b in zip([0, *cuts], [*cuts, len(kinds)], strict=True) if a < b]
    tables = [C.composed([C.ROWS[k] for k in p]) for p in parts]
    cost, end = C.last_state(tables)
    states = C.crossings(tables, 0, end)
    return cost, "".join("".join(C.row_edits(p, a, b)) for p, (a, b) in zip(parts, pairwise(states), strict=True)) + C.ENDING[end]


def test_edits_are_the_cheapest_and_least():
    rng = random.Random(1)
    for _ in range(4000):
        kinds = [rng.choice([0, 1, 4, 4, 5, 8, 8, 9, 6, 7, 11, 12, 13]) for _ in range(rng.randint(1, 14))]
        cuts = sorted(rng.sample(range(len(kinds) + 1), rng.randint(0, min(4, len(kinds)))))
        assert solved(kinds, cuts) == cheapest(tuple(kinds)), (kinds, cuts)


def test_long_conversation():
    """80,000 rows in blocks give the edits of one block, in little memory."""
    rng = random.Random(2)
    kinds = [rng.choice([4, 8, 4, 8, 5, 6, 11]) for _ in range(80_000)]
    whole = solved(kinds, [])
    assert whole == solved(kinds, [1, 7, 30_000, 65_000]) and len(whole[1]) >= 80_000


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        show = lambda x: " " if x is None else str(x)
        hit = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        role, text = show(role), show(text)
        if hit == 1:
            text = ""
        if hit == 2:
            text = "".join(c for c in text if c not in ".!?")
        if hit == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if hit == 0 else 2 if hit == 3 else 1)
    return out


def report(rows, ids):
    """The report by brute force, conversation by conversation."""
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        groups[conv].append((turn, role, text))
    out = {}
    for conv in ids:
        found = sorted(groups[conv], key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest()))
        seen, kinds = set(), []
        for _, role, text in found:
            bare = text.strip(SPACE)
            fault = C.BLANK if not bare else C.DUPLICATE if (role, text) in seen else C.CUT if bare[-1] not in ".!?" else C.FINE
            seen.add((role, text))
            kinds.append(4 * ("sua".find(role[0]) if role and role[0] in "sua" else 3) + fault)
        cost, audit = cheapest(tuple(kinds))
        turns = [t for t, _, _ in found if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in pairwise(found))
        lines, state, rest = [], 0, iter(found)
        for letter in audit:
            row = next(rest) if letter != "I" else (None, "", "")
            if letter == "D":
                continue
            if letter in "IR":
                state = 3 if state == 2 else 2
                lines.append(("", "", "user", "assistant")[state] + ":" + row[2])
            else:
                state = "sua".index(row[1][0]) + 1
                lines.append(row[1] + ":" + row[2])
        faults = [k % 4 for k in kinds]
        counts = [faults.count(f) for f in (C.BLANK, C.DUPLICATE, C.CUT)]
        out[conv] = (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def got(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len({r[0] for r in rows})
    return {r[0]: r[1:] for r in rows}


@pytest.mark.parametrize("piece_rows", [C.PIECE_ROWS, 5])
def test_sample_is_as_brute_force(spark, piece_rows):
    """With pieces of a few rows, most conversations lie in several."""
    sample = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").limit(200 if piece_rows == 5 else 10_000)
    rows = [tuple(r) for r in sample.select("conv_id", "turn", "role", "text").collect()]
    want = report(damage(rows), {r[0] for r in rows})
    assert got(repair_report(damaged(sample), sample, piece_rows)) == want
    assert {c for w in want.values() for c in w[6]} == {"D", "K", "R"}  # an insertion costs more than a deletion


def odd_rows():
    rng = random.Random(3)
    rows = [(1, t, "user" if t % 2 else "assistant", "same.") for t in range(40)] + [(2, 5, "user", "x" * 3_000_000 + " end.\n")]
    rows += [(3, None, None, None), (3, None, "user", "a?"), (3, 4, "", "b."), (3, 4, "", "b."), (3, 9, "system", "c. "), (3, 2**62, "assistant", " \t")]
    rows += [(None, 1, "user", "no id."), (None, None, "assistant", "no id!"), (None, 1, "user", "no id.")]
    rows += [(7, t, rng.choice(["user", "assistant", "system", "tool", "User", "say"]), rng.choice(["a.", "b", "", "é!", "c? "])) for t in range(60)]
    return rows + [(-4, 0, "system", "only."), (5, 0, "assistant", "a:b."), (5, 0, "assistant:a", "b."), (5, 1, "a", "b.")]


def test_odd_rows(spark):
    """NULLs, empty and very long texts, repeated rows, equal turns, unknown roles, clashing columns."""
    rows = odd_rows()
    schema = "conv_id bigint, turn bigint, role string, text string, uid int, kind string, piece int, seq int, audit string, cost string"
    df = spark.createDataFrame([(*r, 1, "x", 2, 3, "y", "z") for r in rows], schema).repartition(3)
    for n in (C.PIECE_ROWS, 4):
        shown = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
        assert got(repair_report(df, None, n)) == report(shown, {r[0] for r in rows})
        assert got(repair_report(damaged(df), df, n)) == report(damage(rows), {r[0] for r in rows})
    empty = repair_report(damaged(df.limit(0)), df)
    assert {tuple(r)[1:] for r in empty.collect()} == {(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert empty.count() == 7 and repair_report(df.limit(0)).count() == 0


def test_repaired_rows(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "assistant", "Hello."), (1, 2, "assistant", "Yes?"), (1, 3, "user", "cut"), (1, 4, "user", "End.")]
    repair = Repair(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
    left = [(r.role, r.text, r.edit) for r in repair.rows().orderBy("piece", "seq", "at").collect()]
    cost, audit = cheapest((0, 8, 8, 5, 4))
    assert "".join(r.audit for r in repair.edits.orderBy("piece", "seq").collect()) == audit
    assert [r[0] for r in left] in (["system", "user", "assistant"], ["system", "user", "assistant", "user", "assistant"])
    assert {r[2] for r in left} <= {"K", "R", "I"} and repair.counts.where("cost IS NOT NULL").first()["cost"] == cost
