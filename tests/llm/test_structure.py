import hashlib
import heapq
import random
import re
import zlib

import pytest

from millrace.llm import structure as st
from millrace.llm.common import Scratch

GRAMMAR = re.compile(r"(s?(ua)+)?")


def damaged_by_hand(rows):
    out = []
    for conv, turn, role, text in rows:
        said = [" " if x is None else str(x) for x in (conv, turn)]
        kind = zlib.crc32(":".join(said).encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def cheapest(rows):
    """(cost, edits, lines) by uniform search over (row, state), least in ASCII order of the edits."""
    after = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    heap, seen = [(0, "", 0, "", ())], {}
    while heap:
        cost, edits, at, state, lines = heapq.heappop(heap)
        if (at, state) in seen:
            continue
        seen[at, state] = True
        if at == len(rows) and state in ("", "a"):
            return cost, edits, lines
        for role, to in after[state].items():
            if role != "s":
                heapq.heappush(heap, (cost + 3, edits + "I", at, to, (*lines, {"u": "user", "a": "assistant"}[role] + ":")))
        if at < len(rows):
            role, text, fault = rows[at]
            heapq.heappush(heap, (cost + 4, edits + "D", at + 1, state, lines))
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                if role[:1] in after[state]:
                    heapq.heappush(heap, (cost + more, edits + "K", at + 1, role[:1], (*lines, f"{role}:{text}")))
                for r, to in after[state].items():
                    if r != "s":
                        heapq.heappush(heap, (cost + 3 + more, edits + "R", at + 1, to, (*lines, {"u": "user", "a": "assistant"}[r] + f":{text}")))


def report_by_hand(all_rows):
    out = {}
    for conv in {r[0] for r in all_rows}:
        rows = sorted([r[1:] for r in damaged_by_hand(all_rows) if r[0] == conv], key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, kinds = set(), []
        for _, role, text in rows:
            last = re.sub(r"[\x20\x09-\x0D]+", "", text)[-1:]
            kinds.append("blank" if not last else "duplicate" if (role, text) in seen else "ok" if last in ".!?" else "truncated")
            seen.add((role, text))
        turns = [r[0] for r in rows if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
        cost, edits, lines = cheapest([(r[1], r[2], k) for r, k in zip(rows, kinds, strict=True)])
        out[conv] = (gaps, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, edits, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def made_up(seed, n_convs, longest):
    rng, rows = random.Random(seed), []
    texts = ["Yes.", "No!", "so", "", " \n", "Why?  ", "é…", "x.\x0b", "a b. c", None, "Long. " * 50]
    for conv in [*range(n_convs), None]:
        for turn in range(rng.randint(1, longest)):
            role = rng.choice(["user", "assistant"] * 4 + ["system", "tool", "", None, "User", "a", "u"])
            rows.append((conv, rng.choice([turn] * 9 + [None, turn + 3]), role, rng.choice(texts + [f"t{rng.randint(0, 40)}."] * 20)))
    return rows + rows[:5]


def report(spark, rows, extra=False):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    if extra:
        df = df.selectExpr("*", "1 as conv", "2 as part", "3 as fault", "4 as kind", "5 as copy", "6 as dropped")
    out = st.repair_report(st.traced_blocks(st.damaged(df), Scratch(spark, "t"))).collect()
    assert len({r.conv for r in out}) == len(out)
    return {r.conv: tuple(r)[1:] for r in out}


@pytest.mark.parametrize("block", [1, 3, 32])
def test_equals_a_uniform_search(spark, monkeypatch, block):
    monkeypatch.setattr(st, "BLOCK_ROWS", block)
    rows = made_up(block, 60, 12)
    assert report(spark, rows, extra=block == 3) == report_by_hand(rows)


def test_a_conversation_over_many_tasks(spark):
    rows = made_up(9, 1, 3) + [(7, t, "user" if t % 2 == 0 or t % 31 == 0 else "assistant", f"{t % 900}" + "." * (t % 17 > 0)) for t in range(1500)]
    got = report(spark, rows)
    assert got == report_by_hand(rows)


def test_blocks_of_a_long_conversation_lie_in_several_tasks(spark):
    rows = [(7, t, "user" if t % 2 == 0 else "assistant", f"{t}.") for t in range(4000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    traced = st.traced_blocks(st.damaged(df), Scratch(spark, "t"))
    assert traced.select("part").distinct().count() > 2 and traced.count() > 100


def test_auction_prices_are_a_dual_optimum():
    rng = random.Random(3)
    for _ in range(300):
        kinds = [rng.randrange(16) for _ in range(rng.randint(0, 12))]
        arcs = st.lattice(kinds, st._DONE, True)
        price = [0] * len(arcs)
        cost = st.auction(0, arcs, price, st.most_cost(len(kinds)))
        assert all(price[i] <= c + price[j] for i, out in enumerate(arcs) for _, c, j in out)
        faults = ["ok", "blank", "duplicate", "truncated"]
        want = cheapest([(" sua"[k & 3], "", faults[k >> 2]) for k in kinds])
        (edits, _), = st.traces(kinds, st._DONE, True, [0])
        assert (cost, edits) == want[:2]


def test_repaired_turns(spark):
    rows = made_up(5, 30, 9)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    traced = st.traced_blocks(st.damaged(df), Scratch(spark, "t"))
    by_conv = {}
    for r in sorted(st.repaired_turns(traced).collect(), key=lambda r: (r.conv is not None, r.conv or 0, r.place)):
        by_conv.setdefault(r.conv, []).append(r)
    want = report_by_hand(rows)
    for conv, turns in by_conv.items():
        assert "".join(t.edit for t in turns) == want[conv][6]
        kept = [t for t in turns if t.edit != "D"]
        assert GRAMMAR.fullmatch("".join(t.role[0] for t in kept))
        assert hashlib.sha256("\n".join(f"{t.role}:{t.text}" for t in kept).encode()).hexdigest() == want[conv][7]


def test_a_very_long_text_and_an_empty_table(spark):
    rows = [(1, 0, "user", "word. " * 400_000), (1, 1, "assistant", "b" * 3_000_000), (1, 2, "assistant", "c.")]
    assert report(spark, rows) == report_by_hand(rows)
    assert report(spark, []) == {}
