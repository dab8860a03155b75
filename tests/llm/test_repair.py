"""Conversation repair against all cheap edits of small conversations, on odd rows and long signatures."""

import heapq
import random

import pytest

pytest.importorskip("shotframe.llm")
from shotframe.llm import repair  # noqa: E402


def searched(letters):
    """Cheapest, then ASCII-least audit, by search over (cost, audit) with every edit."""
    heap = [(0, "", 0, "0")]  # state: what was said last: 0 nothing, s, u, a
    while heap:
        cost, audit, i, q = heapq.heappop(heap)
        if i == len(letters) and q in "0a":
            return cost, audit
        if cost > 3 * len(letters):
            continue
        for role in "ua":
            if q + role in ("0u", "su", "ua", "au"):
                heapq.heappush(heap, (cost + 2, audit + "I", i, role))
        if i < len(letters):
            x = letters[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, q))
            if x != "x":
                for role in "sua":
                    if q + role in ("0s", "0u", "su", "ua", "au") and (role == x.lower() or role != "s"):
                        heapq.heappush(heap, (cost + x.isupper() + (0 if role == x.lower() else 2), audit + ("K" if role == x.lower() else "R"), i + 1, role))
    raise AssertionError("no repair")


def test_solutions_against_a_search():
    r = random.Random(4)
    for n in range(8):
        for _ in range(60 if n else 1):
            letters = "".join(r.choice("suaoSUAOx" if r.random() < 0.5 else "ua") for _ in range(n))
            assert repair.solve(letters) == searched(letters), letters


def test_long_signatures():
    cost, audit = repair.solve("ua" * 40_000)
    assert cost == 0 and audit == "K" * 80_000
    cost, audit = repair.solve("s" + "uax" * 3001 + "u")
    assert cost == 3 * 3001 + 2 and audit == "K" + "KKD" * 3001 + "KI"


def test_repaired_turns_and_odd_rows(spark):
    schema = "conv_id long, turn long, role string, text string, alive boolean, rows int, signature string, cost int, fault string, letter string, last int, first int, salt int"
    data = [
        (1, 0, "system", "Be good.", True), (1, 1, "user", "Hello?", True), (1, 2, "assistant", "Yes.", True),
        (2, 3, "user", "Same.", True), (2, 3, "user", "Same.", True), (2, 7, "narrator", "cut", True), (2, None, "user", None, True),
        (3, 0, "user", "gone", False), (None, 0, "assistant", "Alone!  \n", True), (None, 5, None, "x.", True), (4, 1, "", "", True),
        (5, 0, "user", "long " * 60_000 + ".", True), (5, 1, "assistant", "yes.", True)]
    df = spark.createDataFrame([(*x, 1, "s", 2, "f", "l", 3, 4, 5) for x in data], schema)
    got = {r.conv_id: r for r in repair.repair(df, present="alive").collect()}
    assert set(got) == {1, 2, 3, 4, 5, None}
    plain = lambda r: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, [(t.role, t.text) for t in r.turns])
    assert plain(got[1]) == (0, 0, 0, 0, 0, 0, "KKK", [("system", "Be good."), ("user", "Hello?"), ("assistant", "Yes.")])
    # By turn: a blank of no turn, the pair of turn 3, the narrator's cut text.
    assert plain(got[2])[:7] == (3, 1, 1, 1, 3, 3 + 3 + 3, "DKDR")
    assert plain(got[2])[7] == [("user", "Same."), ("assistant", "cut")]
    assert plain(got[3]) == (0, 0, 0, 0, 0, 0, "", [])
    # A lone assistant's text and a row of no role: one insert or reroles, whichever is least.
    assert plain(got[None])[5:7] == searched("ao") and got[None].gaps == 4
    assert plain(got[4])[5:] == (3, "D", []) and got[5].cost == 0
    assert repair.repair(df.limit(0)).count() == 0


def test_a_common_signature_without_a_broadcast(spark, monkeypatch):
    rows = spark.range(600).selectExpr("id div 2 as conv_id", "id % 2 as turn", "if(id % 2 = 0, 'user', 'assistant') as role", "if(id = 5, 'cut', 'Whole.') as text")
    monkeypatch.setattr(repair, "small_side", lambda df: df)
    got = repair.repair(rows).groupBy("cost", "audit").count().collect()
    assert sorted(map(tuple, got)) == [(0, "KK", 299), (1, "KK", 1)]
