"""Conversation structure repair by deduplicated signatures.

A conversation's rows, by turn, are written as one letter each: the role's initial (s, u, a, else o; upper case where the text
is cut short), or x for a row that has to go (blank, or role and text seen before). Equal signatures have equal repairs, so
each distinct one is solved once, by a memoised recursion on its halves, and the audit is joined back and replayed on the rows.

A half is solved for every state of the grammar ``(s?(ua)+)?`` that it may begin and end in, as (cost, audit); halves are joined
by the least cost and then the ASCII-least audit. That is exact: an audit that is the beginning of another one of the same
rows has fewer inserts and so another cost, hence of equal costs the smaller half makes the smaller whole.

Faults, gaps and the replay are column expressions; only the distinct signatures meet Python. A conversation is one row of the result
(its audit and its repaired turns), so it must fit a task.

Defined results: null texts and roles are one space (blank; an initial that is neither s, u nor a); null turns come first and are
left out of the gaps; rows of equal turn are ordered by role and text; a null id is a conversation like any other; rows that are
not ``present`` only name their conversation; a conversation without rows has zeros, an empty audit and no turns; repeated rows
are duplicates; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import small_batches, small_side, written

#: White space at the end of a text, and what a whole sentence ends with.
BLANKS, ENDS = " \t\n\x0b\x0c\r", (".", "!", "?")
KEEP, REROLE, DELETE, INSERT, CUT = 0, 2, 3, 2, 1
USER, ASSISTANT = "user", "assistant"
LEGAL = ("su", "ua", "au")
#: States: nothing yet, after the system row, after a user's, after an assistant's.
START, SYSTEM, ASKED, ANSWERED = range(4)
#: The state after one more row of user or assistant, whichever the grammar asks for.
NEXT = {START: ASKED, SYSTEM: ASKED, ASKED: ANSWERED, ANSWERED: ASKED}
#: Signatures up to this length are remembered.
REMEMBERED = 48
#: Solutions beyond a broadcast are dealt out this many times against a common signature.
SALTS = 16

Solved = dict[tuple[int, int], tuple[int, str]]


def _joined(left: Solved, right: Solved) -> Solved:
    out: Solved = {}
    for (a, b), (cost, audit) in left.items():
        for (c, d), (more, rest) in right.items():
            if b == c and ((a, d) not in out or (cost + more, audit + rest) < out[a, d]):
                out[a, d] = cost + more, audit + rest
    return out


#: No insert, one, or two; a third would come back to a state at a cost.
_INSERTS: Solved = {(q, q): (0, "") for q in NEXT} | {(q, NEXT[q]): (INSERT, "I") for q in NEXT} | {(q, ANSWERED): (2 * INSERT, "II") for q in (START, SYSTEM)}


def _row(letter: str) -> Solved:
    out: Solved = {(q, q): (DELETE, "D") for q in NEXT}
    if letter != "x":
        cut, initial = CUT * letter.isupper(), letter.lower()
        for q, then in NEXT.items():
            keeps = initial == ("a" if then == ANSWERED else "u")
            out[q, then] = (KEEP + cut, "K") if keeps else (REROLE + cut, "R")
        if initial == "s":
            out[START, SYSTEM] = (KEEP + cut, "K")
    return out


def _halved(signature: str) -> Solved:
    if len(signature) == 1:
        return _joined(_INSERTS, _row(signature))
    half = len(signature) // 2
    return _joined(_solved(signature[:half]), _solved(signature[half:]))


_remembered = lru_cache(1 << 16)(_halved)


def _solved(signature: str) -> Solved:
    return _remembered(signature) if len(signature) <= REMEMBERED else _halved(signature)


def solve(signature: str) -> tuple[int, str]:
    """The cost and the audit of the cheapest repair of a signature, the ASCII-least among the cheapest."""
    whole = _joined(_solved(signature), _INSERTS) if signature else {(START, START): (0, "")}
    return min(whole[q] for q in ((START, START), (START, ANSWERED)) if q in whole)


def _solutions(signatures: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([solve(x) for x in signatures], columns=["cost", "audit"])


def _faulty(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, present: str | None) -> DataFrame:
    """Each row with its letter and its first fault."""
    alive = F.coalesce(F.col(f"`{present}`"), F.lit(False)) if present else F.lit(True)
    named = rows.select(
        F.col(f"`{conv_col}`").alias("conv_id"), F.col(f"`{turn_col}`").cast("long").alias("turn"), F.coalesce(F.col(f"`{role_col}`").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(" ")).alias("text"), alive.alias("alive"))
    trimmed = named.withColumn("end", F.rtrim("text", F.lit(BLANKS)))
    seen = F.row_number().over(W.partitionBy("conv_id", "alive", "role", "text").orderBy("turn"))
    initial = F.substring("role", 1, 1)
    known = F.when(initial.isin("s", "u", "a"), initial).otherwise(F.lit("o"))
    fault = F.when(~F.col("alive"), F.lit(None)).when(F.col("end") == "", "blank").when(seen > 1, "duplicate").when(~F.right(F.col("end"), F.lit(1)).isin(*ENDS), "truncated")
    out = trimmed.withColumn("fault", fault).drop("end")
    letter = F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", F.upper(known)).otherwise(known)
    return out.withColumn("letter", letter)


def conversations(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", present: str | None = None) -> DataFrame:
    """(conv_id, rows, signature, gaps, blank, duplicate, truncated, illegal): one row for each conversation."""
    faulty = _faulty(rows, conv_col, turn_col, role_col, text_col, present)
    grouped = faulty.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.when(F.col("alive"), F.struct("turn", "role", "text", "letter")))).alias("rows"),
        *[F.count_if(F.col("fault") == x).alias(x) for x in ("blank", "duplicate", "truncated")],
        F.max(F.when(F.col("alive"), F.col("turn"))).alias("last"), F.min(F.when(F.col("alive"), F.col("turn"))).alias("first"))
    turns = F.size(F.array_distinct(F.filter(F.transform("rows", lambda x: x["turn"]), lambda x: x.isNotNull())))
    initials = F.transform("rows", lambda x: F.substring(x["role"], 1, 1))
    pairs = F.zip_with(initials, F.slice(initials, 2, F.greatest(F.size("rows") - 1, F.lit(0))), lambda a, b: F.concat(a, b))
    return grouped.select(
        "conv_id", "rows", F.array_join(F.transform("rows", lambda x: x["letter"]), "").alias("signature"),
        F.coalesce(F.col("last") - F.col("first") + 1 - turns, F.lit(0)).cast("long").alias("gaps"), "blank", "duplicate", "truncated",
        # The last initial has no partner, so its pair is null and no fault.
        F.size(F.filter(pairs, lambda p: ~p.isin(*LEGAL))).cast("long").alias("illegal"))


def replay(rows: Column, audit: Column) -> Column:
    """The repaired turns, array<struct<role, text>>: each row takes the inserts before it and its own edit."""
    edits = F.regexp_extract_all(audit, F.lit("I*[DKR]"), F.lit(0))
    tail = F.regexp_extract(audit, "(I*)$", 1)
    text = F.lit("").alias("text")
    inserted = F.struct(F.lit("I").alias("edit"), F.lit("").alias("role"), text)

    def emitted(x):
        edit = F.right(x["edit"], F.lit(1))
        own = F.when(edit == "D", F.array().cast("array<struct<edit:string,role:string,text:string>>")).otherwise(F.array(F.struct(edit.alias("edit"), x["role"].alias("role"), x["text"].alias("text"))))
        return F.concat(F.array_repeat(inserted, F.length(x["edit"]) - 1), own)

    paired = F.zip_with(rows, edits, lambda r, e: F.struct(e.alias("edit"), r["role"].alias("role"), r["text"].alias("text")))
    items = F.concat(F.flatten(F.transform(paired, emitted)), F.array_repeat(inserted, F.length(tail)))
    # A one-element array binds the items to a name, so that they are built once.
    return F.transform(F.array(items), lambda bound: F.transform(bound, lambda t, i: _placed(t, i, bound)))[0]


def _placed(t: Column, i: Column, items: Column) -> Column:
    """An emitted turn with its role: kept, or user and assistant in turn, after the system row if one was kept."""
    head = F.get(items, F.lit(0))
    led = ((head["edit"] == "K") & head["role"].startswith("s")).cast("int")
    role = F.when(t["edit"] == "K", t["role"]).when((i - led) % 2 == 0, USER).otherwise(ASSISTANT)
    return F.struct(role.alias("role"), t["text"].alias("text"))


def _with_solutions(convs: DataFrame, solved: DataFrame) -> DataFrame:
    """convs (written) joined with solved by signature; common signatures are spread where solved is too large for a broadcast."""
    side = small_side(solved)
    if side is not solved:
        return convs.join(side, "signature")
    spread = convs.withColumn("salt", (F.xxhash64("conv_id") % SALTS + SALTS) % SALTS)
    return spread.join(solved.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), ["signature", "salt"]).drop("salt")


def repair(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", present: str | None = None) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, turns) of every conversation."""
    small_batches(rows.sparkSession)
    convs = written(conversations(rows, conv_col, turn_col, role_col, text_col, present), "repair-conversations")
    solved = convs.select("signature").distinct().select("signature", F.pandas_udf(_solutions, "cost long, audit string")("signature").alias("s")).select("signature", "s.cost", "s.audit")
    both = _with_solutions(convs, written(solved, "repair-signatures"))
    return both.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", replay(F.col("rows"), F.col("audit")).alias("turns"))
