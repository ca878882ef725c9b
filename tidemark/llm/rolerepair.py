"""Repair of damaged conversations by a generalised LR parse over the role grammar.

A conversation should read (s?(ua)+)?: nothing, or one system turn at most and then pairs of user and assistant turns. Its
LR table is fixed below. The parser's stacks share their lower nodes and are followed all at once: every row may be kept,
reroled or deleted, empty turns may be inserted anywhere, and each edit has a cost and an initial in the audit. Stacks with
equal tops accept the same endings, so of these only the one of minimum (cost, audit) goes on; at most one stack a state is
alive. Of two stacks of equal cost neither audit begins with the other (an insertion costs), so comparing beginnings is
enough. Whatever all live audits begin with is settled: those rows go into the digest and are let go, so a conversation is
read as a stream. Held for one conversation are its audit, which is part of the result, and 16 bytes for each distinct turn.

Rows are damaged and their blank and truncated texts found by DataFrame functions; each conversation's rows are streamed in
order within one partition.

Defined results: a null role or text, and a null conv_id or turn in the damage's key, count as one space; rows of a null
conv_id are one conversation; turns of equal number are ordered by role and text; repeated rows are duplicates; a
conversation of which the damage leaves no row has zeros, an empty audit and the digest of nothing; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os.path
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.sqltext import crc32

#: LR table of C -> s P | P | nothing, P -> P T | T, T -> u a: the state after a shift; symbol and length of the rule that a
#: state reduces; the state after a reduction; states in which a conversation may end.
SHIFT = {(0, "s"): 1, (0, "u"): 4, (1, "u"): 4, (2, "u"): 4, (6, "u"): 4, (4, "a"): 7}
REDUCE = {3: ("P", 1), 5: ("P", 2), 7: ("T", 2)}
GOTO = {(0, "P"): 2, (0, "T"): 3, (1, "P"): 6, (1, "T"): 3, (2, "T"): 5, (6, "T"): 5}
ACCEPT = {0, 2, 6}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
ROLE = {"u": "user", "a": "assistant"}
SPACES = " \t\n\x0b\x0c\r"
STOPS = ".!?"
SETTLE = 64
SCHEMA = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"

Stack = tuple  # (state, stack below)


def shifted(stack: Stack, role: str) -> Stack | None:
    """The stack after a turn of this role and all reductions; None where the grammar has no such turn."""
    state = SHIFT.get((stack[0], role))
    if state is None:
        return None
    stack = (state, stack)
    while stack[0] in REDUCE:
        symbol, length = REDUCE[stack[0]]
        for _ in range(length):
            stack = stack[1]
        stack = (GOTO[stack[0], symbol], stack)
    return stack


class Parse:
    """The live stacks of one conversation by top state, each with the least (cost, audit) that leads to it."""

    def __init__(self):
        self.live: dict[int, tuple[int, str, Stack]] = {}
        self._add(self.live, 0, "", (0, None))
        self._insert()

    @staticmethod
    def _add(live: dict[int, tuple[int, str, Stack]], cost: int, audit: str, stack: Stack | None) -> bool:
        if stack is None or stack[0] in live and live[stack[0]][:2] <= (cost, audit):
            return False
        live[stack[0]] = cost, audit, stack
        return True

    def _insert(self) -> None:
        todo = list(self.live.values())
        while todo:
            cost, audit, stack = todo.pop()
            for role in ROLE:
                to = shifted(stack, role)
                if self._add(self.live, cost + INSERT, audit + "I", to):
                    todo.append((cost + INSERT, audit + "I", to))

    def row(self, role: str, must_go: bool, truncated: bool) -> None:
        """Reads a row whose role has this initial."""
        live: dict[int, tuple[int, str, Stack]] = {}
        more = TRUNCATED if truncated else 0
        for cost, audit, stack in self.live.values():
            self._add(live, cost + DELETE, audit + "D", stack)
            if not must_go:
                self._add(live, cost + KEEP + more, audit + "K", shifted(stack, role))
                for to in ROLE:
                    self._add(live, cost + REROLE + more, audit + "R", shifted(stack, to))
        self.live = live
        self._insert()

    def settled(self) -> str:
        """What all live audits begin with; it is taken off them."""
        common = os.path.commonprefix([audit for _, audit, _ in self.live.values()])
        self.live = {s: (cost, audit[len(common) :], stack) for s, (cost, audit, stack) in self.live.items()}
        return common

    def best(self) -> tuple[int, str]:
        """Cost and (unsettled) audit of the cheapest way to end here."""
        return min(x[:2] for s, x in self.live.items() if s in ACCEPT)


class Conversation:
    """What is known of a conversation up to a row."""

    def __init__(self):
        self.parse, self.seen, self.waiting = Parse(), set(), []
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = self.pairs = 0
        self.least = self.most = self.last = None
        self.audit: list[str] = []
        self.sha, self.any = hashlib.sha256(), False

    def row(self, turn: int | None, role: str, text: str, key: tuple[int, int], blank: bool, cut: bool) -> None:
        again = key in self.seen
        self.seen.add(key)
        cut = cut and not blank and not again
        self.blank += blank
        self.duplicate += again and not blank
        self.truncated += cut
        if turn is not None and turn != self.most:  # rows come by turn
            self.least = turn if self.least is None else self.least
            self.most = turn
            self.turns += 1
        initial = role[:1]
        self.illegal += self.last is not None and self.last + initial not in ("su", "ua", "au")
        self.last = initial
        self.parse.row(initial, blank or again, cut)
        self.waiting.append((role, text))
        if len(self.waiting) % SETTLE == 0:
            self._settle(self.parse.settled())

    def _settle(self, audit: str) -> None:
        self.audit.append(audit)
        used = 0
        for edit in audit:
            if edit != "I":
                role, text = self.waiting[used]
                used += 1
            else:
                text = ""
            if edit == "D":
                continue
            if edit != "K":
                role = ROLE["ua"[self.pairs % 2]]
            self.pairs += role[:1] != "s"
            self.sha.update(f"{chr(10) * self.any}{role}:{text}".encode())
            self.any = True
        del self.waiting[:used]

    def result(self, conv_id: int | None) -> tuple:
        cost, rest = self.parse.best()
        self._settle(rest)
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.turns
        return conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, "".join(self.audit), self.sha.hexdigest()


def _repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation and turn to one row a conversation."""
    conv_id, now = None, None

    def out(done: list[tuple]) -> pa.RecordBatch:
        types = [pa.int64()] * 7 + [pa.string()] * 2
        return pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate(types)], [c.split()[0] for c in SCHEMA.split(", ")])

    for b in batches:
        done = []
        for c, gone, turn, role, text, k1, k2, blank, cut in zip(*(x.to_pylist() for x in b.columns), strict=True):
            if now is None or c != conv_id:
                if now is not None:
                    done.append(now.result(conv_id))
                conv_id, now = c, Conversation()
            if not gone:
                now.row(turn, role, text, (k1, k2), blank, cut)
        yield out(done)
    if now is not None:
        yield out([now.result(conv_id)])


def damage_code(conv_id: Column, turn: Column) -> Column:
    space = F.lit(" ")
    return F.crc32(F.concat(F.coalesce(conv_id.cast("string"), space), F.lit(":"), F.coalesce(turn.cast("string"), space)).cast("binary")) % 20


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, gone, turn, role and text after the damage. A dropped row stays with `gone` set and without its text, so
    that its conversation is known."""
    code = damage_code(F.col("conv_id"), F.col("turn"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")), code.alias("code"))
    text = F.when(F.col("code") <= 1, "").when(F.col("code") == 2, F.translate("text", STOPS, "")).otherwise(F.col("text"))
    role = F.when(F.col("code") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("code") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.select("conv_id", (F.col("code") == 0).alias("gone"), "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def repair(rows: DataFrame) -> DataFrame:
    """One row for each conversation of rows(conv_id, gone, turn, role, text)."""
    text = F.col("text")
    end = F.substring(F.rtrim(text, F.lit(SPACES)), -1, 1)
    flagged = rows.select("conv_id", "gone", "turn", "role", "text", F.xxhash64("role", "text").alias("k1"), F.xxhash64("text", "role").alias("k2"), (end == "").alias("blank"), ((end != "") & ~end.isin(*STOPS)).alias("cut"))
    return flagged.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(_repair, SCHEMA)


def repaired(conversations: DataFrame) -> DataFrame:
    """Damages all conversations and repairs them."""
    return repair(damaged(conversations))


def _least(*candidates: str) -> str:
    """SQL of the least struct (c, a, s) of those that are not null."""
    return f"list_aggregate(list_filter([{', '.join(candidates)}], lambda x: x IS NOT NULL), 'min')"


def _oracle() -> str:
    """The same by recursion over rows, with the least (cost, audit, repaired text) of four states: e nothing yet, s after the
    system turn, u after a user turn, a after an assistant turn."""
    add = lambda x, cost, edit, more="''": f"CASE WHEN {x} IS NULL THEN NULL ELSE {{'c': {x}.c + {cost}, 'a': {x}.a || '{edit}', 't': {x}.t || {more}}} END"
    when = lambda test, x: f"CASE WHEN {test} THEN {x} END"
    line = lambda role: f"CASE WHEN {{}}.t = '' THEN '' ELSE chr(10) END || {role} || ':' || r.text"
    more = f"CASE WHEN r.cut THEN {TRUNCATED} ELSE 0 END"
    kept = lambda x, role: when(f"NOT r.bad AND r.i = '{role}'", add(x, more, "K", line("r.role").format(x)))
    turned = lambda x, role: when("NOT r.bad", add(x, f"{REROLE} + {more}", "R", line(f"'{ROLE[role]}'").format(x)))
    new = {"e": [add("p.e", DELETE, "D")], "s": [add("p.s", DELETE, "D"), kept("p.e", "s")], "u": [add("p.u", DELETE, "D")], "a": [add("p.a", DELETE, "D"), kept("p.u", "a"), turned("p.u", "a")]}
    new["u"] += [f(f"p.{x}", "u") for x in "esa" for f in (kept, turned)]
    blank = lambda x, role: f"CASE WHEN {x}.t = '' THEN '' ELSE chr(10) END || '{ROLE[role]}:'"
    put = lambda x, role: add(x, INSERT, "I", blank(x, role))

    def closed(src: str) -> str:
        """Two rounds of insertions."""
        one = f"SELECT * REPLACE ({_least('u', *(put(x, 'u') for x in 'esa'))} AS u, {_least('a', put('u', 'a'))} AS a) FROM ({src})"
        return f"SELECT * REPLACE ({_least('u', *(put(x, 'u') for x in 'esa'))} AS u, {_least('a', put('u', 'a'))} AS a) FROM ({one})"

    step = ", ".join(f"{_least(*v)} AS {k}" for k, v in new.items())
    nothing = "CAST(NULL AS STRUCT(c BIGINT, a VARCHAR, t VARCHAR))"
    start = f"SELECT conv_id, CAST(0 AS BIGINT) AS n, CAST({{'c': 0, 'a': '', 't': ''}} AS STRUCT(c BIGINT, a VARCHAR, t VARCHAR)) AS e, {nothing} AS s, {nothing} AS u, {nothing} AS a FROM ids"
    trim = "rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
    return f"""
WITH RECURSIVE ids AS (SELECT DISTINCT conv_id FROM conversations),
coded AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc32("(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))")} % 20 AS code FROM conversations),
broken AS (SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role, CASE WHEN code = 1 THEN '' WHEN code = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(0, CASE WHEN code = 3 THEN 2 ELSE 1 END)) AS copy FROM coded WHERE code <> 0),
ordered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS n, {trim} = '' AS blank, right({trim}, 1) NOT IN ('.', '!', '?') AS open FROM broken),
again AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 AS dup, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY n) || left(role, 1) AS pair FROM ordered),
rows_ AS (SELECT *, left(role, 1) AS i, blank OR dup AS bad, open AND NOT blank AND NOT dup AS cut FROM again),
states AS ({closed(start)} UNION ALL {closed(f"SELECT p.conv_id, p.n + 1 AS n, {step} FROM states p JOIN rows_ r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.n = p.n + 1")}),
final AS (SELECT conv_id, {_least('e', 'a')} AS x FROM states QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY n DESC) = 1),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE dup AND NOT blank) AS duplicate, count(*) FILTER (WHERE cut) AS truncated, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal FROM rows_ GROUP BY conv_id)
SELECT f.conv_id, coalesce(k.gaps, 0) AS gaps, coalesce(k.blank, 0) AS blank, coalesce(k.duplicate, 0) AS duplicate, coalesce(k.truncated, 0) AS truncated, coalesce(k.illegal, 0) AS illegal, f.x.c AS cost, f.x.a AS audit, sha256(f.x.t) AS repaired_sha256
FROM final f LEFT JOIN counts k ON k.conv_id IS NOT DISTINCT FROM f.conv_id"""


ORACLE = _oracle()
