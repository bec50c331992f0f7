"""Repair of conversation structure by shortest paths over small costs (operator 11).

A sound conversation has the role initials (s?(ua)+)? and no faulty rows. The states of
that pattern, at each place between rows, are the nodes of a graph; its arcs are edits:

    K  keep a row that fits                         0
    R  give it the role that fits, user or assistant   3
    D  delete it (all that is allowed for a blank or duplicate row)   4
    I  insert an empty row of the role that fits    3
    K and R of a truncated row cost 3 more

Dial's algorithm runs from the goals backwards with a ring of seven buckets, as no arc
costs more than six, and records each node's distance. The audit is then walked from the
start: of the tight arcs, along which the distance falls by the arc's cost, always the
least letter. Each letter leads to one node, so the audit is the least in ASCII order of
the cheapest ones, and it alone says what the repaired conversation is.

A conversation is one stream in one task, since its repair is a path through all of it
and its digest is of all of it. Its rows pass twice in Spark's own order, first without
their texts, of which four distances and two bytes a row are held, then with them, of
which one row is held at a time. Duplicates are found by a window over equal rows.

Cases: rows of a null conv_id are one conversation; a null turn comes first and counts in
no gap; a null role or text is one space; rows of one turn stand by role and text;
a role counts by its first character, an empty one fits nowhere; a conversation without
rows (all of them dropped) has an empty audit and the digest of the empty text; extra
columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.sources.tables import table

BLANKS = " \t\n\x0b\x0c\r"
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: One more than the dearest arc.
RING = REROLE + TRUNCATED + 1
START, SYSTEM, USER, ASSISTANT = range(4)
_FAR = 1 << 30
_ROLE = {USER: "user", ASSISTANT: "assistant"}
#: The state that an inserted or reroled row leads to, and for each initial the state that a kept row leads to (None: it doesn't fit).
_NEXT = (USER, USER, ASSISTANT, USER)
_KEPT = {"s": (SYSTEM, None, None, None), "u": (USER, USER, None, USER), "a": (None, None, ASSISTANT, None)}
_CLASSES = (None, "s", "u", "a")
#: A row's code: the class of its initial, then whether it must go, then whether it is truncated.
_GONE, _CUT = 4, 8


def code_of(role: str, fault: str) -> int:
    return "sua".find(role[:1] or "-") + 1 | _GONE * (fault in ("blank", "duplicate")) | _CUT * (fault == "truncated")


def _steps(code: int) -> list[list[tuple[int, int]]]:
    """For each state, the states and costs from which a row of this code leads to it."""
    into: list[list[tuple[int, int]]] = [[(s, DELETE)] for s in range(4)]
    if not code & _GONE:
        extra = TRUNCATED if code & _CUT else 0
        kept = _KEPT.get(_CLASSES[code & 3], (None,) * 4)
        for s in range(4):
            if kept[s] is not None:
                into[kept[s]].append((s, extra))
            into[_NEXT[s]].append((s, REROLE + extra))
    return into


_INTO = [_steps(code) for code in range(16)]
_INSERTED = [[s for s in range(4) if _NEXT[s] == t] for t in range(4)]


def distances(codes: bytes) -> array:
    """The cost from each node (4 * rows passed + state) to the nearest goal."""
    n = len(codes)
    dist = array("i", [_FAR]) * (4 * n + 4)
    ring: list[list[int]] = [[] for _ in range(RING)]
    for goal in (4 * n + START, 4 * n + ASSISTANT):
        dist[goal] = 0
        ring[0].append(goal)
    at, waiting = 0, 2
    while waiting:
        bucket = ring[at % RING]
        while bucket:
            node = bucket.pop()
            waiting -= 1
            if dist[node] != at:  # it was reached for less
                continue
            passed, state = divmod(node, 4)
            for s in _INSERTED[state]:
                near = node - state + s
                if at + INSERT < dist[near]:
                    dist[near] = at + INSERT
                    ring[(at + INSERT) % RING].append(near)
                    waiting += 1
            if passed:
                for s, cost in _INTO[codes[passed - 1]][state]:
                    near = 4 * passed - 4 + s
                    if at + cost < dist[near]:
                        dist[near] = at + cost
                        ring[(at + cost) % RING].append(near)
                        waiting += 1
        at += 1
    return dist


def audit_of(codes: bytes) -> tuple[int, str]:
    """The cost of the cheapest edits, and the least audit of those."""
    dist, n = distances(codes), len(codes)
    letters, passed, state = bytearray(), 0, START
    while passed < n or state not in (START, ASSISTANT):
        here, to = dist[4 * passed + state], _NEXT[state]
        code = codes[passed] if passed < n else None
        extra = TRUNCATED if code is not None and code & _CUT else 0
        kept = None if code is None or code & _GONE else _KEPT.get(_CLASSES[code & 3], (None,) * 4)[state]
        if code is not None and here == DELETE + dist[4 * passed + 4 + state]:
            letters += b"D"
            passed += 1
        elif here == INSERT + dist[4 * passed + to]:
            letters += b"I"
            state = to
        elif kept is not None and here == extra + dist[4 * passed + 4 + kept]:
            letters += b"K"
            passed, state = passed + 1, kept
        else:
            letters += b"R"
            passed, state = passed + 1, to
    return dist[START], letters.decode()


def damaged(rows: DataFrame) -> DataFrame:
    """The rows of `conversations` with a fault put into some of them; a dropped row stays, marked `dropped`."""
    plain = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hurt = plain.withColumn("how", F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn"))) % 20)
    hurt = hurt.withColumn("text", F.when(F.col("how") == 1, "").when(F.col("how") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")))
    hurt = hurt.withColumn("role", F.when(F.col("how") == 4, "user").otherwise(F.col("role"))).withColumn("dropped", F.col("how") == 0)
    return hurt.withColumn("copy", F.explode(F.when(F.col("how") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).select("conv_id", "turn", "role", "text", "dropped")


def _fault(text: Column, nth: Column) -> Column:
    """The first fault of a row; null for none."""
    bare = F.rtrim(text, F.lit(BLANKS))
    return F.when(bare == "", "blank").when(nth > 1, "duplicate").when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), "truncated")


def _stream(rows: DataFrame) -> DataFrame:
    """Each conversation's rows in order, first without their texts, then with them. rows: conv_id, turn, role, text, dropped (bool)."""
    seen = Window.partitionBy("conv_id", "dropped", "role", "text").orderBy(F.asc_nulls_first("turn"))
    judged = rows.repartition("conv_id").withColumn("nth", F.row_number().over(seen)).withColumn("fault", F.when(F.col("dropped"), "dropped").otherwise(F.coalesce(_fault(F.col("text"), F.col("nth")), F.lit(""))))
    # Rows of one turn stand by role and text; the text itself is only needed to order them, so its place among them goes along.
    order = (F.asc_nulls_first("turn"), "role", "text", "nth")
    placed = judged.withColumn("place", F.row_number().over(Window.partitionBy("conv_id").orderBy(*order)))
    twice = placed.withColumn("pass", F.explode(F.array(F.lit(0), F.lit(1))))
    light = twice.select("conv_id", "pass", "place", "turn", "role", F.when(F.col("pass") == 1, F.col("text")).alias("text"), "fault")
    return light.sortWithinPartitions(F.asc_nulls_first("conv_id"), "pass", "place")


class _Conversation:
    """What is held of one conversation while its rows pass."""

    def __init__(self, conv_id: int | None) -> None:
        self.conv_id = conv_id
        self.codes = bytearray()
        self.low = self.high = self.last = None
        self.turns = self.illegal = 0
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.before: str | None = None
        self.cost, self.audit, self.at, self.state = 0, None, 0, START

    def note(self, turn: int | None, role: str, fault: str) -> None:
        """The first pass."""
        if fault == "dropped":
            return
        self.codes.append(code_of(role, fault))
        if fault:
            self.faults[fault] += 1
        if self.before is not None and self.before + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = role[:1]
        if turn is not None:
            self.turns += turn != self.last
            self.low, self.high, self.last = turn if self.low is None else self.low, turn, turn

    def solve(self) -> None:
        self.cost, self.audit = audit_of(bytes(self.codes))

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        """(edit, role, text) of the rows that are inserted before the next one."""
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            self.state = _NEXT[self.state]
            yield "I", _ROLE[self.state], ""

    def edited(self, role: str, text: str) -> tuple[str, str, str]:
        """(edit, role, text) of the next row of the second pass."""
        letter = self.audit[self.at]
        self.at += 1
        if letter == "K":
            self.state = _KEPT[role[0]][self.state]
        elif letter == "R":
            self.state = _NEXT[self.state]
            role = _ROLE[self.state]
        return letter, role, text

    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.turns


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Conversation, tuple[str, str, str] | None]]:
    """Each conversation with each of its edited rows in order, and with None at its end."""
    now: _Conversation | None = None
    for batch in batches:
        for conv_id, turned, _, turn, role, text, fault in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now is None or conv_id != now.conv_id:
                if now is not None:
                    yield from _rest(now)
                now = _Conversation(conv_id)
            if turned == 0:
                now.note(turn, role, fault)
                continue
            if now.audit is None:
                now.solve()
            if fault != "dropped":
                for row in now.inserted():
                    yield now, row
                yield now, now.edited(role, text)
    if now is not None:
        yield from _rest(now)


def _rest(now: _Conversation) -> Iterator[tuple[_Conversation, tuple[str, str, str] | None]]:
    for row in now.inserted():
        yield now, row
    yield now, None


def _batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 1000, most_chars: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    held, chars = [], 0
    for row in rows:
        held.append(row)
        chars += sum(len(x) for x in row if isinstance(x, str))
        if len(held) >= most or chars >= most_chars:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, chars = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        place = 0
        for conversation, row in _walk(batches):
            place = 0 if row is None else place + 1
            if row is not None:
                yield conversation.conv_id, place - 1, *row

    yield from _batches(rows(), pa.schema([("conv_id", pa.int64()), ("step", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())]))


_SUMMARY = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        digest, first = hashlib.sha256(), True
        for c, row in _walk(batches):
            if row is None:
                yield c.conv_id, c.gaps(), *c.faults.values(), c.illegal, c.cost, c.audit, digest.hexdigest()
                digest, first = hashlib.sha256(), True
            elif row[0] != "D":
                digest.update(f"{'' if first else chr(10)}{row[1]}:{row[2]}".encode("utf-8", "surrogatepass"))
                first = False

    yield from _batches(rows(), pa.schema([("conv_id", pa.int64()), *((x, pa.int64()) for x in _SUMMARY), ("audit", pa.string()), ("repaired_sha256", pa.string())]))


def repaired_turns(rows: DataFrame) -> DataFrame:
    """conv_id, step, edit, role, text: every edit in order; what isn't deleted is the repaired conversation."""
    return _stream(_undamaged(rows)).mapInArrow(_turns, "conv_id bigint, step bigint, edit string, role string, text string")


def repairs(rows: DataFrame) -> DataFrame:
    """A row per conversation: its faults, the cost and audit of its repair, and the digest of the repaired text."""
    return _stream(_undamaged(rows)).mapInArrow(_summaries, "conv_id bigint, " + ", ".join(f"{x} bigint" for x in _SUMMARY) + ", audit string, repaired_sha256 string")


def _undamaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and dropped, without nulls in the last three."""
    dropped = F.col("dropped") if "dropped" in rows.columns else F.lit(False)
    return rows.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), dropped.alias("dropped"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation of the table, damaged by a fixed rule and repaired."""
    return repairs(damaged(table(spark, sf_dir, "conversations")))


#: The cheapest edits row by row: of each state's edits so far the cheapest and then least, which a common rest keeps in order.
ORACLE = r"""
WITH RECURSIVE tab(i, k, v) AS (
  SELECT i, 0, i FROM range(256) t(i)
  UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM tab WHERE k < 8
), crc AS (
  SELECT list(v ORDER BY i) AS tl FROM tab WHERE k = 8
), named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations
), hashed AS (
  SELECT conv_id, turn, role, text,
    xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], [CAST(ascii(x) AS BIGINT) FOR x IN string_split(name, '')]), lambda c, b: xor(tl[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 20 AS how
  FROM named, crc
), hurt AS (
  SELECT conv_id, turn, CASE WHEN how = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN how = 1 THEN '' WHEN how = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN how = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM hashed WHERE how <> 0
), judged AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth, regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS bare
  FROM hurt
), rows_ AS (
  SELECT *, left(role, 1) AS x, CASE WHEN bare = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before
  FROM judged
), facts AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before IS NOT NULL AND before || x NOT IN ('su', 'ua', 'au')) AS illegal
  FROM rows_ GROUP BY conv_id
), ins(s, t, dear, letters, made) AS (
  VALUES (0, 0, 0, '', ''), (1, 1, 0, '', ''), (2, 2, 0, '', ''), (3, 3, 0, '', ''), (0, 2, 3, 'I', chr(10) || 'user:'), (1, 2, 3, 'I', chr(10) || 'user:'), (3, 2, 3, 'I', chr(10) || 'user:'),
    (2, 3, 3, 'I', chr(10) || 'assistant:'), (0, 3, 6, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'), (1, 3, 6, 'II', chr(10) || 'user:' || chr(10) || 'assistant:')
), arcs(s, edit, x, t) AS (
  VALUES (0, 'K', 's', 1), (0, 'K', 'u', 2), (1, 'K', 'u', 2), (3, 'K', 'u', 2), (2, 'K', 'a', 3), (0, 'R', NULL, 2), (1, 'R', NULL, 2), (3, 'R', NULL, 2), (2, 'R', NULL, 3),
    (0, 'D', NULL, 0), (1, 'D', NULL, 1), (2, 'D', NULL, 2), (3, 'D', NULL, 3)
), walk(conv_id, i, s, best) AS (
  SELECT conv_id, CAST(0 AS BIGINT), t, {'cost': CAST(dear AS BIGINT), 'audit': letters, 'made': made} FROM facts, ins WHERE ins.s = 0
  UNION ALL
  SELECT conv_id, i, t, min({'cost': CAST(cost + dear AS BIGINT), 'audit': audit || letters, 'made': put || made}) FROM (
    SELECT w.conv_id, w.i + 1 AS i, a.t AS s, w.best.audit || a.edit AS audit,
      w.best.cost + CASE a.edit WHEN 'D' THEN 4 WHEN 'R' THEN 3 ELSE 0 END + CASE WHEN a.edit <> 'D' AND r.fault = 'truncated' THEN 3 ELSE 0 END AS cost,
      w.best.made || CASE a.edit WHEN 'D' THEN '' WHEN 'K' THEN chr(10) || r.role || ':' || r.text ELSE chr(10) || (CASE a.t WHEN 2 THEN 'user' ELSE 'assistant' END) || ':' || r.text END AS put
    FROM walk w JOIN rows_ r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i + 1 JOIN arcs a ON a.s = w.s
    WHERE (a.edit = 'D' OR r.fault IS NULL OR r.fault = 'truncated') AND (a.edit <> 'K' OR a.x = r.x)
  ) p JOIN ins USING (s) GROUP BY conv_id, i, t
), done AS (
  SELECT w.conv_id, min(best) AS best FROM walk w JOIN facts f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.n = w.i WHERE w.s IN (0, 3) GROUP BY w.conv_id
)
SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
  CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(d.best.cost, 0) AS BIGINT) AS cost, coalesce(d.best.audit, '') AS audit, sha256(coalesce(substr(d.best.made, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN done d ON d.conv_id IS NOT DISTINCT FROM c.conv_id
"""
