"""Repair of conversation structure by weighted interval parsing.

A repaired conversation reads ``(s?(ua)+)?``: nothing, or an optional system
turn and pairs of a user and an assistant turn.  The grammar is in Chomsky
normal form over spans of rows.  Its symbols T[p, r] stand for "the repaired
turns of this span lead from p to r", with p and r among: nothing yet, after a
system turn, after a user turn, after an assistant turn::

    T[p, r] -> T[p, q] T[q, r]          (any p, q, r)
    T[p, r] -> keep | rerole | delete   (one row)
    T[p, r] -> insert insert ...        (no row: the insertion closure)

A cell of a span holds the cheapest (cost, audit) of each symbol, the audit
being the edits' initials; of equal costs the least in ASCII.  Cells are closed
under insertion on both sides and combined bottom-up by span length (1, 2, 4
...).  Every symbol may be cut at any row, so one cut of a span is enough and a
conversation of n rows takes n - 1 combinations.  Keeping only the least audit
is exact: audits of one span and one cost are never prefixes of each other (a
longer one would hold more insertions), so their order outlasts any
continuation.

Rows with one conversation, turn, role and text are counted together before
anything is shuffled.  The parse sees roles and faults only; texts pass once
more, in order, behind their conversation's audit, and are never gathered.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ferret.llm.common import LONG, STR, byte_batches, schema, stored, table

KEEP, REROLE, DELETE, INSERT, CUT = 0, 3, 4, 3, 3
# What counts as blank, and what ends a whole text.
BLANKS = " \t\n\x0b\x0c\r"
ENDS = (".", "!", "?")
START, SYSTEM, USER, ASSISTANT = range(4)
# state -> state by the initial of a repaired turn
NEXT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
STATES = range(4)

Cell = dict[tuple[int, int], tuple[int, str]]


def combine(left: Cell, right: Cell) -> Cell:
    """The cell of two neighbouring spans together: T[p, r] -> T[p, q] T[q, r]."""
    out: Cell = {}
    for (p, q), (c, x) in left.items():
        for r in STATES:
            y = right.get((q, r))
            if y is None:
                continue
            have = out.get((p, r))
            if have is None or c + y[0] < have[0] or (c + y[0] == have[0] and x + y[1] < have[1]):
                out[p, r] = (c + y[0], x + y[1])
    return out


@cache
def closure() -> Cell:
    """The cell of no rows: cheapest insertions from each state to each other."""
    cell: Cell = {(p, p): (0, "") for p in STATES}
    step = cell | {(p, r): (INSERT, "I") for a in "ua" for p, r in NEXT[a].items()}
    while (more := combine(cell, step)) != cell:
        cell = more
    return cell


@cache
def leaf(initial: str, fault: str) -> Cell:
    """The closed cell of one row by its role's initial and its first fault ('', 'blank', 'duplicate', 'truncated')."""
    cell: Cell = {(p, p): (DELETE, "D") for p in STATES}
    if fault not in ("blank", "duplicate"):
        extra = CUT if fault == "truncated" else 0
        for letter, cost, roles in (("R", REROLE, "ua"), ("K", KEEP, initial)):
            for role in roles:
                for p, r in NEXT.get(role, {}).items():
                    if (p, r) not in cell or (cost + extra, letter) < cell[p, r]:
                        cell[p, r] = (cost + extra, letter)
    return combine(combine(closure(), cell), closure())


def power(cell: Cell, n: int) -> Cell:
    """The cell of ``n`` equal rows side by side."""
    out = None
    while n:
        if n & 1:
            out = cell if out is None else combine(out, cell)
        cell, n = (combine(cell, cell) if n > 1 else cell), n >> 1
    return out


class Parse:
    """Bottom-up parse of rows that arrive in order; holds cells of growing spans only."""

    def __init__(self):
        self.spans: list[tuple[int, Cell]] = []

    def add(self, cell: Cell, n: int = 1) -> None:
        self.spans.append((n, power(cell, n)))
        while len(self.spans) > 1 and self.spans[-1][0] >= self.spans[-2][0]:
            self._join()

    def _join(self) -> None:
        (m, right), (n, left) = self.spans.pop(), self.spans.pop()
        self.spans.append((n + m, combine(left, right)))

    def best(self) -> tuple[int, str]:
        """Cheapest (cost, audit) that gives no turns or ends after an assistant turn."""
        while len(self.spans) > 1:
            self._join()
        cell = self.spans[0][1] if self.spans else closure()
        return min(cell[START, r] for r in (START, ASSISTANT) if (START, r) in cell)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (conversation, initial, blank, cut, first, copies) in order -> one row per conversation."""
    names = ["conv_id", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    now, parse, counts, last = None, None, None, ""

    def close():
        cost, audit = parse.best()
        return (now, counts["blank"], counts["duplicate"], counts["truncated"], counts["illegal"], cost, audit)

    for batch in batches:
        done = []
        for conv, initial, blank, cut, first, n in zip(*(c.to_pylist() for c in batch.columns)):
            if parse is None or conv != now:
                if parse is not None:
                    done.append(close())
                now, parse, counts, last = conv, Parse(), dict.fromkeys(names[1:5], 0), None
            fault = "blank" if blank else "truncated" if cut else ""
            for f, k in (((fault, n),) if blank else ((fault, 1), ("duplicate", n - 1)) if first else (("duplicate", n),)):
                if k:
                    parse.add(leaf(initial, f), k)
                    if f:
                        counts[f] += k
            counts["illegal"] += (last is not None and last + initial not in ("su", "ua", "au")) + n - 1
            last = initial
        if done:
            yield _answers(done, names, batch.schema.field(0).type)
    if parse is not None:
        yield _answers([close()], names, batch.schema.field(0).type)


def _answers(rows: list, names: list[str], key: pa.DataType) -> pa.RecordBatch:
    types = [key, *[pa.int64()] * 5, pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def _rows(conversations: DataFrame) -> DataFrame:
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), filled("role"), filled("text"))
    return rows.withColumn("h", F.unhex(F.sha2("text", 256)))


def audits(conversations: DataFrame) -> DataFrame:
    """One row per conversation: (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit).

    Rows are taken by turn (nulls first), equal turns by role and a hash of the
    text.  A row's first fault counts: blank (no character but blanks of ASCII),
    duplicate (role and text stand earlier), truncated (its last such character
    is none of ``.!?``).  ``gaps`` are turn numbers missing between the least and
    the largest, ``illegal`` the neighbours whose role initials are not su, ua
    or au.  Null roles and texts are one blank; a null id is a conversation of
    its own; repeated rows are duplicates; an empty table gives no rows; other
    columns are not read.  A role of no letters can only be rerole or deleted.
    One conversation is parsed by one task, which sees roles and faults only (a
    few bytes a row); long texts stay where they are.
    """
    byte_batches(conversations.sparkSession)
    bare = F.rtrim(F.col("text"), F.lit(BLANKS))
    light = (_rows(conversations).groupBy("conv_id", "turn", "role", "h")
             .agg(F.count("*").alias("n"), F.max(bare == "").alias("blank"), F.max(~F.right(bare, F.lit(1)).isin(*ENDS)).alias("cut")))
    place = F.struct(F.col("turn").isNotNull().alias("k"), F.col("turn").alias("turn"))
    first = light.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("h").alias("x")).agg(F.min(place).alias("f"))
    light = light.join(first, F.expr("conv_id <=> c and role = r and h = x")).withColumn("first", F.col("f.turn").eqNullSafe(F.col("turn")))
    rows = light.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "h").select(
        "conv_id", F.substring("role", 1, 1).alias("initial"), "blank", "cut", "first", "n")
    out = rows.mapInArrow(_parse, schema(conv_id=conversations.schema["conv_id"].dataType, blank=LONG, duplicate=LONG, truncated=LONG, illegal=LONG, cost=LONG, audit=STR))
    span = conversations.groupBy(F.col("conv_id").alias("c")).agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"))
    return out.join(span, F.expr("conv_id <=> c")).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conversation, role, text) of the repaired turns; an audit's row comes before its conversation's rows.

    A role of None marks the end of a conversation.
    """
    now, audit, at, state = None, None, 0, START

    def forced():
        # the role that may be set or inserted at this place
        return "assistant" if state == USER else "user"

    def take(role):
        nonlocal state
        state = NEXT[role[:1]][state]
        return role

    for batch in batches:
        for conv, kind, role, text in zip(*(c.to_pylist() for c in batch.columns)):
            if kind == 0:
                if audit is not None:
                    while at < len(audit):
                        yield now, take(forced()), ""
                        at += 1
                    yield now, None, None
                now, audit, at, state = conv, text, 0, START
                continue
            while audit[at] == "I":
                yield now, take(forced()), ""
                at += 1
            if audit[at] != "D":
                yield now, take(forced() if audit[at] == "R" else role), text
            at += 1
    if audit is not None:
        while at < len(audit):
            yield now, take(forced()), ""
            at += 1
        yield now, None, None


def _ordered(conversations: DataFrame, audited: DataFrame) -> DataFrame:
    """Each conversation's audit followed by its rows in the order of the parse, streamed by one task, never gathered."""
    none = lambda t: F.lit(None).cast(t)
    rows = _rows(conversations).select("conv_id", F.lit(1).alias("kind"), "turn", "role", "h", "text")
    heads = audited.select("conv_id", F.lit(0).alias("kind"), none("long").alias("turn"), none("string").alias("role"),
                           none("binary").alias("h"), F.col("audit").alias("text"))
    return (heads.unionByName(rows).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "h")
            .select("conv_id", "kind", "role", "text"))


def repair(conversations: DataFrame, audited: DataFrame) -> DataFrame:
    """(conv_id, pos, role, text): the turns of the repaired conversations, as ``audited`` (of :func:`audits`) says."""
    key = conversations.schema["conv_id"].dataType
    arrow = to_arrow_type(key)

    def turns(batches):
        pos, rows = 0, []
        for conv, role, text in _turns(batches):
            if role is None:
                pos = 0
                continue
            rows.append((conv, pos, role, text))
            pos += 1
            if len(rows) >= 2000:
                yield _turn_rows(rows, arrow)
                rows = []
        if rows:
            yield _turn_rows(rows, arrow)

    byte_batches(conversations.sparkSession)
    return _ordered(conversations, audited).mapInArrow(turns, schema(conv_id=key, pos=LONG, role=STR, text=STR))


def _turn_rows(rows: list, key: pa.DataType) -> pa.RecordBatch:
    conv, pos, role, text = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(conv, key), pa.array(pos, pa.int64()), pa.array(role, pa.string()), pa.array(text, pa.string())],
                                      names=["conv_id", "pos", "role", "text"])


def digests(conversations: DataFrame, audited: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): hash of the repaired ``role:text`` lines, fed turn by turn."""
    key = conversations.schema["conv_id"].dataType
    arrow = to_arrow_type(key)

    def hashed(batches):
        sha, first, ids, out = hashlib.sha256(), True, [], []
        for conv, role, text in _turns(batches):
            if role is None:
                ids.append(conv)
                out.append(sha.hexdigest())
                sha, first = hashlib.sha256(), True
                if len(out) >= 2000:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, arrow), pa.array(out, pa.string())], names=["conv_id", "repaired_sha256"])
                    ids, out = [], []
            else:
                sha.update(f"{'' if first else chr(10)}{role}:{text}".encode())
                first = False
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(ids, arrow), pa.array(out, pa.string())], names=["conv_id", "repaired_sha256"])

    byte_batches(conversations.sparkSession)
    return _ordered(conversations, audited).mapInArrow(hashed, schema(conv_id=key, repaired_sha256=STR))


def damaged(conversations: DataFrame) -> DataFrame:
    """``conversations`` with faults made by crc32 of ``conv_id:turn`` modulo 20; nulls are one blank."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), h.alias("d")).where("d <> 0")
    return rows.select(
        "conv_id", "turn", F.when(F.col("d") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("d") == 1, F.lit("")).when(F.col("d") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("d") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def op13_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "conversations")
    rows = damaged(base)
    found = stored(audits(rows), "turns-audits")
    out = found.join(digests(rows, found).withColumnRenamed("conv_id", "of"), F.expr("conv_id <=> of")).drop("of")
    every = base.select(F.col("conv_id").alias("every")).distinct()
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return every.join(out, F.expr("every <=> conv_id"), "left").select(
        F.col("every").alias("conv_id"), *[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


#: The same repair as a left-to-right table of cheapest edits by state.
OP13_SQL = """
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
hashed AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(k, ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
    lambda h, e: CASE WHEN xor(h, e) & 1 = 1 THEN xor(xor(h, e) >> 1, 3988292384::BIGINT) ELSE xor(h, e) >> 1 END), 4294967295::BIGINT) % 20 AS d
  FROM keyed),
damaged AS (
  SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN d = 1 THEN '' WHEN d = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(CASE WHEN d = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM hashed WHERE d <> 0),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen,
    rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare
  FROM damaged),
f AS (
  SELECT conv_id, turn, role, text, i, substr(role, 1, 1) AS ini,
    lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS prev,
    CASE WHEN bare = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
  FROM numbered),
moves(p, c, r) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (3, 'u', 2), (2, 'a', 3)),
ins(p, r, cost, audit) AS (VALUES (0, 0, 0, ''), (1, 1, 0, ''), (2, 2, 0, ''), (3, 3, 0, ''), (0, 2, 3, 'I'), (0, 3, 6, 'II'),
  (1, 2, 3, 'I'), (1, 3, 6, 'II'), (2, 3, 3, 'I'), (3, 2, 3, 'I')),
edits AS (
  SELECT p, p AS r, 4 AS cost, 'D' AS letter, NULL AS c FROM (VALUES (0), (1), (2), (3)) t(p)
  UNION ALL SELECT p, r, 0, 'K', c FROM moves
  UNION ALL SELECT p, r, 3, 'R', NULL FROM moves WHERE c <> 's'),
dp AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, ins.r AS st, {'c': ins.cost, 'a': ins.audit} AS best
  FROM (SELECT DISTINCT conv_id FROM f) CROSS JOIN ins WHERE ins.p = 0
  UNION ALL
  SELECT f.conv_id, f.i, ins.r, min({'c': dp.best.c + e.cost + ins.cost + CASE WHEN e.letter <> 'D' AND f.fault = 'truncated' THEN 3 ELSE 0 END,
    'a': dp.best.a || e.letter || ins.audit})
  FROM dp JOIN f ON f.conv_id IS NOT DISTINCT FROM dp.conv_id AND f.i = dp.i + 1
  JOIN edits e ON e.p = dp.st AND (e.letter = 'D' OR f.fault NOT IN ('blank', 'duplicate')) AND (e.c IS NULL OR e.c = f.ini)
  JOIN ins ON ins.p = e.r
  GROUP BY f.conv_id, f.i, ins.r),
sizes AS (
  SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
    count(*) FILTER (WHERE fault = 'truncated') AS truncated,
    count(*) FILTER (WHERE i > 1 AND prev || ini NOT IN ('su', 'ua', 'au')) AS illegal
  FROM f GROUP BY conv_id),
final AS (
  SELECT s.conv_id, min(dp.best) AS best FROM sizes s JOIN dp ON dp.conv_id IS NOT DISTINCT FROM s.conv_id AND dp.i = s.n
  WHERE dp.st IN (0, 3) GROUP BY s.conv_id),
letters AS (
  SELECT conv_id, unnest(string_split(best.a, '')) AS letter, generate_subscripts(string_split(best.a, ''), 1) AS pos FROM final),
placed AS (
  SELECT l.conv_id, l.pos, l.letter, f.role, f.text, f.ini FROM
    (SELECT *, sum((letter <> 'I')::INT) OVER (PARTITION BY conv_id ORDER BY pos) AS i FROM letters WHERE letter <> '') l
  LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM l.conv_id AND f.i = l.i AND l.letter <> 'I'),
turns AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS k,
    first_value(letter = 'K' AND ini = 's') OVER (PARTITION BY conv_id ORDER BY pos) AS sys
  FROM placed WHERE letter <> 'D'),
texts AS (
  SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (k + sys::INT) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''),
    chr(10) ORDER BY pos) AS body
  FROM turns GROUP BY conv_id)
SELECT o.conv_id, coalesce(s.gaps, 0) AS gaps, coalesce(s.blank, 0) AS blank, coalesce(s.duplicate, 0) AS duplicate,
  coalesce(s.truncated, 0) AS truncated, coalesce(s.illegal, 0) AS illegal, CAST(coalesce(n.best.c, 0) AS BIGINT) AS cost,
  coalesce(n.best.a, '') AS audit, sha256(coalesce(t.body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN sizes s ON s.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN final n ON n.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN texts t ON t.conv_id IS NOT DISTINCT FROM o.conv_id
"""
