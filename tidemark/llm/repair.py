"""Conversation structure repair (operator 11): Wagner-Fischer alignment of turns to an alternating grammar.

A repaired conversation's role initials are `(s?(ua)+)?`. Turns are aligned to the grammar's string of every feasible
length: all strings of one start share their suffixes, so that one table over (turns left, characters left) holds the
costs of all lengths. Only cells are computed that an alignment of at most the incumbent cost can pass (Ukkonen's
band: a cell off the diagonal takes deletions or insertions to come back); the band's first run gives the incumbent,
a second one its exact band. Every length of least cost is backtraced from the first turn on, taking the edit of the
least initial that keeps the cost, and the audits are compared. Conversations of one length are aligned together; every
so many rows of the table are kept and the others made anew, so memory grows with the root of the turns.

Spark sorts the turns of each conversation and streams them twice: only a byte a turn is gathered for the alignment,
and texts pass by batches when the edits are applied, however long a conversation is.

Defined results: a null role or text is one space; a null conv_id is a conversation of its own; turns of equal number
are taken by role, then text; a null turn comes first. A role with another initial, or none, is kept nowhere. Repeated
rows count as often as they are there. An empty table gives no rows; a conversation without rows has zeros.
"""

from __future__ import annotations

import hashlib
from math import isqrt

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
_FAR = 1 << 28
_BLANKS = " \t\n\x0b\x0c\r"
#: Table cells of one alignment at once, and turns of conversations gathered for one.
CELLS, GATHERED = 4_000_000, 200_000

DAMAGED = "conv_id long, turn long, role string, text string, alive boolean"


def damage(conversations: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """conv_id, turn, role, text, alive: the rows after damage by crc32 of `conv_id:turn`; a dropped row stays, not alive
    and without role and text, so that its conversation is known."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(F.col(id_col).cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), blank("role").alias("role"), blank("text").alias("text"))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20
    rows = rows.withColumn("kind", kind).withColumn("alive", F.col("kind") != 0)
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.select("conv_id", "turn", F.when(F.col("alive"), role).alias("role"), F.when(F.col("alive"), text).alias("text"), "alive", copies.alias("copy")).drop("copy")


def _kind(role: Column) -> Column:
    """0, 1, 2 for initials s, u, a; 3 for others."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for k, v in enumerate("sua") for x in (v, k)]), F.substring(role, 1, 1)), F.lit(3))


def _faults(damaged: DataFrame) -> DataFrame:
    """Rows in order within partitions by conv_id: (conv_id, turn, alive, kind, fault); fault 1 blank, 2 duplicate,
    3 truncated, 0 none."""
    seen = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy(F.asc_nulls_first("turn")))
    end = F.substring(F.rtrim(F.col("text"), F.lit(_BLANKS)), -1, 1)
    fault = F.when(end == "", 1).when(F.col("seen") > 1, 2).when(~end.isin(".", "!", "?"), 3).otherwise(0)
    rows = damaged.repartition("conv_id").withColumn("seen", seen).sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text", "seen")
    return rows.select("conv_id", "turn", "alive", _kind(F.col("role")).alias("kind"), F.coalesce(fault, F.lit(0)).alias("fault"))


class _Band:
    """The table of conversations of n turns each, in the band of cost `limit`. codes: [conversation, turn], a turn's
    kind, 4 more if it is truncated."""

    def __init__(self, codes: np.ndarray, limit: int):
        self.codes, self.n = codes, codes.shape[1]
        self.low = limit // 2 + 1
        self.offset = np.arange(self.low + limit // 5 + 1)
        self.step = isqrt(self.n) + 1

    def left(self, i: int) -> np.ndarray:
        """Characters left in each cell of row i."""
        return self.n - i - self.low + self.offset

    def end(self) -> tuple[np.ndarray, np.ndarray]:
        left = self.left(self.n)
        row = np.where(left >= 0, left * INSERT, _FAR).astype(np.int32)
        return np.tile(row, (len(self.codes), 1)), np.full((len(self.codes), len(row)), _FAR, np.int32)

    def above(self, i: int, plain: np.ndarray, headed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row i from row i + 1: the costs of what is left, of strings of u and a alone and of those with an s before."""
        left, kind = self.left(i), (self.codes[:, i] % 4)[:, None]
        extra = (self.codes[:, i] // 4).astype(np.int32)[:, None] * TRUNCATED
        shifted = lambda row: np.pad(row[:, 1:], ((0, 0), (0, 1)), constant_values=_FAR)
        below = shifted(plain)
        turned = plain + extra + np.where(kind == np.where(left % 2, 2, 1), KEEP, REROLE)
        row = np.where(left < 1, below + DELETE, np.minimum(below + DELETE, turned))
        row = np.where(left < 0, _FAR, row) - INSERT * self.offset
        row = np.minimum(np.minimum.accumulate(row, axis=1) + INSERT * self.offset, _FAR)
        head = np.minimum(shifted(headed) + DELETE, np.where(kind == 0, below + extra, _FAR))
        return row.astype(np.int32), np.where((left < 2) | (left % 2 == 1), _FAR, np.minimum(head, _FAR)).astype(np.int32)

    def costs(self) -> np.ndarray:
        """Least cost of each conversation over all lengths, if not above the limit; keeps some of the rows."""
        plain, headed = self.end()
        self.kept = {self.n: (plain, headed)}
        for i in range(self.n - 1, -1, -1):
            plain, headed = self.above(i, plain, headed)
            if i % self.step == 0:
                self.kept[i] = plain, headed
        even = (self.left(0) % 2 == 0) & (self.left(0) >= 0)
        self.targets = np.where(even, plain, _FAR), headed
        return np.minimum(self.targets[0].min(1), self.targets[1].min(1))

    def audits(self, cost: np.ndarray) -> list[bytes]:
        """The ASCII-least audit of each conversation: those of all lengths of least cost are backtraced and compared."""
        at = [np.nonzero(t == cost[:, None]) for t in self.targets]
        who, headed = np.concatenate([a[0] for a in at]), np.repeat([False, True], [len(a[0]) for a in at])
        left = self.left(0)[np.concatenate([a[1] for a in at])]
        out, done = np.zeros((len(who), self.n + int(left.max(initial=0)) + 1), np.uint8), np.zeros(len(who), np.int64)

        def put(rows, edits):
            out[rows, done[rows]] = edits
            done[rows] += 1

        for start in range(0, self.n, self.step):
            stop = min(start + self.step, self.n)
            block = {stop: self.kept[stop]}
            for i in range(stop - 1, start - 1, -1):
                block[i] = self.above(i, *block[i + 1])
            for i in range(start, stop):
                here, below, width, open_ = block[i], block[i + 1], len(self.offset), np.arange(len(who))
                while len(open_):
                    g, w, h = who[open_], left[open_] - (self.n - i) + self.low, headed[open_]
                    cost_here = np.where(h, here[1][g, w], here[0][g, w])
                    under = np.minimum(w + 1, width - 1)
                    deleted = (w + 1 < width) & (cost_here == np.where(h, below[1][g, under], below[0][g, under]) + DELETE)
                    inserted = ~deleted & ~h & (left[open_] > 0) & (w > 0) & (cost_here == here[0][g, np.maximum(w - 1, 0)] + INSERT)
                    fits = h | (self.codes[g, i] % 4 == np.where(left[open_] % 2, 2, 1))
                    put(open_, np.where(deleted, ord("D"), np.where(inserted, ord("I"), np.where(fits, ord("K"), ord("R")))))
                    left[open_] -= ~deleted & ~h
                    headed[open_] &= deleted
                    open_ = open_[inserted]
        while len(rest := np.flatnonzero(left > 0)):
            put(rest, ord("I"))
            left[rest] -= 1
        best: list[bytes | None] = [None] * len(cost)
        for k, g in enumerate(who):
            audit = out[k, : done[k]].tobytes()
            best[g] = audit if best[g] is None else min(best[g], audit)
        return best


def align(turns: list[bytes]) -> dict[bytes, tuple[int, bytes]]:
    """(cost, audit) of each distinct sequence of codes of turns that need not be deleted."""
    found, waiting = {}, {}
    for x in set(turns):
        if x:
            waiting.setdefault((len(x), min(2 * len(x), 8 + len(x) // 4)), []).append(x)
        else:
            found[x] = 0, b""
    while waiting:
        (n, limit), group = waiting.popitem()
        at_once = max(1, CELLS // ((limit * 7 // 10 + 3) * (2 * isqrt(n) + 4)))
        for k in range(0, len(group), at_once):
            some = group[k : k + at_once]
            codes = np.frombuffer(b"".join(some), np.uint8).reshape(len(some), n)
            band = _Band(codes, limit)
            cost = np.minimum(band.costs(), DELETE * n)
            exact = cost <= limit
            if exact.any():
                table = band if exact.all() else _Band(codes[exact], limit)
                costs = cost if exact.all() else table.costs()
                found.update(zip([x for x, e in zip(some, exact, strict=True) if e], zip(costs.tolist(), table.audits(costs), strict=True), strict=True))
            for x, c in zip(some, cost.tolist(), strict=True):
                if c > limit:  # the cost of some alignment is the incumbent of the second run
                    waiting.setdefault((n, min(DELETE * n, -(-c // 8) * 8)), []).append(x)
    return found


class _Conversation:
    def __init__(self, conv_id):
        self.conv_id, self.turns, self.counts, self.illegal = conv_id, bytearray(), [0, 0, 0, 0], 0
        self.first = self.last = self.before = None
        self.numbers = 0

    def add(self, turn, kind: int, fault: int) -> None:
        self.counts[fault] += 1
        if self.before is not None and (self.before, kind) not in ((0, 1), (1, 2), (2, 1)):
            self.illegal += 1
        self.before = kind
        if turn is not None and turn != self.last:
            self.first, self.last = turn if self.first is None else self.first, turn
            self.numbers += 1
        self.turns.append(8 if fault in (1, 2) else kind + 4 * (fault == 3))

    def row(self, found: dict) -> tuple:
        cost, rest = found[bytes(self.turns.replace(b"\x08", b""))]
        edits, audit = iter(rest), bytearray()
        for code in self.turns:  # a turn to delete comes before an insertion at its place
            if code == 8:
                audit.append(ord("D"))
                continue
            for edit in edits:
                audit.append(edit)
                if edit != ord("I"):
                    break
        audit.extend(edits)
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.numbers
        return self.conv_id, gaps, *self.counts[1:], self.illegal, cost + DELETE * self.turns.count(8), audit.decode()


AUDIT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def audits(damaged: DataFrame) -> DataFrame:
    """A row a conversation: counts of faults, cost and audit of the cheapest repair."""
    bounded_batches(damaged.sparkSession)

    def run(batches):
        import pyarrow as pa

        names, types = zip(*(c.split() for c in AUDIT.split(", ")), strict=True)
        schema = pa.schema([(n, pa.int64() if t == "long" else pa.string()) for n, t in zip(names, types, strict=True)])

        def rows(some):
            found = align([bytes(c.turns.replace(b"\x08", b"")) for c in some])
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*[c.row(found) for c in some], strict=True), schema, strict=True)], schema=schema)

        ready, gathered, now = [], 0, None
        for batch in batches:
            for conv_id, turn, alive, kind, fault in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or now.conv_id != conv_id:
                    if now is not None:
                        ready.append(now)
                        gathered += len(now.turns) + 10
                    if gathered > GATHERED:
                        yield rows(ready)
                        ready, gathered = [], 0
                    now = _Conversation(conv_id)
                if alive:
                    now.add(turn, kind, fault)
        if now is not None:
            yield rows([*ready, now])

    return _faults(damaged).mapInArrow(run, AUDIT)


EDITED = f"{AUDIT}, place long, role string, text string"


def _edited(damaged: DataFrame, audit: DataFrame) -> DataFrame:
    """For each conversation a row of its audit with place 0, then its repaired turns in order from place 1 on."""
    none = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in audit.schema}
    texts = damaged.where("alive").select(F.col("conv_id"), F.lit(1).alias("kind"), "turn", "role", "text", *[c for n, c in none.items() if n != "conv_id"])
    heads = audit.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), *[n for n in none if n != "conv_id"])
    of_audit = list(none)
    rows = heads.unionByName(texts).repartition("conv_id").sortWithinPartitions("conv_id", "kind", F.asc_nulls_first("turn"), "role", "text")

    def run(batches):
        import pyarrow as pa

        schema, edits, audit_at, place, before = None, "", 0, 0, ""

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        for batch in batches:
            names = [*of_audit, "place", "role", "text"]
            schema = pa.schema([(n, pa.string() if n in ("audit", "role", "text") else pa.int64()) for n in names])
            out = []

            def put(conv_id, role, text):
                nonlocal place, before
                place, before = place + 1, role[:1]
                out.append((conv_id, *[None] * (len(of_audit) - 1), place, role, text))

            def inserted(conv_id):
                nonlocal audit_at
                while audit_at < len(edits) and edits[audit_at] == "I":
                    audit_at += 1
                    put(conv_id, "assistant" if before == "u" else "user", "")

            for row in batch.to_pylist():
                if row["kind"] == 0:
                    edits, audit_at, place, before = row["audit"], 0, 0, ""
                    out.append((*[row[n] for n in of_audit], 0, None, None))
                    inserted(row["conv_id"])
                    continue
                edit = edits[audit_at]
                audit_at += 1
                if edit == "K":
                    put(row["conv_id"], row["role"], row["text"])
                elif edit == "R":
                    put(row["conv_id"], "assistant" if before == "u" else "user", row["text"])
                inserted(row["conv_id"])
            if out:
                yield batch_of(out)

    return rows.mapInArrow(run, EDITED)


def repaired(damaged: DataFrame, audit: DataFrame) -> DataFrame:
    """conv_id, place (from 1), role, text of the repaired turns."""
    return _edited(damaged, audit).where("place > 0").select("conv_id", "place", "role", "text")


def digests(damaged: DataFrame, audit: DataFrame) -> DataFrame:
    """The audits with the SHA-256 of the repaired `role:text` lines, hashed as they stream by."""

    def run(batches):
        import pyarrow as pa

        head = digest = None
        for batch in batches:
            done = []
            for row in batch.to_pylist():
                if row["place"] == 0:
                    if head is not None:
                        done.append(head | {"repaired_sha256": digest.hexdigest()})
                    head, digest = {k: row[k] for k in row if k not in ("place", "role", "text")}, hashlib.sha256()
                else:
                    digest.update(f"{chr(10) * (row['place'] > 1)}{row['role']}:{row['text']}".encode())
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=schema())
        if head is not None:
            yield pa.RecordBatch.from_pylist([head | {"repaired_sha256": digest.hexdigest()}], schema=schema())

    def schema():
        import pyarrow as pa

        return pa.schema([(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in f"{AUDIT}, repaired_sha256 string".split(", ")])

    return _edited(damaged, audit).mapInArrow(run, f"{AUDIT}, repaired_sha256 string")


SQL = r"""
WITH RECURSIVE r AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text FROM conversations
), numbered AS (
  SELECT *, row_number() OVER () AS rn, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM r
), bytes AS (
  SELECT rn, CAST(ascii(substr(name, CAST(k AS INTEGER), 1)) AS BIGINT) AS b, k FROM numbered, unnest(range(1, length(name) + 1)) AS u(k)
), crc AS (
  SELECT rn, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list(b ORDER BY k)), lambda x, y:
    list_reduce(list_prepend(xor(x, y), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])), lambda p, q: xor(p >> 1, (p & 1) * 3988292384))), 4294967295) % 20 AS kind
  FROM bytes GROUP BY rn
), damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM numbered JOIN crc USING (rn) WHERE kind <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS seen, substr(role, 1, 1) AS x
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged)
), faults AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1 WHEN seen > 1 THEN 2
    WHEN regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 0 ELSE 3 END AS fault,
    lag(x) OVER (PARTITION BY conv_id ORDER BY i) || x AS pair FROM placed
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank,
    count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n
  FROM faults GROUP BY conv_id
), best AS (
  SELECT conv_id, n, CAST(0 AS BIGINT) AS i, {'c': CAST(0 AS BIGINT), 'a': '', 'o': ''} AS s0, {'c': CAST(100000000 AS BIGINT), 'a': '', 'o': ''} AS s1,
    {'c': CAST(5 AS BIGINT), 'a': 'I', 'o': chr(10) || 'user:'} AS s2, {'c': CAST(10 AS BIGINT), 'a': 'II', 'o': chr(10) || 'user:' || chr(10) || 'assistant:'} AS s3 FROM counts
  UNION ALL
  SELECT conv_id, n, i, s0, s1, s2, least(s3, {'c': s2.c + 5, 'a': s2.a || 'I', 'o': s2.o || chr(10) || 'assistant:'}) FROM (
  SELECT conv_id, n, i, s0, s1, s3, least(s2, least({'c': s0.c + 5, 'a': s0.a || 'I', 'o': s0.o || chr(10) || 'user:'}, least(
    {'c': s1.c + 5, 'a': s1.a || 'I', 'o': s1.o || chr(10) || 'user:'}, {'c': s3.c + 5, 'a': s3.a || 'I', 'o': s3.o || chr(10) || 'user:'}))) AS s2 FROM (
  SELECT b.conv_id, b.n, f.i, {'c': s0.c + 2, 'a': s0.a || 'D', 'o': s0.o} AS s0,
    least({'c': s1.c + 2, 'a': s1.a || 'D', 'o': s1.o}, {'c': s0.c + keep + CASE WHEN x = 's' THEN 0 ELSE 100000000 END, 'a': s0.a || 'K', 'o': s0.o || chr(10) || role || ':' || text}) AS s1,
    least({'c': s2.c + 2, 'a': s2.a || 'D', 'o': s2.o}, CASE WHEN x = 'u'
      THEN least({'c': s0.c + keep, 'a': s0.a || 'K', 'o': s0.o || chr(10) || role || ':' || text}, least({'c': s1.c + keep, 'a': s1.a || 'K', 'o': s1.o || chr(10) || role || ':' || text},
        {'c': s3.c + keep, 'a': s3.a || 'K', 'o': s3.o || chr(10) || role || ':' || text}))
      ELSE least({'c': s0.c + keep + 1, 'a': s0.a || 'R', 'o': s0.o || chr(10) || 'user:' || text}, least({'c': s1.c + keep + 1, 'a': s1.a || 'R', 'o': s1.o || chr(10) || 'user:' || text},
        {'c': s3.c + keep + 1, 'a': s3.a || 'R', 'o': s3.o || chr(10) || 'user:' || text})) END) AS s2,
    least({'c': s3.c + 2, 'a': s3.a || 'D', 'o': s3.o}, CASE WHEN x = 'a' THEN {'c': s2.c + keep, 'a': s2.a || 'K', 'o': s2.o || chr(10) || role || ':' || text}
      ELSE {'c': s2.c + keep + 1, 'a': s2.a || 'R', 'o': s2.o || chr(10) || 'assistant:' || text} END) AS s3
  FROM best b JOIN (SELECT *, CASE fault WHEN 0 THEN 0 WHEN 3 THEN 5 ELSE 100000000 END AS keep FROM faults) f ON f.conv_id IS NOT DISTINCT FROM b.conv_id AND f.i = b.i + 1))
), ends AS (SELECT conv_id, least(s0, s3) AS s FROM best WHERE i = n), every AS (SELECT DISTINCT conv_id FROM conversations)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(s.c, 0) AS cost, coalesce(s.a, '') AS audit, sha256(substr(coalesce(s.o, ''), 2)) AS repaired_sha256
FROM every e LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN ends x ON x.conv_id IS NOT DISTINCT FROM e.conv_id
"""
