"""Conversation repair: faults of every turn and the cheapest edits to an alternating conversation."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from dairyframe.llm import repair_grammar as g
from dairyframe.llm.common import table, written

NAME = "op13_conversation_repair"
#: Rows of one piece of a conversation; longer conversations are several pieces, whose matrices are multiplied.
PIECE = 4096
#: Rules of the grammar. What the rules don't cover is multiplied symbol by symbol, with the same result.
RULES = 128
_BLANKS = " \t\n\x0b\x0c\r"
_LEGAL = {(0, 1), (1, 2), (2, 1)}
_COUNTS = ("blank", "duplicate", "truncated", "illegal", "days", "first_turn", "last_turn", "first_class", "last_class")


class Repair(NamedTuple):
    """``summary``: one row per conversation; ``turns``: the repaired rows, lazily."""

    summary: DataFrame
    turns: DataFrame


def damage(conversations: DataFrame) -> DataFrame:
    """The rows of ``conversations`` after seeded faults, with ``copies``: 0 for a dropped row, 2 for a repeated one."""
    words = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    what = F.crc32(F.concat(words[0], F.lit(":"), words[1]).cast("binary")) % 20
    text = F.when(what == 1, "").when(what == 2, F.translate(words[3], ".!?", "")).otherwise(words[3])
    role = F.when(what == 4, "user").otherwise(words[2])
    copies = F.when(what == 0, 0).when(what == 3, 2).otherwise(1)
    return conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copies"))


def _digest(role: Column, text: Column) -> Column:
    return F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))


def _plain(rows: DataFrame) -> DataFrame:
    """conv, turn, role, text, copies and digest under names of our own; null roles and texts are one space."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    copies = F.col("copies").cast("long") if "copies" in rows.columns else F.lit(1).cast("long")
    turn = F.col("turn").cast("long").alias("turn")
    out = rows.select(F.col("conv_id").alias("conv"), turn, role.alias("role"), text.alias("text"), copies.alias("copies"))
    return out.withColumn("digest", F.when(F.col("copies") > 0, _digest(F.col("role"), F.col("text"))))


def _marked(rows: DataFrame) -> DataFrame:
    """One row per (conv, turn, digest): n copies, role class, state (0 whole, 1 cut off, 2 blank), seen earlier or not.

    The first turn of each role and text comes from an aggregate that combines before its shuffle and is joined back, so
    a text that makes up a third of all rows is counted where it lies, and adaptive execution can split its join.
    """
    visible = F.rtrim(F.col("text"), F.lit(_BLANKS))
    last = F.substring(visible, -1, 1)
    state = F.when(visible == "", 2).when(last.isin(".", "!", "?"), 0).otherwise(1)
    initial = F.substring("role", 1, 1)
    cls = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    slim = rows.select("conv", "turn", "digest", "copies", cls.alias("cls"), state.alias("state"))
    each = slim.groupBy("conv", "turn", "digest").agg(F.sum("copies").alias("n"), F.min("cls").alias("cls"), F.min("state").alias("state"))
    place = F.struct(F.col("turn").isNotNull().alias("k"), F.col("turn"))
    first = each.filter("n > 0").groupBy(F.col("conv").alias("c"), F.col("digest").alias("d")).agg(F.min(place).alias("first"))
    same = F.col("conv").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d"))
    again = F.coalesce(~F.col("first.turn").eqNullSafe(F.col("turn")), F.lit(False))
    return each.join(first, same, "left").select("conv", "turn", "digest", "n", "cls", "state", again.alias("again"))


class _Piece:
    """A run of rows of one conversation, in order."""

    def __init__(self) -> None:
        self.symbols = bytearray()
        self.blank = self.duplicate = self.truncated = self.illegal = self.days = 0
        self.first_turn = self.last_turn = self.first_class = self.last_class = None

    def add(self, turn: int | None, n: int, cls: int, state: int, dup: int) -> None:
        """``n`` equal rows, the last ``dup`` of which repeat an earlier one."""
        self.blank += n * (state == 2)
        self.duplicate += dup * (state != 2)
        fresh = n - dup if state != 2 else 0
        self.truncated += fresh * (state == 1)
        self.illegal += n - 1 + (self.last_class is not None and (self.last_class, cls) not in _LEGAL)
        self.first_class = cls if self.first_class is None else self.first_class
        self.last_class = cls
        self.symbols += bytes([cls + g.CUT * (state == 1)]) * fresh + bytes([g.DROP]) * (n - fresh)
        if turn is not None:
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.days += turn != self.last_turn
            self.last_turn = turn

    def row(self, conv, part: int, no: int, open_: bool) -> tuple:
        return (conv, part, no, open_, bytes(self.symbols), *(getattr(self, c) for c in _COUNTS))


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 4096) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= most:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _fields(conv: T.DataType, *names: str) -> T.StructType:
    return T.StructType([T.StructField("conv", conv), *T.StructType.fromDDL(", ".join(x.replace(":", " ") for x in names)).fields])


_COUNT_FIELDS = [f"{c}:long" for c in _COUNTS]


def pieces(marked: DataFrame, size: int = PIECE) -> DataFrame:
    """Runs of at most ``size`` rows: conv, part and no (their order), open, symbols and counts.

    Rows are range-partitioned by conversation, turn and text, so a long conversation lies in several tasks and none
    holds it whole. A piece is ``open`` unless it is certainly a whole conversation: the first and the last conversation of a
    partition may go on in the next one.
    """
    schema = _fields(marked.schema["conv"].dataType, "part:int", "no:long", "open:boolean", "symbols:binary", *_COUNT_FIELDS)
    arrow = _arrow(schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple]:
            part, no, conv, piece, whole = TaskContext.get().partitionId(), 0, None, None, False
            for key, turn, n, cls, state, again in _rows(batches):
                if piece is None or key != conv:
                    if piece is not None:
                        yield piece.row(conv, part, no, not whole)
                        no += 1
                    whole, conv = piece is not None, key
                    piece = _Piece()
                while n:
                    if len(piece.symbols) >= size:
                        yield piece.row(conv, part, no, True)
                        no, piece, whole = no + 1, _Piece(), False
                    some = min(n, size - len(piece.symbols))
                    piece.add(turn, some, cls, state, some if again else some - 1)
                    n, again = n - some, True
            if piece is not None:
                yield piece.row(conv, part, no, True)

        yield from _batches(found(), arrow)

    order = ["conv", "turn", "digest"]
    ranged = marked.repartitionByRange(*order).sortWithinPartitions(*order)
    return ranged.select("conv", "turn", "n", "cls", "state", "again").mapInArrow(cut, schema)


def learn_rules(found: DataFrame, most: int = RULES) -> list[tuple[int, int]]:
    """Re-Pair rules for the symbols of all pieces.

    Each round counts all pairs of neighbours in Spark and replaces the most frequent ones that share no symbol. The driver
    sees counts of pairs only, at most (9 + ``most``) squared of them.
    """
    rules: list[tuple[int, int]] = []
    while len(rules) < most:
        so_far = list(rules)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                seen = batch.column(0).dictionary_encode()
                weights = np.bincount(seen.indices.to_numpy(), minlength=len(seen.dictionary))
                pairs = g.pair_counts(g.rewrite(seen.dictionary.to_pylist(), so_far), weights)
                if pairs:
                    a, b = zip(*pairs)
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b, list(pairs.values()))], ["a", "b", "n"])

        counts = found.select("symbols").mapInArrow(count, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
        top = counts.filter("n > 1").orderBy(F.desc("n"), "a", "b").limit(4 * most).collect()
        new = g.next_rules([(r.a, r.b, r.n) for r in top], most - len(rules))
        if not new:
            break
        rules += new
    return rules


def _solved(found: DataFrame, rules: list[tuple[int, int]]) -> DataFrame:
    """Pieces with cost and audit where they are whole, and with their matrix (16 costs and audits) where they are open."""
    names = ["part:int", "no:long", "open:boolean", "cost:long", "audit:string", "costs:array<long>", "audits:array<string>"]
    schema = _fields(found.schema["conv"].dataType, *names, *_COUNT_FIELDS)
    arrow = _arrow(schema)
    identity = [[(0, "") if p == q else None for q in range(g.STATES)] for p in range(g.STATES)]

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = g.matrices(rules)
        for batch in batches:
            seen = batch.column("symbols").dictionary_encode()
            rewritten = g.rewrite(seen.dictionary.to_pylist(), rules)
            ends: dict[int, tuple] = {}
            cells: dict[int, tuple] = {}
            lists = [c.to_pylist() for c in batch.columns]
            out = []
            for i, at in enumerate(seen.indices.to_pylist()):
                conv, part, no, is_open, _, *counts = (c[i] for c in lists)
                if is_open and at not in cells:
                    flat = [c for row in g.product(rewritten[at].tolist(), of, identity) for c in row]
                    cells[at] = [-1 if c is None else c[0] for c in flat], [None if c is None else g.text_of(c[1]) for c in flat]
                elif not is_open and at not in ends:
                    ends[at] = g.ended(g.product(rewritten[at].tolist(), of, g.START)[0])
                cost, audit = (None, None) if is_open else ends[at]
                costs, audits = cells[at] if is_open else (None, None)
                out.append((conv, part, no, is_open, cost, audit, costs, audits, *counts))
            if out:
                yield _batch(out, arrow)

    return found.mapInArrow(solve, schema)


def _folded(solved: DataFrame) -> DataFrame:
    """One row per conversation of several pieces: its matrices multiplied in order, from the state before its first row.

    A conversation of n rows arrives as n / PIECE matrices. Its audit has a character for each row and is one value by nature.
    """
    schema = _fields(solved.schema["conv"].dataType, "cost:long", "audit:string", *_COUNT_FIELDS)
    arrow = _arrow(schema)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple]:
            conv, state, total = None, None, None
            for key, costs, audits, *rest in _rows(batches):
                counts = dict(zip(_COUNTS, rest))
                matrix = [[None if costs[4 * p + q] < 0 else (costs[4 * p + q], audits[4 * p + q]) for q in range(4)] for p in range(4)]
                if state is None or key != conv:
                    if state is not None:
                        yield (conv, *g.ended(state[0]), *total.values())
                    conv, state, total = key, g.START, dict.fromkeys(_COUNTS) | {c: 0 for c in _COUNTS[:5]}
                state = g.times(state, matrix)
                touch = total["last_class"] is not None and counts["first_class"] is not None
                total["illegal"] += touch and (total["last_class"], counts["first_class"]) not in _LEGAL
                total["days"] -= total["last_turn"] is not None and total["last_turn"] == counts["first_turn"]
                for c in _COUNTS[:5]:
                    total[c] += counts[c]
                for c in ("first_turn", "first_class"):
                    total[c] = counts[c] if total[c] is None else total[c]
                for c in ("last_turn", "last_class"):
                    total[c] = total[c] if counts[c] is None else counts[c]
            if state is not None:
                yield (conv, *g.ended(state[0]), *total.values())

        yield from _batches(found(), arrow)

    one = solved.repartition("conv").sortWithinPartitions("conv", "part", "no")
    return one.select("conv", "costs", "audits", *_COUNTS).mapInArrow(fold, schema)


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Repaired turns of conversations one after the other: (conv, None, None, None) first, then (conv, edit, role, text)."""
    audit, at, state, conv = "", 0, 0, None

    def fill() -> Iterator[tuple]:
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            role, state = g.PUT[state]
            at += 1
            yield conv, "I", role, ""

    for key, kind, edits, role, text, copies in _rows(batches):
        if kind == 0:
            yield from fill()
            conv, audit, at, state = key, edits, 0, 0
            yield conv, None, None, None
            continue
        for _ in range(copies):
            yield from fill()
            edit = audit[at]
            at += 1
            if edit == "K":
                state = g.after_kept(state, "sua".index(role[0]))
                yield conv, edit, role, text
            elif edit == "R":
                put, state = g.PUT[state]
                yield conv, edit, put, text
    yield from fill()


def _ordered(summary: DataFrame, rows: DataFrame) -> DataFrame:
    """Each conversation's audit, then its rows in order, in one partition; tasks read them as a stream."""
    none = [F.lit(None).cast(t).alias(c) for c, t in (("turn", "long"), ("digest", "binary"), ("role", "string"), ("text", "string"))]
    heads = summary.select("conv", F.lit(0).alias("kind"), "audit", *none, F.lit(0).cast("long").alias("copies"))
    body = rows.filter("copies > 0").select(
        "conv", F.lit(1).alias("kind"), F.lit(None).cast("string").alias("audit"), "turn", "digest", "role", "text", "copies"
    )
    together = heads.unionByName(body).repartition("conv").sortWithinPartitions("conv", "kind", "turn", "digest")
    return together.select("conv", "kind", "audit", "role", "text", "copies")


def repair(rows: DataFrame, *, rules: int = RULES, piece: int = PIECE) -> Repair:
    """Faults of each conversation and its cheapest edits to roles whose initials read ``(s?(ua)+)?``.

    ``rows`` hold conv_id, turn, role, text and, if they like, ``copies`` (how often a row stands there in a row; 0 keeps its
    conversation in the result without a row). Rows come by turn, nulls first, and equal turns by the SHA-256 of role and text.
    Keep costs 0, making a turn a user's or assistant's 1, deletion 2 (forced for blank and repeated rows), an
    inserted empty turn 5, and a row that stays cut off 5. Of equally cheap audits the least by code point is taken.

    ``summary`` has conv_id, gaps, blank, duplicate, truncated, illegal, cost and audit; ``turns`` has conv_id, position, edit, role
    and text of every repaired row. Null roles and texts are one space, null conversation ids one
    conversation, null turns come first and count in no gap. Repeated rows are duplicates; a conversation without rows has
    zeros and an empty audit; no rows give no result. Other columns are ignored. Texts may have any length: they
    are shuffled once and read as a stream, and only conversations' symbols (a byte a row) meet before that.
    """
    plain = _plain(rows)
    marked = written(_marked(plain), "repair-marked")
    found = written(pieces(marked, piece), "repair-pieces")
    solved = written(_solved(found, learn_rules(found, rules)), "repair-solved")
    keep = ["conv", "cost", "audit", *_COUNTS]
    every = written(solved.filter("not open").select(*keep).unionByName(_folded(solved.filter("open")).select(*keep)), "repair-summary")
    gaps = F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("days"), F.lit(0).cast("long"))
    counts = ["blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    summary = every.select(F.col("conv").alias("conv_id"), gaps.alias("gaps"), *counts)

    schema = _fields(plain.schema["conv"].dataType, "position:long", "edit:string", "role:string", "text:string")
    arrow = _arrow(schema)

    def turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple]:
            position = 0
            for conv, edit, role, text in _apply(batches):
                if edit is None:
                    position = 0
                else:
                    yield conv, position, edit, role, text
                    position += 1

        yield from _batches(found(), arrow, 512)

    made = _ordered(every, plain).mapInArrow(turns, schema)
    return Repair(summary, made.withColumnRenamed("conv", "conv_id"))


def turn_hashes(turns: DataFrame) -> DataFrame:
    """(conv, repaired_sha256) of conversations with repaired turns: ``role:text`` joined by newlines.

    Reads partitions of ``Repair.turns`` as they are: a conversation's turns lie together and in order, so they are hashed as a
    stream and no conversation is held whole.
    """
    schema = _fields(turns.schema["conv_id"].dataType, "repaired_sha256:string")
    arrow = _arrow(schema)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple]:
            conv, held = None, None
            for key, position, role, text in _rows(batches):
                if position == 0:
                    if held is not None:
                        yield conv, held.hexdigest()
                    conv, held = key, hashlib.sha256()
                else:
                    held.update(b"\n")
                held.update(f"{role}:{text}".encode())
            if held is not None:
                yield conv, held.hexdigest()

        yield from _batches(found(), arrow)

    return turns.select("conv_id", "position", "role", "text").mapInArrow(digest, schema)


def digested(done: Repair) -> DataFrame:
    """The summary with ``repaired_sha256``; a conversation without repaired turns has the hash of an empty text."""
    joined = done.summary.join(turn_hashes(done.turns), F.col("conv_id").eqNullSafe(F.col("conv")), "left")
    empty = F.lit(hashlib.sha256().hexdigest())
    return joined.select(*done.summary.columns, F.coalesce("repaired_sha256", empty).alias("repaired_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digested(repair(damage(table(spark, sf_dir, "conversations"))))


def _oracle() -> str:
    """The same by a recursive walk over rows that carries the best edits into each of the four states."""

    def plus(e: str, cost: str, letter: str, line: str | None = None) -> str:
        put = f"{e}.t" if line is None else f"CASE WHEN {e}.t IS NULL THEN {line} ELSE {e}.t || chr(10) || {line} END"
        return f"CASE WHEN {e} IS NOT NULL THEN {{'c': {e}.c + {cost}, 'a': {e}.a || '{letter}', 't': {put}}} END"

    def least(*cells: str) -> str:
        return f"list_sort(list_filter([{', '.join(cells)}], lambda z: z IS NOT NULL))[1]"

    def only(when: str, cell: str) -> str:
        return f"CASE WHEN {when} THEN {cell} END"

    user, helper = "'user:'", "'assistant:'"
    two = "'user:' || chr(10) || 'assistant:'"
    inserted = f"""s0 AS e0, s1 AS e1,
        {least("s2", plus("s0", "5", "I", user), plus("s1", "5", "I", user), plus("s3", "5", "I", user))} AS e2,
        {least("s3", plus("s2", "5", "I", helper), plus("s0", "10", "II", two), plus("s1", "10", "II", two))} AS e3"""
    own, u, a = "role || ':' || text", "'user:' || text", "'assistant:' || text"
    kept = lambda e: plus(e, "cut", "K", own)
    cast = lambda e, line: plus(e, "cut + 1", "R", line)
    free = "NOT gone"
    n1 = least(plus("e1", "2", "D"), only(f"{free} AND initial = 's'", kept("e0")))
    n2 = [only(free, cast(e, u)) for e in ("e0", "e1", "e3")] + [only(f"{free} AND initial = 'u'", kept(e)) for e in ("e0", "e1", "e3")]
    n3 = [only(free, cast("e2", a)), only(f"{free} AND initial = 'a'", kept("e2"))]
    return f"""
    WITH RECURSIVE keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
    summed AS (SELECT *, xor(list_reduce(list_prepend(4294967295, range(8 * length(k))),
        lambda c, i: xor(c >> 1, (xor(c, ascii(substr(k, CAST(i // 8 AS BIGINT) + 1, 1)) >> (i % 8)) & 1) * 3988292384)), 4294967295) % 20 AS what FROM keyed),
    damaged AS (SELECT conv_id, turn, CASE WHEN what = 4 THEN 'user' ELSE role END AS role,
        CASE WHEN what = 1 THEN '' WHEN what = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN what = 3 THEN 2 ELSE 1 END)) AS copy
        FROM summed WHERE what <> 0),
    placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text)) AS pos FROM damaged),
    faulty AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS again,
        NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank, substr(role, 1, 1) AS initial,
        regexp_extract(text, '([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*$', 1) NOT IN ('.', '!', '?') AS short,
        lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS before FROM placed),
    turns AS (SELECT *, blank OR again AS gone, CASE WHEN short THEN 5 ELSE 0 END AS cut FROM faulty),
    counts AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
        count(*) FILTER (again AND NOT blank) AS duplicate, count(*) FILTER (short AND NOT gone) AS truncated,
        count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM turns GROUP BY conv_id),
    walk AS (
        SELECT conv_id, CAST(0 AS BIGINT) AS pos, {{'c': CAST(0 AS BIGINT), 'a': '', 't': CAST(NULL AS VARCHAR)}} AS s0,
            CAST(NULL AS STRUCT(c BIGINT, a VARCHAR, t VARCHAR)) AS s1, CAST(NULL AS STRUCT(c BIGINT, a VARCHAR, t VARCHAR)) AS s2,
            CAST(NULL AS STRUCT(c BIGINT, a VARCHAR, t VARCHAR)) AS s3 FROM (SELECT DISTINCT conv_id FROM conversations)
        UNION ALL
        SELECT conv_id, pos, {plus("e0", "2", "D")}, {n1}, {least(plus("e2", "2", "D"), *n2)}, {least(plus("e3", "2", "D"), *n3)}
        FROM (SELECT w.conv_id, t.pos, t.role, t.text, t.initial, t.gone, t.cut, {inserted}
              FROM walk w JOIN turns t ON w.conv_id IS NOT DISTINCT FROM t.conv_id AND t.pos = w.pos + 1)),
    best AS (SELECT conv_id, pos, {least("s0", "e3")} AS z FROM (SELECT conv_id, pos, s0, {inserted} FROM walk))
    SELECT b.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
        CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, z.c AS cost, z.a AS audit,
        sha256(coalesce(z.t, '')) AS repaired_sha256
    FROM best b LEFT JOIN counts c ON b.conv_id IS NOT DISTINCT FROM c.conv_id WHERE b.pos = coalesce(c.n, 0)"""


ORACLE = _oracle()
