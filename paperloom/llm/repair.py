"""Repair of conversations' structure: the cheapest edits that make the roles ``(s?(ua)+)?``.

A dynamic programme goes over a conversation's rows with the four states of that
pattern. A step is a macro edit: up to two inserted turns (three never pay: two of
them would be a pair that the pattern can do without) and then the row kept,
reroled or deleted. As a code, ``I`` so often and then ``K``, ``R`` or ``D``: such codes are prefix-free,
so two audits of the same rows differ within some step, and the first step in
which they differ orders them. So audits are never held: a layer has for each state the least cost, the rank
of its audit among the layer's and a byte that names the state and code it came from. Layers
relative to their cheapest state are few, so steps are remembered.

Rows are sorted over all tasks by range; each task cuts its conversations into
segments of at most SEGMENT rows and solves each from all four states. Segments are then
chained by the same programme, one row for each segment, and their bytes are walked
back where they lie, in parallel. So a conversation of any length is spread over tasks; only
its audit, a string of the result, and the stream of its repaired rows are one task's.
"""

from __future__ import annotations

import functools
import hashlib
from collections import namedtuple
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ASCII_SPACE, cut, hot_join, lean, table, tune

SEGMENT = 4096
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: States: 0 nothing yet, 1 after the system turn, 2 after a user turn, 3 after an assistant turn.
STATES = 4
USER_NEXT = (True, True, False, True)
AFTER = (2, 2, 3, 2)
ENDS = (0, 3)
#: Initials by number; 3 is any other. Faults: 0 none, 1 truncated, 2 must go.
INITIALS = "sua"
LEGAL_PAIRS = {(0, 1), (1, 2), (2, 1)}
EDITS = "DKR"
NONE = None

Layer = tuple[tuple, tuple]


def kept(state: int, initial: int) -> int | None:
    """The state after a kept row of that initial, or None."""
    if initial == 0:
        return 1 if state == 0 else NONE
    return AFTER[state] if initial == (1 if USER_NEXT[state] else 2) else NONE


@functools.lru_cache(maxsize=1 << 16)
def step(layer: Layer, initial: int, fault: int) -> tuple[Layer, int, bytes]:
    """The next layer with its cheapest cost at 0, that cost, and each state's origin: state, run << 2, edit << 4."""
    best: dict[int, tuple] = {}
    for state, (cost, rank) in enumerate(zip(*layer)):
        if cost is NONE:
            continue
        at = state
        for run in range(3):
            moves = [(at, DELETE, 0)]
            if fault < 2:
                extra = TRUNCATED if fault else 0
                moves += [(kept(at, initial), KEEP + extra, 1), (AFTER[at], REROLE + extra, 2)]
            for to, price, edit in moves:
                if to is not NONE:
                    found = (cost + run * INSERT + price, rank, "I" * run + EDITS[edit], state | run << 2 | edit << 4)
                    best[to] = min(best.get(to, found), found)
            at = AFTER[at]
    least = min(b[0] for b in best.values())
    order = {s: r for r, s in enumerate(sorted(best, key=lambda s: best[s][1:3]))}
    costs = tuple(best[s][0] - least if s in best else NONE for s in range(STATES))
    return (costs, tuple(order.get(s, 0) for s in range(STATES))), least, bytes(best[s][3] if s in best else 255 for s in range(STATES))


def start(state: int) -> Layer:
    return tuple(0 if s == state else NONE for s in range(STATES)), (0,) * STATES


def finish(costs: list, ranks: list) -> tuple[int, int, int]:
    """The least cost at an accepted end, the state it comes from and how many turns are inserted last."""
    found = []
    for state in range(STATES):
        at = state
        for run in range(3):
            if costs[state] is not NONE and at in ENDS:
                found.append((costs[state] + run * INSERT, ranks[state], "I" * run, state, run))
            at = AFTER[at]
    cost, _, _, state, run = min(found)
    return cost, state, run


class Segment:
    """Up to SEGMENT rows of one conversation, solved from each of the four states."""

    def __init__(self, conv):
        self.conv, self.rows = conv, 0
        self.layers, self.costs, self.origins = [start(s) for s in range(STATES)], [0] * STATES, bytearray()
        self.faults = [0, 0, 0]  # blank, duplicate, truncated
        self.illegal, self.first, self.last = 0, None, None
        self.turns, self.low, self.high = 0, None, None

    def add(self, turn, initial: int, fault: int) -> None:
        """fault: 0 none, 1 blank, 2 duplicate, 3 truncated."""
        if fault:
            self.faults[fault - 1] += 1
        if self.rows and (self.last, initial) not in LEGAL_PAIRS:
            self.illegal += 1
        self.first = initial if self.first is None else self.first
        self.last = initial
        if turn is not None and turn != self.high:  # turns come in order
            self.turns += 1
            self.low = turn if self.low is None else self.low
            self.high = turn
        for s in range(STATES):
            self.layers[s], price, origin = step(self.layers[s], initial, (0, 2, 2, 1)[fault])
            self.costs[s] += price
            self.origins += origin
        self.rows += 1

    def record(self, part: int, seq: int) -> tuple:
        costs = [None if c is NONE else c + self.costs[s] for s, layer in enumerate(self.layers) for c in layer[0]]
        ranks = [r for layer in self.layers for r in layer[1]]
        return (self.conv, part, seq, *self.faults, self.illegal, self.first, self.last, self.turns, self.low, self.high, costs, ranks, bytes(self.origins))


SEGMENTS = "conv_id long, part int, seq long, blank long, duplicate long, truncated long, illegal long, first int, last int, turns long, low long, high long, costs array<long>, ranks array<int>, origins binary"
Solved = namedtuple("Solved", [field.split(" ")[0] for field in SEGMENTS.split(", ")][:-1])
_PICKED = "part int, seq long, begin int, finish int, tail int, cost long, gaps long, blank long, duplicate long, truncated long, illegal long"


def _arrow(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}
    return pa.schema([(name, kinds[kind]) for name, kind in (field.split(" ") for field in schema.split(", "))])


def _batches(rows: Iterator[tuple], schema: str, size: int, bytes_at: int | None = None) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``size`` rows, and of about a megabyte in column ``bytes_at``."""
    kinds, held, weight = _arrow(schema), [], 0
    for row in rows:
        held.append(row)
        weight += len(row[bytes_at] or "") if bytes_at is not None else 0
        if len(held) >= size or weight > 1 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds.types)], schema=kinds)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds.types)], schema=kinds)


def _columns(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*(c.to_pylist() for c in batch.columns))


def _order(*before: str):
    return [F.asc_nulls_first(c) for c in (*before, "turn", "role", "text")]


def _plain(turns: DataFrame) -> DataFrame:
    filled = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    return turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *filled)


def _seen(rows: DataFrame, hot_rows: int | None) -> DataFrame:
    """rows with ``key`` (of conversation, role and text) and ``again``: the same was said at an earlier turn."""
    when = F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("turn"))
    said = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit("null")), F.length("role").cast("string"), "role", "text")
    keyed = rows.withColumns({"key": F.unhex(F.sha2(said.cast("binary"), 256)), "when": when})
    # Only what is said at several turns is joined; counting combines before it shuffles.
    several = keyed.groupBy("key").agg(F.min("when").alias("since"), F.max("when").alias("until"), F.count("*").alias("count")).filter("since != until")
    several = cut(several.select("key", "since", "count"), "said-again")
    joined = hot_join(keyed, several.select("key", "since"), ["key"], "left", hot_rows, several.select("key", "count"))
    return joined.withColumn("again", F.coalesce(F.col("when") > F.col("since"), F.lit(False))).drop("when", "since")


def segments(rows: DataFrame, size: int = SEGMENT, hot_rows: int | None = None) -> DataFrame:
    """rows as ``_plain`` gives them → their solved segments, a table."""
    stripped = F.rtrim(F.col("text"), F.lit(ASCII_SPACE))
    initial = F.when(F.col("role").startswith("s"), 0).when(F.col("role").startswith("u"), 1).when(F.col("role").startswith("a"), 2).otherwise(3)
    fault = F.when(stripped == "", 1).when(F.col("again"), 2).when(~F.substring(stripped, -1, 1).isin(".", "!", "?"), 3).otherwise(0)
    marked = _seen(rows, hot_rows).withColumns({"initial": initial, "fault": fault})
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Rows alike in all columns stay in one part, one after the other.
    placed = marked.repartitionByRange(parts, *_order("conv_id")).sortWithinPartitions(*_order("conv_id"))
    placed = placed.select("conv_id", "turn", "key", "initial", "fault", F.spark_partition_id().alias("part"))

    def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        segment, part, seq, before = None, None, 0, None
        for batch in batches:
            for conv, turn, key, first, wrong, part in _columns(batch):
                if segment and (segment.conv != conv or segment.rows >= size):
                    yield segment.record(part, seq)
                    segment, seq = None, seq + 1
                segment = segment or Segment(conv)
                segment.add(turn, first, 2 if wrong in (0, 3) and before == (turn, key) else wrong)
                before = (turn, key)
        if segment:
            yield segment.record(part, seq)

    return cut(placed.mapInArrow(lean(lambda batches: _batches(solved(batches), SEGMENTS, 2000, 14)), SEGMENTS), "segments")


def chain(found: list[tuple]) -> tuple[list[tuple[int, int]], int, int]:
    """(costs, ranks) of a conversation's segments in order → begin and end of each, turns inserted last, cost."""
    costs, ranks, from_state = [0, NONE, NONE, NONE], [0] * STATES, []
    for seg_costs, seg_ranks in found:
        best: dict[int, tuple] = {}
        for s in range(STATES):
            for e in range(STATES):
                price = seg_costs[s * STATES + e]
                if costs[s] is not NONE and price is not None:
                    way = (costs[s] + price, ranks[s], seg_ranks[s * STATES + e], s)
                    best[e] = min(best.get(e, way), way)
        order = {e: r for r, e in enumerate(sorted(best, key=lambda e: best[e][1:3]))}
        costs = [best[e][0] if e in best else NONE for e in range(STATES)]
        ranks = [order.get(e, 0) for e in range(STATES)]
        from_state.append(bytes(best[e][3] if e in best else 255 for e in range(STATES)))
    cost, state, tail = finish(costs, ranks)
    spans = []
    for origin in reversed(from_state):
        spans.append((origin[state], state))
        state = origin[state]
    return spans[::-1], tail, cost


def walk(origins: bytes, begin: int, end: int) -> str:
    """The codes of a segment's rows between the two states."""
    codes, state = [], end
    for at in range(len(origins) - STATES * STATES + begin * STATES, -1, -STATES * STATES):
        came = origins[at + state]
        codes.append("I" * (came >> 2 & 3) + EDITS[came >> 4])
        state = came & 3
    return "".join(reversed(codes))


def audits(solved: DataFrame) -> DataFrame:
    """segments → ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit``, one row for each conversation."""

    def picked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        conv, held = None, []

        def close() -> Iterator[tuple]:
            spans, tail, cost = chain([(h.costs, h.ranks) for h in held])
            illegal = sum(h.illegal for h in held) + sum((a.last, b.first) not in LEGAL_PAIRS for a, b in zip(held, held[1:]))
            turned = [h for h in held if h.turns]
            turns = sum(h.turns for h in held) - sum(a.high == b.low for a, b in zip(turned, turned[1:]))
            gaps = turned[-1].high - turned[0].low + 1 - turns if turned else 0
            for h, (begin, end) in zip(held, spans):
                sums = (tail, cost, gaps, *(sum(getattr(x, c) for x in held) for c in ("blank", "duplicate", "truncated")), illegal)
                yield (h.part, h.seq, begin, end, *(sums if h is held[-1] else (0, *[None] * 6)))

        for batch in batches:
            for row in map(Solved._make, _columns(batch)):
                if held and row.conv_id != conv:
                    yield from close()
                    held = []
                conv = row.conv_id
                held.append(row)
        if held:
            yield from close()

    light = solved.drop("origins").repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")
    choices = light.mapInArrow(lean(lambda batches: _batches(picked(batches), _PICKED, 2000)), _PICKED)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for *rest, origins, begin, end, tail in _columns(batch):
                yield (*rest, walk(origins, begin, end) + "I" * tail)

    out = "conv_id long, part int, seq long, cost long, gaps long, blank long, duplicate long, truncated long, illegal long, audit string"
    sums = ["cost", "gaps", "blank", "duplicate", "truncated", "illegal"]
    chosen = solved.select("conv_id", "part", "seq", "origins").join(choices, ["part", "seq"]).select("conv_id", "part", "seq", *sums, "origins", "begin", "finish", "tail")
    pieces = chosen.mapInArrow(lean(lambda batches: _batches(coded(batches), out, 2000, 9)), out)
    whole = pieces.groupBy("conv_id").agg(*(F.max(c).alias(c) for c in sums), F.array_sort(F.collect_list(F.struct("part", "seq", "audit"))).alias("pieces"))
    return whole.select("conv_id", *sums, F.array_join("pieces.audit", "").alias("audit"))


def rebuilt(rows: DataFrame, audited: DataFrame) -> DataFrame:
    """``conv_id, at, role, text``: the repaired rows, in order within their partition; each conversation is streamed behind its audit."""
    audit = audited.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"))
    both = audit.unionByName(rows.select("conv_id", F.lit(1).alias("kind"), "turn", "role", "text"))
    streamed = both.repartition("conv_id").sortWithinPartitions(*_order("conv_id", "kind")).select("conv_id", "kind", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        conv, codes, place, state, at = None, "", 0, 0, 0

        def inserted() -> Iterator[tuple]:
            nonlocal place, state, at
            while codes[place : place + 1] == "I":
                yield conv, at, "user" if USER_NEXT[state] else "assistant", ""
                state, place, at = AFTER[state], place + 1, at + 1

        for batch in batches:
            for of, kind, role, text in _columns(batch):
                if kind == 0:
                    yield from inserted()  # what is left of the conversation before
                    conv, codes, place, state, at = of, text, 0, 0, 0
                    continue
                yield from inserted()
                edit = codes[place]
                place += 1
                if edit != "D":
                    role = role if edit == "K" else "user" if USER_NEXT[state] else "assistant"
                    yield conv, at, role, text
                    state, at = (1 if role[0] == "s" else AFTER[state]), at + 1
        yield from inserted()

    out = "conv_id long, at long, role string, text string"
    return streamed.mapInArrow(lean(lambda batches: _batches(run(batches), out, 2000, 3)), out)


def repair(turns: DataFrame, size: int = SEGMENT, hot_rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """turns: ``conv_id, turn, role, text`` → what is wrong and edited in each conversation
    (``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit``), and the repaired rows (``conv_id, at, role, text``).

    Rows come by turn (null first), ties by role, then text; rows that repeat a turn are
    rows each. A null role or text is one space; a null conv_id is a
    conversation of its own. Blank: nothing but ASCII white space; duplicate: the
    same role and text earlier in the conversation; truncated: it doesn't end in ``.``, ``!`` or
    ``?`` before white space; only the first of these counts. Gaps are numbers missing between the
    least and the greatest turn. Kept rows cost 0, reroled ones 1, deleted ones 2, inserted ones 5, truncated rows that stay
    5 more; blank and duplicate ones must go. Of equally cheap edits the least audit by
    code points is taken. A role that is empty or begins with none of s, u, a must be changed or go. Other columns
    aren't read, whatever their names. A text of any length is held in one task's batch. Empty tables give no rows.
    """
    tune(turns.sparkSession)
    rows = _plain(turns)
    audited = cut(audits(segments(rows, size, hot_rows)), "audits")
    return audited, rebuilt(rows, audited)


def digests(repaired: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256`` of ``role:text`` lines. repaired: as ``rebuilt`` gives it, a conversation's rows together and in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        conv, digest = None, None
        for batch in batches:
            for of, at, role, text in _columns(batch):
                if at == 0:
                    if digest:
                        yield conv, digest.hexdigest()
                    conv, digest = of, hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(f"{role}:{text}".encode())
        if digest:
            yield conv, digest.hexdigest()

    out = "conv_id long, repaired_sha256 string"
    return repaired.mapInArrow(lean(lambda batches: _batches(run(batches), out, 2000)), out)


def damage(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with the faults that the contract plants by a CRC of ``conv_id:turn``."""
    name = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    kind = F.crc32(name.cast("binary")) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = _plain(turns).withColumn("kind", kind).filter("kind != 0").withColumns({"text": text, "role": F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))})
    return rows.withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.sequence(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("kind", "copy")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    audited, repaired = repair(damage(turns))
    # The null conversation too: ids are joined with a flag beside them.
    named = lambda df: df.withColumns({"none": F.col("conv_id").isNull(), "conv_id": F.coalesce("conv_id", F.lit(0))})
    every = named(turns.select(F.col("conv_id").cast("long").alias("conv_id")).distinct())
    joined = every.join(named(audited), ["conv_id", "none"], "left").join(named(digests(repaired)), ["conv_id", "none"], "left")
    zeros = {c: 0 for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    filled = joined.fillna(zeros | {"audit": "", "repaired_sha256": hashlib.sha256().hexdigest()})
    return filled.select(F.when(~F.col("none"), F.col("conv_id")).alias("conv_id"), *zeros, "audit", "repaired_sha256")


#: The same programme over audits as strings, a row of all conversations at a time.
ORACLE_SQL = """
WITH RECURSIVE steps AS (
  SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS i))
), named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations
), drawn AS (
  SELECT conv_id, turn, role, text, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(name)), lambda i: CAST(ord(name[i + 1]) AS BIGINT))), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 20 AS kind FROM named, steps
), damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy FROM drawn WHERE kind <> 0
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, role[1:1] AS initial, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS stripped FROM damaged
), rows AS MATERIALIZED (
  SELECT *, CASE WHEN stripped = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2 WHEN NOT stripped[-1:] IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM numbered
), sums AS (
  SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
    count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (before IS NOT NULL AND NOT before || initial IN ('su', 'ua', 'au')) AS illegal FROM rows GROUP BY 1
), inserts(state, run, codes, moved) AS (
  VALUES (0, 0, '', 0), (0, 1, 'I', 2), (0, 2, 'II', 3), (1, 0, '', 1), (1, 1, 'I', 2), (1, 2, 'II', 3), (2, 0, '', 2), (2, 1, 'I', 3), (2, 2, 'II', 2), (3, 0, '', 3), (3, 1, 'I', 2), (3, 2, 'II', 3)
), edits(state, edit, initial, price, next) AS (
  SELECT s, 'D', CAST(NULL AS VARCHAR), 2, s FROM range(4) _(s)
  UNION ALL SELECT s, 'R', NULL, 1, CASE WHEN s = 2 THEN 3 ELSE 2 END FROM range(4) _(s)
  UNION ALL VALUES (0, 'K', 's', 0, 1), (0, 'K', 'u', 0, 2), (1, 'K', 'u', 0, 2), (2, 'K', 'a', 0, 3), (3, 'K', 'u', 0, 2)
), layers AS (
  SELECT conv_id, 0::BIGINT AS i, 0::BIGINT AS state, {'cost': 0::BIGINT, 'audit': ''} AS best FROM sums
  UNION ALL
  SELECT r.conv_id, r.i, e.next::BIGINT, min({'cost': (l.best.cost + 5 * f.run + e.price + CASE WHEN r.fault = 3 AND e.edit <> 'D' THEN 5 ELSE 0 END)::BIGINT, 'audit': l.best.audit || f.codes || e.edit})
  FROM layers l JOIN rows r ON r.conv_id IS NOT DISTINCT FROM l.conv_id AND r.i = l.i + 1 JOIN inserts f ON f.state = l.state
    JOIN edits e ON e.state = f.moved AND (e.initial IS NULL OR e.initial = r.initial) AND (e.edit = 'D' OR NOT r.fault IN (1, 2))
  GROUP BY r.conv_id, r.i, e.next
), done AS (
  SELECT l.conv_id, min({'cost': (best.cost + 5 * run)::BIGINT, 'audit': best.audit || codes}) AS best FROM layers l JOIN sums s ON s.conv_id IS NOT DISTINCT FROM l.conv_id AND s.n = l.i JOIN inserts f ON f.state = l.state WHERE f.moved IN (0, 3) GROUP BY 1
), letters AS (
  SELECT conv_id, best.audit AS audit, p, best.audit[p:p] AS letter, len(regexp_replace(best.audit[1:p], 'I', '', 'g')) AS i, len(regexp_replace(best.audit[1:p], 'D', '', 'g')) AS place FROM (SELECT conv_id, best, unnest(range(1, length(best.audit) + 1)) AS p FROM done)
), stays AS (
  SELECT l.conv_id, place, letter, CASE WHEN letter = 'I' THEN '' ELSE r.text END AS text, CASE WHEN letter = 'K' THEN r.role END AS role,
    max(CASE WHEN place = 1 AND letter = 'K' AND r.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY l.conv_id) AS system
  FROM letters l LEFT JOIN rows r ON r.conv_id IS NOT DISTINCT FROM l.conv_id AND r.i = l.i AND letter <> 'I' WHERE letter <> 'D'
), said AS (
  SELECT conv_id, sha256(string_agg(coalesce(role, CASE WHEN (place - system) % 2 = 1 THEN 'user' ELSE 'assistant' END) || ':' || text, chr(10) ORDER BY place)) AS digest FROM stays GROUP BY 1
)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(d.best.cost, 0) AS cost, coalesce(d.best.audit, '') AS audit, coalesce(digest, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN sums s ON s.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN done d ON d.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN said t ON t.conv_id IS NOT DISTINCT FROM o.conv_id"""
