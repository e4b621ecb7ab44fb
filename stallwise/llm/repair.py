"""Conversation structure repair by depth-first branch-and-bound.

A conversation shall read as an optional system turn followed by pairs of a
user and an assistant turn.  Rows may be kept, given another role, deleted, and
empty turns inserted; the cheapest edits win, ties the ASCII-least sequence of
their initials.

The search (``search``) walks an explicit stack of prefixes.  A suffix lower
bound on what the other rows must cost, the incumbent (cost, audit) and a
dominance table for each node (row, state) cut prefixes that cannot lead to a
better repair; when the stack is empty the incumbent is proved optimal.

A conversation may hold any share of all rows: its rows are dealt in order over
range partitions and cut into blocks of at most ``BLOCK`` rows.  Each block is
searched for every pair of states at its borders, so blocks are independent
tasks, and their answers are chained per conversation.  Two prefixes that reach
the same state with the same cost are never prefixes of one another (an insert
costs something), so the lesser of two audits stays the lesser whatever follows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stallwise.llm.common import written

#: Rows of a block.
BLOCK = 64
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: What has been said so far: nothing, a system turn, a user turn last, an assistant turn last.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (NOTHING, ASSISTANT)
NEXT = {(NOTHING, "s"): SYSTEM, (NOTHING, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: The one role that may be given or inserted in each state.
WANTED = {NOTHING: "u", SYSTEM: "u", USER: "a", ASSISTANT: "u"}
ROLES = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}
#: Codes of rows: the initial (x: another one) in small letters, in capitals if truncated; a row that must go.
GONE = "-"
BLANKS = " \t\n\x0b\x0c\r"

Answer = tuple[int, str]


def suffix_bounds(codes: str, exits: tuple[int, ...] = ENDS) -> list[tuple[int, int]]:
    """For each position the least that the rows from there on cost, if a user or if an assistant is wanted next.

    The bound is that of a looser task, in which a system turn fits wherever a
    user is wanted; so it never exceeds the true cost.
    """
    after = (0 if any(e != USER for e in exits) else INSERT, 0 if USER in exits else INSERT)
    bounds = [after]
    for code in reversed(codes):
        extra = TRUNCATED if code.isupper() else 0
        each = []
        for wanted in (0, 1):
            ways = [DELETE + after[wanted]]
            if code != GONE:
                ways.append(extra + REROLE + after[1 - wanted])
                if code.lower() == "ua"[wanted]:
                    ways.append(extra + KEEP + after[1 - wanted])
                elif wanted == 0 and code.lower() == "s":
                    ways.append(extra + KEEP + after[0])
            each.append(min(ways))
        after = (min(each[0], INSERT + each[1]), min(each[1], INSERT + each[0]))
        bounds.append(after)
    return bounds[::-1]


def search(codes: str, entry: int = NOTHING, exits: tuple[int, ...] = ENDS) -> Answer | None:
    """The cheapest (cost, audit) that leads the rows from state ``entry`` to one of ``exits``; None if nothing does."""
    n, bound = len(codes), suffix_bounds(codes, exits)
    best: Answer | None = None
    reached: dict[tuple[int, int], Answer] = {}
    stack = [(0, entry, 0, "")]
    while stack:
        at, state, cost, audit = stack.pop()
        if best is not None and (cost + bound[at][state == USER], audit) > (best[0], best[1][:len(audit)]):
            continue
        before = reached.get((at, state))
        if before is not None and before <= (cost, audit):
            continue
        reached[at, state] = (cost, audit)
        if at == n and state in exits and (best is None or (cost, audit) < best):
            best = (cost, audit)
        wanted = WANTED[state]
        steps = [("I", at, NEXT[state, wanted], cost + INSERT)]
        if at < n:
            code = codes[at]
            steps.append(("D", at + 1, state, cost + DELETE))
            if code != GONE:
                extra = cost + (TRUNCATED if code.isupper() else 0)
                kept = NEXT.get((state, code.lower()))
                if kept is not None:
                    steps.append(("K", at + 1, kept, extra + KEEP))
                steps.append(("R", at + 1, NEXT[state, wanted], extra + REROLE))
        # The most promising step goes on top of the stack, of equal ones the least letter.
        steps.sort(key=lambda s: (s[3] + bound[s[1]][s[2] == USER], s[0]), reverse=True)
        stack += [(to, then, total, audit + letter) for letter, to, then, total in steps]
    return best


def block_answers(codes: str, first: bool, last: bool) -> list[tuple[int, int, int, str]]:
    """(entry, exit, cost, audit) of a block for all states at its borders that can matter."""
    found = []
    for entry in (NOTHING,) if first else range(4):
        for exit_ in ENDS if last else range(4):
            answer = search(codes, entry, (exit_,))
            if answer is not None:
                found.append((entry, exit_, *answer))
    return found


def chain(blocks: list[list[tuple[int, int, int, str]]]) -> tuple[int, list[str]]:
    """Cost and the audit of each block along the best way through all blocks of a conversation."""
    ways: dict[int, tuple[int, str]] = {NOTHING: (0, "")}
    cuts: dict[int, list[int]] = {NOTHING: []}
    for answers in blocks:
        best: dict[int, tuple[int, str]] = {}
        ends: dict[int, list[int]] = {}
        for entry, exit_, cost, audit in answers:
            if entry in ways:
                total = (ways[entry][0] + cost, ways[entry][1] + audit)
                if exit_ not in best or total < best[exit_]:
                    best[exit_], ends[exit_] = total, [*cuts[entry], len(total[1])]
        ways, cuts = best, ends
    end = min((s for s in ENDS if s in ways), key=lambda s: ways[s])
    audit = ways[end][1]
    return ways[end][0], [audit[a:b] for a, b in zip([0, *cuts[end]], cuts[end], strict=False)]


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds ``block`` and ``pos`` to rows that come in order; block numbers grow along the range partitions."""
    from pyspark import TaskContext

    block, pos, conv = (TaskContext.get().partitionId() << 40) - 1, BLOCK, object()
    for batch in batches:
        blocks, places = [], []
        for value in batch.column("_conv").to_pylist():
            if value != conv or pos == BLOCK:
                block, pos, conv = block + 1, 0, value
            blocks.append(block)
            places.append(pos)
            pos += 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(blocks, pa.int64()), pa.array(places, pa.int32())], [*batch.schema.names, "block", "pos"])


def ordered(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Columns ``_conv, _turn, role, text, digest, block, pos``: all rows in the order of their conversations, written to the shared folder.

    The order is by turn (null first); rows of one turn go by role and the MD5
    of their text, so that equal rows stand together.  Null roles and texts count as one space.
    """
    named = rows.select(F.col(conv).alias("_conv"), F.col(turn).alias("_turn"), F.coalesce(F.col(role), F.lit(" ")).alias("role"),
                        F.coalesce(F.col(text), F.lit(" ")).alias("text")).withColumn("digest", F.md5(F.col("text").cast("binary")))
    key = ["_conv", "_turn", "role", "digest"]
    schema = named.select("*", F.lit(0).cast("long").alias("block"), F.lit(0).alias("pos")).schema
    return written(named.repartitionByRange(*key).sortWithinPartitions(*key).mapInArrow(_numbered, schema), "turns")


def _last_is_stop(text: Column) -> Column:
    return F.right(F.rtrim(text, F.lit(BLANKS)), F.lit(1)).isin(".", "!", "?")


def faults(turns: DataFrame) -> DataFrame:
    """``_conv, _turn, block, pos, initial, fault`` of ordered rows: the first of blank, duplicate, truncated, or null.

    A duplicate has a row of the same role and text before it in its
    conversation.  Only digests are shuffled, and only those of repeated rows meet all rows.
    """
    found = turns.select("_conv", "_turn", "role", "digest", "block", "pos", F.left("role", F.lit(1)).alias("initial"),
                         (F.rtrim("text", F.lit(BLANKS)) == "").alias("blank"), _last_is_stop(F.col("text")).alias("stop"))
    same = ["_conv", "role", "digest"]
    repeated = (found.groupBy(*same).agg(F.min(F.struct("block", "pos")).alias("first"), F.count("*").alias("n")).filter("n > 1")
                .select(F.col("_conv").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "first"))
    met = found.join(repeated, F.col("_conv").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")), "left")
    again = F.col("first").isNotNull() & (F.struct("block", "pos") != F.col("first"))
    fault = F.when(F.col("blank"), "blank").when(again, "duplicate").when(~F.col("stop"), "truncated")
    return met.select("_conv", "_turn", "block", "pos", F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("x").alias("initial"), fault.alias("fault"))


@dataclass
class Repairs:
    """``summary``: one row a conversation; ``turns``: what stays of it and is put in, in the order of ``place``."""

    summary: DataFrame
    turns: DataFrame


ANSWERS = "entry array<int>, exit array<int>, cost array<int>, audit array<string>"
CHAINED = ("_conv {conv}, cost long, audit string, blank long, duplicate long, truncated long, illegal long, "
           "blocks array<long>, parts array<string>, said array<long>")


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[tuple[str, bool, bool], list] = {}
    for batch in batches:
        found = []
        for codes, block, first, last in zip(*(batch.column(c).to_pylist() for c in ("codes", "block", "first", "last")), strict=True):
            key = (codes, block == first, block == last)
            if key not in known:
                if len(known) > 10_000:
                    known.clear()
                known[key] = block_answers(*key)
            found.append(known[key])
        made = [pa.array([[a[k] for a in answers] for answers in found], pa.list_(t)) for k, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.string()))]
        yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, "entry", "exit", "cost", "audit"])


def _chained(conv_type: pa.DataType):
    """Folds the blocks of each conversation, which come together and in order."""
    fields = pa.schema([("_conv", conv_type), ("cost", pa.int64()), ("audit", pa.string()), *((c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal")),
                        ("blocks", pa.list_(pa.int64())), ("parts", pa.list_(pa.string())), ("said", pa.list_(pa.int64()))])

    def closed(conv, held: list[dict]) -> dict:
        cost, parts = chain([list(zip(b["entry"], b["exit"], b["cost"], b["audit"], strict=True)) for b in held])
        said, so_far = [], 0
        for part in parts:
            said.append(so_far)
            so_far += len(part) - part.count("D")
        initials = "".join(b["initials"] for b in held)
        return {"_conv": conv, "cost": cost, "audit": "".join(parts), **{f: sum(b[f] for b in held) for f in ("blank", "duplicate", "truncated")},
                "illegal": sum(initials[i: i + 2] not in LEGAL for i in range(len(initials) - 1)), "blocks": [b["block"] for b in held], "parts": parts, "said": said}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            done = []
            for row in batch.to_pylist():
                if held and held[0]["_conv"] != row["_conv"]:
                    done.append(closed(held[0]["_conv"], held))
                    held = []
                held.append(row)
            yield pa.RecordBatch.from_pylist(done, fields)
        if held:
            yield pa.RecordBatch.from_pylist([closed(held[0]["_conv"], held)], fields)
    return run


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Applies each block's audit to its rows, which come in order; the audit lies on the block's first row."""
    schema = None
    letters, place, odd = "", 0, False
    for batch in batches:
        schema = schema or pa.schema([batch.schema.field("_conv"), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
        convs, places, edits, roles, texts = [], [], [], [], []

        def say(conv, edit, role, text):
            nonlocal place
            for values, value in zip((convs, places, edits, roles, texts), (conv, place, edit, role, text), strict=True):
                values.append(value)
            place += 1

        for conv, pos, role, text, part, said, total in zip(*(batch.column(c).to_pylist() for c in ("_conv", "pos", "role", "text", "part", "said", "total")), strict=True):
            if pos == 0:
                letters, place, odd = part, said, total % 2 == 1
            while letters[0] == "I":
                letters = letters[1:]
                say(conv, "insert", ROLES["ua"[(place - odd) % 2]], "")
            letter, letters = letters[0], letters[1:]
            if letter == "K":
                say(conv, "keep", role, text)
            elif letter == "R":
                say(conv, "rerole", ROLES["ua"[(place - odd) % 2]], text)
            # Only inserts are left after the block's last row.
            if letters and not letters.strip("I"):
                for _ in letters:
                    say(conv, "insert", ROLES["ua"[(place - odd) % 2]], "")
                letters = ""
        yield pa.RecordBatch.from_arrays([pa.array(convs, schema.field(0).type), pa.array(places, pa.int64()), pa.array(edits, pa.string()),
                                          pa.array(roles, pa.string()), pa.array(texts, pa.string())], schema=schema)


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> Repairs:
    """Repairs every conversation of ``rows``; other columns take no part, whatever their names.

    ``summary``: the conversation, ``gaps`` (numbers missing between its least
    and greatest turn; 0 if all are null), counts of ``blank``, ``duplicate`` and
    ``truncated`` rows and of ``illegal`` neighbours, ``cost`` and ``audit``.
    ``turns``: the conversation, ``place`` (from 0), ``edit`` (keep, rerole,
    insert), ``role`` and ``text``.  A conversation whose rows all go has no turns.
    A null id is a conversation of its own; an empty role fits nowhere.  Empty
    tables give empty ones, repeated rows are duplicates, long texts take part in no search.
    """
    lines = ordered(rows, conv, turn, role, text)
    found = written(faults(lines), "faults")
    fault = F.col("fault")
    code = F.when(fault.isin("blank", "duplicate"), F.lit(GONE)).when(fault == "truncated", F.upper("initial")).otherwise(F.col("initial"))
    in_order = F.array_sort(F.collect_list(F.struct("pos", "initial", code.alias("code"))))
    counts = [F.count_if(fault == f).alias(f) for f in ("blank", "duplicate", "truncated")]
    # A block has at most BLOCK rows, so its list is bounded.
    blocks = found.groupBy("_conv", "block").agg(in_order.alias("list"), *counts).select(
        "_conv", "block", F.array_join("list.code", "").alias("codes"), F.array_join("list.initial", "").alias("initials"), "blank", "duplicate", "truncated")
    span = found.groupBy(F.col("_conv").alias("c")).agg(F.min("block").alias("first"), F.max("block").alias("last"), F.min("_turn").alias("low"), F.max("_turn").alias("high"),
                                                        F.countDistinct("_turn").alias("turns"))
    span = written(span, "spans")
    bordered = blocks.join(span.select("c", "first", "last"), F.col("_conv").eqNullSafe(F.col("c"))).drop("c")
    answered = bordered.mapInArrow(_searched, ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in bordered.schema), ANSWERS]))
    conv_type = lines.schema["_conv"].dataType
    empty = lines.sparkSession.createDataFrame([], lines.select("_conv").schema)
    chained = written(answered.repartition("_conv").sortWithinPartitions("_conv", "block")
                      .mapInArrow(_chained(empty.toArrow().schema.field(0).type), CHAINED.format(conv=conv_type.simpleString())), "repairs")
    gaps = F.when(F.col("low").isNull(), 0).otherwise(F.col("high") - F.col("low") + 1 - F.col("turns")).cast("long")
    summary = chained.join(span, F.col("_conv").eqNullSafe(F.col("c"))).select(
        F.col("_conv").alias(conv), gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    total = F.length(F.translate("audit", "D", ""))
    parts = chained.select(total.alias("total"), F.explode(F.arrays_zip("blocks", "parts", "said")).alias("b")).select(
        F.col("b.blocks").alias("at"), F.col("b.parts").alias("part"), F.col("b.said").alias("said"), "total")
    edited = lines.join(parts, F.col("block") == F.col("at")).select("_conv", "block", "pos", "role", "text", "part", "said", "total")
    turns = edited.repartition("block").sortWithinPartitions("block", "pos").mapInArrow(
        _edited, f"_conv {conv_type.simpleString()}, place long, edit string, role string, text string").withColumnRenamed("_conv", conv)
    return Repairs(summary, turns)


def digests(turns: DataFrame, conv: str = "conv_id") -> DataFrame:
    """``conv`` and ``sha256`` of each conversation's ``role:text`` lines, joined by newlines.

    Lines stream through the digest in order: a task holds one batch and one state, however long a conversation is.
    """
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, current, schema = None, None, None
        for batch in batches:
            schema = schema or pa.schema([batch.schema.field("_conv"), ("sha256", pa.string())])
            done = []
            for value, line in zip(batch.column("_conv").to_pylist(), batch.column("line").to_pylist(), strict=True):
                if state is None or value != current:
                    if state is not None:
                        done.append((current, state.hexdigest()))
                    state, current = hashlib.sha256(line.encode("utf-8", "surrogatepass")), value
                else:
                    state.update(b"\n" + line.encode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], schema.field(k).type) for k in (0, 1)], schema=schema)
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], schema.field(k).type) for k, v in enumerate((current, state.hexdigest()))], schema=schema)

    lines = turns.select(F.col(conv).alias("_conv"), "place", F.concat_ws(":", "role", "text").alias("line"))
    kind = turns.schema[conv].dataType.simpleString()
    return lines.repartition("_conv").sortWithinPartitions("_conv", "place").mapInArrow(run, f"_conv {kind}, sha256 string").withColumnRenamed("_conv", conv)
