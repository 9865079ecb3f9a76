"""Repair of conversation structure by signature.

What a conversation needs depends only on its sequence of roles and faults, which repeats endlessly over a corpus. So every
turn becomes one character, conversations become compact strings, each distinct string is solved once, and the solution,
one character per edit, goes back to all conversations of that signature, whose turns it is replayed on.

Turns are ordered by ranges of (conversation, turn), so a conversation that holds a third of all rows is cut into chunks
that lie in many tasks; only its signature, one character a turn, is put together. Texts stay out of all that: turns are
named by a digest, and only the turns that a repaired conversation keeps fetch their texts.

A signature is solved by halves: for each pair of states of the pattern `(s?(ua)+)?` before and after a stretch, the
cheapest edits of the stretch. Stretches are remembered, so the halves that signatures share are solved once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import beside, written

SPACE = r"\x20\x09-\x0D"
ROLES = {"u": "user", "a": "assistant"}
#: What edits cost. A truncated turn that is not deleted adds the last one.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: States: nothing yet, after s, after u, after a; the role that comes next but for s, and the state it leads to.
NEXT_ROLE, NEXT_STATE = "uuau", (2, 2, 3, 2)
REMEMBERED = 64  # turns of a stretch that is remembered
ENDS = ("", "II", "I", "")  # what still has to be inserted in each state at the end

Edits = tuple[tuple[tuple[int, str] | None, ...], ...]


def _least(options: list[tuple[int, str]]) -> tuple[int, str] | None:
    return min(options, default=None)


def _one(turn: str) -> Edits:
    """The cheapest edits for one turn, with what is inserted ahead of it, from each state to each state."""
    rows = []
    for start in range(4):
        found: dict[int, list] = {}
        state, paid, said = start, 0, ""
        for _ in range(3):  # two insertions lead back to where other edits lead as well
            if turn == "d":
                found.setdefault(state, []).append((paid + DELETE, said + "D"))
            else:
                extra = TRUNCATED if turn.isupper() else 0
                role = turn.lower()
                found.setdefault(state, []).append((paid + DELETE, said + "D"))
                found.setdefault(NEXT_STATE[state], []).append((paid + extra + REROLE, said + "R"))
                if role == NEXT_ROLE[state]:
                    found.setdefault(NEXT_STATE[state], []).append((paid + extra, said + "K"))
                if role == "s" and state == 0:
                    found.setdefault(1, []).append((paid + extra, said + "K"))
            state, paid, said = NEXT_STATE[state], paid + INSERT, said + "I"
        rows.append(tuple(_least(found.get(end, [])) for end in range(4)))
    return tuple(rows)


@lru_cache(maxsize=20_000)
def _remembered(signature: str) -> Edits:
    return _halved(signature) if len(signature) > 1 else _one(signature)


def _stretch(signature: str) -> Edits:
    return _remembered(signature) if len(signature) <= REMEMBERED else _halved(signature)


def _halved(signature: str) -> Edits:
    """Of two ways between the same states that cost the same, none is the beginning of the other, so the least halves make
    the least whole."""
    cut = 1 << ((len(signature) - 1).bit_length() - 1)
    left, right = _stretch(signature[:cut]), _stretch(signature[cut:])
    rows = []
    for start in left:
        row = []
        for end in range(4):
            ways = [(x[0] + y[0], x[1], y[1]) for x, y in ((start[m], right[m][end]) for m in range(4)) if x and y]
            cost = min((w[0] for w in ways), default=0)
            row.append(_least([(c, a + b) for c, a, b in ways if c == cost]))
        rows.append(tuple(row))
    return tuple(rows)


def solve(signature: str) -> tuple[int, str]:
    """(cost, edits) of a signature: one character a turn, s, u, a or x for its role, capitals for truncated turns, and d for
    turns that must go. Edits are K, R, D and I; of the cheapest ones the least by ASCII."""
    if not signature:
        return 0, ""
    ways = [(way[0] + INSERT * len(ENDS[state]), way[1] + ENDS[state]) for state, way in enumerate(_stretch(signature)[0]) if way]
    return min(ways)


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = batch.column(0).to_pylist()
        found = [solve(s) for s in names]
        yield pa.RecordBatch.from_pydict({"signature": names, "cost": pa.array([c for c, _ in found], pa.int64()), "audit": [a for _, a in found]})


def _split(audit: str, sizes: list[int], starts_with_s: bool) -> list[tuple[str, int, int]]:
    """(edits, state before them, turns given before them) of each chunk; insertions go with the turn behind them, those at
    the end with the last chunk."""
    found, at, state, given = [], 0, 0, 0
    for nth, size in enumerate(sizes):
        stop, left = at, size
        while left:
            left -= audit[stop] != "I"
            stop += 1
        if nth == len(sizes) - 1:
            stop = len(audit)
        part = audit[at:stop]
        found.append((part, state, given))
        steps = len(part) - part.count("D")
        if steps and state == 0:  # the first turn given is s, or u
            state, steps = (1 if starts_with_s else 2), steps - 1
        if steps:
            first = 2 if state in (1, 3) else 3
            state = first if steps % 2 else 5 - first
        given += len(part) - part.count("D")
        at = stop
    return found


_PIECES = pa.schema([("cid", pa.string()), ("part", pa.int32()), ("edits", pa.string()), ("state", pa.int32()), ("given", pa.int64())])
_KEPT = pa.schema([("cid", pa.string()), ("name", pa.binary()), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string())])
TOGETHER = 20_000  # rows of a batch handed back


def _batched(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    while held := list(islice(rows, TOGETHER)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations (cid, signature, audit, chunks) -> edits of each chunk."""

    def rows():
        for row in (row for batch in batches for row in batch.to_pylist()):
            audit, signature = row["audit"], row["signature"]
            first = next((k for k, e in enumerate(audit) if e != "D"), None)
            kept_s = first is not None and audit[first] == "K" and signature[first] in "sS"
            for chunk, piece in zip(row["chunks"], _split(audit, [c["size"] for c in row["chunks"]], kept_s), strict=True):
                yield row["cid"], chunk["part"], *piece

    return _batched(rows(), _PIECES)


def _replayed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks (cid, turns, edits, state, given) -> the turns that stay, with their edit and their new role."""

    def rows():
        for row in (row for batch in batches for row in batch.to_pylist()):
            turns = iter([t for turn in row["turns"] for t in [turn] + [None] * (turn["copies"] - 1)])
            state, place = row["state"], row["given"]
            for edit in row["edits"]:
                turn = None if edit == "I" else next(turns)
                if edit == "D":
                    continue
                kept_s = edit == "K" and state == 0 and turn["letters"][0] in "sS"
                yield row["cid"], turn and turn["name"], place, edit, None if edit == "K" else ROLES[NEXT_ROLE[state]]
                state, place = 1 if kept_s else NEXT_STATE[state], place + 1

    return _batched(rows(), _KEPT)


def _initial(role: Column) -> Column:
    first = F.substring(role, 1, 1)
    return F.when(first.isin("s", "u", "a"), first).otherwise(F.lit("x"))


def _small(df: DataFrame, size: Column, most_bytes: int = 8_000_000) -> DataFrame:
    """A written table for a join, sent to all tasks where its rows hold at most so many bytes."""
    return F.broadcast(df) if (df.agg(F.sum(size + 100)).first()[0] or 0) <= most_bytes else df


def repair_conversations(rows: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Repair each conversation to role initials `(s?(ua)+)?` by the cheapest edits.

    Turns stand in ascending order (null turns first; rows of one turn by role and a digest of their text). A turn is
    blank without any character but ASCII white space, else a duplicate where an earlier one has its role and text, else
    truncated where its last such character is none of `.!?`. Keeping costs nothing, a new role (user or assistant) 3,
    deleting 4 (required for blank and duplicate turns), inserting an empty turn 3, and a truncated turn that stays 3 more.

    Returns two tables:
      * conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit: one row per conversation. gaps: turn numbers
        missing between the smallest and the largest; illegal: adjacent role initials other than su, ua, au; audit:
        initials of the edits in order, the least by ASCII of the cheapest.
      * conv_id, place, edit, role, text: the turns of the repaired conversations.

    Null roles and texts count as one space; a null conv_id is a conversation of its own; an empty table gives empty
    tables; other columns are ignored, whatever their names. Rows that repeat are counted before they are shuffled.
    """
    blank_text = F.lit(" ")
    base = rows.select(F.col(conv_id).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), blank_text).alias("role"), F.coalesce(F.col(text), blank_text).alias("text"))
    cid = F.coalesce(F.concat(F.lit("="), F.col("conv").cast("string")), F.lit(""))
    said = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    name = F.unhex(F.sha2(F.concat(cid, F.lit("\n"), F.coalesce(F.col("turn").cast("string"), F.lit("-")), F.lit("\n"), F.hex("said")), 256))
    named = base.withColumn("cid", cid).withColumn("said", said).withColumn("name", name)
    kind = F.when(~F.col("text").rlike(f"[^{SPACE}]"), "b").when(F.col("text").rlike(rf"[.!?][{SPACE}]*\z"), "g").otherwise("t")
    keys = ("cid", "turn", "role", "said", "name", "kind")
    skinny = named.select("conv", *keys[:-1], kind.alias("kind"))
    turns = written(skinny.groupBy("conv", *keys).agg(F.count(F.lit(1)).cast("int").alias("copies")), "turns")

    # a turn is fresh where it is the first one of its role and text in the conversation
    order = F.struct(F.col("turn").isNotNull().alias("has"), "turn")
    again = turns.groupBy("cid", "said").agg(F.min(order).alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").select("cid", "said", F.col("_first.turn").alias("_turn"), F.lit(True).alias("_many"))
    again = written(again, "repeated-turns")
    marked = turns.join(_small(again, F.length("cid") + 40), ["cid", "said"], "left")
    fresh = F.col("_many").isNull() | F.col("turn").eqNullSafe(F.col("_turn"))
    letter = F.when(F.col("kind") == "t", F.upper(_initial(F.col("role")))).otherwise(_initial(F.col("role")))
    letters = F.when((F.col("kind") == "b") | ~fresh, F.repeat(F.lit("d"), F.col("copies"))).otherwise(F.concat(letter, F.repeat(F.lit("d"), F.col("copies") - 1)))
    ranged = marked.select("conv", "cid", "turn", "role", "said", "name", "kind", "copies", letters.alias("letters")).repartitionByRange("cid", "turn", "role", "said")
    ordered = written(ranged.withColumn("part", F.spark_partition_id()), "ordered-turns")

    # a chunk: the turns of a conversation in one range
    each = F.struct(F.col("turn").isNotNull().alias("has"), "turn", "role", "said", "name", "kind", "copies", "letters")
    chunks = written(ordered.groupBy("cid", "part").agg(F.any_value("conv").alias("conv"), F.array_sort(F.collect_list(each)).alias("turns")), "chunks")
    total = lambda f: F.aggregate("turns", F.lit(0).cast("bigint"), lambda n, t: n + f(t))
    facts = chunks.select(
        "cid", "conv", "part", total(lambda t: t["copies"]).alias("size"), F.array_join(F.transform("turns", lambda t: t["letters"]), "").alias("signature"),
        F.array_join(F.transform("turns", lambda t: F.repeat(_initial(t["role"]), t["copies"])), "").alias("initials"), total(lambda t: F.when(t["kind"] == "b", t["copies"]).otherwise(0)).alias("blank"),
        F.filter(F.array_distinct(F.transform("turns", lambda t: t["turn"])), lambda t: t.isNotNull()).alias("numbers"),
    ).withColumns({"first": F.get("numbers", F.lit(0)), "last": F.try_element_at("numbers", F.lit(-1)), "distinct": F.size("numbers")}).drop("numbers")
    joined = facts.groupBy("cid").agg(F.any_value("conv").alias("conv"), F.array_sort(F.collect_list(F.struct("part", "size", "signature", "initials", "blank", "first", "last", "distinct"))).alias("chunks"))
    put = lambda c: F.array_join(F.transform("chunks", lambda x: x[c]), "")
    add = lambda f: F.aggregate("chunks", F.lit(0).cast("bigint"), lambda n, x: n + f(x))
    straddling = F.expr("size(filter(transform(chunks, (x, i) -> i > 0 and x.first = chunks[i - 1].last), hit -> hit))")
    convs = joined.select(
        "cid", "conv", put("signature").alias("signature"), put("initials").alias("initials"), add(lambda x: x["blank"]).alias("blank"), F.array_min(F.transform("chunks", lambda x: x["first"])).alias("low"),
        F.array_max(F.transform("chunks", lambda x: x["last"])).alias("high"), (add(lambda x: x["distinct"]) - straddling).alias("distinct"), F.transform("chunks", lambda x: F.struct(x["part"].alias("part"), x["size"].alias("size"))).alias("chunks"),
    )
    convs = written(convs, "signatures")

    solved = convs.select("signature").distinct().mapInArrow(_solved, "signature string, cost bigint, audit string")
    solved = written(solved, "solved-signatures")
    convs = written(convs.join(_small(solved, F.length("signature") + F.length("audit")), "signature"), "audited")
    legal, pairs = F.regexp_count("initials", F.lit("(?=su|ua|au)")), F.length("initials") - 1
    deleted = F.length(F.regexp_replace("signature", "[^d]", ""))
    summary = convs.select(
        F.col("conv").alias(conv_id), F.coalesce(F.col("high") - F.col("low") + 1 - F.col("distinct"), F.lit(0)).cast("bigint").alias("gaps"), "blank", (deleted - F.col("blank")).cast("bigint").alias("duplicate"),
        F.length(F.regexp_replace("signature", "[^A-Z]", "")).cast("bigint").alias("truncated"), (pairs - legal).cast("bigint").alias("illegal"), "cost", "audit",
    )

    pieces = written(convs.select("cid", "signature", "audit", "chunks").mapInArrow(_pieces, "cid string, part int, edits string, state int, given bigint"), "audit-pieces")
    edited = chunks.select("cid", "part", F.transform("turns", lambda t: F.struct(t["name"].alias("name"), t["copies"].alias("copies"), t["letters"].alias("letters"))).alias("turns"))
    edited = edited.join(pieces, ["cid", "part"]).mapInArrow(_replayed, "cid string, name binary, place bigint, edit string, role string")
    edited = written(edited, "edited-turns")
    texts = named.groupBy("name").agg(F.any_value("conv").alias("conv"), F.any_value("role").alias("_role"), F.any_value("text").alias("text"))
    found = texts.join(edited.where("name is not null"), "name").select("cid", "conv", "place", "edit", F.coalesce("role", "_role").alias("role"), "text")
    ids = convs.select("cid", "conv")
    fresh_turns = edited.where("name is null").join(ids, "cid").select("cid", "conv", "place", "edit", "role", F.lit("").alias("text"))
    repaired = found.unionByName(fresh_turns).select(F.col("conv").alias(conv_id), "place", "edit", "role", "text")
    return summary, repaired
