"""Conversation structure repair by iterative-deepening A*.

A conversation shall read ``(s?(ua)+)?`` in the first letters of its roles. Its
rows may be kept, given another role or deleted, and rows inserted, at the costs
``KEEP`` to ``INSERT``. ``cheapest`` searches depth first in ASCII order of the edits'
letters, leaves every branch whose cost so far plus a lower bound of the rest
exceeds the bound, remembers with what budget a (row, state) failed, and raises
the bound to the least excess until a path is accepted. That first path is the
cheapest, and of equally cheap ones the least in ASCII order. The lower bound is
the cost of a looser grammar: user and assistant take turns, a system row may
only be first, but either may begin and either may end.

Rows are dealt by range and sorted, so a task streams over whole conversations
and solves them on the way. A conversation that may go on in the next task, or
has more than ``PIECE`` rows, leaves as pieces of at most that many rows; of each
piece every way from one grammar state to another is searched, the costs are
folded along the conversation, and the pieces chosen are put together as a
stream. So no task holds a conversation, however long it is. Every piece ends
with an edit of a row: of two ways that edit the same rows none is the other's
beginning, and so the least whole is made of least pieces.

Defined results: a null role or text is one space, as is a null id or turn where
they are written as text; a null ``conv_id`` is a conversation; rows of one turn are
ordered by role, then text, null turns first; rows that repeat are duplicates
like any other; a conversation none of whose rows is left gives zeros and empty
texts; an empty table gives no rows; other columns are not touched. Equal rows
are told by role and text inside a piece, by their SHA-256 across pieces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from cueweave.plans.lineage import cut_lineage

#: Costs of the edits; a truncated row that stays costs ``TRUNCATED`` more.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Rows that a search handles at once.
PIECE = 512
SPACE = "\x20\t\n\x0b\x0c\r"
#: Grammar states: nothing yet, after a system row, after a user row, after an assistant row; the first and last are accepted.
START, SYSTEM, USER, ASSISTANT = range(4)
#: State after a kept row by its first letter, the state after a rerole or insertion, and what closes a conversation.
AFTER = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
TURNED = (USER, USER, ASSISTANT, USER)
NAMES = {USER: "user", ASSISTANT: "assistant"}
CLOSING = {START: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}
LEGAL = {"su", "ua", "au"}
#: Above any cost.
NEVER = 10**15


def damaged(rows: DataFrame) -> DataFrame:
    """The rows after the damage of the contract: ``conv_id, turn, role, text, gone`` (dropped rows stay, marked)."""
    blank = F.lit(" ")
    written = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    role, text = F.coalesce("role", blank), F.coalesce("text", blank)
    dealt = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.crc32(written) % 20).alias("kind"))
    bare = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    once = dealt.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), bare.alias("text"), "kind")
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return once.withColumn("copy", F.explode(copies)).select("conv_id", "turn", "role", "text", (F.col("kind") == 0).alias("gone"))


# ---- the search ------------------------------------------------------------------

def _moves(row, state: int):
    """(letter, cost, rows used, state) in ASCII order of the letters; ``row``: its role's first letter, must go, truncated."""
    letter, must_go, truncated = row
    extra = TRUNCATED * truncated
    out = [("D", DELETE, 1, state), ("I", INSERT, 0, TURNED[state])]
    if not must_go:
        kept = AFTER.get((state, letter))
        if kept is not None:
            out.append(("K", KEEP + extra, 1, kept))
        out.append(("R", REROLE + extra, 1, TURNED[state]))
    return out


def lower_bounds(rows: list, goal: int | None = None) -> list[tuple]:
    """Cost of the rest by row and state under the looser grammar (with a goal, that state at the end)."""
    out = [tuple(0 if goal in (None, state) else NEVER for state in range(4))]
    for letter, must_go, truncated in reversed(rows):
        below, extra = out[-1], TRUNCATED * truncated
        user, assistant = below[USER], below[ASSISTANT]
        # By state before the row, the cheapest edit that uses it.
        base = [DELETE + b for b in below]
        if not must_go:
            as_user, as_assistant = (extra + REROLE * (letter != k) + b for k, b in (("u", user), ("a", assistant)))
            if letter == "s":
                base[START] = min(base[START], extra + below[SYSTEM])
            for state, ways in ((START, (as_user, as_assistant)), (SYSTEM, (as_user, as_assistant)), (USER, (as_assistant,)), (ASSISTANT, (as_user,))):
                base[state] = min(base[state], *ways)
        out.append((
            min(base[START], INSERT + base[USER], INSERT + base[ASSISTANT]), min(base[SYSTEM], INSERT + base[USER], INSERT + base[ASSISTANT]),
            min(base[USER], INSERT + base[ASSISTANT]), min(base[ASSISTANT], INSERT + base[USER]),
        ))
    return out[::-1]


def cheapest(rows: list, start: int = START, goal: int | None = None) -> tuple[int, str] | None:
    """Cost and letters of the first path accepted; with a ``goal`` state the path ends there with an edit of the last row."""
    if not rows:
        closing = CLOSING[start] if goal is None else 0
        return (INSERT * closing, "I" * closing) if goal in (None, start) else None
    rest = lower_bounds(rows, goal)
    bound = rest[0][start]
    while bound < NEVER:
        path, bound = _bounded(rows, start, goal, rest, bound)
        if path is not None:
            return bound, path
    return None


def _bounded(rows, start, goal, rest, bound):
    """(path, its cost) within the bound, or (None, the least cost estimate beyond it)."""
    n, failed, beyond, path = len(rows), {}, NEVER, []
    ends = (START, ASSISTANT) if goal is None else (goal,)
    end = [("I", INSERT, 0, s) for s in TURNED]
    stack = [(0, start, 0, iter(_moves(rows[0], start)))]
    while stack:
        at, state, spent, moves = stack[-1]
        for letter, cost, used, after in moves:
            below, total = at + used, spent + cost
            if total + rest[below][after] > bound:
                beyond = min(beyond, total + rest[below][after])
                continue
            if failed.get((below, after), -1) >= bound - total:
                continue
            path.append(letter)
            if below == n and after in ends:
                return "".join(path), total
            more = _moves(rows[below], after) if below < n else [end[after]] if goal is None else []
            stack.append((below, after, total, iter(more)))
            break
        else:
            stack.pop()
            failed[at, state] = max(failed.get((at, state), -1), bound - spent)
            if path:
                path.pop()
    return None, beyond


def rewritten(roles: list[str], texts: list[str], letters: str, state: int = START) -> list[str]:
    """``role:text`` of the rows after the edits."""
    out, at = [], 0
    for letter in letters:
        if letter == "D":
            at += 1
            continue
        if letter == "K":
            out.append(f"{roles[at]}:{texts[at]}")
            state = AFTER[state, roles[at][:1]]
        else:
            state = TURNED[state]
            out.append(f"{NAMES[state]}:{texts[at] if letter == 'R' else ''}")
        at += letter != "I"
    return out


# ---- conversations on their way through a task ---------------------------------------

_STATS = "turn_min {t}, turn_max {t}, turn_first {t}, turn_last {t}, turns long, blank long, duplicate long, truncated long, illegal long, first string, last string"


def _fields(conv: str, turn: str) -> str:
    return (
        f"conv_id {conv}, pid int, seq long, whole boolean, {_STATS.format(t=turn)}, cost long, audit string, repaired string,"
        " roles array<string>, texts array<string>, blanks array<boolean>, cuts array<boolean>"
    )


def _counts(piece: dict, double: list[bool]) -> dict:
    """What is counted in a piece: rows by their first fault, neighbours, turns."""
    turns = [t for t in piece["turn"] if t is not None]
    first = [r[:1] for r in piece["role"]]
    cut = sum(c and not b and not d for c, b, d in zip(piece["cut"], piece["blank"], double, strict=True))
    return {
        "turn_min": min(turns, default=None), "turn_max": max(turns, default=None), "turn_first": turns[0] if turns else None,
        "turn_last": turns[-1] if turns else None, "turns": len(set(turns)), "blank": sum(piece["blank"]),
        "duplicate": sum(d and not b for d, b in zip(double, piece["blank"], strict=True)), "truncated": cut,
        "illegal": sum(a + b not in LEGAL for a, b in zip(first, first[1:])), "first": first[0] if first else None, "last": first[-1] if first else None,
    }


def _seen_before(roles: list[str], texts: list[str]) -> list[bool]:
    seen: set = set()
    return [(r, t) in seen or bool(seen.add((r, t))) for r, t in zip(roles, texts, strict=True)]


def _codes(roles, blanks, cuts, double) -> list[tuple]:
    return [(r[:1], b or d, c and not b and not d) for r, b, c, d in zip(roles, blanks, cuts, double, strict=True)]


def _solved(piece: dict) -> dict:
    double = _seen_before(piece["role"], piece["text"])
    cost, audit = cheapest(_codes(piece["role"], piece["blank"], piece["cut"], double))
    return _counts(piece, double) | {"whole": True, "cost": cost, "audit": audit, "repaired": "\n".join(rewritten(piece["role"], piece["text"], audit))}


def _unsolved(piece: dict) -> dict:
    return _counts(piece, [False] * len(piece["role"])) | {
        "whole": False, "roles": piece["role"], "texts": piece["text"], "blanks": piece["blank"], "cuts": piece["cut"],
    }


def _pieces(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[dict, bool]]:
    """Pieces of one conversation's rows, and whether the conversation surely began and ended in them."""
    held, inside, none = None, False, True
    names = ("turn", "role", "text", "blank", "cut")
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "gone", *names)]
        for conv, gone, *row in zip(*columns, strict=True):
            if none or conv != held["conv_id"]:
                if not none:
                    yield held, inside and not held["seq"]
                    inside = True
                held, none = {"conv_id": conv, "seq": 0} | {k: [] for k in names}, False
            if gone:
                continue
            if len(held["role"]) == size:
                yield held, False
                held = {"conv_id": conv, "seq": held["seq"] + 1} | {k: [] for k in names}
            for k, v in zip(names, row, strict=True):
                held[k].append(v)
    if not none:
        yield held, False  # the last conversation may go on in the next task


def streamed(rows: DataFrame, size: int = PIECE) -> DataFrame:
    """Solved conversations, and pieces of the others, of rows as ``damaged`` gives them."""
    blank = F.lit(" ")
    body = F.coalesce("text", blank)
    trimmed = F.rtrim(body, F.lit(SPACE))
    keys = ["conv_id", "turn", "role", "text"]
    marked = rows.select(
        "conv_id", "turn", F.coalesce("role", blank).alias("role"), body.alias("text"), "gone", (trimmed == "").alias("blank"),
        (~F.substring(trimmed, -1, 1).isin(".", "!", "?")).alias("cut"),
    ).withColumn("head", F.substring("text", 1, 32))
    # Range borders are drawn from samples on the driver, so from the beginnings of texts alone.
    dealt = marked.repartitionByRange("conv_id", "turn", "role", "head").sortWithinPartitions(*keys).drop("head")
    kinds = [rows.schema[c].dataType.simpleString() for c in ("conv_id", "turn")]
    schema = _fields(*kinds)
    types = _arrow(rows.sparkSession, schema)
    names = [f.strip().split(" ")[0] for f in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pid, out, weight = TaskContext.get().partitionId(), [], 0
        for at, (piece, whole) in enumerate(_pieces(batches, size)):
            found = _solved(piece) if whole else _unsolved(piece)
            out.append({"conv_id": piece["conv_id"], "pid": pid} | found | {"seq": at})
            weight += sum(map(len, piece["text"])) + 100
            if weight > 4_000_000:
                yield _batch(out, names, types)
                out, weight = [], 0
        if out:
            yield _batch(out, names, types)

    return dealt.mapInArrow(run, schema)


def _arrow(spark: SparkSession, schema: str) -> pa.Schema:
    return to_arrow_schema(spark.createDataFrame([], schema).schema)


def _batch(rows: list[dict], names: list[str], types: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r.get(c) for r in rows], types.field(c).type) for c in names], schema=types)


# ---- conversations in pieces -----------------------------------------------------------

def _doubles(pieces: DataFrame) -> DataFrame:
    """``pid, seq, double``: places of the rows whose role and text the conversation has before."""
    digest = F.transform(F.arrays_zip("roles", "texts"), lambda r: F.sha2(F.concat(F.length(r["roles"]).cast("string"), F.lit(":"), r["roles"], r["texts"]), 256))
    rows = pieces.select("conv_id", "pid", "seq", F.posexplode(digest).alias("at", "digest"))
    first = rows.groupBy("conv_id", "digest").agg(F.min(F.struct("pid", "seq", "at")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    again = rows.join(first.drop("n"), rows["conv_id"].eqNullSafe(first["conv_id"]) & (rows["digest"] == first["digest"])).where(
        F.struct("pid", "seq", "at") != F.col("first")
    )
    return again.groupBy("pid", "seq").agg(F.collect_list("at").alias("double"))


def _ways(pieces: DataFrame) -> DataFrame:
    """``conv_id, pid, seq, ways, duplicate, truncated``: the cheapest way from every state to every other through each piece."""
    conv = pieces.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ways, doubles, cuts = [], [], []
            for row in batch.select(["roles", "blanks", "cuts", "double"]).to_pylist():
                marked = set(row["double"] or ())
                codes = _codes(row["roles"], row["blanks"], row["cuts"], [k in marked for k in range(len(row["roles"]))])
                each = [(p, q, cheapest(codes, p, q)) for p in range(4) for q in range(4)]
                ways.append([{"p": p, "q": q, "cost": f[0], "letters": f[1]} for p, q, f in each if f])
                doubles.append(sum(k in marked and not b for k, b in enumerate(row["blanks"])))
                cuts.append(sum(c[2] for c in codes))
            kind = pa.list_(pa.struct([("p", pa.int32()), ("q", pa.int32()), ("cost", pa.int64()), ("letters", pa.string())]))
            yield pa.record_batch({
                **{c: batch.column(c) for c in ("conv_id", "pid", "seq")}, "ways": pa.array(ways, kind),
                "duplicate": pa.array(doubles, pa.int64()), "truncated": pa.array(cuts, pa.int64()),
            })

    slim = pieces.select("conv_id", "pid", "seq", "roles", "blanks", "cuts", "double")
    return slim.mapInArrow(run, f"conv_id {conv}, pid int, seq long, ways array<struct<p:int,q:int,cost:long,letters:string>>, duplicate long, truncated long")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, dict]]:
    """Rows, each with whether another conversation begins with it."""
    held = ...
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1).to_pylist()[0]
            yield held is ... or row["conv_id"] != held, row
            held = row["conv_id"]


def _chosen(ways: DataFrame) -> DataFrame:
    """``pid, seq, p, letters``: the way through each piece of the cheapest whole, ties ASCII-least.

    Held per piece of a conversation: which state each of four states came from.
    """

    def settle(pieces, best):
        last = min(best, key=lambda q: (best[q][0] + INSERT * CLOSING[q], best[q][1]))
        out, q = [], last
        for pid, seq, came in reversed(pieces):
            out.append((pid, seq, came[q], q))
            q = came[q]
        for k, (pid, seq, p, q) in enumerate(reversed(out)):
            yield pid, seq, p, q, CLOSING[last] if k + 1 == len(out) else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, best = [], {}
        for fresh, row in _runs(batches):
            if fresh:
                if pieces:
                    yield _chosen_batch(settle(pieces, best))
                pieces, best = [], {START: (0, 0)}
            # (cost, rank among the beginnings, letters, state before) by state
            found: dict[int, tuple] = {}
            for w in row["ways"]:
                if w["p"] in best:
                    cost, rank = best[w["p"]]
                    way = (cost + w["cost"], rank, w["letters"], w["p"])
                    found[w["q"]] = min(found.get(w["q"], way), way)
            order = sorted(found, key=lambda q: found[q][1:3])
            best = {q: (found[q][0], order.index(q)) for q in found}
            pieces.append((row["pid"], row["seq"], {q: found[q][3] for q in found}))
        if pieces:
            yield _chosen_batch(settle(pieces, best))

    slim = ways.select("conv_id", "pid", "seq", "ways").repartition("conv_id").sortWithinPartitions("conv_id", "pid", "seq")
    picked = slim.mapInArrow(run, "pid int, seq long, p int, q int, closing int")
    joined = ways.select("pid", "seq", "duplicate", "truncated", F.explode("ways").alias("way")).select("pid", "seq", "duplicate", "truncated", "way.*")
    return joined.join(picked, ["pid", "seq", "p", "q"]).withColumn("letters", F.concat("letters", F.repeat(F.lit("I"), F.col("closing")))).withColumn(
        "cost", F.col("cost") + INSERT * F.col("closing")
    )


def _chosen_batch(found) -> pa.RecordBatch:
    pid, seq, p, q, closing = zip(*found, strict=True)
    return pa.record_batch([pa.array(pid, pa.int32()), pa.array(seq, pa.int64()), *(pa.array(x, pa.int32()) for x in (p, q, closing))], names=["pid", "seq", "p", "q", "closing"])


_RESULT = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def _assembled(parts: DataFrame) -> DataFrame:
    """One row per conversation of pieces with their way and new text, as a stream in order."""
    conv = parts.schema["conv_id"].dataType.simpleString()
    counts = ("blank", "duplicate", "truncated", "illegal", "cost")
    schema = f"conv_id {conv}, " + ", ".join(f"{c} {'string' if c in ('audit', 'repaired_sha256') else 'long'}" for c in _RESULT[1:])
    types = _arrow(parts.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {}

        def result() -> pa.RecordBatch:
            gaps = 0 if state["low"] is None else state["high"] - state["low"] + 1 - state["turns"]
            flat = [state["conv_id"], gaps, *(state[c] for c in counts), "".join(state["audit"]), state["digest"].hexdigest()]
            return pa.record_batch([pa.array([v], types.field(c).type) for c, v in zip(_RESULT, flat, strict=True)], schema=types)

        for fresh, row in _runs(batches):
            if fresh:
                if state:
                    yield result()
                state = {"conv_id": row["conv_id"], "low": None, "high": None, "turns": 0, "turn": None, "last": None, "audit": [], "digest": hashlib.sha256(), "any": False}
                state |= dict.fromkeys(counts, 0)
            for c in counts:
                state[c] += row[c]
            if row["first"] is not None:
                state["illegal"] += state["last"] is not None and state["last"] + row["first"] not in LEGAL
                state["last"] = row["last"]
            if row["turn_min"] is not None:
                state["low"] = row["turn_min"] if state["low"] is None else min(state["low"], row["turn_min"])
                state["high"] = row["turn_max"] if state["high"] is None else max(state["high"], row["turn_max"])
                state["turns"] += row["turns"] - (state["turn"] == row["turn_first"])
                state["turn"] = row["turn_last"]
            state["audit"].append(row["letters"])
            if row["lines"]:
                state["digest"].update((("\n" if state["any"] else "") + row["repaired"]).encode("utf-8", "surrogatepass"))
                state["any"] = True
        if state:
            yield result()

    return parts.repartition("conv_id").sortWithinPartitions("conv_id", "pid", "seq").mapInArrow(run, schema)


def _rewritten_parts(pieces: DataFrame, chosen: DataFrame) -> DataFrame:
    """The pieces with their way and their new lines."""
    joined = pieces.drop("cost", "audit", "repaired", "duplicate", "truncated").join(chosen, ["pid", "seq"])
    kinds = {f.name: f.dataType.simpleString() for f in joined.schema}
    kept = [c for c in joined.columns if c not in ("roles", "texts", "blanks", "cuts", "double")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = [
                rewritten(r["roles"], r["texts"], r["letters"], r["p"]) for r in batch.select(["roles", "texts", "letters", "p"]).to_pylist()
            ]
            yield pa.record_batch(
                [*(batch.column(c) for c in kept), pa.array(["\n".join(x) for x in lines]), pa.array([len(x) for x in lines], pa.int32())],
                names=[*kept, "repaired", "lines"],
            )

    return joined.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in kept) + ", repaired string, lines int")


def solved(rows: DataFrame, size: int = PIECE) -> tuple[DataFrame, DataFrame]:
    """Whole conversations as they were solved, and the pieces of the others with the way chosen through them."""
    found = cut_lineage(streamed(rows, size), "conversations")
    pieces = found.where("not whole")
    marked = pieces.join(_doubles(pieces), ["pid", "seq"], "left")
    ways = cut_lineage(_ways(marked), "ways")
    return found.where("whole"), cut_lineage(_rewritten_parts(pieces, _chosen(ways)), "repaired")


def repair(rows: DataFrame, size: int = PIECE) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256`` per conversation; ``rows`` as of ``damaged``."""
    whole, parts = solved(rows, size)
    gaps = F.coalesce(F.col("turn_max") - F.col("turn_min") + 1 - F.col("turns"), F.lit(0)).cast("long")
    direct = whole.select(
        "conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.sha2("repaired", 256).alias("repaired_sha256")
    )
    return direct.unionByName(_assembled(parts))


def repaired(rows: DataFrame, size: int = PIECE) -> DataFrame:
    """``conv_id, part, repaired``: the repaired conversations' lines, long ones in several parts (in order of ``part``)."""
    whole, parts = solved(rows, size)
    order = (F.col("pid").cast("long") * 2**32 + F.col("seq")).alias("part")
    return whole.select("conv_id", order, "repaired").unionByName(parts.where("lines > 0").select("conv_id", order, "repaired"))
