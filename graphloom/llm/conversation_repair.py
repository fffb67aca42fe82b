"""Structure repair of conversations: the cheapest edits that make the roles alternate, with an audit of every edit.

Conversations are bucketed by length and laid out time-major, so one NumPy step updates the state costs of all conversations
of a bucket at once.  The backward pass stores the cost to go of every row and state; the forward pass reads the edits from
it, smallest letter first, again for all conversations at a time.

A conversation of more than LONG rows is cut into segments that are dealt out alone: the costs of a segment from each state
at its start to each at its end form a 4 x 4 matrix, matrices chain by (min, +), and with the costs at its end known every
segment traces its own edits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, col, small_enough

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: States: nothing yet, behind a system turn, behind a user turn, behind an assistant turn; a conversation may end in the first and the last.
START, SYSTEM, USER, ASSISTANT, STATES = 0, 1, 2, 3, 4
ENDS = np.array([True, False, False, True])
#: The turn that an insertion or a new role makes in a state, as the state behind it.
MADE = np.array([USER, USER, ASSISTANT, USER])
#: Initials as codes: s, u, a, any other; and the state behind a kept turn, -1 where it may not stand.
CODES = {"s": 0, "u": 1, "a": 2}
KEPT = np.array([[SYSTEM, USER, -1, -1], [-1, USER, -1, -1], [-1, -1, ASSISTANT, -1], [-1, USER, -1, -1]])
FAR = np.int64(1) << 40
NAMES = {USER: "user", ASSISTANT: "assistant"}
LETTERS = np.frombuffer(b"DIKR", np.uint8)
D, I, K, R = range(4)

#: Rows of a conversation that are repaired in one piece, and of a segment; cells (time x conversations) of a tensor.
LONG, SEGMENT, CELLS = 2_048, 2_048, 1 << 18
#: Bytes of text that a task holds at once; a conversation of more goes in segments too.  Long conversations that may be broadcast.
MOST_BYTES, MOST_BROADCAST = 32_000_000, 100_000
_BLANKS = " \t\n\x0b\f\r"


def backward(code: np.ndarray, lost: np.ndarray, cut: np.ndarray, used: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Costs to go, (time + 1) x conversations x states.  code, lost (to be deleted), cut (truncated) and used (not padding) are
    time x conversations; last holds the costs behind the last row."""
    time, many = code.shape
    costs = np.empty((time + 1, many, STATES), np.int64)
    costs[time] = last
    for t in range(time - 1, -1, -1):
        after = costs[t + 1]
        kept = KEPT[:, code[t]].T  # conversations x states
        keep = np.where((kept >= 0) & ~lost[t][:, None], KEEP + TRUNCATED * cut[t][:, None] + np.take_along_axis(after, np.maximum(kept, 0), 1), FAR)
        rerole = np.where(lost[t][:, None], FAR, REROLE + TRUNCATED * cut[t][:, None] + after[:, MADE])
        best = with_inserts(np.minimum(np.minimum(keep, rerole), DELETE + after))
        costs[t] = np.where(used[t][:, None], best, after)
    return costs


def with_inserts(costs: np.ndarray) -> np.ndarray:
    """Costs where turns may be inserted first; two insertions reach every state that any number reaches."""
    for _ in range(2):
        costs = np.minimum(costs, INSERT + costs[:, MADE])
    return costs


def trace(costs: np.ndarray, code: np.ndarray, lost: np.ndarray, cut: np.ndarray, used: np.ndarray, state: np.ndarray, ending: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(edits, roles, state): letters by time and conversation (-1: none) with the state behind each, and the state at the end.

    Of edits that lead to the least cost the smallest letter is taken; a letter fixes the next state, so this is the least string.
    """
    time, many = code.shape
    every, state = np.arange(many), state.copy()
    edits, roles = (np.full((3 * time + 3, many), -1, np.int8) for _ in range(2))
    slot = 0
    for t in range(time):
        here, after = costs[t], costs[t + 1]
        open_ = used[t].copy()
        for _ in range(3):
            now = here[every, state]
            deletes = open_ & (DELETE + after[every, state] == now)
            inserts = open_ & ~deletes & (INSERT + here[every, MADE[state]] == now)
            kept = KEPT[state, code[t]]
            extra = TRUNCATED * cut[t]
            keeps = open_ & ~deletes & ~inserts & ~lost[t] & (kept >= 0) & (KEEP + extra + after[every, np.maximum(kept, 0)] == now)
            reroles = open_ & ~deletes & ~inserts & ~keeps
            for letter, which in ((D, deletes), (I, inserts), (K, keeps), (R, reroles)):
                edits[slot][which] = letter
            state = np.where(inserts | reroles, MADE[state], np.where(keeps, kept, state))
            roles[slot] = state
            open_ = inserts
            slot += 1
    for _ in range(3 if ending else 0):
        inserts = ~ENDS[state]
        edits[slot][inserts] = I
        state = np.where(inserts, MADE[state], state)
        roles[slot] = state
        slot += 1
    return edits, roles, state


def _tensor(rows: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """Codes 0 to 3, + 4 lost, + 8 truncated, of conversations of like length, as time x conversations."""
    flat = np.zeros((max(map(len, rows)), len(rows)), np.uint8)
    used = np.zeros(flat.shape, bool)
    for c, row in enumerate(rows):
        flat[: len(row), c], used[: len(row), c] = row, True
    return flat & 3, (flat & 4) > 0, (flat & 8) > 0, used


_LAST = with_inserts(np.where(ENDS, np.int64(0), FAR)[None, :])[0]


def repairs(rows: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(cost, letters, states behind them) of each conversation, in order."""
    if not rows:
        return
    code, lost, cut, used = _tensor(rows)
    costs = backward(code, lost, cut, used, np.tile(_LAST, (len(rows), 1)))
    edits, roles, _ = trace(costs, code, lost, cut, used, np.zeros(len(rows), np.int64), True)
    for c in range(len(rows)):
        there = edits[:, c] >= 0
        yield int(costs[0, c, START]), edits[there, c], roles[there, c]


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, turn, role, text of what is left of the rows after the damage that the hash of `conv:turn` picks; nulls in what is hashed and in role and text are one space."""
    space = F.lit(" ")
    base = rows.select(col(conv).cast("long").alias("conv"), col(turn).cast("long").alias("turn"), F.coalesce(col(role).cast("string"), space).alias("role"), F.coalesce(col(text).cast("string"), space).alias("text"))
    base = base.withColumn("kind", F.crc32(F.encode(F.concat(F.coalesce(F.col("conv").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space)), "UTF-8")) % 20)
    text_now = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    out = base.where("kind <> 0").select("conv", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text_now.alias("text"), F.when(F.col("kind") == 3, 2).otherwise(1).alias("times"))
    return out.withColumn("times", F.explode(F.sequence(F.lit(1), "times"))).drop("times")


def _facts() -> Column:
    """The code of a row without regard to duplicates: its initial, + 4 if blank, + 8 if the text does not end a sentence."""
    initial = F.when(F.col("role").startswith("s"), 0).when(F.col("role").startswith("u"), 1).when(F.col("role").startswith("a"), 2).otherwise(3)
    solid = F.rtrim("text", F.lit(_BLANKS))
    return (initial + F.when(solid == "", 4).when(F.right(solid, F.lit(1)).isin(".", "!", "?"), 0).otherwise(8)).cast("int")


_RESULT = "conv long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string, repaired array<struct<role:string,text:string>>"
LEGAL = np.zeros((4, 4), bool)
LEGAL[[0, 1, 2], [1, 2, 1]] = True


def _repaired(letters: np.ndarray, states: np.ndarray, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    for letter, state in zip(letters.tolist(), states.tolist(), strict=True):
        if letter == I:
            yield NAMES[state], ""
        else:
            role, text = next(rows)
            if letter != D:
                yield (role if letter == K else NAMES[state]), text


def _short(texts: bool):
    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # conversations by the power of two that holds their length; a bucket is repaired when its tensor is full
        buckets: dict[int, list[tuple]] = {}
        held = 0
        schema = pa.schema([("conv", pa.int64()), *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("repaired_sha256", pa.string()), ("repaired", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))])

        def solve(convs: list[tuple]) -> pa.RecordBatch:
            out = []
            for (conv, rows, codes, turns), (cost, letters, states) in zip(convs, repairs([c[2] for c in convs]), strict=True):
                digest, parts = hashlib.sha256(), []
                for n, (role, text) in enumerate(_repaired(letters, states, iter(rows))):
                    digest.update(("\n" * (n > 0) + f"{role}:{text}").encode())
                    if texts:
                        parts.append({"role": role, "text": text})
                initials, fault = codes & 3, (codes >> 2) & 3
                known = [t for t in turns if t is not None]
                gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
                blank, duplicate = sum(1 for r in rows if not r[1].strip(_BLANKS)), int((codes & 4 > 0).sum())
                out.append({"conv": conv, "gaps": gaps, "blank": blank, "duplicate": duplicate - blank, "truncated": int((fault == 2).sum()), "illegal": int((~LEGAL[initials[:-1], initials[1:]]).sum()), "cost": cost, "audit": LETTERS[letters].tobytes().decode(), "repaired_sha256": digest.hexdigest(), "repaired": parts if texts else None})
            return pa.RecordBatch.from_pylist(out, schema)

        def put(conv: int | None, rows: list, codes: list, turns: list) -> Iterator[pa.RecordBatch]:
            seen: set = set()
            for i, row in enumerate(rows):
                if codes[i] & 4 == 0 and row in seen:
                    codes[i] = (codes[i] & 3) | 4
                seen.add(row)
            size = 1 << (len(rows) - 1).bit_length()
            bucket = buckets.setdefault(size, [])
            bucket.append((conv, rows, np.array(codes, np.uint8), turns))
            if len(bucket) * size >= CELLS:
                yield solve(buckets.pop(size))

        now, rows, codes, turns = None, [], [], []
        for batch in batches:
            for conv, turn, role, text, code in zip(*(batch.column(c).to_pylist() for c in ("conv", "turn", "role", "text", "code")), strict=True):
                if rows and conv != now:
                    yield from put(now, rows, codes, turns)
                    rows, codes, turns = [], [], []
                    if held >= MOST_BYTES:
                        yield from map(solve, buckets.values())
                        buckets.clear()
                        held = 0
                now = conv
                rows.append((role, text))
                held += len(text)
                codes.append(code)
                turns.append(turn)
        if rows:
            yield from put(now, rows, codes, turns)
        yield from map(solve, buckets.values())

    return repair


def _solved(rows: DataFrame, texts: bool) -> DataFrame:
    """Conversations that a task repairs whole."""
    dealt = rows.repartition("conv").sortWithinPartitions(F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text")
    return dealt.mapInArrow(_short(texts), _RESULT)


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Costs of a segment from each state at its start to each at its end, its illegal pairs and its first and last initial."""
    for batch in batches:
        rows = [np.array(c, np.uint8) for c in batch.column("codes").to_pylist()]
        n, tensors = len(rows), _tensor(rows * STATES)
        last = np.full((STATES * n, STATES), FAR)
        for end in range(STATES):
            last[end * n : (end + 1) * n, end] = 0
        costs = backward(*tensors, last)[0].reshape(STATES, n, STATES)
        out = [costs[:, c, :].T.ravel().tolist() for c in range(n)]
        pairs = [int((~LEGAL[r[:-1] & 3, r[1:] & 3]).sum()) for r in rows]
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("segment"), pa.array(out, pa.list_(pa.int64())), pa.array(pairs, pa.int64()), pa.array([int(r[0] & 3) for r in rows], pa.int32()), pa.array([int(r[-1] & 3) for r in rows], pa.int32())], names=["key", "segment", "matrix", "pairs", "first", "last"])


def _chained(table: pa.Table) -> pa.Table:
    """The costs behind every segment of a conversation, from its last to its first."""
    rows = table.sort_by("segment").to_pylist()
    after, behind = _LAST, []
    for row in reversed(rows):
        behind.append(after.tolist())
        after = np.minimum((np.array(row["matrix"]).reshape(STATES, STATES) + after[None, :]).min(axis=1), FAR)
        after = with_inserts(after[None, :])[0]
    illegal = sum(r["pairs"] for r in rows) + sum(int(not LEGAL[a["last"], b["first"]]) for a, b in zip(rows, rows[1:], strict=False))
    n = len(rows)
    return pa.table({"key": [r["key"] for r in rows], "segment": [r["segment"] for r in rows], "after": pa.array(behind[::-1], pa.list_(pa.int64())), "cost": pa.array([int(after[START])] * n, pa.int64()), "illegal": pa.array([illegal] * n, pa.int64()), "ending": [i == n - 1 for i in range(n)]})


def _traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edits of a segment from each state at its start, and the state at its end."""
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            code, lost, cut, used = _tensor([np.array(row["codes"], np.uint8)] * STATES)
            costs = backward(code, lost, cut, used, np.tile(np.array(row["after"], np.int64), (STATES, 1)))
            edits, roles, ends = trace(costs, code, lost, cut, used, np.arange(STATES), row["ending"])
            letters = ["".join("DIKR"[x] for x in edits[:, s] if x >= 0) for s in range(STATES)]
            states = ["".join(str(y) for x, y in zip(edits[:, s], roles[:, s], strict=True) if x >= 0) for s in range(STATES)]
            out.append({"key": row["key"], "segment": row["segment"], "letters": letters, "states": states, "ends": ends.tolist()})
        yield pa.RecordBatch.from_pylist(out, pa.schema([("key", pa.string()), ("segment", pa.int64()), ("letters", pa.list_(pa.string())), ("states", pa.list_(pa.string())), ("ends", pa.list_(pa.int32()))]))


def _entered(table: pa.Table) -> pa.Table:
    rows, state, at = table.sort_by("segment").to_pylist(), START, []
    for row in rows:
        at.append(state)
        state = row["ends"][state]
    return pa.table({"key": [r["key"] for r in rows], "segment": [r["segment"] for r in rows], "state": pa.array(at, pa.int32())})


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each repaired conversation; rows come in order, before those of a segment its edits.  Only one segment's edits are held."""
    now, digest, first, edits, out = None, None, True, iter(()), []

    def put(role: str, text: str) -> None:
        nonlocal first
        digest.update((("" if first else "\n") + f"{role}:{text}").encode())
        first = False

    def insert() -> tuple | None:
        for letter, state in edits:
            if letter != "I":
                return letter, state
            put(NAMES[int(state)], "")
        return None

    for batch in batches:
        for key, pos, role, text, letters, states in zip(*(batch.column(c).to_pylist() for c in ("key", "pos", "role", "text", "letters", "states")), strict=True):
            if key != now or digest is None:
                if digest is not None:
                    insert()
                    out.append((now, digest.hexdigest()))
                now, digest, first, edits = key, hashlib.sha256(), True, iter(())
            if pos < 0:
                insert()
                edits = iter(zip(letters, states, strict=True))
                continue
            letter, state = insert()
            if letter != "D":
                put(role if letter == "K" else NAMES[int(state)], text)
    if digest is not None:
        insert()
        out.append((now, digest.hexdigest()))
    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.string()), pa.array([d for _, d in out], pa.string())], names=["key", "repaired_sha256"])


def _solved_in_segments(work: Workspace, rows: DataFrame) -> DataFrame:
    """Conversations of any length.  What one task gets of a conversation is a segment, a matrix for each segment, or, for the
    digest, which has to read the whole in order, a stream of its rows."""
    order = [F.col("key").asc(), F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("text").asc(), F.col("salt").asc()]
    keyed = rows.withColumn("key", F.coalesce(F.col("conv").cast("string"), F.lit(""))).withColumn("salt", F.xxhash64(F.monotonically_increasing_id()))
    rows = work.save(keyed.orderBy(*order).drop("salt").withColumn("pos", F.monotonically_increasing_id()), "ordered")
    rows = rows.withColumn("segment", F.expr(f"shiftright(pos, 33) * {(1 << 33) // SEGMENT} + (pos & {(1 << 33) - 1}) div {SEGMENT}"))
    firsts = rows.where("(code & 4) = 0").groupBy("key", "role", F.sha2("text", 256).alias("text")).agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("is_first"))
    repeated = F.expr("(code & 4) = 0 and is_first is null")
    light = rows.drop("text", "role").join(firsts, "pos", "left")
    light = work.save(light.select("key", "conv", "pos", "segment", "turn", F.when(repeated, F.expr("(code & 3) + 4")).otherwise(F.col("code")).alias("code"), F.expr("(code & 4) > 0").alias("is_blank"), repeated.alias("is_repeated")), "light")
    count = lambda c: F.count(F.when(F.expr(c), 1))
    stats = light.groupBy("key", "conv").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps"), count("is_blank").alias("blank"), count("is_repeated").alias("duplicate"), count("code >= 8").alias("truncated"))
    codes = F.expr("transform(array_sort(collect_list(struct(pos, code))), x -> x.code)").alias("codes")
    segments = work.save(light.groupBy("key", "segment").agg(codes), "segments")
    matrices = segments.mapInArrow(_matrices, "key string, segment long, matrix array<long>, pairs long, first int, last int")
    chained = work.save(matrices.groupBy("key").applyInArrow(_chained, "key string, segment long, after array<long>, cost long, illegal long, ending boolean"), "chained")
    traced = segments.join(chained, ["key", "segment"]).select("key", "segment", "codes", "after", "ending")
    traced = work.save(traced.mapInArrow(_traced, "key string, segment long, letters array<string>, states array<string>, ends array<int>"), "traced")
    entered = traced.select("key", "segment", "ends").groupBy("key").applyInArrow(_entered, "key string, segment long, state int")
    edits = work.save(traced.join(entered, ["key", "segment"]).select("key", "segment", F.expr("letters[state]").alias("letters"), F.expr("states[state]").alias("states")), "edits")
    audits = edits.groupBy("key").agg(F.expr("array_join(transform(array_sort(collect_list(struct(segment, letters))), x -> x.letters), '')").alias("audit"))
    nothing = F.lit(None).cast("string")
    stream = rows.select("key", "segment", "pos", "role", "text", nothing.alias("letters"), nothing.alias("states"))
    stream = stream.unionByName(edits.select("key", "segment", F.lit(-1).cast("long").alias("pos"), nothing.alias("role"), nothing.alias("text"), "letters", "states"))
    digests = stream.repartition("key").sortWithinPartitions("key", "segment", "pos").mapInArrow(_hashed, "key string, repaired_sha256 string")
    costs = chained.groupBy("key").agg(F.first("cost").alias("cost"), F.first("illegal").alias("illegal"))
    whole = stats.join(costs, "key").join(audits, "key").join(digests, "key")
    return whole.select("conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256", F.lit(None).cast("array<struct<role:string,text:string>>").alias("repaired"))


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", texts: bool = True, damage: bool = False, long: int = LONG) -> DataFrame:
    """conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256, repaired for every conversation.

    Rows go by turn, nulls first, and rows of one turn by role and text.  Null roles and texts are one space, so such texts
    are blank; a null conversation is one like others.  Repeated rows are duplicates.  A role counts by its first letter (s,
    u, a); others have to get a new one or go.  Equal costs fall to the ASCII-least audit.  `damage` harms the rows first;
    conversations that lose all rows have zeros, an empty audit and the digest of nothing.  Conversations of over `long`
    rows or 32 MB of text go in segments and have a null `repaired` (as all have without `texts`); the rest is the same.
    An empty table gives no rows; further columns don't matter.
    """
    work = Workspace(rows.sparkSession, "conversations")
    convs = rows.select(col(conv).cast("long").alias("conv")).distinct()
    if damage:
        left = damaged(rows, conv, turn, role, text)
    else:
        left = rows.select(col(conv).cast("long").alias("conv"), col(turn).cast("long").alias("turn"), F.coalesce(col(role).cast("string"), F.lit(" ")).alias("role"), F.coalesce(col(text).cast("string"), F.lit(" ")).alias("text"))
    left = left.withColumn("code", _facts())
    sizes = left.groupBy("conv").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    large = work.save(sizes.where(f"n > {long} or bytes > {MOST_BYTES}").select(F.col("conv").alias("c")), "large")
    if large.isEmpty():
        out = _solved(left, texts)
    else:
        marked = F.broadcast(large) if small_enough(large, MOST_BROADCAST) else large
        same = F.col("conv").eqNullSafe(F.col("c"))
        out = _solved(left.join(marked, same, "left_anti"), texts).unionByName(_solved_in_segments(work, left.join(marked, same, "left_semi")))
    out = out.withColumnRenamed("conv", "of")
    zero = {c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    joined = convs.join(out, F.col("conv").eqNullSafe(F.col("of")), "left")
    nothing = hashlib.sha256(b"").hexdigest()
    return joined.select("conv", *zero.values(), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"), "repaired")
