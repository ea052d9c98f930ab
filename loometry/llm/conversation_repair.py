"""Repair of conversations: the cheapest edits that give a proper order of roles.

The rows of a conversation, in order, are walked with a state: nothing said yet, a system
turn, a user turn, an assistant turn. An arc keeps, reroles or deletes the next row, or
inserts an empty turn; a proper conversation ends before it began or after an assistant
turn. A cost DP from the end gives every node (row, state) its cost to go; arcs that lose
nothing against it are optimal. Of all optimal paths the one with the least string of
edit initials is wanted. A node has at most one optimal arc per initial, so its least
first initial fixes its pointer; nodes are then ranked by their first 1, 2, 4, ...
initials, each rank from the ranks of a node and of the node that its pointer, doubled
every time, leads to. Nodes of one final rank have one audit, which is read off the
pointers once.

A conversation may hold any share of all rows. Rows are range-partitioned by conversation
and place; what a partition holds of a conversation is a piece. A piece is a 4 x 4 table
of costs between states, so that costs to go pass from piece to piece by min-plus
products, and the states in which the path enters the pieces by composing 4-to-4 maps.
Only these small tables meet per conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loometry.session import cut_lineage

#: Bytes of text and rows of a partition, about.
PART_BYTES = 8 << 20
PART_ROWS = 50_000
SPACE = " \t\n\v\f\r"

START, SYSTEM, USER, ASSISTANT = range(4)
OTHER = 3
NONE, BLANK, DUPLICATE, TRUNCATED = range(4)
#: The state that an insertion leads to, by state, and the name of its turn.
_NEXT = (USER, USER, ASSISTANT, USER)
_NAMES = {USER: "user", ASSISTANT: "assistant"}
#: Cost to go after the last row, insertions included.
_END = (0, 6, 3, 0)
_FAR = 1 << 60
#: Edit initials by rank; 0 is the end.
_LETTERS = np.frombuffer(b"\0DIKR", np.uint8)


def damage(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with faults put in by the checksum of conversation
    and turn: rows missing, emptied, without stops, repeated, or with the role user.
    Null roles and texts become one space, as null numbers do in the checksum."""
    said = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    fault = F.crc32(F.concat(said[0], F.lit(":"), said[1])) % 20
    rows = conversations.select("conv_id", "turn", fault.alias("fault"), said[2].alias("role"), said[3].alias("text")).filter("fault <> 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", "fault", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"))
    copies = F.explode(F.when(F.col("fault") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.select("conv_id", "turn", "role", "text", copies.alias("copy")).drop("copy")


def _placed(conversations: DataFrame) -> DataFrame:
    """The rows in order, with what the walk needs to know of each. ``pos`` is the number
    of the partition times 2^33 plus the place in it."""
    text = F.coalesce(F.col("text"), F.lit(" "))
    role = F.coalesce(F.col("role"), F.lit(" "))
    rows = conversations.select(F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    size, count = rows.agg(F.sum(F.octet_length("text") + F.octet_length("role")), F.count(F.lit(1))).first()
    parts = max(1, -(-(size or 0) // PART_BYTES), -(-count // PART_ROWS), min(rows.sparkSession.sparkContext.defaultParallelism, count // 1000))
    bare = F.rtrim("text", F.lit(SPACE))
    initial = F.substring("role", 1, 1)
    rows = rows.select(
        "conv", "turn", "role", "text",
        F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(OTHER).cast("tinyint").alias("code"),
        F.when(bare == "", BLANK).when(~F.substring(bare, -1, 1).isin(".", "!", "?"), TRUNCATED).otherwise(NONE).cast("tinyint").alias("fault"),
        F.unhex(F.sha2(F.concat(F.length("role"), F.lit(":"), "role", "text"), 256)).alias("said"),
        # Rows alike in all columns may still part: a row may be repeated any number of times.
        F.monotonically_increasing_id().alias("tie"), F.left("text", F.lit(100)).alias("head"),
    )
    order = ["conv", "turn", "role", "head", "said", "tie"]
    rows = rows.repartitionByRange(int(parts), *order).sortWithinPartitions(*order).drop("tie", "head")
    return cut_lineage(rows.withColumn("pos", F.monotonically_increasing_id()), "turns")


def _part(pos: str) -> Column:
    return F.shiftright(F.col(pos), 33)


# ---------------------------------------------------------------- costs

def _before(code: int, fault: int, after: tuple) -> tuple:
    """Costs to go before a row, from those after it."""
    b0, bs, bu, ba = (4 + c for c in after)
    if fault == NONE or fault == TRUNCATED:
        extra = 3 if fault == TRUNCATED else 0
        user = after[USER] + extra + (0 if code == 1 else 3)
        assistant = after[ASSISTANT] + extra + (0 if code == 2 else 3)
        b0, bs, ba, bu = min(b0, user), min(bs, user), min(ba, user), min(bu, assistant)
        if code == 0:
            b0 = min(b0, after[SYSTEM] + extra)
    cu, ca = min(bu, 3 + ba), min(ba, 3 + bu)
    return min(b0, 3 + cu), min(bs, 3 + cu), cu, ca


def _costs(codes: bytes, faults: bytes, after: tuple) -> list[tuple]:
    """Costs to go at every row and after the last."""
    out = [after]
    for code, fault in zip(reversed(codes), reversed(faults), strict=True):
        after = _before(code, fault, after)
        out.append(after)
    out.reverse()
    return out


def _between(codes: bytes, faults: bytes) -> list[int]:
    """Least cost from each state before the piece (row) to each state after it."""
    columns = []
    for state in range(4):
        after = tuple(0 if s == state else _FAR for s in range(4))
        for code, fault in zip(reversed(codes), reversed(faults), strict=True):
            after = _before(code, fault, after)
        columns.append(after)
    return [columns[j][i] for i in range(4) for j in range(4)]


# ---------------------------------------------------------------- paths

class _Paths:
    """The least optimal paths of many pieces. ``pieces``: codes, faults, costs to go
    after the piece, whether the conversation ends with it."""

    def __init__(self, pieces: list[tuple[bytes, bytes, tuple, bool]]):
        rows = np.array([len(c) + 1 for c, *_ in pieces], np.int64)
        self.first = np.cumsum(rows) - rows
        cost = np.array([c for codes, faults, after, _ in pieces for c in _costs(codes, faults, after)], np.int64).reshape(-1, 4)
        last = self.first + rows - 1
        code, fault = np.full(len(cost), OTHER, np.int64), np.full(len(cost), BLANK, np.int64)
        inner = np.ones(len(cost), bool)
        inner[last] = False
        code[inner] = np.frombuffer(b"".join(p[0] for p in pieces), np.uint8)
        fault[inner] = np.frombuffer(b"".join(p[1] for p in pieces), np.uint8)
        may_insert = inner.copy()
        may_insert[last] = [p[3] for p in pieces]
        after = np.full_like(cost, _FAR)
        after[:-1] = cost[1:]
        after[last] = _FAR
        said = (fault == NONE) | (fault == TRUNCATED)
        extra = np.where(fault == TRUNCATED, 3, 0)
        node = np.arange(len(cost) * 4).reshape(-1, 4)
        letter = np.zeros_like(node)
        target = node.copy()

        def arc(rank, state, allowed, price, to_row, to_state):
            """The arc holds where it is optimal and no smaller initial is."""
            base = after if to_row else cost
            take = allowed & (letter[:, state] == 0) & (base[:, to_state] < _FAR) & (price + base[:, to_state] == cost[:, state])
            letter[take, state] = rank
            target[take, state] = node[take, to_state] + 4 * to_row

        for state in range(4):
            arc(1, state, inner, 4, 1, state)
            arc(2, state, may_insert, 3, 0, _NEXT[state])
            name = _NEXT[state]
            arc(3, state, inner & said & (code == (1 if name == USER else 2)), extra, 1, name)
            if state == START:
                arc(3, state, inner & said & (code == 0), extra, 1, SYSTEM)
            arc(4, state, inner & said, 3 + extra, 1, name)
        self.letter, self.pointer = letter.ravel(), target.ravel()
        self._rank()

    def _rank(self) -> None:
        """Rank all nodes by their first 1, 2, 4, ... initials, doubling the pointers."""
        self.jumps, rank = [self.pointer], self.letter
        self.length = (self.letter > 0).astype(np.int64)
        while True:
            jump = self.jumps[-1]
            if not self.letter[jump].any():
                break
            self.length = self.length + self.length[jump]
            rank = np.unique(rank * (int(rank.max()) + 1) + rank[jump], return_inverse=True)[1]
            self.jumps.append(jump[jump])
        self.rank = rank
        self.end = self.jumps[-1]

    def nodes(self, states: list[int]) -> np.ndarray:
        """The node in which each piece is entered."""
        return self.first * 4 + np.array(states, np.int64)

    def exits(self, nodes: np.ndarray) -> np.ndarray:
        return self.end[nodes] % 4

    def audits(self, nodes: np.ndarray) -> list[bytes]:
        """Initials of the paths from ``nodes``; nodes of one rank are read once."""
        _, one, back = np.unique(self.rank[nodes], return_index=True, return_inverse=True)
        heads = nodes[one]
        found = [b""] * len(heads)
        bits = np.array([int(n).bit_length() for n in self.length[heads]])
        for k in np.unique(bits).tolist():
            here = np.flatnonzero(bits == k)
            path = heads[here][:, None]
            for jump in self.jumps[:k]:
                path = np.concatenate([path, jump[path]], 1)
            letters = _LETTERS[self.letter[path]]
            for row, i in enumerate(here.tolist()):
                found[i] = letters[row, : self.length[heads[i]]].tobytes()
        return [found[i] for i in back.tolist()]


def _apply(audit: bytes, state: int, roles: list[str], texts: list[str]) -> list[tuple[str, str]]:
    """The turns that the edits leave."""
    out, i = [], 0
    for edit in audit.decode():
        if edit == "D":
            i += 1
            continue
        name = _NEXT[state]
        if edit == "I":
            out.append((_NAMES[name], ""))
        else:
            if edit == "K":
                if state == START and roles[i][:1] == "s":
                    name = SYSTEM
                out.append((roles[i], texts[i]))
            else:
                out.append((_NAMES[name], texts[i]))
            i += 1
        state = name
    return out


# ---------------------------------------------------------------- jobs

_PIECE = """piece long, conv {conv}, n long, codes binary, faults binary, between array<long>, blank long, duplicate long, truncated long,
illegal long, code_first int, code_last int, turns long, turn_first long, turn_last long"""


def _pieces(placed: DataFrame) -> DataFrame:
    """One row per piece: its faults, counts and costs between states."""
    from pyspark.sql.pandas.types import to_arrow_type

    # The first row that says a thing is no duplicate; partial aggregation combines
    # what a conversation repeats before it is shuffled.
    firsts = placed.groupBy("conv", "said").agg(F.min("pos").alias("pos")).select(_part("pos").alias("part"), "pos")
    rows = placed.select(_part("pos").alias("part"), "pos", "conv", "turn", "code", "fault")
    conv_type = to_arrow_type(placed.schema["conv"].dataType)
    legal = np.zeros((4, 4), bool)
    legal[[0, 1, 2], [1, 2, 1]] = True

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by("pos")
        pos = left.column("pos").to_numpy()
        convs = left.column("conv").to_pylist()
        turns = left.column("turn").to_pylist()
        code, fault = left.column("code").to_numpy().astype(np.uint8), left.column("fault").to_numpy().astype(np.uint8)
        fault[(fault != BLANK) & ~np.isin(pos, right.column("pos").to_numpy())] = DUPLICATE
        cuts = [0, *[i for i in range(1, len(convs)) if convs[i] != convs[i - 1]], len(convs)]
        out: dict[str, list] = {c.split()[0]: [] for c in _PIECE.replace("\n", " ").split(", ")}
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            codes, faults = code[a:b], fault[a:b]
            known = [t for t in turns[a:b] if t is not None]
            counts = np.bincount(faults, minlength=4)
            cells = codes.tobytes(), faults.tobytes()
            row = (
                int(pos[a]), convs[a], b - a, *cells, _between(*cells), counts[BLANK], counts[DUPLICATE], counts[TRUNCATED],
                np.count_nonzero(~legal[codes[:-1], codes[1:]]), codes[0], codes[-1], len(set(known)),
                known[0] if known else None, known[-1] if known else None,
            )
            for name, value in zip(out, row, strict=True):
                out[name].append(value)
        types = dict(conv=conv_type, codes=pa.binary(), faults=pa.binary(), between=pa.list_(pa.int64()), code_first=pa.int32(), code_last=pa.int32())
        return pa.table({name: pa.array([int(v) if isinstance(v, np.integer) else v for v in values], types.get(name, pa.int64())) for name, values in out.items()})

    schema = _PIECE.format(conv=placed.schema["conv"].dataType.simpleString())
    return cut_lineage(rows.groupBy("part").cogroup(firsts.groupBy("part")).applyInArrow(run, schema), "pieces")


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_SMALL = ("piece", "between", "blank", "duplicate", "truncated", "illegal", "code_first", "code_last", "turns", "turn_first", "turn_last")


def _totals(pieces: DataFrame) -> DataFrame:
    """Per conversation: its counts, its cost, and for each piece the costs to go after it.

    A conversation's list has one small entry per partition that holds a part of it.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    conv = pieces.schema["conv"].dataType
    listed = pieces.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct(*_SMALL))).alias("pieces"))

    def run(batches):
        for batch in batches:
            out = {name: [] for name in (*_COUNTS, "ends")}
            for own in batch.column(1).to_pylist():
                total = {name: sum(p[name] for p in own) for name in ("blank", "duplicate", "truncated", "illegal")}
                distinct, low, high = 0, None, None
                for i, p in enumerate(own):
                    if i and (own[i - 1]["code_last"], p["code_first"]) not in ((0, 1), (1, 2), (2, 1)):
                        total["illegal"] += 1
                    if p["turn_first"] is not None:
                        distinct += p["turns"] - (high == p["turn_first"])
                        low, high = (p["turn_first"] if low is None else low), p["turn_last"]
                total["gaps"] = 0 if low is None else min(high - low + 1 - distinct, (1 << 63) - 1)
                ends, after = [], _END
                for p in reversed(own):
                    ends.append({"piece": p["piece"], "after": list(after), "last": p is own[-1], "many": len(own) > 1})
                    table = p["between"]
                    after = tuple(min(table[4 * i + j] + after[j] for j in range(4)) for i in range(4))
                total["cost"] = after[START]
                total["ends"] = ends[::-1]
                for name in out:
                    out[name].append(total[name])
            ends_type = pa.list_(pa.struct([("piece", pa.int64()), ("after", pa.list_(pa.int64())), ("last", pa.bool_()), ("many", pa.bool_())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(to_arrow_type(conv)), *[pa.array(v, ends_type if n == "ends" else pa.int64()) for n, v in out.items()]], ["conv", *out]
            )

    counts = ", ".join(f"{c} long" for c in _COUNTS)
    schema = f"conv {conv.simpleString()}, {counts}, ends array<struct<piece:long,after:array<long>,last:boolean,many:boolean>>"
    return cut_lineage(listed.mapInArrow(run, schema).withColumn("first", F.col("ends")[0]["piece"]), "totals")


def _entered(pieces: DataFrame, totals: DataFrame) -> DataFrame:
    """Every piece with the costs to go after it and the state in which the path enters."""
    ends = totals.select("first", F.explode("ends").alias("end")).select("first", "end.*")
    rows = pieces.select("piece", "codes", "faults").join(ends, "piece")

    def leave(batches):
        for batch in batches:
            own = batch.to_pylist()
            if not own:
                continue
            paths = _Paths([(r["codes"], r["faults"], tuple(r["after"]), r["last"]) for r in own])
            exits = np.stack([paths.exits(paths.nodes([s] * len(own))) for s in range(4)], 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("first"), batch.column("piece"), pa.array(exits.tolist(), pa.list_(pa.int64()))], ["first", "piece", "exits"]
            )

    def compose(batches):
        for batch in batches:
            numbers, states = [], []
            for own in batch.column(0).to_pylist():
                state = START
                for p in own:
                    numbers.append(p["piece"])
                    states.append(state)
                    state = p["exits"][state]
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(states, pa.int64())], ["entered", "state"])

    exits = rows.filter("many").mapInArrow(leave, "first long, piece long, exits array<long>")
    states = exits.groupBy("first").agg(F.sort_array(F.collect_list(F.struct("piece", "exits"))).alias("own")).select("own")
    states = states.mapInArrow(compose, "entered long, state long")
    return rows.join(states, F.col("piece") == F.col("entered"), "left").drop("entered").withColumn("state", F.coalesce("state", F.lit(START).cast("long")))


def _repaired(placed: DataFrame, entered: DataFrame, whole: bool) -> DataFrame:
    """Per piece its audit and its turns: all of them (``whole``), or joined to one text,
    with the hash of it instead where the conversation has no other piece."""
    texts = placed.select(_part("pos").alias("part"), "pos", "role", "text")
    plans = entered.withColumn("part", _part("piece"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by("pos")
        pos = left.column("pos").to_numpy()
        roles, texts = left.column("role").to_pylist(), left.column("text").to_pylist()
        own = right.to_pylist()
        paths = _Paths([(r["codes"], r["faults"], tuple(r["after"]), r["last"]) for r in own])
        audits = paths.audits(paths.nodes([r["state"] for r in own]))
        digests, joined, turns = [], [], []
        for r, audit in zip(own, audits, strict=True):
            a = int(np.searchsorted(pos, r["piece"]))
            b = a + len(r["codes"])
            kept = _apply(audit, r["state"], roles[a:b], texts[a:b])
            if whole:
                turns.append([{"role": x, "text": y} for x, y in kept])
                continue
            text = "\n".join([f"{x}:{y}" for x, y in kept]).encode()
            digests.append(None if r["many"] else hashlib.sha256(text).hexdigest())
            joined.append(text if r["many"] else None)
        columns = {"first": right.column("first"), "piece": right.column("piece"), "audit": pa.array([a.decode() for a in audits], pa.string())}
        if whole:
            columns["turns"] = pa.array(turns, pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))
        else:
            columns |= {"digest": pa.array(digests, pa.string()), "joined": pa.array(joined, pa.binary())}
        return pa.table(columns)

    schema = "first long, piece long, audit string, " + ("turns array<struct<role:string,text:string>>" if whole else "digest string, joined binary")
    return texts.groupBy("part").cogroup(plans.groupBy("part")).applyInArrow(run, schema)


def _streamed(pieces: DataFrame) -> DataFrame:
    """Audit and hash of conversations of several pieces, a piece at a time: a hash is
    taken in order, and the audit is one cell of the result."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        first, audit, digest, empty = None, [], hashlib.sha256(), True

        def out():
            return pa.RecordBatch.from_arrays(
                [pa.array([first], pa.int64()), pa.array(["".join(audit)], pa.string()), pa.array([digest.hexdigest()], pa.string())],
                ["first", "audit", "digest"],
            )

        for batch in batches:
            for i in range(batch.num_rows):
                if batch.column(0)[i].as_py() != first:
                    if first is not None:
                        yield out()
                    first, audit, digest, empty = batch.column(0)[i].as_py(), [], hashlib.sha256(), True
                audit.append(batch.column(1)[i].as_py())
                text = batch.column(2)[i].as_py()
                if text:
                    digest.update(text if empty else b"\n" + text)
                    empty = False
        if first is not None:
            yield out()

    ordered = pieces.repartition("first").sortWithinPartitions("first", "piece").select("first", "audit", "joined")
    return ordered.mapInArrow(run, "first long, audit string, digest string")


def repair(conversations: DataFrame) -> DataFrame:
    """One row per ``conv_id`` of ``conversations`` (``conv_id, turn, role, text``):
    ``gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``.

    Rows go by turn, nulls first; rows of one turn by role, the first 100 characters
    of the text, and a hash of role and text. A row's first fault counts: blank,
    duplicate (role and text seen before in the conversation), truncated. Keep costs 0, rerole 3,
    delete 4 (and must be for blank and duplicate rows), insert 3; truncated rows that
    stay cost 3 more. The roles' initials must become ``(s?(ua)+)?``. ``audit`` has the
    initials K, R, D, I of the cheapest edits, the least in ASCII of several. ``gaps``
    counts the numbers missing between the smallest and the largest turn.

    Null ids are one conversation. Null roles and texts are one space. Repeated rows are
    duplicates. Texts of any length are judged whole. Other columns are ignored. An empty
    table gives no rows.
    """
    placed = _placed(conversations)
    pieces = _pieces(placed)
    totals = _totals(pieces)
    done = cut_lineage(_repaired(placed, _entered(pieces, totals), whole=False), "repaired")
    alone = done.filter("joined IS NULL").select("first", "audit", "digest")
    found = alone.unionAll(_streamed(done.filter("joined IS NOT NULL")))
    return totals.join(found, "first").select(
        F.col("conv").alias("conv_id"), *_COUNTS, "audit", F.col("digest").alias("repaired_sha256")
    )


def repaired_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, piece, place, role, text``: the turns after repair, ordered by piece and
    place. A conversation of which nothing stays has no row."""
    placed = _placed(conversations)
    pieces = _pieces(placed)
    totals = _totals(pieces)
    turns = _repaired(placed, _entered(pieces, totals), whole=True).select("first", "piece", F.posexplode("turns").alias("place", "said"))
    return turns.join(totals.select("first", "conv"), "first").select(F.col("conv").alias("conv_id"), "piece", "place", "said.*")


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """``repair(damage(...))`` with a row for every conversation, also where no row is left."""
    found = repair(damage(conversations))
    names = conversations.select(F.col("conv_id").alias("_id")).distinct()
    joined = names.join(found, F.col("_id").eqNullSafe(F.col("conv_id")), "left")
    return joined.select(
        F.col("_id").alias("conv_id"), *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in _COUNTS], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )
