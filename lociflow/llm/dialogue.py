"""Repair of conversation structure: the cheapest edits that make roles alternate, ties settled by ranked paths."""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lociflow.llm.scratch import Scratch

BLANKS = " \t\n\x0b\f\r"
EDITS = "DIKR"                     # delete, insert, keep, rerole: in the order of their initials
DELETE, INSERT, REROLE, UNFINISHED = 2, 5, 1, 5
# States: nothing yet, after system, after user, after assistant. A turn is needed next from the second and third.
N_STATES, START, END_STATES = 4, 0, (0, 3)
NEXT = np.array([2, 2, 3, 2])      # the state after the user or assistant turn that may come
FAR = 1 << 40
ROLE_OF = {2: "user", 3: "assistant"}
BUFFER_BYTES = 64 << 20


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By row code (initial s, u, a, other + 4 * (fine, unfinished, must go)): cost of keeping from each state, the
    state after it, cost of a new role."""
    keep, to, rerole = np.full((12, N_STATES), FAR), np.zeros((12, N_STATES), np.int64), np.full(12, FAR)
    for code in range(8):
        more = UNFINISHED if code >= 4 else 0
        rerole[code] = REROLE + more
        for state in range(N_STATES):
            after = {0: 1 if state == START else None, 1: 2 if NEXT[state] == 2 else None, 2: 3 if NEXT[state] == 3 else None}.get(code % 4)
            if after is not None:
                keep[code, state], to[code, state] = more, after
    return keep, to, rerole


KEEP, KEPT_TO, NEW_ROLE = _tables()


def _inserted(d: np.ndarray) -> np.ndarray:
    """Costs to the end once turns may be inserted first."""
    d = d.copy()
    user, assistant = d[:, 2].copy(), d[:, 3].copy()
    d[:, 2], d[:, 3] = np.minimum(user, INSERT + assistant), np.minimum(assistant, INSERT + user)
    d[:, :2] = np.minimum(d[:, :2], INSERT + d[:, 2:3])
    return np.minimum(d, FAR)


def costs(code: np.ndarray, at: np.ndarray, leaving: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Least cost from every state before every row to the end of its run, whose states cost ``leaving``.

    Run k holds rows ``at[k]:at[k + 1]`` and has a place before each row and one behind the last. Turns may be
    inserted at every place, the last one only where the conversation ends with the run.
    """
    m, size = len(at) - 1, np.diff(at)
    dist = np.full((len(code) + m, N_STATES), FAR)
    last = at[1:] + np.arange(m)
    dist[last] = np.where(ends[:, None], _inserted(leaving), leaving)
    order = np.argsort(-size, kind="stable")
    for back in range(1, int(size.max(initial=0)) + 1):
        runs = order[:np.searchsorted(-size[order], -back, side="right")]
        place = last[runs] - back
        c, d = code[at[runs + 1] - back], dist[place + 1]
        kept = KEEP[c] + np.take_along_axis(d, KEPT_TO[c], 1)
        dist[place] = _inserted(np.minimum(np.minimum(DELETE + d, kept), NEW_ROLE[c][:, None] + d[:, NEXT]))
    return dist


def least_paths(code: np.ndarray, at: np.ndarray, leaving: np.ndarray, ends: np.ndarray, entry: np.ndarray) -> dict[str, np.ndarray]:
    """The edits of each run in order, from its state ``entry``: ``run, edit, row, state`` (after it), ``behind``.

    Nodes are the arcs that some cheapest repair takes. An arc is ranked by its letter, then by the least audit of 2, 4, 8 …
    letters that begins with it: the rank of a pair of half as long ones. Arcs that leave one state differ in their letters,
    so an arc has one follower, the least of those at its head; followers double with the ranks. The least arc at the
    entry and its doubled followers are the path. ``row`` of an insertion is the row it precedes, or with ``behind`` follows.
    """
    m = len(at) - 1
    dist = costs(code, at, leaving, ends)
    run_of_row = np.repeat(np.arange(m), np.diff(at))
    place = np.arange(len(code)) + run_of_row
    last = at[1:] + np.arange(m)
    open_end = np.zeros(len(dist), bool)
    open_end[last] = ~ends
    states = np.arange(N_STATES)
    here, there = dist[place], dist[place + 1]
    near = here < FAR
    tails, letters, heads = [], [], []

    def add(letter: str, where: np.ndarray, head: np.ndarray, at_place: np.ndarray):
        i, q = np.nonzero(where)
        tails.append(at_place[i] * N_STATES + q)
        letters.append(np.full(len(i), EDITS.index(letter) + 1))
        heads.append(head[i, q])
    ahead = (place[:, None] + 1) * N_STATES
    add("D", near & (here == DELETE + there), ahead + states, place)
    every = np.arange(len(dist))
    add("I", (dist < FAR) & ~open_end[:, None] & (dist == INSERT + dist[:, NEXT]), every[:, None] * N_STATES + NEXT, every)
    add("K", near & (here == KEEP[code] + np.take_along_axis(there, KEPT_TO[code], 1)), ahead + KEPT_TO[code], place)
    add("R", near & (here == NEW_ROLE[code][:, None] + there[:, NEXT]), ahead + NEXT, place)
    tail, letter, head = map(np.concatenate, (tails, letters, heads))
    order = np.lexsort((letter, tail))
    tail, letter, head = tail[order], letter[order], head[order]
    none = len(tail)                                       # what follows a last arc
    least = np.full(len(dist) * N_STATES, none)
    least[tail[::-1]] = np.arange(none)[::-1]
    follow = np.append(least[head], none)
    rank, steps, doubled = np.append(letter, 0), np.append(np.ones(none, np.int64), 0), [follow]
    while (follow != none).any():
        rank = np.unique(rank * (rank.max() + 1) + rank[follow], return_inverse=True)[1]
        steps = steps + steps[follow]
        follow = follow[follow]
        doubled.append(follow)
    first = (at[:-1] + np.arange(m)) * N_STATES + entry
    lo, hi = np.searchsorted(tail, first), np.searchsorted(tail, first, side="right")
    chosen = np.array([a + np.argmin(rank[a:b]) for a, b in zip(lo, hi) if b > a], np.int64)
    on = np.zeros(none + 1, bool)
    on[chosen] = True
    for jump in doubled:
        on[jump[np.flatnonzero(on)]] = True
    path = np.flatnonzero(on[:-1])
    run = np.searchsorted(last, tail[path] // N_STATES)
    order = np.lexsort((-steps[path], run))
    path, run = path[order], run[order]
    row = tail[path] // N_STATES - run
    behind = row == at[run + 1]
    return {"run": run, "edit": letter[path] - 1, "row": row - behind, "state": head[path] % N_STATES, "behind": behind,
            "cost": dist.reshape(-1)[first]}


def damage(conversations: DataFrame) -> DataFrame:
    """The rows with faults planted by the hash of ``conv_id:turn``; a null is one space in the hash, role and text."""
    def plain(name):
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(plain("conv_id"), F.lit(":"), plain("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", plain("role").alias("role"), plain("text").alias("text"), kind.alias("kind")).where("kind != 0")
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
                       F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
                       F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def _same(a: DataFrame, b: DataFrame, *names: str) -> Column:
    on = a["conv"].eqNullSafe(b["conv"])
    for n in names:
        on = on & (a[n] == b[n])
    return on


def _codes(role: list, mark: np.ndarray) -> np.ndarray:
    return np.array(["sua".find(r[:1]) if r and r[0] in "sua" else 3 for r in role], np.int64) + 4 * np.minimum(mark, 2)


def _edits_of(table: pa.Table, at: np.ndarray, duplicate: np.ndarray) -> pa.RecordBatch:
    """The edited rows of whole conversations, in order."""
    mark = table["mark"].to_numpy()
    gone = (mark == 2) | duplicate
    m = len(at) - 1
    leaving = np.full((m, N_STATES), FAR)
    leaving[:, END_STATES] = 0
    p = least_paths(_codes(table["was_role"].to_pylist(), np.where(gone, 2, mark)), at, leaving, np.ones(m, bool), np.zeros(m, np.int64))
    fault = np.select([mark == 2, duplicate, mark == 1], [0, 1, 2], 3)
    return _laid_out(table, p, fault)


def _sub(p: dict[str, np.ndarray]) -> np.ndarray:
    """Place of an edit beside its row: 0 the row's own, negative before it, positive behind it."""
    inserted = p["edit"] == EDITS.index("I")
    out = np.zeros(len(inserted), np.int64)
    for i in np.flatnonzero(inserted):                     # two in a row at most
        again = i > 0 and inserted[i - 1] and p["run"][i - 1] == p["run"][i] and p["row"][i - 1] == p["row"][i]
        out[i] = (2 if again else 1) if p["behind"][i] else (-1 if again else -2)
    return out


def _laid_out(table: pa.Table, p: dict[str, np.ndarray], fault: np.ndarray) -> pa.RecordBatch:
    own = table.take(pa.array(p["row"]))
    inserted = p["edit"] == EDITS.index("I")
    names = np.array(["blank", "duplicate", "truncated", None], object)
    roles = [r if e == 2 else ROLE_OF.get(s) if e else None for r, e, s in zip(own["was_role"].to_pylist(), p["edit"], p["state"])]

    def unless(name, value=None):
        col = own[name].combine_chunks()
        return pa.compute.if_else(pa.array(inserted), pa.scalar(value, col.type), col)
    return pa.RecordBatch.from_arrays(
        [own["conv"].combine_chunks(), own["pos"].combine_chunks(), pa.array(_sub(p), pa.int32()), unless("turn"), unless("was_role"), unless("text", ""),
         unless("text_key"), unless("mark"), pa.array(np.where(inserted, None, names[fault[p["row"]]]), pa.string()),
         pa.array([EDITS[e] for e in p["edit"]], pa.string()), pa.array(roles, pa.string())], COLUMNS)


COLUMNS = ["conv", "pos", "sub", "turn", "was_role", "text", "text_key", "mark", "fault", "edit", "role"]


def _repeats(conv_at: np.ndarray, roles: list, keys: list, mark: np.ndarray) -> np.ndarray:
    out = np.zeros(len(roles), bool)
    for a, b in zip(conv_at[:-1], conv_at[1:]):
        seen = set()
        for i in range(a, b):
            if mark[i] < 2:
                k = (roles[i], keys[i])
                out[i] = k in seen
                seen.add(k)
    return out


def _whole(table: pa.Table, at: np.ndarray) -> pa.RecordBatch:
    return _edits_of(table, at, _repeats(at, table["was_role"].to_pylist(), table["text_key"].to_pylist(), table["mark"].to_numpy()))


def _runs(values: list) -> np.ndarray:
    """Where runs of equal values begin, and the length."""
    return np.array([0, *(i for i in range(1, len(values)) if values[i] != values[i - 1]), len(values)], np.int64)


def repair(rows: DataFrame, block_rows: int = 4096, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text") -> DataFrame:
    """``conv, pos, sub, turn, was_role, text, fault, edit, role, cost``: every row of every conversation with its edit, and
    the inserted turns, in the order of ``(pos, sub)``; the repaired conversation is what has an edit other than ``D``.

    Rows are taken by turn, nulls first, equal turns by role, then by the digest of their text; a null role or text
    is one space. Rows are sorted by ranges of (conversation, turn), so a conversation of any length is spread over
    tasks. A task solves those that lie inside its range as they pass by, holding ``block_rows`` rows and 64 MB of text at most.
    Those on the edge of a range are gathered by conversation if they are no longer than that. A longer one is cut into runs
    of ``block_rows``: each run gives the matrix of its costs between states, matrices give the
    costs at every cut (one small row a run comes together), and each run is then solved from all four states, of which the one that its
    predecessor ends in is taken. Edits: keep 0, rerole to user or assistant 1, delete 2 (blank and duplicate rows must be), insert
    an empty turn 5, and 5 for a truncated row that stays. The result's initials are ``(s?(ua)+)?``; of equally cheap audits the least is taken.

    An empty table gives none; repeated rows are duplicates; a null conversation is one of its own; very long texts
    are carried, never compared (their digests are); further columns are not read.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark)

    def plain(name):
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))
    named = rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), plain(role_col).alias("was_role"), plain(text_col).alias("text"))
    bare = F.rtrim(F.col("text"), F.lit(BLANKS))
    mark = F.when(bare == "", 2).when(F.substring(bare, -1, 1).isin(".", "!", "?"), 0).otherwise(1)
    named = named.select("*", F.sha2(F.col("text"), 256).alias("text_key"), mark.alias("mark"), F.monotonically_increasing_id().alias("no"))
    by = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("was_role"), F.col("text_key"), F.col("no")]
    placed = named.repartitionByRange(*by).sortWithinPartitions(*by).drop("no").withColumn("pos", F.monotonically_increasing_id())
    shape = (placed.select("conv", "pos", F.lit(0).alias("sub"), "turn", "was_role", "text", "text_key", "mark",
                           *(F.lit(None).cast("string").alias(n) for n in ("fault", "edit", "role"))).schema)

    def as_open(t: pa.Table) -> list[pa.RecordBatch]:
        """Rows that wait for the rest of their conversation."""
        n = t.num_rows
        none = pa.nulls(n, pa.string())
        return pa.table([*(t[c] for c in COLUMNS[:2]), pa.array(np.zeros(n, np.int32)), *(t[c] for c in COLUMNS[3:8]), none, none, none],
                        COLUMNS).combine_chunks().to_batches()

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, first, begun, too_long = [], True, None, False
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            if sum(x.num_rows for x in held) < block_rows and sum(x.nbytes for x in held) < BUFFER_BYTES:
                continue
            table = pa.Table.from_batches(held)
            at = _runs(table["conv"].to_pylist())
            if (first or too_long) and (not too_long or table["conv"][0].as_py() == begun):
                yield from as_open(table.slice(0, at[1]))  # the range may have begun inside it
                begun, at, first = table["conv"][0].as_py(), at[1:], False
                too_long = len(at) == 1
            else:
                too_long = False
            if len(at) > 2:
                inner = table.slice(at[0], at[-2] - at[0])
                yield _whole(inner, at[:-1] - at[0])
                at = at[-2:]
            rest = table.slice(at[0])
            if len(at) == 2 and (rest.num_rows > block_rows or rest.nbytes > BUFFER_BYTES):
                yield from as_open(rest)
                begun, too_long, rest = rest["conv"][0].as_py(), True, rest.slice(0, 0)
            held = rest.combine_chunks().to_batches() if rest.num_rows else []
        if held:
            table = pa.Table.from_batches(held)
            at = _runs(table["conv"].to_pylist())
            if first or (too_long and table["conv"][0].as_py() == begun):
                yield from as_open(table.slice(0, at[1]))
                at = at[1:]
            if len(at) > 2:
                yield _whole(table.slice(at[0], at[-2] - at[0]), at[:-1] - at[0])
                at = at[-2:]
            if len(at) == 2:
                yield from as_open(table.slice(at[0]))
    met = scratch.write(placed.mapInArrow(passing, shape), "passing")
    waiting = met.where(F.col("edit").isNull())
    sizes = waiting.groupBy("conv").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    long = scratch.write(sizes.where((F.col("n") > block_rows) | (F.col("bytes") > BUFFER_BYTES)).select("conv"), "long")

    def gathered(t: pa.Table) -> pa.Table:
        t = t.sort_by("pos")
        return pa.Table.from_batches([_whole(t, np.array([0, t.num_rows]))])
    if not long.limit(1).count():
        parts = [met.where(F.col("edit").isNotNull()), waiting.groupBy("conv").applyInArrow(gathered, shape)]
    else:
        few = waiting.join(long, waiting["conv"].eqNullSafe(long["conv"]), "left_anti")
        many = waiting.join(long, waiting["conv"].eqNullSafe(long["conv"]), "left_semi")
        parts = [met.where(F.col("edit").isNotNull()), few.groupBy("conv").applyInArrow(gathered, shape), _in_runs(many, scratch, block_rows, shape)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    extra = F.when(F.col("fault") == "truncated", UNFINISHED).otherwise(0)
    cost = (F.when(F.col("edit") == "D", DELETE).when(F.col("edit") == "I", INSERT).when(F.col("edit") == "R", extra + REROLE).otherwise(extra))
    return out.select("conv", "pos", "sub", "turn", "was_role", "text", "fault", "edit", "role", cost.cast("long").alias("cost"))


def _in_runs(rows: DataFrame, scratch: Scratch, block_rows: int, shape) -> DataFrame:
    """Conversations longer than a task takes, in runs of ``block_rows`` consecutive rows."""
    kind = rows.schema["conv"].dataType.simpleString()
    first = rows.where("mark < 2").groupBy("conv", "was_role", "text_key").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("first"))
    fault = F.when(F.col("mark") == 2, "blank").when(F.col("first").isNull(), "duplicate").when(F.col("mark") == 1, "truncated")
    flagged = scratch.write(rows.drop("fault").join(first, "pos", "left").withColumn("fault", fault).drop("first"), "flagged")
    initial = F.substring("was_role", 1, 1)
    code = (F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
            + 4 * F.when(F.col("fault").isin("blank", "duplicate"), 2).when(F.col("fault") == "truncated", 1).otherwise(0))
    thin = scratch.write(flagged.select("conv", F.floor(F.col("pos") / block_rows).alias("run"), "pos", code.alias("code")), "thin")
    one_hot = np.where(np.eye(N_STATES, dtype=bool), 0, FAR)

    def matrix(key, t):
        c = t.sort_by("pos")["code"].to_numpy()
        at = np.arange(N_STATES + 1) * len(c)
        d = costs(np.tile(c, N_STATES), at, one_hot, np.zeros(N_STATES, bool))
        m = d[at[:-1] + np.arange(N_STATES)].T             # [from, to]
        return pa.table([pa.array([key[0].as_py()], t["conv"].type), pa.array([key[1].as_py()]), pa.array([m.ravel().tolist()])], ["conv", "run", "m"])

    def suffix(t: pa.Table) -> pa.Table:
        t = t.sort_by("run")
        m = np.array(t["m"].to_pylist()).reshape(-1, N_STATES, N_STATES)
        leaving = np.full((len(m), N_STATES), FAR)
        leaving[-1, list(END_STATES)] = 0
        ahead = _inserted(leaving[-1:])[0]
        for k in range(len(m) - 1, 0, -1):
            ahead = np.minimum((m[k] + ahead).min(1), FAR)
            leaving[k - 1] = ahead
        last = np.arange(len(m)) == len(m) - 1
        return pa.table([t["conv"], t["run"], pa.array(leaving.tolist()), pa.array(last)], ["conv", "run", "leaving", "ends"])
    cuts = (thin.groupBy("conv", "run").applyInArrow(matrix, f"conv {kind}, run long, m array<long>")
            .groupBy("conv").applyInArrow(suffix, f"conv {kind}, run long, leaving array<long>, ends boolean"))
    known = thin.join(cuts, _same(thin, cuts, "run")).select(thin["conv"], thin["run"], "pos", "code", "leaving", "ends")

    def four(t: pa.Table) -> pa.Table:
        t = t.sort_by("pos")
        c, n = t["code"].to_numpy(), t.num_rows
        pos = t["pos"].to_numpy()
        p = least_paths(np.tile(c, N_STATES), np.arange(N_STATES + 1) * n, np.tile(t["leaving"][0].as_py(), (N_STATES, 1)),
                        np.full(N_STATES, t["ends"][0].as_py()), np.arange(N_STATES))
        run = p["run"]
        final = np.flatnonzero(np.append(run[1:] != run[:-1], True)) if len(run) else []
        k = len(run)
        sub = _sub(p)
        roles = [None if e in (0, 2) else ROLE_OF.get(s) for e, s in zip(p["edit"], p["state"])]
        leave = np.full(k, -1)
        leave[final] = p["state"][final]
        return pa.table([t["conv"].combine_chunks().take(pa.array(np.zeros(k, np.int64))), t["run"].combine_chunks().take(pa.array(np.zeros(k, np.int64))),
                         pa.array(run, pa.int32()), pa.array(leave, pa.int32()), pa.array(pos[p["row"] % n]), pa.array(sub, pa.int32()),
                         pa.array([EDITS[e] for e in p["edit"]], pa.string()), pa.array(roles, pa.string())],
                        ["conv", "run", "entry", "leave", "pos", "sub", "edit", "role"])
    paths = scratch.write(known.groupBy("conv", "run").applyInArrow(
        four, f"conv {kind}, run long, entry int, leave int, pos long, sub int, edit string, role string"), "paths")

    def chained(t: pa.Table) -> pa.Table:
        state, runs, taken = START, [], []
        to = {(r, e): s for r, e, s in zip(t["run"].to_pylist(), t["entry"].to_pylist(), t["leave"].to_pylist())}
        for r in sorted({r for r, _ in to}):
            runs.append(r)
            taken.append(state)
            state = to[r, state]
        return pa.table([t["conv"].combine_chunks().take(pa.array(np.zeros(len(runs), np.int64))), pa.array(runs), pa.array(taken, pa.int32())],
                        ["conv", "run", "entry"])
    entries = paths.where("leave >= 0").select("conv", "run", "entry", "leave").groupBy("conv").applyInArrow(chained, f"conv {kind}, run long, entry int")
    taken = paths.join(entries, _same(paths, entries, "run", "entry"), "left_semi")
    own = taken.where("sub = 0").select("pos", "edit", "role")
    kept = flagged.drop("edit", "role").join(own, "pos").withColumn("role", F.when(F.col("edit") == "K", F.col("was_role")).otherwise(F.col("role")))
    new = taken.where("sub != 0").select("conv", "pos", "sub", "edit", "role", F.lit("").alias("text"))
    return kept.unionByName(new, allowMissingColumns=True).select(*shape.names)


def summaries(edits: DataFrame) -> DataFrame:
    """``conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256`` of every conversation in ``repair``'s rows.

    A digest needs its text in order, so a conversation passes through one task, row by row; only its audit is held.
    """
    named = edits.select("conv", "pos", "sub", "turn", "was_role", "text", "fault", "edit", "role", "cost")
    ordered = named.repartition("conv").sortWithinPartitions("conv", "pos", "sub")
    shape = f"conv {named.schema['conv'].dataType.simpleString()}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    names = ["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv_type, done, now = named_type, [], None

        def close():
            low, high, distinct = now["turns"]
            return (now["conv"], high - low + 1 - distinct if distinct else 0, now["blank"], now["duplicate"], now["truncated"], now["illegal"], now["cost"],
                    now["audit"].decode(), now["sha"].hexdigest())

        def batch(rows):
            cols = list(zip(*rows))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], conv_type), *(pa.array(c, pa.int64()) for c in cols[1:7]), pa.array(cols[7], pa.string()),
                                               pa.array(cols[8], pa.string())], names)
        for b in batches:
            for conv, turn, was, text, fault, edit, role, cost in zip(*(b.column(i).to_pylist() for i in (0, 3, 4, 5, 6, 7, 8, 9))):
                if now is None or conv != now["conv"]:
                    if now is not None:
                        done.append(close())
                    now = {"conv": conv, "turns": (0, 0, 0), "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": bytearray(),
                           "sha": hashlib.sha256(), "was": None, "any": False}
                if edit != "I":
                    if fault:
                        now[fault] += 1
                    if now["was"] is not None and now["was"][:1] + was[:1] not in ("su", "ua", "au"):
                        now["illegal"] += 1
                    now["was"] = was
                    if turn is not None:
                        low, high, distinct = now["turns"]
                        now["turns"] = (turn, turn, 1) if not distinct else (low, turn, distinct + (turn != high))
                now["cost"] += cost
                now["audit"] += edit.encode()
                if edit != "D":
                    now["sha"].update((("\n" if now["any"] else "") + f"{role}:{text}").encode())
                    now["any"] = True
            if len(done) >= 4096:
                yield batch(done)
                done = []
        if now is not None:
            done.append(close())
        if done:
            yield batch(done)
    from pyspark.sql.pandas.types import to_arrow_type
    named_type = to_arrow_type(named.schema["conv"].dataType)
    return ordered.mapInArrow(run, shape)


def repaired_summary(original: DataFrame, rows: DataFrame, block_rows: int = 4096) -> DataFrame:
    """``summaries`` of ``rows`` for every conversation of ``original``; one without rows has zeros, no audit and the digest of nothing."""
    made = summaries(repair(rows, block_rows))
    ids = original.select("conv_id").distinct()
    nothing = hashlib.sha256(b"").hexdigest()
    zero = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return ids.join(made, ids["conv_id"].eqNullSafe(made["conv"]), "left").select(
        "conv_id", *(F.coalesce(F.col(n), F.lit(0)).alias(n) for n in zero), F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))
