"""Repair of conversations: turns are aligned to strings of the grammar ``(s?(ua)+)?`` at the least cost of edits.

The grammar has one string for each length and opening, so the cheapest repair is the
best Wagner-Fischer alignment to any of them. Lengths are tried in the order of what they
must cost at least; the cheapest alignment so far is the incumbent, and its cost bounds
both the lengths that are still worth a try and, as in Ukkonen's algorithm, the
diagonals of the table that can be on a path as cheap. Each length's audit is traced
back and compared with the incumbent's, so that of equal costs the least audit stays.

Keeping costs 0, a new role 2, deleting 3, inserting 2; a truncated turn that stays adds
1. Blank and repeated turns must be deleted.

A conversation of more than ``PIECE`` turns is aligned in pieces. A piece has one best
alignment for each state of the grammar that it may begin and end in; costs are folded in
a tree of pieces from its leaves to the root and back, which gives every piece the
cost of what follows it and the state it begins in. No task gets a whole conversation but
the one that hashes or joins what is left of it, which streams.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import fresh, stored, text_batches
from tidemark.llm.places import with_places

#: Turns that are aligned at once, and pieces that are folded at once.
PIECE = 32
FOLD = 64

DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
NEVER = 1 << 40

# States of the grammar: nothing yet, after s, after u, after a. The next role is u but after u.
START, SYSTEM, USER, ASSISTANT = range(4)

SPACE = r"\x20\x09-\x0D"
SPACES = " \t\n\x0b\f\r"

#: A turn as one character: ``-`` must go; else s, u, a or x for other roles, as a capital if it is truncated.
Codes = str


def string(opening: str, length: int) -> str:
    """The grammar's string of a length that goes on after ``opening``."""
    tail = "uaua" if opening != "u" else "auau"
    return (("s" if opening == "s" else "") + tail * (length // 4 + 1))[:length]


def least_cost(rows: int, forced: int, length: int) -> int:
    """What aligning ``rows``, of which ``forced`` must go, to a string of ``length`` costs at least."""
    return max(DELETE * forced + INSERT * max(0, length - rows + forced), DELETE * max(0, rows - length))


def diagonals(rows: int, length: int, incumbent: int) -> tuple[int, int]:
    """The range of length minus rows at which a path as cheap as the incumbent can pass."""
    def least(d: int) -> int:
        rest = length - rows - d
        return INSERT * max(0, d) + DELETE * max(0, -d) + INSERT * max(0, rest) + DELETE * max(0, -rest)

    near = sorted((0, length - rows))
    lo, hi = near
    while lo > -rows and least(lo - 1) <= incumbent:
        lo -= 1
    while hi < length and least(hi + 1) <= incumbent:
        hi += 1
    return lo, hi


def align(codes: Codes, target: str, incumbent: int, open_end: bool) -> tuple[int, str] | None:
    """Cost and least audit of ``codes`` against ``target`` if it is at most ``incumbent``; without ``open_end`` nothing is inserted after the last turn."""
    n, m = len(codes), len(target)
    lo, hi = diagonals(n, m, incumbent)
    rest = [[NEVER] * (m + 1) for _ in range(n + 1)]
    rest[n][m] = 0
    for i in range(n, -1, -1):
        row, below = rest[i], rest[i + 1] if i < n else None
        for j in range(min(m, i + hi), max(0, i + lo) - 1, -1):
            best = row[j]
            if j < m and target[j] != "s" and (i < n or open_end):
                best = min(best, INSERT + row[j + 1])
            if i < n:
                best = min(best, DELETE + below[j])
                if j < m:
                    best = min(best, stay_cost(codes[i], target[j]) + below[j + 1])
            row[j] = best
    if rest[0][0] > incumbent:
        return None
    i = j = 0
    audit = []
    while i < n or j < m:
        now = rest[i][j]
        if i < n and DELETE + rest[i + 1][j] == now:
            audit.append("D")
            i += 1
        elif j < m and target[j] != "s" and (i < n or open_end) and INSERT + rest[i][j + 1] == now:
            audit.append("I")
            j += 1
        else:
            audit.append("K" if codes[i].lower() == target[j] else "R")
            i, j = i + 1, j + 1
    return rest[0][0], "".join(audit)


def stay_cost(code: str, role: str) -> int:
    """Cost of a turn that stays with ``role``."""
    if code == "-":
        return NEVER
    cost = TRUNCATED if code.isupper() else 0
    return cost if code.lower() == role else NEVER if role == "s" else cost + REROLE


def strings(begin: int, end: int, most: int) -> list[str]:
    """Strings of up to ``most`` roles that lead from one state to another."""
    made = [""] if begin == end else []
    openings = {START: ["", "s"], SYSTEM: [""], USER: ["u"], ASSISTANT: [""]}[begin]
    last = {SYSTEM: "s", USER: "u", ASSISTANT: "a"}.get(end)
    for opening in openings:
        made += [s for k in range(1, most + 1) if (s := string(opening, k))[-1] == last]
    return list(dict.fromkeys(made))


def cheapest(codes: Codes, targets: list[str], open_end: bool) -> tuple[int, str] | None:
    """The cheapest alignment to any of ``targets``, of equal ones that with the least audit."""
    n, forced = len(codes), codes.count("-")
    bounds = sorted((least_cost(n, forced, len(t)), len(t), t) for t in targets)
    best: tuple[int, str] | None = None
    for least, _, target in bounds:
        incumbent = best[0] if best else (DELETE + INSERT + TRUNCATED) * (n + len(target)) + DELETE
        if least > incumbent:
            break
        found = align(codes, target, incumbent, open_end)
        if found and (best is None or found < best):
            best = found
    return best


@lru_cache(maxsize=1 << 14)
def whole(codes: Codes) -> tuple[int, str]:
    """Cost and audit of a conversation in one piece."""
    return cheapest(codes, strings(START, START, 0) + strings(START, ASSISTANT, 2 * len(codes) + 2), True)


@lru_cache(maxsize=1 << 12)
def piece(codes: Codes) -> tuple[list[int], list[str]]:
    """Costs and audits of a piece from each state (four at a time) to each; what can't be costs NEVER."""
    made = [cheapest(codes, strings(p, q, 2 * len(codes) + 2), False) or (NEVER, "") for p in range(4) for q in range(4)]
    return [c for c, _ in made], [a for _, a in made]


#: Cost of what is inserted after the last turn, by state.
LAST = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}


def illegal_pairs(initials: Column) -> Column:
    """Adjacent initials other than su, ua, au."""
    pairs = F.transform(F.sequence(F.lit(1), F.length(initials) - 1), lambda i: F.substring(initials, i, F.lit(2)))
    return F.when(F.length(initials) < 2, 0).otherwise(F.size(F.filter(pairs, lambda p: ~p.isin("su", "ua", "au"))))


def aligned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of conversations in one piece: cost, audit."""
    for batch in batches:
        made = [whole(c) for c in batch["codes"]]
        yield batch[["g", "piece"]].assign(cost=[c for c, _ in made], audit=[a for _, a in made], begin=START)


def tabled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of pieces: costs and audits from state to state."""
    for batch in batches:
        made = [piece(c) for c in batch["codes"]]
        yield batch[["g", "piece"]].assign(costs=[c for c, _ in made], audits=[a for _, a in made])


def product(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Costs of consecutive nodes as those of their parent."""
    now = None
    for costs in rows.sort_values("node")["costs"]:
        c = np.asarray(costs).reshape(4, 4)
        now = c if now is None else np.minimum((now[:, :, None] + c[None]).min(axis=1), NEVER)
    return pd.DataFrame({"g": [key[0]], "node": [key[1]], "costs": [now.ravel().tolist()]})


def following(key: tuple, rows: pd.DataFrame, parent: pd.DataFrame) -> pd.DataFrame:
    """(g, node, rest): for each node, what follows it costs at least, by the state that it ends in."""
    rest = np.asarray(parent["rest"].iloc[0])
    made = []
    for node, costs in rows.sort_values("node", ascending=False)[["node", "costs"]].itertuples(index=False):
        made.append((key[0], node, rest.tolist()))
        rest = np.minimum((np.asarray(costs).reshape(4, 4) + rest[None]).min(axis=1), NEVER)
    return pd.DataFrame(made, columns=["g", "node", "rest"])


def choose(costs: list[int], audits: list[str], rest: list[int]) -> list[int]:
    """The state that a piece ends in, by the state it begins in: the cheapest in all, of equal ones that with the least audit."""
    return [min(range(4), key=lambda q: (min(costs[4 * p + q] + rest[q], NEVER), audits[4 * p + q], q)) for p in range(4)]


def chosen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(g, node, ends) of pieces."""
    for batch in batches:
        ends = [choose(c, a, r) for c, a, r in zip(batch["costs"], batch["audits"], batch["rest"])]
        yield batch[["g", "node"]].assign(ends=ends)


def chained(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """States that consecutive nodes lead to."""
    now = list(range(4))
    for ends in rows.sort_values("node")["ends"]:
        now = [int(ends[s]) for s in now]
    return pd.DataFrame({"g": [key[0]], "node": [key[1]], "ends": [now]})


def entered(key: tuple, rows: pd.DataFrame, parent: pd.DataFrame) -> pd.DataFrame:
    """(g, node, begin): the state each node begins in."""
    state, made = int(parent["begin"].iloc[0]), []
    for node, ends in rows.sort_values("node")[["node", "ends"]].itertuples(index=False):
        made.append((key[0], node, state))
        state = int(ends[state])
    return pd.DataFrame(made, columns=["g", "node", "begin"])


def tree(leaves: DataFrame, column: str, fold, kind: str) -> list[DataFrame]:
    """``leaves`` (g, node, column) and the levels above, each stored, up to one node a conversation."""
    made = [leaves]
    up = lambda df: df.select("g", F.expr(f"node div {FOLD}").alias("parent"), "node", column)
    while (made[-1].agg(F.max("node")).first()[0] or 0) > 0:
        made.append(stored(up(made[-1]).groupBy("g", "parent").applyInPandas(fold, f"g string, node long, {column} {kind}")))
    return made


def handed_down(levels: list[DataFrame], top: DataFrame, spread, column: str, kind: str) -> DataFrame:
    """``top`` (g, node, column) of the roots, for the leaves."""
    now = top
    for level in reversed(levels[:-1]):
        children = level.withColumn("parent", F.expr(f"node div {FOLD}"))
        parents = now.withColumnRenamed("node", "parent")
        now = stored(children.groupBy("g", "parent").cogroup(parents.groupBy("g", "parent")).applyInPandas(spread, f"g string, node long, {column} {kind}"))
    return now


def pieced(pieces: DataFrame) -> DataFrame:
    """(g, piece, cost, audit, begin) of the pieces of long conversations."""
    tables = stored(pieces.mapInPandas(tabled, "g string, piece long, costs array<long>, audits array<string>").withColumnRenamed("piece", "node"))
    costs = tree(tables.select("g", "node", "costs"), "costs", product, "array<long>")
    last = [INSERT * len(LAST[s]) for s in range(4)]
    rest = handed_down(costs, costs[-1].select("g", "node", F.lit(last).cast("array<long>").alias("rest")), following, "rest", "array<long>")
    full = tables.join(rest, ["g", "node"])
    ends = stored(full.mapInPandas(chosen, "g string, node long, ends array<int>"))
    states = tree(ends, "ends", chained, "array<int>")
    begin = handed_down(states, states[-1].select("g", "node", F.lit(START).alias("begin")), entered, "begin", "int")
    at = F.col("begin") * 4 + F.get("ends", F.col("begin"))
    made = tables.join(ends, ["g", "node"]).join(begin, ["g", "node"]).select("g", F.col("node").alias("piece"), F.get("costs", at).alias("cost"), F.get("audits", at).alias("audit"), "begin", F.get("ends", F.col("begin")).alias("end"))
    final = pieces.groupBy("g").agg(F.max("piece").alias("final"))
    tail = F.when(F.col("piece") == F.col("final"), F.get(F.lit([LAST[s] for s in range(4)]), F.col("end"))).otherwise("")
    made = made.join(final, "g").withColumn("tail", tail)
    return made.select("g", "piece", (F.col("cost") + INSERT * F.length("tail")).alias("cost"), F.concat("audit", "tail").alias("audit"), "begin")


def turn_edits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(g, index, step, edit, new_role) for each edit of each piece; an insertion has no index, only a reroled or inserted turn a new role."""
    for batch in batches:
        rows = []
        for g, number, audit, begin, codes in batch[["g", "piece", "audit", "begin", "codes"]].itertuples(index=False):
            state, i = int(begin), 0
            for step, edit in enumerate(audit):
                new = None
                if edit == "K" and codes[i].lower() == "s":
                    state = SYSTEM
                elif edit != "D":
                    state = ASSISTANT if state == USER else USER
                    new = None if edit == "K" else "user" if state == USER else "assistant"
                rows.append((g, None if edit == "I" else number * PIECE + i, number * 4 * PIECE + step, edit, new))
                i += edit != "I"
        made = pd.DataFrame(rows, columns=["g", "index", "step", "edit", "new_role"])
        yield made.astype({"index": "Int64"})


def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(g, repaired_sha256) of lines in order of g; only the digest of the conversation in hand is kept."""
    now, state = None, None
    for batch in batches:
        done = []
        for g, line in zip(batch["g"], batch["line"]):
            if g != now:
                if state is not None:
                    done.append((now, state.hexdigest()))
                now, state = g, hashlib.sha256()
            else:
                state.update(b"\n")
            state.update(line.encode("utf-8", "surrogatepass"))
        yield pd.DataFrame(done, columns=["g", "repaired_sha256"])
    if state is not None:
        yield pd.DataFrame([(now, state.hexdigest())], columns=["g", "repaired_sha256"])


def group_key(conv: Column) -> Column:
    """A key that is never null."""
    return F.coalesce(F.concat(F.lit("+"), conv.cast("string")), F.lit(""))


class Repair:
    """Repair of ``turns`` (conv_id, turn, role, text): ``conversations()`` has the audits, ``turns()`` what is left.

    Turns go by number (null first), those of one number by the digest of role and text.
    A null role or text counts as one space, a null conversation is one like any other.
    An empty text is blank; of turns that repeat role and text the first is none. Texts
    of any length are read once for their ends and once more for the result. An empty
    table gives empty results; other columns are left out.
    """

    def __init__(self, turns: DataFrame) -> None:
        text_batches(turns.sparkSession)
        role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
        rows = turns.select(group_key(F.col("conv_id")).alias("g"), "conv_id", F.col("turn").cast("long").alias("id"), role.alias("role"), text.alias("text"))
        self.rows = stored(rows.withColumn("row", F.monotonically_increasing_id()))
        self.coded = self.with_codes()
        entry = F.struct("index", "code", "initial")
        strung = lambda c: F.array_join(F.transform("turns", lambda t: t[c]), "").alias(f"{c}s")
        pieces = self.coded.groupBy("g", F.expr(f"index div {PIECE}").alias("piece")).agg(F.first("total").alias("total"), F.array_sort(F.collect_list(entry)).alias("turns"))
        self.pieces = stored(pieces.select("g", "piece", "total", strung("code"), strung("initial")))
        found = self.pieces.where(F.col("total") <= PIECE).mapInPandas(aligned, "g string, piece long, cost long, audit string, begin int")
        long = self.pieces.where(F.col("total") > PIECE)
        if not long.isEmpty():
            found = found.unionByName(pieced(long))
        self.audits = stored(found)

    def with_codes(self) -> DataFrame:
        """g, id, row, index, total, fault, code and initial of each turn."""
        stripped = F.rtrim(F.col("text"), F.lit(SPACES))
        first = F.substring("role", 1, 1)
        narrow = self.rows.select(
            "g", "id", "row",
            F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256).alias("digest"),
            F.when(first.isin("s", "u", "a"), first).otherwise("x").alias("initial"),
            (stripped == "").alias("blank"), (~F.substring(stripped, -1, 1).isin(".", "!", "?")).alias("open"),
        )
        placed = stored(with_places(stored(narrow)).select("g", "id", "row", "index", "total", "digest", "initial", "blank", "open"))
        # the first of each text by its place, so that a text that repeats very often meets in no task
        firsts = placed.groupBy("g", "digest").agg(F.min("index").alias("index")).select("g", "index", F.lit(True).alias("first"))
        fault = F.when(F.col("blank"), "blank").when(F.col("first").isNull(), "duplicate").when(F.col("open"), "truncated")
        code = F.when(F.col("fault").isin("blank", "duplicate"), "-").when(F.col("fault") == "truncated", F.upper("initial")).otherwise(F.col("initial"))
        joined = placed.join(firsts, ["g", "index"], "left").withColumn("fault", fault)
        return stored(joined.select("g", "id", "row", "index", "total", "fault", code.alias("code"), "initial"))

    def conversations(self) -> DataFrame:
        """g, conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit of each conversation; gaps beyond 64 bits are null."""
        count = lambda f: F.count(F.when(F.col("fault") == f, 1)).alias(f)
        wide = lambda c: c.cast("decimal(20,0)")
        gaps = wide(F.max("id")) - wide(F.min("id")) + 1 - wide(F.count_distinct("id"))
        counts = self.coded.groupBy("g").agg(F.coalesce(gaps, F.lit(0)).try_cast("long").alias("gaps"), count("blank"), count("duplicate"), count("truncated"))
        inside = self.pieces.select("g", illegal_pairs(F.col("initials")).alias("illegal"))
        ends = self.pieces.where(F.col("total") > PIECE).select("g", "piece", F.substring("initials", -1, 1).alias("last"))
        begins = self.pieces.where(F.col("total") > PIECE).select("g", (F.col("piece") - 1).alias("piece"), F.substring("initials", 1, 1).alias("next"))
        between = ends.join(begins, ["g", "piece"]).select("g", illegal_pairs(F.concat("last", "next")).alias("illegal"))
        illegal = inside.unionByName(between).groupBy("g").agg(F.sum("illegal").alias("illegal"))
        parts = F.array_sort(F.collect_list(F.struct("piece", "audit")))
        audits = self.audits.groupBy("g").agg(F.sum("cost").alias("cost"), F.array_join(F.transform(parts, lambda p: p["audit"]), "").alias("audit"))
        names = self.rows.select("g", "conv_id").distinct()
        return names.join(counts, "g").join(illegal, "g").join(audits, "g")

    def turns(self) -> DataFrame:
        """g, conv_id, step, turn, role, text, edit (K, R or I) of the turns of the repaired conversations; ``step`` orders them."""
        edits = self.audits.join(self.pieces.select("g", "piece", "codes"), ["g", "piece"]).mapInPandas(turn_edits, "g string, index long, step long, edit string, new_role string")
        edits = stored(edits.where("edit <> 'D'"))
        of_row = edits.where("edit <> 'I'").join(self.coded.select("g", "index", "row"), ["g", "index"]).select("row", "step", "edit", "new_role")
        stay = self.rows.join(of_row, "row").select("g", "conv_id", "step", F.col("id").alias("turn"), F.coalesce("new_role", "role").alias("role"), "text", "edit")
        names = self.rows.select("g", "conv_id").distinct()
        new = edits.where("edit = 'I'").join(names, "g").select("g", "conv_id", "step", F.lit(None).cast("long").alias("turn"), F.col("new_role").alias("role"), F.lit("").alias("text"), "edit")
        return stay.unionByName(new)


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with faults by the crc32 of conversation and turn: of 20 rows one each is dropped, emptied, cut, repeated, given to the user."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind, copy = fresh(conversations, "kind", "copy")
    rows = conversations.withColumn(kind, F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20).where(F.col(kind) != 0)
    text = F.when(F.col(kind) == 1, "").when(F.col(kind) == 2, F.translate(space("text"), ".!?", "")).otherwise(space("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col(kind) == 4, "user").otherwise(space("role")).alias("role"), text.alias("text"), F.when(F.col(kind) == 3, 2).otherwise(1).alias(kind))
    return rows.withColumn(copy, F.explode(F.array_repeat(F.lit(0), F.col(kind)))).drop(kind, copy)


def repair_table(conversations: DataFrame) -> DataFrame:
    """Faults, cost, audit and digest of the repaired text of every conversation after ``damaged``."""
    repair = Repair(damaged(conversations))
    lines = repair.turns().select("g", "step", F.concat("role", F.lit(":"), "text").alias("line"))
    digests = lines.repartition("g").sortWithinPartitions("g", "step").mapInPandas(hashed, "g string, repaired_sha256 string")
    names = conversations.select(group_key(F.col("conv_id")).alias("g"), "conv_id").distinct()
    joined = names.join(repair.conversations().drop("conv_id"), "g", "left").join(digests, "g", "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) if c != "gaps" else F.when(F.col("audit").isNull(), 0).otherwise(F.col("gaps")).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return joined.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
