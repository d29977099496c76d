"""Operator 12: the trie of conversation prefixes, by an external mergesort that
carries common prefixes.

Conversations are range-partitioned by their turns' digests. A task cuts what it
gets into runs, sorts each with the length of the prefix that neighbours share
(LCP), and merges the runs by a loser tree that compares only beyond a shared
prefix. The merged stream keeps the open path of the trie on a stack: a node is
finished when a conversation leaves it. Nodes on the path of a partition's first
or last conversation may go on in other partitions; their sums meet in a second
pass of the same kind over one row a partition.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import dropped, written

#: Bytes of a turn's digest.
WIDTH = 16
#: Digest bytes that a partition should hold: the bound of a task's memory.
PART_BYTES = 8 << 20
#: Every conversation takes over up to 8 turns of the first of its GROUP.
GROUP, HEADS = 5, 9
_EMPTY = hashlib.sha256(b"").hexdigest()


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, key, size): turns in order, from 1, with the digest of role
    and text and the bytes of the text."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    key = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * WIDTH)
    t = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long"), "turn", key.alias("key"), F.octet_length(text).cast("long").alias("size"))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "key")
    return t.select("conv_id", F.row_number().over(order).alias("pos"), "key", "size")


def head_turns(conv_id: Column) -> Column:
    return F.crc32(conv_id.cast("string")) % HEADS


def rebuilt(t: DataFrame) -> DataFrame:
    """(conv_id, keys, sizes) of every conversation of turns(): the first
    head_turns() turns of the first conversation of its group, if there is one,
    then its own beyond as many. keys has WIDTH bytes a turn."""
    own_head = F.pmod("conv_id", F.lit(GROUP)) == 0
    taken = own_head | (F.col("pos") > head_turns(F.col("conv_id")))
    own = t.select("conv_id", "pos", "key", "size", taken.alias("taken"), F.lit(True).alias("own")).where("taken or pos = 1")
    lent = t.where(own_head & (F.col("pos") < HEADS)).select(F.explode(F.array(*(F.try_add("conv_id", F.lit(k)) for k in range(1, GROUP)))).alias("conv_id"), "pos", "key", "size")
    lent = lent.where(F.col("pos") <= head_turns(F.col("conv_id"))).withColumns({"taken": F.lit(True), "own": F.lit(False)})
    all_turns = F.array_sort(F.collect_list(F.when(F.col("taken"), F.struct("pos", "key", "size"))))
    g = own.unionByName(lent).groupBy("conv_id").agg(F.max("own").alias("own"), all_turns.alias("a")).where("own")
    return g.select("conv_id", F.unhex(F.array_join(F.transform("a", lambda x: x["key"]), "")).alias("keys"), F.transform("a", lambda x: x["size"]).alias("sizes"))


# ---- sorting -----------------------------------------------------------------


def common(a: bytes, b: bytes, at: int) -> int:
    """The turns that a and b begin with alike, at of which are known to be."""
    n, step = min(len(a), len(b)) // WIDTH, 1
    while step:
        if at + step <= n and a[WIDTH * at: WIDTH * (at + step)] == b[WIDTH * at: WIDTH * (at + step)]:
            at, step = at + step, 2 * step
        else:
            step //= 2
    return at


class Run:
    """Sorted conversations and the LCP of each with the one before."""

    def __init__(self, rows: list[tuple[bytes, int, list[int]]]):
        self.rows = sorted(rows, key=lambda r: r[:2])
        self.lcp = [0] + [common(a[0], b[0], 0) for a, b in zip(self.rows, self.rows[1:])]


def merged(runs: list[Run]) -> Iterator[tuple[bytes, int, list[int], int]]:
    """All rows in order, each with its LCP with the one before.

    lcp holds for each run what its head shares with the row it lost to. On the
    way of the last winner up the tree all have lost to it: a longer shared
    prefix decides, and only where two are equal are the turns beyond compared.
    """
    k = len(runs)
    at, lcp, loser = [0] * k, [0] * k, [-1] * max(1, k)

    def play(a: int, b: int) -> tuple[int, int]:
        if at[a] == len(runs[a].rows):
            return b, a
        if at[b] == len(runs[b].rows):
            return a, b
        if lcp[a] != lcp[b]:
            return (a, b) if lcp[a] > lcp[b] else (b, a)
        (x, i, _), (y, j, _) = runs[a].rows[at[a]], runs[b].rows[at[b]]
        n = common(x, y, lcp[a])
        u, v = x[WIDTH * n: WIDTH * n + WIDTH], y[WIDTH * n: WIDTH * n + WIDTH]
        win, lose = (a, b) if (u, i) < (v, j) else (b, a)
        lcp[lose] = n
        return win, lose

    def build(node: int) -> int:
        if node >= k:
            return node - k
        win, loser[node] = play(build(2 * node), build(2 * node + 1))
        return win

    if not k:
        return
    win = build(1)
    while at[win] < len(runs[win].rows):
        yield *runs[win].rows[at[win]], lcp[win]
        at[win] += 1
        if at[win] < len(runs[win].rows):
            lcp[win] = runs[win].lcp[at[win]]
        node = (win + k) // 2
        while node:
            win, loser[node] = play(win, loser[node])
            node //= 2


# ---- nodes -------------------------------------------------------------------


class Node:
    """An open node. Of nodes on a partition's first or last path the sums leave
    out what lies below other such nodes."""

    __slots__ = ("id", "parent", "size", "conv", "n", "children", "leaves", "saved", "ends", "waiting")

    def __init__(self, size: int):
        self.size, self.conv, self.n, self.children, self.leaves, self.saved = size, None, 0, 0, 0, 0
        self.ends, self.waiting = None, []

    def members(self, conv: int | None, n: int) -> None:
        if conv is not None:
            self.conv = conv if self.conv is None else min(self.conv, conv)
            self.n += n

    def closed(self) -> None:
        """All below is known."""
        self.leaves = self.leaves if self.children else 1
        self.saved += (self.n - 1) * self.size

    def below(self, v: Node) -> None:
        self.members(v.conv, v.n)
        self.children, self.leaves, self.saved = self.children + 1, self.leaves + v.leaves, self.saved + v.saved

    def sums(self) -> tuple:
        return self.conv, self.n, self.children, self.leaves, self.saved


_LOCAL = "part int, depth long, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, parent_conv_id long, slot int"
_SPINE = "first binary, last binary, first_sizes array<long>, last_sizes array<long>, sums array<long>"
_ENDS = "at int, ends string"
#: Rows of three kinds from one pass: nodes (depth is given), a partition's two
#: paths (first is given), and ids that end in a node of those (ends is given).
MADE = f"{_LOCAL}, {_SPINE}, {_ENDS}"


def part_nodes(stream: Iterable[tuple[bytes, int, list[int], int]], part: int, ids_a_row: int = 500) -> Iterator[tuple]:
    """Rows of MADE for one partition's conversations in order. The nodes of the
    first path have the slots 0, 1, ... by depth, those of the last path that are
    not on the first one -depth; slot names the parent where it is one of them."""
    path: list[Node] = [Node(0)]
    spine: dict[int, Node] = {}
    first = last = b""
    first_sizes = last_sizes = []
    shared = None  # how deep the current path is that of the first conversation
    ready: list[tuple] = []

    def give(v: Node, slot: int | None) -> None:
        """The finished children of v: their parent's id is known, or its slot."""
        ready.extend((part, *row, None if slot is not None else v.conv, slot, *[None] * 7) for row in v.waiting)
        v.waiting = []

    def pop() -> None:
        depth, v = len(path) - 1, path.pop()
        if depth <= shared:
            spine[depth] = v
            return
        v.closed()
        path[-1].below(v)
        sha = hashlib.sha256(",".join(map(str, v.ends)).encode()).hexdigest() if v.ends else _EMPTY
        path[-1].waiting.append((depth, *v.sums(), sha))
        give(v, None)

    for keys, conv, sizes, lcp in stream:
        if shared is None:
            first, first_sizes, shared = keys, sizes, len(keys) // WIDTH
        else:
            while len(path) - 1 > lcp:
                pop()
            shared = min(shared, lcp)
        path.extend(Node(int(s)) for s in sizes[len(path) - 1:])
        path[-1].members(conv, 1)
        if path[-1].ends is None:
            path[-1].ends = array("q")
        path[-1].ends.append(conv)
        last, last_sizes = keys, sizes
        for depth in range(shared + 1):  # parents whose slot is known
            if path[depth].waiting:
                give(path[depth], depth)
        yield from ready
        ready.clear()
    if shared is None:
        return
    for depth, v in enumerate(path):
        spine[depth if depth <= shared else -depth] = v
    slots = [*range(len(first) // WIDTH + 1), *(-d for d in range(shared + 1, len(path)))]
    sums = []
    for slot in slots:
        v = spine[slot]
        give(v, slot)
        sums += [v.conv if v.n else 0, *v.sums()[1:]]
        for k in range(0, len(v.ends or ()), ids_a_row):
            ready.append((part, *[None] * 8, slot, *[None] * 5, k // ids_a_row, ",".join(map(str, v.ends[k: k + ids_a_row]))))
    yield from ready
    yield (part, *[None] * 9, first, last, list(map(int, first_sizes)), list(map(int, last_sizes)), sums, None, None)


_STITCHED = "part int, slot int, id long, parent long, depth long, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"


def stitched_nodes(summaries: Iterable[tuple]) -> Iterator[tuple]:
    """Rows of _STITCHED from (part, first, last, first_sizes, last_sizes, sums)
    of the partitions in order: (part, slot, id) of each slot, and the finished
    nodes (part and slot null)."""
    path: list[Node] = []
    before, made = b"", 0

    def pop() -> tuple:
        depth, v = len(path) - 1, path.pop()
        v.closed()
        if path:
            path[-1].below(v)
        return (None, None, v.id, v.parent, depth, *v.sums())

    def put(depth: int, size: int, sums: list[int]) -> Node:
        nonlocal made
        if depth == len(path):
            v = Node(size)
            v.id, v.parent, made = made, path[-1].id if path else None, made + 1
            path.append(v)
        v = path[depth]
        v.members(sums[0] if sums[1] else None, sums[1])
        v.children, v.leaves, v.saved = v.children + sums[2], v.leaves + sums[3], v.saved + sums[4]
        return v

    for part, first, last, first_sizes, last_sizes, sums in summaries:
        upto = common(before, first, 0) if path else -1
        while len(path) - 1 > upto:
            yield pop()
        n, shared, none = len(first) // WIDTH, common(first, last, 0), (None,) * 7
        for d in range(n + 1):
            yield (part, d, put(d, first_sizes[d - 1] if d else 0, sums[5 * d: 5 * d + 5]).id, *none)
        while len(path) - 1 > shared:
            yield pop()
        for d in range(shared + 1, len(last) // WIDTH + 1):
            k = 5 * (n + d - shared)
            yield (part, -d, put(d, last_sizes[d - 1], sums[k: k + 5]).id, *none)
        before = last
    while path:
        yield pop()


def _frames(rows: Iterable[tuple], schema: str, at_once: int = 5000) -> Iterator[pd.DataFrame]:
    names, some = [c.split()[0] for c in schema.split(", ")], []
    for r in rows:
        some.append(r)
        if len(some) == at_once:
            yield pd.DataFrame(some, columns=names, dtype=object)
            some = []
    if some:
        yield pd.DataFrame(some, columns=names, dtype=object)


def _sorted_nodes(records: DataFrame, parts: int, run_rows: int) -> DataFrame:
    def run(batches):
        from pyspark import TaskContext

        runs = []
        for pdf in batches:
            rows = list(zip(pdf["keys"], pdf["conv_id"].tolist(), pdf["sizes"]))
            runs += [Run(rows[k: k + run_rows]) for k in range(0, len(rows), run_rows)]
        yield from _frames(part_nodes(merged(runs), TaskContext.get().partitionId()), MADE)

    return records.repartitionByRange(parts, "keys", "conv_id").mapInPandas(run, MADE)


def _stitched(spines: DataFrame) -> DataFrame:
    """In one task, a row a partition, streamed."""

    def run(batches):
        yield from _frames(stitched_nodes(r for pdf in batches for r in pdf.itertuples(index=False)), _STITCHED)

    return spines.repartition(1).sortWithinPartitions("part").mapInPandas(run, _STITCHED)


def _end_digests(ends: DataFrame) -> DataFrame:
    """(id, ends_sha256) from (id, part, at, ends): texts of many ids in order.
    A group streams through its task, some hundred ids a row."""

    def run(batches):
        node, sha = None, None
        for pdf in batches:
            out = []
            for i, text in zip(pdf["id"].tolist(), pdf["ends"]):
                if i != node:
                    if sha:
                        out.append((node, sha.hexdigest()))
                    node, sha = i, hashlib.sha256(text.encode())
                else:
                    sha.update(b"," + text.encode())
            yield pd.DataFrame(out, columns=["id", "ends_sha256"])
        if sha:
            yield pd.DataFrame([(node, sha.hexdigest())], columns=["id", "ends_sha256"])

    return ends.select("id", "part", "at", "ends").repartition("id").sortWithinPartitions("id", "part", "at").mapInPandas(run, "id long, ends_sha256 string")


_NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie(records: DataFrame, part_bytes: int = PART_BYTES, run_rows: int = 10_000) -> DataFrame:
    """The nodes of rebuilt() conversations: conv_id (smallest member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    A conversation is one record, of 24 bytes a turn. Copies and conversations
    that begin alike are dealt over as many partitions as their bytes ask for.
    What meets in one task is a row a partition; digests of many ids that end in
    one node are made of rows of 500 ids, streamed.
    """
    records = written(records, "conversations")
    total = records.agg(F.sum(F.octet_length("keys") + 32)).first()[0] or 0
    parts = max(int(records.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // part_bytes + 1)
    made = written(_sorted_nodes(records, parts, run_rows), "nodes")
    dropped(records)
    stitched = written(_stitched(made.where("first is not null").select("part", *(c.split()[0] for c in _SPINE.split(", ")))), "spine")
    slots = stitched.where("part is not null").select("part", "slot", "id")
    ends = _end_digests(made.where("ends is not null").select("part", "slot", "at", "ends").join(slots, ["part", "slot"]))
    parent = stitched.where("part is null").select(F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    spine = written(
        stitched.where("part is null").drop("part", "slot").join(ends, "id", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_EMPTY))).join(parent, "parent", "left"), "spine"
    )
    local = made.where("depth is not null").select("part", "slot", *_NODE)
    above = slots.join(spine.select("id", F.col("conv_id").alias("parent_conv_id")), "id").drop("id")
    inner = local.where("slot is null").select(*_NODE)
    hung = local.where("slot is not null").drop("parent_conv_id").join(above, ["part", "slot"]).select(*_NODE)
    return inner.union(hung).union(spine.select(*_NODE))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """trie() of all conversations, rebuilt.

    Null roles and texts are empty; null turns come first; turns of one number
    are ordered by their digest, and repeated rows are turns of their own. Rows
    without conv_id belong to no conversation and are left out. A conversation
    that is rebuilt to no turns is a member of the root alone. An empty table
    has no nodes; columns other than the four are not read.
    """
    return trie(rebuilt(turns(conversations)))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
