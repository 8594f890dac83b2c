"""The trie of conversation prefixes, peeled from the deepest turns up."""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator
from functools import reduce
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seclog.sources.staging import staged

#: Bytes that stand for a turn in a path and for a node in keys.
WIDTH = 16
#: Open paths that are peeled together.
BLOCK = 4096
BASE_EVERY, MOST_SHARED = 5, 9
NOBODY = np.iinfo(np.int64).max
NO_ENDS = hashlib.sha256(b"").hexdigest()

NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
SUMS = ("n", "least", "kids", "leaves", "saved")
#: What a block gives: nodes that are complete, paths with open nodes, and the ids that end at open nodes, by kind.
PEELED = (
    "kind string, key binary, "
    "conv_id long, depth long, parent_conv_id long, parent_key binary, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, "
    "path binary, place long, n array<long>, least array<long>, kids array<long>, leaves array<long>, saved array<long>, sizes array<long>, "
    "first_id long, ids string"
)


def conversation_turns(rows: DataFrame, near: F.Column | None = None) -> DataFrame:
    """One row per conversation of ``rows`` (conv_id, turn, role, text): conv_id, turns as array of (digest, size).

    Turns go by ``turn``, null first; rows of one turn by role, then by digest. The digest is 128 bits of the SHA-256 of
    role and text, of which null is empty; the size is that of the text in UTF-8. Texts do not move. Rows without
    conv_id belong to no conversation. ``near`` keeps conversations with one value of it in one partition.
    """
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    said = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    turn = F.struct("turn", role.alias("role"), F.unhex(F.substring(said, 1, 2 * WIDTH)).alias("digest"), F.octet_length(text).cast("long").alias("size"))
    slim = rows.filter("conv_id is not null").select("conv_id", turn.alias("turn"), (F.col("conv_id") if near is None else near).alias("near"))
    ordered = F.transform(F.sort_array(F.collect_list("turn")), lambda t: F.struct(t["digest"].alias("digest"), t["size"].alias("size")))
    return slim.repartition("near").groupBy("near", "conv_id").agg(ordered.alias("turns"))


def with_shared_starts(rows: DataFrame) -> DataFrame:
    """Conversations whose first turns are those of the conversation at the last multiple of five: conv_id, turns.

    The first h turns come from that conversation (all if it has fewer, none if there is none), then come the own
    turns after the first h, if any; h is the CRC-32 of the decimal id modulo nine.
    """
    base = F.col("conv_id") - F.col("conv_id") % BASE_EVERY
    told = conversation_turns(rows, base)
    h = (F.crc32(F.col("conv_id").cast("string")) % MOST_SHARED).cast("int")
    head = F.max(F.when(F.col("conv_id") == F.col("near"), F.slice("turns", 1, MOST_SHARED - 1))).over(Window.partitionBy("near"))
    shared = F.slice(F.coalesce(head, F.slice("turns", 1, 0)), F.lit(1), h)
    own = F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0)))
    return told.select("conv_id", F.concat(shared, own).alias("turns"))


def _shared(a: bytes, b: bytes) -> int:
    """Turns that two paths have in common at their start."""
    low, high = 0, min(len(a), len(b)) // WIDTH
    while low < high:
        middle = (low + high + 1) // 2
        if a[low * WIDTH : middle * WIDTH] == b[low * WIDTH : middle * WIDTH]:
            low = middle
        else:
            high = middle - 1
    return low


def _keys(path: bytes) -> list[bytes]:
    """A key for each prefix of a path, in chains of hashes."""
    turns = (path[at : at + WIDTH] for at in range(0, len(path), WIDTH))
    return list(accumulate(turns, lambda key, turn: hashlib.sha256(key + turn).digest()[:WIDTH], initial=bytes(WIDTH)))


class Peeling:
    """A block of paths, sorted, peeled level by level from the deepest turn.

    At each depth the paths that end there join what is left of the deeper ones; what has the same first turns is one
    node, whose sums are those of its children and of what ends at it; then the last turn is cut off. A node on the
    first or last path of the block may go on in other blocks: unless the block is ``whole``, its sums so far stay
    open, one value per depth of the path.
    """

    def __init__(self, paths: list[bytes], sizes: list[np.ndarray], ids: np.ndarray | None, sums: dict[str, list[np.ndarray]] | None, whole: bool) -> None:
        self.paths, self.sizes, self.ids, self.sums, self.whole = paths, sizes, ids, sums, whole
        self.depth = np.array([len(p) // WIDTH for p in paths])
        self.shared = np.array([_shared(a, b) for a, b in zip(paths, paths[1:], strict=False)] + [-1])
        self.keys: dict[int, list[bytes]] = {}
        self.found: dict[str, list] = {c: [] for c in ("depth", "row", "ended", "n", "least", "kids", "leaves", "saved")}
        self.parent: list[np.ndarray] = []
        self.count = 0
        self.open = {side: {c: np.full(len(paths[row]) // WIDTH + 1, NOBODY if c == "least" else 0) for c in SUMS} for side, row in ((0, 0), (1, len(paths) - 1))}
        #: Open nodes at which conversations of the block end: (row, rows, depth).
        self.open_ends: list[tuple[int, int, int]] = []

    def key(self, row: int, depth: int) -> bytes:
        if row not in self.keys:
            self.keys[row] = _keys(self.paths[row])
        return self.keys[row][depth]

    def _ending(self, depth: int, rows: np.ndarray) -> dict[str, np.ndarray]:
        """The sums that conversations bring to the nodes at which they end; open paths bring theirs separately."""
        zero = np.zeros(len(rows), np.int64)
        if self.ids is None:
            return {"n": zero, "least": zero + NOBODY, "kids": zero, "leaves": zero, "saved": zero}
        return {"n": zero + 1, "least": self.ids[rows], "kids": zero, "leaves": zero, "saved": zero}

    def run(self) -> None:
        last = len(self.paths) - 1
        by_depth = np.argsort(self.depth, kind="stable")
        borders = np.searchsorted(self.depth[by_depth], np.arange(self.depth.max() + 2))
        if self.sums is not None:
            flat = {c: np.concatenate(self.sums[c]) for c in SUMS}
            at = np.concatenate(([0], np.cumsum(self.depth + 1)[:-1]))
        none = np.zeros(0, np.int64)
        left = {"first": none, "end": none, "node": none, **{c: none for c in SUMS}}
        for d in range(int(self.depth.max()), -1, -1):
            ended = by_depth[borders[d] : borders[d + 1]]
            mine = {"first": ended, "end": ended, "node": np.full(len(ended), -1), **self._ending(d, ended)}
            order = np.argsort(np.concatenate((left["first"], ended)), kind="stable")
            item = {c: np.concatenate((left[c], mine[c]))[order] for c in left}
            apart = np.ones(len(order), bool)
            apart[1:] = (item["first"][1:] != item["end"][:-1] + 1) | (self.shared[item["end"][:-1]] < d)
            starts = np.flatnonzero(apart)
            group = np.cumsum(apart) - 1
            first, end = item["first"][starts], item["end"][np.append(starts[1:], len(order)) - 1]
            total = {c: (np.minimum if c == "least" else np.add).reduceat(item[c], starts) for c in SUMS}
            n_ended = np.add.reduceat((self.depth[item["first"]] == d) & (item["node"] < 0) & (item["first"] == item["end"]), starts)
            if self.sums is not None:
                rows = np.flatnonzero(self.depth >= d)
                cut = np.searchsorted(rows, first)
                for c in SUMS:
                    own = (np.minimum if c == "least" else np.add).reduceat(flat[c][at[rows] + d], cut)
                    total[c] = np.minimum(total[c], own) if c == "least" else total[c] + own
            side = np.full(len(first), -1)
            if not self.whole:
                side[-1:][end[-1:] == last] = 1
                side[:1][first[:1] == 0] = 0
            closed = side < 0
            # children learn their parent: its least member, or its key where it stays open
            child = item["node"] >= 0
            into = group[child]
            self.parent.append(np.stack((item["node"][child], np.where(closed[into], total["least"][into], 0), np.where(closed[into], -1, side[into]), np.full(len(into), d))))
            for g in np.flatnonzero(~closed):
                for c in SUMS:
                    self.open[side[g]][c][d] = total[c][g]
                if self.ids is not None and n_ended[g]:
                    self.open_ends.append((int(first[g]), int(n_ended[g]), d))
            total["leaves"] = np.where(total["kids"] == 0, 1, total["leaves"])
            if d:
                last_turn = np.array([self.sizes[r][d - 1] for r in first], np.int64)
                total["saved"] = total["saved"] + (total["n"] - 1) * last_turn
            for c, x in (("depth", np.full(len(first), d)), ("row", first), ("ended", n_ended), *total.items()):
                self.found[c].append(x[closed])
            node = np.full(len(first), -1)
            node[closed] = self.count + np.arange(int(closed.sum()))
            self.count += int(closed.sum())
            # an open node keeps its sums, so nothing of it goes up
            left = {"first": first, "end": end, "node": node, **{c: np.where(closed, total[c], NOBODY if c == "least" else 0) for c in SUMS}}
            left["kids"] = closed.astype(np.int64)

    def ended_ids(self, row: int, n: int) -> str:
        return ",".join(map(str, self.ids[row : row + n].tolist()))

    def tables(self, place: int) -> Iterator[dict]:
        """The rows of PEELED as columns: nodes, open paths, ids that end at open nodes."""
        nodes = {c: np.concatenate(x) for c, x in self.found.items()}
        if self.count:
            parent_id, parent_key = [None] * self.count, [None] * self.count
            for node, least, side, d in np.concatenate(self.parent, axis=1).T.tolist():
                if side < 0:
                    parent_id[node] = least
                else:
                    parent_key[node] = self.key(len(self.paths) - 1 if side else 0, d)
            rows = nodes["row"].tolist()
            out = {"depth": nodes["depth"], "conv_id": nodes["least"], "n_convs": nodes["n"], "n_children": nodes["kids"], "n_leaves": nodes["leaves"], "saved_tokens": nodes["saved"]}
            out |= {"parent_conv_id": parent_id, "parent_key": parent_key}
            if self.ids is None:
                out["key"] = [self.key(r, d) for r, d in zip(rows, nodes["depth"].tolist(), strict=True)]
            else:
                out["ends_sha256"] = [hashlib.sha256(self.ended_ids(r, n).encode()).hexdigest() if n else NO_ENDS for r, n in zip(rows, nodes["ended"].tolist(), strict=True)]
            yield {"kind": ["node"] * self.count, **out}
        if not self.whole:
            sides = {0: 0} if len(self.paths) == 1 else {0: 0, 1: len(self.paths) - 1}
            yield {
                "kind": ["open"] * len(sides), "path": [self.paths[r] for r in sides.values()], "place": [2 * place + s for s in sides],
                "sizes": [self.sizes[r] for r in sides.values()], **{c: [self.open[s][c] for s in sides] for c in SUMS},
            }
        if self.open_ends:
            yield {
                "kind": ["ends"] * len(self.open_ends), "key": [self.key(r, d) for r, _, d in self.open_ends],
                "first_id": [int(self.ids[r]) for r, _, _ in self.open_ends], "ids": [self.ended_ids(r, n) for r, n, _ in self.open_ends],
            }


def _lists(column: pa.Array) -> list[np.ndarray]:
    values, cuts = column.flatten().to_numpy(), np.cumsum(pa.compute.list_value_length(column).to_numpy(zero_copy_only=False))
    return np.split(values, cuts[:-1])


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Batches of ``size`` rows, whatever the size of those that come."""
    held, n = [], 0
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            held.append(batch.slice(at, size - n))
            n, at = n + held[-1].num_rows, at + held[-1].num_rows
            if n == size:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _peel(rows: DataFrame, whole: bool, size: int) -> DataFrame:
    """Peel sorted rows in blocks: conversations (conv_id, path, sizes) or open paths."""
    conversations = "conv_id" in rows.columns
    schema = T.StructType.fromDDL(PEELED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        place = TaskContext.get().partitionId() << 32
        for part in _blocks(batches, sys.maxsize if whole else size):
            ids = part.column("conv_id").to_numpy() if conversations else None
            sums = None if conversations else {c: _lists(part.column(c)) for c in SUMS}
            block = Peeling(part.column("path").to_pylist(), _lists(part.column("sizes")), ids, sums, whole)
            block.run()
            for out in block.tables(place):
                n = len(out["kind"])
                yield pa.RecordBatch.from_arrays([pa.array(list(out[f.name]) if pa.types.is_list(f.type) else out[f.name], f.type) if f.name in out else pa.nulls(n, f.type) for f in arrow], schema=arrow)
            place += 1

    return rows.mapInArrow(run, schema)


def _ends(parts: DataFrame) -> DataFrame:
    """(key, ends_sha256): the parts of a node's ids, which are in order, hashed one after the other, one in memory.

    A SHA-256 is one chain over its bytes, so the ids of one node, though dealt over blocks, pass one task at last.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, None
        for batch in batches:
            done = []
            for mine, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if mine != key:
                    if key is not None:
                        done.append((key, digest.hexdigest()))
                    key, digest = mine, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            yield pa.RecordBatch.from_pydict({"key": [k for k, _ in done], "ends_sha256": [h for _, h in done]}, schema=schema)
        if key is not None:
            yield pa.RecordBatch.from_pydict({"key": [key], "ends_sha256": [digest.hexdigest()]}, schema=schema)

    schema = pa.schema([("key", pa.binary()), ("ends_sha256", pa.string())])
    dealt = parts.select("key", "first_id", "ids").repartition("key").sortWithinPartitions("key", "first_id")
    return dealt.mapInArrow(run, "key binary, ends_sha256 string")


def prefix_trie(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """The nodes of the trie of ``conversations`` (conv_id, turns as array of (digest, size)); one conversation per id.

    A node at depth d is a sequence of first d turns; its members are the conversations that start with it. Per node:
    conv_id (least member), depth, parent_conv_id (least member of the parent, null at the root), n_convs, n_children,
    n_leaves (childless nodes from here down), saved_tokens (sum from here down of (members - 1) * size of the last
    turn) and ends_sha256 (of the ids of the conversations that end here, in order, joined by commas).

    Conversations are dealt by ranges of their path, then of their id, so that equal ones spread too, and each block is
    peeled by itself. Only nodes on the first and last path of a block can go on elsewhere; these two paths and their
    open sums are peeled again with those of other blocks until one block holds all. No conversations: no nodes.
    """
    path = F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["digest"])), ""))
    paths = staged(conversations.select(F.col("conv_id").cast("long"), path.alias("path"), F.col("turns.size").alias("sizes")), "paths")
    table = staged(_peel(paths.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id"), False, block), "peeled")
    ends = _ends(table.filter("kind = 'ends'"))
    levels = [table]
    while True:
        spines = levels[-1].filter("kind = 'open'").select("path", "place", *SUMS, "sizes")
        n = spines.count()
        if n <= block:
            levels.append(staged(_peel(spines.coalesce(1).sortWithinPartitions("path", "place"), True, block), "peeled"))
            break
        dealt = spines.repartitionByRange(-(-n // block), "path", "place").sortWithinPartitions("path", "place")
        levels.append(staged(_peel(dealt, False, block), "peeled"))
    nodes = [level.filter("kind = 'node'").select("key", "parent_key", *NODE) for level in levels]
    late = reduce(DataFrame.unionAll, nodes[1:])
    ended = late.drop("ends_sha256").join(ends, "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_ENDS)))
    named = late.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("named"))
    orphans = nodes[0].filter("parent_key is not null").unionByName(ended)
    found = orphans.join(named, "parent_key", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "named"))
    return nodes[0].filter("parent_key is null").select(*NODE).unionAll(found.select(*NODE))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(with_shared_starts(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
