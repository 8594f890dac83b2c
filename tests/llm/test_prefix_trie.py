"""The prefix trie against one built as a dictionary of prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from seclog.llm import prefix_trie

DDL = "conv_id long, turn long, role string, text string, near string, n long, digest binary"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, b"y") for r in rows], DDL).repartition(3)


def told(rows):
    """conv_id to its turns; rows of one turn must be equal here, as their order is by digest."""
    out = defaultdict(list)
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "")):
        out[c].append((role or "", text or ""))
    return dict(out)


def shared(rows):
    own = told(rows)
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - c % 5, [])[:h] + own[c][h:]
    return out


def trie(convs):
    members = defaultdict(list)
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            members[tuple(convs[c][:d])].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[x] for x in children[p]) or 1
        size = len(p[-1][1].encode()) if p else 0
        saved[p] = (len(members[p]) - 1) * size + sum(saved[x] for x in children[p])
    rows = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in m if len(convs[c]) == len(p))
        rows.append((m[0], len(p), members[p[:-1]][0] if p else None, len(m), len(children[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return rows


def same(got, want):
    key = lambda rows: sorted((tuple(-1 if x is None else x for x in r) for r in rows))
    assert key(got) == key(want)


def talk(seed, n, most=9, words=3):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rng.randint(0, most)):
            rows.append((c, t if t or c % 7 else None, rng.choice(["user", "assistant", None]), rng.choice([None, "", "é" * rng.randint(1, words), "a", "中文"])))
    return rows


@pytest.mark.parametrize(("block", "batch"), [(16, 10_000), (30, 2), (4096, 7)])
def test_the_trie_of_rebuilt_conversations(spark, block, batch):
    rows = talk(block, 120)
    rows += [(200 + c, t, "user", "same") for c in range(60) for t in range(5)]  # a group of copies
    rows += [(300 + c, t, "user", "hot" if t < 2 else f"{c} {t}") for c in range(40) for t in range(4)]  # a hot start
    rows += [(400, t, "user", f"turn {t // 2}") for t in range(300)] + [(401, 3, "x", "long" * 9000), (None, 1, "user", "nobody's")]
    rows += [(500, 1, "user", "twice")] * 2
    convs = prefix_trie.with_shared_starts(table(spark, rows))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        same(prefix_trie.prefix_trie(convs, block).collect(), trie(shared(rows)))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_random_tries_in_blocks_of_every_size():
    rng = random.Random(5)
    for _ in range(150):
        convs = {c: [("user", rng.choice("ab")) for _ in range(rng.randint(0, 6))] for c in rng.sample(range(-50, 99), rng.randint(1, 14))}
        rows = sorted((b"".join((x + y).encode().ljust(16) for x, y in turns), c) for c, turns in convs.items())
        block = prefix_trie.Peeling([p for p, _ in rows], [prefix_trie.np.array([len(y) for _, y in convs[c]], "int64") for _, c in rows], prefix_trie.np.array([c for _, c in rows]), None, True)
        block.run()
        (out,) = block.tables(0)
        names = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
        want = [tuple(r) for r in trie(convs)]
        same(zip(*[out[c] for c in names], strict=True), want)


def test_trees_of_no_and_of_turnless_conversations(spark):
    assert prefix_trie.prefix_trie(prefix_trie.with_shared_starts(table(spark, []))).collect() == []
    turnless = spark.createDataFrame([(7, []), (3, [])], "conv_id long, turns array<struct<digest:binary,size:long>>")
    assert [tuple(r) for r in prefix_trie.prefix_trie(turnless).collect()] == [(3, 0, None, 2, 0, 1, 0, hashlib.sha256(b"3,7").hexdigest())]
