"""Logs that grow, rotate and come again."""

import os
import random
import shutil
from collections import Counter

import numpy as np
import pytest

from seclog.sources import follow
from seclog.streaming import replays, sinks


class Run:
    """A stream over a folder that is run again and again with one checkpoint."""

    def __init__(self, spark, folder, work, chunk=64 << 20, dedup=False):
        self.spark, self.folder, self.work, self.chunk, self.dedup = spark, folder, work, chunk, dedup

    def go(self):
        lines = follow.follow_lines(self.spark, str(self.folder), "*.log*", self.chunk)
        if self.dedup:
            lines = replays.drop_replayed(lines, segment=100)
        sinks.to_table(follow.lines_of(lines), f"{self.work}/out", f"{self.work}/checkpoint").awaitTermination()
        return self.spark.read.parquet(f"{self.work}/out").select("event_id", "line").collect()


def test_a_growing_rotated_and_truncated_log_gives_each_line_once(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    run = Run(spark, logs, tmp_path / "work", chunk=40)
    live = logs / "a.log"
    live.write_bytes(b"one\ntwo \xff\xc3\xa9\n\n  three\nhalf")
    assert sorted(r.line for r in run.go()) == ["one", "three", "two é"]
    with live.open("ab") as f:
        f.write(b" done\n" + b"same\n" * 12)
    os.rename(live, logs / "a.log.1")
    live.write_text("new file\nnext\n")
    want = Counter(["one", "three", "two é", "half done", "new file", "next"] + ["same"] * 12)
    rows = run.go()
    assert Counter(r.line for r in rows) == want and len({r.event_id for r in rows}) == len(rows)
    shutil.copy(live, logs / "b.log")  # a copy of what is known, then cut short with the same first line
    assert len(run.go()) == len(rows)
    os.remove(logs / "b.log")
    live.write_text("new file\nafter the cut\n")
    rows = run.go()
    assert Counter(r.line for r in rows) == want + Counter(["new file", "after the cut"])
    for chunk in (7, 64 << 20):  # ids are those of any other read
        fresh = follow.lines_of(follow.read_grown_lines(spark, str(logs), "*.log*", chunk)).collect()
        assert {r.event_id for r in fresh} <= {r.event_id for r in rows}
        assert Counter(r.line for r in fresh) == want + Counter(["after the cut"]) - Counter(["next"])


def test_ranges_of_any_size_cut_the_same_lines(tmp_path):
    rng = random.Random(2)
    for k in range(60):
        text = "".join(rng.choice(["a", "\n", "bb\n", "\n\n", "é", " x "]) for _ in range(rng.randint(1, 60))).encode()
        path = tmp_path / f"{k}.log"
        path.write_bytes(text)
        folder = follow.LogFolder(str(path))
        for whole in (True, False):
            files = folder.files(whole)
            if not files:
                assert b"\n" not in text and not whole
                continue
            (found,) = files
            want, at = [], 0
            for raw in text[: found.end].split(b"\n"):
                size = min(len(raw) + 1, found.end - at)
                if size:
                    want.append((at, size, raw.decode().strip()))
                at += len(raw) + 1
            for chunk in (1, 2, 5, 1000):
                got = [(r["position"], r["size"], r["line"]) for s in follow.spans(found, 0, chunk) for b in follow.read_span(folder, s, whole) for r in b.to_pylist()]
                assert got == want, (text, chunk)


def test_files_with_one_first_line_are_told_apart(spark, tmp_path):
    for name, body in (("a.log", "head\n1\n2\n"), ("b.log", "head\n3\n"), ("c.log", "head\n1\n"), ("d.log", ""), ("_e.log", "no\n"), ("f.txt", "no\n")):
        (tmp_path / name).write_text(body)
    rows = follow.lines_of(follow.read_grown_lines(spark, str(tmp_path), "*.log")).collect()
    assert Counter(r.line for r in rows) == Counter(["head", "1", "2", "head", "3"])
    assert follow.read_grown_lines(spark, str(tmp_path), "*.none").count() == 0


def test_a_file_that_comes_again_whole_or_in_part_gives_each_line_once(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    body = "".join(f"line {i // 12}\n" for i in range(240)).encode()
    run = Run(spark, logs, tmp_path / "work", chunk=64, dedup=True)
    want = Counter(body.decode().split("\n")[:-1])
    (logs / "a.log").write_bytes(body[: body.index(b"line 9")])
    run.go()
    os.remove(logs / "a.log")
    run.go()
    (logs / "again.log").write_bytes(body)  # forgotten by the source, so all of it comes again
    assert Counter(r.line for r in run.go()) == want
    os.remove(logs / "again.log")
    run.go()
    (logs / "part.log").write_bytes(body[: body.index(b"line 15")])
    assert Counter(r.line for r in run.go()) == want


@pytest.mark.parametrize("seed", range(5))
def test_intervals_hold_what_was_taken(seed):
    rng = random.Random(seed)
    taken, begins, ends = set(), np.zeros(0, np.int64), np.zeros(0, np.int64)
    for _ in range(80):
        new = [(b, b + rng.randint(1, 9)) for b in (rng.randint(0, 300) for _ in range(3))]
        taken |= {x for b, e in new for x in range(b, e)}
        begins, ends = replays.joined(np.append(begins, [b for b, _ in new]), np.append(ends, [e for _, e in new]))
        assert {x for b, e in zip(begins, ends, strict=True) for x in range(b, e)} == taken and (begins[1:] > ends[:-1]).all()
        at = np.arange(320)
        assert set(at[replays.covered(at, begins, ends)]) == taken


def test_short_ranges_share_tasks():
    short = follow.spans(follow.Found("k", "p", 1000 * 65536, "", 0.0), 0, 65536)
    parts = follow.dealt(short)
    assert [s for part in parts for s in part.spans] == short and len(parts) <= 2 * follow.TASKS
    long = follow.spans(follow.Found("k", "p", 10 * follow.OWN, "", 0.0), 0, follow.OWN)
    assert [part.spans for part in follow.dealt(long)] == [[s] for s in long] and follow.dealt([]) == []
