"""Awkward tables that every corpus operator must take."""

import random

DDL = "doc_id long, text string, lang string, source string, n_chars long, size long, kept boolean, target string, fp string, copies long"
SF = "/root/testdata/sf0.001"


def docs(spark, rows):
    """Documents from (doc_id, text) or (doc_id, text, source), with extra columns whose names operators use themselves."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), 1, True, "t", "f", 9) for r in rows]
    return spark.createDataFrame(full, DDL).repartition(3)


def awkward(seed=1):
    rng = random.Random(seed)
    words = "the quick brown fox jumps over lazy dogs while éà ß naïve 中文 Ω don't I'll e.g. 12345678 a@b.org".split()
    text = lambda n: " ".join(rng.choices(words, k=n))
    long_text = "\n".join(text(40) + "." for _ in range(300))
    same = text(60)
    rows = [(i, text(rng.randint(0, 120)), f"s{i % 4}" if i % 9 else None) for i in range(60)]
    rows += [(100, None, None), (101, "", "s1"), (102, " \t\n\x0b ", "s2"), (103, "x" * 5000, "s3"), (104, long_text, "s0"), (105, long_text, "s0")]
    rows += [(110, same, "s1"), (111, same, "s2"), (111, same, "s2"), (112, same, None), (None, same, "s1"), (None, text(30), None), (113, "\x1cone\x85two\xa0three four ", "s1")]
    return rows
