"""Corpus operators against plain, slow versions of what they compute."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from seclog.llm import archive, bpe, components, exact, mixing, quality, simhash, token_counts, token_files, toxicity
from seclog.sources.staging import staged
from tests.llm.helpers import SF, awkward, docs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokenizer(name):
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(name))


def sha(b):
    return hashlib.sha256(b).hexdigest()


def test_token_files_hold_what_the_library_encodes(spark):
    own = tokenizer("byte_bpe_50k.json")
    rows = [*{r[0]: r for r in awkward() if r[0] != 111}.values(), (500, "a<|endoftext|>b")]
    at, want = 0, []
    for doc_id, text, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*own.encode(text or "", add_special_tokens=False).ids, 0]
        want.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = token_files.token_files(docs(spark, rows)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert token_files.token_files(docs(spark, []).limit(0)).collect() == []


def test_token_files_of_one_doc_id_and_of_other_tokenizers(spark):
    rows = [(7, f"text {i % 90} of one id") for i in range(300)] + [(None, "none"), (8, None)]
    got = sorted(token_files.token_files(docs(spark, rows)).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None] + [7] * 300 + [8] and [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got[:-1])]).tolist()
    own = tokenizer("word_bpe_49k.json")
    rows = [*{r[0]: r for r in awkward()}.values()]
    index = token_files.write_token_files(docs(spark, rows), token_files.new_folder(spark, "tokens"), "word_bpe_49k.json", end=70_000, length=64)
    got = {r.doc_id: r for r in token_files.read_token_files(index).collect()}
    for doc_id, text, *_ in rows:
        ids = np.array([*own.encode(text or "", add_special_tokens=False).ids, 70_000], "<u4")
        assert (got[doc_id].n_tokens, got[doc_id].ids_crc32) == (len(ids), zlib.crc32(ids.tobytes()))


def test_pieces_are_kept_in_two_generations(monkeypatch):
    monkeypatch.setattr(token_files, "KEPT_PIECES", 40)
    own, encoder = tokenizer("byte_bpe_50k.json"), token_files.ByteEncoder(token_files.tokenizer_path("byte_bpe_50k.json"))
    texts = [f"the word{i} and the one before, word{i - 1}; café's 12{i}" for i in range(200)]
    assert [np.frombuffer(encoder.encode(t), np.uint16).tolist() for t in texts] == [own.encode(t, add_special_tokens=False).ids for t in texts]
    assert " the" in encoder.kept and len(encoder.kept) <= 40 and len(encoder.kept.old) == 40


def test_sequences_have_equal_length_and_masks(tmp_path):
    path = (tmp_path / "f.arrow").as_uri()
    out = token_files.SequenceWriter(path, length=8, batch=4, width=2)
    ids = np.arange(100)
    for part in np.array_split(ids, 7):
        out.append(part)
    out.close()
    read = token_files.SequenceReader(path)
    assert read.ids(0, 100).tolist() == ids.tolist() and read.ids(30, 5).tolist() == [30, 31, 32, 33, 34]
    seq, mask = read.sequence(12)
    assert seq.to_pylist() == [96, 97, 98, 99, 0, 0, 0, 0] and mask.to_pylist() == [True] * 4 + [False] * 4


def quality_base(text):
    text = text or ""
    words = WORD.findall(text)
    n = len(words)
    windows = [tuple(words[i : i + 8]) for i in range(n - 7)]
    count, cover = Counter(windows), set()
    for i, w in enumerate(windows):
        if count[w] > 1:
            cover |= set(range(i, i + 8))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(cover), n < 20 or 100 * len(cover) > 30 * n


def test_quality_statistics(spark):
    repeated = "one two three four five six seven eight nine " * 5
    rows = [*awkward(), (200, repeated), (201, "a\na\n\nb\na ### $$$ <x>|y")]
    got = Counter(tuple(r)[:6] + (r.base_failed,) for r in quality.line_quality(docs(spark, rows)).collect())
    assert got == Counter((r[0], *quality_base(r[1])) for r in rows)


@pytest.mark.parametrize(
    ("line", "fault"),
    [
        ("Home | About | News | Contact | Search | Login", "navigation"),
        ("BUY!! NOW!! THIS!! IS!! GREAT!!", "punctuation"),
        ("go *** here $$$ and &&& there ###", "punctuation"),
        ("Please enable JavaScript to view this page.", "boilerplate"),
        ("of of of of of of of", "boilerplate"),
        ("A plain sentence, with a number 12 and a question?", None),
        ("Licensed under CC BY-NC 4.0.", None),
    ],
)
def test_line_rules(line, fault):
    assert quality.line_fault(line, line.split(), quality.Rules()) == fault


def test_cleaning_removes_failing_lines_and_rejects_documents_that_lose_too_much(spark):
    good = "\n".join(f"This sentence {i} has plain words and then {i} more." for i in range(8))
    nav = "Home | About | News | Contact"
    rows = [(1, good), (2, good + "\n" + nav), (3, "\n".join([nav] * 9) + "\n" + good[:150]), (4, None)]
    got = {r.doc_id: r for r in quality.clean_documents(docs(spark, rows)).collect()}
    assert set(got) == {1, 2} and got[1].text == got[2].text == good and got[2].n_chars == len(good) and got[1].copies == 9


@pytest.mark.parametrize("phrase", quality.BOILERPLATE)
def test_a_boilerplate_phrase_fails_short_lines_and_no_long_ones(spark, phrase):
    prose = " ".join(f"This sentence {i} has plain words and then {i} more." for i in range(60))
    spaceless = "中文" * 200
    rows = [(1, f"{prose} It names the {phrase.title()} once."), (2, f"{prose}\n{phrase.capitalize()}."), (3, f"{prose}\n{spaceless} {phrase} {spaceless}")]
    got = {r.doc_id: r.text for r in quality.clean_documents(docs(spark, rows)).collect()}
    assert got == {1: rows[0][1], 2: prose, 3: rows[2][1]}
    stats = {r.doc_id: (r.kept, r.n_fault_lines) for r in quality.line_quality(docs(spark, rows)).collect()}
    assert stats == {1: (True, 0), 2: (True, 1), 3: (True, 0)}


def test_word_bpe_is_the_library_s(spark):
    own = tokenizer("word_bpe_49k.json")
    rows = [*awkward(), (300, "İ ﬁ Σς <|endoftext|>x<|startoftext|> <|EndOfText|> 's'RE"), (301, "ab" * 300)]
    want = Counter()
    for doc_id, text, *_ in rows:
        ids = own.encode(text or "", add_special_tokens=False).ids
        want[doc_id, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(own.decode(ids, skip_special_tokens=False).encode())] += 1
    assert Counter(map(tuple, bpe.encoded(docs(spark, rows)).collect())) == want


def test_long_words_merge_like_short_ones():
    rng = np.random.default_rng(3)
    ranks = {a * bpe.PAIR + b: i for i, (a, b) in enumerate([(1, 2), (2, 1), (3, 3), (4, 5), (1, 1), (6, 4), (2, 2)])}
    made = [3, 4, 5, 6, 7, 8, 1]
    for _ in range(300):
        parts = rng.integers(1, 4, rng.integers(1, 40)).tolist()
        assert bpe.merge_short(list(parts), ranks, made) == bpe.merge_long(list(parts), ranks, made)


def slow_fingerprint(text):
    words = [w.translate({c: c + 32 for c in range(65, 91)}) for w in WORD.findall(text or "")]
    k = min(4, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]).encode(), 42) for i in range(len(words) - k + 1)] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_of(nodes, linked):
    left, out = list(nodes), []
    while left:
        group = [left.pop()]
        for x in group:
            near = [y for y in left if linked(x, y)]
            left = [y for y in left if not linked(x, y)]
            group += near
        out.append(group)
    return out


def near_want(rows):
    fps = [(r[0], slow_fingerprint(r[1])) for r in rows]
    want = Counter()
    for group in components_of({f for _, f in fps}, lambda a, b: (a ^ b).bit_count() <= 4):
        ids = [i for i, f in fps if f in group]
        least = min((i for i in ids if i is not None), default=None)
        want += Counter((i, f"{f:016x}", least) for i, f in fps if f in group)
    return want


def test_near_copies(spark):
    base = awkward()[20][1] + " " + awkward()[21][1] + " " + " ".join(map(str, range(300)))
    rows = awkward() + [(400 + i, base.replace(str(100 + i), "w", 1)) for i in range(12)] + [(450, None)]
    assert Counter(map(tuple, simhash.near_copies(docs(spark, rows)).collect())) == near_want(rows)
    assert simhash.near_copies(docs(spark, []).limit(0)).collect() == []


def test_one_row_of_each_near_component_stays(spark):
    rng = np.random.default_rng(4)
    text = lambda: " ".join(f"w{x}" for x in rng.integers(0, 9999, 400))
    a, b, c, d, e, alone, other = (text() for _ in range(7))
    rows = [(5, a), (3, a + " end"), (5, alone), (1, b), (1, b + " end"), (None, c), (None, c + " end"), (2, d), (2, d), (None, e), (8, e + " end"), (None, other), (9, None), (9, "")]
    fps = [slow_fingerprint(t) for _, t in rows]
    assert all((fps[i] ^ fps[i + 1]).bit_count() <= 4 for i in (0, 3, 5, 9))
    left = simhash.without_near_copies(docs(spark, rows)).collect()
    got = Counter((r.doc_id, (r.text or "").removesuffix(" end")) for r in left)
    assert got == Counter([(3, a), (5, alone), (1, b), (None, c), (2, d), (8, e), (None, other), (9, "")])
    assert all(r.copies == 9 for r in left) and any(r.text == a + " end" for r in left)


@pytest.mark.parametrize("block", [16, 4096])
def test_links_connect_what_all_pairs_connect(spark, block):
    rng = np.random.default_rng(5)
    seeds = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
    fps = set(seeds.tolist())
    for s in seeds[:10].tolist():  # crowds around one fingerprint, and chains
        fps |= {s ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 64, (25, 2))}
        for a in rng.integers(0, 64, 12):
            s ^= (1 << int(a)) | (1 << int((a + 7) % 64))
            fps.add(s)
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    nodes = spark.createDataFrame(signed, "fp long")
    links = simhash.links(nodes, 4, block)
    assert all(((a ^ b) & ((1 << 64) - 1)).bit_count() <= 4 for a, b in links.collect())
    found = defaultdict(set)
    for node, root in components.roots(links).collect():
        found[root].add(node)
    want = [frozenset(x - (1 << 64) if x >> 63 else x for x in g) for g in components_of(fps, lambda a, b: (a ^ b).bit_count() <= 4)]
    assert {frozenset(g) for g in found.values()} == {g for g in want if len(g) > 1}


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 200)] + [(500, 501), (7, 7)], "a long, b long")
    assert {tuple(r) for r in components.roots(edges).collect()} == {(i, 0) for i in range(201)} | {(500, 500), (501, 500)}


def exact_want(rows):
    groups = defaultdict(list)
    for doc_id, text, *_ in rows:
        groups[text or ""].append(doc_id)
    want = Counter()
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        kept = 0
        for i in sorted(ids, key=lambda i: i != keep):
            want[i, keep, len(ids), i == keep and not kept, sha(text.encode())] += 1
            kept |= i == keep
    return want


def test_exact_copies(spark):
    rows = awkward() + [(600, "a" * 10000), (601, "a" * 10000), (602, "a" * 10001), (603, None), (604, "")]
    table = docs(spark, rows)
    assert Counter(map(tuple, exact.exact_copies(table).collect())) == exact_want(rows)
    left = exact.without_copies(table).collect()
    assert sorted(r.text or "" for r in left) == sorted({r[1] or "" for r in rows}) and left[0].copies == 9
    assert exact.exact_copies(docs(spark, []).limit(0)).collect() == []


def test_chunks_are_the_text(spark):
    rows = [r for r in awkward() if r[1]]
    table = docs(spark, rows).select("text", exact.chunks(F.col("text")).alias("c"))
    assert all("".join(r.c).encode("latin-1") == r.text.encode() and len(r.c) for r in table.collect())


def test_chunks_are_shared_behind_a_word_put_in_front(spark):
    rng = np.random.default_rng(6)
    chinese = "".join(map(chr, rng.integers(0x4E00, 0x9FA5, 18_000)))
    plain = " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "word", "thing"], 4000))
    rows = [(i, t) for i, text in enumerate((chinese, plain)) for t in (text, "first " + text)]
    cut = [r.c for r in docs(spark, rows).repartition(1).orderBy("doc_id", F.length("text")).select(exact.chunks(F.col("text")).alias("c")).collect()]
    for one, two in (cut[:2], cut[2:]):
        assert len(one) > 50 and len(set(one) & set(two)) >= 0.95 * len(one)


def test_archive_round_trip(spark):
    rows = [(1, "u", "<p>é</p>"), (2, "u\r\nX: y", "<p>é</p>"), (3, None, None), (4, "u", ""), (None, "u", "z"), (5, "u", "z"), (6, "u", "q" * 9000)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, payload int")
    folder = token_files.new_folder(spark, "test-archive")
    got = {tuple(r) for r in archive.web_archive(pages, folder).collect()}
    last = {}
    for i, _, html in rows:
        last[html or ""] = max(last.get(html or "", -1), i if i is not None else -1)
    want = set()
    for i, _, html in rows:
        raw = (html or "").encode()
        first = i == last[html or ""]
        want.add((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if first else "revisit", None if first else last[html or ""]))
    assert got == want
    assert spark.read.parquet(folder + "/payloads").count() == 4
    for r in archive.record_bytes(archive.read_archive(spark, folder)).collect():
        head, _, body = bytes(r.record).partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.1\r\n") and int(re.search(rb"Content-Length: (\d+)", head)[1]) == len(body) - 4
    assert archive.web_archive(pages.limit(0)).collect() == []


def test_counts_after_edits_are_those_of_the_edited_text(spark):
    own = token_counts.piece_counter("byte_bpe_50k.tiktoken").own
    rows = awkward() + [(700, "call 1234567890 or a.b@c.de\n" * 60 + "tail"), (701, "same\nsame\nsame 99999999")]
    got = token_counts.count_after_edits(token_counts.masking_edits(docs(spark, rows)), with_text=True).collect()
    text = {r[0]: r[1] or "" for r in rows if r[0] is not None}
    for r in got:
        assert r.n_tokens_after == len(own.encode_ordinary(r.text_after)) and r.n_chars_after == len(r.text_after)
        assert r.doc_id is None or r.n_tokens == len(own.encode_ordinary(text[r.doc_id]))
    after = {r.doc_id: r.text_after for r in got}
    assert after[701] == "same\nsame <number>" and after[700].count("<email>") == 1 and len(got) == len(rows)


def test_stored_trees_take_several_rounds_of_edits(spark):
    own = token_counts.piece_counter("byte_bpe_50k.tiktoken").own
    rows = [r for r in awkward() if r[0] not in (None, 111)] + [(700, "call 1234567890 or a.b@c.de\n" * 60 + "tail")]
    trees = token_counts.token_trees(docs(spark, rows))
    for new in ("a 99999999 b", "", "Ω"):
        edits = F.expr(f"array(named_struct('start', 20, 'stop', 25, 'new', '{new}'), named_struct('start', 900, 'stop', 901, 'new', 'z'))")
        before = staged(trees.withColumn("edits", edits))
        trees = staged(token_counts.edited_trees(before))
        text = {r.doc_id: r.text or "" for r in before.collect()}
        for r in token_counts.count_after_edits(before, with_tree=True).collect():
            want = text[r.doc_id][:900] + "z" + text[r.doc_id][901:]
            want = want[:20] + new + want[25:]
            assert r.text_after == want and r.n_tokens == len(own.encode_ordinary(text[r.doc_id])) and r.n_chars_encoded < 20000
            assert r.n_tokens_after == sum(r.run_tokens) == len(own.encode_ordinary(want)) and sum(r.run_chars) == len(want)
    # What is stored is what is read: nothing is counted anew.
    odd = trees.withColumn("run_tokens", F.expr("transform(run_tokens, n -> n + 1)")).withColumn("edits", F.lit(None).cast(before.schema["edits"].dataType))
    read = {r.doc_id: r.n_tokens for r in token_counts.count_after_edits(odd).collect()}
    assert read == {r.doc_id: sum(r.run_tokens) + len(r.run_tokens) for r in trees.collect()}
    masked = token_counts.count_after_edits(token_counts.masking_edits(token_counts.token_trees(docs(spark, rows)))).collect()
    assert Counter(masked) == Counter(token_counts.count_after_edits(token_counts.masking_edits(docs(spark, rows))).collect())


def test_edits_reencode_little():
    tree = token_counts.TokenTree("some plain words here " * 20000, token_counts.piece_counter("byte_bpe_50k.tiktoken"))
    tree.edit(200000, 200005, "other")
    assert tree.encoded < 2000


@pytest.mark.parametrize(("line", "old", "new"), [("a row with some plain words and number 1234567 in it\n", "1234567", "<number>"), (" 1234567", "1234567", "<number>"), ("x@y.org 1234567\n", "1234567", "several more words than there were before " * 5)])
def test_dense_edits_encode_in_proportion(line, old, new):
    counter, spent = token_counts.piece_counter("byte_bpe_50k.tiktoken"), []
    for n in (400, 3200):
        tree = token_counts.TokenTree(line * n, counter)
        for i in reversed(range(n)):
            at = i * len(line) + line.index(old)
            tree.edit(at, at + len(old), new)
        text = (line * n).replace(old, new)
        assert tree.text() == text and tree.n_tokens == len(counter.own.encode_ordinary(text)) and sum(tree.runs()[0]) == len(text)
        spent.append(tree.encoded)
    assert spent[1] < 9 * spent[0]


def test_random_edits(spark):
    counter = token_counts.piece_counter("byte_bpe_50k.tiktoken")
    rng = np.random.default_rng(9)
    letters = [*"  \n\t'sretmld.,!aé1²\xa0Ω中\x85", "'re", "'ll", "   ", " the"]
    for _ in range(150):
        text = "".join(rng.choice(letters, rng.integers(0, 300)))
        tree = token_counts.TokenTree(text, counter)
        for _ in range(5):
            a, n = int(rng.integers(0, len(text) + 1)), int(rng.integers(0, 30))
            new = "".join(rng.choice(letters, rng.integers(0, 6)))
            tree.edit(a, a + n, new)
            text = text[:a] + new + text[a + n :]
            assert tree.text() == text and tree.n_tokens == len(counter.own.encode_ordinary(text))


def test_pivot_keeps_the_sum_and_rounds():
    rng = np.random.default_rng(2)
    means = np.zeros(40)
    size = rng.integers(1, 50, 40)
    p = rng.uniform(0.05, 0.95, 40)
    for _ in range(3000):
        done, open_ = mixing.pivot(size, p, rng.uniform(size=40))
        assert abs((done * size).sum() - (p * size).sum()) < 1e-6
        assert all(x in (0, 1) for i, x in enumerate(done) if i != open_)
        means += done
    assert np.abs(means / 3000 - p).max() < 0.05


@pytest.mark.parametrize("block", [4096, 8])
def test_mix_comes_near_its_targets(spark, block, monkeypatch):
    monkeypatch.setattr(mixing.copies, "__defaults__", (7, block, 3))
    rows = [(i, "w " * (i % 37 + 1), f"s{i % 5 % 3}" if i % 11 else None) for i in range(700)]
    table = docs(spark, rows)
    got = mixing.mixed(table).collect()
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len(text.split())
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    target, open_, rest = {}, set(sizes), sum(sizes.values())
    while True:
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            break
        for s in over:
            target[s] = 3 * sizes[s]
            rest -= target[s]
        open_ -= over
    target |= share
    taken = Counter()
    for r in got:
        taken[r.source] += r.taken
        assert r.taken in range(0, 3 * r.size + 1, max(1, r.size)) and abs(r.target - target[r.source]) < 1e-6 and r.source_size == sizes[r.source]
    assert all(abs(taken[s] - target[s]) <= 37 for s in sizes) and len(got) == 700
    assert Counter(map(tuple, got)) == Counter(map(tuple, mixing.mixed(table.repartition(7)).collect()))
    out = Counter(r.doc_id for r in mixing.mix_documents(table).collect())
    assert out == Counter({r.doc_id: r.copies for r in got if r.copies})


def test_mix_takes_awkward_rows(spark):
    got = mixing.mixed(docs(spark, awkward())).collect()
    assert len(got) == len(awkward()) and all(r.taken <= 3 * r.size for r in got)
    assert mixing.mixed(docs(spark, []).limit(0)).collect() == []
    assert {r.taken for r in mixing.mixed(docs(spark, [(1, None), (2, "")])).collect()} == {0}


def test_toxicity_learns_and_takes_awkward_rows(spark):
    table, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = {r.doc_id: r for r in toxicity.scored(table, labels).collect()}
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    out = [(got[i].score, y) for i, y in truth.items() if got[i].held_out]
    pairs = [(a > b) + 0.5 * (a == b) for a, y in out if y for b, z in out if not z]
    assert sum(pairs) / len(pairs) > 0.75
    assert {i: r.score for i, r in got.items()} == {r.doc_id: r.score for r in toxicity.scored(table.repartition(5), labels).collect()}
    odd = toxicity.scored(docs(spark, awkward()), labels.union(labels.limit(3)).unionByName(spark.createDataFrame([(None, 1, 1), (5, None, None)], labels.schema)))
    assert odd.count() == len(awkward())
    assert {r.predicted for r in toxicity.scored(docs(spark, awkward()), labels.limit(0)).collect()} == {0}
    assert toxicity.scored(docs(spark, []).limit(0), labels).collect() == []


def plain_grams(text):
    """Numbers of the n-grams of 4 to 6 characters of a text, one n-gram at a time."""
    m, step, mask = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03, 2**64 - 1
    whole, found = [ord(c) for c in f" {text.lower()} "], set()
    for n in toxicity.ORDERS:
        for at in range(len(whole) - n + 1):
            code = 0
            for c in whole[at : at + n]:
                code = (code * step + c) & mask
            found.add(((code + (n << 56)) * m & mask) >> (64 - 19))
    return found


def test_toxicity_scores_are_those_of_a_plain_fit(spark):
    rng = np.random.default_rng(9)
    nice, bad = "river stone light garden paper window".split(), "vile scum trash filth".split()
    rows, labels = [], []
    for i in range(160):
        toxic = i % 3 == 0
        words = [*rng.choice(nice, rng.integers(3, 12)), *(rng.choice(bad, 2) if toxic else [])]
        rows.append((i, " ".join(rng.permutation(words))))
        labels.append((i, int(toxic)))
    table = docs(spark, [*rows, (500, None), (501, "garden scum")])
    got = {r.doc_id: r.score for r in toxicity.scored(table, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}

    taught = [(plain_grams(t), labels[i][1]) for i, t in rows if zlib.crc32(str(i).encode()) % 5]
    n1, n0 = sum(y for _, y in taught), sum(1 - y for _, y in taught)
    counts = Counter((g, y) for grams, y in taught for g in grams)
    ratio = {}
    for g in {g for g, _ in counts}:
        a, b = counts[g, 1], counts[g, 0]
        r = math.log((a + 1) / (n1 + 2)) - math.log((b + 1) / (n0 + 2))
        pooled = (a + b + 1) / (n1 + n0 + 2)
        if abs(r) > 3.5 * math.sqrt((1 - pooled) / pooled * (1 / n1 + 1 / n0)):
            ratio[g] = r
    names = sorted(ratio)
    x = np.array([[ratio[g] if g in grams else 0.0 for g in names] for grams, _ in taught])
    y = np.array([float(v) for _, v in taught])
    share = n1 / (n1 + n0)
    importance = np.where(y == 1, share / n1, (1 - share) / n0)
    rate = 1 / (0.25 * float((importance * ((x * x).sum(1) + 1)).sum()) + 2e-3)
    w, b = np.zeros(len(names)), math.log(share / (1 - share))
    look_w, look_b, t = w, b, 1.0
    for _ in range(150):  # gradient steps with momentum on the loss, written out
        g = importance * (1 / (1 + np.exp(-(x @ look_w + look_b))) - y)
        new_w, new_b = look_w - rate * (x.T @ g + 2e-3 * look_w), look_b - rate * g.sum()
        t2 = (1 + math.sqrt(1 + 4 * t * t)) / 2
        look_w, look_b = new_w + (t - 1) / t2 * (new_w - w), new_b + (t - 1) / t2 * (new_b - b)
        w, b, t = new_w, new_b, t2
    weight = dict(zip(names, w * np.array([ratio[g] for g in names]), strict=True))
    for i, text in [*rows, (500, ""), (501, "garden scum")]:
        z = b + sum(weight.get(g, 0.0) for g in plain_grams(text))
        assert abs(got[i] - 1 / (1 + math.exp(-z))) < 1e-4, i
    assert got[501] > 0.5 > got[500] and len(names) > 20


def test_pipeline_stages_against_plain_versions(spark):
    import corpus_pipeline

    now = spark.read.parquet(f"{SF}/documents.parquet")
    before = [r.asDict() for r in now.collect()]
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["quality_rules", "exact_dedup", "near_dedup", "mix_sources", "encode"]
    verdict = {d["doc_id"]: quality.judge(d["text"] or "", quality.Rules()) for d in before}
    kept = [d["doc_id"] for d in before if verdict[d["doc_id"]][6]]
    now = steps["quality_rules"](spark, now, SF)
    rows = {r.doc_id: r for r in now.collect()}
    assert sorted(rows) == sorted(kept) and all(rows[i].text == verdict[i][9] for i in kept) and now.columns == list(before[0])
    one = {}
    for i in kept:
        one[rows[i].text] = max(i, one.get(rows[i].text, -1))
    now = steps["exact_dedup"](spark, now, SF)
    assert sorted(r.doc_id for r in now.collect()) == sorted(one.values())
    want = near_want([(i, rows[i].text) for i in one.values()])
    now = steps["near_dedup"](spark, now, SF)
    assert sorted(r.doc_id for r in now.collect()) == sorted(i for i, _, least in want if i == least)
    copies = Counter({r.doc_id: r.copies for r in mixing.mixed(now).collect() if r.copies})
    now = steps["mix_sources"](spark, now, SF)
    assert Counter(r.doc_id for r in now.collect()) == copies and now.columns == list(before[0])
    own = tokenizer("word_bpe_49k.json")
    last = Counter((r.doc_id, r.n_tokens) for r in corpus_pipeline.run(spark, SF).collect())
    assert last == Counter({(i, len(own.encode(rows[i].text, add_special_tokens=False).ids)): n for i, n in copies.items()})
