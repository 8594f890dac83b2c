"""Token counts that follow edits: pre-token segment trees per document, re-encoded only where an edit reaches."""

from __future__ import annotations

import math
import re
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from seclog.llm.common import Kept, documents, latin_pattern, mapped, texts, tokenizer_path
from seclog.sources.staging import staged

#: Pre-tokens in a run.
LEAF = 32
KEPT_PIECES = 300_000


@cache
def _encoding(name: str):
    import base64

    import public_tokenizers
    import tiktoken

    with open(tokenizer_path(name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), public_tokenizers.PATTERN


class PieceCounter(Kept):
    """Pre-token to its number of tokens, each different one encoded once; and the pattern that cuts pre-tokens."""

    def __init__(self, tokenizer: str) -> None:
        super().__init__(lambda piece: len(self.own.encode_ordinary(piece)), KEPT_PIECES)
        self.own, pattern = _encoding(tokenizer)
        self.full = regex.compile(pattern)
        self.latin = latin_pattern(pattern)

    def pattern(self, text: str):
        try:
            text.encode("latin-1")
            return self.latin
        except UnicodeEncodeError:
            return self.full


@cache
def piece_counter(tokenizer: str) -> PieceCounter:
    return PieceCounter(tokenizer)


def _dealt(values: list, size: int) -> list[list]:
    """Runs of ``size`` values at most, none much shorter than the others."""
    n = -(-len(values) // size)
    cuts = [len(values) * i // n for i in range(n + 1)] if n else []
    return [values[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def cut_runs(text: str, counter: PieceCounter) -> tuple[list[int], list[int]]:
    """Characters and tokens of each run of a text."""
    pieces = counter.pattern(text).findall(text)
    if not pieces:
        return [], []
    at = np.arange(0, len(pieces), LEAF)
    lengths, counts = (np.fromiter(map(f, pieces), np.int64, len(pieces)) for f in (len, counter.__getitem__))
    return np.add.reduceat(lengths, at).tolist(), np.add.reduceat(counts, at).tolist()


class TokenTree:
    """Counts of one document: runs of pre-tokens lie in leaves, inner nodes hold sums of characters and of tokens.

    A leaf starts with one run. Edits deal what they encode anew into runs of ``LEAF`` pre-tokens, so that a later
    edit beside them encodes a few runs only; a leaf that comes to hold many runs has all runs dealt to leaves anew,
    which encodes nothing. The runs' texts are kept beside the sums, so an edit moves no other text.
    """

    def __init__(self, text: str, counter: PieceCounter) -> None:
        self._load(text, *cut_runs(text, counter), counter)

    @classmethod
    def stored(cls, text: str, chars: list[int], tokens: list[int], counter: PieceCounter) -> TokenTree:
        """A tree from its text and the characters and tokens of its runs, as ``runs`` gives them; encodes nothing."""
        tree = cls.__new__(cls)
        tree._load(text, chars, tokens, counter)
        return tree

    def _load(self, text: str, chars: list[int], tokens: list[int], counter: PieceCounter) -> None:
        self.counter, self.encoded = counter, 0
        ends = np.cumsum(chars, dtype=np.int64).tolist()
        self._deal([(text[a:b], n) for a, b, n in zip([0, *ends], ends, tokens, strict=False)])

    def _deal(self, runs: list[tuple[str, int]]) -> None:
        """One run a leaf, and all sums anew."""
        self.leaves = [[r] for r in runs] or [[]]
        self.most = max(16, math.isqrt(len(runs)))
        self.base = 1 << (len(self.leaves) - 1).bit_length()
        self.chars, self.tokens = np.zeros(2 * self.base, np.int64), np.zeros(2 * self.base, np.int64)
        for sums, values in ((self.chars, [len(t) for t, _ in runs]), (self.tokens, [n for _, n in runs])):
            sums[self.base : self.base + len(runs)] = values
            width = self.base
            while width > 1:
                sums[width // 2 : width] = sums[width : 2 * width].reshape(-1, 2).sum(axis=1)
                width //= 2

    @property
    def n_tokens(self) -> int:
        return int(self.tokens[1])

    @property
    def n_chars(self) -> int:
        return int(self.chars[1])

    def text(self) -> str:
        return "".join(t for leaf in self.leaves for t, _ in leaf)

    def runs(self) -> tuple[list[int], list[int]]:
        """Characters and tokens of each run in the order of the text."""
        return [len(t) for leaf in self.leaves for t, _ in leaf], [n for leaf in self.leaves for _, n in leaf]

    def find(self, place: int) -> tuple[tuple[int, int], int]:
        """Leaf and run that hold character ``place`` and the characters before the run; the last run beyond the end."""
        node, before = 1, 0
        while node < self.base:
            node *= 2
            if place - before >= self.chars[node] and self.chars[node + 1]:
                before += int(self.chars[node])
                node += 1
        leaf, run = self.leaves[node - self.base], 0
        while run < len(leaf) - 1 and place - before >= len(leaf[run][0]):
            before += len(leaf[run][0])
            run += 1
        return (node - self.base, run), before

    def _beside(self, at: tuple[int, int], step: int) -> tuple[int, int] | None:
        """The next run in a direction."""
        leaf, run = at
        if 0 <= run + step < len(self.leaves[leaf]):
            return leaf, run + step
        node = self.base + leaf
        while node > 1:
            if node % 2 == (step < 0) and self.chars[node ^ 1]:
                node ^= 1
                while node < self.base:
                    node = 2 * node + (step < 0)
                    if not self.chars[node]:
                        node ^= 1
                leaf = node - self.base
                return leaf, (0 if step > 0 else len(self.leaves[leaf]) - 1)
            node //= 2
        return None

    def _text(self, at: tuple[int, int] | None) -> str:
        if at is None or not self.leaves[at[0]]:
            return ""
        return self.leaves[at[0]][at[1]][0]

    def _replace(self, region: list[tuple[int, int]], runs: list[tuple[str, int]]) -> None:
        """Put ``runs`` in place of those of ``region``, which follow each other, dealt over the same leaves."""
        touched = list(dict.fromkeys(leaf for leaf, _ in region))
        head, tail = self.leaves[touched[0]][: region[0][1]], self.leaves[touched[-1]][region[-1][1] + 1 :]
        parts = _dealt(runs, max(1, -(-len(runs) // len(touched))))
        parts += [[] for _ in range(len(touched) - len(parts))]
        parts[0] = head + parts[0]
        parts[-1] = parts[-1] + tail
        for leaf, part in zip(touched, parts, strict=True):
            self.leaves[leaf] = part
            node = self.base + leaf
            chars, tokens = sum(len(t) for t, _ in part) - int(self.chars[node]), sum(n for _, n in part) - int(self.tokens[node])
            while node:
                self.chars[node] += chars
                self.tokens[node] += tokens
                node //= 2
        if max(map(len, parts)) > self.most:
            self._deal([r for leaf in self.leaves for r in leaf])

    def edit(self, start: int, stop: int, new: str) -> None:
        """Replace characters ``start`` to ``stop`` by ``new``.

        Cutting at a place looks at no text before it and at one pre-token beyond its end at most, so it begins
        anew one run before the edit, and ends at the first later border of runs that is a border of
        pre-tokens again: from there on both texts are cut alike.
        """
        start, stop = max(0, min(start, self.n_chars)), max(0, min(stop, self.n_chars))
        stop = max(start, stop)
        first, before = self.find(max(0, start - 1))
        for _ in range(2):
            if (at := self._beside(first, -1)) is not None:
                first, before = at, before - len(self._text(at))
        last, _ = self.find(max(start, stop - 1))
        region = [first]
        while region[-1] < last:
            region.append(self._beside(region[-1], 1))
        old = "".join(map(self._text, region))
        text = old[: start - before] + new + old[stop - before :]
        while True:
            after = self._beside(region[-1], 1)
            tail = self._text(after)
            beyond = None if after is None else self._beside(after, 1)
            look = text + tail + self._text(beyond)
            pieces, place = [], 0
            for m in self.counter.pattern(look).finditer(look):
                if place >= len(text):
                    break
                pieces.append(m[0])
                place = m.end()
            if place == len(text) or after is None:
                break
            text = text + tail
            region.append(after)
        self.encoded += len(text)
        runs = [("".join(run), sum(map(self.counter.__getitem__, run))) for run in _dealt(pieces, LEAF)]
        self._replace(region, runs)


EDITS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType()), T.StructField("new", T.StringType())]))


#: What a row of a tree table has besides its text: characters and tokens of each run. The sums follow from them.
RUNS = [T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("run_chars", "run_tokens")]


def token_trees(docs: DataFrame, tokenizer: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """The tree table: (doc_id, text, run_chars, run_tokens) per row of ``docs``, for ``count_after_edits``.

    Null text counts as empty and has no runs; repeated rows each give a row. No shuffle.
    """

    def rows(batch: pa.RecordBatch) -> dict:
        counter = piece_counter(tokenizer)
        found = [cut_runs(t, counter) for t in texts(batch)]
        columns = dict(zip(("run_chars", "run_tokens"), zip(*found, strict=True), strict=True))
        return {c: batch.column(c) for c in ("doc_id", "text")} | columns

    return mapped(docs.select("doc_id", "text"), rows, T.StructType([*docs.select("doc_id", "text").schema, *RUNS]))


def count_after_edits(docs: DataFrame, tokenizer: str = "byte_bpe_50k.tiktoken", with_text: bool = False, with_tree: bool = False) -> DataFrame:
    """Counts before and after the edits of each row of ``docs`` (doc_id, text, edits).

    Rows with ``run_chars`` and ``run_tokens`` of ``token_trees``, by the same tokenizer, are taken as stored trees, of
    which only what edits touch is encoded; without these columns trees are built first. ``edits`` is an array of
    (start, stop, new), character places in the text as it was; they are applied from the last to the first. Edits
    must not overlap; places beyond the text count as its end, nulls in an edit as 0 or the empty text, null
    ``edits`` as none, a null text as empty. Gives doc_id, n_tokens (before), n_edits, n_tokens_after,
    n_chars_after, n_chars_encoded (what the edits made it encode anew), and if asked for ``text_after`` and with
    it the updated ``run_chars`` and ``run_tokens``. Repeated rows each give a row; other columns are not read; no
    rows give no rows. No shuffle.
    """
    key = docs.schema["doc_id"].dataType.simpleString()
    runs = [f.name for f in RUNS if f.name in docs.columns]

    def rows(batch: pa.RecordBatch) -> dict:
        counter = piece_counter(tokenizer)
        out = []
        of = [batch.column(c).to_pylist() for c in runs]
        for i, (text, edits) in enumerate(zip(texts(batch), batch.column("edits").to_pylist(), strict=True)):
            tree = TokenTree.stored(text, of[0][i], of[1][i], counter) if len(of) == len(RUNS) else TokenTree(text, counter)
            n, edits = tree.n_tokens, sorted((e or {} for e in edits or []), key=lambda e: e.get("start") or 0, reverse=True)
            for e in edits:
                tree.edit(e.get("start") or 0, e.get("stop") or 0, e.get("new") or "")
            more = (tree.text() if with_text or with_tree else "", *(tree.runs() if with_tree else ((), ())))
            out.append((n, len(edits), tree.n_tokens, tree.n_chars, tree.encoded, *more))
        names = ("n_tokens", "n_edits", "n_tokens_after", "n_chars_after", "n_chars_encoded", "text_after", "run_chars", "run_tokens")
        return {"doc_id": batch.column("doc_id")} | dict(zip(names, zip(*out, strict=True), strict=True))

    schema = f"doc_id {key}, n_tokens long, n_edits long, n_tokens_after long, n_chars_after long, n_chars_encoded long"
    schema += ", text_after string" * (with_text or with_tree) + ", run_chars array<int>, run_tokens array<int>" * with_tree
    return mapped(docs.select("doc_id", "text", "edits", *runs), rows, schema)


def edited_trees(trees: DataFrame, tokenizer: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """The tree table after the edits of each row of ``trees`` (doc_id, text, run_chars, run_tokens, edits)."""
    after = count_after_edits(trees, tokenizer, with_tree=True)
    return after.select("doc_id", after["text_after"].alias("text"), "run_chars", "run_tokens")


_NUMBER = re.compile(r"\d{6,}")
_MAIL = re.compile(r"[\w.+-]+@[\w-]+\.[\w.]+")


def masking_edits(docs: DataFrame) -> DataFrame:
    """(doc_id, text, edits): e-mail addresses become <email>, runs of six digits or more <number>, repeated lines go.

    A repeated line is one with a word that equals an earlier line; it goes with the line break before it. The runs of a
    tree table pass through.
    """
    runs = [f for f in RUNS if f.name in docs.columns]

    def edits(text: str) -> list[dict]:
        found, place, seen = [], 0, set()
        for line in text.split("\n"):
            if line in seen:
                found.append({"start": place - 1, "stop": place + len(line), "new": ""})
            elif line.strip():
                seen.add(line)
                end = place + len(line)
                if "@" in line:
                    found += [{"start": place + m.start(), "stop": place + m.end(), "new": "<email>"} for m in _MAIL.finditer(line)]
                taken = [(e["start"], e["stop"]) for e in found if e["stop"] > place]
                for m in _NUMBER.finditer(text, place, end):
                    if not any(a < m.end() and m.start() < b for a, b in taken):
                        found.append({"start": m.start(), "stop": m.end(), "new": "<number>"})
            place += len(line) + 1
        return found

    def rows(batch: pa.RecordBatch) -> dict:
        whole = batch.column("text")
        kept = {f.name: batch.column(f.name) for f in runs}
        return {"doc_id": batch.column("doc_id"), "text": whole, "edits": [edits(t or "") for t in whole.to_pylist()]} | kept

    given = docs.select("doc_id", "text", *[f.name for f in runs])
    return mapped(given, rows, T.StructType([*given.schema, T.StructField("edits", EDITS)]))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents before and after personal data is masked and repeated lines are removed.

    The trees are written as a table first, and the edits read it.
    """
    return count_after_edits(masking_edits(staged(token_trees(documents(spark, sf_dir)), "token_trees")))
