"""BPE encoding and decoding with contiguous rank arrays."""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from array import array
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from seclog.llm.common import Kept, documents, latin_pattern, mapped, texts, tokenizer_path

NONE = PAIR = 1 << 31
#: Words with more symbols are merged with a heap, since scanning for the minimum costs the square of the length.
SHORT = 96
#: Words in each of the two generations that a worker keeps.
KEPT_WORDS = 600_000
#: Leads words that are byte letters already; no text has a lone surrogate.
MAPPED = "\ud800"
_OUTSIDE = re.compile("[^\x00-\xff]")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def merge_short(parts: list[int], ranks: dict[int, int], made: list[int]) -> list[int]:
    """Merge the symbols of one short word: find the least rank, delete that boundary, look up its neighbours anew.

    ``ranks`` goes by left symbol * PAIR + right symbol, ``made`` has the symbol that a rank makes.
    """
    look = ranks.get
    rank = [look(a * PAIR + b, NONE) for a, b in zip(parts, parts[1:], strict=False)]
    while rank:
        least = min(rank)
        if least == NONE:
            break
        i = rank.index(least)
        new = parts[i] = made[least]
        del parts[i + 1], rank[i]
        if i:
            rank[i - 1] = look(parts[i - 1] * PAIR + new, NONE)
        if i < len(rank):
            rank[i] = look(new * PAIR + parts[i + 1], NONE)
    return parts


def merge_long(parts: list[int], ranks: dict[int, int], made: list[int]) -> list[int]:
    """The same for a long word: boundaries wait in a heap by rank and place, neighbours are linked."""
    n = len(parts)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n
    queue = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := ranks.get(parts[i] * PAIR + parts[i + 1])) is not None]
    heapq.heapify(queue)
    while queue:
        r, i, a, b = heapq.heappop(queue)
        j = after[i] if alive[i] else n
        if j >= n or parts[i] != a or parts[j] != b:
            continue
        parts[i], alive[j], after[i] = made[r], False, after[j]
        if after[j] < n:
            before[after[j]] = i
        for x, y in ((before[i], i), (i, after[i])):
            if x >= 0 and y < n and (s := ranks.get(parts[x] * PAIR + parts[y])) is not None:
                heapq.heappush(queue, (s, x, parts[x], parts[y]))
    return [p for p, live in zip(parts, alive, strict=True) if live]


class WordBPE:
    """A tokenizer file of kind BPE with word ends: NFC, white space joined, lower case, split by its pattern, bytes."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.tokens: dict[int, str] = {i: t for t, i in self.vocab.items()}
        self.end = model["end_of_word_suffix"] or ""
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.ranks = {self.vocab[a] * PAIR + self.vocab[b]: r for r, (a, b) in enumerate(merges)}
        self.made = [self.vocab[a + b] for a, b in merges]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.tokens |= {i: t for t, i in self.special.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.letters = byte_letters()
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = latin_pattern(split).findall
        own = Tokenizer.from_file(path)
        self._normal, self._pieces = own.normalizer.normalize_str, own.pre_tokenizer.pre_tokenize_str
        self.kept = Kept(self._word, KEPT_WORDS)

    def word_ids(self, letters: str) -> list[int]:
        """Ids of one word, given as byte letters."""
        parts = [self.vocab[c] for c in letters[:-1]]
        parts.append(self.vocab[letters[-1] + self.end])
        return (merge_short if len(parts) <= SHORT else merge_long)(parts, self.ranks, self.made)

    def split(self, text: str) -> list[str]:
        """Words of a text without special tokens.

        Texts of Latin-1 need no normalisation but lower case. Others go through the file's own normaliser and
        splitter, whose Unicode tables count; their words come back as byte letters and are marked.
        """
        if _OUTSIDE.search(text) is None:
            return self.words(text.lower())
        return [MAPPED + w for w, _ in self._pieces(self._normal(text))]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        get = self.kept.__getitem__
        if "<" not in text or not self.cut.search(text):
            return b"".join(map(get, self.split(text)))
        parts = []
        for k, part in enumerate(self.cut.split(text)):
            parts.append(array("I", [self.special[part]]).tobytes() if k % 2 else b"".join(map(get, self.split(part))))
        return b"".join(parts)

    def _word(self, word: str) -> bytes:
        letters = word[1:] if word[0] == MAPPED else "".join(map(self.letters.__getitem__, word.encode("utf-8", "replace")))
        return array("I", self.word_ids(letters)).tobytes()

    def decode(self, ids: bytes) -> str:
        """Without a decoder in the file, the tokens joined by spaces, special ones too."""
        return " ".join(map(self.tokens.__getitem__, memoryview(ids).cast("I")))


@cache
def word_bpe(name: str) -> WordBPE:
    """The tokenizer of a worker process, read once."""
    return WordBPE(tokenizer_path(name))


def encoded(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", with_ids: bool = False) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_tokens, ids_sha256, decoded_sha256, and ``ids`` if asked for.

    The ids are those of the tokenizer file without special tokens added (their strings in a text do count); the
    decoded text is made from the ids. Null text counts as empty: no ids, digests of nothing. A null doc_id stays
    null, repeated rows each give a row, other columns are not read, no rows give no rows. No shuffle.
    """
    key = docs.schema["doc_id"].dataType.simpleString()

    def rows(batch: pa.RecordBatch) -> dict:
        bpe = word_bpe(tokenizer)
        ids = [bpe.encode(t) for t in texts(batch)]
        return {
            "doc_id": batch.column("doc_id"),
            "n_tokens": [len(x) // 4 for x in ids],
            "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids],
            "decoded_sha256": [hashlib.sha256(bpe.decode(x).encode()).hexdigest() for x in ids],
            "ids": ids,
        }

    schema = f"doc_id {key}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids
    return mapped(docs.select("doc_id", "text"), rows, schema)


def op3_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(documents(spark, sf_dir))
