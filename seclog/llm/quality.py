"""Line-first cleaning: judge every line, remove those that fail, then judge what is left of the document."""

from __future__ import annotations

import re
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seclog.llm.common import documents, mapped, texts

SYMBOLS = "#*$%&|<>"
#: Phrases of page furniture; a line that they make up a share of is no prose.
BOILERPLATE = (
    "all rights reserved", "accept cookies", "cookie policy", "enable javascript", "javascript is disabled",
    "lorem ipsum", "privacy policy", "sign up for our newsletter", "skip to content", "terms of service", "terms of use",
)
_SEPARATORS = ("|", "»", "›", ">", "•", "·", "::")
_FURNITURE = re.compile("|".join(BOILERPLATE))
_NO_LETTER = re.compile(r"[^\w\s]|[\d_]")
_SHOUT = re.compile(r"[!?]{2,}(?=[.,]?(?:\s|$))")
_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
#: White space that str.split() cuts at and the definition of a word does not.
_OTHER_SPACE = re.compile(r"[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


@dataclass(frozen=True)
class Rules:
    """Bounds of the line rules and of the two verdicts on a document."""

    min_words: int = 20
    max_repeat_percent: int = 30
    max_lost_share: float = 0.3
    max_symbols_per_word: float = 0.2
    max_shouts_per_word: float = 0.2
    max_upper_share: float = 0.6
    min_upper_words: int = 5
    min_separators: int = 3
    max_separator_gap: float = 4.0
    max_stutter_share: float = 0.4
    max_boilerplate_share: float = 0.15
    min_letter_share: float = 0.4


def line_fault(line: str, words: list[str], rules: Rules, marks: bool = True, furniture: bool = True) -> str | None:
    """Why a line is no prose: 'punctuation', 'navigation' or 'boilerplate'; None if it may stay.

    ``marks`` and ``furniture`` false: the document is known to have no symbols or separators, or no boilerplate.
    """
    n = len(words)
    if marks:
        if sum(map(line.count, SYMBOLS.replace("|", ""))) > rules.max_symbols_per_word * n:
            return "punctuation"
        cuts = sum(map(words.count, _SEPARATORS))
        if cuts >= rules.min_separators and n - cuts <= rules.max_separator_gap * (cuts + 1):
            return "navigation"
    if n > 1 and ("!" in line or "?" in line) and len(_SHOUT.findall(line)) > rules.max_shouts_per_word * n:
        return "punctuation"
    if n >= rules.min_upper_words and sum(map(str.isupper, words)) > rules.max_upper_share * n:
        return "punctuation"
    if n >= 3 and len(_NO_LETTER.findall(line)) > (1 - rules.min_letter_share) * sum(map(len, words)):
        return "punctuation"
    if furniture and (found := _FURNITURE.findall(line.lower())):
        # By characters of the words, since text without spaces between words is few, long words.
        if sum(len(p) - p.count(" ") for p in found) > rules.max_boilerplate_share * sum(map(len, words)):
            return "boilerplate"
    if n >= 5 and sum(map(eq, words, words[1:])) > rules.max_stutter_share * n:
        return "boilerplate"
    return None


def repeat_words(words: list[bytes], width: int = 8) -> int:
    """Words that lie in windows of ``width`` (a power of two) words found twice or more.

    Windows get exact numbers by doubling: pairs of words, pairs of pairs, and so on.
    """
    n = len(words)
    if n <= width:
        return 0
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    rank = np.fromiter(map(number.__getitem__, words), np.int64, n)
    span = 1
    while True:
        pair = rank[:-span] * (int(rank.max()) + 1) + rank[span:]
        span *= 2
        _, rank, count = np.unique(pair, return_inverse=True, return_counts=True)
        if count.max() == 1:
            return 0
        if span == width:
            break
    again = np.flatnonzero(count[rank] > 1)
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, again, 1)
    np.add.at(cover, again + width, -1)
    return int((np.cumsum(cover)[:n] > 0).sum())


def judge(text: str, rules: Rules) -> tuple:
    """Statistics, both verdicts and the cleaned text of one document."""
    words = text.encode("utf-8", "replace").split()
    n = len(words)
    split = _WORDS.findall if _OTHER_SPACE.search(text) else str.split
    chars = sum(map(len, split(text)))
    symbols = sum(map(text.count, SYMBOLS))
    marks = symbols > 0 or any(map(text.__contains__, _SEPARATORS))
    furniture = any(map(text.lower().__contains__, BOILERPLATE))
    seen: set[str] = set()
    dup = lost = faults = 0
    stay = []
    for line in text.split("\n"):
        own = split(line)
        if own:
            if line in seen:
                dup += 1
            else:
                seen.add(line)
            if line_fault(line, own, rules, marks, furniture):
                faults += 1
                lost += len(own)
                continue
        stay.append(line)
    repeats = repeat_words(words)
    base_failed = n < rules.min_words or 100 * repeats > rules.max_repeat_percent * n
    kept = not base_failed and lost <= rules.max_lost_share * n
    return n, chars, symbols, dup, repeats, base_failed, kept, faults, lost, text if not faults else "\n".join(stay)


STATS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "kept boolean, n_fault_lines long, n_lost_words long"
)


def line_quality(docs: DataFrame, rules: Rules | None = None, with_text: bool = False) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): statistics, verdicts, and ``clean_text`` if asked for.

    A document is dropped (``kept`` false) if the base rule fails (fewer than ``min_words`` words, or more than
    ``max_repeat_percent`` of its words in repeated 8-word windows) or if the lines that fail hold more than
    ``max_lost_share`` of its words. A null text counts as empty: no words, base_failed. A null doc_id stays null;
    repeated rows are judged one by one; other columns are not read; an empty table gives no rows.
    No shuffle: each document is judged where it is read.
    """
    rules = rules or Rules()
    key = docs.schema["doc_id"].dataType.simpleString()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_fault_lines", "n_lost_words"]

    def rows(batch: pa.RecordBatch) -> dict:
        found = [judge(t, rules) for t in texts(batch)]
        columns = dict(zip([*names, "clean_text"], zip(*found, strict=True), strict=True))
        return columns | {"doc_id": batch.column("doc_id")}

    return mapped(docs.select("doc_id", "text"), rows, f"doc_id {key}, {STATS}" + ", clean_text string" * with_text)


def clean_documents(docs: DataFrame, rules: Rules | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, with failing lines removed and ``n_chars``, where present, counted anew.

    All other columns pass through unchanged, whatever their names. A null text has no words and goes; repeated rows
    are judged one by one; no rows give no rows.
    """
    rules = rules or Rules()
    names = docs.columns
    at = names.index("text")
    counted = names.index("n_chars") if "n_chars" in names else None
    by_place = docs.toDF(*[f"_{i}" for i in range(len(names))])  # a name may hold a dot

    def run(batches):
        for batch in batches:
            found = [judge(t, rules) for t in texts(batch, f"_{at}")]
            clean = pa.array([f[9] for f in found], batch.schema.field(at).type)
            batch = batch.set_column(at, batch.schema.field(at), clean)
            if counted is not None:
                field = batch.schema.field(counted)
                batch = batch.set_column(counted, field, pa.array([len(f[9]) for f in found], pa.int64()).cast(field.type))
            yield batch.filter(pa.array([f[6] for f in found], pa.bool_()))

    return by_place.mapInArrow(run, by_place.schema).toDF(*names)


def op2_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality(documents(spark, sf_dir))
