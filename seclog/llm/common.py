"""Small helpers that several corpus operators share."""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Callable, Hashable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words are what ASCII white space separates: bytes.split() on UTF-8 does the same.
WORD = r"[^\x20\x09-\x0D]+"
LOWER_ASCII = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def word_count(text: Column) -> Column:
    """Words of a text as long, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch, null as the empty text."""
    return [x or "" for x in batch.column(column).to_pylist()]


def lower_words(text: str) -> list[bytes]:
    """Words in UTF-8 with A-Z lower-cased; a lone surrogate, which has no UTF-8 form, becomes '?'."""
    return text.encode("utf-8", "replace").translate(LOWER_ASCII).split()


class Kept(dict):
    """What a function makes of a key, kept in two generations of at most ``most`` keys.

    When the young one is full it becomes the old one, of which stays what is asked for again.
    """

    def __init__(self, make: Callable[[Hashable], object], most: int) -> None:
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key: Hashable) -> object:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def mapped(df: DataFrame, rows: Callable[[pa.RecordBatch], dict], schema: str | T.StructType) -> DataFrame:
    """``mapInArrow`` of a function that turns a record batch into columns by name."""
    given = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(given)
        for batch in batches:
            if batch.num_rows:
                out = rows(batch)
                columns = [x if isinstance(x := out[f.name], pa.Array) else pa.array(x, f.type) for f in arrow]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return df.mapInArrow(run, given)


def by_name(df: DataFrame, other: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys of which nulls are equal; the keys come from the left side."""
    right = other.select(*[F.col(k).alias(f"_r_{k}") if k in keys else F.col(k) for k in other.columns])
    condition = None
    for k in keys:
        same = df[k].eqNullSafe(right[f"_r_{k}"])
        condition = same if condition is None else condition & same
    return df.join(right, condition, how).drop(*[f"_r_{k}" for k in keys])


def quoted(name: str) -> Column:
    """A column by its very name, which may hold dots and backticks."""
    return F.col("`" + name.replace("`", "``") + "`")


def packed_rows(df: DataFrame, **others: Column) -> DataFrame:
    """Whole rows as one column ``row``, so that no name can clash with ``others``, the only names beside it."""
    return df.select(F.struct(*[quoted(c).alias(c) for c in df.columns]).alias("row"), *[c.alias(n) for n, c in others.items()])


def unpacked_rows(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select(*[F.col("row").getField(c).alias(c) for c in names])


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer file lies; every executor has the package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def quiet_tokenizers() -> None:
    """Spark runs the tasks side by side; the tokenizers library must not start threads of its own."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"


def latin_pattern(pattern: str) -> re.Pattern:
    """A splitting pattern for texts of Latin-1 only, with its Unicode classes written out.

    The built-in matcher is several times as fast with them as a matcher that knows all of Unicode.
    """

    def members(kind: str) -> str:
        return "".join(re.escape(c) for c in map(chr, range(256)) if unicodedata.category(c)[0] == kind)

    space = "\\t-\\r \x85\xa0"
    for name, own in ((r"\p{L}", members("L")), (r"\p{N}", members("N")), (r"\s", space)):
        pattern = pattern.replace(f"[{name}]", f"[{own}]")
        pattern = re.sub(r"(\[[^\]]*)" + re.escape(name), lambda m, own=own: m[1] + own, pattern)
        pattern = pattern.replace(name, f"[{own}]")
    return re.compile(pattern.replace(r"\S", f"[^{space}]"))
