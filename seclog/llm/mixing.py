"""Mixing sources to target weights by pivotal rounding of fractional copies."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seclog.llm.common import by_name, documents, packed_rows, unpacked_rows, word_count
from seclog.sources.staging import staged

#: Weights go round over the sources in order of their names, null last.
WEIGHTS = (5, 2, 1)
#: A source gives at most this many times its size, and a document as many copies.
MAX_EPOCHS = 3
#: Documents that one task rounds in a row; residuals of this many blocks meet in the next level.
BLOCK = 4096
FAN_IN = 64


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, units, target) from one row per source with its size and number of units.

    Targets share the sum of all sizes by weight; none exceeds ``cap`` times its source, and the excess goes to the
    others by weight. Sorted by the share at which they reach their cap, the capped sources come first, so running
    sums say where capping ends. This is a table of sources, not of documents.
    """
    everything = Window.partitionBy()
    by_name_ = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name_) - 1) % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("w", w).withColumn("cap", F.lit(cap) * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("w"))
    rising = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = (
        ranked.withColumn("total", F.sum("source_size").over(everything))
        .withColumn("rest_w", F.sum("w").over(everything) - F.sum("w").over(rising))
        .withColumn("capped", F.sum("cap").over(rising) + F.col("ratio") * F.col("rest_w") < F.col("total"))
    )
    share = (F.col("total") - F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0)).over(everything)) / F.sum(
        F.when(F.col("capped"), 0).otherwise(F.col("w"))
    ).over(everything)
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.least(share * F.col("w"), F.col("cap").cast("double")))
    return at.select("source", "source_size", "units", target.alias("target"))


def _unit(*values: Column) -> Column:
    """A number in [0, 1) that depends on the values alone."""
    return F.shiftrightunsigned(F.xxhash64(*values), 11) / F.lit(float(1 << 53))


def pivot(size: np.ndarray, p: np.ndarray, draw: np.ndarray) -> tuple[np.ndarray, int | None]:
    """Round all probabilities but one at most, in order; the sum of size * p stays what it is.

    Two open documents meet: one gains what the other loses, weighed by size, until one of them is 0 or 1. Either
    direction is drawn with the chance that keeps every document's expected value.
    """
    p = p.astype(float).tolist()
    size = size.astype(float).tolist()
    open_ = None
    for j, u in enumerate(draw.tolist()):
        if open_ is None:
            open_ = j
            continue
        i = open_
        r = size[i] / size[j]
        up, down = min(1 - p[i], p[j] / r), min(p[i], (1 - p[j]) / r)
        gain = up if u * (up + down) < down else -down
        a, b = p[i] + gain, p[j] - gain * r
        p[i], p[j] = (round(x) if min(abs(x), abs(1 - x)) < 1e-9 else x for x in (a, b))
        open_ = i if 0 < p[i] < 1 else j if 0 < p[j] < 1 else None
    return np.array(p), open_


def _round(frame: DataFrame, level: int, seed: int) -> DataFrame:
    """Round each (source, block); what stays open keeps its fraction."""
    schema = frame.schema
    drawn = frame.withColumn("u", _unit(F.lit(seed), F.lit(level), F.lit("draw"), "source", "doc_id")).withColumn(
        "o", _unit(F.lit(seed), F.lit(level), F.lit("order"), "source", "doc_id")
    )

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("o", "ascending"), ("doc_id", "ascending")])
        done, _ = pivot(*(table.column(c).to_numpy() for c in ("size", "p", "u")))
        return table.set_column(table.schema.get_field_index("p"), "p", pa.array(done)).drop_columns(["u", "o"])

    return drawn.groupBy("source", "block").applyInArrow(run, schema)


def copies(units: DataFrame, targets: DataFrame, seed: int = 7, block: int = BLOCK, fan_in: int = FAN_IN) -> DataFrame:
    """(source, doc_id, copies) for units (source, doc_id, size), of which (source, doc_id) is unique.

    A document of a source gets target / source_size copies: the whole part at once, the fraction by pivotal
    rounding. Documents are dealt to blocks by hash, so a large source is many tasks; each block leaves one open
    document at most, and those meet block group by block group until each source has one, which is drawn.
    """
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    blocks = F.ceil(F.col("units") / block)
    rated = by_name(units, targets, ["source"]).withColumn("rate", rate).withColumn("base", F.floor("rate"))
    first = rated.select(
        "source", "doc_id", "size", "base", (F.col("rate") - F.col("base")).alias("p"),
        F.pmod(F.xxhash64(F.lit(seed), "source", "doc_id"), blocks).alias("block"),
    )
    loose = (F.col("size") > 0) & (F.col("p") > 0)
    out = first.filter(~loose).withColumn("p", F.when(_unit(F.lit(seed), F.lit("empty"), "source", "doc_id") < F.col("p"), 1.0).otherwise(0.0))
    now = staged(_round(first.filter(loose), 0, seed), "mix")
    most = targets.agg(F.max("units")).first()[0] or 0
    level, left = 0, math.ceil(most / block)
    while left > 1:
        settled, still = now.filter("p = 0 or p = 1"), now.filter("p > 0 and p < 1")
        out = out.unionByName(settled)
        level, left = level + 1, math.ceil(left / fan_in)
        now = staged(_round(still.withColumn("block", F.floor(F.col("block") / fan_in)), level, seed), "mix")
    last = F.when((F.col("p") == 0) | (F.col("p") == 1), F.col("p")).otherwise(
        F.when(_unit(F.lit(seed), F.lit("last"), "source", "doc_id") < F.col("p"), 1.0).otherwise(0.0)
    )
    out = out.unionByName(now.withColumn("p", last))
    return out.select("source", "doc_id", (F.col("base") + F.col("p")).cast("long").alias("copies"))


def mixed(docs: DataFrame, seed: int = 7) -> DataFrame:
    """One row per row of ``docs`` (doc_id, source, text): doc_id, size, source_size, target, taken, copies.

    ``size`` is the number of words (null text: 0), ``target`` what the mix should take of the source, ``taken`` the
    words it takes of this row, repeats counted. Rows of one source and doc_id are one unit and get the same number
    of copies; nulls in either are values of their own. A document without words, or of a source without words,
    takes 0. Other columns are not read; no rows give no rows. All draws are hashes of (source, doc_id), so reruns
    agree however the rows lie.
    """
    rows = staged(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
    units = rows.groupBy("source", "doc_id").agg(F.sum("size").alias("size"))
    sizes = units.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("units"))
    targets = staged(source_targets(sizes), "targets")
    chosen = copies(units, targets, seed)
    placed = by_name(by_name(rows, chosen, ["source", "doc_id"]), targets, ["source"])
    return placed.select("doc_id", "source", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mix_documents(docs: DataFrame, seed: int = 7) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it; all columns unchanged, whatever their names.

    A row without words (null text too) is taken no time, as are all rows of a source without words; nulls in source
    or doc_id are values of their own. No rows give no rows.
    """
    taken = mixed(docs, seed).filter("copies > 0").groupBy("source", "doc_id").agg(F.max("copies").alias("copies"))
    rows = by_name(packed_rows(docs, source=F.col("source"), doc_id=F.col("doc_id")), taken, ["source", "doc_id"])
    return unpacked_rows(rows.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")), docs.columns)


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(documents(spark, sf_dir)).drop("source")
