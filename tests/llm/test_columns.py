"""Pipeline stages on tables with awkward column names, nulls and no rows."""

from collections import Counter

import pytest

import corpus_pipeline
from seclog.llm import bpe, exact, mixing, quality, simhash, token_counts
from tests.llm.helpers import awkward

NAMES = ["a.b", "__row", "__n", "__copy", "__copies", "_r_source", "_r_doc_id", "row", "key", "n", "copies", "copy", "back`tick", "two words", "sha", "fp", "size"]
STAGES = [quality.clean_documents, exact.without_copies, simhash.without_near_copies, mixing.mix_documents]
DDL = "doc_id long, text string, source string, n_chars int, " + ", ".join("`" + n.replace("`", "``") + "` string" for n in NAMES)


def table(spark, rows):
    full = [(r[0], r[1], r[2] if len(r) > 2 else "s", len(r[1] or ""), *[f"{n} of {r[0]}" for n in NAMES]) for r in rows]
    return spark.createDataFrame(full, DDL).repartition(3)


@pytest.mark.parametrize("stage", STAGES, ids=lambda f: f.__name__)
def test_all_columns_pass_through_whatever_their_names(spark, stage):
    given = table(spark, [*awkward(), (900, None, None), (None, None, "s")])
    out = stage(given)
    assert out.schema.names == given.schema.names and [f.dataType for f in out.schema] == [f.dataType for f in given.schema]
    rows = out.collect()
    assert rows
    for r in rows:
        assert [r[n] for n in NAMES] == [f"{n} of {r.doc_id}" for n in NAMES] and r.n_chars == len(r.text or "")
    if stage is not mixing.mix_documents:
        before = Counter(r.doc_id for r in given.collect())
        assert all(k <= before[i] for i, k in Counter(r.doc_id for r in rows).items())


@pytest.mark.parametrize("stage", [*STAGES, bpe.encoded, quality.line_quality, token_counts.token_trees], ids=lambda f: f.__name__)
def test_no_rows_and_only_nulls(spark, stage):
    assert stage(table(spark, [])).collect() == []
    stage(table(spark, [(None, None, None), (1, None, None)])).collect()


def test_the_stages_in_a_row_take_these_columns(spark):
    docs = table(spark, awkward())
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
    assert docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and docs.count() > 0
