"""Every operator and pipeline stage on empty tables and on odd rows, with clashing extra columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pagetide.llm import bpe, filter_audit, forced_cuts, language, lexical, lm_score, media, mixing, simhash, sketches, token_counts, token_files, toxicity
from pagetide.llm.common import scratch


def _files(docs, labels):
    path = scratch(docs.sparkSession, "test-files")
    token_files.write(docs, path)
    return token_files.listing(docs.sparkSession, path)


APPLY = {
    "mix": lambda d, x: mixing.mixed(d),
    "simhash": lambda d, x: simhash.linked(d),
    "fingerprints": lambda d, x: sketches.compared_with_next(d),
    "media": lambda d, x: media.media_rows(d),
    "bpe": lambda d, x: bpe.digests(bpe.encode(d)),
    "token_counts": lambda d, x: token_counts.token_counts(d),
    "language": lambda d, x: language.identified(d),
    "token_files": _files,
    "toxicity": toxicity.scored,
    "lm_score": lambda d, x: lm_score.scored(d),
    "forced_cuts": lambda d, x: forced_cuts.digests(forced_cuts.encode(d)),
    "filter_masks": lambda d, x: filter_audit.failed(d),
}


@pytest.mark.parametrize("name", APPLY)
def test_every_odd_row_gives_one_row(odd, labels, name):
    rows = APPLY[name](odd, labels).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r["doc_id"]) for r in odd.collect())


@pytest.mark.parametrize("name", APPLY)
def test_an_empty_table_gives_no_rows(empty, labels, name):
    assert APPLY[name](empty, labels.limit(0)).count() == 0


def test_search_and_audit_take_odd_and_empty_tables(spark, odd, empty, labels):
    asked = odd.withColumnRenamed("doc_id", "item_id").withColumn("doc_id", F.lit("x")).withColumn("rank", F.lit(1.5))
    rows = lexical.best_documents(odd, asked).collect()
    assert rows and {r["item_id"] for r in rows} <= {r["item_id"] for r in asked.collect()}
    assert not lexical.best_documents(empty, asked).count() and not lexical.best_documents(odd, asked.limit(0)).count()
    assert filter_audit.audited(odd, labels).count() == 600 * len({r["lang"] for r in odd.collect()})
    assert not filter_audit.audited(empty, labels.limit(0)).count()


@pytest.fixture(scope="module")
def label_dir(spark, labels):
    path = scratch(spark, "test-labels")
    labels.write.parquet(f"{path}/labels.parquet")
    return path


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_take_odd_and_empty_tables(spark, odd, empty, label_dir, name, stage):
    for docs in (odd, empty):
        out = stage(spark, docs, label_dir)
        rows = out.collect()
        if name != "tokens":
            assert out.columns == docs.columns
            assert {r["doc_id"] for r in rows} <= {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert docs.count() or not rows
