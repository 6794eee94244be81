"""The registered queries of this subpackage and, where SQL can say it, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetide.llm import bpe, filter_audit, forced_cuts, language, lexical, lm_score, media, mixing, simhash, sketches, token_counts, token_files, toxicity
from pagetide.llm.common import documents, scratch

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {"op1_mix_sources": mixing.SQL, "op11_lexical_search": lexical.SQL, "op12_filter_audit": filter_audit.SQL}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix of all documents to the weights 1, 2, 3 takes of each."""
    return mixing.mixed(documents(spark, sf_dir))


@query
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    rows = simhash.linked(documents(spark, sf_dir))
    return rows.select("doc_id", F.lpad(F.lower(F.hex("code")), 16, "0").alias("fingerprint"), "component_id")


@query
def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how near it is to that and to the next document."""
    return sketches.compared_with_next(documents(spark, sf_dir))


@query
def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the stored image of every document's text holds."""
    return media.media_rows(documents(spark, sf_dir))


@query
def op5_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's token ids and of the bytes that they decode to."""
    return bpe.digests(bpe.encode(documents(spark, sf_dir)))


@query
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document, and whether the tokens pass the limit."""
    return token_counts.token_counts(documents(spark, sf_dir))


@query
def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    return language.identified(documents(spark, sf_dir))


@query
def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, number and checksum of every document's ids, from the files written."""
    path = scratch(spark, "token-files")
    token_files.write(documents(spark, sf_dir), path)
    return token_files.listing(spark, path)


@query
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chance that a document is toxic, for every document."""
    return toxicity.scored(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@query
def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked pseudo-log-likelihood of every document."""
    return lm_score.scored(documents(spark, sf_dir))


@query
def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return lexical.best_documents(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@query
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every step of every order of five filters removes, repeats and loses, by language."""
    return filter_audit.audited(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@query
def op13_forced_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's token ids, encoded by fragments, and of the text that they decode to."""
    return forced_cuts.digests(forced_cuts.encode(documents(spark, sf_dir)))
