"""From raw documents to packed training sequences: five stages, each one operator of facetgraph.llm.

1. quality: ordinal grades; documents unlikely to be good go.
2. dedup: n-gram Jaccard join; of each group of near copies one row of the smallest id stays.
3. secrets: live-looking credentials are masked; every row stays.
4. mix: sources are sampled to target weights; a row for each copy that the mix takes.
5. pack: sequences of at most 4096 tokens; a row per piece.

Stages 1 to 4 return the columns of documents. Labels come from the folder's labels table. Texts that are null or
empty pass stages as each operator defines. Rows are judged by their own texts, whatever ids they share; rows of a null id
are documents each, which link with nothing in stage 2.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetgraph.llm import jaccard, linear, mixing, packing, queries, secrets
from facetgraph.llm._common import stored, table, tokenizer_path

#: SQL can't express the trained and hashed stages; the operators behind them have brute-force tests.
ORACLE_SQL = None
#: The dedup stage's words of a shingle and least likeness in hundredths.
WORDS, PERCENT = 5, 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = linear.quality_model(docs, table(spark, sf_dir, "labels"))
    kept = linear.quality(docs, model, docs.columns)
    return kept.where(F.col("p1") >= queries.KEEP).select(docs.columns)


def numbered(docs: DataFrame) -> DataFrame:
    """docs with ``_at``, a row's place in the files that hold it; docs that are no files are written first."""
    place = F.struct("_metadata.file_path", "_metadata.row_index").alias("_at")
    try:
        return docs.select(*docs.columns, place)
    except AnalysisException:  # not a scan of files
        return stored(docs, "docs").select(*docs.columns, place)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    whole = numbered(docs)
    found = jaccard.join(whole, k=WORDS, percent=PERCENT, keep=("_at",))
    kept = stored(jaccard.survivors(found, "_at"), "kept")
    return whole.join(kept.hint("merge"), "_at", "left_semi").select(docs.columns)


def mask(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.mask_secrets(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # rows are mixed by their places, so that those of a null id stay what was counted and texts pass one shuffle
    whole = numbered(docs)
    mixed = mixing.mix(queries.weighted_sizes(whole, table(spark, sf_dir, "labels"), ("_at",)), keep=("_at",)).where("copies > 0")
    taken = stored(mixed.select("_at", "copies"), "taken")
    # texts are shuffled at every size: a broadcast that only small inputs allow would hide what large ones cost
    return whole.join(taken.hint("merge"), "_at").select(*docs.columns, F.explode(F.sequence(F.lit(1), "copies"))).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path(), remember=1 << 17)


STAGES = [("quality", quality), ("dedup", dedup), ("secrets", mask), ("mix", mix), ("pack", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
