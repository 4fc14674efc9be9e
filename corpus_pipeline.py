"""The corpus pipeline: language ID, line dedup, near-dedup, decontamination and packing.

Every stage takes all that its predecessor kept. All but the last return the columns of documents; a document that a stage
rejects is gone for the next, and line dedup changes text and n_chars. Packing returns its pieces. An empty table goes
through all stages as one; columns beyond those of documents go through all but the last, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from finlattice.llm import common, decontam, langid, line_dedup, minhash, packing
from finlattice.llm.queries import ready
from finlattice.session import table


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on these documents, accepts.

    Where no row has lang, text and doc_id there is nothing to learn, and all documents stay. Else a document whose text is
    null, empty or has no letter goes, as does one whose score is below the threshold. Each row is judged by itself, so
    repeated rows all stay or all go, and a null doc_id makes no difference.
    """
    ready(spark)
    return langid.accepted(docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the long lines that five or more of them share, but for the last one.

    Null text stays null, empty text empty. Rows are documents, so five repeated rows share their lines; rows tied for the
    largest doc_id all keep a line, and a null doc_id is never the largest.
    """
    ready(spark)
    return line_dedup.cleaned(line_dedup.dedup_lines(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest doc_id) of each group linked at 0.8 on shingles of five words.

    Documents without words (null, empty or blank text) and those with a null doc_id link with nothing and stay. Rows that
    share a doc_id are one document: all of them stay or all go.
    """
    ready(spark)
    return common.without(docs, minhash.near_duplicates(docs).where("not kept").select("doc_id"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words under a twentieth lies in windows of the benchmark.

    A document without words stays, and with an empty benchmark all do. Each row is judged by itself, whatever its doc_id.
    """
    ready(spark)
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, each with its place in a sequence.

    Null and empty texts have the end id alone; repeated rows are packed each; an empty table has no pieces.
    """
    ready(spark)
    return packing.pack(docs)


STAGES = [
    ("language_id", keep_known_languages),
    ("line_dedup", drop_repeated_lines),
    ("minhash_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: Language ID and tokenisation have no SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's documents are written and read again, and its scratch tables then deleted."""
    ready(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        if k == len(STAGES) - 1:
            return stage(spark, docs, sf_dir)
        old = common.scratch()
        kept = common.written(stage(spark, docs, sf_dir), name)
        new = [p for p in common.scratch() if p not in old]
        common.sweep(spark, new[:-1])
        docs = kept
    return docs
