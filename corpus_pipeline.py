"""From raw documents to packed training sequences, in five stages.

Each stage takes the documents that the one before it left, as Parquet, and returns documents of the
same columns; the last returns packed pieces. No stage reads what an earlier one removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidyshelf.llm import decontaminate, packing, quality_rules, secret_scan, simhash
from tidyshelf.llm.frames import table
from tidyshelf.llm.queries import new_ledger
from tidyshelf.session import cut


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays."""
    return simhash.keep_first(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; documents that are mostly such go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


#: Session setting with the folder of a ledger that outlives the run; without it each run has its own.
LEDGER = "tidyshelf.secrets.ledger"


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Found secrets are masked. With a kept ledger only blobs and rules that no earlier run has read are scanned."""
    return secret_scan.redact(docs, spark.conf.get(LEDGER, None) or new_ledger(spark))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed sequences."""
    return packing.pack(docs)


STAGES = [("quality rules", quality), ("simhash near-dedup", near_copies),
          ("benchmark decontamination", benchmark), ("secret scans", secrets), ("packing", packed)]

#: SimHash groups and packing have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
