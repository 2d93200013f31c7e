"""Secret scans over an incremental ledger of blobs, native throughout.

Every version of a text is addressed by its SHA-256. The ledger is a folder with two tables: ``blobs``
(blob, rules: the versions of the rules that have read it) and ``findings`` (blob, rule, kind, span).
A scan takes each blob once however many paths hold it, only the blobs and rules that the ledger does
not know, appends what it finds, then appends the blobs, and joins the findings of the asked rules to
all paths. A job that dies in between leaves findings without blobs; the next scan finds them again
and equal rows count once.

A rule's version is the digest of its text, so a changed rule is a new one.

Defined cases: a null text is the empty blob; spans are in code points, end exclusive; repeated rows
and paths share the blob's findings; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidyshelf.llm import frames, intervals


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of a pattern; a match counts if the group has ``least``
    characters. ``needle`` is a text that every match holds, if there is one; ``tight`` a pattern with the
    counting matches alone, where short ones can be passed over without moving the others."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    needle: str = ""
    tight: str = ""

    @property
    def version(self) -> str:
        return hashlib.sha256(repr(self).encode()).hexdigest()[:16]


BASE_RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
                   r"""([A-Za-z0-9+/_.=-]+)""", 6, 2),
    Rule("access", "AKIA[A-Z0-9]+", 20, 0, "AKIA"),
    Rule("hex", "[0-9a-f]+", 24, tight="[0-9a-f]{24,}"),
)
MORE_RULES = (
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0, "PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+[.]eyJ[A-Za-z0-9_-]+[.][A-Za-z0-9_-]+", 0, 0, "eyJ"),
    Rule("forge", "gh[pousr]_[A-Za-z0-9]+", 40, 0, "gh"),
)
RULES = BASE_RULES + MORE_RULES

_MATCHES = "array<struct<kind:string,rank:int,rule:string,k:int,gap:int,size:int,counts:boolean>>"


def blob_of(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def _matches(rule: Rule, rank: int, text: Column, todo: Column) -> Column:
    """All matches of a rule in order: text between it and the one before, its length, whether it
    counts. Texts that hold no candidate are passed over by one search."""
    pattern = rule.tight or rule.pattern
    test = text.contains(rule.needle) if rule.needle else text.rlike(pattern)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    group = F.regexp_extract_all(text, F.lit(pattern), F.lit(rule.group))
    zipped = F.arrays_zip(whole.alias("whole"), group.alias("part"),
                          F.split(text, pattern, -1).alias("gap"))
    found = F.transform(
        F.filter(zipped, lambda x: x["whole"].isNotNull()),
        lambda x, i: F.struct(
            F.lit(rule.kind).alias("kind"), F.lit(rank).alias("rank"),
            F.lit(rule.version).alias("rule"), i.alias("k"), F.length(x["gap"]).alias("gap"),
            F.length(x["whole"]).alias("size"), (F.length(x["part"]) >= rule.least).alias("counts")))
    return F.when(F.array_contains(todo, rule.version) & test, found.cast(_MATCHES)).otherwise(
        F.array().cast(_MATCHES))


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, rule, kind, rank, start, end) of the blobs (blob, text, todo)."""
    all_matches = F.concat(*[_matches(rule, rank, F.col("text"), F.col("todo"))
                             for rank, rule in enumerate(rules)])
    rows = blobs.select("blob", F.explode(all_matches).alias("m")).select("blob", "m.*")
    before = W.partitionBy("blob", "rule").orderBy("k").rowsBetween(W.unboundedPreceding, 0)
    end = F.sum(F.col("gap").cast("long") + F.col("size")).over(before)
    return rows.withColumn("end", end).where("counts").select(
        "blob", "rule", "kind", "rank", (F.col("end") - F.col("size")).alias("start"), "end")


def exists(spark, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def update(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> None:
    """Scans what the ledger does not know, and appends it."""
    spark = docs.sparkSession
    versions = F.array(*[F.lit(rule.version) for rule in rules])
    seen = None
    if exists(spark, f"{ledger}/blobs/_SUCCESS"):
        seen = spark.read.parquet(f"{ledger}/blobs").groupBy("blob").agg(
            F.array_distinct(F.flatten(F.collect_set("rules"))).alias("seen"))

    def unseen(blobs: DataFrame) -> DataFrame:
        if seen is None:
            return blobs.withColumn("todo", versions)
        return blobs.join(seen, "blob", "left").withColumn("todo", F.array_except(
            versions, F.coalesce("seen", F.array().cast("array<string>")))).where(
            "size(todo) > 0").drop("seen")

    text = F.coalesce("text", F.lit(""))
    blobs = docs.select(blob_of(F.col("text")).alias("blob"), text.alias("text"))
    scan_blobs(unseen(blobs.dropDuplicates(["blob"])), rules).write.mode("append").parquet(
        f"{ledger}/findings")
    unseen(blobs.select("blob").distinct()).select("blob", F.col("todo").alias("rules")).write.mode(
        "append").parquet(f"{ledger}/blobs")


def findings(spark, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, spans): the spans (start, rank, kind, end) of the rules, in order."""
    return spark.read.parquet(f"{ledger}/findings").where(
        F.col("rule").isin([rule.version for rule in rules])).groupBy("blob").agg(F.array_sort(
            F.collect_set(F.struct("start", "rank", "kind", "end"))).alias("spans"))


def scan(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, spans) of every row; spans is empty where nothing was found."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    update(docs, ledger, rules)
    found = findings(docs.sparkSession, ledger, rules)
    return docs.select("doc_id", blob_of(F.col("text")).alias("blob")).join(found, "blob", "left").select(
        "doc_id", F.coalesce("spans", F.array().cast(found.schema["spans"].dataType)).alias("spans"))


def as_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES,
           mark: str = "[secret]") -> DataFrame:
    """The documents with every found span replaced, with the columns they came with; ``n_chars``,
    where there is one, is counted again for a text that changed."""
    update(docs.select("text"), ledger, rules)
    found = findings(docs.sparkSession, ledger, rules).select(
        F.col("blob").alias("found_blob"), intervals.merged(F.transform("spans", lambda s: F.struct(
            s["start"].alias("start"), s["end"].alias("end")))).alias("found"))
    # whole rows travel as one value, so columns of any name may come along
    joined = docs.select(F.struct(*docs.columns).alias("row"), blob_of(F.col("text")).alias("blob")).join(
        found, F.col("blob") == F.col("found_blob"), "left")
    text = F.col("row")["text"]
    masked = F.array_join(F.transform(
        intervals.gaps(F.col("found"), F.length(text)),
        lambda g: F.substring(text, (g["start"] + 1).cast("int"), (g["end"] - g["start"]).cast("int"))),
        mark)
    changed = F.col("found").isNotNull()
    return joined.select(*frames.with_text(docs, F.col("row"), masked, changed))
