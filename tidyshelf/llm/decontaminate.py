"""Benchmark decontamination: a broadcast hash set of test n-grams, native throughout.

Texts become lower-case words; a window is ``n`` consecutive words of an item, or a shorter item as a
whole. Document windows are hashed in place, exploded as (position, key) and looked up in the broadcast
set of item windows; a hit is then verified word by word, so equal hashes of other words do not count.
Only hits are shuffled. Beyond ``BROADCAST`` windows the set is joined by a shuffle instead.

``scan`` reports, ``clean`` removes the hit words with what follows them up to the next word, or the
whole document where more than ``drop_share`` of its words are hit.

Defined cases: a null text or one without words has no hits; items that are null or without words
have no window; items without an id hit but are not counted; repeated rows of documents each get their
result, repeated items count once; empty tables are fine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidyshelf.llm import frames, intervals

WORDS = 10
#: Most item windows that are broadcast; about 200 bytes each.
BROADCAST = 500_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Separators of words, and words, in a text whose A-Z are left as they are.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.array_remove(
        F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), BETWEEN), "")


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def item_windows(items: DataFrame, n: int = WORDS) -> DataFrame:
    """(window, width, key, items) of all different windows; items are the sorted ids as text."""
    return (
        items.select(F.col("item_id").cast("string").alias("item"), words_of(F.col("text")).alias("w"))
        .withColumn("width", F.least(F.size("w"), F.lit(n))).where("width > 0")
        .select("item", "width", F.explode(F.transform(
            F.sequence(F.lit(1), F.size("w") - F.col("width") + 1),
            lambda i: F.slice("w", i, F.col("width")))).alias("window"))
        .groupBy("window", "width").agg(F.array_sort(F.collect_set("item")).alias("items"))
        .withColumn("key", F.xxhash64(_hashes(F.col("window")))))


def hits(docs: DataFrame, items: DataFrame, n: int = WORDS, broadcast: int = BROADCAST) -> DataFrame:
    """(doc_id, digest, spans, items) of the documents with a verified window. Spans are the windows in
    order of place; digest tells rows of one id apart."""
    windows = item_windows(items, n)
    widths, count = windows.agg(F.collect_set("width"), F.count(F.lit(1))).first()
    short = sorted(w for w in widths if w < n)
    small = count <= broadcast
    if small:
        windows = F.broadcast(windows)
    hashed = docs.select("doc_id", F.xxhash64("text").alias("digest"),
                         words_of(F.col("text")).alias("w")).withColumn("h", _hashes(F.col("w")))

    def keys(width: int) -> Column:
        return F.when(F.size("h") >= width, F.transform(
            F.sequence(F.lit(1), F.size("h") - width + 1),
            lambda i: F.struct(F.xxhash64(F.slice("h", i, width)).alias("key"),
                               i.alias("at"), F.lit(width).alias("width"))
        )).otherwise(F.array().cast("array<struct<key:long,at:int,width:int>>"))

    all_keys = keys(n) if not short else F.concat(keys(n), *map(keys, short))
    # a broadcast join copies no row, so the words stay whole there; a shuffled probe takes its window only
    window = F.slice("w", F.col("p.at"), F.col("p.width"))
    probes = hashed.select("doc_id", "digest", "w", F.explode(all_keys).alias("p")).select(
        "doc_id", "digest", F.col("w") if small else window.alias("w"), "p.key", "p.at",
        F.col("p.width").alias("_width"))
    own = F.slice("w", F.col("at"), F.col("width")) if small else F.col("w")
    found = probes.join(windows, "key").where(
        (F.col("width") == F.col("_width")) & (own == F.col("window")))
    return found.select(
        "doc_id", "digest", "items",
        F.struct((F.col("at") - 1).cast("long").alias("start"),
                 (F.col("at") - 1 + F.col("width")).cast("long").alias("end")).alias("span")
    ).groupBy("doc_id", "digest").agg(
        F.array_sort(F.collect_set("span")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))


def scan(docs: DataFrame, items: DataFrame, n: int = WORDS, broadcast: int = BROADCAST) -> DataFrame:
    """Words, hit words and occurring items of every document."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    items = items.select("item_id", "text")
    found = hits(docs, items, n, broadcast).select(
        F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"),
        intervals.covered(F.col("spans")).alias("n_hit"), "items")
    all_docs = docs.select(
        "doc_id", F.xxhash64("text").alias("digest"),
        F.size(F.array_remove(F.split(F.coalesce("text", F.lit("")), BETWEEN), ""))
        .cast("long").alias("n_words"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return all_docs.join(found, F.col("doc_id").eqNullSafe(F.col("_id"))
                         & (F.col("digest") == F.col("_digest")), "left").select(
        "doc_id", "n_words", n_hit.alias("n_hit"),
        F.coalesce(F.size("items").cast("long"), F.lit(0).cast("long")).alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")).cast("binary"), 256)
        .alias("items_sha256"),
        (n_hit > 0).alias("contaminated"))


def clean(docs: DataFrame, items: DataFrame, n: int = WORDS, drop_share: float = 0.5,
          broadcast: int = BROADCAST) -> DataFrame:
    """The documents without benchmark passages, with the columns they came with; ``n_chars``, where
    there is one, is counted again for a text that changed."""
    found = hits(docs.select("doc_id", "text"), items.select("item_id", "text"), n, broadcast).select(
        F.col("doc_id").alias("hit_id"), F.col("digest").alias("hit_digest"),
        intervals.merged(F.col("spans")).alias("hit"))
    # whole rows travel as one value, so columns of any name may come along
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("id"),
                       F.xxhash64("text").alias("digest"))
    joined = rows.join(found, F.col("id").eqNullSafe(F.col("hit_id"))
                       & (F.col("digest") == F.col("hit_digest")), "left")
    text = F.col("row")["text"]
    split = joined.where("hit IS NOT NULL").withColumn(
        "words", F.array_remove(F.split(text, BETWEEN), "")).withColumn(
        "between", F.split(text, WORD)).withColumn(
        "hits", F.aggregate("hit", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"]))
    pieces = split.where(F.col("hits") <= drop_share * F.size("words")).withColumn(
        "pieces", F.zip_with("words", F.slice("between", 2, F.size("words")), lambda a, b: F.concat(a, b)))
    rest = F.concat(F.get("between", F.lit(0)), F.array_join(F.transform(
        intervals.gaps(F.col("hit"), F.size("words")),
        lambda g: F.array_join(F.slice("pieces", (g["start"] + 1).cast("int"),
                                       (g["end"] - g["start"]).cast("int")), "")), ""))
    changed = pieces.withColumn("rest", rest)
    return joined.where("hit IS NULL").select("row.*").unionByName(
        changed.select(*frames.with_text(docs, F.col("row"), F.col("rest"))))
