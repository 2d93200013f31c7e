"""Duplicate detection: blocking, similarity, star clusters, groups, resolution.

The clusters are those of the greedy rule: walk the rows by ``row_idx``; a row
not yet taken becomes a centre and takes every later untaken row that shares a
block with it and is similar enough. ``cluster`` computes exactly that without
ever forming all pairs of a block:

* rows equal in all compared keys are one node, so exact copies cost nothing;
* per round only the first ``batch`` open nodes of each block are compared with
  each other; those without a smaller similar neighbour are centres;
* each new centre is compared with the open nodes of its blocks, which closes
  its whole neighbourhood; the batch then grows fourfold.

Pairs are held against a bound by the characters that two names share inside the join, before
anything is sent to Python; what is left is decided by further bounds, and few pairs need all windows.

A dense block is used up by a few centres; the number of comparisons is that of
the sequential rule. Big blocks are spread over salted sub-keys on both sides of
every join, so no task holds a block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidyshelf.functions import similarity as sim
from tidyshelf.functions import text, units
from tidyshelf.operators import heavy
from tidyshelf.session import cut, number_rows

THRESHOLD = 0.80
CHUNK = 256          # batch nodes per salted chunk of a block
SHARD = 4096         # open nodes per salted shard of a block
RANKED = 1000        # most rows a block that Spark cuts to before it sorts
KEYS = ["bk", "ck", "mk", "nm", "ts"]
COUNTS = ["ln", "b0", "b1"]   # length of the sorted name and its character counts


# -- keys and blocks ---------------------------------------------------------------

def with_keys(products: DataFrame) -> DataFrame:
    """Compared keys per row: brand, category, model, lower-case name, sorted name."""
    name = F.lower(F.coalesce("product_name", F.lit("")))
    return products.select(
        "row_idx", text.key_string(F.col("brand")).alias("bk"),
        text.key_string(F.col("category")).alias("ck"),
        text.key_string(F.col("model_number")).alias("mk"),
        name.alias("nm"), sim.token_sorted(name).alias("ts"),
    )


def block_keys(brand_key: Column, category_key: Column, model_key: Column) -> Column:
    """The one or two blocks of a row: brand and category prefix, model prefix."""
    return F.array_compact(F.array(
        F.concat(F.lit("bc|"), F.left(brand_key, F.lit(6)), F.lit("|"),
                 F.left(category_key, F.lit(6))),
        F.when(model_key != "", F.concat(F.lit("m|"), F.left(model_key, F.lit(5)))),
    ))


def blocks(products: DataFrame) -> DataFrame:
    """(block, row_idx), one or two rows per product."""
    keyed = with_keys(products)
    return keyed.select(
        F.explode_outer(block_keys(F.col("bk"), F.col("ck"), F.col("mk"))).alias("block"), "row_idx")


def candidate_counts(products: DataFrame) -> DataFrame:
    """Number of candidate pairs, without forming them.

    n(n-1)/2 per block of either kind, less the pairs that sit in both, which
    are those equal in the combination of the two keys.
    """
    keyed = with_keys(products).select(
        F.concat_ws("|", F.left("bk", F.lit(6)), F.left("ck", F.lit(6))).alias("a"),
        F.when(F.col("mk") != "", F.left("mk", F.lit(5))).alias("b"))

    def pairs(keys: list[str], part: DataFrame) -> DataFrame:
        n = part.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
        return n.agg(F.coalesce(F.sum(F.expr("n * (n - 1) div 2")), F.lit(0)).alias("p"))

    by_model = keyed.where("b is not null")
    total = (
        pairs(["a"], keyed).select(F.lit(1).alias("sign"), "p")
        .unionByName(pairs(["b"], by_model).select(F.lit(1).alias("sign"), "p"))
        .unionByName(pairs(["a", "b"], by_model).select(F.lit(-1).alias("sign"), "p"))
    )
    return total.agg(F.sum(F.col("sign") * F.col("p")).cast("bigint").alias("candidate_pairs"))


# -- similarity of given pairs -----------------------------------------------------

def score_pairs(pairs: DataFrame, out: str = "similarity") -> DataFrame:
    """Similarity of the two sides ``a_*`` and ``b_*`` of each row.

    The model rule is native. Only pairs it leaves open send their names to Python; the others send blanks.
    """
    rule, boost = _rule(), _boost()
    sent = lambda k: F.when(F.col("_rule").isNull(), F.col(k)).otherwise(F.lit(""))
    named = sim.name_similarity()(sent("a_ts"), sent("b_ts"), sent("a_nm"), sent("b_nm"), boost)
    return pairs.withColumn("_rule", rule).withColumn(out, F.coalesce("_rule", named)).drop("_rule")


def _rule() -> Column:
    return sim.model_similarity(F.col("a_mk"), F.col("b_mk"), F.col("a_bk"), F.col("b_bk"))


def _boost() -> Column:
    return sim.boosted(F.col("a_bk"), F.col("b_bk"), F.col("a_ck"), F.col("b_ck"))


def possible(floor: float) -> Column:
    """Whether a pair of nodes can reach ``floor``: by the model rule, or by the characters both names have.

    No common subsequence is longer than the characters two names share, so no pair is lost.
    """
    bits = lambda s: [F.col(f"{s}_b0"), F.col(f"{s}_b1")]
    shared = sim.most_common_letters(F.col("a_ln"), bits("a"), F.col("b_ln"), bits("b"))
    by_name = (F.col("a_ln") > 0) & (F.col("b_ln") > 0) & (
        sim.similarity_bound(shared, F.col("a_ln") + F.col("b_ln"), _boost()) >= floor - 5e-4)
    return F.coalesce(_rule() >= floor, by_name)


def reaching(pairs: DataFrame, floor: float) -> DataFrame:
    """The pairs of nodes that reach ``floor``. ``possible`` is tried where the pairs are made; what the
    model rule leaves open then goes to Python, which need not work out whole scores."""
    sent = lambda k: F.when(_rule().isNull(), F.col(k)).otherwise(F.lit(""))
    named = sim.names_reach(floor)(sent("a_ts"), sent("b_ts"), sent("a_nm"), sent("b_nm"), _boost())
    return pairs.where(possible(floor)).where(F.coalesce(_rule() >= floor, named))


def _side(df: DataFrame, s: str, *extra: str) -> DataFrame:
    return df.select(*extra, F.col("node").alias(f"{s}_node"), *[F.col(k).alias(f"{s}_{k}") for k in KEYS],
                     *[F.col(k).alias(f"{s}_{k}") for k in COUNTS if k in df.columns])


# -- clustering --------------------------------------------------------------------

def place(nodes: DataFrame) -> DataFrame:
    """(block, node, keys, counts), one row per block of each node that can be compared at all."""
    first, second = sim.letter_bits(F.col("ts"))
    return nodes.where((F.col("mk") != "") | (F.col("nm") != "")).select(
        "node", *KEYS, F.length("ts").alias("ln"), first.alias("b0"), second.alias("b1"),
        F.explode_outer(block_keys(F.col("bk"), F.col("ck"), F.col("mk"))).alias("block"))


def _open_nodes(keyed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(block membership of nodes that share a block, node of each key set)."""
    nodes = keyed.groupBy(*KEYS).agg(F.min("row_idx").alias("node"), F.count(F.lit(1)).alias("copies"))
    placed = place(nodes)
    sizes = placed.groupBy("block").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    member = placed.join(sizes, "block").select(
        "block", "node", *KEYS, *COUNTS,
        F.ceil(F.col("size") / SHARD).cast("int").alias("shards"),
        F.lit(None).cast("bigint").alias("centre"))
    return member, nodes


def _low_nodes(live: DataFrame, batch: int) -> DataFrame:
    """Rows among which the first ``batch`` of each block are found.

    Up to ``RANKED`` Spark cuts each task's rows to the rank asked for. For more, a quantile sketch per block,
    which is merged like a sum, gives a node that at least ``batch`` rows do not exceed.
    """
    if batch <= RANKED:
        return live
    shares = [2.0 ** -k for k in range(48)]
    cuts = live.groupBy("block").agg(F.percentile_approx("node", shares, 10_000).alias("at"), F.count(F.lit(1)).alias("_n"))
    halvings = F.greatest(F.floor(F.log2(F.col("_n") / F.lit(1.1 * batch))), F.lit(0)).cast("int")
    cuts = cuts.select("block", F.when(halvings < 1, F.lit(None)).otherwise(
        F.get("at", F.least(halvings, F.lit(47)))).alias("_cut"))
    return live.join(cuts, "block").where("_cut IS NULL OR node <= _cut").drop("_cut")


def _centres(member: DataFrame, batch: int, floor: float) -> DataFrame:
    """Open nodes that are settled as centres by comparing the head of each block."""
    live = member.where("centre is null")
    head = (
        _low_nodes(live, batch).withColumn("rank", F.row_number().over(W.partitionBy("block").orderBy("node")))
        .where(F.col("rank") <= batch)
        .withColumn("chunk", F.floor((F.col("rank") - 1) / CHUNK).cast("int"))
    )
    # A node counts only where it is at the head of all its blocks: then all its
    # smaller open neighbours are at hand.
    seen = head.groupBy("node").agg(F.count(F.lit(1)).alias("heads"))
    spans = live.groupBy("node").agg(F.count(F.lit(1)).alias("blocks"))
    ready = seen.join(spans, "node").where("heads = blocks").select("node")
    if batch <= CHUNK:
        left, right, on = head, head, ["block"]
    else:
        # Chunk pairs (i, j), i <= j: every node meets every other exactly once.
        top = F.lit((batch - 1) // CHUNK)
        left = head.withColumn("i", F.col("chunk")).withColumn(
            "j", F.explode(F.sequence(F.col("chunk"), top)))
        right = head.withColumn("j", F.col("chunk")).withColumn(
            "i", F.explode(F.sequence(F.lit(0), F.col("chunk"))))
        on = ["block", "i", "j"]
    pairs = _side(left, "a", *on).join(_side(right, "b", *on), on).where("a_node < b_node")
    beaten = reaching(pairs, floor).select(F.col("b_node").alias("node")).distinct()
    return ready.join(beaten, "node", "left_anti")


def _hits(member: DataFrame, centres: DataFrame, floor: float) -> DataFrame:
    """(node, centre) of nodes the new centres reach and that want a smaller centre."""
    live = member.withColumn("shard", F.pmod(F.col("node"), F.col("shards")).cast("int"))
    spread = (
        member.where("centre is null").join(centres, "node")
        .withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    )
    pairs = (
        _side(spread, "a", "block", "shard")
        .join(_side(live, "b", "block", "shard", "centre"), ["block", "shard"])
        .where("a_node < b_node and (centre is null or a_node < centre)")
    )
    return (
        reaching(pairs, floor)
        .groupBy(F.col("b_node").alias("node")).agg(F.min("a_node").alias("hit"))
    )


def cluster(products: DataFrame, threshold: float = THRESHOLD, batch: int = 8) -> DataFrame:
    """(row_idx, centre) of every row in a cluster of two or more.

    Differs from a block-by-block walk in one point: there is a single global
    order and a single neighbourhood per row over both its blocks, so the result
    does not depend on the order in which blocks are visited.
    """
    return cluster_keys(cut(with_keys(products)), threshold, batch)


def cluster_keys(keyed: DataFrame, threshold: float = THRESHOLD, batch: int = 8) -> DataFrame:
    """``cluster`` of rows whose keys (``with_keys``) are stored already."""
    member, nodes = _open_nodes(keyed)
    member = cut(member)
    found: list[DataFrame] = []
    while True:
        centres = cut(_centres(member, batch, threshold))
        hits = _hits(member, centres, threshold)
        moved = (
            member.join(centres.withColumn("is_centre", F.lit(True)), "node", "left")
            .join(hits, "node", "left")
            .where("is_centre is null")
            .withColumn("centre", F.least("centre", "hit")).drop("hit", "is_centre")
        )
        moved = cut(moved)
        # Taken nodes stay only while a smaller centre could still turn up in the block.
        first_open = moved.where("centre is null").groupBy("block").agg(
            F.min("node").alias("first_open"))
        watched = moved.join(first_open, "block", "left").where(
            "centre is null or first_open < centre")
        found.append(moved.where("centre is not null").select("node", "centre"))
        member = cut(watched.drop("first_open"))
        if member.where("centre is null").isEmpty():
            break
        batch *= 4
    taken = found[0]
    for more in found[1:]:
        taken = taken.unionByName(more)
    taken = taken.groupBy("node").agg(F.min("centre").alias("centre"))
    return _spread_to_rows(keyed, nodes, taken)


def cluster_by_model(products: DataFrame) -> DataFrame:
    """(row_idx, centre) of rows that share a model key with others: what the model rule alone would join."""
    keyed = with_keys(products).where("mk <> ''").select("row_idx", "mk")
    heads = keyed.groupBy("mk").agg(F.min("row_idx").alias("centre"), F.count(F.lit(1)).alias("_n"))
    return heavy.join(keyed, heads.where("_n > 1"), ["mk"], ["row_idx"]).select("row_idx", "centre")


def _spread_to_rows(keyed: DataFrame, nodes: DataFrame, taken: DataFrame) -> DataFrame:
    """From nodes back to rows; copies of a centre belong to it. Sizes come from the copies of the nodes."""
    comparable = (F.col("mk") != "") | (F.col("nm") != "")
    home = nodes.where(comparable).join(taken, "node", "left").select(
        *KEYS[:-1], "copies", F.coalesce("centre", "node").alias("centre"))
    sizes = home.groupBy("centre").agg(F.sum("copies").alias("_n")).where("_n > 1")
    kept = heavy.join(home.drop("copies"), sizes.select("centre"), ["centre"], KEYS[:-1], "left_semi")
    return heavy.join(keyed.where(comparable).select("row_idx", *KEYS[:-1]), kept, KEYS[:-1],
                      ["row_idx"]).select("row_idx", "centre")


# -- groups and members --------------------------------------------------------------

MEMBER_FIELDS = ["product_id", "product_name", "brand", "model_number", "price", "power",
                 "voltage", "source"]


def duplicate_items(products: DataFrame, clusters: DataFrame) -> DataFrame:
    """Members with their similarity to the centre (two decimals; the centre has 1)."""
    detail = products.select("row_idx", *MEMBER_FIELDS)
    keyed = clusters.join(with_keys(products), "row_idx").withColumnRenamed("row_idx", "node")
    heads = keyed.where("node = centre")
    pairs = heavy.join(_side(keyed, "b", "centre"), _side(heads, "a", "centre"), ["centre"], ["b_node"],
                       counted=clusters)
    scored = score_pairs(pairs).select(
        "centre", F.col("b_node").alias("row_idx"),
        F.when(F.col("a_node") == F.col("b_node"), F.lit(1.0))
        .otherwise(F.col("similarity")).alias("exact_similarity"))
    return scored.join(detail, "row_idx").withColumn(
        "similarity", F.round("exact_similarity", 2)).withColumn(
        "specs_summary", text.specs_summary(
            F.col("power"), F.col("voltage"), units.float_text(F.col("price"))))


def duplicate_groups(items: DataFrame) -> DataFrame:
    """One row per cluster: running code, centre, best similarity, size."""
    is_head = F.col("row_idx") == F.col("centre")
    groups = items.groupBy("centre").agg(
        F.max(F.when(is_head, F.col("product_id"))).alias("canonical_product_id"),
        F.max(F.when(is_head, F.col("product_name"))).alias("canonical_name"),
        F.round(F.max(F.when(~is_head, F.col("exact_similarity"))), 2).alias("similarity"),
        F.count(F.lit(1)).alias("members"),
    )
    numbered = number_rows(groups, "centre", "_no", start=1)
    digits = F.col("_no").cast("string")
    return numbered.select(
        F.concat(F.lit("DUP-"), F.lpad(digits, F.greatest(F.length(digits), F.lit(4)), "0"))
        .alias("group_code"),
        F.col("centre").alias("canonical_row_idx"), "canonical_product_id", "canonical_name",
        "similarity", "members", F.lit("pending").alias("status"),
        F.lit(None).cast("string").alias("resolution_notes"))


def group_listing(groups: DataFrame, items: DataFrame, products: DataFrame) -> DataFrame:
    """Groups left joined with their members and the members' product rows, flat."""
    detail = products.select("row_idx", "currency", "quality_score")
    members = items.join(detail, "row_idx", "left")
    return groups.join(
        members.withColumnRenamed("similarity", "member_similarity"),
        F.col("canonical_row_idx") == F.col("centre"), "left",
    ).select("group_code", "status", "canonical_name", text.percent(F.col("similarity"))
             .alias("group_similarity"), "row_idx", "product_id", "product_name", "brand",
             "model_number", text.percent(F.col("member_similarity")).alias("member_similarity"),
             "price", "currency", "power", "voltage", "source", "quality_score")


def group_counters(groups: DataFrame) -> DataFrame:
    return groups.agg(
        F.count(F.lit(1)).alias("total_groups"),
        F.coalesce(F.sum("members"), F.lit(0)).alias("total_duplicate_items"),
        F.count_if(F.col("status") == "pending").alias("pending_groups"),
        F.count_if(F.col("status") == "merged").alias("merged_groups"))


GROUP_ACTIONS = {"merge": "merged", "merged": "merged", "ignore": "ignored",
                 "ignored": "ignored", "review": "reviewed", "reviewed": "reviewed"}


def resolve_groups(groups: DataFrame, actions: DataFrame) -> DataFrame:
    """Applies the latest action per group: (group_code, action, notes, acted_at)."""
    status = F.create_map(*[F.lit(x) for kv in GROUP_ACTIONS.items() for x in kv])
    latest = (
        actions.withColumn("_status", F.try_element_at(status, F.col("action")))
        .where("_status is not null")
        .groupBy("group_code").agg(
            F.max_by(F.struct("_status", "notes"), "acted_at").alias("_last"))
    )
    new_status, notes = F.col("_last._status"), F.col("_last.notes")
    return groups.join(latest, "group_code", "left").select(
        *[c for c in groups.columns if c not in ("status", "resolution_notes")],
        F.coalesce(new_status, "status").alias("status"),
        F.when(new_status.isNotNull(), F.coalesce(
            blank(notes), F.concat(F.lit("Duplicate cluster marked as "), new_status)))
        .otherwise(F.col("resolution_notes")).alias("resolution_notes"))


def blank(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def without_merged(products: DataFrame, groups: DataFrame, clusters: DataFrame) -> DataFrame:
    """Rows left once merged groups keep only their centre."""
    merged = groups.where("status = 'merged'").select(
        F.col("canonical_row_idx").alias("centre"))
    gone = clusters.join(merged, "centre", "left_semi").where("row_idx <> centre")
    return products.join(gone.select("row_idx"), "row_idx", "left_anti")


def model_rule_counts(products: DataFrame) -> DataFrame:
    """Pairs the model rule decides, per model key, from counts alone.

    Brands b1, b2, ... with n1, n2, ... rows and n0 rows without a brand: all
    n(n-1)/2 pairs are equal in model; those of two different brands score lower.
    """
    keyed = with_keys(products).where("mk <> ''")
    brands = keyed.groupBy("mk", "bk").agg(F.count(F.lit(1)).alias("n"))
    named = F.when(F.col("bk") != "", F.col("n")).otherwise(F.lit(0))
    per_model = brands.groupBy("mk").agg(
        F.sum("n").alias("n"), F.sum(named).alias("k"), F.sum(named * named).alias("k2"))
    return per_model.where("n > 1").select(
        F.col("mk").alias("model_key"), F.col("n").alias("product_count"),
        F.expr("n * (n - 1) div 2 - (k * k - k2) div 2").alias("pairs_same_brand"),
        F.expr("(k * k - k2) div 2").alias("pairs_other_brand"))
