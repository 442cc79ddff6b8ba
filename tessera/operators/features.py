"""Subtree aggregates and candidate features over the node table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import dom
from tessera.functions.dom import NodeMatch
from tessera.functions.text import collapsed_length, is_blank
from tessera.operators.nodes import whole_text
from tessera.operators.rank import Net
from tessera.operators.staged import staged

INT_MAX, INT_MIN = 2147483647, -2147483648


def subtree_counts(nodes: DataFrame) -> DataFrame:
    """Counts over each element's descendants, as differences of running sums: no range join.

    n_nodes, n_fields (non-blank texts), n_images, n_anchors, n_chars, n_blocks, n_content, n_items,
    n_formatting, n_decoration by page_id, node_id.
    """
    one = lambda c: c.cast("int")
    text = F.col("tag") == "#text"
    measures = {
        "n_nodes": F.lit(1),
        "n_fields": one(text & ~is_blank(F.col("text"))),
        "n_images": one(F.col("tag") == "img"),
        "n_anchors": one(F.col("tag") == "a"),
        "n_chars": F.when(text, collapsed_length(F.col("text"))).otherwise(0),
        "n_blocks": one(dom.is_tag("block")),
        "n_content": one(dom.is_tag("content")),
        "n_items": one(dom.is_tag("item")),
        "n_formatting": one(dom.is_tag("formatting")),
        "n_decoration": one(dom.is_tag("decoration")),
    }
    upto = Window.partitionBy("page_id").orderBy("node_id").rowsBetween(Window.unboundedPreceding, 0)
    running = nodes.select("page_id", "node_id", "end_id", "parent_id", "depth", "tag", *[F.sum(m).over(upto).alias(k) for k, m in measures.items()])
    ends = running.select("page_id", F.col("node_id").alias("end_id"), *[F.col(k).alias(f"e_{k}") for k in measures])
    elements = running.where("substr(tag, 1, 1) <> '#'")
    return elements.join(ends, ["page_id", "end_id"]).select("page_id", "node_id", "parent_id", "depth", "tag", *[(F.col(f"e_{k}") - F.col(k)).alias(k) for k in measures])


def fixed_point(c: Column) -> Column:
    """Times 1000, truncated, saturating; null and NaN are 0."""
    value = F.coalesce(F.nanvl(c.cast("double"), F.lit(0.0)), F.lit(0.0)) * 1000
    return F.least(F.greatest(value, F.lit(float(INT_MIN))), F.lit(float(INT_MAX))).cast("bigint").cast("int")


def ratio(a: Column, b: Column) -> Column:
    """a / b as fixed point, 0 where b is nearly 0."""
    return fixed_point(F.when(F.abs(b) < 1e-9, 0.0).otherwise(a / b))


def truth(c: Column) -> Column:
    """A boolean as a feature: true is -1, false 1."""
    return F.when(c, -1).otherwise(1)


def divides(n: Column, by: int) -> Column:
    """Whether n is a multiple of by, as a feature; 0 is none."""
    return truth((n != 0) & (n % by == 0))


def distance_to_multiple(n: Column, by: int) -> Column:
    """How far n is from the nearest multiple of by; 0 times by isn't taken."""
    lower = F.floor(n / by)
    return F.least(F.abs(n - F.greatest(lower, F.lit(1)) * by), F.abs(n - (lower + 1) * by)).cast("int")


def either_divides(a: Column, b: Column) -> Column:
    """Whether one of two counts is a multiple of the other, as a feature; 0 is none."""
    return truth((a != 0) & (b != 0) & ((F.try_mod(a, b) == 0) | (F.try_mod(b, a) == 0)))


def smallest_rest(a: Column, b: Column) -> Column:
    """The lesser of the rests of two counts by each other; 0 where one is 0."""
    return F.when((a != 0) & (b != 0), F.least(F.try_mod(a, b), F.try_mod(b, a))).otherwise(0).cast("int")


def skewness(c: Column | str) -> Column:
    """The adjusted sample skewness; 0 under three values or without spread."""
    n = F.count(c)
    biased = F.skewness(c)
    return F.when(n < 3, 0.0).otherwise(F.coalesce(F.nanvl(biased, F.lit(0.0)) * F.sqrt(n * (n - 1)) / (n - 2), F.lit(0.0)))


def group_statistics(df: DataFrame, by: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """mean, sample deviation (0 for one value) and adjusted skewness of measures by group."""
    out = []
    for m in measures:
        out += [F.avg(m).alias(f"{m}_mean"), F.coalesce(F.stddev_samp(m), F.lit(0.0)).alias(f"{m}_stddev"), skewness(m).alias(f"{m}_skew")]
    return df.groupBy(*by).agg(F.count("*").alias("n"), *out)


def children_consistency(nodes: DataFrame) -> DataFrame:
    """page_id, parent_id, n_children, n_tags (distinct child tags), same_tag of every element with child elements."""
    kids = nodes.where("substr(tag, 1, 1) <> '#' and parent_id >= 0")
    return kids.groupBy("page_id", "parent_id").agg(F.count("*").alias("n_children"), F.countDistinct("tag").alias("n_tags")).withColumn("same_tag", F.col("n_tags") == 1)


def signatures(nodes: DataFrame) -> DataFrame:
    """page_id, node_id, signature: the sorted distinct block tags below and with each item node."""
    items = nodes.where(dom.is_tag("item")).select("page_id", "node_id")
    blocks = nodes.where(dom.is_tag("block")).select("page_id", F.explode(F.array_append("path", F.col("node_id"))).alias("node_id"), "tag")
    met = blocks.join(items, ["page_id", "node_id"], "left_semi").groupBy("page_id", "node_id").agg(F.array_join(F.array_sort(F.collect_set("tag")), ",").alias("signature"))
    return items.join(met, ["page_id", "node_id"], "left").select("page_id", "node_id", F.coalesce("signature", F.lit("")).alias("signature"))


def typed(nodes: DataFrame, match_result: NodeMatch | None = None, match_parent: NodeMatch | None = None) -> DataFrame:
    """nodes with is_item and is_content: by tag, or by the examples of a record or of its container, which override tags."""
    if match_result is None and match_parent is None:
        return nodes.withColumns({"is_item": dom.is_tag("item"), "is_content": dom.is_tag("content")})

    def hits(match: NodeMatch) -> DataFrame:
        test = nodes.where("substr(tag, 1, 1) <> '#'")
        if match.text:
            test = test.join(whole_text(nodes, test).withColumnRenamed("text", "all_text"), ["page_id", "node_id"], "left")
            return test.where(match.column(F.col("all_text"))).select("page_id", "node_id", "parent_id")
        return test.where(match.column()).select("page_id", "node_id", "parent_id")

    def flag(found: DataFrame, name: str) -> DataFrame:
        return found.distinct().withColumn(name, F.lit(True))

    items = hits(match_result).select("page_id", "node_id") if match_result else None
    holders = hits(match_parent).select("page_id", "node_id") if match_parent else None
    if items is None:
        items = nodes.select("page_id", "node_id", F.col("parent_id").alias("up")).join(holders.withColumnRenamed("node_id", "up"), ["page_id", "up"], "left_semi").select("page_id", "node_id")
    if holders is None:
        holders = hits(match_result).where("parent_id >= 0").select("page_id", F.col("parent_id").alias("node_id"))
    out = nodes.join(flag(items, "is_item"), ["page_id", "node_id"], "left").join(flag(holders, "is_content"), ["page_id", "node_id"], "left")
    return out.withColumns({k: F.coalesce(k, F.lit(False)) for k in ("is_item", "is_content")})


#: Counters of a subtree, the node itself among them.
SUMS = "nodes fields images anchors text_anchors href_chars chars anchor_chars other_chars blocks content items formatting decoration".split()


#: Moduli and base of the digests of tag sequences, and the entries of a table of powers.
MODULI, BASE, POWERS = (2147483647, 2147483629), 1000003, 256


def _power(n: Column, modulus: int, base: int) -> Column:
    """base ** n modulo a 31-bit modulus, for n below 2 ** 32: one factor from a table for each byte of n."""
    out = F.lit(1).cast("long")
    for level in range(4):
        step = pow(base, POWERS**level, modulus)
        table = F.expr("array(" + ",".join(f"{pow(step, k, modulus)}L" for k in range(POWERS)) + ")")
        out = out * F.get(table, F.shiftright(n, 8 * level).bitwiseAND(POWERS - 1).cast("int")) % modulus
    return out


def tags_below(nodes: DataFrame) -> DataFrame:
    """page_id, node_id, tag: each tag once that a non-empty node at or below each node has.

    A tag's node is dealt to those of its ancestors alone that begin after the page's last node of that tag before it: the others hold that one already.
    """
    before = F.lag("node_id").over(Window.partitionBy("page_id", "tag").orderBy("node_id"))
    last = nodes.where(~dom.is_empty_node()).select("page_id", "node_id", "path", "tag").withColumn("last", F.coalesce(before, F.lit(-1)))
    return last.select("page_id", F.explode(F.filter(F.array_append("path", F.col("node_id")), lambda up: up > F.col("last"))).alias("node_id"), "tag")


def subtree_profile(nodes: DataFrame, tags: DataFrame | None = None) -> DataFrame:
    """page_id, node_id and the counters of every subtree, its root among them: SUMS, longest, deepest, n_tags, tag_mark (tells the set of tags), sequence (tells the tags in order).

    nodes come from :func:`typed`, tags from :func:`tags_below`. Empty nodes count for the depth alone. A text is an anchor's if the anchor lies in the subtree.
    Sums are differences of running sums over the page; what an anchor's texts add stands at the anchor. The sequence is a
    polynomial over the running number of non-empty nodes, under two moduli, shifted to the root's number. Only leaves are dealt to their ancestors, for the two maxima.
    """
    full = ~dom.is_empty_node()
    text = full & (F.col("tag") == "#text")
    chars = F.when(text, collapsed_length(F.col("text"))).otherwise(0)
    links = nodes.where("tag = 'a'").select("page_id", F.explode(F.sequence("node_id", "end_id")).alias("node_id"), F.col("node_id").alias("a"))
    near = links.groupBy("page_id", "node_id").agg(F.max("a").alias("anchor"))
    held = nodes.where(text).select("page_id", "node_id", chars.alias("size")).join(near, ["page_id", "node_id"])
    held = held.groupBy("page_id", F.col("anchor").alias("node_id")).agg(F.count("*").alias("linked"), F.sum("size").alias("linked_size"))
    measures = {
        "nodes": full,
        "fields": text & (chars > 0),
        "images": full & (F.col("tag") == "img"),
        "anchors": full & (F.col("tag") == "a"),
        "text_anchors": F.coalesce("linked", F.lit(0)),
        "href_chars": F.when(full & (F.col("tag") == "a"), F.length(F.coalesce(dom.attr("href"), F.lit("")))).otherwise(0),
        "chars": chars,
        "anchor_chars": F.coalesce("linked_size", F.lit(0)),
        "blocks": full & dom.is_tag("block"),
        "content": full & F.col("is_content"),
        "items": full & F.col("is_item"),
        "formatting": full & dom.is_tag("formatting"),
        "decoration": full & dom.is_tag("decoration"),
    }
    so_far = Window.partitionBy("page_id").orderBy("node_id").rowsBetween(Window.unboundedPreceding, 0)
    each = nodes.join(held, ["page_id", "node_id"], "left").select("page_id", "node_id", "end_id", full.alias("is_full"), F.xxhash64("tag").alias("code"), *[v.cast("long").alias(k) for k, v in measures.items()])
    each = each.withColumn("at", F.sum("nodes").over(so_far))
    for k, modulus in enumerate(MODULI):
        each = each.withColumn(f"s{k}", F.when(F.col("is_full"), F.pmod("code", F.lit(modulus)) * _power(F.col("at"), modulus, BASE) % modulus).otherwise(0))
    names = [*measures, "s0", "s1"]
    run = each.select("page_id", "node_id", "end_id", "at", *names, *[F.sum(k).over(so_far).alias(f"upto_{k}") for k in names])
    ends = run.select("page_id", F.col("node_id").alias("end_id"), *[F.col(f"upto_{k}").alias(f"end_{k}") for k in names])
    sums = run.join(ends, ["page_id", "end_id"]).select("page_id", "node_id", "at", *[(F.col(f"end_{k}") - F.col(f"upto_{k}") + F.col(k)).alias(k) for k in names])
    parts = [F.pmod(f"s{k}", F.lit(m)) * _power(F.col("at"), m, pow(BASE, -1, m)) % m for k, m in enumerate(MODULI)]
    sums = sums.withColumn("sequence", parts[0] * MODULI[0] + parts[1])
    most = nodes.where("node_id = end_id").select("page_id", F.explode(F.array_append("path", F.col("node_id"))).alias("node_id"), "depth", chars.alias("size"))
    most = most.groupBy("page_id", "node_id").agg(F.max("size").alias("longest"), F.max("depth").alias("deepest"))
    sets = (tags if tags is not None else tags_below(nodes)).groupBy("page_id", "node_id").agg(F.count("*").cast("int").alias("n_tags"), F.bit_xor(F.xxhash64("tag")).alias("tag_mark"))
    out = sums.join(most, ["page_id", "node_id"]).join(sets, ["page_id", "node_id"], "left")
    counts = [(F.col("chars") - F.col("anchor_chars") if k == "other_chars" else F.col(k)).cast("int").alias(k) for k in SUMS]
    return out.select("page_id", "node_id", *counts, "longest", "deepest", F.coalesce("n_tags", F.lit(0)).alias("n_tags"), F.coalesce("tag_mark", F.lit(0)).alias("tag_mark"), "sequence")


#: Children by kind, and what is measured over them (mean, deviation and skewness of each).
KINDS = "children items blocks decoration formatting content".split()
SPREADS = "anchor_chars anchors chars nodes fields levels longest other_chars html_len text_anchors".split()


def _features() -> dict[str, Column]:
    """The 156 features of a candidate by name, in the order that published nets expect.

    Columns: t_x is a counter over all that lies below, k_x counts its non-empty children, n is their number.
    Statistics are rounded to nine places before they are cut to thousandths, so that the order of sums makes no difference.
    """
    c = F.col
    n, ni, anchors, texts = c("n"), c("k_items"), c("t_anchors"), c("t_text_anchors")
    out = {k: c(f"t_{k}") for k in ("items", "blocks", "decoration", "formatting", "content")}
    out |= {f"{k}_per_child": ratio(v, n) for k, v in list(out.items())}
    out |= {f"child_{k}": c(f"k_{k}") for k in ("items", "blocks", "decoration", "formatting", "content")}
    out["child_length"] = F.floor("html_len_mean").cast("int")
    out |= {"fields": c("t_fields"), "text_items": c("k_text_items"), "images": c("t_images"), "anchors": anchors, "text_anchors": texts}
    out |= {"chars_per_field": ratio(c("t_chars"), F.greatest(c("t_fields"), F.lit(1))), "item_chars_per_text_item": ratio(c("item_chars"), F.greatest(c("k_text_items"), F.lit(1)))}
    out |= {"longest": c("t_longest"), "length": c("html_len"), "length_per_child": ratio(c("html_len"), n)}
    out["anchor_length"] = F.coalesce(F.floor(F.try_divide(c("t_href_chars"), anchors)), F.lit(0)).cast("int")
    out |= {"chars": c("t_chars"), "item_chars": c("item_chars"), "chars_per_child": ratio(c("t_chars"), n), "item_chars_per_item": ratio(c("item_chars"), ni)}
    out["other_chars"] = c("t_other_chars")
    out |= {f"other_chars_per_{k}": ratio(c("t_other_chars"), v) for k, v in {"child": n, "item": ni, "block": c("k_blocks"), "content": c("k_content"), "anchor": anchors, "text_anchor": texts}.items()}
    out |= {"anchor_chars": c("t_anchor_chars"), "item_anchor_chars": c("item_anchor_chars"), "item_anchor_chars_per_item": ratio(c("item_anchor_chars"), c("k_anchor_items"))}
    out |= {f"anchor_chars_per_{k}": ratio(c("t_anchor_chars"), v) for k, v in {"anchor": anchors, "text_anchor": texts, "child": n}.items()}
    out |= {"nodes": c("t_nodes"), "levels": c("t_levels"), "nodes_per_child": ratio(c("t_nodes"), n), "children_per_level": ratio(n, c("t_levels")), "siblings": c("siblings"), "children": n}
    out |= {"most_missing": c("most_missing"), "mean_missing": fixed_point(c("mean_missing")), "same_tag": truth(c("same_tag")), "same_tags": truth(c("same_tags")), "sequences": c("sequences")}
    counts = {"children": n, "child_items": ni, "child_blocks": c("k_blocks"), "child_content": c("k_content"), "anchors": anchors, "anchor_items": c("k_anchor_items"), "text_items": c("k_text_items"), "text_anchors": texts}
    for name, value in counts.items():
        out |= {f"{name}_by_10": divides(value, 10), f"{name}_by_5": divides(value, 5), f"{name}_to_10": distance_to_multiple(value, 10), f"{name}_to_5": distance_to_multiple(value, 5)}
    pairs = [("children", n, "anchors", anchors), ("child_items", ni, "anchors", anchors)]
    wide = [("children", n, "text_anchors", texts), ("child_items", ni, "text_anchors", texts)]
    for kind in ("anchor", "text", "anchor_text"):
        wide += [("children", n, f"{kind}_children", c(f"k_{kind}_children")), ("child_items", ni, f"{kind}_items", c(f"k_{kind}_items"))]
    for group in (pairs, wide):
        out |= {f"{a}_less_{b}": F.abs(x - y) for a, x, b, y in group}
        out |= {f"{a}_over_{b}": either_divides(x, y) for a, x, b, y in group}
        out |= {f"{a}_rest_{b}": smallest_rest(x, y) for a, x, b, y in group}
    out |= {f"{k}_children_less_items": F.abs(c(f"k_{k}_children") - c(f"k_{k}_items")) for k in ("anchor", "text", "anchor_text")}
    for k in (*SPREADS, "i_chars", "i_anchor_chars"):
        out |= {f"{k}_{stat}": fixed_point(F.round(c(f"{k}_{stat}"), 9)) for stat in ("skew", "stddev", "mean")}
    return out


@lru_cache(maxsize=1)
def feature_names() -> list[str]:
    """Names of the 156 features, in order: what the rank operators compare. Needs a running session."""
    return list(_features())


def candidate_features(nodes: DataFrame, match_result: NodeMatch | None = None, match_parent: NodeMatch | None = None) -> DataFrame:
    """page_id, node_id, end_id, features: an int vector for every non-empty content node with a non-empty child."""
    kinds = nodes if "is_item" in nodes.columns else typed(nodes, match_result, match_parent)
    kinds = staged(kinds.withColumn("full", ~dom.is_empty_node()), "typed")
    tags = staged(tags_below(kinds), "tags")
    profile = staged(subtree_profile(kinds, tags), "profile")
    kids = kinds.where("full and parent_id >= 0").join(profile, ["page_id", "node_id"]).withColumn("levels", F.col("deepest") - F.col("depth"))
    flags = {"block": dom.is_tag("block"), "decoration": dom.is_tag("decoration"), "formatting": dom.is_tag("formatting")}
    kids = kids.withColumns({"k_items": F.col("is_item"), "k_content": F.col("is_content"), "k_blocks": flags["block"], "k_decoration": flags["decoration"], "k_formatting": flags["formatting"]})
    length = F.when(F.col("tag") == "#text", collapsed_length(F.col("text"))).otherwise(F.col("html_len"))
    kids = kids.withColumn("html_len", length)
    linked, worded, item = F.col("anchors") > 0, F.col("fields") > 0, F.col("is_item")
    count = lambda test: F.sum(test.cast("int")).cast("int")
    spread = lambda name, value: [F.avg(value).alias(f"{name}_mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias(f"{name}_stddev"), skewness(value).alias(f"{name}_skew")]
    stats = [x for k in SPREADS for x in spread(k, F.col(k))]
    stats += spread("i_chars", F.when(item, F.col("chars"))) + spread("i_anchor_chars", F.when(item, F.col("anchor_chars")))
    by = kids.groupBy("page_id", F.col("parent_id").alias("node_id")).agg(
        F.count("*").cast("int").alias("n"),
        *[count(F.col(f"k_{k}")).alias(f"k_{k}") for k in KINDS[1:]],
        *[count(t).alias(f"k_{k}_children") for k, t in {"anchor": linked, "text": worded, "anchor_text": linked & worded}.items()],
        *[count(t & item).alias(f"k_{k}_items") for k, t in {"anchor": linked, "text": worded, "anchor_text": linked & worded}.items()],
        F.coalesce(F.sum(F.when(item, F.col("chars"))), F.lit(0)).cast("int").alias("item_chars"),
        F.coalesce(F.sum(F.when(item, F.col("anchor_chars"))), F.lit(0)).cast("int").alias("item_anchor_chars"),
        F.min("n_tags").alias("fewest_tags"),
        F.avg("n_tags").alias("mean_tags"),
        (F.min("tag_mark") == F.max("tag_mark")).alias("same_tags"),
        (F.min("tag") == F.max("tag")).alias("same_tag"),
        F.size(F.collect_set("sequence")).alias("sequences"),
        *stats,
    )
    # Tags at or below any of a candidate's non-empty children.
    over = tags.join(kinds.where("full and parent_id >= 0").select("page_id", "node_id", F.col("parent_id").alias("up")), ["page_id", "node_id"])
    over = over.select("page_id", F.col("up").alias("node_id"), "tag").distinct().groupBy("page_id", "node_id").agg(F.count("*").cast("int").alias("union_tags"))
    by = by.join(over, ["page_id", "node_id"])
    by = by.withColumns({"most_missing": F.col("union_tags") - F.col("fewest_tags"), "mean_missing": F.col("union_tags") - F.col("mean_tags")})
    beside = kinds.where("full").groupBy("page_id", F.col("parent_id").alias("up")).agg(F.count("*").cast("int").alias("siblings"))
    # What lies below is the subtree less its root, which is no text.
    own = {"nodes": F.lit(1), "images": (F.col("tag") == "img").cast("int"), "anchors": (F.col("tag") == "a").cast("int"), "href_chars": F.when(F.col("tag") == "a", F.length(F.coalesce(dom.attr("href"), F.lit("")))).otherwise(0)}
    own |= {k: t.cast("int") for k, t in {"blocks": flags["block"], "content": F.col("is_content"), "items": F.col("is_item"), "formatting": flags["formatting"], "decoration": flags["decoration"]}.items()}
    below = {f"t_{k}": (F.col(k) - own.get(k, F.lit(0))).cast("int") for k in SUMS}
    below |= {"t_longest": F.col("longest"), "t_levels": F.greatest(F.col("deepest") - F.col("depth") - 1, F.lit(0))}
    # Inside an anchor that holds the candidate nothing counts as linked; a candidate that is an anchor itself doesn't either.
    cands = kinds.where("full and is_content").withColumn("up", F.col("parent_id")).join(profile, ["page_id", "node_id"]).join(by, ["page_id", "node_id"]).join(beside, ["page_id", "up"])
    return cands.withColumns(below).select("page_id", "node_id", "end_id", F.array(*[v.cast("int") for v in _features().values()]).alias("features"))


#: Our own weights by voter (-1 is better: a positive weight favours small values); unlisted features weigh 0.
VOTERS = [
    {"anchors": -8, "children": -10, "same_tag": 12, "anchors_stddev": 6, "formatting": 1},
    {"children": -8, "same_tag": 10, "fields": -3, "chars_stddev": 4, "anchors": -9},
    {"items": -7, "same_tag": 9, "anchors_mean": -6, "chars_skew": 2, "levels": -2, "anchors": -6},
    {"anchors": -12, "same_tag": 8, "anchors_skew": 3, "children": -6, "images": 1},
]


def voter_weights(voter: dict[str, int] | Sequence[float] | Net) -> list[float] | Net:
    """Weights of all features, from a few by name or a whole list; a net as it is."""
    if isinstance(voter, Net):
        return voter
    return [float(voter.get(k, 0)) for k in feature_names()] if isinstance(voter, dict) else [float(w) for w in voter]
