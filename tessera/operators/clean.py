"""Cleaning of record groups: statistical rules over windows.

Records are rows with the group's columns, ``pos`` (their order) and url, title, summary, date.
Every rule is a window over the group or an aggregate of it, so all share one shuffle by group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import is_blank, trim_all
from tessera.functions.urls import is_relative

#: Thresholds of the rules, in characters, shares and standard deviations.
FIELD, AVERAGE, SHORT = 10, 60, 20
SHARE, HALF, OUTLIER = 0.4, 0.495, 4.0
MANY, FEW = 7, 2
BANNED = "[»«›‹]"
UNCOUNTED = r"(?i)[0-9.…]|(?:\b(?:first|prev|next|last|pages?)\b)"

Group = Sequence[str]


def _length(c: str) -> Column:
    return F.coalesce(F.length(trim_all(F.col(c))), F.lit(0))


def group_averages(df: DataFrame, by: Group) -> DataFrame:
    """avg_title and avg_summary: mean lengths over the group, null as 0."""
    w = Window.partitionBy(*by)
    return df.withColumn("avg_title", F.avg(_length("title")).over(w)).withColumn("avg_summary", F.avg(_length("summary")).over(w))


def swap_fields(df: DataFrame, by: Group) -> DataFrame:
    """Title and summary change places where titles are blank but summaries aren't, or titles are the longer ones.

    Records that carry ``prior_url`` and ``prior_title`` (the link that the present one displaced) change
    only if they have one, and go back to its url; the averages change in any case.
    """
    out = group_averages(df, by)
    swap = ((F.col("avg_title") < 1) & (F.col("avg_summary") > 1)) | ((F.col("avg_title") > F.col("avg_summary")) & (F.col("avg_summary") > FIELD))
    mine = swap
    if "prior_url" in df.columns:
        mine = swap & F.col("title").isNotNull() & F.col("prior_url").isNotNull() & F.col("prior_title").isNotNull()
        out = out.withColumn("url", F.when(mine, F.col("prior_url")).otherwise(F.col("url")))
    pick = lambda a, b, when: F.when(when, F.col(b)).otherwise(F.col(a))
    return out.withColumns({"title": pick("title", "summary", mine), "summary": pick("summary", "title", mine), "avg_title": pick("avg_title", "avg_summary", swap), "avg_summary": pick("avg_summary", "avg_title", swap)})


def use_alternates(df: DataFrame, by: Group) -> DataFrame:
    """url and title from alt_url and alt_title in groups where these already stand in more than half of the records."""
    n = F.count("*").over(Window.partitionBy(*by))
    is_alt = F.coalesce((F.col("url") == F.col("alt_url")) & F.col("title").eqNullSafe(F.col("alt_title")), F.lit(False))
    use = (F.sum(is_alt.cast("int")).over(Window.partitionBy(*by)) > F.floor(n / 2)) & ~is_blank(F.col("alt_url")) & ~is_blank(F.col("alt_title"))
    return df.withColumns({c: F.when(use, F.col(f"alt_{c}")).otherwise(F.col(c)) for c in ("url", "title")})


def fallback_titles(df: DataFrame, by: Group) -> DataFrame:
    """The fallback place of the best mean title length gives url and title, where it is longer than titles are on average, or in records whose title over a third shares and whose fallback fewer do.

    ``fallbacks`` is an array of url and title. A record without that place takes its longest fallback,
    if it has one that is longer than its title.
    """
    by = list(by)
    w = Window.partitionBy(*by)
    slots = df.where(F.col("title").isNotNull()).select(*by, F.posexplode("fallbacks").alias("slot", "f"))
    sums = slots.groupBy(*by, "slot").agg(F.sum(F.length(trim_all(F.col("f.title")))).alias("chars"))
    best = sums.groupBy(*by).agg(F.max(F.struct("chars", (-F.col("slot")).alias("turn"))).alias("b")).where("b.chars > 0").select(*by, F.col("b.chars").alias("chars"), (-F.col("b.turn")).alias("slot"))
    out = group_averages(df.drop("avg_title", "avg_summary"), by).withColumn("n", F.count("*").over(w)).join(best, by, "left")
    there = F.try_element_at("fallbacks", F.col("slot") + 1)
    longest = F.array_max(F.transform("fallbacks", lambda f: F.struct(F.length(f["title"]).alias("n"), f["url"].alias("url"), f["title"].alias("title"))))
    instead = F.when(longest["n"] >= F.coalesce(F.length("title"), F.lit(0)), F.struct(longest["url"].alias("url"), longest["title"].alias("title")))
    out = out.withColumn("fallback", F.when(F.col("slot").isNotNull(), F.coalesce(there, instead)))
    third = F.rint(F.col("n") / 3)
    out = out.withColumn("longer", F.coalesce(F.rint(F.col("chars") / F.col("n")) > F.rint("avg_title"), F.lit(False)))
    out = out.withColumn("crowded", F.count("*").over(Window.partitionBy(*by, "title")) > third)
    out = out.withColumn("again", F.sum(F.col("crowded").cast("int")).over(Window.partitionBy(*by, F.coalesce(there["title"], F.lit("")))))
    use = F.col("fallback").isNotNull() & (F.col("longer") | (F.col("crowded") & (F.col("again") < third)))
    out = out.withColumns({c: F.when(use, F.col(f"fallback.{c}")).otherwise(F.col(c)) for c in ("url", "title")})
    return out.drop("chars", "slot", "n", "fallback", "longer", "crowded", "again", "avg_title", "avg_summary")


def drop_short(df: DataFrame, by: Group) -> DataFrame:
    """In groups of long fields, records with a short title and summary go."""
    out = df if "avg_title" in df.columns else group_averages(df, by)
    long = (F.col("avg_summary") > AVERAGE) | (F.col("avg_title") > AVERAGE)
    summary = trim_all(F.regexp_replace(F.coalesce("summary", F.lit("")), UNCOUNTED, ""))
    short = (F.length(F.coalesce("title", F.lit(""))) < SHORT) & (F.length(summary) < SHORT)
    return out.where(~(long & short))


def distinct_urls(df: DataFrame, by: Group) -> DataFrame:
    """One record for each url: the last one, at the first one's place."""
    w = Window.partitionBy(*by, "url")
    out = df.withColumn("turn", F.row_number().over(w.orderBy(F.desc("pos")))).withColumn("first_pos", F.min("pos").over(w))
    return out.where("turn = 1").withColumn("pos", F.col("first_pos")).drop("turn", "first_pos")


def drop_repeated(df: DataFrame, by: Group) -> DataFrame:
    """Records whose title, summary and date make up over 40 % of their group go, unless all fields are short."""
    out = df if "avg_title" in df.columns else group_averages(df, by)
    n, same = F.count("*").over(Window.partitionBy(*by)), F.count("*").over(Window.partitionBy(*by, "title", "summary", "date"))
    heavy = ((F.col("avg_summary") > FIELD) | (F.col("avg_title") > FIELD)) & (same / n > SHARE)
    return out.withColumn("heavy", heavy).where(~F.col("heavy")).drop("heavy")


def _placed(df: DataFrame, by: Group) -> DataFrame:
    w = Window.partitionBy(*by)
    return df.withColumn("at", F.row_number().over(w.orderBy("pos"))).withColumn("n", F.count("*").over(w))


def trim_banned_edges(df: DataFrame, by: Group) -> DataFrame:
    """A first or last record with a pager's symbol goes, if no record between has one (groups over two)."""
    banned = F.coalesce(F.col("title").rlike(BANNED) | F.coalesce(F.col("summary").rlike(BANNED), F.lit(False)), F.coalesce(F.col("summary").rlike(BANNED), F.lit(False)))
    out = _placed(df, by).withColumn("banned", banned)
    edge = (F.col("at") == 1) | (F.col("at") == F.col("n"))
    inner = F.max(F.when(~edge, F.col("banned").cast("int")).otherwise(0)).over(Window.partitionBy(*by))
    out = out.withColumn("inner", inner)
    return out.where(~((F.col("n") > FEW) & (F.col("inner") == 0) & edge & F.col("banned"))).drop("at", "n", "banned", "inner")


def drop_relative_minority(df: DataFrame, by: Group) -> DataFrame:
    """Relative urls go where they are under 49.5 % of a group of more than two."""
    w = Window.partitionBy(*by)
    out = df.withColumn("relative", is_relative(F.col("url")))
    share = F.avg(F.col("relative").cast("int")).over(w)
    out = out.withColumn("few", (F.count("*").over(w) > FEW) & (share < HALF))
    return out.where(~(F.col("few") & F.col("relative"))).drop("relative", "few")


def drop_contained_urls(df: DataFrame, by: Group) -> DataFrame:
    """A url that is part of every other url of its group goes (groups over two).

    Only a url of the group's least length can be, and if two of that length differ neither is; so one
    text for each group is looked for in its urls.
    """
    w = Window.partitionBy(*by)
    out = df.withColumn("n", F.count("*").over(w)).withColumn("least", F.min(F.struct(F.length("url").alias("k"), F.col("url").alias("u"))).over(w))
    out = out.withColumn("held", F.min(F.coalesce(F.col("url").contains(F.col("least.u")), F.lit(False)).cast("int")).over(w))
    gone = (F.col("n") > FEW) & (F.col("held") == 1) & (F.col("url") == F.col("least.u"))
    return out.where(~F.coalesce(gone, F.lit(False))).drop("n", "least", "held")


def trim_empty_edges(df: DataFrame, by: Group) -> DataFrame:
    """Leading and trailing records without summary go where under 40 % of a group of more than two lack one."""
    w = Window.partitionBy(*by)
    out = df.withColumn("blank", is_blank(F.col("summary")))
    full = F.when(~F.col("blank"), F.col("pos"))
    out = out.withColumn("low", F.min(full).over(w)).withColumn("high", F.max(full).over(w))
    out = out.withColumn("few", (F.count("*").over(w) > FEW) & (F.avg(F.col("blank").cast("int")).over(w) < SHARE))
    return out.where(~(F.col("few") & ((F.col("pos") < F.col("low")) | (F.col("pos") > F.col("high"))))).drop("blank", "low", "high", "few")


def merge_alternating(df: DataFrame, by: Group) -> DataFrame:
    """In groups over seven where exactly every other record has a one-word title (or a # url), these merge into their neighbours.

    Their summary is appended and their date taken; the neighbour is the next record if the first one merges, else the one before.
    """
    w = Window.partitionBy(*by)
    out = _placed(df, by).withColumn("odd", F.col("at") % 2)
    word = F.coalesce(~F.col("title").contains(" "), F.lit(True))
    mark = F.coalesce(F.col("url").contains("#"), F.lit(False))

    def alternate(test: Column) -> Column:
        """Parity (1: first, third ...) of the records to merge, null if they don't alternate."""
        hit = F.sum(test.cast("int")).over(w)
        low, high = F.min(F.when(test, F.col("odd"))).over(w), F.max(F.when(test, F.col("odd"))).over(w)
        left, right = F.min(F.when(~test, F.col("odd"))).over(w), F.max(F.when(~test, F.col("odd"))).over(w)
        return F.when((F.col("n") > MANY) & (hit == F.floor(F.col("n") / 2)) & (low == high) & (left == right), low)

    out = out.withColumn("parity", F.coalesce(alternate(word), alternate(mark)))
    order = w.orderBy("at")
    near = lambda c: F.when(F.col("parity") == 1, F.lag(c).over(order)).when(F.col("parity") == 0, F.lead(c).over(order))
    out = out.withColumns({"near_summary": near("summary"), "near_date": near("date")}).where("parity is null or odd <> parity")
    summary = F.when(is_blank(F.col("near_summary")), F.col("summary")).otherwise(F.concat_ws(" ", "summary", "near_summary"))
    out = out.withColumn("summary", summary).withColumn("date", F.when(~is_blank(F.col("near_date")), F.col("near_date")).otherwise(F.col("date")))
    return out.drop("at", "n", "odd", "parity", "near_summary", "near_date")


def _common_prefix(low: Column, high: Column) -> Column:
    """Length of the common prefix of two texts, by halving."""
    same = lambda n: F.substring(low, F.lit(1), n) == F.substring(high, F.lit(1), n)
    span = F.least(F.length(low), F.length(high))
    zero = F.struct(F.lit(0).alias("a"), span.alias("b"))

    def halve(acc: Column, _: Column) -> Column:
        mid = F.floor((acc["a"] + acc["b"] + 1) / 2).cast("int")
        return F.when(acc["a"] >= acc["b"], acc).when(same(mid), F.struct(mid.alias("a"), acc["b"].alias("b"))).otherwise(F.struct(acc["a"].alias("a"), (mid - 1).alias("b")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(31)), zero, halve)["a"]


def strip_affixes(df: DataFrame, by: Group) -> DataFrame:
    """What all summaries of a group begin and end with goes, at a word border; not if any is blank.

    The least and the greatest of a group's texts share what all share.
    """
    w = Window.partitionBy(*by)

    def cut(frame: DataFrame, text: Column) -> DataFrame:
        frame = frame.withColumn("t", text).withColumn("blanks", F.max(is_blank(F.col("t")).cast("int")).over(w)).withColumn("n", F.count("*").over(w))
        frame = frame.withColumn("low", F.min("t").over(w)).withColumn("high", F.max("t").over(w))
        common = F.substring("low", F.lit(1), _common_prefix(F.col("low"), F.col("high")))
        border = F.length(F.regexp_extract(common, r"^(.*\s)", 1))
        return frame.withColumn("t", F.when((F.col("n") > 1) & (F.col("blanks") == 0), F.substring("t", border + 1, F.lit(1 << 30))).otherwise(F.col("t"))).drop("blanks", "n", "low", "high")

    out = cut(df, F.col("summary"))
    out = cut(out.withColumn("s", F.col("t")), F.reverse(F.col("t")))
    return out.withColumn("summary", F.reverse("t")).drop("t", "s")


def drop_outliers(df: DataFrame, by: Group, size: str = "size") -> DataFrame:
    """Rows whose size lies over four standard deviations above their group's mean go."""
    w = Window.partitionBy(*by)
    out = df.withColumn("z", F.try_divide(F.col(size) - F.avg(size).over(w), F.stddev_samp(size).over(w)))
    return out.where(F.coalesce(F.col("z") <= OUTLIER, F.lit(True))).drop("z")


def untrimmed(df: DataFrame, by: Group) -> DataFrame:
    """The rules that all records get: swap, alternates, fallbacks; with avg_title (as it is then) and avg_summary (as the swap left it)."""
    out = swap_fields(df, by)
    summary = out.select(*by, "pos", "avg_summary")
    if "alt_url" in out.columns:
        out = use_alternates(out, by)
    if "fallbacks" in out.columns:
        out = fallback_titles(out, by)
    out = out.drop("avg_title", "avg_summary").join(summary, [*by, "pos"])
    return out.withColumn("avg_title", F.avg(F.coalesce(F.length("title"), F.lit(0))).over(Window.partitionBy(*by)))


def trimmed(df: DataFrame, by: Group, size: str = "size") -> DataFrame:
    """The rules that may drop records, in their order, of untrimmed ones; averages are not taken anew, outliers by size go last."""
    for rule in (drop_short, distinct_urls, drop_repeated):
        df = rule(df, by)
    df = df.drop("avg_title", "avg_summary")
    for rule in (trim_banned_edges, drop_relative_minority, drop_contained_urls, trim_empty_edges, merge_alternating, strip_affixes):
        df = rule(df, by)
    return drop_outliers(df, by, size)


def clean(df: DataFrame, by: Group) -> DataFrame:
    """All rules in their order."""
    return trimmed(untrimmed(df, by), by)
