"""PII: information-theoretic sanitisation of whole texts, in DataFrame functions alone.

Four kinds of personal data are found by pattern; they are the protected entities. How strongly a
term reveals an entity is estimated from the corpus: the pointwise mutual information of the two,
over all documents, against the entity's own information content (as in Sanchez and Batet's
C-sanitised documents). A term anywhere in a document that holds an entity is

* generalised (a placeholder) where PMI(term; entity) >= ``generalise`` * IC(entity), and
* removed where it reaches ``remove`` * IC(entity),

if they occur together in ``support`` documents at least; then every occurrence in that document is
masked. Documents that hold a term, an entity or both are counted over whole texts, with partial
counts in each task before the shuffle. Entities that the same documents hold are one class, and so are
terms (told by their number and two 64-bit fingerprints of the documents): pairs are of classes, so a list of addresses that two texts share costs
as much as one address. Pairs are made only where the counts of the two alone do not
rule them out (they share at most as many documents as the rarer of them has).

Positions are code points. A null text is empty. Repeated rows count as documents of their own; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import written

#: The kinds and their patterns, written so that a match never backtracks: where the
#: class of the first run cannot be what follows it, a match starts at the run's start (or where the
#: last match ended), and runs are possessive.
KINDS = ("email", "ip", "card", "phone", "term")
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A cheap test that a text can hold the kind at all.
HINTS = {"email": "text like '%@%'", "ip": r"text rlike '[0-9]\\.[0-9]'", "card": r"text rlike '[0-9](?:[\\x20-]?[0-9]){13}'", "phone": r"text rlike '\\+[0-9]'"}
WORD = r"\p{L}{3,}"
GENERALISE = 0.9
REMOVE = 0.98
SUPPORT = 2
#: A key of more than this share of the documents is dealt over SALTS tasks when it is joined.
HOT = 1 / 500
SALTS = 32
#: Hot keys that may be sent to every task; where there are more, the join is left to Spark, which splits skewed partitions.
HOT_KEYS = 4096


def _matches(kind: str) -> Column:
    """array<struct<kind, i, gap, len, value>> of a text's matches, gaps before them."""
    found, gaps = F.regexp_extract_all("text", F.lit(PATTERNS[kind]), 0), F.split("text", PATTERNS[kind], -1)
    zipped = F.arrays_zip(found.alias("m"), gaps.alias("p"))
    each = F.transform(
        F.filter(zipped, lambda z: z["m"].isNotNull()),
        lambda z, i: F.struct(
            F.lit(KINDS.index(kind)).alias("kind"),
            i.alias("i"),
            F.length(z["p"]).alias("gap"),
            F.length(z["m"]).alias("len"),
            z["m"].alias("value"),
        ),
    )
    return F.when(F.expr(HINTS[kind]), each).otherwise(F.array().cast(_MATCH))


_MATCH = "array<struct<kind:int,i:int,gap:int,len:int,value:string>>"


def _valid() -> Column:
    """Whether a match passes its kind's test."""
    digits = F.regexp_replace("value", "[^0-9]", "")
    back = F.reverse(digits)
    digit = lambda i: F.substring(back, i, F.lit(1)).cast("int")
    luhn = F.aggregate(
        F.sequence(F.lit(1), F.length(digits)),
        F.lit(0),
        lambda a, i: a + F.when(i % 2 == 1, digit(i)).otherwise(digit(i) * 2 - F.when(digit(i) > 4, 9).otherwise(0)),
    )
    small = F.forall(F.split("value", r"\."), lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.right(p, F.lit(3)).cast("int") <= 255))
    return (
        F.when(F.col("kind") == 0, F.lit(True))
        .when(F.col("kind") == 1, small)
        .when(F.col("kind") == 2, F.length(digits).between(14, 19) & (luhn % 10 == 0))
        .otherwise(F.length(digits).between(10, 15))
    )


def numbered(docs: DataFrame, *carry: str) -> DataFrame:
    """rid (a number for each row), doc_id, text ('' for null) and carried columns."""
    more = [F.col(f"`{c}`").alias(f"carried_{c}") for c in carry]
    # Written, since a task that is run again, or a plan used twice, could number rows anew.
    return written(_numbers(docs, more), "rows")


def _numbers(docs: DataFrame, more: list[Column]) -> DataFrame:
    return docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def entities(rows: DataFrame) -> DataFrame:
    """rid, doc_id, kind, start, end, value of every protected entity; one row without kind for a text that has none."""
    found = rows.select("rid", "doc_id", F.explode_outer(F.concat(*[_matches(k) for k in KINDS[:4]])).alias("m")).select("rid", "doc_id", "m.*")
    order = Window.partitionBy("rid", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    placed = found.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(order)).withColumn("start", F.col("end") - F.col("len"))
    good = placed.withColumn("ok", F.col("kind").isNotNull() & _valid())
    keep = [F.when(F.col("ok"), F.col(c)).alias(c) for c in ("kind", "start", "end", "value")]
    return good.select("rid", "doc_id", *keep)


def _terms() -> Column:
    """The distinct terms of a text."""
    return F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(WORD), 0), F.lower))


def _places(texts: DataFrame, hits: DataFrame) -> DataFrame:
    """rid, start, end, removed of every occurrence of a text's terms among hits (rid, term, removed)."""
    words, gaps = F.regexp_extract_all("text", F.lit(WORD), 0), F.split("text", WORD, -1)
    zipped = F.filter(F.arrays_zip(words.alias("m"), gaps.alias("p")), lambda z: z["m"].isNotNull())
    each = texts.select("rid", F.posexplode(zipped).alias("i", "z"))
    upto = Window.partitionBy("rid").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.length("z.m") + F.length("z.p")).over(upto)
    placed = each.select("rid", F.lower("z.m").alias("term"), end.alias("end"), F.length("z.m").alias("n"))
    return placed.join(hits, ["rid", "term"]).select("rid", (F.col("end") - F.col("n")).alias("start"), "end", "removed")


def _dealt(left: DataFrame, right: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """left (with rid) joined with right on keys; size: the documents that a key has. Keys of many documents are salted, if they are few."""
    many = F.col(size) > total * HOT
    hot = written(right.where(many).select(*keys, F.lit(True).alias("hot")), "hot")
    if hot.count() > HOT_KEYS:
        return left.join(right, keys)
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("rid"), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))
    salts = F.when(many, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return left.join(F.broadcast(hot), keys, "left").withColumn("salt", salt).drop("hot").join(right.withColumn("salt", F.explode(salts)), [*keys, "salt"]).drop("salt")


def _classes(prefix: str) -> list[Column]:
    """Two fingerprints of the set of documents in a group."""
    return [F.bit_xor(F.xxhash64("rid", F.lit(seed))).alias(f"{prefix}{seed}") for seed in (1, 2)]


def revealing(rows: DataFrame, found: DataFrame, generalise: float = GENERALISE, remove: float = REMOVE, support: int = SUPPORT) -> DataFrame:
    """rid, start, end, removed of every occurrence of the terms that reveal an entity of the text."""
    total = rows.count()
    held = written(found.where("kind is not null").select("rid", F.concat_ws(":", "kind", F.lower("value")).alias("entity")).distinct(), "held")
    content = F.log(F.lit(float(total)) / F.col("n_entity"))
    alone = held.groupBy("entity").agg(F.count("*").alias("n_entity"), *_classes("e")).where((F.col("n_entity") >= support) & (content > 0))
    alone = written(alone, "alone")
    held = written(_dealt(held, alone, ["entity"], "n_entity", total).select("rid", "e1", "e2", "n_entity").distinct(), "held")
    counts = rows.select("rid", F.explode(_terms()).alias("term")).groupBy("term").agg(F.count("*").alias("n_term"), *_classes("t"))
    counts = written(counts.where(F.col("n_term") >= support), "terms")
    hinted = rows.where(F.expr(" or ".join(f"({h})" for h in HINTS.values())))
    texts = written(hinted.join(held.select("rid").distinct(), "rid", "left_semi").select("rid", "text"), "texts")
    terms = written(_dealt(texts.select("rid", F.explode(_terms()).alias("term")), counts, ["term"], "n_term", total), "own_terms")
    # The most that a pair can reach, where the rarer of the two never occurs without the other.
    most = F.log(F.lit(float(total)) / F.greatest("n_entity", "n_term"))
    pair = ["e1", "e2", "t1", "t2"]
    near = terms.select("rid", "t1", "t2", "n_term").distinct().join(held, "rid").where(most >= generalise * content - 1e-9)
    near = written(near.select("rid", *pair, "n_entity", "n_term"), "near")
    both = near.groupBy(*pair).agg(F.count("*").alias("n_both"), F.max("n_entity").alias("n_entity"), F.max("n_term").alias("n_term"))
    pmi = F.log(F.lit(float(total)) * F.col("n_both") / (F.col("n_entity") * F.col("n_term")))
    told = both.where(F.col("n_both") >= support).where(pmi >= generalise * content).select(*pair, "n_both", (pmi >= remove * content).alias("removed"))
    hits = _dealt(near.select("rid", *pair), written(told, "told"), pair, "n_both", total).groupBy("rid", "t1", "t2").agg(F.max("removed").alias("removed"))
    hits = written(terms.select("rid", "term", "t1", "t2").join(hits, ["rid", "t1", "t2"]).select("rid", "term", "removed"), "hits")
    return _places(texts.join(hits.select("rid").distinct(), "rid", "left_semi"), hits)


def _clear(terms: DataFrame, found: DataFrame) -> DataFrame:
    """The terms (rid, start, end, removed) that no base span of their text overlaps: a running maximum of the ends of base spans that begin before a term ends."""
    base = found.where("kind is not null").select("rid", "start", "end", F.lit(None).cast("boolean").alias("removed"), F.col("start").alias("at"), F.lit(1).alias("side"))
    both = terms.select("rid", "start", "end", "removed", F.col("end").alias("at"), F.lit(0).alias("side")).unionByName(base)
    before = Window.partitionBy("rid").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0)
    reach = F.max(F.when(F.col("side") == 1, F.col("end"))).over(before)
    return both.withColumn("reach", reach).where("side = 0 and coalesce(reach <= start, true)").select("rid", "start", "end", "removed")


def spans_of(rows: DataFrame, **limits: float) -> DataFrame:
    """For each rid, doc_id of numbered rows the arrays base and terms of struct(start, kind, end, removed), by start."""
    found = written(entities(rows), "entities")
    span = F.struct("start", "kind", "end", F.lit(False).alias("removed"))
    base = found.groupBy("rid", "doc_id").agg(F.array_sort(F.collect_list(F.when(F.col("kind").isNotNull(), span))).alias("base"))
    clear = _clear(revealing(rows, found, **limits), found)
    near = clear.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("start", F.lit(4).alias("kind"), "end", "removed"))).alias("terms"))
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint,removed:boolean>>")
    return base.join(written(near, "near"), "rid", "left").select("rid", "doc_id", "base", F.coalesce("terms", none).alias("terms"))


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def find_pii(docs: DataFrame, **limits: float) -> DataFrame:
    """doc_id, counts of each base kind, the digest of the base spans and all spans of docs (doc_id, text)."""
    spans = spans_of(numbered(docs), **limits)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return spans.select(
        "doc_id",
        *[count(k) for k in KINDS[:4]],
        F.sha2(_listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _listed(F.array_sort(F.concat("base", "terms"))).alias("spans"),
    )


def sanitise(docs: DataFrame, *carry: str, **limits: float) -> DataFrame:
    """doc_id, text and carried columns of docs, every entity and revealing term of text replaced by its kind in brackets, or taken out.

    Of spans that overlap, the first is replaced, and what the others reach beyond it goes too.
    """
    rows = numbered(docs, *carry)
    spans = spans_of(rows.select("rid", "doc_id", "text"), **limits)
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    each = spans.select("rid", F.explode(F.concat("base", "terms")).alias("s")).select("rid", "s.*")
    before = Window.partitionBy("rid").orderBy("start", "kind", "end", "removed").rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("at", F.coalesce(F.max("end").over(before), F.lit(0)))
    put = F.when(F.col("removed"), F.lit("")).otherwise(F.element_at(names, F.col("kind") + 1))
    piece = F.when(F.col("start") >= F.col("at"), F.struct(F.col("start").alias("to"), F.col("at").alias("from"), put.alias("put")))
    cut = each.groupBy("rid").agg(F.array_sort(F.collect_list(piece)).alias("cut"), F.max("end").alias("rest"))
    # Four bytes a character: a piece is found by its place, without reading what is before it.
    wide = rows.withColumn("wide", F.encode("text", "UTF-32"))
    joined = wide.join(written(cut, "cut"), "rid", "left")
    part = lambda begin, n: F.decode(F.substring(F.col("wide"), (begin * 4 + 1).cast("int"), (n * 4).cast("int")), "UTF-32")
    pieces = F.transform("cut", lambda p: F.concat(part(p["from"], p["to"] - p["from"]), p["put"]))
    tail = part(F.col("rest"), F.length("text") - F.col("rest"))
    text = F.when(F.col("cut").isNull(), F.col("text")).otherwise(F.concat(F.array_join(pieces, ""), tail))
    return joined.select("doc_id", text.alias("text"), *[F.col(f"carried_{c}").alias(c) for c in carry])


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns for every document."""
    return find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
