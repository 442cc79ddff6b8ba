"""Names of people: pairs of capitalised words, joined with tables of first and last names of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.fields import EMAIL, email_of, phone_of

#: A word, or a run of other marks that keeps two words apart.
TOKEN = r"[\p{L}'’-]+|[^\p{L}'’\s-]+"
CAPITAL = r"^\p{Lu}"


def _pairs(text: Column) -> Column:
    """array<struct<first, last>> of each capitalised word and the word after it, null where that isn't capitalised."""
    tokens = F.regexp_extract_all(text, F.lit(TOKEN), 0)
    both = F.arrays_zip(tokens.alias("first"), F.slice(tokens, 2, F.greatest(F.size(tokens), F.lit(1))).alias("last"))
    kept = F.filter(both, lambda p: p["first"].rlike(CAPITAL))
    return F.transform(kept, lambda p: F.struct(p["first"].alias("first"), F.when(p["last"].rlike(CAPITAL), p["last"]).alias("last")))


def names_in(lines: DataFrame, by: Sequence[str], first: DataFrame, last: DataFrame, strict: bool = False) -> DataFrame:
    """by, name: the one full name in each group of lines (by, text), or else its one first name without a last one.

    first: (name, popular); last: (name), in any case. Strictly, first names must be popular and a last name must follow. A
    group without such a name, or with several, has no row.
    """
    by = list(by)
    known = (first.where("popular") if strict else first).select(F.col("name").alias("first")).distinct()
    families = last.select(F.upper("name").alias("family")).distinct()
    met = lines.select(*by, F.explode(_pairs(F.col("text"))).alias("p")).select(*by, "p.first", "p.last").distinct().join(known, "first")
    met = met.join(families, F.upper("last") == F.col("family"), "left")
    full, alone = F.when(F.col("family").isNotNull(), F.concat_ws(" ", "first", "last")), F.when(F.col("family").isNull(), F.col("first"))
    told = met.groupBy(*by).agg(F.min(full).alias("a"), F.max(full).alias("b"), F.min(alone).alias("c"), F.max(alone).alias("d"))
    name = F.when(F.col("a") == F.col("b"), F.col("a"))
    name = name if strict else F.coalesce(name, F.when(F.col("c") == F.col("d"), F.col("c")))
    return told.select(*by, name.alias("name")).where("name is not null")


def contacts(docs: DataFrame, key: str, text: str, first: DataFrame, last: DataFrame) -> DataFrame:
    """key, name, email, phone of docs, whose keys differ.

    The name is the one that the line of the first address and the line of the first phone number tell, if they tell one; else the one that the whole
    text tells strictly. A null text has none of the three.
    """
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n")
    mail, call = F.get(F.filter(lines, lambda l: l.rlike(EMAIL)), F.lit(0)), F.get(F.filter(lines, lambda l: phone_of(l).isNotNull()), F.lit(0))
    near = docs.select(key, F.explode(F.array(F.struct(F.lit(0).alias("part"), mail.alias("text")), F.struct(F.lit(1).alias("part"), call.alias("text")))).alias("l"))
    near = names_in(near.select(key, "l.*").where("text is not null"), [key, "part"], first, last)
    near = near.groupBy(key).agg(F.min("name").alias("a"), F.max("name").alias("b")).where("a = b").select(key, F.col("a").alias("near"))
    whole = names_in(docs.select(key, F.col(text).alias("text")), [key], first, last, strict=True).withColumnRenamed("name", "whole")
    out = docs.select(key, email_of(F.col(text)).alias("email"), phone_of(F.col(text)).alias("phone"))
    return out.join(near, key, "left").join(whole, key, "left").select(key, F.coalesce("near", "whole").alias("name"), "email", "phone")
