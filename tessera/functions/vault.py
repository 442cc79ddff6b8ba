"""Encrypted columns under versioned keys: the key's number stands beside the cipher text, and keys are a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Between the number of a key and what it hides; cipher texts are base64, so it stands in no other place.
MARK = "."


def key_of(text: Column) -> Column:
    """The number of the key that an encrypted value is under; null if it isn't such a value."""
    return F.when(text.rlike(rf"^[0-9]+[{MARK}]"), F.substring_index(text, MARK, 1)).cast("int")


def sealed(text: Column, key: Column, number: Column) -> Column:
    """A text (null stays null) under a key of 16, 24 or 32 bytes, with the key's number before it. GCM under a fresh vector: equal texts differ, a changed one fails."""
    hidden = F.base64(F.aes_encrypt(text.cast("binary"), key.cast("binary"), F.lit("GCM")))
    return F.when(text.isNotNull(), F.concat(number.cast("string"), F.lit(MARK), F.regexp_replace(hidden, r"\s", "")))


def opened(text: Column, key: Column) -> Column:
    """What sealed hid; null where the key is missing or another, or the value was changed."""
    return F.try_aes_decrypt(F.unbase64(F.substring_index(text, MARK, -1)), key.cast("binary"), F.lit("GCM")).cast("string")


def seal(rows: DataFrame, columns: Sequence[str], keys: DataFrame) -> DataFrame:
    """rows with columns under the newest of keys (number, key)."""
    newest = keys.agg(F.max_by(F.struct("number", "key"), "number").alias("newest"))
    return rows.crossJoin(F.broadcast(newest)).withColumns({c: sealed(F.col(c).cast("string"), F.col("newest.key"), F.col("newest.number")) for c in columns}).drop("newest")


def unseal(rows: DataFrame, columns: Sequence[str], keys: DataFrame) -> DataFrame:
    """rows with columns read under the key that each value names; a value under an unknown key, or changed, is null."""
    for c in columns:
        named = keys.select(F.col("number").alias("_number"), F.col("key").alias("_key"))
        rows = rows.join(named, key_of(F.col(c)) == F.col("_number"), "left").withColumn(c, opened(F.col(c), F.col("_key"))).drop("_number", "_key")
    return rows


def rotate(rows: DataFrame, columns: Sequence[str], keys: DataFrame) -> DataFrame:
    """rows with columns under the newest key: values under it already stay as they are, those under an unknown key, or changed, too."""
    newest = keys.agg(F.max_by(F.struct("number", "key"), "number").alias("newest"))
    rows = rows.crossJoin(F.broadcast(newest))
    for c in columns:
        named = keys.select(F.col("number").alias("_number"), F.col("key").alias("_key"))
        rows = rows.join(named, key_of(F.col(c)) == F.col("_number"), "left")
        plain = opened(F.col(c), F.col("_key"))
        old = (F.col("_number") < F.col("newest.number")) & plain.isNotNull()
        rows = rows.withColumn(c, F.when(old, sealed(plain, F.col("newest.key"), F.col("newest.number"))).otherwise(F.col(c))).drop("_number", "_key")
    return rows.drop("newest")
