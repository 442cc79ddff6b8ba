"""All registered queries and their SQL, from the modules beside this one."""

from __future__ import annotations

from tessera.plans.query import best_records
from tessera.queries import nodes, people, records, searches, text

QUERIES = {**text.QUERIES, **nodes.QUERIES, **records.QUERIES, **searches.QUERIES, **people.QUERIES}
ORACLES: dict[str, str] = {**text.ORACLES, **nodes.ORACLES, **records.ORACLES, **searches.ORACLES, **people.ORACLES}


def FLAGSHIP(spark, sf_dir):
    """Best records of every page."""
    return best_records(spark.read.parquet(f"{sf_dir}/pages.parquet"))
