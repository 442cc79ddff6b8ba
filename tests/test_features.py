"""Subtree profiles against plain Python, on made trees."""

import random

from pyspark.sql import functions as F

from tessera.functions import dom
from tessera.operators import features
from tessera.sources.html import parse_pages

RND = random.Random(6)
TAGS = "div p ul li a span b h2 table tr td img section style".split()


def tree(depth):
    tag = RND.choice(TAGS)
    if tag in ("style", "img"):
        return "<style>x</style>" if tag == "style" else "<img src=x>"
    more = f" href='/x{RND.randint(0, 99)}'" if tag == "a" else " hidden" if RND.random() < 0.05 else ""
    inside = "".join(tree(depth - 1) if depth and RND.random() < 0.8 else RND.choice(["text ", " ", "word word", "<!-- c -->"]) for _ in range(RND.randint(0, 4)))
    return f"<{tag}{more}>{inside}</{tag}>"


def test_profiles_against_plain_python(spark):
    rows = [(i, "http://h/", f"<body>{''.join(tree(4) for _ in range(4))}</body>") for i in range(25)] + [(98, "http://h/", ""), (99, "http://h/", None)]
    nodes = features.typed(parse_pages(spark.createDataFrame(rows, "page_id long, url string, html string"))).withColumn("full", ~dom.is_empty_node()).cache()
    got = {(r["page_id"], r["node_id"]): r for r in features.subtree_profile(nodes).collect()}
    pages = {}
    for r in nodes.orderBy("page_id", "node_id").collect():
        pages.setdefault(r["page_id"], []).append(r)
    marks, runs = {}, {}
    for page, all_ in pages.items():
        anchor = {r["node_id"]: max([a["node_id"] for a in all_ if a["tag"] == "a" and a["node_id"] <= r["node_id"] <= a["end_id"]], default=-1) for r in all_}
        for r in all_:
            below = [x for x in all_ if r["node_id"] <= x["node_id"] <= r["end_id"]]
            full = [x for x in below if x["full"]]
            texts = [x for x in full if x["tag"] == "#text"]
            linked = [x for x in texts if anchor[x["node_id"]] >= r["node_id"]]
            mine = got[page, r["node_id"]]
            assert (mine["nodes"], mine["text_anchors"], mine["images"]) == (len(full), len(linked), sum(x["tag"] == "img" for x in full))
            assert mine["deepest"] == max(x["depth"] for x in below) and mine["chars"] == mine["anchor_chars"] + mine["other_chars"]
            assert (mine["items"], mine["content"]) == (sum(x["is_item"] for x in full), sum(x["is_content"] for x in full))
            tags = frozenset(x["tag"] for x in full)
            assert mine["n_tags"] == len(tags) and marks.setdefault(tags, mine["tag_mark"]) == mine["tag_mark"]
            if r["full"]:
                assert runs.setdefault(tuple(x["tag"] for x in full), mine["sequence"]) == mine["sequence"]
    assert len(set(marks.values())) == len(marks) and len(set(runs.values())) == len(runs) > 50


def test_powers(spark):
    numbers = [0, 1, 255, 256, 65_537, 2**31, 2**32 - 1]
    df = spark.createDataFrame([(n,) for n in numbers], "n long")
    for m in features.MODULI:
        got = {r["n"]: r["p"] for r in df.select("n", features._power(F.col("n"), m, features.BASE).alias("p")).collect()}
        assert got == {n: pow(features.BASE, n, m) for n in numbers}
