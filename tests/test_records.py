"""The node table and record operators on small pages, and plain-Python cross-checks."""

import random

from pyspark.sql import functions as F

from tessera.operators import clean, features, fields, paging, rank
from tessera.plans.query import ExtractQuery, best_records
from tessera.sources.html import page_rows, parse_pages

PAGE = """<html><body><ul id=nav><li><a href="/n1">Home</a><li><a href="/n2">About</a></ul>
<ul id=results>{}</ul><!-- c --><script>var t="</ul>";</script><p>one<p>two<br></body></html>""".format(
    "".join(f'<li><a href="/r{i}">Result number {i} with a longer title</a> some words of summary {i}</li>' for i in range(8))
)


def pages(spark, *html):
    return spark.createDataFrame([(i, f"http://h.example/p{i}", h) for i, h in enumerate(html)], "page_id long, url string, html string")


def test_tree_fills_in_end_tags():
    rows = page_rows(PAGE)
    tags = [r[6] for r in rows]
    assert tags.count("p") == 2 and tags.count("li") == 10 and tags.count("script") == 1
    parents = {r[0]: r[2] for r in rows}
    lis = [r for r in rows if r[6] == "li"]
    assert all(rows[parents[r[0]]][6] == "ul" for r in lis)
    assert all(r[1] >= r[0] for r in rows)
    assert page_rows(None) == [] and page_rows("") == []


def test_subtree_counts_match_brute_force(spark):
    nodes = parse_pages(pages(spark, PAGE))
    rows = page_rows(PAGE)
    got = {r["node_id"]: r for r in features.subtree_counts(nodes).collect()}
    for r in rows:
        if r[6][0] != "#":
            below = rows[r[0] + 1 : r[1] + 1]
            assert got[r[0]]["n_nodes"] == len(below)
            assert got[r[0]]["n_anchors"] == sum(b[6] == "a" for b in below)


def test_best_records_take_the_result_list(spark):
    out = best_records(pages(spark, PAGE)).orderBy("pos").collect()
    assert [r["url"] for r in out] == [f"http://h.example/r{i}" for i in range(8)]
    few = best_records(pages(spark, PAGE), ExtractQuery(whitelist=("/r",), results=3)).collect()
    assert len(few) == 3


def test_tournament_agrees_with_python(spark):
    rnd = random.Random(3)
    rows = [(g, k, [float(rnd.randint(0, 30)), float(rnd.randint(0, 30))]) for g in range(5) for k in range(7)]
    df = spark.createDataFrame(rows, "g int, k int, features array<double>")
    better = rank.net(F.col("features"), F.col("o_features"), F.array(F.lit(1.0), F.lit(-2.0))) == -1
    got = {(r["g"], r["k"]) for r in rank.tournament(df, ["g"], "k", better).collect()}

    def cmp(a, b):
        return 0 if a > 0 and b > 0 and abs(a - b) / (a + b) < 0.125 else (a > b) - (a < b)

    def beats(x, y):
        return cmp(x[0], y[0]) - 2 * cmp(x[1], y[1]) < 0

    want = set()
    for g in range(5):
        mine = [(k, f) for h, k, f in rows if h == g]
        loss = {k: sum(1 for j, o in mine if j == k or not beats(f, o)) for k, f in mine}
        low = [(k, f) for k, f in mine if loss[k] == min(loss.values())]
        if len(low) == 1:
            want.add((g, low[0][0]))
        else:
            want |= {(g, k) for k, f in low if all(j == k or beats(f, o) for j, o in low)}
    assert got == want


def records(spark, rows):
    return spark.createDataFrame([(1, i, *r, None) for i, r in enumerate(rows)], "g int, pos long, url string, title string, summary string, date string")


def test_cleaning_rules(spark):
    def urls(df):
        return [r["url"] for r in df.orderBy("pos").collect()]

    rows = records(spark, [("a", "x", "s"), ("b", "y", "s"), ("a", "z", "s")])
    kept = clean.distinct_urls(rows, ["g"]).orderBy("pos").collect()
    assert [(r["pos"], r["title"]) for r in kept] == [(0, "z"), (1, "y")]
    mixed = records(spark, [("/r", "x", "s")] + [(f"http://h/{i}", "x", "s") for i in range(5)])
    assert "/r" not in urls(clean.drop_relative_minority(mixed, ["g"]))
    held = records(spark, [("http://h/", "x", "s"), ("http://h/1", "x", "s"), ("http://h/2", "x", "s")])
    assert urls(clean.drop_contained_urls(held, ["g"])) == ["http://h/1", "http://h/2"]
    affix = records(spark, [("a", "x", "By me: red car today"), ("b", "x", "By me: blue car today")])
    assert [r["summary"] for r in clean.strip_affixes(affix, ["g"]).orderBy("pos").collect()] == ["red", "blue"]
    pairs = records(spark, [(f"u{i}", "word" if i % 2 else "two words", f"s{i}") for i in range(8)])
    merged = clean.merge_alternating(pairs, ["g"]).orderBy("pos").collect()
    assert [r["summary"] for r in merged] == ["s0 s1", "s2 s3", "s4 s5", "s6 s7"]


def test_next_page_and_forms(spark):
    html = '<p><a href=a>1</a> <a href=b>2</a> <a href=c>3</a></p><form><label for=u>User</label><input id=u name=user type=text><input name=pw type=password><button>Go</button></form>'
    nodes = parse_pages(pages(spark, html, "<p><a href=x>Home</a> <a href=y>Next</a></p>"))
    found = fields.next_page(nodes, 1).join(nodes, ["page_id", "node_id"]).select("page_id", F.col("attrs.href").alias("href")).collect()
    assert {tuple(r) for r in found} == {(0, "b"), (1, "y")}
    controls = fields.form_controls(nodes)
    assert controls.where("name = 'user'").first()["label"] == "User"
    assert fields.login_pairs(controls).count() == 1 and fields.submit_control(controls).count() == 1


def test_dates_are_day_first_only_if_all_can_be(spark):
    rows = spark.createDataFrame([(1, "on 25/12/2014 x"), (1, "on 01/02/2015 x"), (2, "on 12/25/2014 x"), (2, "at 2014-03-04 y")], "g int, t string")
    out = {r["t"]: r["date"] for r in fields.dates(rows, ["g"], "t").collect()}
    assert out["on 25/12/2014 x"] == "2014-12-25" and out["on 01/02/2015 x"] == "2015-02-01"
    assert out["on 12/25/2014 x"] == "2014-12-25" and out["at 2014-03-04 y"] == "2014-03-04"


def test_repeated_page_stops(spark):
    rows = [(1, p, i, f"u{i + (p if p < 3 else 2) * 10}", "t", "s") for p in range(1, 5) for i in range(4)]
    df = spark.createDataFrame(rows, "g int, page_no int, pos int, url string, title string, summary string")
    assert {r["page_no"] for r in paging.stop_at_repeat(df, ["g"]).collect()} == {1, 2}


def test_pairs_of_few_groups_are_made_in_many_tasks(spark):
    rows = [(i, float(i % 9), i % 2) for i in range(400)] + [(400, 1.0, None), (401, None, 0)]
    left = spark.createDataFrame(rows, "a int, va double, g int")
    right = left.withColumnsRenamed({"a": "b", "va": "vb"})
    got = rank.pairs(left, right, "g")
    want = left.join(right, "g").select(*got.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    busy = {r["t"] for r in got.select(F.spark_partition_id().alias("t")).distinct().collect()}
    assert len(busy) > 2
