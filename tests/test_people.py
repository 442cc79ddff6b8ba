"""Names, sign-in forms and versioned keys on hand-made rows."""

from pyspark.sql import functions as F

from tessera.functions import vault
from tessera.operators import fields, names
from tessera.sources.html import parse_pages

FIRST = [("Anna", True), ("Bob", True), ("Quill", False)]
LAST = ["SMITH", "Jones", "o'hara"]


def test_contact_names(spark):
    first = spark.createDataFrame(FIRST, "name string, popular boolean")
    last = spark.createDataFrame([(n,) for n in LAST], "name string")
    docs = {
        1: "Anna Smith wrote\nmail Quill Jones at q@x.org",  # the address's line tells
        2: "Anna Smith wrote\nmail q@x.org or call +1 800 555 1234 for Bob",  # a first name alone on the line
        3: "Anna Smith wrote\nmail q@x.org",  # the line tells nothing: the whole text, strictly
        4: "Quill Jones wrote, no address",  # not popular
        5: "Bob Jones here q@x.org\nand Anna Smith on 800-555-1234",  # two lines, two names; two in the text
        6: "Bob Jones here q@x.org\nBob Jones on 800-555-1234",
        7: "Anna. Smith, anna smith, Anna O'Hara",  # a mark keeps words apart
        8: None,
        9: "",
        10: "Anna Anna Smith q@x.org",
    }
    got = {r["doc_id"]: r["name"] for r in names.contacts(spark.createDataFrame([(*d, "clash") for d in docs.items()], "doc_id long, text string, name string"), "doc_id", "text", first, last).collect()}
    assert got == {1: "Quill Jones", 2: "Bob", 3: "Anna Smith", 4: None, 5: None, 6: "Bob Jones", 7: "Anna O'Hara", 8: None, 9: None, 10: "Anna Smith"}


def test_sign_in_forms(spark):
    form = "<form><input type=text name=u{0}><input type=password name=p{0}></form>"
    html = {
        1: form.format(1) + "<p>Welcome to us all</p>" * 5 + form.format(2) + "<a>Log in</a>",
        2: "<a>Sign-in</a>" + form.format(1) + "<p>Welcome to us all</p>" * 5 + form.format(2),
        3: form.format(1) + form.format(2),
        4: "<input type=password name=p1>",
        5: "<input type=text name=u1>",
        6: form.format(1) + "remember me" + "<p>.</p>" * 9 + form.format(2) + "<p>.</p>" * 40 + "logged in",
        7: None,
    }
    pages = spark.createDataFrame([(k, "http://h/", h) for k, h in html.items()], "page_id long, url string, html string")
    nodes = parse_pages(pages).cache()
    who = nodes.select("page_id", F.col("node_id").alias("n"), F.try_element_at("attrs", F.lit("name")).alias("name"))
    met = fields.login_of(nodes, pages).join(who, ["page_id"]).where("n = node_id or n = user_id").groupBy("page_id").agg(F.sort_array(F.collect_list("name")).alias("names"))
    assert {r["page_id"]: r["names"] for r in met.collect()} == {1: ["p2", "u2"], 2: ["p1", "u1"], 3: ["p1", "u1"], 4: ["p1"], 6: ["p1", "u1"]}


def test_keys_by_number(spark):
    keys = spark.createDataFrame([(1, "0123456789abcdef"), (2, "0123456789abcdef0123456789abcdef")], "number int, key string")
    rows = spark.createDataFrame([(1, "secret", 5), (2, None, 5), (3, "", 5), (4, "é" * 200, 5)], "k int, t string, number int")
    old = vault.seal(rows, ["t"], keys.where("number = 1")).collect()
    assert all(r["t"] is None or r["t"].startswith("1.") for r in old) and len({r["t"] for r in old}) == 4 and all(r["number"] == 5 for r in old)
    broken = [(r["k"], r["t"]) for r in old] + [(5, "1.AAAA"), (6, "not sealed"), (7, "9." + old[0]["t"][2:])]
    hidden = spark.createDataFrame(broken, "k int, t string")
    plain = {r["k"]: r["t"] for r in vault.unseal(hidden, ["t"], keys).collect()}
    assert plain == {1: "secret", 2: None, 3: "", 4: "é" * 200, 5: None, 6: None, 7: None}
    turned = {r["k"]: r["t"] for r in vault.rotate(hidden, ["t"], keys).collect()}
    assert all(turned[k].startswith("2.") for k in (1, 3, 4)) and turned[2] is None and [turned[k] for k in (5, 6, 7)] == [t for k, t in broken[4:]]
    again = spark.createDataFrame(list(turned.items()), "k int, t string")
    assert {r["k"]: r["t"] for r in vault.unseal(again, ["t"], keys).collect()} == plain
    assert {r["k"]: r["t"] for r in vault.rotate(again, ["t"], keys).collect()} == turned
