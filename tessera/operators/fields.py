"""Field extraction: links, contacts, dates, form controls and next-page controls."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import dom
from tessera.functions.text import is_blank, strip
from tessera.functions.urls import absolute
from tessera.operators.dates import dates  # noqa: F401  (part of this module's surface)
from tessera.operators.nodes import whole_text

#: The patterns of contacts, dates, pager labels and search boxes.
EMAIL = r"[^&\"':><\s@]+@[^&\"':><\s@.]+\.[^&\"':><\s@]*[^&\"':><\s@.]"
PHONE = r"[-+().0-9\s]{8,20}[0-9]"
NEXT = r"(?iU)\b(?:next|older|下一页|التالية|suivant|weiter|अगला|avanti|次|следующая|siguiente)\b"
#: Our own list of looser labels, in several languages.
MORE = r"(?i)^\W*(?:(?:show|load|see|view) )?(?:more|older|earlier|further)\b|^\W*previous (?:posts?|page)\b|\b(?:mehr|plus|más|mais|altri|ещё|もっと見る|更多)\W*$"
PAGER_TEXT = 30
PAGER_TAGS = "a input button div li span footer".split()
PERMALINK = r"(?i)^(?:permanent\slink\sto\s|permalink\sto\s)"
SEARCH = r"(?iU)search|find|query|keyword|locate|google|results|(?:[-._\"/#\s]|^|\b)q(?:[-._\"/#\s]|$|\b)|搜索|بحث|Recherche|Chercher|Suche|खोज|Cerca|検索|Поиск|Buscar"
SEARCH_NEVER = r"(?iU)username|e-?mail|user|log\s?in|uname|city|state|zip|location"


def subtree_text(nodes: DataFrame, of: DataFrame) -> DataFrame:
    """page_id, node_id, text: the joined text below each node of ``of`` (page_id, node_id)."""
    return whole_text(nodes, of)


def links(nodes: DataFrame, pages: DataFrame) -> DataFrame:
    """page_id, node_id, pos, href, url (absolute), title of every anchor with href, in document order."""
    anchors = nodes.where("tag = 'a'").select("page_id", "node_id", "end_id", "parent_id", dom.attr("href").alias("href"), dom.attr("title").alias("hint")).where("href is not null")
    text = subtree_text(nodes, anchors)
    out = anchors.join(text, ["page_id", "node_id"], "left").join(pages.select("page_id", F.col("url").alias("base")), "page_id")
    title = F.regexp_replace(F.coalesce(F.when(~is_blank(F.col("text")), F.col("text")), F.col("hint"), F.lit("")), PERMALINK, "")
    pos = F.row_number().over(Window.partitionBy("page_id").orderBy("node_id"))
    return out.select("page_id", "node_id", "end_id", "parent_id", pos.alias("pos"), "href", absolute(F.col("href"), F.col("base")).alias("url"), title.alias("title"))


def email_of(text: Column) -> Column:
    """The first e-mail address, null if none."""
    return F.nullif(F.regexp_extract(text, EMAIL, 0), F.lit(""))


def phone_of(text: Column) -> Column:
    """The first run of phone characters with 7 to 15 digits, null if none."""
    runs = F.filter(F.regexp_extract_all(text, F.lit(PHONE), 0), lambda r: F.length(F.regexp_replace(r, "[^0-9]", "")).between(7, 15))
    return F.trim(F.try_element_at(runs, F.lit(1)))


def contacts(docs: DataFrame, key: str, text: str, names: Sequence[str] = ()) -> DataFrame:
    """key, name, email, phone. A name is the one capitalised pair of words that begins with a listed first name."""
    pairs = F.regexp_extract_all(text, F.lit(r"\b(\p{Lu}\p{Ll}+ \p{Lu}\p{Ll}+)\b"), 1)
    known = F.array_distinct(F.filter(pairs, lambda p: F.lower(F.substring_index(p, " ", 1)).isin([n.lower() for n in names] or [""])))
    name = F.when(F.size(known) == 1, F.try_element_at(known, F.lit(1)))
    return docs.select(key, name.alias("name"), email_of(F.col(text)).alias("email"), phone_of(F.col(text)).alias("phone"))


def form_controls(nodes: DataFrame) -> DataFrame:
    """page_id, node_id, tag, id, name, type, value, title, alt, role, multiple, label, options, option_labels, guid of inputs, buttons, text areas and selects."""
    controls = nodes.where(F.col("tag").isin("input", "button", "textarea", "select")).select(
        "page_id", "node_id", "end_id", "tag", *[dom.attr(a).alias(a) for a in ("id", "name", "type", "value", "title", "alt", "role", "multiple")]
    )
    label = nodes.where("tag = 'label'").select("page_id", "node_id", "end_id", dom.attr("for").alias("id")).where("id is not null")
    text = label.join(subtree_text(nodes, label), ["page_id", "node_id"]).groupBy("page_id", "id").agg(F.min_by("text", "node_id").alias("label"))
    choices = nodes.where("tag = 'option'").select("page_id", F.col("node_id").alias("o"), dom.attr("value").alias("v"), "path")
    shown = whole_text(nodes, choices.select("page_id", F.col("o").alias("node_id"))).select("page_id", F.col("node_id").alias("o"), F.col("text").alias("t"))
    options = choices.join(shown, ["page_id", "o"], "left").select("page_id", F.explode("path").alias("node_id"), F.struct("o", F.coalesce("v", "t").alias("v"), F.coalesce("t", F.lit("")).alias("t")).alias("c"))
    options = options.join(controls.where("tag = 'select'").select("page_id", "node_id"), ["page_id", "node_id"], "left_semi")
    lists = options.groupBy("page_id", "node_id").agg(F.array_sort(F.collect_list("c")).alias("c")).select("page_id", "node_id", F.transform("c", lambda x: x["v"]).alias("options"), F.transform("c", lambda x: x["t"]).alias("option_labels"))
    out = controls.join(text, ["page_id", "id"], "left").join(lists, ["page_id", "node_id"], "left").withColumn("guid", F.sha2("name", 256))
    return out.select("page_id", "node_id", "tag", "id", "name", "type", "value", "title", "alt", "role", "multiple", "label", "options", "option_labels", "guid")


def named_controls(controls: DataFrame) -> DataFrame:
    """Controls without a name go where over 75 % of a page's controls have one."""
    named = (~is_blank(F.col("name"))).cast("int")
    share = F.avg(named).over(Window.partitionBy("page_id"))
    return controls.withColumn("share", share).where((F.col("share") <= 0.75) | (named == 1)).drop("share")


def search_box(controls: DataFrame, strict: bool = True) -> DataFrame:
    """page_id, node_id of the likeliest search box of each page: first those whose names say search; strictly, none that says what isn't one."""
    words = F.concat_ws(" ", "id", "name", "label", "value")
    able = controls.where((F.col("tag") == "input") & F.coalesce(F.lower("type").isin("text", "search"), F.lit(True)))
    if strict:
        able = able.where(~words.rlike(SEARCH_NEVER))
    turn = F.row_number().over(Window.partitionBy("page_id").orderBy(F.when(words.rlike(SEARCH), 0).otherwise(1), "node_id"))
    return able.withColumn("turn", turn).where("turn = 1").select("page_id", "node_id")


def filled(controls: DataFrame, model: dict[str, list[str]]) -> DataFrame:
    """controls with ``entered`` (values that a form model, guid to values, puts in) and ``changed``.

    A select takes all values that are among its options, a text or search box the first one, a radio
    button its own value if the model names it, a check box any. ``guid`` is sha256 of the control's name.
    """
    pairs = F.create_map(*[x for k, v in model.items() for x in (F.lit(k), F.array(*map(F.lit, v)).cast("array<string>"))]) if model else F.create_map().cast("map<string,array<string>>")
    wanted = F.coalesce(F.try_element_at(pairs, F.coalesce("guid", F.lit(""))), F.array().cast("array<string>"))
    kind = F.lower(F.coalesce("type", F.lit("text")))
    entered = (
        F.when(F.col("tag") == "select", F.array_intersect(wanted, F.coalesce("options", F.array().cast("array<string>"))))
        .when((F.col("tag") == "input") & kind.isin("text", "search"), F.slice(wanted, 1, 1))
        .when((F.col("tag") == "input") & (kind == "radio"), F.when(F.lower(F.try_element_at(wanted, F.lit(1))) == F.lower("value"), F.array("value")))
        .when((F.col("tag") == "input") & (kind == "checkbox"), F.when(F.size(wanted) > 0, F.array(F.coalesce("value", F.lit("on")))))
    )
    out = controls.withColumn("entered", F.coalesce(entered, F.array().cast("array<string>")))
    held = F.when(F.col("value").isNotNull() & (F.col("value") != ""), F.array("value")).otherwise(F.array().cast("array<string>"))
    return out.withColumn("changed", (F.size("entered") > 0) & (F.col("entered") != held))


def form_predicate(model: dict[str, list[str]]) -> Column:
    """A form model over captured rows: each named column holds one of its values; an entry without values asks for nothing."""
    out = F.lit(True)
    for name, values in model.items():
        if values:
            out = out & F.coalesce(F.col(name).cast("string").isin(list(values)), F.lit(False))
    return out


def nearest_before(events: DataFrame, by: Sequence[str], order: str, is_anchor: Column, is_target: Column, value: str) -> DataFrame:
    """Targets with the value and place of the nearest earlier anchor of their group: an as-of join by one window."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    seen = F.last(F.when(is_anchor, F.struct(F.col(order).alias("at"), F.col(value).alias("value"))), ignorenulls=True).over(w)
    return events.withColumn("anchor", seen).withColumn("is_target", is_target).where("is_target").select(*by, order, F.col("anchor.at").alias("anchor_at"), F.col("anchor.value").alias("anchor_value"))


def login_pairs(controls: DataFrame) -> DataFrame:
    """page_id, node_id (a password box), user_id (the nearest text box before it)."""
    box = lambda kinds: (F.col("tag") == "input") & F.coalesce(F.col("type").isin(*kinds), F.lit("text" in kinds))
    found = nearest_before(controls, ["page_id"], "node_id", box(["text", "email"]), box(["password"]), "name")
    return found.select("page_id", "node_id", F.col("anchor_at").alias("user_id")).where("user_id is not null")


#: What says that a form near by is for signing in.
LOGIN_HINT = r"(?iU)log(?:ged)?\s?-?in|sign(?:ed)?\s?-?in|remember\s?me|tabindex\s?=\s?[^0-9]?[12][^0-9]"


def login_of(nodes: DataFrame, pages: DataFrame) -> DataFrame:
    """page_id, node_id, user_id: each page's password box for signing in, with the nearest text box before it (null if there is none).

    Of several, the one whose pair (half way between its boxes) is nearest to a hint in the page's source, before or after it; of equally near ones that of
    the earlier hint, then the earlier box; without hints the first. Pairs and hints are events in the order of the source: each hint
    looks at the last pair before it and the first one after it.
    """
    box = nodes.where("tag = 'input'").select("page_id", "node_id", "outer_start", F.lower(F.trim(dom.attr("type"))).alias("type")).where("type in ('text', 'password')")
    before = Window.partitionBy("page_id").orderBy("node_id").rowsBetween(Window.unboundedPreceding, -1)
    user = F.last(F.when(F.col("type") == "text", F.struct("node_id", "outer_start")), ignorenulls=True).over(before)
    pairs = box.withColumn("user", user).where("type = 'password'")
    half = F.coalesce(F.floor((F.col("user.outer_start") + F.col("outer_start")) / 2), F.lit(-1)).cast("int")
    pairs = pairs.select("page_id", "node_id", F.col("user.node_id").alias("user_id"), half.alias("at"))
    asked = pages.join(pairs.select("page_id").distinct(), "page_id", "left_semi")
    hits, gaps = F.regexp_extract_all("html", F.lit(LOGIN_HINT), 0), F.split("html", LOGIN_HINT, -1)
    zipped = F.filter(F.arrays_zip(hits.alias("m"), gaps.alias("p")), lambda z: z["m"].isNotNull())
    upto = Window.partitionBy("page_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    hints = asked.select("page_id", F.posexplode(zipped).alias("i", "z")).withColumn("end", F.sum(F.length("z.m") + F.length("z.p")).over(upto))
    hints = hints.select("page_id", (F.col("end") - F.length("z.m")).cast("int").alias("at"), F.lit(None).cast("struct<at: int, node_id: int, user_id: int>").alias("pair"))
    events = pairs.select("page_id", "at", F.struct("at", "node_id", "user_id").alias("pair")).unionByName(hints)
    order = Window.partitionBy("page_id").orderBy("at", F.col("pair").isNull(), "pair.node_id")
    left = F.last("pair", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    right = F.first("pair", ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))
    seen = events.withColumns({"l": left, "r": right}).where("pair is null").select("page_id", "at", F.explode(F.array("l", "r")).alias("p")).where("p is not null")
    near = seen.groupBy("page_id").agg(F.min(F.struct(F.abs(F.col("p.at") - F.col("at")).alias("far"), F.col("at"), F.col("p.node_id").alias("node_id"), F.col("p.user_id").alias("user_id"))).alias("n"))
    first = pairs.groupBy("page_id").agg(F.min(F.struct("node_id", "user_id")).alias("f"))
    met = first.join(near, "page_id", "left")
    return met.select("page_id", F.coalesce("n.node_id", "f.node_id").alias("node_id"), F.when(F.col("n").isNotNull(), F.col("n.user_id")).otherwise(F.col("f.user_id")).alias("user_id"))


def submit_control(controls: DataFrame) -> DataFrame:
    """page_id, node_id of the first submit control."""
    submit = controls.where(F.col("type").isin("submit", "image") | ((F.col("tag") == "button") & F.coalesce(F.col("type") == "submit", F.lit(True))))
    return submit.groupBy("page_id").agg(F.min("node_id").alias("node_id"))


#: Characters of the longest text that can be a page's number, with what stands around it.
NUMBER_TEXT = 12


def number_controls(nodes: DataFrame) -> DataFrame:
    """page_id, list_id, size, number, node_id: controls that show a page's number, by the list of counting children they stand in.

    ``size`` is how far the list's children count up one by one from its first number. A number must stand in
    one child of the list alone, and its control is the only element of its tag there (of several tags the first of ``PAGER_TAGS``).
    Which subtrees hold a number and nothing else is told by running sums, so no text is gathered for others.
    """
    text = F.when((F.col("tag") == "#text") & ~dom.is_empty_node(), F.trim("text"))
    order = Window.partitionBy("page_id").orderBy("node_id").rowsBetween(Window.unboundedPreceding, 0)
    n, odd = F.coalesce(F.length(text), F.lit(0)), F.coalesce((~text.rlike(r"^[\p{Punct}\s0-9]*$")).cast("int"), F.lit(0))
    run = nodes.select("page_id", "node_id", "end_id", "parent_id", "path", n.alias("n"), odd.alias("odd"), text.alias("t"))
    run = run.withColumns({"chars": F.sum("n").over(order), "odds": F.sum("odd").over(order)})
    ends = run.select("page_id", F.col("node_id").alias("end_id"), F.col("chars").alias("end_chars"), F.col("odds").alias("end_odds"))
    size = F.col("end_chars") - F.col("chars") + F.col("n")
    short = run.join(ends, ["page_id", "end_id"]).where(size.between(1, NUMBER_TEXT) & (F.col("end_odds") - F.col("odds") + F.col("odd") == 0))
    short = short.where("parent_id >= 0").select("page_id", "node_id", F.col("parent_id").alias("list_id"))
    words = run.where((F.col("n") > 0) & (F.col("odd") == 0) & (F.col("n") <= NUMBER_TEXT))
    words = words.select("page_id", F.explode(F.array_append("path", F.col("node_id"))).alias("up"), F.struct("node_id", "t").alias("w")).withColumnRenamed("up", "node_id")
    joined = words.join(short, ["page_id", "node_id"]).groupBy("page_id", "list_id", "node_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("w")), lambda w: w["t"]), "").alias("t"))
    shown = F.trim(F.regexp_replace("t", r"\p{Punct}", ""))
    kids = joined.withColumn("shown", shown).where(F.col("shown").rlike("^[0-9]{1,9}$")).withColumn("number", F.col("shown").cast("int"))
    counting = F.aggregate(
        F.transform(F.array_sort(F.collect_list(F.struct("node_id", "number"))), lambda k: k["number"]),
        F.struct(F.lit(None).cast("int").alias("last"), F.lit(0).alias("size")),
        lambda a, v: F.when(a["last"].isNull() | (v == a["last"] + 1), F.struct(v.alias("last"), (a["size"] + 1).alias("size"))).otherwise(a),
    )["size"]
    lists = kids.groupBy("page_id", "list_id").agg(counting.alias("size")).where("size > 1")
    alone = kids.withColumn("same", F.count("*").over(Window.partitionBy("page_id", "list_id", "shown"))).where("same = 1 and shown = cast(number as string)")
    targets = alone.join(lists, ["page_id", "list_id"]).select("page_id", "list_id", "size", "number", F.col("node_id").alias("kid"))
    able = nodes.where(F.col("tag").isin(PAGER_TAGS) & ~dom.is_empty_node())
    able = able.select("page_id", "node_id", "tag", F.explode(F.array_append("path", F.col("node_id"))).alias("kid"))
    only = able.join(targets, ["page_id", "kid"]).groupBy("page_id", "list_id", "size", "number", "tag").agg(F.count("*").alias("n"), F.min("node_id").alias("node_id")).where("n = 1")
    first = F.min_by("node_id", F.array_position(F.array(*map(F.lit, PAGER_TAGS)), F.col("tag")))
    return only.groupBy("page_id", "list_id", "size", "number").agg(first.alias("node_id"))


def _page_numbers(nodes: DataFrame, page_no: int | DataFrame) -> DataFrame:
    return page_no.select("page_id", "page_no") if isinstance(page_no, DataFrame) else nodes.select("page_id").distinct().withColumn("page_no", F.lit(page_no))


def next_by_number(nodes: DataFrame, page_no: int | DataFrame) -> DataFrame:
    """page_id, node_id, list_id of the control that shows the next page's number, in the list that counts furthest.

    ``page_no`` is that of all pages, or a table (page_id, page_no).
    """
    hit = number_controls(nodes).join(_page_numbers(nodes, page_no), "page_id").where(F.col("number") == F.col("page_no") + 1)
    return hit.groupBy("page_id").agg(F.min(F.struct(-F.col("size"), "list_id", "node_id")).alias("h")).select("page_id", "h.node_id", "h.list_id")


def label_controls(nodes: DataFrame) -> DataFrame:
    """page_id, node_id, rank, place, label of the controls whose text, then title, then looser text or title says next page.

    ``place`` orders those of one rank by tag; ``label`` is what says so, lower-cased and without punctuation.
    """
    controls = nodes.where(F.col("tag").isin(PAGER_TAGS))
    text = controls.select("page_id", "node_id", "end_id", "tag", F.coalesce(dom.attr("title"), dom.attr("alt"), dom.attr("value"), F.lit("")).alias("hint"))
    text = text.join(subtree_text(nodes, controls), ["page_id", "node_id"], "left").withColumn("text", F.coalesce("text", F.lit("")))
    short = F.length("text") < 30
    rank = F.when(short & F.col("text").rlike(NEXT), 0).when(F.col("hint").rlike(NEXT), 1).when(short & F.col("text").rlike(MORE), 2).when(F.col("hint").rlike(MORE), 3)
    place = F.array_position(F.array(*map(F.lit, PAGER_TAGS)), F.col("tag"))
    said = F.when(F.col("rank").isin(0, 2), F.col("text")).otherwise(F.col("hint"))
    label = F.lower(F.trim(F.regexp_replace(said, r"\p{Punct}|[»›]", "")))
    return text.withColumn("rank", rank).where("rank is not null").select("page_id", "node_id", "rank", place.alias("place"), label.alias("label"))


def next_by_label(nodes: DataFrame) -> DataFrame:
    """page_id, node_id, rank of the first of a page's label controls."""
    first = F.min(F.struct("rank", "place", "node_id")).alias("h")
    return label_controls(nodes).groupBy("page_id").agg(first).select("page_id", "h.node_id", "h.rank")


def control_links(nodes: DataFrame, controls: DataFrame) -> DataFrame:
    """page_id, node_id, href of each control (page_id, node_id) that has one: its own, that of the first link in it, or that of the nearest link around it."""
    usable = F.trim(dom.attr("href"))
    links = nodes.where((F.col("tag") == "a") & ~is_blank(usable) & ~usable.startswith("javascript:") & (usable != "#")).select("page_id", F.col("node_id").alias("a"), "path", usable.alias("href"))
    asked = controls.select("page_id", "node_id").distinct()
    inside = links.select("page_id", "a", "href", F.explode(F.array_append("path", F.col("a"))).alias("node_id")).join(asked, ["page_id", "node_id"])
    inside = inside.groupBy("page_id", "node_id").agg(F.min_by("href", "a").alias("inner"))
    around = nodes.join(asked, ["page_id", "node_id"], "left_semi").select("page_id", "node_id", F.explode("path").alias("a")).join(links.select("page_id", "a", "href"), ["page_id", "a"])
    around = around.groupBy("page_id", "node_id").agg(F.max_by("href", "a").alias("outer"))
    met = asked.join(inside, ["page_id", "node_id"], "left").join(around, ["page_id", "node_id"], "left")
    return met.select("page_id", "node_id", F.coalesce("inner", "outer").alias("href")).where("href is not null")


def is_removable(text: Column, reference: Column | None = None) -> Column:
    """Whether a pager's text is so short, and so near a reference pager's, that its node can go from the records."""
    bare = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"\s", "")
    short = F.length(bare(text)) < PAGER_TEXT
    if reference is None:
        return short & F.lit(True)
    return short & (F.levenshtein(bare(text), bare(reference)) < F.floor(F.length(bare(reference)) / 2))


def next_page(nodes: DataFrame, page_no: int | DataFrame) -> DataFrame:
    """page_id, node_id, holder_id of each page's control: by number, in the list ``holder_id``, else by label, alone."""
    number = next_by_number(nodes, page_no).withColumnRenamed("list_id", "holder_id")
    label = next_by_label(nodes).join(number, "page_id", "left_anti")
    return number.unionByName(label.select("page_id", "node_id", F.col("node_id").alias("holder_id")))
