"""Node predicates and projections as native Columns over the ``nodes`` table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import is_blank, strip

#: Tag names by the part they play in a page.
BLOCK = """address article aside audio blockquote canvas dd div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6
header hgroup hr noscript ol output p pre section table tr tfoot ul video""".split()
PROXIMITY = [*BLOCK, "td"]
FORMATTING = """article h1 h2 h3 h4 h5 h6 header footer address p hr blockquote dt dd div a em strong small cite q dfn abbr time
var i b u mark bdi bdo span br wbr img video audio source track svg ol ul li dl table caption colgroup col tbody thead tfoot
tr td th section main""".split()
DECORATION = """abbr acronym address applet area aside b bdi bdo big blink br caption cite code data datalist em embed figcaption
figure font i img kbd label link map mark marquee meta meter nobr noframes noscript output param plaintext pre q rp rt ruby s
samp script small source spacer span strike strong style sub summary sup template #text time var video wbr""".split()
ITEM = "address article dd dt div p section table tr li td fieldset form h1 h2 h3 h4 h5 h6".split()
CONTENT = "p ol ul dl div colgroup tbody td section main form".split()

#: Classes by which a capture numbers nodes and marks hidden and filtered ones.
NODE_MARK, HIDDEN_MARK, FILTER_MARKS = r"fftheme_\d+_\d+", "xmoztheme", ("o2xtheme", "o2x2theme")

CLASSES = {"block": BLOCK, "proximity": PROXIMITY, "formatting": FORMATTING, "decoration": DECORATION, "item": ITEM, "content": CONTENT}


def is_tag(kind: str, tag: Column | str = "tag") -> Column:
    """Whether a tag name is of a class."""
    return F.lower(F.col(tag) if isinstance(tag, str) else tag).isin(CLASSES[kind])


def attr(name: str) -> Column:
    return F.try_element_at(F.col("attrs"), F.lit(name))


def is_hidden() -> Column:
    """A capture's mark, a hidden attribute or an inline style that hides; stands for a layout engine's answer."""
    return F.coalesce(F.coalesce(attr("class").contains(HIDDEN_MARK), F.lit(False)) | F.map_contains_key("attrs", "hidden") | attr("style").rlike(r"(?i)display\s*:\s*none|visibility\s*:\s*hidden"), F.lit(False))


def is_empty_node() -> Column:
    """Comments, scripts, styles, hidden and filtered nodes and blank text."""
    filtered = F.coalesce(attr("class").contains(FILTER_MARKS[0]), F.lit(False))
    return F.col("tag").isin("#comment", "#data", "style", "script") | is_hidden() | filtered | ((F.col("tag") == "#text") & is_blank(F.col("text")))


def first_url_attr() -> Column:
    """The first attribute value that holds ``://``."""
    return F.try_element_at(F.filter(F.map_values("attrs"), lambda v: v.contains("://")), F.lit(1))


@dataclass(frozen=True)
class NodeMatch:
    """A node by example: the id decides alone, then the name, else the fields given (any of them, or all)."""

    id: str | None = None
    name: str | None = None
    tag: str | None = None
    type: str | None = None
    value: str | None = None
    title: str | None = None
    alt: str | None = None
    href: str | None = None
    role: str | None = None
    text: str | None = None
    classes: tuple[str, ...] = ()
    any: bool = True

    def column(self, text: Column | None = None) -> Column:
        """Whether a node matches, case aside. ``text`` is an element's whole text, where ``self.text`` is asked for."""
        same = lambda c, wanted: F.coalesce(F.lower(c) == wanted.lower(), F.lit(False))
        if self.id:
            return same(attr("id"), self.id)
        if self.name:
            return same(attr("name"), self.name)
        tests = [same(attr(k), getattr(self, k)) for k in ("type", "value", "title", "alt", "href", "role") if getattr(self, k)]
        if self.tag:
            tests.append(same(F.col("tag"), self.tag))
        if self.text:
            tests.append(same(strip(F.col("text") if text is None else text), " ".join(self.text.split())))
        if self.classes:
            own = F.split(F.lower(F.coalesce(attr("class"), F.lit(""))), r"\s+")
            wanted = F.array(*[F.lit(c.lower()) for c in self.classes])
            # With all fields asked for, a node may have no class that isn't wanted.
            tests.append(F.arrays_overlap(own, wanted) if self.any else F.size(F.array_except(own, wanted)) == 0)
        out = F.lit(not self.any)
        for test in tests:
            out = out | test if self.any else out & test
        return out

    def score(self) -> Column:
        """Two for every field that agrees; a link that agrees in part counts less."""
        fields = [(attr(k), getattr(self, k)) for k in ("id", "name", "type", "value", "title", "alt", "role")]
        fields += [(F.lower("tag"), self.tag and self.tag.lower()), (strip(F.col("text")), self.text)]
        total = F.lit(0)
        for column, wanted in fields:
            if wanted:
                total = total + F.when(column == wanted, 2).otherwise(0)
        if self.href:
            total = total + F.when(attr("href") == self.href, 3).when(attr("href").endswith(self.href), 2).when(attr("href").contains(self.href), 1).otherwise(0)
        if self.classes:
            total = total + F.size(F.array_intersect(F.split(F.coalesce(attr("class"), F.lit("")), r"\s+"), F.array(*map(F.lit, self.classes))))
        return total
