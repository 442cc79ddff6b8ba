"""URL functions as native Columns: validity, absolute and canonical forms, rewriting, filters."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import is_blank

_CUT = r"[?#&].*$"


def is_valid(url: Column) -> Column:
    return F.coalesce(~is_blank(url) & url.rlike("^https?://"), F.lit(False))


def is_relative(url: Column) -> Column:
    return F.coalesce(~(url.startswith("//") | url.contains("://")), F.lit(True))


def origin(base: Column) -> Column:
    """Scheme and host of a page's URL, with a slash; the URL is cut at ? # &."""
    cut = F.regexp_replace(base, _CUT, "")
    return F.concat(F.regexp_extract(cut, r"^((?:.*?://)?[^/]*)", 1), F.lit("/"))


def folder(base: Column) -> Column:
    """A page's URL up to its last slash; the URL is cut at ? # &."""
    cut = F.regexp_replace(base, _CUT, "")
    return F.when(cut.contains("/"), F.regexp_extract(cut, "^(.*/)", 1)).otherwise(F.concat(cut, F.lit("/")))


def absolute(href: Column, base: Column) -> Column:
    """href as an absolute URL on the page base; without a usable base, or blank, as it is."""
    local = "http://localhost/"
    moved = (
        F.when(is_blank(href), href)
        .when(href.startswith("//"), F.concat(F.when(base.startswith("https:"), "https:").otherwise("http:"), href))
        .when(href.startswith(local), F.concat(origin(base), F.substring(href, len(local), 1 << 30)))
        .when(href.startswith("/"), F.concat(origin(base), F.substring(href, 2, 1 << 30)))
        .when(~href.contains("://"), F.concat(folder(base), href))
        .otherwise(href)
    )
    return F.when(base.isNull() | ~base.contains("/"), href).otherwise(moved)


def canonical_base(url: Column, relative: bool = False) -> Column:
    """``//host`` (or ``//host/folder/``) of a URL cut at ? # &."""
    bare = F.regexp_replace(F.regexp_replace(url, _CUT, ""), "^[A-Za-z0-9]*:?(?://)?", "")
    if not relative:
        return F.concat(F.lit("//"), F.regexp_extract(bare, "^[^/]*", 0))
    kept = F.when(bare.contains("/"), F.regexp_extract(bare, "^(.*/)", 1)).otherwise(F.concat(bare, F.lit("/")))
    return F.concat(F.lit("//"), kept)


def canonical(href: Column, base: Column) -> Column:
    """href relative to base without a scheme of its own."""
    own = href.rlike("^[A-Za-z0-9]*:")
    return (
        F.when(href.startswith("//"), href)
        .when(href.startswith("/"), F.concat(canonical_base(base), href))
        .when(~own, F.concat(canonical_base(base, True), href))
        .otherwise(href)
    )


def cached(url: Column, suffix: str, prefix: str = "") -> Column:
    """The URL under a cache host: host plus suffix, or a prefix before the whole."""
    rest = F.substring_index(url, "://", -1)
    if prefix:
        return F.concat(F.lit(prefix), rest)
    return F.concat(F.lit("http://"), F.substring_index(rest, "/", 1), F.lit(suffix), F.lit("/"), F.regexp_extract(rest, "^[^/]*/(.*)$", 1))


@dataclass(frozen=True)
class UrlRule:
    """A rewrite: the first match is replaced, or all, or all until nothing changes."""

    regex: str
    replacement: str
    replace_all: bool = False
    recursive: bool = False
    go_on: bool = False
    export_only: bool = False


def _replace(c: Column, rule: UrlRule) -> Column:
    pattern = "(?i)" + rule.regex
    if rule.replace_all and rule.recursive:
        # Until nothing changes. A text that doesn't grow settles within as many rounds as it has characters;
        # a rule that keeps on growing it would never end, and stops where the text is eight times as long.
        def again(acc: Column, _: Column) -> Column:
            new = F.regexp_replace(acc["now"], pattern, rule.replacement)
            end = acc["end"] | (new == acc["now"]) | (F.length(new) > 8 * F.length(c) + 64)
            return F.struct(F.when(acc["end"], acc["now"]).otherwise(new).alias("now"), end.alias("end"))

        start = F.struct(c.alias("now"), F.lit(False).alias("end"))
        return F.aggregate(F.sequence(F.lit(0), F.length(c) + 1), start, again, lambda acc: acc["now"])
    if rule.replace_all:
        return F.regexp_replace(c, pattern, rule.replacement)
    # The first match only: what comes before it is matched reluctantly and kept; groups move by one.
    moved = re.sub(r"\$(\d)", lambda m: f"${int(m[1]) + 1}", rule.replacement)
    return F.regexp_replace(c, f"(?is)^(.*?)(?:{rule.regex})", "$1" + moved)


def rewrite(url: Column, rules: list[UrlRule], export: bool = False) -> Column:
    """The rules of a phase in order; the first that matches ends the chain unless it says to go on."""
    result, ended = url, F.lit(False)
    for rule in rules:
        if rule.export_only != export or not rule.regex:
            continue
        hit = ~ended & F.coalesce(result.rlike("(?i)" + rule.regex), F.lit(False))
        result, ended = F.when(hit, _replace(result, rule)).otherwise(result), ended | (hit if not rule.go_on else F.lit(False))
    return result


def node_passes(url: Column, whitelist: tuple[str, ...] = (), patterns: tuple[str, ...] = (), matches: tuple = ()) -> Column:
    """As :func:`passes`, or where the link's node is like one of the given examples (node predicates over its columns)."""
    if not matches:
        return passes(url, whitelist, patterns)
    hit = F.lit(False)
    for match in matches:
        hit = hit | match.column()
    return hit | (passes(url, whitelist, patterns) if whitelist or patterns else F.lit(False))


def passes(url: Column, whitelist: tuple[str, ...] = (), patterns: tuple[str, ...] = ()) -> Column:
    """Keeps a URL that holds a whitelisted text or matches a pattern wholly, case aside; without filters, all."""
    if not whitelist and not patterns:
        return F.lit(True)
    test = F.lit(False)
    for text in whitelist:
        test = test | F.lower(url).contains(text.lower())
    for pattern in patterns:
        test = test | url.rlike(f"(?i)^(?:{pattern})$")
    return F.coalesce(~is_blank(url) & test, F.lit(False))
