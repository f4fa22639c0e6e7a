"""URL rules with redirect equivalence.

A page's own rule decides first. Pages without a rule take the decision of
their aliases: redirects (``<meta http-equiv=refresh>``) and canonical links
(``<link rel=canonical>``) link URLs, connected components of these links are
sets of aliases, and a component that holds an explicitly allowed page is
allowed, else one that holds an explicitly blocked page is blocked. Everything
else is allowed.

All canonical and refresh tags of a page count, of any length and with ``>`` in
quoted values; tags in comments, scripts and styles do not, and ``rel`` and
``http-equiv`` are the attributes of just these names (the first, if repeated).
Attribute values run to their closing quote, character references in them are
decoded, and a refresh target runs to the end of its content attribute (or to its
own closing quote). Tags are read by an Arrow function on pages that mention one.

Edge cases: a null URL or one without ``://`` has an empty host and path, fits
no rule and has no aliases; null or empty html has no links; repeated pages
are judged one by one; very long html is read whole; equally long rules: allow
first, then by text; an empty table gives an empty result; further columns
are not read, so clashing names do not matter.
"""

from __future__ import annotations

import html.entities
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tasklens.llm.common import LOWER, UPPER, ascii_lower, connected_components

Rule = tuple[str, str, str]     # host, path, verdict

#: Comments and the texts of scripts and styles, which hold no tags, or a link or
#: meta tag with its attributes; ``>`` in a quoted value does not end a tag.
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(?:script|style)\b.*?</(?:script|style)\s*>
                 |<(link|meta)(?=[\s/>])((?:[^>"']|"[^"]*"|'[^']*')*)>""", re.I | re.S | re.X)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
NODE = r"(?s)^(?>.*?://)([^/?#]+)/?([^#]*)"
NODE_OF = re.compile(NODE)
REFRESH_URL = re.compile(r"""\burl\s*=\s*(?:"\s*([^"]*?)\s*(?:"|\Z)|'\s*([^']*?)\s*(?:'|\Z)|([^\s"'].*?)\s*\Z)""", re.I | re.S)
SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*:")
FOLDER = re.compile(r"([^:/?#]*)(://[^/?#]*)?(/[^?#]*/)?", re.S)
REFERENCE = re.compile(r"&(?:#(?:[0-9]+|[xX][0-9a-fA-F]+);?|([A-Za-z][A-Za-z0-9]*)(;?)(=?))")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first ``://`` (A-Z lower-cased) and the path after it."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return (F.coalesce(ascii_lower(host), F.lit("")), F.coalesce(path, F.lit("")))


def rule_columns(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """(rule string, verdict) of the longest fitting rule, or nulls.

    ``rules`` is a driver-side list written down by a person; equally long
    rules: allow first, then by text.
    """
    order = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[2] != "allow", r[0] + r[1]))
    rule = verdict = F.lit(None).cast("string")
    for h, p, v in reversed(order):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, F.lit(h + p)).otherwise(rule)
        verdict = F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def url_node(url: Column) -> Column:
    """Identity of a URL for links: lower-cased host, path and query; the
    scheme and the fragment are left out. Null where there is no host."""
    host = F.regexp_extract(url, NODE, 1)
    return F.nullif(F.concat(ascii_lower(host), F.lit("/"), F.regexp_extract(url, NODE, 2)),
                    F.lit("/"))


def node_of(url: str) -> str | None:
    """``url_node`` of one URL."""
    m = NODE_OF.match(url)
    return m and m[1].translate(TO_LOWER) + "/" + m[2]


TO_LOWER = {ord(a): ord(b) for a, b in zip(UPPER, LOWER, strict=True)}


def resolved(target: str, url: str) -> str | None:
    """The absolute form of a link target found on the page ``url``."""
    scheme, root, folder = FOLDER.match(url).groups(default="")
    own = SCHEME.match(target)
    if own:
        return target if target.startswith("//", own.end()) else None
    if not target or target.startswith("#"):
        return None
    if target.startswith("//"):
        return f"{scheme}:{target}"
    if target.startswith("/"):
        return scheme + root + target
    return scheme + root + (folder or "/" if root else "/") + target


def decoded(value: str) -> str:
    """An attribute's value with its character references decoded. A name
    without ``;`` counts only where HTML has it so and no ``=`` follows."""

    def one(m: re.Match) -> str:
        name, end, sign = m.groups()
        if name is None:
            return html.unescape(m[0])
        if not end and sign:
            return m[0]
        return html.entities.html5.get(name + end, "&" + name + end) + sign

    return REFERENCE.sub(one, value)


def link_targets(text: str):
    """Targets of the canonical and refresh tags of a page."""
    for tag in TAG.finditer(text):
        if not tag[1]:
            continue
        have: dict[str, str] = {}
        for m in ATTRIBUTE.finditer(tag[2]):
            have.setdefault(m[1].lower(), decoded(m[2] or m[3] or m[4] or ""))
        if tag[1].lower() == "link":
            if "canonical" in have.get("rel", "").lower().split():
                yield have.get("href", "").strip()
        elif have.get("http-equiv", "").strip().lower() == "refresh":
            m = REFRESH_URL.search(have.get("content", ""))
            yield (m[1] or m[2] or m[3] or "") if m else have.get("url", "").strip()


def alias_edges(pages: DataFrame) -> DataFrame:
    """(a, b): URL nodes joined by a canonical link or a redirect."""

    @F.pandas_udf("array<string>")
    def linked(url: pd.Series, text: pd.Series) -> pd.Series:
        def nodes(u, t):
            goals = (resolved(x, u) for x in link_targets(t))
            return sorted({n for g in goals if g and (n := node_of(g))})
        return pd.Series([nodes(u, t) for u, t in zip(url, text, strict=True)])

    tags = pages.select("url", "html").filter(
        F.col("html").rlike(r"(?i)canonical|http-equiv") & F.col("url").isNotNull())
    found = tags.select("url", F.explode(linked("url", "html")).alias("b"))
    return found.select(url_node(F.col("url")).alias("a"), "b")


def url_verdicts(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """page_id, host, path, rule, verdict and ``reason`` (rule, alias or
    default) of every page."""
    labels = connected_components(alias_edges(pages))
    host, path = host_and_path(F.col("url"))
    judged = pages.select("page_id", host.alias("host"), path.alias("path"),
                          url_node(F.col("url")).alias("node"))
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    judged = judged.withColumns({"rule": rule, "own": verdict})
    linked = judged.filter("own IS NOT NULL").join(labels, "node")
    decided = linked.groupBy("component").agg(
        F.max(F.col("own") == "allow").alias("allowed"))
    alias = (labels.join(decided, "component")
             .select("node", F.when(F.col("allowed"), "allow").otherwise("block").alias("by_alias")))
    out = judged.join(alias, "node", "left")
    return out.select(
        "page_id", "host", "path", "rule",
        F.coalesce("own", "by_alias", F.lit("allow")).alias("verdict"),
        F.when(F.col("own").isNotNull(), "rule")
        .when(F.col("by_alias").isNotNull(), "alias").otherwise("default").alias("reason"))
