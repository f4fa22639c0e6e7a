import itertools
import random
import re
from functools import lru_cache

import pytest
from llm_cases import messy_documents, words

from tasklens.llm import chat_format as C
from tasklens.llm import license_scan as L
from tasklens.llm.queries import URL_RULES
from tasklens.llm.url_filters import url_verdicts


def test_url_rules_and_aliases(spark):
    link = '<link rel="canonical" href="%s">'
    rows = [
        (1, "http://a.example.net/fr/1", "x"), (2, "https://b.example.net/de/2#t", link % "http://a.example.net/fr/1"),
        (3, "http://c.org/x/y?z", "<LINK href='b' rel=canonical>"),
        (4, "http://c.org/q", '<meta http-equiv="refresh" content="0; url=https://b.example.net/de/2">'),
        (5, None, link % "/x"), (6, "nourl", ""), (7, "http://www.example.com/en/a", link % "//c.org/q2"),
        (8, "http://c.org/q2", None), (9, "http://blog.example.com/en/", ""), (10, "HTTP://X.Com", ""),
        (11, "http://c.org/x/b", "x"), (11, "http://c.org/x/b", "x"), (None, "://", None),
        (12, "ftp://h.NET/es/?/fr/#://x", ""), (13, "http://d.org/r", link % "http://c.org/q2"),
        (14, "http://e.net/fr/s", link % "http://c.org/q2")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, node string")
    got = {r.page_id: r for r in url_verdicts(df, URL_RULES).collect()}
    want = {1: ("net/fr/", "block"), 2: (None, "block"), 3: (None, "allow"), 4: (None, "block"), 5: (None, "allow"),
            6: (None, "allow"), 7: ("www.example.com/en/", "allow"), 8: (None, "allow"),
            9: ("example.com/en/", "block"), 10: (None, "allow"), 11: (None, "allow"), None: (None, "allow"),
            12: ("net/es/", "block"), 13: (None, "allow"), 14: ("net/fr/", "block")}
    assert {k: (r.rule, r.verdict) for k, r in got.items()} == want
    assert (got[10].host, got[10].path) == ("x.com", "") and (got[5].host, got[5].path) == ("", "")
    assert (got[12].host, got[12].path) == ("h.net", "/es/")
    assert url_verdicts(df, URL_RULES).count() == len(rows)
    assert url_verdicts(df.limit(0), URL_RULES).collect() == []


def test_all_tags_and_escaped_targets(spark):
    link, meta = '<link rel="canonical" href="%s">', '<meta http-equiv="refresh" content="0; url=%s">'
    bad = "http://b.net/fr/"                 # blocked by its own rule; no page of o.org has a rule
    rows = [
        (1, bad + "1?a=1&b=2", ""), (2, "http://o.org/2", meta % (bad + "1?a=1&amp;b=2")),
        (3, "http://o.org/3", link % "http://o.org/none" + link % (bad + "1?a=1&#38;b=2")),
        (4, bad + "4;v=1", ""), (5, "http://o.org/5", meta % "http://o.org/none2" + meta % (bad + "4;v=1")),
        (6, bad + "6?a=1&copy=2", ""), (7, "http://o.org/7", link % (bad + "6?a=1&copy=2")),
        (8, "http://o.org/8", "<META content='5;URL=\"" + bad + "4;v=1\" ' http-equiv=refresh>"),
        (9, "http://o.org/9", meta % ("&quot;" + bad + "4;v=1&quot;")),
        (10, "http://o.org/10", "<meta http-equiv=refresh content=0;url=" + bad + "4;v=1>"),
        (11, "http://o.org/11", meta % (bad + "4")), (12, "http://o.org/12", "<meta http-equiv=refresh content=5>"),
        (13, "http://o.org/13", "<meta http-equiv=refresh content=0; url=" + bad + "4;v=1>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.verdict for r in url_verdicts(df, URL_RULES).collect()}
    assert {i for i, v in got.items() if v == "allow"} == {11, 12}


def test_references_in_attributes():
    from tasklens.llm.url_filters import decoded
    for raw, want in (("a&amp;b", "a&b"), ("a&ampb", "a&ampb"), ("a&amp", "a&"), ("?x&lt=1", "?x&lt=1"),
                      ("&#x26;&#38;", "&&"), ("&eacute;=1", "é=1"), ("&none;", "&none;"), ("&&amp;", "&&")):
        assert decoded(raw) == want


def cheapest(roles):
    """Least cost by trying everything."""
    @lru_cache(None)
    def go(i, s, room):
        if i == len(roles):
            if s == C.FINAL or not roles:
                return 0
            return min((C.INSERT + go(i, n, room - 1) for n in C.NEXT[s]), default=99) if room else 99
        out = [C.INSERT + go(i, n, room - 1) for n in C.NEXT[s]] if room else [99]
        for o in (C.SYSTEM, C.USER, C.ASSISTANT):
            base = C.RELABEL * (roles[i] != o)
            if o in C.NEXT[s]:
                out.append(base + go(i + 1, o, room))
            if o == s:
                out.append(base + C.MERGE + go(i + 1, o, room))
        return min(out)
    return go(0, C.START, 4)


def cost(roles, new):
    s = total = 0
    for r, o in zip(roles, new, strict=True):
        total, s = total + C.COST[r][s][o], o
    return total + C.END_COST[s]


def test_repair_is_cheapest():
    for n in range(5):
        for roles in itertools.product(range(4), repeat=n):
            assert cost(roles, C.repair(list(roles))) == cheapest(roles)


def test_ranges_of_a_conversation_fit_together():
    r = random.Random(1)
    for _ in range(200):
        roles = [r.randrange(4) for _ in range(r.randrange(2, 30))]
        cuts = sorted(r.sample(range(1, len(roles)), min(len(roles) - 1, 3)))
        parts = [roles[a:b] for a, b in zip([0, *cuts], [*cuts, len(roles)], strict=True)]
        new = []
        for p, (s, e) in zip(parts, C.borders([C.product(p) for p in parts]), strict=True):
            new += C.repair(p, s, e)
        assert cost(roles, new) == cost(roles, C.repair(roles))


def test_rendered_chats(spark):
    r = random.Random(2)
    hot = [(9, i, r.choice(["user", "assistant", "system", "tool"]), str(i)) for i in range(1500)]
    rows = [(1, 1, "User ", "hi"), (1, 2, "user", "x"), (1, 3, None, "y"), (1, 4, "assistant", None),
            (2, 5, "assistant", "a"), (None, 1, "system", "s"), (None, None, "user", "late"),
            (3, 1, "system", "a"), (3, 1, "system", "a"), *hot]
    df = spark.createDataFrame([(*x, 1) for x in rows], "conv_id long, turn long, role string, text string, place int")
    out = C.format_chats(df.repartition(3)).toPandas().sort_values(["place", "sub"])
    text = {None if k != k else int(k): "".join(g.segment) for k, g in out.groupby("conv_id", dropna=False)}
    assert text[1] == "<|user|>\nhi\nx\ny<|end|>\n<|assistant|>\n<|end|>\n"
    assert text[2] == "<|user|>\n<|end|>\n<|assistant|>\na<|end|>\n"
    assert text[3] == "<|system|>\na\na<|end|>\n<|user|>\n<|end|>\n<|assistant|>\n<|end|>\n"
    assert text[None] == "<|system|>\ns<|end|>\n<|user|>\nlate<|end|>\n<|assistant|>\n<|end|>\n"
    marks = re.findall(r"<\|(\w+)\|>", text[9])
    seq = [0, *(C.ROLES.index(m) for m in marks if m != "end")]
    assert all(b in C.NEXT[a] for a, b in zip(seq, seq[1:], strict=False)) and seq[-1] == C.FINAL
    roles = [C.ROLES.index(x[2]) if x[2] in C.ROLES else 0 for x in hot]
    g = out[(out.conv_id == 9) & ~out.action.isin(["insert", "end"])].sort_values("turn")
    assert cost(roles, [C.ROLES.index(x) for x in g.role]) == cost(roles, C.repair(roles))
    assert C.format_chats(df.limit(0)).collect() == []


def base(text):
    w, places, labels = words(text), [], set()
    for phrase, label in L.PHRASES.items():
        p = phrase.split()
        at = [i for i in range(len(w) - len(p) + 1) if w[i:i + len(p)] == p]
        places += at
        labels |= {label} if at else set()
    return (len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))


def test_license_phrases_match_brute_force(spark):
    r = random.Random(3)
    v = "mit license apache cc by gnu general public x é".split()
    rows = [(i, r.choice([" ", "-", "\n", "  "]).join(r.choice(v) for _ in range(r.randrange(40))), "") for i in range(300)]
    rows += [(900, "CC BY cc-by CC by", ""), (901, "mit license mit license", ""), (902, "smit license", "")]
    df = messy_documents(spark, rows)
    got = L.scan_licenses(df).collect()
    assert len(got) == df.count()
    text = {}
    for x in df.collect():
        text.setdefault(x.doc_id, []).append(x.text)
    for x in got:
        assert (x.n_words, x.n_base, x.first_word, x.last_word, x.base_labels) in [base(t) for t in text[x.doc_id]]
        assert set(filter(None, x.base_labels.split(","))) <= set(x.labels.split(",")) and 0 <= x.score <= 1


def test_pasted_notices_are_found(spark):
    t = L.TEMPLATES["bsd"].split()
    moved = [*t[:8], "really", "only", *t[8:]]
    cut = t[:len(t) // 3]
    rows = [(1, "x " * 40 + " ".join(t).upper() + " y", ), (2, "pre " + " ".join(moved)), (3, " ".join(cut)),
            (4, " ".join(reversed(t))), (5, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in L.scan_licenses(df).collect()}
    assert got[1].labels == "bsd" and got[1].score == pytest.approx(1.0) and got[1].spans[0].lo == 40
    assert got[2].labels == "bsd" and got[2].score >= L.COVER
    assert got[3].labels == got[4].labels == got[5].labels == ""
    assert L.scan_licenses(df.limit(0)).collect() == []


@pytest.mark.parametrize(("tag", "linked"), [
    ('<link data-x="%s" rel="canonical" href="http://a.net/t">' % ("y" * 5000), True),
    ('<link title="a > b" rel="canonical" href="http://a.net/t">', True),
    ("<!-- <link rel=canonical href=http://a.net/t> -->", False),
    ("<script>var x = '<link rel=canonical href=http://a.net/t>';</script>", False),
    ('<link data-rel="canonical" href="http://a.net/t">', False),
    ('<link rel="alternate Canonical" href=" http://a.net/t ">', True),
    ("<META http-equiv='Refresh' content='0; URL=http://a.net/t'>", True),
    ("<meta http-equiv=refresh content=0;url=http://a.net/t>", True),
    ("<linkx rel=canonical href=http://a.net/t>", False),
    ('<p>' * 200000 + '<link rel=canonical href="//a.net/t">', True)])
def test_tags_are_read_as_html_has_them(spark, tag, linked):
    from tasklens.llm.url_filters import alias_edges
    df = spark.createDataFrame([("http://b.net/d/p", tag)], "url string, html string")
    assert [tuple(r) for r in alias_edges(df).collect()] == ([("b.net/d/p", "a.net/t")] if linked else [])


def test_targets_are_resolved_against_the_page():
    from tasklens.llm.url_filters import node_of, resolved
    page = "http://H.net/a/b/c?x=1#f"
    assert [resolved(t, page) for t in ("/x", "x", "//o.net/y", "https://o.net", "mailto:a", "#f", "", "?q")] == [
        "http://H.net/x", "http://H.net/a/b/x", "http://o.net/y", "https://o.net", None, None, None, "http://H.net/a/b/?q"]
    assert resolved("x", "http://h.net") == "http://h.net/x"
    assert [node_of(u) for u in ("http://H.Net/A#f", "x", "http:///p", "http://h.net")] == ["h.net/A", None, None, "h.net/"]
