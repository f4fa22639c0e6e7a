"""Small tables with every awkward case, and plain helpers for brute force."""

from __future__ import annotations

import random
import re

LONG = " ".join(f"w{i % 97} the of" for i in range(20000))
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return (text or "").translate({i: i + 32 for i in range(65, 91)})


def words(text):
    return WORD.findall(lower(text))


def messy_documents(spark, more=(), unique=False):
    """Null and empty texts, a very long one, repeated rows, null ids, and
    columns named like the operators' own."""
    rows = [(1, None, "en"), (2, "", None), (3, "...!! 12", "en"), (4, LONG, "en"),
            (6, "Ünïcode «text» ß 漢字 the", "de"), (7, "the MIT License and CC-BY", None)]
    if not unique:
        rows += [(4, LONG, "en"), (None, "no id", "en"), (None, None, None), (7, "another text", "fr")]
    rows += list(more)
    extra = ("k", "h", "fp", "spans", "items", "n_words", "_k", "_kept", "found", "c0", "n_removed", "score")
    out = [(i, t, g, *[f"x{n}" for n in range(len(extra))]) for i, t, g in rows]
    cols = "doc_id long, text string, lang string, " + ", ".join(f"`{c}` string" for c in extra)
    return spark.createDataFrame(out, cols)


def prose(seed, n, vocabulary="the of and to in that is was for on é ü".split()):
    r = random.Random(seed)
    return " ".join(r.choice(vocabulary) for _ in range(n))
