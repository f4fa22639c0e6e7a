"""Shared pieces of the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tasklens.session import ensure_checkpoint_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

#: Bytes of UTF-8 text to lower-case ASCII letters, digits and non-ASCII bytes
#: as they are, and every other ASCII byte to a space, so that ``bytes.split``
#: yields the words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of the lower-cased text.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32
    for b in range(256)
)


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(c, UPPER, LOWER)


def utf8(text) -> bytes:
    """UTF-8 bytes of a text; null (None or NaN) counts as empty."""
    return text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage through the session's shared checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def arrow_texts(batches: Iterator, text: str = "text"):
    """(record batch, list of texts) of Arrow batches."""
    for b in batches:
        yield b, b.column(b.schema.get_field_index(text)).to_pylist()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that each linked node reaches.

    ``edges`` holds undirected links of any orderable type; nulls and loops
    are ignored, repeats are harmless, no links give no rows. Each round
    hooks every node to its smallest neighbour (a minimum that is partly
    computed before the shuffle, so a node with a third of all links is no
    hot key), shortens the pointers until every node points at its root, and
    replaces links by links between roots. At least half of the linked nodes
    vanish in each round. All joins are plain equi-joins with a unique side,
    which Spark may split when one key is frequent; every round is
    checkpointed.
    """
    e = (edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
         .filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").distinct())
    e = checkpointed(e)
    labels = None
    while not e.isEmpty():
        both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        p = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
        p = checkpointed(p.select("node", F.least("node", "m").alias("root")))
        while True:
            up = p.select(F.col("node").alias("root"), F.col("root").alias("up"))
            jumped = checkpointed(
                p.join(up, "root").select("node", "root", "up"))
            p = jumped.select("node", F.col("up").alias("root"))
            if jumped.filter("up <> root").isEmpty():
                break
        if labels is None:
            labels = p.select("node", F.col("root").alias("component"))
        else:
            step = p.select(F.col("node").alias("component"), "root")
            labels = checkpointed(labels.join(step, "component", "left").select(
                "node", F.coalesce("root", "component").alias("component")))
        pa = p.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        pb = p.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        e = checkpointed(
            e.join(pa, "a").join(pb, "b").filter("ra <> rb")
            .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
            .distinct())
    if labels is None:
        return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels


def written(df: DataFrame) -> DataFrame:
    """Write a table to the session's shared checkpoint folder and read it
    back: like a checkpoint, compressed and by column."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def by_place(df: DataFrame) -> DataFrame:
    """The columns renamed c0, c1, ..., so that no name of theirs clashes with
    what an operator adds."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def renamed(df: DataFrame, names: list[str]) -> DataFrame:
    """The first columns of ``by_place`` under their own names again."""
    return df.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)])


def hashed_sample(rows: DataFrame, label: str, n: int) -> DataFrame:
    """(doc_id, label): at most ``n`` ids of each label, by a hash of doc_id.

    The labels are the classes of a model, so their counts fit the driver. All
    but about twice the wanted rows of a class are left out by their hash
    before any are ranked, so what meets in one task is bounded as well.
    """
    size = {r[0]: r[1] for r in rows.groupBy(label).agg(F.count("*")).collect()}
    if not size:
        return rows.select("doc_id", label).limit(0)
    space = 1 << 30
    least = F.create_map(*[F.lit(x) for y, m in size.items()
                           for x in (y, int(min(1.0, (2 * n + 100) / m) * space))])
    hashed = F.pmod(F.xxhash64("doc_id"), F.lit(space))
    near = rows.select("doc_id", label, hashed.alias("hash")).filter(F.col("hash") < least[F.col(label)])
    rank = F.row_number().over(Window.partitionBy(label).orderBy("hash", "doc_id"))
    return near.withColumn("rank", rank).filter(F.col("rank") <= n).select("doc_id", label)
