"""The registered queries and the pipeline on whole small tables."""

import os
import sys

import pytest
from llm_cases import LONG, prose

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = "/root/testdata/sf0.001"


def entry():
    sys.path.insert(0, ROOT)
    import __spark_entry__
    return __spark_entry__


def test_all_are_registered():
    names = entry().queries()
    assert "pipeline" in names
    assert sorted({int(n[2:].split("_")[0]) for n in names if n.startswith("op")}) == list(range(1, 11))


@pytest.mark.parametrize("name", [f"op{i}" for i in (1, 4, 10)])
def test_sql_twins(spark, duck_small, name):
    import pandas as pd
    e = entry()
    key = next(k for k in e.queries() if k.startswith(name + "_"))
    got, want = e.queries()[key](spark, SF).toPandas(), duck_small.execute(e.oracle_sql()[key]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    pd.testing.assert_frame_equal(got[cols].sort_values(cols, ignore_index=True),
                                  want[cols].sort_values(cols, ignore_index=True), check_dtype=False)


def test_rows_cover_the_tables(spark):
    q = entry().queries()
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    for key in q:
        if key.startswith(("op2_", "op3_", "op7_", "op8_", "op9_", "op10_")):
            assert q[key](spark, SF).count() == n, key


def test_pipeline_on_planted_documents(spark, tmp_path):
    import corpus_pipeline
    item = prose(500, 30)
    shared = prose(501, 60)
    text = {1: prose(1, 200), 2: None, 3: "12 ... 34", 4: prose(2, 150) + " " + item + " " + prose(3, 150),
            5: prose(4, 100) + " " + shared, 6: prose(5, 100) + " " + shared + " " + prose(6, 80), 7: LONG}
    rows = [(i, t, "en" if i % 2 else "de", f"s{i}", len(t or "")) for i, t in text.items()]
    rows += [(8, text[1], "en", "s8", 1)]
    rows += [(100 + i, prose(1000 + i, 150), ["en", "de"][i % 2], "s", 900) for i in range(30)]
    cols = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, cols).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        if i < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            seen.append({r.doc_id: r for r in docs.collect()})
    assert {2, 3}.isdisjoint(seen[0]) and {1, 4, 5, 6, 7, 8} <= set(seen[0])
    assert 8 not in seen[1] and {1, 4, 5, 6, 7} <= set(seen[1])
    assert shared in seen[2][5].text and shared not in seen[2][6].text and len(seen[2][6].text) == seen[2][6].n_chars
    assert item not in seen[3][4].text and seen[3][1].text == text[1]
    packed = {r.doc_id for r in docs.collect()}
    assert packed == set(seen[3])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()
