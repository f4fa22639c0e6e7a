import numpy as np
import pytest
from llm_cases import messy_documents, prose
from pyspark.sql import functions as F

from tasklens.llm import language_id as L
from tasklens.llm import toxicity as X

LANGS = {"en": "the of and that with from have this".split(), "de": "der die und nicht über schön ß".split(),
         "fr": "le est où être déjà très voilà".split()}


@pytest.fixture(scope="module")
def labelled(spark):
    rows = [(i * 3 + j, prose(i * 3 + j, 60, v), g) for i in range(40) for j, (g, v) in enumerate(LANGS.items())]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


@pytest.fixture(scope="module")
def model(labelled):
    return L.fit(labelled, docs_per_lang=25)


def test_language_on_unseen_texts(spark, model):
    rows = [(9000 + i, prose(9000 + i, 50, v), g) for i, (g, v) in enumerate(LANGS.items())]
    texts = messy_documents(spark, rows)
    got = {r.doc_id: r for r in L.identify(texts, model).collect()}
    assert all(got[9000 + i].lang_pred == g for i, g in enumerate(LANGS))
    assert got[1].lang_pred == got[2].lang_pred == got[3].lang_pred == "und" and got[1].score == 0
    assert all(0 <= r.score <= 1 for r in got.values())
    kept = L.keep_languages(texts, model)
    assert kept.columns == texts.columns
    assert {1, 2, 3}.isdisjoint(r.doc_id for r in kept.collect())
    assert {r.found for r in kept.collect()} == {"x8"}      # a clashing column stays


def test_whole_text_is_read(model):
    text = prose(1, 3000, LANGS["en"]) + " " + prose(2, 9000, LANGS["de"])
    assert L.predict(model, [text])[0] == ["de"]


def test_pair_tables_are_the_convolution(model):
    x = np.frombuffer(prose(3, 80).encode()[:L.WINDOW], np.uint8)
    e = model.weights["emb"][x]
    w = L.WINDOW - L.SPAN + 1
    cols = np.concatenate([e[j:j + w] for j in range(L.SPAN)], axis=1) @ model.weights["conv"]
    pair, code = L.tables(model), x[:-1].astype(int) * 256 + x[1:]
    assert np.allclose(pair[0][code[:w]] + pair[1][code[2:2 + w]], cols, atol=1e-4)


def test_predictions_are_a_plain_forward_pass(model):
    """Embedding, convolution, maximum and softmax window by window, without pair tables."""
    p = model.weights
    for text in [prose(1, 300, LANGS["fr"]), "Übermäßig!", prose(4, 40), "a", "x" * 257]:
        data = text.encode().lower() if text.isascii() else text.encode().translate(L.FOLD)
        total, size = np.zeros(len(model.langs)), 0
        for at in range(0, len(data), L.WINDOW):
            x = np.zeros(L.WINDOW, np.uint8)
            piece = np.frombuffer(data[at:at + L.WINDOW], np.uint8)
            x[:len(piece)] = piece
            best = np.full(p["conv"].shape[1], -np.inf)
            for k in range(L.WINDOW - L.SPAN + 1):
                best = np.maximum(best, p["emb"][x[k:k + L.SPAN]].ravel() @ p["conv"])
            z = np.maximum(best + p["bias"], 0) @ p["out"] + p["c"]
            total += len(piece) * (z - z.max() - np.log(np.exp(z - z.max()).sum()))
            size += len(piece)
        prob = np.exp(total / size - (total / size).max())
        langs, scores = L.predict(model, [text])
        assert langs == [model.langs[int(total.argmax())]]
        assert abs(scores[0] - (prob / prob.sum()).max()) < 1e-4


def test_gradients_are_the_slope_of_the_loss():
    """Training lowers the loss of separable windows to almost nothing."""
    rng = np.random.default_rng(0)
    y = rng.integers(3, size=90)
    x = (97 + 5 * y[:, None] + rng.integers(0, 4, (90, L.WINDOW))).astype(np.uint8)
    m = L.Model(["a", "b", "c"], L.train(x, y, 3, steps=60))
    got, score = L.predict(m, [bytes(w).decode() for w in x])
    assert got == [m.langs[k] for k in y] and score.min() > 0.8


def test_no_training_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    m = L.fit(empty)
    assert L.predict(m, ["some text", None]) [0] == ["und", "und"]
    assert L.identify(empty, m).collect() == []


@pytest.fixture(scope="module")
def toxic(spark):
    bad = "idiot moron scum trash".split()
    rows, y = [], []
    for i in range(400):
        t = prose(i, 60)
        if i % 5 == 0:
            t += " " + " ".join(bad[(i + j) % 4] for j in range(3))
        rows.append((i, t, "en"))
        y.append((i, int(i % 5 == 0)))
    docs = messy_documents(spark, [(i + 10, t, g) for i, t, g in rows])
    labels = spark.createDataFrame([(i + 10, t, "x") for i, t in y] + [(10, 0, "x"), (None, 1, "x"), (11, None, "x")],
                                   "doc_id long, toxic int, text string")
    return docs, labels


def test_toxicity_scores(spark, toxic):
    docs, labels = toxic
    train = docs.filter("doc_id < 300")
    index = X.fit(docs, train, labels, examples=200)
    got = {r.doc_id: r for r in X.score_documents(docs, index).collect()}
    held = [got[i + 10] for i in range(300, 400)]
    assert [r.predicted for r in held] == [int(r.doc_id % 5 == 0) for r in held]
    assert all(0 <= r.score <= 1 for r in got.values()) and len(got[310].evidence) == 3
    assert got[1].score == index.prior and got[2].evidence == []


def test_neighbours_are_exact(toxic):
    r = np.random.default_rng(1)
    n, v = 300, 40
    x = r.random((n, v)) * (r.random((n, v)) < 0.2)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    blocks, top = [], np.zeros((v, -(-n // X.BLOCK)))
    for b in range(top.shape[1]):
        part = x[b * X.BLOCK:(b + 1) * X.BLOCK]
        w = np.flatnonzero(part.any(axis=0))
        blocks.append((w, part[:, w].T))
        top[:, b] = part.max(axis=0)
    index = X.Index({}, np.ones(v), list(range(n)), np.zeros(n), np.ones(n), blocks, top, 0.0)
    sim, who = index.neighbours(x[:50], 9)
    full = x[:50] @ x.T
    assert np.allclose(sim, -np.sort(-full, axis=1)[:, :9])
    for i in range(50):
        want = sorted(range(n), key=lambda j: (-round(full[i, j], 12), j))[:9]
        assert who[i].tolist() == want


def test_toxicity_without_labels(spark, toxic):
    docs, _ = toxic
    none = spark.createDataFrame([], "doc_id long, toxic int")
    index = X.fit(docs, docs, none)
    assert {r.score for r in X.score_documents(docs, index).collect()} == {0.0}
    empty = docs.limit(0)
    assert X.score_documents(empty, X.fit(empty, empty, none)).collect() == []


def test_only_near_copies_with_the_same_label_are_dropped(spark):
    passage = prose(900, 50, [f"p{i}" for i in range(500)])

    def own(seed, n):
        return prose(seed, n, [f"w{i}" for i in range(5000)])

    text = own(1000, 300)
    rows = [(i, i % 2, own(i, 250) + " " + passage) for i in range(60)]       # a shared passage
    rows += [(100, 1, text), (101, 1, text + " end"), (102, 0, text), (103, 1, text), (104, 0, own(7777, 3))]
    rows += [(105, 1, text + " " + own(1001, 60)), (106, 1, text + " " + own(1002, 90)), (107, 0, None), (108, 0, "")]
    got = X.without_copies(spark.createDataFrame(rows, "doc_id long, toxic int, text string"))
    # 105 shares 296 of 356 shingles with 100, 106 shares 296 of 386
    assert {r.doc_id for r in got.collect()} == {*range(60), 100, 102, 104, 106, 107}


def test_distinct_sets_match_brute_force():
    r = np.random.default_rng(6)
    sets = []
    for _ in range(300):
        fresh = not sets or r.random() < 0.3
        s = set(r.choice(400, r.integers(1, 60)).tolist() if fresh else sets[r.integers(len(sets))])
        for x in r.choice(400, r.integers(0, 8)).tolist():
            s ^= {x}
        sets.append(sorted(s or {1}))
    kept = []
    for i, s in enumerate(sets):
        if all(5 * len({*s} & {*sets[j]}) < 4 * len({*s} | {*sets[j]}) for j in kept):
            kept.append(i)
    assert X.distinct_sets([np.array(s, np.int64) for s in sets]) == kept


def test_document_frequencies_cover_the_corpus(spark, toxic):
    docs, _ = toxic
    df, n = X.document_frequencies(docs, [b"the", b"idiot"])
    assert n == docs.count()
    assert df[1] == docs.filter(F.lower("text").contains("idiot")).count()


def test_hashed_sample_is_bounded(spark):
    from tasklens.llm.common import hashed_sample
    rows = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 20, "b").otherwise("a").alias("y"))
    n = dict(hashed_sample(rows, "y", 50).groupBy("y").count().collect())
    assert n == {"a": 50, "b": 20}
    assert hashed_sample(rows.limit(0), "y", 50).collect() == []
