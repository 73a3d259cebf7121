"""Language id and quality classifier: against brute force, held-out accuracy, and the odd inputs."""

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from barcloud.llm import language, quality

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars int"


def slow_bits(texts: list[str], text: str, order: int = language.ORDER) -> float:
    """Code length of ``text`` under the context tree of ``texts``, symbol by symbol."""
    tree = {}
    for t in texts:
        data = b"\0" * order + t.encode()
        for i in range(order, len(data)):
            for k in range(order + 1):
                tree.setdefault(data[i - k : i], Counter())[data[i]] += 1
    data, bits = b"\0" * order + text.encode(), 0.0
    for i in range(order, len(data)):
        for k in range(order, -1, -1):
            seen = tree.get(data[i - k : i])
            if not seen:
                continue
            n, d = sum(seen.values()), len(seen)
            if data[i] in seen:
                bits -= math.log2(seen[data[i]] / (n + d))
                break
            bits -= math.log2(d / (n + d))
        else:
            bits += 8
    return bits


def test_code_lengths_equal_the_definition(spark, monkeypatch):
    texts = {"aa": ["the cat sat on the mat", "a cat", "né"], "bb": ["der hund und die katze", "ein hund"]}
    rows = [(i, t, lang, "s", 1) for i, (lang, t) in enumerate((k, t) for k, ts in texts.items() for t in ts)]
    model = language.train(spark.createDataFrame(rows, DOCS), rows_per_language=10**6)
    probes = ["the dog", "", "katze", "né né", "zzz\x01", "a", "cat " * 50]
    for window in (language.WINDOW, 7):  # windows cut texts anywhere
        monkeypatch.setattr(language, "WINDOW", window)
        bits = language.code_lengths(model, pa.array([p.encode() for p in probes], pa.binary()))
        for i, p in enumerate(probes):
            for k, lang in enumerate(model.languages):
                assert bits[i, k] == pytest.approx(slow_bits(texts[lang], p), rel=1e-5, abs=1e-4)


def test_held_out_documents_get_their_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = language.op1_language_ppm(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert len(found) > 200
    assert (found["lang"] == found["lang_pred"]).mean() > 0.98
    assert found["score"].between(0, 1).all()


def test_language_odd_inputs(spark):
    docs = spark.createDataFrame([
        (1, "the cat and the dog", "en", "s", 1), (2, "der hund und die katze", "de", "s", 1), (3, None, "en", "s", 1),
        (4, "12 34 !?", None, None, None), (5, "", "de", "s", 1), (None, "the dog " * 30000, "en", "s", 1), (2, "der hund", None, "s", 1),
        (2, "der hund", None, "s", 1),
    ], DOCS)
    model = language.train(docs)
    out = language.identify(docs.withColumn("SCORE", F.lit("mine")), model)
    assert [c.lower() for c in out.columns].count("score") == 1
    got = Counter((r["doc_id"], r["lang_pred"]) for r in out.collect())
    assert got == Counter({(1, "en"): 1, (2, "de"): 3, (3, "und"): 1, (4, "und"): 1, (5, "und"): 1, (None, "en"): 1})
    empty = docs.limit(0)
    assert language.identify(empty, model).count() == 0
    assert {r["lang_pred"] for r in language.identify(docs, language.train(empty)).collect()} == {"und"}


def test_posteriors_find_the_reliable_labellers():
    random = np.random.default_rng(5)
    truth = random.random(4000) < 0.8
    right = np.array([0.95, 0.9, 0.6])
    votes = np.where(random.random((4000, 3)) < right, 1, -1) * np.where(truth, 1, -1)[:, None]
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    good = quality.estimate(patterns, counts.astype(float))
    by = {tuple(p): g for p, g in zip(patterns, good)}
    assert by[1, 1, -1] > 0.5 > by[-1, -1, 1]


def test_quality_agrees_with_the_labels(spark):
    found = quality.op9_quality_weak(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").toPandas()
    assert (found["keep"] == (found["quality"] == 1)).mean() > 0.95
    assert found.loc[found["quality"] == 1, "keep"].mean() > 0.98


def test_quality_odd_inputs(spark):
    good = "A plain sentence of several quite different words, which ends with a stop. " * 2
    docs = spark.createDataFrame([(1, good, "x"), (1, good, "x"), (2, None, None), (3, "", "x"), (None, "word " * 50000, "x")],
                                 "doc_id long, text string, keep string")
    out = quality.score(docs, quality.train(docs)).collect()
    assert len(out) == 5 and all(isinstance(r["keep"], bool) for r in out)
    assert {r["doc_id"]: r["score"] for r in out}[2] == 0.0 == {r["doc_id"]: r["score"] for r in out}[3]
    assert quality.score(docs.limit(0), quality.train(docs.limit(0))).count() == 0


def test_quality_looks_at_whole_texts_and_words():
    opening = [f"w{i}" for i in range(100)]
    assert quality.facts(" ".join(opening + ["x"] * 900), opening + ["x"] * 900).top_word == 0.9
    listed = ["x"] * 30 + [f"w{i}" for i in range(970)]
    assert quality.facts(" ".join(listed), listed).top_word == 0.03
    assert quality._shape("a" * 50 + "9Z") == "x9X"
