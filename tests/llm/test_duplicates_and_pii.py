"""SimHash components and sanitisation: against brute force, planted cases, and the odd inputs."""

import hashlib
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from barcloud.llm import disclosure, simhash

SF = "/root/testdata/sf0.001"


def slow_fingerprint(text: str | None) -> int:
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints: list[tuple[int, int]]) -> dict[int, int]:
    """Smallest id reachable, by comparing all with all."""
    near = {a: [b for b, g in prints if (f ^ g).bit_count() <= 4] for a, f in prints}
    out = {}
    for key in sorted(near):
        waiting = [key] if key not in out else []
        while waiting:
            at = waiting.pop()
            if at not in out:
                out[at] = key
                waiting += near[at]
    return out


def test_components_equal_brute_force(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    prints = [(k, slow_fingerprint(t)) for k, t in texts.items()]
    want = slow_components(prints)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.op10_simhash_bktree(spark, SF).collect()}
    assert got == {k: (f"{f:016x}", want[k]) for k, f in prints}


@pytest.mark.parametrize("shard_rows", [4096, 6])
def test_no_link_is_lost_at_any_shard_size(spark, monkeypatch, shard_rows):
    monkeypatch.setattr(simhash, "SHARD_ROWS", shard_rows)
    rng, prints = random.Random(9), []
    for centre in (0, 2**64 - 1, rng.getrandbits(64)):
        for _ in range(9):  # chains of flips, and hot neighbourhoods
            centre ^= sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 6)))
            prints.append(centre)
    prints = [(i, f) for i, f in enumerate(dict.fromkeys(prints))]
    rows = spark.createDataFrame([(i, f - 2**64 if f >> 63 else f) for i, f in prints], "doc_id long, fp long")
    got = {r["doc_id"]: r["component_id"] for r in simhash.components(rows).collect()}
    assert got == slow_components(prints)


def test_bk_tree_finds_all_within_the_radius():
    rng, tree, values = random.Random(1), simhash.BKTree(), []
    for _ in range(300):
        value = rng.getrandbits(12)
        near = tree.add(value, 4)
        assert sorted(near) == [i for i, v in enumerate(values) if (v ^ value).bit_count() <= 4]
        values.append(value)


def test_near_duplicate_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame(
        [(5, text, 1), (3, text, 2), (3, text, 2), (9, None, 3), (8, "", 4), (None, text, 5), (7, "one two", 6), (6, "z " * 40000, 7)],
        "doc_id long, text string, fp long",
    )
    found = Counter((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(docs).collect())
    assert found == Counter({(5, 3): 1, (3, 3): 2, (9, 8): 1, (8, 8): 1, (None, 3): 1, (7, 7): 1, (6, 6): 1})
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter({3: 1, 8: 1, 7: 1, 6: 1})
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def slow_near_copies(texts: dict[int, str]) -> dict[int, int]:
    """Smallest id connected by a Jaccard similarity of 0.8 or more of five-word shingles, by comparing all with all."""
    def cut(text: str) -> set:
        words = text.lower().split()
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    sets = {k: cut(t) for k, t in texts.items()}
    near = {a: [b for b, y in sets.items() if x == y or 5 * len(x & y) >= 4 * len(x | y)] for a, x in sets.items()}
    out = {}
    for key in sorted(near):
        waiting = [key] if key not in out else []
        while waiting:
            at = waiting.pop()
            if at not in out:
                out[at] = key
                waiting += near[at]
    return out


@pytest.mark.parametrize("shard_rows", [4096, 6])
def test_the_stage_finds_planted_near_copies(spark, monkeypatch, shard_rows):
    import corpus_pipeline
    from barcloud.llm import nearcopies

    monkeypatch.setattr(nearcopies, "SHARD_ROWS", shard_rows)
    rng, texts = random.Random(4), []
    for n in (8, 40, 300, 300, 300, 1000):
        base = [f"v{rng.randrange(3000)}" for _ in range(n)]
        texts.append(base)
        for changed in [0, 1, 1, 2, 3, 5, 8, 13, 20, 40]:
            copy = list(base)
            for i in rng.sample(range(n), min(n, changed)):
                copy[i] = f"u{rng.randrange(10**6)}"
            texts += [copy, copy + [f"t{rng.randrange(10**6)}" for _ in range(changed)]]
    line = [f"common{i}" for i in range(30)]
    texts += [line + [f"x{rng.randrange(10**6)}" for _ in range(60)] for _ in range(30)]
    rng.shuffle(texts)
    texts = {i: " ".join(t) for i, t in enumerate(texts)}
    want = slow_near_copies(texts)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in nearcopies.near_copies(docs).collect()} == want
    assert {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()} == {k for k, v in want.items() if k == v}


def test_one_row_of_a_component_stays(spark):
    """Ids may be repeated, over different texts too, or missing; clean rows stay."""
    from barcloud.llm import nearcopies

    a, b, c = ("one two three four five six", "quite another text about something else", "words of a third kind that none has")
    rows = [(1, a, "x"), (5, a, "x"), (5, b, "x"), (7, c, "x"), (7, c, "x"), (None, a, "x"), (None, "only here are these words", "x"), (None, "only here are these words", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string")
    got = nearcopies.keep_one(docs)
    assert got.columns == docs.columns
    assert Counter((r["doc_id"], r["text"]) for r in got.collect()) == Counter({(1, a): 1, (5, b): 1, (7, c): 1, (None, "only here are these words"): 1})
    assert nearcopies.keep_one(docs.limit(0)).count() == 0


def test_linking_equals_all_pairs_and_is_linear_in_a_chain():
    from barcloud.llm import nearcopies

    rng = np.random.default_rng(8)
    for _ in range(30):
        bases = [rng.choice(400, rng.integers(1, 60), replace=False) for _ in range(6)]
        sets = [np.unique(np.where(rng.random(len(b)) < 0.08, rng.integers(0, 400, len(b)), b)).astype(np.uint64) for b in bases for _ in range(6)]
        want = list(range(len(sets)))
        for i, x in enumerate(sets):
            for j, y in enumerate(sets[:i]):
                if nearcopies.similar(x, y) and want[i] != want[j]:
                    low, high = sorted((want[i], want[j]))
                    want = [low if w == high else w for w in want]
        assert nearcopies.linked(sets) == want
    began = time.time()
    assert set(nearcopies.linked([np.arange(i, i + 40, dtype=np.uint64) for i in range(20_000)])) == {0}
    assert time.time() - began < 60


def test_memories_share_a_budget(monkeypatch):
    from barcloud.llm import tokens

    monkeypatch.setattr(tokens, "BUDGET", 100_000)
    first, second = tokens.Memory(len), tokens.Memory(len, share=1.0)
    for i in range(1000):
        assert first[f"key{i}"] == len(f"key{i}")
    assert 0 < len(first) < 200
    for i in range(1000):
        assert second[f"key{i}"] == len(f"key{i}")
    assert tokens.Memory._together <= 100_000 and not first


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def slow_spans(text: str) -> list[tuple[str, int, int]]:
    def counts(kind: str, value: str) -> bool:
        digits = re.sub("[^0-9]", "", value)
        if kind == "ip":
            return all(int(p) <= 255 for p in value.split("."))
        if kind == "card":
            return 16 <= len(digits) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(digits[::-1])) % 10 == 0
        return kind != "phone" or 8 <= len(digits) <= 15

    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text) if counts(k, m[0])]


def check_digests(texts: dict, rows) -> None:
    for r in rows:
        spans = slow_spans(texts[r["doc_id"]] or "")
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest(), (texts[r["doc_id"]], listed, r["spans"])
        assert r["spans"].startswith(listed)
        assert {k: r[f"n_{k}"] for k in PATTERNS} == {k: sum(s[0] == k for s in spans) for k in PATTERNS}


def test_base_spans_equal_brute_force(spark):
    rng = random.Random(7)
    parts = ["a@b.cc", "_d@e.fg", "x@y@z.com", "1.2.3.4", ".5.6.7.8", "256.1.1.1", "001.2.3.4", "4111 1111 1111 1111", "4111-1111-1111-1112",
             "+1 (706) 555-3138", "+123", "+1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6", " ", "é", "👩", "word", "@", ".", "-", "%", "9" * 30, "0000000000000000"]
    texts = {i: "".join(rng.choice(parts) for _ in range(rng.randrange(14))) for i in range(400)}
    texts |= {900: None, 901: "", 902: "5" * 40000, 903: "a" * 60000 + "@", 904: "u@v.ww " * 3000, 905: "1." * 20000}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    check_digests(texts, disclosure.digests(disclosure.find(docs)).collect())


def test_base_spans_of_the_table(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = disclosure.op8_pii_disclosure(spark, SF).collect()
    assert len(rows) == len(texts)
    check_digests(texts, rows)


def slow_disclosures(texts: list[str], policy: disclosure.Policy) -> set:
    """(email, term, action) by counting over texts with one mail address each; contexts are whole texts here."""
    with_term, with_both, with_mail = Counter(), defaultdict(set), defaultdict(set)
    for text in texts:
        for term in {m.lower() for m in re.findall(r"[^\W\d_][\w'-]{2,}", text)}:
            with_term[term] += 1
        for m in re.finditer(PATTERNS["email"], text):
            with_mail[m[0]].add(text)
            around = text[: m.start()] + "\n" + text[m.end() :]
            for term in re.findall(r"[^\W\d_][\w'-]{2,}", around):
                with_both[m[0], term.lower()].add(text)
    import math

    out = set()
    for (mail, term), both in with_both.items():
        p = len(with_mail[mail]) / len(texts)
        if len(both) >= policy.support and p < 1:
            told = math.log(len(both) / with_term[term] / p) / -math.log(p)
            if told >= policy.generalise:
                out.add((mail, term, "remove" if told >= policy.remove else "generalise"))
    return out


def test_disclosing_terms_equal_brute_force_and_are_sanitised(spark):
    texts = [f"Kestrel wrote bo@x.org about {w} today" for w in ("tea", "rain", "maps", "clay")]
    texts += [f"Heron called bo@x.org for {w} today" for w in ("soup", "wine", "mice")] + ["Heron was seen here today"]
    texts += [f"note {i} without anyone today" for i in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    policy = disclosure.Policy()
    spans = disclosure.contexts(disclosure.base_spans(docs))
    got = {(r["entity"], r["term"], r["action"]) for r in disclosure.disclosures(docs, spans, policy=policy).collect()}
    assert got == slow_disclosures(texts, policy)
    assert ("bo@x.org", "kestrel", "remove") in got and ("bo@x.org", "heron", "generalise") in got
    out = {r["doc_id"]: r["text"] for r in disclosure.sanitise(docs).collect()}
    assert "Kestrel" not in out[0] and "<EMAIL>" in out[0] and out[0].endswith("tea today")
    assert "<NAME>" in out[4] and out[7] == texts[7]  # a term is kept where its entity isn't
    assert all(out[i] == texts[i] for i in range(8, len(texts)))


def test_copies_prove_nothing(spark):
    docs = spark.createDataFrame([(i, "Osprey wrote to bo@x.org today") for i in range(50)] + [(99, "other")], "doc_id long, text string")
    assert all("term" not in r["spans"] for r in disclosure.digests(disclosure.find(docs)).collect())


def test_copies_of_a_document_hide_nothing(spark):
    texts = [f"Osprey wrote to bo@x.org about {w} today" for w in ("tea", "rain", "maps")] + [f"note {i} today" for i in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts + texts[:1] * 200)), "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in disclosure.sanitise(docs).collect()}
    assert not any("Osprey" in t for t in out.values()) and out[5] == texts[5]


@pytest.mark.parametrize("bound", [disclosure.MAX_BROADCAST_ROWS, 3])
def test_repeated_rows_and_many_terms_disclose_alike(spark, monkeypatch, bound):
    """Rows that stand in the table again, copies under other ids or none, and more terms than may be broadcast."""
    texts = [f"Osprey wrote to bo@x.org about {w} today" for w in ("tea", "rain", "maps", "clay")] + [f"note {i} today" for i in range(300)]
    rows = list(enumerate(texts))
    again = rows[:1] * 150 + [(None, texts[1])] * 150 + [(900 + i, texts[2]) for i in range(50)]
    schema, policy = "doc_id long, text string", disclosure.Policy()
    monkeypatch.setattr(disclosure, "MAX_BROADCAST_ROWS", bound)
    for table in (rows, rows + again):
        docs = spark.createDataFrame(table, schema)
        spans = disclosure.contexts(disclosure.base_spans(docs))
        got = {(r["entity"], r["term"], r["action"]) for r in disclosure.disclosures(docs, spans, policy=policy).collect()}
        assert got == slow_disclosures(texts, policy) and ("bo@x.org", "osprey", "remove") in got


def test_columns_of_any_name_stay(spark):
    docs = spark.createDataFrame([(1, "mail a@b.cc now", "k", 7, "e")], "doc_id long, text string, _key string, _until int, _edits string")
    assert [tuple(r) for r in disclosure.sanitise(docs).collect()] == [(1, "mail <EMAIL> now", "k", 7, "e")]


def test_stages_keep_columns_they_would_add(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet").drop("n_chars")
    extra = docs.select("*", F.lit("mine").alias("keep"), F.lit(7.5).alias("score"), F.lit("x").alias("Lang_Pred"), F.lit("b").alias("_bytes"))
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, extra, SF)
        assert out.columns == extra.columns, name
        assert {tuple(r) for r in out.select("keep", "score", "Lang_Pred", "_bytes").distinct().collect()} == {("mine", 7.5, "x", "b")}, name


def test_terms_are_found_and_marked_anywhere_in_a_text(spark):
    filler = "and so the day went on " * 20
    texts = [f"Osprey, {filler}{w} by a{i}@y.net, b{i}@y.net, bo@x.org, c{i}@y.net. {filler} osprey" for i, w in enumerate(("tea", "rain", "maps"))]
    texts += [f"note {i} {filler}" for i in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: r for r in disclosure.find(docs).collect()}
    for i in range(3):
        got = {(t["start"], t["end"]) for t in rows[i]["terms"]}
        assert got == {m.span() for m in re.finditer("osprey", texts[i], re.I)}
    assert not any(rows[i]["terms"] for i in range(3, len(texts)))


def test_sanitise_odd_rows(spark):
    docs = spark.createDataFrame(
        [(1, "mail a@b.cc now", "k"), (1, "mail a@b.cc now", "k"), (None, None, None), (2, "", "x"), (3, "4111111111111111@b.cc", "y")],
        "doc_id long, text string, terms string",
    )
    out = disclosure.sanitise(docs)
    assert out.columns == docs.columns
    got = Counter((r["doc_id"], r["text"]) for r in out.collect())
    assert got == Counter({(1, "mail <EMAIL> now"): 2, (None, None): 1, (2, ""): 1, (3, "<CARD>"): 1})
    assert disclosure.sanitise(docs.limit(0)).count() == 0


def test_the_stages_keep_clean_documents(spark):
    import corpus_pipeline

    larger = "/root/testdata/sf0.01"  # of 200 documents too little is learned about texts of two or three words
    docs = spark.read.parquet(f"{larger}/documents.parquet")
    labels = spark.read.parquet(f"{larger}/labels.parquet").where("quality = 1")
    for name, stage in corpus_pipeline.STAGES[:2]:
        out = stage(spark, docs, larger)
        assert out.columns == docs.columns
        lost = docs.join(out, "doc_id", "left_anti").join(labels, "doc_id").count()
        assert lost <= 0.02 * labels.count(), name
        docs = out
    rows = corpus_pipeline.run(spark, SF)
    assert rows.agg(F.max("length")).first()[0] <= 2048


def test_terms_are_counted_in_distinct_texts_where_the_rows_stand(spark, monkeypatch, capsys):
    texts = [(1, "falcon nest"), (1, "falcon nest"), (2, "falcon nest"), (3, "Falcon egg falcon"), (4, None), (5, "owl nest"), (6, "owl nest")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    terms = spark.createDataFrame([("falcon",), ("nest",), ("owl",)], "term string")
    want = {"falcon": 2, "nest": 2, "owl": 1}
    assert {r["term"]: r["n_t"] for r in disclosure.term_counts(docs, terms).collect()} == want
    disclosure.term_counts(docs.where("doc_id > 1"), terms).explain()
    assert "hashpartitioning(term" in (plan := capsys.readouterr().out) and "hashpartitioning(_text_key" not in plan
    monkeypatch.setattr(disclosure, "MAX_BROADCAST_ROWS", 0)
    assert {r["term"]: r["n_t"] for r in disclosure.term_counts(docs, terms).collect()} == want
