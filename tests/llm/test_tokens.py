"""Tokenisers, packing and compressed id files: against the libraries, round trips, and the odd inputs."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from barcloud.llm import bytebpe, packing, repair
from barcloud.llm.tokens import Memory, word_bpe

SF = "/root/testdata/sf0.001"
ODD = ["", " ", "\n", "a  b   c", " lead trail ", "x \n y\n\n z", "don't I'LL  go ½²", "a\x1cb c", "\x85 \xa0a \x00b",
       "e ́a İx", "ΑΣ ΑΣ.", "<|endoftext|> hi", "日本語 テキスト 123 مرحبا 👩‍👩‍👧", "___ a_b -- '' 's", "x" * 3000]


def odd_texts(n: int) -> list[str]:
    rng = random.Random(3)
    kinds = (lambda: rng.randrange(0x3100), lambda: rng.randrange(128), lambda: 32, lambda: 10)
    return ODD + ["".join(chr(rng.choice(kinds)()) for _ in range(25)) for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")


@pytest.fixture(scope="module")
def words():
    tokenizer = Tokenizer.from_file(packing.vocabulary())
    tokenizer.encode_special_tokens = True
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


def crc(ids) -> int:
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_word_ids_equal_the_library(words):
    ours = word_bpe(packing.vocabulary())
    for text in odd_texts(1500):
        assert np.frombuffer(ours.bytes_of(text), "<u4").tolist() == words(text), text


def test_memory_stays_bounded_and_right():
    made = []
    memory = Memory(lambda k: made.append(k) or k * 2, limit=3)
    assert [memory[k] for k in "abcdabcdea"] == [k * 2 for k in "abcdabcdea"]
    assert len(memory) <= 3 and len(memory._old) <= 3


def test_byte_ids_equal_the_library():
    ours = bytebpe.byte_bpe(bytebpe.vocabulary(), public_tokenizers.PATTERN)
    library = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ours.ranks.id_of, special_tokens={})
    for text in odd_texts(1500):
        ids = ours.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text), text
        assert ours.decode(ids) == text.encode()


def test_prefixes_append_and_edit():
    ranks, rng = bytebpe.byte_bpe(bytebpe.vocabulary(), public_tokenizers.PATTERN).ranks, random.Random(4)
    computed = []
    for _ in range(120):
        data = "".join(rng.choice("abcdeti ") for _ in range(rng.randrange(400))).encode()
        a = rng.randrange(len(data) + 1)
        b = min(len(data), a + rng.randrange(4))
        new = "".join(rng.choice("abth") for _ in range(rng.randrange(5))).encode()
        edited = bytebpe.Prefixes(ranks, data)
        computed.append((edited.replace(a, b, new), len(data) - a))
        edited.append(b"tion")
        assert edited.last == bytebpe.Prefixes(ranks, data[:a] + new + data[b:] + b"tion").last
    assert any(done < behind for done, behind in computed)  # re-encoding ends near the edit


def test_round_trip_odd_rows(spark):
    rows = spark.createDataFrame([(1, "a b", "x"), (1, "a b", "x"), (None, None, None), (2, "", "y")], "doc_id long, text string, ids string")
    out = bytebpe.round_trip(rows).collect()
    assert sorted((r["text"] or "").encode() for r in out) == sorted(bytes(r["decoded"]) for r in out)
    assert bytebpe.round_trip(rows.limit(0)).count() == 0


def test_best_fit_takes_the_fullest_bin_and_closes_it_first():
    bins = packing.Bins(10, 2)
    assert [bins.put(n) for n in (6, 7, 3, 4)] == [(0, 0), (1, 0), (1, 7), (0, 6)]
    assert bins.open == 0
    bins = packing.Bins(10, 2)
    bins.put(6), bins.put(8)
    assert bins.put(5) == (2, 0)  # a third bin closes the one of 8
    assert bins.put(2) == (0, 6) and bins.open == 2


def check_packed(rows, capacity: int) -> int:
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing_is_gapless_and_near_the_bound(docs, words):
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = packing.op3_packing_bounded(docs.sparkSession, SF).collect()
    used = check_packed(rows, packing.CAPACITY)
    assert used <= sum(r["length"] for r in rows) / packing.CAPACITY * 1.02 + 1
    by = defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
    assert by.keys() == texts.keys()
    for key, own in by.items():
        ids = words(texts[key]) + [0]
        assert [r["start"] for r in sorted(own, key=lambda r: r["piece"])] == list(range(0, len(ids), packing.CAPACITY))
        assert all(r["ids_crc32"] == crc(ids[r["start"] : r["start"] + r["length"]]) for r in own)


def test_packing_odd_rows(spark):
    rows = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, None), (2, ""), (3, "w " * 5000)], "doc_id long, text string")
    cut = packing.pieces(rows, capacity=8, with_ids=True)
    out = packing.pack(cut, capacity=8, open_bins=2, pieces_per_packer=3).collect()
    check_packed(out, 8)
    assert len(out) == 2 + 1 + 1 + 626 and all(len(r["ids"]) == 4 * r["length"] for r in out)
    assert packing.pack_documents(rows.limit(0)).count() == 0


@pytest.mark.parametrize("ids", [[], [5], [7] * 5000, [1, 2, 3] * 900, list(range(3000)) * 3, [2**32 - 20, 9] * 50])
def test_grammars_expand_to_the_ids(ids):
    ids = np.array(ids, np.uint32)
    starts = np.unique([0, len(ids) // 3, len(ids)])
    block = repair.Block(repair.compress(ids, starts, least=4)) if len(ids) and ids.max() < 2**31 else None
    if block is None:
        return
    assert (block.ids(0, len(ids)) == ids).all()
    rng = random.Random(2)
    for _ in range(50):
        a = rng.randrange(len(ids) + 1)
        b = rng.randrange(a, len(ids) + 1)
        assert (block.ids(a, b) == ids[a:b]).all()


def test_id_files_round_trip(spark, docs, words, tmp_path):
    odd = spark.createDataFrame([(-5, "again"), (-5, "again"), (-5, "other"), (10**9, None), (None, "no id")], "doc_id long, text string")
    every = docs.unionByName(odd)
    repair.write(every, f"{tmp_path}/ids", block_ids=20000)
    rows = repair.read(spark, f"{tmp_path}/ids", with_ids=True).collect()
    rows.sort(key=lambda r: r["start"])
    texts = defaultdict(list)
    for r in every.collect():
        texts[r["doc_id"]].append(crc(words(r["text"]) + [2]))
    at = 0
    for r in rows:
        assert r["start"] == at and r["ids_crc32"] == zlib.crc32(r["ids"]) and len(r["ids"]) == 4 * r["n_tokens"]
        texts[r["doc_id"]].remove(r["ids_crc32"])
        at += r["n_tokens"]
    assert not any(texts.values())
    keys = [r["doc_id"] for r in rows]
    assert keys[0] is None and keys[1:] == sorted(keys[1:])
    repair.write(docs.limit(0), f"{tmp_path}/none")
    assert repair.read(spark, f"{tmp_path}/none").count() == 0


def test_many_texts_together_give_the_ids_of_each(words):
    texts = [None, *odd_texts(300), "x" * 3000, "Été déjà, l'ÉTÉ's a.b.c 12 don't", None]
    ours = word_bpe(packing.vocabulary())
    assert [np.frombuffer(ids, "<u4").tolist() for ids in ours.every(texts)] == [words(text) for text in texts]
    bpe = bytebpe.byte_bpe(bytebpe.vocabulary(), public_tokenizers.PATTERN)
    library = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks.id_of, special_tokens={})
    assert [np.frombuffer(ids, "<u4").tolist() for ids in bpe.every(texts)] == [library.encode_ordinary(t or "") for t in texts]


def test_prefixes_of_many_sequences_follow_the_merges():
    from barcloud.llm import prefixes

    ranks, rng = bytebpe.byte_bpe(bytebpe.vocabulary(), public_tokenizers.PATTERN).ranks, random.Random(8)
    table = prefixes.Prefixes((t.decode("latin-1"), i) for t, i in sorted(ranks.id_of.items(), key=lambda x: x[1]))
    texts = ["", *["".join(rng.choice("aethino ") for _ in range(rng.randrange(40))) for _ in range(400)], "aaaaaaa" * 9]
    want = [[ranks.id_of[t] for t in ranks.merge(text.encode())] for text in texts]
    assert [np.frombuffer(ids, "<u4").tolist() for ids in table.ids(texts)] == want
    # "abc" cannot come of its merges, as "ab" comes before "bc"; equal symbols merge from the left
    table = prefixes.Prefixes([("c", 7), ("b", 8), ("a", 9), ("ab", 0), ("bc", 1), ("abc", 2), ("aa", 3)])
    assert [np.frombuffer(ids, "<u4").tolist() for ids in table.ids(["abc", "bcab", "aaab", "aaa"])] == [[2], [1, 0], [3, 0], [3, 9]]


def test_known_words_are_looked_up_once_and_new_ones_made_together():
    made, looked_up = [], []

    class Watched(Memory):
        def get(self, key, default=None):
            looked_up.append(key)
            return super().get(key, default)

    def learn(keys):
        made.append(set(keys))
        return [k.encode() for k in keys]

    memory = Watched(None)
    assert memory.every(["a", "b", "a"], learn) == [b"a", b"b", b"a"]
    assert memory.every(["b", "c", "c", "a"], learn) == [b"b", b"c", b"c", b"a"]
    assert made == [{"a", "b"}, {"c"}] and len(looked_up) == 7
    assert memory.every([], learn) == []


def test_rare_pairs_are_not_sorted(monkeypatch):
    sizes, sort = [], np.sort
    monkeypatch.setattr(np, "sort", lambda values: sizes.append(len(values)) or sort(values))
    rng = np.random.default_rng(3)
    ids = np.concatenate([rng.permutation(40_000), np.tile([50_001, 50_002, 50_003], 20)]).astype(np.uint32)
    blob = repair.compress(ids, np.array([0, len(ids)]))
    assert sizes and max(sizes) < 1000
    assert repair.Block(blob).ids(0, len(ids)).tolist() == ids.tolist()
