"""Line dedup, conversation repair and tokenizer alignment against brute force, with the odd inputs."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from barcloud.llm import crosstoken, linededup, turns
from barcloud.llm.tokens import byte_letters

SPACE = " \t\n\x0b\x0c\r"


# --- lines ----------------------------------------------------------------------------------------------------------

def kept_lines(rows):
    """(lines, lines lost, text kept) of each row, by definition; a missing id is larger than any other."""
    order = lambda i: (i is None, i or 0)
    key = lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(SPACE))
    first = {}
    for number, text in rows:
        for line in (text or "").split("\n"):
            first[key(line)] = min(first.get(key(line), order(number)), order(number))
    out = []
    for number, text in rows:
        lines = (text or "").split("\n")
        keep = [x for x in lines if len(key(x)) < 10 or first[key(x)] == order(number)]
        out.append((number, len(lines), len(lines) - len(keep), None if text is None else "\n".join(keep)))
    return out


def line_rows():
    rng = random.Random(5)
    common = ["a passage that many hold", "  A Passage That Many Hold\t", "short", "", "ÉÉÉÉÉÉÉÉÉ9 é", "éééééééé9", "x" * 500]
    rows = [(i, "\n".join(rng.choice([*common, f"own line number {i}", f"shared {i // 3} by three"]) for _ in range(rng.randrange(9))))
            for i in range(300)]
    rows += [(7, rows[7][1]), (7, "a passage that many hold\nanother text of id seven"), (None, None), (None, rows[3][1]),
             (None, "only a missing id holds this"), (None, "only a missing id holds this"), (900, None), (901, ""), (902, "\n\n"),
             (903, "\n".join(f"line of the long text {i}" for i in range(5000))), (904, "line of the long text 4999\n" * 2000)]
    return rows + [(1, rows[1][1])] * 400  # one row, many times


def test_lines_equal_brute_force(spark):
    rows = line_rows()
    docs = spark.createDataFrame([(i, t, "mine", 5) for i, t in rows], "doc_id long, text string, bitmap string, N_Lines int").repartition(7)
    got = linededup.drop_lines(docs)
    assert got.columns == ["doc_id", "text", "bitmap", "n_lines", "n_dropped"]
    found = Counter((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got.collect())
    assert found == Counter(kept_lines(rows))
    assert {r.bitmap for r in got.select("bitmap").distinct().collect()} == {"mine"}


def test_line_ids_may_be_text(spark):
    rows = [("b", "the very same line\nown"), ("a", "The very same LINE "), (None, "the very same line")]
    got = {r.doc_id: r.text for r in linededup.drop_lines(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert got == {"b": "own", "a": "The very same LINE ", None: ""}


def test_bitmaps_keep_the_same_lines_without_text(spark):
    docs = spark.createDataFrame(line_rows(), "doc_id long, text string")
    bitmaps = linededup.keep_bitmaps(docs)
    assert "text" not in bitmaps.columns
    for r in bitmaps.collect():
        keep = linededup.keep_mask(r.bitmap, r.n_lines)
        assert len(keep) == r.n_lines and r.n_lines - keep.sum() == r.n_dropped > 0
    assert linededup.keep_bitmaps(docs.limit(0)).count() == 0
    assert linededup.drop_lines(docs.limit(0)).count() == 0


def test_a_hot_line_is_spread(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(
            F.lit("the line that three quarters of all documents hold"), F.when(F.col("id") % 4 == 0, F.col("id").cast("string")).otherwise("")).alias("text"))
        sizes = linededup.decide(linededup.line_keys(docs)).where("_kind <> 'edge'").withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()
        edges = linededup.decide(linededup.line_keys(docs)).where("_kind = 'edge'").count()
        assert len(sizes) >= 4 and edges >= 6  # only later documents are listed; the hot key lies in most partitions
        assert max(r["count"] for r in sizes) <= 2 * 20_000 / 8
        assert linededup.drop_lines(docs).where("n_dropped > 0").count() == 14_999
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


# --- conversations --------------------------------------------------------------------------------------------------

def every_repair(classes):
    """(cost, edits) of the best repair among all with up to two inserts before any row, by trying them all."""
    states = {(turns.START, "", 0)}
    may_follow = {"s": (0,), "u": (0, 1, 3), "a": (2,)}
    state_of = {"s": 1, "u": 2, "a": 3}
    for kind in classes:
        initial, fault = "sua?"[kind // 3], kind % 3
        new = set()
        for state, edits, cost in states:
            for inserts in range(3):
                if inserts:
                    state, edits, cost = 3 if state == 2 else 2, edits + "I", cost + 5
                new.add((state, edits + "D", cost + 2))
                if fault != 1:
                    for edit, role, price in (("K", initial, 0), ("R", "u", 1), ("R", "a", 1)):
                        if state in may_follow.get(role, ()):
                            new.add((state_of[role], edits + edit, cost + price + 5 * (fault == 2)))
        states = new
    ends = {0: "", 1: "II", 2: "I", 3: ""}
    return min((cost + 5 * len(ends[s]), edits + ends[s]) for s, edits, cost in states)


def test_repairs_are_the_cheapest_and_ascii_least():
    rng = random.Random(1)
    for n in range(5):
        for _ in range(40):
            classes = bytes(rng.randrange(12) for _ in range(n))
            assert turns.solve(classes)[::-1] == every_repair(classes), classes


def test_halves_and_parts_give_the_whole(monkeypatch):
    rng = random.Random(2)
    rows = [bytes(rng.choice([0, 3, 6, 3, 6, 9, 4, 5, 8, 1]) for _ in range(rng.randrange(80))) for _ in range(300)]
    whole = []
    for classes in rows:
        state, cost = turns._end(turns.forward(classes, turns.START))
        whole.append((turns._direct(classes, turns.START, state) + turns.ENDING[state], cost))
    monkeypatch.setattr(turns, "BASE", 2)
    turns._short.cache_clear()
    for classes, (audit, cost) in zip(rows, whole):
        assert turns.solve(classes) == (audit, cost)
        cuts = [0, *sorted(rng.randrange(len(classes) + 1) for _ in range(3)), len(classes)]
        parts = [classes[a:b] for a, b in zip(cuts, cuts[1:])]
        states, total = turns.choose_crossings([[turns.forward(p, s) for s in turns.STATES] for p in parts])
        joined = "".join(turns.between(p, a, b) for p, a, b in zip(parts, states, states[1:]))
        assert (joined + turns.ENDING[states[-1]], total) == (audit, cost)


def repaired(rows):
    """The digests of conversations by definition; ``rows`` are (conv, turn, role, text) after damage, None for a dropped row."""
    held = defaultdict(list)
    for conv, turn, role, text in rows:
        held[conv].append((turn, role, text))
    out = {}
    for conv, all_rows in held.items():
        mine = sorted((r for r in all_rows if r[1] is not None), key=lambda r: (r[0] is not None, r[0] or 0, r[1], turns_hash(r[2])))
        seen, classes, faults = set(), [], Counter()
        for _, role, text in mine:
            stripped = text.rstrip(SPACE)
            fault = "blank" if not stripped else "duplicate" if (role, text) in seen else "truncated" if stripped[-1] not in ".!?" else ""
            seen.add((role, text))
            faults[fault] += 1
            classes.append(turns.class_of(role[:1], {"blank": 1, "duplicate": 1, "truncated": 2}.get(fault, 0)))
        audit, cost = turns.solve(bytes(classes))
        lines, state, left = [], 0, iter(mine)
        for edit in audit:
            role, text = (None, "") if edit == "I" else next(left)[1:]
            if edit in "RI":
                role = "assistant" if state == 2 else "user"
            if edit != "D":
                state = {"s": 1, "u": 2, "a": 3}[role[:1]]
                lines.append(f"{role}:{text}")
        known = [t for t, _, _ in mine if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        out[conv] = (gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit,
                     hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


_HASH = {}


def turns_hash(text):
    return _HASH[text]


def conversation_rows():
    rng = random.Random(3)
    say = ["Yes.", "No!", "cut off", "", " \t\n", "Well?  ", "é.", "A long one. " * 2000]
    rows = [(c, rng.choice([t, t, t, None, t + 3]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", ""]), rng.choice(say) or f"t{t}.")
            for c in [*range(60), None] for t in range(rng.randrange(1, 14))]
    rows += [(100, t, ("user", "assistant")[t % 2], f"Turn {t}." if t % 7 else "same.") for t in range(3000)]  # most of all rows
    rows += [(101, 0, "user", "again and again.")] * 500 + [(102, None, "user", "")] + [(103, 5, None, None)]
    return rows


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_conversations_equal_brute_force(spark, adaptive):
    rows = conversation_rows()
    given = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    hashes = spark.createDataFrame([(x,) for x in {r[3] for r in given}], "text string").select("text", *turns._hashes()).collect()
    _HASH.update({r.text: (r.t1, r.t2) for r in hashes})
    table = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, audit int").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", adaptive)  # false: long conversations span partitions
    try:
        got = {r.conv: tuple(r)[1:] for r in turns.digests(turns.repair(table)).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == repaired(given)


def test_conversations_without_rows(spark):
    rows = spark.createDataFrame([(1, 0, "user", "x", 0), (2, 0, "user", "Hi.", 1)], "conv long, turn long, role string, text string, n long")
    got = {r.conv: tuple(r)[1:] for r in turns.digests(turns.repaired_rows(rows, turns.audits(rows.where("n > 0")))).collect()}
    assert got[1] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got[2][-3:] == (2, "D", hashlib.sha256(b"").hexdigest())  # one row alone: an insert costs more
    assert turns.repair(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_damage(spark):
    rows = spark.createDataFrame([(c, t, "assistant", "A. b! c?") for c in range(40) for t in range(5)], "conv_id long, turn long, role string, text string")
    import zlib

    for r in turns.damage(rows).collect():
        kind = zlib.crc32(f"{r.conv}:{r.turn}".encode()) % 20
        assert r.n == {0: 0, 3: 2}.get(kind, 1)
        assert r.text == {1: "", 2: "A b c"}.get(kind, "A. b! c?") and r.role == ("user" if kind == 4 else "assistant")


# --- alignment ------------------------------------------------------------------------------------------------------

class Libraries:
    def __init__(self):
        self.a = Tokenizer.from_file(public_tokenizers.path(crosstoken.A_FILE))
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(crosstoken.B_FILE))
        self.letters = {v: k for k, v in byte_letters().items()}

    def tokens(self, text):
        """(id, begin, end) of both tokenizers, or nothing."""
        if not text:
            return [], []
        a = [(i, bytes(self.letters[c] for c in self.a.id_to_token(i))) for i in self.a.encode(" " + text, add_special_tokens=False).ids]
        b = []
        for i in self.b.encode(text):
            piece = self.b.id_to_piece(i)
            b.append((i, bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()))
        if any(b"".join(v for _, v in x) != (" " + text).encode() for x in (a, b)):
            return [], []
        out = []
        for x in (a, b):
            ends = np.cumsum([len(v) for _, v in x]).tolist()
            out.append([(i, e - len(v), e) for (i, v), e in zip(x, ends)])
        return out


def alignments(rows):
    libraries, out, links, counts = Libraries(), [], [], Counter()
    for number, text in rows:
        a, b = libraries.tokens(text)
        mine, j = [], 0
        for i, begin, end in a:
            while j and b[j - 1][2] > begin:
                j -= 1
            while j < len(b) and b[j][1] < end:
                if b[j][2] > begin:
                    mine.append((i, b[j][0]))
                j += 1
        common = sorted({e for *_, e in a} & {e for *_, e in b})
        groups = ["|".join(",".join(str(i) for i, _, e in x if low < e <= high) for x in (a, b)) for low, high in zip([0, *common], common)]
        links.append(mine)
        counts.update(mine)
        out.append([number, len(a), len(b), len(groups), len(mine), ";".join(groups)])
    most = defaultdict(int)
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    return Counter((*o[:5], sum(counts[p] == most[p[1]] for p in x), sum(counts[p] for p in x), o[5]) for o, x in zip(out, links))


def odd_rows():
    rng = random.Random(4)
    kinds = (lambda: rng.randrange(0x3100), lambda: rng.randrange(128), lambda: 32, lambda: 10, lambda: rng.choice(b";.\r\t "))
    odd = [None, "", " ", "  ", "\n", "a  b   c", "x \n y\n\n z ", "\r\n;\r\n}", "a▁b", "<s> </s> <unk><|endoftext|>", "a  b ", "don't I'LL",
           "word " * 5000, "日本語 テキスト 123", "aaaaaaaa" * 40, "\t\tx = 1;\n\t}"]
    texts = odd + ["".join(chr(rng.choice(kinds)()) for _ in range(20)) for _ in range(400)]
    return [*enumerate(texts), (None, "a word"), (3, "a word"), (3, "a word")]


def test_alignments_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(crosstoken, "BLOCK_CHARS", 3000)
    rows = odd_rows()
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, N_A int").repartition(5)
    got = crosstoken.align(docs)
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    assert got.columns == names
    assert Counter(tuple(r) for r in got.collect()) == alignments(rows)
    assert crosstoken.align(docs.limit(0)).count() == 0


def test_alignments_of_the_given_documents(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = Counter((*r[:-1], hashlib.sha256(r[-1].encode()).hexdigest() if r[-1] else "") for r in alignments(rows).elements())
    assert Counter(tuple(r) for r in crosstoken.op13_align_identity(spark, sf).collect()) == want


def test_exact_groups_never_become_pairs(spark):
    docs = spark.createDataFrame([(i, "the cat sat on the mat") for i in range(50)], "doc_id long, text string")
    made = crosstoken.blocks(docs, "doc_id", "text", *map(public_tokenizers.path, (crosstoken.A_FILE, crosstoken.B_FILE)))
    sizes = made.select(F.size("pairs").alias("pairs"), F.size("exact_ids").alias("exact")).collect()
    assert sum(r.pairs for r in sizes) == 0 and all(r.exact >= 5 for r in sizes)


def test_blocks_are_neither_sorted_nor_sent_in_large_batches(spark):
    """Blocks are rows of about 2 MB: a sorted join and batches of 64 MB took more than an executor's memory."""
    docs = spark.createDataFrame(odd_rows(), "doc_id long, text string")
    plan = crosstoken.align(docs)._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin [block" not in plan
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= crosstoken.BATCH_BYTES
