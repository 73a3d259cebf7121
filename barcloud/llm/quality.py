"""A quality classifier from weak labels.

Overlapping heuristics (:data:`LABELLERS`) vote good, bad or abstain on each text.  How far each can be trusted is
not known: expectation-maximisation estimates, from the votes of *all* documents, the share of good
texts and each labeller's probabilities of its three votes given a good and a bad text.  Votes are
counted per pattern first, at most ``3 ** labellers`` of them, so the iterations run over counts.  The posterior of
a text's vote pattern is its label.

A linear scorer over hashed features (words, word shapes, repetitions) is fitted by logistic
regression to the posteriors of at most ``SAMPLE_ROWS`` documents that a hash picks, the bound of
this model; it then scores every whole text.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barcloud.llm.common import table, texts, with_arrow_columns
from barcloud.llm.tokens import Memory

GOOD, BAD, ABSTAIN = 1, -1, 0
SAMPLE_ROWS = 6_000
DIMENSIONS = 1 << 13
KEEP = 0.4
EM_ROUNDS = 100
FIT_ROUNDS = 300

_SYMBOLS = b"#*%$&@=|~^<>{}[]\\_"
_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123)) + bytes(range(128, 256))
_SPACE = b" \t\n\r\x0b\x0c"
_MARKS = frozenset(_SYMBOLS.decode())
_LONE = frozenset("|-*#=~_<>/\\+•·")
_STOPS = frozenset(".!?:;\"')")


@dataclass(frozen=True)
class Facts:
    """What the labellers look at: shares of one text, each 0 where there is nothing to share."""

    words: int
    lines: int
    repeated_pairs: float
    top_word: float
    symbols: float
    marked_words: float
    upper: float
    shouts: float
    repeated_lines: float
    lone_marks: float
    open_lines: float
    word_length: float
    letters: float


def facts(text: str, words: list[str]) -> Facts:
    data = text.encode("utf-8")
    visible = len(data.translate(None, _SPACE))
    count = lambda chars: len(data) - len(data.translate(None, chars))
    letters, n = count(_LETTERS), len(words)
    lines = [x for x in map(str.strip, text.split("\n")) if x]

    def share(part: float, whole: int) -> float:
        return part / whole if whole else 0.0

    return Facts(
        n, len(lines), share(n - 1 - len(set(zip(words, words[1:]))), n - 1),
        share(max(Counter(words).values(), default=0), n), share(count(_SYMBOLS), visible),
        share(sum(w[-1] in _MARKS for w in words), n), share(count(_UPPER), letters),
        share(data.count(b"!") + data.count(b"?"), n), share(len(lines) - len(set(lines)), len(lines)),
        share(sum(map(_LONE.__contains__, words)), n), share(sum(x[-1] not in _STOPS for x in lines), len(lines)),
        share(visible, n), share(letters, visible),
    )


def _bad(when: bool) -> int:
    return BAD if when else ABSTAIN


#: Overlapping heuristics: most defects are seen by two or three; most votes abstain.
LABELLERS = (
    lambda f: _bad(f.words >= 20 and f.repeated_pairs > 0.3),
    lambda f: _bad(f.words >= 20 and f.top_word > 0.2),
    lambda f: _bad(f.words >= 5 and f.symbols > 0.03),
    lambda f: _bad(f.words >= 5 and f.marked_words > 0.15),
    lambda f: _bad(f.words >= 5 and f.upper > 0.5),
    lambda f: _bad(f.words >= 5 and f.shouts > 0.4),
    lambda f: _bad(f.lines >= 3 and f.repeated_lines > 0.4),
    lambda f: _bad(f.words >= 5 and f.lone_marks > 0.08),
    lambda f: _bad(f.lines >= 3 and f.open_lines > 0.6),
    lambda f: _bad(f.words == 0 or f.words >= 5 and not 2.5 <= f.word_length <= 14),
    lambda f: GOOD if f.words >= 5 and f.letters > 0.93 and f.upper < 0.2 else ABSTAIN,
    lambda f: GOOD if f.words >= 20 and f.repeated_pairs < 0.1 and f.lone_marks < 0.02 else ABSTAIN,
)


def pattern_of(text: str) -> int:
    """The votes on a text as one number in base 3."""
    f, pattern = facts(text, text.split()), 0
    for vote in LABELLERS:
        pattern = 3 * pattern + vote(f) + 1
    return pattern


def votes_of(patterns: np.ndarray) -> np.ndarray:
    """Votes by labeller of pattern numbers."""
    places = 3 ** np.arange(len(LABELLERS) - 1, -1, -1)
    return patterns[:, None] // places % 3 - 1


def estimate(votes: np.ndarray, counts: np.ndarray, rounds: int = EM_ROUNDS) -> np.ndarray:
    """P(good) of each vote pattern by expectation-maximisation.

    It starts from the votes with a complaint at twice the weight of a praise; no vote starts at good.
    """
    good = 1 / (1 + np.exp(-1.0 - 2.0 * np.where(votes == BAD, 2 * votes, votes).sum(1)))
    cast = np.stack([votes == v for v in (BAD, ABSTAIN, GOOD)], 2)
    for _ in range(rounds):
        weights = np.stack([counts * (1 - good), counts * good])
        # one observation of each kind of vote more, so no probability is zero
        chance = (np.einsum("yn,njv->yjv", weights, cast) + 1) / (weights.sum(1)[:, None, None] + 3)
        share = (weights.sum(1) + 1) / (counts.sum() + 2)
        log = np.log(share) + np.einsum("njv,yjv->ny", cast, np.log(chance))
        good = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -500, 500)))
    return good


def _slot(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8")) % DIMENSIONS


def _shape(word: str) -> str:
    kinds = ["X" if c.isupper() else "x" if c.isalpha() else "9" if c.isdigit() else c for c in word]
    return "".join(k for k, before in zip(kinds, [""] + kinds) if k != before)


_SAME, _SEEN = _slot("\x00same"), _slot("\x00seen")
_features = Memory(lambda w: np.array([_slot("w" + w.lower()), _slot("s" + _shape(w))], "<u2").tobytes())


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Slots and their values: shares of the words, with markers of repeated words and pairs."""
    n = len(words)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0)
    slots = np.frombuffer(b"".join(map(_features.__getitem__, words)), "<u2")
    counts = np.bincount(slots, minlength=DIMENSIONS).astype(float)
    counts[_SAME] += sum(map(str.__eq__, words, words[1:]))
    counts[_SEEN] += n - 1 - len(set(zip(words, words[1:])))
    at = np.flatnonzero(counts)
    return at, np.sqrt(counts[at] / (n + 20))  # of few words little is concluded


def fit(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, rounds: int = FIT_ROUNDS) -> np.ndarray:
    """Weights and, last, the intercept of a logistic regression on soft targets, by adaptive gradient steps."""
    weights, sums = np.zeros(DIMENSIONS + 1), np.full(DIMENSIONS + 1, 1e-8)
    if not rows:
        return weights
    at = np.concatenate([r[0] for r in rows])
    values = np.concatenate([r[1] for r in rows])
    row = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    for _ in range(rounds):
        z = np.bincount(row, values * weights[at], len(rows)) + weights[-1]
        error = 1 / (1 + np.exp(-z)) - target
        slope = np.append(np.bincount(at, values * error[row], DIMENSIONS), error.sum()) / len(rows) + 1e-4 * weights
        sums += slope**2
        weights -= 0.3 * slope / np.sqrt(sums)
    return weights


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> np.ndarray:
    """Weights of the scorer; votes are counted over all of ``docs``, null text is empty."""

    def vote(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        return {"pattern": pa.array([pattern_of(t or "") for t in texts(batch, text_col)], pa.int32())}

    field = T.StructType([T.StructField("pattern", T.IntegerType())])
    seen = with_arrow_columns(docs.select(text_col), vote, field, drop=(text_col,))
    counted = seen.groupBy("pattern").count().orderBy("pattern").toPandas()  # at most 3 ** labellers rows
    if not len(counted):
        return np.zeros(DIMENSIONS + 1)
    good = estimate(votes_of(counted["pattern"].to_numpy()), counted["count"].to_numpy(float))
    label = dict(zip(counted["pattern"], good))

    def features_of(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        own = [features((t or "").split()) for t in texts(batch, text_col)]
        return vote(batch) | {
            "slots": pa.array([a.astype("<u2").tobytes() for a, _ in own], pa.binary()),
            "shares": pa.array([v.astype("<f4").tobytes() for _, v in own], pa.binary()),
        }

    share = min(1.0, sample_rows / counted["count"].sum())
    picked = docs.where(F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(1 << 30)) <= share * (1 << 30))
    fields = T.StructType([*field, T.StructField("slots", T.BinaryType()), T.StructField("shares", T.BinaryType())])
    sample = with_arrow_columns(picked.select(text_col), features_of, fields, drop=(text_col,)).limit(2 * sample_rows).collect()
    sample.sort(key=lambda r: (r["pattern"], r["slots"], r["shares"]))
    rows = [(np.frombuffer(r["slots"], "<u2").astype(np.int64), np.frombuffer(r["shares"], "<f4")) for r in sample]
    return fit(rows, np.array([label.get(r["pattern"], 0.5) for r in sample]))


def score(docs: DataFrame, weights: np.ndarray, text_col: str = "text", keep: float = KEEP) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``keep``; a text without a word has score 0; columns of these names are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def make(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        w, z = shared.value, []
        for text in texts(batch, text_col):
            at, values = features((text or "").split())
            z.append(w[-1] + values @ w[at] if len(at) else -np.inf)
        found = 1 / (1 + np.exp(-np.maximum(np.array(z), -700)))
        found = np.where(np.isneginf(z), 0.0, found)
        return {"score": pa.array(found, pa.float64()), "keep": pa.array(found >= keep)}

    return with_arrow_columns(docs, make, T.StructType([
        T.StructField("score", T.DoubleType()), T.StructField("keep", T.BooleanType())
    ]))


def op9_quality_weak(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, train(docs)).select("doc_id", "score", "keep")
