"""Language identification by prediction by partial matching.

For each language a context tree over bytes holds how often each byte followed each context of up to
``ORDER`` bytes.  The statistics are frozen after training; the code length of a byte is

* ``-log2(c / (n + d))`` in the longest context of the language in which the byte was seen (``c``
  times out of ``n``, among ``d`` different bytes),
* after ``-log2(d / (n + d))`` for every longer known context, where it was not (the escape),
* and 8 bits after the escape from the empty context.

A text's language is the one with the least sum over all bytes; the score is the posterior
probability ``2**-bits`` under equal priors.  The trees of all languages are merged into one table of
grams per depth, so a batch of texts is scored by a few table look-ups per byte and any text length
uses windows of bounded size.

Training reads at most ``rows_per_language`` labelled rows of each language (a hash of the id picks
them) and keeps the ``GRAMS`` most frequent longest grams of each: the two bounds of the model.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barcloud.llm.common import bytes_and_offsets, has_letter, table, with_arrow_columns

#: Longest context in bytes; grams of ORDER + 1 bytes fit 32 bits.
ORDER = 3
ROWS_PER_LANGUAGE = 2_000
GRAMS = 200_000
LANGUAGES = 200
#: Positions scored at once.
WINDOW = 1 << 19
UNKNOWN = "und"

_RESULT = T.StructType([
    T.StructField("lang_pred", T.StringType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("bits_per_byte", T.DoubleType()),
])


@dataclass(frozen=True)
class Model:
    """Merged context trees: per depth the child table, code lengths per gram and escapes per context."""

    languages: tuple[str, ...]
    code: np.ndarray
    children: tuple[np.ndarray, ...]
    cost: tuple[np.ndarray, ...]
    escape: tuple[np.ndarray, ...]


def padded(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes with ORDER zero bytes before each text, and the start of each text in them."""
    data, offsets = bytes_and_offsets(array)
    n = len(array)
    starts = offsets[:-1] + ORDER * np.arange(1, n + 1)
    buffer = np.zeros(len(data) + ORDER * (n + 1), np.uint8)
    for i, start in enumerate(starts):
        buffer[start : start + offsets[i + 1] - offsets[i]] = data[offsets[i] : offsets[i + 1]]
    return buffer, starts


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), object)
        for lang in sorted(set(langs)):
            rows = batch.column("text").filter(pa.array(langs == lang))
            buffer, starts = padded(rows)
            lengths = bytes_and_offsets(rows)[1]
            held = np.zeros(len(buffer), bool)
            for start, length in zip(starts, np.diff(lengths)):
                held[start : start + length] = True
            grams, counts = [], []
            for at in range(0, len(buffer), WINDOW):
                where = np.flatnonzero(held[at : at + WINDOW]) + at
                gram = np.zeros(len(where), np.uint32)
                for back in range(ORDER, -1, -1):
                    gram = (gram << np.uint32(8)) | buffer[where - back]
                values, n = np.unique(gram, return_counts=True)
                grams.append(values)
                counts.append(n)
            if grams:
                grams, counts = np.concatenate(grams), np.concatenate(counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(grams)), pa.array(grams.astype(np.int64)), pa.array(counts)],
                    ["lang", "gram", "n"],
                )


def train(
    labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    rows_per_language: int = ROWS_PER_LANGUAGE,
) -> Model:
    """Context trees of the ``LANGUAGES`` most frequent languages in ``labelled``; rows without text or language are ignored.

    An empty table gives a model without languages, which answers ``und``.
    """
    rows = labelled.select(
        F.xxhash64(F.col(id_col).cast("string")).alias("pick"),
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"),
    ).where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()
    if not sizes:
        return build({})
    # a hash picks about the bound; the few rows beyond it go by rank
    quota = {r["lang"]: min(1.0, 0.95 * rows_per_language / r["count"]) for r in sizes}
    share = F.create_map(*[F.lit(x) for pair in quota.items() for x in pair])[F.col("lang")]
    sample = rows.where(F.pmod("pick", F.lit(1 << 30)) < share * F.lit(float(1 << 30)))
    grams = (
        sample.select("lang", F.col("text").cast("binary").alias("text"))
        .mapInArrow(_gram_counts, "lang string, gram long, n long")
        .groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    )
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    kept = grams.withColumn("r", rank).where(F.col("r") <= GRAMS).drop("r").toPandas()
    return build({
        lang: (part["gram"].to_numpy(np.uint32), part["n"].to_numpy(np.int64)) for lang, part in kept.groupby("lang")
    })


def build(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Model:
    """Tables from each language's counts of grams of ORDER + 1 bytes."""
    languages = tuple(sorted(counts))
    depth = ORDER + 1
    code = np.zeros(256, np.int64)
    if not languages:
        return Model((), code, (), (), ())
    every = np.unique(np.concatenate([counts[lang][0] for lang in languages]))
    seen = np.unique(every.view(np.uint8) if every.flags.c_contiguous else every.copy().view(np.uint8))
    code[seen] = np.arange(1, len(seen) + 1)
    width = len(seen) + 1

    # grams of each depth: every suffix of a gram, and every context of one
    grams = [every & np.uint32((1 << (8 * d)) - 1) if d < 4 else every for d in range(1, depth + 1)]
    for d in range(depth - 1, 0, -1):
        grams[d - 1] = np.unique(np.concatenate([grams[d - 1], grams[d] >> np.uint32(8)]))
        if d > 1:  # the added contexts need their own suffixes
            for lower in range(d - 1, 0, -1):
                grams[lower - 1] = np.unique(np.concatenate([grams[lower - 1], grams[d - 1] & np.uint32((1 << (8 * lower)) - 1)]))

    def node(d: int, values: np.ndarray) -> np.ndarray:
        return np.searchsorted(grams[d - 1], values) + 1

    children, cost, escape = [], [], []
    for d in range(1, depth + 1):
        own = grams[d - 1]
        parents = node(d - 1, own >> np.uint32(8)) if d > 1 else np.zeros(len(own), np.int64)
        n_contexts = len(grams[d - 2]) + 1 if d > 1 else 1
        child = np.zeros((n_contexts, width), np.int32)
        child[parents, code[(own & np.uint32(255)).astype(np.int64)]] = np.arange(1, len(own) + 1)
        table_ = np.zeros((len(own) + 1, len(languages)), np.float32)
        out = np.zeros((n_contexts, len(languages)), np.float32)
        lower = node(d - 1, own & np.uint32((1 << (8 * (d - 1))) - 1)) if d > 1 else None
        for k, lang in enumerate(languages):
            longest, n = counts[lang]
            suffix = longest & np.uint32((1 << (8 * d)) - 1) if d < 4 else longest
            c = np.bincount(node(d, suffix), weights=n, minlength=len(own) + 1)[1:]
            total = np.bincount(parents, weights=c, minlength=n_contexts)
            kinds = np.bincount(parents, weights=c > 0, minlength=n_contexts)
            known = total > 0
            out[known, k] = -np.log2(kinds[known] / (total[known] + kinds[known]))
            below = cost[-1][lower, k] if d > 1 else 8.0
            table_[1:, k] = np.where(
                c > 0, -np.log2(np.maximum(c, 1e-9) / np.maximum(total + kinds, 1)[parents]), out[parents, k] + below
            )
        if d == 1:
            table_[0] = out[0] + 8.0  # a byte that no language has seen
        children.append(child)
        cost.append(table_)
        escape.append(out)
    return Model(languages, code, tuple(children), tuple(cost), tuple(escape))


def code_lengths(model: Model, array: pa.Array) -> np.ndarray:
    """Bits of every text of a binary array under every language."""
    buffer, starts = padded(array)
    lengths = np.diff(bytes_and_offsets(array)[1])
    bits = np.zeros((len(array), len(model.languages)))
    full = np.flatnonzero(lengths)
    if not len(full):
        return bits
    first, last = starts[full], starts[full] + lengths[full]
    for at in range(0, len(buffer), WINDOW):
        end = min(at + WINDOW, len(buffer))
        back = max(0, at - ORDER)
        cost = _costs(model, model.code[buffer[back:end]])[at - back :]
        a, b = np.searchsorted(last, at, "right"), np.searchsorted(first, end, "left")
        if a < b:  # texts with bytes in this window, and the padding between them
            edges = np.stack([np.maximum(first[a:b], at), np.minimum(last[a:b], end)], 1).ravel() - at
            cut = edges[-1] == end - at
            sums = np.add.reduceat(cost, edges[:-1] if cut else edges, axis=0, dtype=np.float64)[::2]
            bits[full[a:b]] += sums
    return bits


def _costs(model: Model, codes: np.ndarray) -> np.ndarray:
    ids = [codes]
    for d in range(1, ORDER + 1):
        before = np.concatenate([np.zeros(1, ids[-1].dtype), ids[-1][:-1]])
        ids.append(model.children[d][before, codes])
    cost = model.cost[ORDER][ids[ORDER]]
    at = np.flatnonzero(ids[ORDER] == 0)
    for d in range(ORDER - 1, -1, -1):
        if not len(at):
            break
        context = np.where(at > 0, ids[d][at - 1], 0)
        cost[at] += model.escape[d + 1][context] + model.cost[d][ids[d][at]]
        at = at[ids[d][at] == 0] if d else at[:0]
    return cost


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``bits_per_byte`` (of the language predicted).

    ``und`` with score 0 if the text is null or has no letter, or the model no language.  Ties go to
    the first language by name; columns of these names are replaced; every row stays.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    ready = docs.withColumn("_bytes", F.when(has_letter(F.col(text_col)), F.col(text_col).cast("binary")))

    def predict(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        m = shared.value
        array = batch.column("_bytes")
        known = ~np.asarray(array.is_null()) if m.languages else np.zeros(len(array), bool)
        if not known.any():
            none = pa.nulls(len(array), pa.float64())
            return {"lang_pred": pa.array([UNKNOWN] * len(array), pa.string()),
                    "score": pa.array(np.zeros(len(array))), "bits_per_byte": none}
        bits = code_lengths(m, array)
        best = bits.argmin(1)
        least = bits[np.arange(len(bits)), best]
        posterior = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(1)
        lengths = np.maximum(np.diff(bytes_and_offsets(array)[1]), 1)
        names = np.where(known, np.array(m.languages, object)[best], UNKNOWN)
        return {"lang_pred": pa.array(names, pa.string()), "score": pa.array(np.where(known, posterior, 0.0)),
                "bits_per_byte": pa.array(least / lengths, mask=~known)}

    return with_arrow_columns(ready, predict, _RESULT, drop=("_bytes",))


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def op1_language_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out(F.col("doc_id"))))
    out = identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "bits_per_byte")
