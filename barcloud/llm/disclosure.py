"""Personal data and the terms that disclose it: information-theoretic sanitisation, as DataFrame work alone.

*Base spans* are e-mail addresses, IP addresses, payment cards and phone numbers by pattern.  Each
distinct value is a protected entity.  A *term* (a word of three or more characters outside addresses) anywhere
in a text that holds an entity discloses it by

    ``log(P(entity | term) / P(entity)) / log(1 / P(entity))``

which is 1 if the term only occurs with the entity and 0 if it tells nothing.  All counts are of distinct whole
texts, so copies neither prove nor hide anything: ``P(entity | term)`` is the share of the texts with the term that
have the entity; ``P(entity)`` is its share of all texts.  Terms that share ``SUPPORT`` or more texts with an
entity are removed wherever they stand in the entity's texts from ``REMOVE`` on, and generalised to their word
class from ``GENERALISE`` on.

Patterns are written so that matching is linear: a match may only begin where a run of its characters
begins or the match before ended, and repetitions don't give back.  Offsets are in code points.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barcloud.llm.common import MAX_BROADCAST_ROWS, attach_facts, small_or_shuffled, table
from barcloud.session import write_table

SUPPORT = 3
REMOVE = 0.95
GENERALISE = 0.8
TERM = r"\p{L}[\p{L}\p{N}'-]{2,}+"

_LOCAL = "A-Za-z0-9._%+-"
#: kind: (pattern, a substring that any match has)
KINDS = {
    "email": (rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    "ip": (r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "."),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", ""),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "+"),
}
_BYTE = r"0*(?:[0-9]|[1-9][0-9]|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
#: Spans gathered before they join the longer list, which keeps appending linear.
_BLOCK = 256
_SPAN = "struct<value:string,start:int,end:int>"


@dataclass(frozen=True)
class Policy:
    """When a term discloses too much."""

    support: int = SUPPORT
    remove: float = REMOVE
    generalise: float = GENERALISE


def located(hits: Column, gaps: Column) -> Column:
    """Spans of the matches ``hits``, given the texts between them (one more than matches)."""
    none = F.array().cast(f"array<{_SPAN}>")
    start = F.struct(
        F.array().cast(f"array<array<{_SPAN}>>").alias("done"), none.alias("now"), F.lit(0).alias("at")
    )

    def step(acc: Column, item: Column) -> Column:
        begin = acc["at"] + F.length(item["gap"])
        span = F.struct(
            item["hit"].alias("value"), begin.alias("start"), (begin + F.length(item["hit"])).alias("end")
        )
        full = F.size(acc["now"]) >= _BLOCK
        return F.struct(
            F.when(full, F.array_append(acc["done"], acc["now"])).otherwise(acc["done"]).alias("done"),
            F.array_append(F.when(full, none).otherwise(acc["now"]), span).alias("now"),
            (begin + F.length(item["hit"])).alias("at"),
        )

    items = F.arrays_zip(hits.alias("hit"), F.slice(gaps, 1, F.size(hits)).alias("gap"))
    return F.aggregate(items, start, step, lambda acc: F.concat(F.flatten(acc["done"]), acc["now"]))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def weigh(d: Column, i: Column) -> Column:
        n = d.try_cast("int")
        return F.coalesce(F.when(i % 2 == 0, n).otherwise(2 * n - F.when(n > 4, 9).otherwise(0)), F.lit(0))

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), weigh), F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str) -> Callable[[Column], Column]:
    """Whether a span is a match that counts; Spark passes one argument for each parameter, so the kind is bound here."""
    return lambda span: _counts(kind, span["value"])


def _counts(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if kind == "card":
        digits = _digits(value)
        return F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    return F.lit(True)


def _with_matches(df: DataFrame, text: str, out: str, pattern: str, part: str) -> DataFrame:
    """``df`` with the spans of ``pattern``; three steps, so that each pattern runs once per text and purpose."""
    some = F.contains(F.col(text), F.lit(part)) if part else F.lit(True)
    df = df.withColumn(f"{out}_hits", F.when(some, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))))
    gaps = F.when(F.size(f"{out}_hits") > 0, F.split(F.col(text), pattern, -1))
    df = df.withColumn(f"{out}_gaps", gaps)
    spans = F.when(F.size(f"{out}_hits") > 0, located(F.col(f"{out}_hits"), F.col(f"{out}_gaps")))
    spans = F.coalesce(spans, F.array().cast(f"array<{_SPAN}>"))
    return df.withColumn(out, spans).drop(f"{out}_hits", f"{out}_gaps")


def row_key(id_col: str, text_col: str) -> Column:
    """One value for equal rows of id and text; never null."""
    return F.xxhash64(F.col(id_col).cast("string"), F.coalesce(F.col(text_col), F.lit("")))


def text_key(text_col: str) -> Column:
    """One value for equal texts; null is empty."""
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def base_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: key, key of the text, id and for each kind an array of (value, start, end)."""
    found = docs.select(
        row_key(id_col, text_col).alias("_key"), text_key(text_col).alias("_text_key"), F.col(id_col),
        F.coalesce(F.col(text_col), F.lit("")).alias("_text"),
    )
    for kind, (pattern, part) in KINDS.items():
        found = _with_matches(found, "_text", f"_{kind}", pattern, part)
    return found.select("_key", "_text_key", id_col, *[
        F.filter(f"_{kind}", _valid(kind)).alias(kind) for kind in KINDS
    ])


def contexts(found: DataFrame) -> DataFrame:
    """One row per row and entity it holds: key, key of the text, kind, entity (its value in a common form)."""
    entity = {"email": lambda v: F.lower(v), "card": _digits, "phone": _digits, "ip": lambda v: v}

    def named(kind: str) -> Callable[[Column], Column]:
        return lambda s: F.struct(F.lit(kind).alias("kind"), entity[kind](s["value"]).alias("entity"))

    every = F.concat(*[F.transform(kind, named(kind)) for kind in KINDS])
    return found.select("_key", "_text_key", F.inline(F.array_distinct(every)))


def unaddressed(text: Column) -> Column:
    """``text`` with a line break for every character of an e-mail address: no other base span has letters, and places stay."""
    pattern, part = KINDS["email"]
    pieces = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit")
    )
    blank = F.transform(pieces, lambda x: F.concat(x["gap"], F.repeat(F.lit("\n"), F.coalesce(F.length(x["hit"]), F.lit(0)))))
    return F.when(F.contains(text, F.lit(part)), F.array_join(blank, "")).otherwise(text)


def _terms(texts: DataFrame, *keep: str) -> DataFrame:
    """(text key, ``keep``, term) of ``texts`` (text key, text): each term once a row, in lower case."""
    found = F.transform(F.regexp_extract_all(unaddressed(F.col("_text")), F.lit(TERM), F.lit(0)), F.lower)
    return texts.select("_text_key", *keep, F.explode(F.array_distinct(found)).alias("term"))


def _one_of_each(docs: DataFrame, held: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(text key, n_most, text) of one row for each text in ``held``: copies are out before a term is made of them.

    ``n_most`` is the number of texts of the most frequent entity a text holds.
    """
    readers = held.groupBy("_text_key").agg(F.min("of").alias("of"), F.max("n_e").alias("n_most"))
    readers = write_table(readers.select("of._key", "of.rows", "_text_key", "n_most"), "pii-readers")
    few = readers.count() <= MAX_BROADCAST_ROWS
    rows = docs.select(row_key(id_col, text_col).alias("_key"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    rows = rows.join(F.broadcast(readers) if few else readers, "_key")
    if not readers.where("rows > 1").isEmpty():  # a row of this id and text stands in the table again
        rows = rows.where("rows = 1").unionByName(rows.where("rows > 1").dropDuplicates(["_key"]))
    rows = rows.select("_text_key", "n_most", "_text")
    return rows if few else write_table(rows, "pii-texts")  # moved once, not for each of the two passes


def _with_counts(words: DataFrame, near: DataFrame) -> DataFrame:
    """``words`` with ``n_near`` of their terms, without terms that ``near`` lacks; no term meets in one task.

    A term above the mean share of ``MAX_BROADCAST_ROWS`` terms is one of fewer than that, which are broadcast; any other
    has few rows.
    """
    if near.count() <= MAX_BROADCAST_ROWS:
        return words.join(F.broadcast(near), "term")
    common = F.col("n_near") > F.lit(near.agg(F.sum("n_near")).first()[0] / MAX_BROADCAST_ROWS)
    words = words.join(F.broadcast(near.where(common).withColumnRenamed("n_near", "n_common")), "term", "left")
    found = words.where("n_common is not null").withColumnRenamed("n_common", "n_near")
    others = words.where("n_common is null").drop("n_common").join(near.where(~common), "term")
    return found.unionByName(others)


def term_counts(docs: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(term, n_t): the distinct texts of ``docs`` with each of the distinct ``terms``.

    One row of each text is counted where it stands, so that only partial counts travel; a text's other rows are known by
    a broadcast of the texts that have any.  If those are too many for that, pairs of text and term travel.
    """
    rows = docs.select(
        row_key(id_col, text_col).alias("_key"), text_key(text_col).alias("_text_key"),
        F.coalesce(F.col(text_col), F.lit("")).alias("_text"),
    )
    of_rows = rows.groupBy("_text_key", "_key").agg(F.count("*").alias("rows"))
    copies = of_rows.groupBy("_text_key").agg(F.min(F.struct("_key", "rows")).alias("of"), F.sum("rows").alias("n"))
    copies = copies.where("n > 1").select("_text_key", F.col("of._key").alias("_kept"), F.col("of.rows").alias("_rows"))
    copies = write_table(copies, "pii-copies")
    terms = small_or_shuffled(terms)

    def known(some: DataFrame) -> DataFrame:
        return _terms(some).join(terms, "term", "left_semi")

    if copies.count() <= MAX_BROADCAST_ROWS:
        rows = rows.join(F.broadcast(copies), "_text_key", "left")
        words = known(rows.where("_kept is null or (_kept = _key and _rows = 1)")).select("term")
        if not copies.where("_rows > 1").isEmpty():  # a row of this id and text stands in the table again
            words = words.unionByName(known(rows.where("_kept = _key and _rows > 1")).distinct().select("term"))
    else:
        words = known(rows).distinct()
    return words.groupBy("term").agg(F.count("*").alias("n_t"))


def disclosures(
    docs: DataFrame, spans: DataFrame, text_col: str = "text", policy: Policy = Policy(), id_col: str = "doc_id"
) -> DataFrame:
    """(kind, entity, term, disclosure, action) of terms beyond the policy's thresholds, over the whole corpus."""
    texts = docs.select(text_key(text_col).alias("_text_key"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    total = texts.select("_text_key").distinct().count()
    of_rows = spans.groupBy("_text_key", "kind", "entity", "_key").agg(F.count("*").alias("rows"))
    held = of_rows.groupBy("_text_key", "kind", "entity").agg(F.min(F.struct("_key", "rows")).alias("of"))
    held = write_table(held, "pii-held")
    # an entity of fewer texts cannot share enough of them with a term
    n_entity = held.groupBy("kind", "entity").agg(F.count("*").alias("n_e")).where(F.col("n_e") >= policy.support)
    n_entity = write_table(n_entity, "pii-entities")
    held = attach_facts(held, n_entity, ["kind", "entity"], "n_e", ["_text_key"]).where("n_e is not null")
    held = write_table(held, "pii-shared")

    def told(n_both: Column, n_term: Column, n_entity: Column) -> Column:
        p_entity = n_entity / F.lit(total)
        share = F.log(n_both / n_term / p_entity) / -F.log(p_entity)
        return F.when(n_entity < total, share).otherwise(0.0)

    def at_most(n_near: Column, n_entity: Column) -> Column:
        return told(F.least(n_entity, n_near), n_near, n_entity)

    # texts with the term and any entity are a lower bound of all with the term, and so give an upper
    # bound of the disclosure: common words are out before pairs are made and before the corpus is counted.
    # The bound grows with the entity's texts (but for an entity of all of them), so a text's most frequent
    # entity decides on its words; they are made again from the text, which is cheaper than to keep them
    some = _one_of_each(docs, held, id_col, text_col)
    near = _terms(some).groupBy("term").agg(F.count("*").alias("n_near")).where(F.col("n_near") >= policy.support)
    near = write_table(near, "pii-near")
    words = _with_counts(_terms(some, "n_most"), near)
    may = (at_most(F.col("n_near"), F.col("n_most")) >= policy.generalise) | (F.col("n_most") >= total)
    pairs = words.where(may).drop("n_most").join(held.drop("of"), "_text_key")
    pairs = pairs.where(at_most(F.col("n_near"), F.col("n_e")) >= policy.generalise)
    pairs = pairs.groupBy("kind", "entity", "term", "n_e", "n_near").agg(F.count("*").alias("n_te"))
    pairs = pairs.where(
        (F.col("n_te") >= policy.support) & (told(F.col("n_te"), F.col("n_near"), F.col("n_e")) >= policy.generalise)
    )
    pairs = write_table(pairs, "pii-pairs")
    n_term = term_counts(docs, pairs.select("term").distinct(), id_col, text_col)
    scored = pairs.join(n_term, "term").withColumn("disclosure", told(F.col("n_te"), F.col("n_t"), F.col("n_e")))
    action = F.when(F.col("disclosure") >= policy.remove, "remove").when(F.col("disclosure") >= policy.generalise, "generalise")
    return scored.withColumn("action", action).where("action is not null").select(
        "kind", "entity", "term", "disclosure", "action"
    )


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", policy: Policy = Policy()) -> DataFrame:
    """Per row of ``docs``: key, id, the base spans by kind and ``terms``, the disclosing terms (start, end, action).

    Null text is empty; repeated rows give their spans each; an empty table gives none.
    """
    found = write_table(base_spans(docs, id_col, text_col), "pii-spans")
    spans = contexts(found)
    flagged = write_table(disclosures(docs, spans, text_col, policy, id_col), "pii-terms")
    # a word may disclose several entities: removal wins
    wanted = spans.join(small_or_shuffled(flagged), ["kind", "entity"]).groupBy("_key", "term").agg(F.max("action").alias("action"))
    wanted = write_table(wanted, "pii-wanted")
    rows = docs.select(row_key(id_col, text_col).alias("_key"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    rows = rows.join(small_or_shuffled(wanted.select("_key").distinct()), "_key", "left_semi")
    rows = _with_matches(rows.withColumn("_text", unaddressed(F.col("_text"))), "_text", "_words", TERM, "")
    words = rows.select("_key", F.inline(F.transform("_words", lambda s: F.struct(
        F.lower(s["value"]).alias("term"), s["start"].alias("at"), s["end"].alias("until")
    ))))
    marked = words.join(small_or_shuffled(wanted), ["_key", "term"])
    marked = marked.groupBy("_key", "at", "until").agg(F.max("action").alias("action"))
    terms = marked.groupBy("_key").agg(F.sort_array(F.collect_list(
        F.struct(F.col("at").alias("start"), F.col("until").alias("end"), "action")
    )).alias("terms"))
    none = F.array().cast("array<struct<start:int,end:int,action:string>>")
    return found.join(terms, "_key", "left").withColumn("terms", F.coalesce("terms", none))


def _listed(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    base = F.concat(*[_listed(F.col(kind), kind) for kind in KINDS])
    listed = found.select(
        id_col, *[F.size(kind).cast("long").alias(f"n_{kind}") for kind in KINDS],
        base.alias("_base"), _listed(F.col("terms"), "term").alias("_terms"),
    )
    return listed.select(
        id_col, *[f"n_{kind}" for kind in KINDS],
        F.sha2(F.array_join("_base", ","), 256).alias("base_sha256"),
        F.array_join(F.concat("_base", "_terms"), ",").alias("spans"),
    )


def _replacements(found: DataFrame) -> DataFrame:
    """(key, edits): disjoint (start, end, tag) in order; overlapping spans are one edit with the base span's tag."""
    edit = "array<struct<start:int,end:int,tag:string>>"

    def tagged(tag: str | None) -> Callable[[Column], Column]:
        return lambda s: F.struct(
            s["start"].alias("start"), s["end"].alias("end"), (F.lit(tag) if tag else s["action"]).alias("tag")
        )

    every = [F.transform(kind, tagged(f"<{kind.upper()}>")) for kind in KINDS]
    ordered = F.array_sort(F.concat(*every, F.transform("terms", tagged(None))))
    one = found.where(F.size(ordered) > 0).select("_key", ordered.alias("all")).dropDuplicates(["_key"])

    def step(acc: Column, s: Column) -> Column:
        over = s["start"] < acc["end"]
        joined = F.struct(
            acc["start"].alias("start"), F.greatest(acc["end"], s["end"]).alias("end"),
            F.when(acc["tag"].startswith("<"), acc["tag"]).otherwise(s["tag"]).alias("tag"),
        )
        return F.struct(
            F.when(over, acc["done"]).otherwise(F.array_append(acc["done"], F.struct(
                acc["start"].alias("start"), acc["end"].alias("end"), acc["tag"].alias("tag")))).alias("done"),
            *[F.when(over, joined[c]).otherwise(s[c]).alias(c) for c in ("start", "end", "tag")],
        )

    first = F.struct(F.array().cast(edit).alias("done"), F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit("").alias("tag"))
    last = F.aggregate("all", first, step, lambda acc: F.array_append(acc["done"], F.struct(
        acc["start"].alias("start"), acc["end"].alias("end"), acc["tag"].alias("tag"))))
    return one.select("_key", last.alias("_edits"))  # its first edit is empty and at 0


def _generalised(word: Column) -> Column:
    return F.when(word.rlike(r"^\p{Lu}"), "<NAME>").when(word.rlike(r"\p{N}"), "<CODE>").otherwise("<WORD>")


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", policy: Policy = Policy()) -> DataFrame:
    """``docs`` with base spans replaced by their kind, and disclosing terms removed or generalised; all rows and columns stay."""
    edits = _replacements(find(docs, id_col, text_col, policy))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    ready = docs.select(row.alias("_row"), row_key(id_col, text_col).alias("_key")).join(edits, "_key", "left")
    text = F.col("_row")[text_col]
    next_start = F.concat(F.transform(F.slice(F.col("_edits"), 2, F.size("_edits")), lambda s: s["start"]), F.array(F.length(text)))

    def edited(item: Column) -> Column:
        s, until = item["edit"], item["until"]
        word = F.substring(text, s["start"] + 1, s["end"] - s["start"])
        tag = F.when(s["tag"] == "generalise", _generalised(word)).when(s["tag"] == "remove", "").otherwise(s["tag"])
        return F.concat(tag, F.substring(text, s["end"] + 1, until - s["end"]))

    items = F.arrays_zip(F.col("_edits").alias("edit"), F.col("_until").alias("until"))
    done = F.array_join(F.transform(items, edited), "")
    ready = ready.withColumn("_until", next_start)
    text = F.when(F.col("_edits").isNull(), text).otherwise(done)
    return ready.select(*[(text if c == text_col else F.col("_row")[c]).alias(c) for c in docs.columns])


def op8_pii_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(find(table(spark, sf_dir, "documents")))
