"""Every registered query: name -> (spark, sf_dir) -> DataFrame over the whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barcloud.config import PLATFORMS, get_platform
from barcloud.functions import alignment as A
from barcloud.functions import bases as B
from barcloud.functions import headers as H
from barcloud.operators import buckets, candidates, clouds, components, correction, counting, density, em, sam
from barcloud.plans import align, lens, preproc
from barcloud.plans.count import count as count_reads
from barcloud.session import cut_lineage, shared_folder, tune
from barcloud.sources import blockgzip, counts, fastq, sinks, tables

P10X = get_platform("10x")
N_BUCKETS = 50
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(tune(spark), sf_dir)

    run.__doc__ = fn.__doc__
    _QUERIES[fn.__name__] = run
    return fn


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def _keys(spark, sf):
    return counting.quality_key_counts(lens.fastq_reads(spark, sf))


def _whitelist(spark, sf):
    return cut_lineage(lens.whitelist(spark, sf))


def _corrections(spark, sf, double=False, broadcast=None):
    whitelist = _whitelist(spark, sf)
    counted = count_reads(lens.fastq_reads(spark, sf), whitelist)
    return preproc.correct(counted, whitelist, double, broadcast=broadcast)


def _corrected(spark, sf, double=False, broadcast=None):
    return _corrections(spark, sf, double, broadcast).decisions


# ---- count ------------------------------------------------------------------------------------

@query
def barcode_count(spark, sf):
    """Reads per whitelisted barcode."""
    return counting.whitelisted_counts(_keys(spark, sf), lens.whitelist(spark, sf))


@query
def quality_key_count(spark, sf):
    return _keys(spark, sf)


@query
def quality_key_bytes(spark, sf):
    """The key as the hex text of its 16 interchange bytes."""
    return _keys(spark, sf).select(F.hex(B.key_binary("bases", "quals")).alias("key_hex"), "n")


@query
def read_totals(spark, sf):
    return counting.read_totals(lens.fastq_reads(spark, sf), lens.whitelist(spark, sf))


@query
def merged_counts(spark, sf):
    """Counts of two inputs (by order status) merged into one table."""
    part = lambda cond: counting.quality_key_counts(lens.fastq_reads(spark, sf, cond))
    return counting.merge_counts(part("o_orderstatus = 'F'"), part("o_orderstatus <> 'F'"))


@query
def barcode_pack(spark, sf):
    """Big- and little-endian packing of observed barcodes and the way back."""
    keys = lens.fastq_reads(spark, sf).select(F.substring("r1", 1, 16).alias("bases")).distinct()
    big = B.pack("bases")
    return keys.select(
        "bases", big.alias("big"), B.pack_little_endian("bases").alias("little"),
        B.unpack(big).alias("unpacked"), B.base_digits("bases").alias("digits"), B.n_count("bases").alias("n_count"))


@query
def haplotag_parse(spark, sf):
    """Header-coded barcodes: text -> code -> text, and membership in the generated whitelist."""
    reads = _haplotag_reads(spark, sf)
    code = B.pack_haplotag(H.bx_tag("name"))
    return reads.select(
        "read_id", H.bx_tag("name").alias("tag"), code.alias("bc"), B.unpack_haplotag(code).alias("decoded"),
        F.coalesce(B.is_haplotag_code(code), F.lit(False)).alias("listed"), H.name_only("name").alias("ident"))


def _haplotag_reads(spark, sf):
    seg = lambda k: F.lpad(((F.col("read_id") * k + 5) % 100).cast("string"), 2, "0")
    tag = F.concat(F.lit("A"), seg(7), F.lit("C"), seg(11), F.lit("B"), seg(13), F.lit("D"), seg(17))
    header = F.when(F.col("read_id") % 9 == 0, F.concat(F.lit("@r"), F.col("read_id").cast("string"))).otherwise(
        F.concat(F.lit("@r"), F.col("read_id").cast("string"), F.lit(" 1:N:0 BX:Z:"), tag))
    return lens.fastq_reads(spark, sf).withColumn("name", header)


@query
def haplotag_count(spark, sf):
    return counting.haplotag_counts(_haplotag_reads(spark, sf))


@query
def haplotag_route(spark, sf):
    """Buckets of header-coded reads when only every second order was counted: uncounted codes have a bucket too."""
    reads = _haplotag_reads(spark, sf)
    counted = cut_lineage(counting.haplotag_counts(reads.where("read_id % 2 = 0")))
    placed = cut_lineage(buckets.assign_buckets(counted, N_BUCKETS))
    return buckets.route_haplotag(reads, placed).select("read_id", "bc", "bucket")


@query
def barcode_extract_platforms(spark, sf):
    """Barcode and identifier of one header per platform and read."""
    reads = lens.reads(spark, sf).select("read_id", "obs")
    rid, bases = F.col("read_id").cast("string"), B.unpack("obs")
    twelve = F.concat(F.lit("A01C02B03D"), F.lpad((F.col("read_id") % 96 + 1).cast("string"), 2, "0"))
    headers = {
        "10x": F.concat(F.lit("@run:1:"), rid, F.lit(" x:"), bases),
        "haplotag": F.concat(F.lit("@run:1:"), rid, F.lit(" BX:Z:"), twelve),
        "tru": F.concat(F.lit("@"), rid),
        "cpt": F.concat(F.lit("@run:"), rid, F.lit(":xx"), rid),
        "dbs": F.concat(F.lit("@run:1:"), rid, F.lit(" BX:Z:"), bases, F.lit("ACGT")),
        "tellseq": F.when(F.col("read_id") % 2 == 0, F.concat(F.lit("@run:1:"), rid, F.lit(":"), bases, F.lit("TC 1:N:0:1")))
        .otherwise(F.concat(F.lit("@run:1:"), rid, F.lit(" BX:Z:"), bases, F.lit("TC"))),
    }
    parts = [F.struct(F.lit(name).alias("platform"), header.alias("header")) for name, header in headers.items()]
    tall = reads.select("read_id", F.inline(F.array(*parts)))
    code, ident = F.lit(None).cast("long"), F.lit(None).cast("string")
    for name in headers:
        here = F.col("platform") == name
        text, rest = H.split_header("header", PLATFORMS[name])
        code = F.when(here, H.encode(text, PLATFORMS[name])).otherwise(code)
        ident = F.when(here, rest).otherwise(ident)
    return tall.select("read_id", "platform", code.alias("bc"), ident.alias("ident"))


# ---- preproc ----------------------------------------------------------------------------------

@query
def barcode_prior(spark, sf):
    whitelist = lens.whitelist(spark, sf)
    priors = correction.barcode_priors(whitelist, counting.whitelisted_counts(_keys(spark, sf), whitelist))
    return priors.select("bc", "n", F.round("prior", 12).alias("prior"))


def _decisions(df):
    return df.select("bases", "quals", "n", "outcome", "assigned",
                     F.round(F.when(F.col("total") > 0, F.col("max_p") / F.col("total")), 9).alias("ratio"))


@query
def barcode_correct_h1(spark, sf):
    return _decisions(_corrected(spark, sf))


@query
def barcode_correct_h1_n(spark, sf):
    """Keys with N only."""
    return _decisions(_corrected(spark, sf).where(F.col("bases").contains("N")))


@query
def barcode_correct_h1_shuffle(spark, sf):
    """The same decisions through the masked-code shuffle join for whitelists too large to broadcast."""
    return _decisions(_corrected(spark, sf, broadcast=False))


@query
def barcode_correct_h2(spark, sf):
    return _decisions(_corrected(spark, sf, double=True))


@query
def correction_outcomes(spark, sf):
    return correction.outcome_histogram(_corrected(spark, sf, double=True))


@query
def corrected_counts(spark, sf):
    return correction.corrected_counts(_corrected(spark, sf))


def _routed(spark, sf, double=False):
    return preproc.route(lens.fastq_reads(spark, sf), _corrections(spark, sf, double), N_BUCKETS, double)


@query
def bucket_assign_cumulative(spark, sf):
    counted = preproc.bucket_counts(_corrections(spark, sf))
    return buckets.assign_buckets(cut_lineage(counted), N_BUCKETS)


@query
def bucket_route(spark, sf):
    return _routed(spark, sf).select("read_id", "bc", "bucket")


@query
def bucket_route_h2(spark, sf):
    return _routed(spark, sf, double=True).select("read_id", "bc", "bucket")


@query
def trim_and_format(spark, sf):
    """Text of every routed pair, single-line records for buckets, FASTQ for the rest."""
    return buckets.shard_lines(_routed(spark, sf))


@query
def bx_format(spark, sf):
    return buckets.shard_lines(_routed(spark, sf), bx_format=True)


# ---- files: written from the given tables, read back by the sources ------------------------------

def _folder(spark, name):
    """A new path in the shared folder, in the form every file system client takes."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    return path[len("file:"):] if path.startswith("file:/") and not path.startswith("file://") else path


@query
def whitelist_file(spark, sf):
    path = _folder(spark, "whitelist")
    lens.whitelist(spark, sf).select(F.concat(B.unpack("bc"), F.lit("-1")).alias("value")).write.text(path)
    return tables.read_whitelist(spark, path)


@query
def fastq_file(spark, sf):
    """Interleaved FASTQ written and read in splits that begin anywhere."""
    path = _folder(spark, "fastq")
    lines = ["name", "r1", F.lit("+"), "q1", "name2", "r2", F.lit("+"), "q2"]
    lens.fastq_reads(spark, sf).select(F.concat_ws("\n", *lines).alias("value")).write.text(path)
    return fastq.read_pairs(spark, path, splitBytes=100_000).select(*fastq.PAIR_FIELDS)


@query
def fastq_block_gzip(spark, sf):
    """Interleaved FASTQ written as block gzip and read in splits of its compressed bytes."""
    path = _folder(spark, "fastq-blocks")
    lines = ["name", "r1", F.lit("+"), "q1", "name2", "r2", F.lit("+"), "q2"]
    blockgzip.write_lines(lens.fastq_reads(spark, sf).select(F.concat_ws("\n", *lines).alias("value")), path)
    return fastq.read_pairs(spark, path, splitBytes=50_000).select(*fastq.PAIR_FIELDS)


@query
def barcode_count_file(spark, sf):
    counts.register(spark)
    path = _folder(spark, "ncnt")
    table = counting.whitelisted_counts(_keys(spark, sf), lens.whitelist(spark, sf))
    table.write.format("barcode_counts").mode("overwrite").save(path)
    return spark.read.format("barcode_counts").load(path)


@query
def key_count_file(spark, sf):
    counts.register(spark)
    path = _folder(spark, "fcnt")
    coded = _keys(spark, sf).select(B.key_binary("bases", "quals").alias("bc_key"), "n")
    coded.write.format("key_counts").mode("overwrite").save(path)
    bases, quals = B.unpack_key("bc_key")
    return spark.read.format("key_counts").load(path).select(bases.alias("bases"), quals.alias("quals"), "n")


@query
def single_line_file(spark, sf):
    """Shards written as single-line records and read as aligner input."""
    path = _folder(spark, "shards")
    routed, load = preproc.route_with_load(lens.fastq_reads(spark, sf), _corrections(spark, sf), N_BUCKETS)
    sinks.write_shards(buckets.shard_lines(routed), path, load)
    return tables.read_single_line(spark, [f"{path}/bucket={b}" for b in range(1, N_BUCKETS + 1)], P10X)


@query
def sam_header_text(spark, sf):
    """Header lines of a contig index rendered from the nations."""
    path = _folder(spark, "fai")
    line = F.format_string("%s\t%d\t7\t60\t61", F.regexp_replace("n_name", " ", "_"), F.col("n_nationkey") + 1000)
    ordered = lens.table(spark, sf, "nation").coalesce(1).sortWithinPartitions("n_nationkey")
    ordered.select(line.alias("value")).write.text(path)
    return sam.sam_header(tables.read_contigs(spark, path), "@RG\tID:rg1", "run")


# ---- align ------------------------------------------------------------------------------------

def _cands(spark, sf):
    return lens.candidates(spark, sf)


CAND_KEY = ["bc", "ident", "mate", "bwa_rank"]


@query
def alignment_score(spark, sf):
    scored = candidates.with_scores(_cands(spark, sf), P10X)
    return scored.select(*CAND_KEY, F.round("score", 9).alias("score"), "score_mapq", "clip_edit_dist")


@query
def alignment_score_cigar(spark, sf):
    """Scores and reference length from CIGAR text."""
    parsed = _cands(spark, sf).withColumn("cigar", A.parse_cigar("cigar_text"))
    scores = A.score_columns("cigar", "edit_dist", P10X)
    return parsed.select(
        *CAND_KEY, F.round(scores["score"], 9).alias("score"), scores["score_mapq"].alias("score_mapq"),
        A.reference_length("cigar").alias("ref_len"), A.cigar_string("cigar").alias("cigar_text"))


@query
def candidate_filter(spark, sf):
    admitted = candidates.prepare(_cands(spark, sf), P10X)
    return admitted.select(*CAND_KEY, "clip_edit_dist")


@query
def candidate_filter_compat(spark, sf):
    admitted = candidates.prepare(_cands(spark, sf), P10X, compat=True)
    return admitted.select(*CAND_KEY, "clip_edit_dist")


def _clouded(spark, sf, layout="auto"):
    return align.clouded_candidates(_cands(spark, sf), layout=layout)


@query
def cloud_build(spark, sf):
    return _clouded(spark, sf).select(*CAND_KEY, "chrom", "pos", "cloud")


@query
def cloud_build_spread(spark, sf):
    """The same clouds through the layout for heavy barcodes."""
    return _clouded(spark, sf, "spread").select(*CAND_KEY, "chrom", "pos", "cloud")


@query
def cloud_summary(spark, sf):
    return clouds.cloud_summary(_clouded(spark, sf))


@query
def cloud_collisions(spark, sf):
    return clouds.collisions(_clouded(spark, sf))


def _initial(spark, sf):
    return align.initial_state(_cands(spark, sf))


@query
def softmax_init(spark, sf):
    return _initial(spark, sf).select(*CAND_KEY, F.round("gamma", 9).alias("gamma"))


@query
def cloud_weight_init(spark, sf):
    return _initial(spark, sf).groupBy(*clouds.CLOUD).agg(F.round(F.sum("gamma"), 6).alias("weight"))


@query
def cloud_components(spark, sf):
    """Components of clouds that share a read, and each cloud's share of its component's weight."""
    found = components.cloud_components(_initial(spark, sf))
    return found.select(*clouds.CLOUD, "component", "n_clouds", F.round("weight", 6).alias("weight"), F.round("share", 6).alias("share"))


@query
def em_gate(spark, sf):
    """Barcodes with enough read pairs, aligned or not, for expectation-maximisation."""
    return _pair_counts(spark, sf).withColumn("em", F.col("n_pairs") >= 30)


def _pair_counts(spark, sf):
    """Read pairs per barcode of the reads lens: small barcodes have unaligned pairs too, up to 29, 30 or 31."""
    key = F.col("l_orderkey")
    bc = F.when(key % 11 == 0, 1000 + key % 509).otherwise(key % 97)
    aligned = lens.table(spark, sf, "lineitem").select(bc.alias("bc"), key.alias("ident")).distinct()
    sizes = aligned.groupBy("bc").agg(F.count("*").alias("n"))
    more = F.when(F.col("bc") >= 1000, 29 + F.col("bc") % 3 - F.col("n")).otherwise(0)
    unaligned = sizes.where(more > 0).select("bc", F.explode(F.sequence(F.lit(-1).cast("long"), -more, F.lit(-1).cast("long"))).alias("ident"))
    return align.read_pair_counts(aligned.unionByName(unaligned))


@query
def mate_lookup(spark, sf):
    """Reads with the number of surviving candidates of their mate (NULL without mate)."""
    reads = candidates.prepare(_cands(spark, sf), P10X).groupBy(*candidates.READ).agg(F.count("*").alias("n_cands"))
    w = candidates.PAIR
    mates = reads.select(*w, (1 - F.col("mate")).alias("mate"), F.col("n_cands").alias("mate_cands"))
    return reads.join(mates, candidates.READ, "left")


@query
def mate_pair_score(spark, sf):
    """Mate term of every candidate under the initial probabilities."""
    supported = align.initial_state(_cands(spark, sf), support=True)
    term = F.ln(F.greatest(F.col("support"), F.lit(em._NO_MATE)))
    return supported.select(*CAND_KEY, F.round(term, 6).alias("mate_term"))


def _posterior(spark, sf, rounds, layout="auto"):
    df = align.posteriors(_cands(spark, sf), rounds=rounds, layout=layout, pair_counts=_pair_counts(spark, sf))
    return df.select(*CAND_KEY, "chrom", "cloud", "bad", F.round("gamma", 6).alias("gamma"))


@query
def em_round1(spark, sf):
    return _posterior(spark, sf, 1)


@query
def em_full(spark, sf):
    return _posterior(spark, sf, 5)


@query
def em_full_spread_reads(spark, sf):
    """The same posteriors through the layout for heavy read pairs."""
    return _posterior(spark, sf, 5, "spread_reads")


@query
def em_full_spread(spark, sf):
    """The same posteriors through the layout for heavy barcodes."""
    return _posterior(spark, sf, 5, "spread")


def _resolved(spark, sf, layout="auto"):
    return align.resolve(_cands(spark, sf), layout=layout, pair_counts=_pair_counts(spark, sf))


READ = ["bc", "ident", "mate"]


@query
def best_alignment(spark, sf):
    return _resolved(spark, sf).select(
        *READ, "bwa_rank", "chrom", "pos", "rev", "cloud", "mi", "bad", F.round("gamma", 6).alias("gamma"))


@query
def second_best_xa(spark, sf):
    alt = F.col("alt")
    return _resolved(spark, sf).where(alt.isNotNull()).select(
        *READ, alt["chrom"].alias("alt_chrom"), alt["pos"].alias("alt_pos"), alt["rev"].alias("alt_rev"),
        alt["cigar_text"].alias("alt_cigar"), alt["edit_dist"].alias("alt_edit_dist"))


@query
def duplicate_mark(spark, sf):
    return _resolved(spark, sf).select(*READ, "duplicate")


@query
def duplicate_mark_spread(spark, sf):
    return _resolved(spark, sf, "spread").select(*READ, "mi", "duplicate")


@query
def sam_flags(spark, sf):
    """FLAG, proper pair, MAPQ and TLEN of every selected alignment."""
    df = _resolved(spark, sf)
    return df.withColumns(sam.flag_columns(df)).select(*READ, "flag", "proper", "mapq", "tlen")


def contigs(spark: SparkSession) -> DataFrame:
    """The five contigs the candidates lens uses."""
    return spark.range(5).select(
        F.col("id").cast("int").alias("chrom_id"), F.concat(F.lit("chr"), (F.col("id") + 1).cast("string")).alias("name"),
        F.lit(4_000_000).cast("long").alias("length"))


def sam_reads(spark, sf):
    """One read pair of 100 bases per barcode and identifier of the candidates lens."""
    key = F.col("l_orderkey")
    bc = F.when(key % 11 == 0, 1000 + key % 509).otherwise(key % 97)
    idents = lens.table(spark, sf, "lineitem").select(bc.alias("bc"), key.alias("ident")).distinct()
    base = lambda k: F.substring(F.lit("ACGT"), ((F.col("ident") + k) % 4 + 1).cast("int"), F.lit(1))
    unit = F.concat(*[base(k) for k in (0, 1, 3, 2, 0)])
    return idents.select(
        "bc", "ident", F.repeat(unit, 20).alias("r1"), F.repeat(F.lit("FFFF:"), 20).alias("q1"),
        F.repeat(F.reverse(unit), 20).alias("r2"), F.repeat(F.lit("IIIIA"), 20).alias("q2"))


@query
def sam_lines(spark, sf):
    records = sam.sam_records(_resolved(spark, sf), sam_reads(spark, sf), contigs(spark), P10X, read_group="@RG\tID:rg1\tSM:s1")
    return records.select("bc", "ident", "mate", sam.sam_line(records).alias("line"))


@query
def sam_lines_shared_names(spark, sf):
    """SAM lines where every read name occurs under two barcodes, with other bases."""
    twice = lambda df: df.unionByName(df.withColumn("bc", F.col("bc") + 5000))
    reads = sam_reads(spark, sf)
    other = reads.select((F.col("bc") + 5000).alias("bc"), "ident", F.col("r2").alias("r1"), F.col("q2").alias("q1"),
                         F.col("r1").alias("r2"), F.col("q1").alias("q2"))
    selected = align.resolve(twice(_cands(spark, sf)), pair_counts=twice(_pair_counts(spark, sf)))
    records = sam.sam_records(selected, reads.unionByName(other), contigs(spark), P10X, read_group="@RG\tID:rg1\tSM:s1")
    return records.select("bc", "ident", "mate", sam.sam_line(records).alias("line"))


@query
def density_bins(spark, sf):
    return density.density_bins(_clouded(spark, sf))


@query
def density_scores(spark, sf):
    """Log density of every bin of every cloud."""
    bins = density.density_bins(_clouded(spark, sf))
    return bins.select(*clouds.CLOUD, "bin", F.round(A.log_density("n", P10X), 9).alias("log_density"))


@query
def density_prefilter(spark, sf):
    """Candidates kept by the edit-distance cut inside colliding clouds, and clouds to anneal."""
    return align.density_decisions(_cands(spark, sf), anneal=False).select(*CAND_KEY, "active", "anneal")


@query
def density_anneal(spark, sf):
    """Active candidates after density optimisation."""
    return align.density_decisions(_cands(spark, sf)).select(*CAND_KEY, "active")


@query
def density_anneal_spread(spark, sf):
    return align.density_decisions(_cands(spark, sf), layout="spread").select(*CAND_KEY, "active")


@query
def best_alignment_density(spark, sf):
    """Best alignments with the density optimisation before expectation-maximisation."""
    df = align.resolve(_cands(spark, sf), density=True, pair_counts=_pair_counts(spark, sf))
    return df.select(*READ, "bwa_rank", "chrom", "pos", F.round("gamma", 6).alias("gamma"))


@query
def barcode_runs(spark, sf):
    """Runs of consecutive reads with equal status, in read order."""
    orders = lens.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return clouds.consecutive_runs(orders, "o_orderstatus", "o_orderkey")


@query
def session_clouds_events(spark, sf):
    """Clouds over event time: gaps above six hours split the events of a user."""
    events = lens.table(spark, sf, "events").select(
        F.col("user_id").alias("bc"), F.unix_micros(F.col("ts").cast("timestamp")).alias("pos"), "value")
    totals = clouds.island_totals(events, "bc", "pos", 6 * 3600 * 1_000_000, "value")
    return totals.select("bc", "cloud", "last", "n", F.round("total", 4).alias("total"))
