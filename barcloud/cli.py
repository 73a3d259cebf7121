"""Command line: ``python -m barcloud count|preproc|align|help``.

Inputs are paths instead of standard input; ``-t`` is accepted and ignored, Spark decides on tasks.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from barcloud.config import DEFAULT_PLATFORM, PLATFORMS, get_platform
from barcloud.functions import bases as B
from barcloud.functions.alignment import parse_cigar, cigar_string, cigar_sum, reference_length
from barcloud.operators import buckets, correction, counting, sam
from barcloud.plans import align as align_plan
from barcloud.plans import count as count_plan
from barcloud.plans import preproc as preproc_plan
from barcloud.session import tune
from barcloud.sources import counts as count_files
from barcloud.sources import fastq, files, sinks, tables

NCNT, FCNT = ".ncnt", ".fcnt"


def build_parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="barcloud", description="Linked-read analytics on Spark.")
    modes = parser.add_subparsers(dest="mode", required=True)

    count = modes.add_parser("count", help="count barcodes of interleaved FASTQ")
    count.add_argument("-w", dest="whitelist", help="barcode whitelist (not needed with -p)")
    count.add_argument("-o", dest="out", required=True, help="output prefix")
    count.add_argument("-p", dest="haplotag", action="store_true", help="haplotag barcodes")
    count.add_argument("reads", nargs="+", help="interleaved FASTQ files")

    pre = modes.add_parser("preproc", help="correct barcodes and shard reads", add_help=False)
    pre.add_argument("--help", action="help")
    pre.add_argument("-w", dest="whitelist")
    pre.add_argument("-n", dest="buckets", type=int, default=500, help="how many buckets (500)")
    pre.add_argument("-h", dest="double", action="store_true", help="correct two substitutions too")
    pre.add_argument("-o", dest="out", required=True, help="output directory")
    pre.add_argument("-b", dest="bx", action="store_true", help="BX:Z-tagged FASTQ output")
    pre.add_argument("-p", dest="haplotag", action="store_true")
    pre.add_argument("-t", dest="threads", type=int, default=1)
    pre.add_argument("--reads", nargs="+", required=True, help="interleaved FASTQ files")
    pre.add_argument("counts", nargs="*", help=f"outputs of count (*{NCNT})")

    al = modes.add_parser("align", help="choose the best alignment of every read")
    al.add_argument("-1", dest="first")
    al.add_argument("-2", dest="second")
    al.add_argument("-s", dest="single", help="single-line record file or directory")
    al.add_argument("-x", dest="multi", action="store_true", help="several single-line inputs after the options")
    al.add_argument("-r", dest="reference", required=True, help="reference FASTA; its .fai index is read")
    al.add_argument("-o", dest="out", required=True)
    al.add_argument("-R", dest="read_group")
    al.add_argument("-d", dest="density", action="store_true", help="optimise the density of reads in clouds")
    al.add_argument("-p", dest="platform", default=DEFAULT_PLATFORM, choices=sorted(PLATFORMS))
    al.add_argument("-i", dest="index", default="1", help="index after the BX tag [1]")
    al.add_argument("-t", dest="threads", type=int, default=1)
    al.add_argument("--candidates", required=True, help="Parquet table of candidate alignments")
    al.add_argument("inputs", nargs="*")

    modes.add_parser("help", help="show the options of all modes")
    return parser


def validate(parser: argparse.ArgumentParser, args) -> None:
    if args.mode in ("count", "preproc") and not args.whitelist and not args.haplotag:
        parser.error("-w is needed: only haplotag barcodes (-p) come without a whitelist file")
    if args.mode == "preproc":
        for path in args.counts:
            if not path.endswith(NCNT):
                parser.error(f"count outputs end with {NCNT}: {path}")
            try:
                files.expand(path)
                if not args.haplotag:
                    files.expand(_sibling(path))
            except FileNotFoundError as missing:
                parser.error(f"cannot find {missing}")
    if args.mode == "align":
        if args.second and not args.first:
            parser.error("-2 needs -1 beside it")
        if bool(args.first) + bool(args.single) + args.multi != 1:
            parser.error("give the reads in one way: -1 (and -2), -s or -x")
        if args.read_group:
            args.read_group = sam.unescape(args.read_group)
            try:
                sam.validate_read_group(args.read_group)
            except ValueError as problem:
                parser.error(str(problem))


def _sibling(path: str) -> str:
    return path[: -len(NCNT)] + FCNT


def run_count(spark: SparkSession, args) -> None:
    reads = fastq.read_pairs(spark, ",".join(args.reads))
    whitelist = None if args.haplotag else tables.read_whitelist(spark, args.whitelist)
    counts = count_plan.count(reads, whitelist, args.haplotag)
    count_files.register(spark)
    listed = _write_observed(counts.barcodes, "barcode_counts", args.out + NCNT)
    usable = ""
    if counts.keys is not None:
        coded = counts.keys.select(B.key_binary("bases", "quals").alias("bc_key"), "n")
        usable = f" of {_write_observed(coded, 'key_counts', args.out + FCNT)} usable"
    print(f"pairs with a listed barcode: {listed}{usable}")


def _write_observed(table: DataFrame, source: str, path: str) -> int:
    """Writes a table of counts and returns their sum, observed by the job that writes: no job of its own."""
    seen = Observation()
    table.observe(seen, F.sum("n").alias("pairs")).write.format(source).mode("overwrite").save(path)
    return seen.get.get("pairs") or 0


def read_counts(spark: SparkSession, paths: list[str], haplotag: bool) -> count_plan.Counts:
    """Counts of several runs merged into one."""
    count_files.register(spark)
    barcodes = spark.read.format("barcode_counts").load(",".join(paths))
    keys = None
    if not haplotag:
        bases, quals = B.unpack_key("bc_key")
        raw = spark.read.format("key_counts").load(",".join(map(_sibling, paths)))
        merged = counting.merge_counts(raw)
        keys = merged.select(bases.alias("bases"), quals.alias("quals"), "n")
    return count_plan.Counts(keys, counting.merge_counts(barcodes))


def run_preproc(spark: SparkSession, args) -> None:
    if not args.counts:
        print("no inputs given: there is nothing to process", file=sys.stderr)
        return
    reads = fastq.read_pairs(spark, ",".join(args.reads))
    counts = read_counts(spark, args.counts, args.haplotag)
    if args.haplotag:
        routed, load = preproc_plan.route_haplotag(reads, counts, args.buckets)
    else:
        whitelist = tables.read_whitelist(spark, args.whitelist)
        corrections = preproc_plan.correct(counts, whitelist, args.double)
        outcomes = correction.outcome_histogram(corrections.decisions).orderBy("outcome").collect()
        print("pairs by correction:", ", ".join(f"{r['n_reads']} {r['outcome']}" for r in outcomes))
        routed, load = preproc_plan.route_with_load(reads, corrections, args.buckets, args.double)
    lines = buckets.shard_lines(routed, args.bx, args.haplotag)
    sinks.write_shards(lines, args.out, load)


def read_inputs(spark: SparkSession, args, platform) -> DataFrame:
    """bc, ident, r1, q1, r2, q2 of whichever input form was given."""
    if args.first and args.second:
        return tables.with_barcodes(fastq.read_mates(spark, args.first, args.second), platform)
    if args.first:
        return tables.with_barcodes(fastq.read_pairs(spark, args.first), platform)
    return tables.read_single_line(spark, args.inputs if args.multi else args.single, platform)


def read_candidates(spark: SparkSession, path: str, contigs: DataFrame) -> DataFrame:
    """Candidates table; contig names are coded and CIGAR text is parsed when given that way."""
    df = spark.read.parquet(path)
    if dict(df.dtypes)["chrom"] == "string":
        df = tables.encode_contigs(df.withColumnRenamed("chrom", "_name"), contigs, "_name", "chrom")
    if dict(df.dtypes).get("cigar") == "string":
        df = df.withColumn("cigar", parse_cigar("cigar"))
    derived = {"cigar_text": cigar_string("cigar"), "ref_len": reference_length("cigar"), "clip": cigar_sum("cigar", ("S", "H"))}
    return df.withColumns({k: v for k, v in derived.items() if k not in df.columns})


def run_align(spark: SparkSession, args) -> None:
    if args.multi and not args.inputs:
        print("no inputs given: there is nothing to process", file=sys.stderr)
        return
    platform = get_platform(args.platform)
    contigs = tables.read_contigs(spark, args.reference + ".fai")
    reads = read_inputs(spark, args, platform)
    selected = align_plan.resolve(
        read_candidates(spark, args.candidates, contigs), platform, density=args.density,
        pair_counts=align_plan.read_pair_counts(reads))
    records = sam.sam_records(selected, reads, contigs, platform, args.index, args.read_group)
    sinks.write_sam(records, contigs, args.out, args.read_group, " ".join(["barcloud", *sys.argv[1:]]))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = build_parser()
    args = parser.parse_args(argv)
    if args.mode == "help":
        parser.print_help()
        return 0
    validate(parser, args)
    session = tune(spark or SparkSession.builder.appName("barcloud").getOrCreate())
    {"count": run_count, "preproc": run_preproc, "align": run_align}[args.mode](session, args)
    return 0
