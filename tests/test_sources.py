"""Files in and out: FASTQ splits, count files, whitelists, shards, SAM and the command line."""

import gzip
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from barcloud import cli
from barcloud.config import SkewPolicy, get_platform
from barcloud.functions import bases as B
from barcloud.operators import sam
from barcloud.sources import blockgzip, counts, fastq, sinks, tables
from barcloud.streaming import counts as stream

P10X = get_platform("10x")
WL = ["ACGTACGTACGTACGT", "CCCCACGTACGTACGT", "GGGGACGTACGTTTTT"]


def pairs(n, seed=1):
    rng = random.Random(seed)
    word = lambda k, alphabet: "".join(rng.choice(alphabet) for _ in range(k))
    out = []
    for i in range(n):
        r1 = rng.choice(WL) + "T" * 7 + word(rng.randrange(10, 60), "ACGT")
        r2 = word(rng.randrange(20, 70), "ACGTN")
        # '@' and '+' are frequent quality characters
        q1, q2 = "@" + word(len(r1) - 1, "@+5IF"), "@" + word(len(r2) - 1, "@+5IF")
        out.append((f"@r{i} 1:N:0", r1, q1, f"@r{i} 2:N:0", r2, q2))
    return out


def text(rows):
    return "".join(f"{a}\n{b}\n+\n{c}\n{d}\n{e}\n+\n{f}\n" for a, b, c, d, e, f in rows)


@pytest.mark.parametrize("split", [97, 400, 1000, 1 << 20])
def test_fastq_splits_on_any_boundary(spark, tmp_path, split):
    rows = pairs(40)
    (tmp_path / "a.fq").write_text(text(rows[:25]))
    (tmp_path / "b.fq").write_text(text(rows[25:]).rstrip("\n"))  # no final newline
    df = fastq.read_pairs(spark, str(tmp_path), splitBytes=split)
    got = df.orderBy("file_no", "split", "idx").select(*fastq.PAIR_FIELDS).collect()
    assert [tuple(r) for r in got] == rows


@pytest.mark.parametrize("split", [130, 1000, 5003])
def test_fastq_pairs_that_share_one_name(spark, tmp_path, split):
    rows = [("@same 1:N:0", a, b, "@same 2:N:0", c, d) for _, a, b, _, c, d in pairs(60)]
    rows[40] = ("@odd/1", *rows[40][1:3], "@odd/2", *rows[40][4:])
    (tmp_path / "a.fq").write_text(text(rows))
    got = fastq.read_pairs(spark, str(tmp_path), splitBytes=split).orderBy("split", "idx").select(*fastq.PAIR_FIELDS)
    assert [tuple(r) for r in got.collect()] == rows


def packed(rows, sizes):
    """Text of the rows as block gzip whose members have the sizes given, over and over; one of size 0 is empty."""
    data, out, at, i = text(rows).encode(), b"", 0, 0
    while at < len(data):
        size = sizes[i % len(sizes)]
        out += blockgzip.member(data[at : at + size])
        at, i = at + size, i + 1
    return out + blockgzip.END


@pytest.mark.parametrize("same_name", [False, True])
@pytest.mark.parametrize("split", [1, 61, 500, 4000, 1 << 20])
def test_block_gzip_splits_on_any_boundary(spark, tmp_path, split, same_name):
    rows = pairs(14 if split == 1 else 60)
    if same_name:
        rows = [("@same 1", a, b, "@same 2", c, d) for _, a, b, _, c, d in rows]
    step = 3000 if split == 1 else 170
    line = len(text(rows[:1]))  # a member that ends where a row does
    (tmp_path / "a.fq.gz").write_bytes(packed(rows[:35], [line, step, 0, 7, 2 * step, 1]))
    (tmp_path / "b.fq.bgz").write_bytes(packed(rows[35:], [step]))
    got = fastq.read_pairs(spark, str(tmp_path), splitBytes=split).orderBy("file_no", "split", "idx")
    assert [tuple(r) for r in got.select(*fastq.PAIR_FIELDS).collect()] == rows


def test_block_gzip_is_read_by_many_tasks_and_by_other_readers(spark, tmp_path):
    rows = pairs(2000)
    lines = spark.createDataFrame([(line,) for line in text(rows).splitlines()], "value string").coalesce(1)
    blockgzip.write_lines(lines, str(tmp_path / "out"))
    (path,) = (tmp_path / "out").iterdir()
    assert gzip.decompress(path.read_bytes()).decode() == text(rows)
    df = fastq.read_pairs(spark, str(tmp_path / "out"), splitBytes=20_000)
    assert df.select("split").distinct().count() > 1
    assert sorted(map(tuple, df.select(*fastq.PAIR_FIELDS).collect())) == sorted(rows)


def test_block_gzip_corruption_fails(spark, tmp_path):
    data = bytearray(packed(pairs(60), [500]))
    data[len(data) // 2] ^= 0xFF
    (tmp_path / "a.fq.gz").write_bytes(data)
    with pytest.raises(Exception):
        fastq.read_pairs(spark, str(tmp_path / "a.fq.gz")).collect()


def test_counts_of_many_files_a_task_and_overwrite(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(counts, "FILE_RECORDS", 100)
    blocks = (np.arange(k, dtype=np.int64) for k in (60, 60, 250, 30))
    assert [len(g[0]) for g in counts._grouped(blocks)] == [120, 250, 30]
    counts.register(spark)
    path = str(tmp_path / "out")
    for n in (500, 20):
        spark.range(n).selectExpr("id as bc", "id + 1 as n").write.format("barcode_counts").mode("overwrite").save(path)
        got = spark.read.format("barcode_counts").load(path)
        assert sorted(map(tuple, got.collect())) == [(i, i + 1) for i in range(n)]


def test_mates_of_different_names_fail(spark, tmp_path):
    rows = pairs(4)
    rows[2] = (rows[2][0], *rows[2][1:3], "@other 2:N:0", *rows[2][4:])
    (tmp_path / "a.fq").write_text(text(rows))
    with pytest.raises(Exception, match="different names"):
        fastq.read_pairs(spark, str(tmp_path)).collect()


def test_a_rerun_replaces_counts(spark, tmp_path):
    counts.register(spark)
    df, path = spark.range(40).selectExpr("id + 1 as bc", "id as n"), str(tmp_path / "run.ncnt")
    load = lambda: sorted(map(tuple, spark.read.format("barcode_counts").load(path).collect()))
    for tasks in (4, 2):
        df.repartition(tasks).write.format("barcode_counts").mode("overwrite").save(path)
        assert load() == sorted(map(tuple, df.collect()))
    df.write.format("barcode_counts").mode("append").save(path)
    assert len(load()) == 80


def test_unknown_contigs_and_missing_reads_fail(spark):
    names = spark.createDataFrame([(0, "c1", 10)], "chrom_id int, name string, length long")
    df = spark.createDataFrame([("c1",), (None,)], "chrom string")
    assert {r[0] for r in tables.encode_contigs(df, names, "chrom", "code").collect()} == {0, None}
    with pytest.raises(Exception, match="unknown contig c9"):
        tables.encode_contigs(spark.createDataFrame([("c9",)], "chrom string"), names, "chrom", "code").collect()


def test_fastq_gzip_and_truncation(spark, tmp_path):
    rows = pairs(30)
    with gzip.open(tmp_path / "a.fq.gz", "wt") as f:
        f.write(text(rows))
    got = fastq.read_pairs(spark, str(tmp_path / "a.fq.gz")).select(*fastq.PAIR_FIELDS).collect()
    assert [tuple(r) for r in got] == rows
    (tmp_path / "cut.fq").write_text(text(rows[:2])[:-150])
    with pytest.raises(Exception, match="truncated"):
        fastq.read_pairs(spark, str(tmp_path / "cut.fq")).collect()


def test_mate_files_pair_by_position(spark, tmp_path):
    rows = pairs(50, 3)
    one = "".join(f"{a}\n{b}\n+\n{c}\n" for a, b, c, *_ in rows)
    two = "".join(f"{d}\n{e}\n+\n{f}\n" for *_, d, e, f in rows)
    (tmp_path / "1.fq").write_text(one)
    (tmp_path / "2.fq").write_text(two)
    got = fastq.read_mates(spark, str(tmp_path / "1.fq"), str(tmp_path / "2.fq"), splitBytes=700)
    assert sorted(map(tuple, got.select(*fastq.PAIR_FIELDS).collect())) == sorted(rows)
    (tmp_path / "2.fq").write_text("".join(f"{d}\n{e}\n+\n{f}\n" for *_, d, e, f in rows[:-1]))
    with pytest.raises(Exception, match="differ in length"):
        fastq.read_mates(spark, str(tmp_path / "1.fq"), str(tmp_path / "2.fq")).collect()


def test_mates_must_agree_on_the_barcode(spark):
    df = spark.createDataFrame([("@a:ACGTACGTACGTACGT", "A", "I", "@a:CCCCACGTACGTACGT", "C", "I")], ", ".join(f"{c} string" for c in fastq.PAIR_FIELDS))
    with pytest.raises(Exception, match="different barcodes"):
        tables.with_barcodes(df, P10X).collect()


def test_count_files_round_trip(spark, tmp_path):
    counts.register(spark)
    df = spark.range(0, 1000, 1, 3).select((F.lit(2 ** 32 - 1) - F.col("id") * 7).alias("bc"), (F.col("id") + 1).alias("n"))
    path = str(tmp_path / "x.ncnt")
    df.write.format("barcode_counts").mode("append").save(path)
    back = spark.read.format("barcode_counts").option("splitRecords", 64).load(path)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))

    keys = df.select(B.key_binary(B.unpack("bc"), F.lit("I#" + "!" * 14)).alias("bc_key"), "n")
    path = str(tmp_path / "x.fcnt")
    keys.write.format("key_counts").mode("append").save(path)
    back = spark.read.format("key_counts").option("splitRecords", 64).load(path)
    assert sorted((bytes(r[0]), r[1]) for r in back.collect()) == sorted((bytes(r[0]), r[1]) for r in keys.collect())


def test_count_file_layout(spark, tmp_path):
    """Bytes written by hand in the documented layout, two blocks with a recurring key ending in zero bytes."""
    key = bytes([33]) * 14 + b"\0\0"
    block = lambda rows: len(rows).to_bytes(8, "little") + b"".join(k + n.to_bytes(8, "little") for k, n in rows)
    (tmp_path / "a.fcnt").write_bytes(block([(key, 5)]) + block([(key, 2), (b"\x01" * 16, 1)]))
    (tmp_path / "a.ncnt").write_bytes((2).to_bytes(8, "little") + np.array([(4294967295, 3), (1, 9)], np.dtype([("b", "<u4"), ("n", "<i8")])).tobytes())
    merged = cli.read_counts(spark, [str(tmp_path / "a.ncnt")], False)
    assert {r.n for r in merged.keys.collect()} == {7, 1}
    assert {tuple(r) for r in merged.barcodes.collect()} == {(4294967295, 3), (1, 9)}
    (tmp_path / "bad.ncnt").write_bytes((9).to_bytes(8, "little"))
    with pytest.raises(Exception, match="corrupted"):
        spark.read.format("barcode_counts").load(str(tmp_path / "bad.ncnt")).collect()


def test_line_tables(spark, tmp_path):
    (tmp_path / "wl.txt").write_text("\n".join(WL) + "\n")
    assert tables.read_whitelist(spark, str(tmp_path / "wl.txt")).count() == 3
    (tmp_path / "bad.txt").write_text("A" * 16 + "\n")
    with pytest.raises(Exception, match="whitelisted"):
        tables.read_whitelist(spark, str(tmp_path / "bad.txt")).collect()
    (tmp_path / "ref.fa.fai").write_text("chr10\t900\t6\t60\t61\nchr1\t800\t900\t60\t61\n")
    got = tables.read_contigs(spark, str(tmp_path / "ref.fa.fai")).collect()
    assert [tuple(r) for r in got] == [(0, "chr10", 900), (1, "chr1", 800)]
    small = tables.haplotag_whitelist(spark, 4)
    assert small.distinct().count() == 256 and small.where(B.is_haplotag_code("bc")).count() == 256


def test_read_group():
    assert sam.read_group_id(sam.unescape(r"@RG\tID:foo\tSM:bar")) == "foo"
    with pytest.raises(ValueError):
        sam.validate_read_group("@RG ID:foo")


@pytest.mark.parametrize("argv", [
    ["count", "-o", "x", "reads.fq"],
    ["align", "-r", "x", "-o", "y", "--candidates", "c"],
    ["align", "-2", "b", "-r", "x", "-o", "y", "--candidates", "c"],
    ["align", "-1", "a", "-s", "b", "-r", "x", "-o", "y", "--candidates", "c"],
    ["align", "-s", "b", "-r", "x", "-o", "y", "--candidates", "c", "-R", "@RG ID"],
    ["align", "-s", "b", "-r", "x", "-o", "y", "--candidates", "c", "-p", "nope"],
    ["preproc", "-w", "w", "-o", "y", "--reads", "r", "--", "x.txt"],
])
def test_bad_command_lines(argv):
    with pytest.raises(SystemExit):
        cli.main(argv)


def test_count_of_no_reads_is_zero(spark, tmp_path, capsys):
    (tmp_path / "r.fq").write_text("")
    (tmp_path / "wl.txt").write_text("\n".join(WL) + "\n")
    assert cli.main(["count", "-w", str(tmp_path / "wl.txt"), "-o", str(tmp_path / "c"), str(tmp_path / "r.fq")], spark) == 0
    assert "pairs with a listed barcode: 0 of 0 usable" in capsys.readouterr().out


def test_command_line_end_to_end(spark, tmp_path, capsys):
    rows = pairs(60, 5)
    # one damaged barcode, one short read
    name, r1, q1, *rest = rows[0]
    rows[0] = (name, "T" + r1[1:], "#" + q1[1:], *rest)
    rows[1] = (rows[1][0], rows[1][1][:20], rows[1][2][:20], *rows[1][3:])
    (tmp_path / "r.fq").write_text(text(rows))
    (tmp_path / "wl.txt").write_text("\n".join(WL) + "\n")
    path = lambda p: str(tmp_path / p)
    assert cli.main(["count", "-w", path("wl.txt"), "-o", path("c"), path("r.fq")], spark) == 0
    assert "pairs with a listed barcode: 58 of 59 usable" in capsys.readouterr().out  # seen by the jobs that write
    assert cli.main(["preproc", "-w", path("wl.txt"), "-n", "2", "-o", path("out"), "--reads", path("r.fq"), "--", path("c.ncnt")], spark) == 0
    single = tables.read_single_line(spark, [path("out/bucket=1"), path("out/bucket=2")], P10X)
    got = {r.ident: r for r in single.withColumn("s", B.unpack("bc")).collect()}
    assert len(got) == 59 and "r1" not in got
    for n, r1, q1, _, r2, q2 in rows[2:]:
        r = got[n.split()[0][1:]]
        assert (r.s, r.r1, r.q1, r.r2, r.q2) == (r1[:16], r1[23:], q1[23:], r2, q2)

    idents = [(r.bc, k, m) for k, r in sorted(got.items()) for m in (0, 1) if not (m == 1 and k == "r5")]
    cands = spark.createDataFrame(
        [(bc, k, m, 0, "chr1", 100 + 7 * int(k[1:]) + 200 * m, bool(m), 1, 60, f"{len((got[k].r1, got[k].r2)[m])}M", len((got[k].r1, got[k].r2)[m])) for bc, k, m in idents],
        "bc long, ident string, mate long, bwa_rank long, chrom string, pos long, rev boolean, edit_dist long, bwa_mapq long, cigar string, read_len long")
    cands.write.parquet(path("cands"))
    (tmp_path / "ref.fa.fai").write_text("chr1\t90000\t6\t60\t61\n")
    cli.main(["align", "-x", "-r", path("ref.fa"), "-o", path("sam"), "-R", r"@RG\tID:g1\tSM:s", "-i", "7", "--candidates", path("cands"),
              "--", path("out/bucket=1"), path("out/bucket=2")], spark)
    header = [r.value for r in spark.read.text(path("sam/header")).collect()]
    assert header[:3] == ["@HD\tVN:1.3\tSO:unsorted", "@SQ\tSN:chr1\tLN:90000", "@RG\tID:g1\tSM:s"] and header[3].startswith("@PG\tID:")
    lines = [r.value.split("\t") for r in spark.read.text(path("sam/body")).collect()]
    assert len(lines) == 2 * 59
    assert all(a[0] == b[0] for a, b in zip(lines[::2], lines[1::2]))  # mates are adjacent
    flags = {(l[0], int(l[1]) & 0xC0): int(l[1]) for l in lines}
    assert flags[("r2", 64)] & ~1024 == 99 and flags[("r2", 128)] & ~1024 == 147
    assert flags[("r5", 64)] & ~1024 == 73 and flags[("r5", 128)] == 133
    mapped = next(l for l in lines if l[0] == "r2" and int(l[1]) & 128)
    assert "RG:Z:g1" in mapped and f"BX:Z:{got['r2'].s}-7" in mapped and "NM:i:1" in mapped


def test_streaming_counts_equal_batch(spark, tmp_path):
    rows = pairs(80, 9)
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in fastq.PAIR_FIELDS))
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = stream.barcode_counts(source).writeStream.outputMode("complete").format("memory").queryName("bc_counts").start()
    query.processAllAvailable()
    query.stop()
    got = {tuple(r) for r in spark.table("bc_counts").collect()}
    batch = stream.barcode_counts(df)
    assert got == {tuple(r) for r in batch.collect()} and sum(n for _, n in got) == 80
    wl = spark.createDataFrame([(WL[0],)], "s string").select(B.pack("s").alias("bc"))
    assert stream.whitelisted(batch, wl).count() == 1


def test_streaming_sessions(spark, tmp_path):
    rows = [("u", 0), ("u", 50), ("u", 200), ("v", 10), ("z", 100_000)]
    df = spark.createDataFrame(rows, "k string, s long").select("k", F.timestamp_seconds("s").alias("ts"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    out = stream.sessions(source, "k", "ts", "100 seconds", "10 seconds")
    query = out.writeStream.outputMode("append").format("memory").queryName("sess").start()
    query.processAllAvailable()
    query.stop()
    assert sorted((r.k, r.n) for r in spark.table("sess").collect()) == [("u", 1), ("u", 2), ("v", 1)]


@pytest.mark.parametrize("kind", ["fastq", "fasta"])
def test_splits_read_little_beyond_their_bytes_and_grow_with_the_input(tmp_path, monkeypatch, kind):
    from barcloud.sources import fasta, files

    path, count = str(tmp_path / f"reads.{kind}"), 4000
    record = lambda i: f"@r{i}\n{'ACGT' * 30}\n+\n{'F' * 120}\n" * 2 if kind == "fastq" else f">c{i}\n{'ACGT' * 30}\n"
    (tmp_path / f"reads.{kind}").write_text("".join(record(i) for i in range(count)))
    make = lambda p: fastq.FastqReader({"path": p, "splitBytes": "20000"}, True) if kind == "fastq" else fasta.FastaReader({"path": p, "splitBytes": "20000"})
    taken = []
    local = files.filesystem(path)[0]

    class Stream:
        def __init__(self, stream):
            self.seek, self._stream = stream.seek, stream

        def read(self, size):
            taken.append(len(data := self._stream.read(size)))
            return data

        def read_at(self, size, at):
            taken.append(len(data := self._stream.read_at(size, at)))
            return data

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self._stream.close()

    class System:
        get_file_info = local.get_file_info

        def open_input_file(self, name):
            return Stream(local.open_input_file(name))

    monkeypatch.setattr(files, "filesystem", lambda p: (System(), p))
    splits = make(path).partitions()
    batches = [b for s in splits for b in make(path).read(s)]
    names = [n for b in batches for n in b.column("name" if kind == "fastq" else "header").to_pylist() if n]
    assert [int(n[2 if kind == "fastq" else 1:]) for n in names] == list(range(count))
    assert sum(taken) <= len(splits) * (20_000 + 5 * (1 << 16))
    monkeypatch.undo()
    large = tmp_path / "large"
    with large.open("wb") as out:
        out.truncate(3 << 30)
    parts = make(str(large)).partitions()
    assert len(parts) <= files.MAX_SPLITS and parts[-1].end == 3 << 30


def test_no_task_writes_two_buckets(spark, tmp_path):
    lines = spark.range(6000).select((F.col("id") % 60).cast("int").alias("bucket"), F.col("id").cast("string").alias("value"))
    load = lines.groupBy("bucket").agg(F.count("*").alias("n")).where("bucket != 59")
    sinks.write_shards(lines, str(tmp_path / "shards"), load, SkewPolicy(target_file_rows=70))
    back = spark.read.text(str(tmp_path / "shards"))
    assert sorted((r.bucket, r.value) for r in back.collect()) == sorted((i % 60, str(i)) for i in range(6000))
    files = [(f.parent.name, f.name.split("-")[1]) for f in (tmp_path / "shards").glob("bucket=*/part-*") if f.parent.name != "bucket=59"]
    assert len({task for _, task in files}) == len(files) == 2 * 59
