"""Counting, correction, buckets and routing on small hand-made inputs."""

import pytest
from pyspark.sql import functions as F

from barcloud.config import SkewPolicy
from barcloud.functions import bases as B
from barcloud.operators import buckets, correction, counting
from barcloud.plans import count as count_plan
from barcloud.plans import preproc

PREFIX = "ACGTACGTACGTAC"


def read(name, bases, quals="I" * 16, length=60):
    r1 = (bases + "T" * 7 + "G" * 100)[:length]
    return (name, r1, (quals + "F" * 100)[:length], name, "CC", "II")


def reads_df(spark, rows):
    return spark.createDataFrame(rows, "name string, r1 string, q1 string, name2 string, r2 string, q2 string")


def whitelist_df(spark, barcodes):
    return spark.createDataFrame([(b,) for b in barcodes], "s string").select(B.pack("s").alias("bc"))


def decide(spark, whitelist, rows, double=False, broadcast=True, policy=SkewPolicy()):
    wl = whitelist_df(spark, whitelist)
    counts = count_plan.count(reads_df(spark, rows), wl)
    done = preproc.correct(counts, wl, double, policy, broadcast).decisions
    text = F.when(F.col("assigned").isNotNull(), B.unpack("assigned"))
    return {(r.bases, r.quals): (r.outcome, r.to) for r in done.select("bases", "quals", "outcome", text.alias("to")).collect()}


@pytest.mark.parametrize("broadcast", [True, False])
@pytest.mark.parametrize("known, outcome", [(9, "NOBUCKET"), (99, "H1CHANGE")])
def test_prior_decides_single_edit(spark, known, outcome, broadcast):
    rows = [read(f"@k{i}", PREFIX + "AC") for i in range(known)] + [read("@x", PREFIX + "AT")]
    found = decide(spark, [PREFIX + "AC", PREFIX + "AG"], rows, broadcast=broadcast)
    assert found[(PREFIX + "AT", "B" * 16)] == (outcome, PREFIX + "AC" if outcome == "H1CHANGE" else None)
    assert found[(PREFIX + "AC", "B" * 16)] == ("NOCHANGE", PREFIX + "AC")


@pytest.mark.parametrize("broadcast", [True, False])
def test_n_positions(spark, broadcast):
    n1, n2 = "N" + PREFIX[1:] + "AC", "NN" + PREFIX[2:] + "AC"
    found = decide(spark, [PREFIX + "AC"], [read("@a", n1), read("@b", n2), read("@c", "T" * 16)], broadcast=broadcast)
    assert found[(n1, "B" * 16)] == ("H1CHANGE", PREFIX + "AC")
    assert found[(n2, "B" * 16)] == ("NOBUCKET", None)
    assert found[("T" * 16, "B" * 16)] == ("NOBUCKET", None)


@pytest.mark.parametrize("broadcast", [True, False])
def test_double_edits(spark, broadcast):
    # two barcodes two edits apart; reads of the first, good and bad qualities
    wl = [PREFIX + "AC", PREFIX + "TT"]
    low = "I" * 14 + "##"
    found = decide(spark, wl, [read("@a", wl[0]), read("@b", wl[0], low), read("@c", wl[1]), read("@d", wl[1])], True, broadcast)
    assert found[(wl[0], "B" * 16)][0] == "NOCHANGE"
    assert found[(wl[0], "B" * 14 + "##")][0] == "NOBUCKET"
    rows = [read("@a", wl[0], low)] + [read(f"@{i}", wl[1]) for i in range(400)]
    assert decide(spark, wl, rows, True, broadcast)[(wl[0], "B" * 14 + "##")] == ("H2CHANGE", wl[1])


def test_heavy_base_string_equals_light(spark):
    """One base string with very many quality strings is attached through the broadcast side."""
    rows = [read(f"@{q}{i}", PREFIX + "AT", chr(34 + q) * 16) for q in range(30) for i in range(2)]
    rows += [read(f"@k{i}", PREFIX + "AC") for i in range(200)]
    light = decide(spark, [PREFIX + "AC"], rows)
    heavy = decide(spark, [PREFIX + "AC"], rows, policy=SkewPolicy(max_group_rows=3, max_heavy_keys=8))
    assert light == heavy and len(light) == 31


def test_ignored_reads_and_totals(spark):
    wl = whitelist_df(spark, [PREFIX + "AC"])
    rows = [read("@a", PREFIX + "AC"), read("@b", PREFIX + "AC", length=31), read("@c", PREFIX + "AC", length=32),
            read("@d", PREFIX + "AC", " " + "I" * 15), read("@e", PREFIX.lower() + "ac"), read("@f", "N" + PREFIX[1:] + "AC")]
    totals = counting.read_totals(reads_df(spark, rows), wl).first()
    assert (totals.nice_reads, totals.total_reads, totals.ignored_reads) == (3, 4, 2)
    size = sum(sum(map(len, r)) + 10 for r in rows)
    assert totals.n_bytes == size
    bad = whitelist_df(spark, ["A" * 16])
    with pytest.raises(Exception, match="whitelisted"):
        counting.check_whitelist(bad).collect()


def test_priors_cover_the_whole_whitelist(spark):
    wl = whitelist_df(spark, [PREFIX + x for x in ("AC", "AG", "AT")])
    keys = counting.quality_key_counts(reads_df(spark, [read("@a", PREFIX + "AC")] * 5))
    priors = correction.barcode_priors(wl, counting.whitelisted_counts(keys, wl)).collect()
    assert sum(r.prior for r in priors) == pytest.approx(1)
    assert sorted(r.prior for r in priors) == pytest.approx([1 / 8, 1 / 8, 6 / 8])


def test_buckets_are_balanced_and_total(spark):
    counts = spark.range(5000).select((F.col("id") * 858993 + 7).alias("bc"), (F.col("id") % 13).alias("n"))
    placed = buckets.assign_buckets(counts, 20).collect()
    assert len({r.bc for r in placed}) == len(placed) == 5000
    loads = {b: sum(r.n for r in placed if r.bucket == b) for b in range(1, 21)}
    mean = sum(loads.values()) / 20
    assert max(loads.values()) < mean + 13 and min(loads.values()) > mean - 13
    before = {r.bc: r.before for r in buckets.running_total(counts).collect()}
    running = 0
    for r in sorted(placed, key=lambda r: r.bc):
        assert before[r.bc] == running
        running += r.n


@pytest.mark.parametrize("policy", [SkewPolicy(), SkewPolicy(max_group_rows=2, max_heavy_keys=4, max_broadcast_rows=1)])
@pytest.mark.parametrize("double", [False, True])
def test_routing(spark, policy, double):
    wl = whitelist_df(spark, [PREFIX + "AC", "G" * 16])
    rows = [read(f"@k{i} 1:N", PREFIX + "AC") for i in range(100)]
    rows += [read(f"@x{i} 1:N", PREFIX + "AT") for i in range(7)] + [read("@t 1:N", "T" * 16), read("@n 1:N", "NN" + PREFIX)]
    counts = count_plan.count(reads_df(spark, rows), wl)
    routed = preproc.route(reads_df(spark, rows), preproc.correct(counts, wl, double, policy), 4, double, policy)
    got = {r.name: r.to for r in routed.select("name", F.when(F.col("bucket") > 0, B.unpack("bc")).alias("to")).collect()}
    assert len(got) == len(rows)
    assert all(got[n[0]] == PREFIX + "AC" for n in rows if n[0][1] in "kx")
    assert got["@t 1:N"] is None and got["@n 1:N"] is None
    lines = {r.bucket: r.value for r in buckets.shard_lines(routed.where("name in ('@x1 1:N', '@t 1:N')")).collect()}
    inner = "G" * 37
    assert lines.pop(0) == f"@t\n{inner}\n+\n{'F' * 37}\n@t\nCC\n+\nII"
    assert list(lines.values()) == [f"{PREFIX}AC @x1 {inner} {'F' * 37} CC II"]
    tagged = buckets.shard_lines(routed.where("name = '@x1 1:N'"), bx_format=True).first().value
    assert tagged.split("\n")[0] == f"@x1 BX:Z:{PREFIX}AC-1" == tagged.split("\n")[4]


def test_small_maps_are_routed_in_one_pass(spark, tmp_path):
    wl = whitelist_df(spark, [PREFIX + "AC", "G" * 16])
    reads_df(spark, [read(f"@k{i}", PREFIX + "AC") for i in range(9)] + [read("@x", PREFIX + "AT")]).write.parquet(str(tmp_path / "r"))
    reads = spark.read.parquet(str(tmp_path / "r"))
    corrections = preproc.correct(count_plan.count(reads, wl), wl)
    for rows, scans in ((8_000_000, 1), (2, 2)):
        routed = preproc.route(reads, corrections, 2, policy=SkewPolicy(max_broadcast_rows=rows))
        plan = routed._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("parquet") == scans
        assert routed.where("bucket > 0").count() == 10


def test_ambiguous_known_barcode_keeps_its_raw_bucket(spark):
    """A whitelisted barcode rejected by double edits is still written under its raw barcode."""
    wl = [PREFIX + "AC", PREFIX + "TT"]
    rows = [read("@a", wl[0]), read("@b", wl[0], "I" * 14 + "##"), read("@c", wl[1]), read("@d", wl[1])]
    counts = count_plan.count(reads_df(spark, rows), whitelist_df(spark, wl))
    corrections = preproc.correct(counts, whitelist_df(spark, wl), True)
    routed = preproc.route(reads_df(spark, rows), corrections, 2, True)
    assert {r.name: r.s for r in routed.select("name", B.unpack("bc").alias("s")).collect()}["@b"] == wl[0]


@pytest.mark.parametrize("broadcast", [True, False])
def test_haplotag_counts_and_routing(spark, broadcast):
    tags = ["A01C02B03D04"] * 6 + ["A96C96B96D96", "A00C02B03D04"]
    rows = [(f"@h{i} BX:Z:{t}", "G" * 40, "I" * 40, f"@h{i}", "C", "I") for i, t in enumerate(tags)] + [("@x", "G" * 40, "I" * 40, "@x", "C", "I")]
    df = reads_df(spark, rows)
    counts = counting.haplotag_counts(df)
    assert sorted(r.n for r in counts.collect()) == [1, 6]
    placed = buckets.assign_buckets(counts, 2)
    policy = SkewPolicy(max_group_rows=2, max_heavy_keys=2)
    routed = buckets.route_haplotag(df, placed, policy, broadcast)
    got = {r.name: r.bucket for r in routed.collect()}
    assert len(got) == 8 and got["@h7 BX:Z:A00C02B03D04"] == 0 and got["@h0 BX:Z:A01C02B03D04"] > 0
    line = buckets.shard_lines(routed.where("name like '@h0 %'"), haplotag=True).first().value
    assert line == f"A01C02B03D04 @h0 {'G' * 40} {'I' * 40} C I"
