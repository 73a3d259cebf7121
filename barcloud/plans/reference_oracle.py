"""Reference SQL (DuckDB dialect) for the queries over reference sequences, from the plain definitions."""

from __future__ import annotations

from barcloud.operators.seeds import BAND
from barcloud.plans.reference_catalog import COMMON, OVERLAP, PAD, PAIRS_SQL, READS_SQL, SEED_K, SEED_W, TILE

_LINES = """lines as (
  select p_size, p_partkey, substring(translate(md5(cast(p_partkey as varchar)), '0123456789abcdef', 'ACGTTGCAGATCCATG'), 1, 20 + p_partkey % 13) as bases from part)"""
_CONTIGS = _LINES + """, texts as (
  select p_size, string_agg(bases, '' order by p_partkey) as bases from lines group by p_size
), contigs as (
  select row_number() over (order by p_size) - 1 as chrom_id, 'c' || p_size as name, cast(length(bases) as bigint) as length,
    cast(coalesce(sum(length(bases)) over (order by p_size rows between unbounded preceding and 1 preceding), 0) as bigint) as start, bases from texts)"""

_TILES = _CONTIGS + f""", tiles as (
  select chrom_id, tile, substring(bases, tile * {TILE} + 1, {TILE + OVERLAP}) as bases
  from (select chrom_id, unnest(range(cast(ceil(length / {TILE}.0) as bigint))) as tile, bases from contigs))"""
_READS = _TILES + f""", reads as ({READS_SQL.format(numbers="unnest(range(8))", tiles="tiles")}
), strands as (
  select chrom_id as chrom, tile, j, false as rev, bases from reads
  union all select chrom_id, tile, j, true, reverse(translate(bases, 'ACGT', 'TGCA')) from reads)"""


def _minimizers(name: str, source: str, keys: str) -> str:
    """CTEs: every k-mer, every full window, and the least k-mer of each."""
    code = " + ".join(f"(strpos('ACGT', substring(bases, cast(i + {j + 1} as int), 1)) - 1) * {4 ** (SEED_K - 1 - j)}" for j in range(SEED_K))
    return f""", {name}_k as (
  select {keys}, i, code, code * 2654435761 % 4294967296 as h from (
    select {keys}, i, size, case when strpos(substring(bases, cast(i + 1 as int), {SEED_K}), 'N') = 0 then cast({code} as bigint) end as code from (
      select {keys}, bases, length(bases) as size, unnest(range(length(bases) - {SEED_K - 1})) as i from {source}) a) b
), {name}_w as (
  select {keys}, min({{'h': h, 'qpos': i, 'code': code}}) filter (code is not null) over (
    partition by {keys} order by i rows between current row and {SEED_W - 1} following) as least,
    count(*) over (partition by {keys} order by i rows between current row and {SEED_W - 1} following) as n from {name}_k
), {name} as (select distinct {keys}, least.qpos as qpos, least.code as code from {name}_w where n = {SEED_W} and least is not null)"""


_INDEX = _minimizers("idx", "contigs", "chrom_id")
_HITS = f"""{_minimizers("asked", "strands", "chrom, tile, j, rev")}{_INDEX}, hits as (
  select chrom, tile, j, rev, asked.qpos, chrom_id, idx.qpos as pos, count(*) over (partition by code, chrom, tile, j, rev, asked.qpos) as n
  from asked join idx using (code))"""

_CHAINS = _HITS + f""", d as (select *, pos - qpos as diag from hits
), breaks as (
  select *, case when diag - lag(diag) over (partition by chrom, tile, j, rev, chrom_id order by diag, qpos) > {BAND} then 1 else 0 end as far from d
), numbered_chains as (
  select *, sum(far) over (partition by chrom, tile, j, rev, chrom_id order by diag, qpos rows unbounded preceding) as chain from breaks
), chains as (
  select chrom, tile, j, rev, chrom_id, min(diag) as diag_low, max(diag) as diag_high from numbered_chains group by chrom, tile, j, rev, chrom_id, chain
), ranges as (
  select c.*, strands.bases as q, diag_low - {PAD} as begin, contigs.bases as whole,
    diag_high + length(strands.bases) + {PAD} as stop
  from chains c join strands using (chrom, tile, j, rev) join contigs on c.chrom_id = contigs.chrom_id
), pairs as (
  select *, row_number() over () as id, repeat('N', greatest(-begin, 0)) || substring(whole, greatest(begin, 0) + 1, cast(stop - greatest(begin, 0) as bigint)) as t, diag_high - begin + {PAD} + 1 as width from ranges)"""
#: local alignment of q on t with affine gaps, all cells of all pairs by rows of the read, where each path began carried along
_ALIGNED = """, walk as (
  select id, 0 as i, j, case when j < width then 0 else -100000 end as h, 0 as qb, j as tb, -100000 as f, 0 as fqb, cast(0 as bigint) as ftb
  from (select id, width, unnest(range(length(t) + 1)) as j from pairs) s
  union all
  select id, i, j, h, case when h <= 0 then i when h = d then dqb when h = e then (reach).qb else fqb end,
    case when h <= 0 then j when h = d then dtb when h = e then (reach).tb else ftb end, f, fqb, ftb
  from (select *, case when inside then greatest(first, e) else -100000 end as h from (
    select *, (reach).v - 6 - j as e from (
      select *, max({'v': first + j, 'k': j, 'qb': case when first <= 0 then i when first = d then dqb else fqb end,
          'tb': case when first <= 0 then j when first = d then dtb else ftb end}) over (
          partition by id order by j rows between unbounded preceding and 1 preceding) as reach from (
        select *, case when inside then greatest(0, d, f) else -100000 end as first from (
          select w.id, w.i + 1 as i, w.j, w.j >= w.i + 1 and w.j < w.i + 1 + p.width as inside,
            coalesce(lag(w.h) over n, -100000) + case when substring(p.q, w.i + 1, 1) = substring(p.t, w.j, 1) and substring(p.t, w.j, 1) <> 'N' then 1 else -4 end as d,
            lag(w.qb) over n as dqb, lag(w.tb) over n as dtb, greatest(w.h - 7, w.f - 1) as f,
            case when w.h - 7 >= w.f - 1 then w.qb else w.fqb end as fqb, case when w.h - 7 >= w.f - 1 then w.tb else w.ftb end as ftb
          from walk w join pairs p using (id) where w.i < length(p.q) window n as (partition by w.id order by w.j)) a) b) c) x) y
), best as (
  select id, min({'s': -h, 'j': j, 'i': i, 'qb': qb, 'tb': tb}) as b from walk where h > 0 group by id
), aligned as (
  select pairs.*, -b.s as score, b.qb as q_begin, b.i as q_end, b.tb as t_begin, b.j as t_end from best join pairs using (id))"""


def oracle_sql() -> dict[str, str]:
    return {
        "fasta_contigs": f"with {_CONTIGS} select chrom_id, name, length, start from contigs",
        "fasta_tiles": f"""with {_CONTIGS}, numbered as (
            select chrom_id, unnest(range(cast(ceil(length / {TILE}.0) as bigint))) as tile, bases from contigs)
          select chrom_id, tile, tile * {TILE} as pos, substring(bases, tile * {TILE} + 1, {TILE + OVERLAP}) as bases from numbered""",
        "locate_intervals": f"""with {_CONTIGS}, total as (select cast(sum(length) as bigint) as n from contigs), i as (
            select l_orderkey, l_linenumber, (l_orderkey * 7919 + l_linenumber * 104729) % (2 * n + 40) - 20 as rb, l_partkey % 90 as size, n
            from lineitem, total), r as (select *, rb + size as re, rb >= n as rev from i), s as (
            select *, case when rev then 2 * n - re else rb end as low, case when rev then 2 * n - 1 - rb else re - 1 end as high from r)
          select l_orderkey, l_linenumber, rb, re, chrom_id, name, low - start + 1 as pos, high - start + 1 as pos_end,
            case when chrom_id is not null then rev end as rev
          from s left join contigs on rb >= 0 and re > rb and re <= 2 * n and (rev or re <= n) and low >= start and high < start + length""",
        "minimizer_index": f"with {_CONTIGS}{_INDEX} select code, chrom_id, qpos as pos from idx",
        "seed_hits": f"with {_READS}{_HITS} select chrom, tile, j, rev, qpos as \"at\", chrom_id, pos from hits",
        "seed_chains": f"""with {_READS}{_HITS}, d as (select *, pos - qpos as diag from hits where n <= {COMMON}), b as (
            select *, case when diag - lag(diag) over (partition by chrom, tile, j, rev, chrom_id order by diag, qpos) > {BAND} then 1 else 0 end as far from d),
          c as (select *, sum(far) over (partition by chrom, tile, j, rev, chrom_id order by diag, qpos rows unbounded preceding) as chain from b)
          select chrom, tile, j, rev, chrom_id, min(diag) as diag_low, max(diag) as diag_high, count(distinct qpos) as votes, count(*) as seeds,
            max(qpos) - min(qpos) as covered from c group by chrom, tile, j, rev, chrom_id, chain""",
        "base_alignments": f"""with recursive {_READS}{_CHAINS}{_ALIGNED}
          select chrom, tile, j, rev, chrom_id, diag_low, diag_high, begin + t_begin as pos, score, q_begin, q_end, t_end from aligned""",
        "alignment_quality": f"""with recursive {_READS}{_CHAINS}{_ALIGNED}, scored as (
            select chrom, tile, j, rev, chrom_id, diag_low, score, begin + t_begin as pos, greatest(q_end - q_begin, t_end - t_begin) as size from aligned
          ), paired as (
            select a.*, row_number() over (partition by a.chrom, a.tile, a.j order by a.score desc, a.chrom_id, a.pos, a.rev, a.diag_low) as n from scored a
          ), rivalled as (
            select x.chrom, x.tile, x.j, x.n, greatest({SEED_K}, coalesce(max(y.score), 0)) as second, list(y.score) filter (y.score is not null) as others
            from paired x left join paired y on x.chrom = y.chrom and x.tile = y.tile and x.j = y.j and x.n <> y.n group by all
          ), counted as (
            select p.*, second, len(list_filter(coalesce(others, []), lambda s: s >= second - 5)) as rivals,
              max(score) over (partition by chrom, tile, j) as best, 1 - (size - score) / 5.0 / size as same from paired p join rivalled using (chrom, tile, j, n)
          )
          select chrom, tile, j, rev, chrom_id, diag_low, score, best, second, rivals, cast(greatest(0, least(254, floor(
            6.02 * (score - second) * power(power(same, 2) * case when size > 50 then ln(50) / ln(size) else 1 end, 2) - 4.343 * ln(rivals + 1) + 0.5))) as int) as mapq
          from counted""",
        "mate_rescue": f"""with recursive {_TILES}, mates as ({PAIRS_SQL.format(numbers="unnest(range(2))", tiles="tiles")}
          ), pairs as (
            select row_number() over () as id, m.chrom_id, m.tile, m.j, reverse(translate(two, 'ACGT', 'TGCA')) as q,
              tile * {TILE} + place - 35 - 48 as begin, repeat('N', greatest(-(tile * {TILE} + place - 35 - 48), 0)) ||
              substring(c.bases, greatest(tile * {TILE} + place - 35 - 48, 0) + 1, cast(least(583, tile * {TILE} + place + 500) as bigint)) as t,
              10000 as width
            from mates m join contigs c on m.chrom_id = c.chrom_id){_ALIGNED}
          select chrom_id as chrom, tile, j, true as rev, chrom_id, score, begin + t_end as pos_end from aligned""",
    }
