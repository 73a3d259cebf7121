"""Reference SQL (DuckDB dialect) for the registered queries.

Written from the plain definitions, not from the Spark plans: corrections by cross-joined edits,
the mate term by a self-join, probabilities in log space.
"""

from __future__ import annotations

import math

from barcloud.config import DENSITY_ROUNDS, EM_ROUNDS, get_platform
from barcloud.operators.sam import PROGRAM, VERSION
from barcloud.plans.catalog import N_BUCKETS
from barcloud.plans.lens import _INSERT, CANDIDATES_SQL, READS_SQL

_P = get_platform("10x")
# read pairs of a barcode: those of the candidates lens, and unaligned ones that fill small barcodes up
_PAIRS = "case when bc >= 1000 then greatest(count(distinct ident), 29 + bc % 3) else count(distinct ident) end"


def _with(ctes: list[tuple[str, str]], final: str) -> str:
    body = ",\n".join(f"{name} as materialized ({sql})" for name, sql in ctes)
    return f"with {body}\n{final}"


# ---- reads ------------------------------------------------------------------------------------

def _base(i: int) -> str:
    e = 15 - i
    packed = f"substr('ACGT', cast(floor(obs / {4 ** e}) as bigint) % 4 + 1, 1)"
    return f"case when (n_cnt >= 1 and epos = {e}) or (n_cnt = 2 and (epos + 1) % 16 = {e}) then 'N' else {packed} end"


def _qual(i: int) -> str:
    e = 15 - i
    return f"chr(cast(33 + case when epos = {e} then q_epos else {'q_tail' if i >= 14 else '33'} end as int))"


def _fastq(where: str = "true") -> list[tuple[str, str]]:
    bases = " || ".join(_base(i) for i in range(16))
    quals = " || ".join(_qual(i) for i in range(16))
    lens = READS_SQL.replace("{orders}", f"(select * from orders where {where})")
    return [
        ("lens", lens),
        ("fq", f"""select read_id, '@r' || read_id || ' 1:N:0:1' as name, '@r' || read_id || ' 2:N:0:1' as name2,
            substr(({bases}) || 'TTTTTTT' || repeat('{_INSERT}', 13), 1, r1_len) as r1,
            substr(({quals}) || repeat('F', 140), 1, r1_len) as q1,
            'G' || repeat('{_INSERT[::-1]}', 5) as r2, repeat('I', 51) as q2 from lens"""),
    ]


def _pack(col: str, positions=range(16)) -> str:
    """Arithmetic pack of a 16-base text; N counts as A."""
    terms = [
        f"greatest(instr('CGT', substr({col}, {i + 1}, 1)), 0) * {4 ** (15 - k)}" for k, i in enumerate(positions)
    ]
    return f"cast({' + '.join(terms)} as bigint)"


def _unpack(col: str, n: int = 16) -> str:
    return " || ".join(f"substr('ACGT', ({col} // {4 ** (n - 1 - i)}) % 4 + 1, 1)" for i in range(n))


_NCOUNT = "length(bases) - length(replace(bases, 'N', ''))"


def _keys(where: str = "true") -> list[tuple[str, str]]:
    return _fastq(where) + [
        ("keys", "select substr(r1, 1, 16) as bases, substr(q1, 1, 16) as quals, cast(count(*) as bigint) as n "
                 "from fq where length(r1) >= 32 group by 1, 2"),
        ("wl", "select distinct tru as bc from lens"),
        ("coded", f"select *, {_pack('bases')} as bc, {_NCOUNT} as ns from keys"),
        ("ncnt", "select bc, cast(sum(n) as bigint) as n from coded where ns = 0 and bc in (select bc from wl) group by bc"),
        ("pri", "select wl.bc, cast(coalesce(n, 0) as bigint) as n, "
                "(coalesce(n, 0) + 1) * 1.0 / (select sum(coalesce(n, 0) + 1) from wl left join ncnt using (bc)) as prior "
                "from wl left join ncnt using (bc)"),
    ]


def _p(q: str) -> str:
    return f"power(10.0::double, -least({q}, 33) / 10.0::double)"


def _corrected(double: bool) -> list[tuple[str, str]]:
    q = lambda pos: f"(ascii(substr(quals, cast({pos} as int) + 1, 1)) - 33)"
    ctes = _keys() + [
        ("edit", "select i, x, cast(power(4, 15 - i) as bigint) as unit from range(16) t(i), range(0, 4) u(x)"),
        ("one", f"""select bases, quals, n, bc as cand0, ns, xor(bc, x * unit) as cand, prior * {_p(q('i'))} as p
            from (select k.*, i, x, unit from coded k, edit
                  where (ns = 0 and x > 0 and k.bc not in (select bc from wl))
                     or (ns = 1 and substr(bases, cast(i as int) + 1, 1) = 'N')) e
            join (select bc as wbc, prior from pri) w on w.wbc = xor(e.bc, x * unit)"""),
        ("own", "select bases, quals, k.bc as cand, prior as p from coded k join pri using (bc) where ns = 0"),
    ]
    if double:
        ctes.append(("two", f"""select bases, quals, wbc as cand,
              w.prior * ({_p(f"greatest(3, least({q('i')}, 33) - 1)")} * {_p(f"greatest(3, least({q('j')}, 33) - 1)")}) as p
            from (select k.bases, k.quals, k.bc, a.i, b.i as j, xor(xor(k.bc, a.x * a.unit), b.x * b.unit) as wcand
                  from coded k, edit a, edit b
                  where ns = 0 and k.bc in (select bc from wl) and a.i < b.i and a.x > 0 and b.x > 0) e
            join (select bc as wbc, prior from pri) w on w.wbc = e.wcand"""))
    far = "union all select bases, quals, cand, p, 'H2CHANGE' as kind from two" if double else ""
    ctes += [
        ("opts", f"""select bases, quals, cand, p, 'NOCHANGE' as kind from own
            union all select bases, quals, cand, p, 'H1CHANGE' as kind from one {far}"""),
        ("agg", "select bases, quals, max(p) as max_p, sum(p) as total, arg_max(cand, p) as cand, arg_max(kind, p) as kind "
                "from opts group by bases, quals"),
        ("dec", """select k.bases, k.quals, k.n, k.bc as raw, k.ns,
              case when max_p / total > 0.975 then kind else 'NOBUCKET' end as outcome,
              case when max_p / total > 0.975 then cand end as assigned, max_p / total as ratio
            from coded k left join agg using (bases, quals)"""),
    ]
    return ctes


_DECISIONS = "select bases, quals, n, outcome, assigned, round(ratio, 9) as ratio from dec"


def _bucketed(double: bool) -> list[tuple[str, str]]:
    return _corrected(double) + [
        ("fin", "select assigned as bc, sum(n) as n from dec where assigned is not null group by 1"),
        ("allbc", "select wl.bc, cast(coalesce(n, 0) as bigint) as n from wl left join fin using (bc)"),
        ("cum", "select bc, n, coalesce(sum(n) over (order by bc rows between unbounded preceding and 1 preceding), 0) as before, "
                "(select greatest(sum(n), 1) from allbc) as total from allbc"),
        ("buck", f"select bc, n, cast(least(floor(before * {N_BUCKETS} / total), {N_BUCKETS - 1}) + 1 as integer) as bucket from cum"),
        ("moved", """select bases, quals, case when outcome in ('H1CHANGE', 'H2CHANGE') then assigned
              when ns = 0 and raw in (select bc from wl) then raw end as bc from dec"""),
        ("routed", """select fq.*, m.bc, coalesce(b.bucket, 0) as bucket
            from fq join moved m on substr(r1, 1, 16) = m.bases and substr(q1, 1, 16) = m.quals
            left join buck b on b.bc = m.bc where length(r1) >= 32"""),
    ]


def _shards(bx: bool) -> str:
    n1, n2 = "'@r' || read_id", "'@r' || read_id"
    r1, q1 = "substr(r1, 24)", "substr(q1, 24)"
    nl = "chr(10)"
    fastq = lambda a, b: f"{a} || {nl} || {r1} || {nl} || '+' || {nl} || {q1} || {nl} || {b} || {nl} || r2 || {nl} || '+' || {nl} || q2"
    code = f"({_unpack('bc')})"
    if bx:
        tag = f"' BX:Z:' || {code} || '-1'"
        record = fastq(f"{n1} || {tag}", f"{n2} || {tag}")
    else:
        record = f"{code} || ' ' || {n1} || ' ' || {r1} || ' ' || {q1} || ' ' || r2 || ' ' || q2"
    return _with(_bucketed(False), f"select bucket, case when bucket > 0 then {record} else {fastq(n1, n2)} end as value from routed")


def _haplotag() -> list[tuple[str, str]]:
    seg = lambda k: f"lpad(cast((read_id * {k} + 5) % 100 as varchar), 2, '0')"
    val = lambda k: f"((read_id * {k} + 5) % 100)"
    return _fastq() + [("hap", f"""select read_id, length(r1) as len,
        case when read_id % 9 = 0 then null else 'A' || {seg(7)} || 'C' || {seg(11)} || 'B' || {seg(13)} || 'D' || {seg(17)} end as tag,
        case when read_id % 9 = 0 then null else {val(7)} * 16777216 + {val(11)} * 65536 + {val(13)} * 256 + {val(17)} end as bc,
        case when read_id % 9 = 0 then null else {' and '.join(f'{val(k)} between 1 and 96' for k in (7, 11, 13, 17))} end as listed
        from fq""")]


def _extract() -> str:
    little = _pack("bases")
    return _with(_fastq() + [("b", f"select read_id, obs, {_unpack('obs')} as bases from lens")], f"""
        select read_id, '10x' as platform, obs as bc, '@run:1:' || read_id as ident from b
        union all select read_id, 'haplotag', 16777216 + 2 * 65536 + 3 * 256 + read_id % 96 + 1, '@run:1:' || read_id || '' from
          (select read_id from b) h
        union all select read_id, 'tru', read_id, '@' || read_id from b
        union all select read_id, 'cpt', read_id, '@run:' || read_id from b
        union all select read_id, 'dbs', obs * 256 + 27, '@run:1:' || read_id from b
        union all select read_id, 'tellseq', obs * 16 + 13, '@run:1:' || read_id from b""")


# ---- candidates -------------------------------------------------------------------------------

_KEY = "bc, ident, mate, bwa_rank"


def _scored() -> list[tuple[str, str]]:
    e = _P.error_rate
    mism = "(edit_dist - i_len)"
    runs = "(case when i_len > 0 then 1 else 0 end)"
    score = (f"({{m}} - {mism}) * {math.log(1 - e)!r}::double + {mism} * {math.log(e)!r}::double "
             f"+ {runs} * {math.log(1e-4)!r}::double + s_len * {math.log(0.03)!r}::double").format(m="m_len")
    quality = (f"60::double + {mism} * {math.log10(e)!r}::double + {runs} * {math.log10(1e-4)!r}::double "
               f"+ s_len * {math.log10(0.03)!r}::double")
    cigar = ("m_len || 'M' || case when i_len > 0 then i_len || 'I' else '' end "
             "|| case when s_len > 0 then s_len || 'S' else '' end")
    return [
        ("lens", CANDIDATES_SQL.replace("{lineitem}", "lineitem")),
        ("sc", f"select *, {score} as score, cast(trunc({quality}) as integer) as score_mapq, "
               f"edit_dist + s_len as clip_edit_dist, {cigar} as cigar_text from lens"),
    ]


def _admitted() -> list[tuple[str, str]]:
    return _scored() + [
        ("adm", "select *, chrom * 8589934592 + pos as gpos from (select *, first_value(clip_edit_dist) over "
                "(partition by bc, ident, mate order by bwa_rank) as base0 from sc where s_len < read_len // 2) z "
                "where clip_edit_dist - base0 <= 12"),
    ]


def _clouded() -> list[tuple[str, str]]:
    return _admitted() + [
        ("brk", f"""select *, case when pos - lag(pos) over w <= {_P.dist_thresh} then 0 else 1 end as brk from adm
            window w as (partition by bc, chrom order by pos, ident, mate, bwa_rank)"""),
        ("isl", "select *, sum(brk) over (partition by bc, chrom order by pos, ident, mate, bwa_rank "
                "rows unbounded preceding) as isl from brk"),
        ("cl", "select * exclude (brk, isl, base0), min(pos) over (partition by bc, chrom, isl) as cloud, "
               "count(*) over (partition by bc, chrom, isl, ident, mate) as copies from isl"),
    ]


def _softmax(source: str, logit: str, extra: str = "*") -> str:
    return f"""select * exclude (d, mx, e), e / sum(e) over r as gamma_new from (
        select *, case when {logit} - mx < ln(1e-50) - ln(nc) then 0.0::double else exp({logit} - mx) end as e, 0 as d
        from (select *, max({logit}) over r as mx from {source} window r as (partition by bc, ident, mate)) a) b
        window r as (partition by bc, ident, mate)"""


def _initial(density: bool = False) -> list[tuple[str, str]]:
    before, source = (_annealed(), "dens") if density else (_clouded(), "(select *, true as active from cl)")
    return before + [
        ("cn", f"select *, count(*) over (partition by bc, ident, mate) as nc from {source}"),
        ("ini", "select * rename (gamma_new as gamma) from (" + _softmax("cn", "score") + ") z"),
    ]


def _components() -> str:
    """Labels of smaller clouds spread over links until nothing is new; the least label names the component."""
    ctes = _initial() + [
        ("node", "select distinct bc, ident, mate, (cast(chrom as bigint) << 40) + cloud as u from ini"),
        ("link", "select distinct a.bc, a.u, b.u as v from node a join node b on a.bc = b.bc and a.ident = b.ident and a.mate = b.mate and a.u <> b.u"),
        ("reach", """select distinct bc, u, u as label from node
           union select l.bc, l.v, r.label from reach r join link l on r.bc = l.bc and r.u = l.u where r.label < l.v"""),
        ("comp", "select bc, u, min(label) as component from reach group by 1, 2"),
        ("weight", "select bc, chrom, cloud, (cast(chrom as bigint) << 40) + cloud as u, sum(gamma) as weight from ini group by 1, 2, 3"),
    ]
    final = """select bc, chrom, cloud, component, count(*) over c as n_clouds, round(weight, 6) as weight,
          round(weight / sum(weight) over c, 6) as share
        from weight join comp using (bc, u) window c as (partition by bc, component)"""
    return _with(ctes, final).replace("with ", "with recursive ", 1)


def _mate_term(gamma_table: str) -> str:
    """Per candidate: best of -15 and penalty + ln(gamma) over the mate's candidates in the cloud."""
    return f"""select i.bc, i.ident, i.mate, i.bwa_rank, greatest(-15.0::double, max(
          case when (case when i.rev = 1 then i.pos - j.pos else j.pos - i.pos end) between -35 and 750 then 0.0::double else -15.0::double end
          + ln(j.gamma))) as term
        from {gamma_table} i join {gamma_table} j
          on i.bc = j.bc and i.ident = j.ident and i.mate <> j.mate and i.chrom = j.chrom and i.cloud = j.cloud
             and i.rev <> j.rev and j.gamma > 0
        group by 1, 2, 3, 4"""


def _em(rounds: int, density: bool = False) -> list[tuple[str, str]]:
    ctes = _initial(density) + [
        ("rnk", """select *, row_number() over (partition by bc, chrom, cloud, ident, mate order by pos, bwa_rank) as seen,
            {'a': pos, 'b': ident, 'c': mate, 'd': bwa_rank} as place from ini"""),
        ("bad", "select bc, chrom, cloud, min(place) as hit from rnk where seen = 2 group by 1, 2, 3"),
        ("ord", """select r.*, hit is not null as bad, case when coalesce(place >= hit, false)
              then {'g': gpos - pos + r.cloud, 'l': 1, 'p': 0, 'm': mate, 'r': 0}
              else {'g': gpos - pos + r.cloud, 'l': 0, 'p': pos, 'm': mate, 'r': bwa_rank} end as entry
            from rnk r left join bad b on r.bc = b.bc and r.chrom = b.chrom and r.cloud = b.cloud"""),
        ("lead", "select bc, ident, arg_min(mate, entry) as follower from ord group by 1, 2"),
        ("gate", f"select bc, {_PAIRS} >= 30 as em from lens group by 1"),
        ("g0", "select o.* exclude (entry, place, seen), l.follower <> o.mate as leads, g.em from ord o "
               "join lead l using (bc, ident) join gate g using (bc)"),
    ]
    current = "g0"
    for r in range(rounds):
        weight = f"w{r}"
        summed = "case when active then gamma else 0 end" if r else "gamma"
        ctes.append((weight, f"select bc, chrom, cloud, sum({summed}) as weight from {current} group by 1, 2, 3"))
        for half, who in (("a", "leads"), ("b", "not leads")):
            terms, logits, soft, step = (f"{x}{r}{half}" for x in ("t", "l", "s", "g"))
            ctes += [
                (terms, _mate_term(current)),
                (logits, f"""select c.*, c.score + ln(greatest(w.weight, 1e-300)) + coalesce(t.term, -15.0::double) as logit
                    from {current} c join {weight} w using (bc, chrom, cloud) left join {terms} t using ({_KEY})"""),
                (soft, _softmax(logits, "logit")),
                (step, f"select * exclude (gamma_new, logit) replace (case when em and ({who}) then gamma_new else gamma end as gamma) from {soft}"),
            ]
            current = step
    ctes.append(("post", f"select * from {current}"))
    return ctes


def _selected(density: bool = False) -> list[tuple[str, str]]:
    return _em(EM_ROUNDS, density) + [
        ("rk", "select *, row_number() over w as rn, lead(case when active then gamma else -1 end) over w as g2, lead(chrom) over w as alt_chrom, "
               "lead(pos) over w as alt_pos, lead(rev) over w as alt_rev, lead(cigar_text) over w as alt_cigar, "
               "lead(edit_dist) over w as alt_edit_dist from post "
               "window w as (partition by bc, ident, mate order by active desc, floor(gamma * 1e9 + 0.5) desc, gpos, bwa_rank)"),
        ("best", "select *, gamma <= 0.9 and g2 > 0 as has_alt from rk where rn = 1"),
        ("pairs", """select b.*, m.chrom as mchrom, m.pos as mpos, m.rev as mrev, m.m_len as mlen, m.bc is not null as mapped,
              dense_rank() over (partition by b.bc order by b.chrom, b.cloud) as mi
            from best b left join best m on b.bc = m.bc and b.ident = m.ident and b.mate <> m.mate"""),
        ("sel", "select *, row_number() over (partition by bc, mate, rev, chrom, pos, coalesce(mchrom, -1), coalesce(mpos, -1) "
                "order by ident) > 1 as duplicate from pairs"),
        ("flg", """select *, coalesce(mapped and rev <> mrev and chrom = mchrom
                and (case when rev = 1 then pos - mpos else mpos - pos end) between 0 and 750, false) as proper,
              cast(greatest(0, least(case when gamma <= 0.999999 then trunc(-10 * log10(1 - gamma)) else 60 end, score_mapq, bwa_mapq, 60)) as integer) as mapq,
              cast(case when mapped and chrom = mchrom then -((pos + rev * (m_len - 1) - mpos - mrev * (mlen - 1))
                + sign(pos + rev * (m_len - 1) - mpos - mrev * (mlen - 1))) else 0 end as bigint) as tlen from sel"""),
        ("fl", """select *, cast(1 + case when proper then 2 else 0 end + case when mapped then 0 else 8 end + rev * 16
              + coalesce(mrev, 0) * 32 + case when mate = 0 then 64 else 128 end + case when duplicate then 1024 else 0 end as integer) as flag
            from flg"""),
    ]


def _sam(shared: bool = False) -> str:
    seq = lambda unit: f"repeat({unit}, 20)"
    unit = " || ".join(f"substr('ACGT', (ident + {k}) % 4 + 1, 1)" for k in (0, 1, 3, 2, 0))
    tab = "chr(9)"
    ctes = _selected() + [
        ("rd", f"select ident, {seq('unit')} as r1, repeat('FFFF:', 20) as q1, repeat(reverse(unit), 20) as r2, repeat('IIIIA', 20) as q2 "
               f"from (select distinct l_orderkey as ident, {unit.replace('ident', 'l_orderkey')} as unit from lineitem) z"),
        ("j", f"""select fl.*, case when mate = 0 then r1 else r2 end as s, case when mate = 0 then q1 else q2 end as q,
              case when mate = 0 then r2 else r1 end as os, case when mate = 0 then q2 else q1 end as oq,
              {_unpack('bc')} as code from fl join rd using (ident)"""),
    ]
    if shared:  # the same alignments under a second barcode, whose reads have the mates' bases exchanged
        ctes += [
            ("j1", "select * from j"),
            ("j2", f"""select * exclude (bc, code, s, q, os, oq), bc + 5000 as bc, {_unpack('(bc + 5000)')} as code,
                os as s, oq as q, s as os, q as oq from j1"""),
            ("jj", "select * from j1 union all by name select * from j2"),
        ]
    lines = "jj" if shared else "j"
    rg = f"{tab} || 'RG:Z:rg1'"
    mapped = f""" || {tab} || """.join([
        "ident", "flag", "'chr' || (chrom + 1)", "pos", "mapq", "cigar_text",
        "case when not mapped then '*' when mchrom = chrom then '=' else 'chr' || (mchrom + 1) end",
        "coalesce(mpos, 0)", "tlen",
        "case when rev = 1 then reverse(translate(s, 'ACGT', 'TGCA')) else s end",
        "case when rev = 1 then reverse(q) else q end",
        "'NM:i:' || edit_dist", "'BX:Z:' || code || '-1'", "'XG:f:' || printf('%.5g', gamma)", "'MI:i:' || mi",
        "'XF:i:' || case when bad then 1 else 0 end"])
    xa = (f"case when has_alt then {tab} || 'XA:Z:chr' || (alt_chrom + 1) || ',' || case when alt_rev = 1 then '-' else '+' end "
          "|| alt_pos || ',' || alt_cigar || ',' || alt_edit_dist || ';' else '' end")
    missing = f" || {tab} || ".join([
        "ident", "(5 + rev * 32 + case when mate = 0 then 128 else 64 end)", "'*'", "0", "0", "'*'",
        "'chr' || (chrom + 1)", "pos", "0", "os", "oq", "'BX:Z:' || code || '-1'"])
    return _with(ctes, f"select bc, ident, mate, {mapped} || {rg} || {xa} as line from {lines} "
                       f"union all select bc, ident, 1 - mate, {missing} || {rg} as line from {lines} where not mapped")


def _prefiltered() -> list[tuple[str, str]]:
    return _clouded() + [
        ("a1", "select *, min(clip_edit_dist) over (partition by bc, chrom, cloud, ident, mate) as least_, "
               "count(*) over (partition by bc, chrom, cloud) as recs, max(copies) over (partition by bc, chrom, cloud) as most from cl"),
        ("a2", "select *, most > 1 and recs >= 6 as elig from a1"),
        ("a3", "select *, not (elig and clip_edit_dist > least_ + 5) as active from a2"),
        ("a4", "select *, case when active then pos end as kp, "
               "count(case when active then 1 end) over (partition by bc, chrom, cloud, ident, mate) as choices from a3"),
        ("a5", "select *, count(kp) over c as left_, max(choices) over c as mostc, min(kp) over c as lo "
               "from a4 window c as (partition by bc, chrom, cloud)"),
    ]


def _prefilter() -> str:
    return _with(_prefiltered(), f"select {_KEY}, active, elig and left_ >= 6 and mostc > 1 as anneal from a5")


def _log_density(n: str) -> str:
    dens = ", ".join(f"{math.log(p)!r}::double" for p in _P.density_probs)
    return (f"case when {n} < 4 then list_extract([{dens}], cast({n} + 1 as integer)) "
            f"else {math.log(_P.density_probs[-1])!r}::double - ({n} - 3) * {math.log(2.0)!r}::double end")


def _annealed() -> list[tuple[str, str]]:
    """The density ascent, half-step by half-step; ``dens`` has the candidates with ``active``."""
    read = "bc, chrom, cloud, ident, mate"
    first = "floor(score * 1e9 + 0.5) desc, pos, bwa_rank"
    ctes = _prefiltered() + [
        ("den_b0", "select *, coalesce(active and elig and left_ >= 6 and mostc > 1, false) as ours, (pos - lo) // 1000 as bin from a5"),
        ("den_c0", f"select *, ours and row_number() over (partition by {read}, ours order by {first}) = 1 as chosen from den_b0"),
    ]
    now = "den_c0"
    for k, half in enumerate([0, 1] * DENSITY_ROUNDS):
        ctes += [
            (f"den_d{k}", f"""select *, count(case when chosen then 1 end) over (partition by bc, chrom, cloud, bin) as n_load,
                max(case when chosen and mate = 0 then pos end) over w as p0, max(case when chosen and mate = 0 then rev end) over w as v0,
                max(case when chosen and mate = 1 then pos end) over w as p1, max(case when chosen and mate = 1 then rev end) over w as v1,
                max(case when chosen then bin end) over (partition by {read}) as own
                from {now} window w as (partition by bc, chrom, cloud, ident)"""),
            (f"den_e{k}", f"""select *, case when mate = 0 then p1 else p0 end as mp, case when mate = 0 then v1 else v0 end as mv,
                n_load - case when bin = own then 1 else 0 end as oth from den_d{k}"""),
            (f"den_f{k}", f"""select *, coalesce(rev <> mv and (case when rev = 1 then pos - mp else mp - pos end) between 0 and 750, false) as paired,
                cast(floor((score / 20.0 + ({_log_density('(oth + 1)')}) - ({_log_density('oth')})) * 1e9 + 0.5) as bigint) as worth from den_e{k}"""),
            (f"den_g{k}", f"""select * exclude (chosen, n_load, p0, v0, p1, v1, own, mp, mv, oth, paired, worth),
                case when ours and (ascii(right(md5(cast(ident as varchar)), 1)) + mate) % 2 = {half}
                  then row_number() over (partition by {read}, ours order by paired desc, worth desc, chosen desc, pos, bwa_rank) = 1
                  else chosen end as chosen from den_f{k}"""),
        ]
        now = f"den_g{k}"
    return ctes + [("dens", f"select * exclude (active), case when ours then chosen else active end as active from {now}")]


def _density(final: str) -> str:
    return _with(_clouded() + [
        ("bins", "select bc, chrom, cloud, (pos - cloud) // 1000 as bin, cast(count(*) as bigint) as n from cl group by 1, 2, 3, 4")], final)


def _compat() -> str:
    return _with(_scored() + [
        ("keep", "select * from sc where s_len < read_len // 2"),
        ("z0", "select bc, ident, max(case when mate = 0 then clip_edit_dist end) as b0, max(case when mate = 1 then clip_edit_dist end) as b1 "
               "from keep where bwa_rank = 0 group by 1, 2"),
        ("bl", "select k.*, case when mate = 0 then coalesce(b0, -1) else coalesce(b1, b0, -1) end as base0 "
               "from keep k left join z0 using (bc, ident)"),
    ], f"select {_KEY}, clip_edit_dist from bl where bwa_rank = 0 or clip_edit_dist - base0 <= 12")


def oracle_sql() -> dict[str, str]:
    logs = _log_density("n")
    post = f"select {_KEY}, chrom, cloud, bad, round(gamma, 6) as gamma from post"
    cloud_rows = f"select {_KEY}, chrom, pos, cloud from cl"
    read = "bc, ident, mate"
    h1 = _with(_corrected(False), _DECISIONS)
    return {
        "barcode_count": _with(_keys(), "select bc, n from ncnt"),
        "quality_key_count": _with(_keys(), "select bases, quals, n from keys"),
        "whitelist_file": _with(_fastq(), "select distinct tru as bc from lens"),
        "fastq_file": _with(_fastq(), "select name, r1, q1, name2, r2, q2 from fq"),
        "fastq_block_gzip": _with(_fastq(), "select name, r1, q1, name2, r2, q2 from fq"),
        "barcode_count_file": _with(_keys(), "select bc, n from ncnt"),
        "key_count_file": _with(_keys(), "select bases, quals, n from keys"),
        "single_line_file": _with(_bucketed(False), "select bc, 'r' || read_id as ident, substr(r1, 24) as r1, substr(q1, 24) as q1, r2, q2 from routed where bucket > 0"),
        "sam_header_text": f"""select '@HD' || chr(9) || 'VN:1.3' || chr(9) || 'SO:unsorted' as value
            union all select '@SQ' || chr(9) || 'SN:' || replace(n_name, ' ', '_') || chr(9) || 'LN:' || (n_nationkey + 1000) from nation
            union all select '@RG' || chr(9) || 'ID:rg1'
            union all select concat_ws(chr(9), '@PG', 'ID:{PROGRAM}', 'PN:{PROGRAM}', 'VN:{VERSION}', 'CL:run')""",
        "quality_key_bytes": _with(_keys(), "select " + " || ".join(
            f"printf('%02X', (instr('CGTN', substr(bases, {i}, 1))) * 34 + ascii(substr(quals, {i}, 1)) - 33)" for i in range(1, 17))
            + " as key_hex, n from keys"),
        "read_totals": _with(_keys(), f"""select
            cast((select sum(n) from ncnt) as bigint) as nice_reads, cast((select sum(n) from keys) as bigint) as total_reads,
            cast(sum(case when length(r1) < 32 then 1 else 0 end) as bigint) as ignored_reads,
            cast(sum(length(name) + length(r1) + length(q1) + length(name2) + length(r2) + length(q2) + 10) as bigint) as n_bytes from fq"""),
        "merged_counts": _with(_keys(), "select bases, quals, n from keys"),
        "barcode_pack": _with(_fastq() + [("d", "select distinct substr(r1, 1, 16) as bases from fq")], f"""
            select bases, {_pack('bases')} as big, {_pack('bases', range(15, -1, -1))} as little,
              replace(bases, 'N', 'A') as unpacked, translate(bases, 'ACGTN', '01234') as digits, cast({_NCOUNT} as integer) as n_count from d"""),
        "haplotag_parse": _with(_haplotag(), "select read_id, tag, bc, tag as decoded, coalesce(listed, false) as listed, '@r' || read_id as ident from hap"),
        "haplotag_count": _with(_haplotag(), "select bc, cast(count(*) as bigint) as n from hap where listed and len >= 32 group by bc"),
        "haplotag_route": _with(_haplotag() + [
            ("cnt", "select bc, cast(count(*) as bigint) as n from hap where listed and len >= 32 and read_id % 2 = 0 group by bc"),
            ("run", "select bc, n, coalesce(sum(n) over (order by bc rows between unbounded preceding and 1 preceding), 0) as before, sum(n) over () as total from cnt"),
            ("bk", f"select bc, least(cast(floor(before * {N_BUCKETS} / total) as integer), {N_BUCKETS - 1}) + 1 as bucket from run"),
            ("rd", "select read_id, case when listed then cast(bc as bigint) end as bc from hap where len >= 32 and tag is not null"),
        ], """select read_id, r.bc, cast(case when r.bc is null then 0 else coalesce(k.bucket, (select min(bucket) from bk)) end as integer) as bucket
            from rd r asof left join bk k on r.bc >= k.bc"""),
        "barcode_extract_platforms": _extract(),
        "barcode_prior": _with(_keys(), "select bc, n, round(prior, 12) as prior from pri"),
        "barcode_correct_h1": h1,
        "barcode_correct_h1_n": h1 + " where contains(bases, 'N')",
        "barcode_correct_h1_shuffle": h1,
        "barcode_correct_h2": _with(_corrected(True), _DECISIONS),
        "correction_outcomes": _with(_corrected(True), "select outcome, cast(sum(n) as bigint) as n_reads from dec group by 1"),
        "corrected_counts": _with(_corrected(False), "select assigned as bc, cast(sum(n) as bigint) as n from dec where assigned is not null group by 1"),
        "bucket_assign_cumulative": _with(_bucketed(False), "select bc, n, bucket from buck"),
        "bucket_route": _with(_bucketed(False), "select read_id, bc, bucket from routed"),
        "bucket_route_h2": _with(_bucketed(True), "select read_id, bc, bucket from routed"),
        "trim_and_format": _shards(False),
        "bx_format": _shards(True),
        "alignment_score": _with(_scored(), f"select {_KEY}, round(score, 9) as score, score_mapq, clip_edit_dist from sc"),
        "alignment_score_cigar": _with(_scored(), f"select {_KEY}, round(score, 9) as score, score_mapq, m_len as ref_len, cigar_text from sc"),
        "candidate_filter": _with(_admitted(), f"select {_KEY}, clip_edit_dist from adm"),
        "candidate_filter_compat": _compat(),
        "cloud_build": _with(_clouded(), cloud_rows),
        "cloud_build_spread": _with(_clouded(), cloud_rows),
        "cloud_summary": _with(_clouded(), "select bc, chrom, cloud, cast(count(*) as bigint) as n_candidates, max(pos) as hi, "
                                           "cast(count(distinct ident) as bigint) as n_pairs from cl group by 1, 2, 3"),
        "cloud_collisions": _with(_clouded(), "select bc, chrom, cloud, ident, mate, cast(count(*) as bigint) as n from cl group by 1, 2, 3, 4, 5 having count(*) > 1"),
        "softmax_init": _with(_initial(), f"select {_KEY}, round(gamma, 9) as gamma from ini"),
        "cloud_weight_init": _with(_initial(), "select bc, chrom, cloud, round(sum(gamma), 6) as weight from ini group by 1, 2, 3"),
        "cloud_components": _components(),
        "em_gate": _with(_scored(), f"select bc, cast({_PAIRS} as bigint) as n_pairs, {_PAIRS} >= 30 as em from lens group by 1"),
        "mate_lookup": _with(_admitted() + [("c", f"select {read}, cast(count(*) as bigint) as n_cands from adm group by 1, 2, 3")],
                             "select a.*, b.n_cands as mate_cands from c a left join c b on a.bc = b.bc and a.ident = b.ident and a.mate <> b.mate"),
        "mate_pair_score": _with(_initial() + [("t", _mate_term("ini"))],
                                 f"select {_KEY}, round(coalesce(term, -15.0::double), 6) as mate_term from ini left join t using ({_KEY})"),
        "em_round1": _with(_em(1), post),
        "em_full": _with(_em(EM_ROUNDS), post),
        "em_full_spread": _with(_em(EM_ROUNDS), post),
        "em_full_spread_reads": _with(_em(EM_ROUNDS), post),
        "best_alignment": _with(_selected(), f"select {read}, bwa_rank, chrom, pos, rev = 1 as rev, cloud, cast(mi as integer) as mi, bad, round(gamma, 6) as gamma from sel"),
        "second_best_xa": _with(_selected(), f"select {read}, alt_chrom, alt_pos, alt_rev = 1 as alt_rev, alt_cigar, cast(alt_edit_dist as integer) as alt_edit_dist from best where has_alt"),
        "duplicate_mark": _with(_selected(), f"select {read}, duplicate from sel"),
        "duplicate_mark_spread": _with(_selected(), f"select {read}, cast(mi as integer) as mi, duplicate from sel"),
        "sam_flags": _with(_selected(), f"select {read}, flag, proper, mapq, tlen from fl"),
        "sam_lines": _sam(),
        "sam_lines_shared_names": _sam(shared=True),
        "density_bins": _density("select * from bins"),
        "density_scores": _density(f"select bc, chrom, cloud, bin, round({logs}, 9) as log_density from bins"),
        "density_prefilter": _prefilter(),
        "best_alignment_density": _with(_selected(True), f"select {read}, bwa_rank, chrom, pos, round(gamma, 6) as gamma from sel"),
        "density_anneal": _with(_annealed(), f"select {_KEY}, active from dens"),
        "density_anneal_spread": _with(_annealed(), f"select {_KEY}, active from dens"),
        "barcode_runs": """select min(o_orderkey) as run_start, o_orderstatus, cast(count(*) as bigint) as n
            from (select *, row_number() over (order by o_orderkey) - row_number() over (partition by o_orderstatus order by o_orderkey) as grp from orders) z
            group by o_orderstatus, grp""",
        "session_clouds_events": """with e as (select user_id as bc, epoch_us(ts) as pos, value from events),
            b as (select *, case when pos - lag(pos) over (partition by bc order by pos) <= 21600000000 then 0 else 1 end as brk from e),
            c as (select *, sum(brk) over (partition by bc order by pos rows unbounded preceding) as isl from b)
            select bc, min(pos) as cloud, max(pos) as last, cast(count(*) as bigint) as n, round(sum(value), 4) as total from c group by bc, isl""",
    }
