"""Oracle SQL for the metric queries: BLEU / chrF in n-gram explode form, distances."""

from __future__ import annotations

# metric_pairs view over whole documents: hypothesis drops every 7th word.
METRIC_PAIRS = r"""mp as (
  select doc_id, array_to_string(list_filter(w, lambda x, i: (i-1)%7<>3),' ') hyp, array_to_string(w,' ') ref
  from (select doc_id, string_split(regexp_replace(text,'\s+',' ','g'),' ') w from documents))"""

_PUNCT = r"[\x7b-\x7e\x5b-\x60\x20-\x26\x28-\x2b\x3a-\x40\x2f]"


def strip(x: str) -> str:
    return rf"regexp_replace({x},'^\s+|\s+$','','g')"


def tok13a(x: str) -> str:
    s = (f"replace(replace(replace(replace(replace(replace(replace({strip(x)},'<skipped>',''),"
         r"'-' || chr(10),''),chr(10),' '),'&quot;','\"'),'&amp;','&'),'&lt;','<'),'&gt;','>')")
    s = f"regexp_replace(' ' || {s} || ' ', '({_PUNCT})', ' \\1 ', 'g')"
    s = rf"regexp_replace({s}, '([^0-9])([\.,])', '\1 \2 ', 'g')"
    s = rf"regexp_replace({s}, '([\.,])([^0-9])', ' \1 \2', 'g')"
    s = rf"regexp_replace({s}, '([0-9])(-)', '\1 \2 ', 'g')"
    return f"list_filter(regexp_split_to_array({s}, '\\s+'), lambda t: t <> '')"


def _clip_ctes(prefix: str, src: str, units: str, sep: str, orders: int) -> str:
    """CTEs {prefix}_stats(doc_id, n, h, r, m) over sides h/r of table ``src``.

    ``units(side)`` is the list of units (tokens or characters) of a side; n-grams are
    built with ``lead`` windows (linear in the text length)."""
    def grams(side: str) -> str:
        leads = ", ".join(f"lead(u,{j}) over (partition by doc_id order by i) u{j}" for j in range(1, orders))
        parts = [f"select doc_id, 1 n, u g from {prefix}_{side}w"]
        for n in range(2, orders + 1):
            expr = " || ".join(["u"] + [f"'{sep}' || u{j}" if sep else f"u{j}" for j in range(1, n)])
            parts.append(f"select doc_id, {n} n, {expr} g from {prefix}_{side}w where u{n - 1} is not null")
        return f"""{prefix}_{side}u as (select doc_id, unnest(l) u, generate_subscripts(l,1) i
                 from (select doc_id, {units(side)} l from {src})),
{prefix}_{side}w as (select doc_id, i, u, {leads} from {prefix}_{side}u),
{prefix}_{side}g as ({" union all ".join(parts)})"""
    return f"""{grams('h')},
{grams('r')},
{prefix}_hc as (select doc_id, n, g, count(*) c from {prefix}_hg group by all),
{prefix}_rc as (select doc_id, n, g, count(*) c from {prefix}_rg group by all),
{prefix}_m as (select doc_id, n, sum(least(a.c, b.c)) m from {prefix}_hc a join {prefix}_rc b using (doc_id, n, g)
          group by all),
{prefix}_len as (select doc_id, len({units('h')}) lh, len({units('r')}) lr from {src}),
{prefix}_stats as (select s.doc_id, o.n, greatest(s.lh-o.n+1, 0) h, greatest(s.lr-o.n+1, 0) r,
                 coalesce(m.m, 0) m
          from {prefix}_len s cross join (select unnest(range(1,{orders + 1})) n) o
          left join {prefix}_m m on m.doc_id = s.doc_id and m.n = o.n)"""


def bleu_ctes(pairs: str = METRIC_PAIRS) -> str:
    return pairs + f""",
btk as (select doc_id, {tok13a('hyp')} h, {tok13a('ref')} r,
               length({strip('hyp')}) > 0 and length({strip('ref')}) > 0 nonblank from mp),
""" + _clip_ctes("b", "btk", lambda side: side, " ", 4) + """,
brow as (select doc_id,
  sum(case when n=1 then m end)::BIGINT m1, sum(case when n=2 then m end)::BIGINT m2,
  sum(case when n=3 then m end)::BIGINT m3, sum(case when n=4 then m end)::BIGINT m4,
  sum(case when n=1 then h end)::BIGINT t1, sum(case when n=2 then h end)::BIGINT t2,
  sum(case when n=3 then h end)::BIGINT t3, sum(case when n=4 then h end)::BIGINT t4,
  sum(case when n=1 then h end)::BIGINT hyp_len, sum(case when n=1 then r end)::BIGINT ref_len
  from b_stats group by doc_id)"""


def bleu_formula(t: str) -> str:
    """BLEU from columns m1..m4, t1..t4, hyp_len, ref_len of relation ``t``."""
    z = ["(m1=0)::INT", "(m1=0)::INT+(m2=0)::INT", "(m1=0)::INT+(m2=0)::INT+(m3=0)::INT",
         "(m1=0)::INT+(m2=0)::INT+(m3=0)::INT+(m4=0)::INT"]
    p = [f"ln(case when m{i}=0 then 100.0/(pow(2.0,{z[i - 1]})*t{i}) else 100.0*m{i}/t{i} end)" for i in range(1, 5)]
    return f"""(select *, case when t1=0 or m1+m2+m3+m4=0 then 0.0 else
      (case when hyp_len >= ref_len then 1.0 when hyp_len > 0 then exp(1 - ref_len/hyp_len) else 0.0 end) *
      exp(case when t2=0 then {p[0]}
               when t3=0 then ({p[0]}+{p[1]})/2
               when t4=0 then ({p[0]}+{p[1]}+{p[2]})/3
               else ({p[0]}+{p[1]}+{p[2]}+{p[3]})/4 end) end bleu
    from {t})"""


def chrf_ctes(lower: bool, prefix: str) -> str:
    lo = (lambda x: f"lower({x})") if lower else (lambda x: x)
    return f"""{prefix}tk as (select doc_id, {lo(f"regexp_replace(hyp,'\\s','','g')")} h,
               {lo(f"regexp_replace(ref,'\\s','','g')")} r,
               length({strip('hyp')}) > 0 and length({strip('ref')}) > 0 nonblank from mp),
""" + _clip_ctes(prefix, f"{prefix}tk", lambda side: f"string_split({side}, '')", "", 6) + f""",
{prefix}row as (select doc_id, """ + ", ".join(
        f"sum(case when n={i} then h end)::BIGINT h{i}, sum(case when n={i} then r end)::BIGINT r{i}, "
        f"sum(case when n={i} then m end)::BIGINT c{i}" for i in range(1, 7)) + f" from {prefix}_stats group by doc_id)"


def chrf_formula(t: str) -> str:
    both = [f"(h{i}>0 and r{i}>0)" for i in range(1, 7)]
    eff = "+".join(f"{b}::INT" for b in both)
    psum = "+".join(f"case when {b} then c{i}/h{i} else 0.0 end" for i, b in enumerate(both, 1))
    rsum = "+".join(f"case when {b} then c{i}/r{i} else 0.0 end" for i, b in enumerate(both, 1))
    return f"""(select *, case when pp + rr = 0 then 0.0 else 100.0 * 5 * pp * rr / (4 * pp + rr) end chrf
    from (select *, case when ({eff}) = 0 then 0.0 else ({psum}) / ({eff}) end pp,
                    case when ({eff}) = 0 then 0.0 else ({rsum}) / ({eff}) end rr from {t}))"""
