"""Query of the URL filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridlark.llm.urlfilter import BIN, CONTEXT, EDGE_BINS, FOLD, LOWER, SCALE, SYMBOLS, UPPER, judge

RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


def op4_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), RULES)


def _rules_sql() -> str:
    rows = []
    for rule in sorted(RULES, key=lambda r: (len(r), r), reverse=True):
        own, _, start = rule.partition("/")
        rows.append((rule, f"(host = '{own}' or ends_with(host, '.{own}')) and starts_with(path, '/{start}')"))
    cases = lambda f: "case " + " ".join(f"when {cond} then '{f(rule)}'" for rule, cond in rows) + " end"
    return f"{cases(lambda r: r)} as rule, {cases(lambda r: RULES[r])} as label"


def _model_sql() -> str:
    parts, joins, last = [], [], {}
    for kind in ("allow", "block"):
        chance = f"cast(1.0 as double) / cast({SYMBOLS} as double)"
        for order in range(CONTEXT + 1):
            t, c = f"{kind}_t{order}", f"{kind}_c{order}"
            parts.append(f"{t} as (select substring(gram, {CONTEXT + 1 - order}, {order + 1}) as k, sum({kind}) as n from counted where {kind} > 0 group by 1)")
            parts.append(f"{c} as (select substring(k, 1, {order}) as k, sum(n) as n, count(*) as t from {t} group by 1)")
            joins.append(f"left join {t} on substring(gram, {CONTEXT + 1 - order}, {order + 1}) = {t}.k left join {c} on substring(gram, {CONTEXT + 1 - order}, {order}) = {c}.k")
            chance = f"case when {c}.n is null then {chance} else (cast(coalesce({t}.n, 0) as double) + cast({c}.t as double) * ({chance})) / (cast({c}.n as double) + cast({c}.t as double)) end"
        last[kind] = chance
    ratio = f"cast(round(cast({SCALE} as double) * (ln({last['allow']}) - ln({last['block']}))) as bigint)"
    return ", ".join(parts) + f", model as (select gram, {ratio} as ratio from counted {' '.join(joins)})"


def oracle() -> str:
    n = CONTEXT + 1
    return f"""
with r0 as (select page_id, case when instr(url, '://') > 0 then substring(url, instr(url, '://') + 3) else '' end as rest from pages),
r1 as (select page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') as host,
  coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path,
  coalesce(regexp_replace(regexp_replace(translate(rest, '{UPPER}', '{LOWER}'), '[0-9]', '0', 'g'), '[^a-z0./-]', '_', 'g'), '') as symbols from r0),
r2 as (select *, {_rules_sql()}, substring(md5(symbols), 1, 1) in {FOLD} as calibrates from r1),
g as (select symbols, case when not calibrates then label end as label, unnest(generate_series(1, length(symbols))) as pos, concat('{"^" * CONTEXT}', symbols) as padded from r2 where length(symbols) > 0),
counted as (select substring(padded, pos, {n}) as gram, sum(case when label = 'allow' then 1 else 0 end) as allow, sum(case when label = 'block' then 1 else 0 end) as block from g group by 1),
{_model_sql()},
u as (select distinct symbols from r2 where length(symbols) > 0),
ug as (select symbols, unnest(generate_series(1, length(symbols))) as pos, concat('{"^" * CONTEXT}', symbols) as padded from u),
us as (select symbols, cast(floor(cast(sum(ratio) as double) / cast(count(*) as double)) as bigint) as score from ug join model on substring(padded, pos, {n}) = gram group by 1),
s as (select r2.*, coalesce(us.score, 0) as score from r2 left join us using (symbols)),
b as (select least(greatest(cast(floor(cast(score as double) / {BIN}) as bigint), -{EDGE_BINS}), {EDGE_BINS}) as bin, sum(case when label = 'allow' then 1 else 0 end) as allow, sum(case when label = 'block' then 1 else 0 end) as block from s where label is not null and calibrates group by 1),
w as (select cast(floor(cast((bin + coalesce(lag(bin) over (order by bin) + 1, bin)) * {BIN} as double) / 2.0) as bigint) as edge, coalesce(sum(allow) over (order by bin rows between unbounded preceding and 1 preceding), 0) * sum(block) over ()
  + sum(block) over (order by bin rows between current row and unbounded following) * sum(allow) over () as wrong, sum(allow) over () * sum(block) over () as both_n from b),
l as (select (select edge from w where both_n > 0 order by wrong, edge limit 1) as threshold)
select page_id, host, path, rule, coalesce(label, case when threshold is null or score >= threshold then 'allow' else 'block' end) as verdict, score, threshold from s cross join l"""


QUERIES = {"op4_urlfilter": op4_urlfilter}
ORACLE_SQL = {"op4_urlfilter": oracle()}
