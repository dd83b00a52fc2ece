"""Articles and companies derived from the given tables, in SQL that both engines take.

Every order is one article (three versions per article id, batches 1 to 3); part names,
suppliers and customers are the companies.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession

TABLES = ["nation", "supplier", "customer", "part", "orders", "lineitem"]
AS_OF = dt.datetime(2026, 1, 1)

ARTICLES = """
select k,
  case when k % 50 = 49 then null
       else 'A'||lpad(cast(cast(floor(k / 3) as bigint) as string), 9, '0') end article_id,
  cast(1 + k % 3 as int) batch_id,
  'Title '||cast(k as string) title,
  case k % 10 when 0 then p_name when 1 then upper(p_name)||' Inc.'
    when 2 then c_name||' '||c_mktsegment when 3 then replace(p_name, ' ', '')
    when 4 then 'New '||c_name||' '||c_mktsegment||' Works' when 5 then p_name||' / Zed'
    when 6 then 'Nobody '||cast(k as string) when 7 then null
    when 8 then s_name||' (US)' else c_name end company_name,
  case k % 9 when 0 then y||'-'||m||'-'||dd when 1 then m||'/'||dd||'/'||y
    when 2 then mon||' '||dd||', '||y when 3 then y||m||dd
    when 4 then 'filed on '||y||'-'||m||'-'||dd||' by staff' when 5 then 'n/a'
    when 6 then dd||'/'||m||'/'||y when 7 then mon||' '||y else '' end published_date,
  case k % 6 when 0 then 'AI/ML' when 1 then 'Machine Learning' when 2 then 'FinTech'
    when 3 then 'Cloud' when 4 then 'ai & ml' else 'Gardening' end category,
  case k % 11 when 0 then '$'||cast(n as string) when 1 then '€'||cast(n % 900 as string)||'K'
    when 2 then 'GBP '||cast(n % 90 as string)||'.5 million'
    when 3 then cast(n as string)||' usd'
    when 4 then '$'||cast(n % 900 as string)||'M - $'||cast(1 + n % 5 as string)||'B'
    when 5 then '¥'||cast(n as string)||' thousand'
    when 6 then '$1,'||lpad(cast(n % 1000 as string), 3, '0')||',000'
    when 7 then 'n/a' when 8 then '€'||cast(n % 70 as string)||' - €'||cast(n % 90 as string)||'m'
    when 9 then '£1.2.3' else null end revenue,
  o_orderpriority||' '||coalesce(p_type, '') summary,
  'https://news.example/'||cast(k as string) url,
  c_name author,
  case k % 5 when 0 then cast(n % 3000 as string) when 1 then cast(n % 300 as string)||'.5'
    when 2 then 'many' when 3 then '1e3' else null end word_count
from (
  select o_orderkey k, o_orderpriority, cast(floor(o_totalprice) as bigint) n,
    p_name, p_type, s_name, c_name, c_mktsegment,
    cast(year(d) as string) y, lpad(cast(month(d) as string), 2, '0') m,
    lpad(cast(day(d) as string), 2, '0') dd,
    substr('JanFebMarAprMayJunJulAugSepOctNovDec', cast(3 * month(d) - 2 as int), 3) mon
  from (select *, cast(o_orderdate + interval '25' year as date) d from {orders}) o
  left join (select l_orderkey, min(l_partkey) l_partkey, min(l_suppkey) l_suppkey
             from {lineitem} group by l_orderkey) l on l_orderkey = o_orderkey
  left join {part} p on p_partkey = l_partkey
  left join {supplier} s on s_suppkey = l_suppkey
  left join {customer} c on c_custkey = o_custkey) f
"""

COMPANIES = """
select cast(3 * min(p_partkey) + 1 as bigint) id, p_name company_name,
  case when length(p_name) % 5 = 0 then cast(null as int)
       else cast(1970 + length(p_name) * 3 as int) end founded_year,
  'City '||cast(length(p_name) % 4 as string) headquarters,
  cast(case length(p_name) % 5 when 0 then 9999 when 1 then 10000 when 2 then 30000
       when 3 then 30001 end as int) employee_count,
  case length(p_name) % 3 when 0 then 'AI/ML' when 1 then 'Retail' else null end industry,
  case length(p_name) % 3 when 0 then true when 1 then false else null end is_public,
  upper(substr(p_name, 1, 4)) stock_ticker
from {part} group by p_name
union all
select cast(3 * s_suppkey + 2 as bigint), s_name, cast(1980 + s_nationkey as int), n_name,
  cast(floor(abs(s_acctbal) * 5) as int), 'Artificial Intelligence', s_acctbal > 0,
  cast(null as string)
from {supplier} left join {nation} on n_nationkey = s_nationkey
union all
select cast(3 * c_custkey + 3 as bigint), c_name||' '||c_mktsegment,
  cast(1950 + c_nationkey as int), n_name, cast(floor(abs(c_acctbal) * 5) as int),
  case c_mktsegment when 'MACHINERY' then 'Machine Learning' when 'BUILDING' then null
    else lower(c_mktsegment) end,
  case when c_acctbal > 1000 then true when c_acctbal > 0 then false end,
  'C'||cast(c_custkey as string)
from {customer} left join {nation} on n_nationkey = c_nationkey
"""


def _derive(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    used = [t for t in TABLES if f"{{{t}}}" in sql]
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derive(spark, sf_dir, ARTICLES)


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derive(spark, sf_dir, COMPANIES)


def as_sql(sql: str) -> str:
    """The same text over plain table names."""
    return sql.format(**{t: t for t in TABLES})
