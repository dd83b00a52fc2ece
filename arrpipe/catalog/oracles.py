"""The same results in plain SQL for another engine, from the given tables alone.

Matching is stated as one join with all conditions OR-ed, numbering as one global
row_number, and so on: the direct statement of what the Spark jobs compute.
"""

from __future__ import annotations

from .inputs import ARTICLES, COMPANIES, as_sql

# The seeds as the results must have them, stated apart from the code under test.
CATEGORIES = [
    (1, "Finance", "Finance"), (2, "Cybersecurity", "Security"), (3, "Enterprise Software", "Software"),
    (4, "Data Analytics", "Analytics"), (5, "InfoSec", "Security"), (6, "Machine Learning", "AI/ML"),
    (7, "Software", "Software"), (8, "Cloud", "Cloud"), (9, "FinTech", "Finance"), (10, "AI/ML", "AI/ML"),
    (11, "Financial Technology", "Finance"), (12, "Analytics", "Analytics"), (13, "Security", "Security"),
    (14, "AI & ML", "AI/ML"), (15, "Artificial Intelligence", "AI/ML"), (16, "Big Data", "Analytics"),
    (17, "SaaS", "Software"), (18, "Cloud Services", "Cloud"), (19, "Cloud Computing", "Cloud"),
]
REVENUE_RANGES = [
    (0, 0.0, 0.0, "Unknown", 0), (1, 1.0, 1e4, "Up to 10K USD", 1), (2, 10001.0, 1e5, "10K -100K USD", 2),
    (3, 100001.0, 1e6, "100K - 1M USD", 3), (4, 1000001.0, 1e7, "1M-10M USD", 4),
    (5, 10000001.0, 1e8, "10M-100M", 5), (6, 100000001.0, 1e9, "100M-1B", 6),
    (7, 1000000001.0, 1e10, "1B - 10B", 7), (8, 10000000001.0, 1e11, "10B - 100B", 8),
    (9, 100000000001.0, None, "100B+", 9),
]
CURRENCIES = [(1, "EUR", 1.1, True), (2, "GBP", 1.27, True), (3, "JPY", 1.0 / 150, True), (4, "USD", 1.0, True)]
# Endings of company names that don't count, and names with other names.
_SUFFIXES = [
    "corporation", r"corp\.?", "incorporated", r"inc\.?", "limited", r"ltd\.?", "llc", "plc",
    "gmbh", "ag", r"co\.?", "company", "group", "holdings", "technologies", "research", "labs",
]
_SYNONYMS = [
    (["facebook", "facebookai", "facebookairesearch"], ["meta ai", "metaai"]),
    (["azure", "microsoftazure"], ["microsoft"]),
]

_INPUTS = f"articles as ({as_sql(ARTICLES)}), companies as ({as_sql(COMPANIES)})"



def _values(rows: list[tuple]) -> str:
    """A VALUES list of the seed rows."""
    def literal(v) -> str:
        if v is None:
            return "null"
        if isinstance(v, float):
            return f"{v!r}::double"
        return str(v) if isinstance(v, (bool, int)) else "'" + v + "'"

    return "(values " + ", ".join(f"({', '.join(map(literal, row))})" for row in rows) + ")"


_CATEGORIES = f"""categories as (
  select a id, b name, c category_group from {_values(CATEGORIES)} t(a, b, c))"""
_RANGES = f"""ranges as (
  select a range_id, b min_revenue_usd, c max_revenue_usd, d range_name, e range_order
  from {_values(REVENUE_RANGES)} t(a, b, c, d, e))"""
_RATES = f"""rates as (
  select a id, b base_currency, c usd_conversion, d is_current
  from {_values(CURRENCIES)} t(a, b, c, d))"""
_DATES = """dates as (select cast(year(d)*10000 + month(d)*100 + day(d) as integer) date_id,
  cast(d as date) date, cast(year(d) as integer) as year, cast(month(d) as integer) as month,
  cast(day(d) as integer) as day, cast(quarter(d) as integer) quarter_no
  from generate_series(date '2020-01-01', date '2026-12-31', interval 1 day) t(d))"""

_AS_OF = "date '2026-01-01'"
_MONTHS = "%b %d, %Y"


def _date(x: str) -> str:
    iso = rf"regexp_extract({x}, '(^|[^0-9])([0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}})($|[^0-9])', 2)"
    return f"""case
      when {iso} <> '' then cast(try_strptime({iso}, '%Y-%m-%d') as date)
      when {x} like '%/%/%' then cast(coalesce(try_strptime({x}, '%m/%d/%Y'),
                                               try_strptime({x}, '%d/%m/%Y')) as date)
      when {x} like '% %, %' then cast(try_strptime({x}, '{_MONTHS}') as date)
      when regexp_full_match({x}, '[0-9]{{8}}') then cast(try_strptime({x}, '%Y%m%d') as date)
      when regexp_full_match({x}, '[A-Z][a-z]{{2}} [0-9]{{4}}')
        then cast(try_strptime(left({x}, 4)||day({_AS_OF})||', '||right({x}, 4), '{_MONTHS}') as date)
      end"""


_NUMBER = r"'^\s*[+-]?([0-9]+(_[0-9]+)*(\.([0-9]+(_[0-9]+)*)?)?|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$'"


def _int(x: str) -> str:
    return (
        f"case when regexp_matches({x}, {_NUMBER}) "
        f"then try_cast(try_cast({x} as double) as integer) end"
    )


def _amount(x: str) -> str:
    """Amount of text without currency symbols and codes."""
    # Units and their powers of ten.
    powers = {"b": 9, "bn": 9, "billion": 9, "m": 6, "mm": 6, "million": 6, "k": 3, "thousand": 3}
    pattern = r"'([0-9.]+)\s*(" + "|".join(sorted(powers, key=len, reverse=True)) + ")?'"
    unit = f"lower(regexp_extract({x}, {pattern}, 2, 'i'))"
    factors = ", ".join(f"'{unit_}': 1e{power}::double" for unit_, power in powers.items())
    return f"""try_cast(regexp_extract({x}, {pattern}, 1, 'i') as double)
      * coalesce(map {{{factors}}}[{unit}], 1::double)"""


_SYMBOL_FREE = r"regexp_replace(replace(%s, ',', ''), '[$€£¥]|(USD|EUR|GBP|JPY)\b', '', 'gi')"
_PARSED = f"""parsed as (
  select k, case when ok then currency end currency,
    case when ok and not is_range then low end actual,
    case when ok and is_range then least(low, high) end as "min",
    case when ok and is_range then greatest(low, high) end as "max"
  from (select *, currency is not null and low is not null
                  and (not is_range or high is not null) ok
    from (select k, contains(revenue, ' - ') is_range,
      case when revenue like '%$%' then 'USD' when revenue like '%€%' then 'EUR'
        when revenue like '%£%' then 'GBP' when revenue like '%¥%' then 'JPY'
        else nullif(upper(regexp_extract(revenue, '(USD|EUR|GBP|JPY)\\b', 1, 'i')), '') end currency,
      {_amount(_SYMBOL_FREE % "split_part(revenue, ' - ', 1)")} low,
      {_amount(_SYMBOL_FREE % "split_part(revenue, ' - ', 2)")} high
    from articles) q) q2)"""

_SUFFIX = rf"\s+(?:{'|'.join(_SUFFIXES)})\.?\s*"


def _normal(x: str) -> str:
    bare = rf"regexp_replace(lower(trim({x})), '\s*\([^)]*\)', '', 'g')"
    return f"regexp_extract({bare}, '(?s)^(.*?)(?:{_SUFFIX})?$', 1)"


def _compact(x: str) -> str:
    return f"regexp_replace({_normal(x)}, '[^a-z0-9]', '', 'g')"


def _initials(x: str) -> str:
    words = f"regexp_extract_all({_normal(x)}, '[^[:space:]]+')"
    return f"array_to_string(list_transform({words}, lambda w: w[1]), '')"


def _synonyms(x: str) -> str:
    whens = " ".join(
        f"when {_compact(x)} in ({str(list(names))[1:-1]}) then {list(others)}"
        for names, others in _SYNONYMS
    )
    return f"case {whens} else cast([] as varchar[]) end"


def _alias_rows(rows: str, out: str, strict: bool = False, listed: bool = False) -> str:
    """CTE ``out``: (name, aliases) of the names in CTE ``rows``, in order of construction.

    ``strict``: no initials of one letter, no empty aliases. ``listed``: synonyms of a CTE "synonyms".
    """
    wanted = "alias <> '' and not (step = 3 and pos = 2 and length(alias) < 2)" if strict else "true"
    builtin = f"""select name, 4, pos, alias from (
    select name, unnest(s) alias, generate_subscripts(s, 1) pos
    from (select distinct name, {_synonyms('name')} s from {out}_parts) y) z"""
    table = f"""select distinct name, 4, place, synonym from {out}_parts
    join synonyms s on s.compact = {_compact('name')}"""
    return rf"""{out}_parts as (
  select name, unnest(parts) part, generate_subscripts(parts, 1) pos
  from (select distinct name, string_split_regex(name, '\s*/\s*') parts from {rows}
        where name is not null) d),
{out}_rows as (
  select name, 1 step, pos, {_normal('part')} alias from {out}_parts
  union all select name, 2, pos, {_compact('part')} from {out}_parts
  union all select name, 3 step, step pos, alias from (
    select distinct name, unnest([{_compact('name')}, {_initials('name')},
      {_compact(r"regexp_extract(name, '\(([^)]+)\)', 1)")}]) alias, unnest([1, 2, 3]) step
    from {out}_parts) w where alias <> ''
  union all {table if listed else builtin}),
{out} as (select name, list(alias order by step, pos, alias) aliases from {out}_rows where {wanted} group by name)"""


# Names with their keys; every name against every company, all conditions OR-ed.
def _pairs(strict: bool = False) -> str:
    filled = " and n.normal <> ''" if strict else ""
    filled_compact = " and n.compact <> ''" if strict else ""
    return f"""article_names as (select company_name as name from articles),
{_alias_rows('article_names', 'a_names', strict)},
firm_names as (select company_name as name from companies),
{_alias_rows('firm_names', 'f_names', strict)},
names as (
  select name company_name, {_normal('name')} normal, {_compact('name')} compact, aliases
  from a_names),
firms as (
  select id, {_normal('name')} normal, {_compact('name')} compact, aliases
  from companies join f_names on name = company_name),
pairs as (
  select * from (
    select n.company_name, f.id, f.normal = n.aliases[-1] preferred, n.normal = f.normal{filled} by_normal,
      n.compact = f.compact{filled_compact} by_compact, list_has_any(n.aliases, f.aliases) by_alias,
      length(n.compact) >= 4 and length(f.compact) >= 4 and contains(n.compact, f.compact) holds,
      length(n.compact) >= 4 and length(f.compact) >= 4 and contains(f.compact, n.compact) is_held
    from names n join firms f on true) p
  where by_normal or by_compact or by_alias or holds or is_held)"""


def _best(pairs: str, rows: str = "articles") -> str:
    return f"""{pairs},
best as (
  select article_id, cast(priority as integer) priority, id company_id from (
    select a.article_id, case when p.preferred then 0 else 1 end priority, p.id,
      row_number() over (partition by a.article_id
                         order by case when p.preferred then 0 else 1 end, p.id) rn
    from {rows} a join pairs p on p.company_name = a.company_name
    where a.article_id is not null) r where rn = 1)"""


_PAIRS = _pairs()
_BEST = _best(_PAIRS)

_OBSERVED = f"""{_PARSED}, typed as (
  select a.*, co.id company_id, case when co.id is not null then 'Exact' end kind,
    cat.id category_id, {_date('a.published_date')} pub, p.currency, p.actual, p."min" low,
    p."max" high, round(p.actual * usd_conversion, 2) revenue_actual_usd,
    round(p."min" * usd_conversion, 2) revenue_min_actual_usd,
    round(p."max" * usd_conversion, 2) revenue_max_actual_usd
  from articles a join parsed p on p.k = a.k
  left join companies co on co.company_name = a.company_name
  left join categories cat on cat.name = a.category
  left join rates on base_currency = p.currency),
observed as (
  select t.*, coalesce((select min_by(range_id, range_order) from ranges
    where range_id <> 0 and v >= min_revenue_usd
      and (max_revenue_usd is null or v <= max_revenue_usd)), 0) revenue_range_id
  from (select *, coalesce(revenue_actual_usd,
                           (revenue_min_actual_usd + revenue_max_actual_usd) / 2) v from typed) t)"""
_DIMS = f"{_CATEGORIES}, {_RANGES}, {_RATES}, {_DATES}"


_CLASSES = """staff_classes(lowest, highest, class) as (
  values (null::int, 9999, 'Small'), (10000, 30000, 'Medium'), (30001, null::int, 'Large')),
listings(listed, label) as (values (true, 'Public'), (false, 'Private'))"""


def _fact(rows: str) -> str:
    """The star join, each attribute group looked up on its own."""
    return f"""
  with firm as (
    select c.id firm_id, c.* exclude (id, company_name), c.company_name known_name,
      cast(2026 - c.founded_year as integer) company_age,
      coalesce(l.label, 'Unknown') public_private_status, coalesce(z.class, 'Unknown') company_size_category
    from companies c left join listings l on l.listed = c.is_public
    left join staff_classes z
      on c.employee_count between coalesce(z.lowest, c.employee_count) and coalesce(z.highest, c.employee_count)),
  topic as (select id topic_id, name category_name, category_group from categories),
  band as (select range_id band_id, range_order revenue_range_order, range_name revenue_range_name from ranges),
  day as (select date published, year, month, 'Q' || quarter_no quarter_no from dates)
  select article_id, title, category_group, category_name, ifnull(kind, 'Not matched') company_matched,
    case when kind is not null then known_name when article_id is not null then r.company_name end company_name,
    ifnull(revenue_min_actual_usd, revenue_actual_usd) revenue_min_usd,
    ifnull(revenue_max_actual_usd, revenue_actual_usd) revenue_max_usd, revenue_actual_usd,
    revenue_range_order, revenue_range_name, industry, founded_year, company_age, headquarters, employee_count,
    ifnull(public_private_status, 'Unknown') public_private_status, stock_ticker,
    array_to_string(list_filter([industry, category_group], lambda x: x is not null), ' - ') industry_category,
    pub published_date, ifnull(company_size_category, 'Unknown') company_size_category,
    year, month, monthname(pub)[:3] mon, ifnull(quarter_no, 'Q') quarter_no, k
  from {rows} r left join firm on firm_id = company_id left join topic on topic_id = category_id
  left join band on band_id = revenue_range_id left join day on published = pub"""


_ARR = "coalesce(revenue_actual_usd, (revenue_min_usd + revenue_max_usd) / 2) arr_usd"
_FACT_CTES = f"with {_INPUTS}, {_DIMS}, {_CLASSES}, {_OBSERVED}, fact as ({_fact('observed')})"
_GOLD_CTES = (
    f"{_FACT_CTES}, gold as (select * exclude (k), k observation_id, {_ARR} from fact)"
)
_MART = """select g.* from gold g
  where (exists (select 1 from (values ('group', 'AI/ML'), ('name', 'machine learning'), ('name', 'ai/ml'),
      ('name', 'ai & ml'), ('name', 'artificial intelligence'), ('industry', 'ai/ml'),
      ('industry', 'machine learning'), ('industry', 'artificial intelligence')) wanted(field, value)
    where value = case field when 'group' then g.category_group when 'name' then lower(g.category_name)
      else lower(g.industry) end))
  and g.year in (2022, 2023, 2024) and g.arr_usd > 5e7"""

_ATTRS = "founded_year, headquarters, employee_count, industry, is_public, stock_ticker"
_CHANGED = """changed as (select * replace (cast(employee_count + 1 as integer) as employee_count)
  from companies where is_public or is_public is null)"""
_STORED = f"""stored as (select id, company_name, {_ATTRS},
    cast(case when is_public then 2 else 1 end as integer) insert_batch_id,
    cast(case when employee_count > 20000 then 4 end as integer) updated_batch_id
  from companies where stock_ticker is not null)"""
_COLUMNS = "article_id, title, company_name, nullif(published_date, '') published_date, category, " \
    "revenue, summary, url, author, word_count"


def _value(source: str, expression: str, ctes: str = _INPUTS) -> str:
    return f"with {ctes} select k, {source}, {expression} as value from articles"


def _found(columns: list[str]) -> str:
    return "[" + ", ".join(f"''{c}''" for c in columns) + "]"


_HEADER = ["article_id", "title", "company_name", "published_date", "category", "revenue",
           "summary", "url", "author", "word_count"]
_SHORT = [c for c in _HEADER if c not in ("revenue", "author")]
_CASED = ["Title" if c == "title" else c for c in _HEADER]
_ACME = "Schema mismatch for company ''Acme''"

ORACLES: dict[str, str] = {
    "csv_ingest_strings": f"with {_INPUTS} select {_COLUMNS} from articles",
    "csv_schema_gate": f"""with {_INPUTS}
      select case batch_id when 1 then 'complete' when 2 then 'short' else 'cased' end folder,
        case batch_id when 1 then 'success' else 'quarantined' end status,
        case batch_id when 2 then 'Schema mismatch. Missing columns: [''revenue'', ''author'']. Found: {_found(_SHORT)}.'
          when 3 then 'Schema mismatch. Missing columns: [''title'']. Found: {_found(_CASED)}.' end reason,
        cast(sum(case batch_id when 1 then 1 else 0 end) as bigint) n_rows
      from articles group by all""",
    "json_ingest_companies": f"with {_INPUTS} select company_name, {_ATTRS} from companies",
    "csv_redelivery": f"""with {_INPUTS}
      select cast(batch_id as integer) delivery, if(batch_id < 3, 'success', 'quarantined') status,
        count(*) filter (batch_id < 3) n, count(article_id) filter (batch_id < 3) n_ids,
        count(word_count) filter (batch_id < 3) n_words
      from articles group by batch_id""",
    "json_schema_gate": f"""with {_INPUTS}
      select case k % 7
        when 0 then '{_ACME}. Missing fields: [''is_public'', ''stock_ticker''].'
        when 1 then 'loaded' when 2 then 'loaded 7203'
        when 3 then '{_ACME}: value must be an object.'
        when 4 then 'Schema mismatch. Expected an object keyed by company_name.'
        when 5 then '{_ACME}. Wrong type: [''employee_count''].'
        else 'Invalid JSON' end reason, count(*) n
      from articles group by all""",
    "file_ledger_skip": f"""with {_INPUTS}, f as (select author||'.csv' file_name, category,
        timestamp '1970-01-01' + to_days(cast(k as integer)) file_timestamp from articles)
      select file_name, cast(file_timestamp as date) as day from f where not exists (select 1 from f g
        where g.category in ('AI/ML', 'Cloud') and g.file_name = f.file_name
          and g.file_timestamp = f.file_timestamp)""",
    "file_ledger_path": f"""with {_INPUTS}, f as (select author||'.csv' file_name, category,
        '/in/'||cast(k % 4 as varchar)||'/'||author||'.csv' path, k % 3 as day from articles)
      select path, cast(day as bigint) as day, count(*) n from f where not exists (select 1 from f g
        where g.category in ('AI/ML', 'Cloud') and g.path = f.path and g.day = f.day) group by all""",
    "file_log": f"""with {_INPUTS} select
        (select cast(max(batch_id) + 1 as integer) from articles) batch_id, url file_name,
        case when word_count = 'many' then 'bad word count' end reason,
        case when word_count = 'many' then 'quarantined' else 'success' end status,
        'N' alert_processed, coalesce(word_count = 'many', false) has_quarantined_at,
        not coalesce(word_count = 'many', false) has_processed_at from articles""",
    "ledger_repair": f"""with {_INPUTS}
      select k, case when k % 6 = 4 then 'Y' else 'N' end alert_processed from articles""",
    "article_batch_id": f"with {_INPUTS} select max(batch_id) + 1 batch_id from articles",
    "seed_category": f"""with {_INPUTS}, {_CATEGORIES}
      select id, name, category_group,
        (select count(*) from articles where category = name) n_articles from categories""",
    "seed_category_present": f"""with {_INPUTS} select cast(min(k) as integer) id, category as name,
        cast(null as varchar) category_group from articles group by category""",
    "backfill_group": f"""with {_INPUTS}, {_CATEGORIES}
      select k, category as name, case when category = 'Cloud' then 'Kept' else category_group end
        category_group from articles left join categories c on c.name = category""",
    "seed_range": f"""with {_INPUTS}, {_DIMS}, {_OBSERVED}
      select r.*, (select count(*) from observed o where o.revenue_range_id = r.range_id) n_articles
      from ranges r""",
    "seed_fx": f"""with {_INPUTS}, {_RATES}, {_PARSED}
      select r.*, (select count(*) from parsed where currency = base_currency) n_articles
      from rates r""",
    "dim_date": f"""with {_INPUTS}, {_DATES}, used as (
        select {_date('published_date')} d, count(*) n from articles group by 1)
      select dates.*, coalesce(n, 0) n_articles from dates left join used on d = date""",
    "scd2_companies": f"""with {_INPUTS}, {_CHANGED}
      select company_name, {_ATTRS}, 'one.json' file_name,
        company_name not in (select company_name from changed) is_current
      from companies where stock_ticker is not null
      union all select company_name, {_ATTRS}, 'two.json', true from changed""",
    "scd2_company_files": f"""with {_INPUTS}, {_CHANGED}, all_rows as (
        select company_name, {_ATTRS}, 'one.json' file_name, 1 run from companies
        union all select company_name, {_ATTRS}, 'two.json', 2 from changed
        union all select company_name, {_ATTRS}, 'three.json', 2 from companies
          where stock_ticker is not null)
      select * exclude (run), row_number() over (partition by company_name
        order by run desc, file_name desc) = 1 is_current from all_rows""",
    "upsert_companies": f"""with {_INPUTS}, {_CHANGED}, {_STORED}, nb as (
        select max(greatest(insert_batch_id, coalesce(updated_batch_id, 0))) + 1 b from stored)
      select s.id, s.company_name, {', '.join(f'case when c.id is null then s.{a} else c.{a} end {a}' for a in _ATTRS.split(', '))},
        s.insert_batch_id,
        cast(case when c.id is null then s.updated_batch_id else b end as integer) updated_batch_id
      from stored s cross join nb left join changed c on c.company_name = s.company_name
      union all
      select cast((select max(id) from stored) + row_number() over (order by c.company_name) as bigint),
        c.company_name, {', '.join(f'c.{a}' for a in _ATTRS.split(', '))}, cast(b as integer), null
      from changed c cross join nb where c.company_name not in (select company_name from stored)""",
    "upsert_changed": f"""with {_INPUTS}, {_STORED}, delivered as (select * replace (cast(
          if(coalesce(is_public, true), employee_count + 1, employee_count) as integer) as employee_count) from companies),
        nb as (select max(greatest(insert_batch_id, coalesce(updated_batch_id, 0))) + 1 b from stored)
      select s.id, s.company_name, {', '.join(f'd.{a}' for a in _ATTRS.split(', '))}, s.insert_batch_id,
        cast(case when d.employee_count is distinct from s.employee_count then b
          else s.updated_batch_id end as integer) updated_batch_id
      from stored s cross join nb join delivered d on d.company_name = s.company_name
      union all
      select cast((select max(id) from stored) + row_number() over (order by d.company_name) as bigint),
        d.company_name, {', '.join(f'd.{a}' for a in _ATTRS.split(', '))}, cast(b as integer), null
      from delivered d cross join nb where d.company_name not in (select company_name from stored)""",
    "company_keys": f"""with {_INPUTS}, {_STORED}
      select cast((select max(id) from stored) + row_number() over (order by company_name) as bigint) id,
        company_name, headquarters
      from companies where company_name not in (select company_name from stored)""",
    "company_batch_id": f"""with {_INPUTS}, {_STORED} select count(*) n, cast(max(greatest(
        insert_batch_id, coalesce(updated_batch_id, 0))) + 1 as integer) batch_id from stored""",
    "audit_counts": f"""with {_INPUTS}, {_STORED} select count(*) total,
        count(*) filter (where updated_batch_id is null) never_updated from stored""",
    "new_observations": f"""with {_INPUTS} select k, article_id, batch_id from articles b
      where not exists (select 1 from articles s where s.batch_id < 3 and s.category <> 'Gardening'
        and s.article_id = b.article_id and s.batch_id = b.batch_id)""",
    "new_observations_with_id": f"""with {_INPUTS} select k, article_id, batch_id, cast(null as varchar) reason
      from articles b where article_id is not null
        and not exists (select 1 from articles s where s.batch_id < 3 and s.category <> 'Gardening'
          and s.article_id = b.article_id and s.batch_id = b.batch_id)
      union all select k, article_id, batch_id, 'article_id is missing' from articles
      where article_id is null and batch_id > 1""",
    "scd2_latest_only": f"""with {_INPUTS} select k, article_id, batch_id, title,
        article_id is null or batch_id = max(batch_id) over (partition by article_id) is_current from articles""",
    "scd2_articles": f"""with {_INPUTS} select k, article_id, batch_id, title,
        batch_id = 2 and not exists (select 1 from articles n where n.batch_id = 3
          and n.article_id = a.article_id) is_current
      from articles a where batch_id < 3
      union all select k, article_id, batch_id, title, true from articles where batch_id = 3""",
    "observation_ids": f"""with {_INPUTS} select cast((select max(batch_id) from articles)
        + row_number() over (order by article_id nulls last, batch_id, k) as bigint) observation_id,
        k, article_id, batch_id from articles""",
    "word_count_int": _value("word_count", _int("word_count")),
    "published_dates": _value("published_date", _date("published_date")),
    "revenue_amounts": f"with {_INPUTS}, {_PARSED} select * from parsed",
    "company_normal": _value("company_name", _normal("company_name")),
    "company_compact": _value("company_name", _compact("company_name")),
    "company_initials": _value("company_name", _initials("company_name")),
    "company_synonyms": f"""with {_INPUTS}, named as (select k, case batch_id
        when 1 then 'Facebook AI Research' when 2 then 'Azure Inc.' else company_name end name
        from articles)
      select k, array_to_string(list_sort({_synonyms('name')}), '|') as value from named""",
    "company_synonyms_table": f"""with {_INPUTS}, synonyms as (
        select {_compact('company_name')} compact, id place, unnest([upper(headquarters), 'HQ '||headquarters]) synonym
        from companies where industry = 'Artificial Intelligence'),
      article_names as (select company_name as name from articles),
      {_alias_rows('article_names', 'named', listed=True)}
      select k, company_name, aliases[-1] as last_alias,
        coalesce(array_to_string(list_sort(list_distinct(aliases)), '|'), '') as value
      from articles left join named on name = company_name""",
    "company_aliases_strict": f"""with {_INPUTS}, article_names as (select company_name as name from articles),
        {_alias_rows('article_names', 'named', strict=True)}
      select k, company_name,
        coalesce(array_to_string(list_sort(list_distinct(aliases)), '|'), '') as value
      from articles left join named on name = company_name""",
    "company_aliases": f"""with {_INPUTS}, article_names as (select company_name as name from articles),
        {_alias_rows('article_names', 'named')}
      select k, company_name,
        coalesce(array_to_string(list_sort(list_distinct(aliases)), '|'), '') as value
      from articles left join named on name = company_name""",
    "sql_functions": f"""with {_INPUTS}, {_PARSED},
        article_names as (select company_name as name from articles),
        {_alias_rows('article_names', 'named')}
      select a.k, {_normal('company_name')} n, {_compact('company_name')} c,
        {_initials('company_name')} i,
        cast(coalesce(len(list_distinct(aliases)), 0) as integer) n_aliases,
        {_date('published_date')} d, p.currency
      from articles a join parsed p on p.k = a.k left join named on name = company_name""",
    "usd_convert": f"""with {_INPUTS}, {_RATES}, {_PARSED}
      select k, cur revenue_currency, actual, "min", "max",
        round(actual * rate, 2) actual_usd, round("min" * rate, 2) min_usd,
        round("max" * rate, 2) max_usd
      from (select *, if(k % 13 = 5, 'CHF', currency) cur from parsed) p
      left join (select base_currency, usd_conversion rate from rates union all select 'CHF', 1.25) r
        on base_currency = cur""",
    "revenue_bucket": f"""with {_INPUTS}, {_DIMS}, {_OBSERVED}
      select k, revenue_actual_usd, revenue_min_actual_usd,
        revenue_max_actual_usd, revenue_range_id from observed""",
    # A range ends where the next begins.
    "revenue_bucket_contiguous": f"""with {_INPUTS}, {_DIMS}, {_OBSERVED}
      select k, revenue_actual_usd, revenue_min_actual_usd, revenue_max_actual_usd,
        coalesce((select max(range_id) from ranges where range_id <> 0 and min_revenue_usd <= v), 0) revenue_range_id
      from (select * replace (v / 7 as v) from observed)""",
    "match_exact": f"""with {_INPUTS} select k, a.company_name, c.id company_id,
        case when c.id is not null then 'Exact' end company_match_kind
      from articles a left join companies c on c.company_name = a.company_name""",
    "category_lookup": f"""with {_INPUTS}, {_CATEGORIES} select k, category, id category_id
      from articles left join categories on name = category""",
    "match_candidates": f"""with {_INPUTS}, {_PAIRS}
      select company_name, rule, min(id) company_id from (
        select company_name, id, unnest([case when by_normal then 'normal' end,
          case when by_compact then 'compact' end, case when by_alias then 'alias' end,
          case when holds then 'contains' end, case when is_held then 'contained' end]) rule
        from pairs) u where rule is not null group by company_name, rule""",
    "match_best": f"with {_INPUTS}, {_BEST} select * from best",
    "match_best_strict": f"with {_INPUTS}, {_best(_pairs(strict=True))} select * from best",
    # Only the newest version of an article, if it has no exact match.
    "match_current_version": f"""with {_INPUTS}, newest as (select * from articles a
        where company_name not in (select company_name from companies)
          and not exists (select 1 from articles n where n.article_id = a.article_id and n.batch_id > a.batch_id)),
      {_best(_PAIRS, 'newest')} select * from best""",
    # Three runs of growing inputs, stated as one.
    "match_incremental": f"""with {_INPUTS}, {_PAIRS}
      select company_name, cast(b.p as integer) priority, b.id company_id from (
        select a.company_name, min({{'p': case when p.preferred then 0 else 1 end, 'id': p.id}})
          filter (p.id is not null) b
        from (select distinct company_name from articles where company_name is not null) a
        left join pairs p on p.company_name = a.company_name group by a.company_name) q""",
    "match_applied": f"""with {_INPUTS}, {_BEST}
      select cast(k as integer) k, coalesce(c.id, b.company_id) company_id,
        case when c.id is not null then 'Exact' when b.company_id is not null then 'Fuzzy' end
          company_match_kind, a.company_name company_name_raw
      from articles a left join companies c on c.company_name = a.company_name
      left join best b on b.article_id = a.article_id""",
    "fact_articles": f"""{_FACT_CTES}
      select * exclude (k), k observation_id from fact""",
    "gold_arr": f"{_GOLD_CTES} select * from gold",
    "mart_ai_arr_50m": f"{_GOLD_CTES} {_MART}",
    "csv_export_roundtrip": f"{_GOLD_CTES} {_MART}",
    "run_audit": f"""with {_INPUTS}, {_BEST},
      unmatched as (select a.* from articles a where a.company_name is null
        or a.company_name not in (select company_name from companies)),
      named as (select distinct company_name from articles where company_name is not null
        and article_id in (select article_id from unmatched)),
      n as (select (select count(*) from articles) a, (select count(*) from companies) c,
        (select count(*) from unmatched where article_id in (select article_id from best)) f,
        (select count(*) from named) m)
      select unnest(['bronze_articles', 'bronze_company_metadata', 'dim_company', 'dim_company', 'dim_category',
          'dim_revenue_range', 'dim_date', 'dim_currency_conversion', 'name_matches', 'silver_observations',
          'silver_observations', 'silver_observations', 'silver_observations', 'silver_articles',
          'gold_fact_arr_observation']) table_name,
        unnest(['written', 'written', 'written', 'never_updated', 'written', 'written', 'written', 'written',
          'written', 'written', 'current', 'inserted', 'matched_fuzzy', 'written', 'written']) counter,
        unnest([a, c, c, c, 19, 10, 2557, 4, m, a, a, a, f, a, a]) n from n""",
    # Companies arrive in name order; their surrogate keys decide ties between candidates.
    "landing_to_gold": f"""with {_INPUTS.replace('companies as (', 'listed as (')},
      companies as (select * replace (cast(row_number() over (order by company_name) as bigint) as id)
        from listed),
      {_DIMS}, {_OBSERVED}, {_BEST},
      latest as (select * from observed o where batch_id = 3 or article_id is null
          or not exists (select 1 from articles n where n.batch_id = 3 and n.article_id = o.article_id)
        union all select * from observed where batch_id < 3 and article_id is null),
      matched as (select l.* replace (coalesce(l.company_id, b.company_id) as company_id,
          coalesce(kind, case when b.company_id is not null then 'Fuzzy' end) as kind)
        from latest l left join best b on b.article_id = l.article_id),
      {_CLASSES}, fact as ({_fact('matched')})
      select * exclude (k), {_ARR} from fact""",
}
