"""DuckDB SQL that computes every named query independently of Spark."""

from __future__ import annotations

SPACE = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"
WORDS = r"trim(regexp_replace({0}, '[^A-Z0-9]+', ' ', 'g'))"
# DuckDB upper-cases a sharp s to a single letter; write it out first.
PLAIN = "upper(strip_accents(replace({0}, 'ß', 'ss')))"
GEO = "upper(nullif({0}, ''))"
STATUS = r"""case when {0} is null then 'unknown'
  when regexp_matches({0}, '\bEN\s+LIQUIDACION\b') then 'in_liquidation'
  when regexp_matches({0}, '\bEN\s+DISOLUCION\b') then 'in_dissolution'
  when regexp_matches({0}, '\bEXTINGUID[AO]S?\b') then 'extinct'
  else 'no_adverse_marker' end"""


def match_key(normalized: str) -> str:
    for marker in (
        r"\bEXTINGUID[AO]S?\b",
        r"\bEN\s+LIQUIDACION\b",
        r"\bEN\s+DISOLUCION\b",
    ):
        normalized = f"regexp_replace({normalized}, '{marker}', ' ', 'g')"
    return SPACE.format(normalized)


def div(a: str, b: str) -> str:
    return f"(case when {b} <> 0 then {a} / {b} end)"


def rounded(expression: str, name: str) -> str:
    return f"round({expression}, {3 if name.endswith('_k_eur') else 8}) as {name}"


def grouped(expression: str) -> str:
    """Number with one decimal and thousands separators."""
    size = f"round(abs({expression}), 1)"
    whole = f"cast(floor({size}) as bigint)"
    tenth = f"cast(round(({size} - floor({size})) * 10) as bigint)"
    sign = f"case when {expression} < 0 and {size} > 0 then '-' else '' end"
    return f"({sign} || format('{{:,}}', {whole}) || '.' || {tenth})"


def percent(expression: str) -> str:
    return f"({grouped(f'({expression}) * 100')} || '%')"


REV, REV0 = "operating_revenue_latest_k_eur", "operating_revenue_previous_k_eur"
EB, EB0 = "ebitda_latest_k_eur", "ebitda_previous_k_eur"
EMP = "employees_latest"

SOURCE = f"""
latest as (select case when month(max(o_orderdate)) = 12 and day(max(o_orderdate)) = 31 then year(max(o_orderdate))
    else year(max(o_orderdate)) - 1 end as latest_year from orders),
per_order as (
  select l_orderkey, o_custkey, year(o_orderdate) = (select latest_year from latest) as is_latest,
    sum(cast(l_extendedprice as decimal(12,2)) * (cast(1 as decimal(3,2)) - cast(l_discount as decimal(3,2)))) as revenue,
    sum(cast(l_extendedprice as decimal(12,2)) * (cast(1 as decimal(3,2)) - cast(l_discount as decimal(3,2)))
      - cast(l_quantity as decimal(6,0)) * cast(p_retailprice as decimal(8,2))) as ebitda
  from orders join lineitem on o_orderkey = l_orderkey join part on l_partkey = p_partkey
  where year(o_orderdate) between (select latest_year - 1 from latest) and (select latest_year from latest) group by all),
per_company as (
  select o_custkey, nullif(count(*) filter (is_latest), 0) as n,
    cast(sum(revenue) filter (is_latest) as double) / 1000 as r1,
    cast(sum(revenue) filter (not is_latest) as double) / 1000 as r0,
    cast(sum(ebitda) filter (is_latest) as double) / 1000 as e1,
    cast(sum(ebitda) filter (not is_latest) as double) / 1000 as e0
  from per_order group by o_custkey),
source as (
  select c_custkey + 1 as record_order,
    concat('Customer ', cast(case when c_custkey % 150 = 149 then c_custkey - 1 else c_custkey end as varchar),
      case when c_custkey % 25 = 0 then ' (EXTINGUIDA)' when c_custkey % 33 = 0 then ' (EN LIQUIDACIÓN)'
           when c_custkey % 97 = 0 then '  (en disolución)' else '' end) as company_name,
    case when c_custkey % 9 <> 0 then concat('https://company-', cast(c_custkey as varchar), '.example') end as website,
    case when c_custkey % 13 = 0 then null when c_custkey % 4 = 1 then '  ' || lower(n_name)
         when c_custkey % 4 = 2 then replace(n_name, 'A', 'Á') else n_name end as municipality,
    n as {EMP},
    case when c_custkey % 61 = 0 then 0.0::double when c_custkey % 67 = 0 then -r1 else r1 end as {REV},
    r0 as {REV0}, e1 as {EB}, e0 as {EB0},
    case when c_custkey % 7 = 0 then 'There is no shareholders information for this company'
         else concat(' HOLDING  ', cast(c_custkey % 50 as varchar), ' SL') end as shareholder_name
  from customer left join nation on n_nationkey = c_nationkey
  left join per_company on o_custkey = c_custkey)"""

LAYERS = f"""{SOURCE},
spaced as (
  select record_order, {SPACE.format('company_name')} as company_name, {SPACE.format('website')} as website,
    {SPACE.format('municipality')} as municipality, {EMP}, {REV}, {REV0}, {EB}, {EB0},
    nullif({SPACE.format('shareholder_name')}, 'There is no shareholders information for this company') as shareholder_name,
    {PLAIN.format(SPACE.format('company_name'))} as plain
  from source),
named as (select *, {WORDS.format('plain')} as company_name_normalized, {STATUS.format('plain')} as legal_status from spaced),
keyed as (select *, legal_status in ('extinct', 'in_liquidation', 'in_dissolution') as has_adverse_legal_status,
    {match_key('company_name_normalized')} as company_match_key from named),
clean as (select *, count(*) over (partition by company_match_key) > 1 as potential_duplicate,
    count(*) over (partition by company_match_key) as potential_duplicate_count from keyed),
ratios as (select *, {div(REV, REV0)} - 1 as revenue_growth, {REV} - {REV0} as revenue_change_k_eur,
    {div(EB, REV)} as ebitda_margin, {EB} - {EB0} as ebitda_change_k_eur,
    {div(REV, EMP)} as revenue_per_employee_k_eur, {div(EB, EMP)} as ebitda_per_employee_k_eur from clean),
fin as (select *, coalesce({REV} < 0, false) as has_negative_latest_revenue,
    coalesce({REV} = 0, false) as has_zero_latest_revenue, coalesce({EB} < 0, false) as has_negative_latest_ebitda,
    coalesce(revenue_growth < 0, false) as has_revenue_decline,
    coalesce(abs(ebitda_margin) > 1, false) as has_extreme_ebitda_margin,
    ({REV} is null or {REV0} is null or {EB} is null or {EB0} is null) as has_incomplete_financial_data from ratios),
counted as (select *,
    has_incomplete_financial_data::bigint + has_negative_latest_revenue::bigint + has_zero_latest_revenue::bigint
      + has_extreme_ebitda_margin::bigint + potential_duplicate::bigint as data_quality_issue_count,
    has_adverse_legal_status::bigint + has_negative_latest_ebitda::bigint + has_revenue_decline::bigint
      as business_risk_signal_count from fin),
q as (select *, data_quality_issue_count > 0 as has_data_quality_issue,
    business_risk_signal_count > 0 as has_business_risk_signal,
    case when data_quality_issue_count >= 2 then 'high_priority_review' when data_quality_issue_count = 1 then 'review'
         else 'clean' end as data_quality_status,
    case when has_incomplete_financial_data or has_zero_latest_revenue or has_extreme_ebitda_margin then 'not_eligible'
         when has_negative_latest_revenue or potential_duplicate then 'eligible_with_review'
         else 'eligible' end as analytical_eligibility,
    concat_ws('|', case when has_incomplete_financial_data then 'incomplete_financial_data' end,
      case when has_negative_latest_revenue then 'negative_latest_revenue' end,
      case when has_zero_latest_revenue then 'zero_latest_revenue' end,
      case when has_extreme_ebitda_margin then 'extreme_ebitda_margin' end,
      case when potential_duplicate then 'potential_duplicate' end) as data_quality_reasons,
    concat_ws('|', case when has_adverse_legal_status then 'adverse_legal_status' end,
      case when has_negative_latest_ebitda then 'negative_latest_ebitda' end,
      case when has_revenue_decline then 'revenue_decline' end) as business_risk_reasons
  from counted)"""


def over(body: str, extra: str = "") -> str:
    """Query over the company layers."""
    return f"with {LAYERS}{extra} {body}"


SCOPES = {
    "all": "true",
    "eligible": "analytical_eligibility = 'eligible'",
    "no_adverse_eligible": "not has_adverse_legal_status and analytical_eligibility = 'eligible'",
    "no_adverse_marker": "not has_adverse_legal_status",
}


def overview(scope: str) -> str:
    medians = ", ".join(
        rounded(f"quantile_cont({column}, 0.5)", name)
        for name, column in (
            ("median_employees", EMP),
            ("median_revenue_k_eur", REV),
            ("median_ebitda_k_eur", EB),
            ("median_revenue_growth", "revenue_growth"),
            ("median_ebitda_margin", "ebitda_margin"),
        )
    )
    return f"""select '{scope}' as scope, count(*) as company_count, coalesce(sum({EMP}), 0)::bigint as employee_count,
      count({REV}) as revenue_available_count, count({EB}) as ebitda_available_count,
      {rounded(f'sum({REV})', 'revenue_total_k_eur')}, {rounded(f'sum({EB})', 'ebitda_total_k_eur')}, {medians},
      count(*) filter (has_negative_latest_ebitda) as negative_ebitda_count,
      count(*) filter (has_revenue_decline) as revenue_decline_count from q where {SCOPES[scope]}"""


FLAGS = [
    "has_incomplete_financial_data", "has_negative_latest_revenue", "has_zero_latest_revenue",
    "has_extreme_ebitda_margin", "potential_duplicate", "has_adverse_legal_status",
    "has_negative_latest_ebitda", "has_revenue_decline",
]
SUMMARY_FLAGS = FLAGS + ["has_data_quality_issue", "has_business_risk_signal"]
EXPLORER = f"""record_order, company_name, municipality, {EMP}, {REV}, {EB}, revenue_growth, ebitda_margin,
  data_quality_status, analytical_eligibility, has_business_risk_signal, data_quality_reasons, business_risk_reasons"""
SOURCE_COLUMNS = [
    "record_order", "company_name", "website", "municipality", EMP, REV, REV0, EB, EB0, "shareholder_name",
]


def union(parts: list[str]) -> str:
    return " union all ".join(f"({p})" for p in parts)


def coverage(columns: list[str]) -> str:
    return over(
        union(
            [
                f"select '{c}' as variable, count({c}) as available_records, count(*) - count({c}) as missing_records, "
                f"{rounded(f'count({c}) / count(*)', 'coverage_rate')} from q"
                for c in columns
            ]
        )
    )


def concentration(scope: str) -> str:
    levels = ", ".join(f"({n})" for n in (1, 2, 5, 10, 20, 50, 100))
    return f""",
ranked as (select {REV} as r, row_number() over (order by {REV} desc) as rn from q where {REV} is not null and {SCOPES[scope]}),
levels(top_n) as (values {levels}),
conc as (select '{scope}' as scope, top_n::bigint as top_n, count(r) filter (rn <= top_n) as companies_included,
    sum(r) filter (rn <= top_n) as revenue_k_eur, sum(r) filter (rn <= top_n) / sum(r) as concentration_rate
  from levels, ranked group by top_n)"""


def ranking(metric: str, direction: str, top_n: int, scope: str) -> str:
    return f"""select row_number() over (order by {metric} {direction}, record_order) as rank, company_name, municipality,
    {EMP}, {REV}, {EB}, revenue_growth, ebitda_margin, legal_status, analytical_eligibility
  from q where {metric} is not null and {SCOPES[scope]} qualify rank <= {top_n}"""


def places(table: str, place: str) -> str:
    return f"""select {place}, count(*) as company_count, coalesce(sum({EMP}), 0)::bigint as employee_count,
    {rounded(f'coalesce(sum({REV}), 0)', 'revenue_total_k_eur')}, {rounded(f'coalesce(sum({EB}), 0)', 'ebitda_total_k_eur')},
    {rounded(f'quantile_cont({REV}, 0.5)', 'median_revenue_k_eur')},
    {rounded('quantile_cont(ebitda_margin, 0.5)', 'median_ebitda_margin')},
    count(*) filter (has_adverse_legal_status) as adverse_status_count,
    count(*) filter (has_negative_latest_ebitda) as negative_ebitda_count,
    {rounded('count(*) filter (has_adverse_legal_status) / count(*)', 'adverse_status_rate')},
    {rounded('count(*) filter (has_negative_latest_ebitda) / count(*)', 'negative_ebitda_rate')}
  from {table} group by {place}"""


KPI = f"""select count(*) as total_companies, {rounded(f'coalesce(sum({REV}), 0)', 'total_revenue_k_eur')},
    {rounded(f'coalesce(quantile_cont({REV}, 0.5), 0)', 'median_revenue_k_eur')},
    {rounded(f'coalesce(sum({EB}), 0)', 'total_ebitda_k_eur')},
    {rounded('coalesce(quantile_cont(ebitda_margin, 0.5), 0)', 'median_ebitda_margin')},
    coalesce(sum({EMP}), 0)::bigint as total_employees,
    {rounded('count(*) filter (has_data_quality_issue) / count(*)', 'data_quality_issue_rate')},
    {rounded('count(*) filter (has_business_risk_signal) / count(*)', 'business_risk_signal_rate')},
    count(*) filter (analytical_eligibility = 'eligible') as eligible_companies from q"""

LEADER = f"""select municipality as leading_municipality,
    {rounded('count(*) / (select count(*) from q)', 'leading_share')} from q
  where municipality is not null group by municipality order by count(*) desc, municipality limit 1"""

LABELS = f""",
labelled as (select *, {GEO.format(SPACE.format('municipality'))} as municipality_original from q),
inventory as (select municipality_original, {WORDS.format('strip_accents(municipality_original)')} as municipality_match_key,
    count(*) as company_count, coalesce(sum({EMP}), 0)::bigint as employee_count,
    {rounded(f'coalesce(sum({REV}), 0)', 'revenue_total_k_eur')}, {rounded(f'coalesce(sum({EB}), 0)', 'ebitda_total_k_eur')},
    count(*) filter (has_adverse_legal_status) as adverse_status_count
  from labelled group by 1, 2)"""

MAPPED = f"""{LABELS},
mapped as (select labelled.*, case when municipality_original is null then 'UNKNOWN' else r_name end as municipality_canonical,
    case when municipality_original = 'NATION_7' then 'pending' else 'reviewed' end as municipality_review_status from labelled
  left join nation on {WORDS.format('strip_accents(municipality_original)')} = {WORDS.format('strip_accents(upper(n_name))')}
  left join region on n_regionkey = r_regionkey)"""

SHOCK, INFLATION = "(1.0::double + (-20.0)::double / 100.0)", "(1.0::double + 10.0::double / 100.0)"


def stressed(shock: str, inflation: str, table: str = "q") -> str:
    return f""",
s1 as (select *, {REV} * {shock} as stressed_revenue_k_eur,
    (case when {REV} - {EB} < 0 then 0.0::double else {REV} - {EB} end) * {inflation} as stressed_opex_k_eur from {table}),
s2 as (select *, stressed_revenue_k_eur - stressed_opex_k_eur as stressed_ebitda_k_eur from s1),
s as (select *, {div('stressed_ebitda_k_eur', 'stressed_revenue_k_eur')} as stressed_ebitda_margin,
    coalesce(stressed_ebitda_k_eur < 0, false) as stressed_has_negative_ebitda,
    coalesce({EB} >= 0 and stressed_ebitda_k_eur < 0, false) as is_newly_distressed from s2)"""


IMPACT = f"""{rounded(f'coalesce(sum({REV}), 0)', 'base_total_revenue_k_eur')},
    {rounded('coalesce(sum(stressed_revenue_k_eur), 0)', 'stressed_total_revenue_k_eur')},
    {rounded(f'coalesce(sum(stressed_revenue_k_eur), 0) - coalesce(sum({REV}), 0)', 'revenue_delta_k_eur')},
    {rounded(f'coalesce(sum({EB}), 0)', 'base_total_ebitda_k_eur')},
    {rounded('coalesce(sum(stressed_ebitda_k_eur), 0)', 'stressed_total_ebitda_k_eur')},
    {rounded(f'coalesce(sum(stressed_ebitda_k_eur), 0) - coalesce(sum({EB}), 0)', 'ebitda_delta_k_eur')},
    {rounded(f'coalesce((sum(stressed_ebitda_k_eur) - sum({EB})) / abs(nullif(sum({EB}), 0)), 0)', 'ebitda_contraction_pct')},
    count(*) filter ({EB} < 0) as base_negative_ebitda_count,
    count(*) filter (stressed_has_negative_ebitda) as stressed_negative_ebitda_count,
    count(*) filter (is_newly_distressed) as newly_distressed_count,
    coalesce(sum({EMP}) filter (stressed_has_negative_ebitda), 0)::bigint as jobs_in_distressed_entities,
    {rounded(f'greatest(0, least(1, (count({REV}) - count(*) filter (stressed_has_negative_ebitda)) / count({REV})))', 'resilience_rate')}"""

DEDUCTIONS = [
    ("has_incomplete_financial_data", "Incomplete Financial Reporting", 25),
    ("has_negative_latest_revenue", "Negative Operating Revenue Reported", 30),
    ("has_zero_latest_revenue", "Zero Operating Revenue", 25),
    ("has_extreme_ebitda_margin", "Extreme / Distorted EBITDA Margin (>100%)", 20),
    ("potential_duplicate", "Potential Entity Duplicate Warning", 10),
    ("has_adverse_legal_status", "Adverse Legal Status (Liquidation / Extinction)", 35),
    ("has_negative_latest_ebitda", "Negative Operating EBITDA", 20),
    ("has_revenue_decline", "Year-over-Year Revenue Contraction", 10),
]
LOST = " + ".join(f"{flag}::int * {points}" for flag, _, points in DEDUCTIONS)
LISTED = ", ".join(f"case when {flag} then '{factor} -{points}' end" for flag, factor, points in DEDUCTIONS)
GRADED = f""",
scored as (select *, greatest(0, least(100, 100 - ({LOST})))::int as health_score from q),
graded as (select *, case when health_score >= 90 then 'AAA' when health_score >= 80 then 'AA' when health_score >= 70 then 'A'
    when health_score >= 60 then 'BBB' when health_score >= 50 then 'BB' when health_score >= 40 then 'B'
    else 'CCC / Distressed' end as grade from scored)"""
BANDS = f"""case grade when 'AAA' then '#10B981' when 'AA' then '#34D399' when 'A' then '#60A5FA' when 'BBB' then '#FBBF24'
    when 'BB' then '#F97316' when 'B' then '#EF4444' else '#991B1B' end as grade_color,
  case grade when 'AAA' then 'Very strong: complete, consistent figures and sound operations.'
    when 'AA' then 'Strong: reliable figures with hardly a remark.'
    when 'A' then 'Good: healthy figures, a few points to look at.'
    when 'BBB' then 'Fair: average figures, the usual checks apply.'
    when 'BB' then 'Uncertain: clear risk signals or doubts about the data.'
    when 'B' then 'Weak: heavy losses or figures that contradict each other.'
    else 'Very weak: existence in question or figures beyond use.' end as assessment"""


def percent_rank(metric: str, name: str, compared: str) -> str:
    return (
        f"case when {metric} is null then 0.0 else "
        f"{rounded(f'(count({metric}) over (order by {metric} range between unbounded preceding and current row)) / {compared} * 100', name).rsplit(' as ', 1)[0]} end as {name}"
    )


GRID = ", ".join(f"({s}, {c / 2})" for s in range(-40, 21) for c in range(51))

TREE = f""",
tree as (select municipality, company_name, greatest({REV}, 1.0) as area,
    least(40.0, greatest(-20.0, coalesce(ebitda_margin, 0.0) * 100)) as margin
  from q where municipality is not null and {REV} is not null)"""

DOCUMENT_WORDS = WORDS.format(PLAIN.format(SPACE.format("text")))

ORACLES = {
    "municipality_summary": over(places("q", "municipality")),
    "clean_companies": over(
        """select record_order, company_name, website, municipality, shareholder_name, company_name_normalized,
        legal_status, has_adverse_legal_status, company_match_key, potential_duplicate, potential_duplicate_count from clean"""
    ),
    "text_normalize_documents": f"""select doc_id, {SPACE.format('text')} as single_spaced, {DOCUMENT_WORDS} as name_normalized,
      {STATUS.format(PLAIN.format(SPACE.format('text')))} as legal_status, {match_key(DOCUMENT_WORDS)} as match_key,
      upper(replace(nullif({SPACE.format('text')}, ''), 'ß', 'ss')) as geographic_text,
      {WORDS.format(PLAIN.format(SPACE.format('text')))} as geographic_key from documents""",
    "duplicate_groups": over(
        "select company_match_key, count(*) as group_size from clean group by 1 having count(*) > 1"
    ),
    "duplicate_documents": f"""with keyed as (select doc_id, {match_key(DOCUMENT_WORDS)} as k from documents)
      select doc_id, count(*) over (partition by k) > 1 as potential_duplicate,
        count(*) over (partition by k) as potential_duplicate_count from keyed""",
    "financial_features": over(
        """select record_order, revenue_growth, revenue_change_k_eur, ebitda_margin, ebitda_change_k_eur,
        revenue_per_employee_k_eur, ebitda_per_employee_k_eur, has_negative_latest_revenue, has_zero_latest_revenue,
        has_negative_latest_ebitda, has_revenue_decline, has_extreme_ebitda_margin, has_incomplete_financial_data from fin"""
    ),
    "quality_controls": over(
        """select record_order, data_quality_issue_count, business_risk_signal_count, has_data_quality_issue,
        has_business_risk_signal, data_quality_status, analytical_eligibility, data_quality_reasons, business_risk_reasons from q"""
    ),
    "quality_summary": over(
        union(
            [
                f"select '{f}' as indicator, count(*) filter ({f}) as record_count, "
                f"{rounded(f'count(*) filter ({f}) / count(*)', 'record_percentage')} from q"
                for f in SUMMARY_FLAGS
            ]
        )
    ),
    "category_distribution": over(
        union(
            [
                f"select '{c}' as variable, cast({c} as varchar) as category, count(*) as record_count from q group by {c}"
                for c in ("data_quality_status", "analytical_eligibility", "legal_status", "business_risk_signal_count")
            ]
        )
    ),
    "contract_report": over(
        union(
            [
                """select 'empty_source' as "check", (count(*) = 0)::bigint as failures from source""",
                """select 'missing_record_order' as "check", count(*) filter (record_order is null) as failures from source""",
                """select 'missing_company_name' as "check", count(*) filter (company_name is null) as failures from source""",
                """select 'blank_company_name' as "check", count(*) filter (trim(company_name) = '') as failures from source""",
                """select 'repeated_record_order' as "check", count(record_order) - count(distinct record_order) as failures from source""",
                *[
                    f"""select '{f}' as "check", count(*) filter ({f} is null) as failures from q"""
                    for f in FLAGS
                ],
            ]
        )
    ),
    "stage_integrity": over(
        """select 'source' as stage, count(*) as row_count from source union all
        select 'clean', count(*) from clean union all select 'financial', count(*) from fin union all
        select 'quality', count(*) from q union all
        select 'distinct_key_digests', case when (select count(*) from (select record_order from source except all select record_order from q)) = 0
          then 1 else 2 end"""
    ),
    "scope_filter": over(
        "select record_order, " + ", ".join(f"({c}) as in_{s}" for s, c in SCOPES.items()) + " from q"
    ),
    "eligible_companies": over(
        f"select record_order, company_name, legal_status, analytical_eligibility from q where {SCOPES['no_adverse_eligible']}"
    ),
    "overview_summary": over(overview("eligible")),
    "scope_comparison": over(union([overview(s) for s in SCOPES])),
    "faceted_filter": over(
        f"""select {EXPLORER} from q where not has_adverse_legal_status
        and municipality in ('NATION_3', 'nation_1', 'nation_5', 'NÁTION_2', 'NATION_7', 'NATION_11')
        and ({REV} is null or {REV} between 50 and 5000) and ({EMP} is null or {EMP} between 1 and 9)
        and data_quality_status in ('clean', 'review') and not has_business_risk_signal"""
    ),
    "explorer_projection": over(f"select {EXPLORER} from q"),
    "distinct_values": over("select distinct municipality from q where municipality is not null"),
    "company_lookup": over(
        f"select {', '.join(SOURCE_COLUMNS)} from q where company_name = 'Customer 148' order by record_order limit 1"
    ),
    "coverage": coverage([EMP, REV, EB, "revenue_growth", "ebitda_margin"]),
    "coverage_ordered": coverage(SOURCE_COLUMNS),
    "revenue_concentration": over(
        f"""select scope, top_n, companies_included, {rounded('revenue_k_eur', 'revenue_k_eur')},
        {rounded('concentration_rate', 'concentration_rate')} from conc""",
        concentration("all"),
    ),
    "concentration_curve": over(
        f"""select 'cumulative_share' as series, top_n, {rounded('concentration_rate * 100', 'share_pct')} from conc
        union all select 'equal_share', 1, round(100.0 / 100, 8) union all select 'equal_share', 100, 100.0""",
        concentration("eligible"),
    ),
    "revenue_percentiles": over(
        union(
            [
                f"select 'all' as scope, {p}::double as percentile, {rounded(f'quantile_cont({REV}, {p})', 'revenue_k_eur')} from q"
                for p in (0.25, 0.5, 0.75, 0.9, 0.95, 0.99)
            ]
        )
    ),
    "percentile_chart": over(
        union(
            [
                f"select '{label}' as label, {p}::double as percentile, {rounded(f'quantile_cont({REV}, {p})', 'revenue_k_eur')} "
                f"from q where not has_adverse_legal_status"
                for label, p in (("P28", 0.29), ("P10", 0.1), ("P50", 0.5), ("P99", 0.999))
            ]
        )
    ),
    "order_price_percentiles": f"""select o_orderstatus, count(o_totalprice) as available,
      {', '.join(rounded(f'quantile_cont(o_totalprice, {p})', n) for n, p in (('p25', 0.25), ('p50', 0.5), ('p75', 0.75), ('p99', 0.99)))}
      from orders group by o_orderstatus""",
    "company_ranking": over(ranking(REV, "desc", 20, "all")),
    "company_ranking_asc": over(ranking(EMP, "asc", 50, "no_adverse_eligible")),
    "leaderboard": over(f"select rank, company_name, {REV} from ({ranking(REV, 'desc', 15, 'all')})"),
    "municipality_top_n": over(
        f"select * from ({places('q', 'municipality')}) where municipality is not null order by revenue_total_k_eur desc, municipality limit 10"
    ),
    "kpi_metrics": over(KPI),
    "leading_municipality": over(LEADER),
    "municipality_inventory": over(
        """select row_number() over (order by company_count desc, revenue_total_k_eur desc, municipality_original) as inventory_id, *
        from inventory""",
        LABELS,
    ),
    "mapping_template": over(
        """select municipality_original, municipality_match_key, municipality_original as municipality_canonical,
        'pending' as review_status, 'identity_pending_review' as normalization_rule, '' as notes from inventory""",
        LABELS,
    ),
    "mapped_companies": over(
        "select record_order, municipality, municipality_canonical, municipality_review_status from mapped", MAPPED
    ),
    "mapped_summary": over(places("mapped", "municipality_canonical"), MAPPED),
    "mapping_contract": over(
        """select 'unknown_review_status' as "check", 0::bigint as failures union all
        select 'repeated_label', (select count(*) from (select municipality_original from inventory
          group by 1 having count(*) > 1)) union all
        select 'uncovered_label', (select count(*) from inventory where municipality_original is not null
          and municipality_original not in (select municipality_original from mapped where municipality_original is not null))""",
        MAPPED,
    ),
    "stress_companies": over(
        """select record_order, stressed_revenue_k_eur, stressed_opex_k_eur, stressed_ebitda_k_eur, stressed_ebitda_margin,
        stressed_has_negative_ebitda, is_newly_distressed from s""",
        stressed(SHOCK, INFLATION),
    ),
    "stress_summary": over(f"select {IMPACT} from s", stressed(SHOCK, INFLATION)),
    "stress_newly_distressed": over(
        f"""select company_name, municipality, {EMP}, {REV}, stressed_revenue_k_eur, {EB}, stressed_ebitda_k_eur,
        stressed_ebitda_margin from s where is_newly_distressed""",
        stressed(SHOCK, INFLATION),
    ),
    "stress_comparison": over(
        f"""select 'revenue' as measure, {rounded(f'sum({REV})', 'baseline_k_eur')}, {rounded('sum(stressed_revenue_k_eur)', 'stressed_k_eur')} from s
        union all select 'ebitda', round(sum({EB}), 3), round(sum(stressed_ebitda_k_eur), 3) from s""",
        stressed(SHOCK, INFLATION),
    ),
    "stress_grid": over(
        f"select revenue_shock_pct, cost_inflation_pct, {IMPACT} from s group by all",
        f""",
scenarios as (select a::double as revenue_shock_pct, b::double as cost_inflation_pct from (values {GRID}) v(a, b)),
paired as (select * from q, scenarios)"""
        + stressed("(1.0::double + revenue_shock_pct / 100.0)", "(1.0::double + cost_inflation_pct / 100.0)", "paired"),
    ),
    "health_scores": over(
        f"""select record_order, health_score, grade, {BANDS}, concat_ws('; ', {LISTED}) as deductions,
        concat_ws('; ', case when not has_incomplete_financial_data then 'Complete Financial Reporting' end,
          case when not has_adverse_legal_status then 'No Adverse Legal Marker' end,
          case when not has_negative_latest_ebitda and {EB} > 0 then 'Positive Operating EBITDA' end,
          case when not has_revenue_decline and revenue_growth > 0 then 'Positive YoY Growth (+' || {percent('revenue_growth')} || ')' end,
          case when ebitda_margin >= 0.15 then 'Strong EBITDA Margin (' || {percent('ebitda_margin')} || ')'
               when ebitda_margin > 0.05 then 'Stable EBITDA Margin (' || {percent('ebitda_margin')} || ')' end) as positives
        from graded""",
        GRADED,
    ),
    "grade_distribution": over("select grade, count(*) as record_count from graded group by grade", GRADED),
    "percentile_benchmark": over(
        f"""select record_order, company_name, {percent_rank(REV, 'revenue_scale_pct', 'count(*) over ()')},
        {percent_rank('ebitda_margin', 'ebitda_margin_rank_pct', 'count(ebitda_margin) over ()')},
        {percent_rank('revenue_per_employee_k_eur', 'labor_productivity_pct', 'count(revenue_per_employee_k_eur) over ()')},
        {percent_rank(EMP, 'workforce_size_pct', f'count({EMP}) over ()')},
        {percent_rank('revenue_growth', 'revenue_growth_rank_pct', 'count(revenue_growth) over ()')},
        50.0::double as benchmark_pct from q"""
    ),
    "positioning": over(
        f"""select record_order, company_name, municipality, {REV}, {EB}, ebitda_margin, {EMP},
        least(0.5, greatest(-0.5, ebitda_margin)) * 100 as display_margin,
        least(500, greatest(5, coalesce({EMP}, 10)))::bigint as size_scaled,
        case when has_business_risk_signal then 'Business Risk Signal' when has_data_quality_issue then 'Data Quality Review'
             else 'Prime Eligible' end as cohort
        from q where {REV} is not null and ebitda_margin is not null"""
    ),
    "treemap_rollup": over(
        f"""select municipality, company_name, case when grouping(company_name) = 1 then 'municipality' else 'company' end as level,
        {rounded('sum(area)', 'area_k_eur')}, {rounded('sum(area * margin) / sum(area)', 'ebitda_margin_pct')}
        from tree group by grouping sets ((municipality, company_name), (municipality))""",
        TREE,
    ),
    "raw_register_roundtrip": f"with {SOURCE} select * from source",
    "standard_csv_roundtrip": over(f"select {', '.join(SOURCE_COLUMNS)} from q"),
    "run_metadata": over(
        """select 7 as analytical_table_count, count(*) filter (has_business_risk_signal) as business_risk_signal_count,
        false as contains_licensed_data, 'thousand_eur' as currency_unit,
        count(*) filter (has_data_quality_issue) as data_quality_issue_count, 'fully_synthetic' as dataset_type,
        36 as final_column_count, 'companylens' as project, true as public_distribution_allowed, count(*) as row_count,
        'synthetic' as source, 10 as source_column_count,
        'All companies are made up; their figures describe no real region. Not a basis for lending, investing or legal steps. '
          || 'Legal status is read from words in company names, not from a court register.' as limitations from q"""
    ),
    "executive_briefing": over(
        f"""select k.*, l.*, total_companies::double as stated_companies, round(total_revenue_k_eur, 1) as stated_revenue_k,
        round(total_ebitda_k_eur, 1) as stated_ebitda_k, total_employees::double as stated_employees,
        round(median_revenue_k_eur, 1) as stated_median_revenue_k, round(median_ebitda_margin * 100, 1) as stated_median_margin,
        eligible_companies::double as stated_eligible, total_companies::double as stated_of_companies,
        round(100 * eligible_companies / total_companies, 1) as stated_eligible_share,
        round(data_quality_issue_rate * 100, 1) as stated_issue_rate,
        round(business_risk_signal_rate * 100, 1) as stated_risk_rate, leading_municipality as stated_place,
        round(leading_share * 100, 1) as stated_place_share from ({KPI}) k, ({LEADER}) l"""
    ),
    "long_keys_roundtrip": f"with {SOURCE} select record_order + 9007199254740992 as record_order, company_name from source",
    "label_texts": over(
        f"""select record_order, '€' || {grouped(REV)} || 'k' as revenue_label,
        {percent('round(ebitda_margin, 3)')} as margin_label,
        case when round(revenue_growth, 3) >= 0 then '+' else '' end || {percent('round(revenue_growth, 3)')} as growth_label from q"""
    ),
    "geographic_audit": over(
        """select municipality_original, row_number() over (order by company_count desc, revenue_total_k_eur desc, municipality_original) as inventory_id,
        company_count, employee_count, 'pending' as review_status from inventory""",
        LABELS,
    ),
}
ORACLES["mapping_roundtrip"] = ORACLES["mapping_template"]


def count_of(sql: str) -> str:
    return f"(select count(*) from ({sql}))"


TABLES = [
    "scope_comparison",
    "coverage",
    "quality_summary",
    "revenue_concentration",
    "revenue_percentiles",
    "company_ranking",
    "municipality_summary",
]
EVERY_COMPANY = over("select record_order from q")
ORACLES["pipeline_run"] = " union all ".join(
    [
        *[f"select '{s}' as name, {count_of(EVERY_COMPANY)} as row_count" for s in ("source", "clean", "financial", "quality")],
        *[f"select '{t}' as name, {count_of(ORACLES[t])} as row_count" for t in TABLES],
    ]
)
# Columns of the exported tables, in the order of TABLES, and of the company layer.
WIDTHS = [14, 4, 3, 5, 3, 10, 11, 36]
ORACLES["export_manifest"] = " union all ".join(
    f"select '{t}' as artifact, {count_of(ORACLES.get(t, EVERY_COMPANY))} as row_count, {w}::bigint as column_count, true as files_agree"
    for t, w in zip([*TABLES, "companies_quality_controlled"], WIDTHS, strict=True)
)
