"""Readers, column resolution, writers and the synthetic extract."""

from __future__ import annotations

from pyspark.sql import functions as F

from covermart.fixed_values import (
    REQUIRED_COLUMNS,
    SYNTHETIC_APPS,
    SYNTHETIC_NETWORK_GROUPS,
    SYNTHETIC_PAYER_TYPES,
    SYNTHETIC_PAYERS,
    SYNTHETIC_PRODUCTS,
    SYNTHETIC_PROFILES,
)
from covermart.sources import extract as ex
from covermart.sources.sinks import write_csv
from covermart.sources.synthetic import synthetic_rows
from fixture_queries.catalog import query
from fixture_queries.policy_queries import _DATE_SQL, _STAMP_SQL, _clean_sql, _number_sql
from fixture_queries.tables import raw_policies, stored, table, view

_EXTRACT_SQL = """
SELECT cast(l_orderkey AS string) AS index, n_name AS payercountry,
       concat('"', s_name, '", branch ', n_name) AS payer_name,
       cast(cast(round(l_extendedprice * 100) AS bigint) AS string) AS gross_premium_usd,
       CASE WHEN l_orderkey % 41 <> 0 THEN cast(cast(l_shipdate AS date) AS string) END
           AS member_start_date,
       CASE WHEN l_orderkey % 43 <> 0 THEN l_returnflag END AS op_member_network_type
FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey JOIN {nation} ON s_nationkey = n_nationkey
"""
_EXTRACT_ORACLE = _EXTRACT_SQL.format(lineitem="lineitem", supplier="supplier", nation="nation")


def _written_extract(spark, sf_dir, separator: str, name: str) -> str:
    return stored(
        spark, sf_dir, name,
        lambda path: write_csv(view(spark, sf_dir, _EXTRACT_SQL), path, separator),
    )


@query("scan_delimited", _EXTRACT_ORACLE)
def scan_delimited(spark, sf_dir):
    """Tab-separated content under a .csv name: the separator comes from the header line."""
    return ex.read_extract(spark, _written_extract(spark, sf_dir, "\t", "tabbed.csv"))


@query("csv_sink", _EXTRACT_ORACLE)
def csv_sink(spark, sf_dir):
    return ex.read_extract(spark, _written_extract(spark, sf_dir, ",", "extract.csv"))


_LINE = "list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')[1]"


def _count(delimiter: str) -> str:
    return f"length(line) - length(replace(line, {delimiter}, ''))"


@query(
    "sniff_delimiter",
    f"""SELECT doc_id, CASE WHEN c1 >= c2 AND c1 >= c3 AND c1 >= c4 THEN ','
                            WHEN c2 >= c3 AND c2 >= c4 THEN chr(9)
                            WHEN c3 >= c4 THEN ';' ELSE '|' END AS delimiter
        FROM (SELECT doc_id, {_count("','")} AS c1, {_count("chr(9)")} AS c2,
                     {_count("';'")} AS c3, {_count("'|'")} AS c4
              FROM (SELECT doc_id, {_LINE} AS line FROM documents) AS l
              WHERE line IS NOT NULL) AS c""",
)
def sniff_delimiter(spark, sf_dir):
    """The delimiter that each document's first line would be read with."""
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    return (
        table(spark, sf_dir, "documents")
        .select("doc_id", F.try_element_at(lines, F.lit(1)).alias("line"))
        .where("line IS NOT NULL")
        .select("doc_id", ex.delimiter_of(F.col("line")).alias("delimiter"))
    )


@query("scan_parquet", "SELECT * FROM orders")
def scan_parquet(spark, sf_dir):
    return ex.read_extract(spark, f"{sf_dir}/orders.parquet")


@query(
    "normalize_headers",
    """SELECT c_custkey AS index, n_name AS payer_name, c_acctbal AS gross_premium_usd,
              c_mktsegment AS policy_type FROM customer JOIN nation ON c_nationkey = n_nationkey""",
)
def normalize_headers(spark, sf_dir):
    raw = table(spark, sf_dir, "customer").join(
        table(spark, sf_dir, "nation"), F.expr("c_nationkey = n_nationkey")
    ).select(
        F.col("c_custkey").alias("  Index "),
        F.col("c_name").alias("Payer--Name"),
        F.col("c_acctbal").alias("Gross Premium (USD)"),
        F.col("c_mktsegment").alias("_policy.type_"),
        F.col("n_name").alias("PAYER NAME"),
    )
    return ex.normalize_headers(raw)


_RAW_SOURCE = {
    "index": "l_orderkey",
    "OP Member Network Type": "network_text",
    "Gross_Premium_USD": "gross_text",
    "NetPremiumUSD": "gross_text",
    "TPA_USD": "gross_text",
    "UWYear": "uw_text",
    "MemberStartDate": "start_text",
    "member stop date": "start_text",
    "reload_ts": "reload_text",
    "beneficiarykey": "beneficiary_text",
}
_RESOLVED = {
    "policy_record_id": "l_orderkey",
    "network_type": "network_text",
    "gross_premium_usd": "gross_text",
    "net_premium_usd": "gross_text",
    "tpa_fee_usd": "gross_text",
    "uw_year": "uw_text",
    "member_start_date": "start_text",
    "member_stop_date": "start_text",
    "reload_timestamp": "reload_text",
    "beneficiary_key": "beneficiary_text",
}


def _raw_extract(spark, sf_dir):
    return raw_policies(spark, sf_dir).select(
        *[F.col(c).alias(name) for name, c in _RAW_SOURCE.items()]
    )


@query(
    "resolve_aliases",
    "SELECT "
    + ", ".join(
        f"{_RESOLVED[c]} AS {c}" if c in _RESOLVED else f"cast(NULL AS varchar) AS {c}"
        for c in ex.CANONICAL_COLUMNS
    )
    + " FROM raw_policy",
    ("raw_policy",),
)
def resolve_aliases(spark, sf_dir):
    return ex.resolve_aliases(_raw_extract(spark, sf_dir))


def _typed_sql(column: str) -> str:
    source = _RESOLVED.get(column)
    if source is None:
        return f"NULL AS {column}"
    if column in ("gross_premium_usd", "net_premium_usd", "tpa_fee_usd"):
        return f"{_number_sql(source)} AS {column}"
    if column == "uw_year":
        return f"try_cast({_number_sql(source)} AS integer) AS {column}"
    if column in ("member_start_date", "member_stop_date"):
        return f"{_DATE_SQL} AS {column}"
    if column == "reload_timestamp":
        return f"{_STAMP_SQL} AS {column}"
    return f"{_clean_sql(f'cast({source} AS varchar)')} AS {column}"


@query(
    "typed_projection",
    f"SELECT {', '.join(_typed_sql(c) for c in ex.CANONICAL_COLUMNS)} FROM raw_policy",
    ("raw_policy",),
)
def typed_projection(spark, sf_dir):
    return ex.typed_projection(_raw_extract(spark, sf_dir))


@query(
    "validate_required",
    " UNION ALL ".join(
        f"SELECT '{c}' AS required_column, count({_RESOLVED[c]}) AS rows_with_text "
        "FROM raw_policy"
        for c in REQUIRED_COLUMNS
    ),
    ("raw_policy",),
)
def validate_required(spark, sf_dir):
    """Passes the check for missing columns, then counts what each required column holds."""
    raw = _raw_extract(spark, sf_dir)
    ex.validate_required(raw)
    counts = ex.resolve_aliases(raw).agg(*[F.count(c).alias(c) for c in REQUIRED_COLUMNS])
    return counts.unpivot([], list(REQUIRED_COLUMNS), "required_column", "rows_with_text")


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _of_payer(field: int) -> str:
    return f"{_list(row[field] for row in SYNTHETIC_PAYERS)}[p + 1]"


def _of_profile(field: int) -> str:
    return f"{_list(row[field] for row in SYNTHETIC_PROFILES)}[m + 1]"


def _cents(amount: str) -> str:
    return f"cast(format('{{:.2f}}', {amount}) AS double)"


_SYNTHETIC_SQL = f"""
SELECT id + 11310000 AS index, {_of_payer(3)} AS servername,
       {_of_payer(4)} AS serviceprovidername, {_of_payer(0)} AS payercountry,
       {_of_payer(1)} AS payer_name, {_of_payer(2)} AS payer_key,
       CASE WHEN (m + y) % 2 = 0 THEN {_list(row[7][0] for row in SYNTHETIC_PAYERS)}[p + 1]
            ELSE {_list(row[7][1] for row in SYNTHETIC_PAYERS)}[p + 1] END AS mastercontract,
       {_list(a for a, _ in SYNTHETIC_PRODUCTS)}[(m + p) % 4 + 1] AS policy_type,
       {_of_payer(5)} AS licensing_authority, {_of_payer(6)} AS op_member_network_type,
       {_of_profile(0)} AS dependency, {_of_profile(5)} AS nationality,
       {_of_profile(6)} AS maritalstatus, gross AS gross_premium_usd,
       {_cents("gross * (0.87::double + ((m + p) % 4) * 0.015::double)")} AS net_premium_usd,
       {_cents("gross * (0.035::double + ((m + p) % 3) * 0.006::double)")} AS tpa_usd,
       {_of_profile(2)} AS gender, {_of_profile(1)} AS isdependent,
       {_of_profile(3)} AS age_profile, y AS uwyear,
       {_list(SYNTHETIC_PAYER_TYPES)}[(p + m) % 3 + 1] AS payer_type,
       {_list(b for _, b in SYNTHETIC_PRODUCTS)}[(m + p) % 4 + 1] AS policytype,
       {_list(SYNTHETIC_NETWORK_GROUPS)}[(m + y + p) % 3 + 1] AS networkgroup,
       m + 1 AS rn1, strftime(make_date(y, s, 1), '%d %m %Y') AS member_start_date,
       strftime(CASE WHEN m % 11 = 0 THEN make_date(y, 6, 30)
                     WHEN m % 7 = 0 THEN make_date(y, 9, 30)
                     ELSE make_date(y, 12, 31) END, '%d %m %Y') AS member_stop_date,
       printf('BEN-%02d-%03d', p + 1, m + 1) AS beneficiarykey,
       printf('BP-%02d-%03d', p + 1, m + 1) AS beneficiarypayerkey,
       printf('MC-%02d-%02d', p + 1, (m + y) % 2 + 1) AS mastercontractkey,
       CASE WHEN reg THEN printf('REG-%02d-%03d', p + 1, m // 2 + 1) ELSE '' END
           AS registereduserkey,
       CASE WHEN reg THEN strftime(make_date(y, greatest(1, s - 1), 15), '%d %m %Y')
            ELSE '' END AS registrationdate,
       CASE WHEN reg THEN cast(y AS varchar) ELSE '' END AS registrationyear,
       CASE WHEN reg THEN {_list(SYNTHETIC_APPS)}[(m + p) % 3 + 1] ELSE 'None' END AS appname,
       {_of_profile(4)} AS age_bucket, concat(cast(y + 1 AS varchar), '0308115210') AS reload_ts
FROM (SELECT *, (m * 2 + p + y) % 10 + 1 AS s, (m + p + y) % 5 <> 0 AS reg,
             {_cents("(285 + p * 68 + m * 19) * (1 + (y - 2024) * 0.06::double)")} AS gross
      FROM (SELECT c_custkey AS id, cast(c_custkey % 16 AS integer) AS m,
                   cast((c_custkey // 16) % 6 AS integer) AS p,
                   cast(2024 + c_custkey // 96 AS integer) AS y FROM customer) AS i) AS d
"""


@query("synth_policies", _SYNTHETIC_SQL)
def synth_policies(spark, sf_dir):
    """One synthetic policy per customer number."""
    return synthetic_rows(
        table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    )
