"""The supplied star schema seen as an insurance-policy extract.

``POLICY_SQL`` runs unchanged in Spark and in DuckDB, so both sides start from the same
rows. Money starts as whole cents.
"""

from __future__ import annotations

POLICY_SQL = """
SELECT
    l_orderkey,
    r_name AS server_name,
    concat('Provider ', p_brand) AS service_provider,
    n_name AS payer_country,
    s_name AS payer_name,
    concat(p_brand, ' ', p_type) AS master_contract,
    concat(p_brand, '/', p_type) AS master_contract_key,
    nullif(c_mktsegment, 'FURNITURE') AS policy_type,
    o_orderpriority AS policy_type_detail,
    concat('LA-', r_name) AS licensing_authority,
    nullif(l_returnflag, 'N') AS network_type,
    concat(l_linestatus, o_orderstatus) AS network_group,
    CASE o_custkey % 4 WHEN 0 THEN 'Principal' WHEN 1 THEN 'Spouse'
         WHEN 2 THEN 'Child' ELSE 'Parent' END AS dependency,
    n_name AS nationality,
    CASE o_custkey % 3 WHEN 0 THEN 'Single' WHEN 1 THEN 'Married'
         ELSE 'Widowed' END AS marital_status,
    CASE o_custkey % 2 WHEN 0 THEN 'Female' ELSE 'Male' END AS gender,
    CASE WHEN o_custkey % 4 = 0 THEN 'Principal' ELSE 'Dependent' END AS dependent_status,
    CASE o_custkey % 3 WHEN 0 THEN 'Adult' WHEN 1 THEN 'Child'
         ELSE 'Senior' END AS age_profile,
    CASE o_custkey % 6 WHEN 0 THEN '0-17' WHEN 1 THEN '18-29' WHEN 2 THEN '30-39'
         WHEN 3 THEN '40-49' WHEN 4 THEN '50-59' ELSE '60+' END AS age_bucket,
    p_type AS payer_type,
    CASE WHEN l_orderkey % 89 <> 0
         THEN concat('BEN-', cast(o_custkey AS string)) END AS beneficiary_key,
    CASE WHEN o_custkey % 5 <> 0
         THEN concat('REG-', cast(cast((o_custkey - o_custkey % 2) / 2 AS bigint) AS string))
         END AS registered_user_key,
    CASE WHEN o_custkey % 5 <> 0
         THEN CASE o_custkey % 3 WHEN 0 THEN 'Lumi' WHEN 1 THEN 'MyHealth'
                   ELSE 'CareHub' END END AS app_name,
    CASE WHEN l_suppkey % 40 = 7 THEN cast(0 AS bigint)
         ELSE cast(round(l_extendedprice * 100) AS bigint) END AS gross_cents,
    CASE WHEN l_suppkey % 50 <> 3
         THEN cast(round(l_extendedprice * (1 - l_discount) * 100) AS bigint)
         END AS net_cents,
    cast(round(l_extendedprice * l_tax * 100) AS bigint) AS tpa_cents,
    CASE WHEN l_orderkey % 101 <> 0 THEN cast(year(o_orderdate) AS int) END AS uw_year,
    CASE WHEN l_orderkey % 41 <> 0 THEN cast(o_orderdate AS date) END AS member_start_date,
    CASE WHEN l_orderkey % 43 <> 0
         THEN least(cast(l_shipdate AS date), cast(o_orderdate AS date) + 364)
         END AS member_stop_date,
    CASE WHEN o_custkey % 5 <> 0 AND o_custkey % 7 <> 0
         THEN date '1995-01-01' + cast((o_custkey * 37) % 2400 AS int)
         END AS registration_date
FROM {lineitem}
JOIN {orders} ON l_orderkey = o_orderkey
JOIN {customer} ON o_custkey = c_custkey
JOIN {nation} ON c_nationkey = n_nationkey
JOIN {region} ON n_regionkey = r_regionkey
JOIN {supplier} ON l_suppkey = s_suppkey
JOIN {part} ON l_partkey = p_partkey
"""
# The same joins for Spark: facts meet parts and suppliers while their rows are short, orders meet
# customers apart, and the two sides are brought together last.
POLICY_JOINS = """
FROM (SELECT * FROM {lineitem} JOIN {part} ON l_partkey = p_partkey
      JOIN {supplier} ON l_suppkey = s_suppkey) AS l
JOIN (SELECT * FROM {orders} JOIN {customer} ON o_custkey = c_custkey
      JOIN {nation} ON c_nationkey = n_nationkey
      JOIN {region} ON n_regionkey = r_regionkey) AS o ON l_orderkey = o_orderkey
"""
POLICY_FRAME_SQL = POLICY_SQL.partition("FROM {lineitem}")[0] + POLICY_JOINS
ALL_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

# Dirty text for the cleaning operators. {price} is the amount as decimal(12,2) text and
# {day}, {iso} the order date as ``d mm yyyy`` parts and as ISO text.
RAW_COLUMNS = """
    CASE l_orderkey % 8 WHEN 0 THEN concat('$', {price}) WHEN 1 THEN concat({price}, ' USD')
         WHEN 2 THEN '' WHEN 3 THEN ' NaN ' WHEN 4 THEN '(5)' WHEN 5 THEN concat('1,', {price})
         WHEN 6 THEN NULL ELSE {price} END AS gross_text,
    CASE l_orderkey % 6 WHEN 0 THEN {iso}
         WHEN 1 THEN concat(cast(day(o_orderdate) AS string), ' ', substr({iso}, 6, 2), ' ',
                            substr({iso}, 1, 4))
         WHEN 2 THEN concat(substr({iso}, 9, 2), '/', substr({iso}, 6, 2), '/',
                            substr({iso}, 1, 4))
         WHEN 3 THEN '2026' WHEN 4 THEN ' <NA> ' ELSE concat({iso}, ' 10:11:12')
         END AS start_text,
    CASE l_orderkey % 4 WHEN 0 THEN concat(cast(year(o_orderdate) AS string), '.0')
         WHEN 1 THEN concat(cast(year(o_orderdate) AS string), '.5')
         WHEN 2 THEN cast(year(o_orderdate) AS string)
         ELSE concat(cast(year(o_orderdate) AS string), ' ') END AS uw_text,
    CASE l_orderkey % 3 WHEN 0 THEN concat(replace({iso}, '-', ''), '115210')
         WHEN 1 THEN concat({iso}, ' 11:52:10') ELSE 'null' END AS reload_text,
    CASE l_orderkey % 5 WHEN 0 THEN concat('  ', l_returnflag, ' ') WHEN 1 THEN 'None'
         WHEN 2 THEN 'NULL' WHEN 3 THEN '' ELSE l_returnflag END AS network_text,
    concat('BEN-', cast(o_custkey AS string)) AS beneficiary_text
"""
RAW_SQL = (
    "SELECT l_orderkey, l_linenumber, "
    + RAW_COLUMNS.format(
        price="cast(cast(l_extendedprice AS decimal(12,2)) AS string)",
        iso="cast(cast(o_orderdate AS date) AS string)",
    )
    + " FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey"
)

# One scope per supplier and per nation, so the table of scopes grows with the data.
# The list values are valid JSON: no name holds a quote or a backslash.
SCOPES_SQL = """
SELECT concat('S', cast(s_suppkey AS string)) AS scope_id,
       CASE s_suppkey % 5
         WHEN 0 THEN concat('{{"year_start":1996,"year_end":1999,"payers":["', s_name, '"]}}')
         WHEN 1 THEN concat('{{"year_start":1990,"year_end":2030,"payers":["', s_name,
              '"," ","Nobody"],"network_types":["A","R"],"age_buckets":["30-39","60+"]}}')
         WHEN 2 THEN concat('{{"year_start":1998,"year_end":1998,"payers":["', s_name,
              '"],"app_names":["Lumi","CareHub"],"gender":["Female"]}}')
         WHEN 3 THEN concat('{{"year_start":1995,"year_end":2001,"payers":["', s_name,
              '","Supplier#000000001"],"policy_types":["BUILDING","MACHINERY"],',
              '"dependencies":["Child"],"marital_statuses":["Single","Married"]}}')
         ELSE concat('{{"year_start":1997,"year_end":1996,"payers":["', s_name, '"]}}')
       END AS scope_json
FROM {supplier}
UNION ALL
SELECT concat('N', cast(n_nationkey AS string)) AS scope_id,
       CASE n_nationkey % 3
         WHEN 0 THEN concat('{{"year_start":1995,"year_end":1997,"payer_countries":["',
                            n_name, '"],"network_groups":["OO","FF","OF"]}}')
         WHEN 1 THEN concat('{{"year_start":1995,"year_end":2001,"nationalities":["', n_name,
              '"],"providers":["Provider Brand#1","Provider Brand#2","Provider Brand#3",',
              '"Provider Brand#4"],"genders":["ignored"]}}')
         ELSE concat('{{"year_start":', cast(1995 + n_nationkey % 7 AS string),
              ',"year_end":', cast(1995 + n_nationkey % 7 AS string), ',"gender":[]}}')
       END AS scope_json
FROM {nation}
"""

# Questions: a template per customer, filled with names from the tables, and every user turn
# of the conversations. {{c}} is a contract, {{s}} a payer, both of which may be unknown.
_TEMPLATES = (
    "'App penetration trend for ', n_name, ' in 2000'",
    "'Compare ', supplier, ' and Supplier#000000002 app penetration and recommend an action.'",
    "'Which master contract has the highest gross premium by network type?'",
    "'Which age bucket has the lowest app penetration?'",
    "'Which policy type has the highest TPA ratio?'",
    "'  What is   the portfolio doing\t\tnow? '",
    "'How did active population change month over month in ', n_name, '?'",
    "'Net premium of ', contract, ' and ', contract, ' by network'",
    "'Gross premium for the ', lower(c_mktsegment), ' policy type in 2001 versus 2000'",
    "'Which payer is lagging on mobile adoption?'",
    "'Which insurer has the worst fee ratio?'",
    "'Show the 30-39 age band against 60+ on adoption'",
    "'Country premium economics for ', n_name",
    "'Which market has the largest member population over time?'",
    "'registered users by country in 2000 and 2001'",
    "'Net to gross margin of ', supplier, ' vs ', supplier_2",
    "'TPA to gross trend 1998'",
    "'premiums and fees by carrier'",
    "'Total ', c_mktsegment, ' product underwriting cost'",
    "'What about ', contract, ' in ', n_name, ' for the 18-29 group?'",
    "'Digital registration of ', n_name, ' and NATION_3 by year'",
    "'Unassigned policy type gross'",
    "'Straße nach Été: NET premium of ', upper(supplier), '!'",
    "'beneficiaries per payer, weakest first'",
    "'x2000 20005 2000. (2001) 1999 growth of gross premium'",
    "'Which carrier has the least gross premium?'",
    "'mobile usage of payer ', supplier",
    "'active members 2003'",
    "'contract review'",
    "'demographic gross premium, net premium and ratio'",
)
QUESTIONS_SQL = (
    "SELECT concat('C', cast(c_custkey AS string)) AS question_id, CASE c_custkey % "
    + str(len(_TEMPLATES))
    + "".join(f" WHEN {i} THEN concat({t}, '')" for i, t in enumerate(_TEMPLATES))
    + """ END AS question
FROM (SELECT *, concat('Supplier#', lpad(cast(c_custkey % 14 AS string), 9, '0')) AS supplier,
             concat('supplier ', lpad(cast(c_custkey % 9 AS string), 9, '0')) AS supplier_2,
             concat('Brand#', cast(c_custkey % 27 AS string), ' ECONOMY') AS contract
      FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey) AS c
UNION ALL
SELECT concat('V', cast(conv_id AS string), '-', cast(turn AS string)) AS question_id,
       text AS question
FROM {conversations} WHERE role = 'user'
"""
)
