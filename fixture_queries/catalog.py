"""The list of queries and, beside each, the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fixture_queries import views

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# Common table expressions that an oracle may start from, each with what it needs.
_TABLE_NAMES = {name: name for name in views.ALL_TABLES}
COMMON = {
    "policy": ((), views.POLICY_SQL.format(**_TABLE_NAMES)),
    "raw_policy": ((), views.RAW_SQL.format(**_TABLE_NAMES)),
    "scopes": ((), views.SCOPES_SQL.format(**_TABLE_NAMES)),
    "records": (
        ("policy",),
        """
        SELECT *, CASE WHEN provisional_stop < effective_start THEN effective_start
                       ELSE provisional_stop END AS effective_stop
        FROM (SELECT *,
                coalesce(member_start_date, CASE WHEN uw_year BETWEEN 1900 AND 2100
                         THEN make_date(uw_year, 1, 1) END) AS effective_start,
                coalesce(member_stop_date, CASE WHEN uw_year BETWEEN 1900 AND 2100
                         THEN make_date(uw_year, 12, 31) END) AS provisional_stop
              FROM policy) AS d
        """,
    ),
    "scoped": (("records",), "SELECT * FROM records WHERE uw_year IS NOT NULL"),
    "expanded": (
        ("records",),
        """
        SELECT * FROM (
            SELECT r.*, cast(last_day(cast(month_start AS date)) AS date) AS month_end
            FROM (SELECT *, row_number() OVER () AS row_id FROM records
                  WHERE effective_start IS NOT NULL AND effective_stop IS NOT NULL) AS r,
                 unnest(generate_series(date_trunc('month', effective_start),
                                        date_trunc('month', effective_stop),
                                        INTERVAL 1 MONTH)) AS t(month_start)
        ) AS x WHERE month_end <= effective_stop
        """,
    ),
    "months": (
        ("expanded",),
        """
        SELECT *, cast(gross_cents AS hugeint) * 10000000000000000 // n AS gross_share,
               cast(net_cents AS hugeint) * 10000000000000000 // n AS net_share,
               cast(tpa_cents AS hugeint) * 10000000000000000 // n AS tpa_share,
               CASE WHEN beneficiary_key IS NOT NULL AND registered_user_key IS NOT NULL
                     AND (registration_date IS NULL OR registration_date <= month_end)
                    THEN registered_user_key END AS active_user
        FROM (SELECT *, count(*) OVER (PARTITION BY row_id) AS n,
                     row_number() OVER (PARTITION BY row_id ORDER BY month_end) AS place
              FROM expanded) AS e
        """,
    ),
    "scoped_months": (("months",), "SELECT * FROM months WHERE uw_year IS NOT NULL"),
}

USD_SUMS = """
    cast(sum(gross_cents) AS bigint) / 1e2 AS gross_premium_usd,
    cast(sum(net_cents) AS bigint) / 1e2 AS net_premium_usd,
    cast(sum(tpa_cents) AS bigint) / 1e2 AS tpa_fee_usd"""
MONTH_MEASURES = """
    count(DISTINCT beneficiary_key) AS active_population,
    count(DISTINCT active_user) AS active_registered_users,
    coalesce(cast((sum(gross_share) + 500100000000) // 1000000000000 AS bigint), 0) / 1e6
        AS gross_premium_usd,
    coalesce(cast((sum(net_share) + 500100000000) // 1000000000000 AS bigint), 0) / 1e6
        AS net_premium_usd,
    coalesce(cast((sum(tpa_share) + 500100000000) // 1000000000000 AS bigint), 0) / 1e6
        AS tpa_fee_usd"""
LINKED = (
    "count(DISTINCT CASE WHEN registered_user_key IS NOT NULL THEN beneficiary_key END)"
)


def common(name: str, sql: str, needs: tuple[str, ...] = ()) -> None:
    """Add a common table expression for later oracles."""
    COMMON[name] = (needs, sql)


def with_common(sql: str, *names: str) -> str:
    """``sql`` after a WITH clause that defines the named expressions and their needs."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for need in COMMON[name][0]:
            add(need)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    clauses = ",\n".join(f"{n} AS ({COMMON[n][1]})" for n in ordered)
    return f"WITH {clauses}\n{sql}" if ordered else sql


def query(name: str, oracle: str | None = None, start: tuple[str, ...] = ()):
    """Register a query under a name, with its oracle where SQL can express it."""

    def add(function: Query) -> Query:
        QUERIES[name] = function
        if oracle is not None:
            ORACLES[name] = with_common(oracle, *start)
        return function

    return add
