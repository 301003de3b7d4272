"""The flagship query."""

from ..registry import sql_query

sql_query(
    "pricing_summary",
    """
    SELECT l_returnflag, l_linestatus, CAST(sum(l_quantity) AS DECIMAL(38, 2)) AS sum_qty,
           round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue,
           round(avg(l_discount), 4) AS avg_disc, count(*) AS n
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00'
    GROUP BY l_returnflag, l_linestatus
    """,
)
