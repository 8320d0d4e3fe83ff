"""How queries and their SQL are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


class Register:
    """Queries by name, with the DuckDB SQL that gives the same rows."""

    def __init__(self):
        self.queries: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, sql: str | None = None):
        def add(f):
            self.queries[f.__name__] = f
            if sql:
                self.sql[f.__name__] = sql
            return f

        return add


def six(x: Column | str, digits: int = 6) -> Column:
    """Rounded, so that the order of summation does not show."""
    return F.round(F.col(x) if isinstance(x, str) else x, digits)


def as_sql(x: Column | str, digits: int = 6) -> Column:
    """A double rounded as the SQL rounds it: scaled, to the nearest whole number, and back. ``six`` goes by its decimal digits, which differs at a half."""
    scale = float(10**digits)
    return F.round((F.col(x) if isinstance(x, str) else x) * scale, 0) / scale


#: Common table expressions of the views in ``sources.tables``.
def cell_sql(measure: str = "l_discount", name: str = "cell") -> str:
    return f"""{name} AS (
  SELECT l_suppkey AS row_id, p_brand || '/' || p_type AS col_id, r_name AS lineage, n_name AS cluster,
    CAST(sum(CAST(l_quantity AS DECIMAL(12,2)) * CAST({measure} AS DECIMAL(12,2))) AS DOUBLE) / CAST(sum(CAST(l_quantity AS DECIMAL(12,2))) AS DOUBLE) AS value
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  GROUP BY ALL)"""


PRED_SQL = (
    cell_sql()
    + """, sums AS (SELECT lineage, col_id, sum(value) AS s, count(value) AS n FROM cell GROUP BY ALL
), others AS (SELECT lineage, col_id, round((sum(s) OVER w - s) / nullif(sum(n) OVER w - n, 0), 12) AS mu FROM sums WINDOW w AS (PARTITION BY col_id)
), grand AS (SELECT lineage, avg(mu) AS grand FROM others GROUP BY lineage
), pred AS (SELECT row_id, cell.lineage, cluster, cell.col_id, round(value - mu, 9) AS truth, round(mu - grand, 9) AS predicted
  FROM cell JOIN others ON cell.lineage = others.lineage AND cell.col_id = others.col_id JOIN grand ON cell.lineage = grand.lineage)"""
)

METRIC_SQL = (
    PRED_SQL
    + """, ranked AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY truth, col_id) AS rt, row_number() OVER (PARTITION BY row_id ORDER BY predicted, col_id) AS rp,
    rank() OVER (PARTITION BY row_id ORDER BY truth) + (count(*) OVER (PARTITION BY row_id, truth) - 1) / 2.0::DOUBLE AS avg_t,
    rank() OVER (PARTITION BY row_id ORDER BY predicted) + (count(*) OVER (PARTITION BY row_id, predicted) - 1) / 2.0::DOUBLE AS avg_p
  FROM pred WHERE truth IS NOT NULL AND predicted IS NOT NULL
), metric AS (SELECT row_id, lineage, cluster, count(*) AS n,
    CASE WHEN sum(CASE WHEN rt <= 10 THEN greatest(-truth, 0) / log2(rt + 1) END) > 0 THEN sum(CASE WHEN rp <= 10 THEN greatest(-truth, 0) / log2(rp + 1) END) / sum(CASE WHEN rt <= 10 THEN greatest(-truth, 0) / log2(rt + 1) END) END AS ndcg,
    count(*) FILTER (rp <= 10 AND truth <= 0) / 10.0::DOUBLE AS precision, count(*) FILTER (rp <= 10 AND rt <= 10) / 10.0::DOUBLE AS overlap,
    CASE WHEN var_pop(avg_t) > 0 AND var_pop(avg_p) > 0 THEN corr(avg_t, avg_p) END AS spearman,
    avg(CASE WHEN rp <= 10 THEN truth END) - avg(CASE WHEN rt <= 10 THEN truth END) AS regret
  FROM ranked GROUP BY ALL HAVING count(*) >= 10)"""
)

EVENT_SQL = """ev AS (SELECT user_id AS cell, event_type AS feature, count(*) AS count, min(CAST(json_extract(props, '$.k') AS INT)) AS k FROM events GROUP BY ALL
), counts AS (SELECT cell, feature, count, 'g' || CAST(min(k) OVER (PARTITION BY cell) % 3 AS VARCHAR) AS label FROM ev)"""
