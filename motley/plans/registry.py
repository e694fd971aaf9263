"""The registered queries: name -> (function of spark and sf_dir, SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Common table expressions of the SQL: lineitem as frames of labels (also with gaps), and in long form.
WITH = """
WITH wide AS (
  SELECT CAST(year(l_shipdate) AS BIGINT) AS sample_id, l_orderkey * 8 + l_linenumber AS frame_id, l_orderkey, row_number() OVER () AS rid,
         [CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END, CASE l_linestatus WHEN 'F' THEN 0 ELSE 1 END,
          least(4, CAST(floor(l_quantity / 10) AS INTEGER)), CAST(floor(round(l_discount * 100) / 3) AS INTEGER), CAST(floor(round(l_tax * 100) / 3) AS INTEGER)] AS labels
  FROM lineitem
), site AS (SELECT * FROM (VALUES (0, 3), (1, 2), (2, 5), (3, 4), (4, 3)) AS t(site, k)),
long AS (SELECT sample_id, frame_id, rid, l_orderkey, site, k, labels[site + 1] AS label FROM wide CROSS JOIN site),
gaps AS (SELECT sample_id, frame_id, rid, site, k, CASE WHEN (l_orderkey + site) % 11 <> 0 THEN label END AS label FROM long),
alphabet AS (SELECT site, k, CAST(unnest(range(k)) AS INTEGER) AS label FROM site),
counts AS (SELECT sample_id, site, label, count(*) AS n FROM long GROUP BY ALL),
samples AS (SELECT DISTINCT sample_id FROM wide),
marginal AS (
  SELECT s.sample_id, a.site, a.label, coalesce(c.n, 0) / sum(coalesce(c.n, 0)) OVER (PARTITION BY s.sample_id, a.site) AS p
  FROM samples s CROSS JOIN alphabet a LEFT JOIN counts c ON c.sample_id = s.sample_id AND c.site = a.site AND c.label = a.label
),
edge AS (SELECT a.site AS r, b.site AS s FROM site a JOIN site b ON a.site < b.site),
jcounts AS (SELECT sample_id, r, s, labels[r + 1] AS k, labels[s + 1] AS l, count(*) AS n FROM wide CROSS JOIN edge GROUP BY ALL),
jalphabet AS (SELECT e.r, e.s, a.label AS k, b.label AS l FROM edge e JOIN alphabet a ON a.site = e.r JOIN alphabet b ON b.site = e.s),
joint AS (
  SELECT s.sample_id, a.r, a.s, a.k, a.l, coalesce(c.n, 0) / sum(coalesce(c.n, 0)) OVER (PARTITION BY s.sample_id, a.r, a.s) AS p
  FROM samples s CROSS JOIN jalphabet a LEFT JOIN jcounts c ON c.sample_id = s.sample_id AND c.r = a.r AND c.s = a.s AND c.k = a.k AND c.l = a.l
)
"""


def js_sql(rows: str, keys: str) -> str:
    """SELECT keys, kl, js of rows (keys, p, q): clipped and normalised with windows, unlike the operator's single aggregation."""
    return f"""
    SELECT {keys}, sum(pc * ln(pc / qc)) AS kl, (sum(pc * ln(pc / mc)) + sum(qc * ln(qc / mc))) / 2 AS js FROM (
      SELECT {keys}, greatest(p, 1e-12) / sum(greatest(p, 1e-12)) OVER w AS pc, greatest(q, 1e-12) / sum(greatest(q, 1e-12)) OVER w AS qc,
             greatest((p + q) / 2, 1e-12) / sum(greatest((p + q) / 2, 1e-12)) OVER w AS mc
      FROM ({rows}) WINDOW w AS (PARTITION BY {keys})
    ) GROUP BY {keys}"""


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add
