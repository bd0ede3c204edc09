"""op3: mixing sources to target weights."""

from . import mixing
from .common import table
from .registry import query

SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, 3.0::DOUBLE * source_size AS cap, row_number() OVER (ORDER BY source IS NULL, source) AS place FROM totals),
weighted AS (SELECT *, [1.0::DOUBLE, 2.0, 3.0][(place - 1) % 3 + 1] AS weight FROM ranked),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighted),
shares AS (SELECT *, max(CASE WHEN cap > weight * level THEN level END) OVER () AS open_level FROM levels),
rates AS (
  SELECT source, source_size, coalesce(least(cap, weight * open_level), cap) AS target FROM shares),
rated AS (
  SELECT s.doc_id, s.size, r.source_size, r.target,
    CASE WHEN r.source_size > 0 THEN least(3.0::DOUBLE, r.target / r.source_size) ELSE 0.0::DOUBLE END AS rate,
    CAST(('0x' || substr(md5('mix:' || CAST(s.doc_id AS VARCHAR)), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS uniform
  FROM sized s JOIN rates r ON s.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, round(target, 4) AS target,
  CAST(floor(rate) + CASE WHEN uniform < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) * size AS taken
FROM rated
"""


@query("op3_source_mixing", SQL)
def op3_source_mixing(spark, folder):
    from pyspark.sql import functions as F

    report = mixing.mixing_report(table(spark, folder, "documents"))
    return report.select("doc_id", "size", "source_size", F.round("target", 4).alias("target"), "taken")
