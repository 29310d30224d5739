"""Registered source queries: journal lines and receipts derived from events, read through the tolerant parsers."""

from __future__ import annotations

from pyspark.sql import functions as F

from quiltlens.operators import audit as A
from quiltlens.plans.audit import pages
from quiltlens.plans.registry import define_view, query, view
from quiltlens.session import shared_dir
from quiltlens.sources import receipts as R

define_view("journal_lines", r"""
SELECT event_id, user_id, CASE WHEN event_id % 10 = 0 THEN replace(line, '"seq"', 'seq') WHEN event_id % 17 = 0 THEN '  ' ELSE line END AS value FROM (
  SELECT event_id, user_id, chr(123) || '"seq": ' || CAST(event_id AS STRING) || ', "id": "s' || CAST(user_id AS STRING) || '", "type": "' || event_type || '", "event": ' || chr(123) || '"type": "' || event_type || '", "count": ' || CAST(event_id % 7 AS STRING) || chr(125) || chr(125) AS line FROM {events}) t
""")


@query("journal_events", "SELECT 's' || user_id AS session, event_id AS seq, event_type AS type, event_id % 7 AS count FROM events WHERE event_id % 10 <> 0 AND event_id % 17 <> 0")
def _(spark, d):
    return R.parse_journal(view(spark, d, "journal_lines").select("value"))[0].select("session", "seq", "type", "count")


@query("journal_diagnostics", "SELECT 'unreadable journal line' AS error, value AS text FROM {journal_lines} WHERE event_id % 10 = 0")
def _(spark, d):
    return R.parse_journal(view(spark, d, "journal_lines").select("value"))[1]


@query("read_receipts", "SELECT event_id AS seq, 's' || user_id AS id, event_type AS type FROM events WHERE event_id % 10 <> 0 AND event_id % 17 <> 0")
def _(spark, d):
    import uuid

    path = f"{shared_dir(spark)}/quiltlens/receipts-{uuid.uuid4().hex}"
    view(spark, d, "journal_lines").select("value").write.text(path)
    return R.read_receipts(spark, path, R.EVENT_SCHEMA, multiline=False).filter("seq IS NOT NULL").select("seq", "id", "type")


# one file for every 256 events: a list of receipts, cut off in some files and no JSON at all in others
define_view("receipt_files", r"""
SELECT doc, CASE WHEN doc % 7 = 3 THEN '[' || items WHEN doc % 7 = 4 THEN 'no receipt ' || CAST(doc AS STRING) ELSE '[' || items || ']' END AS value FROM (
  SELECT doc, array_join(collect_list(item), ',') AS items FROM (
    SELECT CAST(floor(event_id / 256) AS BIGINT) AS doc, chr(123) || '"seq": ' || CAST(event_id AS STRING) || ', "id": "s' || CAST(user_id AS STRING) || '", "type": "' || event_type || '"' || chr(125) AS item FROM {events}) t GROUP BY doc) u
""")


def receipt_files(spark, d):
    import uuid

    path = f"{shared_dir(spark)}/quiltlens/receipt-files-{uuid.uuid4().hex}"
    view(spark, d, "receipt_files").repartition("doc").write.partitionBy("doc").text(path)
    return [f.withColumn("doc", F.regexp_extract("file", "/doc=([0-9]+)/", 1).cast("bigint")) for f in R.read_receipt_files(spark, path, R.EVENT_SCHEMA)]


@query("receipt_files", "SELECT CAST(floor(event_id / 256) AS BIGINT) AS doc, event_id AS seq, 's' || user_id AS id, event_type AS type FROM events WHERE CAST(floor(event_id / 256) AS BIGINT) % 7 NOT IN (3, 4)")
def _(spark, d):
    return receipt_files(spark, d)[0].select("doc", "seq", "id", "type")


@query("quarantined_files", "SELECT DISTINCT CAST(floor(event_id / 256) AS BIGINT) AS doc FROM events WHERE CAST(floor(event_id / 256) AS BIGINT) % 7 IN (3, 4)")
def _(spark, d):
    return receipt_files(spark, d)[1].select("doc")


@query("write_findings", 'SELECT "check", count(*) AS findings FROM {audit_f} GROUP BY 1')
def _(spark, d):
    import uuid

    path = f"{shared_dir(spark)}/quiltlens/findings-{uuid.uuid4().hex}"
    R.write_findings(A.audit_findings(pages(spark, d)), path)
    return spark.read.parquet(path).groupBy("check").agg(F.count("*").alias("findings"))
