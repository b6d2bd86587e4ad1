"""Views in the session catalog, as SQL text over the layers' files, which every session of the catalog can read.

RAW views read the declared RAW tables. Views of the CURATED tables name the folders that the manifest names now, up to the last
committed batch, so they are replaced after each commit; what an older one names stays for a while, see ``batchlog``.
ANALYTICS views read the CURATED ones.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from paypulse.schemas import FAILED, PAID, TABLES, EventTable
from paypulse.sources import batchlog
from paypulse.sources.layers import committed_batch, curated_table

_RATE = "round(100 * {} / nullif({}, 0), 2)"
#: Names and texts of the views over ``curated.orders`` and ``curated.payments``.
ANALYTICS_VIEWS = {
    "v_revenue_per_minute": f"""
        SELECT date_trunc('MINUTE', event_ts) AS minute, sum(CASE WHEN status = '{PAID}' THEN amount ELSE 0D END) AS revenue
        FROM curated.payments GROUP BY 1""",
    "v_payment_failure_rate": f"""
        SELECT minute, total_payments, failed_payments, {_RATE.format('failed_payments', 'total_payments')} AS failure_rate_pct
        FROM (SELECT date_trunc('MINUTE', event_ts) AS minute, count(*) AS total_payments, count_if(status = '{FAILED}') AS failed_payments
              FROM curated.payments GROUP BY 1)""",
    "v_order_conversion": f"""
        SELECT minute, total_orders, paid_orders, {_RATE.format('paid_orders', 'total_orders')} AS conversion_rate_pct
        FROM (SELECT minute, count(order_id) AS total_orders, count(paid_id) AS paid_orders
              FROM (SELECT DISTINCT date_trunc('MINUTE', event_ts) AS minute, order_id FROM curated.orders) o
              LEFT JOIN (SELECT DISTINCT order_id AS paid_id FROM curated.payments WHERE status = '{PAID}') p ON order_id = paid_id
              GROUP BY minute)""",
}


def _raw_view(table: EventTable) -> str:
    fields = ", ".join(f"try_variant_get(record_content, '$.{f}', '{t}') AS {f}" for f, t in table.fields)
    return f"SELECT load_time, {fields}, record_content AS payload FROM raw.{table.raw_table}"


def _files(path: str) -> str:
    return f"parquet.`{path}`"


def curated_sql(spark: SparkSession, root: str, table: EventTable) -> str:
    """What ``keyed.read`` gives as of the last committed batch, as SQL over the folders."""
    stored = curated_table(root, table)
    manifest, committed = batchlog.manifest_of(spark, stored.path), committed_batch(spark, root)
    names = ", ".join(table.schema.names)
    changes = f"FROM {_files(f'{stored.path}/changes')} WHERE batch_id > {manifest.merged} AND batch_id <= {committed}"
    rows = [f"SELECT {names}, {run.last}L AS at FROM {_files(f'{stored.path}/{run.folder}')}" for run in manifest.folders]
    replaced = [f"SELECT {table.key} AS new_key, {run.last}L AS new_at FROM {_files(f'{stored.path}/{run.folder}-replaced')}" for run in manifest.runs]
    if committed > manifest.merged:
        rows.append(f"SELECT {names}, CAST(batch_id AS BIGINT) AS at {changes}")
        replaced.append(f"SELECT {table.key} AS new_key, CAST(batch_id AS BIGINT) AS new_at {changes} AND before IS NOT NULL")
    if not rows:
        columns = ", ".join(f"CAST(NULL AS {f.dataType.simpleString()}) AS {f.name}" for f in table.schema)
        return f"SELECT {columns} WHERE false"
    if not replaced:
        return f"SELECT {names} FROM ({rows[0]})"
    rows, replaced = (" UNION ALL ".join(x) for x in (rows, replaced))
    return f"SELECT {names} FROM ({rows}) LEFT ANTI JOIN ({replaced}) ON {table.key} = new_key AND new_at > at"


def publish_views(spark: SparkSession, root: str) -> None:
    """Create or replace all views. ``register_layers(catalog=True)`` has declared the databases and the RAW tables."""
    for table in TABLES.values():
        spark.sql(f"CREATE OR REPLACE VIEW raw.v_{table.name} AS {_raw_view(table)}")
        spark.sql(f"CREATE OR REPLACE VIEW curated.{table.name} AS {curated_sql(spark, root, table)}")
    for name, text in ANALYTICS_VIEWS.items():
        spark.sql(f"CREATE OR REPLACE VIEW analytics.{name} AS {text}")
