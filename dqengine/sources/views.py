"""Tables that stand for dirty data and for metadata, derived from the given tables.

Every text is valid in Spark SQL and in DuckDB, so a query and its check start from the
same rows. Time windows use the fixed clocks below instead of "now".
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

DATASET_CLOCK = "2024-01-31 00:00:00"
EVENT_CLOCK = "2024-01-30 12:00:00"

VIEW_SQL: dict[str, str] = {
    "lineitem_dirty": """
with d as (
  select l_orderkey, l_partkey, l_suppkey, l_linenumber,
    case when (l_orderkey*7+l_linenumber)%25=0 then null else l_quantity end as l_quantity,
    case when (l_orderkey+l_linenumber)%100=0 then l_extendedprice*20
         when (l_orderkey+l_linenumber)%30=0 then -l_extendedprice
         else l_extendedprice end as l_extendedprice,
    l_discount, l_tax,
    case when l_orderkey%8=0 then null else l_returnflag end as l_returnflag,
    case when l_suppkey%14=0 then null else l_linestatus end as l_linestatus,
    l_shipdate
  from lineitem)
select * from d union all select * from d where l_orderkey%33=0
""",
    "events_dirty": """
with d as (
  select event_id, case when event_id%20=0 then null else ts end as ts, user_id,
    case when event_id%9=0 then null else event_type end as event_type,
    case when event_id%40=0 then null else value end as value, props
  from events)
select * from d union all select * from d where event_id%50=0
""",
    "documents_labeled": """
select d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic
from documents d left join labels l on d.doc_id=l.doc_id
""",
    "datasets": """
select o_orderkey as dataset_id, concat('ds_', cast(o_orderkey as string)) as dataset_name,
  round(o_totalprice - 100*floor(o_totalprice/100), 2) as quality_score,
  case when o_orderstatus='P' then 'PROCESSING' when o_orderstatus='F' then 'FAILED'
       when o_orderkey%2=0 then 'COMPLETED' else 'PENDING_APPROVAL' end as status,
  cast('2024-01-31 00:00:00' as timestamp) - (o_orderkey%4320) * interval '1' minute as processed_at
from orders
""",
    "quality_issues": """
select l_orderkey as dataset_id,
  case l_returnflag when 'A' then 'NULL_VALUES' when 'N' then 'DUPLICATES' else 'OUTLIERS' end as issue_type,
  case when l_discount>0.07 then 'HIGH' when l_discount>0.03 then 'MEDIUM' else 'LOW' end as severity,
  cast(l_quantity as bigint) as affected_rows, l_shipdate as detected_at
from lineitem
""",
    "actions_log": """
select event_id as action_id, user_id as dataset_id,
  case user_id%4 when 0 then 'DataQualityAgent' when 1 then 'DataHealingAgent'
       when 2 then 'RealTimeMonitor' else 'HumanOperator' end as agent_name,
  case when user_id%4=3 then case event_id%4 when 0 then 'REJECTED_HANDLE_NULLS'
         when 1 then 'BULK_REJECTED_REMOVE_DUPLICATES'
         when 2 then 'REJECTED_WITH_ALTERNATIVE_HANDLE_OUTLIERS' else 'APPROVED_HANDLE_NULLS' end
       when user_id%4=2 then case when event_type='error' then 'API_AUTO_FETCH_FAILED' else 'API_AUTO_FETCH' end
       when user_id%4=1 then 'EXECUTED_HANDLE_NULLS' else 'QUALITY_ANALYSIS_COMPLETE' end as action_type,
  case event_type when 'error' then 'FAILED' when 'signup' then 'PENDING_APPROVAL'
       when 'view' then 'EXECUTING' else 'COMPLETED' end as execution_status,
  concat('value=', cast(cast(floor(value) as bigint) as string), ' ', repeat('x', cast(event_id%150 as int))) as action_details,
  ts as action_at
from events
""",
    "feedback": """
select event_id as action_id, 'DataHealingAgent' as agent_name,
  case event_id%3 when 0 then 'general' when 1 then 'rejection_with_alternative' else 'nlp_parsed' end as feedback_type,
  case event_id%8 when 0 then 'Use median instead, too aggressive'
    when 1 then 'The mean is fine for missing data' when 2 then 'wrong method: FILL_MODE is better'
    when 3 then 'Remove outlier rows, severe case' when 4 then 'duplicate_keep_first please, minor issue'
    when 5 then 'data loss risk, needs manual review' when 6 then 'be conservative and careful'
    else '' end as feedback_text,
  cast(1 + floor(event_id/5.0)%5 as int) as rating,
  concat('dataset_', cast(user_id%10 as string)) as context, ts as feedback_at
from events where event_type <> 'error'
""",
    "learning_log": """
select event_id as log_id,
  case user_id%3 when 0 then 'DataQualityAgent' when 1 then 'DataHealingAgent' else 'PipelineOrchestrator' end as agent_name,
  case event_type when 'view' then 'quality_analysis' when 'click' then 'null_handling'
    when 'purchase' then 'FILL_MEDIAN' when 'signup' then 'FILL_MEAN' else 'auto_approved' end as action_type,
  concat('dataset_', cast(user_id%10 as string)) as context,
  case when event_id%(3+user_id%10)=0 then 0.0e0 else 1.0e0 end as success_score,
  value as execution_time, ts as logged_at
from events
""",
    "feed_sources": """
select s_suppkey as source_id, s_name as source_name,
  cast(300*(s_suppkey%5) as int) as fetch_interval, s_suppkey%7<>0 as is_active
from supplier
""",
    "feed_snapshots": """
select event_id as snapshot_id, user_id as source_id, props as payload,
  'json' as snapshot_format, cast(floor(value) as bigint) as records_count, ts as fetched_at
from events where event_type <> 'error'
""",
}

VIEW_INPUTS: dict[str, tuple[str, ...]] = {
    "lineitem_dirty": ("lineitem",),
    "events_dirty": ("events",),
    "documents_labeled": ("documents", "labels"),
    "datasets": ("orders",),
    "quality_issues": ("lineitem",),
    "actions_log": ("events",),
    "feedback": ("events",),
    "learning_log": ("events",),
    "feed_sources": ("supplier",),
    "feed_snapshots": ("events",),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, or a view derived from the given tables."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    if name in BASE_TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    for base in VIEW_INPUTS[name]:
        spark.read.parquet(f"{sf_dir}/{base}.parquet").createOrReplaceTempView(base)
    df = spark.sql(VIEW_SQL[name])
    if name == "datasets":
        df = df.withColumn("processed_at", F.col("processed_at").cast("timestamp_ntz"))
    return df


def with_views(query: str, *names: str) -> str:
    """Check SQL with the named views written out as common table expressions."""
    parts = [f"{n} as ({VIEW_SQL[n].strip()})" for n in names]
    body = query.strip()
    if body.lower().startswith("with "):
        return "with " + ",\n".join([*parts, body[5:]])
    return "with " + ",\n".join(parts) + "\n" + body if parts else body
