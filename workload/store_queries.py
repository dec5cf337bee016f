"""Sources, the audit store and exports: written to the shared folder, read back and compared."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from dqspark.functions import fixed
from dqspark.operators import alerts, profile, reports
from dqspark.operators.rules import Rule
from dqspark.plans.audit import audit
from dqspark.plans.clean import apply, preview
from dqspark.session import shared_folder
from dqspark.sources import readers
from dqspark.sources.buckets import BucketedTable
from dqspark.sources.store import AuditStore, export_csv

from .history_queries import _HISTORY, _MERGED, _snapshot
from .profile_queries import DIRTY, _profile_sql
from .registry import miss, register, union
from .tables import table, view
from .views import AS_OF, with_views

OPTIONS = profile.Options(as_of=AS_OF)
_TOKENS = ", ".join("'" + t.replace("'", "''") + "'" for t in fixed.NA_TOKENS)


def _folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _write(df, path: str) -> None:
    df.write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


# --- sources -----------------------------------------------------------------------
@register("csv_round_trip", f"""select cast(doc_id as varchar) as doc_id, case when text in ({_TOKENS}) then null else sha256(text) end as digest,
 case when lang in ({_TOKENS}) then null else lang end as lang from documents""")
def csv_round_trip(spark, sf_dir):
    """Documents with line breaks in their fields, written as CSV and read by several tasks."""
    path = _folder(spark, "csv")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    _write(docs, path)
    return readers.read_csv(spark, path).selectExpr("doc_id", "sha2(text, 256) as digest", "lang")


@register("csv_profile", with_views(["customer_dirty"], union([_profile_sql(c, c, "customer_dirty").replace("from customer_dirty", f"from (select * replace (case when {c} in ({_TOKENS}) then null else {c} end as {c}) from customer_dirty)") for c in DIRTY if c != "balance_amount"])))
def csv_profile(spark, sf_dir):
    """A file is profiled as text columns."""
    path = _folder(spark, "csv")
    _write(view(spark, sf_dir, "customer_dirty"), path)
    found = profile.profile_columns(readers.validate_frame(readers.read_csv(spark, path)), options=OPTIONS)
    return found.where("column <> 'balance_amount'").selectExpr(
        "column as column_name", "inferred_type", "row_count", "missing_count", "missing_rate", "unique_count", "unique_rate",
        "cardinality", "constant as is_constant", "identifier_candidate",
    )


# --- the store ---------------------------------------------------------------------
def _stored(spark, sf_dir):
    store = AuditStore(spark, _folder(spark, "store"))
    df = view(spark, sf_dir, "customer_dup")
    rules = [Rule(1, "Phone pattern", "regex", "phone", parameters={"pattern": r"\+254\d{9}"}), Rule(2, "Names", "required", "full_name")]
    result = audit(df, rules, options=OPTIONS)
    for number in (1, 2, 3):
        store.save_audit(result, f"2024-01-0{number}", f"a{number}", "customers", "version_import", number)
    store.save_audit(result, "2024-01-02", "a2", "customers", "version_import", 2)  # written again, not twice
    store.delete_audit("a3")
    return store


@register("store_audits", with_views(["customer_dup"], """select a as audit_id, 'customers' as dataset_name, v as dataset_version, (select count(*) from customer_dup) as row_count,
 cast(7 as bigint) as column_count from (values ('a1', 1), ('a2', 2)) t(a, v)"""))
def store_audits(spark, sf_dir):
    """Audits saved, saved again, deleted, listed."""
    store = _stored(spark, sf_dir)
    return store.list_audits().select("audit_id", "dataset_name", "dataset_version", "row_count", "column_count")


@register("store_executions", with_views(["customer_dup"], f"""select a as audit_id, rule_id, affected_rows from (values ('a1'), ('a2')) t(a), (
 select cast(1 as bigint) as rule_id, count_if(not {miss('phone')} and not regexp_full_match(trim(phone), '\\+254[0-9]{{9}}')) as affected_rows from customer_dup
 union all select cast(2 as bigint), count_if({miss('full_name')}) from customer_dup)"""))
def store_executions(spark, sf_dir):
    return _stored(spark, sf_dir).live("rule_executions").select("audit_id", "rule_id", "affected_rows")


@register("version_round_trip", "select o_orderkey, o_totalprice, o_orderstatus from orders where o_orderkey % 2 = 1")
def version_round_trip(spark, sf_dir):
    """Two versions of a dataset; the second one is read back."""
    store = AuditStore(spark, _folder(spark, "store"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    store.write_version(orders, "orders", 1)
    store.write_version(store.read_version("orders", 1).where("o_orderkey % 2 = 1"), "orders", 2)
    return store.read_version("orders", 2)


@register("cleaned_version", with_views(["customer_dup"], "select count(distinct customer_id) as row_count, count(distinct customer_id) as customers, cast(0 as bigint) as unclean from customer_dup"))
def cleaned_version(spark, sf_dir):
    """A cleaned table written as a version, with its audit."""
    store = AuditStore(spark, _folder(spark, "store"))
    df = view(spark, sf_dir, "customer_dup")
    source = audit(df, options=OPTIONS)
    wanted = source.issues.where("title in ('Duplicate key values in customer_id', 'Inconsistent category casing in segment')")
    done = preview(df, source, [r["id"] for r in wanted.select("id").collect()], options=OPTIONS, order_by=["customer_id"])
    apply(store, "customers", 1, done, "2024-01-05", "c1")
    saved = store.audit("c1").select("row_count")
    rows = store.read_version("cleaned_customers", 1).selectExpr("count(distinct customer_id) as customers", "count_if(segment <> initcap(segment)) as unclean")
    return saved.crossJoin(rows)


# --- exports -----------------------------------------------------------------------
def _exported(spark, df, kind):
    path = _folder(spark, "export")
    export_csv(df, kind, path)
    return spark.read.option("header", True).csv(path)


@register("export_rules", with_views(["executions", "audits", "quality_rules"], """select r.name as "Rule", a.dataset_name as "Dataset", e.outcome as "Outcome", cast(e.affected_rows as varchar) as "Affected rows", e.audit_id as "Audit"
 from executions e join quality_rules r on r.id = e.rule_id join audits a on a.audit_id = e.audit_id"""))
def export_rules(spark, sf_dir):
    found = reports.execution_history(*[view(spark, sf_dir, v) for v in ("executions", "quality_rules", "audits")])
    return _exported(spark, found, "rule_executions").select("Rule", "Dataset", "Outcome", "`Affected rows`", "Audit")


@register("export_alerts", with_views(_HISTORY, f"""select alert_type as "Type", severity as "Severity", status as "Status", dataset_name as "Dataset" from {_MERGED}"""))
def export_alerts(spark, sf_dir):
    return _exported(spark, _snapshot(spark, sf_dir), "alerts").select("Type", "Severity", "Status", "Dataset")


# --- alerts kept in buckets ------------------------------------------------------------
@register("alerts_in_buckets", with_views(["runs"], """select workspace_id, concat('schedule:', run_id) as fingerprint, case when (v % 2) = 0 then '2024-02-02' else '2024-02-01' end as updated_on
 from (select *, cast(split_part(run_id, '-', 3) as int) as v from runs) where status = 'failed'"""))
def alerts_in_buckets(spark, sf_dir):
    """All run alerts, then those of even quarters once more: only their buckets are written again."""
    kept = BucketedTable(spark, _folder(spark, "alerts"), ["workspace_id", "fingerprint"])
    found = alerts.run_alerts(view(spark, sf_dir, "runs"))
    empty = alerts.upsert(_snapshot(spark, sf_dir).limit(0), found.limit(0), "2024-02-01")
    for part, day in ((found, "2024-02-01"), (found.where("cast(split_part(fingerprint, '-', 3) as int) % 2 = 0"), "2024-02-02")):
        kept.update(part, lambda held, fresh, day=day: alerts.upsert(held if "status" in held.columns else empty, fresh, day))
    return kept.read().selectExpr("workspace_id", "fingerprint", "date_format(updated_at, 'yyyy-MM-dd') as updated_on")


_LATER = "select fingerprint, severity from (select concat('schedule:', run_id) as fingerprint, 'critical' as severity, started_at from runs where status = 'failed') order by started_at desc, fingerprint limit 5 offset {}"


@register("alert_page_after", with_views(["runs"], _LATER.format(10)))
def alert_page_after(spark, sf_dir):
    """The third page, found by the last row of the second."""
    found, after = alerts.run_alerts(view(spark, sf_dir, "runs")).withColumn("status", F.lit("new")), None
    for _ in range(2):
        page = alerts.alert_page(found, page_size=5, after=after) if after else alerts.alert_page(found, page_size=5)
        rows = page.select("detected_at", "fingerprint").collect()  # a page
        if not rows:
            break
        after = rows[-1].asDict()
    return (alerts.alert_page(found, page_size=5, after=after) if after else found.limit(0)).select("fingerprint", "severity")
