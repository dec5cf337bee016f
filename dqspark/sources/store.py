"""Audit history as partitioned Parquet tables, and exports.

Tables only grow: an audit is written once under its own partition, so writing it again
replaces that partition and nothing else.  Derived state (alerts, assignments) is kept as
numbered snapshots, since a Parquet table cannot be overwritten while it is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..functions.values import lit, name
from ..operators.cells import side_by_side

AUDIT_TABLES = ("audits", "column_profiles", "issues", "rule_executions", "deductions")


class AuditStore:
    """Reads and writes history tables below one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(self.path(table))

    def save(self, table: str, rows: DataFrame, audit_date: str, audit_id: str) -> None:
        """Write the rows of one audit into its partition; a repeated write replaces them."""
        marked = rows.drop("audit_date", "audit_id").withColumns({"audit_date": F.lit(audit_date), "audit_id": F.lit(audit_id)})
        writer = marked.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("audit_date", "audit_id").parquet(self.path(table))

    def save_audit(self, audit, audit_date: str, audit_id: str, dataset_name: str, kind: str = "audit", version: int | None = None) -> None:
        """Write every table of an audit (S7).  ``audit`` is the result of ``plans.audit``."""
        head = side_by_side([], audit.summary, audit.dataset).selectExpr(
            f"{lit(dataset_name)} as dataset_name", f"{lit(kind)} as audit_kind", f"cast({lit(version)} as int) as dataset_version",
            "current_timestamp() as created_at", "cast(overall as int) as score", "risk_level", "issue_count", "row_count",
            "column_count", "completeness_rate", "duplicate_row_rate",
        )
        self.save("audits", head, audit_date, audit_id)
        self.save("column_profiles", audit.columns, audit_date, audit_id)
        self.save("issues", audit.issues, audit_date, audit_id)
        self.save("deductions", audit.deductions, audit_date, audit_id)
        if audit.executions is not None:
            self.save("rule_executions", audit.executions, audit_date, audit_id)

    def audit(self, audit_id: str) -> DataFrame:
        """One audit's head row."""
        return self.live("audits").where(f"audit_id = {lit(audit_id)}")

    def list_audits(self, limit: int | None = None) -> DataFrame:
        """Audits, newest first."""
        ordered = self.live("audits").orderBy("created_at", "audit_id", ascending=False)
        return ordered.limit(limit) if limit else ordered

    def count_audits(self) -> int:
        return self.live("audits").count()

    def delete_audit(self, audit_id: str) -> int:
        """Hide an audit by writing a marker; readers drop marked audits."""
        found = self.audit(audit_id).count()
        if found:
            self.spark.sql(f"select {lit(audit_id)} as audit_id, current_timestamp() as deleted_at").write.mode("append").parquet(
                self.path("deleted_audits")
            )
        return found

    def live(self, table: str) -> DataFrame:
        """A table without the rows of deleted audits."""
        rows = self.read(table)
        try:
            gone = self.spark.read.parquet(self.path("deleted_audits"))
        except AnalysisException:
            return rows
        return rows.join(gone.select("audit_id").distinct(), "audit_id", "left_anti")

    # -- numbered snapshots ---------------------------------------------------------
    def snapshot_number(self, table: str) -> int:
        """Newest complete snapshot, 0 when there is none."""
        try:
            done = self.spark.read.parquet(self.path(table + "_commits"))
        except AnalysisException:
            return 0
        return int(done.agg(F.max("snapshot")).first()[0] or 0)

    def snapshot(self, table: str) -> DataFrame:
        number = self.snapshot_number(table)
        return self.spark.read.parquet(f"{self.path(table)}/snapshot={number}")

    def write_snapshot(self, table: str, rows: DataFrame, replace_unfinished: bool = False) -> int:
        """Write the next snapshot, then commit its number.

        A folder of that number without a commit belongs to another writer, or to one that
        failed; it is refused unless ``replace_unfinished``.
        """
        number = self.snapshot_number(table) + 1
        rows.write.mode("overwrite" if replace_unfinished else "errorifexists").parquet(f"{self.path(table)}/snapshot={number}")
        self.spark.sql(f"select {number} as snapshot").write.mode("append").parquet(self.path(table + "_commits"))
        return number

    # -- dataset versions ------------------------------------------------------------
    def write_version(self, df: DataFrame, dataset: str, version: int) -> str:
        """Store one immutable version of a dataset."""
        path = f"{self.root}/versions/dataset={dataset}/version={int(version)}"
        df.write.mode("errorifexists").parquet(path)
        return path

    def read_version(self, dataset: str, version: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/versions/dataset={dataset}/version={int(version)}")


# Export headings: column -> heading.
EXPORTS = {
    "rule_executions": {
        "rule_name": "Rule", "dataset_name": "Dataset", "outcome": "Outcome", "affected_rows": "Affected rows",
        "affected_percentage": "Affected percentage", "executed_at": "Executed", "audit_id": "Audit",
    },
    "drift": {
        "dataset": "Dataset", "drift_type": "Drift type", "severity": "Severity", "impact_score": "Impact score",
        "status": "Status", "baseline": "Baseline version", "candidate": "Candidate version",
    },
    "alerts": {
        "title": "Alert", "alert_type": "Type", "severity": "Severity", "status": "Status", "dataset_name": "Dataset",
        "detected_at": "Detected at", "audit_id": "Audit ID", "description": "Description",
    },
    "audits": {
        "dataset_name": "Dataset", "audit_id": "Audit ID", "score": "Score", "issue_count": "Issues", "risk_level": "Risk",
        "created_at": "Generated At",
    },
}


def export_view(df: DataFrame, kind: str) -> DataFrame:
    """The columns of an export under their headings."""
    return df.selectExpr(*[f"{name(c)} as {name(heading)}" for c, heading in EXPORTS[kind].items()])


def export_csv(df: DataFrame, kind: str, path: str) -> None:
    """Write an export as CSV with a header, in parallel."""
    export_view(df, kind).write.mode("overwrite").option("header", True).csv(path)
