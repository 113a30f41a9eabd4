"""From an approved mapping to a loaded, reconciled table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from plumbline.operators import load as L
from plumbline.operators import mapping as M
from plumbline.operators import reconcile as R
from plumbline.plans.intake import Intake


def approved_plan(intake: Intake, mapping: DataFrame) -> list[L.ColumnPlan]:
    """The load plan of a mapping that passes every check; anything less is refused."""
    failed = M.check_mapping(intake.columns, mapping).filter("status = 'failed'").collect()
    if failed:
        raise L.LoadRefused(f"checks failed: {sorted(r['name'] for r in failed)}")
    return L.plan_columns(intake.columns, mapping)


def load_and_reconcile(intake: Intake, mapping: DataFrame, path: str, drop_duplicates: bool = False) -> DataFrame:
    """Load the typed rows to ``path`` and return the reconciliation of the written table."""
    plans = approved_plan(intake, mapping)
    totals = intake.totals.first()
    duplicates = int(totals["duplicate_rows"])
    rows = int(totals["rows"])
    L.load_table(intake.rows, plans, path, rows - duplicates if drop_duplicates else rows, drop_duplicates)
    written = intake.rows.sparkSession.read.parquet(path)
    return R.reconcile(written, plans, rows, duplicates, drop_duplicates)
