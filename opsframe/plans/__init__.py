"""Jobs: the operators composed into the reports and plans that users run."""

from opsframe.plans.catalog import copy_table, inventory_report
from opsframe.plans.configs import config_change_plan
from opsframe.plans.logs import CompileLogReport, compile_log_report
from opsframe.plans.objects import retention_plan
from opsframe.plans.policies import migrate_policies, policy_upsert_report
from opsframe.plans.workload import queue_report, workload_report

__all__ = [
    "CompileLogReport",
    "compile_log_report",
    "config_change_plan",
    "copy_table",
    "inventory_report",
    "migrate_policies",
    "policy_upsert_report",
    "queue_report",
    "retention_plan",
    "workload_report",
]
