"""Registered plans: each pairs a Spark DataFrame job over the driver tables with
an equivalent DuckDB SQL oracle (where SQL can express it)."""

from .catalog import ORACLE, REGISTRY, register  # noqa: F401
from . import (audit_plans, split_plans, metric_plans, openset_plans, feature_plans,  # noqa: F401,E402
               monitor_plans, report_plans, model_plans)
