"""Plans bound to the test tables: one query for each operator, with its SQL."""

import importlib

CORE_QUERIES, CORE_ORACLE = {}, {}
for _name in ("graph_queries", "analysis_queries", "extract_queries", "review_queries", "evidence_queries", "impact_queries", "source_queries", "package_queries", "architecture_queries", "archive_queries", "contract_queries"):
    _module = importlib.import_module(f"orrery.plans.{_name}")
    CORE_QUERIES |= _module.QUERIES
    CORE_ORACLE |= _module.ORACLE
