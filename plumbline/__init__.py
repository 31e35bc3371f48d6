"""Measure, explain and repair the quality of tables with Spark."""

from plumbline.operators.dataset import Dataset
from plumbline.operators.propose import decide
from plumbline.operators.rules import RuleSet, load_rules, parse_rules
from plumbline.plans.analysis import Analysis, analyze, measure, structural_findings
from plumbline.plans.review import advise, clean, offer
from plumbline.sources.history import History
from plumbline.sources.readers import open_view, read_csv, read_parquet

__all__ = [
    "Analysis",
    "Dataset",
    "History",
    "RuleSet",
    "advise",
    "analyze",
    "clean",
    "decide",
    "load_rules",
    "measure",
    "offer",
    "open_view",
    "parse_rules",
    "read_csv",
    "read_parquet",
    "structural_findings",
]
