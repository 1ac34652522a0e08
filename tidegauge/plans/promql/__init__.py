"""PromQL over series tables: parsed to a tree, planned as one DataFrame."""

from tidegauge.plans.promql.parser import parse
from tidegauge.plans.promql.planner import Evaluation, evaluate, instant, range_query

__all__ = ["Evaluation", "evaluate", "instant", "parse", "range_query"]
