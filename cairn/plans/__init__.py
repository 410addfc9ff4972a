"""Choice of an access path for graph queries."""

from cairn.plans.planner import Plan, plan

__all__ = ["Plan", "plan"]
