"""Differentially private microdata from hierarchical tables, on Spark.

``from tallytree import TopDown, Equal, SumEqual`` and the like: every public class, loaded when it is asked for.
"""

from importlib import import_module

_WHERE = {
    "TopDown": "plans.engine",
    **dict.fromkeys(("And", "AtomicExpression", "BinaryExpression", "CompoundExpression", "Equal", "Equivalent", "FalseExpression", "GreaterThan", "GreaterThanOrEqual", "Implies", "IsNull", "LessThan", "LessThanOrEqual", "LogicalExpression", "NaryExpression", "Not", "NotEqual", "Or", "TrueExpression", "UnaryExpression"), "functions.expressions"),
    **dict.fromkeys(("AggregateConstraint", "AtNode", "Constraint", "ContextualAggregateConstraint", "InfeasibleError", "StructuralZero", "SumEqual", "SumEqualRealTotal", "WeightedSumEqual"), "operators.constraints"),
    **dict.fromkeys(("geometric_budget", "uniform_budget", "register_mechanism"), "operators.noise"),
    **dict.fromkeys(("read_records", "write_records"), "sources"),
}
__all__ = sorted(_WHERE)


def __getattr__(name: str):
    if name not in _WHERE:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(import_module(f"{__name__}.{_WHERE[name]}"), name)
