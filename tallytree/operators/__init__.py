"""The relational and numerical operators of the engine."""

from .constraints import (
    AggregateConstraint,
    Constraint,
    ContextualAggregateConstraint,
    InfeasibleError,
    StructuralZero,
    SumEqual,
    SumEqualRealTotal,
)
from .noise import geometric_budget, register_mechanism, uniform_budget

__all__ = ["AggregateConstraint", "Constraint", "ContextualAggregateConstraint", "InfeasibleError", "StructuralZero", "SumEqual", "SumEqualRealTotal", "geometric_budget", "register_mechanism", "uniform_budget"]
