"""Expressions, exact samplers and statistics of noise."""

from .expressions import (
    And,
    AtomicExpression,
    BinaryExpression,
    CompoundExpression,
    Equal,
    Equivalent,
    FalseExpression,
    GreaterThan,
    GreaterThanOrEqual,
    Implies,
    IsNull,
    LessThan,
    LessThanOrEqual,
    LogicalExpression,
    NaryExpression,
    Not,
    NotEqual,
    Or,
    TrueExpression,
    UnaryExpression,
)

__all__ = ["And", "AtomicExpression", "BinaryExpression", "CompoundExpression", "Equal", "Equivalent", "FalseExpression", "GreaterThan", "GreaterThanOrEqual", "Implies", "IsNull", "LessThan", "LessThanOrEqual", "LogicalExpression", "NaryExpression", "Not", "NotEqual", "Or", "TrueExpression", "UnaryExpression"]
