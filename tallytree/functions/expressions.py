"""Predicates over the cells of a domain, as an expression tree that becomes a Spark column.

Logic is two-valued: a comparison with a null is false, except that null differs from everything.
A literal whose kind doesn't fit its column equals nothing; ordering them is an error.
"""

from __future__ import annotations

import datetime
import decimal
import functools
import operator
from abc import ABC, abstractmethod
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _kind_of_type(t: T.DataType) -> str:
    if isinstance(t, T.NumericType):
        return "number"
    if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "time"
    if isinstance(t, T.BooleanType):
        return "boolean"
    return "text" if isinstance(t, T.StringType) else "other"


def _kind_of_value(v: Any) -> str:
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, (int, float, decimal.Decimal)):
        return "number"
    if isinstance(v, (datetime.date, datetime.datetime)):
        return "time"
    return "text" if isinstance(v, str) else "other"


class LogicalExpression(ABC):
    """A condition on a cell. As a constraint it says that cells that don't meet it are empty."""

    @abstractmethod
    def to_column(self, schema: T.StructType | None = None) -> Column:
        """A boolean column, never null. With a schema, literals are held against the columns' types."""

    def mask(self, domain: DataFrame, name: str = "mask") -> DataFrame:
        return domain.withColumn(name, self.to_column(domain.schema))


class TrueExpression(LogicalExpression):
    def to_column(self, schema=None):
        return F.lit(True)

    def __repr__(self):
        return "TrueExpression()"


class FalseExpression(LogicalExpression):
    def to_column(self, schema=None):
        return F.lit(False)

    def __repr__(self):
        return "FalseExpression()"


class AtomicExpression(LogicalExpression):
    """A comparison of one column with a literal."""

    compare = None
    if_null, if_other_kind = False, None

    def __init__(self, variable_id: str, value: Any) -> None:
        self.variable_id, self.value = variable_id, value

    def to_column(self, schema=None):
        if schema is not None:
            if self.variable_id not in schema.names:
                raise ValueError(f"{self!r}: there is no column {self.variable_id!r}")
            if self.value is not None and (kind := _kind_of_type(schema[self.variable_id].dataType)) != "other" and kind != _kind_of_value(self.value):
                if self.if_other_kind is None:
                    raise TypeError(f"{self!r}: the column is a {kind}")
                return F.lit(self.if_other_kind)
        if self.value is None:
            return F.lit(self.if_null)
        return F.coalesce(type(self).compare(F.col(self.variable_id), F.lit(self.value)), F.lit(self.if_null))

    def __repr__(self):
        return f"{type(self).__name__}({self.variable_id!r}, {self.value!r})"


class Equal(AtomicExpression):
    compare, if_other_kind = staticmethod(operator.eq), False


class NotEqual(AtomicExpression):
    compare, if_null, if_other_kind = staticmethod(operator.ne), True, True


class GreaterThan(AtomicExpression):
    compare = staticmethod(operator.gt)


class GreaterThanOrEqual(AtomicExpression):
    compare = staticmethod(operator.ge)


class LessThan(AtomicExpression):
    compare = staticmethod(operator.lt)


class LessThanOrEqual(AtomicExpression):
    compare = staticmethod(operator.le)


class IsNull(LogicalExpression):
    def __init__(self, variable_id: str) -> None:
        self.variable_id = variable_id

    def to_column(self, schema=None):
        return F.col(self.variable_id).isNull()

    def __repr__(self):
        return f"IsNull({self.variable_id!r})"


class CompoundExpression(LogicalExpression):
    def __init__(self, expressions: list[LogicalExpression]) -> None:
        for e in expressions:
            if not isinstance(e, LogicalExpression):
                raise TypeError(f"{type(self).__name__} takes logical expressions, not {e!r}")
        self.expressions = list(expressions)

    def _columns(self, schema) -> list[Column]:
        return [e.to_column(schema) for e in self.expressions]

    def __repr__(self):
        return f"{type(self).__name__}({', '.join(map(repr, self.expressions))})"


class NaryExpression(CompoundExpression):
    def __init__(self, *expressions: LogicalExpression) -> None:
        if not expressions:
            raise ValueError(f"{type(self).__name__} takes at least one expression")
        super().__init__(list(expressions))


class UnaryExpression(CompoundExpression):
    def __init__(self, expression: LogicalExpression) -> None:
        super().__init__([expression])


class BinaryExpression(CompoundExpression):
    def __init__(self, antecedent: LogicalExpression, consequent: LogicalExpression) -> None:
        super().__init__([antecedent, consequent])


class And(NaryExpression):
    def to_column(self, schema=None):
        return functools.reduce(operator.and_, self._columns(schema))


class Or(NaryExpression):
    def to_column(self, schema=None):
        return functools.reduce(operator.or_, self._columns(schema))


class Not(UnaryExpression):
    def to_column(self, schema=None):
        return ~self._columns(schema)[0]


class Implies(BinaryExpression):
    def to_column(self, schema=None):
        a, b = self._columns(schema)
        return ~a | b


class Equivalent(BinaryExpression):
    def to_column(self, schema=None):
        a, b = self._columns(schema)
        return a == b
