"""Guarded ad-hoc queries."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from paypulse.plans.views import VIEWS

# Words a query may not contain, allowed first words, default row cap.
FORBIDDEN_WORDS = (
    "DELETE", "DROP", "ALTER", "TRUNCATE", "GRANT", "REVOKE", "CREATE",
    "REPLACE", "PUT", "GET", "COPY", "MERGE", "INSERT", "UPDATE",
)
FIRST_WORDS = ("select", "with")
DEFAULT_LIMIT = 50

# Spark functions that call arbitrary JVM methods from a plain SELECT.
JVM_CALLS = ("REFLECT", "TRY_REFLECT", "JAVA_METHOD")

# Nodes of a parsed plan that only work on the rows of those below them or on literals.
_NODES = frozenset((
    "Project", "Filter", "Aggregate", "UnresolvedHaving", "Sort", "GlobalLimit", "LocalLimit", "Offset", "Tail", "Distinct",
    "Join", "LateralJoin", "Union", "Intersect", "Except", "SubqueryAlias", "UnresolvedSubqueryColumnAliases", "Generate",
    "WithWindowDefinition", "UnresolvedInlineTable", "OneRowRelation", "LocalRelation", "Pivot", "Unpivot", "Sample",
    "UnresolvedHint", "Window",
))


def check_read_only(query: str | None) -> str:
    """The query without surrounding blanks and semicolons; ``ValueError`` if it may write."""
    text = (query or "").strip("; \t\r\n")
    if not text:
        raise ValueError("SQL is empty.")
    if not text.lower().startswith(FIRST_WORDS):
        raise ValueError("Only SELECT queries are allowed.")
    words = {word.upper() for word in re.findall(r"\w+", text)}
    if not words.isdisjoint(FORBIDDEN_WORDS + JVM_CALLS):
        raise ValueError("Query contains disallowed keywords.")
    return text


def _seq(items) -> list:
    return [items.apply(k) for k in range(items.size())]


def _check_plan(node, known: frozenset[str]) -> None:
    """Refuse whatever a parsed plan reads besides the relations in ``known`` (lower case).

    Every node is visited, in subqueries and common table expressions too; the name of an
    expression is known in those after it and in the query it belongs to.
    """
    kind = node.getClass().getSimpleName()
    if kind == "UnresolvedWith":
        for named in _seq(node.cteRelations()):
            _check_plan(named._2(), known)
            known |= {named._1().lower()}
    elif kind == "UnresolvedRelation":
        name = [part.lower() for part in _seq(node.multipartIdentifier())]
        if len(name) != 1 or name[0] not in known:
            raise ValueError(f"Unknown table or view: {'.'.join(name)}")
    elif kind not in _NODES:
        raise ValueError(f"Not allowed in a query: {kind}")
    for expression in _seq(node.expressions()):
        _check_expression(expression, known)
    for child in _seq(node.children()):
        _check_plan(child, known)


def _check_expression(expression, known: frozenset[str]) -> None:
    kind = expression.getClass()
    while kind is not None and kind.getSimpleName() != "PlanExpression":
        kind = kind.getSuperclass()
    if kind is not None:
        _check_plan(expression.plan(), known)
    for child in _seq(expression.children()):
        _check_expression(child, known)


def read_only_sql(
    spark: SparkSession, query: str, limit: int = DEFAULT_LIMIT, views: Iterable[str] = VIEWS
) -> DataFrame:
    """Run a SELECT over the registered ``views``; at most ``limit`` rows.

    The query is parsed first, and its whole plan is checked before anything is resolved or
    run: it may read the views and its own common table expressions, and nothing else. Files,
    catalog tables, table functions, scripts (``TRANSFORM ... USING``) and commands are refused.
    The cap is applied outside the query, so neither a larger LIMIT in it nor the word in a
    literal gets around it. Several statements in one text do not parse.
    """
    text = check_read_only(query)
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    catalog = spark._jsparkSession.sessionState().catalog()
    # A name that isn't a temp view now would be looked up in the catalog.
    _check_plan(plan, frozenset(v.lower() for v in views if catalog.getTempView(v).isDefined()))
    return spark.sql(text).limit(int(limit))
