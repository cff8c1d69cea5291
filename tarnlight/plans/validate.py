"""The read-only gate: a query is judged by Spark's own parse, not by patterns."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

MOST_CHARS = 10_000
#: Formats whose name before a path would read files past the catalog; table functions that are safe. Fixed values.
FORMATS = frozenset("parquet csv json orc text avro delta binaryfile libsvm jdbc image xml".split())
TABLE_FUNCTIONS = frozenset("range explode explode_outer posexplode posexplode_outer inline inline_outer stack json_tuple variant_explode".split())
#: Functions that call into the machine instead of computing from their arguments. Fixed values.
FUNCTIONS_DENIED = frozenset("reflect java_method try_reflect input_file_name input_file_block_start input_file_block_length current_user session_user user version spark_partition_id assert_true raise_error".split())
#: A translation may be longer than its text.
MOST_SPARK_CHARS = 20 * MOST_CHARS
_READ = frozenset("Project Filter Aggregate Sort GlobalLimit LocalLimit Offset Join Distinct Union Intersect Except UnresolvedWith SubqueryAlias UnresolvedRelation UnresolvedInlineTable OneRowRelation Generate WithWindowDefinition UnresolvedHaving Sample Pivot UnresolvedPivot Unpivot UnresolvedTableValuedFunction LateralJoin UnresolvedSubqueryColumnAliases Window ResolvedInlineTable LocalRelation Deduplicate UnresolvedTVFAliases Repartition RepartitionByExpression UnresolvedHint CTERelationDef WithCTE UnresolvedOrdinal Tail".split())
_SHOW = frozenset("ShowTables ShowNamespaces ShowTablesCommand ShowColumns".split())


class Rejected(ValueError):
    """A query that the service does not run."""


def _names_functions(sql: str) -> bool:
    """Whether a text without comments may call a function that is not allowed.

    A denied name must stand in the text as it is, a computed one behind IDENTIFIER, a
    qualified one behind a dot; without these the expressions need not be walked.
    """
    low = sql.lower()
    return "identifier" in low or any(f in low for f in FUNCTIONS_DENIED) or re.search(r"\.\s*(?:\w+|`[^`]*`)\s*\(", low) is not None


def parsed(spark: SparkSession, sql: str, translated: bool = False):
    """Spark's own parse of one read-only query, not yet bound to tables; ``Rejected`` if it is none."""
    if not sql.strip():
        raise Rejected("empty query")
    if len(sql) > MOST_SPARK_CHARS:
        raise Rejected(f"query is longer than {MOST_SPARK_CHARS} characters")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as e:
        raise Rejected(f"not one valid statement: {str(e).splitlines()[0][:300]}") from None
    if plan.nodeName() not in _SHOW:
        _walk(plan, not translated or _names_functions(sql))
    return plan


def check(spark: SparkSession, sql: str) -> None:
    """Raise ``Rejected`` unless the text is one read-only query over catalog tables."""
    if len(sql) > MOST_CHARS:
        raise Rejected(f"query is longer than {MOST_CHARS} characters")
    parsed(spark, sql)


def check_predicate(spark: SparkSession, text: str) -> None:
    """Raise ``Rejected`` unless the text is one condition over a row: no subquery, no other clause."""
    plan = parsed(spark, f"SELECT 1 WHERE (\n{text}\n)")
    shape = [plan.nodeName()]
    while plan.children().size() == 1:
        plan = plan.children().apply(0)
        shape.append(plan.nodeName())
        if plan.subqueries().size():
            raise Rejected("a predicate has no subqueries")
    if shape != ["Project", "Filter", "OneRowRelation"]:
        raise Rejected("not one condition")


def _items(seq):
    return [seq.apply(i) for i in range(seq.size())]


def _walk(plan, deep: bool) -> None:
    name = plan.nodeName().split(" ")[0].lstrip("'")
    if name not in _READ:
        raise Rejected(f"statement not allowed: {name}")
    if name == "UnresolvedRelation":
        names = _items(plan.multipartIdentifier())
        if len(names) > 2 or (len(names) > 1 and names[0].lower() in FORMATS) or any(c in n for n in names for c in "/\\:*?"):
            raise Rejected(f"files cannot be read by path: {'.'.join(names)}")
    if name == "UnresolvedTableValuedFunction":
        function = plan.name().apply(plan.name().size() - 1).lower()
        if plan.name().size() > 1 or function not in TABLE_FUNCTIONS:
            raise Rejected(f"table function not allowed: {function}")
    for e in _items(plan.expressions()) if deep else ():
        _walk_expression(e)
    for group in (plan.children(), plan.subqueries(), plan.innerChildren()):
        for child in _items(group):
            if hasattr(child, "subqueries"):
                try:
                    child.subqueries
                    child.nodeName
                except AttributeError:
                    continue
                if child.getClass().getName().startswith("org.apache.spark.sql.catalyst.plans.logical") or "Unresolved" in child.getClass().getSimpleName():
                    _walk(child, deep)


def _walk_expression(e) -> None:
    kind = e.getClass().getSimpleName()
    if kind == "UnresolvedFunction":
        names = [n.lower() for n in _items(e.nameParts())]
        if names[-1] in FUNCTIONS_DENIED or (len(names) > 1 and names[:-1] not in (["builtin"], ["system", "builtin"])):
            raise Rejected(f"function not allowed: {'.'.join(names)}")
    elif kind == "ExpressionWithUnresolvedIdentifier":
        raise Rejected("names cannot be computed")
    for child in _items(e.children()):
        _walk_expression(child)
