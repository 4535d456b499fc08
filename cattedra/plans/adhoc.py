"""Ad-hoc SQL over a tenant's tables (Q8).

The statement is parsed and the tree the parser made of it is walked, object by object: plan nodes must be of the kinds
that a query is made of, relations must be the given views or a common table expression that is in scope there, and
functions must be built in and not reach outside the rows. What is not known to be harmless is refused. Only
then does the text run, in a session of its own that holds nothing but the views, with named parameter markers (no string
interpolation of values). An error becomes a message, as in the reference.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession

# --- Fixed values: messages shown for an empty result and for an error. ---
NO_DATA = "Nessun dato trovato"
QUERY_ERROR = "Nessun dato trovato o errore nella query"
# --- end of fixed values ---

#: Kinds of plan nodes that a query over views may hold. All others (commands, scripts, writes, paths) are refused.
QUERY_NODES = {
    "Project", "Filter", "UnresolvedHaving", "Aggregate", "Distinct", "Sort", "GlobalLimit", "LocalLimit", "Offset", "Sample",
    "Join", "LateralJoin", "AsOfJoin", "Union", "Intersect", "Except", "Generate", "Expand", "Pivot", "UnresolvedUnpivot",
    "Unpivot", "Window", "WithWindowDefinition", "SubqueryAlias", "UnresolvedSubqueryColumnAliases", "UnresolvedWith",
    "UnresolvedRelation", "UnresolvedInlineTable", "OneRowRelation", "LocalRelation", "UnresolvedTableValuedFunction",
    "UnresolvedTVFAliases", "UnresolvedHint", "PipeOperator",
}
#: Built-in functions that call into the JVM, read files or tell of the machine or its settings.
REACHING = {
    "reflect", "java_method", "try_reflect", "input_file_name", "input_file_block_start", "input_file_block_length",
    "current_user", "user", "session_user", "current_catalog", "current_database", "current_schema", "version",
    "spark_partition_id", "from_avro", "to_avro", "schema_of_avro", "from_protobuf", "to_protobuf",
}
#: Table functions of a query.
TABLE_FUNCTIONS = {"range", "explode", "explode_outer", "posexplode", "posexplode_outer", "inline", "inline_outer", "stack",
                   "json_tuple", "variant_explode", "variant_explode_outer"}
_PLANS, _EXPRESSIONS = "org.apache.spark.sql.catalyst.plans.logical.LogicalPlan", "org.apache.spark.sql.catalyst.expressions.Expression"
_DEEPEST = 400


class Refused(ValueError):
    """The text is not one query over the given views."""


@dataclass
class AdhocResult:
    frame: DataFrame | None
    names: list[str]
    n_columns: int
    message: str = ""


class _Guard:
    """Walks a parsed plan. Every node is a Scala product, and all that it holds is among its elements; so nothing that the
    parser produced is passed over, whatever the kind of node."""

    def __init__(self, session: SparkSession, views: set[str]):
        self.jvm = session._jvm
        self.views = views
        self.builtin = session._jsparkSession.sessionState().functionRegistry()
        self.classes = {name: self.jvm.java.lang.Class.forName(name, False, self.jvm.Thread.currentThread().getContextClassLoader())
                        for name in (_PLANS, _EXPRESSIONS, "scala.collection.Iterable", "scala.Product")}
        self.known: dict[str, str] = {}

    def kind(self, node) -> tuple[str, str]:
        """(simple class name, what sort of object it is)."""
        own = node.getClass()
        name = own.getName()
        if name not in self.known:
            sort = next((s for s, c in self.classes.items() if c.isAssignableFrom(own)), "")
            self.known[name] = "" if name.startswith("org.apache.spark.sql.types.") else sort
        return name.rpartition(".")[2].rstrip("$"), self.known[name]

    def walk(self, node, scope: frozenset[str], depth: int = 0) -> None:
        """``scope``: names of the common table expressions that are visible here."""
        if node is None or not hasattr(node, "getClass"):
            return  # strings and numbers
        if depth > _DEEPEST:
            raise Refused("too deep")
        name, sort = self.kind(node)
        if sort == _PLANS:
            if name not in QUERY_NODES:
                raise Refused(name)
            if name == "UnresolvedWith":
                return self.with_list(node, scope, depth)
            if name == "UnresolvedRelation":
                return self.relation(self.parts(node.multipartIdentifier()), scope)
            if name == "UnresolvedTableValuedFunction" and self.one(self.parts(node.name())) not in TABLE_FUNCTIONS:
                raise Refused("table function")
        elif sort == _EXPRESSIONS:
            if name == "UnresolvedFunction":
                self.function(self.parts(node.nameParts()))
            elif "Identifier" in name or "Reflection" in name or name in ("CallFunction", "PythonUDF", "ScalaUDF"):
                raise Refused(name)
        if sort == "scala.collection.Iterable":
            self.each(node.iterator(), scope, depth)
        elif sort:
            self.each(node.productIterator(), scope, depth)

    def each(self, elements, scope: frozenset[str], depth: int) -> None:
        while elements.hasNext():
            self.walk(elements.next(), scope, depth + 1)

    def with_list(self, node, scope: frozenset[str], depth: int) -> None:
        """A definition sees those before it (itself too if recursive); the body sees all."""
        recursive, seen = bool(node.allowRecursion()), scope
        definitions = node.cteRelations().iterator()
        while definitions.hasNext():
            definition = definitions.next()
            name = definition._1().lower()
            self.walk(definition._2(), seen | {name} if recursive else seen, depth + 1)
            seen = seen | {name}
        self.walk(node.child(), seen, depth + 1)

    @staticmethod
    def parts(sequence) -> list[str]:
        out, each = [], sequence.iterator()
        while each.hasNext():
            out.append(each.next().lower())
        return out

    @staticmethod
    def one(parts: list[str]) -> str:
        """The name, if it is no qualified one."""
        return parts[0] if len(parts) == 1 else ""

    def relation(self, parts: list[str], scope: frozenset[str]) -> None:
        if self.one(parts) not in self.views | scope:
            raise Refused(".".join(parts))

    def function(self, parts: list[str]) -> None:
        name = self.one(parts)
        if not name or name in REACHING or not self.builtin.functionExists(
                self.jvm.org.apache.spark.sql.catalyst.FunctionIdentifier(name)):
            raise Refused(".".join(parts))


def own_session(spark: SparkSession, views: dict[str, DataFrame]) -> SparkSession:
    """A session with the settings of ``spark`` that holds the views and no other temporary view, variable or function."""
    session = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if key.startswith("spark.sql.") and session.conf.isModifiable(key):
            session.conf.set(key, value)
    rows = session._jvm.org.apache.spark.sql.classic.Dataset
    for name, df in views.items():
        rows.ofRows(session._jsparkSession, df._jdf.queryExecution().analyzed()).createOrReplaceTempView(name)
    return session


def check(session: SparkSession, query: str, views: set[str]) -> None:
    """Raise ``Refused`` unless ``query`` is one query over ``views``. Nothing runs."""
    plan = session._jsparkSession.sessionState().sqlParser().parsePlan(query)
    _Guard(session, {v.lower() for v in views}).walk(plan, frozenset())


def run_sql(spark: SparkSession, text: str, views: dict[str, DataFrame],
            args: dict[str, Any] | None = None) -> AdhocResult:
    """Run one query over ``views``. The caller's session and its own views are left as they are."""
    query = text.strip().rstrip(";")
    try:
        session = own_session(spark, views)
        check(session, query, set(views))
        frame = session.sql(query, args=args or {})
    except Exception:  # noqa: BLE001 - the reference turns every error into a message
        return AdhocResult(None, [], 0, QUERY_ERROR)
    return AdhocResult(frame, frame.columns, len(frame.columns))


def run_sql_checked(spark: SparkSession, text: str, views: dict[str, DataFrame],
                    args: dict[str, Any] | None = None) -> AdhocResult:
    """``run_sql`` plus the empty-result message (one LIMIT-1 probe)."""
    res = run_sql(spark, text, views, args)
    if res.frame is not None and res.frame.isEmpty():
        res.message = NO_DATA
    return res
