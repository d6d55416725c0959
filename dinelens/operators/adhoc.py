"""Guarded ad-hoc SQL and the canned questions.

The reference lets a language model write SQL and runs it after a guard.
Only the guard and the run are kept. The guard walks the tree that Spark's
parser makes of the text, node by node and field by field, nested queries and
named ones included: the statement must be one query (no command can be one),
read only the views offered to it, and call only functions on a list. After
analysis it walks the optimised plan: what the query would read is bounded, and
so are joins without an equality, which grow with the product of their sides.
Then it runs as one ``spark.sql`` statement, lazily.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dinelens.functions.metrics import ratio
from dinelens.functions.places import real_city
from dinelens.operators.revenue import cities_ranked, in_city, kpis_by_scope

# Plan nodes a query can have at its top, functions that a query
# may call, and table functions that only make rows.
QUERY_NODES = frozenset(
    "Project Aggregate Filter Sort GlobalLimit LocalLimit Offset Distinct Union Except Intersect SubqueryAlias "
    "UnresolvedWith UnresolvedHaving WithWindowDefinition UnresolvedSubqueryColumnAliases Join OneRowRelation "
    "UnresolvedOrderBy UnresolvedRelation".split()
)
FUNCTIONS = frozenset(
    "abs add_months any any_value approx_count_distinct array array_agg array_contains array_distinct array_join array_size array_sort avg "
    "bool_and bool_or bround cardinality ceil ceiling char_length character_length coalesce collect_list collect_set concat concat_ws contains "
    "corr count count_if covar_pop covar_samp cume_dist current_date current_timestamp date date_add date_diff date_format date_part date_sub "
    "date_trunc datediff day dayofmonth dayofweek dayofyear dense_rank double element_at endswith every exists exp explode extract filter first "
    "first_value float floor format_number greatest hour if ifnull in initcap instr int isnan isnotnull isnull kurtosis lag last last_day "
    "last_value lcase lead least left len length like ilike ln locate log log10 log2 lower lpad ltrim max max_by mean median min min_by minute "
    "mod mode month months_between named_struct next_day nth_value ntile nullif nullifzero nvl nvl2 percent_rank percentile percentile_approx "
    "pmod position posexplode pow power quarter rank regexp_count regexp_extract regexp_like regexp_replace regr_slope replace reverse right "
    "rlike round row_number rpad rtrim second sign size skewness slice some sort_array split split_part sqrt startswith std stddev stddev_pop "
    "stddev_samp string struct substr substring sum to_date to_timestamp transform trim trunc try_add try_cast try_divide try_subtract try_sum "
    "try_to_number ucase unix_timestamp upper var_pop var_samp variance weekofyear when width_bucket year zeroifnull + - * / % || not and or".split()
)
TABLE_FUNCTIONS = frozenset("explode explode_outer posexplode posexplode_outer inline inline_outer stack range".split())

MAX_BYTES = 1 << 40  # estimated bytes of all tables that a query reads
MAX_PRODUCT_ROWS = 1000  # rows of one side of a join without an equality, by proof
MAX_NODES = 20_000  # fields of a parsed statement that the guard is ready to walk


def _fields(node: JavaObject, name: str) -> Iterator[object]:
    """The members of a case class or collection of class ``name``; nothing for other objects."""
    if name.startswith("scala.collection."):
        it = node.iterator()
    elif name.startswith(("org.apache.spark.sql.catalyst.", "scala.")) and _jvm(node).java.lang.Class.forName("scala.Product").isInstance(node):
        it = node.productIterator()
    else:
        return
    while it.hasNext():
        yield it.next()


def _jvm(node: JavaObject):
    return SparkSession.active().sparkContext._jvm


def walk(plan: JavaObject) -> Iterator[tuple[str, JavaObject]]:
    """``(class name, object)`` of every object that a plan is made of, itself first."""
    stack: list[object] = [plan]
    seen = 0
    while stack:
        node = stack.pop()
        if not isinstance(node, JavaObject):
            continue
        seen += 1
        if seen > MAX_NODES:
            raise ValueError("the statement is too large")
        name = node.getClass().getName()
        yield name.rpartition(".")[2], node
        stack.extend(_fields(node, name))


def _parts(names: JavaObject) -> list[str]:
    it, out = names.iterator(), []
    while it.hasNext():
        out.append(it.next())
    return out


def refusal(spark: SparkSession, sql: str, views: Iterable[str]) -> str | None:
    """Why ``sql`` may not run over ``views``; None if it may.

    The text is parsed and never analysed or run here.
    """
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as exc:
        return f"no SQL statement: {str(exc).splitlines()[0]}"
    top = plan.getClass().getSimpleName()
    if top not in QUERY_NODES:
        return f"not a query: {top}"
    allowed, relations = {v.lower() for v in views}, []
    try:
        for kind, node in walk(plan):
            if kind == "UnresolvedWith":
                for pair in _parts(node.cteRelations()):
                    allowed.add(pair.productElement(0).lower())
            elif kind == "UnresolvedRelation":
                relations.append(".".join(_parts(node.multipartIdentifier())))
            elif kind == "UnresolvedTableValuedFunction":
                name = ".".join(_parts(node.name()))
                if name.lower() not in TABLE_FUNCTIONS:
                    return f"table function not allowed: {name}"
            elif kind == "UnresolvedFunction":
                name = ".".join(_parts(node.nameParts()))
                if name.lower() not in FUNCTIONS:
                    return f"function not allowed: {name}"
            elif kind == "UnresolvedGenerator":
                name = node.name().funcName()
                if name.lower() not in TABLE_FUNCTIONS:
                    return f"table function not allowed: {name}"
            elif kind in ("ScriptTransformation", "InsertIntoStatement", "UnresolvedInlineTable", "UnresolvedTableOrView", "UnresolvedIdentifier") or kind.endswith("Command"):
                return f"not allowed in a query: {kind}"
    except ValueError as exc:
        return str(exc)
    unknown = [r for r in relations if r.lower() not in allowed]
    return f"unknown table: {unknown[0]}" if unknown else None


def _number(option: JavaObject) -> float:
    return float("inf") if option.isEmpty() else float(str(option.get()))


def _has_equality(condition: JavaObject) -> bool:
    """Whether one of the terms of an AND is an equality between columns of the two sides."""
    kind = condition.getClass().getSimpleName()
    if kind == "And":
        return _has_equality(condition.left()) or _has_equality(condition.right())
    return kind in ("EqualTo", "EqualNullSafe")


def cost_refusal(frame: DataFrame, max_bytes: int = MAX_BYTES, max_product_rows: int = MAX_PRODUCT_ROWS) -> str | None:
    """Why an analysed query may not run: it would read too much, or join everything with everything."""
    plan = frame._jdf.queryExecution().optimizedPlan()
    stack, total = [plan], 0
    while stack:
        node = stack.pop()
        children = _parts(node.children()) + _parts(node.subqueries())
        stack.extend(children)
        if not children:
            total += int(str(node.stats().sizeInBytes()))
        if node.getClass().getSimpleName() == "Join":
            condition = node.condition()
            if condition.isEmpty() or not _has_equality(condition.get()):
                small = min(_number(node.left().maxRows()), _number(node.right().maxRows()))
                if small > max_product_rows:
                    return "a join without an equality"
    return f"it reads about {total} bytes, more than {max_bytes}" if total > max_bytes else None


@dataclass
class GuardedResult:
    sql: str
    ok: bool
    frame: DataFrame | None = None
    error: str | None = None
    columns: list[str] = field(default_factory=list)

    def fetch(self, max_rows: int = 1000) -> tuple[list[tuple], bool]:
        """Rows for display, at most ``max_rows``, and whether more exist.

        Only ``max_rows + 1`` rows ever reach the driver, whatever the
        statement returns (``frame`` stays whole); errors at run time are reported, not raised.
        """
        if not self.ok or self.frame is None:
            return [], False
        try:
            rows = [tuple(r) for r in self.frame.limit(max_rows + 1).collect()]
        except Exception as exc:  # run-time errors (casts, division, ...)
            self.ok, self.error = False, str(exc).splitlines()[0]
            return [], False
        return rows[:max_rows], len(rows) > max_rows


def guarded_sql(spark: SparkSession, sql: str, views: dict[str, DataFrame] | None = None, max_bytes: int = MAX_BYTES) -> GuardedResult:
    """G1: refuse unsafe text; otherwise analyse it over ``views`` (temp
    views), refuse what costs too much, and return the lazy result. Errors are
    reported, not raised."""
    text = sql.strip().rstrip(";")
    why = refusal(spark, text, views or {})
    if why:
        return GuardedResult(sql, False, error=f"refused: {why}")
    for name, df in (views or {}).items():
        df.createOrReplaceTempView(name)
    try:
        frame = spark.sql(text)
    except Exception as exc:  # analysis errors: unknown table, bad syntax
        return GuardedResult(sql, False, error=str(exc).splitlines()[0])
    why = cost_refusal(frame, max_bytes)
    if why:
        return GuardedResult(sql, False, error=f"refused: {why}")
    return GuardedResult(sql, True, frame=frame, columns=frame.columns)


def ask_city_totals(mart: DataFrame, restaurants: DataFrame, city: str) -> DataFrame:
    """Total revenue and orders in one real city."""
    return kpis_by_scope(mart, restaurants, city).select("total_revenue", "total_orders")


def ask_top_rated_cities(restaurants: DataFrame, k: int = 3) -> DataFrame:
    """Real cities by mean rating (rounded to 2), ties by name."""
    return (
        restaurants.filter(real_city("city").isNotNull())
        .groupBy(real_city("city").alias("city"))
        .agg(F.round(F.avg("rating"), 2).alias("avg_rating"))
        .orderBy(F.col("avg_rating").desc_nulls_last(), F.col("city").asc_nulls_last())
        .limit(k)
    )


def ask_top_cities(mart: DataFrame, k: int = 5) -> DataFrame:
    """Top k real cities by revenue."""
    return cities_ranked(mart).limit(k)


def ask_restaurant_count(restaurants: DataFrame) -> DataFrame:
    """Number of restaurants."""
    return restaurants.agg(F.count(F.lit(1)).alias("total_restaurants"))


def ask_avg_order_value(mart: DataFrame, city: str | None = None) -> DataFrame:
    """Revenue per order over the mart, rounded to 2."""
    return in_city(mart, city).agg(
        F.round(ratio(F.sum("total_revenue"), F.sum("total_orders")), 2).alias("avg_order_value")
    )
