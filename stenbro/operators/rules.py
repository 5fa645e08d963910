"""A declarative rule language compiled to columns: no join, no Python, one pass for any number of rules."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Spellings of an operator -> its name; fixed.
SYNONYMS = {
    "boolean_true": "bool_true", "true": "bool_true",
    "<=": "lte", "le": "lte", "less_than_or_equal": "lte", ">=": "gte", "ge": "gte", "greater_than_or_equal": "gte",
    "<": "lt", "less_than": "lt", ">": "gt", "greater_than": "gt", "==": "equals", "eq": "equals", "=": "equals",
    "between": "range", "exists": "present", "in": "one_of", "matches": "regex",
}


def operator_name(name: str) -> str:
    """The name of an operator in any of its spellings."""
    key = name.strip().lower()
    return SYNONYMS.get(key, key)


def bounds(rule: dict) -> dict:
    """A rule's arguments with its threshold under the name that its operator reads: min, max or equals."""
    args = {k: rule[k] for k in ("min", "max", "equals", "threshold") if rule.get(k) is not None}
    name = {"gt": "min", "gte": "min", "lt": "max", "lte": "max", "equals": "equals"}.get(operator_name(rule["type"]))
    if name and "threshold" in args:
        args.setdefault(name, args["threshold"])
    return args


def _number(c: Column) -> Column:
    return c.try_cast("double")


def _pattern_holds(pattern: str) -> bool:
    """Whether the engine's regex language knows the pattern."""
    spark = SparkSession.active()
    try:
        spark._jvm.java.util.regex.Pattern.compile(pattern)
    except Exception:  # noqa: BLE001  (a syntax error of the pattern, raised through the gateway)
        return False
    return True


def predicate(c: Column, kind: str, listed: bool = False, **args) -> Column:
    """The predicate of one rule; NULL values fail it (but for an open range). `listed`: the value is a list.

    A pattern that isn't one fails every value.
    """
    kind, number = operator_name(kind), _number(c)
    text = c.cast("string")
    made = {
        "bool_true": lambda: F.lower(F.trim(text)).isin("true", "1", "yes", "1.0"),
        "equals": lambda: c == F.lit(args["threshold"]),
        "gt": lambda: number > args["threshold"],
        "gte": lambda: number >= args["threshold"],
        "lt": lambda: number < args["threshold"],
        "lte": lambda: number <= args["threshold"],
        "range": lambda: reduce(
            lambda a, b: a & b,
            [number >= lo for lo in [args.get("min")] if lo is not None] + [number <= hi for hi in [args.get("max")] if hi is not None] or [F.lit(True)],
        ),
        "present": lambda: c.isNotNull() & (F.coalesce(text, F.lit("")) != ""),
        "true_if_present": lambda: c.isNotNull(),
        "contains": lambda: F.array_contains(c, args["threshold"]) if listed else F.contains(F.lower(text), F.lit(str(args["threshold"]).lower())),
        "one_of": lambda: c.isin(*args["threshold"]),
        "regex": lambda: text.rlike("(?i)" + args["threshold"]) if _pattern_holds(args["threshold"]) else F.lit(False),
    }
    if kind not in made:
        raise ValueError(f"unknown rule type {kind!r}")
    return F.coalesce(made[kind](), F.lit(False))


def outcome(c: Column, rule: dict, listed: bool = False) -> tuple[Column, Column]:
    """(points, passed) of a rule: its first level that holds counts, and passes even with 0 points.

    A level without a type has its rule's; a rule without levels is one level.
    """
    levels = rule.get("levels") or [rule]
    tests = [predicate(c, level.get("type") or rule["type"], listed, **{k: level.get(k) for k in ("threshold", "min", "max")}) for level in levels]
    chosen = None
    for holds, level in zip(tests, levels, strict=True):
        chosen = F.when(holds, level["points"]) if chosen is None else chosen.when(holds, level["points"])
    return chosen.otherwise(0), reduce(lambda a, b: a | b, tests)


def points(c: Column, rule: dict) -> Column:
    """Points of a rule."""
    return outcome(c, rule)[0]


def scored(fields: dict[str, Column], book: list[dict]) -> dict[str, Column]:
    """Points of every rule of a book by rule name; `data_key` names the field."""
    return {rule["rule"]: points(fields[rule["data_key"]], rule) for rule in book}


def located(schema: T.StructType, section: str, key: str) -> list[str]:
    """The paths that a rule's key may mean, in the order in which they count: the dotted path itself; else the key in
    its own section, then the first section of the document that has it, then the top level."""
    if "." in key:
        return [key]
    sections = [f for f in schema.fields if isinstance(f.dataType, T.StructType)]
    own = [f"{section}.{key}" for f in sections if f.name == section and key in f.dataType.names]
    other = [f"{f.name}.{key}" for f in sections if key in f.dataType.names][:1]
    return [*own, *(p for p in other if p not in own), *([key] if key in schema.names and not own and not other else [])]


def looked_up(schema: T.StructType, section: str, key: str) -> Column:
    """The value that a rule's key means in a document; NULL where no section has the key."""
    paths = located(schema, section, key)
    return F.coalesce(*map(F.col, paths)) if paths else F.lit(None)


#: Functions that rules may call by name: payload of columns -> points.
FUNCTIONS: dict[str, Callable[[dict[str, Column]], Column]] = {}


def function(name: str):
    """Register a scoring function."""

    def add(f):
        FUNCTIONS[name] = f
        return f

    return add


def called(schema: T.StructType, section: str, rule: dict) -> tuple[Column, Column]:
    """(points, passed) of a rule that calls a function: payload by its key aliases, or its one key as `value`.

    A name that nobody registered gives 0 points; passed are points above 0.
    """
    keys = rule.get("data_keys") or {"value": rule["data_key"]}
    made = FUNCTIONS.get(rule["function_name"])
    got = made({alias: looked_up(schema, section, key) for alias, key in keys.items()}) if made else F.lit(0)
    got = F.coalesce(got.cast("int"), F.lit(0))
    return got, got > 0


def evaluated(df: DataFrame, key: str, book: list[dict]) -> DataFrame:
    """(key, ordinal, section, rule, points, status) of every rule of a book for every document.

    status: 'not_evaluated' where the value of a rule that calls no function is missing, else 'achieved' or 'failed'.
    """
    rows = []
    for k, rule in enumerate(book):
        if rule.get("function_name"):
            got, passed = called(df.schema, rule["section"], rule)
            status = F.when(passed, "achieved").otherwise("failed")
        else:
            value = looked_up(df.schema, rule["section"], rule["data_key"])
            got, passed = outcome(value, rule)
            status = F.when(value.isNull(), "not_evaluated").when(passed, "achieved").otherwise("failed")
            got = F.when(value.isNotNull(), got).otherwise(0)
        rows.append(F.struct(F.lit(k).alias("ordinal"), F.lit(rule["section"]).alias("section"), F.lit(rule["rule"]).alias("rule"), got.cast("int").alias("points"), status.alias("status")))
    return df.select(key, F.inline(F.array(*rows)))


def rolled_up(results: DataFrame, key: str, most: int) -> DataFrame:
    """(key, total, percent, achieved) from `evaluated`: percent rounded half to even, achieved rules by points, then book order."""
    done = F.when(F.col("status") == "achieved", F.struct((-F.col("points")).alias("p"), "ordinal", "rule"))
    whole = results.groupBy(key).agg(F.sum("points").alias("total"), F.array_sort(F.collect_list(done)).alias("a"))
    return whole.select(key, "total", F.bround(F.col("total") * 100.0 / most, 0).cast("bigint").alias("percent"), F.transform("a", lambda x: x["rule"]).alias("achieved"))
