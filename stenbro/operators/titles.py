"""Titles looked up in a catalogue (override, exact, inverted index), and candidates folded into entities."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stenbro.functions import text as X
from stenbro.operators import relational as R

RATIO, COVERAGE = 0.98, 0.75


def named(register: DataFrame) -> DataFrame:
    """(code, n, main) of every name and alias of a title register."""
    names = F.array(*[F.struct(F.col(c).alias("n"), F.lit(k == 0).alias("main")) for k, c in enumerate(("StillingsBetegnelseNavn", "Alias1", "Alias2"))])
    return register.select(F.col("StillingsBetegnelseKode").alias("code"), F.inline(names)).where("n is not null")


def fuzzy(values: DataFrame, names: DataFrame, tokens: Callable[[Column], Column]) -> DataFrame:
    """(v, code) of the distinct `values` (v) whose words mean one title: the index of words gives each title a sum, the
    best one must hold RATIO of the three best sums, and the value must have COVERAGE of the words of its name."""
    index = names.select("code", F.explode(tokens(F.col("n"))).alias("t")).distinct()
    own = names.where("main").select("code", F.explode(tokens(F.col("n"))).alias("t")).distinct()
    said = values.select("v", F.explode(tokens(F.col("v"))).alias("t"))
    sums = said.join(index, "t").groupBy("v", "code").agg(F.count("*").alias("n"))
    best = R.top_per(sums, ["v"], [F.desc("n"), F.col("code")], 3).groupBy("v").agg(F.max_by("code", -F.col("pos")).alias("code"), (F.max("n") / F.sum("n")).alias("ratio"))
    sizes = own.groupBy("code").agg(F.count("*").alias("size"))
    kept = best.where(F.col("ratio") >= RATIO).select("v", "code").join(sizes, "code")
    covered = kept.join(own, "code").join(said.distinct(), ["v", "t"]).groupBy("v", "code").agg((F.count("*") / F.first("size")).alias("covered"))
    return covered.where(F.col("covered") >= COVERAGE).select("v", "code")


def looked_up(values: DataFrame, names: DataFrame, tokens: Callable[[Column], Column], overrides: dict[str, str]) -> DataFrame:
    """(v, how, code) of the distinct `values` (v): overridden by label, else equal to a name or alias, else `fuzzy`.

    An override whose label is no title has the code 'custom'; of titles with the same name the last code counts.
    """
    exact = names.where("n <> ''").groupBy(X.title_key(F.col("n")).alias("key")).agg(F.max("code").alias("exact"))
    label = X.labelled(F.col("key"), overrides, "")
    keyed = values.withColumn("key", X.title_key(F.col("v"))).withColumn("label", F.nullif(label, F.lit("")))
    forced = exact.select(F.col("key").alias("label_key"), F.col("exact").alias("forced"))
    found = keyed.join(exact, "key", "left").withColumn("label_key", X.title_key(F.col("label"))).join(forced, "label_key", "left").join(fuzzy(values, names, tokens), "v", "left")
    how = F.when(F.col("label").isNotNull(), "override").when(F.col("exact").isNotNull(), "exact").when(F.col("code").isNotNull(), "fuzzy")
    code = F.when(F.col("label").isNotNull(), F.coalesce("forced", F.lit("custom"))).otherwise(F.coalesce("exact", "code"))
    return found.select("v", how.alias("how"), code.alias("code")).where("how is not null")


def entities(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Candidates of a key as one: first name and title, all e-mails and phones, least distance, hints of which later ones win."""
    o = F.col(order)
    one = R.folded(df, keys, {"name": F.col("name"), "title": F.col("title")}, ["emails", "phones"], ["dom_distance"], o)
    last = df.select(*keys, o.alias("_o"), F.explode("hints").alias("_k", "_v")).groupBy(*keys, "_k").agg(F.max_by("_v", "_o").alias("_v"))
    hints = last.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list(F.concat("_k", F.lit("="), "_v"))), "; ").alias("hints"))
    joined = one.join(hints, keys, "left")
    return joined.select(*keys, "name", "title", "dom_distance", *[F.coalesce(F.array_join(c, "; "), F.lit("")).alias(c) for c in ("emails", "phones")], F.coalesce("hints", F.lit("")).alias("hints"))
