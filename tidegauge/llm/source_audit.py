"""How far the sources of a language differ in their words: pairs of sources, and words over the language's rate.

A term is kept in a language if at least ``MIN_DOCS`` of its documents have it; V terms are kept.
Rates are integers, ``1 + floor(SCALE * (count + PRIOR) / (total + PRIOR * V))``. The distance of two
sources is the sum over all kept terms of the absolute difference of their rates, found without ever
visiting a term that neither has: each pair starts at V times the difference of the rates of a zero
count, and the term postings add corrections. A posting against a source that lacks the term corrects
by an amount that depends on its count alone, so those are added once a count, times the terms
with it; two postings of one term correct what is left.

The corpus is read once: words are split and counted by language, source and term with partial
sums before the one shuffle, and what follows works on counts. The languages, few and large, are no
partitioning key anywhere: rows of a language are dealt over ``DEALS`` keys.

Defined cases: null text, language or source is the empty string; a source without kept terms has the rates of
zero counts; a language without kept terms has pairs of value 0 and no terms; repeated rows are
documents of their own; an empty table gives an empty result. Ties go by the item's bytes. Rates are exact for totals below 10^18
words. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, text_or_empty

MIN_DOCS = 30
TOP = 50
PRIOR = 5
SCALE = 1_000_000_000
#: Keys that the rows of one language are dealt over.
DEALS = 64
NOT_TERMS = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"


def terms(text: Column) -> Column:
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_remove(F.split(lower, NOT_TERMS), "")


def term_counts(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """lang, source, term, n, lang_n: occurrences of kept terms in the source and in its language.

    A document's terms are emitted twice, all of them for ``n`` and the distinct ones for the documents,
    so that both are counted by one aggregation.
    """
    found = docs.select(text_or_empty("lang").alias("lang"), text_or_empty("source").alias("source"), terms(text_or_empty("text")).alias("terms"))
    every = F.struct(F.lit(False).alias("first"), "terms")
    distinct = F.struct(F.lit(True).alias("first"), F.array_distinct("terms").alias("terms"))
    counted = (
        found.select("lang", "source", F.explode(F.array(every, distinct)).alias("b"))
        .select("lang", "source", "b.first", F.explode("b.terms").alias("term"))
        .groupBy("lang", "source", "term")
        .agg(F.count_if(~F.col("first")).alias("n"), F.count_if("first").alias("docs"))
    )
    everywhere = Window.partitionBy("lang", "term")
    return (
        counted.withColumn("lang_n", F.sum("n").over(everywhere))
        .withColumn("lang_docs", F.sum("docs").over(everywhere))
        .where(F.col("lang_docs") >= min_docs)
        .select("lang", "source", "term", "n", "lang_n")
    )


def rate(n: str | Column, total: str | Column, v: str | Column) -> Column:
    """1 + floor(SCALE * (n + PRIOR) / (total + PRIOR * v)), in decimals of full width; 1 where nothing is counted."""
    n, total, v = (F.col(x) if isinstance(x, str) else x for x in (n, total, v))
    above = (n + PRIOR).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    below = F.nullif((total + PRIOR * v).cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)"))
    return F.coalesce(F.call_function("div", above, below), F.lit(0)) + 1


def _deal(*columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(DEALS))


def source_rates(docs: DataFrame, counts: DataFrame) -> DataFrame:
    """lang, source, total, v, zero (its rate of a zero count): a row for every occurring pair."""
    groups = docs.select(text_or_empty("lang").alias("lang"), text_or_empty("source").alias("source")).distinct()
    kept = counts.select("lang", "term", "lang_n").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("lang_n").alias("lang_total"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    zero = F.lit(0).cast("long")
    return (
        groups.join(totals, ["lang", "source"], "left")
        .join(kept, "lang", "left")
        .select("lang", "source", *[F.coalesce(c, zero).alias(c) for c in ("total", "v", "lang_total")])
        .withColumn("zero", rate(zero, "total", "v"))
    )


def pair_distances(rates: DataFrame, postings: DataFrame) -> DataFrame:
    """lang, a, b, value for every two sources a < b of a language; postings are lang, source, term, n, p, zero."""
    dealt = rates.select("lang", F.col("source").alias("b"), F.col("zero").alias("zero_b"), F.explode(F.sequence(F.lit(0), F.lit(DEALS - 1))).alias("deal"))

    def against_all(rows: DataFrame, *by: str) -> DataFrame:
        return rows.withColumn("deal", _deal(*by)).join(dealt, ["lang", "deal"]).where("source <> b")

    apart = lambda x, y: F.abs(F.col(x) - F.col(y))
    a, b = F.least("source", "b").alias("a"), F.greatest("source", "b").alias("b")
    base = against_all(rates, "source").where("source < b").select("lang", a, b, (F.col("v") * apart("zero", "zero_b")).alias("value"))
    alike = postings.groupBy("lang", "source", "zero", "n", "p").agg(F.count(F.lit(1)).alias("terms"))
    one = against_all(alike, "source", "n").select("lang", a, b, (F.col("terms") * (apart("p", "zero_b") - apart("zero", "zero_b"))).alias("value"))
    other = postings.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("p_b"), F.col("zero").alias("zero_b"))
    two = apart("p", "p_b") - apart("p", "zero_b") - apart("zero", "p_b") + apart("zero", "zero_b")
    met = postings.join(other, ["lang", "term"]).where("source < b").select("lang", a, b, two.alias("value"))
    return base.unionByName(one).unionByName(met).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank."""
    counts = durable(term_counts(docs, min_docs))
    rates = durable(source_rates(docs, counts))
    postings = durable(
        counts.join(rates, ["lang", "source"]).select(
            "lang", "source", "term", "n", "zero", rate("n", "total", "v").alias("p"), rate("lang_n", "lang_total", "v").alias("q")
        )
    )
    pairs = durable(pair_distances(rates, postings))
    both = pairs.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").unionByName(
        pairs.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value")
    )
    over = postings.where("n > 0 and p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = both.withColumn("rank", F.row_number().over(order)).select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank")
    heads = over.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.unionByName(heads.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))
