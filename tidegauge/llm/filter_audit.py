"""How filters interact: what each removes, alone and after others, in every order.

Each document gets a mask with one bit a filter that it fails. Four filters look at the text alone;
the last one fails a text that a document of smaller id also has. Those duplicates are found by
partition refinement: texts are split by their length in code points, then by the hash of one block
after the other (``BLOCK`` code points, each next one twice as long, so that a text of n has about
log n), and a class of one document leaves after every split. Texts of the classes that survive all
blocks are compared in full, and every document whose id is not the least of its text is marked.
Hashes only find candidates: equal hashes of different texts do no harm.

Only slim rows (id, class, block hashes) take part in the refinement. Texts move once, those of
surviving classes only, found by a Bloom filter of the classes; equal texts meet as one row a task.
Counting is by part and mask: at most 2 to the number of filters rows a part, from which all orders
follow without going back to the documents.

Defined cases: a null text is empty, a null part is the empty string; a null id comes after all
other ids and is no copy of another null id, nor are rows of the same id and text of each other;
labels that repeat an id count as 1 where any of them says 1, a null label as 0; an empty table
gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import exact_dedup
from .common import durable, text_or_empty

#: Code points of the first block; each further block is twice as long.
BLOCK = 256
DUPLICATE = "E"


def words(text: Column) -> Column:
    """Written without a lambda, so that Spark splits a text once for all filters."""
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def _long(n: Column) -> Column:
    """A hundred times a count of a very long text is no int."""
    return n.cast("long")


def few_words(text: Column) -> Column:
    return F.size(words(text)) < 50


def few_distinct(text: Column) -> Column:
    found = words(text)
    return 100 * _long(F.size(F.array_distinct(found))) < 65 * _long(F.size(found))


def many_capitals(text: Column) -> Column:
    """Over a twentieth of the code points are A to Z."""
    return 100 * _long(F.regexp_count(text, F.lit("[A-Z]"))) > 5 * _long(F.length(text))


def has_symbols(text: Column) -> Column:
    return text.rlike(r"[#$%&*|]")


#: Failure conditions on the text, by letter; ``DUPLICATE`` comes after them.
FILTERS: dict[str, Callable[[Column], Column]] = {"A": few_words, "B": few_distinct, "C": many_capitals, "D": has_symbols}


def _blocks(text: Column) -> Column:
    """The hashes of a text's blocks, all of them, as far as it goes."""
    n = F.greatest(F.lit(1), F.ceil(F.log2(F.length(text) / BLOCK + 1))).cast("int")

    def one(k: Column) -> Column:
        start = (F.pow(F.lit(2), k) - 1).cast("int") * BLOCK + 1
        return F.xxhash64(F.substr(text, start, F.pow(F.lit(2), k).cast("int") * BLOCK))

    return F.transform(F.sequence(F.lit(0), n - 1), one)


def _chain(length: Column, hashes: Column) -> Column:
    """The class of a text after all its blocks, as ``surviving_classes`` reaches it step by step."""
    return F.aggregate(hashes, F.xxhash64(length), _refined)


def _refined(before: Column, block: Column) -> Column:
    return F.xxhash64(before, block)


def surviving_classes(rows: DataFrame) -> DataFrame:
    """The classes of two documents or more that no block splits: (class).

    ``rows`` are lengths ``n`` and hashes ``blocks``, refined in rounds; a round takes the next block
    of the documents that are left. There are about log n rounds for the longest text that repeats.
    """
    left = durable(_without_singles(rows.select(F.xxhash64("n").alias("class"), "blocks")))
    done, k = [], 0
    while True:
        done.append(left.where(F.size("blocks") <= k).select("class").distinct())
        going = left.where(F.size("blocks") > k)
        if going.isEmpty():
            break
        left = durable(_without_singles(going.withColumn("class", _refined(F.col("class"), F.get("blocks", F.lit(k))))))
        k += 1
    return durable(reduce(DataFrame.unionByName, done).distinct())


def _without_singles(rows: DataFrame) -> DataFrame:
    """Rows whose class has another row; counts are made before anything meets, and hot classes can be split in the join."""
    several = durable(rows.groupBy("class").count().where("count > 1").select("class"))
    return rows.join(several, "class", "left_semi")


def marked(rows: DataFrame, bits: Column) -> DataFrame:
    """id, part, bits and ``repeats`` (a smaller id has the same text) of rows of id, part and text."""
    n, blocks = F.length("text"), _blocks(F.col("text"))
    slim = durable(rows.select("id", "part", bits.alias("bits"), n.alias("n"), blocks.alias("blocks")).withColumn("class", _chain(F.col("n"), F.col("blocks"))))
    classes = surviving_classes(slim).withColumn("key", F.hex("class"))
    keyed = rows.withColumn("class", _chain(n, blocks)).withColumn("key", F.hex("class"))
    texts = durable(exact_dedup.only_known(keyed, "key", classes, "key").drop("key"))
    firsts = durable(texts.groupBy("class", "text").agg(F.min("id").alias("first")))
    by_class = durable(firsts.groupBy("class").agg(F.count(F.lit(1)).alias("texts"), F.min("first").alias("first")))
    met = slim.select("id", "part", "bits", "class").join(by_class, "class", "left").where("texts is null or texts = 1")
    # classes that hold different texts in spite of all hashes are decided text by text
    mixed = texts.join(by_class.where("texts > 1").select("class"), "class", "left_semi").join(firsts, ["class", "text"])
    both = met.select("id", "part", "bits", "first").unionByName(mixed.select("id", "part", bits.alias("bits"), "first"))
    smaller = F.coalesce(F.col("id") > F.col("first"), F.col("id").isNull() & F.col("first").isNotNull())
    return both.select("id", "part", "bits", smaller.alias("repeats"))


def mask_counts(docs: DataFrame, labels: DataFrame, filters: dict[str, Callable[[Column], Column]] = FILTERS, part_col: str = "source") -> DataFrame:
    """part, mask, n, good, toxic: the documents of a part that fail the filters of a mask.

    The bits are those of ``filters`` in order, then that of ``DUPLICATE``. ``docs`` has doc_id and text.
    """
    rows = docs.select(F.col("doc_id").alias("id"), text_or_empty(part_col).alias("part"), text_or_empty("text").alias("text"))
    bits = reduce(Column.__add__, (fails(F.col("text")).cast("int") * (1 << k) for k, fails in enumerate(filters.values())))
    mask = F.col("bits") + F.col("repeats").cast("int") * (1 << len(filters))
    says = [F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0))).alias(c) for c in ("quality", "toxic")]
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(*says)
    return (
        marked(rows, bits)
        .join(known, "id", "left")
        .groupBy("part", mask.alias("mask"))
        .agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.coalesce(c, F.lit(0))).alias(k) for k, c in (("good", "quality"), ("toxic", "toxic"))])
    )


def audit(docs: DataFrame, labels: DataFrame, filters: dict[str, Callable[[Column], Column]] = FILTERS, part_col: str = "source") -> DataFrame:
    """A row per part, order of the filters and step: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    letters = [*filters, DUPLICATE]
    bit = {x: 1 << k for k, x in enumerate(letters)}
    steps = [
        ("".join(order), k + 1, bit[x], sum(bit[y] for y in order[:k]))
        for order in permutations(letters)
        for k, x in enumerate(order)
    ]
    plan = F.from_json(
        F.lit("[" + ",".join(f'{{"filter_order":"{o}","step":{k},"bit":{b},"prior":{p}}}' for o, k, b, p in steps) + "]"),
        "array<struct<filter_order:string,step:int,bit:int,prior:int>>",
    )
    by_part = mask_counts(docs, labels, filters, part_col).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))
    orders = F.lit(len(steps) // len(letters))
    fails = lambda m, bits: m["mask"].bitwiseAND(bits) != 0
    failing, prior = F.col("s.bit"), F.col("s.prior")

    def total(value: Callable[[Column], Column], when: Callable[[Column], Column]) -> Column:
        return F.aggregate("masks", F.lit(0).cast("long"), lambda done, m: done + F.when(when(m), value(m)).otherwise(0))

    here = lambda m: fails(m, failing) & ~fails(m, prior)
    return by_part.withColumn("s", F.explode(plan)).select(
        "part",
        "s.filter_order",
        "s.step",
        total(lambda m: m["n"], lambda m: ~fails(m, failing.bitwiseOR(prior))).alias("kept"),
        total(lambda m: m["n"], here).alias("removed"),
        total(lambda m: m["n"], lambda m: fails(m, failing) & fails(m, prior)).alias("redundant"),
        total(lambda m: m["n"], lambda m: m["mask"] == failing).alias("unique_fails"),
        total(lambda m: m["good"], here).alias("good_lost"),
        total(lambda m: m["toxic"], here).alias("toxic_lost"),
        # of the filters that a document fails, each comes first in an equal share of the orders
        total(lambda m: (m["n"] * orders / F.bit_count(m["mask"])).cast("long"), lambda m: fails(m, failing)).alias("shapley"),
    )
