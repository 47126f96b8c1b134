"""What filters do to a corpus in every order they can be applied in.

A document's failed filters are the bits of its mask. Documents are summed to cells, one for
each part and mask, of which a part has 32 at most. A recursive query extends the applied
prefixes by each unused letter and meets the cells of every part, so a level of the recursion
emits the metrics of that step; the orders are read off their prefixes.

The case E, a text that a smaller id has too, needs no join of documents: equal texts share
their other bits, so a text's rows are summed first and its least id decides.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidlake.llm.common import keep

#: The failure conditions' bits; E is found on the whole table.
BITS = {"A": 1, "B": 2, "C": 4, "D": 8, "E": 16}
METRICS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]


def text_mask(text: Column) -> Column:
    """Bits of the conditions A to D on a whole text; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))

    def bit(letter: str, fails: Column) -> Column:
        return F.when(fails, F.lit(BITS[letter])).otherwise(F.lit(0))

    def of_words(words: Column) -> Column:
        n = F.size(words)
        return bit("A", n < 100) + bit("B", 100 * F.size(F.array_distinct(words)) < 80 * n)

    # a one-element array binds the words, so that a text is split once
    split_once = F.element_at(F.transform(F.array(words), of_words), 1)
    return split_once + bit("C", 100 * capitals > 10 * F.length(text)) + bit("D", text.rlike("[#$%&*|]"))


def mask_cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents, good ones and toxic ones of each part (``lang``) and mask of failed filters.

    A row without an id has no label and no smaller id, so E leaves it; rows that share an id
    are told apart by nothing, so E takes them only for a smaller id. Several labels of one
    id count as one: good or toxic if any of them says so.
    """
    marks = labels.groupBy("doc_id").agg(
        F.max((F.col("quality") == 1).cast("long")).alias("good"),
        F.max((F.col("toxic") == 1).cast("long")).alias("toxic"),
    )
    texts = docs.select(
        "doc_id",
        F.coalesce("lang", F.lit("")).alias("part"),
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("digest"),
        text_mask(F.col("text")).alias("mask"),
    )
    marked = texts.join(marks, "doc_id", "left").fillna(0, ["good", "toxic"])
    sums = [F.sum("n").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic")]
    # the join has dealt the rows by id: this sum needs no further shuffle
    by_id = marked.groupBy("doc_id", "digest", "part", "mask").agg(
        F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic")
    )
    no_id = F.col("doc_id").isNull()
    by_text = by_id.groupBy("digest", "part", "mask").agg(
        *sums,
        F.coalesce(F.sum(F.when(no_id, F.col("n"))), F.lit(0)).alias("n_no_id"),
        F.min(F.when(~no_id, F.struct("doc_id", "n", "good", "toxic"))).alias("least"),
    )
    # a text has one row for each part
    first = F.min("least.doc_id").over(Window.partitionBy("digest"))
    found = by_text.withColumn("is_first", F.coalesce(F.col("least.doc_id") == first, F.lit(False)))

    def passing(name: str) -> Column:
        return F.when(F.col("is_first"), F.col(f"least.{name}")).otherwise(F.lit(0))

    held = F.struct(
        F.col("mask"),
        (F.col("n_no_id") + passing("n")).alias("n"),
        passing("good").alias("good"),
        passing("toxic").alias("toxic"),
    )
    rest = F.struct(
        (F.col("mask") + BITS["E"]).alias("mask"),
        (F.col("n") - held["n"]).alias("n"),
        (F.col("good") - held["good"]).alias("good"),
        (F.col("toxic") - held["toxic"]).alias("toxic"),
    )
    split = found.select("part", F.inline(F.array(held, rest))).filter("n > 0")
    return split.groupBy("part", "mask").agg(*sums)


#: One row of cells for each part keeps the recursion at 325 rows a part; ``aggregate`` and
#: ``filter`` run over its cells. ``applied`` carries the bits of the prefix so far.
STEPS = """
WITH RECURSIVE letters(letter, bit) AS (VALUES {letters}),
steps(part, prefix, applied, step, letter, m) AS (
  SELECT part, '', 0, 0, '', CAST(NULL AS {metrics}) FROM {{cells}}
  UNION ALL
  SELECT s.part, concat(s.prefix, l.letter), s.applied + l.bit, s.step + 1, l.letter,
    aggregate(
      c.cells,
      CAST(named_struct('kept', 0, 'removed', 0, 'redundant', 0, 'unique_fails', 0, 'good_lost', 0,
                        'toxic_lost', 0) AS {metrics}),
      (t, x) -> CAST(named_struct(
        'kept', t.kept + if(x.mask & (s.applied + l.bit) = 0, x.n, 0L),
        'removed', t.removed + if(x.mask & (s.applied + l.bit) = l.bit, x.n, 0L),
        'redundant', t.redundant + if(x.mask & l.bit <> 0 AND x.mask & s.applied <> 0, x.n, 0L),
        'unique_fails', t.unique_fails + if(x.mask = l.bit, x.n, 0L),
        'good_lost', t.good_lost + if(x.mask & (s.applied + l.bit) = l.bit, x.good, 0L),
        'toxic_lost', t.toxic_lost + if(x.mask & (s.applied + l.bit) = l.bit, x.toxic, 0L)
      ) AS {metrics})
    )
  FROM steps s
  JOIN {{cells}} c ON c.part = s.part
  JOIN letters l ON s.applied & l.bit = 0
  WHERE s.step < {depth}
)
SELECT part, prefix, step, letter, m.* FROM steps WHERE step > 0
"""


#: Prefixes of the orders, the empty one included.
PREFIXES = sum(math.perm(len(BITS), n) for n in range(len(BITS) + 1))
ROW_LIMIT = "spark.sql.cteRecursionRowLimit"


def order_steps(cells: DataFrame) -> DataFrame:
    """A row for each part and each prefix of an order, with the metrics of its last step.

    The session's row limit for recursive queries is raised, while this runs, to the rows that
    the recursion has: 326 a part.
    """
    spark = cells.sparkSession
    kind = "STRUCT<" + ", ".join(f"{name}: BIGINT" for name in METRICS) + ">"
    letters = ", ".join(f"('{letter}', {bit})" for letter, bit in BITS.items())
    packed = keep(
        cells.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("mask", "n", "good", "toxic"))).alias("cells"))
    )
    limit = int(spark.conf.get(ROW_LIMIT))
    try:
        if limit >= 0:
            spark.conf.set(ROW_LIMIT, max(limit, PREFIXES * packed.count() + 1))
        return keep(spark.sql(STEPS.format(letters=letters, metrics=kind, depth=len(BITS)), cells=packed))
    finally:
        spark.conf.set(ROW_LIMIT, limit)


def filter_orders(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Metrics of every step of all 120 orders of the filters, for each part of the documents.

    Returns part, filter_order, step, kept, removed, redundant, unique_fails, good_lost,
    toxic_lost and shapley (its filter's removed, over all orders and steps), with zeros. Null
    texts are empty, a null ``lang`` is the part ''. Other columns have no say, and a table
    without rows has no parts.
    """
    steps = order_steps(mask_cells(docs, labels))
    orders = steps.filter(F.col("step") == len(BITS)).select("part", F.col("prefix").alias("filter_order"))
    each = orders.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(BITS)))).alias("step"))
    each = each.withColumn("prefix", F.expr("substring(filter_order, 1, step)"))
    rows = each.join(steps, ["part", "prefix", "step"])
    of_filter = Window.partitionBy("part", "letter")  # 120 rows: a filter has one step in an order
    return rows.select(
        "part", "filter_order", "step", *METRICS, F.sum("removed").over(of_filter).alias("shapley")
    )
