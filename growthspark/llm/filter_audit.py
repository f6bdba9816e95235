"""Filter interaction audit (operator 12).

What a set of filters removes, alone, in any order and in any company, follows
from the counts of its 2^n coalitions: a document is removed by a coalition if
it fails one of its filters.  Those counts are tabulated per part.  A step of an
order removes the difference of two coalitions.  Shapley values are the
constrained least squares fit of an additive game to the table: kernel weights,
the sum held to the removal of all filters.  Its normal equations are solved in
rationals, once, as a map from the table to the values; times n! its entries
are integers, so the values are exact.
"""

from __future__ import annotations

from fractions import Fraction
from itertools import permutations
from math import comb, factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

SPACE = r"[\x20\x09-\x0D]+"


def solve(a: list[list[Fraction]], b: list[list[Fraction]]) -> list[list[Fraction]]:
    """X with a X = b, by Gauss-Jordan elimination in rationals."""
    n = len(a)
    rows = [[*p, *q] for p, q in zip(a, b)]
    for k in range(n):
        pivot = next(i for i in range(k, n) if rows[i][k])
        rows[k], rows[pivot] = rows[pivot], rows[k]
        lead = rows[k][k]
        rows[k] = [v / lead for v in rows[k]]
        for i in range(n):
            if i != k and rows[i][k]:
                f = rows[i][k]
                rows[i] = [v - f * w for v, w in zip(rows[i], rows[k])]
    return [r[n:] for r in rows]


def shapley_map(n: int) -> list[list[int]]:
    """Integer rows r: n! times the Shapley value of filter i is the sum of r[i][S] v(S), v(0) = 0.

    Least squares over the proper coalitions S with weights
    (n - 1) / (C(n, s) s (n - s)), under the constraint that the values add up to v(all).
    """
    full = (1 << n) - 1
    weight = {}
    for s in range(1, full):
        k = s.bit_count()
        weight[s] = Fraction(n - 1, comb(n, k) * k * (n - k))
    a = [[Fraction(0)] * (n + 1) for _ in range(n + 1)]
    b = [[Fraction(0)] * (full + 1) for _ in range(n + 1)]
    for s, w in weight.items():
        held = [i for i in range(n) if s >> i & 1]
        for i in held:
            b[i][s] += w
            for j in held:
                a[i][j] += w
    for i in range(n):
        a[i][n] = a[n][i] = Fraction(1)  # the multiplier of the constraint, and the constraint
    b[n][full] = Fraction(1)
    scaled = [[v * factorial(n) for v in r] for r in solve(a, b)[:n]]
    if any(v.denominator != 1 for r in scaled for v in r):
        raise ArithmeticError("the map times n! must be integer")
    return [[int(v) for v in r] for r in scaled]


def text_rules(text: Column) -> dict[str, Column]:
    """Failure conditions A to D of a whole text (never null); words are case-sensitive."""
    words = F.array_remove(F.split(text, SPACE), "")
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))
    return {
        "A": F.size(words) < 100,
        "B": 100 * F.size(F.array_distinct(words)) < 80 * F.size(words),
        "C": 100 * capitals > 10 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def failures(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """Counts n per (part, mask, good, toxic); bit i of the mask: a document fails rule ABCDE[i].

    The rules A to D read the text alone, so copies share them and are counted
    together.  Rule E is failed by all rows of a text but those of its smallest
    id: ids are counted per text first, then the least of them is kept with its
    count, so that a text or an id that a third of all rows hold is combined
    before each shuffle.  Rows without id neither fail E nor make others fail.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rules = text_rules(F.col("text"))
    mask = sum((F.when(rule, 1 << i).otherwise(0) for i, rule in enumerate(rules.values())), F.lit(0))
    rows = (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
                        text.alias("text"))
            .select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), mask.alias("mask"))
            .groupBy("doc_id", "part", "digest", "mask").agg(F.count(F.lit(1)).alias("n")))
    marked = (labels.select(F.col(id_col).cast("long").alias("doc_id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
              .groupBy("doc_id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic")))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    held = rows.join(marked, "doc_id", "left").select("doc_id", "part", "digest", "mask", "n", flag("good"), flag("toxic"))
    texts = held.groupBy("digest", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("unnamed"),
        F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("first"))
    least = F.min("first.doc_id").over(W.partitionBy("digest"))  # as many rows as parts and labels at most
    kept = F.col("unnamed") + F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0)
    split = F.array(F.struct(F.col("mask"), kept.alias("n")),
                    F.struct((F.col("mask") + (1 << len(rules))).alias("mask"), (F.col("n") - kept).alias("n")))
    return (texts.withColumn("least", least).select("part", "good", "toxic", F.explode(split).alias("s"))
            .groupBy("part", "s.mask", "good", "toxic").agg(F.sum("s.n").alias("n")))


def coalitions(counts: DataFrame, n: int) -> DataFrame:
    """Per part: total, and arrays over all 2^n coalitions of what each removes (removed, good, toxic)."""
    full = (1 << n) - 1
    hit = F.when(F.col("mask").bitwiseAND(F.col("coalition")) != 0, F.col("n")).otherwise(0)
    cells = (counts.withColumn("coalition", F.explode(F.sequence(F.lit(0), F.lit(full)))).withColumn("hit", hit)
             .groupBy("part", "coalition").agg(
                 F.sum("n").alias("total"), F.sum("hit").alias("removed"),
                 F.sum(F.when(F.col("good"), F.col("hit")).otherwise(0)).alias("good"),
                 F.sum(F.when(F.col("toxic"), F.col("hit")).otherwise(0)).alias("toxic")))
    table = F.array_sort(F.collect_list(F.struct("coalition", "removed", "good", "toxic"))).alias("t")  # 2^n cells
    return cells.groupBy("part").agg(F.max("total").alias("total"), table).select("part", "total", "t.removed", "t.good", "t.toxic")


def order_steps(tables: DataFrame, letters: str) -> DataFrame:
    """Every step of every order of the filters, per part, from its coalition table."""
    n = len(letters)
    full = (1 << n) - 1
    orders = ",".join("".join(p) for p in permutations(letters))
    weights = [", ".join(f"{w}L" for w in row) for row in shapley_map(n)]
    values = F.expr("array(" + ", ".join(f"aggregate(zip_with(removed, array({w}), (v, w) -> v * w), 0L, (a, v) -> a + v)" for w in weights) + ")")
    steps = (tables.withColumn("shapleys", values)
             .withColumn("filter_order", F.explode(F.split(F.lit(orders), ",")))
             .withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n)))))
    place = {c: F.instr("filter_order", c) for c in letters}
    before = sum((F.when(place[c] < F.col("step"), 1 << i).otherwise(0) for i, c in enumerate(letters)), F.lit(0))
    which = sum((F.when(place[c] == F.col("step"), i).otherwise(0) for i, c in enumerate(letters)), F.lit(0))
    steps = steps.withColumn("before", before).withColumn("which", which).withColumn("bit", F.expr("shiftleft(1, which)"))
    at = lambda name, s: F.col(name)[s]
    after = F.col("before") + F.col("bit")
    step = lambda name: at(name, after) - at(name, F.col("before"))
    return steps.select(
        "part", "filter_order", "step", (F.col("total") - at("removed", after)).alias("kept"), step("removed").alias("removed"),
        (at("removed", F.col("bit")) - step("removed")).alias("redundant"),
        (at("removed", F.lit(full)) - at("removed", F.lit(full) - F.col("bit"))).alias("unique_fails"),
        step("good").alias("good_lost"), step("toxic").alias("toxic_lost"), at("shapleys", F.col("which")).alias("shapley"))


def audit_filters(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """Filters A to E over whole texts: one row per part, order of the filters and step.

    A null text is empty, a null part the empty string.  A document is good
    (toxic) if any label row of its id says so.  Repeated rows count each; only
    rows of an id above the text's smallest fail E, so rows that repeat id and text
    stay together.  Extra columns are ignored; an empty table has no parts and gives no rows.
    """
    return order_steps(coalitions(failures(docs, labels, id_col, text_col, part_col), 5), "ABCDE")
