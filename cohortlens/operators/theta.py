"""Theta joins (edit distance, substring containment) as equi-joins.

A theta join has no equality key, so Spark could only run it as a nested
loop. These helpers generate candidate pairs of *distinct values* with plain
equi-joins, verify the predicate exactly, and join the pairs back to the
rows by value, so duplicate rows keep their multiplicity:

* edit distance <= k: two strings within distance k share a string reachable
  from both by at most k deletions (the deletion neighbourhood), so joining
  on neighbourhood members finds every such pair. Values whose length
  differs from every value of the other side by more than k are dropped
  before the neighbourhoods are built (they cannot match);
* substring: a pattern occurs in a text only if each of its n-grams does;
  each pattern joins on its *rarest* n-gram (document frequency over the
  texts), which keeps candidate lists short even when some n-grams are
  everywhere. Patterns shorter than n join on the text's substrings of their
  own length.

The plan is the same at every size; AQE decides from measured sizes whether
a join broadcasts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GRAM = 3
MAX_EDIT_DISTANCE = 2


# -- edit distance ------------------------------------------------------------
def deletion_neighbourhood(col: Column, k: int = MAX_EDIT_DISTANCE) -> Column:
    """Array of the distinct strings obtained from ``col`` by deleting at
    most ``k`` (0, 1 or 2) characters, the string itself included."""
    if k not in range(MAX_EDIT_DISTANCE + 1):
        raise ValueError(f"edit distance must be between 0 and {MAX_EDIT_DISTANCE}, not {k}")
    out = F.array(col)
    if k == 0:
        return out
    n = F.length(col)
    idx = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))

    def drop1(s, i):
        return F.concat(s.substr(F.lit(1), i - 1), s.substr(i + 1, F.lit(1 << 30)))

    out = F.concat(out, F.transform(idx, lambda i: drop1(col, i)))
    if k == 2:
        two = F.flatten(F.transform(idx, lambda i: F.transform(
            F.filter(idx, lambda j: j > i),
            lambda j: F.concat(col.substr(F.lit(1), i - 1), col.substr(i + 1, j - i - 1),
                               col.substr(j + 1, F.lit(1 << 30))))))
        out = F.concat(out, two)
    return F.array_distinct(out)


def _values(df: DataFrame, col: str, name: str) -> DataFrame:
    return df.select(F.col(col).alias(name)).where(F.col(name).isNotNull()).distinct()


def edit_distance_pairs(left: DataFrame, lcol: str, right: DataFrame, rcol: str,
                        max_distance: int = MAX_EDIT_DISTANCE) -> DataFrame:
    """All (left row, right row) pairs with levenshtein(lcol, rcol) <=
    ``max_distance`` (0, 1 or 2), plus ``_dist``."""
    near = F.explode(deletion_neighbourhood(F.col("_l"), max_distance)).alias("_v")
    lv, rv = _values(left, lcol, "_l"), _values(right, rcol, "_r")
    reach = F.explode(F.sequence(F.length("_r") - max_distance, F.length("_r") + max_distance))
    lengths = rv.select(reach.alias("_n")).distinct()
    lv = lv.join(lengths, F.length("_l") == F.col("_n"), "left_semi")
    rn = rv.select("_r", F.explode(deletion_neighbourhood(F.col("_r"), max_distance)).alias("_w"))
    pairs = (lv.select("_l", near).join(rn, F.col("_v") == F.col("_w")).select("_l", "_r").distinct()
             .withColumn("_dist", F.levenshtein("_l", "_r")).where(F.col("_dist") <= max_distance))
    return (left.join(pairs, F.col(lcol) == F.col("_l"))
            .join(right, F.col("_r") == F.col(rcol)).drop("_l", "_r"))


# -- substring containment ------------------------------------------------------
def _grams(col: Column, n: int) -> Column:
    """Distinct n-grams (by character) of ``col``; empty when shorter."""
    m = F.length(col) - n + 1
    return F.array_distinct(F.when(m > 0, F.transform(F.sequence(F.lit(1), m),
                                                      lambda i: col.substr(i, F.lit(n))))
                            .otherwise(F.array().cast("array<string>")))


def text_keys(text: Column, n: int = GRAM) -> Column:
    """Grams of up to ``n`` characters, by which a text meets anchors."""
    return F.concat(*[_grams(text, m) for m in range(1, n + 1)])


def pattern_keys(pattern: Column, n: int = GRAM) -> Column:
    """Grams of which a text that contains ``pattern`` has every one."""
    return F.when(F.length(pattern) >= n, _grams(pattern, n)).otherwise(F.array(pattern))


def anchors(patterns: DataFrame, n: int = GRAM) -> DataFrame:
    """Distinct patterns (_p and any others) with _g: the gram that the
    fewest patterns have, a shorter pattern as a whole. Patterns are counted,
    not texts: a text is cut into grams once only."""
    grams = patterns.select("*", F.explode(pattern_keys(F.col("_p"), n)).alias("_g"))
    shared = grams.withColumn("_pf", F.count(F.lit(1)).over(Window.partitionBy("_g")))
    return shared.groupBy(*patterns.columns).agg(F.min_by("_g", F.struct("_pf", "_g")).alias("_g"))


def contains_pairs(texts: DataFrame, tcol: str, patterns: DataFrame, pcol: str,
                   n: int = GRAM) -> DataFrame:
    """All (text row, pattern row) pairs where ``tcol`` contains ``pcol``
    (both non-empty).

    One equi-join: a distinct text's grams of up to n characters meet the one
    anchor of every distinct pattern, and the pattern is verified. A text has
    a gram once and a pattern one anchor, so a pair comes up once."""
    patterns = patterns.where(F.length(pcol) > 0)
    tv = _values(texts, tcol, "_t")
    pairs = (tv.select("_t", F.explode(text_keys(F.col("_t"), n)).alias("_g")).join(anchors(_values(patterns, pcol, "_p"), n), "_g")
             .where(F.col("_t").contains(F.col("_p"))).select("_t", "_p"))
    return (texts.join(pairs, F.col(tcol) == F.col("_t"))
            .join(patterns, F.col("_p") == F.col(pcol)).drop("_t", "_p"))
