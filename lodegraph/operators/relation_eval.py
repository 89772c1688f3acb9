"""Extracted relations against true ones: four ways of matching, one to one, with the direction told."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegraph.functions import names as N
from lodegraph.operators.evaluation import greedy_matching
from lodegraph.operators.metrics import safe_ratio
from lodegraph.sources.tables import written

#: The ways of matching.
MODES = ("strict", "partial", "direction_agnostic", "type_only")
# fixed values: how alike names have to be, and ends of relations that agree in type alone
ALIKE, SOME = 0.85, 0.3


def _alike(a: Column, b: Column) -> Column:
    """Of two structs (bare, some): a name without what doesn't count, and whether it has a letter at all."""
    return F.when(a["some"] & b["some"], N.similarity(a["bare"], b["bare"])).otherwise(0.0)


def _name(of: Column) -> Column:
    return F.struct(N.bare_name(of).alias("bare"), (F.length(of) > 0).alias("some"))


def compared(mode: str, src: Column, dst: Column, true_src: Column, true_dst: Column, threshold: float = ALIKE) -> tuple[Column, Column, Column]:
    """(whether two relations of one type match, similarity, whether the direction is right)."""
    return _compared(mode, *map(_name, (src, dst, true_src, true_dst)), threshold)


def _compared(mode: str, src: Column, dst: Column, true_src: Column, true_dst: Column, threshold: float) -> tuple[Column, Column, Column]:
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}")
    ahead, back = (_alike(src, true_src), _alike(dst, true_dst)), (_alike(src, true_dst), _alike(dst, true_src))
    forward, reverse = (ahead[0] + ahead[1]) / 2, (back[0] + back[1]) / 2
    fits = (ahead[0] >= threshold) & (ahead[1] >= threshold)
    if mode == "strict":
        return (src["bare"] == true_src["bare"]) & (dst["bare"] == true_dst["bare"]), forward, F.lit(True)
    if mode == "partial":
        return fits, forward, F.lit(True)
    best = F.greatest(forward, reverse)
    if mode == "direction_agnostic":
        return fits | ((back[0] >= threshold) & (back[1] >= threshold)), best, fits & (reverse <= forward)
    return best > SOME, best, forward > reverse


def matches(extracted: DataFrame, truth: DataFrame, mode: str = "strict", threshold: float = ALIKE) -> DataFrame:
    """(item, i, j, type, similarity, direction): relations of an item matched one to one, most alike first, ties by i and j.

    extracted: item, i, src, dst, type; truth: item, j, src, dst, type. Types have to agree, so only relations of one
    item and type are compared. Names are made bare once a relation, not once a pair; the pairs are found once, written.
    """
    a = extracted.select("item", "type", "i", _name(F.col("src")).alias("src"), _name(F.col("dst")).alias("dst"))
    b = truth.select("item", "type", "j", _name(F.col("src")).alias("true_src"), _name(F.col("dst")).alias("true_dst"))
    ok, alike, direction = _compared(mode, F.col("src"), F.col("dst"), F.col("true_src"), F.col("true_dst"), threshold)
    found = written(a.join(b, ["item", "type"]).where(ok).select("item", "i", "j", "type", F.round(alike, 9).alias("similarity"), direction.alias("direction")))
    return greedy_matching(found, "item").join(found.select("item", "i", "j", "type", "direction"), ["item", "i", "j"])


def scores(extracted: DataFrame, truth: DataFrame, matched: DataFrame, by: list[str]) -> DataFrame:
    """(by, tp, fp, fn, precision, recall, f1, direction_accuracy) counted by columns that all three have; none gives one row."""
    count = lambda rows, name, *more: rows.groupBy(*by).agg(F.count("*").alias(name), *more)
    right = F.count_if("direction").alias("right")
    a, b, m = count(extracted, "n"), count(truth, "t"), count(matched, "tp", right)
    both = (a.join(b, by, "full").join(m, by, "full") if by else a.crossJoin(b).crossJoin(m)).fillna(0, ["n", "t", "tp", "right"])  # by nothing: a row each
    p, r = safe_ratio(F.col("tp"), F.col("n")), safe_ratio(F.col("tp"), F.col("t"))
    return both.select(*by, "tp", (F.col("n") - F.col("tp")).alias("fp"), (F.col("t") - F.col("tp")).alias("fn"), p.alias("precision"), r.alias("recall"), safe_ratio(2 * p * r, p + r).alias("f1"), safe_ratio(F.col("right"), F.col("tp")).alias("direction_accuracy"))


def batch(per_item: DataFrame) -> DataFrame:
    """One row: micro means from sums over items, and macro means of the items' own figures, of scores by item."""
    sums = per_item.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")], *[F.coalesce(F.avg(c), F.lit(0.0)).alias(f"macro_{c}") for c in ("precision", "recall", "f1")], F.count("*").alias("items"))
    p, r = safe_ratio(F.col("tp"), F.col("tp") + F.col("fp")), safe_ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return sums.select("items", p.alias("micro_precision"), r.alias("micro_recall"), safe_ratio(2 * p * r, p + r).alias("micro_f1"), "macro_precision", "macro_recall", "macro_f1")
