"""Routing documents to a reviewer within a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_cells(docs: DataFrame, cells: DataFrame) -> DataFrame:
    """``docs`` with ``known_source`` and ``known_pair``: whether training had its source, and its source with its label."""
    pairs = cells.select("source", F.col("label").alias("clf")).distinct().withColumn("known_pair", F.lit(True))
    sources = cells.select("source").distinct().withColumn("known_source", F.lit(True))
    both = docs.join(pairs, ["source", "clf"], "left").join(sources, "source", "left")
    return both.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("known_pair", "known_source")})


def triggers(doubt: float | None, novelty: float | None, pair: bool = True, unseen: bool = True) -> dict[str, Column]:
    """Why a document may be routed; a trigger that is off never fires."""
    off = F.lit(False)
    known = F.col("known_source")
    return {
        "unseen_source": ~known if unseen else off,
        "new_pair": ~F.col("known_pair") if pair else off,
        "novel": F.col("maxsim") < novelty if novelty is not None else off,
        "doubtful": F.col("conf") < doubt if doubt is not None else off,
    }


def priority(order: str = "novelty", seed: int | None = None, key: str = "doc_id") -> list[Column]:
    """Unseen sources first, then the least similar or the least sure; random by hash if there is a seed."""
    if seed is not None:
        return [F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed)))), F.col(key)]
    by = [F.col("maxsim"), F.col("conf")]
    return [F.col("known_source"), *(by if order == "novelty" else by[::-1]), F.col(key)]


def route(docs: DataFrame, fired: Column, budget: int, key: str = "doc_id", order: str = "novelty", seed: int | None = None) -> DataFrame:
    """``docs`` with ``routed``: those that fired, or the first ``budget`` of them (0: all). A top-k, not a full sort."""
    if budget <= 0:
        return docs.withColumn("routed", F.coalesce(fired, F.lit(False)))
    chosen = docs.where(fired).orderBy(*priority(order, seed, key)).limit(budget).select(key).withColumn("routed", F.lit(True))
    return docs.join(chosen, key, "left").withColumn("routed", F.coalesce("routed", F.lit(False)))


def budget_positions(docs: DataFrame, fired: Column, most: int, key: str = "doc_id", order: str = "novelty") -> DataFrame:
    """The place of each of the first ``most`` routed documents, so that smaller budgets are filters."""
    top = docs.where(fired).orderBy(*priority(order, None, key)).limit(most)
    return top.withColumn("position", F.row_number().over(Window.orderBy(*priority(order, None, key))) - 1)  # at most ``most`` rows
