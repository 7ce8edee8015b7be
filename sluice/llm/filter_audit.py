"""Audit of filters that are applied one after another: what each removes, misses and shares with the others, in every order.

A document's failures are a mask of one bit a filter. Documents are counted by part and mask, all and those with each label; with five filters
that is a row of 32 numbers for each part and label. All that is asked of an order and a step depends on the mask alone, so it is an
incidence matrix of 32 masks by 600 (120 orders of 5 steps) of zeros and ones, and the answers are the product of the stacked rows with those matrices, in
integers. The texts are read once, whatever the number of orders.

The five filters of the query are expressions of Spark; the one that looks for earlier copies compares SHA-256 of whole texts, grouped
before the shuffle, and finds the document of the least id by a join on text and id, so that no task holds the copies of one text.

Cases: a null text is an empty one; a null part is the empty string; rows without an id have no label and no earlier copy, and are nobody's earlier copy;
repeated rows of one id count each, and none of them is an earlier copy of the others; of several labels of an id any that is 1 counts; an empty table
has no parts and gives no rows. Extra columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import drop, staged

#: More filters than this have too many orders for one matrix.
MOST_FILTERS = 6
_BLANKS = r"[\x20\x09-\x0D]+"
OUTCOMES = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def text_filters(text: Column) -> dict[str, Column]:
    """The failure conditions of filters on one text, null being empty: A short, B repetitive, C upper-case, D signs."""
    text = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(text, _BLANKS), "")
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 3 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def incidence(letters: str) -> dict[str, np.ndarray]:
    """kept, removed, redundant and unique: masks x (orders x steps), 1 where a document of the mask counts; orders as permutations() gives them."""
    n = len(letters)
    out = {name: np.zeros((1 << n, factorial(n) * n), np.int64) for name in ("kept", "removed", "redundant", "unique")}
    masks = np.arange(1 << n)
    for k, order in enumerate(permutations(range(n))):
        gone = np.zeros(1 << n, bool)
        for step, f in enumerate(order):
            fails, at = (masks >> f & 1).astype(bool), k * n + step
            out["removed"][:, at] = fails & ~gone
            out["redundant"][:, at] = fails & gone
            out["unique"][:, at] = masks == 1 << f
            gone |= fails
            out["kept"][:, at] = ~gone
    return out


def histograms(masked: DataFrame) -> DataFrame:
    """(part, cells): for each part the masks that occur with n, good and toxic; from rows (part, mask, n, good, toxic)."""
    each = masked.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])
    return each.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # as many as there are masks


def outcomes(cells: DataFrame, letters: str) -> DataFrame:
    """A row for each part, order and step, from the parts' histograms."""
    if not 0 < len(letters) <= MOST_FILTERS:
        raise ValueError(f"1 to {MOST_FILTERS} filters, not {len(letters)}")

    def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = incidence(letters)
        names = ["".join(o) for o in permutations(letters)]
        orders, steps = np.repeat(names, len(letters)), np.tile(np.arange(1, len(letters) + 1), len(names))
        letter = np.array([letters.index(o[s - 1]) for o, s in zip(orders, steps, strict=True)])
        for batch in batches:
            stacked = np.zeros((3, len(batch), 1 << len(letters)), np.int64)
            for k, own in enumerate(batch["cells"]):
                for c in own:
                    stacked[:, k, c["mask"]] = c["n"], c["good"], c["toxic"]
            kept, redundant, unique = (stacked[0] @ of[name] for name in ("kept", "redundant", "unique"))
            removed = (stacked.reshape(-1, stacked.shape[2]) @ of["removed"]).reshape(3, len(batch), -1)
            shapley = np.stack([removed[0][:, letter == f].sum(axis=1) for f in range(len(letters))], axis=1)
            for k, part in enumerate(batch["part"]):
                yield pd.DataFrame(
                    {
                        "part": part, "filter_order": orders, "step": steps.astype(np.int32), "kept": kept[k], "removed": removed[0, k], "redundant": redundant[k],
                        "unique_fails": unique[k], "good_lost": removed[1, k], "toxic_lost": removed[2, k], "shapley": shapley[k][letter],
                    }
                )

    return cells.mapInPandas(multiply, OUTCOMES)


def audit(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", good_col: str = "quality", toxic_col: str = "toxic") -> DataFrame:
    """The outcomes of the filters A to D of text_filters and E, an earlier copy, by part, in every order."""
    text, fails = F.coalesce(F.col(text_col), F.lit("")), text_filters(F.col(text_col))
    bits = sum((F.when(c, 1 << k).otherwise(0) for k, c in enumerate(fails.values())), F.lit(0))
    rows = documents.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part_col), F.lit("")).alias("part"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), bits.alias("bits"))
    each = staged(rows.groupBy("id", "part", "digest", "bits").agg(F.count(F.lit(1)).alias("n")), "failures")
    named = each.where(F.col("id").isNotNull())
    first = named.groupBy("digest").agg(F.min("id").alias("id"), F.lit(True).alias("first"))
    is_one = lambda c: F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0)))
    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(is_one(good_col).alias("good"), is_one(toxic_col).alias("toxic")).where("good + toxic > 0")
    joined = named.join(first, ["digest", "id"], "left").join(known, "id", "left").unionByName(each.where(F.col("id").isNull()), allowMissingColumns=True)
    late = F.col("first").isNull() & F.col("id").isNotNull()
    share = lambda c: (F.col("n") * F.coalesce(c, F.lit(0))).alias(c)
    masked = joined.select("part", (F.col("bits") + F.when(late, 1 << len(fails)).otherwise(0)).alias("mask"), "n", share("good"), share("toxic"))
    cells = staged(histograms(masked), "histograms")  # as many rows as parts
    drop(each)
    return outcomes(cells, "".join(fails) + "E")
