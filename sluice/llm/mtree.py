"""Exact top-k search by inner product over M-trees.

Inner products become distances: with M the largest norm of all vectors, x gets one more component sqrt(M^2 - |x|^2) and a query gets 0 there, so
that |q - x|^2 = |q|^2 + M^2 - 2 q.x, and the nearest vectors are those of the highest products. Scores are integers and exact, by 64-bit
products where those cannot overflow and by Python's integers beyond; distances are only used for bounds, with a margin for rounding.

Index: vectors go to the nearest of a bounded sample of pivots, one for about subtree_size vectors; a pivot's cell, with its covering radius and the least
distance in it, is a node of the top level. A cell of more than subtree_size vectors is dealt by a hash of id and vector into subtrees (so a hot
vector or pivot makes more subtrees, not a larger one), and each subtree is built as a paged M-tree: a root page of routing
objects with covering radius and distance to the root, and leaf pages of entries, each with its distance to the routing object. Every subtree is one
row of a staged table.

Search: a query starts with the k-th score it reaches on the pivots, which are vectors of the table themselves. It then goes best first in
two rounds: to the cells of its nearest pivots, and, with the k-th score it has found by then, to those others that can still hold one of the k best by
their pivot's distance, radius and least distance. Which cells a query goes to is settled before anything is shuffled; it travels in blocks
of queries, once to each grove of GROVE subtrees that some of the block visit, with a mark for each query and subtree. In a subtree pages wait in a queue by their least possible distance, which
starts from the stored distance to the root, without computing any; a page is opened only while it can hold one of the k best, and an entry is computed
only if the stored distances and the triangle inequality leave it a chance. The k best of each subtree meet by query.

How many cells and pages are passed over depends on the vectors: clustered ones leave few, vectors without any structure in many
dimensions nearly all, as all their distances are alike. `report` counts them.

Cases: vectors that are null or hold nulls or non-finite components (before or after scaling) take no part, nor do rows with a null id; a shorter
vector counts as filled up with zeros; ties go to the smaller id; a row equal to another in id and vector counts once, and an id with several vectors
once, by its best; a query never finds a row of its own id; with fewer than k candidates all are returned; empty tables give no rows. A score outside 64 bits
is given, and ranked, as the nearest 64-bit integer. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import staged

#: Pivots, at least and at most.
FEW_PIVOTS, PIVOTS = 8, 1024
SUBTREE = 4096
#: Entries of a page at most, and pages that a subtree is to have.
PAGE, PAGES = 256, 16
QUERY_BLOCK = 512
#: Subtrees that get a block of queries together.
GROVE = 16
#: Cells that a query visits first.
FIRST_CELLS = 2
#: Rows whose distances to all pivots are computed together.
STEP = 1024
#: Rounding of a distance, as a share of sqrt(|q|^2 + M^2).
MARGIN = 2e-6
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1
_TREE = "tree int, n long, vectors binary, ids binary, pages binary"
_SENT = "grove int, queries binary, query_ids binary, floors binary, visits binary"


def integer_vectors(table: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, v): floor(scale * x) of every usable vector, as doubles that hold whole numbers, each row once."""
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.transform(F.col(vector_col).cast("array<double>"), lambda x: x * scale).alias("v"))
    fine = F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    whole = F.transform("v", lambda x: F.when(F.abs(x) < float(1 << 53), F.floor(x).cast("double")).otherwise(x))  # larger doubles are whole
    return rows.where(F.col("id").isNotNull() & fine).select("id", whole.alias("v")).dropDuplicates(["id", "v"])


def _padded(vectors, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.float64)
    for k, v in enumerate(vectors):
        out[k, : len(v)] = v
    return out


def _distances(x: np.ndarray, y: np.ndarray, most: float) -> np.ndarray:
    """Distances between rows of x and y, which hold the extra component of vectors."""
    nx, ny = (x * x).sum(axis=1), (y * y).sum(axis=1)
    ax, ay = np.sqrt(np.maximum(most - nx, 0)), np.sqrt(np.maximum(most - ny, 0))
    return np.sqrt(np.maximum(nx[:, None] + ny[None, :] - 2 * (x @ y.T) + (ax[:, None] - ay[None, :]) ** 2, 0))


def _from_queries(q: np.ndarray, y: np.ndarray, most: float) -> np.ndarray:
    """Distances from queries, whose extra component is 0, to vectors."""
    return np.sqrt(np.maximum((q * q).sum(axis=1)[:, None] + most - 2 * (q @ y.T), 0))


class Products:
    """Exact inner products of whole-numbered vectors, cut to 64 bits."""

    def __init__(self, width: int, largest: float):
        bound = width * int(largest) ** 2
        self.kind = "float" if bound < 1 << 53 else "int" if bound < 1 << 63 else "any"

    def of(self, rows: np.ndarray, q: np.ndarray) -> np.ndarray:
        if self.kind == "float":  # every sum on the way is a whole number that a double holds
            return (rows @ q).astype(np.int64)
        if self.kind == "int":
            return rows.astype(np.int64) @ q.astype(np.int64)
        own = [int(x) for x in q]
        return np.array([min(HIGHEST, max(LOWEST, sum(int(a) * b for a, b in zip(r, own, strict=True)))) for r in rows], np.int64)


    def table(self, q: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """queries x rows."""
        if self.kind == "any":
            return np.stack([self.of(rows, x) for x in q]) if len(q) else np.empty((0, len(rows)), np.int64)
        kind = np.float64 if self.kind == "float" else np.int64
        return (q.astype(kind) @ rows.astype(kind).T).astype(np.int64)


def kth_scores(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> list[int | None]:
    """Of queries x rows the k-th highest score of each query among the rows' distinct ids, each by its best and without the query's own; None with fewer."""
    order = np.argsort(ids, kind="stable")
    first = np.flatnonzero(np.r_[True, ids[order][1:] != ids[order][:-1]])
    best, names = np.maximum.reduceat(scores[:, order], first, axis=1), ids[order][first]
    at = np.minimum(np.searchsorted(names, own), len(names) - 1)
    mine = names[at] == own
    best[mine, at[mine]] = LOWEST
    left = len(names) - mine
    kth = -np.partition(~best, k - 1, axis=1)[:, k - 1] - 1 if len(names) >= k else np.zeros(len(own), np.int64)
    return [x if n >= k else None for x, n in zip(kth.tolist(), left.tolist(), strict=True)]


class Best:
    """The k best (score, id) of a query, each id once, and the k-th score."""

    def __init__(self, k: int):
        self.k, self.rows = k, []

    def add(self, score: int, at: int) -> None:
        item = (-score, at)
        for have in self.rows:
            if have[1] == at:
                if item >= have:
                    return
                self.rows.remove(have)
                break
        if len(self.rows) < self.k or item < self.rows[-1]:
            self.rows = sorted([*self.rows, item])[: self.k]

    def worst(self) -> int | None:
        return -self.rows[-1][0] if len(self.rows) == self.k else None


class Subtree:
    """A root page of routing objects and a leaf page for each; entries lie leaf by leaf."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, most: float, pages: np.ndarray | None = None, products: Products | None = None):
        self.v, self.ids, self.most, self.computed = vectors, ids, most, 0
        self.products = products or Products(vectors.shape[1], float(np.abs(vectors).max(initial=0)))
        if pages is None:
            pages = self._build()
        #: Of each leaf: first entry, entries, row of its routing object, distance of that to the root's, covering radius; then of each entry its distance.
        self.pages, n = pages, int(pages[0])
        self.first, self.size, self.routing = (pages[1 + k * n : 1 + (k + 1) * n].astype(np.int64) for k in range(3))
        self.to_root, self.radius = (pages[1 + k * n : 1 + (k + 1) * n] for k in (3, 4))
        self.to_routing = pages[1 + 5 * n :]

    def _build(self) -> np.ndarray:
        """Bulk load: routing objects are taken far apart, one after another; entries join the nearest, and full pages are cut."""
        n = len(self.v)
        page = min(PAGE, max(8, n // PAGES))
        count = max(1, -(-n // page))
        step = max(1, n // (16 * count))
        pool = np.argsort(self.ids, kind="stable")[::step]
        chosen = [int(pool[0])]
        near = _distances(self.v[pool], self.v[chosen], self.most)[:, 0]
        while len(chosen) < count and near.max() > 0:
            chosen.append(int(pool[near.argmax()]))
            near = np.minimum(near, _distances(self.v[pool], self.v[chosen[-1:]], self.most)[:, 0])
        d = _distances(self.v, self.v[chosen], self.most)
        home = d.argmin(axis=1)
        own = d[np.arange(n), home]
        order = np.lexsort((own, home))
        cuts = []  # leaves: runs of one home, `page` entries at most
        starts = np.flatnonzero(np.concatenate([[True], np.diff(home[order]) != 0, [True]]))
        for a, b in zip(starts, starts[1:], strict=False):
            cuts += [(s, min(page, b - s), chosen[home[order[a]]]) for s in range(a, b, page)]
        at = np.empty(n, np.int64)
        at[order] = np.arange(n)
        to_root = _distances(self.v[[r for _, _, r in cuts]], self.v[order[:1]], self.most)[:, 0]
        radius = [own[order[s : s + m]].max() for s, m, _ in cuts]
        rows = [at[r] for _, _, r in cuts]
        pages = np.concatenate([[len(cuts)], [s for s, _, _ in cuts], [m for _, m, _ in cuts], rows, to_root, radius, own[order]])
        self.v, self.ids = self.v[order], self.ids[order]
        return pages

    def search(self, q: np.ndarray, own: int, k: int, floor: int | None) -> list[tuple[int, int]]:
        """[(score, id)], best first, ties to the smaller id. floor: k candidates elsewhere score at least this."""
        base = float(q @ q) + self.most
        slack = MARGIN * np.sqrt(base)
        best, v = Best(k), self.v

        def reach(score: int | None) -> float:
            """No vector farther than this scores so high; made safe."""
            return np.inf if score is None or score == LOWEST else np.sqrt(max(base - 2 * float(score), 0)) + slack

        limit = reach(floor)
        to_root = np.sqrt(max(base - 2 * float(q @ v[0]), 0))
        self.computed += 1
        least = np.maximum(np.abs(self.to_root - to_root) - self.radius - slack, 0)  # by stored distances alone
        queue = [(float(x), 0, int(p)) for p, x in enumerate(least) if not x > limit]  # so that a distance beyond what doubles hold rules nothing out
        heapq.heapify(queue)
        while queue:
            bound, known, p = heapq.heappop(queue)
            if bound > limit:
                break
            to = np.sqrt(max(base - 2 * float(q @ v[self.routing[p]]), 0))
            if not known:
                self.computed += 1
                bound = max(bound, to - self.radius[p] - slack)
                if bound > limit:
                    continue
                if queue and bound > queue[0][0]:
                    heapq.heappush(queue, (bound, 1, p))
                    continue
            a, m = self.first[p], self.size[p]
            rows = a + np.flatnonzero(~(np.abs(self.to_routing[a : a + m] - to) > limit + slack))
            self.computed += len(rows)
            scores = self.products.of(v[a : a + m] if len(rows) == m else v[rows], q)
            worst = best.worst()
            worst = floor if worst is None else worst if floor is None else max(floor, worst)
            keep = np.flatnonzero(scores >= worst) if worst is not None else np.arange(len(rows))
            keep = keep[np.lexsort((self.ids[rows[keep]], ~scores[keep]))]
            for at, x in zip(self.ids[rows[keep]].tolist(), scores[keep].tolist(), strict=True):
                if (least_kept := best.worst()) is not None and x < least_kept:
                    break
                if at != own:
                    best.add(x, at)
            if (worst := best.worst()) is not None:
                limit = min(limit, reach(worst))
        return [(-s, i) for s, i in best.rows]


def top_k(
    table: DataFrame,
    is_query: Column,
    k: int = 5,
    scale: int = 256,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    pivots: int = PIVOTS,
    subtree_size: int = SUBTREE,
    report: dict[str, int] | None = None,
) -> DataFrame:
    """query_id, rank (from 1), id_col, score: the k rows of highest integer inner product for each row where is_query holds.

    is_query may use the id column alone. report, if given, takes the counts of queries, subtrees and visits.
    """
    spark = table.sparkSession
    vectors = staged(integer_vectors(table, id_col, vector_col, scale), "vectors")
    norm = F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x * x)
    total = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("most"), F.max(F.size("v")).alias("width"), F.max(F.array_max(F.transform("v", F.abs))).alias("largest")).first()
    if not total["n"]:
        return spark.createDataFrame([], f"query_id long, rank int, {id_col} long, score long")
    most, width, largest = float(total["most"]), max(1, total["width"]), total["largest"] or 0.0
    form = "<i4" if largest < 1 << 31 else "<f8"
    products = Products(width, largest)
    # a bounded sample: the rows whose ids hash lowest
    count = min(pivots, max(FEW_PIVOTS, -(-total["n"] // subtree_size)))
    sample = vectors.orderBy(F.xxhash64("id", F.lit("pivot")), "id", "v").limit(count).collect()
    pivot, pivot_ids = _padded([r["v"] for r in sample], width), np.array([r["id"] for r in sample], np.int64)

    @F.pandas_udf("pivot int, far double")
    def nearest(v: pd.Series) -> pd.DataFrame:
        home, far = [], []
        for at in range(0, len(v), STEP):
            d = _distances(_padded(v.iloc[at : at + STEP].tolist(), width), pivot, most)
            home.append(d.argmin(axis=1).astype(np.int32))
            far.append(d.min(axis=1))
        return pd.DataFrame({"pivot": np.concatenate([*home, np.empty(0, np.int32)]), "far": np.concatenate([*far, np.empty(0)])})

    housed = staged(vectors.withColumn("own", nearest("v")).select("id", "v", "own.pivot", "own.far"), "housed")
    cells = {r["pivot"]: r for r in housed.groupBy("pivot").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("radius"), F.min("far").alias("least")).collect()}  # `pivots` rows at most
    own = np.array(sorted(cells))
    centre, radius, least = pivot[own], np.array([cells[p]["radius"] for p in own]), np.array([cells[p]["least"] for p in own])
    parts = np.array([-(-cells[p]["n"] // subtree_size) for p in own])
    first_tree, trees = np.cumsum(parts) - parts, int(parts.sum())
    cell_of = np.repeat(np.arange(len(own)), parts)
    placed = spark.createDataFrame(list(zip(own.tolist(), first_tree.tolist(), parts.tolist(), strict=True)), "pivot int, first int, parts int")
    tree = (F.col("first") + F.pmod(F.xxhash64("id", "v"), F.col("parts"))).cast("int")

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        t = Subtree(_padded(rows["v"].tolist(), width), rows["id"].to_numpy(np.int64), most, products=products)
        return pd.DataFrame({"tree": [rows["tree"].iloc[0]], "n": [len(t.ids)], "vectors": [t.v.astype(form).tobytes()], "ids": [t.ids.astype("<i8").tobytes()], "pages": [t.pages.astype("<f8").tobytes()]})

    planted = housed.join(F.broadcast(placed), "pivot").select(tree.alias("tree"), "id", "v")  # `pivots` rows at most
    index = staged(planted.groupBy("tree").applyInPandas(build, _TREE), "trees")
    asked = vectors.withColumnRenamed("id", id_col).where(is_query).withColumnRenamed(id_col, "id")
    queries = asked.count()
    blocks = max(1, -(-queries // QUERY_BLOCK))
    block = F.pmod(F.xxhash64("id", F.lit("block")), F.lit(blocks)).cast("int")

    @F.pandas_udf("long")
    def sample_floor(v: pd.Series, ids: pd.Series) -> pd.Series:
        """The k-th score of each query among the pivots."""
        out = []
        for at in range(0, len(v), STEP):
            q, own_ids = _padded(v.iloc[at : at + STEP].tolist(), width), ids.iloc[at : at + STEP].to_numpy(np.int64)
            out += kth_scores(products.table(q, pivot), pivot_ids, own_ids, k)
        return pd.Series([LOWEST if x is None else x for x in out], dtype="int64")

    def route(rows: pd.DataFrame, late: bool) -> pd.DataFrame:
        """The groves that a block of queries goes to in one of the two rounds, with what each query visits there."""
        q, ids, floors = _padded(rows["v"].tolist(), width), rows["id"].to_numpy(np.int64), rows["floor"].to_numpy(np.int64)
        d = _from_queries(q, centre, most)
        early = np.zeros(d.shape, bool)
        np.put_along_axis(early, np.argsort(d, axis=1, kind="stable")[:, :FIRST_CELLS], True, axis=1)
        go = early
        if late:
            base = (q * q).sum(axis=1) + most
            slack = MARGIN * np.sqrt(base)
            far = np.array([np.inf if f == LOWEST else np.sqrt(max(b - 2 * float(f), 0)) for f, b in zip(floors.tolist(), base, strict=True)])
            go = ~early & ~(np.maximum(d - radius, least - d) > (far + 2 * slack)[:, None])
        sent = []
        for g in range(-(-trees // GROVE)):
            marks = go[:, cell_of[g * GROVE : (g + 1) * GROVE]]
            own = np.flatnonzero(marks.any(axis=1))
            if len(own):
                sent.append((g, q[own].astype(form).tobytes(), ids[own].astype("<i8").tobytes(), floors[own].astype("<i8").tobytes(), np.ascontiguousarray(marks[own].T).astype(np.uint8).tobytes()))
        return pd.DataFrame(sent, columns=["grove", "queries", "query_ids", "floors", "visits"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tree, v, ids, pages, asking, query_ids, floors, visits in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                asked_ids = np.frombuffer(query_ids, "<i8")
                mine = np.frombuffer(visits, np.uint8).reshape(-1, len(asked_ids))[tree % GROVE].astype(bool)
                if not mine.any():
                    continue
                t = Subtree(np.frombuffer(v, form).reshape(-1, width).astype(np.float64), np.frombuffer(ids, "<i8"), most, np.frombuffer(pages, "<f8"), products)
                each = zip(asked_ids[mine].tolist(), np.frombuffer(asking, form).reshape(-1, width)[mine].astype(np.float64), np.frombuffer(floors, "<i8")[mine].tolist(), strict=True)
                found = [(q, i, s) for q, x, floor in each for s, i in t.search(x, q, k, None if floor == LOWEST else floor)]
                columns = list(zip(*found, strict=True)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query_id", "id", "score"])

    def visited(sent: DataFrame) -> DataFrame:
        met = index.withColumn("grove", F.floor(F.col("tree") / GROVE).cast("int")).join(sent, "grove").select("tree", "vectors", "ids", "pages", "queries", "query_ids", "floors", "visits")
        return met.mapInArrow(search, "query_id long, id long, score long").groupBy("query_id", "id").agg(F.max("score").alias("score"))

    ranked = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    asked = staged(asked.select("id", "v", sample_floor("v", "id").alias("floor"), block.alias("block")), "asked")
    early = staged(asked.groupBy("block").applyInPandas(lambda rows: route(rows, False), _SENT), "early")
    near = staged(visited(early).withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k), "near")
    found = near.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("found"))
    later = asked.join(found, "id", "left").select("id", "v", F.greatest("floor", F.coalesce("found", F.lit(LOWEST))).alias("floor"), "block")
    late = staged(later.groupBy("block").applyInPandas(lambda rows: route(rows, True), _SENT), "late")
    if report is not None:
        marked = F.length(F.replace(F.hex("visits"), F.lit("0"), F.lit("")))  # a digit 1 for each query and subtree
        went = sum(s.agg(F.sum(marked)).first()[0] or 0 for s in (early, late))
        report.update(queries=queries, subtrees=trees, visits=int(went))
    both = near.drop("rank").unionByName(visited(late)).groupBy("query_id", "id").agg(F.max("score").alias("score"))
    return both.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
