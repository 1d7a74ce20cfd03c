"""Nearest neighbours by inner product with vantage-point trees, one a shard.

Vectors are lifted by one coordinate so that all have the length of the longest; then the nearest by
Euclidean distance is the one with the largest inner product, and distances obey the triangle
inequality. A vector belongs to the cell of its nearest pivot (pivots are a sample of at most ``PIVOTS``
rows), and a cell is dealt by hash to shards of ``shard_rows``; every shard builds one tree, and the
queries stream past it, so a vector moves once, whatever the number of queries. A query first searches its own
pivot's cell. Its ``k``-th best there bounds the rest: cells whose range of distances to their pivot is too far
from it are not asked at all, and the trees of the others start with that bound.

A cell or branch is entered if its nearest possible point, ``factor`` times as far as the triangle
inequality says, could still be among the best: factor 1 is exact, larger ones skip more. Final scores
are exact inner products of the original vectors in double precision, summed in the order of the
components.

Rows that repeat both id and vector are counted first and dealt as one, with their number. Within a
shard equal vectors are one point; of its ids the ``k`` smallest other than the query's are enough,
with ties to the smaller id, and points that only the query's own id has are passed over, so none is
lost.

Defined results: vectors that are null, zero or hold null or non-finite components take no part, nor
do rows with a null id; vectors of other dimensions than the query's are not compared with it (a
dimension that no pivot has is one cell); every row counts, also one that repeats an id or an id and
its vector, so a neighbour repeated takes several places, and the rows of one query id share its ``k``
places, as in the SQL twin; all rows of the query's own id are excluded; other columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cropwind.sources.paths import written

NEIGHBOURS = 20
QUERY_EVERY = 20
#: 1 is exact. Larger ones skip more cells and branches.
FACTOR = 1.0
#: Rows whose vectors are the pivots, at most.
PIVOTS = 256
#: Vectors of one tree, and queries that meet it at once.
SHARD_ROWS = 16_384
QUERY_BLOCK = 2_048
LEAF = 256
_SHARD = ("dimension", "cell", "shard")
_MOVED = [*_SHARD, "asked", "id", "copies", "top", "bound", "vector"]


def usable(embeddings: DataFrame) -> DataFrame:
    """``vec_id, vector`` (doubles) of the rows that take part."""
    vector = F.col("embedding").cast("array<double>")
    rows = embeddings.select("vec_id", vector.alias("vector")).where("vec_id IS NOT NULL AND vector IS NOT NULL")
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(finite & F.exists("vector", lambda x: x != 0))


def scores(points: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products, components added one after the other."""
    out = np.zeros(len(points))
    for d in range(points.shape[1]):
        out += points[:, d] * query[d]
    return out


class Tree:
    """A vantage-point tree over lifted points; inner nodes hold ranges of distances to their vantage point."""

    def __init__(self, points: np.ndarray):
        self.points = points
        #: Pairs of queries and points that searches have compared.
        self.compared = 0
        self.root = self._built(np.arange(len(points)))

    def _built(self, members: np.ndarray):
        if len(members) <= LEAF:
            return members
        # The vantage point is the member farthest from the first one: it spreads distances.
        first = self.points[members] - self.points[members[0]]
        vantage = self.points[members[int(np.argmax((first * first).sum(axis=1)))]]
        apart = np.sqrt(((self.points[members] - vantage) ** 2).sum(axis=1))
        order = np.argsort(apart, kind="stable")
        half = len(members) // 2
        near, far = order[:half], order[half:]
        if apart[near[0]] == apart[far[-1]]:
            return members
        return vantage, (apart[near[0]], apart[near[-1]], self._built(members[near])), (apart[far[0]], apart[far[-1]], self._built(members[far]))

    def search(self, queries: np.ndarray, k: int, factor: float, owners: tuple[np.ndarray, np.ndarray] | None = None, worst: np.ndarray | None = None) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """For each query the candidates' numbers and squared distances, at least the best ``k`` of those met.

        ``owners`` numbers the points and the queries; a query passes over the points of its own number.
        ``worst`` has squared distances beyond which a query needs no candidate.
        """
        n = len(queries)
        best = [np.zeros(0, np.int64)] * n
        dist = [np.zeros(0)] * n
        worst = np.full(n, np.inf) if worst is None else worst.copy()
        norms = (self.points**2).sum(axis=1)
        own = (queries**2).sum(axis=1)
        # A little slack keeps candidates whose rounded distances tie.
        room = 1e-12 + 1e-13 * (own + norms.max())

        def visit(node, active: np.ndarray) -> None:
            if not len(active):
                return
            if isinstance(node, np.ndarray):
                self.compared += len(active) * len(node)
                d2 = np.maximum(own[active][:, None] + norms[node][None] - 2.0 * queries[active] @ self.points[node].T, 0.0)
                near = d2 <= (worst[active] * (1 + 1e-9) + room[active])[:, None]
                if owners is not None:
                    near &= owners[0][node][None] != owners[1][active][:, None]
                hit, at = np.nonzero(near)
                cuts = np.searchsorted(hit, np.arange(len(active) + 1))
                for i, q in enumerate(active.tolist()):
                    mine = at[cuts[i] : cuts[i + 1]]
                    if not len(mine):
                        continue
                    found, far = np.concatenate((best[q], node[mine])), np.concatenate((dist[q], d2[i, mine]))
                    if len(far) > k:
                        limit = np.partition(far, k - 1)[k - 1]
                        keep = far <= limit * (1 + 1e-9) + room[q]
                        found, far, worst[q] = found[keep], far[keep], limit
                    best[q], dist[q] = found, far
                return
            vantage, near, far = node
            apart = np.sqrt(np.maximum(((queries[active] - vantage) ** 2).sum(axis=1), 0.0))
            gaps = [np.maximum(np.maximum(side[0] - apart, apart - side[1]), 0.0) * factor for side in (near, far)]
            # Queries go first to the side they are closer to.
            first = gaps[0] <= gaps[1]
            for side, gap, turn in ((near, gaps[0], first), (far, gaps[1], ~first), (far, gaps[1], first), (near, gaps[0], ~first)):
                open_ = turn & (gap * (1 - 1e-9) <= np.sqrt(worst[active] + room[active]) + 1e-9)
                visit(side[2], active[open_])

        visit(self.root, np.arange(n))
        return best, dist


def _vectors(batch: pa.RecordBatch, dimension: int) -> np.ndarray:
    return batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)


def _lift(vectors: np.ndarray, top: float) -> np.ndarray:
    return np.sqrt(np.maximum(top - (vectors**2).sum(axis=1), 0.0))


class Pivots:
    """Lifted pivots by dimension: ``cells``, ``points`` and the ranges of distances of their cells."""

    def __init__(self, rows: list, ranges: dict[int, tuple[float, float]] | None = None):
        self.of: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        # Once the ranges are known, pivots without vectors (repeats of another one) are left out.
        known = [(i, r) for i, r in enumerate(rows) if ranges is None or i in ranges]
        for d in {r.dimension for _, r in known}:
            mine = [(i, r) for i, r in known if r.dimension == d]
            points = np.array([r.vector for _, r in mine], np.float64)
            self.of[d] = np.array([i for i, _ in mine], np.int32), np.column_stack((points, _lift(points, mine[0][1].top)))
        self.ranges = ranges or {}

    def apart(self, lifted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cells, distance of each point to each pivot)."""
        cells, points = self.of[lifted.shape[1] - 1]
        squares = (lifted**2).sum(axis=1)[:, None] + (points**2).sum(axis=1)[None] - 2.0 * lifted @ points.T
        return cells, np.sqrt(np.maximum(squares, 0.0))

    def reached(self, lifted: np.ndarray, home: np.ndarray, worst: np.ndarray, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """(query, cell) of the cells other than ``home`` that may hold a point within ``worst`` (squared)."""
        cells, apart = self.apart(lifted)
        low, high = (np.array([self.ranges[c][i] for c in cells.tolist()]) for i in (0, 1))
        gap = np.maximum(np.maximum(low - apart, apart - high), 0.0) * factor
        size = (lifted**2).sum(axis=1)[:, None] + high**2
        # A small distance has lost half of its digits.
        query, at = np.nonzero((gap**2 <= worst[:, None] + 1e-7 * size) & (cells[None] != home[:, None]))
        return query, cells[at]


def _by_dimension(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    for batch in batches:
        dimensions = batch.column("dimension").to_numpy()
        for d in np.unique(dimensions).tolist():
            mine = batch.take(pa.array(np.flatnonzero(dimensions == d)))
            for lo in range(0, len(mine), QUERY_BLOCK):
                yield d, mine.slice(lo, QUERY_BLOCK)


def _dealt(pivots: Pivots, query: bool):
    """Adds ``cell``, of the nearest pivot, and ``apart``, the distance to it; -1 and 0 without a pivot."""

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for d, part in _by_dimension(batches):
            cell, far = np.full(len(part), -1, np.int32), np.zeros(len(part))
            if d in pivots.of:
                v = _vectors(part, d)
                cells, apart = pivots.apart(np.column_stack((v, np.zeros(len(v)) if query else _lift(v, part.column("top")[0].as_py()))))
                at = apart.argmin(axis=1)
                cell, far = cells[at], apart[np.arange(len(v)), at]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell), pa.array(far)], names=[*part.schema.names, "cell", "apart"])

    return dealt


def _others(pivots: Pivots, factor: float):
    """``asked, cell`` of the further cells each query has to search."""

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for d, part in _by_dimension(batches):
            if d in pivots.of:
                v = _vectors(part, d)
                bound, top = part.column("bound").to_numpy(), part.column("top").to_numpy()
                query, cell = pivots.reached(np.column_stack((v, np.zeros(len(v)))), part.column("home").to_numpy(), _worst(v, top, bound), factor)
                yield pa.RecordBatch.from_arrays([part.column("asked").take(pa.array(query)), pa.array(cell)], names=["asked", "cell"])

    return others


def _worst(queries: np.ndarray, top: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """Squared lifted distance at the score ``bound``, with room for rounding; no bound is minus infinity."""
    size = (queries**2).sum(axis=1) + top
    return np.maximum(size - 2.0 * bound, 0.0) + 1e-9 * size


class Shard:
    """The tree of one shard's vectors and the ids that each of them has."""

    def __init__(self, rows: pa.Table, dimension: int):
        data = np.concatenate([_vectors(b, dimension) for b in rows.to_batches()])
        self.vectors, place = np.unique(data, axis=0, return_inverse=True)
        ids = rows.column("id").to_numpy()
        order = np.lexsort((ids, place.ravel()))
        self.ids, self.copies = ids[order], rows.column("copies").to_numpy()[order]
        self.starts = np.searchsorted(place.ravel()[order], np.arange(len(self.vectors) + 1))
        # A point's number is that of its only id, or -1 where several ids have the vector.
        self.known = np.unique(ids)
        self.owners = np.where(np.diff(self.starts) == 1, np.searchsorted(self.known, self.ids[self.starts[:-1]]), -1)
        self.tree = Tree(np.column_stack((self.vectors, _lift(self.vectors, rows.column("top")[0].as_py()))))

    def answers(self, batch: pa.RecordBatch, k: int, factor: float) -> pa.RecordBatch:
        q, asking, bound = _vectors(batch, self.vectors.shape[1]), batch.column("id").to_numpy(), batch.column("bound").to_numpy()
        spot = np.minimum(np.searchsorted(self.known, asking), len(self.known) - 1)
        owners = self.owners, np.where(self.known[spot] == asking, spot, -2)
        lifted = np.column_stack((q, np.zeros(len(q))))
        found, _ = self.tree.search(lifted, k, factor, owners, _worst(q, batch.column("top").to_numpy(), bound))
        row, out_v, out_s = [], [], []
        for i, (qid, times, points) in enumerate(zip(asking.tolist(), batch.column("copies").to_pylist(), found, strict=True)):
            s = scores(self.vectors[points], q[i])
            members = [self.starts[p] + _smallest(self.ids[self.starts[p] : self.starts[p + 1]], qid, k) for p in points]
            m = np.concatenate(members) if members else np.zeros(0, np.int64)
            v, s = self.ids[m], np.repeat(s, [len(x) for x in members])
            best = np.lexsort((v, -s))[:k]
            best = np.repeat(best, self.copies[m[best]] * times)[:k]
            row.append(np.full(len(best), i))
            out_v.append(v[best])
            out_s.append(s[best])
        at = pa.array(np.concatenate(row))
        return pa.RecordBatch.from_arrays([batch.column("asked").take(at), batch.column("id").take(at), pa.array(np.concatenate(out_v)), pa.array(np.concatenate(out_s))], names=["asked", "query_id", "vec_id", "score"])


def _searched(k: int, factor: float):
    """Rows come shard by shard, the shard's vectors (``asked`` -1) before its queries."""

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, shard = None, [], None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in _SHARD])
            kind = batch.column("asked").to_numpy() >= 0
            change = (keys[:, 1:] != keys[:, :-1]).any(axis=0) | (kind[1:] != kind[:-1])
            cuts = np.concatenate(([0], np.flatnonzero(change) + 1, [len(batch)])) if len(batch) else np.zeros(1, np.int64)
            for first, end in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                key, part = tuple(keys[:, first].tolist()), batch.slice(first, end - first)
                if key != current:
                    current, held, shard = key, [], None
                if not kind[first]:
                    held.append(part)
                    continue
                if shard is None and held:
                    shard, held = Shard(pa.Table.from_batches(held), key[0]), []
                if shard is not None:
                    for lo in range(0, len(part), QUERY_BLOCK):
                        yield shard.answers(part.slice(lo, QUERY_BLOCK), k, factor)

    return searched


def _smallest(ids: np.ndarray, without: int, k: int) -> np.ndarray:
    """Places of the ``k`` smallest of sorted ids other than ``without``."""
    lo, hi = np.searchsorted(ids, [without, without + 1]) if without < np.iinfo(np.int64).max else (np.searchsorted(ids, without), len(ids))
    return np.concatenate((np.arange(min(lo, k)), np.arange(hi, min(hi + k, len(ids)))))[:k]


def _best(found: DataFrame, key: str, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place.cast("int")).where(F.col("rank") <= k)


class Index:
    """All vectors, dealt to cells and shards.

    ``rows`` has ``vec_id, vector, copies, dimension, top, cell, apart``; ``sizes`` one row a cell with its
    number of ``shards``. Only the pivots and the ranges of their cells come to the driver.
    """

    def __init__(self, embeddings: DataFrame, k: int, shard_rows: int):
        # More copies than places make no difference.
        counted = usable(embeddings).groupBy("vec_id", "vector").agg(F.least(F.count("*"), F.lit(k)).alias("copies"))
        square = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
        rows = written(counted.withColumns({"dimension": F.size("vector"), "square": square}), "vantage-rows")
        tops = written(rows.groupBy("dimension").agg(F.max("square").alias("top")), "vantage-tops")
        rows = rows.drop("square").join(tops, "dimension")
        wanted = min(PIVOTS, max(1, -(-rows.count() // shard_rows)))
        sample = rows.orderBy(F.xxhash64("vec_id", "vector")).limit(wanted).select("dimension", "vector", "top").collect()
        schema = "vec_id long, vector array<double>, copies long, dimension int, top double"
        rows = rows.select("vec_id", "vector", "copies", "dimension", "top")
        self.schema = f"{schema}, cell int, apart double"
        self.rows = written(rows.mapInArrow(_dealt(Pivots(sample), query=False), self.schema), "vantage-dealt")
        sizes = self.rows.groupBy("dimension", "cell").agg(F.count("*").alias("n"), F.min("apart").alias("low"), F.max("apart").alias("high"))
        self.sizes = written(sizes.withColumn("shards", F.ceil(F.col("n") / shard_rows).cast("int")), "vantage-cells")
        self.pivots = Pivots(sample, {r.cell: (r.low, r.high) for r in self.sizes.where("cell >= 0").collect()})
        # Dealt by id and vector, so that shards have equal sizes also where one of them repeats.
        shard = F.pmod(F.xxhash64("vec_id", "vector"), F.col("shards")).cast("int").alias("shard")
        held = self.rows.join(self.sizes.select("dimension", "cell", "shards"), ["dimension", "cell"])
        self.held = held.select("dimension", "cell", shard, F.lit(-1).cast("long").alias("asked"), F.col("vec_id").alias("id"), "copies", "top", F.lit(None).cast("double").alias("bound"), "vector")

    def queries(self, is_query) -> DataFrame:
        """The query rows, numbered by ``asked``, with the cell of their nearest pivot."""
        asked = self.rows.where(is_query).select("vec_id", "vector", "copies", "dimension", "top")
        asked = asked.mapInArrow(_dealt(self.pivots, query=True), self.schema).withColumn("asked", F.monotonically_increasing_id())
        return written(asked.withColumn("bound", F.lit(float("-inf"))), "vantage-queries")

    def search(self, sent: DataFrame, k: int, factor: float) -> DataFrame:
        """``asked, query_id, vec_id, score``: the best of each shard in each query's ``cell``."""
        shards = self.sizes.select("dimension", "cell", "shards")
        sent = sent.join(shards, ["dimension", "cell"]).withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
        both = self.held.unionByName(sent.select(*_SHARD, "asked", F.col("vec_id").alias("id"), "copies", "top", "bound", "vector"))
        rows = both.repartition(*_SHARD).sortWithinPartitions(*_SHARD, F.col("asked") >= 0)
        return rows.select(*_MOVED).mapInArrow(_searched(k, factor), "asked long, query_id long, vec_id long, score double")

    def others(self, asked: DataFrame, first: DataFrame, k: int, factor: float) -> DataFrame:
        """The queries once for each further cell that may hold one of their ``k`` nearest."""
        bounds = _best(first, "asked", k).groupBy("asked").agg(F.min("score").alias("low"), F.count("*").alias("n")).where(F.col("n") == k)
        bounded = asked.drop("bound", "apart").withColumnRenamed("cell", "home").join(bounds.select("asked", F.col("low").alias("bound")), "asked", "left")
        bounded = written(bounded.fillna(float("-inf"), ["bound"]), "vantage-bounds")
        cells = bounded.select("asked", "dimension", "home", "top", "bound", "vector").mapInArrow(_others(self.pivots, factor), "asked long, cell int")
        return written(bounded.join(cells, "asked"), "vantage-sent")


def neighbours(embeddings: DataFrame, is_query, k: int = NEIGHBOURS, factor: float = FACTOR, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found of every query row."""
    index = Index(embeddings, k, shard_rows)
    asked = index.queries(is_query)
    first = written(index.search(asked, k, factor), "vantage-first")
    more = index.search(index.others(asked, first, k, factor), k, factor)
    # Each shard asked gave k rows a query at most.
    return _best(first.unionByName(more), "query_id", k).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH rows AS (
  SELECT vec_id, embedding::DOUBLE[] AS vector FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.vector, c.vector) AS score
  FROM rows q JOIN rows c ON q.vec_id <> c.vec_id AND len(q.vector) = len(c.vector) WHERE q.vec_id % 20 = 0
), placed AS (
  SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM pairs
)
SELECT * FROM placed WHERE rank <= 20
"""
