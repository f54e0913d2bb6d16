"""Exact top-k search by inner product as a Voronoi kNN join.

Vectors are quantised to integers. Pivots, a hash sample of the data vectors, cut the data
into cells; queries are grouped by their own nearest pivots. A summary of each cell holds
the number of its vectors, their largest norm, their largest distance to the pivot
(radius) and the k + 1 smallest distances. For a query q, a vector x of a cell at distance d
from its pivot, and every x of the cell:

    q . x >= q . pivot - |q| d   and   q . x <= min(q . pivot + |q| radius, |q| largest norm)

The lower bounds of the nearest vectors of all cells give a score that k + 1 vectors are sure to
reach; a cell whose upper bound stays below it for every query of a group is of no use to the
group. The other cells are replicated to the group, best bound first, and the group is solved where
they meet, in slices of the data that are merged afterwards; cells that fall behind what was found
on the way are passed over. All bounds come from summaries, never from all pairs. Where vectors
lie in clusters most cells are left out; of evenly spread directions of many dimensions no
bound can leave out any, and every group needs all data.

Of equal vectors only those with the k + 1 smallest ids can be in an answer (one of them
may be the query itself), so no more of them travel; equal queries are solved once, unless their ids
have several vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelltrail.llm.common import staged, table

SCALE = 64
K = 20
QUERY_STEP = 20
# Pivots are about the square root of the number of vectors, within these bounds: they and the
# summaries of their cells are held by the driver and every task.
PIVOTS, MOST_PIVOTS = 64, 2048
# Vectors of a packed block, and queries that are solved together.
BLOCK_ROWS = 8192
GROUP_ROWS = 4096
# Scores that a task computes at a time.
SCORES = 1 << 22
NO_ID = -(2**63)


def quantised(df: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """Distinct (vec_id, v) with integer components; unusable vectors and null ids go."""
    parts = F.transform(vector_col, lambda x: x.cast("double"))
    fine = F.forall(
        "v", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(x)
    )
    rows = df.select(F.col(id_col).cast("bigint").alias("vec_id"), parts.alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & fine)
    whole = F.transform("v", lambda x: F.floor(x * scale).cast("bigint"))
    return rows.select("vec_id", whole.alias("v")).dropDuplicates(["vec_id", "v"])


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten() if isinstance(column, pa.ListArray) else column.values
    return flat.to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.int64)


def nearest(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest pivot of each vector and the distance to it."""
    x, p = x.astype(float), pivots.astype(float)
    square = (x * x).sum(1)[:, None] - 2 * (x @ p.T) + (p * p).sum(1)
    cell = square.argmin(1)
    return cell, np.sqrt(((x - p[cell]) ** 2).sum(1))


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products; floats are exact below 2**53."""
    most = np.abs(q).max(initial=0) * float(np.abs(x).max(initial=0)) * max(1, q.shape[1])
    return (q.astype(float) @ x.T.astype(float)).astype(np.int64) if most < 2**53 else q @ x.T


def blocks_of(rows: DataFrame, pivots: np.ndarray, near: int) -> DataFrame:
    """Rows (vec_id, v) packed by cell: cell, ids, vectors, n, and of the block the radius, the largest
    norm and the ``near`` smallest distances to the pivot. With a column ``own`` the ids are pairs."""
    dim = pivots.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            ids, x = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            cell, far = nearest(x, pivots)
            norm = np.sqrt((x.astype(float) ** 2).sum(1))
            out = []
            for c in np.unique(cell):
                at = np.flatnonzero(cell == c)
                least = np.sort(far[at])[:near].tolist()
                size = len(at), float(far[at].max()), float(norm[at].max())
                out.append((int(c), ids[at].tobytes(), x[at].tobytes(), *size, least))
            kinds = (pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.float64(), pa.float64(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)],
                names=["cell", "ids", "vectors", "n", "radius", "norm", "least"],
            )

        for batch in batches:
            if batch.num_rows:
                ids = batch.column("vec_id").to_numpy()
                if "own" in batch.schema.names:
                    ids = np.stack([ids, batch.column("own").to_numpy()], axis=1)
                held.append((ids, matrix(batch.column("v"), dim)))
            if sum(len(i) for i, _ in held) >= BLOCK_ROWS:
                yield from flush()
        yield from flush()

    schema = "cell int, ids binary, vectors binary, n int, radius double, norm double, least array<double>"
    return rows.mapInArrow(run, schema)


class Bounds:
    """Bounds of inner products between queries and cells, by the cells' summaries."""

    def __init__(self, pivots, counts, radius, norms, least, k: int):
        self.pivots, self.counts, self.radius, self.norms, self.k = pivots, counts, radius, norms, k
        # smallest distances to the pivot of each cell, infinite where a cell has fewer vectors
        self.least = least

    def upper(self, q: np.ndarray) -> np.ndarray:
        near, size = q.astype(float) @ self.pivots.T, np.sqrt((q.astype(float) ** 2).sum(1))[:, None]
        bound = np.minimum(near + size * self.radius, size * self.norms)
        return np.where(self.counts > 0, bound + self._slack(bound), -np.inf)

    def sure(self, q: np.ndarray) -> np.ndarray:
        """A score that more than k vectors reach, for each query."""
        out = np.full(len(q), -np.inf)
        for i, one in enumerate(q.astype(float)):
            low = (self.pivots @ one)[:, None] - np.sqrt(one @ one) * self.least
            low = (low - self._slack(low))[np.isfinite(self.least)]
            if len(low) > self.k:
                out[i] = np.partition(low, len(low) - self.k - 1)[len(low) - self.k - 1]
        return out

    @staticmethod
    def _slack(x: np.ndarray) -> np.ndarray:
        return 1e-6 * np.abs(x) + 1e-3


class Best:
    """The best candidates so far of the queries of a group; ``own`` ids are no candidates of a query.

    ``sure`` are scores that as many vectors as are kept are known to reach.
    """

    def __init__(self, q: np.ndarray, own: np.ndarray, keep: int, sure: np.ndarray | None = None):
        self.q, self.own, self.keep = q, own, keep
        self.found: list[tuple[np.ndarray, np.ndarray]] = [
            (np.empty(0, np.int64), np.empty(0, np.int64)) for _ in q
        ]
        # an own id can be among those that are sure
        low = np.full(len(q), -np.inf)
        self.last = low if sure is None else np.where(own == NO_ID, sure, low)

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        step = max(1, SCORES // max(1, len(self.q)))
        for lo in range(0, len(ids), step):
            self._add(ids[lo : lo + step], x[lo : lo + step])

    def _add(self, ids: np.ndarray, x: np.ndarray) -> None:
        score = products(self.q, x)
        for i in np.flatnonzero((score >= self.last[:, None]).any(1)):
            at = np.flatnonzero(score[i] >= self.last[i])
            at = at[ids[at] != self.own[i]]
            s = np.concatenate([self.found[i][0], score[i][at]])
            v = np.concatenate([self.found[i][1], ids[at]])
            order = np.lexsort((v, -s))[: self.keep]
            self.found[i] = (s[order], v[order])
            if len(order) == self.keep:
                self.last[i] = max(self.last[i], s[order[-1]])


def top_k(
    df: DataFrame,
    queries: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = K,
    scale: int = SCALE,
    pivots: int | None = None,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products of every query with ``df``.

    Ties go to the smaller vec_id; all candidates are given if there are fewer than k. Rows
    of ``df`` with the query's id are no candidates of it; of an id with several different vectors each
    is a query, with an answer of its own. Vectors that are null, or hold null
    or non-finite components, take no part, nor do rows without id and empty vectors. Candidates
    of a query are the vectors of its own length; a vector may be of any length. Repeated rows count once. Without queries or
    data the result is empty. Other columns do not matter.
    """
    spark = df.sparkSession
    every = quantised(df, id_col, vector_col, scale)
    asked = quantised(queries, id_col, vector_col, scale)
    schema = "query_id bigint, rank int, vec_id bigint, score bigint"
    lengths = [
        {r.dim for r in rows.select(F.size("v").alias("dim")).distinct().collect()} for rows in (every, asked)
    ]
    # a search for each length that both have, of which there are few
    found = [
        same_length(every.where(F.size("v") == dim), asked.where(F.size("v") == dim), dim, k, pivots)
        for dim in sorted(lengths[0] & lengths[1] - {0})
    ]
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], schema)


def same_length(every: DataFrame, asked: DataFrame, dim: int, k: int, pivots: int | None) -> DataFrame:
    """``top_k`` for quantised vectors ``v`` of ``dim`` components."""
    spark = every.sparkSession
    place = F.row_number().over(W.partitionBy("v").orderBy("vec_id"))
    data = staged(
        every.withColumn("place", place).where(F.col("place") <= k + 1).drop("place"), "vectors"
    )
    if pivots is None:
        pivots = min(MOST_PIVOTS, max(PIVOTS, int(data.count() ** 0.5)))
    # of ids with several vectors more than one row can be no candidate
    several = data.groupBy("vec_id").agg(F.count("*").alias("n")).where("n > 1").select("vec_id", F.lit(True).alias("m"))
    asked = asked.join(several, "vec_id", "left").select("vec_id", "v", F.when(F.col("m"), F.col("vec_id")).alias("own"))
    asked = staged(asked, "asked")
    reps = asked.select("v", "own").distinct().withColumn("rep", F.monotonically_increasing_id())
    reps = staged(reps, "query-vectors")
    owners = F.coalesce("own", F.lit(NO_ID))

    chosen = data.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).collect()
    centre = np.unique(np.array([r.v for r in chosen], np.int64), axis=0)
    blocks = staged(blocks_of(data, centre, k + 1), "vector-cells")
    cells = blocks.groupBy("cell").agg(
        F.sum("n").alias("n"),
        F.max("radius").alias("radius"),
        F.max("norm").alias("norm"),
    )
    place = F.row_number().over(W.partitionBy("cell").orderBy("d"))
    nearest_rows = blocks.select("cell", F.explode("least").alias("d")).withColumn("place", place)
    counts, radius, norms = np.zeros(len(centre)), np.zeros(len(centre)), np.zeros(len(centre))
    least = np.full((len(centre), k + 1), np.inf)
    for r in cells.collect():
        counts[r.cell], radius[r.cell], norms[r.cell] = r.n, r.radius, r.norm
    for r in nearest_rows.where(F.col("place") <= k + 1).collect():
        least[r.cell, r.place - 1] = r.d
    bounds = Bounds(centre.astype(float), counts, radius, norms, least, k)

    named = reps.select(F.col("rep").alias("vec_id"), "v", owners.alias("own"))
    asking = staged(blocks_of(named, centre, 0), "query-cells")
    per_cell = {r.cell: r.n for r in asking.groupBy("cell").agg(F.sum("n").alias("n")).collect()}
    # neighbouring pivots share a group until it is full; a large cell gets several
    groups, group, held = {}, 0, 0
    for c in chain_of(centre, sorted(per_cell)):
        if held and held + per_cell[c] > GROUP_ROWS:
            group, held = group + groups_of(held), 0
        groups[c] = group
        held += per_cell[c]
    sizes: dict[int, int] = {}
    for c, g in groups.items():
        sizes[g] = sizes.get(g, 0) + per_cell[c]
    # a group meets its data in so many slices
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    shares = max(1, -(-tasks // max(1, group + groups_of(held))))

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Queries by group: row by row, so that equal groups of all tasks can meet."""
        for batch in batches:
            for c, ids, x in zip(*(batch.column(n).to_pylist() for n in ("cell", "ids", "vectors")), strict=True):
                ids, x = np.frombuffer(ids, np.int64).reshape(-1, 2), np.frombuffer(x, np.int64).reshape(-1, dim)
                g = groups[c] + (ids[:, 0] * 2654435761 % 2**32) % groups_of(sizes[groups[c]])
                for one in np.unique(g):
                    at = np.flatnonzero(g == one)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([int(one)], pa.int32()),
                            pa.array([ids[at].tobytes()], pa.binary()),
                            pa.array([x[at].tobytes()], pa.binary()),
                            pa.array([len(at)], pa.int32()),
                        ],
                        names=["group", "ids", "vectors", "n"],
                    )

    def routes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Cells that a group needs, with the largest upper bound."""
        for batch in batches:
            for g, ids, x in zip(*(batch.column(n).to_pylist() for n in ("group", "ids", "vectors")), strict=True):
                q = np.frombuffer(x, np.int64).reshape(-1, dim)
                own = np.frombuffer(ids, np.int64).reshape(-1, 2)[:, 1]
                upper, sure = bounds.upper(q), np.where(own == NO_ID, bounds.sure(q), -np.inf)
                need = np.flatnonzero((upper >= sure[:, None]).any(0) & (counts > 0))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(need), g), pa.int32()),
                        pa.array(need, pa.int32()),
                        pa.array(upper[:, need].max(0), pa.float64()),
                    ],
                    names=["group", "cell", "bound"],
                )

    grouped = asking.mapInArrow(slices, "group int, ids binary, vectors binary, n int")
    wanted = (
        grouped.mapInArrow(routes, "group int, cell int, bound double")
        .groupBy("group", "cell")
        .agg(F.max("bound").alias("bound"))
    )
    parts = blocks.select("cell", "ids", "vectors").join(wanted, "cell").drop("cell")
    parts = parts.withColumn("share", F.pmod(F.xxhash64("ids"), F.lit(shares)).cast("int"))
    every_share = F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share")
    first = F.lit(float("inf")).alias("bound")
    meeting = grouped.select("group", "ids", "vectors", first, every_share).unionByName(parts)
    meeting = meeting.repartition(tasks, "group", "share").sortWithinPartitions("group", "share", F.desc("bound"))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, ids, asked_rows, best = None, [], [], None

        def answers() -> Iterator[pa.RecordBatch]:
            if best is None:
                return
            hits = [
                [{"vec_id": int(v), "score": int(s)} for s, v in zip(*f, strict=True)] for f in best.found
            ]
            hit = pa.struct([("vec_id", pa.int64()), ("score", pa.int64())])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(ids)[:, 0], pa.int64()), pa.array(hits, pa.list_(hit))],
                names=["rep", "hits"],
            )

        for batch in batches:
            for g, share, i, x, bound in zip(
                *(batch.column(n).to_pylist() for n in ("group", "share", "ids", "vectors", "bound")), strict=True
            ):
                if (g, share) != current:
                    yield from answers()
                    current, ids, asked_rows, best = (g, share), [], [], None
                i, x = np.frombuffer(i, np.int64), np.frombuffer(x, np.int64).reshape(-1, dim)
                if bound == float("inf"):
                    ids.append(i.reshape(-1, 2))
                    asked_rows.append(x)
                    continue
                if best is None:
                    q, own = np.concatenate(asked_rows), np.concatenate(ids)[:, 1]
                    best = Best(q, own, k + 1, bounds.sure(q))
                if bound >= best.last.min():
                    best.add(i, x)
        yield from answers()

    solved = meeting.mapInArrow(solve, "rep bigint, hits array<struct<vec_id: bigint, score: bigint>>")
    # the best of all slices: at most k + 1 rows of each
    order = F.array_sort(
        F.transform(F.flatten(F.collect_list("hits")), lambda h: F.struct((-h["score"]).alias("s"), h["vec_id"]))
    )
    solved = solved.groupBy("rep").agg(F.slice(order, 1, k + 1).alias("hits"))
    whose = asked.select(F.col("vec_id").alias("query_id"), "v", owners.alias("o")).join(
        reps.select("rep", "v", owners.alias("o")), ["v", "o"]
    )
    others = F.filter("hits", lambda h: h["vec_id"] != F.col("query_id"))
    return (
        whose.select("query_id", "rep")
        .join(solved, "rep")
        .select("query_id", F.posexplode(F.slice(others, 1, k)).alias("pos", "hit"))
        .select("query_id", (F.col("pos") + 1).alias("rank"), "hit.vec_id", (-F.col("hit.s")).alias("score"))
    )


def groups_of(queries: int) -> int:
    return max(1, -(-queries // GROUP_ROWS))


def chain_of(pivots: np.ndarray, cells: list[int]) -> list[int]:
    """Cells in an order that keeps neighbouring pivots together, each next to its nearest."""
    left, out = set(cells), []
    while left:
        if out:
            rest = sorted(left)
            far = ((pivots[rest] - pivots[out[-1]]) ** 2).sum(1)
            out.append(rest[int(far.argmin())])
        else:
            out.append(min(left))
        left.remove(out[-1])
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where(F.col("vec_id") % QUERY_STEP == 0))


# floor and products of these sizes are exact in doubles
ORACLE = f"""
with e as (
    select vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::double)) as v
    from embeddings
    where embedding is not null
      and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
),
s as (
    select q.vec_id as query_id, e.vec_id, list_inner_product(q.v, e.v)::bigint as score
    from e as q join e on q.vec_id <> e.vec_id
    where q.vec_id % {QUERY_STEP} = 0
),
r as (
    select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s
)
select query_id, rank, vec_id, score from r where rank <= {K}
"""
