"""Approximate nearest neighbours by largest inner product over balanced posting lists.

Equal vectors are one vector of the index, with as many of their smallest ids as an answer can hold, so a vector that a
third of all rows share is scored once. Vectors get one more component, from the largest norm of all rows, so that the
largest inner product is the least distance. Centroids, one for about LIST distinct vectors, are fitted on a bounded
sample with a penalty on large lists; each vector joins its nearest list and, near a boundary, a few more. Lists over `cap`
vectors are dealt in parts, and so are the queries of lists that are asked more than `batch` times. A query searches the
centroids by a neighbour graph held in memory and takes the lists whose distance is within a ratio of the nearest, and
more until those hold enough other ids. The graph's edges go both ways and each of its components has an entry, so every
list can be reached. The ratio is measured on the whole index: for PROBES of the queries, chosen by hash, the truly
nearest of all vectors are found by comparing with each, and the ratio is the least tried that finds `recall` of them; if
none does, queries take all lists. Lists score their vectors in double precision. A query's EARLY nearest lists come first; the others then give only those vectors that are no
farther than the last one of a whole answer, so that what travels hardly grows with the lists that a query takes.

Vectors that are null, zero, of another length than most of the sample, or that hold null or non-finite components
take no part; neither do rows without id. Equal scores tie: the smaller vec_id comes first. Repeated (vec_id, vector)
rows are returned once. An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import storage
from . import textbytes as tb

#: Rows of the sample at least and at most; distinct vectors of a list on average; lists of a vector at most, and how much
#: farther than the nearest they are.
SAMPLE, MOST, LIST, REPLICAS, BOUNDARY = 16_384, 262_144, 400, 4, 1.08
#: Lists of a query that are scored first; the others answer only with what is as near as the last of those found there.
EARLY = 8
#: Distances held at a time: vectors of a block times centroids.
HELD = 1 << 20
#: Queries that the ratio is measured on, and the components that vectors or queries of one task hold at most.
PROBES, COMPONENTS = 256, 4 << 20


def usable(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id and v (doubles) of the rows that take part."""
    v = F.col(vector).cast("array<double>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    ok = F.col("vec_id").isNotNull() & (F.size(v) > 0) & ~F.exists(v, bad) & F.exists(v, lambda x: x != 0)
    return df.where(ok).select("vec_id", v.alias("v"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)


def _lift(x: np.ndarray, most: float) -> np.ndarray:
    """Vectors of norm at most `most` onto the unit sphere of one more dimension."""
    y = x / most
    return np.column_stack([y, np.sqrt(np.maximum(0, 1 - (y * y).sum(1)))])


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (x * x).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * x @ c.T))


def _blocks(n: int, centroids: int):
    """Ranges of rows whose distances to all centroids are within HELD."""
    step = max(1, HELD // max(1, centroids))
    for lo in range(0, n, step):
        yield slice(lo, min(n, lo + step))


def _nearest(d: np.ndarray, m: int) -> np.ndarray:
    """The places of the m least of each row, nearest first; ties by place."""
    if m >= d.shape[1]:
        return np.argsort(d, 1, kind="stable")
    # the m-th least value settles which places count; equal ones there go by place
    edge = np.partition(d, m - 1, 1)[:, m - 1 : m]
    out = np.empty((len(d), m), np.int64)
    for i, (row, e) in enumerate(zip(d, edge[:, 0].tolist(), strict=True)):
        at = np.flatnonzero(row <= e)
        out[i] = at[np.argsort(row[at], kind="stable")[:m]]
    return out


class Index:
    """Centroids with a graph of their neighbours. most: the largest norm of all vectors."""

    def __init__(self, sample: np.ndarray, most: float, lists: int, rounds: int = 12) -> None:
        self.most = most
        x = _lift(sample, most)
        k = max(1, min(lists, len(x) // 16))
        rng = np.random.Generator(np.random.PCG64(3))
        self.c, weight = x[rng.choice(len(x), k, replace=False)].copy(), np.zeros(k)
        to, near = np.zeros(len(x), np.int64), np.zeros(len(x))
        for _ in range(rounds):
            for at in _blocks(len(x), k):
                d = _distances(x[at], self.c) ** 2
                to[at], near[at] = (d + weight).argmin(1), d.min(1)
            n = np.bincount(to, minlength=k)
            weight += 0.05 * near.mean() * (n / max(1, n.mean()) - 1)  # large lists become dearer
            total = np.zeros_like(self.c)
            np.add.at(total, to, x)
            self.c = np.where(n[:, None] > 0, total / np.maximum(1, n)[:, None], self.c)
        nearest = [_nearest(_distances(self.c[at], self.c), min(25, k))[:, 1:] for at in _blocks(k, k)]
        self.graph, self.entries = _linked(np.concatenate(nearest))
        self.ratio = np.inf

    def lists_of(self, x: np.ndarray) -> list[np.ndarray]:
        """The lists that each vector joins: the nearest first, then those at most BOUNDARY times as far."""
        out = []
        for some in _blocks(len(x), len(self.c)):
            d = _distances(_lift(x[some], self.most), self.c)
            near = _nearest(d, REPLICAS)
            at = np.take_along_axis(d, near, 1)
            out += [n[a <= a[0] * BOUNDARY] for n, a in zip(near, at, strict=True)]
        return out

    def walk(self, q: np.ndarray, ratio: float, least: int, sizes: np.ndarray) -> np.ndarray:
        """Best-first search of the graph from a few entries: all lists within `ratio` of the nearest that it meets,
        and more while they hold fewer than `least` ids. sizes: ids of the vectors whose nearest list it is, so that
        none counts twice."""
        import heapq

        away = lambda rows: np.sqrt(((self.c[rows] - q) ** 2).sum(1))
        first = self.entries
        seen = set(first.tolist())
        todo = list(zip(away(first).tolist(), first.tolist(), strict=True))
        heapq.heapify(todo)
        met: list[tuple[float, int]] = []
        best, held = np.inf, 0
        while todo:
            d, at = heapq.heappop(todo)
            if d > best * ratio and held >= least and len(met) > 8:
                break
            best, held = min(best, d), held + int(sizes[at])
            met.append((d, at))
            new = [x for x in self.graph[at].tolist() if x not in seen]
            if new:
                seen.update(new)
                for pair in zip(away(np.array(new)).tolist(), new, strict=True):
                    heapq.heappush(todo, pair)
        met.sort()
        out, held = [], 0
        for d, at in met:
            if d <= best * ratio or held < least:
                out.append(at)
                held += int(sizes[at])
        return np.array(out)

    def calibrate(self, probes: np.ndarray, near: list[list[tuple[np.ndarray, int]]], least: int, sizes: np.ndarray, recall: float) -> None:
        """The least ratio tried that finds `recall` of what is truly nearest to the probes. near: for each of them, the
        lists of each vector that is, and how many ids of the answer that vector has."""
        q = np.column_stack([probes / np.linalg.norm(probes, axis=1)[:, None], np.zeros(len(probes))])
        need, ids = [], []
        for d, found in zip(_distances(q, self.c), near, strict=True):
            need += [d[lists].min() / max(d.min(), 1e-300) for lists, _ in found]
            ids += [n for _, n in found]
        by = np.argsort(need)
        need, held = np.array(need)[by], np.cumsum(np.array(ids)[by])
        for share in (recall, *(1 - (1 - recall) / 2**i for i in range(1, 6)), 1.0):
            # what the walk doesn't meet within a ratio asks for a larger one
            self.ratio = need[min(len(need) - 1, int(np.searchsorted(held, share * held[-1])))] * (1 + 1e-9) if len(need) else np.inf
            hit = 0
            for v, found in zip(q, near, strict=True):
                taken = set(self.walk(v, self.ratio, least, sizes).tolist())
                hit += sum(n for lists, n in found if not taken.isdisjoint(lists.tolist()))
            if hit >= recall * held[-1:].sum():
                return
        self.ratio = np.inf


def _linked(near: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The graph of these neighbours with its edges both ways, and entries: a few, and one at least in each component."""
    k = len(near)
    a, b = np.repeat(np.arange(k), near.shape[1]), near.reshape(-1)
    edges = np.unique(np.concatenate([a, b]) * k + np.concatenate([b, a]))
    a, b = edges // k, edges % k
    graph = np.split(b, np.cumsum(np.bincount(a, minlength=k))[:-1])
    part = np.arange(k)
    while True:  # each takes the least place that its neighbours know, and what that one knows
        least = part.copy()
        np.minimum.at(least, a, part[b])
        least = least[least]
        if (least == part).all():
            break
        part = least
    return graph, np.union1d(np.arange(0, k, max(1, k // 8)), np.unique(part))


def truly_nearest(every: DataFrame, probes: np.ndarray, k: int) -> DataFrame:
    """probe, rep, score, n (ids): the k distinct vectors nearest to each probe, by comparing it with all of them."""
    dim = probes.shape[1]

    def compare(batches):
        rep, n = np.zeros((len(probes), 0), np.int64), np.zeros((len(probes), 0), np.int64)
        score = np.zeros((len(probes), 0))
        for b in batches:
            x = _matrix(b.column(1), dim)
            own, ids = b.column(0).to_numpy(), b.column(2).to_numpy()
            for lo in range(0, len(x), HELD // 256):
                some = slice(lo, lo + HELD // 256)
                new = probes @ x[some].T
                score, rep, n = (np.hstack([old, np.broadcast_to(v, new.shape)]) for old, v in ((score, new), (rep, own[some]), (n, ids[some])))
                if score.shape[1] > k:
                    at = np.argpartition(-score, k - 1, 1)[:, :k]
                    score, rep, n = (np.take_along_axis(v, at, 1) for v in (score, rep, n))
        probe = np.repeat(np.arange(len(probes)), score.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(v.reshape(-1)) for v in (probe, rep, score, n)], names=["probe", "rep", "score", "n"])

    found = every.select("rep", "v", F.size("ids").cast("long").alias("n")).mapInArrow(compare, "probe long, rep long, score double, n long")
    order = W.partitionBy("probe").orderBy(F.desc("score"), "rep")
    return found.withColumn("at", F.row_number().over(order)).where(F.col("at") <= k)


def _measure(index: Index, every: DataFrame, asking: DataFrame, posted: DataFrame, sizes: np.ndarray, k: int, dim: int, recall: float) -> None:
    """Sets the index's ratio by some queries and what is truly nearest to them."""
    some = asking.orderBy(F.xxhash64("rep"), "rep").select("rep", "v").limit(PROBES).toArrow()
    if not some.num_rows:
        return
    own, probes = some.column("rep").to_pylist(), _matrix(some.column("v"), dim)
    true = truly_nearest(every, probes, k + 1).orderBy("probe", "at").select("probe", "rep", "n").collect()  # PROBES times k + 1
    spark = every.sparkSession
    wanted = F.broadcast(spark.createDataFrame(sorted({(r["rep"],) for r in true}), "rep long"))
    lists = {r["rep"]: np.array(r["lists"]) for r in posted.join(wanted, "rep").groupBy("rep").agg(F.collect_list("list").alias("lists")).collect()}
    near, left = [[] for _ in own], [k] * len(own)
    for i, rep, n in true:
        n = min(left[i], n - (rep == own[i]))  # its own id is no answer
        left[i] -= n
        if n:
            near[i].append((lists[rep], n))
    index.calibrate(probes, near, k + 1, sizes, recall)


def distinct(vectors: DataFrame, k: int) -> DataFrame:
    """h, v, rep (the smallest id), ids (the k smallest): one row for each distinct vector."""
    rows = vectors.select(F.xxhash64("v").alias("h"), "v", "vec_id").distinct()
    # the limit takes effect before the exchange as well, so a common vector doesn't gather in one task
    rows = rows.withColumn("n", F.row_number().over(W.partitionBy("h", "v").orderBy("vec_id"))).where(F.col("n") <= k)
    return rows.groupBy("h", "v").agg(F.min("vec_id").alias("rep"), F.sort_array(F.collect_list("vec_id")).alias("ids"))


def fit(index: DataFrame) -> tuple[Index | None, int]:
    """The index of the distinct vectors whose smallest ids hash lowest, and the vectors' length.

    There are 16 of them for each list, within SAMPLE and MOST.
    """
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    n, most = index.agg(F.count("*"), F.max(norm)).first()
    if not n:
        return None, 0
    lists = -(-n // LIST)
    rows = index.select("rep", "v").orderBy(F.xxhash64("rep"), "rep").limit(min(MOST, max(SAMPLE, 16 * lists))).toArrow()
    sizes = rows.column("v").combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
    dim = int(np.bincount(sizes).argmax())
    x = _matrix(rows.filter(pa.array(sizes == dim)).column("v"), dim)
    return Index(x, float(most), lists), dim


def best(scores: np.ndarray, ids: np.ndarray, first: np.ndarray, q: np.ndarray, x: np.ndarray, k: int, floor: float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of one query's k best that reach `floor`: vectors are chosen by matrix product, then scored and
    ordered one by one. ids: those of all vectors end to end, the i-th one's from first[i] on."""
    edge = floor
    if len(scores) > k:
        edge = max(edge, -np.partition(-scores, k - 1)[k - 1])
    keep = np.flatnonzero(scores >= edge - 1e-9 * max(1.0, abs(edge))) if np.isfinite(edge) else np.arange(len(scores))
    exact = (x[keep] * q).sum(1)
    keep, exact = keep[exact >= floor], exact[exact >= floor]
    n = first[keep + 1] - first[keep]
    own, exact = ids[tb.row_ranges(first[keep], n)], np.repeat(exact, n)
    order = np.lexsort([own, -exact])[:k]
    return own[order], exact[order]


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, cap: int = 8192, batch: int = 20_000, recall: float = 0.97) -> DataFrame:
    """query_id, rank, vec_id, score: for each of queries(vec_id, v), the k vectors found that are nearest, not itself."""
    spark = vectors.sparkSession
    every = storage.keep(distinct(vectors, k + 1), "vectors")
    index, dim = fit(every)
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    every = every.where(F.size("v") == dim)
    cap, batch = (max(1, min(x, COMPONENTS // dim)) for x in (cap, batch))
    asking = storage.keep(distinct(queries.where(F.size("v") == dim), 1), "queries")
    centroids = spark.sparkContext.broadcast(index)  # MOST / 16 at most

    def post(batches):
        for b in batches:
            x = _matrix(b.column(1), dim)
            if not len(x):
                continue
            lists = centroids.value.lists_of(x)
            n = np.array([len(y) for y in lists])
            rows = pa.array(np.repeat(np.arange(len(x)), n))
            primary = np.zeros(int(n.sum()), bool)
            primary[np.cumsum(n) - n] = True
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(lists).astype(np.int32)), pa.array(primary), b.column(0).take(rows), b.column(1).take(rows), b.column(2).take(rows)], names=["list", "nearest", "rep", "v", "ids"])

    posted = storage.keep(every.select("rep", "v", "ids").mapInArrow(post, "list int, nearest boolean, rep long, v array<double>, ids array<bigint>"), "postings")
    sizes, length = np.zeros(len(index.c), np.int64), np.zeros(len(index.c), np.int64)
    for row in posted.groupBy("list").agg(F.sum(F.when(F.col("nearest"), F.size("ids"))), F.count("*")).collect():  # a row for each list
        sizes[row[0]], length[row[0]] = row[1] or 0, row[2]

    _measure(index, every, asking, posted, sizes, k, dim, recall)
    shared = spark.sparkContext.broadcast(index)  # with its ratio

    def choose(batches):
        for b in batches:
            # a query is one row with the places of its lists: Spark sets them out, one row at a time
            found = [shared.value.walk(np.append(v / np.linalg.norm(v), 0.0), shared.value.ratio, k + 1, sizes) for v in _matrix(b.column(1), dim)]
            if found:
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.list_(pa.int32()))], names=["rep", "q", "lists"])

    asked = storage.keep(asking.select("rep", "v").mapInArrow(choose, "rep long, q array<double>, lists array<int>"), "asked")
    asked = asked.select("rep", "q", F.posexplode("lists").alias("at", "list")).select("list", (F.col("at") < EARLY).alias("early"), "rep", "q")
    times = np.zeros(len(index.c), np.int64)
    for row in asked.groupBy("list").count().collect():  # a row for each list
        times[row[0]] = row[1]
    parts = [(i, int(-(-n // cap) or 1), int(-(-t // batch) or 1)) for i, (n, t) in enumerate(zip(length.tolist(), times.tolist(), strict=True)) if t]
    table = F.broadcast(spark.createDataFrame(parts, "list int, parts int, turns int"))  # a row for each list
    place = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    lists = posted.join(table, "list").select("list", place("rep", "parts").alias("part"), each("turns").alias("turn"), "v", "ids")
    keys = ["list", "part", "turn"]

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, np.ndarray]] = []
        rep = left.column("rep")
        if left.num_rows and right.num_rows:
            q, x = _matrix(left.column("q"), dim), _matrix(right.column("v"), dim)
            column = right.column("ids").combine_chunks()
            ids = column.flatten().to_numpy(zero_copy_only=False)
            first = np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))])
            floor = left.column("floor").to_numpy()
            for at in range(0, len(q), 256):
                found += [best(y, ids, first, q[i], x, k + 1, floor[i]) for i, y in enumerate(q[at : at + 256] @ x.T, at)]
        else:
            rep = rep.slice(0, 0)
        ends = np.cumsum([0, *(len(f[0]) for f in found)])
        some = np.flatnonzero(np.diff(ends))
        flat = [np.concatenate([np.empty(0, kind), *(f[j] for f in found)]) for j, kind in enumerate((np.int64, float))]
        near = pa.StructArray.from_arrays([pa.array(x) for x in flat], names=["vec_id", "score"])
        near = pa.ListArray.from_arrays(pa.array(np.append(ends[some], ends[-1]).astype(np.int32)), near)
        return pa.table({"rep": rep.take(pa.array(some)), "near": near})

    def scored(asked: DataFrame) -> DataFrame:
        """rep, vec_id, score: what each list gives its queries, all of it at least their floor."""
        asked = asked.join(table, "list").select("list", each("parts").alias("part"), place("rep", "turns").alias("turn"), "rep", "q", "floor")
        near = asked.groupBy(*keys).cogroup(lists.groupBy(*keys)).applyInArrow(score, "rep long, near array<struct<vec_id: long, score: double>>")
        return near.select("rep", F.inline("near"))

    def merged(found: DataFrame) -> DataFrame:
        """rep, near: the k + 1 best, best first."""
        # boundary vectors come from several lists, with one score: they rank as one
        order = W.partitionBy("rep").orderBy(F.desc("score"), "vec_id")
        few = found.withColumn("n", F.dense_rank().over(order)).where(F.col("n") <= k + 1)
        one = few.groupBy("rep").agg(F.collect_set(F.struct((-F.col("score")).alias("away"), "vec_id")).alias("near"))
        return one.select("rep", F.slice(F.sort_array("near"), 1, k + 1).alias("near"))

    lowest = F.lit(float("-inf"))
    one = storage.keep(merged(scored(asked.where("early").withColumn("floor", lowest))), "early")
    floors = one.where(F.size("near") > k).select("rep", (-F.col("near")[k]["away"]).alias("floor"))
    late = asked.where("not early").join(floors, "rep", "left").withColumn("floor", F.coalesce("floor", lowest))
    before = one.select("rep", F.explode("near").alias("x")).select("rep", "x.vec_id", (-F.col("x.away")).alias("score"))
    one = merged(before.union(scored(late)))
    # back to every row that asks: its own id is no answer
    rows = queries.where(F.size("v") == dim).select(F.col("vec_id").alias("query_id"), F.xxhash64("v").alias("h"), "v").distinct()
    rows = rows.join(asking.select("h", "v", "rep"), ["h", "v"]).select("query_id", "rep").join(one, "rep")
    rows = rows.select("query_id", F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("near"))
    rows = rows.select("query_id", F.posexplode("near").alias("at", "x"))
    return rows.select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.away")).alias("score"))


def neighbours(table: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """The k nearest of every row whose vec_id is divisible by `every`, among all other rows."""
    vectors = usable(table)
    return search(vectors, vectors.where(F.col("vec_id") % every == 0), k)
