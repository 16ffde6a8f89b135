"""Approximate nearest neighbours by inner product: inverted lists scanned with adaptive dimensions.

Lists come from k-means on a bounded sample; every vector is indexed. Largest inner product becomes smallest distance
by one more dimension, sqrt(M^2 - |x|^2) with M the largest norm (0 for vectors of one norm). Vectors are rotated at
random and compared in blocks of columns: after each block a candidate's partial distance, scaled to all dimensions, is
tested against the query's k-th best so far, and candidates that are farther with confidence are abandoned. A list is
scanned for all queries of a task at once: blocks are matrix products while many candidates are left, and single pairs
once few are. The survivors' scores are computed anew from the original vectors in double precision.

Lists are joined into groups of at most about CELL vectors and split where they hold more; a task scans one group for
one block of queries and returns k of each query, and these are merged. Vectors travel once for each block of
queries that looks into their group. Equal vectors of a task are scanned as one. A query looks into a share ``probes``
of the lists, 8 at least, and into as many as hold HELD vectors (k others, if that is more). Ties go to the smaller id.

Vectors of over LONG times the median norm would leave the others' distances without digits: they form a list of their
own, of which every query computes the inner products.

Defined results: vectors that are null, empty, zero or hold null, NaN or infinite components take no part, neither do
those of another dimension than most have; rows with a null id take no part; rows that repeat an id are rows each, as
queries and as candidates, and a query never finds its own row; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import stored

#: Vectors that the lists are fitted to, at most.
SAMPLE = 16_384
ITERATIONS = 6
#: Bounds of a task's vectors and queries; between them an eighth of all.
CELLS, QUERIES = (8192, 1 << 16), (512, 1 << 14)
BLOCK = 16
#: Confidence of the hypothesis test: a candidate is abandoned if its scaled partial distance exceeds the k-th best
#: by the factor (1 + EPSILON / sqrt(dimensions seen))^2.
EPSILON = 2.1
PROBES = 0.65
#: Vectors that a query is compared with, at least.
HELD = 2048
#: Lists, at most: what the sample can tell apart. Larger lists are split over tasks.
MOST_LISTS = SAMPLE // 8
LONG = 1024.0
#: Distinct vectors kept beyond k, for rounding among equal scores.
SPARE = 12
#: Share of the candidates left at which pairs are compared one by one.
SPARSE = 1 / 16
SEED = 7


def usable(v: Column) -> Column:
    """Vectors that take part."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def norm(v: Column) -> Column:
    """Euclidean norm, without overflow on the way."""
    top = F.array_max(F.transform(v, lambda x: F.abs(x.cast("double"))))
    return F.get(F.transform(F.array(top), lambda m: m * F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + (x / m) * (x / m)))), F.lit(0))


def norms_of(x: np.ndarray) -> np.ndarray:
    m = np.abs(x).max(axis=1, keepdims=True, initial=0.0)
    m[m == 0] = 1.0
    return m[:, 0] * np.sqrt(((x / m) ** 2).sum(axis=1))


def rotation(d: int, seed: int = SEED) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, d)))
    return q * np.sign(np.diag(r))


def kmeans(x: np.ndarray, k: int, iterations: int = ITERATIONS, seed: int = SEED) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[:k]]
    for _ in range(iterations):
        near = np.argmin((c * c).sum(1) - 2 * x @ c.T, axis=1)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        n = np.bincount(near, minlength=len(c))
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], x[rng.integers(len(x), size=len(c))])
    return c


def lifted(x: np.ndarray, top: float) -> np.ndarray:
    """x over the largest norm, and the dimension that makes all norms 1."""
    x = x / top
    return np.hstack([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1)))[:, None]])


def directions(q: np.ndarray) -> np.ndarray:
    """Queries at norm 1, 0 in the lifted dimension."""
    return np.hstack([q / norms_of(q)[:, None], np.zeros((len(q), 1))])


def exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products in double precision; a row's sum doesn't depend on where the row stands."""
    with np.errstate(over="ignore", invalid="ignore"):
        return (x.astype(np.float64) * q.astype(np.float64)).sum(axis=-1)


def scan(q: np.ndarray, x: np.ndarray, limit: np.ndarray, epsilon: float = EPSILON) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, candidate, distance) of the pairs that aren't abandoned and are within the queries' limits."""
    d, s = x.shape[1], 0
    part = np.zeros((len(q), len(x)))
    while s < d:
        e = min(s + BLOCK, d)
        a, b = q[:, s:e], x[:, s:e]
        part += (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * a @ b.T
        s = e
        if s == d:
            break
        keep = part <= (limit * (1 + epsilon / s**0.5) ** 2 * (s / d) + 1e-12)[:, None]
        if keep.sum() < SPARSE * keep.size:
            i, j = np.nonzero(keep)
            dist = part[i, j]
            while s < d and len(i):
                e = min(s + BLOCK, d)
                diff = x[j, s:e] - q[i, s:e]
                dist = dist + (diff * diff).sum(axis=1)
                s = e
                at = limit[i] if s == d else limit[i] * (1 + epsilon / s**0.5) ** 2 * (s / d)
                keep = dist <= at + 1e-12
                i, j, dist = i[keep], j[keep], dist[keep]
            return i, j, dist
        part[~keep] = np.inf
    i, j = np.nonzero(part <= (limit + 1e-12)[:, None])
    return i, j, part[i, j]


class Best:
    """The n least distances of each query so far, with their candidates."""

    def __init__(self, queries: int, n: int):
        self.dist, self.at = np.full((queries, n), np.inf), np.full((queries, n), -1, dtype=np.int64)
        self.limit = np.full(queries, np.inf)

    def add(self, rows: np.ndarray, i: np.ndarray, at: np.ndarray, dist: np.ndarray) -> None:
        """Pairs of the query rows[i], i ascending, and the candidate ``at``."""
        if not len(i):
            return
        some, first, count = np.unique(i, return_index=True, return_counts=True)
        place = np.arange(len(i)) - np.repeat(first, count)
        row, width, n = np.repeat(np.arange(len(some)), count), int(count.max()), self.dist.shape[1]
        d, a = np.full((len(some), n + width), np.inf), np.full((len(some), n + width), -1, dtype=np.int64)
        q = rows[some]
        d[:, :n], a[:, :n] = self.dist[q], self.at[q]
        d[row, n + place], a[row, n + place] = dist, at
        o = np.argpartition(d, n - 1, axis=1)[:, :n]
        self.dist[q], self.at[q] = np.take_along_axis(d, o, 1), np.take_along_axis(a, o, 1)
        self.limit[q] = self.dist[q].max(axis=1)


class Index:
    """What tasks know: centres, sizes of lists, the groups that lists are in. List len(centres) is the long vectors'."""

    def __init__(self, centres: np.ndarray, top: float, cut: float, share: float, k: int):
        self.centres, self.top, self.cut, self.share, self.k = centres, top, cut, share, k
        self.norms = (centres * centres).sum(axis=1)

    def nearest(self, x: np.ndarray) -> np.ndarray:
        size = norms_of(x)
        near = np.full(len(x), len(self.centres))
        usual = size <= self.cut
        near[usual] = np.argmin(self.norms - 2 * lifted(x[usual], self.top) @ self.centres.T, axis=1)
        return near

    def sized(self, loads: dict[int, tuple[int, int]], cell: int, block: int) -> None:
        """loads: list to its vectors and queries. Groups of lists, and the parts of a list that holds more."""
        self.sizes = np.array([loads.get(i, (0, 0))[0] for i in range(len(self.centres) + 1)])
        self.group, self.parts = _grouped(self.sizes, cell)
        self.block, self.shares = _grouped(np.array([loads.get(i, (0, 0))[1] for i in range(len(self.centres) + 1)]), block)

    def probed(self, q: np.ndarray) -> np.ndarray:
        """A row per query: whether it looks into each list. As many lists as hold k others."""
        n = len(self.centres)
        order = np.argsort(self.norms - 2 * q @ self.centres.T, axis=1, kind="stable")
        held = self.sizes[n] + self.sizes[order].cumsum(axis=1)
        least = min(n, max(8, round(n * self.share)))
        most = np.maximum(least, (held < max(self.k + 1, HELD)).sum(axis=1) + 1)
        out = np.zeros((len(q), n + 1), dtype=bool)
        np.put_along_axis(out, order, np.arange(n) < most[:, None], axis=1)
        out[:, n] = True
        return out & (self.sizes > 0)


def _grouped(sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The first group of each list, and how many groups of its own it is split over (1: shared with its neighbours)."""
    group, parts, at, held = np.zeros(len(sizes), dtype=np.int64), np.ones(len(sizes), dtype=np.int64), 0, 0
    for i, n in enumerate(sizes.tolist()):
        if n > most:
            at += held > 0
            group[i], parts[i], held = at, -(-n // most), 0
            at += int(parts[i])
        else:
            if held + n > most:
                at, held = at + 1, 0
            group[i], held = at, held + n
    return group, parts


def search(df: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vector: str = "embedding", probes: float = PROBES, lists: int | None = None) -> DataFrame:
    """For each row for which ``queries`` holds, its k nearest other rows: query_id, rank, id, score.

    ``probes``: share of the lists that a query looks into; at least 8 lists."""
    kind = df.schema[vector].dataType.simpleString()
    kind = kind if kind == "array<float>" else "array<double>"
    good = df.where(usable(F.col(vector)) & F.col(id_col).isNotNull())
    good = good.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast(kind).alias("v"), F.coalesce(queries, F.lit(False)).alias("q"))
    sized = good.withColumn("n", norm(F.col("v")))
    size = sized.agg(F.count("*").alias("n"), F.mode(F.size("v"), True).alias("d"), F.percentile_approx("n", 0.5).alias("m"), F.count_if("q").alias("q")).first()
    out = f"query_id long, rank int, {id_col} long, score double"
    if not size.n:
        return df.sparkSession.createDataFrame([], out)
    d, cut = size.d, size.m * LONG
    good = good.where(F.size("v") == d)
    top = float(sized.where((F.size("v") == d) & (F.col("n") <= cut)).agg(F.max("n")).first()[0] or 1.0)
    n_lists = max(1, min(MOST_LISTS, lists or round(size.n**0.5)))
    drawn = good.select("v", F.xxhash64("id", "v").alias("h")).orderBy("h").limit(SAMPLE).select("v").collect()  # bounded
    x = np.array([r.v for r in drawn], dtype=np.float64).reshape(-1, d)
    x = x[norms_of(x) <= cut]
    centres = kmeans(lifted(x, top), n_lists) if len(x) else np.zeros((1, d + 1))
    index, turn = Index(centres, top, cut, probes, k), rotation(d + 1)

    def vectors(column) -> np.ndarray:
        return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, d)

    def assign(batches):
        for b in batches:
            if b.num_rows:
                import pyarrow as pa

                yield b.append_column("list", pa.array(index.nearest(vectors(b.column("v"))).astype(np.int32)))

    placed = stored(good.mapInArrow(assign, f"id long, v {kind}, q boolean, list int").withColumn("u", F.monotonically_increasing_id()), "placed")
    loads = placed.groupBy("list").agg(F.count("*").alias("c"), F.count_if("q").alias("q")).collect()  # at most MOST_LISTS + 1 rows
    cell, block = (min(most, max(least, n // 8)) for (least, most), n in ((CELLS, size.n), (QUERIES, size.q)))
    index.sized({r.list: (r.c, r.q) for r in loads}, cell, block)

    def places(first: np.ndarray, parts: np.ndarray, u: Column) -> Column:
        """The group of a row: its list's first, and one of its parts by chance."""
        a, n = F.array(*map(F.lit, first.tolist())), F.array(*map(F.lit, parts.tolist()))
        return F.get(a, F.col("list")) + F.pmod(F.xxhash64(u), F.get(n, F.col("list")))

    def ask(batches):
        """A row for each group that a query looks into."""
        import pyarrow as pa

        for b in batches:
            for at in range(0, b.num_rows, 256):
                s = b.slice(at, 256)
                probed, group = index.probed(directions(vectors(s.column("v")))), []
                for p in probed:
                    lists = np.flatnonzero(p)
                    group.append(np.unique(np.concatenate([index.group[i] + np.arange(index.parts[i]) for i in lists]) if len(lists) else lists))
                yield s.append_column("g", pa.array([x.astype(np.int64) for x in group], pa.list_(pa.int64()))).select(["u", "id", "v", "list", "b", "g"])

    asked = placed.where("q").withColumn("b", places(index.block, index.shares, F.col("u")))
    asked = asked.select("u", "id", "v", "list", "b").mapInArrow(ask, f"u long, id long, v {kind}, list int, b long, g array<long>")
    asked = stored(asked, "asked")
    asks = asked.select("b", F.explode("g").alias("g"))
    held = placed.withColumn("g", places(index.group, index.parts, F.col("u"))).join(asks.distinct(), "g")
    dealt = held.select("g", "b", "u", "id", "v", "list", F.lit(False).alias("side"))
    dealt = dealt.unionByName(asked.select(F.explode("g").alias("g"), "b", "u", "id", "v", "list", F.lit(True).alias("side")))

    def cells(t):
        import pyarrow as pa

        side = np.asarray(t.column("side"), dtype=bool)
        v = vectors(t.column("v").combine_chunks())
        u, ids, where = (np.asarray(t.column(c)) for c in ("u", "id", "list"))
        qu, qi, q = u[side], ids[side], v[side]
        cu, ci, c, where = u[~side], ids[~side], v[~side], where[~side]
        res = neighbours(index, turn, q, qu, c, cu, ci, where, k) if len(c) and len(q) else ()
        i, j, s = res if len(res) else (np.zeros(0, int),) * 2 + (np.zeros(0),)
        return pa.table({"u": qu[i], "query_id": qi[i], "id": ci[j], "score": pa.array(s, pa.float64())}) if len(i) else pa.table({"u": pa.array([], pa.int64()), "query_id": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})

    found = dealt.groupBy("g", "b").applyInArrow(cells, "u long, query_id long, id long, score double")
    w = Window.partitionBy("u").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")


def neighbours(index: Index, turn: np.ndarray, q: np.ndarray, qu: np.ndarray, c: np.ndarray, cu: np.ndarray, ci: np.ndarray, where: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, candidate, score): up to k of each query, of the lists it looks into."""
    # equal vectors of a list as one, their rows by id
    raw = np.ascontiguousarray(c).view(np.dtype((np.void, c.shape[1] * 8))).reshape(-1)
    _, same = np.unique(raw, return_inverse=True)
    o = np.lexsort((ci, same.reshape(-1), where))
    c, cu, ci, where, same = c[o], cu[o], ci[o], where[o], same.reshape(-1)[o]
    first = np.flatnonzero(np.r_[True, (same[1:] != same[:-1]) | (where[1:] != where[:-1])])
    count = np.diff(np.r_[first, len(c)])
    lists, start = np.unique(where[first], return_index=True)
    end = np.r_[start[1:], len(first)]
    flat = directions(q)
    probed, flat = index.probed(flat), flat @ turn
    own = np.isin(cu[first], qu) & (count == 1)
    best, long = Best(len(q), k + SPARE), []
    for at, a, b in zip(lists.tolist(), start.tolist(), end.tolist(), strict=True):
        asks = np.flatnonzero(probed[:, at])
        if not len(asks):
            continue
        if at == len(index.centres):
            long = [first[a:b]]
            continue
        x = lifted(c[first[a:b]], index.top) @ turn
        step = max(1, (1 << 22) // len(x))
        for s in range(0, len(asks), step):
            rows = asks[s : s + step]
            i, j, dist = scan(flat[rows], x, best.limit[rows])
            other = ~own[a + j] | (cu[first[a + j]] != qu[rows[i]])
            best.add(rows, i[other], first[a + j[other]], dist[other])
    members = dict(zip(first.tolist(), count.tolist(), strict=True))
    out_i, out_j, out_s = [], [], []
    back = np.argsort(o)
    for i in range(len(q)):
        at = best.at[i][best.at[i] >= 0]
        j = np.concatenate([np.arange(f, f + min(members[f], k + 1)) for f in at.tolist()] or [at])
        if long:
            z = long[0]
            s = exact_scores(q[i], c[z])
            z = z[np.lexsort((ci[z], -s))[: k + 1]]
            j = np.concatenate([j, *[np.arange(f, f + min(members[f], k + 1)) for f in z.tolist()]])
        j = j[cu[j] != qu[i]]
        s = exact_scores(q[i], c[j])
        top = np.lexsort((ci[j], -s))[:k]
        out_i.append(np.full(len(top), i))
        out_j.append(j[top])
        out_s.append(s[top])
    j = np.concatenate(out_j)
    return np.concatenate(out_i), o[j], np.concatenate(out_s)
