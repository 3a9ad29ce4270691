"""The k most similar vectors of every vector, by a forest of random-projection trees.

Vectors are normalised, so that cosine is a dot product. A tree halves its rows level by level at the median of their
projections on a random direction, one direction for a level. A query descends every tree to a leaf; each branch it
didn't take goes, with the distance to the cutting plane as its priority, into one queue that all trees share, and the
nearest branches are descended in turn until ``probes`` leaves have been visited. The candidates of the visited leaves
are reranked by exact cosine. All queries of a task move through the queue in step (one array row each), and leaves are
scored as blocks: the queries that visit a leaf times its members, one matrix product.

Distribution. A shard holds at most about ``shard_values`` numbers (rows times dimensions, 32 MB) of one field and is
searched by one task, which holds them and what is looked up in them once. In fields that are larger, equal vectors are
first collapsed to one (an aggregation, so that a vector with a third of all rows is one row before anything is routed),
and the rest is cut by a routing tree of the same kind. Its upper levels are fitted on the driver, on a sample of
``driver_rows`` at most; the levels below, where there are more cells than that sample can part, one by one by quantiles
of a sample (``sample_rows`` for each cell) that stays distributed; every vector is a member of one shard, and is looked up in the ``routes`` shards that are nearest by the same
priority. A hot field thus costs more shards, not a larger task. Only links travel to the final merge. Nearest shards
are enough for links of high cosine; plain neighbours lie in any shard, so with ``routes=None`` a vector that asks is
looked up in every one, whatever their number. That suits a small share of asking rows: each task holds them all.

Defined cases: vectors that are null, of a wrong length, not finite or all zero are neither found nor looked up. A
query_id that stands several times is one vector; if its rows disagree it is looked up with each, and its best cosines
count. Equal vectors are collapsed before trees are built (else no plane could part them) and expanded afterwards; ties
in cosine go to the lower id. A field with fewer than k+1 vectors gives as many neighbours as there are.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.sources.shared import written

LINK = "query_id long, neighbour_id long, cosine double"
_LINK = pa.schema([("query_id", pa.int64()), ("neighbour_id", pa.int64()), ("cosine", pa.float64())])


@dataclass(frozen=True)
class Search:
    """What to look for and how hard.

    k: neighbours of each vector. min_cosine: links below it aren't wanted (None: all are). trees, leaf_rows, probes:
    the forest of a shard, and the leaves a query visits over all trees. shard_values, routes (None: every shard),
    sample_rows, driver_rows: see above.
    """

    k: int = 10
    min_cosine: float | None = None
    trees: int = 6
    leaf_rows: int = 192
    probes: int = 30
    shard_values: int = 1 << 23
    routes: int | None = 4
    sample_rows: int = 64
    driver_rows: int = 1 << 16
    seed: int = 7


BLOCK = 1 << 13


def _unit(lists: pa.Array | pa.ChunkedArray, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Normalised rows as float32, and which rows are usable (others are all zero); all lists have ``dims`` values.

    Norms are taken in double precision, block by block, so that only the result is held whole.
    """
    out, good, at = np.zeros((len(lists), dims), np.float32), np.zeros(len(lists), bool), 0
    for chunk in lists.chunks if isinstance(lists, pa.ChunkedArray) else [lists]:
        values = chunk.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
        for lo in range(0, len(values), BLOCK):
            x = values[lo : lo + BLOCK].astype(np.float64)
            norm = np.sqrt(np.einsum("ij,ij->i", x, x))
            ok = np.isfinite(norm) & (norm > 0)
            rows = slice(at + lo, at + lo + len(x))
            good[rows] = ok
            out[rows][ok] = x[ok] / norm[ok, None]
        at += len(values)
    return out, good


def _blocks(rows: np.ndarray, take: np.ndarray):
    """Selected rows, a block at a time."""
    for lo in range(0, len(take), BLOCK):
        yield rows[take[lo : lo + BLOCK]]


def _identities(rows: np.ndarray) -> np.ndarray:
    """128-bit hashes of rows rounded to six digits: equal vectors have equal hashes."""
    odd = np.random.default_rng(11).integers(1, 1 << 63, (rows.shape[1], 2), np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.empty((len(rows), 2), np.uint64)
    for lo in range(0, len(rows), BLOCK):
        words = np.ascontiguousarray(np.round(rows[lo : lo + BLOCK], 6) + np.float32(0)).view(np.uint32).astype(np.uint64)
        mixed = (words ^ (words >> np.uint64(15))) * np.uint64(0x9E3779B97F4A7C15)
        for h in range(2):
            out[lo : lo + BLOCK, h] = ((mixed ^ (mixed >> np.uint64(29))) * odd[:, h]).sum(axis=1, dtype=np.uint64)
    return out.view(np.dtype((np.void, 16))).ravel()


def _exact(rows: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of pairs of rows in double precision."""
    out = np.empty(len(a))
    for lo in range(0, len(a), BLOCK):
        x, y = (rows[i[lo : lo + BLOCK]].astype(np.float64) for i in (a, b))
        out[lo : lo + BLOCK] = np.einsum("ij,ij->i", x, y) / np.sqrt(np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", y, y))
    return np.minimum(out, 1.0)


class Tree:
    """Projection tree of fixed depth: node i of a level has the children 2i and 2i+1 of the next."""

    def __init__(self, directions: np.ndarray, cuts: list[np.ndarray]):
        self.directions, self.cuts, self.depth = directions, cuts, len(cuts)

    @classmethod
    def fit(cls, rows: np.ndarray, take: np.ndarray, depth: int, rng: np.random.Generator) -> tuple["Tree", np.ndarray]:
        """The tree over the selected rows, and the leaf of each of them."""
        directions = rng.standard_normal((rows.shape[1], depth)).astype(np.float32)
        directions /= np.linalg.norm(directions, axis=0, keepdims=True)
        at = np.concatenate([x @ directions for x in _blocks(rows, take)]) if len(take) else np.zeros((0, depth), np.float32)
        node, cuts = np.zeros(len(take), np.int64), []
        for level in range(depth):
            p = at[:, level]
            order = np.lexsort((p, node))
            bounds = np.searchsorted(node[order], np.arange((1 << level) + 1))
            size = np.diff(bounds)
            middle = np.clip(bounds[:-1] + size // 2, 0, max(0, len(take) - 1))
            before = np.clip(middle - 1, 0, None)
            sorted_p = p[order]
            cut = np.where(size > 1, (sorted_p[middle] + sorted_p[before]) / 2, 0.0).astype(np.float32)
            cuts.append(cut)
            node = 2 * node + (p > cut[node])
        return cls(directions, cuts), node


def best_leaves(trees: list[Tree], queries: np.ndarray, probes: int) -> np.ndarray:
    """[query, probe] -> tree * leaves + leaf, -1 where a query has no further leaf; all trees share each query's queue."""
    n, depth = len(queries), trees[0].depth
    leaves = 1 << depth
    if depth == 0:
        return np.zeros((n, 1), np.int64)
    at = np.stack([queries @ t.directions for t in trees], axis=1)  # query, tree, level
    cuts = np.stack([np.concatenate(t.cuts) for t in trees])  # node i of level l stands at 2^l - 1 + i
    probes = min(probes, leaves * len(trees))
    room = len(trees) + probes * depth
    priority = np.full((n, room), -np.inf, np.float32)
    where = np.zeros((n, room, 3), np.int32)  # tree, level, node
    priority[:, : len(trees)] = np.inf
    where[:, : len(trees), 0] = np.arange(len(trees))
    used, rows = len(trees), np.arange(n)
    found = np.full((n, probes), -1, np.int64)
    for probe in range(probes):
        pick = np.argmax(priority[:, :used], axis=1)
        near = priority[rows, pick]
        priority[rows, pick] = -np.inf
        tree, level, node = where[rows, pick].T.astype(np.int64)
        alive = near > -np.inf
        for step in range(depth):
            go = alive & (level <= step)
            side = at[rows, tree, step] - cuts[tree, (1 << step) - 1 + np.where(go, node, 0)]
            right = side > 0
            priority[:, used] = np.where(go, np.minimum(near, -np.abs(side)), -np.inf)
            where[:, used, 0], where[:, used, 1], where[:, used, 2] = tree, step + 1, 2 * node + ~right
            node = np.where(go, 2 * node + right, node)
            used += 1
        found[:, probe] = np.where(alive, tree * leaves + node, -1)
        if used > 4 * depth + 64:  # drop spent places: a queue never needs more than the probes that remain
            keep = min(used, probes - probe)
            best = np.argpartition(-priority[:, :used], keep - 1, axis=1)[:, :keep]
            priority[:, :keep] = np.take_along_axis(priority[:, :used], best, axis=1)
            where[:, :keep] = np.take_along_axis(where[:, :used], best[:, :, None], axis=1)
            used = keep
    return found


def _top(q: np.ndarray, m: np.ndarray, cosine: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the first k of each query by (cosine desc, id), each (query, member) once."""
    order = np.lexsort((ids[m], -cosine, q))
    q, m = q[order], m[order]
    pair = q * (int(m.max()) + 1 if len(m) else 1) + m
    first = np.zeros(len(pair), bool)
    first[np.unique(pair, return_index=True)[1]] = True
    order, q = order[first], q[first]
    rank = np.arange(len(q)) - np.searchsorted(q, q)
    return order[rank < k]


def search_shard(ids: np.ndarray, rows: np.ndarray, member: np.ndarray, asks: np.ndarray, s: Search):
    """Yield (query_id, neighbour_id, cosine) arrays of one shard. member: rows of the shard; asks: rows to look up."""
    # row: one of the rows of each distinct vector; rows are only ever read through it, so they are held once
    _, row, copy_of = np.unique(_identities(rows), return_index=True, return_inverse=True)
    copy_of = copy_of.ravel()

    # members of each distinct vector, ids ascending; each id once; beyond k+1 none can be among the first k
    order = np.lexsort((ids, copy_of))
    order = order[member[order]]
    fresh = np.ones(len(order), bool)
    fresh[1:] = (copy_of[order][1:] != copy_of[order][:-1]) | (ids[order][1:] != ids[order][:-1])
    order = order[fresh]
    owner = copy_of[order]
    place = np.arange(len(order)) - np.searchsorted(owner, owner)
    order, owner = order[place <= s.k], owner[place <= s.k]
    start = np.searchsorted(owner, np.arange(len(row) + 1))
    size = np.diff(start)

    stored = np.flatnonzero(size > 0)
    asked = np.unique(copy_of[asks])
    if not len(stored) or not len(asked):
        return
    lowest = ids[order[np.minimum(start[:-1], len(order) - 1)]]
    depth = max(0, math.ceil(math.log2(len(stored) / s.leaf_rows))) if len(stored) > s.leaf_rows else 0
    rng = np.random.default_rng(s.seed)
    fitted = [Tree.fit(rows, row[stored], depth, rng) for _ in range(s.trees if depth else 1)]
    trees = [t for t, _ in fitted]
    leaf_of = np.concatenate([leaf + i * (1 << depth) for i, (_, leaf) in enumerate(fitted)])
    by_leaf = np.argsort(leaf_of, kind="stable")
    leaf_start = np.searchsorted(leaf_of[by_leaf], np.arange(len(trees) * (1 << depth) + 1))
    by_leaf = stored[by_leaf % len(stored)]

    ask_order = np.flatnonzero(asks)
    ask_order = ask_order[np.argsort(copy_of[ask_order], kind="stable")]
    ask_owner = copy_of[ask_order]
    block = 1 << 15
    for lo in range(0, len(asked), block):
        part = asked[lo : lo + block]
        visits = np.concatenate([best_leaves(trees, rows[row[part[i : i + 2048]]], s.probes) for i in range(0, len(part), 2048)])
        who, slot = np.nonzero(visits >= 0)
        leaf = visits[who, slot]
        order_v = np.argsort(leaf, kind="stable")
        who, leaf = who[order_v], leaf[order_v]
        cut = np.flatnonzero(np.diff(leaf)) + 1
        qs, ms, cs = [], [], []
        for a, b in zip(np.r_[0, cut], np.r_[cut, len(leaf)]):
            members = by_leaf[leaf_start[leaf[a]] : leaf_start[leaf[a] + 1]]
            if not len(members):
                continue
            scores = rows[row[part[who[a:b]]]] @ rows[row[members]].T
            if s.min_cosine is not None:
                i, j = np.nonzero(scores >= s.min_cosine - 1e-5)
            else:
                take = min(s.k + 1, len(members))
                j = np.argpartition(-scores, take - 1, axis=1)[:, :take].ravel()
                i = np.repeat(np.arange(b - a), take)
            qs.append(who[a:b][i])
            ms.append(members[j])
            cs.append(scores[i, j])
        if not qs:
            continue
        q, m, c = np.concatenate(qs), np.concatenate(ms), np.concatenate(cs)
        # the vector's own copies are its first neighbours if there are any; one place more, for itself
        keep = _top(q, m, c, lowest, s.k + 1)
        q, m = part[q[keep]], m[keep]
        c = _exact(rows, row[q], row[m])
        c[q == m] = 1.0
        if s.min_cosine is not None:
            near = c >= s.min_cosine
            q, m, c = q[near], m[near], c[near]
        # from distinct vectors to ids: every id that asks, times the members of the neighbour
        a0, a1 = np.searchsorted(ask_owner, q), np.searchsorted(ask_owner, q, side="right")
        reps = a1 - a0
        q_row = ask_order[np.repeat(a0, reps) + _within(reps)]
        m_rep, c_rep = np.repeat(m, reps), np.repeat(c, reps)
        many = size[m_rep]
        n_row = order[np.repeat(start[m_rep], many) + _within(many)]
        q_id, n_id, c_all = np.repeat(ids[q_row], many), ids[n_row], np.repeat(c_rep, many)
        other = q_id != n_id
        q_id, n_id, c_all = q_id[other], n_id[other], c_all[other]
        # an id that asks with several rows has each neighbour once, with its best cosine
        once = np.lexsort((-c_all, n_id, q_id))
        once = once[np.r_[True, (np.diff(q_id[once]) != 0) | (np.diff(n_id[once]) != 0)]] if len(once) else once
        q_id, n_id, c_all = q_id[once], n_id[once], c_all[once]
        rank = np.lexsort((n_id, -c_all, q_id))
        q_id, n_id, c_all = q_id[rank], n_id[rank], c_all[rank]
        first_k = np.arange(len(q_id)) - np.searchsorted(q_id, q_id) < s.k
        yield q_id[first_k], n_id[first_k], c_all[first_k]


def _within(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each count c, one after the other."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def usable_vectors(vectors: DataFrame, fields: DataFrame) -> DataFrame:
    """(field_key, dims, query_id, query_vector) of the rows whose length is that of their field.

    Whether values are finite and not all zero is seen to where they are first read as an array.
    """
    known = fields.where("vector_dimensions > 0").groupBy("index_name", "field_name").agg(F.max("vector_dimensions").alias("dims"))
    named = known.select("index_name", "field_name", "dims", F.concat_ws("\u001f", "index_name", "field_name").alias("field_key"))
    rows = vectors.select("index_name", "field_name", "query_id", "query_vector").where("query_id is not null")
    return rows.join(named, ["index_name", "field_name"]).where(F.size("query_vector") == F.col("dims")).select("field_key", "dims", "query_id", "query_vector")


#: The trees of all fields must fit into this many bytes, as every executor gets them.
TREES_BYTES = 1 << 29


def _node_of(tree: Tree, unit: np.ndarray, levels: int) -> np.ndarray:
    at, node = unit @ tree.directions, np.zeros(len(unit), np.int64)
    for level in range(levels):
        node = 2 * node + (at[:, level] > tree.cuts[level][node])
    return node


def _routing_tree(rows: DataFrame, n: int, dims: int, depth: int, s: Search) -> Tree:
    """The routing tree of one field's (query_vector) rows."""
    spark, rng = rows.sparkSession, np.random.default_rng(s.seed + 1)
    near = min(depth, max(1, int(math.log2(max(2, s.driver_rows // s.sample_rows)))))
    want = s.sample_rows << near
    sample = rows.sample(min(1.0, 1.2 * want / n), seed=s.seed).select("query_vector").limit(2 * want).toArrow()
    unit, good = _unit(sample.column(0), dims)
    tree, _ = Tree.fit(unit, np.flatnonzero(good), near, rng)
    if near == depth:
        return tree
    more = rng.standard_normal((dims, depth - near)).astype(np.float32)
    tree = Tree(np.concatenate([tree.directions, more / np.linalg.norm(more, axis=0, keepdims=True)], axis=1), tree.cuts)
    spread = written(rows.sample(min(1.0, 1.2 * (s.sample_rows << depth) / n), seed=s.seed + 2).select("query_vector"), "routing-sample")
    for level in range(near, depth):
        known = spark.sparkContext.broadcast(tree)

        def project(batches, level=level, known=known):
            for batch in batches:
                unit, good = _unit(batch.column(0), dims)
                unit, t = unit[good], known.value
                yield pa.RecordBatch.from_arrays([pa.array(_node_of(t, unit, level)), pa.array((unit @ t.directions[:, level]).astype(np.float64))], names=["node", "at"])

        # one number for each cell of the level: no more than there are shards
        cuts = spread.mapInArrow(project, "node long, at double").groupBy("node").agg(F.percentile_approx("at", 0.5, 1000).alias("cut")).collect()
        cut = np.zeros(1 << level, np.float32)
        for r in cuts:
            cut[r.node] = r.cut
        tree = Tree(tree.directions, [*tree.cuts, cut])
        known.unpersist()
    return tree


def _spread(spark, weights: list[float], partitions: int) -> list[int]:
    """A key for each shard such that hashing puts the shards into ``partitions`` tasks, heavy ones apart.

    Where there are thousands of shards, chance spreads them as well, and a shard's number is its key.
    """
    if partitions > 1 << 12:
        return list(range(len(weights)))
    keys: dict[int, list[int]] = {}
    for r in spark.range(64 * partitions).selectExpr("cast(id as int) as k", f"pmod(hash(cast(id as int)), {partitions}) as p").collect():
        keys.setdefault(r.p, []).append(r.k)
    out, heap = [0] * len(weights), [(0.0, p) for p in sorted(keys)]
    for i in sorted(range(len(weights)), key=lambda i: -weights[i]):
        load, p = heapq.heappop(heap)
        out[i] = keys[p].pop()
        if keys[p]:
            heapq.heappush(heap, (load + weights[i], p))
    return out


def _identified(rows: DataFrame) -> DataFrame:
    """The usable rows with rid, a 64-bit identity of field and vector that equal vectors of a field share."""

    def identify(batches):
        for batch in batches:
            dims = batch.column("dims").to_numpy()
            for d in np.unique(dims):
                mine = batch.filter(pa.array(dims == d))
                unit, good = _unit(mine.column("query_vector"), int(d))
                mine = mine.filter(pa.array(good))
                if not mine.num_rows:
                    continue
                h = _identities(unit[good]).view(np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([*mine.columns, pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy())], names=[*mine.schema.names, "h1", "h2"])

    schema = "field_key string, dims int, query_id long, query_vector array<float>, asks boolean, h1 long, h2 long"
    hashed = rows.select("field_key", F.col("dims").cast("int").alias("dims"), "query_id", "query_vector", "asks").mapInArrow(identify, schema)
    return written(hashed.withColumn("rid", F.xxhash64("field_key", "h1", "h2")).drop("h1", "h2"), "identified")


def links(vectors: DataFrame, fields: DataFrame, s: Search, asks_sql: str = "true") -> DataFrame:
    """(query_id, neighbour_id, cosine, rank): the first k neighbours of every vector for which asks_sql holds.

    Empty tables, and tables without a usable vector, give no rows.
    """
    spark = vectors.sparkSession
    rows = usable_vectors(vectors, fields).withColumn("asks", F.expr(asks_sql))
    # fields come from the catalogue, so there are few
    sizes = {r.field_key: (r.dims, r.n) for r in rows.groupBy("field_key", "dims").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return spark.createDataFrame([], LINK + ", rank int")
    large = [k for k, (d, n) in sizes.items() if n * d > s.shard_values]
    small = {k: v for k, v in sizes.items() if k not in large}
    found = []
    if small:
        keys = list(small)
        slots = _spread(spark, [small[k][1] for k in keys], len(keys))
        slot_of = F.create_map(*[F.lit(x) for kv in zip(keys, slots) for x in kv])
        flat = rows.where(F.col("field_key").isin(keys)).select(slot_of[F.col("field_key")].alias("shard"), "dims", "query_id", F.lit(True).alias("home"), "asks", "query_vector")
        found.append(_search(flat, len(keys), s))
    if large:
        found.append(_large_fields(rows.where(F.col("field_key").isin(large)), large, s))
    best = reduce(DataFrame.unionByName, found).groupBy("query_id", "neighbour_id").agg(F.max("cosine").alias("cosine"))
    # a window holds at most k links for each shard that a query was looked up in
    rank = F.expr("row_number() over (partition by query_id order by cosine desc, neighbour_id)")
    return best.withColumn("rank", rank).where(F.col("rank") <= s.k)


def _search(flat: DataFrame, shards: int, s: Search) -> DataFrame:
    def look_up(table: pa.Table) -> pa.Table:
        dims = table.column("dims")[0].as_py()
        unit, good = _unit(table.column("query_vector"), dims)
        ids, home, asks = (table.column(c).to_numpy() for c in ("query_id", "home", "asks"))
        found = list(search_shard(ids, unit, home & good, asks & good, s))
        parts = zip(*found) if found else ([], [], [])
        return pa.Table.from_arrays([pa.array(np.concatenate(p) if len(p) else [], t) for p, t in zip(parts, _LINK.types)], schema=_LINK)

    return flat.repartition(shards, "shard").groupBy("shard").applyInArrow(look_up, LINK)


def _large_fields(rows: DataFrame, keys: list[str], s: Search) -> DataFrame:
    """(query_id, neighbour_id, cosine) of fields that take several shards, a few more than the first k of each vector."""
    spark = rows.sparkSession
    identified = _identified(rows)
    vectors = identified.groupBy("field_key", "dims", "rid").agg(F.first("query_vector").alias("query_vector"), F.max("asks").alias("asks"))
    vectors = written(vectors, "distinct-vectors")
    sizes = {r.field_key: (r.dims, r.n) for r in vectors.groupBy("field_key", "dims").agg(F.count("*").alias("n")).collect()}
    trees, first, weights = {}, {}, []
    for key, (dims, n) in sizes.items():
        depth = max(0, math.ceil(math.log2(n * dims / s.shard_values)))
        trees[key] = _routing_tree(vectors.where(F.col("field_key") == key), n, dims, depth, s) if depth else None
        first[key] = len(weights)
        weights += [n / (1 << depth)] * (1 << depth)
    size = sum(t.directions.nbytes + sum(c.nbytes for c in t.cuts) for t in trees.values() if t)
    if size > TREES_BYTES:
        raise ValueError(f"routing trees of {size} bytes; larger shards (shard_values) make smaller trees")
    shared = spark.sparkContext.broadcast((trees, first, np.array(_spread(spark, weights, len(weights)), np.int32), {k: d for k, (d, _) in sizes.items()}))

    def route(batches):
        trees, first, slots, dims_of = shared.value
        for batch in batches:
            keys = batch.column("field_key").to_numpy(zero_copy_only=False)
            for key in np.unique(keys):
                tree, mine = trees[key], batch.filter(pa.array(keys == key))
                unit, _ = _unit(mine.column("query_vector"), dims_of[key])
                asks, leaves = mine.column("asks").to_numpy(zero_copy_only=False), 1 << tree.depth if tree else 1
                if tree is None:
                    to = np.zeros((len(unit), 1), np.int64)
                elif s.routes is None or s.routes >= leaves:  # every shard, from the own one on; no queue is needed
                    to = (best_leaves([tree], unit, 1) + np.arange(leaves)) % leaves
                else:
                    to = best_leaves([tree], unit, s.routes)
                for r in range(to.shape[1]):
                    sent = mine if r == 0 else mine.filter(pa.array(asks))
                    leaf = to[:, r] if r == 0 else to[asks, r]
                    n = len(leaf)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(slots[first[key] + leaf]), pa.array(np.full(n, dims_of[key], np.int32)), sent.column("rid"), pa.array(np.full(n, r == 0)), sent.column("asks"), sent.column("query_vector")],
                        names=["shard", "dims", "query_id", "home", "asks", "query_vector"],
                    )

    flat = vectors.select("field_key", "rid", "asks", "query_vector").mapInArrow(route, "shard int, dims int, query_id long, home boolean, asks boolean, query_vector array<float>")
    near = _search(flat, len(weights), s).groupBy("query_id", "neighbour_id").agg(F.max("cosine").alias("cosine"))
    # back from distinct vectors to ids: the k+1 lowest ids of each, itself being its own first neighbour
    lowest = identified.select("rid", "query_id").distinct().withColumn("place", F.expr("row_number() over (partition by rid order by query_id)")).where(F.col("place") <= s.k + 1).drop("place")
    asking = identified.where("asks").select("query_id", "rid").distinct()
    own = asking.select(F.col("rid").alias("query_rid")).distinct().withColumn("neighbour_rid", F.col("query_rid")).withColumn("cosine", F.lit(1.0))
    pairs = near.select(F.col("query_id").alias("query_rid"), F.col("neighbour_id").alias("neighbour_rid"), "cosine").unionByName(own)
    members = pairs.join(lowest.select(F.col("rid").alias("neighbour_rid"), F.col("query_id").alias("neighbour_id")), "neighbour_rid")
    # one list of k+1 for each distinct vector; an id takes those that aren't itself
    place = F.expr("row_number() over (partition by query_rid order by cosine desc, neighbour_id)")
    lists = members.withColumn("place", place).where(F.col("place") <= s.k + 1).groupBy("query_rid").agg(F.collect_list(F.struct("cosine", "neighbour_id")).alias("near"))
    out = asking.join(lists, asking.rid == lists.query_rid).select("query_id", F.explode("near").alias("n"))
    return out.where("n.neighbour_id <> query_id").select("query_id", F.col("n.neighbour_id").alias("neighbour_id"), F.col("n.cosine").alias("cosine"))


def similar_pairs(vectors: DataFrame, fields: DataFrame, s: Search) -> DataFrame:
    """(query_id_a, query_id_b), a < b, where one is among the other's k most similar and their cosine reaches min_cosine."""
    found = links(vectors, fields, s)
    a, b = F.least("query_id", "neighbour_id"), F.greatest("query_id", "neighbour_id")
    return found.select(a.alias("query_id_a"), b.alias("query_id_b")).distinct()
