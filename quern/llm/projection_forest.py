"""Near-duplicate vectors by a forest of random-projection trees.

Each tree splits the vectors of one label again and again: by their projection on a random direction, at a place where few
vectors lie; those near the border go to both sides (spill). Leaves are compared exactly, by cosine in double precision;
pairs found in any tree are united, and each counts once. Equal vectors are one member with a multiplicity.

The splits of a node are found on a bounded sample of its members, by hash, several levels at once; then all of its members
are sent down in one pass. Leaves that are still large are split in the next round: each round divides a node by up to
SAMPLE / LEAST_SAMPLE, so there are as many rounds as that number fits into the logarithm of the largest label (one up to
some 50 000 vectors, two up to 6 million, three up to 800 million). A leaf that no direction can split, since most of
its members lie near every border, is compared whole, in blocks: its members are near copies of each other.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, rows_of, store

COSINE = 0.98
#: Trees; members of a leaf that are few enough to compare; members of one side of a block.
TREES, LEAF, BLOCK = 4, 400, 1000
#: Members of a node that its splits are found on, about; of those a node that is split further must have so many.
SAMPLE, LEAST_SAMPLE = 4096, 32
#: A border's spill to either side, in units of the largest distance of a link over the root of the dimension. Where two such
#: vectors are parted by one split in about 1 of 80 cases, 4 trees of 10 splits lose about 1 pair of 5000.
SPILL = 0.5
#: A split that would send more than this share of its members to both sides isn't made; directions that are tried.
MOST_SPILLED, TRIES = 0.3, 4

_MEMBERS = "vec_id bigint, label bigint, dim int, member binary, raw binary"
_MEMBER = pa.schema([("vec_id", pa.int64()), ("label", pa.int64()), ("dim", pa.int32()), ("member", pa.binary()), ("raw", pa.binary())])


def unit(raws: pd.Series | list[bytes]) -> np.ndarray:
    """Rows of length 1 of vectors of one dimension, as doubles."""
    x = np.stack([np.frombuffer(r[1:], "<f4" if r[:1] == b"f" else "<f8") for r in raws]).astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def members(vectors: DataFrame) -> DataFrame:
    """One row for each vector: member (a hash of its label and values; null if it can link with nothing) and raw (a letter for their type, and the values)."""
    single = dict(vectors.dtypes)["embedding"] == "array<float>"
    kind, dtype = (b"f", "<f4") if single else (b"d", "<f8")

    def of(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            ids, labels, e = (part.column(i) for i in range(3))
            values = e.values.to_numpy(zero_copy_only=False).astype(dtype)  # null becomes nan
            ends, has = e.offsets.to_numpy(), e.is_valid().to_numpy(zero_copy_only=False) & labels.is_valid().to_numpy(zero_copy_only=False)
            dims, member, raw = [], [], []
            for i, label in enumerate(labels.to_pylist()):
                x = values[ends[i] : ends[i + 1]]
                if has[i] and len(x) and np.isfinite(x).all() and x.any():
                    r = kind + x.tobytes()
                    dims.append(len(x))
                    member.append(xxhash.xxh3_128_digest(b"%d:%s" % (label, r)))
                    raw.append(r)
                else:
                    dims.append(0)
                    member.append(None)
                    raw.append(None)
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), labels.cast(pa.int64()), pa.array(dims, pa.int32()), pa.array(member, pa.binary()), pa.array(raw, pa.binary())], schema=_MEMBER)

    return vectors.select("vec_id", "label", F.col("embedding").cast("array<float>" if single else "array<double>").alias("embedding")).mapInArrow(of, _MEMBERS)


def direction(seed: int, dim: int) -> np.ndarray:
    d = np.random.default_rng([seed & 0xFFFFFFFF, seed >> 32 & 0xFFFFFFFF, dim]).standard_normal(dim)
    return d / np.linalg.norm(d)


def child(node: int, side: int) -> int:
    return xxhash.xxh3_64_intdigest(node.to_bytes(8, "little") + bytes([side]))


def spill(dim: int) -> float:
    return SPILL * float(np.sqrt((2 - 2 * COSINE) / dim))


def border(p: np.ndarray, delta: float) -> tuple[float, int]:
    """(share of projections within delta of the border, border) of the best place among the middle ranks."""
    p = np.sort(p)
    at = p[np.unique(np.linspace(len(p) // 4, len(p) - 1 - len(p) // 4, 33).astype(int))]
    spilled = np.searchsorted(p, at + delta, "right") - np.searchsorted(p, at - delta)
    best = np.lexsort((np.abs(np.arange(len(at)) - len(at) // 2), spilled))[0]
    return spilled[best] / len(p), float(at[best])


_SPLIT = struct.Struct("<Bd")
_LEAF, _STUCK = 255, 254


def grow(x: np.ndarray, node: int, n: int, leaf: int) -> bytes:
    """A tree below a node of n members, of which x is a sample: in depth-first order the number of a direction and a border for each split, and ends."""
    out, todo, delta = [], [(node, np.arange(len(x)))], spill(x.shape[1])
    while todo:
        here, idx = todo.pop()
        if len(idx) * n <= leaf * len(x) or len(idx) < min(LEAST_SAMPLE, leaf + 1):
            out.append(bytes([_LEAF]))
            continue
        found = []
        for t in range(TRIES):
            found.append((*border(x[idx] @ direction(child(here, 2 + t), x.shape[1]), delta), t))
            if found[-1][0] <= MOST_SPILLED / 2:
                break
        share, at, t = min(found)
        if share > MOST_SPILLED:
            out.append(bytes([_STUCK]))
            continue
        out.append(_SPLIT.pack(t, at))
        p = x[idx] @ direction(child(here, 2 + t), x.shape[1])
        todo += [(child(here, 1), idx[p >= at - delta]), (child(here, 0), idx[p < at + delta])]
    return b"".join(out)


class Tree:
    """A tree made by grow(), with its directions."""

    def __init__(self, node: int, packed: bytes, dim: int):
        self.delta, self.nodes, places, at = spill(dim), [], [node], 0
        borders, ways = [], []
        while places:
            here = places.pop()
            if packed[at] >= _STUCK:
                self.nodes.append((here, packed[at] == _STUCK, -1))
                at += 1
                continue
            t, border_at = _SPLIT.unpack_from(packed, at)
            at += _SPLIT.size
            self.nodes.append((here, False, len(borders)))
            borders.append(border_at)
            ways.append(direction(child(here, 2 + t), dim))
            places += [child(here, 1), child(here, 0)]
        self.borders, self.ways = borders, np.stack(ways) if ways else np.zeros((0, dim))

    def leaves(self, x: np.ndarray) -> Iterator[tuple[int, np.ndarray, bool]]:
        """(leaf, rows of x in it, whether it is stuck)."""
        p = x @ self.ways.T
        held = [np.arange(len(x))]
        for place, stuck, split in self.nodes:
            idx = held.pop()
            if split < 0:
                if len(idx):
                    yield place, idx, stuck
                continue
            q, at = p[idx, split], self.borders[split]
            held += [idx[q >= at - self.delta], idx[q < at + self.delta]]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


_PLACED = pa.schema([("member", pa.binary()), ("leaf", pa.int64()), ("stuck", pa.bool_())])
#: Rows, bytes of vectors and of directions that a task holds at once, about.
ROUTE_ROWS, ROUTE_BYTES = 8192, 1 << 25


def route(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sends rows (member, raw, node, tree) down their trees."""
    known: dict[int, Tree] = {}

    def placed(rows: list[dict]) -> pa.RecordBatch:
        by_node: dict[int, list[dict]] = {}
        for r in rows:
            by_node.setdefault(r["node"], []).append(r)
        members, places, stuck_ones = [], [], []
        for node, own in by_node.items():
            x = unit([r["raw"] for r in own])
            if node not in known:
                if sum(t.ways.nbytes for t in known.values()) > ROUTE_BYTES:
                    known.clear()
                known[node] = Tree(node & (1 << 64) - 1, own[0]["tree"], x.shape[1])
            for place, idx, stuck in known[node].leaves(x):
                members += [own[i]["member"] for i in idx]
                places += [_signed(place)] * len(idx)
                stuck_ones += [stuck] * len(idx)
        return pa.RecordBatch.from_arrays([pa.array(members, pa.binary()), pa.array(places, pa.int64()), pa.array(stuck_ones, pa.bool_())], schema=_PLACED)

    rows, size = [], 0
    for some in rows_of(parts):
        rows += some
        size += sum(len(r["raw"]) for r in some)
        if len(rows) >= ROUTE_ROWS or size >= ROUTE_BYTES:
            yield placed(rows)
            rows, size = [], 0
    if rows:
        yield placed(rows)


def leaves(own: DataFrame, leaf: int = LEAF) -> DataFrame:
    """(member, leaf) of every tree, from members (member, label, dim, raw); a member is in one leaf of each tree or more."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("member")
        node, n = int(pdf["node"].iloc[0]), int(pdf["n"].iloc[0])
        tree = grow(unit(pdf["raw"]), node & (1 << 64) - 1, n, leaf)
        # A node whose sample asks for no split ends here, as a stuck one does.
        return pd.DataFrame({"node": [node], "tree": [tree if tree != bytes([_LEAF]) else bytes([_STUCK])]})

    # All trees begin with the whole of a label and a dimension; a node's number is a hash of the way to it.
    trees = F.explode(F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.xxhash64(t, "label", "dim"))).alias("node")
    start = own.select("member", "label", "dim").groupBy("label", "dim").agg(F.count("*").alias("n")).select("label", "dim", "n", trees)
    sizes = store(start, "nodes")
    rows = own.join(sizes.select("label", "dim", "node"), ["label", "dim"]).select("member", "raw", "node")
    done = rows.join(sizes.where(F.col("n") <= leaf).select("node"), "node", "left_semi").select("member", F.col("node").alias("leaf"))
    sizes = sizes.where(F.col("n") > leaf).select("node", "n")
    out = [done]
    while not sizes.isEmpty():
        big = rows.join(sizes, "node")
        # By hash, so a node's sample is the same in every run; about SAMPLE members whatever the size of the node.
        some = big.where(F.pmod(F.xxhash64("member", "node"), F.lit(1 << 30)) * F.col("n") < F.lit(float(SAMPLE << 30)))
        fitted = store(some.groupBy("node").applyInPandas(lambda pdf: fit(pdf), "node bigint, tree binary"), "trees")
        placed = store(rows.join(fitted, "node").select("member", "raw", "node", "tree").mapInArrow(route, "member binary, leaf bigint, stuck boolean"), "placed")
        sizes = store(placed.groupBy("leaf").agg(F.count("*").alias("n"), F.max("stuck").alias("stuck")).where(~F.col("stuck") & (F.col("n") > 2 * leaf)).select(F.col("leaf").alias("node"), "n"), "nodes")
        out.append(placed.join(sizes.select(F.col("node").alias("leaf")), "leaf", "left_anti").select("member", "leaf"))
        rows = placed.join(sizes.select(F.col("node").alias("leaf")), "leaf", "left_semi").select("member", F.col("leaf").alias("node")).join(own.select("member", "raw"), "member").select("member", "raw", "node")
    held = out[0]
    for more in out[1:]:
        held = held.unionByName(more)
    return store(held, "leaves")


def block_links(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links within one block of a leaf (member, copies, side, leaf, others, raw): (a, null, n) adds n to the links of a; (a, b, 0) joins a and b.

    A pair counts here only if no leaf with a smaller number holds both.
    """
    pdf = pdf.sort_values("member").reset_index(drop=True)
    x = unit(pdf["raw"])
    side, copies, here = pdf["side"].to_numpy(), pdf["copies"].to_numpy(np.int64), int(pdf["leaf"].iloc[0])
    left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)  # side 2: a block with itself
    linked = x[left] @ x[right].T >= COSINE
    earlier = [[o for o in map(int, others) if o < here] for others in pdf["others"]]
    numbers = {o: i for i, o in enumerate(sorted({o for e in earlier for o in e}))}
    if numbers and linked.any():
        met = np.zeros((len(pdf), len(numbers)), np.float32)
        for i, e in enumerate(earlier):
            met[i, [numbers[o] for o in e]] = 1
        linked &= met[left] @ met[right].T == 0
    linked &= left[:, None] != right[None, :]
    n = np.zeros(len(pdf), np.int64)
    np.add.at(n, left, linked @ copies[right])
    if side[0] != 2:
        np.add.at(n, right, linked.T @ copies[left])
    # A forest that joins what the links join: breadth first over the block's rows.
    names, edges, todo = pdf["member"], [], set(np.flatnonzero(linked.any(1)).tolist())
    seen_l, seen_r = np.zeros(len(left), bool), np.zeros(len(right), bool)
    place_l = {int(v): i for i, v in enumerate(left)}
    while todo:
        i = todo.pop()
        seen_l[i] = True
        queue = [i]
        while queue:
            i = queue.pop()
            for j in np.flatnonzero(linked[i] & ~seen_r):
                seen_r[j] = True
                edges.append((names[left[i]], names[right[j]], 0))
                new = set(np.flatnonzero(linked[:, j] & ~seen_l).tolist())
                if (k := place_l.get(int(right[j]))) is not None and not seen_l[k]:
                    new.add(k)
                for k in new:
                    if linked[k, j]:
                        edges.append((names[left[k]], names[right[j]], 0))
                    seen_l[k] = True
                    todo.discard(k)
                    queue.append(k)
    rows = [(names[i], None, int(n[i])) for i in np.flatnonzero(n)]
    return pd.DataFrame(rows + edges, columns=["a", "b", "n"])


def links(vectors: DataFrame, leaf: int = LEAF) -> DataFrame:
    """vec_id, n_links, component_id and kept, one row for each row of vectors.

    Links only within one label and one dimension. Vectors that are null, zero or hold null or non-finite components, and
    those without a label, link with nothing: 0 links, their own component. A row without vec_id takes part, gets the
    component of its links (null if there is none) and isn't kept. Repeated rows are vectors of their own, linked with each
    other; an empty table gives none; extra columns are left out.
    """
    rows = store(members(vectors), "vectors")
    distinct = rows.where("member is not null").groupBy("member").agg(F.count("*").alias("copies"), F.min("vec_id").alias("first"), F.first("label").alias("label"), F.first("dim").alias("dim"), F.first("raw").alias("raw"))
    distinct = store(distinct, "distinct")
    held = leaves(distinct, leaf)
    size = held.groupBy("leaf").agg(F.count("*").alias("n")).where("n > 1").select("leaf", F.ceil(F.col("n") / BLOCK).cast("int").alias("parts"))
    size = store(size, "sizes")
    others = held.groupBy("member").agg(F.collect_set("leaf").alias("others"))  # leaves of one member
    placed = held.join(size, "leaf").withColumn("own", F.pmod(F.xxhash64("member"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    placed = placed.select("leaf", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), side.alias("side"), "member")
    carried = store(distinct.select("member", "copies", "raw").join(others, "member"), "carried")
    found = placed.join(carried, "member").groupBy("leaf", "lo", "hi").applyInPandas(lambda pdf: block_links(pdf), "a binary, b binary, n bigint")
    found = store(found, "found")
    n = found.where("b is null").groupBy("a").agg(F.sum("n").alias("n"))
    comp = connected_components(found.where("b is not null").select("a", "b"))
    named = distinct.select("member", "copies", "first").join(n, F.col("member") == F.col("a"), "left").join(comp, F.col("member") == F.col("node"), "left")
    named = store(named.select("member", "first", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "member").alias("component")), "named")
    low = named.groupBy("component").agg(F.min("first").alias("lowest"))
    named = store(named.join(low, "component").select("member", "n_links", "lowest"), "named")
    # Rows that link with nothing stay out of the join: they have one key, null.
    out = rows.where("member is not null").select("vec_id", "member").join(named, "member").select("vec_id", "n_links", F.col("lowest").alias("component_id"))
    out = out.unionByName(rows.where("member is null").select("vec_id", F.lit(0).alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.select("vec_id", F.col("n_links").cast("bigint").alias("n_links"), "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, [CAST(x AS DOUBLE) FOR x IN embedding] AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([1 FOR x IN embedding IF x <> 0]) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.98),
r(n, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.n, l.b FROM r JOIN l ON r.c = l.a),
k AS (SELECT a, count(*) AS n FROM l GROUP BY a), c AS (SELECT n, min(c) AS c FROM r GROUP BY n)
SELECT vec_id, CAST(coalesce(k.n, 0) AS BIGINT) AS n_links, c.c AS component_id, vec_id = c.c AS kept
FROM embeddings LEFT JOIN k ON k.a = vec_id JOIN c ON c.n = vec_id
"""
