"""Problem 1: the most similar vectors of every vector, by a block matrix join of int8 tiles."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.plans.storage import staged, width


def usable(vectors: DataFrame, dim: int) -> DataFrame:
    """(id, embedding) of vectors with ``dim`` finite numbers that are not all zero; rows as stored."""
    e = F.col("embedding")
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    ok = F.col("chunk_rowid").isNotNull() & (F.size(e) == dim) & ~bad & F.exists(e, lambda x: x != 0)
    return vectors.filter(ok).select(F.col("chunk_rowid").cast("long").alias("id"), F.col("embedding").cast("array<float>").alias("embedding"))


def _squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (c * c).sum(1)[None] - 2 * (x @ c.T), 0)


def _closest(x: np.ndarray, c: np.ndarray, entries: int = 4_000_000) -> np.ndarray:
    """Index of each row's nearest centre; never more than ``entries`` distances at a time."""
    step = max(1, entries // len(c))
    return np.concatenate([_squared(x[at : at + step], c).argmin(1) for at in range(0, len(x), step)]) if len(x) else np.zeros(0, dtype=np.int64)


def fit_cells(sample: np.ndarray, cells: int, rounds: int = 6, seed: int = 1) -> np.ndarray:
    """Centres of at most ``cells`` cells: far-apart sample rows (each the best of four drawn by squared distance), then
    Lloyd's rounds.  Cells that no row is nearest to are left out."""
    rng = np.random.default_rng(seed)
    centres = np.empty((cells, sample.shape[1]), dtype=np.float32)
    centres[0] = sample[0]
    least = _squared(sample, centres[:1])[:, 0]
    for k in range(1, cells):
        total = np.cumsum(least, dtype=np.float64)
        if total[-1] <= 0:
            centres = centres[:k]
            break
        drawn = np.minimum(np.searchsorted(total, rng.random(4) * total[-1]), len(sample) - 1)
        with_it = np.minimum(_squared(sample, sample[drawn]), least[:, None])
        best = int(with_it.sum(0).argmin())
        centres[k], least = sample[drawn[best]], with_it[:, best]
    for _ in range(rounds):
        own = _closest(sample, centres)
        n = np.bincount(own, minlength=len(centres))
        order = np.argsort(own, kind="stable")
        sums = np.add.reduceat(sample[order], np.searchsorted(own[order], np.flatnonzero(n)), axis=0)
        centres = (sums / n[n > 0][:, None]).astype(np.float32)
    return centres


def _within(least: np.ndarray, reach: float) -> np.ndarray:
    """Squared distance beyond which no border with a centre can be in reach, of squared distances to the nearest."""
    return least * (1 + 2 * reach) ** 2 + 1e-9 if np.isfinite(reach) else np.full(len(least), np.inf)


@dataclass
class Tree:
    """Cells of cells: a node is near the vectors that come to it, a leaf belongs to a block of the join.

    ``parent`` of a top node is -1; ``block`` of an inner node is -1.  ``splits`` and ``slices`` of a leaf tell into how
    many parts its block's own and asking vectors are cut.
    """

    parent: np.ndarray
    centre: np.ndarray
    block: np.ndarray
    splits: np.ndarray
    slices: np.ndarray

    def __post_init__(self) -> None:
        order = np.argsort(self.parent, kind="stable")
        keys, at = np.unique(self.parent[order], return_index=True)
        self.children = dict(zip(keys.tolist(), np.split(order, at[1:])))

    def leaves(self, x: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of every row of ``x``: the nearest leaf first, then those whose border is near.

        On every level a row goes on to the nearest node and to every node from whose border with it the row is at most
        ``reach`` of its distance to the nearest centre away.  (What lies in another node lies behind that border.)
        """
        row, node = np.arange(len(x)), np.full(len(x), -1)
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(row):
            found = []
            order = np.argsort(node, kind="stable")
            row, node = row[order], node[order]
            cuts = np.flatnonzero(np.diff(node)) + 1
            for rows in np.split(np.arange(len(row)), cuts):
                kids = self.children[int(node[rows[0]])]
                step = max(1, 4_000_000 // len(kids))
                for lo in range(0, len(rows), step):
                    some = row[rows[lo : lo + step]]
                    d2 = _squared(x[some], self.centre[kids])
                    i, j = np.nonzero(d2 <= _within(d2.min(1), reach)[:, None])
                    found.append((some[i], kids[j], d2[i, j]))
            row, node, d2 = self._near(x, *(np.concatenate(f) for f in zip(*found)), reach)
            leaf = self.block[node] >= 0
            done.append((row[leaf], node[leaf], d2[leaf]))
            row, node = row[~leaf], node[~leaf]
        if not done:
            return row, node
        row, node, _ = self._near(x, *(np.concatenate(f) for f in zip(*done)), reach)
        return row, node

    def _near(self, x: np.ndarray, row: np.ndarray, node: np.ndarray, d2: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.lexsort((node, d2, row))
        row, node, d2 = row[order], node[order], d2[order]
        first = np.concatenate([[True], np.diff(row) != 0])
        own = np.flatnonzero(first)[np.cumsum(first) - 1]  # where each row's nearest node is
        least = d2[own]
        keep = d2 <= _within(least, reach)
        ask = np.flatnonzero(keep & ~first) if np.isfinite(reach) else []
        for lo in range(0, len(ask), 16_384):
            at = ask[lo : lo + 16_384]
            gap = np.linalg.norm(self.centre[node[at]] - self.centre[node[own[at]]], axis=1)
            keep[at] = d2[at] - least[at] <= 2 * reach * np.sqrt(least[at]) * gap + 1e-9
        return row[keep], node[keep], d2[keep]

    def places(self, ids: np.ndarray, x: np.ndarray, reach: float) -> dict[str, np.ndarray]:
        """Where each vector is sent: row, block, split, slice, whether it is one of the block's own there, whether it asks.

        A block's own vectors are cut into ``splits``, those that ask it into ``slices``; every slice meets every split.
        """
        row, node = self.leaves(x, reach)
        order = np.lexsort((np.arange(len(row)), row))
        row, node = row[order], node[order]
        block = self.block[node]
        home = np.concatenate([[True], np.diff(row) != 0]) if len(row) else np.zeros(0, bool)
        pair = np.unique(np.stack([row, block, ~home]).T, axis=0, return_index=True)[1]
        pair = pair[np.argsort(pair, kind="stable")]
        row, node, block, home = row[pair], node[pair], block[pair], home[pair]
        again = np.zeros(len(row), bool)  # a block once a vector: the home is met first
        where = np.lexsort((~home, block, row))
        same = (np.diff(row[where]) == 0) & (np.diff(block[where]) == 0)
        again[where[1:][same]] = True
        row, node, block, home = row[~again], node[~again], block[~again], home[~again]
        out = {"row": row, "block": block, "split": np.zeros(len(row), np.int32), "slice": np.zeros(len(row), np.int32), "own": home, "asks": np.ones(len(row), bool)}
        heavy = np.flatnonzero((self.splits[node] > 1) | (self.slices[node] > 1))
        if not len(heavy):
            return out
        more: dict[str, list] = {k: [] for k in out}
        mixed = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
        for k in heavy:
            splits, slices = int(self.splits[node[k]]), int(self.slices[node[k]])
            mine, ask = int(mixed[row[k]]) % splits, int(mixed[row[k]]) // splits % slices
            cells = [(mine, s, True, s == ask) for s in range(slices)] if home[k] else []
            cells += [(s, ask, False, True) for s in range(splits) if not home[k] or s != mine]
            for name, values in zip(("split", "slice", "own", "asks"), zip(*cells)):
                more[name] += values
            more["row"] += [row[k]] * len(cells)
            more["block"] += [block[k]] * len(cells)
        light = np.ones(len(row), bool)
        light[heavy] = False
        return {name: np.concatenate([v[light], np.array(more[name], dtype=v.dtype)]) for name, v in out.items()}


def group_cells(centres: np.ndarray, weight: np.ndarray, near: np.ndarray, most: float) -> np.ndarray:
    """Block of each cell.  ``near[i, j]`` tells how many sample rows of cell i come near cell j.

    One after the other, a block begins with the free cell farthest off and takes the cell that shares most of its rows
    with it (the one nearest to its first if none does) until the next would make it heavier than ``most``."""
    block = np.full(len(centres), -1, dtype=np.int64)
    far = _squared(centres, centres.mean(0, keepdims=True))[:, 0]
    both = (near + near.T) / np.maximum(near.sum(1), 1)[None]
    n = 0
    while (free := np.flatnonzero(block < 0)).size:
        seed = free[far[free].argmax()]
        shared = np.zeros(len(centres))
        gap = _squared(centres[[seed]], centres)[0]
        held, cell = 0.0, seed
        while held == 0 or held + weight[cell] <= most:
            block[cell] = n
            held += weight[cell]
            shared += both[cell]
            free = free[free != cell]
            if not len(free):
                break
            cell = free[shared[free].argmax()] if shared[free].any() else free[gap[free].argmin()]
        n += 1
    return block


def grow(x: np.ndarray, each: float, rows: int, block_rows: int, reach: float, heavy: int = 32_768, most_cells: int = 4_096) -> Tree:
    """Cells of about ``rows`` vectors fitted on sample rows that stand for ``each`` vectors, cells near each other put
    together in blocks of about ``block_rows``; a block that stands for more than ``heavy`` is cut."""
    centre = fit_cells(x, int(max(1, min(-(-len(x) * each // rows), len(x) // 4, most_cells))))
    weight = np.bincount(_closest(x, centre), minlength=len(centre)) * each
    one = np.ones(len(centre), dtype=np.int32)
    tree = Tree(np.full(len(centre), -1), centre, np.zeros(len(centre), dtype=np.int64), one, one)
    row, leaf = tree.leaves(x, reach)
    home = np.concatenate([[True], np.diff(row) != 0])
    near = np.zeros((len(centre), len(centre)), dtype=np.float32)
    np.add.at(near, (leaf[home][np.cumsum(home) - 1][~home], leaf[~home]), 1)
    tree.block = block = group_cells(centre, weight, near, block_rows)
    inside = np.bincount(block[leaf[home]], minlength=block.max() + 1) * each
    asked = np.bincount(np.unique(np.stack([row, block[leaf]]).T, axis=0)[:, 1], minlength=block.max() + 1) * each
    tree.splits = np.maximum(1, np.ceil(inside / heavy)).astype(np.int32)[block]
    tree.slices = np.maximum(1, np.ceil(asked / heavy)).astype(np.int32)[block]
    return tree


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(-1, dim)


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, the scale of each row, and the length of what rounding lost."""
    scale = np.maximum(np.abs(x).max(1), 1e-30) / 127
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    lost = np.linalg.norm(x - codes * scale[:, None], axis=1)
    return codes, scale, lost


def int8_products(a: np.ndarray, b: np.ndarray, columns: int = 1_040) -> np.ndarray:
    """Whole-number products of rows of int8 codes with rows of int8 codes.

    A sum of 1,040 products of codes is below 2**24, so a float32 matrix product of so many columns has no rounding; it
    is used because it is many times faster here than an integer one."""
    out = np.zeros((len(a), len(b)), dtype=np.float32)
    for at in range(0, a.shape[1], columns):
        part = a[:, at : at + columns].astype(np.float32) @ b[:, at : at + columns].astype(np.float32).T
        out = part if not at else out + part
    return out


def nearest_in_tile(queries: np.ndarray, query_ids: np.ndarray, base: np.ndarray, base_ids: np.ndarray, k: int, rows: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Ids and squared distances of the k nearest base rows of every query (its own id apart), padded with -1, inf.

    The products of int8 codes give each distance to within the two vectors' rounding losses.  A pair whose lower bound
    exceeds the k-th least upper bound of its query cannot be among the k; all others are computed again in float64
    from the stored floats.  Ties go to the smaller id.
    """
    order = np.argsort(base_ids)
    base_ids = base_ids[order]
    cb, sb, lost_b = quantise(base[order])
    cq, sq, lost_q = quantise(queries)
    block = 16
    wide = -(-len(base_ids) // block) * block  # blocks of columns; the last is filled up with far ones
    codes = np.zeros((wide, base.shape[1]), dtype=np.int8)
    codes[: len(base_ids)] = cb
    own = np.full(wide, 1e30, dtype=np.float32)
    own[: len(base_ids)] = (cb.astype(np.float32) ** 2).sum(1) * sb**2
    double = np.zeros(wide, dtype=np.float32)
    double[: len(base_ids)] = -2 * sb
    worst = float(lost_b.max())
    out_i = np.full((len(queries), k), -1, dtype=np.int64)
    out_d = np.full((len(queries), k), np.inf)
    blocks = wide // block
    for at in range(0, len(queries), rows):
        part, scale = cq[at : at + rows], sq[at : at + rows]
        nq = (part.astype(np.float32) ** 2).sum(1) * scale**2
        tile = int8_products(part, codes)
        tile *= double  # squared distance of the codes, less the query's own square
        tile *= scale[:, None]
        tile += own
        if blocks > k + 1:  # the least of k + 1 blocks: at least k + 1 columns (one may be the query itself) are within
            kth = np.partition(tile.reshape(len(part), blocks, block).min(2), k, axis=1)[:, k]
        else:
            kth = np.full(len(part), 1e29)
        margin = lost_q[at : at + rows] + worst
        reach = np.sqrt(np.maximum(kth.astype(np.float64) + nq, 0)) + margin
        limit = (reach + margin) ** 2 - nq + 1e-5 * (1 + nq)
        qi, bi = np.nonzero(tile <= np.minimum(limit, 1e28)[:, None].astype(np.float32))
        same = query_ids[at + qi] == base_ids[bi]
        qi, bi = qi[~same], bi[~same]
        if not len(qi):
            continue
        d = np.empty(len(qi))
        for lo in range(0, len(qi), 8192):
            gap = queries[at + qi[lo : lo + 8192]].astype(np.float64) - base[order[bi[lo : lo + 8192]]]
            d[lo : lo + 8192] = np.einsum("ij,ij->i", gap, gap)
        rank = np.lexsort((base_ids[bi], d, qi))
        qi, bi, d = qi[rank], bi[rank], d[rank]
        start = np.searchsorted(qi, np.arange(len(part)))
        nth = np.arange(len(qi)) - start[qi]
        keep = nth < k
        out_i[at + qi[keep], nth[keep]] = base_ids[bi[keep]]
        out_d[at + qi[keep], nth[keep]] = d[keep]
    return out_i, out_d


def _tile(dim: int, k: int):
    def run(group: pa.Table) -> pa.Table:
        ids = group.column("id").to_numpy()
        own = group.column("own").to_numpy()
        asks = group.column("asks").to_numpy()
        x = _matrix(group.column("embedding"), dim)
        base = np.flatnonzero(own)
        base = base[np.unique(ids[base], return_index=True)[1]]
        ask = np.flatnonzero(asks)
        ask = ask[np.unique(ids[ask], return_index=True)[1]]
        if not len(base) or not len(ask):
            return pa.table({"id": pa.array([], pa.int64()), "heap": pa.array([], pa.list_(pa.struct([("d", pa.float64()), ("n", pa.int64())])))})
        who, far = nearest_in_tile(x[ask], ids[ask], x[base], ids[base], k)
        n = (who >= 0).sum(1)
        flat = who >= 0
        values = pa.StructArray.from_arrays([pa.array(far[flat]), pa.array(who[flat])], ["d", "n"])
        return pa.table({"id": pa.array(ids[ask]), "heap": pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), values)})

    return run


_NODES = "parent int, centre array<float>, block long, splits int, slices int"
_SENT = "block long, split int, slice int, id long, own boolean, asks boolean, embedding array<float>"


def _tree(rows: list) -> Tree:
    return Tree(np.array([r["parent"] for r in rows]), np.array([r["centre"] for r in rows], dtype=np.float32), np.array([r["block"] for r in rows], dtype=np.int64), np.array([r["splits"] for r in rows]), np.array([r["slices"] for r in rows]))


def _joined(top: Tree, below: dict[int, list]) -> Tree:
    """``top`` with the tree of every of its leaves (regions, by their ``block``) hung in."""
    parent, centre, block = [top.parent], [top.centre], [np.full(len(top.parent), -1, dtype=np.int64)]
    cut = [[np.ones(len(top.parent), dtype=np.int32)], [np.ones(len(top.parent), dtype=np.int32)]]
    for node in np.flatnonzero(top.block >= 0):
        t = below[int(top.block[node])]
        parent.append(np.full(len(t.parent), node))
        centre.append(t.centre)
        block.append(t.block)
        cut[0].append(t.splits)
        cut[1].append(t.slices)
    return Tree(np.concatenate(parent), np.concatenate(centre), np.concatenate(block), np.concatenate(cut[0]), np.concatenate(cut[1]))


def _places(tree: Callable[[], Tree], reach: float, dim: int, regions: bool = False) -> Callable:
    """Every vector with the blocks it is sent to; with ``regions``, the blocks are regions and nothing is cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tree()
        for batch in batches:
            if not len(batch):
                continue
            ids, x = batch.column("id").to_numpy(), _matrix(batch.column("embedding"), dim)
            p = t.places(ids, x, reach)
            back = pa.array(p["row"])
            yield pa.RecordBatch.from_arrays([pa.array(p["block"], pa.int64()), pa.array(p["split"], pa.int32()), pa.array(p["slice"], pa.int32()), batch.column("id").take(back), pa.array(p["own"]), pa.array(p["asks"]), batch.column("embedding").take(back)], [c.split(" ")[0] for c in _SENT.split(", ")])

    return run


def _region_places(reach: float, dim: int):
    """As ``_places`` for the vectors that one region was sent, whose tree comes with them; a vector of another region asks
    only."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names = [c.split(" ")[0] for c in _SENT.split(", ")]
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.bool_(), pa.list_(pa.float32()))], names)
        t, ids, x = _tree(right.to_pylist()), left.column("id").to_numpy(), _matrix(left.column("embedding"), dim)
        p = t.places(ids, x, reach)
        at_home = left.column("own").to_numpy()[p["row"]]
        useful = at_home | p["asks"]
        p = {k: v[useful] for k, v in p.items()}
        back = pa.array(p["row"])
        return pa.table([pa.array(p["block"], pa.int64()), pa.array(p["split"], pa.int32()), pa.array(p["slice"], pa.int32()), left.column("id").combine_chunks().take(back), pa.array(p["own"] & at_home[useful]), pa.array(p["asks"]), left.column("embedding").combine_chunks().take(back)], names)

    return run


def _top_tree(sample: DataFrame, each: float, region_rows: int, dim: int, fit_rows: int) -> tuple[Tree, DataFrame, dict[int, float]]:
    """Top of the tree down to regions of about ``region_rows`` vectors, the sample with its region, and what each region
    stands for.  Every level is one fit of at most 64 centres for each node that is too large, on ``fit_rows`` of its rows."""
    spark = sample.sparkSession
    parent, centre, block, size = [], [], [], {}
    homes = sample.select("id", "embedding", F.lit(-1).alias("node"))
    open_: dict[int, float] = {-1: each * sample.count()}
    for _ in range(8):
        large = {n: s for n, s in open_.items() if s > region_rows}
        if not large:
            break
        wanted = spark.createDataFrame([(n, min(1.0, fit_rows * each / s), min(64, int(-(-s // region_rows)))) for n, s in large.items()], "node int, share double, want int")
        part = homes.join(F.broadcast(wanted), "node").filter(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1_000_000)) < F.col("share") * 1_000_000)

        def fit(group: pa.Table) -> pa.Table:
            c = fit_cells(_matrix(group.column("embedding"), dim), min(group.column("want")[0].as_py(), max(1, group.num_rows // 4)))
            return pa.table({"parent": pa.array([group.column("node")[0].as_py()] * len(c), pa.int32()), "centre": pa.array(list(c), pa.list_(pa.float32()))})

        fitted = part.select("node", "want", "embedding").groupBy("node").applyInArrow(fit, "parent int, centre array<float>").collect()
        for r in fitted:
            parent.append(r.parent)
            centre.append(r.centre)
        block = np.full(len(parent), -1, dtype=np.int64)
        block[[n for n in range(len(parent)) if n not in set(parent)]] = 0
        one = np.ones(len(parent), dtype=np.int32)
        level = Tree(np.array(parent), np.array(centre, dtype=np.float32), block, one, one)

        def home(batches: Iterator[pa.RecordBatch], level: Tree = level) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                row, node = level.leaves(_matrix(batch.column("embedding"), dim), 0.0)
                first = np.concatenate([[True], np.diff(row) != 0]) if len(row) else np.zeros(0, bool)
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("embedding"), pa.array(node[first].astype(np.int32))], ["id", "embedding", "node"])

        homes = staged(homes.select("id", "embedding").mapInArrow(home, "id long, embedding array<float>, node int"), "homes")
        open_ = {r.node: r.n * each for r in homes.groupBy("node").agg(F.count("*").alias("n")).collect()}
    if not parent:
        parent, centre = [-1], [[0.0] * dim]
        homes, open_ = homes.withColumn("node", F.lit(0)), {0: open_[-1]}
    inner = set(parent)
    block = np.array([-1 if n in inner else n for n in range(len(parent))], dtype=np.int64)
    one = np.ones(len(parent), dtype=np.int32)
    return Tree(np.array(parent), np.array(centre, dtype=np.float32), block, one, one), homes, open_


def nearest_vectors(vectors: DataFrame, k: int = 10, dim: int = 384, rows: int = 256, block_rows: int = 8_192, reach: float = 0.12, fit_rows: int = 8_192, per_cell: int = 16, region_rows: int = 262_144, most_regions: int = 2_048, broadcast_cells: int = 40_000) -> DataFrame:
    """The k nearest other vectors (L2) of every usable vector of the table.

    Vectors are laid out in cells of about ``rows`` around centres fitted on a sample of ``per_cell`` vectors a cell
    (``fit_rows`` at least).  The fit goes by levels: nodes of more than ``region_rows`` vectors are divided first, each
    on ``fit_rows`` of its sample, and the cells of each region are fitted by a task of its own, so no task's memory grows
    with the number of cells (above ``most_regions`` regions grow, and their cells with them).  Cells that share many
    vectors make up blocks of about ``block_rows``; a block of more than 32,768 rows, by its share of the sample, is
    cut.  Each vector is joined with the blocks of its nearest cell and of every cell whose border is within ``reach``
    (see ``Tree.leaves``), and the parts' k best are merged into one heap.  ``reach`` infinity makes it the exact
    join; below, a neighbour behind a farther border is lost (the README has the measured recall).  Up to
    ``broadcast_cells`` cells are broadcast; beyond, vectors are first sent to their regions and meet the cells there.
    Equal vectors are kept once, with their k + 1 smallest ids, so copies cost nothing.

    Null, short, non-finite and all-zero vectors take no part; of several vectors of a chunk_rowid only the least (in
    the order of arrays) takes part.  Result: id, heap array of (d squared distance, n neighbour id), nearest first,
    ties to the smaller id.
    """
    spark = vectors.sparkSession
    key = F.struct(F.xxhash64("embedding").alias("h"), F.hash("embedding").alias("g"))
    ok = usable(vectors, dim).withColumn("v", key)
    narrow = staged(ok.select("id", "v").groupBy("id").agg(F.min("v").alias("v"), F.max("v").alias("w")), "vectors")
    torn = narrow.filter("v != w").select("id")
    if not torn.isEmpty():
        torn = staged(torn, "torn")
        least = ok.join(torn, "id", "left_semi").groupBy("id").agg(F.min("embedding").alias("embedding")).select("id", key.alias("v"))
        narrow = staged(narrow.filter("v = w").select("id", "v").unionByName(least), "chosen")
        others = ok.join(torn, "id", "left_semi").select("id", "v").distinct().join(least, ["id", "v"], "left_anti")
    else:
        others = None
    heads = narrow.groupBy("v").agg(F.min("id").alias("head"), F.count("*").alias("n")).filter("n > 1").select("v", "head")
    extra = staged(narrow.join(heads, "v").filter("id != head").select("id", "head", "v"), "copies")
    total = narrow.count()
    n_extra = extra.count()
    base_rows = total - n_extra
    if not total:
        return ok.select("id", F.array().cast("array<struct<d:double,n:bigint>>").alias("heap"))
    drop = extra.select("id", "v")
    if others is not None:
        drop = staged(drop.unionByName(others), "unused")
    n_drop = drop.count()
    reps = ok
    if n_drop:
        reps = ok.join(F.broadcast(drop) if n_drop <= 1_000_000 else drop, ["id", "v"], "left_anti")
    reps = reps.select("id", "embedding")
    cells = -(-base_rows // rows)
    share = min(1.0, max(fit_rows, per_cell * cells) / base_rows)
    sample = reps.filter(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1_000_000)) < int(share * 1_000_000)) if share < 1 else reps
    sample = staged(sample, "sample")
    taken = sample.count()
    each = base_rows / taken
    region_rows = max(region_rows, -(-base_rows // most_regions))
    top, homes, sizes = _top_tree(sample, each, region_rows, dim, fit_rows)

    def cells_of(group: pa.Table) -> pa.Table:
        node = group.column("node")[0].as_py()
        t = grow(_matrix(group.column("embedding"), dim), each, rows, block_rows, reach)
        kinds = [pa.int32(), pa.int32(), pa.list_(pa.float32()), pa.int64(), pa.int32(), pa.int32()]
        values = [np.full(len(t.parent), node), t.parent, list(t.centre), (node << 20) + t.block, t.splits, t.slices]
        return pa.table([pa.array(v, kind) for v, kind in zip(values, kinds)], ["node", *[c.split(" ")[0] for c in _NODES.split(", ")]])

    model = staged(homes.repartition(min(len(sizes), 4 * width(spark)), "node").groupBy("node").applyInArrow(cells_of, "node int, " + _NODES), "cells")
    if model.count() <= broadcast_cells:
        below: dict[int, list] = {}
        for r in model.collect():  # broadcast_cells rows at most
            below.setdefault(r.node, []).append(r)
        whole = _joined(top, {n: _tree(r) for n, r in below.items()})
        sent = reps.mapInArrow(_places(lambda: whole, reach, dim), _SENT)
    else:
        per = {n: max(1, int(s // 131_072)) for n, s in sizes.items()}
        parts = spark.createDataFrame(list(per.items()), "node int, parts int")
        here = reps.mapInArrow(_places(lambda: top, reach, dim), _SENT).withColumn("node", F.col("block").cast("int")).join(F.broadcast(parts), "node")
        here = here.select("node", F.pmod(F.xxhash64("id", F.lit(3)), F.col("parts")).cast("int").alias("part"), "id", "own", "embedding")
        trees = model.join(F.broadcast(parts), "node").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        sent = here.groupBy("node", "part").cogroup(trees.groupBy("node", "part")).applyInArrow(_region_places(reach, dim), _SENT)
    tasks = model.select("block", "splits", "slices").distinct().agg(F.sum(F.col("splits") * F.col("slices"))).first()[0]
    sent = sent.repartition(int(min(32_768, max(width(spark), tasks))), "block", "split", "slice")  # about one group a task
    parts = sent.groupBy("block", "split", "slice").applyInArrow(_tile(dim, k), "id long, heap array<struct<d:double,n:bigint>>")
    heaps = parts.groupBy("id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("heap"))), 1, k).alias("heap"))
    if not n_extra:
        return heaps
    heaps = staged(heaps, "heaps")
    extra = extra.drop("v")
    # copies: the first of equal vectors stands for all; every neighbour list gets their smallest ids back
    nth = F.row_number().over(Window.partitionBy("head").orderBy("id"))  # limited before the shuffle
    few = extra.withColumn("nth", nth).filter(F.col("nth") <= k).groupBy("head").agg(F.sort_array(F.collect_list("id")).alias("more"))
    few = staged(few, "few")
    listed = heaps.select("id", F.explode("heap").alias("h")).join(few.withColumnRenamed("head", "n"), F.col("h.n") == F.col("n"), "left")
    spread = F.concat(F.array("h"), F.transform(F.coalesce("more", F.array().cast("array<bigint>")), lambda m: F.struct(F.col("h.d").alias("d"), m.alias("n"))))
    wide = listed.groupBy("id").agg(F.flatten(F.collect_list(spread)).alias("heap"))
    wide = heaps.select("id").join(wide, "id", "left").join(few.withColumnRenamed("head", "id"), "id", "left")
    zero = F.transform(F.coalesce("more", F.array().cast("array<bigint>")), lambda m: F.struct(F.lit(0.0).alias("d"), m.alias("n")))
    whole = F.array_sort(F.concat(F.coalesce("heap", F.array().cast("array<struct<d:double,n:bigint>>")), zero))
    heads_out = wide.select("id", whole.alias("all"), F.lit(None).cast("long").alias("me"))
    copies = extra.select(F.col("id").alias("me"), F.col("head").alias("id")).join(wide.select("id", whole.alias("all")), "id")
    with_head = F.array_sort(F.concat(F.array(F.struct(F.lit(0.0).alias("d"), F.col("id").alias("n"))), F.col("all")))
    copies = copies.select(F.col("me").alias("id"), F.slice(F.filter(with_head, lambda x: x["n"] != F.col("me")), 1, k).alias("heap"))
    return heads_out.select("id", F.slice("all", 1, k).alias("heap")).unionByName(copies)


def neighbour_pairs(heaps: DataFrame) -> DataFrame:
    """(chunk_rowid_a, chunk_rowid_b), smaller first: at least one is among the nearest of the other."""
    one = heaps.select("id", F.explode("heap").alias("h")).select(F.least("id", F.col("h.n")).alias("chunk_rowid_a"), F.greatest("id", F.col("h.n")).alias("chunk_rowid_b"))
    return one.distinct()
