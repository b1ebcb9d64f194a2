"""Embedding near-duplicates: exact threshold pairs by cells and balls.

Both cover unit vectors, where cosine 0.95 is a distance
of 0.316.  The upper level is ``cells``: the nearest of some centres, which
come from a farthest-first walk over at most ``SAMPLE`` vectors (the only sample;
every vector is indexed, and the choice of centres changes no result).  Below a
cell, nets with halving radii 1, 1/2, 1/4, 1/8 are nested in each other; the last
ones are ``balls``, and the wider ones serve only to find them: no tree of nodes
is descended.  A vector visits every later cell whose covering ball it may
reach; there it meets balls, and then vectors, and each time one goes if it is
farther away than the threshold plus its covering radius.  Nothing else is left
out, so the pairs are exact.

All vectors of one ball lie within the threshold of each other.  So a ball of
near copies needs no comparison inside, and one wholly in reach of a vector is
counted by its size.  Links are counted where both sides are at hand, in the task
of a cell and a part of its visitors, which gives one row for each vector and one
edge for each ball at most; no pair is ever a row.  In a loose group (cosines
between 0.95 and 0.992) balls are single vectors, and the products of all its
pairs are still computed, in blocks of bounded size.  Equal vectors are one class
from the start.  A cell holds at most ``PER_CELL`` vectors (larger ones are split)
and its visitors are dealt in parts of that size.

Vectors that are null, empty or zero or hold null or non-finite components link
with nothing, nor does a row without ``vec_id``; vectors of different length do
not link.  Repeated rows are one vector and give equal rows.  Further columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galley.llm.common import components
from galley.plans.joins import durable

THRESHOLD = 0.95
SAMPLE = 2048
PER_CELL = 20_000
RADII = [1.0, 0.5, 0.25, 0.125]
_SAFE = 1e-9  # far above the rounding of a distance, far below any radius


def _unit(rows) -> np.ndarray:
    if not len(rows):
        return np.empty((0, 1))
    x = np.array([np.asarray(r, dtype=np.float64) for r in rows])
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that no square overflows or vanishes
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of unit vectors."""
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


def farthest_first(x: np.ndarray, n: int) -> np.ndarray:
    """Up to ``n`` rows, each the farthest from those before it."""
    chosen = [0]
    near = _apart(x, x[:1])[:, 0]
    while len(chosen) < min(n, len(x)) and near.max() > 1e-6:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, _apart(x, x[chosen[-1:]])[:, 0])
    return x[chosen]


def net(x: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Centres (places in ``x``) and for each row the centre within ``radius``."""
    centres: list[int] = []
    owner = np.full(len(x), -1, dtype=np.int64)
    step = 512
    for lo in range(0, len(x), step):
        part = x[lo : lo + step]
        mine = owner[lo : lo + step]
        for at in range(0, len(centres), 4096):
            some = np.array(centres[at : at + 4096])
            d = _apart(part, x[some])
            best = d.argmin(axis=1)
            fits = (d[np.arange(len(part)), best] <= radius) & (mine < 0)
            mine[fits] = some[best[fits]]
        open_rows = np.flatnonzero(mine < 0)
        if len(open_rows):
            close = _apart(part[open_rows], part[open_rows]) <= radius
            for k, row in enumerate(open_rows):
                if mine[row] < 0:
                    centres.append(lo + int(row))
                    mine[open_rows[close[k] & (mine[open_rows] < 0)]] = lo + row
                    mine[row] = lo + row
    return np.array(centres, dtype=np.int64), owner


def balls(x: np.ndarray) -> np.ndarray:
    """For each row the centre of its ball, by nets nested in one another."""
    owner = np.zeros(len(x), dtype=np.int64)
    for radius in RADII:
        order = np.argsort(owner, kind="stable")
        cuts = np.flatnonzero(np.diff(owner[order])) + 1
        for group in np.split(order, cuts):
            if len(group) == 1:
                owner[group] = group
            else:
                owner[group] = group[net(x[group], radius)[1]]
    return owner


def _classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with a valid vector, and one row per distinct vector."""
    fine = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    valid = vectors.filter(
        F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & fine & F.exists("embedding", lambda v: v != 0)
    )
    grouped = valid.distinct().groupBy("embedding").agg(
        F.min("vec_id").alias("id"), F.count("*").alias("n")
    )
    return valid, grouped


def _cells(classes: DataFrame, per_cell: int) -> DataFrame:
    """``id, n, v, cell``, cells numbered from 0 and of ``per_cell`` rows at most."""
    total = classes.count()
    # some square root of the rows per cell: few visitors, little to hold
    wanted = int(min(1024, max(1, total // max(500, int(16 * total**0.5)))))
    sample = classes.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toPandas()
    centres = farthest_first(_unit(sample["v"]), wanted)
    shared = classes.sparkSession.sparkContext.broadcast(centres)

    def assign(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for lo in range(0, len(part), 4096):
                some = part.iloc[lo : lo + 4096].copy()
                some["centre"] = _apart(_unit(some["v"]), shared.value).argmin(axis=1)
                yield some

    dealt = durable(classes.mapInPandas(assign, "id long, n long, v array<double>, centre long"))
    sizes = dealt.groupBy("centre").count().orderBy("centre").collect()  # 1024 rows at most
    parts, first, start = {}, {}, 0
    for centre, size in sizes:
        first[centre], parts[centre] = start, -(-size // per_cell)
        start += parts[centre]
    place = F.create_map(*[F.lit(x) for c in first for x in (c, first[c])]) if first else F.create_map()
    spread = F.create_map(*[F.lit(x) for c in parts for x in (c, parts[c])]) if parts else F.create_map()
    if not first:
        return dealt.withColumn("cell", F.lit(0).cast("long")).drop("centre")
    sub = F.pmod(F.xxhash64("id"), spread[F.col("centre")])
    return dealt.withColumn("cell", (place[F.col("centre")] + sub).cast("long")).drop("centre")


def _tree(cells: DataFrame) -> DataFrame:
    """Each class with its ball: ``id, n, v, cell, ball``."""

    def build(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id", kind="stable").reset_index(drop=True)
        group["ball"] = group["id"].to_numpy()[balls(_unit(group["v"]))]
        return group

    return cells.groupBy("cell").applyInPandas(build, "id long, n long, v array<double>, cell long, ball long")


def _visits(tree: DataFrame, reach: float, per_cell: int) -> DataFrame:
    """``cell, part, home, id, n, v, ball``: the vectors of each cell, and those of
    earlier cells that may link with one of them, in parts."""
    # the covering ball of a cell: around one of its vectors, over all of them
    hubs = tree.groupBy("cell").agg(F.min_by("v", "id").alias("hub")).orderBy("cell").toPandas()
    hub = _unit(hubs["hub"])  # as many rows as there are cells
    cell_ids = hubs["cell"].to_numpy()
    place = np.full(int(cell_ids.max()) + 1, -1, dtype=np.int64)
    place[cell_ids] = np.arange(len(cell_ids))
    shared = tree.sparkSession.sparkContext.broadcast((hub, cell_ids, place))

    def span(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hub, _, place = shared.value
        for part in parts:
            if len(part):
                x, own = _unit(part["v"]), place[part["cell"].to_numpy()]
                d = np.sqrt(np.maximum(2 - 2 * np.einsum("ij,ij->i", x, hub[own]), 0))
                yield pd.DataFrame({"cell": part["cell"], "cover": d})

    covers = tree.select("cell", "v").mapInPandas(span, "cell long, cover double")
    cover = np.zeros(len(cell_ids))
    for row in covers.groupBy("cell").agg(F.max("cover")).collect():  # as many rows as there are cells
        cover[place[row[0]]] = row[1]
    bounds = tree.sparkSession.sparkContext.broadcast(cover)

    def visits(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hub, cell_ids, place = shared.value
        for part in parts:
            for lo in range(0, len(part), 1024):
                some = part.iloc[lo : lo + 1024]
                own = place[some["cell"].to_numpy()]
                near = _apart(_unit(some["v"]), hub) <= bounds.value[None, :] + reach + _SAFE
                near &= np.arange(len(cell_ids))[None, :] > own[:, None]
                who, where = np.nonzero(near)
                out = some.iloc[who][["id", "n", "v", "ball"]].copy()
                out["cell"] = cell_ids[where]
                yield out

    columns = "id long, n long, v array<double>, ball long, cell long"
    guests = tree.mapInPandas(visits, columns).withColumn("home", F.lit(False))
    # visitors come in parts; the cell's own vectors go to each of its parts
    parts = guests.groupBy("cell").agg(F.ceil(F.count("*") / per_cell).alias("parts"))
    guests = guests.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
    homes = tree.withColumn("home", F.lit(True)).join(F.broadcast(parts), "cell", "left")
    homes = homes.withColumn(
        "part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1).cast("long")) - 1))
    )
    names = ["cell", "part", "home", "id", "n", "v", "ball"]
    return homes.select(names).unionByName(guests.select(names))


class _Forest:
    """Which nodes hang together; ``join`` takes links by blocks and lists none."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def roots(self, nodes: np.ndarray) -> np.ndarray:
        r = self.up[nodes]
        while (self.up[r] != r).any():
            r = self.up[r]
        self.up[nodes] = r
        return r

    def join(self, rows: np.ndarray, link: np.ndarray) -> None:
        """``rows[i]`` with each column node ``j`` of which ``link[i, j]`` holds."""
        root = self.roots(np.arange(link.shape[1]))
        low = np.where(link, root, len(self.up)).min(axis=1)
        high = np.where(link, root, -1).max(axis=1)
        for i in np.flatnonzero(high >= 0):
            some = np.array([low[i]]) if low[i] == high[i] else np.unique(root[link[i]])
            some = self.roots(np.append(some, rows[i]))
            self.up[some] = some.min()


def count_links(
    x: np.ndarray, n: np.ndarray, ball: np.ndarray, y: np.ndarray, m: np.ndarray, visitor: np.ndarray, inner: bool, threshold: float
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Links between vectors ``x`` of one cell and its visitors ``y``, and with
    ``inner`` also between different balls of the cell.

    ``n`` and ``m`` are the weights of the vectors, ``ball`` and ``visitor`` name the
    balls by the place of their centre in ``x`` and by any number.  Gives the links
    of each ``x`` and each ``y``, and for every ball (the cell's in order of their
    centres, then the visitors' in order of number) one it hangs together with.
    A ball wholly in or wholly out of reach of a vector is counted or left by its
    centre; only the rest is compared vector by vector.
    """
    reach = float(np.sqrt(2 - 2 * threshold))
    centre, own = np.unique(ball, return_inverse=True)
    guests, guest = np.unique(visitor, return_inverse=True)
    order = np.argsort(own, kind="stable")
    start = np.searchsorted(own[order], np.arange(len(centre) + 1))
    single = np.diff(start) == 1
    c, weight = x[centre], np.bincount(own, weights=n, minlength=len(centre))
    radius = np.zeros(len(centre))
    np.maximum.at(radius, own, np.sqrt(np.maximum(2 - 2 * np.einsum("ij,ij->i", x, c[own]), 0)))
    radius[single] = 0
    to_x, to_y, to_ball = np.zeros(len(x)), np.zeros(len(y)), np.zeros(len(centre))
    forest = _Forest(len(centre) + len(guests))

    def compare(z: np.ndarray, w: np.ndarray, node: np.ndarray, to_z: np.ndarray, later: bool) -> None:
        step = max(64, 2_000_000 // max(1, len(c)))
        for lo in range(0, len(z), step):
            part, pw, at = z[lo : lo + step], w[lo : lo + step].astype(float), node[lo : lo + step]
            dot = part @ c.T
            link = dot >= threshold
            if not single.all():
                d = np.sqrt(np.maximum(2 - 2 * dot, 0)) - _SAFE
                link &= single | (d + radius + 2 * _SAFE <= reach)
                maybe = ~single & ~link & (d <= reach + radius)
            else:
                maybe = None
            if later:  # each pair of balls once
                after = np.arange(len(c))[None, :] > at[:, None]
                link &= after
                maybe = maybe & after if maybe is not None else None
            to_z[lo : lo + step] += link @ weight
            to_ball[:] += pw @ link
            if maybe is not None:
                for j in np.flatnonzero(maybe.any(axis=0)):
                    rows, members = np.flatnonzero(maybe[:, j]), order[start[j] : start[j + 1]]
                    near = part[rows] @ x[members].T >= threshold
                    to_z[lo + rows] += near @ n[members]
                    to_x[members] += pw[rows] @ near
                    link[rows, j] = near.any(axis=1)
            forest.join(at, link)

    if inner:
        compare(x, n, own, to_x, True)
    compare(y, m, len(centre) + guest, to_y, False)
    return to_x + to_ball[own], to_y, forest.roots(np.arange(len(forest.up))), guests


def _count(everyone: DataFrame, threshold: float) -> DataFrame:
    """``id, more``: the links of each vector beyond its ball; ``a, b``: balls that hang together.

    A task gives a row for each of its vectors and balls at most.
    """

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        home = group["home"].to_numpy()
        own, guest = group[home].sort_values("id", kind="stable"), group[~home]
        ids, seen = own["id"].to_numpy(), guest["id"].to_numpy()
        ball = np.searchsorted(ids, own["ball"].to_numpy())
        y = _unit(guest["v"]) if len(guest) else np.empty((0, len(own["v"].iat[0])))
        to_x, to_y, root, guests = count_links(
            _unit(own["v"]), own["n"].to_numpy(), ball, y, guest["n"].to_numpy(), guest["ball"].to_numpy(), group["part"].iat[0] == 0, threshold
        )
        nodes = np.concatenate((ids[np.unique(ball)], guests)).astype(np.int64)
        who, more = np.concatenate((ids, seen)), np.concatenate((to_x, to_y)).astype(np.int64)
        hangs = nodes != nodes[root]
        counted = pd.DataFrame({"id": who[more > 0], "more": more[more > 0], "a": 0, "b": 0})
        joined = pd.DataFrame({"id": 0, "more": 0, "a": nodes[hangs], "b": nodes[root][hangs]})
        return pd.concat([counted, joined], ignore_index=True)

    return everyone.groupBy("cell", "part").applyInPandas(meet, "id long, more long, a long, b long")


def _links(classes: DataFrame, threshold: float, per_cell: int) -> DataFrame:
    """``id, links, component`` of every class of equal vectors."""
    reach = float(np.sqrt(2 - 2 * threshold))
    if 2 * RADII[-1] >= reach:
        raise ValueError(f"threshold {threshold} is too high for balls of radius {RADII[-1]}")
    tree = durable(_tree(_cells(classes, per_cell)))
    found = durable(_count(_visits(tree, reach, per_cell), threshold))
    within = tree.groupBy("ball").agg(F.sum("n").alias("all"), F.min("id").alias("first"))
    joined = components(found.filter("more = 0").select("a", "b").distinct())
    named = within.join(joined, within["ball"] == joined["node"], "left").withColumn(
        "component", F.coalesce("component", "ball")
    )
    lowest = named.groupBy("component").agg(F.min("first").alias("lowest"))
    named = named.join(lowest, "component").select("ball", "all", "lowest")
    more = found.filter("more > 0").groupBy("id").agg(F.sum("more").alias("more"))
    return (
        tree.select("id", "ball")
        .join(named, "ball")
        .join(more, "id", "left")
        .select("id", (F.col("all") - 1 + F.coalesce("more", F.lit(0))).alias("links"), F.col("lowest").alias("component"))
    )


def near_duplicates(
    vectors: DataFrame, threshold: float = THRESHOLD, per_cell: int = PER_CELL
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row."""
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")
    )
    valid, classes = _classes(rows)
    classes = durable(classes)
    sizes = [r[0] for r in classes.select(F.size("embedding").alias("d")).distinct().collect()]  # lengths, not rows
    every = None
    for size in sizes:
        own = classes.filter(F.size("embedding") == size).select("id", "n", F.col("embedding").alias("v"))
        found = _links(own, threshold, per_cell)
        every = found if every is None else every.unionByName(found)
    if every is None:
        every = classes.select("id", F.col("n").alias("links"), F.col("id").alias("component")).limit(0)
    named = classes.join(every, "id").select("embedding", "links", "component")
    met = rows.withColumn("ok", F.col("vec_id").isNotNull()).join(named, "embedding", "left")
    linked = F.col("ok") & F.col("component").isNotNull()
    component = F.when(linked, F.col("component")).otherwise(F.col("vec_id"))
    return met.select(
        "vec_id",
        F.when(linked, F.col("links")).otherwise(0).cast("long").alias("n_links"),
        component.alias("component_id"),
        component.eqNullSafe(F.col("vec_id")).alias("kept"),
    )
