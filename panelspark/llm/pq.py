"""Near-duplicate vectors by an inverted file with product-quantised residuals.

Vectors are scaled to length 1; cosine c is then distance sqrt(2 - 2c). A coarse centroid names each vector's list; the
residual is coded by the nearest codeword in each of SUBSPACES parts. A query is held against the lists whose cells come
within that distance of it (the distance to the bisecting plane of two centroids tells), so the probes suffice. In a list its
asymmetric distances to the codes come from one matrix product with the vectors that the codes stand for; each vector keeps its own
quantisation error, so a code further than distance plus error is no neighbour for certain. The rest is ranked by exact cosine.

A pair of vectors from different lists meets once, in the later list, and both are credited.

Equal vectors of a label count as one with a multiplicity, so copies are never paired. A label's vectors, by list, are cut into
blocks of BLOCK_BYTES. A vector goes to its own block and once to each other one that has a list it is held against, not to each
list; there it finds its lists again. So a vector is sent once for each block of its label at most, and a block's vectors stay while those that come
to ask stream past. Tasks give back counts and a spanning forest of the links, not all pairs.

Centroids and codewords are fitted on a bounded sample; every row is indexed. They decide cost only: the bounds hold
for any centroids.

Defined results: null or zero vectors, and those with null or non-finite parts or of another length than most, link with
nothing; a null label links with nothing; rows that repeat a key keep one row each, and each links by its own vector; a
row whose key is null takes part like others but names no component: its component is the smallest key reachable, or null (and then
it is kept) if it reaches none; an empty table
gives an empty result; only the key and the outputs are returned, so clashing columns of the input do no harm. Rows find the class of their
vector by its label and two 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from panelspark.llm.common import NO_KEY, lean, materialize, mix, within
from panelspark.llm.graph import components

#: Vectors that centroids and codewords are fitted on, at most about.
SAMPLE_ROWS = 20_000
LISTS, SUBSPACES, CODEWORDS = 64, 8, 64
#: Lists grow as the square root of the vectors up to this many, so that a sample of SAMPLE_ROWS fits about 20 vectors a list.
MOST_LISTS = 1024
#: Bytes, in double precision, of the vectors that one task holds as data, and their number, at most about.
BLOCK_BYTES, MOST_ROWS = 1 << 25, 1 << 16
#: Blocks whose vectors come to ask in one task.
ASKING = 8
#: Vectors that are placed, or ask, at once: their distances to all centroids are held in memory.
STEP = 2048
#: Vectors of a list that are asked at once, and pairs that are compared one by one at once. Where the codes leave one pair in DENSE, all are compared by one product.
STRIP, PAIRS, DENSE = 1024, 1 << 16, 64


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """Centroids of the rows of x; fewer than k if x has fewer rows."""
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = listed(x, c)
        n = np.bincount(near, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def listed(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Number of the nearest centroid of each row, a step at a time."""
    half = (c**2).sum(1) / 2
    return np.concatenate([np.argmin(half - x[lo : lo + STEP] @ c.T, axis=1) for lo in range(0, max(len(x), 1), STEP)])


@dataclass
class Quantiser:
    """Coarse centroids, and for each subspace its dimensions and codewords."""

    centroids: np.ndarray
    codebooks: list[tuple[slice, np.ndarray]]

    @classmethod
    def fit(cls, x: np.ndarray, lists: int = LISTS, subspaces: int = SUBSPACES, codewords: int = CODEWORDS) -> Quantiser:
        c = kmeans(x, lists)
        r = x - c[listed(x, c)]
        cuts = np.linspace(0, x.shape[1], min(subspaces, x.shape[1]) + 1).astype(int)
        return cls(c, [(slice(a, b), kmeans(r[:, a:b], codewords)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)])

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, residual codes and quantisation error of each row."""
        near = listed(x, self.centroids)
        r = x - self.centroids[near]
        codes = np.stack([listed(r[:, s], book) for s, book in self.codebooks], axis=1).astype(np.uint8)
        return near, codes, np.sqrt(((x - self.decode(near, codes)) ** 2).sum(axis=1))

    def decode(self, near: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The vectors that lists and codes stand for."""
        return self.centroids[near] + np.concatenate([book[codes[:, i]] for i, (_, book) in enumerate(self.codebooks)], axis=1)

    @cached_property
    def apart(self) -> np.ndarray:
        """Distances of the centroids; infinite between equal ones, whose cells no plane tells apart."""
        n = (self.centroids**2).sum(1)
        d = np.sqrt(np.maximum(n[:, None] - 2 * self.centroids @ self.centroids.T + n[None, :], 0))
        return np.where(d < 1e-9, np.inf, d).astype(np.float32)

    def reach(self, x: np.ndarray, near: np.ndarray, radius: float) -> np.ndarray:
        """Whether each row of list `near` is held against each list: its own, and each later one whose cell comes within `radius` of it.

        Two rows within the radius of each other each reach the other's cell, so the one of the earlier list finds the pair.
        """
        own, c = np.arange(len(x)), self.centroids.astype(np.float32)
        d = ((self.centroids**2).sum(1) / 2).astype(np.float32) - x.astype(np.float32) @ c.T
        d -= d[own, near][:, None]  # half of how much further its squared distance is: the distance to the plane times that of the centroids
        ok = d <= (np.float32(radius + 1e-6) * self.apart + np.float32(slack(x.shape[1])))[near]
        ok &= np.arange(len(c))[None, :] > near[:, None]
        ok[own, near] = True
        return ok

    def probes(self, x: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) for each list that a row is held against."""
        return np.nonzero(self.reach(x, listed(x, self.centroids), radius))


def slack(width: int) -> float:
    """More than single precision loses in a product of rows of length up to 2 and that width."""
    return (width + 8) * 2.0**-21


def unit_rows(col: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of length 1 in double precision, and which rows have one."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    fits = pc.fill_null(pc.equal(pc.list_value_length(col), width), False)
    x = np.full((len(col), width), np.nan)
    x[np.asarray(fits)] = pc.list_flatten(col.filter(fits)).cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, width)  # null parts become NaN
    with np.errstate(invalid="ignore", over="ignore"):
        big = np.abs(x).max(axis=1, keepdims=True) if width else np.zeros((len(x), 1))
        ok = np.isfinite(big[:, 0]) & (big[:, 0] > 0) & np.isfinite(x).all(axis=1)
        x = x / np.where(ok[:, None], big, 1)
        x = x / np.where(ok, np.sqrt((x**2).sum(axis=1)), 1)[:, None]
    return np.where(ok[:, None], x, 0), ok


def forest(top: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Positions of the links that join what was apart before them; top, a name for each node's component, is brought up to date."""
    kept = []
    apart = np.flatnonzero(top[a] != top[b])
    for part in (apart[np.unique(b[apart], return_index=True)[1]], apart[np.unique(a[apart], return_index=True)[1]], apart):  # one link for each node first, as in dense groups no other is needed
        part = part[top[a[part]] != top[b[part]]]
        up: dict[int, int] = {}

        def find(i: int, up: dict[int, int] = up) -> int:
            while (j := up.get(i, i)) != i:
                up[i] = up.get(j, j)
                i = j
            return i

        for k, i, j in zip(part.tolist(), top[a[part]].tolist(), top[b[part]].tolist(), strict=True):
            i, j = find(i), find(j)
            if i != j:
                up[j] = i
                kept.append(k)
        if up:
            new = np.arange(len(top))
            new[list(up)] = [find(i) for i in list(up)]
            top[:] = new[top]
    return np.array(kept, np.int64)


class Block:
    """Vectors of one label that are asked: x, unit rows; ids, copies, lists, codes and errors of each. They stand by list."""

    def __init__(self, q: Quantiser, x: np.ndarray, ids: np.ndarray, copies: np.ndarray, lists: np.ndarray, codes: np.ndarray, error: np.ndarray, cosine: float):
        order = np.argsort(lists, kind="stable")
        self.q, self.cosine, self.radius = q, cosine, distance(cosine)
        self.x, self.ids, self.copies, self.lists = x[order], ids[order], copies[order], lists[order]
        self.n, self.top = np.zeros(len(x), np.int64), np.arange(len(x))
        # the squared distance of a unit vector to a code is at most (radius + error)^2 where this row times (vector, 1) is at least 0
        self.rows = np.empty((len(x), x.shape[1] + 1), np.float32)
        for lo in range(0, len(x), STEP):
            at = order[lo : lo + STEP]
            y = q.decode(lists[at], codes[at])
            self.rows[lo : lo + STEP, :-1] = y
            self.rows[lo : lo + STEP, -1] = ((self.radius + error[at] + 1e-6) ** 2 - 1 - (y**2).sum(axis=1)) / 2
        self.which, self.starts = np.unique(self.lists, return_index=True)

    def links(self, x: np.ndarray, ids: np.ndarray, lists: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
        """(queries, positions here, None) of links, PAIRS or fewer at a time; or where the codes leave much, (queries, positions here of one list, which of these pairs are links)."""
        need = np.ascontiguousarray(self.q.reach(x, lists, self.radius)[:, self.which].T)
        x1 = np.concatenate([x, np.ones((len(x), 1))], axis=1).astype(np.float32)
        least, held, size = np.float32(-slack(x.shape[1])), [], 0
        for k, (lo, hi) in enumerate(zip(self.starts, [*self.starts[1:], len(self.x)], strict=True)):
            who = np.flatnonzero(need[k])
            if not len(who):
                continue
            asking = x1[who]
            for a in range(lo, hi, STRIP):
                here = np.arange(a, min(a + STRIP, hi))
                s = asking @ self.rows[a : here[-1] + 1].T
                at = np.flatnonzero(s.ravel() >= least)
                if len(at) > max(s.size // DENSE, 1000):
                    c = x[who] @ self.x[a : here[-1] + 1].T
                    link = c >= self.cosine
                    i, j = np.nonzero(np.abs(c - self.cosine) < 1e-9)  # a product of matrices rounds otherwise: what is close is told as elsewhere
                    link[i, j] = self.close(x, who[i], here[j])
                    link &= ids[who][:, None] != self.ids[here][None, :]
                    yield who, here, link
                elif len(at):
                    i, j = np.divmod(at, s.shape[1])
                    held.append((who[i], j + a))
                    size += len(at)
                if size >= PAIRS:
                    yield from self.told(x, ids, held)
                    held, size = [], 0
        if held:
            yield from self.told(x, ids, held)

    def close(self, x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether queries i and positions j here have the cosine."""
        parts = [np.einsum("ij,ij->i", x[i[lo : lo + PAIRS]], self.x[j[lo : lo + PAIRS]]) >= self.cosine for lo in range(0, len(i), PAIRS)]
        return np.concatenate(parts) if parts else np.zeros(0, bool)

    def told(self, x: np.ndarray, ids: np.ndarray, held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray, None]]:
        i, j = map(np.concatenate, zip(*held, strict=True))
        ok = self.close(x, i, j) & (ids[i] != self.ids[j])
        if ok.any():
            yield i[ok], j[ok], None

    def ask(self, x: np.ndarray, ids: np.ndarray, copies: np.ndarray, lists: np.ndarray, first: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """How many vectors here each query links with, and (id, id) of a forest of the links; vectors here are credited in self.n. first: the queries are those here from that position on."""
        n, base, out_a, out_b = np.zeros(len(x), np.int64), np.full(len(x), -1) if first is None else np.arange(first, first + len(x)), [ids[:0]], [ids[:0]]
        for i, j, link in self.links(x, ids, lists):
            if link is None:
                np.add.at(n, i, self.copies[j])
                other = lists[i] != self.lists[j]  # those of the queries' own list ask for themselves
                np.add.at(self.n, j[other], copies[i[other]])
            else:
                n[i] += link @ self.copies[j]
                other = lists[i] != self.lists[j[0]]
                self.n[j] += copies[i[other]] @ link[other]
            if first is None:  # a query from elsewhere hangs on to the first that it links with
                new, at = np.unique(i, return_index=True) if link is None else (i[link.any(axis=1)], link.argmax(axis=1)[link.any(axis=1)])
                new, at = new[base[new] < 0], at[base[new] < 0]
                base[new] = j[at]
                out_a.append(ids[new]), out_b.append(self.ids[j[at]])
            if link is not None:
                left = np.nonzero(link & (self.top[base[i]][:, None] != self.top[j][None, :]))  # base is known wherever there is a link
                i, j = i[left[0]], j[left[1]]
            f = forest(self.top, base[i], j)
            out_a.append(ids[i[f]]), out_b.append(self.ids[j[f]])
        return n, np.concatenate(out_a), np.concatenate(out_b)

    def ask_itself(self) -> tuple[np.ndarray, np.ndarray]:
        """The vectors here ask each other: (id, id) of a forest of the links."""
        out = [(self.ids[:0], self.ids[:0])]
        for lo in range(0, len(self.x), STEP):
            hi = min(lo + STEP, len(self.x))
            n, a, b = self.ask(self.x[lo:hi], self.ids[lo:hi], self.copies[lo:hi], self.lists[lo:hi], lo)
            self.n[lo:hi] += n
            out.append((a, b))
        return tuple(map(np.concatenate, zip(*out, strict=True)))


@dataclass
class Cuts:
    """Where the lists of one label lie in its blocks of `rows` vectors: sizes, the vectors in each list; asking, the blocks that ask in one task."""

    sizes: np.ndarray
    rows: int
    asking: int

    def __post_init__(self) -> None:
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.first, self.last = self.starts // self.rows, np.maximum(self.starts + self.sizes - 1, 0) // self.rows
        lists = [np.flatnonzero((self.sizes > 0) & (self.first <= b) & (self.last >= b)) for b in range(int(self.last.max()) + 1)]
        self.lists = [(x[0], x[-1] + 1) for x in lists]
        #: The last block that any vector may come from, as those of a list over several blocks visit all of them.
        self.latest = np.array([self.last[x].max() for x in lists])

    def home(self, ids: np.ndarray, lists: np.ndarray) -> np.ndarray:
        """Block of each vector."""
        return (self.starts[lists] + (mix(ids.astype(np.uint64)) % self.sizes[lists].astype(np.uint64)).astype(np.int64)) // self.rows

    def tasks(self, home: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, task) by row: where each vector goes. A task is a block and a group of blocks that ask, as one number."""
        reach = reach & (self.sizes > 0)
        visits = np.stack([reach[:, a:b].any(axis=1) for a, b in self.lists], axis=1)
        visits[np.arange(len(home)), home] = False
        row, block = np.nonzero(visits)
        parts = self.latest[home] // self.asking + 1
        own = np.repeat(np.arange(len(home)), parts)
        row, task = np.concatenate([row, own]), np.concatenate([(block << 32) + home[row] // self.asking, (home[own] << 32) + within(parts)])
        order = np.argsort(row, kind="stable")
        return row[order], task[order]


def distance(cosine: float) -> float:
    return float(np.sqrt(max(0.0, 2 - 2 * cosine)))


def near_duplicates(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = 0.98) -> DataFrame:
    """(key, n_links, component_id, kept) of each vector: links join vectors of one label with at least that cosine."""
    element = getattr(df.schema[vector].dataType, "elementType", None)
    kind_v = "array<float>" if isinstance(element, FloatType) else "array<double>"  # single precision stays as it is, at half the size
    rows = df.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_KEY)).alias("id"), F.col(label).alias("label"), F.col(vector).cast(kind_v).alias("v"))
    named = lambda c: F.when(c != NO_KEY, c)
    alone = rows.select(named(F.col("id")).alias(key), F.lit(0).cast("long").alias("n_links"), named(F.col("id")).alias("component_id"), F.lit(True).alias("kept"))
    inf = F.lit(float("inf"))
    # a NaN is above all numbers, so it is the largest part
    finite = (F.array_max("v") < inf) & (F.array_min("v") > -inf) & ((F.array_max("v") != 0) | (F.array_min("v") != 0)) & ~F.exists("v", lambda x: x.isNull())
    sound = F.col("label").isNotNull() & finite
    width = rows.where("v is not null").groupBy(F.size("v").alias("w")).agg(F.count("*").alias("count"), F.approx_count_distinct(F.when(sound, F.xxhash64("v"))).alias("vectors")).orderBy(F.desc("count"), "w").first()
    if width is None or not width.w:
        return alone
    width, about = width.w, max(width.vectors, 1)
    fits = sound & (F.size("v") == width)
    usable = rows.where(fits)
    picked = usable if about <= SAMPLE_ROWS else usable.where(F.pmod(F.xxhash64("v"), F.lit(1 << 30)) < int((1 << 30) * SAMPLE_ROWS / about))
    picked = picked.select("v").distinct().toArrow().column("v")
    if not len(picked):
        picked = usable.select("v").limit(SAMPLE_ROWS).toArrow().column("v")
    if not len(picked):
        return alone
    spark = df.sparkSession
    lists = min(max(LISTS, isqrt(about)), MOST_LISTS)
    model = spark.sparkContext.broadcast(Quantiser.fit(unit_rows(picked, width)[0], lists))  # MOST_LISTS + SUBSPACES * CODEWORDS vectors at most

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = model.value
        for whole in batches:
            for b in (whole.slice(lo, STEP) for lo in range(0, len(whole), STEP)):
                lists, codes, error = q.encode(unit_rows(b.column("v"), width)[0])
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lists.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error)], [*b.schema.names, "list", "codes", "error"])

    kind = rows.schema["label"].dataType.simpleString()
    hashes = [F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), F.col("v")).alias("h2")]
    classes = usable.groupBy("label", "v").agg(F.min("id").alias("least"), F.count("*").alias("copies"))
    # numbers of classes are drawn once and written, so every later reader sees the same
    classes = classes.select(F.monotonically_increasing_id().alias("rep"), "label", "v", "copies", "least", *hashes)
    indexed = materialize(classes.mapInArrow(lean(place), f"rep long, label {kind}, v {kind_v}, copies long, least long, h1 long, h2 long, list int, codes binary, error double"), "index")

    block, asking = max(1, min(MOST_ROWS, BLOCK_BYTES // (8 * width))), ASKING
    sizes = indexed.groupBy("label", "list").agg(F.count("*").alias("n"))
    large = materialize(sizes.groupBy("label").agg(F.sum("n").alias("n")).where(F.col("n") > block).select("label", F.monotonically_increasing_id().alias("large")), "large")
    found = sizes.join(F.broadcast(large), "label").select("large", "list", "n").toArrow()  # at most MOST_LISTS rows for each block
    of = found.column("large").to_numpy()
    cuts = {}
    for one in np.unique(of):
        n = np.zeros(lists, np.int64)
        n[found.column("list").to_numpy()[of == one]] = found.column("n").to_numpy()[of == one]
        cuts[int(one)] = Cuts(n, block, asking)
    known = spark.sparkContext.broadcast(cuts)
    radius = distance(cosine)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each vector with its block and the tasks that it goes to; a label that is not large is one block."""
        q = model.value
        for whole in batches:
            for b in (whole.slice(lo, STEP) for lo in range(0, len(whole), STEP)):
                large = pc.fill_null(b.column("large"), -1).to_numpy(zero_copy_only=False)
                near, home = b.column("list").to_numpy().astype(np.int64), np.zeros(len(b), np.int64)
                row, task = [np.flatnonzero(large < 0)], [np.zeros((large < 0).sum(), np.int64)]
                reach = q.reach(unit_rows(b.column("v"), width)[0], near, radius) if (large >= 0).any() else None
                for one in np.unique(large[large >= 0]).tolist():
                    at, cut = np.flatnonzero(large == one), known.value[one]
                    home[at] = cut.home(b.column("rep").to_numpy()[at], near[at])
                    r, t = cut.tasks(home[at], reach[at])
                    row.append(at[r]), task.append(t)
                row, task = np.concatenate(row), np.concatenate(task)
                order = np.argsort(row, kind="stable")
                tasks = pa.ListArray.from_arrays(pa.array(np.searchsorted(row[order], np.arange(len(b) + 1)).astype(np.int32)), pa.array(task[order]))
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(home), tasks], [*b.schema.names[:-1], "home", "tasks"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links with the data of this task's block: how many vectors each links with, and a spanning forest. The block's own vectors come first."""
        q, held, settled, here = model.value, [], False, None
        own = (np.zeros(0, np.int64),) * 2

        def columns(b: pa.RecordBatch) -> tuple[np.ndarray, ...]:
            return unit_rows(b.column("v"), width)[0], *(b.column(c).to_numpy() for c in ("rep", "copies", "list"))

        def links(ids: np.ndarray, n: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            ids, n = ids[n > 0], n[n > 0]
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in ((ids, a), (ids, b), (n, np.zeros(len(a), np.int64)))], ["a", "b", "n"])

        def settle() -> None:
            """Makes the block of what was held, if anything; its vectors ask each other in one of its tasks."""
            nonlocal here, own, settled
            settled = True
            if held:
                x, ids, copies, lists, codes, error, asks = map(np.concatenate, zip(*held, strict=True))
                held.clear()
                here = Block(q, x, ids, copies, lists, codes, error, cosine)
                own = here.ask_itself() if asks.all() else own

        for whole in batches:
            home, task = whole.column("home").to_numpy(), whole.column("task").to_numpy()
            data = home == task >> 32
            if data.any():
                if settled:
                    raise RuntimeError("a block's vectors come after those that ask")
                b = whole.filter(pa.array(data))
                codes = np.frombuffer(b"".join(b.column("codes").to_pylist()), np.uint8).reshape(len(b), -1)
                held.append((*columns(b), codes, b.column("error").to_numpy(), (home // asking == task & 0xFFFFFFFF)[data]))
            if not data.all():
                if not settled:
                    settle()
                if here is None:  # by chance no vector has its place in this block
                    continue
                b = whole.filter(pa.array(~data))
                x, ids, copies, lists = columns(b)
                order = np.argsort(lists, kind="stable")
                for lo in range(0, len(b), STEP):
                    at = order[lo : lo + STEP]
                    yield links(ids[at], *here.ask(x[at], ids[at], copies[at], lists[at]))
        if not settled:
            settle()
        if here is not None:
            yield links(here.ids, here.n, *own)

    sent = indexed.select("rep", "label", "v", "copies", "list", "codes", "error")
    if cuts:
        kinds = f"rep long, label {kind}, v {kind_v}, copies long, list int, codes binary, error double, home long, tasks array<long>"
        sent = sent.join(F.broadcast(large), "label", "left").select(*sent.columns, "large").mapInArrow(lean(send), kinds).withColumn("task", F.explode("tasks")).drop("tasks")
    else:
        sent = sent.withColumns({"home": F.lit(0).cast("long"), "task": F.lit(0).cast("long")})
    sent = sent.repartition("label", "task").sortWithinPartitions("label", "task", F.col("home") != F.shiftright("task", 32))
    met = materialize(sent.groupBy("label", "task").applyInArrow(meet, "a long, b long, n long"), "met")
    counts = met.where("a = b").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    comp = components(met.where("a <> b").select("a", "b")).withColumnRenamed("node", "rep")
    classes = indexed.select("rep", "label", "copies", "least", "h1", "h2")
    linked = classes.join(comp, "rep")
    smallest = linked.groupBy("component").agg(F.min("least").alias("smallest"))
    of_class = classes.join(counts, "rep", "left").join(linked.select("rep", "component").join(smallest, "component"), "rep", "left")
    of_class = of_class.select("label", "h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("smallest", "least").alias("c"))
    return (
        rows.select("id", "label", *(F.when(fits, h).alias(name) for h, name in zip(hashes, ("h1", "h2"), strict=True))).join(of_class, ["label", "h1", "h2"], "left")
        .select(named(F.col("id")).alias(key), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), named(F.coalesce("c", "id")).alias("component_id"))
        .withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.col("component_id").isNull()))
    )


def op10_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all vectors, within labels."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {"op10_embeddings": op10_embeddings}
