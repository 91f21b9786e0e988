"""N-gram Jaccard join over size-banded tiles.

A document's set is its distinct k-word shingles, as sorted 64-bit hashes. Two sets link when
100 * intersection >= threshold * union, so their difference has at most
(a + b) * (100 - threshold) / (100 + threshold) shingles, and their sizes are in one band or in
neighbouring bands. A tile is one band and one slot: each band cuts the hash range into more
slots than linked sets of that band can differ in, so linked sets agree on whole slots, and
each set goes to the tiles (band, slot, content of the slot) of its own and of the next band.
There are `spare(d)` slots beyond the d + 1 that this needs, so a set may leave as many of its tiles:
first those of poor slots, then those that most sets are in. All sets leave tiles in one order, so of
the tiles that linked sets agree on, at least the last in that order is kept by both.

In a tile, hashed bitmap signatures (parities of the hashes at one to two bits a shingle) bound
the difference from below, hence the overlap from above; what passes is intersected exactly, as
sorted arrays. Equal sets are one node from the start. A tile's nodes are first compared
with the tile's smallest node only (an aggregate and an equi-join, whatever the tile's size).
Those links are contracted; what is left are tiles that still hold nodes of several components
besides their smallest. Near copies share many tiles, so their nodes are not compared tile by tile: each node gets
a hub, the first in a hashed order of the nodes that it shares a tile with, and the nodes of one hub are a group. A tile whose
nodes have one hub is done with its group; after HUBS such groupings, each with another order, the few tiles that are left are
groups themselves, in which nodes that had a hub in common are not compared again. Groups are cut into blocks; pairs of
blocks compare nodes of different components, bitmaps first and then sorted arrays, and return a spanning forest of links.
So no step emits all pairs of a group, comparing takes numbers in a task's memory only, and no link between components is lost.

Defined results
---------------
- null or blank text: no shingles, linked with nothing, component_id = doc_id;
- fewer than k words: the whole sequence is the one shingle;
- rows with the same doc_id are the same node of the graph, each row has its own n_shingles;
- null doc_id: counted, but no node: component_id is null; `representatives` keeps one such row for each set;
- other columns of the input are ignored by `join` and carried by `representatives`.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, components, some
from .textkernel import _STEP, Words, mix, slices

#: A slot with so few shingles says little: many unrelated sets may agree on it.
POOR = 2
#: Nodes of a block, and their shingles: a row holds two blocks.
BLOCK_ROWS, BLOCK_SHINGLES = 4096, 1 << 19
#: Groupings by hubs before the tiles themselves are groups.
HUBS = 3


def spare(most: int) -> int:
    """Slots beyond those that linked sets can differ in, and one more: so many of a set's tiles may be left."""
    return 2 + most // 5


def shingles(words: Words, k: int) -> list[np.ndarray]:
    """Each row's distinct shingles, sorted."""
    at, h = words.runs(k)
    bounds = np.searchsorted(at, words.first)
    count = np.diff(words.first)
    out = [np.unique(h[bounds[r] : bounds[r + 1]]) for r in range(words.rows)]
    for r in np.flatnonzero((count > 0) & (count < k)):
        # as Words.runs has it for a run of that many words
        steps = np.array([pow(_STEP, j, 1 << 64) for j in range(count[r])], dtype=np.uint64)
        total = (words.hash[words.first[r] : words.first[r + 1]] * steps).sum(dtype=np.uint64)
        out[r] = mix(np.array([total]) + np.uint64(count[r]))
    return out


def bitmap(s: np.ndarray) -> bytes:
    """Parities of the hashes' low bits, one to two bits for each shingle."""
    width = 64
    while width < len(s):
        width *= 2
    parity = np.bincount((s & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(parity.astype(np.uint8), bitorder="little").tobytes()


def differ(a: bytes, b: bytes) -> int:
    """At least so many shingles are in one set only."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


class Bands:
    """Size bands [low[i], low[i + 1]) of which linked sets are in one or in two neighbouring ones."""

    def __init__(self, threshold: int):
        self.t, self.low = threshold, [1, 2]

    def most(self, total: int) -> int:
        """The largest difference of linked sets with sizes of this sum."""
        return total * (100 - self.t) // (100 + self.t)

    def _grow(self, n: int) -> None:
        while self.low[-1] <= n:
            self.low.append(max(self.low[-1] + 1, (self.low[-1] - 1) * 100 // self.t + 1))

    def tiles(self, n: int) -> list[tuple[int, int]]:
        """(band, slots) of a set of n shingles; none for a band in which only equal sets link."""
        self._grow(n * 2 + 2)
        i = int(np.searchsorted(self.low, n, side="right")) - 1
        self._grow(self.low[i + 1] * 2 + 2)
        out = []
        for band in (i, i + 1):
            most = self.most(2 * (self.low[band + 1] - 1))
            if most:
                out.append((band, most + 1 + spare(most)))
        return out


def signatures(s: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each tile of a set, and its note: (tiles that may still be left) * 4 + (poor slot) * 2 + (parity of the band).

    Sets with few enough poor slots have left them already; others leave poor slots only, as all tiles in the order before a richer one count.
    """
    total = np.zeros(len(s) + 1, dtype=np.uint64)
    np.cumsum(mix(s ^ np.uint64(0x5851F42D4C957F2D)), out=total[1:])
    out, notes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)]
    for band, slots in bands.tiles(len(s)):
        edge = (np.arange(1, slots, dtype=np.float64) * (2.0**64 / slots)).astype(np.uint64)
        cut = np.concatenate([[0], np.searchsorted(s, edge), [len(s)]])
        size = np.diff(cut)
        key = total[cut[1:]] - total[cut[:-1]]
        name = mix(np.arange(slots, dtype=np.uint64) + np.uint64(band << 32))
        sig = mix(mix(key + size.astype(np.uint64)) ^ name)
        poor, left = size <= POOR, spare(bands.most(2 * (bands.low[band + 1] - 1)))
        if poor.sum() <= left:
            left -= int(poor.sum())
            sig, poor = sig[~poor], poor[~poor]
        else:
            # poor tiles alone use up what may be left, those that no other set emits included
            left = np.where(poor, left, 0)
        out.append(sig)
        notes.append((left * 4 + poor * 2 + band % 2).astype(np.int32))
    return np.concatenate(out), np.concatenate(notes)


def _signed(x) -> np.ndarray:
    return np.ascontiguousarray(x, dtype=np.uint64).view(np.int64)


def _digests(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for salt in (0x9FB21C651E98DF25, 0xD2B74407B1CE6E93):
        out.append(_signed([mix(s ^ np.uint64(salt)).sum(dtype=np.uint64) for s in sets]))
    return out[0], out[1]


def _sets(k: int):
    def run(batches):
        for batch in batches:
            for i, j in slices(batch.column("text")):
                sets = shingles(Words(batch.column("text").slice(i, j - i), lower=True), k)
                h1, h2 = _digests(sets)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i), pa.array([len(s) for s in sets], pa.int64()), pa.array(h1), pa.array(h2), pa.array([bitmap(s) for s in sets], pa.binary())],
                    ["doc_id", "n", "h1", "h2", "bits"],
                )

    return run


def _tiles(k: int, threshold: int):
    def run(batches):
        bands = Bands(threshold)
        for batch in batches:
            for i, j in slices(batch.column("text")):
                sets = [s for s in shingles(Words(batch.column("text").slice(i, j - i), lower=True), k) if len(s)]
                if sets:
                    sigs = [signatures(s, bands) for s in sets]
                    h1 = np.repeat(_digests(sets)[0], [len(x) for x, _ in sigs])
                    tiles, notes = np.concatenate([x for x, _ in sigs]), np.concatenate([x for _, x in sigs])
                    yield pa.RecordBatch.from_arrays([pa.array(_signed(tiles)), pa.array(h1), pa.array(notes)], ["tile", "h1", "note"])

    return run


def _near(threshold: int):
    """Keeps the pairs whose bitmaps allow a link."""

    def run(batches):
        bands = Bands(threshold)
        for batch in batches:
            na, nb = batch.column("na").to_pylist(), batch.column("nb").to_pylist()
            keep = [differ(x, y) <= bands.most(p + q) for x, y, p, q in zip(batch.column("xa").to_pylist(), batch.column("xb").to_pylist(), na, nb)]
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    return run


def _linked(s: np.ndarray, t: np.ndarray, threshold: int) -> bool:
    both = len(np.intersect1d(s, t, assume_unique=True))
    return 100 * both >= threshold * (len(s) + len(t) - both)


def _verify(k: int, threshold: int):
    def run(batches):
        for batch in batches:
            for i, j in slices(batch.column("ta"), 2 << 20):
                one = shingles(Words(batch.column("ta").slice(i, j - i), lower=True), k)
                two = shingles(Words(batch.column("tb").slice(i, j - i), lower=True), k)
                keep = [bool(len(s) and len(t)) and _linked(s, t, threshold) for s, t in zip(one, two)]
                yield batch.select(["a", "b"]).slice(i, j - i).filter(pa.array(keep, pa.bool_()))

    return run


def _arrays(k: int):
    def run(batches):
        for batch in batches:
            for i, j in slices(batch.column("text")):
                sets = shingles(Words(batch.column("text").slice(i, j - i), lower=True), k)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("node").slice(i, j - i), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())],
                    ["node", "n", "s"],
                )

    return run


def _parities(sets: list[np.ndarray], width: int) -> np.ndarray:
    """Parities of the hashes' low bits, a row of 64-bit words for each set."""
    out = np.zeros((len(sets), width), np.uint8)
    for row, s in zip(out, sets):
        row[:] = np.bincount((s & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(out, axis=1, bitorder="little").view(np.uint64)


class Block:
    """Nodes that are compared with one another: links that join different components, a spanning forest of them."""

    def __init__(self, bands: Bands, sets: list[np.ndarray], component: np.ndarray, side: np.ndarray, met: np.ndarray):
        """`side`: nodes of one side, 0 or 1, are not compared, those of side 2 are with all. `met`: labels, nodes that agree on one (but 0) are not compared."""
        order = np.argsort([len(s) for s in sets], kind="stable")
        self.bands, self.order = bands, order
        self.sets = [sets[i] for i in order]
        self.size = np.array([len(s) for s in self.sets], np.int64)
        self.side, self.met = side[order], met[order]
        self.label = np.unique(component[order], return_inverse=True)[1]
        self.width = np.array([1 << max(6, (8 * int(n) - 1).bit_length()) for n in self.size], np.int64)
        self.last = np.searchsorted(self.size, self.size * 100 // bands.t, side="right")
        self.rows: dict[int, tuple[int, np.ndarray]] = {}

    def _bits(self, width: int) -> tuple[int, np.ndarray]:
        """First node and bitmaps of the nodes of this width and of those that they are compared with."""
        if width not in self.rows:
            low, high = np.searchsorted(self.width, [width, width + 1])
            self.rows = {width: (int(low), _parities(self.sets[low : self.last[high - 1]], width))}
        return self.rows[width]

    def forest(self) -> list[tuple[int, int]]:
        out = []
        for x in range(len(self.sets)):
            y = np.arange(x + 1, self.last[x])
            y = y[(self.label[y] != self.label[x]) & ((self.side[y] != self.side[x]) | (self.side[y] == 2))]
            if len(y) and self.met.shape[1]:
                y = y[~((self.met[y] == self.met[x]) & (self.met[x] != 0)).any(axis=1)]
            if not len(y):
                continue
            low, bits = self._bits(int(self.width[x]))
            apart = np.bitwise_count(bits[y - low] ^ bits[x - low]).sum(axis=1)
            near = apart <= self.bands.most(self.size[y] + self.size[x])
            for z in y[near][np.argsort(apart[near], kind="stable")].tolist():
                if self.label[z] != self.label[x] and _linked(self.sets[x], self.sets[z], self.bands.t):
                    self.label[self.label == self.label[z]] = self.label[x]
                    out.append((int(self.order[x]), int(self.order[z])))
        return out


def _forest(threshold: int):
    def run(batches):
        bands = Bands(threshold)
        for batch in batches:
            rows = batch.column("rows")
            at, flat = rows.offsets.to_numpy(), rows.values
            node, side, component = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("node", "side", "component"))
            met = np.stack([flat.field(c).to_numpy(zero_copy_only=False) for c in ("met0", "met1", "met2")], axis=1)
            s, links = flat.field("s"), []
            for i, j in zip(at[:-1], at[1:]):
                sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in s[i:j]]
                links += [(node[i + x], node[i + y]) for x, y in Block(bands, sets, component[i:j], side[i:j], met[i:j]).forest()]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], ["a", "b"])

    return run


def _compared(scratch: Scratch, threshold: int, groups: DataFrame, arrays: DataFrame, found: DataFrame, name: str) -> DataFrame:
    """The components (node, component) of `found` and of the links that groups (key, node, component, met0..2) hold.

    A group's largest component is not compared with itself: it is cut into blocks, which all other nodes visit,
    and pairs of blocks of the others meet. Of large groups, the first block is visited first, then eight times
    as many, and so on: nodes that have many links find one of them soon, so that few links are found again by several blocks.
    """
    weighed = scratch.cut(groups.join(arrays.groupBy("node").agg(F.sum("n").alias("w")), "node"), f"{name}_groups")
    blocks = lambda n, w: F.greatest(F.ceil(n / BLOCK_ROWS), F.ceil(w / BLOCK_SHINGLES)).cast("int")
    met = ["met0", "met1", "met2"]
    limit, step = 1, 0
    while True:
        each = weighed.groupBy("key", "component").agg(F.count("*").alias("n"), F.sum("w").alias("w"))
        top = each.groupBy("key").agg(F.max(F.struct("n", "component", "w")).alias("top"), F.sum("n").alias("n"), F.sum("w").alias("w")).where("top.n < n")
        homes, guests = blocks(F.col("top.n"), F.col("top.w")), blocks(F.col("n") - F.col("top.n"), F.col("w") - F.col("top.w"))
        top = scratch.cut(top.select("key", F.col("top.component").alias("main"), homes.alias("homes"), guests.alias("guests")), f"{name}_top{step}")
        most = top.agg(F.max(F.greatest("homes", "guests"))).first()[0]
        if most is None:
            break
        rest = weighed.join(top, "key")
        at = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
        upto = lambda n: F.sequence(F.lit(0), F.least(n, F.lit(limit)) - 1)
        home = rest.where("component = main").select("key", "node", "component", *met, at(F.col("homes")).alias("j"), F.lit(0).alias("side"), "guests").where(F.col("j") < limit)
        guest = rest.where("component <> main")
        # row (i, j): the others' block i and the main component's block j, which each home is copied to for every i; -1 - j for the others' block j
        home = home.select("key", "node", "component", *met, F.explode(F.sequence(F.lit(0), F.col("guests") - 1)).alias("i"), "j", "side")
        visit = guest.select("key", "node", "component", *met, at(F.col("guests")).alias("i"), F.explode(upto(F.col("homes"))).alias("j"), F.lit(1).alias("side"))
        # pairs (i, j) of the others' blocks, fewer than `limit` apart; a node meets its own block once and every other block once
        own = guest.withColumn("own", at(F.col("guests")))
        other = F.sequence(F.greatest(F.lit(0), F.col("own") - limit + 1), F.least(F.col("guests"), F.col("own") + limit) - 1)
        own = own.withColumn("other", F.explode(other))
        side = F.when(F.col("own") == F.col("other"), 2).otherwise((F.col("own") > F.col("other")).cast("int"))
        own = own.select("key", "node", "component", *met, F.least("own", "other").alias("i"), (-1 - F.greatest("own", "other")).alias("j"), side.alias("side"))
        spread = home.unionByName(visit).unionByName(own).join(arrays.select("node", "s"), "node")
        row = F.struct("node", "side", "component", *met, "s")
        new = spread.groupBy("key", "i", "j").agg(F.collect_list(row).alias("rows")).select("rows").mapInArrow(_forest(threshold), "a long, b long")
        new = scratch.cut(new.distinct(), f"{name}_links{step}")
        scratch.drop(f"{name}_top{step}")
        if some(new):
            stars = found.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
            found = scratch.cut(components(scratch, stars.unionByName(new), f"{name}_cc{step}"), f"{name}_components{step}")
            if most > limit:
                weighed = weighed.join(found.withColumnRenamed("component", "new"), "node", "left").withColumn("component", F.coalesce("new", "component")).drop("new")
                weighed = scratch.cut(weighed, f"{name}_groups{step}")
        if most <= limit:
            break
        limit, step = limit * 8, step + 1
    return found


def _open_tiles(scratch: Scratch, rest: DataFrame, found: DataFrame, name: str) -> DataFrame:
    """`rest` (tile, node, more) with components, of the tiles whose nodes are of several."""
    rest = rest.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = rest.groupBy("tile").agg(F.min("component").alias("p"), F.max("component").alias("q")).where("p < q").select("tile")
    return scratch.cut(rest.join(mixed, "tile"), name)


def _by_hubs(scratch: Scratch, threshold: int, rest: DataFrame, texts, k: int, found: DataFrame) -> DataFrame:
    """The components (node, component) with the links between nodes of one tile of `rest` (tile, node, component). `texts` gives (doc_id, text) of nodes."""
    cut, drop, met = scratch.cut, scratch.drop, [f"met{salt}" for salt in range(HUBS)]
    # a node's hubs: in each of several hashed orders, the first of the nodes that it shares a tile with
    first = lambda salt: F.struct(F.xxhash64(F.lit(salt), "node").alias("h"), F.col("node").alias("hub"))
    least = rest.groupBy("tile").agg(*[F.min(first(salt)).alias(m) for salt, m in enumerate(met)])
    hub = rest.join(least, "tile").groupBy("node").agg(*[F.min(m).alias(m) for m in met])
    hub = hub.select("node", *[F.xxhash64(F.lit(salt), f"{m}.hub").bitwiseOR(F.lit(1)).alias(m) for salt, m in enumerate(met)])
    # all hubs meet the tiles in one join, as there are many more places in tiles than nodes
    told = cut(rest.join(hub, "node"), "told")
    # tiles whose nodes have one hub are done when its group is; `done` is the first such hub's number, HUBS for none
    ends = told.groupBy("tile").agg(*[(F.min(m) == F.max(m)).alias(m) for m in met])
    done = reduce(lambda later, n: F.when(F.col(met[n]), n).otherwise(later), reversed(range(HUBS)), F.lit(HUBS))
    told = told.join(ends.select("tile", done.alias("done")), "tile")
    none = F.lit(0).cast("long")
    # a node without a tile for a hub's group is in none
    hubs = told.groupBy("node", "component", *met).agg(F.max("done").alias("done"))
    hubs = cut(hubs.select("node", "component", *[F.when(F.col("done") >= n, F.col(m)).otherwise(none).alias(m) for n, m in enumerate(met)]), "hubs")
    rest = told.where(F.col("done") == HUBS).select("tile", "node", *met)
    arrays = texts(hubs.select("node")).select(F.col("doc_id").alias("node"), "text").mapInArrow(_arrays(k), "node long, n long, s binary")
    arrays = cut(arrays.where("n > 0"), "arrays")
    # a group's nodes with an earlier hub in common are not compared again
    groups = [hubs.where(F.col(m) != 0).select(F.col(m).alias("key"), "node", "component", *[e if i < n else none.alias(e) for i, e in enumerate(met)]) for n, m in enumerate(met)]
    found = _compared(scratch, threshold, reduce(DataFrame.unionByName, groups), arrays, found, "hub")
    last = _open_tiles(scratch, rest, found, "last")
    if some(last):
        groups = last.select(F.col("tile").alias("key"), "node", "component", *met)
        found = _compared(scratch, threshold, groups, arrays, found, "tile")
    drop("arrays", "told", "hubs", "last")
    return found


def graph(docs: DataFrame, k: int = 3, threshold: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of `docs` (doc_id, text)."""
    scratch = Scratch(docs.sparkSession, "jaccard")
    cut, drop = scratch.cut, scratch.drop
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts = docs.where("doc_id is not null and text is not null")
    sets = cut(docs.mapInArrow(_sets(k), "doc_id long, n long, h1 long, h2 long, bits binary"), "sets")
    ids = sets.where("n > 0 and doc_id is not null")
    classes = cut(ids.groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("node")), "classes")

    tiles = texts.mapInArrow(_tiles(k, threshold), "tile long, h1 long, note int")
    # copies agree on h1: a tile of copies alone needs no work
    shared = tiles.groupBy("tile").agg(F.min("h1").alias("p"), F.max("h1").alias("q"), F.count("*").alias("m"))
    shared = cut(shared.where("p <> q").select("tile", "m"), "shared")
    # each set leaves its most common tiles; a set has no more tiles than shingles, so windows are as short as texts
    order = Window.partitionBy("h1", F.col("note") % 2).orderBy(F.desc(F.shiftright("note", 1) % 2), F.desc("m"), "tile")
    members = tiles.join(shared, "tile").distinct().withColumn("nth", F.row_number().over(order)).where(F.col("nth") > F.shiftright("note", 2))
    members = cut(members.select("tile", "h1"), "members_h")
    members = cut(members.join(classes.select("h1", "node"), "h1").select("tile", "node").distinct(), "members")
    drop("shared", "members_h")

    centre = members.groupBy("tile").agg(F.min("node").alias("b"))
    pairs = members.join(centre, "tile").where("node <> b").select(F.col("node").alias("a"), "b").distinct()
    bits = classes.join(sets.select(F.col("doc_id").alias("node"), "h1", "h2", "n", "bits"), ["node", "h1", "h2", "n"]).select("node", "n", "bits").distinct()
    bits = cut(bits, "bits")
    left = bits.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("bits").alias("xa"))
    right = bits.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("xb"))
    pairs = cut(pairs.join(left, "a").join(right, "b").mapInArrow(_near(threshold), "a long, b long").distinct(), "pairs")

    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    near = cut(texts.join(nodes, texts.doc_id == nodes.node, "left_semi").distinct(), "texts")
    one = near.select(F.col("doc_id").alias("a"), F.col("text").alias("ta"))
    two = near.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))
    links = cut(pairs.join(one, "a").join(two, "b").mapInArrow(_verify(k, threshold), "a long, b long").distinct(), "star")
    drop("texts", "pairs", "bits")
    found = cut(components(scratch, links), "components")

    # what the smallest nodes leave open: pairs of other nodes of one tile in different components
    rest = _open_tiles(scratch, members.join(centre, "tile").where("node <> b").select("tile", "node"), found, "rest")
    drop("members")
    if some(rest):
        found = _by_hubs(scratch, threshold, rest, lambda wanted: texts.join(wanted, texts.doc_id == wanted.node, "left_semi").distinct(), k, found)
    labels = classes.join(found, "node", "left").select("h1", "h2", "n", F.coalesce("component", "node").alias("component"))
    # rows that share an id share the smallest label of their sets
    rows = sets.join(labels, ["h1", "h2", "n"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component"))
    return rows.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component_id"))


def _digested(k: int):
    def run(batches):
        for batch in batches:
            for i, j in slices(batch.column("text")):
                part = batch.slice(i, j - i)
                sets = shingles(Words(part.column("text"), lower=True), k)
                h1, h2 = _digests(sets)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([len(s) for s in sets], pa.int64()), pa.array(h1), pa.array(h2)], [*part.schema.names, "__n", "__h1", "__h2"])

    return run


def representatives(docs: DataFrame, k: int = 5, threshold: int = 80) -> DataFrame:
    """One row for each doc_id that is the smallest of its component, and for each set of the rows without a doc_id.

    Of several rows, the one with the smallest text stays, as far as there is one; rows without doc_id and shingles all stay.
    """
    scratch = Scratch(docs.sparkSession, "representatives")
    labels = graph(docs, k, threshold).where("doc_id is not null").groupBy("doc_id").agg(F.min("component_id").alias("__c"), F.count("*").alias("__rows"))
    labels = scratch.cut(labels.withColumnRenamed("doc_id", "__d").where("__c <> __d or __rows > 1"), "labels")
    again = labels.where("__c = __d").select("__d")
    plain = docs.toDF(*["text" if c == "text" else f"c{n}" for n, c in enumerate(docs.columns)])
    at = F.col(f"c{docs.columns.index('doc_id')}")
    order = [F.asc_nulls_last("text"), *[c for c, t in plain.dtypes if c != "text" and "map<" not in t and t != "variant"]]

    def one(rows: DataFrame, *keys) -> DataFrame:
        return rows.withColumn("__nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__nth = 1").select(plain.columns)

    kept = plain.join(labels.select("__d"), at == F.col("__d"), "left_anti")
    if some(again):
        kept = kept.unionByName(one(plain.join(again, at == F.col("__d"), "left_semi"), at))
    if some(docs.where("doc_id is null")):
        schema = plain.select("*", F.lit(0).cast("long").alias("__n"), F.lit(0).cast("long").alias("__h1"), F.lit(0).cast("long").alias("__h2")).schema
        digested = plain.where(at.isNull()).mapInArrow(_digested(k), schema)
        kept = kept.where(at.isNotNull()).unionByName(one(digested.where("__n > 0"), "__n", "__h1", "__h2")).unionByName(digested.where("__n = 0").select(plain.columns))
    return kept.toDF(*docs.columns)
