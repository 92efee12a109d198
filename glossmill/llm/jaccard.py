"""N-gram Jaccard join (operator 3): an exact similarity join in the Jaccard metric space, reduced to components.

1. Every document becomes its set of 5-word shingles (64-bit hashes) and a fingerprint of the set; equal sets are one point.
2. Pivots: a bounded sample of documents, thinned until none is within distance 0.2 of another. Each task measures the exact distances
   of its points to all pivots. A point within 0.2 of a pivot is linked to it and belongs to the Voronoi cell of its nearest one; a
   point further away, but by no more than 0.2 beyond the cell's radius, may still be linked to some point of that cell (the triangle
   inequality) and is replicated into it. Points of one cell are connected already, so a cell is joined only with its replicas, and
   only with its points that the inequality leaves; cells without replicas are done.
3. Points that no pivot is near are joined with each other recursively, with the finest pivots that sets have, single shingles: sets
   within distance 0.2 share one of the first n - ceil(0.8 n) + 1 shingles in any fixed order, so a point enters the region of each of
   those. The order puts frequent shingles last, which keeps regions small.
4. In each region, leaders attach points in the Hamming space of parity sketches (2 to 4 bits an element), whose distance never exceeds the sets'
   difference. A point joins every leader within two radii (the triangle inequality), so the groups that come out, merged over all
   regions, hold every pair within distance 0.2. Regions of more than REGION_POINTS points are dealt over tasks (pivot_links).
5. Each cell and group is joined exactly on its full sets: a pivot's distances to the others give links, and the points that no links
   connect yet are joined on. One too large for one task is dealt over tasks (pivot_links), many pivots a round.
6. Components of the links; each document gets the smallest doc_id of its own.

Nothing is capped: large cells, regions and groups take more steps. Documents without words are linked with nothing. Ids may be null
(ignored for component_id unless all are) or repeat; equal rows are equal points. An empty table gives an empty one; only the id and
text columns are read, so other columns can't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glossmill.llm.components import components
from glossmill.llm.shared import attach, dealt_documents, dropped, dropped_later, give_back, most_frequent, parted, per_batch, slices, utf8, written
from glossmill.llm.shingles import mixed, shingle_sets

#: Jaccard similarity of at least NEED / 100.
NEED = 80
#: Least bits of a sketch.
SKETCH = 256
#: Frequent shingles: met at least HOT_DF times in blocks that hold them twice; at most MAX_HOT of them (2 MB) are broadcast. They
#: only decide an order.
HOT_DF, MAX_HOT, COUNT_BLOCK = 10, 1 << 18, 1 << 21
#: Documents that serve as pivots, at most; hashes of all their sets and of one, at most: 8 MB for the driver and each worker to hold.
DOC_PIVOTS, PIVOT_HASHES, PIVOT_SIZE = 1_024, 1 << 20, 1 << 12
#: Hashes of a group's sets that one task may hold (24 MB).
GROUP_HASHES = 3_000_000
#: Points of a region that one task may hold; pivots of a round for each larger one, and at most about so many per task in the last round.
REGION_POINTS, PIVOTS, CHUNK = 2_000, 64, 1_024
#: Bytes of whole regions that a task gathers before it joins them.
HELD_BYTES = 16 << 20
#: About so many (pivot, hash) pairs are counted at once.
PAIRS = 1_000_000


def sets_of(texts: list[str | None]) -> list[np.ndarray]:
    return shingle_sets([utf8(t).lower() for t in texts])


def fingerprint(own: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(own.tobytes(), digest_size=8).digest(), "little", signed=True)


def sketch(own: np.ndarray) -> bytes:
    """Parities of the shingles' buckets, a power of two of them: two sketches differ in at most as many bits as the sets in elements."""
    size = max(SKETCH, 1 << (2 * len(own) - 1).bit_length())
    return np.packbits(np.bincount((own >> np.uint64(24)).astype(np.int64) & (size - 1), minlength=size) & 1).tobytes()


def halved(bits: np.ndarray) -> np.ndarray:
    """Sketches with half as many buckets."""
    half = bits.shape[-1] // 2
    return bits[..., :half] ^ bits[..., half:]


class Sketches:
    """Sketches of points ordered by size, as one matrix for each length."""

    def __init__(self, bits: list[bytes]) -> None:
        length = np.array([len(b) for b in bits])
        self.starts = np.concatenate([[0], np.flatnonzero(np.diff(length)) + 1, [len(bits)]])
        self.full = [np.frombuffer(b"".join(bits[a:b]), np.uint64).reshape(b - a, -1) for a, b in zip(self.starts[:-1], self.starts[1:], strict=True)]
        self.half = [halved(m) for m in self.full]

    def differ(self, k: int, a: int, b: int) -> np.ndarray:
        """Least numbers of elements in which point k differs from points a to b."""
        own = int(np.searchsorted(self.starts, k, "right")) - 1
        row = k - self.starts[own]
        out = []
        for c in range(len(self.full)):
            lo, hi = max(a, self.starts[c]) - self.starts[c], min(b, self.starts[c + 1]) - self.starts[c]
            if hi > lo:
                x, y = self.full[own][row], self.full[c]
                if len(x) > y.shape[1]:
                    x = self.half[own][row]
                elif len(x) < y.shape[1]:
                    y = self.half[c]
                if len(x) != y.shape[1]:  # more than twice the size: only the sizes tell
                    out.append(np.zeros(hi - lo, np.int64))
                else:
                    out.append(np.bitwise_count(y[lo:hi] ^ x).sum(axis=1, dtype=np.int64))
        return np.concatenate(out)


def frequent_shingles(docs: DataFrame) -> np.ndarray:
    """Sorted hashes of frequent shingles. Tasks count blocks of their own rows and pass on what a block holds twice or more."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            values, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *held]), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(values[n > 1].view(np.int64)), pa.array(n[n > 1])], ["h", "n"])

        for batch in batches:
            for part in slices(batch, 500):
                held.extend(sets_of(part.column(0).to_pylist()))
                if sum(map(len, held)) > COUNT_BLOCK:
                    yield out()
        yield out()
        give_back()

    counts = docs.select("text").mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    top = most_frequent(counts.filter(F.col("n") >= HOT_DF), "h", MAX_HOT, "jaccard-frequent")
    return np.sort(np.array(top, np.int64).view(np.uint64))


class Pivots:
    """The sets of the documents that serve as pivots, as an index from shingles to pivots."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.size = np.array([len(s) for s in sets], np.int64)
        self.fp = np.array([fingerprint(s) for s in sets], np.int64)
        values = np.concatenate([np.zeros(0, np.uint64), *sets])
        order = np.argsort(values, kind="stable")
        self.values, self.owner = values[order], np.repeat(np.arange(len(sets), dtype=np.int32), self.size)[order]

    def close(self, sets: list[np.ndarray]) -> list[list[tuple[int, float]]]:
        """For each set the pivots (number, distance) within WIDE percent, nearest first."""
        out: list[list[tuple[int, float]]] = [[] for _ in sets]
        if not len(self.values) or not sets:
            return out
        n = np.array([len(s) for s in sets], np.int64)
        flat, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
        first = np.searchsorted(self.values, flat, "left")
        many = np.searchsorted(self.values, flat, "right") - first
        cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(many) // PAIRS)) + 1).tolist(), len(flat)]
        both = np.zeros(len(sets) * len(self.size), np.int64)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            place = np.repeat(first[a:b] - np.cumsum(many[a:b]) + many[a:b], many[a:b]) + np.arange(many[a:b].sum())
            both += np.bincount(self.owner[place] + len(self.size) * np.repeat(row[a:b], many[a:b]), minlength=len(both))
        found = np.flatnonzero(both)
        r, p, both = found // len(self.size), found % len(self.size), both[found]
        union = n[r] + self.size[p] - both
        inside = ~far(union - both, union + both, WIDE)
        distance = 1 - both / union
        for k in np.lexsort((p, distance, r)).tolist():
            if inside[k]:
                out[int(r[k])].append((int(p[k]), float(distance[k])))
        return out


#: Two radii, in percent.
WIDE = 2 * (100 - NEED)
#: What rounding may add to a distance.
SLACK = 1e-9


def far(differ: np.ndarray, total: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of `total` elements together that differ in at least `differ` are further apart than percent / 100."""
    return 200 * differ > percent * (total + differ)


def document_pivots(docs: DataFrame) -> Pivots:
    """Pivots from a sample of the rows' texts, by hash; bounded by DOC_PIVOTS, PIVOT_HASHES and PIVOT_SIZE.

    Which documents serve decides only where a pair is found. A set within the distance of an earlier one doesn't serve.
    """
    hashed = docs.select("text", F.xxhash64("text").alias("h"))
    limit = int(2**64 * min(1.0, 1.5 * DOC_PIVOTS / max(1, docs.count()))) - 2**63
    sample = hashed.filter(F.col("h") <= min(limit, 2**63 - 1)).groupBy("h").agg(F.first("text").alias("text"))

    def sets(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = [s if 0 < len(s) <= PIVOT_SIZE else s[:0] for s in sets_of(batch.column("text").to_pylist())]
        return pa.RecordBatch.from_arrays([batch.column("h"), pa.array([s.tobytes() for s in own], pa.binary())], ["h", "elements"])

    found = per_batch(sample, sets, "h long, elements binary").filter("length(elements) > 0").orderBy("h").limit(DOC_PIVOTS).collect()
    chosen: list[np.ndarray] = []
    held: dict[int, list[int]] = {}  # the chosen sets that have a shingle
    total = 0
    for r in found:
        own = as_set(r.elements)
        if total + len(own) > PIVOT_HASHES:
            break
        both = np.bincount([k for h in own.tolist() for k in held.get(h, ())], minlength=len(chosen))
        if not any(100 * c >= NEED * (len(own) + len(chosen[k]) - c) for k, c in enumerate(both.tolist())):
            for h in own.tolist():
                held.setdefault(h, []).append(len(chosen))
            chosen.append(own)
            total += len(own)
    return Pivots(chosen)


NEAR = "p long, d double"


def points(docs: DataFrame) -> DataFrame:
    """doc_id, th, n, fp per row, with home (its cell, the fingerprint of the nearest pivot within the distance) and away (how far it is),
    others (further pivots within the distance), shell (pivots within two radii, and how far they are), and for points without a home
    keys (the shingles whose regions they enter) and bits (the sketch). Null fp for empty sets; th: a hash of the text."""
    hot = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs))
    chosen = docs.sparkSession.sparkContext.broadcast(document_pivots(docs))
    near = pa.list_(pa.struct([("p", pa.int64()), ("d", pa.float64())]))

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        common, pivots = hot.value, chosen.value
        sets = sets_of(batch.column("text").to_pylist())
        out: dict[str, list] = {c: [] for c in ("n", "fp", "home", "away", "others", "shell", "keys", "bits")}
        for own, close in zip(sets, pivots.close(sets), strict=True):
            linked_to = [(p, d) for p, d in close if d <= 1 - NEED / 100 + SLACK]
            row = {"n": len(own), "fp": fingerprint(own) if len(own) else None, "home": None, "away": None, "others": [], "keys": [], "bits": None}
            row["shell"] = [{"p": int(pivots.fp[p]), "d": d} for p, d in close if d > 1 - NEED / 100 + SLACK]
            if linked_to:
                row |= {"home": int(pivots.fp[linked_to[0][0]]), "away": linked_to[0][1], "others": [int(pivots.fp[p]) for p, _ in linked_to[1:]]}
            elif len(own):
                row["bits"] = sketch(own)
                if len(common):
                    at = np.minimum(np.searchsorted(common, own), len(common) - 1)
                    usual = common[at] == own
                    own = np.concatenate([own[~usual], own[usual]])
                row["keys"] = own[: len(own) + (-len(own) * NEED // 100) + 1].view(np.int64)
            for c, values in out.items():
                values.append(row[c])
        kinds = {"n": pa.int64(), "fp": pa.int64(), "home": pa.int64(), "away": pa.float64(), "others": pa.list_(pa.int64()), "shell": near, "keys": pa.list_(pa.int64()), "bits": pa.binary()}
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), *(pa.array(out[c], k) for c, k in kinds.items())], ["doc_id", "th", *kinds])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    return per_batch(rows, make, f"doc_id {kind}, th long, n long, fp long, home long, away double, others array<long>, shell array<struct<{NEAR}>>, keys array<long>, bits binary", 200)


def cells(distinct: DataFrame) -> DataFrame:
    """(grp, fp, label) of the members of the cells that have replicas: the replicas with their own label, and the points of the cell
    that may be linked with one, labelled with the pivot. Tables with a row for each pivot are broadcast, DOC_PIVOTS rows at most."""
    reach = 1 - NEED / 100 + SLACK
    core = distinct.filter("home is not null").select("home", "away", "fp")
    radius = core.groupBy("home").agg(F.max("away").alias("radius"))
    shell = distinct.select("fp", F.explode("shell").alias("s")).select("fp", F.col("s.p").alias("home"), F.col("s.d").alias("d"))
    replicas = shell.join(F.broadcast(radius), "home").filter(F.col("d") <= F.col("radius") + reach)
    least = replicas.groupBy("home").agg(F.min("d").alias("least"))
    inner = core.join(F.broadcast(least), "home").filter(F.col("away") >= F.col("least") - reach)
    return replicas.select(F.col("home").alias("grp"), "fp", F.col("fp").alias("label")).unionByName(inner.select(F.col("home").alias("grp"), "fp", F.col("home").alias("label")))


def shared_regions(rows: DataFrame) -> DataFrame:
    """(region, fp, size) of the regions with two points or more, from (key, fp) rows sorted by key.

    A region's name is a hash of its points, so regions with the same points are one. Streams over sorted rows; what must be together
    is only neighbouring rows of a key.
    """

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        keep = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def out(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            starts = np.flatnonzero(np.diff(key, prepend=key[:1] - 1)) if len(key) else np.zeros(0, np.int64)
            sizes = np.diff(starts, append=len(key))
            sums = np.add.reduceat(fp.view(np.uint64), starts) if len(starts) else np.zeros(0, np.uint64)
            marks = mixed(sums + sizes.astype(np.uint64)).view(np.int64)
            good = np.zeros(len(starts), bool)
            for k in np.flatnonzero(sizes > 1).tolist():
                if int(marks[k]) not in seen:
                    good[k] = True
                    seen.add(int(marks[k]))
            if len(seen) > 200_000:
                seen.clear()
            rows = np.repeat(good, sizes)
            return pa.RecordBatch.from_arrays([pa.array(np.repeat(marks, sizes)[rows]), pa.array(fp[rows]), pa.array(np.repeat(sizes, sizes)[rows], pa.int64())], ["region", "fp", "size"])

        for batch in batches:
            key, fp = (np.concatenate([k, batch.column(c).to_numpy()]) for c, k in enumerate(keep))
            last = int(np.searchsorted(key, key[-1])) if len(key) else 0  # the last key may go on
            yield out(key[:last], fp[:last])
            keep = key[last:], fp[last:]
        yield out(*keep)

    return rows.mapInArrow(pick, "region long, fp long, size long").distinct()


def around(n: np.ndarray, bits: Sketches, k: int) -> tuple[int, int, np.ndarray]:
    """The points a to b, ordered by size, that aren't too small or large to be within two radii of point k, and how much they differ at least."""
    # A smaller set has at least 100 - 2 (100 - NEED) percent of the larger one's elements.
    a, b = int(np.searchsorted(n, n[k] * (100 - WIDE) / 100, "left")), int(np.searchsorted(n, n[k] * 100 / (100 - WIDE), "right"))
    return a, b, np.maximum(bits.differ(k, a, b), np.abs(n[a:b] - n[k]))


def leader_edges(fp: np.ndarray, n: np.ndarray, bits: list[bytes]) -> list[tuple[int, int]]:
    """A forest of edges that connects all points of one region which may be within the distance (see step 3)."""
    edges: list[tuple[int, int]] = []
    order = np.argsort(n, kind="stable")
    fp, n, bits = fp[order], n[order], Sketches([bits[k] for k in order.tolist()])
    left = np.ones(len(fp), bool)
    root = np.arange(len(fp))
    for k in range(len(fp)):
        if not left[k]:
            continue
        if (root == root[0]).all():
            break
        a, b, differ = around(n, bits, k)
        inside = ~far(differ, n[a:b] + n[k], WIDE)
        for r in np.unique(root[a:b][inside]).tolist():  # one edge for each part of the region that joins
            if r != root[k]:
                edges.append((int(fp[k]), int(fp[r])))
                root[root == r] = root[k]
        left[a:b] &= far(differ, n[a:b] + n[k], 100 - NEED)
        left[k] = False
    return edges


def region_edges(members: DataFrame) -> DataFrame:
    """(a, b) edges of all regions, from (region, fp, n, bits) rows grouped by region."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = size = 0

        def out(whole: bool) -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks() if held else None
            held.clear()
            edges: set[tuple[int, int]] = set()
            if table is not None and table.num_rows:
                region = table.column("region").to_numpy()
                stop = table.num_rows if whole else int(np.flatnonzero(region != region[-1])[-1:].sum() + 1) if (region != region[-1]).any() else 0
                fp, n = table.column("fp").to_numpy(), table.column("n").to_numpy()
                bits = table.column("bits").slice(0, stop).to_pylist()
                cuts = [0, *(np.flatnonzero(np.diff(region[:stop])) + 1).tolist(), stop] if stop else [0]
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    edges.update(leader_edges(fp[a:b], n[a:b], bits[a:b]))
                if stop < table.num_rows:
                    held.extend(table.slice(stop).to_batches())
            return pa.RecordBatch.from_arrays([pa.array([e[0] for e in edges], pa.int64()), pa.array([e[1] for e in edges], pa.int64())], ["a", "b"])

        for batch in batches:
            for at in range(0, batch.num_rows, REGION_POINTS):
                held.append(part := batch.slice(at, REGION_POINTS))
                rows, size = rows + part.num_rows, size + part.nbytes
                if rows >= 50_000 or size >= HELD_BYTES:
                    yield out(False)
                    rows, size = sum(b.num_rows for b in held), sum(b.nbytes for b in held)
        yield out(True)

    return members.mapInArrow(join, "a long, b long")


def close_sketches(n: np.ndarray, bits: list[bytes], pivots: int) -> np.ndarray:
    """For the first `pivots` points, as a matrix, whether each of the other points may be within two radii."""
    order = np.argsort(n, kind="stable")
    size, made = n[order], Sketches([bits[k] for k in order.tolist()])
    out = np.zeros((pivots, len(n)), bool)
    for k in np.flatnonzero(order < pivots).tolist():
        a, b, differ = around(size, made, k)
        out[order[k], order[a:b]] = ~far(differ, size[a:b] + size[k], WIDE)
    return out[:, pivots:]


def pivot_edges(rows: DataFrame, close: Callable[[np.ndarray, list[bytes], int], np.ndarray]) -> DataFrame:
    """(a, b) edges that connect pivots with the members close to them, where labels differ, from (unit, chunk, part, member, fp, n, data,
    label) rows grouped by unit, chunk and part, pivots first. Holds the pivots of one part; members stream past them."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, root = None, pa.table({}), np.zeros(0, np.int64)
        for batch in batches:
            unit, chunk, part, member = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            change = (np.diff(unit) != 0) | (np.diff(chunk) != 0) | (np.diff(part) != 0) | (member[1:] != member[:-1])
            cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows] if batch.num_rows else [0]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                key, run = (unit[a], chunk[a], part[a]), pa.Table.from_batches([batch.slice(a, b - a)])
                if not member[a]:
                    held = pa.concat_tables([held, run]) if now == key else run
                    now, root = key, np.unique(held.column("label").to_numpy(), return_inverse=True)[1]
                elif now == key:
                    for at in range(0, run.num_rows, 500):
                        yield edges(held, run.slice(at, 500), root)

    def edges(held: pa.Table, others: pa.Table, root: np.ndarray) -> pa.RecordBatch:
        both = pa.concat_tables([held, others])
        pfp, fp = held.column("fp").to_numpy(), others.column("fp").to_numpy()
        hit = close(both.column("n").to_numpy(), both.column("data").to_pylist(), len(pfp))
        hit &= held.column("label").to_numpy()[:, None] != others.column("label").to_numpy()
        found = []
        for k in np.flatnonzero(hit.any(axis=0)).tolist():
            pivots = np.flatnonzero(hit[:, k])
            found.append((pfp[pivots[0]], fp[k]))
            for r in np.unique(root[pivots]).tolist():  # pivots that this point joins
                if r != root[pivots[0]]:
                    found.append((pfp[pivots[0]], pfp[pivots[root[pivots] == r][0]]))
                    root[root == r] = root[pivots[0]]
        return pa.RecordBatch.from_arrays([pa.array([int(e[k]) for e in found], pa.int64()) for k in range(2)], ["a", "b"])

    return rows.mapInArrow(join, "a long, b long")


def pivot_links(members: DataFrame, close: Callable[[np.ndarray, list[bytes], int], np.ndarray], name: str) -> DataFrame:
    """(a, b) edges that connect whatever chains of close points connect in each unit, over (unit, fp, n, data, label) rows of units too
    large for a task; points with equal labels are connected already.

    A round compares a few pivots of each unit with all its points. Points that are connected by then need no comparison with each
    other, so only those outside a unit's largest component are open, and the next pivots come from them. While rounds halve the
    open points they go on; the last one compares all that are open with all points, dealt over tasks by pivots and points.
    """
    ids = ["unit", "fp"]
    left, rest = members.select(*ids, "label"), None
    members = members.drop("label")
    edges = left.filter("label <> fp").select(F.col("label").alias("a"), F.col("fp").alias("b"))
    largest = lambda rows: rows.groupBy("unit", "label").count().groupBy("unit").agg(F.max_by("label", "count").alias("most"))
    most = largest(left)
    while True:
        opened = left.join(F.broadcast(most), "unit").filter("label <> most").drop("most")
        last, rest = rest, opened.count()
        if not rest:
            return edges
        final = rest <= PIVOTS or (last is not None and 2 * rest > last)
        if final:
            chunks = opened.join(members, ids).groupBy("unit").agg(F.ceil(F.greatest(F.count("*") / CHUNK, F.sum(F.length("data")) / (8 * GROUP_HASHES))).alias("chunks"))
            chosen = opened.join(F.broadcast(chunks), "unit").withColumn("chunk", F.pmod(F.xxhash64("fp", F.lit("chunk")), "chunks"))
        else:
            order = Window.partitionBy("unit").orderBy(F.xxhash64("fp", F.lit("pivot")), "fp")
            chosen = opened.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= PIVOTS).drop("k").withColumns({"chunk": F.lit(0).cast("long"), "chunks": F.lit(1).cast("long")})
        chosen = dropped_later(written(chosen, f"{name}-pivots"))
        whole = members.join(left, ids)
        parts = members.groupBy("unit").agg(F.ceil(F.greatest(F.count("*") / REGION_POINTS, F.sum(F.length("data")) / (8 * GROUP_HASHES))).alias("parts"))
        parts = F.broadcast(parts.join(chosen.select("unit", "chunks").distinct(), "unit"))

        def dealt(rows: DataFrame, member: bool, chunk, part) -> DataFrame:
            return rows.withColumn("chunk", chunk).withColumn("part", part).select("unit", "chunk", "part", F.lit(member).alias("member"), "fp", "n", "data", "label")

        points = dealt(whole.join(parts, "unit"), True, F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)), F.pmod(F.xxhash64("fp", F.lit("part")), "parts"))
        pivots = dealt(members.join(chosen.drop("chunks"), ids).join(parts, "unit"), False, F.col("chunk"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        deal = ["unit", "chunk", "part"]
        found = dropped_later(written(pivot_edges(pivots.unionByName(points).repartition(*deal).sortWithinPartitions(*deal, "member"), close), f"{name}-edges"))
        edges = edges.unionByName(found)
        if final:
            return edges
        labels = components(edges, f"{name}-labels")
        label = F.coalesce("root", "fp")
        left = dropped_later(written(left.join(chosen, ids, "left_anti").join(labels.withColumnRenamed("node", "fp"), "fp", "left").select(*ids, label.alias("label")), f"{name}-left"))
        most = largest(left)


def linked(one: int, other: np.ndarray, both: np.ndarray) -> np.ndarray:
    """Whether sets of one and other elements that share `both` are within the distance."""
    return 100 * both >= NEED * (one + other - both)


def join_group(sets: list[np.ndarray], labels: np.ndarray | None = None) -> np.ndarray:
    """For each set of a group the number of a set of its component, by pivots, exactly (step 5). Equal labels are connected already."""
    size = np.array([len(s) for s in sets])
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
    starts = np.cumsum(size) - size
    root = np.arange(len(sets)) if labels is None else np.unique(labels, return_inverse=True)[1]
    mark = np.zeros(int(flat.max()) + 1, bool)

    def overlaps(k: int, rows: np.ndarray) -> np.ndarray:
        mark[flat[starts[k] : starts[k] + size[k]]] = True
        if 2 * len(rows) > len(sets):
            both = np.add.reduceat(mark[flat], starts)[rows]
        else:
            both = np.array([np.count_nonzero(mark[flat[starts[r] : starts[r] + size[r]]]) for r in rows.tolist()], np.int64)
        mark[flat[starts[k] : starts[k] + size[k]]] = False
        return both

    todo = np.arange(len(sets))  # points whose links among each other aren't settled
    while len(todo) > 1 and (root[todo] != root[todo[0]]).any():
        # A pivot of the least common component settles most; its links to all open points are then known.
        roots, at, n = np.unique(root[todo], return_index=True, return_counts=True)
        pivot = todo[at[n.argmin()]]
        rows = todo[root[todo] != root[pivot]]
        both = overlaps(pivot, rows)
        hits = np.unique(root[rows[linked(size[pivot], size[rows], both)]])
        root[np.isin(root, hits)] = root[pivot]
        todo = todo[todo != pivot]
    first, own = np.unique(root, return_index=True, return_inverse=True)[1:]
    return first[own]


def as_set(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint64)


def close_sets(n: np.ndarray, data: list[bytes], pivots: int) -> np.ndarray:
    """For the first `pivots` sets, as a matrix, whether each of the other sets is within the distance."""
    sets = [as_set(x) for x in data]
    values, owner = np.concatenate(sets[:pivots]), np.repeat(np.arange(pivots), n[:pivots])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    flat, row = np.concatenate(sets[pivots:]), np.repeat(np.arange(len(sets) - pivots), n[pivots:])
    both = np.zeros(pivots * (len(sets) - pivots), np.int64)
    step = max(1, PAIRS // pivots)
    for at in range(0, len(flat), step):
        first = np.searchsorted(values, flat[at : at + step], "left")
        many = np.searchsorted(values, flat[at : at + step], "right") - first
        place = np.repeat(first - np.cumsum(many) + many, many) + np.arange(many.sum())
        both += np.bincount(owner[place] * (len(sets) - pivots) + np.repeat(row[at : at + step], many), minlength=len(both))
    return linked(n[:pivots, None], n[None, pivots:], both.reshape(pivots, -1))


def exact_links(members: DataFrame) -> DataFrame:
    """(a, b) links that connect exactly the points of each group (grp, fp, n, elements, label) that chains of close pairs connect."""

    def join(part: pa.Table) -> pa.Table:
        fp = part.column("fp").to_numpy()
        root = join_group([as_set(x) for x in part.column("elements").to_pylist()], part.column("label").to_numpy())
        rest = np.flatnonzero(root != np.arange(len(fp)))
        return pa.table({"a": fp[root[rest]], "b": fp[rest]})

    large = members.groupBy("grp").agg(F.sum("n").alias("hashes")).filter(F.col("hashes") > GROUP_HASHES).select("grp")
    if not large.limit(1).count():
        return members.groupBy("grp").applyInArrow(join, "a long, b long")
    large = F.broadcast(large)  # at most one row for each GROUP_HASHES hashes
    small = members.join(large, "grp", "left_anti").groupBy("grp").applyInArrow(join, "a long, b long")
    units = members.join(large, "grp", "left_semi").select(F.col("grp").alias("unit"), "fp", "n", F.col("elements").alias("data"), "label")
    return small.unionByName(pivot_links(units, close_sets, "jaccard-links"))


def candidate_groups(distinct: DataFrame) -> DataFrame:
    """(grp, fp, label) of the points that no pivot is near: groups that hold every pair of them within the distance (steps 3 and 4)."""
    alone = distinct.filter("home is null")
    keyed = alone.select(F.explode("keys").alias("key"), "fp")
    regions = written(shared_regions(keyed.repartition("key").sortWithinPartitions("key")), "jaccard-regions")
    sketched = alone.select("fp", "n", "bits")
    members = regions.filter(F.col("size") <= REGION_POINTS).join(sketched, "fp").repartition("region").sortWithinPartitions("region").select("region", "fp", "n", "bits")
    edges = region_edges(members)
    large = regions.filter(F.col("size") > REGION_POINTS)
    if large.limit(1).count():
        points_of = large.join(sketched, "fp").select(F.col("region").alias("unit"), "fp", "n", F.col("bits").alias("data"), F.col("fp").alias("label"))
        edges = edges.unionByName(pivot_links(dropped_later(written(points_of, "jaccard-large")), close_sketches, "jaccard-regions"))
    groups = components(edges, "jaccard-groups")
    dropped(regions)
    both = groups.select(F.col("node").alias("fp"), F.col("root").alias("grp")).unionByName(groups.select(F.col("root").alias("fp"), F.col("root").alias("grp")).distinct())
    return both.select("grp", "fp", F.col("fp").alias("label"))


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id per row of docs."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    every = written(points(rows), "jaccard-points")
    own = dropped_later(written(every.select("doc_id", F.col("n").alias("n_shingles"), "fp"), "jaccard-own"))
    # One row for each distinct set, with a document that has it.
    same = [F.first(c).alias(c) for c in ("n", "home", "away", "others", "shell", "keys", "bits")]
    distinct = written(every.filter("fp is not null").groupBy("fp").agg(F.min(F.struct("doc_id", "th")).alias("of"), *same), "jaccard-sets")
    dropped(every)
    grouped = candidate_groups(distinct).unionByName(cells(distinct))
    # Full sets of grouped points only, made again from one document each. A point is in one group and at most DOC_PIVOTS cells.
    units = grouped.groupBy("fp").agg(F.collect_list(F.struct("grp", "label")).alias("units"))
    wanted = written(units.join(distinct.select("fp", F.col("of.doc_id").alias("id"), F.col("of.th").alias("hash")), "fp"), "jaccard-wanted")
    perhaps = parted(rows.withColumn("th", F.xxhash64("text")), wanted.select(F.col("id").alias("doc_id"), F.col("hash").alias("th")), "doc_id", "th")[1]
    texts = perhaps.join(wanted, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("th") == F.col("hash")))

    def again(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = sets_of(batch.column("text").to_pylist())
        good = np.array([bool(len(s)) and fingerprint(s) == fp for s, fp in zip(sets, batch.column("fp").to_pylist(), strict=True)], bool)
        arrays = [batch.column("units"), batch.column("fp"), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())]
        return pa.RecordBatch.from_arrays(arrays, ["units", "fp", "n", "elements"]).filter(pa.array(good))

    full = per_batch(texts.select("units", "fp", "text"), again, "units array<struct<grp: long, label: long>>, fp long, n long, elements binary").dropDuplicates(["fp"])
    full = written(full, "jaccard-full")
    members = full.select(F.explode("units").alias("u"), "fp", "n", "elements").select("u.grp", "fp", "n", "elements", "u.label")
    homes = distinct.filter("home is not null")
    direct = homes.select(F.col("home").alias("a"), F.col("fp").alias("b")).unionByName(homes.select(F.col("home").alias("a"), F.explode("others").alias("b")).distinct())
    labels = components(exact_links(members).unionByName(direct), "jaccard-components")
    dropped(full, wanted, distinct)
    counts = own.filter("fp is not null").groupBy("fp").agg(F.count("*").alias("copies"))
    total = own.count()
    label = labels.join(counts.withColumnRenamed("fp", "node"), "node").select(F.col("node").alias("fp"), "root", "copies")
    rooted = dropped_later(written(attach(own.filter("fp is not null"), label, "fp", "copies", total).select("doc_id", "n_shingles", F.coalesce("root", "fp").alias("root")), "jaccard-rooted"))
    least = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("members"))
    joined = attach(rooted, least, "root", "members", total).select("doc_id", "n_shingles", "component_id")
    alone = own.filter("fp is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return joined.unionByName(alone)


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, any others) less those that are in a component with a smaller doc_id.

    Where ids repeat or are null, every row with the id of a component stays, but rows equal in id and text count once.
    """
    classes = dropped_later(written(similar_components(docs), "jaccard-classes"))
    whole = docs.select(F.struct("*").alias("row"), "doc_id")
    if classes.groupBy("doc_id").count().filter("count > 1 or doc_id is null").limit(1).count():
        heads = classes.filter("doc_id <=> component_id").select(F.col("doc_id").alias("id")).distinct()
        kept = whole.withColumn("text", F.col("row.text")).join(heads, F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")
        return kept.dropDuplicates(["doc_id", "text"]).select("row.*")
    gone = classes.filter("doc_id <> component_id").select("doc_id")
    untouched, perhaps = parted(whole, gone, "doc_id")
    return untouched.unionByName(perhaps.join(gone, "doc_id", "left_anti")).select("row.*")


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_components(dealt_documents(spark, sf_dir))


QUERIES = {"op3_jaccard_join": op3_jaccard_join}
SQL = {
    "op3_jaccard_join": r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
  s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS sh FROM d, LATERAL (SELECT unnest(range(1, greatest(len(w) - 3, 2))) AS i) WHERE len(w) > 0),
  n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
  shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL),
  links AS (SELECT x, y FROM shared JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
  reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x)
SELECT x AS doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(y) AS component_id FROM reach LEFT JOIN n ON n.doc_id = x GROUP BY x""",
}
