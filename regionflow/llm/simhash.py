r"""SimHash near-dedup: fingerprints, vantage-point shards and trees, connected components.

A text's A-Z are lower-cased; its words are `[^\x20\x09-\x0D]+`, its features the
four-word shingles, repeats included (the whole sequence if it has fewer words,
none if it has no words).  A fingerprint's bit is 1 if it is set in over half of
the features' XXH64 hashes (seed 42).  Fingerprints link at ``RADIUS`` or fewer
differing bits; a component is what links connect.

Equal fingerprints are one point, so copies cost nothing.  Points are sharded by
Hamming distance to vantage points.  Between unrelated fingerprints the distance
of all 64 bits is 32 +- 4, so a triangle bound of radius 4 on it prunes next to
nothing, and each point would have to visit most shards (README.md has figures).
The distance is therefore split: the bits are cut in RADIUS + m bands, of which two linked points
agree in m at least, and for each choice of m bands all values are vantage
points, whose shards hold the points at distance 0 in these bands.  So each link
lies whole inside a shard, and m follows from the number of points, so that
shards stay small.  Inside a shard the whole distance is used: a vantage-point
tree splits points by a radius around one of them, and a branch is left out where
the triangle bound allows; points near a radius are asked on both its sides.

A shard of over ``SHARD`` points is split by rings around one of its points,
wider than RADIUS, so that links lie inside a ring or between neighbours; rings are dealt in pieces of bounded size, a
piece meets the pieces of its ring and, if it's near their boundary, those of
the next.  A cell gives one row a point at most: the
least point that the cell's links connect it to.

Defined results: null, empty and blank texts have the fingerprint zero and link
as any other; component_id is the smallest id of a component, null ids don't
count, a component without any id has a null component_id; repeated rows and ids
are kept row by row; an empty table gives an empty table; other columns are left
out.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Words, arrow_map, discard, stored, table
from .near_dup import components

SHINGLE, SEED, RADIUS = 4, 42, 4
#: Points of a shard that one task takes whole; points that a tree's leaf compares with each other.
SHARD, LEAF = 4096, 128
#: Points that a shard should hold by chance; decides the number of bands.
EXPECTED = 2000
CELL = ("shard", "cell")


def lower(words: Words) -> None:
    """A-Z of the buffer become a-z."""
    capital = (words.buffer >= 65) & (words.buffer <= 90)
    words.buffer[capital] += 32
    words.text = words.buffer.tobytes()


def bit_counts(hashes, sizes):
    """How often each of 64 bits is set in the hashes of each text: texts by bits, for texts of sizes > 0 hashes in a row."""
    import numpy as np

    # a byte's bits, one in each byte of a number; up to 255 of these add up without a carry
    spread = (((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.uint64) << (8 * np.arange(8)).astype(np.uint64)).sum(1, dtype=np.uint64)
    parts = -(-sizes // 255)
    of = np.repeat(np.arange(len(sizes)), parts)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)
    starts = np.repeat(np.cumsum(sizes) - sizes, parts) + nth * 255
    octets = hashes.view(np.uint8).reshape(-1, 8)
    sums = [np.add.reduceat(spread[octets[:, k]], starts).view(np.uint8).reshape(-1, 8) for k in range(8)]
    return np.add.reduceat(np.concatenate(sums, axis=1).astype(np.int64), np.cumsum(parts) - parts)


def fingerprints(docs: DataFrame, text_col: str = "text", out: str = "fingerprint", keep_text: bool = True) -> DataFrame:
    """docs with the 64 bits of each text as a signed number."""

    def make():
        import numpy as np
        import xxhash

        def f(batch):
            words = Words(batch.column(batch.schema.get_field_index(text_col)))
            lower(words)
            sizes = words.sizes.astype(np.int64)
            features = np.where(sizes >= SHINGLE, sizes - SHINGLE + 1, (sizes > 0).astype(np.int64))
            first = np.repeat(np.cumsum(sizes) - sizes, features) + np.arange(features.sum()) - np.repeat(np.cumsum(features) - features, features)
            last = first + np.repeat(np.minimum(sizes, SHINGLE), features) - 1
            text, digest = words.text, xxhash.xxh64_intdigest
            spans = zip(words.begin[first].tolist(), (words.begin[last] + words.length[last]).tolist())
            hashes = np.fromiter((digest(text[a:z], SEED) for a, z in spans), np.uint64, len(first))
            bits = np.zeros(len(sizes), np.uint64)
            some = np.flatnonzero(features)
            if len(some):
                ones = bit_counts(hashes, features[some]) * 2 > features[some][:, None]
                bits[some] = np.packbits(ones, axis=1, bitorder="little").view("<u8").ravel()
            return {out: bits.view(np.int64)}

        return f

    return arrow_map(docs, T.StructType().add(out, "long"), make, text_col, () if keep_text else (text_col,))


# --- one shard


class Tree:
    """Which of some points links within a radius connect, found by vantage points.

    ``label`` names for each point the least point of its component so far.
    """

    def __init__(self, points, radius: int = RADIUS):
        import numpy as np

        self.points, self.radius = points, radius
        self.label = np.arange(len(points))
        self.compared = 0

    def link(self) -> None:
        import numpy as np

        self.within(np.arange(len(self.points)))

    def within(self, a) -> None:
        import numpy as np

        while len(a) > LEAF:
            d = np.bitwise_count(self.points[a] ^ self.points[a[0]]).astype(np.int64)
            radius = min(int(np.median(d)), int(d.max()) - 1)
            inner = d <= radius
            # the triangle bound: a link goes from one side to the other only near the radius
            self.across(a[inner & (d > radius - self.radius)], a[~inner & (d <= radius + self.radius)])
            self.within(a[inner])
            a = a[~inner]
        self.compare(a, a)

    def across(self, a, b) -> None:
        import numpy as np

        if not len(a) or not len(b):
            return
        if len(a) * len(b) > LEAF * LEAF:
            v = self.points[a[0]]
            x, y = (np.bitwise_count(self.points[i] ^ v).astype(np.int64) for i in (a, b))
            radius = int(np.median(np.r_[x, y]))
            parts = [(a[x <= radius], b[y <= radius]), (a[x > radius], b[y > radius])]
            parts.append((a[(x <= radius) & (x > radius - self.radius)], b[(y > radius) & (y <= radius + self.radius)]))
            parts.append((a[(x > radius) & (x <= radius + self.radius)], b[(y <= radius) & (y > radius - self.radius)]))
            # where the bound prunes little, comparing all is the cheaper way
            if sum(len(p) * len(q) for p, q in parts) < 0.7 * len(a) * len(b):
                for p, q in parts:
                    self.across(p, q)
                return
        step = max(1, LEAF * LEAF // len(b))
        for i in range(0, len(a), step):
            self.compare(a[i : i + step], b)

    def compare(self, a, b) -> None:
        """Joins the labels of all pairs of a and b within the radius."""
        import numpy as np

        self.compared += len(a) * len(b)
        near = np.bitwise_count(self.points[a][:, None] ^ self.points[b]) <= self.radius
        while True:
            x, y = self.label[a], self.label[b]
            i, j = np.nonzero(near & (x[:, None] != y))
            if not len(i):
                return
            low, high = np.minimum(x[i], y[j]), np.maximum(x[i], y[j])
            to = np.arange(len(self.label))
            np.minimum.at(to, high, low)
            while not np.array_equal(to, to[to]):
                to = to[to]
            self.label = to[self.label]


def small_labels(points, group):
    """For each point the place of the first of its group (equal numbers, in a row) that links connect it to; groups are small: neighbours at 1, 2, ... places are compared."""
    import numpy as np

    out_a, out_b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for t in range(1, len(points)):
        same = group[t:] == group[:-t]
        if not same.any():
            break
        at = np.flatnonzero(same & (np.bitwise_count(points[t:] ^ points[:-t]) <= RADIUS))
        out_a.append(at)
        out_b.append(at + t)
    i, j, label = np.concatenate(out_a), np.concatenate(out_b), np.arange(len(points))
    while True:
        low, new = np.minimum(label[i], label[j]), label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def linked(members: DataFrame) -> DataFrame:
    """a, b: links that connect, in each cell (CELL) of members, the same points as all links of the cell do; one row a point and cell at most."""
    import pyarrow as pa

    names = [*CELL, "point"]

    def edges(shard, cell, points):
        """Links of whole cells, rows in order of cells."""
        import numpy as np

        new = np.r_[True, (np.diff(shard) != 0) | (np.diff(cell) != 0)]
        size = np.diff(np.r_[np.flatnonzero(new), len(new)])
        group = np.cumsum(new) - 1
        small = (size <= LEAF // 2)[group]
        few = points[small]
        label = small_labels(few, group[small])
        moved = np.flatnonzero(label != np.arange(len(few)))
        a, b = [few[moved]], [few[label[moved]]]
        for g in np.flatnonzero(size > LEAF // 2):
            own = points[group == g] if len(size) < 8 else points[np.searchsorted(group, g) : np.searchsorted(group, g, "right")]
            tree = Tree(own)
            tree.link()
            moved = np.flatnonzero(tree.label != np.arange(len(own)))
            a.append(own[moved])
            b.append(own[tree.label[moved]])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)], ["a", "b"])

    def run(batches):
        import numpy as np

        held = [np.empty(0, np.int64) for _ in names]
        for batch in batches:
            rows = [np.r_[h, batch.column(batch.schema.get_field_index(c)).to_numpy()] for h, c in zip(held, names)]
            if not len(rows[0]):
                continue
            # the last cell may go on in the next batch
            whole = np.flatnonzero((rows[0] != rows[0][-1]) | (rows[1] != rows[1][-1]))
            cut = whole[-1] + 1 if len(whole) else 0
            held = [r[cut:] for r in rows]
            if cut:
                yield edges(rows[0][:cut], rows[1][:cut], rows[2][:cut].view(np.uint64))
        if len(held[0]):
            yield edges(held[0], held[1], held[2].view(np.uint64))

    return members.select(*names).repartition(*CELL).sortWithinPartitions(*CELL).mapInArrow(run, "a long, b long")


# --- all shards


def bands_for(n: int, expected: int = EXPECTED) -> int:
    """The fewest bands at which a shard of n points holds ``expected`` by chance: links agree in all but RADIUS of them."""
    return next((b for b in range(RADIUS + 1, 2 * RADIUS + 1) if n <= expected << (64 // b * (b - RADIUS))), 2 * RADIUS)


def masks(bands: int) -> list[int]:
    """The bits of each choice of bands that two linked points may agree in, as signed numbers."""
    edges = [64 * i // bands for i in range(bands + 1)]
    band = [(1 << z) - (1 << a) for a, z in zip(edges, edges[1:])]
    chosen = [sum(c) for c in itertools.combinations(band, bands - RADIUS)]
    return [m - (1 << 64) if m >> 63 else m for m in chosen]


def sharded(points: DataFrame, bands: int, size: int = SHARD) -> DataFrame:
    """shard, cell, point: every two linked points of points (point) meet in a cell; cells of one point only may be there, too."""
    shard = F.array(*[F.xxhash64(F.lit(i), F.col("point").bitwiseAND(F.lit(m))) for i, m in enumerate(masks(bands))])
    members = points.select("point", F.explode(shard).alias("shard"))
    sizes = members.groupBy("shard").agg(F.count("*").alias("n"), F.min("point").alias("vantage")).where("n > 1")
    met = members.join(sizes, "shard")
    # rings of one place more than the radius, so that links lie in a ring or between neighbours
    wide = RADIUS + 1
    far = F.expr("bit_count(point ^ vantage)")
    crowded = met.where(F.col("n") > size).select("shard", "point", far.alias("far"))
    crowded = crowded.withColumn("ring", F.expr(f"CAST(far div {wide} AS INT)"))
    rings = crowded.groupBy("shard", "ring").agg(F.expr(f"CAST(ceil(count(*) / {size}) AS INT)").alias("pieces"))
    rings = rings.groupBy("shard").agg(F.map_from_entries(F.collect_list(F.struct("ring", "pieces"))).alias("pieces"))
    dealt = crowded.join(rings, "shard").withColumn("piece", F.expr("CAST(pmod(xxhash64(point, 7), pieces[ring]) AS INT)"))
    own = "transform(sequence(0, pieces[ring] - 1), p -> xxhash64(0, ring, least(p, piece), greatest(p, piece)))"
    ahead = f"CASE WHEN far % {wide} > 0 AND pieces[ring + 1] IS NOT NULL THEN transform(sequence(0, pieces[ring + 1] - 1), p -> xxhash64(1, ring, piece, p)) ELSE array() END"
    behind = f"CASE WHEN far % {wide} < {wide - 1} AND pieces[ring - 1] IS NOT NULL THEN transform(sequence(0, pieces[ring - 1] - 1), p -> xxhash64(1, ring - 1, p, piece)) ELSE array() END"
    cells = dealt.select("shard", F.explode(F.expr(f"concat({own}, {ahead}, {behind})")).alias("cell"), "point")
    return met.where(F.col("n") <= size).select("shard", F.lit(0).cast("long").alias("cell"), "point").unionByName(cells)


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fingerprint (a signed number) and component_id of every row of docs."""
    tables: list = []
    rows = stored(fingerprints(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("_text")), "_text", "point", False), "fingerprints", tables)
    points = stored(rows.groupBy("point").agg(F.min("id").alias("first")), "points", tables)
    cells = sharded(points.select("point"), bands_for(points.count()))
    links = stored(linked(cells).distinct(), "links", tables)
    label = components(links)
    tables.append(label)
    named = points.join(label.select(F.col("node").alias("point"), "label"), "point", "left").select("point", "first", F.coalesce("label", "point").alias("label"))
    of_label = named.groupBy("label").agg(F.min("first").alias("component_id"))
    # written, so that the last join is of two plain shuffles and Spark can split the rows of a fingerprint with many copies
    known = stored(named.join(of_label, "label").select("point", "component_id"), "known", tables)
    done = stored(rows.join(known, "point").select(F.col("id").alias(id_col), F.col("point").alias("fingerprint"), "component_id"), "components")
    discard(*tables)
    return done


def op13_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    df = simhash_components(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return df.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
