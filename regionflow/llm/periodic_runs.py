r"""Periodic run detection: recursive frequency splitting, then a lag scan of what survives.

Words are `[^\x20\x09-\x0D]+`, numbered from 0.  A run is a stretch of
consecutive words with smallest period q, of at least max(``SHORTEST``, 2 q)
words, that no neighbouring word extends.  A word of a run has an equal word q
places before or after it, and q is at most half of the segment that holds the
run.  So a word without an equal one that near is too rare in its segment to be
in any run: it splits the segment.  The parts are shorter and their words rarer,
so they are split again, until nothing changes; parts under ``SHORTEST`` words go.

The surviving segments are scanned lag by lag.  Lags up to ``DENSE`` are
compared at every place.  Longer ones go by classes (Q, 2Q]: a run of such a
period agrees with itself, shifted, over more than Q words, so that it holds a
whole aligned block of Q/2 words whose copy lies a lag of the class ahead.  Equal
blocks are named exactly, by doubling (a block's name is that of its halves;
blocks that occur once in their segment get none), so a lag is only tried where
a block says so, and each is extended by the same names.  All of it is exact, and
n log(n)**2 at worst in a text's n words; documents of a batch are scanned together.

Defined results: null, empty and blank texts have no words, no runs and an empty
collapsed text; a document never changes another one; rows are kept one by one,
repeated ones too; an empty table gives an empty table; other columns pass
through, those named as an output are replaced by it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Words, arrow_map, table

#: A run's fewest words; the lags that are compared everywhere.
SHORTEST, DENSE = 12, 8
#: Pairs of places that are extended at once.
PAIRS = 1 << 20
RUN = T.StructType().add("start", "long").add("length", "long").add("period", "long")
ADDED = T.StructType().add("n_words", "long").add("runs", T.ArrayType(RUN)).add("collapsed", "string")


def stretches(equal):
    """Where each run of true values starts, and its length."""
    import numpy as np

    step = np.diff(np.r_[np.int8(0), equal.view(np.int8), np.int8(0)])
    start = np.flatnonzero(step == 1)
    return start, np.flatnonzero(step == -1) - start


def survivors(word, doc):
    """First place and length of each segment that no rare word splits any more, for words of documents in order."""
    import numpy as np

    place, segment, starts, sizes = np.arange(len(word)), doc, [], []
    kinds = int(word.max()) + 1 if len(word) else 1
    while len(place):
        long = np.bincount(segment)
        key = segment * kinds + word[place]
        order = np.argsort(key, kind="stable")
        key, at = key[order], place[order]
        near = (key[1:] == key[:-1]) & (np.diff(at) <= long[segment[order[1:]]] // 2)
        stays = np.zeros(len(place), bool)
        stays[order[1:][near]] = True
        stays[order[:-1][near]] = True
        place, segment = place[stays], segment[stays]
        if not len(place):
            break
        new = np.r_[True, (np.diff(place) != 1) | (np.diff(segment) != 0)]
        first, part = np.flatnonzero(new), np.cumsum(new) - 1
        size = np.bincount(part)
        whole = size == long[segment[first]]
        done = whole & (size >= SHORTEST)
        starts.append(place[first[done]])
        sizes.append(size[done])
        again = ~whole & (size >= SHORTEST)
        place = place[again[part]]
        segment = (np.cumsum(again) - 1)[part[again[part]]]
    if not starts:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    start, size = np.concatenate(starts), np.concatenate(sizes)
    order = np.argsort(start)
    return start[order], size[order]


class Blocks:
    """Exact names of blocks of 1, 2, 4, ... places: equal blocks have equal names, a block that occurs once has -1."""

    def __init__(self, first):
        import numpy as np

        self.names, self.order = [], []
        place, key = np.arange(len(first)), first
        while True:
            order = np.argsort(key, kind="stable")
            k, p = key[order], place[order]
            new = np.r_[True, k[1:] != k[:-1]] if len(k) else np.empty(0, bool)
            group = np.cumsum(new) - 1
            several = np.bincount(group)[group] > 1 if len(k) else new
            if not several.any():
                return
            p, group = p[several], group[several]
            name = np.cumsum(np.r_[True, group[1:] != group[:-1]]) - 1
            names = np.full(len(first), -1, np.int32)
            names[p] = name
            self.names.append(names)
            # sorted by name and place, as one number
            self.order.append(name * len(first) + p)
            half = 1 << (len(self.names) - 1)
            place = np.sort(p)
            place = place[place + half < len(first)]
            place = place[names[place + half] >= 0]
            key = names[place].astype(np.int64) * (int(name[-1]) + 1) + names[place + half]

    def ahead(self, a, b):
        """How many places from a and b on are equal."""
        import numpy as np

        n, far = np.zeros(len(a), np.int64), len(self.names[0])
        for k in range(len(self.names) - 1, -1, -1):
            x, y = self.names[k][np.minimum(a + n, far - 1)], self.names[k][np.minimum(b + n, far - 1)]
            n[(x == y) & (x >= 0) & (np.maximum(a, b) + n < far)] += 1 << k
        return n

    def behind(self, a, b):
        """How many places before a and b are equal."""
        import numpy as np

        n = np.zeros(len(a), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            i, j = a - n - (1 << k), b - n - (1 << k)
            x, y = self.names[k][np.maximum(i, 0)], self.names[k][np.maximum(j, 0)]
            n[(x == y) & (x >= 0) & (np.minimum(i, j) >= 0)] += 1 << k
        return n


def primitive(found: list):
    """start, length, period of the stretches found, each once, by start: with a multiple of its period it's no other run."""
    import numpy as np

    start, length, period = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    once = np.ones(len(start), bool)
    once[1:] = (np.diff(start) != 0) | (np.diff(length) != 0)
    return start[once], length[once], period[once]


def scanned(key, segment):
    """start (in key), length, period of all runs of segments in a row: key holds a number of a word in its segment."""
    import numpy as np

    # a place of its own between segments
    at = np.arange(len(key)) + segment
    row = np.arange(-1, -2 - (int(at[-1]) + 1), -1, dtype=np.int64)
    row[at] = key
    found = []
    for q in range(1, min(DENSE, len(row) - 1) + 1):
        start, size = stretches(row[:-q] == row[q:])
        good = size >= max(SHORTEST, 2 * q) - q
        found.append((start[good], size[good] + q, np.full(good.sum(), q)))
    blocks = Blocks(row)
    for level in range(2, len(blocks.names)):
        size, names, order = 1 << level, blocks.names[level], blocks.order[level]
        anchor = np.arange(0, len(row), size)
        anchor = anchor[names[anchor] >= 0]
        own = names[anchor].astype(np.int64) * len(row)
        # copies in a run of a much shorter period that holds the anchor's block show that run only
        start, length, period = primitive(found)
        short = (period <= size // 2) & (length >= size)
        start, end = start[short], (start + length - size)[short]
        held = np.searchsorted(start, anchor, "right") - 1
        past = np.where((held >= 0) & (anchor <= np.r_[end, -1][held]), np.r_[end, -1][held], -1)
        low, high = (np.searchsorted(order, own + np.minimum(x, len(row) - 1), "right") for x in (np.maximum(anchor + 2 * size, past), anchor + 4 * size))
        high = np.maximum(low, high)
        many = high - low
        cut = np.searchsorted(np.cumsum(many), np.arange(PAIRS, many.sum() + PAIRS, PAIRS))
        for i, j in zip([0, *(cut[:-1] + 1)], np.minimum(cut + 1, len(many))):
            n = many[i:j]
            a = np.repeat(anchor[i:j], n)
            b = order[np.repeat(low[i:j] - (np.cumsum(n) - n), n) + np.arange(n.sum())] % len(row)
            left, right, q = blocks.behind(a, b), blocks.ahead(a, b), b - a
            good = left + right >= q
            found.append(((a - left)[good], (left + right + q)[good], q[good]))
    start, length, period = primitive(found)
    return np.searchsorted(at, start), length, period


def runs_of(word, doc):
    """start (a place among all words), length and period of every run, by start, then period; words and documents are numbers."""
    import numpy as np

    start, size = survivors(word, doc)
    if not len(start):
        return (np.empty(0, np.int64),) * 3
    segment = np.repeat(np.arange(len(start)), size)
    place = np.arange(len(segment)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start, size)
    key = segment * (int(word.max()) + 1) + word[place]
    first, length, period = scanned(key, segment)
    found = place[first]
    order = np.lexsort((period, found))
    return found[order], length[order], period[order]


def periodic_runs(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_words, runs (start, length, period by start, then period) and collapsed.

    collapsed is the text's words joined by one blank, without those that a run holds after its first ``period`` words.
    """

    def make():
        import numpy as np
        import pyarrow as pa

        def f(batch):
            words = Words(batch.column(batch.schema.get_field_index(text_col)))
            sizes = words.sizes.astype(np.int64)
            total, edge = int(sizes.sum()), np.r_[0, np.cumsum(sizes)]
            offsets = np.r_[words.begin, len(words.buffer)].astype(np.int64)
            kinds = pa.LargeBinaryArray.from_buffers(pa.large_binary(), total, [None, pa.py_buffer(offsets), pa.py_buffer(words.text)])
            word = kinds.dictionary_encode().indices.to_numpy().astype(np.int64)
            start, length, period = runs_of(word, np.repeat(np.arange(len(sizes)), sizes))
            cover = np.zeros(total + 1, np.int64)
            np.add.at(cover, start + period, 1)
            np.add.at(cover, start + length, -1)
            keep = np.cumsum(cover)[:-1] == 0
            owner = np.searchsorted(edge, start, "right") - 1
            rows: list = [[] for _ in range(len(sizes))]
            for d, s, n, q in zip(owner.tolist(), (start - edge[owner]).tolist(), length.tolist(), period.tolist()):
                rows[d].append({"start": s, "length": n, "period": q})
            # kept words with their blank, but for the last of each text
            kept = np.flatnonzero(keep)
            span = words.length + 1
            stays = np.repeat(keep, span)
            of = np.searchsorted(edge, kept, "right") - 1
            last = kept[np.r_[np.diff(of) != 0, True]] if len(kept) else kept
            stays[words.begin[last] + words.length[last]] = False
            held = np.r_[0, np.cumsum(np.where(keep, span, 0))][edge]
            ends = held - np.searchsorted(last, edge)
            text = pa.StringArray.from_buffers(len(sizes), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(words.buffer[stays].tobytes()))
            return {"n_words": sizes, "runs": rows, "collapsed": text}

        return f

    return arrow_map(docs, ADDED, make, text_col)


def with_repeats(docs: DataFrame) -> DataFrame:
    """docs where each tenth document by crc32(doc_id) repeats itself: with h that number and g = h div 10, each word i >= a is word a + (i - a) % p,

    for a = g % n and p = 1 + (n - a) div (3 + g % 8).
    """
    docs = docs.select("*", F.crc32(F.col("doc_id").cast("string")).alias("_h"))
    words = F.when(F.col("_h") % 10 == 0, F.expr(r"regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0)"))
    docs = docs.withColumn("_w", words).withColumn("_a", F.expr("CASE WHEN size(_w) > 0 THEN CAST((_h div 10) % size(_w) AS INT) END"))
    docs = docs.withColumn("_p", F.expr("CAST(1 + (size(_w) - _a) div (3 + (_h div 10) % 8) AS INT)"))
    turned = "array_join(transform(_w, (w, i) -> CASE WHEN i < _a THEN w ELSE _w[_a + (i - _a) % _p] END), ' ')"
    return docs.withColumn("text", F.expr(f"CASE WHEN _a IS NULL THEN text ELSE {turned} END")).drop("_h", "_w", "_a", "_p")


def op12_periodic_runs(spark, sf_dir: str) -> DataFrame:
    docs = with_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    df = periodic_runs(docs).drop("text")
    df = df.withColumn("best", F.expr("array_max(transform(runs, r -> named_struct('length', r.length, 'start', -r.start, 'period', -r.period)))"))
    return df.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.expr("-best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.expr("-best.period").alias("period"),
        F.expr("(1000 * best.length) div -best.period").alias("exponent_milli"),
        F.expr(r"sha2(array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), ''), 256)").alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
        "n_words",
    )
