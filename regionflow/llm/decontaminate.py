r"""Benchmark decontamination: an FM-index per training shard.

A shard is a run of a task's documents.  Its index holds all their words as one
sequence over the alphabet of the test items' words; each run of foreign words,
and each end of a document, is one separator, unlike any other, as no test
phrase can hold it.  Suffixes are sorted by prefix doubling (a separator ends
every comparison), the Burrows-Wheeler transform is kept in a wavelet matrix
with rank directories, and suffix positions are sampled at every eighth place
and behind every separator.  All test phrases of a block run backward search
together; occurrences are located by walking to a sampled position; the spans
of a document are merged.

Test items come in blocks of bounded size, one broadcast each.  A single block is
one pass, and nothing is shuffled.  Of several, each is a job of its own over the
documents, written with numbers for rows, so that a worker never holds more than
one block; a job gives the spans of the documents that it hits, and these few rows are added up
and joined back.

A phrase is 13 words (an item of fewer is one phrase).  Defined results: a null
or wordless text has no words and no hits; wordless and null items are never
found; items that share an id count once, and a null id is the empty string; repeated documents are judged each; empty tables give
empty tables or no hits; input columns are kept and clashing ones replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, column, discard, stored, table, texts_of, without

WINDOW, SAMPLE = 13, 8
#: Bytes of item text in a block (about 150 MB of phrases in a worker), and of document text in a shard.
BLOCK_BYTES, SHARD_BYTES = 8 << 20, 8 << 20

#: UTF-8 bytes of words, lower-cased; all else is a blank.  Every byte of a character beyond ASCII is of a word.
_FOLDED = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after A-Z are lower-cased, as UTF-8."""
    return (text or "").encode().translate(_FOLDED).split()


class Phrases:
    """The distinct test phrases of one block of items over an alphabet of their words; 0 is the separator."""

    def __init__(self, items: list[tuple]):
        import numpy as np

        self.ids: dict[bytes, int] = {}
        number: dict[str, int] = {}
        flat, sizes, owner = [], [], []
        for key, text in items:
            w = [self.ids.setdefault(x, len(self.ids) + 1) for x in words(text)]
            flat += w
            sizes.append(len(w))
            owner.append(number.setdefault(key, len(number)))
        self.keys = list(number)
        sizes, flat = np.array(sizes, np.int64), np.array(flat, np.int32)
        windows = np.where(sizes, np.maximum(sizes - WINDOW + 1, 1), 0)
        first = np.repeat(np.cumsum(sizes) - sizes, windows)
        start = first + np.arange(len(first)) - np.repeat(np.cumsum(windows) - windows, windows)
        length = np.repeat(np.minimum(sizes, WINDOW), windows)
        # right aligned: backward search starts in the last column
        matrix = np.zeros((len(start), WINDOW), np.int32)
        for k in range(WINDOW):
            has = length > k
            matrix[has, WINDOW - 1 - k] = flat[(start + length - 1 - k)[has]]
        kept, group = distinct_rows(matrix)
        self.matrix, self.lengths = matrix[kept], length[kept]
        # the items of each phrase, each once
        pairs = np.unique(group * max(len(self.keys), 1) + np.repeat(np.array(owner, np.int64), windows))
        phrase, self.item = np.divmod(pairs, max(len(self.keys), 1))
        self.item_start = np.searchsorted(phrase, np.arange(len(kept) + 1))

    def items(self, phrase: int) -> list[str]:
        return [self.keys[i] for i in self.item[self.item_start[phrase] : self.item_start[phrase + 1]].tolist()]


def distinct_rows(matrix):
    """(places of one row of each kind, each row's kind) of a matrix of small integers: by a hash, checked number by number."""
    import numpy as np

    rng = np.random.default_rng(9)
    while True:
        h = np.zeros(len(matrix), np.uint64)
        for k in range(matrix.shape[1]):
            h = (h ^ matrix[:, k].astype(np.uint64)) * (rng.integers(1, 2**63, dtype=np.uint64) | np.uint64(1))
            h ^= h >> np.uint64(29)
        _, kept, kind = np.unique(h, return_index=True, return_inverse=True)
        if all((matrix[kept, k][kind] == matrix[:, k]).all() for k in range(matrix.shape[1])):
            return kept, kind
        # two unlike rows have one hash: another hash parts them


class WaveletMatrix:
    """A sequence of small integers with rank and access for arrays of positions."""

    def __init__(self, seq, top: int):
        import numpy as np

        self.n, self.levels, self.zeros, self.width = len(seq), [], [], max(1, int(top).bit_length())
        seq = seq.astype(np.int32)
        for b in range(self.width - 1, -1, -1):
            bit = ((seq >> b) & 1).astype(bool)
            ones = np.zeros(self.n + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.levels.append(ones)
            self.zeros.append(self.n - int(ones[-1]))
            seq = np.concatenate([seq[~bit], seq[bit]])

    def rank(self, symbols, at):
        """How often each symbol stands before each position."""
        import numpy as np

        lo, hi = np.zeros_like(at), at.copy()
        for k, (ones, zeros) in enumerate(zip(self.levels, self.zeros)):
            bit = (symbols >> (self.width - 1 - k)) & 1 == 1
            a, b = ones[lo], ones[hi]
            lo, hi = np.where(bit, zeros + a, lo - a), np.where(bit, zeros + b, hi - b)
        return hi - lo

    def access(self, at):
        """The symbols at each position, and their ranks there."""
        import numpy as np

        lo, hi, out = np.zeros_like(at), at.copy(), np.zeros_like(at)
        for ones, zeros in zip(self.levels, self.zeros):
            bit = ones[hi + 1] > ones[hi]
            out = out * 2 + bit
            a, b = ones[lo], ones[hi]
            lo, hi = np.where(bit, zeros + a, lo - a), np.where(bit, zeros + b, hi - b)
        return out, hi - lo


def sorted_places(keys):
    """Places in the order of their keys; a key and its place are sorted as one number where they fit."""
    import numpy as np

    bits = max(1, int(len(keys)).bit_length())
    if not len(keys) or int(keys.max()).bit_length() + bits > 62:
        return np.argsort(keys, kind="stable")
    return np.sort((keys << bits) | np.arange(len(keys))) & ((1 << bits) - 1)


def suffix_array(seq):
    """The sorted suffixes of a sequence whose zeros are all unlike, in the order they stand."""
    import numpy as np

    n = len(seq)
    seps = np.flatnonzero(seq == 0)
    rank = np.asarray(seq, np.int64) + len(seps)
    rank[seps] = np.arange(len(seps))
    # places whose suffix isn't yet unlike all others, with their ranks: at first, all that aren't separators
    order = sorted_places(rank)
    sorted_rank = rank[order]
    start = np.flatnonzero(np.r_[True, sorted_rank[1:] != sorted_rank[:-1]])
    size = np.diff(np.r_[start, n])
    rank[order] = np.repeat(start, size)
    live = order[np.repeat(size > 1, size)]
    k = 1
    while len(live):
        own, after = rank[live], rank[live + k]
        by = sorted_places(own * n + after)
        live, own, after = live[by], own[by], after[by]
        new = np.r_[True, own[1:] != own[:-1]]
        fresh = new | np.r_[True, after[1:] != after[:-1]]
        at = np.arange(len(live))
        rank[live] = own + np.maximum.accumulate(np.where(fresh, at, 0)) - np.maximum.accumulate(np.where(new, at, 0))
        start = np.flatnonzero(fresh)
        size = np.diff(np.r_[start, len(live)])
        live = live[np.repeat(size > 1, size)]
        k *= 2
    sa = np.empty(n, np.int64)
    sa[rank] = np.arange(n)
    return sa


class FMIndex:
    """Count and locate over one shard; seq ends with a separator."""

    def __init__(self, seq, top: int):
        import numpy as np

        sa = suffix_array(seq)
        bwt = seq[sa - 1]
        self.before = np.r_[0, np.cumsum(np.bincount(seq, minlength=top + 1))]
        self.tree = WaveletMatrix(bwt, top)
        # a suffix behind a separator is always sampled, so no walk crosses one
        kept = (sa % SAMPLE == 0) | (bwt == 0)
        self.kept = np.r_[0, np.cumsum(kept)]
        self.samples = sa[kept]

    def search(self, phrases: Phrases):
        """The ranges of suffixes that start with each phrase."""
        import numpy as np

        n = len(phrases.lengths)
        lo, hi = np.zeros(n, np.int64), np.full(n, self.tree.n, np.int64)
        for step in range(WINDOW):
            live = np.flatnonzero((phrases.lengths > step) & (hi > lo))
            if not len(live):
                break
            c = phrases.matrix[live, WINDOW - 1 - step]
            lo[live] = self.before[c] + self.tree.rank(c, lo[live])
            hi[live] = self.before[c] + self.tree.rank(c, hi[live])
        return lo, np.maximum(lo, hi)

    def locate(self, rows):
        """Text positions of rows of the suffix array."""
        import numpy as np

        at, steps, out = rows.copy(), 0, np.zeros(len(rows), np.int64)
        live = np.arange(len(rows))
        while len(live):
            known = self.kept[at[live] + 1] > self.kept[at[live]]
            done = live[known]
            out[done] = self.samples[self.kept[at[done]]] + steps
            live = live[~known]
            c, r = self.tree.access(at[live])
            at[live] = self.before[c] + r
            steps += 1
        return out


def merged(spans: list) -> list:
    """Spans in order; those that meet are one."""
    out: list = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(e, out[-1][1])
        else:
            out.append([s, e])
    return out


def shard_hits(texts: list, phrases: Phrases):
    """For each text: number of words, merged hit spans (in words, end exclusive), items found."""
    import numpy as np

    ids, n_words, starts, seq = phrases.ids, [], [], []
    get, base = ids.get, 0
    for t in texts:
        w = words(t)
        n_words.append(len(w))
        starts.append(base)
        seq += [get(x, 0) for x in w]
        seq.append(0)
        base += len(w) + 1
    spans: list[list] = [[] for _ in texts]
    items: list[set] = [set() for _ in texts]
    if not texts or not len(phrases.lengths):
        return n_words, spans, items
    full = np.array(seq, np.int32)
    # foreign words next to each other are one separator
    keep = (full != 0) | np.r_[True, full[:-1] != 0]
    place = np.flatnonzero(keep)
    short = full[keep]
    index = FMIndex(short, len(ids))
    lo, hi = index.search(phrases)
    found = np.flatnonzero(hi > lo)
    if len(found):
        size = hi[found] - lo[found]
        which = np.repeat(found, size)
        rows = np.repeat(lo[found] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
        at = place[index.locate(rows)]
        doc = np.searchsorted(starts, at, "right") - 1
        begin = at - np.array(starts)[doc]
        for d, s, n in zip(doc.tolist(), begin.tolist(), phrases.lengths[which].tolist()):
            spans[d].append([s, s + n])
        # a phrase's items are added once a document, however often it's there
        for pair in np.unique(doc * len(phrases.lengths) + which).tolist():
            d, p = divmod(pair, len(phrases.lengths))
            items[d].update(phrases.items(p))
    return n_words, [merged(s) for s in spans], items


def item_blocks(items: DataFrame, id_col: str, text_col: str, most: int = BLOCK_BYTES):
    """The number of blocks of (id, text), and these, each of about ``most`` bytes of text at most (a longer item is a block of its own)."""
    rows = items.select(F.coalesce(column(id_col).cast("string"), F.lit("")).alias("id"), column(text_col).alias("text")).where("text IS NOT NULL")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // (most // 2)) or 1
    parts = (rows if n == 1 else rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == i) for i in range(n))
    return n, ([(r["id"], r["text"]) for r in part.collect()] for part in parts)


SPANS = T.ArrayType(T.StructType().add("start", "long").add("end", "long"))
FOUND = T.StructType().add("n_words", "long").add("spans", SPANS).add("items", T.ArrayType(T.StringType()))


def found_in(docs: DataFrame, block: list, text_col: str, drop: tuple = ()) -> DataFrame:
    """docs with _found: words, spans and items of one block."""
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def make():
        phrases = Phrases(shared.value)

        def f(batch):
            found = zip(*shard_hits(texts_of(batch, text_col), phrases))
            return {"_found": [{"n_words": n, "spans": [{"start": s, "end": e} for s, e in spans], "items": sorted(items)} for n, spans, items in found]}

        return f

    return arrow_map(docs, T.StructType().add("_found", FOUND), make, text_col, drop, SHARD_BYTES)


def found_in_blocks(docs: DataFrame, blocks, text_col: str) -> DataFrame:
    """docs with _found for all blocks, each by a job of its own."""
    tables: list = []
    rows = stored(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    texts, hits = rows.select("_row", column(text_col).alias("_text")), []
    for k, block in enumerate(blocks):
        part = found_in(texts, block, "_text", ("_text",)).select("_row", "_found.*")
        # every row's number of words comes from the first block
        hits.append(stored(part if k == 0 else part.where(F.size("spans") > 0), "hits", tables))
    every = hits[0]
    for h in hits[1:]:
        every = every.unionByName(h)
    # spans of several blocks that meet are one
    spans = every.select("_row", F.explode("spans").alias("s")).select("_row", "s.*")
    before = Window.partitionBy("_row").orderBy("start", "end")
    reach = F.max("end").over(before.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("fresh", F.when(F.col("start") <= reach, 0).otherwise(1)).withColumn("nth", F.sum("fresh").over(before.rowsBetween(Window.unboundedPreceding, 0)))
    spans = spans.groupBy("_row", "nth").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    spans = spans.groupBy(F.col("_row").alias("_s")).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    found = every.select("_row", F.explode("items").alias("item")).groupBy(F.col("_row").alias("_i")).agg(F.array_sort(F.collect_set("item")).alias("items"))
    merged = hits[0].select("_row", "n_words").join(spans, F.col("_row") == F.col("_s"), "left").join(found, F.col("_row") == F.col("_i"), "left")
    one = F.struct("n_words", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items")).cast(FOUND)
    merged = stored(merged.select(F.col("_row").alias("_number"), one.alias("_found")), "found")
    discard(*tables)
    return rows.join(merged, F.col("_row") == F.col("_number")).drop("_row", "_number")


def find_contamination(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", keep_text: bool = True, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with n_words, n_hit, spans, items (sorted) and contaminated."""
    out = docs.select(*[column(c) for c in without(docs, ("n_words", "n_hit", "spans", "items", "contaminated", "_found", "_row", "_number"))])
    n, blocks = item_blocks(items, item_id, item_text, block_bytes)
    out = found_in(out, next(blocks), text_col) if n == 1 else found_in_blocks(out, blocks, text_col)
    step = "aggregate(_found.spans, 0L, (n, s) -> n + s.end - s.start)"
    out = out.withColumn("n_words", F.col("_found.n_words")).withColumn("n_hit", F.expr(step)).withColumn("spans", F.col("_found.spans")).withColumn("items", F.col("_found.items"))
    out = out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words")))
    return out.drop("_found") if keep_text else out.drop("_found", text_col)


def op3_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_contamination(docs, table(spark, sf_dir, "benchmark"), keep_text=False)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")
