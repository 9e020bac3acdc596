r"""N-gram Jaccard join: Bayesian pruning of candidates, exact verification.

Texts are sets of five-word shingles.  Texts with equal sets are copies and are
collapsed first, so a join never expands copies.  128 MinHash values a set make
32 bands of four; sets that agree in a band form a bucket, and each two members
of a bucket are compared.  Of buckets with the same members, one stays.  Buckets
of more than ``BLOCK`` members are dealt in blocks, so that a cell (two blocks)
is bounded; a pair counts only in the first band in which it agrees.  MinHash
values of a pair are compared sixteen at a time, and the pair is dropped as soon
as the posterior probability that its Jaccard similarity reaches the threshold
(uniform prior) falls below ``TOLERANCE``.  Pairs left are verified exactly on
their shingle sets.  Classes are the connected components of verified links.

``n_links`` of a text counts the different texts that are linked with it: those
of its own set (other white space, similarity 1) and those of linked sets.  A
cell gives one row a member, with the number of its links and the smallest
member that they connect it to; only comparisons grow with the square of a class
of near copies, not rows.  At the threshold a pair misses all bands with
probability 5e-8.

Sets are addressed by 64-bit hashes: among 1e9 distinct sets, two share an
address with probability 0.03.

Words are `[^\x20\x09-\x0D]+`.  Defined results: a text of one to four words is
one shingle; null and wordless texts have no links and are a class each; a class
without any id has a null class_id; an id may name several texts, each of which
has its own class; repeated rows share a class; an empty table gives an empty
table; other columns are left out by ``near_classes`` and kept by ``one_of_each``.

Every table between the steps is deleted once it's read; that of the result
stays in the shared folder for its readers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Words, arrow_map, column, discard, stored, table, texts_of

NGRAM, THRESHOLD = 5, 0.8
PERMS, ROWS = 128, 4
BANDS = PERMS // ROWS
STEP, TOLERANCE = 16, 1e-6
#: Members of a block; entries of sets that a cell holds as bits at once.
BLOCK, ENTRIES = 512, 500_000
CELL = ("bucket", "low", "high")


class Shingler:
    """Distinct shingle hashes of texts, and MinHash signatures of them."""

    def __init__(self, seed: int = 11):
        import numpy as np

        rng = np.random.default_rng(seed)
        self.mix = rng.integers(1, 2**63, NGRAM, dtype=np.uint64) | np.uint64(1)
        self.a = (rng.integers(1, 2**32, PERMS, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)[:, None]
        self.b = rng.integers(0, 2**32, PERMS, dtype=np.uint64).astype(np.uint32)[:, None]

    def phrases(self, h, m: int):
        """Hashes of all phrases of m words."""
        import numpy as np

        n = max(len(h) - m + 1, 0)
        s = np.full(n, np.uint64(m), np.uint64)
        for k in range(m):
            s = (s ^ h[k : k + n]) * self.mix[k]
            s ^= s >> np.uint64(29)
        return s

    def sets(self, texts) -> list:
        """The sorted distinct shingle hashes of each text of an Arrow column."""
        import numpy as np

        words = Words(texts)
        h = words.hashes()
        s = self.phrases(h, NGRAM)
        out, at = [], 0
        for n in words.sizes.tolist():
            # a text of one to four words is one shingle
            out.append(np.unique(s[at : at + n - NGRAM + 1]) if n >= NGRAM else self.phrases(h[at : at + n], n) if n else np.empty(0, np.uint64))
            at += n
        return out

    def signature(self, s) -> bytes:
        import numpy as np

        x, low = (s >> np.uint64(32)).astype(np.uint32), np.full(PERMS, 0xFFFFFFFF, np.uint32)
        for i in range(0, len(x), 2048):
            low = np.minimum(low, (self.a * x[None, i : i + 2048] + self.b).min(1))
        return low.astype("<u4").tobytes()


#: The columns that name a row: hashes of its id and of its text.
ROW = ("id_hash", "text_hash")


def named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, ROW and _text of docs; rows of one name have one id and one text."""
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(id_col).alias(ROW[0]), F.xxhash64(text_col).alias(ROW[1]), F.col(text_col).alias("_text"))


def with_sets(rows: DataFrame, binary_set: bool = False) -> DataFrame:
    """rows, their _text replaced by node (null without words) and either sig or the set itself."""
    added = T.StructType().add("node", "long").add("shingles" if binary_set else "sig", "binary")

    def make():
        import numpy as np
        import xxhash

        shingler = Shingler()

        def f(batch):
            sets = shingler.sets(batch.column(batch.schema.get_field_index("_text")))
            node = [int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).astype(np.int64)) if len(s) else None for s in sets]
            if binary_set:
                return {"node": node, "shingles": [s.tobytes() for s in sets]}
            return {"node": node, "sig": [shingler.signature(s) if len(s) else None for s in sets]}

        return f

    return arrow_map(rows, added, make, "_text", ("_text",))


def least_matches(perms: int = PERMS, step: int = STEP, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[int]:
    """For n = step, 2 step, ...: the fewest matches at which P(similarity >= threshold | matches) is at least tolerance.

    With a uniform prior the posterior is Beta(m + 1, n - m + 1); its upper tail is a binomial sum.
    """
    from math import comb

    out = []
    for n in range(step, perms + 1, step):
        tail = lambda m, n=n: sum(comb(n + 1, k) * threshold**k * (1 - threshold) ** (n + 1 - k) for k in range(m + 1))
        out.append(next(m for m in range(n + 1) if tail(m) >= tolerance))
    return out


def cells(batches):
    """The rows of one cell at a time, from batches sorted by ``CELL``."""
    import numpy as np
    import pyarrow as pa

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        whole = pa.Table.from_batches([batch])
        if held is not None:
            whole = pa.concat_tables([held, whole])
        keys = np.stack([whole.column(c).to_numpy() for c in CELL])
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist()]
        for start, end in zip(cuts, cuts[1:]):
            yield whole.slice(start, end - start)
        held = whole.slice(cuts[-1])
    if held is not None:
        yield held


def by_cell(df: DataFrame) -> DataFrame:
    return df.repartition(*CELL).sortWithinPartitions(*CELL)


def candidates(nodes: DataFrame) -> DataFrame:
    """The members of all cells of nodes (node, sig): CELL, band, node, block.

    Each two members of a bucket meet in one cell; a bucket of up to BLOCK members is one.
    """
    key = F.expr(f"transform(sequence(0, {BANDS - 1}), i -> xxhash64(i, substring(sig, i * {4 * ROWS} + 1, {4 * ROWS})))")
    members = nodes.select("node", F.posexplode(key).alias("band", "bucket"))
    mark = F.expr("bit_xor(xxhash64(node))").alias("mark")
    buckets = members.groupBy("bucket").agg(F.min("band").alias("band"), F.count("*").alias("n"), F.min("node").alias("first"), F.max("node").alias("last"), mark).where("n > 1")
    # of buckets with the same members that of the first band, where all pairs agree that agree in another of them
    kept = buckets.groupBy("n", "first", "last", "mark").agg(F.min(F.struct("band", "bucket")).alias("b"))
    kept = kept.select("b.bucket", F.expr(f"CAST(ceil(n / {BLOCK}) AS INT)").alias("blocks"))
    met = members.join(kept, "bucket").withColumn("block", F.expr("CAST(pmod(xxhash64(node, 1), blocks) AS INT)"))
    met = met.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    return met.select("bucket", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "band", "node", "block")


def likely_pairs(cell, least: list) -> dict:
    """{row: partners' rows} of a cell (with sig): the pairs that stay likely through all comparisons, each once."""
    import numpy as np

    block = cell.column("block").to_numpy()
    sig = np.frombuffer(b"".join(texts_of(cell, "sig")), "<u4").reshape(-1, PERMS)
    band, low, high = (cell.column(c)[0].as_py() for c in ("band", "low", "high"))
    left, right = np.flatnonzero(block == low), np.flatnonzero(block == high)
    partners: dict = {}
    for place, i in enumerate(left):
        at = right if low < high else right[place + 1 :]
        same = sig[at] == sig[i]
        # four equal values of a band, read as one number
        bands = same.view(np.uint32)[:, : band + 1] == 0x01010101
        here = bands[:, band] & ~bands[:, :band].any(1)
        at, same = at[here], same[here]
        matches = same.reshape(-1, PERMS // STEP, STEP).sum(2).cumsum(1)
        at = at[(matches >= least).all(1)]
        if len(at):
            partners[i] = at
    return partners


#: What says in which cell a node is, and which of its pairs count there.
MEMBER = (*CELL, "band", "node", "block")


def likely(met: DataFrame) -> DataFrame:
    """The rows of met (MEMBER, sig) that have a likely partner in their cell, without sig.

    Pairs aren't written: ``verify`` finds them again among the rows that are left, so that rows stay linear in a class.
    """
    import pyarrow as pa

    schema, least = T.StructType([met.schema[c] for c in MEMBER]), least_matches()

    def run(batches):
        import numpy as np

        for cell in cells(batches):
            partners = likely_pairs(cell, least)
            if partners:
                some = np.unique(np.concatenate([np.array(list(partners)), *partners.values()]))
                yield from cell.select(list(MEMBER)).take(pa.array(some)).combine_chunks().to_batches()

    return by_cell(met.select(*MEMBER, "sig")).mapInArrow(run, schema)


def shared_counts(sets: list, pairs: list) -> list:
    """For each (i, js) of pairs, how many elements the sorted set i shares with each set of js."""
    import numpy as np

    counts = [np.zeros(len(js), np.int64) for _, js in pairs]
    parts = -(-sum(map(len, sets)) // ENTRIES)
    ends = np.array([(2**64 * k) // parts for k in range(1, parts)], np.uint64)
    cuts = [np.r_[0, np.searchsorted(s, ends), len(s)] for s in sets]
    for k in range(parts):
        part = [s[c[k] : c[k + 1]] for s, c in zip(sets, cuts)]
        owner = np.repeat(np.arange(len(part)), [len(s) for s in part])
        _, column, times = np.unique(np.concatenate(part), return_inverse=True, return_counts=True)
        number = np.cumsum(times > 1) - 1
        common = times[column] > 1
        owner, column = owner[common], number[column[common]]
        if not len(column):
            continue
        bits = np.zeros((len(sets), (int(column.max()) // 64 + 1) * 8), np.uint8)
        np.add.at(bits, (owner, column >> 3), (1 << (column & 7)).astype(np.uint8))
        bits = bits.view(np.uint64)
        for n, (i, js) in zip(counts, pairs):
            n += np.bitwise_count(bits[js] & bits[i]).sum(1, dtype=np.int64)
    return counts


def verify(members: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """node, end, n of the cells of members (MEMBER, sig, shingles, n_texts).

    n: the texts of the sets that node links with in a cell, whose exact similarity reaches the threshold; end: the
    smallest node that the cell's links connect node to.
    """
    import pyarrow as pa

    schema, least = T.StructType().add("node", "long").add("end", "long").add("n", "long"), least_matches()

    def run(batches):
        import numpy as np

        for cell in cells(batches):
            cell = cell.sort_by("node")
            node, texts = cell.column("node").to_numpy(), cell.column("n_texts").to_numpy()
            sets = [np.frombuffer(s, np.uint64) for s in texts_of(cell, "shingles")]
            size = np.array([len(s) for s in sets])
            pairs = list(likely_pairs(cell, least).items())
            n, end = np.zeros(len(node), np.int64), np.arange(len(node))
            for (i, js), both in zip(pairs, shared_counts(sets, pairs)):
                js = js[both / (size[i] + size[js] - both) >= threshold]
                if len(js):
                    n[i] += texts[js].sum()
                    n[js] += texts[i]
                    ends = np.unique(end[np.append(js, i)])
                    end[np.isin(end, ends)] = ends[0]
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(node[at]), pa.array(node[end[at]]), pa.array(n[at])], ["node", "end", "n"])

    return by_cell(members.select(*MEMBER, "sig", "shingles", "n_texts")).mapInArrow(run, schema)


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, label: the smallest node that links (a, b) connect to it, as a table of the shared folder.

    Each round takes the smallest label among neighbours, then the label of that
    label, so a chain of n links needs about log n rounds; every round is written
    to the shared folder, and the one before it deleted.
    """
    edges = stored(links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a")), "edges")
    labels = stored(edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("label"), F.lit(True).alias("moved")), "labels")
    for _ in range(most_rounds):
        near = edges.join(labels, F.col("v") == F.col("node")).groupBy("u").agg(F.min("label").alias("m"))
        down = labels.join(near, F.col("node") == F.col("u"), "left").select("node", "label", F.least("label", "m").alias("new"))
        up = labels.select(F.col("node").alias("n2"), F.col("label").alias("l2"))
        jumped = down.join(up, F.col("new") == F.col("n2"), "left").select("node", F.least("new", "l2").alias("label"), (F.least("new", "l2") < F.col("label")).alias("moved"))
        done = stored(jumped, "labels")
        discard(labels)
        labels = done
        if done.where("moved").isEmpty():
            discard(edges)
            return labels
    raise RuntimeError("components didn't settle")


def row_classes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, ROW, node, label, class_id, n_links of every row of docs, as a table of the shared folder.

    label: a number of the row's class, null without words; class_id: the smallest id of the class.
    """
    tables: list = []
    texts = named(docs, id_col, text_col)
    rows = stored(with_sets(texts), "signatures", tables)
    worded = rows.where("node IS NOT NULL")
    # a node's set is taken from one of its rows
    nodes = stored(worded.groupBy("node").agg(F.min("id").alias("rep"), F.min(F.struct(*ROW)).alias("row"), F.first("sig").alias("sig")), "nodes", tables)
    several = stored(worded.select("node", "text_hash").distinct().groupBy("node").agg(F.count("*").alias("n_texts")).where("n_texts > 1"), "several", tables)
    members = stored(likely(candidates(nodes).join(nodes.select("node", "sig"), "node")), "likely", tables)
    # the sets of the texts that are still in question
    asked = members.select("node").distinct().join(nodes.select("node", "row"), "node").select(F.col("node").alias("asked"), "row.*")
    sets = with_sets(texts.drop("id").join(asked, [*ROW]), True).where("node = asked").dropDuplicates(["node"]).select("node", "shingles")
    sets = stored(sets, "sets", tables)
    held = sets.join(several, "node", "left").join(nodes.select("node", "sig"), "node").select("node", "sig", "shingles", F.coalesce("n_texts", F.lit(1)).alias("n_texts"))
    links = stored(verify(members.join(held, "node")), "links", tables)
    label = components(links.where("node <> end").select(F.col("node").alias("a"), F.col("end").alias("b")))
    tables.append(label)
    of_label = label.join(nodes.select("node", "rep"), "node").groupBy("label").agg(F.min("rep").alias("class_id"))
    degree = links.groupBy("node").agg(F.sum("n").alias("n"))
    linked = label.select("node", "label").join(of_label, "label").join(degree, "node")
    known = nodes.select("node", "rep").join(linked, "node", "left").join(several, "node", "left")
    known = known.select("node", F.coalesce("label", "node").alias("label"), F.coalesce("class_id", "rep").alias("class_id"), F.expr("coalesce(n, 0L) + coalesce(n_texts, 1L) - 1L").alias("n_links"))
    # written, so that the last join is of two plain shuffles and Spark can split the rows of a set with many copies
    known = stored(known, "known", tables)
    out = rows.select("id", *ROW, "node").join(known, "node", "left")
    done = stored(out.select("id", *ROW, "node", "label", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")), "classes")
    discard(*tables)
    return done


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a row of docs: its id, class_id (the smallest id of its class) and n_links (other texts that it links with)."""
    return row_classes(docs, id_col, text_col).select(F.col("id").alias(id_col), "class_id", "n_links")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each class: that of the smallest id, a row without an id only if no other has one.

    Rows are chosen by id and text together, so that an id which names several
    texts keeps each that isn't a copy.  Texts without words are no copies of
    another.  Repeated rows of one id and one text are one document.
    """
    rows = row_classes(docs, id_col, text_col)
    first = F.min(F.struct(F.col("id").isNull(), "id", *ROW)).alias("row")
    keys = [f"_{c}" for c in ROW]
    kept = rows.where("label IS NOT NULL").groupBy("label").agg(first).select("row.id_hash", "row.text_hash").union(rows.where("label IS NULL").select(*ROW)).toDF(*keys)
    chosen = docs.withColumns({k: F.xxhash64(of) for k, of in zip(keys, (id_col, text_col))}).join(kept, keys, "left_semi").dropDuplicates(keys)
    return chosen.select(*[column(c) for c in docs.columns])


def op7_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
