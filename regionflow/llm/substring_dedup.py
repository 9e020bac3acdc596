r"""Substring dedup: repeated-phrase automata.

A window is 13 consecutive words of one document.  Words covered by a window
that also starts in a document with a smaller id are removed.

1. Each window has an anchor, its five-word phrase of smallest hash; equal
   windows have equal anchors, and about one place in five is one.  Anchors that
   documents share are found by one pre-aggregated grouping of hashes.
2. For shared anchors only, the documents give contexts: the anchor's stretch
   of text, which holds exactly the windows that have it.  Equal contexts of
   different documents are grouped first, so copied passages count once.
3. Contexts are dealt by anchor into shards of bounded size.  A shard confirms
   its recurring passages word by word (runs of windows that one earlier document
   has), compiles them into an Aho-Corasick automaton over word numbers, and
   streams its contexts through it to locate every occurrence.  An anchor on the
   edge of a very common passage may have more contexts than a shard holds; the
   distinct windows of those contexts are dealt instead, each by its own hash, to
   shards of the same kind.
4. Occurrences go back to the documents, whose words they remove.

Hashes decide only what is looked at.  Documents with the same words as an
earlier one are settled by their digests and give no contexts.

Defined results: ids are whole numbers, and one other than null names one text
each; a null text has no words; texts of fewer than 13 words lose nothing;
repeated rows of one id don't dedupe each other; rows with a null id come after
all others and dedupe nothing; an empty table gives an empty table; other input
columns are left out.

Every table between the steps is deleted once it's read; that of the result
stays in the shared folder for its readers.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SLICE_BYTES, Words, arrow_map, byte_slices, discard, stored, table, texts_of

WINDOW, ANCHOR = 13, 5
#: Distinct contexts of one shard's automaton.
SHARD_CONTEXTS = 8_000
#: The id that stands for a null id: after all others.
LAST = 2**63 - 1


def column(batch, name: str):
    return batch.column(batch.schema.get_field_index(name))


def anchors(words: Words, seed: int = 5):
    """(text number, anchor hash, first window, last window + 1) arrays, windows counted within their text."""
    import numpy as np

    mix = np.random.default_rng(seed).integers(1, 2**63, ANCHOR, dtype=np.uint64) | np.uint64(1)
    h, sizes = words.hashes(), words.sizes
    n, width = len(h), WINDOW - ANCHOR + 1
    if n < WINDOW:
        return (np.empty(0, np.int64),) * 4
    g = np.zeros(n - ANCHOR + 1, np.uint64)
    for k in range(ANCHOR):
        g = (g ^ h[k : n - ANCHOR + 1 + k]) * mix[k]
        g ^= g >> np.uint64(31)
    # the low five bits name the place, so that the least of a window tells where it stands
    key = (g & ~np.uint64(31)) | (np.arange(len(g), dtype=np.uint64) & np.uint64(31))
    least = key[: n - WINDOW + 1].copy()
    for k in range(1, width):
        np.minimum(least, key[k : k + len(least)], out=least)
    windows = np.maximum(sizes - WINDOW + 1, 0)
    doc = np.repeat(np.arange(len(sizes)), windows)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(windows) - windows, windows)
    least = least[at + np.repeat(np.cumsum(sizes) - sizes, windows)]
    new = np.ones(len(doc), bool)
    new[1:] = (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])
    begin = np.flatnonzero(new)
    size = np.diff(np.r_[begin, len(doc)])
    return doc[begin], (least[begin] >> np.uint64(16)).astype(np.int64), at[begin], at[begin] + size


def profiles(docs: DataFrame) -> DataFrame:
    """id, tag, n_words, digest, anchors from id, tag, text."""
    added = T.StructType().add("n_words", "long").add("digest", "binary").add("anchors", T.ArrayType(T.LongType()))

    def make():
        import numpy as np
        import pyarrow as pa

        def f(batch):
            words = Words(column(batch, "text"))
            doc, value, _, _ = anchors(words)
            # a text that repeats a phrase names its anchor again and again
            new = np.ones(len(doc), bool)
            new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
            doc, value = doc[new], value[new]
            offsets = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(value, pa.int64()))
            return {"n_words": words.sizes, "digest": [hashlib.sha256(x).digest() for x in words.joined()], "anchors": lists}

        return f

    return arrow_map(docs, added, make, "text", ("text",))


def contexts_of(docs: DataFrame) -> DataFrame:
    """id, tag, anchor, c (hash of context), context, at (its first word) from id, tag, text, wanted (anchors)."""
    schema = T.StructType().add("id", "long").add("tag", "long").add("anchor", "long").add("c", "long").add("context", "string").add("at", "integer")

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash

        for whole in batches:
            for batch in byte_slices(whole, "text", SLICE_BYTES):
                words = Words(column(batch, "text"))
                doc, value, first, last = anchors(words)
                lists = column(batch, "wanted")
                asked = lists.flatten().to_numpy()
                of = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
                # text and anchor as one number; two that meet by chance only give a context too many
                number = lambda d, v: (v.astype(np.uint64) << np.uint64(12)) * np.uint64(0x9E3779B97F4A7C15) + d.astype(np.uint64)
                chosen = np.isin(number(doc, value), number(of, asked))
                doc, value, first, last = (x[chosen] for x in (doc, value, first, last))
                start = (np.cumsum(words.sizes) - words.sizes)[doc]
                texts = words.spans(start + first, start + last + WINDOW - 1)
                c = np.array([xxhash.xxh3_64_intdigest(x) for x in texts], np.uint64).view(np.int64)
                ids, tags = (column(batch, x).to_numpy()[doc] for x in ("id", "tag"))
                columns = [pa.array(ids), pa.array(tags), pa.array(value), pa.array(c), pa.array(texts, pa.string()), pa.array(first.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return docs.select("id", "tag", "text", "wanted").mapInArrow(run, schema)


def groups_of(numbers, starts, seed: int = 3):
    """Equal windows (numbers[s : s + WINDOW]) get equal group numbers: grouped by a hash, then compared word by word."""
    import numpy as np

    rng = np.random.default_rng(seed)
    rows = np.lib.stride_tricks.sliding_window_view(numbers, WINDOW)
    while True:
        h = np.zeros(len(starts), np.uint64)
        for k in range(WINDOW):
            h = (h ^ numbers[starts + k].astype(np.uint64)) * (rng.integers(1, 2**63, dtype=np.uint64) | np.uint64(1))
            h ^= h >> np.uint64(29)
        _, place, group = np.unique(h, return_index=True, return_inverse=True)
        if (rows[starts] == rows[starts[place][group]]).all():
            return group
        # two unlike windows have one hash: another hash parts them


def locate(contexts: list[tuple[str, int, int]]) -> list[list[tuple[int, int, int]]]:
    """For contexts (text, first id, last id): (start, end, first id) of the passages that an earlier document has.

    Words are numbered; a recurring passage is a run of windows, equal word by
    word to windows whose first document is one and the same, before the
    context's last one.
    """
    import ahocorasick
    import numpy as np

    class Numbers(dict):
        def __missing__(self, word):
            n = self[word] = len(self) + 1
            return n

    number = Numbers()
    numbered = [tuple([number[w] for w in c.split(" ")]) for c, _, _ in contexts]
    if not numbered:
        return []
    sizes = np.array([len(n) for n in numbered])
    begin = np.cumsum(sizes) - sizes
    flat = np.fromiter((n for words in numbered for n in words), np.int64, int(sizes.sum()))
    windows = sizes - WINDOW + 1
    owner = np.repeat(np.arange(len(numbered)), windows)
    starts = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows) + begin[owner]
    low, high = (np.array([c[i] for c in contexts], np.int64) for i in (1, 2))
    group = groups_of(flat, starts)
    order = np.argsort(group, kind="stable")
    first = np.minimum.reduceat(low[owner[order]], np.flatnonzero(np.diff(group[order], prepend=-1)))[group]
    recurs = first < high[owner]
    # runs of recurring windows of one context with one first document
    same = np.zeros(len(owner), bool)
    same[1:] = recurs[1:] & recurs[:-1] & (owner[1:] == owner[:-1]) & (first[1:] == first[:-1])
    head = np.flatnonzero(recurs & ~same)
    tail = np.flatnonzero(recurs & ~np.r_[same[1:], False])
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    at = starts - begin[owner]
    for o, a, z, f in zip(owner[head].tolist(), at[head].tolist(), (at[tail] + WINDOW).tolist(), first[head].tolist()):
        automaton.add_word(numbered[o][a:z], (z - a, f))
    if not len(automaton):
        return [[] for _ in contexts]
    automaton.make_automaton()
    out = []
    for words in numbered:
        found: list[tuple[int, int, int]] = []
        for last, (n, f) in automaton.iter(words):
            start = last - n + 1
            # passages inside one of the same document say nothing new
            while found and found[-1][2] == f and found[-1][0] >= start:
                found.pop()
            if not found or found[-1][2] != f or found[-1][1] < last + 1:
                found.append((start, last + 1, f))
        out.append(found)
    return out


HITS = T.ArrayType(T.StructType().add("start", "integer").add("end", "integer").add("first", "long"))


def located(distinct: DataFrame) -> DataFrame:
    """anchor, c, hits (passages with their first id) of contexts with recurring passages, from anchor, c, context, lo, hi."""
    schema = T.StructType().add("anchor", "long").add("c", "long").add("hits", HITS)

    def run(batches):
        import pyarrow as pa

        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)

        def shard(rows):
            found = locate([r[2:] for r in rows])
            kept = [(a, c, [{"start": s, "end": e, "first": f} for s, e, f in h]) for (a, c, _, _, _), h in zip(rows, found) if h]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in kept], f.type) for i, f in enumerate(target)], schema.names)

        rows: list[tuple] = []
        for batch in batches:
            for row in zip(*(texts_of(batch, c) for c in ("anchor", "c", "context", "lo", "hi"))):
                if len(rows) >= SHARD_CONTEXTS and row[0] != rows[-1][0]:
                    yield shard(rows)
                    rows = []
                rows.append(row)
        yield shard(rows)

    dealt = distinct.select("anchor", "c", "context", "lo", "hi").repartition("anchor").sortWithinPartitions("anchor")
    return dealt.mapInArrow(run, schema)


def remove(docs: DataFrame) -> DataFrame:
    """id, tag, n_removed, kept (text) from id, tag, text, spans (start, end)."""
    added = T.StructType().add("n_removed", "long").add("kept", "string")

    def make():
        import numpy as np

        def f(batch):
            words = Words(column(batch, "text"))
            begin = np.cumsum(words.sizes) - words.sizes
            lists = column(batch, "spans")
            spans, of = lists.flatten(), np.repeat(begin, lists.value_lengths().to_numpy())
            edge = np.zeros(len(words.begin) + 1, np.int64)
            np.add.at(edge, of + spans.field("start").to_numpy(), 1)
            np.add.at(edge, of + spans.field("end").to_numpy(), -1)
            left = np.cumsum(edge)[:-1] == 0
            before = np.r_[0, np.cumsum(left)]
            n = words.sizes - (before[begin + words.sizes] - before[begin])
            # bytes of the words left, each with the blank behind it
            stay = np.repeat(left, words.length + 1)
            text = words.buffer[stay].tobytes()
            at = np.r_[0, np.cumsum((words.length + 1) * left)]
            cut = zip(at[begin].tolist(), at[begin + words.sizes].tolist())
            return {"n_removed": n, "kept": [text[a : z - 1].decode() if z > a else "" for a, z in cut]}

        return f

    return arrow_map(docs, added, make, "text", ("text", "spans"))


def shared_anchors(prof: DataFrame) -> DataFrame:
    """id, tag, wanted: the anchors of each row that a document has too whose id is another one."""
    marks = prof.select("id", "tag", F.explode("anchors").alias("anchor"))
    shared = marks.groupBy("anchor").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("anchor")
    return marks.join(shared, "anchor", "left_semi").groupBy("id", "tag").agg(F.collect_set("anchor").alias("wanted"))


def of_windows(crowded: DataFrame) -> DataFrame:
    """What ``located`` gives, for contexts of crowded anchors: each distinct window goes through an automaton once."""
    each = F.expr(f"transform(sequence(0, size(w) - {WINDOW}), i -> named_struct('shift', i, 'words', array_join(slice(w, i + 1, {WINDOW}), ' ')))")
    windows = crowded.withColumn("w", F.split("context", " ")).select("anchor", "c", "lo", "hi", F.explode(each).alias("x")).select("anchor", "c", "lo", "hi", "x.shift", "x.words")
    key = F.xxhash64("words")
    distinct = windows.groupBy("words").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo < hi")
    found = located(distinct.select(key.alias("anchor"), F.xxhash64("words", F.lit(1)).alias("c"), F.col("words").alias("context"), "lo", "hi"))
    hits = windows.select("anchor", "c", "shift", key.alias("k"), F.xxhash64("words", F.lit(1)).alias("k2")).join(found.select(F.col("anchor").alias("k"), F.col("c").alias("k2"), "hits"), ["k", "k2"])
    moved = F.expr("transform(hits, h -> named_struct('start', h.start + shift, 'end', h.end + shift, 'first', h.first))")
    return hits.select("anchor", "c", moved.cast(HITS).alias("hits"))


def shared_spans(spots: DataFrame, tables: list) -> DataFrame:
    """id, tag, spans: the words of each row that an earlier document's windows cover."""
    distinct = stored(spots.groupBy("anchor", "c", "context").agg(F.min("id").alias("lo"), F.max("id").alias("hi")), "distinct", tables)
    crowded = stored(distinct.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > SHARD_CONTEXTS).select("anchor"), "crowded", tables)
    found = located(distinct.join(crowded, "anchor", "left_anti")).unionByName(of_windows(distinct.join(crowded, "anchor", "left_semi")))
    earlier = F.expr("transform(filter(hits, h -> h.first < id), h -> named_struct('start', at + h.start, 'end', at + h.end))")
    met = spots.select("id", "tag", "anchor", "c", "at").join(found, ["anchor", "c"])
    hits = met.select("id", "tag", earlier.alias("s")).where("size(s) > 0")
    return stored(hits.groupBy("id", "tag").agg(F.flatten(F.collect_list("s")).alias("spans")), "spans", tables)


def dedupe_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """id, n_words, n_removed, kept_sha256 of every row; with keep_text also ``kept``, the words left of rows that lost some (null: none lost)."""
    # with its id, a text's hash names a row
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("id"), F.xxhash64(F.col(text_col)).alias("tag"), F.col(text_col).alias("text"))
    tables: list = []
    full = stored(profiles(rows), "profiles")
    prof = stored(full.drop("anchors"), "heads", tables)
    # rows with the words of an earlier document: all their windows recur
    same = prof.where(f"n_words >= {WINDOW}").groupBy("digest").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("digest", "lo")
    copies = stored(prof.select("id", "tag", "digest").join(same, "digest").where("id > lo").select("id", "tag").distinct(), "copies", tables)
    wanted = stored(shared_anchors(full.select("id", "tag", "anchors")).join(copies, ["id", "tag"], "left_anti"), "wanted")
    discard(full)
    asked = stored(rows.where("text IS NOT NULL").join(wanted, ["id", "tag"]), "asked", tables)
    discard(wanted)
    spots = stored(contexts_of(asked), "contexts")
    spans = shared_spans(spots, tables)
    discard(spots)
    gone = remove(asked.select("id", "tag", "text").join(spans, ["id", "tag"])).dropDuplicates(["id", "tag"])
    settled = gone.select("id", "tag", "n_removed", F.sha2("kept", 256).alias("kept_sha"), *(["kept"] if keep_text else []))
    out = prof.select("id", "tag", "n_words", "digest").join(settled, ["id", "tag"], "left").join(copies.withColumn("copied", F.lit(True)), ["id", "tag"], "left")
    n = F.when(F.col("copied"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0)))
    sha = F.when(F.col("copied"), F.sha2(F.lit(b""), 256)).otherwise(F.coalesce("kept_sha", F.lower(F.hex("digest"))))
    kept = [F.when(F.col("copied"), "").otherwise(F.col("kept")).alias("kept")] if keep_text else []
    done = stored(out.select(F.when(F.col("id") != LAST, F.col("id")).alias(id_col), "n_words", n.alias("n_removed"), sha.alias("kept_sha256"), *kept), "result")
    discard(*tables)
    return done


def op5_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedupe_substrings(docs, keep_text=False)
