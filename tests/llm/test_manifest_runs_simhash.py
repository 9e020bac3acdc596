"""The manifest, the run detection and the fingerprints against brute force, and the defined results of odd inputs."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from regionflow.llm import merkle, periodic_runs, registry, simhash

ODD = [None, "", " ", "\n\t ", "a", "a b c d", "word " * 40_000, "x" * 100_000, "Same text twice", "Same text twice", "日本 語 ＡＢ é " * 9, "a\x00b \x0b c"]
LANGS = [None, "de", "é", "Z", "en"]


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def sha(*x):
    return hashlib.sha256("".join(x).encode()).hexdigest()


def lowered(t):
    return None if t is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(None if i == 3 else i, t, "x", i) for i, t in enumerate(ODD)] + [(4, "a", "x", 4)]
    return spark.createDataFrame(rows, "doc_id long, text string, runs string, N_Words int")


# --- manifest


def manifest_of(rows):
    """All of the contract's columns, by whole levels."""
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    groups = defaultdict(list)
    for d, source, lang, n, text in rows:
        leaf = lambda t: sha(*map(enc, (d, source, lang, n, t)))  # noqa: B023, E731
        hit = d is not None and zlib.crc32(str(d).encode()) % 3 == 0
        groups[lang].append(((d is not None, d or 0), leaf(text), leaf(lowered(text)) if hit else leaf(text), d))

    def levels(x):
        out = [x]
        while len(out[-1]) > 1:
            out.append([sha(*out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
        return out

    def path(all_levels, i):
        for x in all_levels[:-1]:
            p = i // 8 * 8
            yield "".join(x[p:i]), "".join(x[i + 1 : p + 8])
            i //= 8

    order = sorted(groups, key=lambda k: (k is not None, (k or "").encode()))
    trees = {k: levels([r[1] for r in sorted(groups[k], key=lambda r: r[:3])]) for k in order}
    top = levels([trees[k][-1][0] for k in order])
    for j, k in enumerate(order):
        for i, (_, leaf, now, d) in enumerate(sorted(groups[k], key=lambda r: r[:3])):
            way = [*path(trees[k], i), *path(top, j)]
            a = now
            for left, right in way:
                a = sha(left, a, right)
            yield d, leaf, trees[k][-1][0], top[-1][0], sha(*[x + y for x, y in way]), a, a == top[-1][0]


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def manifest_rows(spark, df, tmp_path, name):
    df.write.mode("overwrite").parquet(f"{tmp_path}/{name}/documents.parquet")
    return sorted((tuple(r[c] for c in COLUMNS) for r in merkle.op11_merkle_manifest(spark, f"{tmp_path}/{name}").collect()), key=repr)


TABLE = "doc_id long, source string, lang string, n_chars int, text string"


@pytest.mark.parametrize("depth,n", [(4, 150), (1, 700), (2, 700), (1, 1)])
def test_manifest(spark, tmp_path, monkeypatch, depth, n):
    monkeypatch.setattr(merkle, "DEPTH", depth)
    monkeypatch.setattr(merkle, "BLOCK", 8**depth)
    rng = random.Random(n)
    rows = [(i * 3 % 501, rng.choice(["a", None]), rng.choice(LANGS[:-1]) if rng.random() < 0.4 else "en", rng.choice([i, None]), rng.choice([f"Text {i} É", "SAME", None, ""])) for i in range(n)]
    rows += [rows[0]] * (n > 9) + [(None, None, None, None, None)] * 2 * (n > 9)
    got = manifest_rows(spark, spark.createDataFrame(rows, TABLE).repartition(5), tmp_path, "m")
    assert got == sorted(manifest_of(rows), key=repr)
    assert n < 10 or {r[6] for r in got} == {True, False}


def test_manifest_sql(spark, tmp_path):
    rows = [(i, "s", ["en", "de", None][i * i % 3], i, f"T{i}") for i in range(300)]
    got = manifest_rows(spark, spark.createDataFrame(rows, TABLE), tmp_path, "q")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/q/documents.parquet/*.parquet')")
    assert got == sorted(db.execute(registry.oracle_sql()["op11_merkle_manifest"]).fetchall(), key=repr)


def test_empty_manifest(spark, tmp_path):
    assert manifest_rows(spark, spark.createDataFrame([], TABLE), tmp_path, "e") == []


def test_versions_share_untouched_nodes():
    leaves = [sha(str(i)) for i in range(100)]
    first = merkle.grown(leaves, merkle.height(100))
    new = merkle.changed(first, 77, 3, sha("other"))
    assert new[0] == merkle.grown([*leaves[:77], sha("other"), *leaves[78:]], 3)[0] != first[0]
    assert merkle.grown(leaves, 3) == first  # a version leaves the others as they are

    def nodes(n):
        return {id(n)} | set().union(*map(nodes, n[1])) if n[1] else {id(n)}

    assert len(nodes(new) - nodes(first)) == 4  # the leaf and its three ancestors
    assert merkle.folded(sha("other"), merkle.siblings(first, 77, 3)) == new[0]


def test_numbers_are_exact(spark):
    df = spark.range(5000).selectExpr("concat('g', id % 3 * id % 2) AS g", "cast(pmod(id * 7919, 1000) AS int) AS x", "id").repartition(7)
    tables = []
    got = defaultdict(list)
    for r in merkle.numbered(df, ["g"], ["x", "id"], tables).collect():
        got[r["g"]].append((r["place"], r["x"], r["id"]))
    for rows in got.values():
        rows.sort()
        assert [r[0] for r in rows] == list(range(len(rows))) and [r[1:] for r in rows] == sorted(r[1:] for r in rows)
    merkle.discard(*tables)


# --- runs


def runs_of(w):
    out = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i - s + q >= max(12, 2 * q):
                out.setdefault((s, i - s + q), q)
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


def sequence(rng):
    kind, n = rng.randint(0, 4), rng.randint(0, 90)
    if kind < 2:
        return [rng.randint(0, 1 + kind) for _ in range(n)]
    if kind == 2:
        d = ([rng.randint(0, 9) for _ in range(rng.randint(1, 40))] * 12)[: n + rng.randint(0, 60)]
        for _ in range(rng.randint(0, 2)):
            if d:
                d[rng.randrange(len(d))] = rng.randint(0, 9)
        return d
    if kind == 3:
        unit = [0] * rng.randint(1, 30) + [1]
        return [x for _ in range(rng.randint(0, 8)) for x in (unit if rng.random() < 0.8 else unit[1:])]
    return [0] * n


@pytest.mark.parametrize("seed", [1, 2])
def test_runs_against_all_lags(seed):
    import numpy as np

    rng = random.Random(seed)
    for _ in range(1200):
        docs = [sequence(rng) for _ in range(rng.randint(1, 6))]
        flat = np.array([x for d in docs for x in d], np.int64)
        got = list(zip(*(x.tolist() for x in periodic_runs.runs_of(flat, np.repeat(np.arange(len(docs)), [len(d) for d in docs])))))
        want, first = [], 0
        for d in docs:
            want += [(s + first, n, q) for s, n, q in runs_of(d)]
            first += len(d)
        assert got == want


def test_hard_sequences_take_seconds():
    import time

    import numpy as np

    n = 300_000
    fibonacci = [0]
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    fibonacci = b[:n]
    for w in (np.zeros(n, np.int64), np.arange(n) % 7, np.arange(n) // 3 % 50_000, np.array(fibonacci), np.random.default_rng(1).integers(0, 2, n)):
        began = time.time()
        periodic_runs.runs_of(w.astype(np.int64), np.zeros(n, np.int64))
        assert time.time() - began < 60


def test_runs_of_odd_texts(spark, odd):
    got = periodic_runs.periodic_runs(odd).collect()
    assert len(got) == len(ODD) + 1 and sorted(got[0].asDict()) == ["collapsed", "doc_id", "n_words", "runs", "text"]
    for r in got:
        w = words(r["text"])
        want = [(0, 40_000, 1)] if len(w) == 40_000 else runs_of(w)
        assert (r["n_words"], [tuple(x) for x in r["runs"]]) == (len(w), want)
        dropped = {i for s, n, q in want for i in range(s + q, s + n)}
        assert r["collapsed"] == " ".join(x for i, x in enumerate(w) if i not in dropped)
    assert periodic_runs.periodic_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_run_query(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, None if i == 7 else " \n".join(rng.choice(["alpha", "beta", "gamma", "x", "é"]) for _ in range(rng.randint(0, 120)))) for i in range(160)] + [(None, "no id " * 20)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in periodic_runs.op12_periodic_runs(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for d, text in rows:
        w = words(text)
        h = zlib.crc32(str(d).encode()) if d is not None else 1
        n, g = len(w), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = runs_of(w)
        s, length, q = max(runs, key=lambda r: (r[1], -r[0], -r[2])) if runs else (None,) * 3
        dropped = {i for a, m, p in runs for i in range(a + p, a + m)}
        r = got[d]
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(runs), s, length, q)
        assert r["exponent_milli"] == (1000 * length // q if runs else None)
        assert r["runs_sha256"] == sha(*[f"{a},{m},{p}\n" for a, m, p in runs])
        assert r["collapsed_sha256"] == sha(" ".join(x for i, x in enumerate(w) if i not in dropped))
    assert sum(bool(r["n_runs"]) for r in got.values()) > 5


# --- fingerprints


def fingerprint(text):
    import xxhash

    w = words(lowered(text))
    parts = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def component_ids(points, radius=4):
    """Least index of each point's component, by all pairs."""
    import numpy as np

    x = np.array(points, np.uint64)
    near, label = np.bitwise_count(x[:, None] ^ x) <= radius, np.arange(len(x))
    while True:
        new = np.where(near, label, len(x)).min(1)
        if (new == label).all():
            return label.tolist()
        label = new


def test_fingerprints_of_odd_texts(spark, odd):
    for r in simhash.fingerprints(odd).collect():
        assert r["fingerprint"] % 2**64 == fingerprint(r["text"])
    got = simhash.simhash_components(odd).collect()
    assert len(got) == len(ODD) + 1 and {r["component_id"] for r in got if r["fingerprint"] == 0} == {0}
    assert simhash.simhash_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert [r["component_id"] for r in simhash.simhash_components(spark.createDataFrame([(None, "a")], "doc_id long, text string")).collect()] == [None]


def test_near_texts(spark, tmp_path):
    rng = random.Random(4)
    base = [" ".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") + str(rng.randint(0, 400)) for _ in range(200)) for _ in range(12)]
    rows = []
    for i in range(240):
        w = base[i % 12].split()
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = "edit" + str(rng.randint(0, 9))
        rows.append((1000 - i, rng.choice([" ", "\n"]).join(w)))
    rows += [(2000, None), (1999, ""), (3, "short text")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.op13_simhash_near_dedup(spark, str(tmp_path)).collect()}
    rows.sort()
    prints = [fingerprint(t) for _, t in rows]
    label = component_ids(prints)
    assert got == {d: (format(p, "016x"), rows[k][0]) for (d, _), p, k in zip(rows, prints, label)}
    assert 1 < len(set(label)) < 200


def points_around(rng, n_centres, n, most):
    centres = [rng.getrandbits(64) for _ in range(n_centres)]
    out = set()
    while len(out) < n:
        x = rng.choice(centres)
        for b in rng.sample(range(64), rng.randint(0, most)):
            x ^= 1 << b
        out.add(x)
    return sorted(out)


def linked_labels(spark, points, bands, size):
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in points]
    cells = simhash.sharded(spark.createDataFrame(signed, "point long"), bands, size)
    links = [(r["a"] % 2**64, r["b"] % 2**64) for r in simhash.linked(cells).collect()]
    place = {p: i for i, p in enumerate(points)}
    label = list(range(len(points)))
    moved = True
    while moved:
        moved = False
        for a, b in links:
            low = min(label[place[a]], label[place[b]])
            moved |= label[place[a]] != low or label[place[b]] != low
            label[place[a]] = label[place[b]] = low
    return label, cells, links


@pytest.mark.parametrize("bands,size,most", [(5, 4096, 6), (6, 4096, 6), (8, 4096, 5), (5, 20, 7), (6, 16, 9)])
def test_shards_hold_every_link(spark, bands, size, most):
    """A small size makes rings and pieces of the shards of near copies."""
    points = points_around(random.Random(bands * size), 6, 700, most)
    label, cells, links = linked_labels(spark, points, bands, size)
    want = component_ids(points)
    assert label == want and len(set(want)) > 1
    biggest = max(r["count"] for r in cells.groupBy("shard", "cell").count().collect())
    assert size > 700 or biggest <= 4 * size  # two pieces, dealt by hash
    assert len(links) <= cells.count()


@pytest.mark.parametrize("n,most", [(3000, 7), (600, 14)])
def test_trees_find_every_link(n, most):
    import numpy as np

    points = points_around(random.Random(n), 9, n, most)
    tree = simhash.Tree(np.array(points, np.uint64))
    tree.link()
    assert tree.label.tolist() == component_ids(points)


def test_trees_prune_by_the_triangle_bound():
    import numpy as np

    # two far clusters: no point of one is compared with points of the other
    rng = random.Random(6)
    near = [0 ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64) for _ in range(500)]
    points = sorted({*near, *[p ^ (2**64 - 1) for p in near]})
    tree = simhash.Tree(np.array(points, np.uint64))
    tree.link()
    assert tree.label.tolist() == component_ids(points) and tree.compared < 0.6 * len(points) ** 2


def test_bands_follow_the_number_of_points():
    assert [simhash.bands_for(n) for n in (0, 10**6, 10**7, 10**9, 10**11, 10**30)] == [5, 5, 6, 6, 7, 8]
    for bands in (5, 6, 7, 8):
        for m in simhash.masks(bands):
            assert bin(m % 2**64).count("1") >= 64 // bands * (bands - 4)
    rng = random.Random(1)
    for _ in range(300):
        x, y = (a := rng.getrandbits(64)), a
        for b in rng.sample(range(64), 4):
            y ^= 1 << b
        for bands in (5, 6, 7, 8):
            assert any((x ^ y) & m % 2**64 == 0 for m in simhash.masks(bands))
