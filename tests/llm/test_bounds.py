"""What is held, written and scanned: names with dots, the ledger's cost, blocks of items, classes of many near copies."""

import random
import threading

import public_tokenizers
from pyspark.sql import functions as F

from regionflow.llm import byte_bpe, common, decontaminate, html_text, near_dup, periodic_runs, secret_scan, simhash, token_counts, toxicity

SECRET = "password = 'abcdefghijkl' deadbeefdeadbeef0"


def test_names_with_dots(spark, tmp_path):
    docs = spark.createDataFrame([(1, SECRET, 3), (2, None, 4)], "doc_id long, text string, x int").withColumnRenamed("x", "a.b").withColumn("c`d", F.lit("q"))
    items = spark.createDataFrame([("i", "deadbeefdeadbeef0")], "item_id string, text string")
    done = [
        token_counts.count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model")),
        decontaminate.find_contamination(docs, items),
        decontaminate.find_contamination(docs, items.unionByName(items.withColumn("text", F.lit("password"))), block_bytes=4),
        html_text.extract_text(docs.withColumnRenamed("text", "html")),
        secret_scan.scan_secrets(docs, str(tmp_path / "a")),
        secret_scan.redact(docs, str(tmp_path / "b")),
        byte_bpe.encode_bpe(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken")),
        periodic_runs.periodic_runs(docs),
        near_dup.one_of_each(docs),
        simhash.fingerprints(docs),
    ]
    for df in done:
        rows = df.collect()
        assert sorted(r["a.b"] for r in rows) == [3, 4] and {r["c`d"] for r in rows} == {"q"}


def test_rows_without_an_id_are_never_held_out(spark):
    df = spark.createDataFrame([(None,), (5,)], "doc_id long").select(toxicity.held_out(F.col("doc_id")).alias("h"))
    assert [type(r["h"]) for r in df.collect()] == [bool, bool]


def test_a_second_call_scans_nothing(spark, tmp_path, monkeypatch):
    rows = [(i, f"text {i} {SECRET if i % 3 else ''}") for i in range(40)] + [(None, SECRET)] * 5
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(secret_scan, "ledger_of", lambda s: str(tmp_path / "ledger"))
    first = sorted(secret_scan.op10_secret_scans(spark, str(tmp_path)).collect(), key=repr)
    scanned = []
    own = secret_scan.scan_blobs
    monkeypatch.setattr(secret_scan, "scan_blobs", lambda blobs, col: own(scanned.append(blobs.count()) or blobs, col))
    assert sorted(secret_scan.op10_secret_scans(spark, str(tmp_path)).collect(), key=repr) == first and scanned == [0]
    assert spark.read.parquet(str(tmp_path / "ledger")).count() == 41
    # a small scan takes only its own blobs' findings out of the ledger
    kept = []
    stored = secret_scan.stored
    monkeypatch.setattr(secret_scan, "stored", lambda df, name, *a: kept.append((name, df.count())) or stored(df, name, *a))
    secret_scan.scan_secrets(spark.createDataFrame([(1, SECRET)], "doc_id long, text string"), str(tmp_path / "ledger")).count()
    assert kept == [("blobs", 1), ("findings", 1)]


def test_the_ledger_has_a_fixed_place(spark):
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert secret_scan.ledger_of(spark) == secret_scan.ledger_of(spark) == f"{shared}/secret-ledger"


def test_copies_of_a_blob_are_scanned_once_a_task(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)
    own = secret_scan.find_secrets

    def counted(text):
        seen.add(1)
        return own(text)

    secret_scan.find_secrets = counted
    try:
        docs = spark.createDataFrame([(None, SECRET)] * 300, "doc_id long, text string").coalesce(1)
        assert secret_scan.scan_secrets(docs, str(tmp_path / "l")).where("size(findings) = 2").count() == 300
    finally:
        secret_scan.find_secrets = own
    assert 1 <= seen.value <= 4


def test_twenty_blocks_are_twenty_jobs(spark, monkeypatch):
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(400)}"
    items = [(f"i{i}", " ".join(word() for _ in range(14))) for i in range(40)]
    docs = [(i, " ".join([word() for _ in range(30)] + (items[i][1].split() if i < 40 else []) + [word() for _ in range(9)])) for i in range(80)]
    most, plans = [], []
    own = decontaminate.found_in

    def found_in(df, block, *a):
        most.append(sum(len(t) for _, t in block))
        out = own(df, block, *a)
        plans.append(out._jdf.queryExecution().toString().count("MapInArrow"))
        return out

    monkeypatch.setattr(decontaminate, "found_in", found_in)
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")
    total = sum(len(t) for _, t in items)
    many = {r["doc_id"]: r for r in decontaminate.find_contamination(df, bench, block_bytes=total // 10).collect()}
    assert len(most) >= 20 and max(most) < total / 5
    assert len(set(plans)) == 1  # no worker is chained behind another
    one = {r["doc_id"]: r for r in decontaminate.find_contamination(df, bench).collect()}
    assert many == one and sum(r["contaminated"] for r in one.values()) == 40


def test_rows_of_a_large_class_hold_no_pairs(spark):
    """Near copies: rows between the stages are the members times their blocks, however many pairs they make, and hold no lists."""
    rng = random.Random(1)
    form = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(4000):
        w = list(form)
        w[rng.randrange(3)] = f"e{rng.randrange(10**9)}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    tables: list = []
    nodes = common.stored(near_dup.with_sets(near_dup.named(docs, "doc_id", "text")).where("node IS NOT NULL").dropDuplicates(["node"]), "nodes", tables)
    met = common.stored(near_dup.candidates(nodes).join(nodes.select("node", "sig"), "node"), "met", tables)
    blocks = -(-4000 // near_dup.BLOCK)
    likely = near_dup.likely(met)
    assert 4000 <= likely.count() <= met.count() <= 4000 * near_dup.BANDS * blocks
    assert not any(f.dataType.typeName() == "array" for f in likely.schema)
    common.discard(*tables)


def test_the_cleaning_setting_comes_back(spark):
    before = spark.conf.get(common.CLEAN_SHUFFLES, "false")
    inside = []

    def write(i):
        with common.clean_shuffles(spark):
            barrier.wait(30)
            inside.append(spark.conf.get(common.CLEAN_SHUFFLES))
            barrier.wait(30)

    barrier = threading.Barrier(3)
    threads = [threading.Thread(target=write, args=(i,)) for i in range(3)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert inside == ["true"] * 3 and spark.conf.get(common.CLEAN_SHUFFLES, "false") == before
