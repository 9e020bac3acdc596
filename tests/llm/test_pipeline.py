"""The pipeline's stages, one by one, against brute-force versions, and the registered queries."""

import os

import pytest

import corpus_pipeline as cp
from regionflow.llm import chat_format, decontaminate, registry, secret_scan
from regionflow.llm.common import shared_dir
from tests.llm.test_operators import ODD, SECRET, brute_contamination, brute_dedupe, brute_rules, brute_secrets, classes, near_rows, numbers_of_links

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables aren't here")


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in cp.STAGES]
    assert names == ["quality_rules", "ngram_jaccard_join", "decontamination", "secret_scans", "byte_bpe"]
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for name, stage in cp.STAGES:
        out = stage(spark, docs, SF)
        path = f"{shared_dir(spark)}-{name}"
        out.write.parquet(path)
        docs, old = spark.read.parquet(path), docs
        rows = {r["doc_id"]: r for r in docs.collect()}
        if name != "byte_bpe":
            assert docs.columns == old.columns
        if name == "quality_rules":
            assert all(brute_rules(before[i])[0] >= 50 for i in rows)
            good = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
            base = {i for i in good if (b := brute_rules(before[i]))[0] >= 50 and 2 * b[4] <= b[0]}
            assert len(base - set(rows)) <= 0.02 * len(base)
        elif name == "ngram_jaccard_join":
            assert set(rows) == set(classes(sorted(before.items())).values())
        elif name == "decontamination":
            found = brute_contamination(list(before.values()), bench)
            assert set(rows) == {i for i, (n, hit, _) in zip(before, found) if not (hit and 20 * hit >= n)}
        elif name == "secret_scans":
            assert set(rows) == set(before) and not any(brute_secrets(r["text"]) for r in rows.values())
            assert all(r["text"] == before[i] for i, r in rows.items() if not brute_secrets(before[i]))
        else:
            assert set(rows) == set(before) and all(r["round_trip"] for r in rows.values())
        before = {i: r["text"] for i, r in rows.items()} if name != "byte_bpe" else before


def test_queries_are_registered():
    import __spark_entry__ as e

    assert {n.split("_")[0] for n in registry.queries()} == {f"op{i}" for i in range(1, 14)} and "pipeline" in e.queries()


WANT = {
    "op1": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars",
    "op2": "doc_id held_out score predicted",
    "op3": "doc_id n_words n_hit n_items items_sha256 contaminated",
    "op4": "doc_id n_bytes n_tokens over_limit",
    "op5": "doc_id n_words n_removed kept_sha256",
    "op6": "page_id url text n_chars",
    "op7": "doc_id class_id n_links",
    "op8": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op9": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op10": "doc_id n_assign n_access n_hex base_sha256 spans",
    "op11": "doc_id leaf subroot root proof_sha256 folded_root verified",
    "op12": "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256",
    "op13": "doc_id fingerprint component_id",
}


@pytest.fixture(scope="module")
def given(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def results(spark):
    return {name.split("_")[0]: f(spark, SF).collect() for name, f in registry.queries().items()}


def test_every_query_returns_its_columns(results, given):
    for key, rows in results.items():
        assert set(WANT[key].split()) <= set(rows[0].asDict())
        if key not in ("op1", "op6"):
            assert sorted(r["doc_id"] for r in rows) == sorted(given)


def test_chat_query_says_what_its_sql_says(spark, results):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{SF}/conversations.parquet')")
    cur = con.execute(chat_format.OP1_SQL)
    names = [d[0] for d in cur.description]
    key = lambda r: tuple((r[c] is None, str(r[c])) for c in sorted(names))
    assert sorted(key(dict(zip(names, r))) for r in cur.fetchall()) == sorted(key(r) for r in results["op1"])


def test_query_results_against_brute_force(results, given):
    import hashlib

    import numpy as np
    import tiktoken  # noqa: F401

    from regionflow.llm import byte_bpe
    from tests.llm.test_operators import RANKS

    rows = sorted(given.items())
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in results["op5"]} == brute_dedupe(rows)
    assert {r["doc_id"]: r["class_id"] for r in results["op7"]} == classes(rows)
    assert {r["doc_id"]: r["n_links"] for r in results["op7"]} == numbers_of_links(rows)
    bpe = byte_bpe.encoding(RANKS)
    for r in results["op8"]:
        ids = np.array(bpe.encode_ordinary(given[r["doc_id"]] or ""), "<u4")
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256((given[r["doc_id"]] or "").encode()).hexdigest()
    for r in results["op9"]:
        n, chars, symbols, dup, repeat = brute_rules(given[r["doc_id"]])
        assert [r[c] for c in WANT["op9"].split()[1:6]] == [n, chars, symbols, dup, repeat]
        assert r["base_failed"] == (n < 50 or 2 * repeat > n) and not (r["base_failed"] and r["kept"])


def test_a_named_ledger_outlives_a_call(spark, tmp_path, monkeypatch):
    spark.conf.set(secret_scan.LEDGER, str(tmp_path / "ledger"))
    try:
        first = sorted(secret_scan.op10_secret_scans(spark, SF).collect())
        seen = spark.read.parquet(str(tmp_path / "ledger")).count()
        assert sorted(secret_scan.op10_secret_scans(spark, SF).collect()) == first
        assert spark.read.parquet(str(tmp_path / "ledger")).count() == seen  # no blob was scanned again
        # two scans at once may add a pair twice
        spark.read.parquet(str(tmp_path / "ledger")).cache().write.mode("append").parquet(str(tmp_path / "ledger"))
        assert sorted(secret_scan.op10_secret_scans(spark, SF).collect()) == first
    finally:
        spark.conf.unset(secret_scan.LEDGER)


def test_stages_on_odd_documents(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(i + 100, t) for i, t in near_rows(7)[:30]] + [(0, "a b c d e f"), (101, SECRET), (103, SECRET), (None, SECRET), (None, None)]
    rows += rows[:3]
    schema = "doc_id long, text string, kept string, n_tokens int, findings string, _rest string, node int"
    docs = spark.createDataFrame([(i, t, "k", 7, "f", "r", 1) for i, t in rows], schema)
    for name, stage in cp.STAGES:
        out, none = stage(spark, docs, SF), stage(spark, docs.limit(0), SF)
        got = out.collect()
        assert none.count() == 0
        if name == "byte_bpe":
            assert out.columns == ["doc_id", "kept", "findings", "_rest", "node", "n_tokens", "token_ids", "round_trip"]
            assert len(got) == len(rows) and all(r["round_trip"] for r in got)
            continue
        assert out.columns == docs.columns and all(tuple(r)[2:] == ("k", 7, "f", "r", 1) for r in got)
        if name == "quality_rules":
            assert all(brute_rules(r["text"])[0] >= 50 for r in got) and none.columns == docs.columns
        elif name == "ngram_jaccard_join":
            names = [(r["doc_id"], r["text"]) for r in got]
            assert len(names) == len(set(names)) and (0, "a b c d e f") in names and (101, SECRET) in names
            assert (103, SECRET) not in names and (None, SECRET) not in names and (None, None) in names and (0, None) in names
        elif name == "secret_scans":
            assert len(got) == len(rows) and not any(brute_secrets(r["text"]) for r in got)
        else:
            assert len(got) == len(rows)


def test_decontamination_of_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"]) for r in decontaminate.op3_decontamination(spark, SF).collect()}
    want = brute_contamination([d["text"] for d in docs], bench)
    assert got == {d["doc_id"]: (n, h, len(i)) for d, (n, h, i) in zip(docs, want)}
