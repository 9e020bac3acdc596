"""Each operator against a brute-force version, and the defined results of odd inputs."""

import hashlib
import random
import re
from itertools import combinations

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from regionflow.llm import byte_bpe, chat_format, common, decontaminate, html_text, near_dup, quality_rules, secret_scan, substring_dedup, token_counts, toxicity

ODD = [None, "", " ", "\n\t ", "a", "a b c d", "word " * 30_000, "x" * 100_000, "same text twice here now ok", "same text twice here now ok", "日本 語 ＡＢ é", "<|endoftext|> </s> [INST]", "a\x00b \x0b c"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(None if i == 3 else i, t, "x", i) for i, t in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, kept string, n_tokens int")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


PIECES = public_tokenizers.path("piece_bpe_32k.model")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def test_counts_are_the_library_s(odd, none):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = token_counts.count_tokens(odd, PIECES)
    assert got.columns.count("n_tokens") == 1 and "kept" in got.columns
    for r in got.collect():
        assert (r["n_bytes"], r["n_tokens"]) == (len((r["text"] or "").encode()), len(model.encode(r["text"] or "")))
        assert r["over_limit"] == (r["n_tokens"] > 4096)
    assert token_counts.count_tokens(none, PIECES).count() == 0


def test_json_counts(odd):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    for r in token_counts.count_tokens(odd, path).collect():
        assert r["n_tokens"] == len(t.encode(r["text"] or "", add_special_tokens=False).ids)


def test_parts_rejoin():
    c = token_counts.counter(PIECES)
    rng = random.Random(2)
    for _ in range(200):
        t = "".join(rng.choice(["a", "B", " ", "  ", "▁", "\n", "é", "the", "."]) for _ in range(rng.randint(0, 40)))
        assert c.counts([t]) == [len(c.model.encode(t))]
    assert c.split


def test_bpe_round_trip(odd, none):
    bpe = byte_bpe.encoding(RANKS)
    done = byte_bpe.decode_bpe(byte_bpe.encode_bpe(odd, RANKS), RANKS)
    for r in done.collect():
        import numpy as np

        t = r["text"] or ""
        assert bytes(r["decoded"]) == t.encode() and r["n_tokens"] * 4 == len(r["token_ids"])
        assert np.frombuffer(r["token_ids"], "<u4").tolist() == bpe.encode_ordinary(t)
    assert byte_bpe.encode_bpe(none, RANKS).count() == 0


def test_safe_parts():
    bpe, rng = byte_bpe.encoding(RANKS), random.Random(4)
    for _ in range(300):
        t = "".join(rng.choice(["a", "9", " ", "\n", "'s", "!", "é", "\x1c", "　", "\x85", "word"]) for _ in range(rng.randint(0, 30)))
        parts = byte_bpe.safe_parts(t, rng.randint(1, 5))
        assert "".join(parts) == t and [i for p in parts for i in bpe.encode_ordinary(p)] == bpe.encode_ordinary(t)


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><div id="cookie-banner"><p>We use cookies a lot here</p></div><header><a>Home</a></header>
<nav><ul><li>One</li></ul></nav><div class="ad">Buy now, really, do buy now</div><article><h1>Head &amp; line</h1><p>First <b>bold</b>
 text&nbsp;here<br>more.<p>Be.<aside>Side note</aside><ul><li>x<li>y</ul><section class="comments"><p>Great post of yours!</p></section></article>
<form>Send <input></form><footer>&copy; me</footer><script>var a="<p>no</p>"</script></body></html>"""


def test_page(spark):
    assert html_text.main_text(PAGE) == "Head & line\n\nFirst bold text here more.\n\nBe.\n\nx\n\ny"
    plain = "<body><div class='menu'>Home About</div><div><p>" + "long text " * 20 + "</p><p>end.</p></div><div class='footer'>c</div></body>"
    assert html_text.main_text(plain) == ("long text " * 20).strip() + "\n\nend."
    rows = [(0, None), (1, ""), (2, "<p>"), (3, "just words"), (4, "<div>" * 500 + "deep"), (5, PAGE), (5, PAGE), (6, "<p>a</p>" * 5000), (7, "<b")]
    got = html_text.extract_text(spark.createDataFrame(rows, "page_id long, html string"))
    found = sorted((r["page_id"], r["text"][:12], r["n_chars"]) for r in got.collect())
    assert found[0] == (0, "", 0) and found[1] == (1, "", 0) and found[3][:2] == (3, "just words") and found[4][:2] == (4, "deep")
    assert found[5] == found[6] and found[7][2] == 5000 + 2 * 4999
    assert html_text.extract_text(spark.createDataFrame([], "html string")).count() == 0


def test_chat_rows(spark):
    rows = [(1, 1, "assistant", "a\\l<|im_end|>\n[b]"), (1, 0, "user", None), (2, None, None, None), (None, 5, "assistant", "z"), (3, 0, "user", "q"), (3, 0, "user", "q"), (4, 0, "<|im_start|>x\n", "y\n" * 20000)]
    log = spark.createDataFrame(rows, "conv_id long, seq long, role string, text string").selectExpr("*", "seq AS msg", "'message' AS kind", "1 AS turns")
    got = {r["conv_id"]: r for r in chat_format.read_back(chat_format.render(chat_format.fold_events(log))).collect()}
    assert [(t["role"], t["text"]) for t in got[1]["turns"]] == [("user", ""), ("assistant", "a\\l<|im_end|>\n[b]")] and got[1]["loss_text"] == "a\\l<|im_end|>\n[b]"
    assert len(got[3]["turns"]) == 2 and got[None]["loss_text"] == "z" and got[2]["turns"][0]["role"] == ""
    assert (got[4]["turns"][0]["role"], got[4]["turns"][0]["text"]) == ("<|im_start|>x\n", "y\n" * 20000)
    assert chat_format.render(chat_format.fold_events(log.limit(0))).count() == 0


def test_chat_events(spark):
    events = [(0, 0, "message", "user", "hi"), (1, 1, "delta", "assistant", "bad"), (2, 1, "regenerate", "assistant", ""), (3, 1, "delta", "assistant", "good "), (4, 1, "delta", "assistant", "day"), (6, 2, "message", "user", "tpyo"), (7, 2, "edit", "user", "typo")]
    random.Random(1).shuffle(events)
    log = spark.createDataFrame([(9, *e) for e in events], "conv_id long, seq long, msg long, kind string, role string, text string")
    turns = chat_format.fold_events(log).first()["turns"]
    assert [(t["role"], t["text"]) for t in turns] == [("user", "hi"), ("assistant", "good day"), ("user", "typo")]


def brute_contamination(texts, items):
    out = []
    for t in texts:
        w, hit, found = decontaminate.words(t), set(), set()
        for k, x in items:
            x = decontaminate.words(x)
            m = min(13, len(x))
            grams = {tuple(x[i : i + m]) for i in range(len(x) - m + 1)} if m else set()
            for i in range(len(w) - m + 1 if m else 0):
                if tuple(w[i : i + m]) in grams:
                    hit.update(range(i, i + m))
                    found.add(str(k))
        out.append((len(w), len(hit), sorted(found)))
    return out


@pytest.mark.parametrize("block", [1 << 20, 60])
def test_contamination(spark, block):
    rng = random.Random(block)
    texts = [" ".join(rng.choice("aBcd") for _ in range(rng.randint(0, 70))) for _ in range(30)] + ODD
    items = [(i, " ".join(rng.choice("abcd") for _ in range(rng.choice([0, 1, 3, 12, 13, 14, 20])))) for i in range(12)] + [(50, None), (51, "--"), (1, "a a a")]
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, spans int")
    got = decontaminate.find_contamination(docs, spark.createDataFrame(items, "item_id long, text string"), block_bytes=block)
    rows = {r["doc_id"]: r for r in got.collect()}
    for i, want in enumerate(brute_contamination(texts, items)):
        r = rows[i]
        assert (r["n_words"], r["n_hit"], r["items"]) == want
        assert r["contaminated"] == (want[1] > 0 and 20 * want[1] >= want[0]) and sum(s["end"] - s["start"] for s in r["spans"]) == want[1]
    nothing = decontaminate.find_contamination(docs, spark.createDataFrame([], "item_id long, text string"))
    assert nothing.where("n_hit > 0 OR contaminated").count() == 0


def test_words_are_the_contract_s():
    assert [w.decode() for w in decontaminate.words("Don't É_x9 ﬁ—Z")] == re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "don't É_x9 ﬁ—z")


def brute_dedupe(rows):
    first, out = {}, {}
    for i, t in sorted(rows):
        w = words(t)
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), i)
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < i:
                gone[k : k + 13] = [True] * 13
        out[i] = (len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g)))
    return out


def passages(seed, n=40):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    shared = [[rng.choice(vocabulary) for _ in range(rng.randint(10, 40))] for _ in range(4)]
    rows = []
    for i in range(n):
        w = []
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(shared)
            a = rng.randint(0, 5)
            w += rng.choice([p[a : len(p) - rng.randint(0, 5)], [rng.choice(vocabulary) for _ in range(20)], ["again"] * 20])
        rows.append((i, rng.choice([" ", "\n", "  "]).join(w)))
    return rows + [(n + 1, rows[3][1]), (n + 2, rows[3][1]), (n + 3, ""), (n + 4, "tiny text")]


@pytest.mark.parametrize("most", [8_000, 3])
def test_substrings(spark, none, most, monkeypatch):
    monkeypatch.setattr(substring_dedup, "SHARD_CONTEXTS", most)
    rows = passages(most)
    got = substring_dedup.dedupe_substrings(spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_words", F.lit("x")))
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got.collect()} == brute_dedupe(rows)
    assert substring_dedup.dedupe_substrings(none).count() == 0


def test_substrings_odd(spark):
    long = " ".join(f"v{i}" for i in range(3000))
    rows = [(1, long), (1, long), (2, None), (None, long), (None, "only here " * 9), (3, "x" * 50_000)]
    got = substring_dedup.dedupe_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = sorted(((r["doc_id"] or 0), r["n_words"], r["n_removed"]) for r in got)
    assert found == [(0, 18, 0), (0, 3000, 3000), (1, 3000, 0), (1, 3000, 0), (2, 0, 0), (3, 1, 0)]


def classes(rows):
    sets = {i: frozenset(tuple(w[k : k + min(5, len(w))]) for k in range(len(w) - min(5, len(w)) + 1)) if (w := words(t)) else frozenset() for i, t in rows}
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(parent)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and both >= 0.8 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def near_rows(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows = []
    for g in range(25):
        base = [word() for _ in range(rng.randint(3, 150))]
        for _ in range(rng.choice([1, 1, 2, 3, 12])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                w[rng.randrange(len(w))] = word()
            rows.append((len(rows) * 3, " ".join(w)))
    return rows + [(900, None), (901, ""), (902, ""), (903, "x" * 60_000), (904, "one two"), (905, "one two")]


@pytest.mark.parametrize("seed", [1, 2])
def test_near_classes(spark, seed):
    rows = near_rows(seed)
    got = {r["doc_id"]: r for r in near_dup.near_classes(spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit(1))).collect()}
    assert {i: r["class_id"] for i, r in got.items()} == classes(rows)
    assert len(got) == len(rows) and all(r["n_links"] >= 0 for r in got.values())


def test_one_of_each(spark, none):
    rows = [*near_rows(5), (None, "kept as it has no id")]
    docs = spark.createDataFrame([(*r, "c") for r in [*rows, rows[0]]], "doc_id long, text string, class_id string")
    left = near_dup.one_of_each(docs)
    ids = [r["doc_id"] for r in left.collect()]
    assert left.columns == docs.columns and sorted(i for i in ids if i is not None) == sorted(set(classes(rows[:-1]).values())) and ids.count(None) == 1
    assert near_dup.near_classes(none).count() == 0


def test_a_large_group_proposes_linearly_many_pairs(spark):
    rng = random.Random(9)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(400):
        w = list(base)
        w[rng.randrange(200)] = f"edit{i}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    nodes = near_dup.with_sets(near_dup.named(docs, "doc_id", "text"))
    assert near_dup.candidates(nodes).count() < 400 * 2 * near_dup.BANDS
    assert near_dup.near_classes(docs).select("class_id").distinct().count() == 1


def numbers_of_links(rows):
    """For each row the number of different texts that its text links with, from all pairs."""
    sets = {}
    for _, t in rows:
        w = (t or "").split()
        m = min(len(w), 5)
        if w:
            sets[t] = {tuple(w[k : k + m]) for k in range(len(w) - m + 1)}
    n = dict.fromkeys(sets, 0)
    for a, b in combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both >= 0.8 * len(sets[a] | sets[b]):
            n[a], n[b] = n[a] + 1, n[b] + 1
    return {i: n.get(t, 0) for i, t in rows}


def filled(rng, form, edits):
    w = list(form)
    for at in rng.sample(range(len(form)), edits):
        w[at] = f"e{rng.randrange(10**9)}"
    return " ".join(w)


def test_light_pairs_in_heavily_edited_families(spark):
    rng = random.Random(21)
    families = []
    for g in range(6):
        form = [f"w{rng.randrange(10**6)}" for _ in range(300)]
        families.append([(1000 * g + i, filled(rng, form, edits)) for i, edits in enumerate([3, 3] + [16] * 400)])
    got = near_dup.near_classes(spark.createDataFrame(sum(families, []), "doc_id long, text string")).collect()
    expected = {}
    for rows in families:  # no two families share a shingle
        expected |= classes(rows)
    assert {r["doc_id"]: r["class_id"] for r in got} == expected


@pytest.mark.parametrize("block", [512, 7])
def test_links_are_counted_whole(spark, monkeypatch, block):
    monkeypatch.setattr(near_dup, "BLOCK", block)
    monkeypatch.setattr(near_dup, "ENTRIES", 500_000 if block == 512 else 300)
    rng = random.Random(22)
    form = [f"w{i}" for i in range(120)]
    rows = [(i, filled(rng, form, i % 4)) for i in range(60)] + [(100 + i, t) for i, (_, t) in enumerate(near_rows(3)[:40])]
    rows += [(200, "five words with other blanks"), (201, "five words\twith other  blanks"), (202, "five words with other blanks"), (203, rows[5][1] + " "), (204, None)]
    got = {r["doc_id"]: r for r in near_dup.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: r["n_links"] for i, r in got.items()} == numbers_of_links(rows)
    assert {i: r["class_id"] for i, r in got.items()} == classes(rows)
    assert got[200]["n_links"] == got[201]["n_links"] == 1


def test_pruning_table():
    least = near_dup.least_matches()
    assert len(least) == 8 and least == sorted(least) and least[-1] < 0.8 * 128


def test_labels_are_learned_through_disguises(spark):
    rng = random.Random(3)
    calm = lambda: [rng.choice(["tree", "house", "river", "stone", "cloud", "light"]) + rng.choice(["", "s", "ly"]) for _ in range(60)]
    docs, labels = [], []
    for i in range(240):
        w = calm()
        if i % 4 == 0:
            w[5], w[20] = "Blockhead", "nitwitted"
        docs.append((i, " ".join(w)))
        labels.append((i, int(i % 4 == 0)))
    held = [(1000, "what a Bl0ckhеad you are"), (1001, "the river and the trees"), (1002, None), (1003, ""), (1004, "b-l " + "tree " * 20_000)]
    d, y = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit_toxicity(d, y)
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(spark.createDataFrame(held, "doc_id long, text string").withColumn("score", F.lit("old")), model).collect()}
    assert got[1000]["predicted"] == 1 and [got[i]["predicted"] for i in (1001, 1002, 1003, 1004)] == [0] * 4
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert toxicity.fit_toxicity(d, y.where("toxic = 0")).score("Blockhead") < 0.01
    exempt = toxicity.Model(model.stems, {toxicity.fold("blockhead engine") + " "}, model.coef)
    assert exempt.score("the blockhead engine") < model.score("the blockhead engine")


def test_fold():
    assert toxicity.fold("Ѕtup1d 1D10T! p@thetic S​cum mörön") == " " + " ".join(x.replace("l", "i") for x in "stupid idiot pathetic scum moron".split())


def brute_rules(t):
    t = t or ""
    w = words(t)
    lines = [x for x in t.split("\n") if words(x)]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    mark = set()
    for i, g in enumerate(grams):
        if grams.count(g) >= 2:
            mark.update(range(i, i + 3))
    return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(mark)]


def test_rule_statistics():
    rng = random.Random(8)
    texts = [t for t in ODD if t is None or len(t) < 1000] + ["".join(rng.choice(["a", "b ", "\n", "# ", "é", "\x0b", "x y z ", "\r\n"]) for _ in range(rng.randint(0, 60))) for _ in range(200)]
    for t in texts:
        assert quality_rules.statistics(t)[0] == brute_rules(t)


def test_forest_parts_good_from_bad(spark, odd, none):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9)))
    docs, labels = [], []
    for i in range(160):
        w = [word() for _ in range(80)]
        docs.append((i, " ".join(w) if i % 5 else " | ".join(w)))
        labels.append((i, int(i % 5 > 0)))
    d, y = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    forest = quality_rules.fit_forest(d, y)
    got = {r["doc_id"]: r["kept"] for r in quality_rules.judge(d, forest).collect()}
    assert sum(got[i] != bool(v) for i, v in labels) <= 2
    assert quality_rules.fit_forest(d, y.where("quality = 1")) is None and quality_rules.judge(d, None).where("kept").count() == 160
    strange = quality_rules.judge(odd, forest)
    assert strange.count() == len(ODD) and strange.where("n_words < 50 AND kept").count() == 0 and quality_rules.judge(none, forest).count() == 0


KEY = "AKIA" + "ABCDEFGHIJ1234567"
SECRET = f"x PassWord = 'abcdefghijkl' {KEY} deadbeefdeadbeef0 token:short api_key=\"Abc/def+ghi=jkl\" éé secret: aaaaaaaaaaaa"


def brute_secrets(t):
    t = t or ""
    rules = [
        (r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "assign", lambda m: len(m[2]) >= 12),
        (r"AKIA[A-Z0-9]+", "access", lambda m: len(m[0]) >= 18),
        (r"[0-9a-f]+", "hex", lambda m: len(m[0]) >= 16),
    ]
    found = [(m.start(), k, name, m.end()) for k, (r, name, good) in enumerate(rules) for m in re.finditer(r, t) if good(m)]
    return ",".join(f"{n}:{s}:{e}" for s, _, n, e in sorted(found))


def test_secrets(spark, odd, none, tmp_path):
    rng = random.Random(5)
    texts = [*ODD, SECRET, SECRET] + ["".join(rng.choice(["token", "=", ":", " ", "'", "abcdef0123456789", "AKIA", "ABCDEFGHIJKLMN", "secret", "K", "ſecret"]) for _ in range(rng.randint(0, 14))) for _ in range(150)]
    docs = spark.createDataFrame([(i, t, "f") for i, t in enumerate(texts)], "doc_id long, text string, findings string")
    found = secret_scan.scan_secrets(docs, str(tmp_path / "ledger"))
    rows = found.select("doc_id", secret_scan.joined(F.col("findings"), secret_scan.BASE_KINDS).alias("s")).collect()
    assert len(rows) == len(texts) and all(r["s"] == brute_secrets(texts[r["doc_id"]]) for r in rows)
    assert secret_scan.scan_secrets(none, str(tmp_path / "none")).count() == 0
    assert secret_scan.scan_secrets(odd, str(tmp_path / "odd")).count() == len(ODD)


def test_only_unseen_blobs_are_scanned(spark, tmp_path):
    path = str(tmp_path / "ledger")
    one = spark.createDataFrame([(1, SECRET), (2, SECRET), (3, "calm")], "doc_id long, text string")
    secret_scan.scan_secrets(one, path).count()
    assert spark.read.parquet(path).count() == 2
    two = spark.createDataFrame([(7, SECRET), (8, "new")], "doc_id long, text string")
    assert {r["doc_id"]: len(r["findings"]) for r in secret_scan.scan_secrets(two, path).collect()} == {7: 5, 8: 0}
    assert spark.read.parquet(path).count() == 3
    secret_scan.scan_secrets(two, path, rule_version=99).count()
    assert spark.read.parquet(path).count() == 5


def test_redaction(spark, tmp_path):
    docs = spark.createDataFrame([(1, SECRET), (2, "calm"), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in secret_scan.redact(docs, str(tmp_path / "ledger")).collect()}
    assert got[2] == "calm" and got[3] is None
    assert brute_secrets(got[1]) == "" and got[1].startswith("x [SECRET]' [SECRET] [SECRET] token:short [SECRET]")


def test_slices_are_bounded():
    import pyarrow as pa

    b = pa.RecordBatch.from_arrays([pa.array(["a" * 10, None, "b" * 50, "c", "", "d" * 9])], ["t"])
    parts = list(common.byte_slices(b, "t", 20))
    assert sum(p.num_rows for p in parts) == 6 and [p.num_rows for p in parts] == [2, 1, 3]


def test_long_texts_take_seconds():
    """Texts of a few MB, made to be hard for each operator's Python part."""
    import time

    import pyarrow as pa

    began = time.time()
    model = toxicity.Model({" bad": 3.0, " bad ": 3.5}, {" bad apple ", " apple bad "}, [-1.0, 1, 1, 1])
    assert model.matches(toxicity.fold("bad apple bad pear " * 200_000))
    assert html_text.main_text("<div>" * 200_000 + "deep") == "deep"
    assert html_text.main_text("<p><article>" + "<div>x" * 100_000 + "</p>" * 100_000).startswith("x")
    assert html_text.main_text("words " + "< <! <a " * 100_000).startswith("words <")
    assert secret_scan.find_secrets("-eyJ" * 500_000) == [] and secret_scan.find_secrets("token " * 300_000) == []
    assert len(near_dup.Shingler().sets(pa.array(["word " * 1_000_000]))[0]) == 1
    assert substring_dedup.anchors(common.Words(pa.array(["x" * 5_000_000 + " y" * 100])))[0].tolist()
    assert quality_rules.statistics("a b c " * 500_000)[0][0] == 1_500_000
    assert decontaminate.shard_hits(["a b c d " * 300_000], decontaminate.Phrases([("i", "c d a b")]))[1] == [[[2, 1_199_998]]]
    assert time.time() - began < 90


def test_words_of_a_buffer():
    import pyarrow as pa

    found = common.Words(pa.array(ODD))
    assert found.joined() == [" ".join(words(t)).encode() for t in ODD] and found.sizes.tolist() == [len(words(t)) for t in ODD]
    every = [w for t in ODD for w in words(t)]
    assert len(set(found.hashes().tolist())) == len(set(every)) and found.hashes(7).tolist() == found.hashes().tolist()
    assert common.Words(pa.array([None, ""])).joined() == [b"", b""]


def test_an_id_of_several_texts_loses_none(spark):
    t = " ".join(f"w{i}" for i in range(100))
    rows = [(3, t), (5, t.replace("w50", "x50")), (5, "a text that stands alone here"), (5, "a text that stands alone here"), (7, None), (7, "one more alone")]
    left = near_dup.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["text"] or "") for r in left) == [(3, t), (5, "a text that stands alone here"), (7, ""), (7, "one more alone")]


def test_rows_without_an_id(spark):
    rng = random.Random(12)
    form = [f"w{i}" for i in range(100)]
    rows = [(None, filled(rng, form, i % 3)) for i in range(120)] + [(None, f"alone {i} " * 20) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_dup.near_classes(docs).collect()
    want = numbers_of_links(list(enumerate(t for _, t in rows)))
    assert len(got) == 180 and all(r["class_id"] is None for r in got) and sorted(r["n_links"] for r in got) == sorted(want.values())
    assert near_dup.one_of_each(docs).count() == 61
    # texts are hashed a second time once for each set in question, however many rows share a null id
    seen = spark.sparkContext.accumulator(0)
    inner = near_dup.with_sets

    def counted(df, binary_set=False):
        return inner(df.where(F.udf(lambda: bool(seen.add(1)) or True, "boolean").asNondeterministic()()), binary_set) if binary_set else inner(df)

    near_dup.with_sets = counted
    try:
        near_dup.near_classes(docs).count()
    finally:
        near_dup.with_sets = inner
    assert 0 < seen.value <= 240
    gone = substring_dedup.dedupe_substrings(docs).collect()
    assert all(r["n_removed"] == 0 for r in gone)


def test_deltas_belong_to_the_last_message(spark):
    events = [(0, 0, "message", "user", "A"), (1, 0, "message", "user", "B"), (2, 0, "delta", "user", "C"), (3, 1, "delta", "assistant", "x"), (4, 1, "message", "assistant", "W"), (5, 1, "edit", "assistant", "V"), (6, 1, "delta", "assistant", "!"), (None, 1, "message", "assistant", "last"), (9, None, "message", "user", "end")]
    log = spark.createDataFrame([(9, *e) for e in events], "conv_id long, seq long, msg long, kind string, role string, text string")
    turns = chat_format.fold_events(log).first()["turns"]
    assert [t["text"] for t in turns] == ["A", "BC", "x", "V!", "last", "end"]


def brute_matches(folded, stems, phrases):
    """Stems at blanks, the heaviest at each place, without those that begin inside a phrase."""
    padded, out = folded + " ", {}
    inside = {i for p in phrases for k in range(len(padded)) if padded.startswith(p, k) for i in range(k, k + len(p) - 1)}
    for k in range(len(padded)):
        held = [(w, s) for s, w in stems.items() if padded.startswith(s, k)]
        if held and k not in inside:
            out[k] = max(held)[0]
    return out


def test_lexicon_against_brute_force():
    rng = random.Random(13)
    stems = {" ab": 1.0, " ab ": 2.0, " abc": 3.0, " b": 0.5, " ca ": 4.0}
    phrases = {" ab ca ", " b b ", " ca abc "}
    model = toxicity.Model(stems, phrases, [0.0, 1, 1, 1])
    for _ in range(300):
        folded = " " + " ".join(rng.choice(["ab", "abc", "abd", "b", "ba", "ca", "cab", "x"]) for _ in range(rng.randint(0, 14)))
        assert {s: w for s, _, w in model.matches(folded)} == brute_matches(folded, stems, phrases)


def test_scores_of_odd_texts(spark, odd, none):
    model = toxicity.Model({" bad": 3.0}, set(), [-2.0, 1, 1, 1])
    got = toxicity.score_toxicity(odd.withColumn("predicted", F.lit("old")), model)
    assert got.count() == len(ODD) and got.columns.count("predicted") == 1 and got.where("score BETWEEN 0 AND 1").count() == len(ODD)
    assert toxicity.score_toxicity(none, model).count() == 0
    # labels and documents that repeat: toxic if any label says so, one text an id
    docs = spark.createDataFrame([(i % 20, "calm words" if i % 2 else "awful badword here") for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i in range(20) for y in ((0, 1) if i % 2 == 0 else (0, 0))], "doc_id long, toxic int")
    learned = toxicity.fit_toxicity(docs, labels)
    assert learned.score("badword") > 0.5 > learned.score("calm words")
    assert toxicity.fit_toxicity(none, labels.limit(0)).score("x") < 0.01


def test_windows_with_many_surroundings(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "SHARD_CONTEXTS", 10)
    rng = random.Random(14)
    hot = " ".join(f"h{i}" for i in range(13))
    rows = [(i, f"{' '.join(f'a{rng.randrange(9999)}' for _ in range(6))} {hot} {' '.join(f'b{rng.randrange(9999)}' for _ in range(6))}") for i in range(90)]
    rows += [(None, rows[0][1]), (None, "c " + rows[1][1])]
    got = substring_dedup.dedupe_substrings(spark.createDataFrame(rows, "doc_id long, text string"))
    want = brute_dedupe([(i, t) for i, t in rows if i is not None])
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got.collect() if r["doc_id"] is not None} == want
    assert sorted(r["n_removed"] for r in got.collect() if r["doc_id"] is None) == [25, 25]


ARTICLE = "<h1>Title</h1><p>" + "Prose of some length. " * 12 + "</p><p>End.</p>"
TEXT = "Title\n\n" + ("Prose of some length. " * 12).strip() + "\n\nEnd."


@pytest.mark.parametrize(
    "page",
    [
        f"<body><nav>Home</nav><div class='content no-sidebar'>{ARTICLE}</div><div class='sidebar'>Side</div></body>",
        f"<body><div class='widget'>{ARTICLE}</div><div class='comments'><p>Great post!</p></div></body>",
        f"<body><div id='cookieBanner'>We use cookies</div><main>{ARTICLE}</main><footer>c</footer></body>",
        f"<body><article>{ARTICLE}<div class='ad'>Buy now</div><aside>Aside</aside></article><div class='related-posts'>More</div></body>",
        f"<body><header><h2>Site</h2></header><article><header>{ARTICLE}</header></article><form>Name<input></form></body>",
        f"<html><head><title>T</title><style>p{{}}</style><script>x='<p>'</script></head><body>{ARTICLE}</body></html>",
        f"<div class='site-footer'>c</div><div class='page'>{ARTICLE}</div><div class='comment-list'><article class='c'>Nice</article></div>".replace("<article class='c'>Nice</article>", "<p>Nice</p>"),
        f"<body><article>{ARTICLE}<p hidden>secret</p><section class='comments'>Hm</section></article></body>",
        f"<body><table><tr><td>{ARTICLE}</td><td class='sidebar-left'>Side</td></tr></table></body>",
        f"<body><div role='navigation'><a>x</a></div><article>{ARTICLE}<!-- note --></article><noscript>No</noscript></body>",
        f"<body><ul class='breadcrumbs'><li>a<li>b</ul><section>{ARTICLE}</section><div class='newsletter signup'>Join us</div></body>",
        f"<BODY><ARTICLE>{ARTICLE}</ARTICLE><DIV CLASS='Social'>Share</DIV><a href='",
    ],
)
def test_hand_pages(page):
    assert html_text.main_text(page) == TEXT


def test_related_work_is_prose():
    page = f"<body><article>{ARTICLE}<p class='related-work'>Work of others.</p></article></body>"
    assert html_text.main_text(page) == TEXT + "\n\nWork of others."


def test_web_tokens():
    part = "abcdefgh_-"
    text = f"x eyJ{part}.{part}.{part} -eyJ{part}.{part}.{part}.{part} eyJab.{part}.{part} eyJ{part}.{part}"
    rule = re.compile(r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")
    assert secret_scan.web_tokens(text) == [m.span() for m in rule.finditer(text)]


def test_redaction_marks_are_plain_text(spark, tmp_path):
    docs = spark.createDataFrame([(1, SECRET, "c")], "doc_id long, text string, findings string")
    got = secret_scan.redact(docs, str(tmp_path / "ledger"), mark="it's \\1 $0")
    assert got.columns == docs.columns and got.first()["text"].startswith("x it's \\1 $0' it's \\1 $0 it's")
