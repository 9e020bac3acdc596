r"""Secret scans: an incremental ledger of content-addressed blobs.

Every version of a text is addressed by its SHA-256.  The ledger, a table at a
path of the caller's (queries take it from ``spark.regionflow.secretLedger``,
and otherwise keep one at a fixed place of the shared folder), holds the findings of each (blob,
rule version) pair ever scanned.  A scan groups the texts by address, keeps one path of each blob
(the groups are pre-aggregated, so thousands of copies cost nothing), drops the
pairs that the ledger has, scans the rest and appends them; then the findings of
these blobs alone are taken from the ledger and
joined back to all paths, whose copies Spark may split, since the other side
has one row a blob.

Base rules (kinds assign, access, hex) find leftmost non-overlapping matches;
further kinds add spans: github, jwt, private_key.  Offsets are code points.

Defined results: a null text is an empty blob without findings; repeated rows
get the findings of their blob each; an empty table gives an empty table; the
paths' other columns are kept and clashing ones replaced.

The ledger stays, and so does the table of findings that the result reads.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, column, discard, shared_dir, stored, table, texts_of, without

#: Raise with every change of the rules: pairs of older versions are scanned anew.
RULE_VERSION = 1

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
LONG_HEX = re.compile(r"[0-9a-f]{16,}")
BASE_KINDS = ("assign", "access", "hex")
GITHUB = re.compile(r"\bgh[pousr]_[A-Za-z0-9]{36,}")
PRIVATE_KEY = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]*(?:-----END [A-Z ]*PRIVATE KEY-----)?")
_DOTTED, _JWT_HEAD = re.compile(r"[A-Za-z0-9_.-]+"), re.compile(r"\beyJ")


def web_tokens(text: str) -> list[tuple[int, int]]:
    """Three parts of 8 or more characters parted by dots, the first behind ``eyJ``: maximal runs, then their parts, so each character is seen once."""
    out = []
    for run in _DOTTED.finditer(text):
        if "eyJ" not in run[0]:
            continue
        at, done = run.start(), -1
        parts = []
        for p in run[0].split("."):
            parts.append((at, p))
            at += len(p) + 1
        for (at, a), (_, b), (last, c) in zip(parts, parts[1:], parts[2:]):
            m = _JWT_HEAD.search(a)
            if at > done and m and len(a) - m.end() >= 8 and len(b) >= 8 and len(c) >= 8:
                done = last + len(c)
                out.append((at + m.start(), done))
    return out


def spans_of(rule: re.Pattern):
    return lambda text: [m.span() for m in rule.finditer(text)]


#: Kinds beyond the base: a string without which there are none, and what finds them.
MORE = {"github": ("gh", spans_of(GITHUB)), "jwt": ("eyJ", web_tokens), "private_key": ("PRIVATE KEY", spans_of(PRIVATE_KEY))}
KINDS = [*BASE_KINDS, *MORE]

FINDING = T.ArrayType(T.StructType().add("kind", "string").add("start", "integer").add("end", "integer"))


def find_secrets(text: str | None) -> list[tuple[str, int, int]]:
    """All findings of one text, by start, then kind as listed."""
    text = text or ""
    found = [("hex", m.start(), m.end()) for m in LONG_HEX.finditer(text)]
    if ":" in text or "=" in text:
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    for kind, (hint, find) in MORE.items():
        if hint in text:
            found += [(kind, *span) for span in find(text)]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


#: Blobs that a task remembers, so that it scans the copies of one once.
REMEMBERED = 1 << 16


def scan_blobs(blobs: DataFrame, text_col: str) -> DataFrame:
    """blobs (blob, text_col) with ``findings``, without their texts; copies that a task meets are scanned once."""
    added = T.StructType().add("findings", FINDING)

    def make():
        seen: dict[str, list] = {}

        def findings(blob, text):
            if blob not in seen:
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen[blob] = [{"kind": k, "start": s, "end": e} for k, s, e in find_secrets(text)]
            return seen[blob]

        return lambda b: {"findings": [findings(*x) for x in zip(texts_of(b, "blob"), texts_of(b, text_col))]}

    return arrow_map(blobs, added, make, text_col, (text_col,))


def read_ledger(spark, path: str) -> DataFrame:
    """The ledger at path, or an empty one if nothing was ever written there."""
    schema = T.StructType().add("blob", "string").add("rule_version", "integer").add("findings", FINDING)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def scan_secrets(docs: DataFrame, ledger_path: str, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True, rule_version: int = RULE_VERSION) -> DataFrame:
    """docs with ``findings``; the ledger gains the pairs that it hadn't.

    Rows that share an id must not differ in text; where they do, each is found by (id, blob).
    """
    spark = docs.sparkSession
    text, path = F.coalesce(column(text_col), F.lit("")), column(id_col)
    address = F.sha2(text.cast("binary"), 256)
    kept = [column(c) for c in without(docs, ["findings", "blob", *([] if keep_text else [text_col])])]
    # one path stands for a blob: its smallest id, or none if all its ids are null
    blobs = docs.select(address.alias("blob"), path.alias("path")).groupBy("blob").agg(F.min("path").alias("path"))
    blobs = stored(blobs, "blobs")
    ledger = read_ledger(spark, ledger_path).where(F.col("rule_version") == rule_version)
    unseen = blobs.join(ledger.select("blob"), "blob", "left_anti")
    paths = docs.select(path.alias("path"), address.alias("blob"), text.alias("_text"))
    todo = paths.join(unseen.withColumnRenamed("path", "_p").withColumnRenamed("blob", "_b"), F.expr("path <=> _p AND blob = _b"), "left_semi").select("blob", "_text")
    # rows of one (id, blob) count once in the ledger
    scanned = scan_blobs(todo, "_text").groupBy("blob").agg(F.max("findings").alias("findings"))
    scanned.select("blob", F.lit(rule_version).cast("integer").alias("rule_version"), "findings").write.mode("append").parquet(ledger_path)
    # of the ledger, what these blobs need, as a table of its own, in which a pair stands once even if two scans added
    # it: the other side of this join is the paths as they are, whose hot blobs Spark can split
    known = read_ledger(spark, ledger_path).where((F.col("rule_version") == rule_version) & (F.size("findings") > 0)).select("blob", "findings")
    known = stored(known.join(blobs.select("blob"), "blob", "left_semi").dropDuplicates(["blob"]), "findings")
    discard(blobs)
    back = docs.select(*kept, address.alias("_blob")).join(known, F.col("_blob") == F.col("blob"), "left")
    return back.select(*kept, F.coalesce("findings", F.array().cast(FINDING)).alias("findings"))


def joined(findings, kinds=None):
    chosen = F.filter(findings, lambda x: x["kind"].isin(*kinds)) if kinds else findings
    return F.array_join(F.transform(chosen, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(docs: DataFrame, ledger_path: str, mark: str = "[SECRET]", text_col: str = "text") -> DataFrame:
    """docs with every secret's span replaced by ``mark``; overlapping spans are replaced together."""
    found = scan_secrets(docs, ledger_path, text_col=text_col)
    # the stretches between secrets, joined by the mark
    cut = lambda s, f: F.struct(f["end"].alias("at"), F.when(f["start"] >= s["at"], F.array_append(s["left"], F.struct(s["at"].alias("a"), f["start"].alias("z")))).otherwise(s["left"]).alias("left"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<a:int,z:int>>").alias("left"))
    text = column(text_col)
    left = F.aggregate("findings", zero, lambda s, f: F.when(f["end"] <= s["at"], s).otherwise(cut(s, f)), lambda s: F.array_append(s["left"], F.struct(s["at"].alias("a"), F.length(text).alias("z"))))
    clean = F.array_join(F.transform(left, lambda g: F.substr(text, g["a"] + 1, g["z"] - g["a"])), mark)
    return found.withColumn(text_col, F.when(F.size("findings") > 0, clean).otherwise(text)).select(*[column(c) for c in docs.columns])


#: Names a ledger; without it queries share one in the folder that spark.checkpoint.dir names.
LEDGER = "spark.regionflow.secretLedger"


def ledger_of(spark) -> str:
    """The path of the ledger that queries share: a fixed one, so that a later call, of any session, scans only what is new.

    Where neither setting is there, which only one machine allows, the ledger lives as long as the session.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return spark.conf.get(LEDGER, None) or (f"{shared.rstrip('/')}/secret-ledger" if shared else f"{shared_dir(spark).rsplit('/', 1)[0]}/secret-ledger")


def op10_secret_scans(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan_secrets(docs, ledger_of(spark), keep_text=False)
    count = lambda kind: F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(joined(F.col("findings"), BASE_KINDS), 256).alias("base_sha256"),
        joined(F.col("findings")).alias("spans"),
    )
