"""Toxicity: a weighted lexicon matched by Aho-Corasick over folded text.

Folding undoes disguises: compatibility forms, accents, homoglyphs of other
scripts, letters swapped for digits or signs, zero-width characters; i, l, 1, !
and | become one letter.  The lexicon holds word stems (prefixes and whole
words), weighed by the log odds that labelled training rows give them; exception
phrases (two-word phrases with a stem that only clean training rows have, and
any given ones) take a match back.  The sum of the weights, and the sum
normalised by length, give the score through a logistic calibration.

Training reads one text each of at most ``max_labelled`` labelled documents
(those with the smallest hash of doc_id) and never a held-out one; a stem must
be in a twentieth of the toxic training texts, two at least and ``MIN_TOXIC`` at most; lexicon and phrases are bounded by
``max_terms``.  All documents are scored whole, in time linear in their length.

Defined results: a document labelled both ways is toxic; null and empty texts score as texts without a match; without
toxic training rows every score is the toxic share of the training rows (0 if
there is none); repeated rows are scored each; empty tables give empty tables;
input columns are kept and clashing ones replaced.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, discard, stored, table, texts_of

MAX_LABELLED, MAX_TERMS, MIN_TOXIC, THRESHOLD = 24_000, 2_000, 6, 0.3

# Characters of other scripts, digits and signs that look like a letter.
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ɡ": "g", "ո": "n", "ս": "u", "ԛ": "q", "ԝ": "w",
    "α": "a", "β": "b", "γ": "y", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "σ": "o", "τ": "t", "υ": "u", "χ": "x", "ω": "w",
    "ı": "i", "ł": "l", "ø": "o", "đ": "d", "ħ": "h", "æ": "ae", "œ": "oe", "ß": "ss",
    "0": "o", "1": "i", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "l": "i",
}
SIGNS = {"@": "a", "$": "s", "!": "i", "|": "i", "€": "e", "£": "i", "+": "t"}

_INNER = re.compile(r"[@$!|€£+](?=\w)")
_WORD = re.compile(r"[^\W_]+")
# combining marks and zero-width characters vanish
_TABLE = str.maketrans(LOOKALIKES) | dict.fromkeys([*range(0x300, 0x370), *range(0x200B, 0x2010), 0x2060, 0xFEFF, 0xAD])


def fold(text: str | None) -> str:
    """Words of text in folded letters, each after one blank."""
    text = text or ""
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text)
    text = text.lower()
    if any(s in text for s in SIGNS):
        text = _INNER.sub(lambda m: SIGNS[m[0]], text)
    return " " + " ".join(_WORD.findall(text.translate(_TABLE)))


class Model:
    """Stems with weights, exception phrases and a logistic calibration."""

    def __init__(self, stems: dict[str, float], phrases: set[str], coef: list[float]):
        self.stems, self.phrases, self.coef = stems, phrases, coef
        self._found = None

    def __getstate__(self):
        return {"stems": self.stems, "phrases": self.phrases, "coef": self.coef, "_found": None}

    def automaton(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for s, w in self.stems.items():
            a.add_word(s, (len(s), w, None))
        for p in self.phrases:
            a.add_word(p, (len(p), 0.0, p))
        if len(a):
            a.make_automaton()
        return a

    def matches(self, folded: str) -> list[tuple[int, str, float]]:
        """(start, stem, weight) of the heaviest stem at each word, without those inside an exception phrase."""
        if self._found is None:
            self._found = self.automaton()
        if not len(self._found):
            return []
        best: dict[int, tuple[str, float]] = {}
        free: list[tuple[int, int]] = []
        padded = folded + " "
        for end, (n, w, phrase) in self._found.iter(padded):
            start = end - n + 1
            if phrase is not None:
                free.append((start, end))
            elif start not in best or best[start][1] < w:
                best[start] = (padded[start : end + 1], w)
        # both in order, so one pass tells which matches begin inside a phrase
        free.sort()
        out, k, reach = [], 0, -1
        for s, (t, w) in sorted(best.items()):
            while k < len(free) and free[k][0] <= s:
                reach = max(reach, free[k][1])
                k += 1
            if s >= reach:
                out.append((s, t, w))
        return out

    def features(self, text: str | None) -> list[float]:
        folded = fold(text)
        found = self.matches(folded)
        total, n = sum(w for _, _, w in found), folded.count(" ")
        return [1.0, math.log1p(total), math.log1p(1000.0 * total / (n + 50)), math.log1p(len({t for _, t, _ in found}))]

    def score(self, text: str | None) -> float:
        z = sum(a * b for a, b in zip(self.coef, self.features(text)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def logistic(x, y, ridge: float = 0.1, steps: int = 30):
    """Newton's method with a ridge on all but the constant."""
    import numpy as np

    w, pen = np.zeros(x.shape[1]), np.array([1e-3] + [ridge] * (x.shape[1] - 1))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + pen * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + np.diag(pen)
        step = np.linalg.solve(hess, grad)
        w -= step
        if abs(step).max() < 1e-8:
            break
    return w


def word_counts(rows: DataFrame) -> DataFrame:
    """word, toxic, clean: labelled texts that have the folded word, summed within tasks first."""
    schema = T.StructType().add("word", "string").add("toxic", "long").add("clean", "long")

    def run(batches):
        for b in batches:
            n: tuple[Counter, Counter] = (Counter(), Counter())
            for t, y in zip(texts_of(b, "text"), texts_of(b, "label")):
                n[y == 1].update(set(fold(t).split(" ")) - {""})
            import pyarrow as pa

            words = list(set(n[0]) | set(n[1]))
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([n[1][w] for w in words], pa.int64()), pa.array([n[0][w] for w in words], pa.int64())], ["word", "toxic", "clean"])

    return rows.mapInArrow(run, schema).groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", held_out=None, exceptions: tuple[str, ...] = (), max_labelled: int = MAX_LABELLED, max_terms: int = MAX_TERMS) -> Model:
    """A model of at most max_terms stems, learned from labelled rows that aren't held out."""
    # a document labelled both ways counts as toxic
    known = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("integer")).alias("label"))
    if held_out is not None:
        known = known.where(~held_out(F.col("id")))
    known = known.orderBy(F.xxhash64("id"), "id").limit(max_labelled)
    # one text of each id, so that the rows are bounded too; they're read several times
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(known), "id")
    labelled = stored(rows.groupBy("id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.max("label").alias("label")), "labelled")
    try:
        return fitted(labelled.select("text", "label"), tuple(exceptions), max_terms)
    finally:
        discard(labelled)


def fitted(rows: DataFrame, exceptions: tuple[str, ...], max_terms: int) -> Model:
    """A model from rows (text, label)."""
    import numpy as np

    n = rows.agg(F.expr("count_if(label = 1)"), F.expr("count_if(label <> 1)")).first()
    given = {" " + fold(x).strip() + " " for x in exceptions}
    if not n[0]:
        return Model({}, set(), [-30.0, 0, 0, 0])
    words, least = word_counts(rows), max(2, min(MIN_TOXIC, n[0] // 20))
    stems = words.where(F.length("word") >= 3).select(F.explode(F.concat(F.array(F.concat(F.lit(" "), "word", F.lit(" "))), F.expr("transform(filter(sequence(4, 12), k -> k <= length(word)), k -> ' ' || substring(word, 1, k))"))).alias("stem"), "toxic", "clean")
    odds = F.log((F.col("toxic") + 0.5) / (n[0] + 1)) - F.log((F.col("clean") + 0.5) / (n[1] + 1))
    kept = stems.groupBy("stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).where(F.col("toxic") >= least).withColumn("odds", odds).where("odds >= 2.5")
    top = kept.orderBy((F.col("odds") * F.sqrt("toxic")).desc(), F.length("stem"), "stem").limit(max_terms).collect()
    chosen: dict[str, float] = {}
    for r in sorted(top, key=lambda r: (len(r["stem"]), r["stem"])):
        # a longer stem adds something only if it's purer than each shorter one that it starts with
        if all(r["odds"] > chosen[r["stem"][:k]] + 0.5 for k in range(2, len(r["stem"])) if r["stem"][:k] in chosen):
            chosen[r["stem"]] = float(r["odds"])
    model = Model(chosen, given, [0.0, 0, 0, 0])
    model = Model(chosen, given | learned_exceptions(rows, model, max_terms), [0.0, 0, 0, 0])
    added = T.StructType().add("x", T.ArrayType(T.DoubleType()))

    def make():
        return lambda b: {"x": [model.features(t) for t in texts_of(b, "text")]}

    got = arrow_map(rows, added, make, "text", ("text",)).toPandas()
    x, y = np.array(got["x"].tolist()), (got["label"].to_numpy() == 1).astype(float)
    order = np.lexsort(np.column_stack([x, y]).T)
    return Model(model.stems, model.phrases, [float(c) for c in logistic(x[order], y[order])])


def learned_exceptions(rows: DataFrame, model: Model, most: int) -> set[str]:
    """Two-word phrases around a stem that several clean training rows have and no toxic one."""
    schema = T.StructType().add("phrase", "string").add("label", "integer")

    def run(batches):
        import pyarrow as pa

        for b in batches:
            out: list[tuple[str, int]] = []
            for t, y in zip(texts_of(b, "text"), texts_of(b, "label")):
                folded = fold(t) + " "
                seen = set()
                for s, _, _ in model.matches(folded[:-1]):
                    end = folded.index(" ", s + 1)
                    nxt, prev = folded.find(" ", end + 1), folded.rfind(" ", 0, s)
                    if nxt > 0:
                        seen.add(folded[s : nxt + 1])
                    if s > 0:
                        seen.add(folded[max(prev, 0) : end + 1])
                out += [(p, y) for p in seen]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.string()), pa.array([y for _, y in out], pa.int32())], ["phrase", "label"])

    found = rows.mapInArrow(run, schema).groupBy("phrase").agg(F.expr("count_if(label = 1)").alias("toxic"), F.expr("count_if(label <> 1)").alias("clean"))
    return {r["phrase"] for r in found.where("toxic = 0 and clean >= 5").orderBy(F.col("clean").desc(), "phrase").limit(most).collect()}


def score_toxicity(df: DataFrame, model: Model, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """df with score (0 to 1) and predicted (1 if score >= 0.3)."""
    added = T.StructType().add("score", "double")

    def make():
        return lambda b: {"score": [model.score(t) for t in texts_of(b, text_col)]}

    drop = ("predicted",) if keep_text else ("predicted", text_col)
    return arrow_map(df, added, make, text_col, drop).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("integer"))


def held_out(doc_id):
    """False for a row without an id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"), held_out=held_out)
    scored = score_toxicity(docs, model, keep_text=False)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
