"""Toxicity: a weighted lexicon matched by Aho-Corasick over folded text.

Folding maps accented letters, homoglyphs and digit substitutions to plain small letters and everything else to
spaces. The lexicon's terms (whole words, and stems that open a word) get their weights from labelled rows: the log odds of
a toxic document among those that hold the term. Exception phrases, listed or found in clean rows, cancel the terms
inside them. A text's matched weight, set against its length, goes through a logistic link fitted on the same rows.

Defined results: null and empty texts match nothing and get the score that the link gives to no match; without labelled
rows of both kinds the lexicon is empty and all scores are 0; only the key and the outputs are returned, so
clashing columns of the input do no harm; repeated rows give repeated rows.
"""

from __future__ import annotations

import math
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm.common import bounded, give_back, held_out, lean, steps

#: Labelled rows that the lexicon is learnt from, at most about.
SAMPLE_ROWS = 9000
#: A text with this score or more is toxic.
THRESHOLD = 0.7
#: Letters that look like others, and signs that stand for letters.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "е": "e", "н": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ɡ": "g", "ӏ": "l", "ԛ": "q", "ѡ": "w",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "γ": "y", "ω": "w",
    "ı": "i", "ł": "l", "ø": "o", "đ": "d", "ß": "s", "æ": "a", "œ": "o", "ſ": "s",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "|": "l",
}
#: Characters without width, dropped before matching.
UNSEEN = "­​‌‍⁠﻿"


class Folding(dict):
    """Translation of single characters, made when first met: by decomposition to a base letter, then through HOMOGLYPHS; combining marks and what
    has no width go, and what is no letter becomes a space."""

    def __missing__(self, c: int) -> str | None:
        char = chr(c)
        base = unicodedata.normalize("NFKD", char)[:1].lower()
        base = HOMOGLYPHS.get(base, HOMOGLYPHS.get(char.lower(), base))
        out = None if char in UNSEEN or unicodedata.combining(char) else base if base.isalpha() else " "
        self[c] = out
        return out


_TABLE = Folding()


def fold(text: str) -> str:
    return text.translate(_TABLE)


@dataclass
class Lexicon:
    """Terms with weights (" word " for a whole word, " stem" for what opens one), exception phrases, and the link's coefficients."""

    terms: dict[str, float]
    exceptions: list[str] = field(default_factory=list)
    link: tuple[float, ...] = (-50.0, 0.0, 0.0, 0.0)

    def automaton(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for t, w in self.terms.items():
            a.add_word(t, (len(t), w, t))
        for t in self.exceptions:
            a.add_word(f" {t} ", (len(t) + 2, 0.0, ""))
        a.make_automaton()
        return a

    def matches(self, automaton, folded: str) -> list[tuple[int, int, float, str]]:
        """(start, end, weight, term) in a folded text that starts and ends with a space; those inside an exception are left out."""
        found = [(end - n + 1, end + 1, w, t) for end, (n, w, t) in automaton.iter(folded)]
        spans = sorted((s, e) for s, e, _, t in found if not t)
        if spans:
            # how far the exceptions reach that start here or before
            starts, reach = [s for s, _ in spans], list(accumulate((e for _, e in spans), max))
            found = [m for m in found if m[3] and not ((i := bisect_right(starts, m[0])) and m[1] <= reach[i - 1])]
        return found

    def score(self, weight: float, length: int) -> float:
        """Logistic link of the matched weight, its share of the words, and its square root."""
        if not self.terms:
            return 0.0
        z = sum(a * b for a, b in zip(self.link, link_features(weight, length), strict=True))
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))


def link_features(weight: float, length: int) -> tuple[float, ...]:
    return 1.0, math.log1p(weight), math.sqrt(weight), 10 * weight / (length + 10)


def fit_link(rows: list[tuple[float, int]], toxic: np.ndarray, ridge: float = 1e-2) -> tuple[float, ...]:
    """Coefficients by Newton's method."""
    x = np.array([link_features(*r) for r in rows])
    b = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(b))
        step = np.linalg.solve(h, x.T @ (toxic - p) - ridge * b)
        b += step / max(1.0, np.abs(step).max())
        if np.abs(step).max() < 1e-8:
            break
    return tuple(map(float, b))


def learn(texts: list[str], toxic: list[int], least: int = 3, share: float = 0.02, odds: float = 3.0, stems: tuple[int, int] = (4, 8), exceptions: tuple[str, ...] = ()) -> Lexicon:
    """A lexicon from labelled texts. A term must stand in `least` toxic documents and in `share` of them, with log odds ratio `odds` at least."""
    y = np.array(toxic, float)
    n_bad, n_good = float(y.sum()), float(len(y) - y.sum())
    if not n_bad or not n_good:
        return Lexicon({})
    folded = [f" {' '.join(fold(t or '').split())} " for t in texts]
    bad, good = Counter(), Counter()

    def candidates(text: str) -> set[str]:
        out = set()
        for w in set(text.split()):
            out.add(f" {w} ")
            out |= {f" {w[:n]}" for n in range(stems[0], min(stems[1], len(w)) + 1)}
        return out

    least = max(least, math.ceil(share * n_bad))
    # hashes are counted first, so that only the strings that may count are held
    hashes = np.concatenate([np.fromiter(map(hash, candidates(t)), np.int64) for t, label in zip(folded, toxic, strict=True) if label])
    kind, times = np.unique(hashes, return_counts=True)
    often = set(kind[times >= least].tolist())
    for t, label in zip(folded, toxic, strict=True):
        if label:
            bad.update(c for c in candidates(t) if hash(c) in often)
    seen = {t for t, n in bad.items() if n >= least}
    for t, label in zip(folded, toxic, strict=True):
        if not label:
            good.update(candidates(t) & seen)
    ratio = {t: math.log((bad[t] + 0.5) / (n_bad + 1)) - math.log((good[t] + 0.5) / (n_good + 1)) for t in seen}
    kept: dict[str, float] = {}
    # terms that tell most come first, longer ones if they tell as much; what a kept term covers or extends adds nothing
    for t in sorted((t for t in seen if ratio[t] >= odds), key=lambda t: (-bad[t] * ratio[t] * (1 + 0.01 * len(t)), t)):
        if not any(t.startswith(k) or k.startswith(t.rstrip()) for k in kept):
            kept[t] = ratio[t]
    if not kept:
        return Lexicon({})
    out = Lexicon(kept, list(exceptions))
    automaton = out.automaton()
    phrases: dict[str, list[int]] = {}
    for t, label in zip(folded, toxic, strict=True):
        around = set()
        for s, e, _, _ in out.matches(automaton, t):
            left = t.rfind(" ", 0, s) if s else 0
            stop = t.find(" ", e if t[e - 1] != " " else e - 1)
            after = t.find(" ", stop + 1)
            around |= {t[left + 1 : stop].strip(), t[s:after].strip() if after > 0 else ""}
        for p in around - {""}:
            if " " in p:
                phrases.setdefault(p, [0, 0])[bool(label)] += 1
    out.exceptions += sorted(p for p, (clean, dirty) in phrases.items() if clean >= 3 and not dirty)
    automaton = out.automaton()
    out.link = fit_link([(sum(m[2] for m in out.matches(automaton, t)), t.count(" ")) for t in folded], y)
    return out


def train(labelled: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = SAMPLE_ROWS) -> Lexicon:
    """A lexicon from about `rows` labelled rows at most, chosen by a hash of the key."""
    usable = labelled.where(F.col(label).isNotNull()).select(key, text, label)
    sample = sorted(((r[0], r[1] or "", int(r[2])) for r in bounded(usable, key, rows).collect()))
    lexicon = learn([r[1] for r in sample], [r[2] for r in sample])
    del sample
    give_back()  # the driver goes on for long after this
    return lexicon


def score(df: DataFrame, lexicon: Lexicon, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, keep: tuple[str, ...] = ()) -> DataFrame:
    """key, score, predicted, weight, terms (those matched, each once) and the columns in `keep`. Narrow: one pass over whole texts."""
    model = df.sparkSession.sparkContext.broadcast(lexicon)  # a few thousand terms at most: they come from the bounded sample
    names = ["score", "predicted", "weight", "terms"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = model.value
        automaton = lex.automaton() if lex.terms else None
        for batch in steps(batches, "text_to_score"):
            scores, weights, terms = [], [], []
            for t in batch.column(0).to_pylist():
                folded = f" {fold(t or '')} "
                found = lex.matches(automaton, folded) if automaton else []
                w = sum(m[2] for m in found)
                weights.append(w)
                terms.append(sorted({m[3].strip() for m in found}))
                scores.append(lex.score(w, len(folded.split())))
            cols = [pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32()), pa.array(weights, pa.float64()), pa.array(terms, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *cols], [key, *keep, *names])

    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in (key, *keep))
    return df.select(df[text].alias("text_to_score"), key, *keep).mapInArrow(run, f"{fields}, score double, predicted int, weight double, terms array<string>")


def clean(docs: DataFrame, lexicon: Lexicon, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score below the threshold, with all their columns. Narrow: one pass over whole texts."""
    model = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = model.value
        automaton = lex.automaton() if lex.terms else None
        for batch in steps(batches, text):
            keep = []
            for t in batch.column(batch.schema.get_field_index(text)).to_pylist():
                folded = f" {fold(t or '')} "
                w = sum(m[2] for m in lex.matches(automaton, folded)) if automaton else 0.0
                keep.append(lex.score(w, len(folded.split())) < threshold)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)


def labelled_documents(docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that may teach: labelled, and not held out."""
    labels = docs.sparkSession.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").where(~held_out(F.col("doc_id")))
    docs = docs.select("doc_id", "text")
    few = bounded(labels.where(F.col("toxic").isNotNull()), "doc_id", SAMPLE_ROWS)  # so that few texts are shuffled
    return docs.join(few, "doc_id")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; the third that is held out teaches nothing."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    lexicon = train(labelled_documents(docs, sf_dir))
    return score(docs, lexicon).withColumn("held_out", held_out(F.col("doc_id"))).select("doc_id", "held_out", "score", "predicted", "weight", "terms")


QUERIES = {"op3_toxicity": op3_toxicity}
