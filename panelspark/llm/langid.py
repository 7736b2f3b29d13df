"""Language of every word by a linear-chain conditional random field, and of every document by its words.

The words of a text are labelled together: byte n-grams with word borders (so affixes too) and membership in a lexicon of
frequent words score each word, learned transitions score neighbours, and forward-backward gives each word's
marginals. The field is fitted on a bounded sample of labelled rows, spliced into code-switched sequences so that the
transitions meet changes of language. A document's language has the largest mean marginal; that mean is its score.

Forward-backward runs over blocks of words whose transfer matrices chain, so a very long text costs no more
steps than its blocks, and nothing is cut off.

Defined results: null, empty and letterless texts are `und` with score 0; ties go to the first label in alphabetical
order; without any labelled row every text is `und`; only the key and the outputs are returned, so clashing columns of
the input do no harm; repeated rows give repeated rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm.common import bounded, fold_case, held_out, mix, powers, prefix_hash, span_hash, steps, text_bytes, within, words

UND = "und"
#: Rows that the field is fitted on, at most about.
SAMPLE_ROWS = 3000
#: n-gram weights by hash.
BUCKETS = 1 << 18
ORDERS = (1, 2, 3, 4)
LEXICON = 4000
#: Bytes that belong to words: ASCII letters and all bytes of longer characters.
_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
BLOCK = 32


def word_table(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Folded bytes, word starts and ends, first word of each row."""
    raw = fold_case(raw)
    return raw, *words(raw, off, ~_LETTERS)


def features(raw: np.ndarray, start: np.ndarray, end: np.ndarray, lexicon: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of each word, end to end, and how many each has: n-grams of ^word$ and the word itself if in the lexicon."""
    size = end - start + 2
    first = np.cumsum(size) - size
    buf = np.full(int(size.sum()), 2, np.uint64)
    inner = np.ones(len(buf), bool)
    inner[first] = inner[first + size - 1] = False
    buf[first + size - 1] = 3
    buf[inner] = raw[np.repeat(start, end - start) + within(end - start)]
    at, numbers = [], []
    word = np.repeat(np.arange(len(start)), size)
    left = np.repeat(first + size, size) - np.arange(len(buf))
    gram = np.zeros(len(buf), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        gram = gram[: len(buf) - n + 1] * np.uint64(256) + buf[n - 1 :]
        if n in ORDERS:
            ok = left[: len(gram)] >= n
            at.append(word[: len(gram)][ok])
            numbers.append((mix(gram[ok] + np.uint64(n << 40)) & np.uint64(BUCKETS - 1)).astype(np.int64))
    if len(lexicon):
        k = np.minimum(np.searchsorted(lexicon, hashes), len(lexicon) - 1)
        ok = lexicon[k] == hashes
        at.append(np.flatnonzero(ok))
        numbers.append(BUCKETS + k[ok])
    at_all, num = np.concatenate(at), np.concatenate(numbers)
    order = np.argsort(at_all, kind="stable")
    return num[order], np.bincount(at_all, minlength=len(start))


@dataclass
class Field:
    """A fitted field: labels in alphabetical order, feature weights, transition scores, hashes of the lexicon's words."""

    labels: list[str]
    weights: np.ndarray
    transitions: np.ndarray
    lexicon: np.ndarray

    def scores(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        num, count = features(raw, start, end, self.lexicon, hashes)
        return np.add.reduceat(self.weights[num], np.cumsum(count) - count, axis=0)


def _scaled(a: np.ndarray) -> np.ndarray:
    return a / a.max(axis=-1, keepdims=True)


def marginals(scores: np.ndarray, first: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Forward-backward over the words of each row; first: index of each row's first word, one more at the end."""
    n, k = scores.shape
    count = np.diff(first)
    if not n:
        return np.zeros((0, k))
    x = np.exp(scores.astype(np.float64) - scores.max(axis=1, keepdims=True))
    t = np.exp(transitions - transitions.max())
    blocks = -(-count // BLOCK)
    block0 = np.cumsum(blocks) - blocks
    place = within(count)
    b, j = np.repeat(block0, count) + place // BLOCK, place % BLOCK
    total = int(blocks.sum())
    e = np.ones((total, BLOCK, k))
    live = np.zeros((total, BLOCK), bool)
    e[b, j], live[b, j] = x, True
    through = np.broadcast_to(np.eye(k), (total, k, k)).copy()
    for s in range(BLOCK):
        step = (through.reshape(-1, k) @ t).reshape(total, k, k) * e[:, s, None, :]
        through = np.where(live[:, s, None, None], step / step.max(axis=(1, 2), keepdims=True), through)
    into, outof = np.full((total, k), 1.0 / k), np.ones((total, k))
    order = np.argsort(-blocks, kind="stable")
    sizes = blocks[order]
    for m in range(1, int(sizes[0])):
        rows = block0[order[: np.searchsorted(-sizes, -m, "left")]]
        into[rows + m] = _scaled(np.einsum("ij,ijk->ik", into[rows + m - 1], through[rows + m - 1]))
    for m in range(int(sizes[0]) - 1, 0, -1):
        rows = block0[order[: np.searchsorted(-sizes, -m, "left")]]
        outof[rows + m - 1] = _scaled(np.einsum("ijk,ik->ij", through[rows + m], outof[rows + m]))
    forward = np.empty_like(e)
    a = into
    for s in range(BLOCK):
        a = np.where(live[:, s, None], _scaled((a @ t) * e[:, s]), a)
        forward[:, s] = a
    a = outof
    for s in range(BLOCK - 1, -1, -1):
        forward[:, s] *= a
        a = np.where(live[:, s, None], _scaled((a * e[:, s]) @ t.T), a)
    p = forward[b, j]
    return p / p.sum(axis=1, keepdims=True)


def fit(texts: list[str], langs: list[str], rounds: int = 250, sequences: int = 128, length: int = 64, seed: int = 7) -> Field:
    """Fit by Adagrad on the log-likelihood of spliced sequences: runs of words from documents of random languages."""
    labels = sorted(set(langs))
    k = len(labels)
    empty = Field(labels, np.zeros((BUCKETS, k), np.float32), np.zeros((k, k)), np.zeros(0, np.uint64))
    raw, off = text_bytes(pa.array(texts, pa.large_string()))
    raw, start, end, first = word_table(raw, off)
    if not len(start) or k < 2:
        return empty
    hashes = span_hash(prefix_hash(raw), start, end)
    kind, at, back, often = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
    lexicon = np.sort(kind[np.argsort(-often, kind="stable")[:LEXICON]])
    num, count = features(raw, start[at], end[at], lexicon, kind)
    num_at = np.cumsum(count) - count
    w, g2 = np.zeros((BUCKETS + len(lexicon), k)), np.full((BUCKETS + len(lexicon), k), 1e-6)
    tr, t2 = np.zeros((k, k)), np.full((k, k), 1e-6)
    rng = np.random.default_rng(seed)
    label = np.array([labels.index(x) for x in langs])
    rows = [np.flatnonzero((label == c) & (np.diff(first) > 0)) for c in range(k)]
    if any(not len(r) for r in rows):
        rows = [r if len(r) else np.flatnonzero(np.diff(first) > 0) for r in rows]
    for _ in range(rounds):
        seq, gold = np.empty((sequences, length), np.int64), np.empty((sequences, length), np.int64)
        for s in range(sequences):
            i = 0
            while i < length:
                c = int(rng.integers(k))
                d = int(rng.choice(rows[c]))
                n = min(int(rng.geometric(1 / 16)), length - i, int(first[d + 1] - first[d]))
                p = int(rng.integers(first[d], first[d + 1] - n + 1))
                seq[s, i : i + n], gold[s, i : i + n] = back[p : p + n], c
                i += n
        types, local = np.unique(seq, return_inverse=True)
        local = local.reshape(seq.shape)
        c = count[types]
        idx = num[np.repeat(num_at[types], c) + within(c)]
        sc = np.add.reduceat(w[idx], np.cumsum(c) - c, axis=0)[local]
        x = np.exp(sc - sc.max(axis=2, keepdims=True))
        t = np.exp(tr)
        f, bwd = np.empty_like(x), np.ones_like(x)
        f[:, 0] = _scaled((np.full((sequences, k), 1 / k) @ t) * x[:, 0])
        for i in range(1, length):
            f[:, i] = _scaled((f[:, i - 1] @ t) * x[:, i])
        for i in range(length - 2, -1, -1):
            bwd[:, i] = _scaled((bwd[:, i + 1] * x[:, i + 1]) @ t.T)
        p = f * bwd
        p /= p.sum(axis=2, keepdims=True)
        pair = f[:, :-1, :, None] * t * (x * bwd)[:, 1:, None, :]
        pair /= pair.sum(axis=(2, 3), keepdims=True)
        np.put_along_axis(p, gold[..., None], np.take_along_axis(p, gold[..., None], 2) - 1, 2)
        gt = pair.sum(axis=(0, 1))
        np.subtract.at(gt, (gold[:, :-1].ravel(), gold[:, 1:].ravel()), 1)
        per_type = np.stack([np.bincount(local.ravel(), p[..., c_].ravel(), len(types)) for c_ in range(k)], axis=1)
        touched, where = np.unique(idx, return_inverse=True)
        spread = np.repeat(per_type, c, axis=0)
        gw = np.stack([np.bincount(where, spread[:, c_], len(touched)) for c_ in range(k)], axis=1)
        gw += 1e-3 * w[touched]
        g2[touched] += gw**2
        w[touched] -= 0.2 * gw / np.sqrt(g2[touched])
        t2 += gt**2
        tr -= 0.2 * gt / np.sqrt(t2)
    return Field(labels, w.astype(np.float32), tr, lexicon)


def train(labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = SAMPLE_ROWS) -> Field:
    """A field from about `rows` rows of `labelled` at most, chosen by a hash of the key."""
    usable = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(key, text, lang)
    sample = sorted(tuple(r) for r in bounded(usable, key, rows).collect())
    return fit([r[1] for r in sample], [r[2] for r in sample])


def label_words(field: Field, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of each row, each row's first word, and the marginals of every word."""
    raw, start, end, first = word_table(raw, off)
    if not len(start) or not field.labels:
        return start, end, first, np.zeros((len(start), len(field.labels)))
    hashes = span_hash(prefix_hash(raw), start, end)
    kind, at, back = np.unique(hashes, return_index=True, return_inverse=True)
    return start, end, first, marginals(field.scores(raw, start[at], end[at], kind)[back], first, field.transitions)


def identify(df: DataFrame, field: Field, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, lang_pred, score, and langs: the share of the words that are likeliest in each language. Narrow: one pass over whole texts."""
    spark = df.sparkSession
    model = spark.sparkContext.broadcast(field)  # BUCKETS + LEXICON rows of weights, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = model.value
        powers(1)
        for batch in steps(batches):
            raw, off = text_bytes(batch.column(1))
            _, _, first, p = label_words(f, raw, off)
            n = np.diff(first)
            langs, scores, shares = [UND] * len(n), np.zeros(len(n)), [[] for _ in n]
            rows = np.flatnonzero(n) if f.labels else np.zeros(0, np.int64)
            if len(rows):
                mean = np.add.reduceat(p, first[rows], axis=0) / n[rows, None]
                best = np.eye(len(f.labels))[p.argmax(axis=1)]
                share = np.add.reduceat(best, first[rows], axis=0) / n[rows, None]
                ascii_letter = np.zeros(len(raw) + 1, np.int64)
                np.cumsum(_LETTERS[raw] & (raw < 128), out=ascii_letter[1:])
                plain = ascii_letter[off[1:]] > ascii_letter[off[:-1]]
                for i, m, s in zip(rows, mean, share, strict=True):
                    if plain[i] or any(map(str.isalpha, batch.column(1)[int(i)].as_py())):
                        langs[i], scores[i] = f.labels[int(m.argmax())], min(1.0, float(m.max()))
                        shares[i] = [(f.labels[c], float(v)) for c, v in enumerate(s) if v > 0]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs), pa.array(scores), pa.array(shares, pa.map_(pa.string(), pa.float64()))], [key, "lang_pred", "score", "langs"])

    return df.select(df[key].alias(key), df[text].alias("text")).mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, lang_pred string, score double, langs map<string,double>")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; the third that is held out teaches nothing."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    field = train(docs.where(~held_out(F.col("doc_id"))))
    return identify(docs, field).withColumn("held_out", held_out(F.col("doc_id"))).select("doc_id", "held_out", "lang_pred", "score", "langs")


QUERIES = {"op1_language_id": op1_language_id}
