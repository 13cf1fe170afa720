"""Language identification: the family first, then one-versus-one linear support vector machines within it."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import simhash

#: Languages that are not listed form families of their own.
FAMILIES = {"en": "germanic", "de": "germanic", "nl": "germanic", "fr": "romance", "es": "romance", "it": "romance", "pt": "romance"}
SPACE, KNOWN = 1 << 14, 1 << 16
BLOCK = 1 << 20
SCHEMA = "doc_id long, lang_id string, family string, margin double, known double, accepted boolean"

_rng = np.random.default_rng(20240101)
_T = [_rng.integers(0, KNOWN, 256).astype(np.uint16) for _ in range(3)]
_LETTER = np.array([97 <= b <= 122 or b >= 128 for b in range(256)])
_FOLD = np.where(_LETTER, np.arange(256), 32).astype(np.uint8)


def _trigrams(data: np.ndarray, offsets: np.ndarray):
    """Blocks (first position, hashes, validity) over the bytes: the trigram that begins at each position, valid if its middle is a letter and it ends within its document."""
    for lo in range(0, int(offsets[-1]), BLOCK):
        lo = max(lo, 0)
        hi = min(lo + BLOCK, int(offsets[-1]))
        b = np.full(hi - lo + 2, 32, np.uint8)
        part = data[lo : min(hi + 2, int(offsets[-1]))]
        b[: len(part)] = _FOLD[part]
        valid = _LETTER[b[1:-1]]
        ends = offsets[1:][(offsets[1:] > lo) & (offsets[1:] <= hi + 1)] - lo
        for back in (1, 2):
            at = ends - back
            valid[at[(at >= 0) & (at < hi - lo)]] = False
        yield lo, _T[0][b[:-2]] ^ _T[1][b[1:-1]] ^ _T[2][b[2:]], valid


def _sums(values: np.ndarray, lo: int, offsets: np.ndarray, into: np.ndarray) -> None:
    """Adds the values of a block to the totals of the documents they belong to."""
    c = np.concatenate(([0.0], np.cumsum(values, dtype=np.float64)))
    hi = lo + len(values)
    first, last = np.searchsorted(offsets, lo, "right") - 1, np.searchsorted(offsets, hi, "left")
    cuts = np.clip(offsets[first : last + 1], lo, hi) - lo
    into[first:last] += np.diff(c[cuts])


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Per text the shares of its trigrams by hash (texts x SPACE), and which of the KNOWN hashes occur anywhere."""
    data, offsets = simhash.buffers(texts)
    x, seen = np.zeros((len(texts), SPACE), np.float32), np.zeros(KNOWN, bool)
    for lo, h, ok in _trigrams(data, offsets):
        at = np.flatnonzero(ok)
        doc = np.searchsorted(offsets, at + lo, "right") - 1
        np.add.at(x, (doc, h[at] & (SPACE - 1)), 1)
        seen[h[at]] = True
    return x / np.maximum(x.sum(axis=1, keepdims=True), 1), seen


def svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, epochs: int = 30, seed: int = 1) -> np.ndarray:
    """Weights of a linear support vector machine (hinge loss, y of -1 and 1) by dual coordinate descent."""
    w, alpha, q = np.zeros(x.shape[1], np.float32), np.zeros(len(x)), np.einsum("ij,ij->i", x, x) + 1e-12
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(x)):
            new = min(max(alpha[i] - (y[i] * float(x[i] @ w) - 1) / q[i], 0.0), c)
            if new != alpha[i]:
                w += np.float32((new - alpha[i]) * y[i]) * x[i]
                alpha[i] = new
    return w


@dataclass
class Model:
    """families: sorted names; members: languages of each; pairs: (family, i, j) of each one-versus-one machine; weights: machines x SPACE, the family machines first."""

    families: list[str]
    members: list[list[str]]
    pairs: list[tuple[int, int, int]]
    weights: np.ndarray
    known: np.ndarray

    def predict(self, texts: pa.Array, min_known: float) -> dict[str, list]:
        data, offsets = simhash.buffers(texts)
        n = len(texts)
        score, total, known = np.zeros((len(self.weights), n)), np.zeros(n), np.zeros(n)
        for lo, h, ok in _trigrams(data, offsets):
            _sums(ok, lo, offsets, total)
            _sums(self.known[h] & ok, lo, offsets, known)
            h = h & (SPACE - 1)
            for k, w in enumerate(self.weights):
                _sums(w[h] * ok, lo, offsets, score[k])
        score /= np.maximum(total, 1)
        f = len(self.families)
        family = score[:f].argmax(axis=0) if f else np.zeros(n, int)
        votes = [np.zeros((len(m), n)) for m in self.members]
        edge = [np.zeros((len(m), n)) for m in self.members]
        for (a, i, j), s in zip(self.pairs, score[f:]):
            votes[a][i] += s >= 0
            votes[a][j] += s < 0
            edge[a][i] += s
            edge[a][j] -= s
        # Most votes, then the largest sum of margins, then the first name.
        best = [np.lexsort((np.broadcast_to(np.arange(len(m)), (n, len(m))), -e.T, -v.T), axis=1)[:, 0] for m, v, e in zip(self.members, votes, edge)]
        share = np.where(total > 0, known / np.maximum(total, 1), 0.0)
        order = np.sort(score[:f], axis=0) if f else np.zeros((1, n))
        margin = order[-1] - order[-2] if f > 1 else np.zeros(n)
        fine = (total > 0) & (share >= min_known) & (f > 0)
        return {
            "lang_id": [self.members[a][best[a][k]] if fine[k] else None for k, a in enumerate(family)],
            "family": [self.families[a] if fine[k] else None for k, a in enumerate(family)],
            "margin": margin.tolist(),
            "known": share.tolist(),
            "accepted": fine.tolist(),
        }


def fit(texts: list[str], langs: list[str], families: dict[str, str] = FAMILIES) -> Model:
    """Family machines (one against the rest) and a machine for each pair of languages of a family."""
    x, known = features(pa.array(texts, pa.string())) if texts else (np.zeros((0, SPACE), np.float32), np.zeros(KNOWN, bool))
    x *= 50  # shares are small; this puts the margins on the scale of the loss
    langs_, fam = np.array(langs, dtype=object), np.array([families.get(g, g) for g in langs], dtype=object)
    names = sorted(set(fam))
    members = [sorted(set(langs_[fam == f])) for f in names]
    weights, pairs = [], []
    for f in names:
        weights.append(svm(x, np.where(fam == f, 1, -1)) if len(names) > 1 else np.zeros(SPACE, np.float32))
    for a, m in enumerate(members):
        for i, j in combinations(range(len(m)), 2):
            at = np.isin(langs_, [m[i], m[j]])
            pairs.append((a, i, j))
            weights.append(svm(x[at], np.where(langs_[at] == m[i], 1, -1)))
    return Model(names, members, pairs, np.array(weights, np.float32).reshape(-1, SPACE), known)


def train(docs: DataFrame, per_lang: int = 300, families: dict[str, str] = FAMILIES) -> Model:
    """A model of the lang column, fitted on per_lang labelled rows of each language: those whose id has the least hash.

    per_lang bounds the sample that goes to the driver; a language is thinned by hash on the executors first.
    """
    labelled = docs.where("lang is not null and text is not null and trim(text) <> ''").select("lang", "text", F.xxhash64("doc_id").alias("h"))
    counts = {r.lang: r["count"] for r in labelled.groupBy("lang").count().collect()}
    if not counts:
        return fit([], [], families)
    share = F.create_map(*[F.lit(v) for g, n in counts.items() for v in (g, min(1.0, 2.0 * (per_lang + 20) / n))])[F.col("lang")]
    thin = labelled.where((F.pmod("h", F.lit(1_000_000)) / 1_000_000.0) < share)
    rows = thin.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))).where(F.col("k") <= per_lang).select("lang", "text").collect()
    return fit([r.text for r in rows], [r.lang for r in rows], families)


def identify(docs: DataFrame, model: Model | None = None, min_known: float = 0.5) -> DataFrame:
    """(doc_id, lang_id, family, margin, known, accepted) for every row of docs (doc_id, text, lang).

    Byte trigrams of the whole text are hashed; the family with the highest score is taken, then the language with
    most votes of the machines of that family. known is the share of the trigrams that the sample had; a text below
    min_known, or without any trigram around a letter, belongs to no known language and is not accepted.

    Edge cases: a null, empty or letterless text is not accepted, with null language and family and known 0; null
    langs are left out of the fit but identified; ties between families, in a machine or between the votes (after the sum of
    margins) go to the first name; repeated rows are each returned; an
    empty table, or one without labels, gives no accepted row; other columns are ignored.
    """
    model = model or train(docs)

    def run(batches):
        for batch in batches:
            for part in simhash.chunks(batch, "text", 8 << 20):
                found = model.predict(part.column(1), min_known)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found["lang_id"], pa.string()), pa.array(found["family"], pa.string()), pa.array(found["margin"], pa.float64()), pa.array(found["known"], pa.float64()), pa.array(found["accepted"], pa.bool_())], ["doc_id", "lang_id", "family", "margin", "known", "accepted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def keep_identified(docs: DataFrame, model: Model | None = None, min_known: float = 0.5) -> DataFrame:
    """The rows of docs, all columns as they are, whose text identify() accepts; in one pass, without a join.

    Edge cases as in identify(): what it does not accept is dropped, and a table without labels keeps nothing.
    """
    model = model or train(docs)

    def run(batches):
        for batch in batches:
            for part in simhash.chunks(batch, "text", 8 << 20):
                found = model.predict(part.column(part.schema.get_field_index("text")), min_known)
                yield part.filter(pa.array(found["accepted"], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
