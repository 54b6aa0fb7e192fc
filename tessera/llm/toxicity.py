"""Toxicity by a classifier chain: linear models in a fixed order, each fed the earlier categories' probabilities.

The chain is fitted on at most ``MAX_LABELLED`` labelled documents (those of least hash of their id, so the choice doesn't
depend on the layout), each counted once however many near copies the sample holds. Features are
the words and word beginnings whose presence goes with a category beyond chance and six shape figures. A later model is trained with
out-of-fold probabilities of the earlier ones: those of models that did not see the document, whose words, means and scales
were also chosen without it. Every document is then scored over its whole text, in one pass without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.store import lean, small_batches, trim
from tessera.llm.textnp import SECOND_TABLE, U, batch_bytes, lowered, mix, shingles, slices, span_hashes, words

#: Bounds of the fit: labelled documents it learns from, and words of the model (the most telling ones).
MAX_LABELLED, MOST_WORDS = 6_000, 600
LEAST_DOCS, LEAST_CHI2, FOLDS, RIDGE, STEM = 6, 30.0, 5, 1.0, 5
MINIMA = 2
_SALTS = mix(np.arange(1, MINIMA + 1, dtype=U))
_EDGE = np.zeros(256, bool)
_EDGE[[i for i in range(33, 127) if not chr(i).isalnum()]] = True


def bare_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of words without ASCII punctuation at either end (words of nothing else keep it), hashes of their first
    STEM bytes, and words by row."""
    starts, ends, many = words(data, offsets)
    solid = np.flatnonzero(~_EDGE[data])
    i, j = np.searchsorted(solid, starts), np.searchsorted(solid, ends)
    full = i < j
    a, b = starts.copy(), ends.copy()
    a[full], b[full] = solid[i[full]], solid[j[full] - 1] + 1
    return span_hashes(data, a, b), span_hashes(data, a, np.minimum(b, a + STEM), SECOND_TABLE), many


def shape(raw: np.ndarray, offsets: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Of each row: log words, mean length of a word, and the share of capitals, digits, punctuation and line ends."""
    size = np.maximum(np.diff(offsets), 1)
    share = lambda mask: np.diff(np.concatenate(([0], np.cumsum(mask)))[offsets]) / size
    return np.stack([np.log1p(many), np.log1p(size / np.maximum(many, 1)), share((raw >= 65) & (raw <= 90)), share((raw >= 48) & (raw <= 57)), share(_EDGE[raw]), share(raw == 10)], axis=1)


def _featured(column: pa.Array):
    data, offsets = batch_bytes(column)
    for i, j in slices(offsets):
        raw, off = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        h, stem, many = bare_words(lowered(raw), off)
        yield i, j, h, stem, many, shape(raw, off, many)


def _collectable(batches):
    """(labels, text) -> labels, distinct words with counts, minima over word triples (near copies share one), shape."""
    for batch in batches:
        for i, j, h, stem, many, dense in _featured(batch.column(1)):
            at = np.concatenate(([0], np.cumsum(many)))
            tri, n3 = shingles(h, many, 3)
            at3 = np.concatenate(([0], np.cumsum(n3)))
            rows = []
            for r in range(j - i):
                w, c = np.unique(np.concatenate((h[at[r] : at[r + 1]], stem[at[r] : at[r + 1]])), return_counts=True)
                t = tri[at3[r] : at3[r + 1]]
                low = [int(mix(t ^ salt).min()) for salt in _SALTS] if len(t) else [0] * MINIMA
                rows.append((w.tobytes(), c.astype(np.int32).tobytes(), np.array(low, U).tobytes(), dense[r].tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *(pa.array([x[k] for x in rows], pa.binary()) for k in range(4))], names=["y", "w", "c", "low", "dense"])


def fit_linear(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    """Weights (the last is the intercept, not shrunk) of a logistic model, by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    pull = np.full(len(w), ridge)
    pull[-1] = 1e-6
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(pull), x.T @ (p - y) + pull * w)
        w -= step
        if np.abs(step).max() < 1e-7:
            break
    return w


def best_cutoff(p: np.ndarray, y: np.ndarray) -> float:
    grid = np.arange(50, 14, -1) / 100
    f1 = [2 * y[p >= t].sum() / max(1, (p >= t).sum() + y.sum()) for t in grid]
    return float(grid[int(np.argmax(f1))])


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Chain:
    """keys: the words' hashes, sorted; mean and scale of the shape figures; weights of each category's model, and the
    probability from which it says yes: that of the best F1 score out of fold, between 0.15 and 0.5."""

    categories: list[str]
    keys: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]
    cutoffs: list[float]

    def base(self, words_of: list[tuple[np.ndarray, np.ndarray]], dense: np.ndarray) -> np.ndarray:
        x = np.zeros((len(dense), len(self.keys)))
        for r, (w, c) in enumerate(words_of):
            at = np.minimum(np.searchsorted(self.keys, w), max(len(self.keys) - 1, 0))
            if len(self.keys):
                ok = self.keys[at] == w
                x[r, at[ok]] = np.log1p(c[ok])
        return np.hstack([x, (dense - self.mean) / self.scale])

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), len(self.categories)))
        for k, w in enumerate(self.weights):
            out[:, k] = _sigmoid(np.hstack([x, _logit(out[:, :k])]) @ w[:-1] + w[-1])
        return out

    def score(self, column: pa.Array):
        """(first row, last row + 1, probabilities), the words' weights summed without laying out a table."""
        n = len(self.keys)
        flag = np.zeros(1 << 16, bool)
        flag[(self.keys & U(0xFFFF)).astype(np.int64)] = True
        for i, j, h, stem, many, dense in _featured(column):
            row = np.tile(np.repeat(np.arange(j - i), many), 2)
            h = np.concatenate((h, stem))
            maybe = np.flatnonzero(flag[(h & U(0xFFFF)).astype(np.int64)])
            at = np.searchsorted(self.keys, h[maybe])
            ok = (at < n) & (self.keys[np.minimum(at, n - 1)] == h[maybe]) if n else np.zeros(0, bool)
            pair, times = np.unique(row[maybe[ok]] * max(n, 1) + at[ok], return_counts=True)
            row, word, value = pair // max(n, 1), pair % max(n, 1), np.log1p(times)
            out = np.zeros((j - i, len(self.categories)))
            z = (dense - self.mean) / self.scale
            for k, w in enumerate(self.weights):
                total = np.bincount(row, weights=value * w[word], minlength=j - i) if len(row) else np.zeros(j - i)
                out[:, k] = _sigmoid(total + np.hstack([z, _logit(out[:, :k])]) @ w[n:-1] + w[-1])
            yield i, j, out


def _chosen(words_of, y: np.ndarray, most_words: int) -> np.ndarray:
    """Words and beginnings of which a category holds beyond chance: chi-squared over documents of at least LEAST_CHI2."""
    if not len(words_of):
        return np.zeros(0, U)
    flat = np.concatenate([w for w, _ in words_of])
    doc = np.repeat(np.arange(len(words_of), dtype=np.int32), [len(w) for w, _ in words_of])
    by = np.argsort(flat, kind="stable")
    flat, doc = flat[by], doc[by]
    first = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1])))
    keys, df = flat[first], np.diff(np.append(first, len(flat)))
    common = df >= LEAST_DOCS
    best = np.zeros(len(keys))
    total = len(words_of)
    for k in range(y.shape[1]):
        pos = y[:, k].sum()
        a = np.add.reduceat(y[:, k].astype(np.float32)[doc], first)
        b, c = df - a, pos - a
        d = total - pos - b
        low = np.maximum(df * (a + c) * (b + d) * (c + d), 1)
        best = np.maximum(best, total * (a * d - b * c) ** 2 / low)
    keep = np.flatnonzero(common & (best >= LEAST_CHI2))
    keep = keep[np.argsort(-best[keep], kind="stable")][:most_words]
    return np.sort(keys[keep])


def fit_chain(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], max_labelled: int = MAX_LABELLED, most_words: int = MOST_WORDS, id_col: str = "doc_id", text_col: str = "text") -> Chain:
    """Fit on labelled documents, ``max_labelled`` at most, with ``most_words`` words as features at most.

    A label of an unknown document, a null label or a null id teaches nothing; with no label at all every probability is a
    half and nothing is called toxic. An id that is labelled more than once has the largest of its labels; of rows that
    share an id the one whose text has the least hash is the document.
    """
    small_batches(docs.sparkSession)
    ys = labels.select(F.col(id_col).alias("__id"), F.array(*(c.cast("double") for c in categories.values())).alias("y")).where(F.col("__id").isNotNull() & ~F.exists("y", lambda v: v.isNull()))
    ys = ys.groupBy("__id").agg(F.max("y").alias("y"))
    n = ys.count()
    if n > max_labelled:  # about so many, by a hash of the id, then the bound itself
        ys = ys.where(F.pmod(F.xxhash64("__id"), F.lit(1_000_000)) < int(1_000_000 * max_labelled / n)).orderBy(F.xxhash64("__id"), "__id").limit(max_labelled)
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("text"))
    sample = texts.join(F.broadcast(ys), "__id")  # max_labelled rows at most
    sample = sample.groupBy("__id").agg(F.first("y").alias("y"), F.min_by("text", F.xxhash64("text")).alias("text")).select("y", "text")
    rows = sample.mapInArrow(lean(_collectable), "y array<double>, w binary, c binary, low binary, dense binary").collect()
    rows.sort(key=lambda r: (r.low, r.w, r.y))
    seen: list[set[bytes]] = [set() for _ in range(MINIMA)]
    own = []
    for r in rows:
        low = [r.low[8 * k : 8 * k + 8] for k in range(MINIMA)]
        if not any(x in s for x, s in zip(low, seen, strict=True)):
            own.append(r)
        for x, s in zip(low, seen, strict=True):
            s.add(x)
    names = list(categories)
    if len(own) < 2:
        return Chain(names, np.zeros(0, U), np.zeros(6), np.ones(6), [np.zeros(7 + k) for k in range(len(names))], [1.01] * len(names))
    del rows
    words_of = [(np.frombuffer(r.w, U), np.frombuffer(r.c, np.int32)) for r in own]
    dense, y = np.stack([np.frombuffer(r.dense) for r in own]), np.array([r.y for r in own])
    fold = np.arange(len(y)) % FOLDS
    parts = [(fold != f, fold == f) for f in range(FOLDS) if (fold == f).any() and (fold != f).any()]
    whole = _described(words_of, dense, y, np.ones(len(y), bool), most_words)
    apart = [_described(words_of, dense, y, learn, most_words) for learn, _ in parts]
    chain = Chain(names, *whole, [], [])
    features = lambda own: Chain([], *own, [], []).base(words_of, dense)  # noqa: E731 - laid out anew for each fit, or all folds' stand in memory at once
    unseen = np.zeros((len(y), 0))
    for k in range(len(names)):
        out = np.zeros(len(y))
        for (learn, held), described in zip(parts, apart, strict=True):
            full = np.hstack([features(described), _logit(unseen)])
            w = fit_linear(full[learn], y[learn, k])
            out[held] = _sigmoid(full[held] @ w[:-1] + w[-1])
        chain.weights.append(fit_linear(np.hstack([features(whole), _logit(unseen)]), y[:, k]))
        chain.cutoffs.append(best_cutoff(out, y[:, k]))
        unseen = np.hstack([unseen, out[:, None]])
    return chain


def _described(words_of, dense: np.ndarray, y: np.ndarray, learn: np.ndarray, most_words: int):
    """Words, means and scales chosen on the rows to learn from."""
    keys = _chosen([w for w, ok in zip(words_of, learn, strict=True) if ok], y[learn], most_words)
    mean, scale = dense[learn].mean(axis=0), np.maximum(dense[learn].std(axis=0), 1e-6)
    return keys, mean, scale


def score_chain(docs: DataFrame, chain: Chain, target: str, flag_col: str = "toxic", threshold: float | None = None, text_col: str = "text") -> DataFrame:
    """The documents with p_<category> for each category and ``flag_col``: the target's probability is ``threshold`` (by
    default the chain's own cutoff) or more.

    Null and empty texts are scored as texts without words. All columns stay; columns of the new names give way.
    """
    small_batches(docs.sparkSession)
    fields = [f"p_{c}" for c in chain.categories]
    docs = docs.drop(*fields, flag_col)
    at, k = docs.columns.index(text_col), chain.categories.index(target)
    least = chain.cutoffs[k] if threshold is None else threshold
    model = docs.sparkSession.sparkContext.broadcast(chain)  # MOST_WORDS words at most

    def run(batches):
        for batch in batches:
            parts = [p for _, _, p in model.value.score(batch.column(at))]
            p = np.concatenate(parts) if parts else np.zeros((0, len(fields)))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(p[:, i]) for i in range(len(fields))), pa.array(p[:, k] >= least)], names=schema.names)

    schema = T.StructType([*docs.schema.fields, *(T.StructField(f, T.DoubleType()) for f in fields), T.StructField(flag_col, T.BooleanType())])
    return docs.mapInArrow(lean(run), schema)


def default_categories() -> dict[str, Column]:
    """The chain over the labels table: poor quality first, then toxic."""
    return {"low_quality": F.col("quality") == 0, "toxic": F.col("toxic") == 1}


def drop_toxic(docs: DataFrame, labels: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that a chain fitted on their labelled ones doesn't call toxic, with their own columns."""
    chain = fit_chain(docs, labels, default_categories(), text_col=text_col)
    trim()  # the driver, of what the fit took
    return score_chain(docs, chain, "toxic", "__toxic", text_col=text_col).where("not __toxic").select(docs.columns)
