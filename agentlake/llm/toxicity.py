"""Toxicity by a chain of linear classifiers trained on the label table.

Categories are predicted in order; each later model also gets the earlier categories' probabilities, which for
training come from models that haven't seen the row (out-of-fold). A document's inputs are its distinct words and
their prefixes; the strongest by chi-square in the sample are kept. The sample of labelled rows is bounded by
``Settings.sample`` (smallest hashes of doc_id first); scoring reads every document whole, in one pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agentlake.llm.shared import materialise
from agentlake.llm.words import text_blocks, tidy

#: category -> its condition on the label table, in the order of the chain; the last decides.
CATEGORIES = (("low_quality", "quality = 0"), ("toxic", "toxic = 1"))


@dataclass(frozen=True)
class Settings:
    sample: int = 6000
    inputs: int = 2000
    least_documents: int = 4
    folds: int = 3
    prefixes: tuple[int, ...] = (3, 4, 5, 6)
    penalty: float = 1.0
    steps: int = 100
    categories: tuple[tuple[str, str], ...] = CATEGORIES


@dataclass
class Model:
    """For each category: intercept, weights of earlier probabilities, weight of each input; ``bounds`` decide."""

    settings: Settings
    inputs: dict[str, int] = field(default_factory=dict)
    intercepts: list[float] = field(default_factory=list)
    chained: list[np.ndarray] = field(default_factory=list)
    weights: np.ndarray | None = None
    bounds: list[float] = field(default_factory=list)


def split_words(texts: pa.Array) -> pa.Array:
    """Lists of the words of texts: runs of letters, numerals and underscores in lower case; without any, one empty word."""
    spaced = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"[^\p{L}\p{N}_]+", " ")
    return pc.ascii_split_whitespace(pc.ascii_trim_whitespace(spaced))


def named(words: pa.Array, prefixes: tuple[int, ...]) -> Iterator[tuple[str, pa.Array]]:
    """The inputs of words: themselves and their proper prefixes (null for shorter words), each kind with its mark."""
    yield "=", pc.if_else(pc.equal(words, ""), None, words)
    length = pc.utf8_length(words)
    for k in prefixes:
        yield f"{k}", pc.if_else(pc.greater(length, k), pc.utf8_slice_codeunits(words, 0, k), None)


class Held:
    """Which of the known inputs texts hold, and by how many distinct words."""

    def __init__(self, inputs: dict[str, int], prefixes: tuple[int, ...]):
        self.prefixes, self.width = prefixes, len(inputs) + 1
        self.known = {}
        for mark in ("=", *map(str, prefixes)):
            mine = {x[len(mark) + 1 :]: n for x, n in inputs.items() if x.startswith(mark + ":")}
            self.known[mark] = pa.array(list(mine), pa.large_string()), np.fromiter(mine.values(), dtype=np.int64, count=len(mine))

    def counts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, input, distinct words of the text that have the input), sorted."""
        words = split_words(texts)
        coded = words.flatten().dictionary_encode()
        n_words = len(coded.dictionary)
        text = np.repeat(np.arange(len(texts)), np.diff(words.offsets.to_numpy()))
        pair = np.unique(text * np.int64(n_words + 1) + coded.indices.to_numpy())  # each word once a text
        text, word = np.divmod(pair, n_words + 1)
        pairs = []
        for mark, each in named(coded.dictionary, self.prefixes):
            strings, numbers = self.known[mark]
            if len(strings):
                at = pc.fill_null(pc.index_in(each, value_set=strings, skip_nulls=True), -1).to_numpy(zero_copy_only=False)[word]
                pairs.append(text[at >= 0] * np.int64(self.width) + numbers[at[at >= 0]])
        pair, times = np.unique(np.concatenate([np.empty(0, np.int64), *pairs]), return_counts=True)
        return *np.divmod(pair, self.width), times


@tidy
def _counted(batches: Iterator[pa.RecordBatch], settings: Settings) -> Iterator[pa.RecordBatch]:
    """(input, documents with it, of those in each category) for each block of the sample."""
    n = len(settings.categories)
    for batch in batches:
        place = pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), batch.column(0)], ["at", "text"])
        for at, texts in text_blocks(place):
            words = split_words(texts)
            coded = words.flatten().dictionary_encode()
            text = np.repeat(np.arange(len(texts)), np.diff(words.offsets.to_numpy()))
            weights = [None, *(np.asarray(batch.column(k + 1).take(at).to_numpy(zero_copy_only=False), dtype=float) for k in range(n))]
            for mark, each in named(coded.dictionary, settings.prefixes):
                kinds = each.dictionary_encode()
                number = kinds.indices.take(coded.indices)
                there = number.is_valid().to_numpy(zero_copy_only=False)
                pair = np.unique(text[there] * np.int64(len(kinds.dictionary) + 1) + number.drop_null().to_numpy())
                row, number = np.divmod(pair, len(kinds.dictionary) + 1)
                sums = [np.bincount(number, None if w is None else w[row], minlength=len(kinds.dictionary)) for w in weights]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f"{mark}:{x}" for x in kinds.dictionary.to_pylist()], pa.string()), *(pa.array(x.astype(np.int64)) for x in sums)], ["input", "held", *(f"y{k}" for k in range(n))]
                )


@tidy
def _vectors(batches: Iterator[pa.RecordBatch], settings: Settings, inputs: dict[str, int]) -> Iterator[pa.RecordBatch]:
    n, held = len(settings.categories), Held(inputs, settings.prefixes)
    for batch in batches:
        place = pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), batch.column(0)], ["at", "text"])
        for at, texts in text_blocks(place):
            text, column, times = held.counts(texts)
            edges = pa.array(np.searchsorted(text, np.arange(len(texts) + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(edges, pa.array(x.astype(np.int32))) for x in (column, times)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k + 1).take(at) for k in range(n + 1)), *lists], [*(f"y{k}" for k in range(n)), "fold", "index", "value"])


class Rows:
    """Sparse rows with dense extra columns."""

    def __init__(self, index: list, value: list, width: int):
        self.row = np.repeat(np.arange(len(index)), [len(x) for x in index])
        self.column = np.concatenate([np.array(x, dtype=np.int64) for x in index]) if index else np.empty(0, np.int64)
        self.value = np.concatenate([np.log1p(np.array(x, dtype=float)) for x in value]) if value else np.empty(0)
        self.n, self.width = len(index), width

    def pick(self, keep: np.ndarray) -> Rows:
        out = Rows([], [], self.width)
        at = keep[self.row]
        out.row, out.column, out.value, out.n = (np.cumsum(keep) - 1)[self.row[at]], self.column[at], self.value[at], int(keep.sum())
        return out

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=self.value * w[self.column], minlength=self.n)

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, weights=self.value * g[self.row], minlength=self.width)


def fit(x: Rows, extra: np.ndarray, y: np.ndarray, penalty: float, steps: int) -> tuple[float, np.ndarray, np.ndarray]:
    """Logistic regression by accelerated gradient descent: intercept, weights of ``extra``, weights of ``x``."""
    rate = np.clip(y.mean() if len(y) else 0.0, 1e-4, 1 - 1e-4)
    b, e, w = float(np.log(rate / (1 - rate))), np.zeros(extra.shape[1]), np.zeros(x.width)
    if not len(y) or y.min() == y.max():
        return b, e, w
    # curvature bound from the norm of the rows, found by power iteration
    v = np.ones(x.width)
    for _ in range(8):
        v = x.back(x.times(v))
        v /= max(np.linalg.norm(v), 1e-12)
    size = 0.25 * (np.linalg.norm(x.back(x.times(v))) + (extra**2).sum() + x.n) + penalty
    before, momentum = (b, e, w), 1.0
    for _ in range(steps):
        ahead = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        k = (momentum - 1) / ahead
        momentum = ahead
        bb, ee, ww = (p + k * (p - q) for p, q in zip((b, e, w), before, strict=True))
        before = (b, e, w)
        g = 1 / (1 + np.exp(-np.clip(bb + extra @ ee + x.times(ww), -30, 30))) - y
        b, e, w = bb - g.sum() / size, ee - (extra.T @ g + penalty * ee) / size, ww - (x.back(g) + penalty * ww) / size
    return float(b), e, w


def probability(x: Rows, extra: np.ndarray, model: tuple[float, np.ndarray, np.ndarray]) -> np.ndarray:
    b, e, w = model
    return 1 / (1 + np.exp(-np.clip(b + extra @ e + x.times(w), -30, 30)))


def best_bound(p: np.ndarray, y: np.ndarray) -> float:
    """The bound on out-of-fold probabilities of the best F1, halfway to the next probability; above 1 if no row is positive."""
    if not y.any():
        return 1.1
    order = np.argsort(-p, kind="stable")
    hit = np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(y) + 1) + y.sum())
    k = int(np.argmax(f1))
    low = p[order[k + 1]] if k + 1 < len(p) else 0.0
    return float((p[order[k]] + low) / 2)


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """A model from labelled rows of ``docs``. Rows with a null label or id don't count, nor rows beyond the sample; with
    no positive row the model rejects nothing."""
    n = len(settings.categories)
    ys = [F.expr(condition).cast("int").alias(f"y{k}") for k, (_, condition) in enumerate(settings.categories)]
    known = labels.select("doc_id", *ys).dropna().groupBy("doc_id").agg(*(F.max(f"y{k}").alias(f"y{k}") for k in range(n)))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.sample).select(F.col("doc_id").alias("_id"), *(f"y{k}" for k in range(n)))
    chosen = materialise(chosen, "labelled_ids")
    fold = F.pmod(F.xxhash64(F.lit("fold"), "_id"), F.lit(settings.folds)).cast("int").alias("fold")
    texts = docs.select(F.col("doc_id").alias("_doc"), F.col("text").cast("string").alias("text"))
    sample = texts.join(F.broadcast(chosen), F.col("_doc") == F.col("_id"))  # at most ``sample`` rows
    sample = materialise(sample.select("text", *(f"y{k}" for k in range(n)), fold), "labelled")
    count = sample.agg(F.count(F.lit(1)), *(F.sum(f"y{k}") for k in range(n))).first()
    held = sample.select("text", *(f"y{k}" for k in range(n))).mapInArrow(partial(_counted, settings=settings), "input string, held long, " + ", ".join(f"y{k} long" for k in range(n)))
    held = held.groupBy("input").agg(F.sum("held").alias("held"), *(F.sum(f"y{k}").alias(f"y{k}") for k in range(n))).filter(F.col("held") >= settings.least_documents)
    total, wanted = max(count[0], 1), []
    for k in range(n):
        share = (count[k + 1] or 0) / total
        gap = F.col(f"y{k}") - share * F.col("held")
        wanted.append(gap * gap / (F.col("held") * (1 - F.col("held") / (total + 1)) + 1e-9))
    held = held.select("input", *(w.alias(f"chi{k}") for k, w in enumerate(wanted)))
    inputs: dict[str, int] = {}
    held = materialise(held, "inputs")
    for k in range(n):  # at most ``inputs`` rows
        for r in held.orderBy(F.desc(f"chi{k}"), "input").limit(settings.inputs // n).select("input").collect():
            inputs.setdefault(r[0], len(inputs))

    schema = ", ".join(f"y{k} int" for k in range(n)) + ", fold int, index array<int>, value array<int>"
    rows = sample.mapInArrow(partial(_vectors, settings=settings, inputs=inputs), schema).collect()  # at most ``sample`` rows of at most ``inputs`` numbers
    rows.sort()
    x, folds = Rows([r["index"] for r in rows], [r["value"] for r in rows], max(len(inputs), 1)), np.array([r["fold"] for r in rows], dtype=int)
    model, extra = Model(settings, inputs), np.zeros((len(rows), 0))
    weights = np.zeros((n, max(len(inputs), 1)))
    # inputs that nearly all rows hold count little; this also keeps the fit well conditioned
    rarity = np.log((len(rows) + 1) / (np.bincount(x.column, minlength=x.width) + 0.5)).clip(0)
    x.value = x.value * rarity[x.column]
    for k in range(n):
        y = np.array([r[f"y{k}"] for r in rows], dtype=float)
        unseen = np.zeros(len(rows))
        for f in range(settings.folds):
            away = folds == f
            part = fit(x.pick(~away), extra[~away], y[~away], settings.penalty, settings.steps)
            unseen[away] = probability(x.pick(away), extra[away], part)
        b, e, weights[k] = fit(x, extra, y, settings.penalty, settings.steps)
        model.intercepts.append(b)
        model.chained.append(e)
        model.bounds.append(best_bound(unseen, y))
        extra = np.column_stack([extra, unseen])
    model.weights = weights * rarity
    return model


def probabilities(texts: pa.Array, held: Held, model: Model) -> np.ndarray:
    """(texts, categories): the chain on one block of texts."""
    text, column, times = held.counts(texts)
    value, n = np.log1p(times), len(model.settings.categories)
    out = np.zeros((len(texts), n))
    for k in range(n):
        z = model.intercepts[k] + np.bincount(text, weights=value * model.weights[k][column], minlength=len(texts)) + out[:, :k] @ model.chained[k]
        out[:, k] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    return out


@tidy
def _scored(batches: Iterator[pa.RecordBatch], model: Model, column: int, keep: bool) -> Iterator[pa.RecordBatch]:
    n, held = len(model.settings.categories), Held(model.inputs, model.settings.prefixes)
    for batch in batches:
        place = pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), batch.column(column).cast(pa.string())], ["at", "text"])
        out = np.concatenate([np.zeros((0, n)), *(probabilities(texts, held, model) for _, texts in text_blocks(place))])
        if keep:
            yield batch.filter(pa.array(out[:, -1] < model.bounds[-1]))
        else:
            flags = [pa.array(out[:, k] >= model.bounds[k]) for k in range(n)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(out[:, k]) for k in range(n)), *flags], ["doc_id", *(f"p{k}" for k in range(n)), *(f"f{k}" for k in range(n))])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, then for each category its probability (p_<name>) and verdict (<name>), for every row of ``docs``. Null and
    empty texts have no words and get the intercepts; a very long text counts whole. Repeated rows come out alike; other
    columns are ignored; an empty table gives no rows."""
    names = [name for name, _ in model.settings.categories]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = ", ".join(["doc_id long", *(f"p_{n} double" for n in names), *(f"{n} boolean" for n in names)])
    return rows.mapInArrow(partial(_scored, model=model, column=1, keep=False), schema)


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that the chain's last category doesn't hold, with their own columns, in one pass. Rows are
    judged one by one: null ids, repeated rows and columns of any name stay as they are; null and empty texts are judged
    by the intercepts; an empty table stays empty."""
    return docs.mapInArrow(partial(_scored, model=model, column=docs.columns.index("text"), keep=True), docs.schema)
