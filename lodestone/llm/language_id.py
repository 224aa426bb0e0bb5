"""Language identification by a convolutional network over bytes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from lodestone.llm.batches import map_batches, raw_texts, text_slices

WIDTHS = (2, 3, 4)
FILTERS, EMBEDDING = 16, 8
#: Bytes of a window. Neighbouring windows share as many bytes as the widest filter needs.
WINDOW = 256
STEP = WINDOW - max(WIDTHS) + 1
#: The classifier is fitted on at most so many documents (the bound of its sample), dealt evenly to the languages.
TRAIN_DOCS = 4_000
#: Windows that are learned from each of them, and steps of the fit.
TRAIN_WINDOWS = 3
STEPS, BATCH, RATE = 900, 64, 4e-3
#: Windows whose convolution is computed at once.
INFER_WINDOWS = 256
UNKNOWN = "und"


@dataclass
class ByteNet:
    """Byte embeddings, filters of several widths, the largest response of each filter in a window, and a softmax."""

    languages: list[str]
    embedding: np.ndarray  # 256 x EMBEDDING
    filters: list[np.ndarray]  # width * EMBEDDING x FILTERS, for each width
    offsets: list[np.ndarray]
    weights: np.ndarray  # filters of all widths x languages
    bias: np.ndarray

    @classmethod
    def fresh(cls, languages: list[str], seed: int = 7) -> ByteNet:
        rng = np.random.default_rng(seed)
        normal = lambda scale, *shape: rng.normal(0, scale, shape).astype(np.float32)
        return cls(
            languages,
            normal(0.5, 256, EMBEDDING),
            [normal((w * EMBEDDING) ** -0.5, w * EMBEDDING, FILTERS) for w in WIDTHS],
            [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
            normal(0.1, FILTERS * len(WIDTHS), len(languages)),
            np.zeros(len(languages), np.float32),
        )

    def parameters(self) -> list[np.ndarray]:
        return [self.embedding, *self.filters, *self.offsets, self.weights, self.bias]

    def _views(self, windows: np.ndarray) -> list[np.ndarray]:
        embedded = self.embedding[windows]  # n x WINDOW x EMBEDDING
        n, length, _ = embedded.shape
        flat = np.ascontiguousarray(embedded).reshape(n, length * EMBEDDING)
        step = flat.strides[1] * EMBEDDING
        return [
            np.lib.stride_tricks.as_strided(flat, (n, length - w + 1, w * EMBEDDING), (flat.strides[0], step, flat.strides[1]))
            for w in WIDTHS
        ]

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        """For each window (a row of bytes) a probability for each language."""
        out = np.empty((len(windows), len(self.languages)), np.float32)
        for a in range(0, len(windows), INFER_WINDOWS):
            part = folded(windows[a : a + INFER_WINDOWS])
            pooled = [
                np.maximum((np.ascontiguousarray(v).reshape(-1, v.shape[2]) @ f).reshape(len(part), -1, FILTERS).max(axis=1) + b, 0)
                for v, f, b in zip(self._views(part), self.filters, self.offsets, strict=True)
            ]
            out[a : a + INFER_WINDOWS] = _softmax(np.concatenate(pooled, axis=1) @ self.weights + self.bias)
        return out

    def gradients(self, windows: np.ndarray, answers: np.ndarray, importance: np.ndarray) -> list[np.ndarray]:
        """Gradients of the weighted cross entropy for ``parameters()``."""
        n = len(windows)
        views = self._views(windows)
        responses, places = [], []
        for v, f, b in zip(views, self.filters, self.offsets, strict=True):
            r = np.ascontiguousarray(v).reshape(-1, v.shape[2]) @ f
            r = r.reshape(n, -1, FILTERS)
            at = r.argmax(axis=1)  # n x FILTERS
            places.append(at)
            responses.append(np.take_along_axis(r, at[:, None, :], axis=1)[:, 0] + b)
        pooled = np.concatenate(responses, axis=1)
        active = np.maximum(pooled, 0)
        error = _softmax(active @ self.weights + self.bias)
        error[np.arange(n), answers] -= 1
        error *= importance[:, None] / n
        back = (error @ self.weights.T) * (pooled > 0)
        d_embedding = np.zeros_like(self.embedding)
        d_filters, d_offsets = [], []
        row = np.arange(n)[:, None]
        for i, (w, v, f, at) in enumerate(zip(WIDTHS, views, self.filters, places, strict=True)):
            g = back[:, i * FILTERS : (i + 1) * FILTERS]  # n x FILTERS
            chosen = v[row, at]  # n x FILTERS x w * EMBEDDING
            d_filters.append(np.einsum("nf,nfd->df", g, chosen, optimize=True))
            d_offsets.append(g.sum(axis=0))
            d_input = (g[:, :, None] * f.T[None]).reshape(n, FILTERS, w, EMBEDDING)
            for k in range(w):
                np.add.at(d_embedding, windows[row, at + k], d_input[:, :, k])
        return [d_embedding, *d_filters, *d_offsets, active.T @ error, error.sum(axis=0)]


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def cut_windows(documents: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Windows that cover the whole of each text, the last one filled up with zero bytes, and each text's number of windows;
    an empty text has none."""
    counts = [-(-max(1, len(d) - WINDOW + STEP) // STEP) if d else 0 for d in documents]
    out = np.zeros((sum(counts), WINDOW), np.uint8)
    at = 0
    for d, n in zip(documents, counts, strict=True):
        if n:
            padded = np.zeros((n - 1) * STEP + WINDOW, np.uint8)
            padded[: len(d)] = np.frombuffer(d, np.uint8)
            out[at : at + n] = np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::STEP]
            at += n
    return out, np.array(counts, np.int64)


def folded(windows: np.ndarray) -> np.ndarray:
    """Windows with letters of ASCII and Latin-1 in lower case."""
    ascii_upper = (windows >= 0x41) & (windows <= 0x5A)
    latin_upper = np.zeros_like(ascii_upper)
    latin_upper[:, 1:] = (windows[:, :-1] == 0xC3) & (windows[:, 1:] >= 0x80) & (windows[:, 1:] <= 0x9E) & (windows[:, 1:] != 0x97)
    return windows + np.uint8(0x20) * (ascii_upper | latin_upper)


def fit(windows: np.ndarray, answers: list[str], steps: int = STEPS, seed: int = 7) -> ByteNet:
    """A network fitted to labelled windows by Adam; every language weighs the same."""
    languages = sorted(set(answers))
    net = ByteNet.fresh(languages, seed)
    if len(languages) < 2:
        return net
    y = np.array([languages.index(a) for a in answers])
    weight = (len(y) / (len(languages) * np.bincount(y)))[y].astype(np.float32)
    rng = np.random.default_rng(seed)
    parameters = net.parameters()
    first, second = [np.zeros_like(p) for p in parameters], [np.zeros_like(p) for p in parameters]
    windows = folded(windows)
    for step in range(1, steps + 1):
        own = rng.integers(0, len(y), BATCH)
        rate = RATE * (1 - step / (steps + 1))
        for p, g, m, v in zip(parameters, net.gradients(windows[own], y[own], weight[own]), first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def learnable(doc_id: Column) -> Column:
    """Documents that may be learned from; the others are held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) != 0, F.lit(False))


def training_windows(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", limit: int = TRAIN_DOCS
) -> list[tuple[str, bytes]]:
    """Windows of a sample of ``limit`` learnable documents with text and language, with their language: equally many documents of each
    language, those with the smallest hashes, and one of each if there are more languages than that. From each a few windows at places
    given by a hash. Only these windows come to the driver, and a count for each language."""
    d, body, label = (F.col(f"`{c}`") for c in (doc_id, text, lang))
    usable = docs.filter(learnable(d) & label.isNotNull() & body.isNotNull() & body.rlike("\\p{L}"))
    counts = {r["lang"]: r["count"] for r in usable.groupBy(label.alias("lang")).count().collect()}
    if not counts:
        return []
    quota = max(1, limit // len(counts))
    draw = F.xxhash64(d, F.lit("sample"))
    uniform = F.shiftrightunsigned(draw, 11) / F.lit(2.0**53)
    # a share of each language that holds about twice its quota, then the quota by rank among these few rows
    shares = F.create_map(*[F.lit(x) for name, n in counts.items() for x in (name, (2.0 * quota + 100.0) / n)])
    length = F.length(body)
    places = [F.pmod(F.xxhash64(d, F.lit(f"place {i}")), F.greatest(length - WINDOW + 1, F.lit(1))) + 1 for i in range(TRAIN_WINDOWS)]
    drawn = usable.filter(uniform < F.element_at(shares, label)).select(
        label.alias("lang"),
        draw.alias("draw"),
        F.array(*[F.substr(body, p.cast("int"), F.lit(WINDOW)) for p in places]).alias("excerpts"),
    )
    ranked = drawn.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("draw", "excerpts")))
    rows = sorted((r.lang, r.draw, r.excerpts) for r in ranked.filter(F.col("rank") <= quota).collect())
    return [(language, x.encode()[:WINDOW]) for language, _, excerpts in rows for x in dict.fromkeys(excerpts)]


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", limit: int = TRAIN_DOCS) -> ByteNet | None:
    """A network fitted to ``training_windows``, with every language that occurs there, or None without any."""
    taken = training_windows(docs, doc_id, text, lang, limit)
    if not taken:
        return None
    windows = np.zeros((len(taken), WINDOW), np.uint8)
    for i, (_, excerpt) in enumerate(taken):
        windows[i, : len(excerpt)] = np.frombuffer(excerpt, np.uint8)
    return fit(windows, [language for language, _ in taken])


def identify_languages(
    docs: DataFrame, net: ByteNet | None, text: str = "text", min_score: float | None = None
) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (columns of these names are replaced), or, with ``min_score``, the rows of ``docs`` alone
    whose language is known with at least that score.

    A text is cut into windows that cover all of it; its score for a language is the windows' mean probability, weighted
    by their bytes, and the language with the highest one (of equal ones the first in the alphabet) is predicted. A null text, one without a letter,
    and every text if ``net`` is None get ``und`` with score 0. Repeated rows get equal results, an empty table no rows.
    """
    added = ("lang_pred", "score")
    kept = list(docs.columns) if min_score is not None else [c for c in docs.columns if c not in added]
    letter = F.coalesce(F.col(f"`{text}`").rlike("\\p{L}"), F.lit(False))
    # positions stand for names, so that columns may be called anything
    marked = docs.select(*[F.col(f"`{c}`") for c in kept], letter.alias("__letter"))
    at = kept.index(text)
    own = docs.select(*[F.col(f"`{c}`") for c in kept]).schema.fields
    result = [StructField("lang_pred", StringType()), StructField("score", DoubleType())]
    schema = StructType([*own, *([] if min_score is not None else result)])
    shared = docs.sparkSession.sparkContext.broadcast(net)  # a few thousand numbers

    def run(batches):
        model = shared.value
        for part in text_slices(batches, kept[at]):
            letters = part.column(part.num_columns - 1).to_pylist()
            documents = [d if ok and model else b"" for d, ok in zip(raw_texts(part.column(at)), letters, strict=True)]
            windows, counts = cut_windows(documents)
            names = [UNKNOWN] * len(documents)
            scores = np.zeros(len(documents))
            full = np.flatnonzero(counts)
            if len(full):
                likely = model.probabilities(windows).astype(np.float64)
                weight = np.maximum((windows != 0).sum(axis=1), 1).astype(np.float64)
                starts = (np.cumsum(counts) - counts)[full]
                sums = np.add.reduceat(likely * weight[:, None], starts, axis=0)
                mean = sums / np.add.reduceat(weight, starts)[:, None]
                best = mean.argmax(axis=1)
                scores[full] = np.clip(mean[np.arange(len(full)), best], 0, 1)
                for i, b in zip(full.tolist(), best.tolist(), strict=True):
                    names[i] = model.languages[b]
            columns = part.columns[:-1]
            if min_score is None:
                yield pa.RecordBatch.from_arrays([*columns, pa.array(names, pa.string()), pa.array(scores)], names=schema.names)
            else:
                keep = pa.array([n != UNKNOWN and s >= min_score for n, s in zip(names, scores.tolist(), strict=True)], pa.bool_())
                yield pa.RecordBatch.from_arrays(columns, names=schema.names).filter(keep)

    return map_batches(marked, run, schema)
