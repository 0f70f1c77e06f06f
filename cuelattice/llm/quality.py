"""Quality by a factorisation machine.

A text becomes a sparse vector: hashed words, binned structure statistics and the size in its metadata. The machine
scores it with linear weights plus all pairwise interactions at low rank, in time linear in the entries:
sum over pairs <v_i, v_j> x_i x_j = 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelattice.llm import words
from cuelattice.llm.common import labelled_sample, small_batches

WORDS = 1 << 14
BINS = 12
STATISTICS = (
    "words", "word_length", "upper", "digits", "signs", "signed_words", "repeated_next", "distinct", "capital_words",
    "bars", "repeated_lines", "lines", "line_words", "commonest", "sentence_ends", "long_words", "n_chars",
)
DIMENSIONS = WORDS + BINS * len(STATISTICS)
_RUN_SIGNS = np.array([chr(i) in "#$%&*|" for i in range(0x80)] + [False])
_ENDS = np.array([chr(i) in ".?!" for i in range(0x80)] + [False])
# Classes of code points: 0 sign, 1 white space, 2 letter, 3 capital, 4 digit; beyond the table all count as letters.
_KIND = np.array([1 if (c := chr(i)).isspace() else 3 if c.isupper() else 2 if c.isalpha() else 4 if c.isdigit() else 0 for i in range(0x3000)], dtype=np.int8)
_LOWER = np.array([ord(c) if len(c := chr(i).lower()) == 1 else i for i in range(0x3000)], dtype=np.uint32)


def vector(text: str, n_chars: float | None) -> tuple[np.ndarray, np.ndarray]:
    """A whole text as sparse entries: places and values."""
    codes = words.points(text)
    near = np.minimum(codes, len(_KIND) - 1)
    kind = np.where(codes < len(_KIND), _KIND[near], 2)
    starts, ends = words.spans(kind == 1)
    n = len(starts)
    ids, values, stats = np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros(len(STATISTICS))
    if n:
        length = ends - starts
        total = lambda mask: np.concatenate([[0], np.cumsum(mask)])
        within = lambda sums: sums[ends] - sums[starts]
        capitals, letters = within(total(kind == 3)), within(total((kind == 2) | (kind == 3)))
        last, one = np.minimum(codes[ends - 1], 0x80), kind[ends - 1] == 0
        two = one & (length >= 2) & (kind[np.maximum(ends - 2, 0)] == 0)
        lead = (kind[starts] == 0) & (length > 1)
        lowered = np.where(codes < len(_LOWER), _LOWER[near], codes)
        core_ends = ends - one.astype(np.int64) - two
        some = core_ends > starts + lead
        sums = words.prefix(lowered)
        cores = words.span_hashes(sums, (starts + lead)[some], core_ends[some])
        marks = words.span_hashes(sums, starts, ends)
        ids, times = np.unique((cores % np.uint64(WORDS)).astype(np.int64), return_counts=True)
        values = np.sqrt(times)
        values = values / max(np.sqrt((values**2).sum()), 1e-9)
        counts = np.unique(marks, return_counts=True)[1]
        lines = [x for x in text.split("\n") if x.strip()]
        chars = max(int(length.sum()), 1)
        stats = np.array([
            np.log2(1 + n) / 14, min(chars / n / 16, 1.0), capitals.sum() / chars, (kind == 4).sum() / chars, (kind == 0).sum() / chars,
            (two | (one & _RUN_SIGNS[last])).mean(), (marks[1:] == marks[:-1]).sum() / n, len(counts) / n,
            ((letters > 1) & (capitals == letters)).mean(), ((length == 1) & (last == 124)).mean(),
            1 - len(set(lines)) / max(len(lines), 1), np.log2(1 + len(lines)) / 10, np.log2(1 + n / max(len(lines), 1)) / 12,
            counts.max() / n, (one & ~two & _ENDS[last]).mean(), (length > 20).mean(), 0.0,
        ])
    stats[-1] = 0.0 if n_chars is None or n_chars != n_chars else np.log2(1 + max(float(n_chars), 0.0)) / 18
    s = np.clip(stats, 0.0, 1.0)
    # Fine steps near nothing, coarse ones near all: a little junk in a long text shows too.
    bins = np.where(s <= 0, 0, 1 + np.clip(np.floor(np.log2(np.maximum(s, 1e-9) * 512)), 0, BINS - 2)).astype(np.int64)
    linear = [0, 1, 7, 11, 12, 16]
    bins[linear] = np.minimum(np.floor(s * BINS), BINS - 1).astype(np.int64)[linear]
    return np.concatenate([ids, WORDS + BINS * np.arange(len(s)) + bins]), np.concatenate([values, np.full(len(s), 0.5)])


@dataclass
class FactorisationMachine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def logits(self, ids: np.ndarray, values: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Scores of many sparse rows at once; row k has entries from ``starts[k]`` on, at least one each."""
        weighted = self.factors[ids] * values[:, None]
        total = np.add.reduceat(weighted, starts, axis=0)
        squares = np.add.reduceat(weighted**2, starts, axis=0)
        return self.bias + np.add.reduceat(self.linear[ids] * values, starts) + 0.5 * (total**2 - squares).sum(axis=1)


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, rank: int = 6, epochs: int = 8, batch: int = 128, rate: float = 0.15, shrink: float = 1e-4, seed: int = 7) -> FactorisationMachine:
    """Adagrad on the log loss, in mini-batches, with rows in a fixed order shuffled by ``seed``."""
    rng = np.random.default_rng(seed)
    ones = float((labels > 0).sum())
    fm = FactorisationMachine(float(np.log((ones + 1) / (len(labels) - ones + 1))), np.zeros(DIMENSIONS), rng.normal(0, 0.02, (DIMENSIONS, rank)))
    gl, gv = np.full(DIMENSIONS, 1e-3), np.full((DIMENSIONS, rank), 1e-3)
    for _ in range(epochs if len(rows) else 0):
        order = rng.permutation(len(rows))
        for lo in range(0, len(order), batch):
            picked = order[lo : lo + batch]
            sizes = np.array([len(rows[i][0]) for i in picked])
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            ids, x = np.concatenate([rows[i][0] for i in picked]).astype(np.int64), np.concatenate([rows[i][1] for i in picked]).astype(float)
            weighted = fm.factors[ids] * x[:, None]
            total = np.add.reduceat(weighted, starts, axis=0)
            z = fm.bias + np.add.reduceat(fm.linear[ids] * x, starts) + 0.5 * (total**2 - np.add.reduceat(weighted**2, starts, axis=0)).sum(axis=1)
            d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[picked]) / len(picked)
            each = np.repeat(d, sizes)
            by = np.argsort(ids, kind="stable")
            used, first = np.unique(ids[by], return_index=True)
            lin = np.add.reduceat((each * x)[by], first) + shrink * fm.linear[used]
            fac = np.add.reduceat(((each * x)[:, None] * (np.repeat(total, sizes, axis=0) - weighted))[by], first, axis=0) + shrink * fm.factors[used]
            gl[used] += lin**2
            gv[used] += fac**2
            fm.linear[used] -= rate * lin / np.sqrt(gl[used])
            fm.factors[used] -= rate * fac / np.sqrt(gv[used])
            fm.bias -= rate * float(d.sum())
    return fm


def _metadata(docs: DataFrame):
    """The size that the table states for a text; a table without ``n_chars`` states none."""
    return (F.col("n_chars").cast("double") if "n_chars" in docs.columns else F.lit(None).cast("double")).alias("n_chars")


def fit_quality(docs: DataFrame, labels: DataFrame, max_rows: int = 8_000, label: str = "quality") -> FactorisationMachine:
    """Train on about ``max_rows`` labelled rows that aren't held out; texts become vectors on the executors."""
    small_batches(docs.sparkSession)
    sample = labelled_sample(docs, labels, label, max_rows, _metadata(docs))

    def vectors(batches):
        for pdf in batches:
            got = [vector(t, n) for t, n in zip(pdf["text"], pdf["n_chars"], strict=True)]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "ids": [x.astype(np.int32).tobytes() for x, _ in got], "x": [v.astype(np.float32).tobytes() for _, v in got], "label": pdf["label"]})

    got = sample.mapInPandas(vectors, "doc_id long, ids binary, x binary, label int").toArrow().sort_by([("doc_id", "ascending"), ("label", "ascending"), ("ids", "ascending")])
    # The vectors stay where Arrow holds them: about 8 bytes an entry.
    rows = [(np.frombuffer(i.as_buffer(), dtype=np.int32), np.frombuffer(x.as_buffer(), dtype=np.float32)) for i, x in zip(got["ids"], got["x"], strict=True)]
    return train(rows, (got["label"].to_numpy() > 0).astype(float))


def score_of(docs: DataFrame, model: FactorisationMachine):
    """The score of each whole text as a column of ``docs``."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, sizes in batches:
            got = [vector(t or "", n) for t, n in zip(texts, sizes, strict=True)]
            if not got:
                yield pd.Series([], dtype="float64")
                continue
            starts = np.concatenate([[0], np.cumsum([len(i) for i, _ in got])[:-1]]).astype(np.int64)
            z = held.value.logits(np.concatenate([i for i, _ in got]), np.concatenate([v for _, v in got]), starts)
            yield pd.Series(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    return score(F.coalesce("text", F.lit("")), _metadata(docs))


def score_quality(docs: DataFrame, model: FactorisationMachine, threshold: float = 0.3) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on).

    Null and empty texts are scored from the structure statistics of an empty text. Columns of these names that
    ``docs`` already has are replaced.
    """
    out = docs.withColumn("score", score_of(docs, model))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, model: FactorisationMachine, threshold: float = 0.3) -> DataFrame:
    """The documents that score at least ``threshold``, all their columns untouched."""
    return docs.where(score_of(docs, model) >= threshold)
