"""Toxicity by noisy-channel deobfuscation.

Disguised words (leetspeak, letters set apart, drawn-out letters) become small lattices of characters. A Viterbi
search under a character trigram model, counted over every text of the corpus, picks the likeliest readings, and a
lexicon learned from labelled rows scores the restored words.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelattice.llm.common import labelled_sample, saved, small_batches

# The letters that the character model tells apart; code 0 is "no letter", the last code any other letter.
LETTERS = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"
OTHER = len(LETTERS) + 1
SIZE = 64
# What a sign may stand for in disguised words.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "µ": "u",
}
SEPARATORS = set(" .-_*~'`,/\\:;^=#​­")
EDGES = ".,;:?\"'()[]{}<>%&*#|!$/\\-_=~`^…«»„“”–—"
SPACED = re.compile(r"(?<!\S)\S(?:[ ]\S){2,}(?!\S)")
DRAWN = re.compile(r"(.)\1\1")
# How much a clean row that holds a feature counts against it, in toxic rows, at equal numbers of both.
CLEAN_COST = 1.5
# Words whose readings, and whose scores, a worker keeps.
KEPT_READINGS, KEPT_SCORES = 50_000, 150_000
SUBSTITUTED, DROPPED, SHORTENED, PARTED = -0.5, -0.2, -0.4, -3.0

_CODE = {c: i + 1 for i, c in enumerate(LETTERS)}


def _code(c: str) -> int:
    return _CODE.get(c) or (OTHER if c.isalpha() else 0)


_TABLE = np.array([_code(chr(i)) for i in range(0x250)], dtype=np.int64)


def _count_trigrams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = np.zeros(SIZE**3, dtype=np.int64)
    waiting: list[np.ndarray] = []
    size = 0
    for pdf in batches:
        for text in pdf["text"]:
            points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), dtype=np.uint32)
            codes = np.where(points < len(_TABLE), _TABLE[np.minimum(points, len(_TABLE) - 1)], 0)
            waiting.append(codes[:-2] * SIZE * SIZE + codes[1:-1] * SIZE + codes[2:])
            size += len(codes)
            if size > 1_000_000:
                total += np.bincount(np.concatenate(waiting), minlength=SIZE**3)
                waiting, size = [], 0
    if waiting:
        total += np.bincount(np.concatenate(waiting), minlength=SIZE**3)
    at = np.flatnonzero(total)
    yield pd.DataFrame({"gram": at, "n": total[at]})


def character_counts(docs: DataFrame) -> DataFrame:
    """Trigram counts over every whole text: ``gram`` (three codes as one number), ``n``. At most 64**3 rows."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInPandas(_count_trigrams, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


class CharacterModel:
    """log P(c | a, b) with add-k smoothing and back-off weights, from trigram counts."""

    def __init__(self, grams, counts):
        full = np.zeros(SIZE**3)
        full[np.asarray(grams, dtype=np.int64)] = np.asarray(counts, dtype=float)
        tri = full.reshape(SIZE, SIZE, SIZE)
        bi = tri.sum(axis=0)
        uni = bi.sum(axis=0) + 0.5
        p1 = uni / uni.sum()
        p2 = (bi + 2.0 * p1) / (bi.sum(axis=1, keepdims=True) + 2.0)
        p3 = (tri + 5.0 * p2[None, :, :]) / (tri.sum(axis=2, keepdims=True) + 5.0)
        self.logp = np.log(p3).astype(np.float32)

    def after(self, a: int, b: int, c: int) -> float:
        return float(self.logp[a, b, c])


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """Alternatives for each run of one sign in ``token``: (what is written, log weight of the channel)."""
    out = []
    for m in re.finditer(r"(.)\1*", token, re.S):
        c, n = m[1], len(m[0])
        arcs: list[tuple[str, float]] = []
        if c.isalpha():
            if n == 1:
                arcs.append((c, 0.0))
            else:
                arcs += [(c * 2, 0.0 if n == 2 else SHORTENED), (c, SHORTENED * (2 if n == 2 else 1))]
        else:
            for x in LEET.get(c, ""):
                arcs.append((x, SUBSTITUTED))
                if n > 1:
                    arcs.append((x * 2, SUBSTITUTED))
            if c in SEPARATORS or c.isspace():
                arcs.append(("", DROPPED))
            arcs.append((" ", PARTED))
        out.append(arcs)
    return out


def decode(token: str, model: CharacterModel, best: int = 4) -> list[tuple[str, float]]:
    """The likeliest readings of one disguised token: Viterbi over (last two letters) states, best first."""
    states: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
    for arcs in lattice(token):
        step: dict[tuple[int, int], tuple[float, str]] = {}
        for (a, b), (score, text) in states.items():
            for written, weight in arcs:
                s, x, y = score + weight, a, b
                for c in written:
                    k = _code(c)
                    if not (k == 0 and y == 0):
                        s += model.after(x, y, k)
                        x, y = y, k
                if (x, y) not in step or step[x, y][0] < s:
                    step[x, y] = (s, text + written)
        states = step
    ends = sorted(((s + (model.after(a, b, 0) if b else 0.0), t) for (a, b), (s, t) in states.items()), reverse=True)
    return [(t, s) for s, t in ends[:best]]


def suspicious(word: str) -> str:
    """The part of a word that needs decoding, or nothing: letters with signs among them, or drawn-out letters."""
    if word.isalpha():
        return word if DRAWN.search(word) else ""
    core = word.strip(EDGES)
    at = word.find(core) if core else 0
    if core and at == 1 and word[0] in "!$|(":
        core = word[0] + core
    elif core and len(word) - len(core) - at == 1 and word[-1] in "!$|":
        core = core if core.isalpha() else core + word[-1]
    letters = sum(c.isalpha() for c in core)
    if not letters or (core.isalpha() and not DRAWN.search(core)):
        return ""
    return core if letters >= 2 or len(core) <= 6 else ""


def features(word: str) -> list[str]:
    return [f"={word}", *(f"{n}{word[:n]}" for n in (4, 5, 6) if len(word) > n)]


@dataclass
class ToxicityModel:
    """Character model, weights by feature (``=`` whole word, a digit and a prefix) and bias."""

    characters: CharacterModel
    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -3.0
    memo: dict[str, tuple[str, ...]] = field(default_factory=dict, repr=False)
    scored: dict[str, float] = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return {"characters": self.characters, "weights": self.weights, "bias": self.bias, "memo": {}, "scored": {}}

    def readings(self, word: str) -> tuple[str, ...]:
        """Restored forms of one lower-case word, itself included; those of disguised words are kept, since they repeat."""
        core, plain = suspicious(word), word.strip(EDGES)
        if not core:
            return (plain,) if plain else ()
        got = self.memo.get(word)
        if got is None:
            if len(self.memo) > KEPT_READINGS:
                self.memo.clear()
            restored = (p for t, _ in decode(core, self.characters) for p in t.split())
            got = self.memo[word] = tuple(dict.fromkeys([*([plain] if plain else []), *restored]))
        return got

    def words(self, text: str) -> set[str]:
        """The distinct restored words of a whole text."""
        low = text.lower()
        found = set(low.split())
        out = set()
        for w in found:
            out.update(self.readings(w))
        for run in SPACED.findall(low):
            for t, _ in decode(run, self.characters):
                out.update(t.split())
                out.add(t.replace(" ", ""))
        return out

    def word_score(self, word: str) -> float:
        return max((self.weights.get(f, 0.0) for f in features(word)), default=0.0)

    def score(self, text: str) -> float:
        low = text.lower()
        total, memo = self.bias, self.scored
        if len(memo) > KEPT_SCORES:
            memo.clear()
        for w in set(low.split()):
            s = memo.get(w)
            if s is None:
                s = memo[w] = max((self.word_score(r) for r in self.readings(w)), default=0.0)
            total += s
        for run in SPACED.findall(low):
            seen = {p for t, _ in decode(run, self.characters) for p in (*t.split(), t.replace(" ", ""))}
            total += max((self.word_score(r) for r in seen), default=0.0)
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, total))))


def akin(a: str, b: str) -> bool:
    """One is the beginning of the other, so that one word has both."""
    return a[1:].startswith(b[1:]) or b[1:].startswith(a[1:])


# How far a whole word is preferred to the beginnings that hold it.
_TRUST = {"=": 1.0, "6": 0.8, "5": 0.75, "4": 0.7}


def _marks(words: set[str]) -> list[int]:
    """Three independent minimum hashes of a set of words; near copies have all three in common."""
    crc = np.fromiter((zlib.crc32(w.encode("utf-8", "replace")) for w in words), dtype=np.uint64, count=len(words))
    return [int((crc * np.uint64(m) & np.uint64(0xFFFFFFFF)).min()) if len(crc) else 0 for m in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)]


def _features_of(words: str) -> set[str]:
    return {f for w in words.split(" ") if w for f in features(w)}


def cover(held: dict[str, np.ndarray], clean: dict[str, int], rows: int, cost: float, min_gain: int = 4, covers: int = 4, most: int = 2000) -> list[str]:
    """Features by greedy cover: again and again the one that explains most toxic rows not yet explained ``covers`` times.

    ``held`` has the toxic rows of each feature, ``clean`` how many clean rows hold it; those count against it at ``cost``
    each. It ends when no feature explains ``min_gain`` more rows.
    """
    left = np.full(rows, covers)
    gain = {f: _TRUST[f[0]] * (len(i) - cost * clean[f]) for f, i in held.items()}
    chosen: list[str] = []
    while gain and len(chosen) < most:
        best, best_gain = None, 0.0
        for f in sorted(gain, key=lambda f: (-gain[f], f)):
            if gain[f] <= best_gain:
                break
            gain[f] = _TRUST[f[0]] * (float((left[held[f]] > 0).sum()) - cost * clean[f])
            if gain[f] > best_gain:
                best, best_gain = f, gain[f]
        if best is None or best_gain < min_gain:
            break
        chosen.append(best)
        left[held[best]] -= 1
        gain = {f: g for f, g in gain.items() if g >= min_gain and not (akin(f, best) and np.isin(held[f], held[best]).mean() > 0.9)}
    return chosen


def weigh(chosen: list[str], held: dict[str, np.ndarray], toxic_rows: int, clean_held: dict[str, np.ndarray], clean_rows: int) -> tuple[np.ndarray, float]:
    """Logistic weights of the chosen features, none below 0, and the bias, from which rows hold which."""
    col = np.concatenate([np.full(len(x[f]), j) for x in (held, clean_held) for j, f in enumerate(chosen)]).astype(np.int64)
    row = np.concatenate([*(held[f] for f in chosen), *(clean_held[f] + toxic_rows for f in chosen)]).astype(np.int64)
    n = toxic_rows + clean_rows
    y = (np.arange(n) < toxic_rows).astype(float)
    w, b = np.zeros(len(chosen)), math.log((toxic_rows + 0.5) / (clean_rows + 0.5))
    for _ in range(300):
        d = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[col], n) + b, -30, 30))) - y
        w = np.clip(w - 20.0 * (np.bincount(col, d[row], len(chosen)) / n + 2e-5 * w), 0, 12)
        b -= 2.0 * float(d.mean())
    return w, b


def learn(rows: DataFrame, characters: CharacterModel, min_gain: int = 3) -> ToxicityModel:
    """A lexicon from rows ``words`` (restored words, parted by spaces) and ``label``: greedy cover, then logistic weights.

    Features are counted where the rows lie. The driver gets those alone that explain enough toxic rows, with the
    numbers of the rows that hold them.
    """
    model = ToxicityModel(characters)
    numbered = rows.select("words", "label", F.monotonically_increasing_id().alias("row"))
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1:
        return model
    model.bias = math.log((n1 + 0.5) / (n0 + 0.5))
    cost = CLEAN_COST / max(n1 / max(n0, 1), 0.02)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for pdf in batches:
            for words, y in zip(pdf["words"], pdf["label"], strict=True):
                seen[y].update(_features_of(words))
        both = list(seen[0].keys() | seen[1].keys())
        yield pd.DataFrame({"feature": both, "toxic": [seen[1][f] for f in both], "clean": [seen[0][f] for f in both]})

    counted = rows.mapInPandas(count, "feature string, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    trust = F.element_at(F.create_map(*[F.lit(x) for kv in _TRUST.items() for x in kv]), F.substring("feature", 1, 1))
    useful = counted.where((F.col("toxic") >= min_gain) & (trust * (F.col("toxic") - cost * F.col("clean")) >= min_gain))
    totals = {r["feature"]: (r["toxic"], r["clean"]) for r in useful.collect()}
    wanted = rows.sparkSession.sparkContext.broadcast(frozenset(totals))

    def hold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [(f, y, i) for words, y, i in zip(pdf["words"], pdf["label"], pdf["row"], strict=True) for f in _features_of(words) & wanted.value]
            yield pd.DataFrame(got, columns=["feature", "label", "row"])

    postings = numbered.mapInPandas(hold, "feature string, label int, row long").groupBy("feature", "label").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    held: dict[int, dict[str, np.ndarray]] = {0: {f: np.zeros(0, dtype=np.int64) for f in totals}, 1: {}}
    found = postings.collect()
    place = {y: np.unique(np.array([i for r in found if r["label"] == y for i in r["rows"]], dtype=np.int64)) for y in (0, 1)}
    for r in found:
        held[r["label"]][r["feature"]] = np.searchsorted(place[r["label"]], np.array(r["rows"], dtype=np.int64))
    chosen = cover(held[1], {f: c for f, (_, c) in totals.items()}, n1, cost, min_gain)
    if not chosen:
        return model
    w, model.bias = weigh(chosen, held[1], n1, held[0], n0)
    # A feature chosen for its precision keeps a weight that lets one clear word decide on its own.
    prior = [math.log((totals[f][0] + 0.5) / (totals[f][1] + 0.5)) + math.log((n0 + 1) / (n1 + 1)) for f in chosen]
    model.weights = {f: float(max(x, p)) for f, x, p in zip(chosen, w, prior, strict=True)}
    return model


def fit_toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = 8_000, label: str = "toxic") -> ToxicityModel:
    """Count characters over all of ``docs``, learn the lexicon from about ``max_rows`` labelled rows not held out.

    Of near copies with one label (rows whose restored words agree in three minimum hashes) one is learned from.
    """
    spark = docs.sparkSession
    grams = character_counts(docs).toArrow()
    characters = CharacterModel(grams["gram"].to_numpy(), grams["n"].to_numpy())
    del grams
    blank = spark.sparkContext.broadcast(ToxicityModel(characters))

    def bags(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [blank.value.words(t) for t in pdf["text"]]
            yield pd.DataFrame({"words": [" ".join(sorted(x)) for x in found], "marks": [_marks(x) for x in found], "label": (pdf["label"] > 0).astype("int32")})

    sample = labelled_sample(docs, labels, label, max_rows).mapInPandas(bags, "words string, marks array<long>, label int")
    rows = saved(sample.groupBy("marks", "label").agg(F.min("words").alias("words")).select("words", "label"), "toxicity-rows")
    model = learn(rows, characters)
    blank.unpersist()
    return model


def score_of(docs: DataFrame, model: ToxicityModel):
    """The score of each whole text as a column of ``docs``."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield pd.Series([held.value.score(t or "") for t in s], dtype="float64")

    return score(F.coalesce("text", F.lit("")))


def score_toxicity(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on).

    Null and empty texts score the bias alone. Columns of these names that ``docs`` already has are replaced.
    """
    out = docs.withColumn("score", score_of(docs, model))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5) -> DataFrame:
    """The documents that score below ``threshold``, all their columns untouched."""
    return docs.where(score_of(docs, model) < threshold)
