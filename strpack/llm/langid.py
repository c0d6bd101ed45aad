"""Language identification by nearest centroid.

Texts become normalised TF-IDF vectors of hashed character n-grams (1 to 3 letters, case folded, other characters one
blank). Training clusters the vectors of every language into a few centroids (spherical k-means), so that a language may
have several modes; prediction takes the closest centroid by cosine and rejects what is farther from all of them than texts
of the learned languages are. Short texts lie farther from their centroid than long ones, so the least cosine that is
accepted depends on the number of letters; it comes from texts kept out of the centroids, whole and in pieces.

Training sample: about ``Params.sample`` labelled texts over all languages and at least one of each (texts kept by a hash,
at a rate per language computed from its number of distinct texts; copies of one text count once), reduced to vectors on
the executors. Prediction reads every whole text.

Edge cases: null text and texts without a letter are ``und`` with score 0 and rejected; ties go to the first language
in alphabetical order; repeated rows get equal results; very long texts are counted in pieces that neither break a
character nor lose an n-gram; with no labelled row at all everything is ``und``; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch, cut, drop_cut


@dataclass(frozen=True)
class Params:
    buckets: int = 4096  # hashed n-gram space
    sample: int = 3000  # labelled texts to learn from, in expectation, over all languages
    broadcast_languages: int = 100_000  # rates of so many languages are broadcast; more are joined by shuffle
    centroids: int = 3  # clusters per language
    rounds: int = 8  # k-means iterations
    held: int = 10  # one in so many sampled texts is kept out to set the least cosines
    pieces: tuple[int, ...] = (40, 80, 160, 320, 640)  # characters of the pieces cut from them for short texts
    margin: float = 0.85  # rejected: a cosine of at most this share of the least one seen at that number of letters
    shortest: int = 24  # letters under which only a cosine of zero is rejected
    seed: int = 7


@dataclass
class Model:
    params: Params
    langs: list[str]
    lang_of: np.ndarray  # centroid -> language
    weights: np.ndarray  # (buckets, centroids): centroid components times idf
    idf: np.ndarray
    floors: np.ndarray  # least cosine at 2^k letters

    def floor(self, letters: np.ndarray) -> np.ndarray:
        at = np.interp(np.log2(np.maximum(letters, 1)), np.arange(len(self.floors)), self.floors)
        return np.where(letters < self.params.shortest, 0.0, at)


@lru_cache(1)
def _fold() -> np.ndarray:
    """Code point -> folded letter, or 0 for what is no letter."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


#: Bytes of a text that are counted at a time.
PIECE = 1 << 20


def _parts(t: bytes, size: int) -> Iterator[str]:
    """A text in parts of about so many bytes, cut between characters."""
    a = 0
    while a < len(t):
        b = min(len(t), a + size)
        while a < b < len(t) and t[b] & 0xC0 == 0x80:
            b -= 1
        if b == a:  # a character longer than a part
            b = min(len(t), a + size)
            while b < len(t) and t[b] & 0xC0 == 0x80:
                b += 1
        yield t[a:b].decode("utf-8", "ignore")
        a = b


def counts(texts: list[bytes | None], buckets: int, size: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-gram counts of every text, and its number of letters."""
    fold = _fold()
    out = np.zeros((len(texts), buckets), np.float32)
    letters = np.zeros(len(texts), np.int64)
    mask = np.uint32(buckets - 1)
    for i, t in enumerate(texts):
        row, before, blank = out[i], np.zeros(1, np.uint32), True
        for text in _parts(t or b"", size):
            x = fold[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
            if not len(x):
                continue
            keep = x != 0
            letters[i] += int(keep.sum())
            inked = keep.copy()
            keep[1:] |= inked[:-1]  # one blank after each word
            keep[0] |= not blank
            blank = not inked[-1]
            y = x[keep]
            if not len(y):
                continue
            x = np.concatenate([before, y])
            h1 = (x + np.uint32(1)) * np.uint32(0x9E3779B1)
            h2 = (h1[:-1] ^ (h1[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + h1[1:]
            h3 = (h2[:-1] ^ (h2[:-1] >> np.uint32(13))) * np.uint32(0xC2B2AE35) + h1[2:]
            k = len(before)  # n-grams that end before this part were counted with the last one
            for h in (h1[k:], h2[k - 1 :], h3[max(0, k - 2) :]):
                h = h ^ (h >> np.uint32(16))
                row += np.bincount(((h * np.uint32(0x27D4EB2F)) >> np.uint32(12)) & mask, minlength=buckets)
            before = x[-2:]
    return out, letters


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _damped(c: np.ndarray) -> np.ndarray:
    return np.log1p(c)


def _floors(best: np.ndarray, letters: np.ndarray, p: Params, least: int = 30) -> np.ndarray:
    """Least accepted cosine at 2^k letters: of the octaves with enough held-out texts, the others by their neighbours."""
    octave = np.floor(np.log2(np.maximum(letters, 1)) + 0.5).astype(int)
    known = [k for k in range(int(octave.max(initial=0)) + 1) if (octave == k).sum() >= least]
    if not known:
        return np.zeros(1)
    return np.interp(np.arange(known[-1] + 1), known, [p.margin * best[octave == k].min() for k in known])


def fit(df: DataFrame, params: Params = Params(), text: str = "text", lang: str = "lang") -> Model:
    """Learn from the rows of df with a text and a non-null language; nothing but these two columns is read."""
    space, buckets = 1 << 40, params.buckets
    rows = df.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    rows = rows.withColumn("h", F.pmod(F.xxhash64(F.lit(params.seed), "text"), F.lit(space)))
    stats = cut(rows.groupBy("lang").agg(F.approx_count_distinct("text", 0.02).alias("n"), F.min("h").alias("least")))
    count = stats.count()
    each, nothing = max(1, params.sample // max(1, count)), Model(params, [], np.zeros(0, int), np.zeros((buckets, 0), np.float32), np.ones(buckets, np.float32), np.zeros(1))
    rates = stats.select("lang", F.greatest("least", (F.lit(each) * F.lit(float(space)) / F.col("n")).cast("long")).alias("most"))
    chosen = rows.join(F.broadcast(rates) if count <= params.broadcast_languages else rates, "lang").where("h <= most")
    # Copies of one text share its hash; one of them is enough, and a hot text cannot swell the sample.
    chosen = chosen.dropDuplicates(["lang", "text"]).select("lang", F.col("text").cast("binary"), (F.pmod(F.xxhash64(F.lit(params.seed + 1), "text"), F.lit(params.held)) == 0).alias("held"))

    def vector(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for lang, t, held in zip(*(batch.column(i).to_pylist() for i in range(3))):
            pieces = [t] + ([s[:n].encode() for s in [t.decode("utf-8", "replace")] for n in params.pieces if len(s) > n] if held else [])
            c, letters = counts(pieces, buckets)
            out += [(lang, r.astype(np.float16).tobytes(), held, int(n)) for r, n in zip(np.minimum(c, 60000), letters) if n]
        kinds = pa.string(), pa.binary(), pa.bool_(), pa.int64()
        return pa.record_batch([pa.array(x, k) for x, k in zip(zip(*out) if out else ((),) * 4, kinds)], names=["lang", "v", "held", "letters"])

    got = by_batch(chosen, vector, "lang string, v binary, held boolean, letters long").orderBy("lang", "held", "v").toArrow()
    drop_cut(stats)
    held = got["held"].to_numpy()
    if not got.num_rows:
        return nothing
    langs = sorted(set(got["lang"].to_pylist()))
    labels, sizes = np.searchsorted(langs, np.array(got["lang"].to_pylist(), object)), got["letters"].to_numpy()
    x = np.empty((got.num_rows, buckets), np.float32)
    for i, v in enumerate(got["v"]):
        x[i] = np.frombuffer(v.as_buffer(), np.float16)
    del got
    for k in range(len(langs)):  # a language with held-out texts only learns from them
        if held[labels == k].all():
            held = held & (labels != k)
    idf = (np.log((1 + (~held).sum()) / (1 + (x > 0)[~held].sum(0))) + 1).astype(np.float32)
    # In place: the driver holds this matrix once.
    np.log1p(x, out=x)
    x *= idf
    x /= np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), 1e-12)[:, None]
    rng, centroids, of = np.random.default_rng(params.seed), [], []
    for k in range(len(langs)):
        own = x[(labels == k) & ~held]
        c = own[rng.choice(len(own), min(params.centroids, len(own)), replace=False)]
        for _ in range(params.rounds):
            near = (own @ c.T).argmax(1)
            c = _unit(np.stack([own[near == j].sum(0) if (near == j).any() else c[j] for j in range(len(c))]))
        centroids.append(c)
        of += [k] * len(c)
    c = np.concatenate(centroids)
    floors = _floors((x[held] @ c.T).max(1, initial=0.0), sizes[held], params)
    return Model(params, langs, np.array(of), (c * idf).T.astype(np.float32).copy(), idf, floors)


def predict(df: DataFrame, model: Model, *keep: str, text: str = "text") -> DataFrame:
    """The columns ``keep`` of df, then lang_pred, score and rejected for every whole text. The model (a few hundred kB,
    bounded by buckets x centroids x languages) is broadcast. Row-local: no exchange."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    names = [*keep, "lang_pred", "score", "rejected"]
    kinds = dict(df.dtypes)
    at = keep.index(text) if text in keep else len(keep)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        m, texts = shared.value, batch.column(at).cast(pa.binary())
        langs, scores, rejected = [], [], []
        for i in range(0, len(texts), 256):
            c, letters = counts([t.as_py() for t in texts[i : i + 256]], m.params.buckets)
            c, some, floor = _damped(c), letters > 0, m.floor(letters)
            size = np.linalg.norm(c * m.idf, axis=1)
            some &= size > 0
            if m.langs:
                cos = (c @ m.weights) / np.maximum(size, 1e-12)[:, None]
                best = cos.argmax(1)
                top = np.clip(cos[np.arange(len(c)), best], 0, 1)
            else:
                some[:] = False
            for k in range(len(c)):
                langs.append(m.langs[m.lang_of[best[k]]] if some[k] else "und")
                scores.append(float(round(float(top[k]), 6)) if some[k] else 0.0)
                rejected.append(bool(not some[k] or top[k] <= floor[k]))
        return pa.record_batch([*batch.columns[: len(keep)], pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], names=names)

    schema = ", ".join([f"`{k}` {kinds[k]}" for k in keep] + ["lang_pred string, score double, rejected boolean"])
    # The text travels once: as a column to keep, or as bytes behind the others.
    rows = df.select(*keep) if text in keep else df.select(*keep, F.col(text).cast("binary").alias("__bytes"))
    return by_batch(rows, run, schema)
