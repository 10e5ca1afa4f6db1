"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on windows of ordinary texts and one on what marks toxic
texts off: the stretches of byte n-grams that occur far more often in toxic texts of the sample. A
window of a text is compressed once against the ordinary dictionary and once against both
together; the saving in bytes tells how much of it only the toxic side explains. Shares of windows
beyond thresholds, the mean and the largest saving become a score by a logistic fit on labelled
texts that the dictionaries have not seen. How clearly a gram has to mark, and the two thresholds,
are cross-validated on those texts against the cut of the score.

Dictionaries and fit take at most ``sample_rows`` labelled rows (by hash of the id, the documented
bound); what is broadcast is two dictionaries of a few KB. Scoring covers whole texts, without a
shuffle.

Defined cases: null, empty and blank texts have one empty window with no saving and get the score
that belongs to it; repeated rows repeat their result; without labelled rows of both kinds every
score is 0; a null doc_id is kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, labelled_sample, logistic, map_batches, table

GRAM = 7
#: Score from which on a text counts as toxic.
CUT = 0.7
#: What is calibrated: evidence (log-likelihood ratio) that a gram marks; saved bytes from which on a window counts as marked, and as strongly marked.
LEVELS = (12, 18, 24, 32)
THRESHOLDS = tuple((a, b) for a in range(1, 5) for b in range(a + 1, 8))
#: Toxic texts that have to hold a gram or a stretch, at any number of texts.
LEAST = 3
#: Shortest match in bytes that the compressors use: shorter ones are chance.
MATCH = 6


_SEPARATORS = bytes(b for b in range(128) if not (0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A))
_TO_BLANK = bytes.maketrans(_SEPARATORS, b" " * len(_SEPARATORS))


def words_only(text: str | None) -> bytes:
    """The text's words in lower case, with one blank before, between and after them."""
    return b" %s " % b" ".join((text or "").lower().encode().translate(_TO_BLANK).split())


def windows(raw: bytes, size: int) -> list[bytes]:
    """Stretches of at most ``size`` bytes that end before a blank where they can; all bytes are in one of them."""
    out, at, n = [], 0, len(raw)
    while at < n:
        end = min(n, at + size)
        if end < n:
            blank = raw.rfind(b" ", at + size // 2, end)
            end = blank if blank > 0 else end
        out.append(raw[at:end])
        at = end
    return out or [b""]


def _placed(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Grams with their places and sizes, by place: GRAM bytes inside a word, and whole words of at most GRAM bytes, blanks around them included."""
    data = np.frombuffer(raw, np.uint8).astype(np.int64)
    blanks = np.append(0, np.cumsum(data == 32))
    grams, places, sizes = [], [], []
    for size in range(3, GRAM + 1):
        at = np.arange(max(0, len(data) - size + 1))
        whole = (data[at] == 32) & (data[at + size - 1] == 32)
        at = at[whole | (blanks[at + size - 1] == blanks[at + 1])] if size == GRAM else at[whole]
        gram = np.zeros(len(at), np.int64)
        for k in range(size):
            gram = gram * 256 + data[at + k]
        grams.append(gram)
        places.append(at)
        sizes.append(np.full(len(at), size))
    g, p, n = np.concatenate(grams), np.concatenate(places), np.concatenate(sizes)
    order = np.lexsort((-n, p))
    return g[order], p[order], n[order]


def _counted(texts: list[bytes], grams: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Grams (by default all) of the texts, sorted, and in how many texts each occurs."""
    if grams is None:
        found = [np.unique(_placed(t)[0]) for t in texts]
        grams = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    texts_with = np.zeros(len(grams), np.int64)
    for t in texts if len(grams) else ():
        own = np.unique(_placed(t)[0])
        at = np.minimum(np.searchsorted(grams, own), len(grams) - 1)
        texts_with[at[grams[at] == own]] += 1
    return grams, texts_with


def gram_evidence(toxic: list[bytes], ordinary: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Grams that LEAST different toxic texts hold, sorted, with the log-likelihood ratio of their toxic and ordinary texts (0 where they are
    no more common in toxic ones). It weighs how pure a gram is against how often it was seen, so that a mark of a small group counts too."""
    toxic, ordinary = list(dict.fromkeys(toxic)), list(dict.fromkeys(ordinary))
    grams, here = _counted(toxic)
    grams, here = grams[here >= LEAST], here[here >= LEAST]
    _, there = _counted(ordinary, grams)
    share = len(toxic) / max(1, len(toxic) + len(ordinary))
    part = lambda seen, expected: seen * np.log(np.maximum(seen, 1) / expected)
    both = here + there
    found = 2 * (part(here, both * share) + part(there, np.maximum(both * (1 - share), 1e-9)))
    return grams, np.where(here > both * share, found, 0.0)


def marked_stretches(raw: bytes, grams: np.ndarray) -> list[bytes]:
    """The maximal stretches that overlapping marking grams cover."""
    out, start, end = [], 0, 0
    own, places, sizes = _placed(raw)
    marks = np.isin(own, grams)
    for i, n in zip(places[marks].tolist(), sizes[marks].tolist(), strict=True):
        if i >= end:
            out.append(raw[start:end])
            start = i
        end = max(end, i + n)
    return [x for x in (*out, raw[start:end]) if x]


def common_stretches(texts: list[list[bytes]]) -> list[bytes]:
    """The stretches, repeats included, that LEAST toxic texts hold; all where none is that common."""
    texts_with: dict[bytes, int] = {}
    for t in texts:
        for w in set(t):
            texts_with[w] = texts_with.get(w, 0) + 1
    often = [w for t in texts for w in t if texts_with[w] >= LEAST]
    return often or [w for t in texts for w in t]


def _trained(size: int, samples: list[bytes]) -> bytes:
    """The content of a trained dictionary; the samples' tail where they are too few to train on."""
    try:
        data = zstandard.train_dictionary(size, samples).as_bytes()
        return data[min(len(data) // 4, 512) :]
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def toxic_content(size: int, words: list[bytes], most: int = 16384) -> bytes:
    """A dictionary trained on the stretches, after those that training left out (it prefers common ones), the commonest last; of these ``most`` bytes,
    as far as windows reach back."""
    trained = _trained(size, [b"".join(words[i : i + 8]) for i in range(0, len(words), 8)])
    left = [w for w, _ in Counter(words).most_common() if w not in trained]
    return b"".join(reversed(left))[-most:] + trained


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    weights: list[float]
    size: int = 48
    marked: int = 2
    strong: int = 3

    def _compressors(self):
        p = zstandard.ZstdCompressionParameters(compression_level=3, min_match=MATCH, strategy=zstandard.STRATEGY_BTLAZY2, window_log=15, hash_log=14, chain_log=15, search_log=7, write_content_size=False, write_checksum=False, write_dict_id=False)
        for content in (self.ordinary, self.toxic + self.ordinary):  # the ordinary part stays as near, so that only toxic matches differ
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=p)
            yield zstandard.ZstdCompressor(dict_data=d, compression_params=p).compress

    def __getstate__(self):
        return {k: v for k, v in vars(self).items() if k != "_both"}

    def saved(self, text: str | None) -> np.ndarray:
        """Bytes that the toxic side saves in each window."""
        if "_both" not in vars(self):
            self._both = tuple(self._compressors())
        plain, both = self._both
        return np.array([len(plain(w)) - len(both(w)) for w in (w + b" " for w in windows(words_only(text), self.size))])

    def features(self, text: str | None) -> list[float]:
        return self.features_of(self.saved(text))

    def features_of(self, saved: np.ndarray) -> list[float]:
        marked, strong = saved >= self.marked, saved >= self.strong
        return [float(marked.mean()), float(strong.mean()), float(saved.mean()), float(saved.max()) / 10, float(np.log1p(marked.sum())), float(np.log1p(strong.sum())), float(np.log1p(len(saved)))]

    def score(self, text: str | None) -> float:
        z = float(np.dot(self.weights, [1.0, *_shaped(np.array([self.features(text)]))[0]])) if self.weights else -50.0
        return float(1 / (1 + np.exp(-np.clip(z, -50, 50))))


def _shaped(x: np.ndarray) -> np.ndarray:
    """Shares grow fast at first: their roots join the features."""
    return np.hstack([x, np.sqrt(np.maximum(x[:, :2], 0))])


def _held_out(x: np.ndarray, y: np.ndarray, folds: int = 5) -> tuple[float, float]:
    """The best F1 over all cuts of the log-odds, and that cut; each row is scored by a fit on the other folds, which have equal parts of
    both kinds."""
    fold_of = np.zeros(len(y), int)
    for kind in (0, 1):
        fold_of[y == kind] = np.arange((y == kind).sum()) % folds
    z = np.zeros(len(y))
    for f in np.unique(fold_of):
        w = logistic(x[fold_of != f], y[fold_of != f])
        z[fold_of == f] = w[0] + x[fold_of == f] @ w[1:]
    order = np.argsort(-z, kind="stable")
    z, hits = z[order], np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + hits[-1])
    f1[:-1][z[:-1] == z[1:]] = 0  # equal scores fall on one side
    best = int(f1.argmax())
    return float(f1[best]), float((z[best] + z[min(best + 1, len(z) - 1)]) / 2)


def fit_toxicity(docs: DataFrame, labels: DataFrame, keep=None, sample_rows: int = 8000, sample_bytes: int = 64 << 20, ordinary_bytes: int = 8192, toxic_bytes: int = 2048, size: int = 48) -> Model:
    """From at most ``sample_rows`` labelled rows with at most ``sample_bytes`` of text: half of them for the dictionaries, half for the fit
    and its thresholds. The score is moved so that the cut which held-out folds like best lies at CUT."""
    sample = labelled_sample(docs, labels, "toxic", sample_rows, keep, sample_bytes)
    rows = [(zlib.crc32(str(r["doc_id"]).encode() + b"half"), r["doc_id"], r["text"], r["y"]) for r in sample.select("doc_id", "text", "y").collect()]
    rows.sort(key=lambda r: r[:3])
    first, second = [r for r in rows if r[0] % 2 == 0], [r for r in rows if r[0] % 2]
    toxic = [words_only(t) for _, _, t, y in first if y]
    plain = [words_only(t) for _, _, t, y in first if not y]
    if not toxic or not plain or len({y for *_, y in second}) < 2:
        return Model(b"", b"", [], size)
    grams, evidence = gram_evidence(toxic, plain)
    ordinary = _trained(ordinary_bytes, [w for t in plain for w in windows(t, size)])
    y = np.array([y for *_, y in second], float)
    tried, best, best_f1 = set(), None, -1.0
    for level in LEVELS:
        words = common_stretches([marked_stretches(t, grams[evidence >= level]) for t in toxic])
        content = toxic_content(toxic_bytes, words)
        if content in tried:
            continue
        tried.add(content)
        model = Model(ordinary, content, [], size)
        saved = [model.saved(t) for _, _, t, _ in second]
        for marked, strong in THRESHOLDS:
            model.marked, model.strong = marked, strong
            x = _shaped(np.array([model.features_of(s) for s in saved]))
            f1, cut = _held_out(x, y)
            if f1 > best_f1:
                weights = logistic(x, y)
                weights[0] += np.log(CUT / (1 - CUT)) - cut
                best, best_f1 = Model(ordinary, content, weights.tolist(), size, marked, strong), f1
    return best


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row; no shuffle."""

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([model.score(t) for t in batch.column(1).to_pylist()], pa.float64())], names=["doc_id", "score"])

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), score, "doc_id long, score double")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"), fold("doc_id", 3) != 1)
    scored = score_documents(docs, model)
    return scored.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
