"""Quality rules as a learned decision list.

Each document gets statistics. Sequential covering learns rules that reject: a conjunction of
thresholds on statistics is grown on two thirds of a labelled sample until it covers (nearly) no
good document, pruned on the other third, kept if it is precise there, and the rows that it covers
are taken out before the next one grows. The list becomes one ordered Spark conditional expression
over the statistics' columns.

Defined cases: a null or empty text has no words and all statistics zero (and fails the base rule);
repeated rows are judged each for itself; without labelled rows of both kinds the list is empty and
only the base rule rejects; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ASCII_SPACE, map_batches, table, written

SYMBOLS = "#*$%&|<>"
WINDOW = 5
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_digits", "n_marks", "n_distinct_words")


def repeated_window_words(ids: np.ndarray, size: int, width: int = WINDOW) -> int:
    """Words that lie in a window of ``width`` words found twice or more. ids: words as numbers below ``size``."""
    n = len(ids) - width + 1
    if n < 2:
        return 0
    key, span = ids.astype(np.int64), max(2, size)
    windows, bound = key[:n].copy(), span
    for k in range(1, width):
        if bound > (1 << 62) // span:  # numbers stay exact: name the prefixes anew
            windows = np.unique(windows, return_inverse=True)[1]
            bound = int(windows.max()) + 1
        windows = windows * span + key[k : n + k]
        bound *= span
    _, inverse, counts = np.unique(windows, return_inverse=True, return_counts=True)
    twice = counts[inverse] > 1
    if not twice.any():
        return 0
    edge = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edge, np.flatnonzero(twice), 1)
    np.add.at(edge, np.flatnonzero(twice) + width, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def statistics_of(text: str | None) -> tuple[int, ...]:
    """The COUNTS of one text."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    names: dict[bytes, int] = {}
    ids = np.fromiter((names.setdefault(w, len(names)) for w in words), np.int64, len(words))
    lines = [x for x in text.split("\n") if x.strip(ASCII_SPACE)]
    kinds = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    upper, lower, digits = int(kinds[65:91].sum()), int(kinds[97:123].sum()), int(kinds[48:58].sum())
    spaces = int(sum(kinds[ord(c)] for c in ASCII_SPACE))
    chars = len(text)
    marks = int(kinds[33:127].sum()) - upper - lower - digits
    symbols = int(sum(kinds[ord(c)] for c in SYMBOLS))
    return (len(words), chars - spaces, symbols, len(lines) - len(set(lines)), repeated_window_words(ids, len(names)), len(lines), upper, upper + lower, digits, marks, len(names))


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and COUNTS of every row; no shuffle."""

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [statistics_of(t) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in zip(*rows, strict=True))], names=["doc_id", *COUNTS])

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), count, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS))


def _share(a: str, b: str) -> Column:
    return F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))




def features() -> dict[str, Column]:
    return {
        "words": F.col("n_words").cast("double"),
        "mean_word": _share("word_chars", "n_words"),
        "symbol_share": _share("n_symbols", "n_words"),
        "dup_line_share": _share("n_dup_lines", "n_lines"),
        "repeat_share": _share("n_repeat_words", "n_words"),
        "upper_share": _share("n_upper", "n_letters"),
        "digit_share": _share("n_digits", "word_chars"),
        "mark_share": _share("n_marks", "n_words"),
        "distinct_share": _share("n_distinct_words", "n_words"),
        "line_words": _share("n_words", "n_lines"),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def covers(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] >= self.threshold if self.above else x[self.feature] <= self.threshold


def _covered(rule: list[Condition], x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for c in rule:
        out &= c.covers(x)
    return out


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, longest: int) -> list[Condition]:
    """Adds the condition of the largest FOIL gain until no good row is covered."""
    rule: list[Condition] = []
    inside = np.ones(len(bad), bool)
    while len(rule) < longest and (~bad & inside).any():
        p0, n0 = (bad & inside).sum(), (~bad & inside).sum()
        best, gain = None, 0.0
        for name, column in x.items():
            values, b = column[inside], bad[inside]
            order = np.argsort(values, kind="stable")
            values, b = values[order], b[order]
            cuts = np.flatnonzero(values[1:] > values[:-1])
            if not len(cuts):
                continue
            low_bad, low_all = np.cumsum(b)[cuts], cuts + 1
            middle = (values[cuts] + values[cuts + 1]) / 2
            for above, p, n in ((False, low_bad, low_all - low_bad), (True, p0 - low_bad, n0 - (low_all - low_bad))):
                with np.errstate(divide="ignore", invalid="ignore"):
                    g = np.where(p > 0, p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0))), -1.0)
                k = int(np.argmax(g))
                if g[k] > gain + 1e-9:
                    best, gain = Condition(name, above, float(middle[k])), float(g[k])
        if best is None:
            break
        rule.append(best)
        inside &= best.covers(x)
    return rule


def learn_rules(x: dict[str, np.ndarray], bad: np.ndarray, most: int = 12, longest: int = 4, precision: float = 0.95, least: int = 3) -> list[list[Condition]]:
    """Sequential covering. Deterministic: every third row prunes, the others grow; rows are taken out as rules cover them."""
    rules: list[list[Condition]] = []
    prune = np.arange(len(bad)) % 3 == 2
    left = np.ones(len(bad), bool)
    while len(rules) < most and (bad & left & ~prune).sum() >= least:
        part = left & ~prune
        rule = _grow({k: v[part] for k, v in x.items()}, bad[part], longest)
        if not rule:
            break
        held = left & prune
        held_x = {k: v[held] for k, v in x.items()}

        def worth(r: list[Condition]) -> float:
            inside = _covered(r, held_x, int(held.sum()))  # noqa: B023
            p, n = (bad[held] & inside).sum(), (~bad[held] & inside).sum()  # noqa: B023
            return (p - n) / (p + n) if p + n else -1.0

        shorter = [rule[:k] for k in range(1, len(rule) + 1)]
        rule = max(shorter, key=lambda r: (worth(r), -len(r)))
        inside = _covered(rule, x, len(bad)) & left
        right = (bad & inside).sum()
        if right < least or right < precision * inside.sum():
            break
        rules.append(rule)
        left &= ~inside
    return rules


def decision_list(rules: list[list[Condition]]) -> Column:
    """Index (from 1) of the first rule that a row meets, else 0, as one ordered conditional expression over features()."""
    cols = features()
    out = None
    for i, rule in enumerate(rules, 1):
        test = F.lit(True)
        for c in rule:
            test = test & ((cols[c.feature] >= c.threshold) if c.above else (cols[c.feature] <= c.threshold))
        out = F.when(test, i) if out is None else out.when(test, i)
    return F.lit(0) if out is None else out.otherwise(0)


def labelled_statistics(stats: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """Features and y of at most ``rows`` labelled documents, chosen by the hash of their id; of rows that share an id, the smallest features."""
    y = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").cast("int").alias("y"))
    y = y.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    found = stats.join(F.broadcast(y), "doc_id").select("doc_id", "y", F.struct(*(c.alias(k) for k, c in features().items())).alias("found"))
    return found.groupBy("doc_id").agg(F.first("y").alias("y"), F.min("found").alias("found")).select(F.xxhash64("doc_id").alias("h"), "doc_id", "y", "found.*")


def fit_rules(stats: DataFrame, labels: DataFrame, sample_rows: int = 20_000, **how) -> list[list[Condition]]:
    """Learns from at most ``sample_rows`` labelled rows (the documented bound; a few numbers each), in the order of hashed ids."""
    sample = labelled_statistics(stats, labels, sample_rows).toPandas().sort_values(["h", "doc_id"], kind="stable")
    return learn_rules({k: sample[k].to_numpy(float) for k in features()}, sample["y"].to_numpy(int) == 0, **how)


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def judge_documents(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000) -> DataFrame:
    """doc_id, COUNTS, base_failed, rule (the first that rejects, 0 for none) and kept."""
    stats = written(document_statistics(docs), "statistics")
    rule = decision_list(fit_rules(stats, labels, sample_rows))
    return stats.withColumn("base_failed", base_failed()).withColumn("rule", rule.cast("int")).withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
