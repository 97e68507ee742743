"""Quality rules and an isolation forest over their statistics (operator 1)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import binary_parts, checkpointed, small_batches

#: Rows that each tree sees, trees, and so at most TREES * TREE_ROWS rows to fit on.
TREE_ROWS, TREES = 256, 100
#: Cells of the histogram of scores from which the threshold is chosen.
SCORE_BINS = 2000
#: Share of the good labelled rows that the threshold may reject at most.
MOST_GOOD_REJECTED = 0.002

#: Range of a feature at least, so that a rule no fitted row breaks isn't an anomaly at the first hit.
LEAST_SPAN = 0.05

SYMBOLS = b"#*$%&|<>"
_SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
EXTRA = ["n_lines", "n_distinct_words", "n_stops"]


def covered_by_repeats(words: list[bytes], n: int) -> int:
    """Words inside windows of ``n`` words that are found at least twice, the first included."""
    m = len(words) - n + 1
    if m < 2:
        return 0
    number: dict[bytes, int] = {}
    code = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    key = code[:m]
    for k in range(1, n):
        key = key * len(number) + code[k : m + k]
        if k + 1 < n and int(key.max()) > 2**62 // len(number):
            _, key = np.unique(key, return_inverse=True)
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    same = ordered[1:] == ordered[:-1]
    twice = np.zeros(m, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    edge[: m] += twice
    edge[at + n] -= 1
    return int(np.count_nonzero(np.cumsum(edge[:-1])))


def text_statistics(text: bytes) -> tuple[int, ...]:
    """STATISTICS and EXTRA of one whole text. Words are runs of bytes but ASCII white space."""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip(_SPACES)]
    joined = b"".join(words)
    chars = len(joined) if joined.isascii() else len(joined.decode("utf-8"))
    symbols = len(joined) - len(joined.translate(None, SYMBOLS))
    stops = len(joined) - len(joined.translate(None, b".!?"))
    return len(words), chars, symbols, len(lines) - len(set(lines)), covered_by_repeats(words, 3), len(lines), len(set(words)), stops


def rule_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id, STATISTICS and EXTRA. Null text has no words."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            data, at = binary_parts(batch.column(1))
            rows = [text_statistics(bytes(data[a:b])) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            columns = np.array(rows, np.int64).reshape(-1, len(STATISTICS) + len(EXTRA)).T
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns)], ["id", *STATISTICS, *EXTRA])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, " + ", ".join(f"{c} bigint" for c in STATISTICS + EXTRA)).withColumnRenamed("id", id_col)


def features(columns: dict[str, np.ndarray]) -> np.ndarray:
    """The forest's inputs: shares and means, so that length alone isn't an anomaly."""
    words, chars = np.maximum(columns["n_words"], 1.0), np.maximum(columns["word_chars"], 1.0)
    return np.stack(
        [
            np.log1p(columns["n_words"]),
            columns["word_chars"] / words,
            columns["n_symbols"] / chars,
            columns["n_dup_lines"] / np.maximum(columns["n_lines"], 1.0),
            columns["n_repeat_words"] / words,
            np.log(np.maximum(columns["n_distinct_words"], 1.0)) / np.log(words + 1),
            columns["n_stops"] / words,
        ],
        1,
    )


def usual_path(n: float) -> float:
    """Mean path length of an unsuccessful search among ``n`` rows in a random binary tree."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


class IsolationForest:
    """Trees of random splits; arrays of feature, split, left child and path length by node."""

    def __init__(self, rows: np.ndarray, trees: int = TREES, tree_rows: int = TREE_ROWS, seed: int = 7):
        draw = np.random.default_rng(seed)
        size = min(tree_rows, len(rows))
        self.scale, self.trees = max(usual_path(size), 1e-9), []
        self.low, self.high = (rows.min(0), rows.max(0)) if len(rows) else (None, None)
        for _ in range(trees):
            own = rows[draw.choice(len(rows), size, replace=False)] if size else rows
            feature, split, left, path = [-1], [0.0], [0], [usual_path(len(own))]
            todo = [(0, own, 0)]
            depth_limit = int(np.ceil(np.log2(max(size, 2))))
            while todo:
                node, own, depth = todo.pop()
                wide = np.flatnonzero(own.max(0) > own.min(0)) if len(own) > 1 else []
                if depth >= depth_limit or not len(wide):
                    path[node] = depth + usual_path(len(own))
                    continue
                f = draw.choice(wide)
                at = draw.uniform(own[:, f].min(), own[:, f].max())
                below = own[:, f] < at
                feature[node], split[node], left[node] = f, at, len(feature)
                for part in (own[below], own[~below]):
                    todo.append((len(feature), part, depth + 1))
                    feature.append(-1), split.append(0.0), left.append(0), path.append(0.0)
            self.trees.append((np.array(feature), np.array(split), np.array(left), np.array(path)))

    def score(self, rows: np.ndarray) -> np.ndarray:
        """2 ** (-mean path / usual path): near 1 for rows that random splits isolate soon.

        A row outside the range of the fitted rows would share the path of the nearest edge;
        its distance outside, in ranges, counts as splits that would have cut it off.
        """
        if not len(rows) or self.low is None:
            return np.zeros(len(rows))
        total = np.zeros(len(rows))
        for feature, split, left, path in self.trees:
            node = np.zeros(len(rows), np.int64)
            while True:
                f = feature[node]
                inner = np.flatnonzero(f >= 0)
                if not len(inner):
                    break
                at = node[inner]
                node[inner] = left[at] + (rows[inner, f[inner]] >= split[at])
            total += path[node]
        span = np.maximum(self.high - self.low, LEAST_SPAN)
        outside = np.maximum(np.maximum(self.low - rows, rows - self.high) / span, 0).sum(1)
        return 2.0 ** (-total / len(self.trees) / self.scale / (1 + outside))


def scored(stats: DataFrame, forest: IsolationForest, keep: list[str]) -> DataFrame:
    """Add ``anomaly_score`` to the columns ``keep`` of rows with STATISTICS and EXTRA."""

    def run(batches):
        for batch in batches:
            columns = {c: batch.column(c).to_numpy().astype(np.float64) for c in STATISTICS + EXTRA}
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(forest.score(features(columns)))], [*keep, "anomaly_score"])

    fields = ", ".join(f"`{c}` {stats.schema[c].dataType.simpleString()}" for c in keep)
    return stats.select(*dict.fromkeys([*keep, *STATISTICS, *EXTRA])).mapInArrow(run, f"{fields}, anomaly_score double")


def base_failed():
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def choose_threshold(cells: list[tuple[int, int, int]], most_good_rejected: float) -> float:
    """The score from which rows are rejected; cells: (cell of the score, good rows, bad rows).

    Best is the largest share of bad rows less the share of good ones, with at most
    ``most_good_rejected`` of the good. Of the scores that are equally good, the middle.
    """
    good, bad = sum(c[1] for c in cells), sum(c[2] for c in cells)
    if not good or not bad:
        return float("inf")
    best, low, high, g, b = 0.0, float("inf"), float("inf"), 0, 0
    above = SCORE_BINS + 1
    for cell, own_good, own_bad in sorted(cells, reverse=True):
        gain = b / bad - g / good
        if g <= most_good_rejected * good and gain >= best and b:  # reject from just above this cell
            high = above if gain > best else high
            best, low = gain, cell + 1
        g, b, above = g + own_good, b + own_bad, cell
    return (low + high) / 2 / SCORE_BINS if best > 0 else float("inf")


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_good_rejected: float = MOST_GOOD_REJECTED, trees: int = TREES, tree_rows: int = TREE_ROWS) -> DataFrame:
    """STATISTICS, ``base_failed``, ``anomaly_score`` and ``kept`` of every row of ``docs``.

    The forest is fitted on at most ``trees * tree_rows`` rows: those labelled good
    (``quality`` 1) that pass the base rules and come first by a hash of the id. The threshold is
    chosen over all labelled rows that pass the base rules (``choose_threshold``). Of several
    labels of an id the lowest counts; null labels don't. Without labelled rows of both kinds
    nothing but the base rules rejects.
    """
    with small_batches(docs.sparkSession):
        stats = checkpointed(rule_statistics(docs, id_col, text_col))
    label = labels.where(F.col("quality").isNotNull()).groupBy(F.col(id_col)).agg(F.min("quality").alias("quality"))
    known = stats.where(~base_failed()).join(label, id_col)
    most = trees * tree_rows
    sample = known.where("quality = 1").orderBy(F.xxhash64(id_col), id_col).select(*STATISTICS, *EXTRA).limit(most).toPandas()
    forest = IsolationForest(features({c: sample[c].to_numpy(np.float64) for c in sample}) if len(sample) else np.zeros((0, 7)), trees, tree_rows)
    cell = F.floor(F.col("anomaly_score") * SCORE_BINS)
    cells = scored(known, forest, ["quality"]).groupBy(cell.alias("cell")).agg(F.sum((F.col("quality") > 0).cast("long")).alias("good"), F.count("*").alias("n")).orderBy("cell").collect()
    threshold = choose_threshold([(r.cell, r.good, r.n - r.good) for r in cells], most_good_rejected)
    out = scored(stats, forest, [id_col, *STATISTICS]).withColumn("base_failed", base_failed())
    return out.withColumn("kept", ~F.col("base_failed") & ~(F.col("anomaly_score") >= F.lit(threshold)))
