"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framedrift.llm.common import fold, settle

WORDS = re.compile(r"[^\W\d_]+")
STEMS = (3, 4, 5, 6, 7, 8)  # letters of the word starts that are features of their own
LABELLED = 12_000  # labelled rows that the lexicons are drawn from, about
FITTED = 12_000  # rows that the classifier is fitted on, about
LEXICON = 400  # entries at most
FEATURES = 4_000  # of the classifier at most
PURE = 0.8  # least share of toxic rows among those with a lexicon entry
SURE = 25.0  # least log-likelihood ratio of a feature that is used
WORD_VOTERS, STEM_VOTERS = 8, 4
PATTERNS = (
    re.compile(r"!{2,}"),
    re.compile(r"\b[A-Z]{4,}\b(?:\W+[A-Z]{3,}\b){2}"),
    re.compile(r"(?i:\byou(?:'re| are)?\s+(?:an?|all|such)\b)"),
    re.compile(r"\b\w+[*@#$]+\w+\b"),
    re.compile(r"(\w)\1{3,}"),
)
VOTERS = WORD_VOTERS + STEM_VOTERS + len(PATTERNS)


def features(text: str | None) -> set[str]:
    """Distinct lower-case words, starts of longer words (a star), and starts that two or more have (two stars)."""
    words = set(WORDS.findall((text or "").lower()))
    found = set(words)
    for k in STEMS:
        for start, n in Counter([w[:k] for w in words if len(w) > k]).items():
            found.add(start + "*")
            if n > 1:
                found.add(start + "**")
    return found


def voter_of(entry: str) -> int:
    """Lexicon entries are dealt to voters by a hash, words and stems apart."""
    h = zlib.crc32(entry.encode())
    return WORD_VOTERS + h % STEM_VOTERS if entry.endswith("*") else h % WORD_VOTERS


def votes(text: str | None, lexicon: dict[str, int]) -> int:
    """Bit v is set if voter v marks the text."""
    mask = 0
    for entry in features(text) & lexicon.keys():
        mask |= 1 << lexicon[entry]
    for v, p in enumerate(PATTERNS, WORD_VOTERS + STEM_VOTERS):
        mask |= bool(p.search(text or "")) << v
    return mask


def association(table: DataFrame, ones: float, zeros: float) -> DataFrame:
    """Adds ``g``, the log-likelihood ratio of a feature and the class, negative if it speaks for zero.

    ``a`` and ``b`` are the weights of the ones and zeros that have the feature.
    """
    total = ones + zeros
    table = table.withColumns({"_ar": ones - F.col("a"), "_br": zeros - F.col("b"), "_n": F.col("a") + F.col("b")})

    def term(cell: str, row: str, column: float) -> Column:
        expected = F.expr(row) * (column / total)
        return F.when((F.col(cell) > 0) & (expected > 0), F.col(cell) * F.log(F.col(cell) / expected)).otherwise(0.0)

    rest = f"{total!r}D - _n"
    g = 2 * (term("a", "_n", ones) + term("b", "_n", zeros) + term("_ar", rest, ones) + term("_br", rest, zeros))
    above = F.col("a") * zeros > F.col("b") * ones
    return table.withColumn("g", F.when(above, g).otherwise(-g)).drop("_ar", "_br", "_n")


class LabelModel:
    """Class-conditional trees over binary voters, fitted by expectation maximisation.

    For each class, every voter depends on the class and on one other voter, the tree being the one
    of greatest mutual information, so voters that err together do not count twice. ``masks`` are the
    vote patterns seen, ``n`` their row counts, ``known`` the counts [mask, class] of labelled rows among them.
    """

    def __init__(self, masks: np.ndarray, n: np.ndarray, known: np.ndarray, rounds: int = 40):
        self.votes = (masks[:, None] >> np.arange(VOTERS)) & 1
        free = np.maximum(n - known.sum(axis=1), 0)
        lexical = self.votes[:, : WORD_VOTERS + STEM_VOTERS].any(axis=1)
        posterior = np.where(lexical, 0.9, 0.05)
        for i in range(rounds):
            # The labelled rows begin alone, if there are any of both classes.
            others = free * (i > 0 or known.sum(axis=0).min() == 0)
            weight = np.stack([others * (1 - posterior), others * posterior], axis=1) + known
            self.prior = (weight.sum(axis=0) + 1) / (weight.sum() + 2)
            if i < 5:
                self.trees = [self._tree(weight[:, y]) for y in (0, 1)]
            self.tables = [self._tables(weight[:, y], self.trees[y]) for y in (0, 1)]
            posterior = self._posterior()
        self.posterior = posterior
        share = [(self.votes * w[:, None]).sum(axis=0) / max(1e-9, w.sum()) for w in weight.T]
        self.accuracy = self.prior[1] * share[1] + self.prior[0] * (1 - share[0])

    def _pairs(self, w: np.ndarray) -> np.ndarray:
        """Joint chances [u, v, vote of u, vote of v], smoothed."""
        sides = (1 - self.votes, self.votes)
        joint = np.array([[(a * w[:, None]).T @ b for b in sides] for a in sides]).transpose(2, 3, 0, 1) + 0.25
        return joint / joint.sum(axis=(2, 3), keepdims=True)

    def _tree(self, w: np.ndarray) -> list[int]:
        """Parent of each voter in a spanning tree of greatest mutual information; -1 at the root, voter 0."""
        joint = self._pairs(w)
        alone = joint.sum(axis=3)
        gain = (joint * np.log(joint / (alone[..., None] * joint.sum(axis=2)[:, :, None, :]))).sum(axis=(2, 3))
        parent, best = [-1] * VOTERS, gain[0].copy()
        nearest, inside = np.zeros(VOTERS, int), {0}
        while len(inside) < VOTERS:
            v = max((u for u in range(VOTERS) if u not in inside), key=lambda u: best[u])
            parent[v] = int(nearest[v])
            inside.add(v)
            nearest = np.where(gain[v] > best, v, nearest)
            best = np.maximum(best, gain[v])
        return parent

    def _tables(self, w: np.ndarray, parents: list[int]) -> np.ndarray:
        """log chance [voter, vote of its parent, its vote]."""
        out = np.zeros((VOTERS, 2, 2))
        for v, p in enumerate(parents):
            above = self.votes[:, p] if p >= 0 else np.zeros(len(w), int)
            np.add.at(out[v], (above, self.votes[:, v]), w)
        out += 0.5
        return np.log(out / out.sum(axis=2, keepdims=True))

    def _posterior(self) -> np.ndarray:
        logs = []
        for y in (0, 1):
            total = np.full(len(self.votes), np.log(self.prior[y]))
            for v, p in enumerate(self.trees[y]):
                above = self.votes[:, p] if p >= 0 else 0
                total = total + self.tables[y][v][above, self.votes[:, v]]
            logs.append(total)
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


def fit_linear(rows: list[np.ndarray], target: np.ndarray, size: int, rounds: int = 300, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression on soft labels; the last weight is the intercept. Full-batch AdaGrad."""
    of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    at = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
    weights, squares = np.zeros(size + 1), np.full(size + 1, 1e-3)
    for _ in range(rounds):
        margin = np.bincount(of, weights[at], minlength=len(rows)) + weights[-1]
        error = 1 / (1 + np.exp(-np.clip(margin, -500, 500))) - target
        slope = np.append(np.bincount(at, error[of], minlength=size) + ridge * weights[:-1], error.sum())
        squares += slope**2
        weights -= 0.5 * slope / np.sqrt(squares)
    return weights


def _per_batch(docs: DataFrame, schema: str, work: Callable[[dict], dict]) -> DataFrame:
    """mapInArrow from columns as lists to columns as lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict(work(batch.to_pydict()))

    return docs.mapInArrow(run, schema)


def _feature_counts(docs: DataFrame) -> DataFrame:
    """(feature, a, b) from rows (_text, _y): weight of ones and zeros whose text has the feature."""

    def work(columns: dict) -> dict:
        ones, zeros = Counter(), Counter()
        for text, y in zip(columns["_text"], columns["_y"], strict=True):
            for f in features(text):
                ones[f] += y
                zeros[f] += 1 - y
        return {"feature": list(ones), "a": [float(x) for x in ones.values()], "b": [float(zeros[f]) for f in ones]}

    counts = _per_batch(docs.select("_text", F.col("_y").cast("double").alias("_y")), "feature string, a double, b double", work)
    return counts.groupBy("feature").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


def _drawn(rows: DataFrame, most: int, total: int) -> DataFrame:
    """About ``most`` rows, those whose hash ``_order`` falls below the share."""
    return rows.where(F.pmod("_order", F.lit(1 << 20)) / (1 << 20) < most / max(most, total))


def _once(rows: DataFrame) -> DataFrame:
    """Of rows (_key, _text, _y) with equal text, the one with the least key."""
    first = F.min(F.struct("_key", "_text", "_y")).alias("_first")
    return rows.groupBy(F.sha2(F.coalesce("_text", F.lit("")), 256).alias("_h")).agg(first).select("_first.*")


def train(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str) -> tuple[dict[str, float], float]:
    """(weights of features, intercept), learned from rows whose fold is not 0."""
    spark = docs.sparkSession
    marked = labels.where((fold(key) != 0) & F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(
        F.col(key).alias("_key")
    ).agg(F.max(label).cast("int").alias("_y")).withColumn("_order", F.xxhash64("_key"))
    marked = settle(marked)
    anchors = settle(_drawn(marked, LABELLED, marked.count()).select("_key", "_y"))
    pool = docs.where(fold(key) != 0).select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    # About LABELLED rows, so bounded. Copies of a text count once, or its words would look decisive.
    labelled = settle(_once(pool.join(F.broadcast(anchors), "_key")))
    sizes = {r["_y"]: r["count"] for r in labelled.groupBy("_y").count().collect()}
    ones, zeros = sizes.get(1, 0), sizes.get(0, 0)
    if not ones or not zeros:
        return {}, float(np.log((ones + 1e-3) / (zeros + 1e-3))) if ones + zeros else -10.0

    scored = association(_feature_counts(labelled).where("a >= 3"), float(ones), float(zeros)).where((F.col("g") > SURE) & (F.col("a") >= PURE * (F.col("a") + F.col("b"))))
    entries = [r.feature for r in scored.orderBy(F.desc("g"), "feature").limit(LEXICON).select("feature").collect()]
    lexicon = {e: voter_of(e) for e in entries}

    def vote(columns: dict) -> dict:
        masks = [votes(t, lexicon) for t in columns["_text"]]
        return {"_key": columns["_key"], "mask": masks, "_order": columns["_order"]}

    kind = docs.schema[key].dataType.simpleString()
    hashed = pool.withColumn("_order", F.xxhash64("_key", F.lit(1)))
    cast = _per_batch(hashed, f"_key {kind}, mask long, _order long", vote)
    cast = settle(cast.join(F.broadcast(anchors), "_key", "left"))
    # At most 2 ** VOTERS patterns, whatever the number of rows.
    seen = cast.groupBy("mask").agg(
        F.count("*").alias("n"), *[F.count(F.when(F.col("_y") == y, 1)).alias(f"y{y}") for y in (0, 1)]
    ).orderBy("mask").toPandas()
    model = LabelModel(seen["mask"].to_numpy(), seen["n"].to_numpy(float), seen[["y0", "y1"]].to_numpy(float))
    posterior = spark.createDataFrame(pd.DataFrame({"mask": seen["mask"], "_y": model.posterior}))

    chosen = _drawn(cast.drop("_y"), FITTED, int(seen["n"].sum())).join(F.broadcast(posterior), "mask").select("_key", "_y")
    fitted = settle(_once(pool.join(F.broadcast(chosen.dropDuplicates(["_key"])), "_key")))
    sums = fitted.agg(F.sum("_y").alias("one"), F.count("*").alias("n")).first()
    best = association(_feature_counts(fitted).where("a + b >= 3"), sums.one, sums.n - sums.one).where(F.abs("g") > SURE)
    names = [r.feature for r in best.orderBy(F.desc(F.abs("g")), "feature").limit(FEATURES).select("feature").collect()]
    index = {f: i for i, f in enumerate(names)}

    def active(columns: dict) -> dict:
        found = [sorted(index[f] for f in features(t) & index.keys()) for t in columns["_text"]]
        return {"_y": columns["_y"], "active": pa.array(found, pa.list_(pa.int32()))}

    rows = _per_batch(fitted.select("_text", "_y"), "_y double, active array<int>", active).toArrow()
    rows = rows.combine_chunks()
    weights = fit_linear([np.array(x, np.int64) for x in rows["active"].to_pylist()], rows["_y"].to_numpy(), len(names))
    return dict(zip(names, weights[:-1].tolist(), strict=True)), float(weights[-1])


def score_toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """Adds ``held_out``, ``score`` (0 to 1) and ``predicted`` to (key) of every row of ``docs``.

    Lexicons of words and word starts come from about LABELLED labelled rows. Their entries, dealt to
    voters, and fixed patterns vote on every training row; a generative model of the vote patterns
    estimates how accurate the voters are and which err together, the labelled rows anchoring it. A
    logistic regression on word features is fitted to its posteriors on about FITTED rows, and scores
    every whole text. Rows whose crc32(key) mod 5 is 0 are never learned from.

    Null and empty texts have no features and score by the intercept. Without labels of both kinds
    the score is the same for all. Conflicting labels of a key count as toxic; labels without key or
    value are left out. Repeated rows score alike. Long texts are read whole; an empty table gives no rows.
    Other columns are not read.
    """
    weights, intercept = train(docs, labels, key, text, label)
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def score(columns: dict) -> dict:
        w = shared.value
        margins = [intercept + sum(w[f] for f in features(t) & w.keys()) for t in columns["_text"]]
        scores = 1 / (1 + np.exp(-np.clip(np.array(margins), -500, 500)))
        return {"_key": columns["_key"], "held_out": columns["_held"], "score": scores, "predicted": (scores >= 0.5).astype(np.int32)}

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"), (fold(key) == 0).alias("_held"))
    return _per_batch(rows, f"_key {kind}, held_out boolean, score double, predicted int", score).withColumnRenamed("_key", key)
