"""Toxic passages as maximum-scoring segments of token log-odds.

A token's log-odds of standing in a toxic document come from document counts under hierarchical Dirichlet priors: a word
is shrunk towards its five-letter prefix, that towards its four-letter prefix, and that towards the base rate. Every
other token costs a small drift. One linear scan (all maximal scoring segments) finds the passages. Under the
token scores of clean documents, a segment of score S in n tokens has the expected number K n exp(-lambda S)
(extreme-value statistics); what the segments exceed ln(K n) by, summed, is a document's evidence, and a logistic
curve fitted on labelled documents that gave no counts turns it into a score from 0 to 1.

The model is fitted on at most `max_rows` labelled documents, those of the smallest hash of doc_id; it grows no
further with the corpus, so it can be sent to every task. Every text is scored whole.

Defined results: null and empty texts have no evidence and get the curve's lowest score; a null doc_id counts as
held in (not held out); repeated rows are scored each; an empty table gives no rows; without usable labels every
score is 0; a text is scanned whole however long, one at a time; of equal hashes the smaller doc_id is sampled. Other columns
pass through score_documents; one that has the score's name is replaced.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from pixelspark.llm.common import discard, mixed, text_slices, written
from pixelspark.llm.near_duplicates import shingle_sets

WORD = re.compile(r"\w+")
PREFIXES = (4, 5)
COPIES = 4


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def segments(events: list[tuple[int, float]], drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last token, score), in one pass over the tokens that score above zero.

    events: (token position, score) in order; all tokens between them cost `drift`. Each candidate keeps the cumulative
    score before and after it; a new one swallows those it can be joined to with a gain.
    """
    found: list[list] = []  # first, last, sum before, sum after
    total, at = 0.0, 0
    for k, score in events:
        before = total - drift * (k - at)
        total, at = before + score, k + 1
        new = [k, k, before, total]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= new[2]:
                j = found[j][4]
            if j < 0 or found[j][3] >= new[3]:
                new.append(j)
                found.append(new)
                break
            new[0], new[2] = found[j][0], found[j][2]
            del found[j:]
    return [(a, b, after - before) for a, b, before, after, _ in found]


@dataclass
class Model:
    """Counts of the units that matter, and the calibration. Plain data, sent to the tasks."""

    base: float = 0.0
    counts: dict[str, tuple[int, int]] = field(default_factory=dict)  # unit: toxic, other documents
    prior: float = 4.0
    caution: float = 1.5
    enough: int = 5
    drift: float = 0.25
    rate: float = 1.0  # lambda
    scale: float = 0.1  # K
    curve: tuple[float, float] = (-20.0, 0.0)
    known: dict[str, float] = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"known": {}}

    def log_odds(self, word: str) -> float:
        """Of the narrowest unit that stands in `enough` documents, less `caution` standard errors."""
        p, found = self.base, None
        for unit in units(word):
            toxic, other = self.counts.get(unit, (0, 0))
            if toxic + other >= (self.enough if found is not None else 1):
                yes, no = toxic + self.prior * p, other + self.prior * (1 - p)
                found = math.log(yes / no) - self.caution * math.sqrt(1 / yes + 1 / no)
                p = min(0.9, max(self.base / 4, yes / (yes + no)))
        return 0.0 if found is None else found - math.log(self.base / (1 - self.base))

    def events(self, text: str | None) -> tuple[int, list[tuple[int, float]]]:
        words = WORD.findall(text.lower()) if text else []
        known = self.known
        if len(known) > 100_000:
            known.clear()
        for w in set(words).difference(known):
            s = self.log_odds(w) if self.counts else 0.0
            known[w] = s if s > 0.5 else 0.0
        scores = list(map(known.__getitem__, words))
        return len(words), [(k, s) for k, s in enumerate(scores) if s] if any(scores) else []

    def passages(self, text: str | None) -> tuple[int, list[tuple[int, int, float]]]:
        n, events = self.events(text)
        return n, segments(events, self.drift) if events else []

    def evidence(self, n: int, scores: list[float]) -> float:
        """What the significant segments have above the score that one in n tokens has by chance."""
        chance = math.log(max(1.0, self.scale * n))
        return sum(x for s in scores if (x := self.rate * s - chance) > 0)

    def score(self, text: str | None) -> float:
        n, found = self.passages(text)
        a, b = self.curve
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * math.log1p(self.evidence(n, [s for *_, s in found]))))))


def units(word: str) -> list[str]:
    """From the widest to the narrowest."""
    return [f"{n}:{word[:n]}" for n in PREFIXES if len(word) >= n] + [f"w:{word}"]


def sample(spark: SparkSession, docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """(text, toxic, fold) of at most max_rows labelled documents that aren't held out, one of each group of copies.

    Copies would make every word of theirs look like evidence. A document goes if one of the same label and a smaller
    hash shares one of COPIES minima of its hashed 5-word shingles, which near copies do almost surely.
    """
    kept = labels.selectExpr("cast(doc_id as long) doc_id", "toxic").where("doc_id is not null and toxic in (0, 1)").where(~held_out(F.col("doc_id")))
    chosen = kept.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    # the only read of docs; from here on at most max_rows documents (and repeats of their ids)
    rows = written(docs.selectExpr("cast(doc_id as long) doc_id", "text").join(F.broadcast(chosen), "doc_id"), "sampled")

    def minima(batches: Iterator) -> Iterator:
        import pyarrow as pa

        seeds = mixed(np.arange(1, COPIES + 1, dtype=np.uint64))
        for batch in batches:
            found = [[int(mixed(s ^ k).min() >> np.uint64(1)) for k in seeds] if len(s) else [] for _, texts in text_slices(batch) for s in shingle_sets(texts)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.list_(pa.int64()))], names=["doc_id", "minima"])

    one = rows.select("doc_id", "text").mapInArrow(minima, "doc_id long, minima array<long>").dropDuplicates(["doc_id"])
    of = Window.partitionBy("toxic", "k", "v").orderBy(F.xxhash64("doc_id"), "doc_id")
    ranked = one.join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", F.posexplode("minima").alias("k", "v")).withColumn("r", F.row_number().over(of))
    apart = ranked.groupBy("doc_id", "toxic").agg(F.max("r").alias("r")).where("r = 1")
    apart = apart.select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(10)).alias("fold"))
    own = written(rows.join(F.broadcast(apart), "doc_id").select("text", "toxic", "fold"), "sample")
    discard(rows)
    return own


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, max_rows: int = 20_000) -> Model:
    rows = sample(spark, docs, labels, max_rows)

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        # a few hundred documents at a time: a batch's units would be millions
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                toxic: Counter[str] = Counter()
                other: Counter[str] = Counter()
                n = [0, 0]
                for text, label in zip(part.column("text").to_pylist(), part.column("toxic").to_pylist(), strict=True):
                    own = {u for w in set(WORD.findall((text or "").lower())) for u in units(w)}
                    (toxic if label else other).update(own)
                    n[bool(label)] += 1
                toxic["n:"], other["n:"] = n[1], n[0]
                names = list(toxic.keys() | other.keys())
                yield pa.RecordBatch.from_pydict({"unit": names, "toxic": [toxic[u] for u in names], "other": [other[u] for u in names]})

    counted = rows.where("fold < 7").mapInArrow(count, "unit string, toxic long, other long").groupBy("unit").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    counted = written(counted.where("toxic + other >= 2 or unit = 'n:'"), "units")
    total = counted.where("unit = 'n:'").collect()
    if not total or not total[0].toxic or not total[0].other:
        discard(rows)
        return Model()
    model = Model(base=total[0].toxic / (total[0].toxic + total[0].other))
    # Units above the base rate, in two toxic documents of the bounded sample at least, and the units below such a prefix.
    raised = counted.where((F.col("toxic") >= 2) & (F.col("toxic") > 2 * model.base * (F.col("toxic") + F.col("other") + 2)))
    word = F.substring(F.col("unit"), 3, 1_000_000)
    prefix = F.explode(F.array(*(F.concat(F.lit(f"{n}:"), F.substring(word, 1, n)) for n in PREFIXES)))
    heads = raised.where("unit not like 'w:%'").select(F.col("unit").alias("prefix"))
    below = counted.withColumn("prefix", prefix).join(heads, "prefix").select("unit", "toxic", "other")
    model.counts = {r.unit: (r.toxic, r.other) for r in raised.union(below).collect()}
    discard(counted)
    calibrate(rows.where("fold >= 7"), model)
    discard(rows)
    return model


STEP = 1 / 256  # scores are counted to this


def calibrate(rows: DataFrame, model: Model) -> None:
    """Sets rate, scale and curve from documents of the sample that gave no counts.

    Scores of tokens and segments come as counts by score, whatever the texts' length; evidence as one number per document.
    """
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def measure(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            found: Counter[tuple[int, int]] = Counter()  # (0: tokens, 1: segments, 2: length, score in steps)
            for toxic, text in zip(batch.column("toxic").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if toxic:
                    continue
                n, events = sent.value.events(text)
                found[2, 0] += n
                found.update((0, round(s / STEP)) for _, s in events)
                found.update((1, round(s / STEP)) for *_, s in segments(events, sent.value.drift))
            keys = list(found)
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys], pa.int32()), pa.array([s for _, s in keys], pa.int64()), pa.array([found[k] for k in keys], pa.int64())], names=["kind", "score", "n"])

    rows = rows.selectExpr("text", "cast(toxic as int) toxic")
    table = rows.mapInArrow(measure, "kind int, score long, n long").groupBy("kind", "score").agg(F.sum("n").alias("n")).collect()
    n = sum(r.n for r in table if r.kind == 2) + 1

    def scores(kind: int) -> tuple[np.ndarray, np.ndarray]:
        """(scores, counts), the greatest first, with one chance score that looks toxic as a prior."""
        own = sorted([(r.score * STEP, r.n) for r in table if r.kind == kind] + [(6.0, 1)], reverse=True)
        return np.array([s for s, _ in own]), np.array([k for _, k in own])

    tokens, times = scores(0)
    low, high = 1e-3, 20.0
    for _ in range(60):  # sum over tokens of p exp(lambda s) = 1
        mid = (low + high) / 2
        grown = (np.exp(mid * tokens) * times).sum() / n + (n - times.sum()) / n * math.exp(-mid * model.drift)
        low, high = (mid, high) if grown < 1 else (low, mid)
    model.rate = low
    own, times = scores(1)
    above = np.cumsum(times)
    expected = np.exp(np.minimum(model.rate * own, 50.0)) * (above - (times - 1) / 2) / n  # K at which each is as rare as seen
    order = np.argsort(expected)
    middle = np.searchsorted(np.cumsum(times[order]), times.sum() / 2)
    model.scale = float(np.clip(expected[order][middle], 1e-2, 1.0))
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def weigh(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            found = [sent.value.passages(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array([sent.value.evidence(k, [s for *_, s in parts]) for k, parts in found], pa.float64())], names=["toxic", "evidence"])

    seen = rows.select("toxic", "text").mapInArrow(weigh, "toxic int, evidence double").collect()  # two numbers for each document of the sample
    x = np.log1p([r.evidence for r in seen] + [0.0, 4.0])
    y = np.array([float(r.toxic) for r in seen] + [0.0, 1.0])
    a, b = 0.0, 1.0
    for _ in range(50):  # Newton's method, slightly ridged
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))
        w = p * (1 - p) + 1e-9
        g = np.array([(y - p).sum() - 1e-2 * a, ((y - p) * x).sum() - 1e-2 * b])
        h = np.array([[w.sum() + 1e-2, (w * x).sum()], [(w * x).sum(), (w * x * x).sum() + 1e-2]])
        da, db = np.linalg.solve(h, g)
        step = min(1.0, 4 / max(1e-9, abs(da), abs(db)))
        a, b = a + step * da, b + step * db
    model.curve = (float(a), float(b))


def score_documents(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """docs with a score column added, by their text column; one pass, no shuffle. A column of that name is replaced."""
    docs = docs.select(*(c for c in docs.columns if c.lower() != name.lower()))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own = sent.value
        for batch in batches:
            scores = [own.score(t) for k in range(0, batch.num_rows, 256) for t in batch.column(at).slice(k, 256).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("cast(doc_id as long) doc_id", "text")
    model = fit(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score_documents(docs, model)
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
