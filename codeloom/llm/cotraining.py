"""Quality by co-training: a text-content and a page-metadata classifier teach each other on unlabelled documents.

Both views are fitted on a bounded sample of labelled documents. In each round they score every unlabelled document in one
pass; each view labels those it is confident of, and their features are counted by label for the other view, on the
executors and however many they are. The other view is fitted anew with what the counts say: the log ratios of its
features between the two pseudo-labelled classes, as one more regressor whose weight the labelled sample sets. In the end
each view is calibrated on labelled documents held back from fitting, and a logistic combination of both scores every
document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from codeloom.llm.common import Scratch, enter, worker_cache

#: Feature ids of the text view: words below WORDS, binned shares of characters and shape above.
TEXT_SIZE, WORDS, META_SIZE = 1 << 16, 60_000, 1 << 14
#: Signs whose share of a text is a feature each.
SIGNS = b"!|%$&*#@<>{}=_~^.,?;:-/\\()[]'\"\n"


@dataclass(frozen=True)
class Setting:
    """`labelled` bounds the labelled rows that fitting and calibration use: the first ones by a hash of doc_id. The pseudo-labels
    that views exchange have no bound."""

    labelled: int = 20_000
    rounds: int = 3
    confident: float = 0.9  # least probability of a pseudo-label, whose error must also be a quarter of a blind guess's
    seen: int = 3  # a feature counts once so many documents have it
    evidence: float = 3.0  # ... and its share in the two classes differs by so many standard errors


class _Ids(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        got = self[word] = xxhash.xxh3_64_intdigest(word) % WORDS
        return got


_ids = _Ids()
worker_cache("quality", _ids.clear)


def text_features(text: str | None) -> np.ndarray:
    """Distinct feature ids of a whole text: its words, A-Z lowered and stripped of signs, and its shape in bins."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.lower().translate(None, b"!?.,;:|%$&*\"'()[]{}<>#=~^").split()
    n, hist = max(1, len(raw)), np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    letters = max(1, int(hist[65:91].sum() + hist[97:123].sum()))
    bins = [min(15, len(raw).bit_length()), int(15 * hist[65:91].sum() / letters), int(15 * hist[48:58].sum() / n), int(15 * hist[128:].sum() / n)]
    bins += [min(15, int(2 * len(raw) / max(1, len(words)))), int(15 * len(set(words)) / max(1, len(words)))]
    lines = raw.split(b"\n")
    bins.append(int(15 * len(set(lines)) / len(lines)))
    bins += [0 if not c else min(15, 1 + int(4 + np.log2(c / n * 16)) if c / n * 16 > 0.0625 else 1) for c in hist[list(SIGNS)].tolist()]
    shape = [WORDS + 16 * k + max(0, b) for k, b in enumerate(bins)]
    return np.unique(np.array([*map(_ids.__getitem__, words), *shape], np.uint16))


def meta_features(source, lang, n_chars) -> np.ndarray:
    """Feature ids of what a page's record says without its text; nulls are values of their own."""
    size = -1 if n_chars is None else int(max(0, n_chars)).bit_length()
    said = [f"s{source}", f"l{lang}", f"n{size}", f"s{source}l{lang}", f"l{lang}n{size}", f"s{source}n{size}", "bias"]
    return np.unique(np.array([xxhash.xxh3_64_intdigest(x) % META_SIZE for x in said], np.uint16))


def feature_table(docs: DataFrame) -> DataFrame:
    """doc_id, text_ids, meta_ids (unsigned 16-bit ids) from doc_id, text, source, lang, n_chars; one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("quality")
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                some = batch.slice(at, 1000)
                ids, texts, *meta = (c.to_pylist() for c in some.columns)
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), pa.array([text_features(t).tobytes() for t in texts], pa.binary()), pa.array([meta_features(*m).tobytes() for m in zip(*meta, strict=True)], pa.binary())],
                    names=["doc_id", "text_ids", "meta_ids"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("source").cast("string"), F.col("lang").cast("string"), F.col("n_chars").cast("long")).mapInArrow(run, "doc_id long, text_ids binary, meta_ids binary")


def _rows(packed: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All feature ids and where each row's begin."""
    sizes = np.array([len(p) // 2 for p in packed], np.int64)
    return np.frombuffer(b"".join(packed), np.uint16).astype(np.int32), np.concatenate(([0], np.cumsum(sizes)))


def margins(packed: list[bytes], w: np.ndarray, b: float) -> np.ndarray:
    ids, starts = _rows(packed)
    sums = np.concatenate(([0.0], np.cumsum(w[ids])))
    return sums[starts[1:]] - sums[starts[:-1]] + b


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def telling(positive: np.ndarray, n_positive: float, negative: np.ndarray, n_negative: float, seen: int, evidence: float) -> np.ndarray:
    """Which features, by their counts in two classes of so many documents, differ between them by evidence."""
    n, count = n_positive + n_negative, positive + negative
    share = count / n
    error = np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / n_positive + 1 / n_negative))
    return (count >= seen) & (np.abs(positive / n_positive - negative / n_negative) >= evidence * error)


@dataclass
class Exchange:
    """What one view learns from the other: counts of its features over the documents that the other one is sure are of
    each class, and how many those are."""

    counts: tuple[np.ndarray, np.ndarray]
    documents: tuple[int, int]

    def ratios(self, seen: int, evidence: float, least: int = 20) -> np.ndarray:
        """Log ratios of the shares of features between the classes; zero for those without evidence, and for all while a
        class has fewer than `least` documents."""
        (negative, positive), (n0, n1) = self.counts, self.documents
        if min(n0, n1) < least:
            return np.zeros(len(positive))
        ratio = np.log((positive + 1) / (n1 + 2)) - np.log((negative + 1) / (n0 + 2))
        return np.where(telling(positive, n1, negative, n0, seen, evidence), ratio, 0.0)


def fit(packed: list[bytes], y: np.ndarray, size: int, seen: int, evidence: float, ratios: np.ndarray | None = None, steps: int = 250) -> tuple[np.ndarray, float]:
    """Logistic regression over the binary features whose classes differ by evidence, and the sum of a row's `ratios` where
    there are any; full gradients (Adam), so that the same rows give the same model. The result is one weight a feature."""
    ids, starts = _rows(packed)
    row = np.repeat(np.arange(len(y), dtype=np.int32), np.diff(starts))
    n, positive = len(y), y.sum()
    count, in_positive = np.bincount(ids, minlength=size), np.bincount(ids, y[row], size)
    used = telling(in_positive, positive, count - in_positive, n - positive, seen, evidence)
    told = np.zeros(n) if ratios is None else np.bincount(row, ratios[ids], n)
    spread = told.std()
    told = (told - told.mean()) / spread if spread > 0 else np.zeros(n)
    keep = used[ids]
    ids, row = ids[keep], row[keep]
    w, a, b = np.zeros(size), 0.0, float(np.log((positive + 1) / (n - positive + 1)))
    m, v = np.zeros(size + 2), np.zeros(size + 2)
    for step in range(1, steps + 1):
        p = sigmoid(np.bincount(row, w[ids], n) + a * told + b)
        g = np.append(np.bincount(ids, (p - y)[row], size) / n + 1e-5 * w, ((p - y) @ told / n + 1e-5 * a, (p - y).mean()))
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        w, a, b = np.where(used, w - move[:-2], 0.0), (a - move[-2] if spread > 0 else 0.0), b - move[-1]
    if ratios is None or not spread > 0:
        return w, b
    mean = np.bincount(np.repeat(np.arange(n), np.diff(starts)), ratios[_rows(packed)[0]], n).mean()
    return w + a / spread * ratios, b - a * mean / spread


def calibrate(columns: np.ndarray, y: np.ndarray, steps: int = 60) -> np.ndarray:
    """Logistic weights of the columns and a constant, by Newton steps with a small ridge (Platt's method for one column)."""
    x = np.column_stack((columns, np.ones(len(y))))
    t = np.zeros(x.shape[1])
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    for _ in range(steps):
        p = sigmoid(x @ t)
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(x.shape[1])
        t = t - np.linalg.solve(h, x.T @ (p - target) + 1e-3 * t)
    return t


@dataclass
class Model:
    views: list[tuple[np.ndarray, float]]
    platt: list[np.ndarray]
    mix: np.ndarray

    def scores(self, packed: tuple[list[bytes], list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated probabilities of the text view, the metadata view, and both."""
        z = [p[0] * margins(x, *v) + p[1] for x, v, p in zip(packed, self.views, self.platt, strict=True)]
        return sigmoid(z[0]), sigmoid(z[1]), sigmoid(np.column_stack(z) @ self.mix[:2] + self.mix[2])


SIZES = (TEXT_SIZE, META_SIZE)


@dataclass
class Sample:
    """The bounded labelled rows of one label: packed features of both views, to fit on and held back for calibration."""

    train: tuple[list[bytes], list[bytes]]
    y: np.ndarray
    held: tuple[list[bytes], list[bytes]]
    y_held: np.ndarray

    def usable(self) -> bool:
        return min(self.y.sum(), len(self.y) - self.y.sum(), self.y_held.sum(), len(self.y_held) - self.y_held.sum()) >= 2

    def model(self, setting: Setting, told: list[Exchange | None]) -> Model:
        """Fits each view with what the other one told it, then calibrates both and their combination."""
        views = []
        for packed, size, exchange in zip(self.train, SIZES, told, strict=True):
            views.append(fit(packed, self.y, size, setting.seen, setting.evidence, exchange and exchange.ratios(setting.seen, setting.evidence)))
        z = [margins(x, *v) for x, v in zip(self.held, views, strict=True)]
        platt = [calibrate(m[:, None], self.y_held) for m in z]
        mix = calibrate(np.column_stack([p[0] * m + p[1] for p, m in zip(platt, z, strict=True)]), self.y_held)
        return Model(views, platt, mix)

    def sure(self, confident: float) -> tuple[float, float]:
        """Least probability of class 0 and 1 for a pseudo-label: its error is also at most a quarter of a blind guess's."""
        share = float(self.y.mean())
        return max(confident, 1 - share / 4), max(confident, 1 - (1 - share) / 4)


def labelled_sample(table: DataFrame, label: Column, setting: Setting) -> Sample:
    """The first `labelled` rows with a label by a hash of doc_id. Hashes alone are sorted; features travel only with the rows
    that are taken."""
    known = table.withColumn("y", label).where("y IS NOT NULL").withColumn("k", F.xxhash64("doc_id", F.lit(6)))
    cut = known.select("k", "doc_id").orderBy("k", "doc_id").limit(setting.labelled).agg(F.max(F.struct("k", "doc_id")).alias("cut"), F.count("*").alias("n")).first()
    rows = []
    if cut["n"]:
        some = known if cut["n"] < setting.labelled else known.where(F.struct("k", "doc_id") <= F.struct(F.lit(cut["cut"]["k"]).alias("k"), F.lit(cut["cut"]["doc_id"]).alias("doc_id")))
        rows = sorted(some.select("k", "doc_id", "y", "text_ids", "meta_ids").collect(), key=lambda r: (r["k"], r["doc_id"], bytes(r["text_ids"]), bytes(r["meta_ids"])))
    parts = [r for i, r in enumerate(rows) if i % 4], [r for i, r in enumerate(rows) if i % 4 == 0]
    (train, held), ys = (tuple([bytes(r[c]) for r in x] for c in ("text_ids", "meta_ids")) for x in parts), [np.array([float(r["y"]) for r in x]) for x in parts]
    return Sample(train, ys[0], held, ys[1])


def exchange(table: DataFrame, labels: dict[str, Column], models: dict[str, Model], sure: dict[str, tuple[float, float]]) -> dict[str, list[Exchange]]:
    """For each label what the text view and the metadata view are told by the other, over every row of table without it.

    One pass for all labels; a task sends one row for each feature that it counted. The driver gets at most two rows for
    each feature, view and label, whatever the input."""
    names = list(models)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {(i, view, c): np.zeros(SIZES[view] + 1, np.int64) for i in range(len(names)) for view in (0, 1) for c in (0, 1)}
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                some = batch.slice(at, 1000)
                packed = some.column(0).to_pylist(), some.column(1).to_pylist()
                for i, name in enumerate(names):
                    free = some.column(2 + i).to_numpy(zero_copy_only=False)
                    own = models[name].scores(packed)[:2]
                    for view in (0, 1):  # the view that learns; the other one labels
                        p = own[1 - view]
                        for c, chosen in ((0, free & (1 - p >= sure[name][0])), (1, free & (p >= sure[name][1]))):
                            rows = np.flatnonzero(chosen)
                            if len(rows):
                                ids = _rows([packed[view][r] for r in rows])[0]
                                got = sums[i, view, c]
                                got[: SIZES[view]] += np.bincount(ids, minlength=SIZES[view])
                                got[-1] += len(rows)  # the documents, one place behind the features
        for (i, view, c), got in sums.items():
            at = np.flatnonzero(got)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), 4 * i + 2 * view + c, np.int32)), pa.array(at.astype(np.int32)), pa.array(got[at])], names=["of", "feature", "n"])

    rows = table.select("text_ids", "meta_ids", *(labels[x].isNull() for x in names)).mapInArrow(count, "of int, feature int, n long")
    got = rows.groupBy("of", "feature").agg(F.sum("n").alias("n")).toArrow()
    of, feature, n = (got.column(c).to_numpy() for c in ("of", "feature", "n"))
    out = {}
    for i, name in enumerate(names):
        out[name] = []
        for view in (0, 1):
            counts = [np.zeros(SIZES[view] + 1), np.zeros(SIZES[view] + 1)]
            for c in (0, 1):
                mine = of == 4 * i + 2 * view + c
                counts[c][feature[mine]] = n[mine]
            out[name].append(Exchange((counts[0][:-1], counts[1][:-1]), (int(counts[0][-1]), int(counts[1][-1]))))
    return out


def co_train(table: DataFrame, labels: dict[str, Column], setting: Setting = Setting()) -> dict[str, Model | None]:
    """A model for each 0/1 label (null: unlabelled) over a feature table; None if a class has fewer than two rows to fit on.

    The driver holds the labelled samples and counts of features; every round reads all rows of the table once, on the
    executors. Rounds end early once they exchange the same counts again."""
    samples = {name: labelled_sample(table, label, setting) for name, label in labels.items()}
    usable = {name: s for name, s in samples.items() if s.usable()}
    models: dict[str, Model | None] = dict.fromkeys(labels)
    models |= {name: s.model(setting, [None, None]) for name, s in usable.items()}
    last = None
    for _ in range(setting.rounds if usable else 0):
        told = exchange(table, labels, {name: models[name] for name in usable}, {name: s.sure(setting.confident) for name, s in usable.items()})
        now = {name: [x.documents for x in told[name]] for name in usable}
        if now == last:
            break
        last = now
        models |= {name: s.model(setting, told[name]) for name, s in usable.items()}
    return models


def score(table: DataFrame, models: dict[str, Model | None]) -> DataFrame:
    """table with <name>_text, <name>_meta and <name> (both views) for each model; 0.5 where there is none. Columns of table that
    have such a name give way."""
    table = table.select(*(c for c in table.columns if c not in {f"{n}{x}" for n in models for x in ("", "_text", "_meta")}))
    schema = StructType(list(table.schema.fields))
    for name in models:
        for column in (f"{name}_text", f"{name}_meta", name):
            schema = schema.add(column, "double")
    at = [table.columns.index(c) for c in ("text_ids", "meta_ids")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = tuple(batch.column(i).to_pylist() for i in at)
            more = []
            for model in models.values():
                got = model.scores(packed) if model and batch.num_rows else [np.full(batch.num_rows, 0.5)] * 3
                more += [pa.array(np.round(x, 12)) for x in got]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=schema.names)

    return table.mapInArrow(run, schema)


def quality_scores(docs: DataFrame, labels: DataFrame, scratch: Scratch, setting: Setting = Setting()) -> DataFrame:
    """doc_id, score, text_score, meta_score, toxic_score, keep for every row of docs.

    score: probability of quality; toxic_score: the same method on the toxic label; keep: score at least and toxic_score
    below one half. Labels that disagree on a document count as their larger value; without labels of both classes the
    scores are 0.5, which keeps. A null text is an empty one, null metadata are values of their own, a null doc_id is
    unlabelled, repeated rows get equal scores, an empty table gives no rows.
    """
    known = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("quality"), F.max("toxic").cast("int").alias("toxic"))
    table = scratch.table(feature_table(docs).join(known, "doc_id", "left"), "features")
    models = co_train(table, {name: F.col(name) for name in ("quality", "toxic")}, setting)
    scored = score(table.select("doc_id", "text_ids", "meta_ids"), models)
    keep = (F.col("quality") >= 0.5) & ((F.col("toxic") < 0.5) | F.lit(models["toxic"] is None))
    return scored.select("doc_id", F.col("quality").alias("score"), F.col("quality_text").alias("text_score"), F.col("quality_meta").alias("meta_score"), F.col("toxic").alias("toxic_score"), keep.alias("keep"))


def op6_cotraining_quality(spark, sf_dir: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return quality_scores(read("documents"), read("labels"), Scratch(spark, "quality"))
