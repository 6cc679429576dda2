"""Toxicity by compression distance: which of two zstandard dictionaries shortens a text's windows more.

For each language two dictionaries are trained by zstandard on labelled documents: one on all windows of ordinary text, one on the
passages of toxic documents that set them apart (occurrences of words which toxic documents use significantly more often). The
toxic side holds the ordinary dictionary too. The common part is what makes short windows comparable: an ordinary window compresses
to the same length with either, so the difference in length (the gain, in bytes) is due to toxic wording alone.

A document is lower-cased, white space is folded, and all of it is cut at white space into windows of about ``WINDOW`` bytes.
It is held against two thresholds: the sum of positive gains over (number of windows + ``PRIOR``), and the highest such mean of
``RUN`` consecutive windows, so that a toxic passage in a very long document isn't diluted. Match finder and thresholds are
calibrated for each language on labelled documents that the dictionaries have not seen: for the first the best F1, never one that
flags more than ``MAX_FALSE`` of the ordinary ones; for the second ``RUN_MARGIN`` times the highest value of any ordinary one.

Training reads at most ``MAX_TRAIN`` labelled documents, whole, chosen by a hash of doc_id (the documented bound; of several texts of
one doc_id the lowest counts). Copies and near copies among them (the same ``NEAR`` longest words) count once, as they would make
rare words look telling. Every document of the table is then scored whole.

Scale: one narrow stage without shuffle. Training runs on executors, a task for each language; what reaches the driver and the
executors is a few dictionaries of about 20 kB each, whatever the corpus is.

Defined results: null, empty and blank texts score 0 and are not toxic; a score of 1 (a tie with the threshold) is toxic; a language
without enough labels of either kind (and a null language) uses the model over all languages; without any usable labels nothing is
toxic; repeated rows are treated alike; texts of any length are read whole; null labels and ids are ignored; further columns are
ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, small_batches

WINDOW = 56
PRIOR = 3
BASE_BYTES = 16_384
TOXIC_BYTES = 2048
MAX_TRAIN = 8000
TASKS = 16
MAX_FALSE = 0.015
LEAST_LABELS = 6  # toxic documents that a language needs for a model of its own
Z_SCORE, LEAST_RATIO, LEAST_DOCS = 4.0, 4.0, 4
NEAR = 8
RUN, RUN_MARGIN = 8, 1.5
#: (strategy, shortest match): quick and coarse, or near-optimal and fine. Calibration picks one for each language.
FINDERS = ((zstandard.STRATEGY_LAZY, 4), (zstandard.STRATEGY_BTOPT, 3))
_WINDOW = re.compile(rb"(?s).{1,%d}\S*\s*" % WINDOW)
_WORD = re.compile(r"[^\W\d_]+")


def windows(text: str | None) -> list[bytes]:
    return _WINDOW.findall(" ".join(text.lower().split()).encode()) if text else []


@dataclass
class Model:
    base: bytes
    toxic: bytes
    finder: tuple[int, int] = FINDERS[0]
    threshold: float = float("inf")
    run_threshold: float = float("inf")

    def scorer(self):
        """Function: text -> (mean gain of all windows, highest mean gain of a run of windows)."""
        strategy, shortest = self.finder
        how = zstandard.ZstdCompressionParameters(
            window_log=18, chain_log=16, hash_log=16, search_log=4, min_match=shortest, target_length=16, strategy=strategy,
            write_content_size=0, write_checksum=0, write_dict_id=0,
        )
        sides = []
        for content in (self.base, self.toxic + self.base):
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=how)
            sides.append(zstandard.ZstdCompressor(dict_data=d, compression_params=how).compress)
        plain, toxic = sides

        def score(text: str | None) -> tuple[float, float]:
            gains = [max(0, len(plain(part)) - len(toxic(part))) for part in windows(text)]
            whole = sum(gains) / (len(gains) + PRIOR)
            if len(gains) <= RUN:
                return whole, whole
            run = top = sum(gains[:RUN])
            for old, new in zip(gains, gains[RUN:]):
                run += new - old
                if run > top:
                    top = run
            return whole, top / (RUN + PRIOR)

        return score

    def relative(self):
        """Function: text -> score relative to the thresholds; from 1 on it is toxic."""
        score = self.scorer()

        def one(text: str | None) -> float:
            whole, run = score(text)
            return max(whole / self.threshold, run / self.run_threshold)

        return one


def telling_words(texts: list[str], toxic: np.ndarray) -> dict[str, float]:
    """Words in significantly more toxic than ordinary documents, with their z-scores."""
    seen: tuple[Counter, Counter] = (Counter(), Counter())
    known: set[tuple] = set()
    for text, label in zip(texts, toxic):
        own = set(_WORD.findall(text.lower()))
        long = sorted(own, key=lambda w: (-len(w), w))
        marks = {(int(label), *long[:NEAR])} | ({(int(label), *long[NEAR : 2 * NEAR])} if len(long) >= 2 * NEAR else set())
        if marks.isdisjoint(known):
            known |= marks
            seen[int(label)].update(own)
    yes, no = max(1, int(toxic.sum())), max(1, int((toxic == 0).sum()))
    found = {}
    for word, n in seen[1].items():
        other = seen[0][word]
        p = (n + other) / (yes + no)
        if n < LEAST_DOCS or p >= 1 or n / yes < LEAST_RATIO * (other + 1) / no:
            continue
        z = (n / yes - other / no) / (p * (1 - p) * (1 / yes + 1 / no)) ** 0.5
        if z >= Z_SCORE:
            found[word] = z
    return found


def trained(size: int, samples: list[bytes]) -> bytes:
    """A zstandard dictionary; with too little text to train on, the text itself."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def toxic_passages(texts: list[str], words: dict[str, float]) -> list[bytes]:
    """For each text its telling words in order of occurrence."""
    found = []
    for text in texts:
        if own := [w for w in _WORD.findall(text.lower()) if w in words]:
            found.append("".join(f" {w} " for w in own).encode())
    return found


def fit(texts: list[str], toxic: np.ndarray) -> Model | None:
    """A model from two thirds of the texts, calibrated on the rest; None without enough of either kind."""
    # copies say nothing new: one of each text and label
    distinct = list(dict.fromkeys(zip(texts, np.asarray(toxic).tolist())))
    texts, toxic = [t for t, _ in distinct], np.array([x for _, x in distinct], np.int64)
    held = np.arange(len(texts)) % 3 == 2
    if min(toxic[~held].sum(), (1 - toxic[~held]).sum()) < LEAST_LABELS or not toxic[held].any() or toxic[held].all():
        return None
    own = [t for t, h in zip(texts, held) if not h]
    words = telling_words(own, toxic[~held])
    if not words:
        return None
    base = trained(BASE_BYTES, [w for t, label in zip(own, toxic[~held]) if not label for w in windows(t)])
    passages = toxic_passages([t for t, label in zip(own, toxic[~held]) if label], words)
    telling = trained(TOXIC_BYTES, passages)
    best, kept = -1.0, None
    truth = toxic[held]
    for finder in FINDERS:
        model = Model(base, telling, finder)
        score = model.scorer()
        s, runs = np.array([score(t) for t, h in zip(texts, held) if h]).T
        run_threshold = RUN_MARGIN * float(max(runs[truth == 0].max(), runs[truth == 1].min()))
        for threshold in np.unique(s[s > 0]):
            flagged = (s >= threshold) | (runs >= run_threshold)
            hit, false = int((flagged & (truth == 1)).sum()), int((flagged & (truth == 0)).sum())
            f1 = 2 * hit / (flagged.sum() + truth.sum())
            if false <= MAX_FALSE * (truth == 0).sum() and f1 > best:
                below = s[s < threshold]
                best = f1
                kept = Model(base, telling, finder, float((threshold + below.max()) / 2 if len(below) else threshold), run_threshold)
    return kept


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> dict[str | None, Model]:
    """Models by language, and one over all under None; each is trained by a task of its own."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    language = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = docs.select("doc_id", "text", language.alias("lang")).where("text is not null").join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("text", "lang", "toxic")).alias("r")).select("doc_id", "r.*")
    own = F.when(F.col("lang").isNotNull(), F.concat(F.lit("="), "lang"))
    placed = rows.select("doc_id", "text", "toxic", F.explode(F.array_compact(F.array(F.lit("all"), own))).alias("model"))

    def one(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending")])
        found = fit(table["text"].to_pylist(), np.array([int(x > 0) for x in table["toxic"].to_pylist()], np.int64))
        return pa.table({"model": pa.array([key[0].as_py()][: found is not None], pa.string()), "fitted": pa.array([pickle.dumps(found)][: found is not None], pa.binary())})

    spread = placed.repartition(TASKS, "model")  # a number of tasks of its own, so that languages train side by side
    fitted = spread.groupBy("model").applyInArrow(one, "model string, fitted binary").collect()
    return {None if r.model == "all" else r.model[1:]: pickle.loads(r.fitted) for r in fitted}


def classify(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """(doc_id, toxic_score, toxic) of every document; the score is relative to its language's threshold, 1 is toxic."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, max_train))

    @F.arrow_udf(T.DoubleType())
    @lean
    def relative(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        scorers = {lang: m.relative() for lang, m in shared.value.items()}
        rest = scorers.get(None, lambda text: 0.0)
        for texts, langs in batches:
            yield pa.array([scorers.get(lang, rest)(text.as_py()) for text, lang in zip(texts, langs.to_pylist())], pa.float64())

    language = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    scored = docs.select("doc_id", relative(F.col("text"), language).alias("toxic_score"))
    return scored.select("doc_id", "toxic_score", (F.col("toxic_score") >= 1).alias("toxic"))
