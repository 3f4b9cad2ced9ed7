"""Language identification by mixture inference: the proportions of languages in a document.

Each word's likelihood under each language is the product of its byte trigrams'. For each
document, expectation-maximisation estimates the proportions of languages from its words;
of the nested sets of its likeliest languages, up to all of them, the one of best penalised
likelihood is selected. A uniform component beside the languages takes what fits none of them.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraquarry.llm import common

UNKNOWN = "und"
BUCKETS = 1 << 16
#: Trigrams overlap: a word's log-likelihood is tempered for that.
TEMPER = 0.5
#: Penalty for each further language of a set, in units of the log of the word count.
PENALTY = 1.5
#: Components whose trigrams are looked up at once.
COLUMNS = 64
#: Rounds of expectation-maximisation for each set.
ROUNDS = 8

_LETTER = re.compile(r"[^\W\d_]")
_KEEP = np.zeros(256, np.uint8)
_KEEP[[*range(97, 123), *range(128, 256)]] = [*range(97, 123), *range(128, 256)]


def word_trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigram buckets at each byte of a word; where words start among them; the first word of each text."""
    data, offsets = common.text_buffers(pc.utf8_lower(texts.fill_null("")))
    kept = _KEEP[data]
    inside = kept > 0
    starts, ends, first = common.spans(inside, offsets)
    wide = np.concatenate(([0], kept, [0])).astype(np.uint32)
    before, after = wide[:-2].copy(), wide[2:].copy()
    before[starts], after[ends - 1] = 0, 0  # no trigram reaches into a neighbouring text
    grams = (before << np.uint32(16) | wide[1:-1] << np.uint32(8) | after) * np.uint32(2654435761) >> np.uint32(16)
    lengths = ends - starts
    return grams[inside], np.concatenate(([0], np.cumsum(lengths)))[:-1], first


@dataclass
class Model:
    """Languages and, by trigram bucket, their log-probabilities and the uniform component's, last."""

    languages: list[str]
    table: np.ndarray

    def words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Tempered log-likelihoods of words by component, and the first word of each text."""
        grams, starts, first = word_trigrams(texts)
        if not len(starts):
            return np.zeros((0, self.table.shape[1]), np.float32), first
        size = self.table.shape[1]
        words = np.empty((len(starts), size), np.float32)
        for at in range(0, size, COLUMNS):
            words[:, at : at + COLUMNS] = np.add.reduceat(self.table[:, at : at + COLUMNS][grams], starts, axis=0)
        return words * np.float32(TEMPER), first

    def chunk_bytes(self) -> int:
        """Bytes of text that are judged at once: fewer the more components there are."""
        return max(1, common.CHUNK_BYTES * COLUMNS // max(COLUMNS, self.table.shape[1]))


def mixtures(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The proportions of components in each text, of the language set that is selected; zero rows without words."""
    count, size = len(first) - 1, words.shape[1]
    lengths = np.diff(first)
    some = np.flatnonzero(lengths)
    out = np.zeros((count, size))
    if not len(some):
        return out
    starts, lengths = first[some], lengths[some]
    of = np.repeat(np.arange(len(some)), lengths)
    top = words.max(1, keepdims=True)
    likely = np.exp(words - top).astype(np.float64)

    def estimate(likely: np.ndarray, of: np.ndarray, lengths: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        starts = np.cumsum(lengths) - lengths
        share = allowed / allowed.sum(1, keepdims=True)
        for _ in range(ROUNDS):
            part = likely * share[of]
            part /= np.maximum(part.sum(1, keepdims=True), 1e-300)
            share = np.add.reduceat(part, starts, axis=0) / lengths[:, None]
        mixed = np.maximum((likely * share[of]).sum(1), 1e-300)
        return share, np.add.reduceat(np.log(mixed), starts), mixed

    share, fit, mixed = estimate(likely, of, lengths, np.ones((len(some), size)))
    # the log-likelihood is concave in the proportions: its tangent here bounds that of every set
    most = fit + np.add.reduceat(likely / mixed[:, None], starts, axis=0).max(1) - lengths
    rank = np.argsort(np.argsort(-share, axis=1, kind="stable"), axis=1)
    best = np.full(len(some), -np.inf)
    chosen = np.zeros_like(share)
    for languages in range(1, size + 1):
        penalty = PENALTY * (languages - 1) * np.log(lengths + 1.0)
        able = most - penalty > best  # in the others, no set of so many languages or more can win
        if not able.any():
            break
        words_of = able[of]
        found, fit, _ = estimate(likely[words_of], np.repeat(np.arange(able.sum()), lengths[able]), lengths[able], (rank[able] < languages).astype(np.float64))
        fit = fit - penalty[able]
        better = fit > best[able] + 1e-9
        at = np.flatnonzero(able)[better]
        best[at], chosen[at] = fit[better], found[better]
    out[some] = chosen
    return out


def fit(labelled: DataFrame, *, per_language: int = 2000, smoothing: float = 0.05, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit a model to a bounded sample: about ``per_language`` rows of each label, chosen by a hash of their ids.

    Rows without a label or text are left out; every label is learned, at 256 KB of the
    model each. Without any row the model knows no language.
    """
    rows = labelled.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("lang IS NOT NULL AND text IS NOT NULL")
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(counts)
    table = np.full((BUCKETS, len(languages) + 1), -np.log(BUCKETS), np.float32)
    if not languages:
        return Model([], table)
    scale = 1 << 20
    least = F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, min(scale, -(-scale * per_language // n)))))
    sample = rows.where(F.pmod(F.xxhash64("id"), F.lit(scale)) < least[F.col("lang")]).select("text", "lang").repartition(8)

    place = {lang: i for i, lang in enumerate(languages)}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.chunks(batches):
            grams, starts, first = word_trigrams(batch.column("text"))
            edges = np.append(starts, len(grams))[first]
            own = np.array([place[lang] for lang in batch.column("lang").to_pylist()], np.int64)
            at, n = np.unique(np.repeat(own * BUCKETS, np.diff(edges)) + grams, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(n, pa.int64())], names=["cell", "n"])

    cells = sample.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # at most languages * BUCKETS rows
    cell, n = cells.column("cell").to_numpy(), cells.column("n").to_numpy()
    order = np.argsort(cell)
    cell, n = cell[order], n[order]
    edges = np.searchsorted(cell, np.arange(len(languages) + 1) * BUCKETS)
    for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        found = np.zeros(BUCKETS)
        found[cell[a:b] - i * BUCKETS] = n[a:b]
        found += smoothing
        table[:, i] = np.log(found / found.sum())
    return Model(languages, table)


def predict(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The languages of every whole text: doc_id, lang_pred, score, languages, other_share.

    lang_pred is the language of largest proportion, score that proportion, languages the
    selected set with proportions (a map), other_share what fits no learned language. A null
    text, and one without a letter, is "und" with score 0; so is every text of a model that
    knows no language. Repeated rows are judged alike; other columns are ignored; an empty
    table gives no rows.
    """
    common.tune(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    held = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(lambda b: _predict(b, held.value), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, languages map<string,double>, other_share double")


def judged(texts: pa.Array, model: Model) -> Iterator[tuple[str, float, dict[str, float], float]]:
    """Label, score, proportions and the share of none, of each text."""
    shares = mixtures(*model.words(texts))
    for text, share in zip(texts.to_pylist(), shares, strict=True):
        own = share[:-1]
        if text is None or not model.languages or not _LETTER.search(text):
            yield UNKNOWN, 0.0, {}, 0.0
            continue
        # where nothing but the uniform component was selected, the label is the first language's, with score 0
        best = int(np.argmax(own))
        yield model.languages[best], float(min(1.0, own[best])), {lang: float(s) for lang, s in zip(model.languages, own, strict=True) if s > 0}, float(share[-1])


def _predict(batches: Iterable[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in common.chunks(batches, limit=model.chunk_bytes()):
        labels, scores, sets, other = zip(*judged(batch.column("text"), model), strict=True)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(labels, pa.string()), pa.array(scores, pa.float64()), pa.array([list(s.items()) for s in sets], pa.map_(pa.string(), pa.float64())), pa.array(other, pa.float64())], names=["doc_id", "lang_pred", "score", "languages", "other_share"])


def held_out(id_col: str = "doc_id"):
    """Whether a row is kept from training: crc32 of its id as text has the remainder 2 by 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identified(docs: DataFrame, model: Model, *, other_limit: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows whose text is in learned languages, with all their columns.

    Rejected: null texts, texts without letters, and texts of which more than
    ``other_limit`` fits no learned language.
    """
    common.tune(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.chunks(batches, text_col, held.value.chunk_bytes()):
            keep = [label != UNKNOWN and other <= other_limit for label, _, _, other in judged(batch.column(at), held.value)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
