"""HTML extraction: a recurrent labeller decides on every leaf block in the context of its page.

Pages become sequences of blocks (``blocks``). A bidirectional LSTM in NumPy reads each
block's tag path (the elements above it, hashed), its words (hashed, as shares) and a few
measures, from both ends of the page, and says whether the block is main text. It is trained
on 2,400 drawn layouts (``layouts``) with texts of a bounded sample of the pages, on the driver;
the model (under 0.5 MB) is broadcast, and one map pass labels all pages.

Pages of one batch run together, in order of their lengths. Of a page of any length the
state of ``STEPS`` blocks at a time is held: the forward pass notes its state at each such
border and is made again while the backward pass comes by. A page's blocks are held whole.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraquarry.llm import blocks, common, layouts

HIDDEN = 20
MEASURES = 9
INPUT = blocks.ABOVE + blocks.NEAR + blocks.WORDS + MEASURES
#: Blocks of a page whose states are held at once; blocks of a batch of pages.
STEPS, TOGETHER = 2048, 1 << 14


def inputs(page: list[blocks.Block], start: int = 0, end: int | None = None) -> np.ndarray:
    """The vectors of some of a page's blocks."""
    own = page[start:end]
    out = np.zeros((len(own), INPUT), np.float32)
    for row, block in zip(out, own, strict=True):
        row[list(block.above)] = 1
        if block.near:
            row[[blocks.ABOVE + b for b in block.near]] = 1
        words = block.words()
        at = blocks.ABOVE + blocks.NEAR
        if words:
            row[at : at + blocks.WORDS] = np.bincount(words, minlength=blocks.WORDS) * (2 / np.sqrt(len(words)) / np.sqrt(1 + len(words) / 8))
        text, size = block.text, len(block.text)
        row[at + blocks.WORDS :] = (
            1,
            block.linked,
            np.log1p(len(words)) / 4,
            min(1.0, 8 * sum(map(text.count, ".!?")) / size),
            min(1.0, 20 * text.count(",") / size),
            text[-1] in ".!?…:\"”",
            text[:1].isupper(),
            block.linked * np.log1p(len(words)) / 4,
            len(words) == 0,
        )
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Model:
    """Weights: inputs to the gates of both directions, state to gates by direction, states to the answer."""

    inward: np.ndarray  # INPUT x (2 * 4 * HIDDEN)
    across: np.ndarray  # 2 x HIDDEN x (4 * HIDDEN)
    outward: np.ndarray  # 2 * HIDDEN + 1
    threshold: float = 0.5

    def walk(self, gates: np.ndarray, mask: np.ndarray, way: int, state: tuple[np.ndarray, np.ndarray], keep: list | None = None) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
        """The hidden states of some steps in one direction, and the state after them; masked steps leave it at zero."""
        h, c = state
        out = np.zeros((*gates.shape[:2], HIDDEN), np.float32)
        for t in range(len(gates)) if way == 0 else range(len(gates) - 1, -1, -1):
            z = gates[t] + h @ self.across[way]
            s, g = _sigmoid(z[:, : 3 * HIDDEN]), np.tanh(z[:, 3 * HIDDEN :])
            i, f, o = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :]
            before = (h, c)
            c = (f * c + i * g) * mask[t]
            v = np.tanh(c)
            h = o * v * mask[t]
            out[t] = h
            if keep is not None:
                keep.append((t, before, i, f, o, g, v))
        return out, (h, c)

    def scores(self, pages: list[list[blocks.Block]]) -> list[np.ndarray]:
        """The probability of main text of every block of some pages."""
        sizes = np.array([len(p) for p in pages])
        most, count = int(sizes.max(initial=0)), len(pages)
        width = 4 * HIDDEN
        zero = (np.zeros((count, HIDDEN), np.float32),) * 2
        borders = list(range(0, most, STEPS))

        def window(start: int) -> tuple[np.ndarray, np.ndarray]:
            end = min(most, start + STEPS)
            gates, mask = np.zeros((end - start, count, 2 * width), np.float32), np.zeros((end - start, count, 1), np.float32)
            for at, page in enumerate(pages):
                own = inputs(page, start, end)
                gates[: len(own), at] = own @ self.inward
                mask[: len(own), at] = 1
            return gates, mask

        states, held = [zero], None
        for start in borders[:-1]:
            gates, mask = window(start)
            states.append(self.walk(gates[:, :, :width], mask, 0, states[-1])[1])
        out, back = [np.empty(n, np.float32) for n in sizes], zero
        for start, state in zip(reversed(borders), reversed(states[: len(borders)]), strict=True):
            gates, mask = window(start)
            ahead, _ = self.walk(gates[:, :, :width], mask, 0, state)
            behind, back = self.walk(gates[:, :, width:], mask, 1, back)
            held = _sigmoid(ahead @ self.outward[:HIDDEN] + behind @ self.outward[HIDDEN:-1] + self.outward[-1])
            for at, n in enumerate(sizes):
                stop = min(int(n), start + len(gates))
                if stop > start:
                    out[at][start:stop] = held[: stop - start, at]
        return out

    def label(self, pages: list[list[blocks.Block]]) -> list[np.ndarray]:
        """Whether each block is main text; pages of like lengths run together."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i]))
        while order:
            count = 1
            while count < len(order) and (count + 1) * min(STEPS, len(pages[order[count]])) <= TOGETHER and len(pages[order[count]]) <= STEPS:
                count += 1
            for i, s in zip(order[:count], self.scores([pages[i] for i in order[:count]]), strict=True):
                out[i] = s >= self.threshold
            del order[:count]
        return out


def train(examples: list[tuple[list[blocks.Block], list[bool]]], *, rounds: int = 12, batch: int = 32, rate: float = 0.01, seed: int = 5) -> Model:
    """Fit a model to labelled pages by Adam on the cross-entropy of their blocks, back through both directions.

    In part of the pages of each round all hashed words, or all names near the blocks, are
    left out, so that neither alone decides.
    """
    rng = np.random.default_rng(seed)
    width = 4 * HIDDEN
    model = Model(
        rng.normal(0, 0.08, (INPUT, 2 * width)).astype(np.float32),
        rng.normal(0, 0.15, (2, HIDDEN, width)).astype(np.float32),
        np.append(rng.normal(0, 0.3, 2 * HIDDEN), 0).astype(np.float32),
    )
    parts = [model.inward, model.across, model.outward]
    first, second = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    vectors = [inputs(p) for p, _ in examples]
    sizes = np.array([len(v) for v in vectors])
    steps, total = 0, rounds * -(-len(examples) // batch)
    words = slice(blocks.ABOVE + blocks.NEAR, blocks.ABOVE + blocks.NEAR + blocks.WORDS)
    for _ in range(rounds):
        order = np.argsort(sizes + rng.uniform(0, 8, len(sizes)), kind="stable")  # like lengths together
        groups = [order[i : i + batch] for i in range(0, len(order), batch)]
        for g in rng.permutation(len(groups)):
            own = groups[g]
            most = int(sizes[own].max())
            x, mask, y = np.zeros((most, len(own), INPUT), np.float32), np.zeros((most, len(own), 1), np.float32), np.zeros((most, len(own)), np.float32)
            for at, i in enumerate(own):
                n = sizes[i]
                x[:n, at], mask[:n, at], y[:n, at] = vectors[i], 1, examples[i][1]
                if rng.random() < 0.3:
                    x[:n, at, words] = 0
                if rng.random() < 0.15:
                    x[:n, at, blocks.ABOVE : blocks.ABOVE + blocks.NEAR] = 0
            grads = _gradients(model, x, mask, y)
            steps += 1
            pace = rate * min(1, steps / 20) * (1 - 0.9 * steps / total)
            for p, grad, m, v in zip(parts, grads, first, second, strict=True):
                m += 0.1 * (grad - m)
                v += 0.01 * (grad * grad - v)
                p -= pace * (m / (1 - 0.9**steps)) / (np.sqrt(v / (1 - 0.99**steps)) + 1e-8)
    return model


def _gradients(model: Model, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    most, count, _ = x.shape
    width = 4 * HIDDEN
    gates = (x.reshape(-1, INPUT) @ model.inward).reshape(most, count, 2 * width)
    zero = (np.zeros((count, HIDDEN), np.float32),) * 2
    kept: tuple[list, list] = ([], [])
    states = [model.walk(gates[:, :, w * width : (w + 1) * width], mask, w, zero, kept[w])[0] for w in (0, 1)]
    both = np.concatenate(states, 2)
    error = (_sigmoid(both @ model.outward[:-1] + model.outward[-1]) - y) * mask[:, :, 0] / mask.sum()
    outward = np.append(np.tensordot(both, error, ((0, 1), (0, 1))), error.sum()).astype(np.float32)
    dgates, across = np.zeros_like(gates), np.zeros_like(model.across)
    for way in (0, 1):
        dh_next, dc_next = np.zeros((count, HIDDEN), np.float32), np.zeros((count, HIDDEN), np.float32)
        for t, (h, c), i, f, o, g, v in reversed(kept[way]):
            dh = (error[t][:, None] * model.outward[way * HIDDEN : (way + 1) * HIDDEN] + dh_next) * mask[t]
            dc = (dh * o * (1 - v * v) + dc_next) * mask[t]
            dz = np.concatenate((dc * g * i * (1 - i), dc * c * f * (1 - f), dh * v * o * (1 - o), dc * i * (1 - g * g)), 1)
            dgates[t, :, way * width : (way + 1) * width] = dz
            across[way] += h.T @ dz
            dh_next, dc_next = dz @ model.across[way].T, dc * f
    inward = x.reshape(-1, INPUT).T @ dgates.reshape(-1, 2 * width)
    norm = np.sqrt(sum(float((p * p).sum()) for p in (inward, across, outward)))
    scale = np.float32(min(1.0, 1.0 / (norm + 1e-9)))
    return [inward * scale, across * scale, outward * scale]


def vocabulary(pages: DataFrame, rows: int = 200, chars: int = 4096) -> list[str]:
    """Words of the blocks of at most about ``rows`` distinct pages, of each from ``chars`` characters at its middle."""
    middle = F.expr(f"substring(text, greatest(1, cast(length(text) / 2 - {chars // 2} AS int)), {chars})")
    out: list[str] = []
    for row in common.sampled_texts(pages.select("doc_id", middle.alias("text")), rows).collect():
        for block in blocks.read(row.text):
            out += block.text.split()
    return out


def fit(pages: DataFrame, *, layouts_drawn: int = 2400, rows: int = 200, seed: int = 11, id_col: str = "page_id", html_col: str = "html") -> Model:
    """A labeller for ``pages``: layouts are drawn, their words are of a bounded sample of the pages (``vocabulary``)."""
    common.tune(pages.sparkSession)
    return train(layouts.pages(layouts_drawn, vocabulary(common.documents(pages, id_col, html_col), rows), seed))


def extract(pages: DataFrame, model: Model, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The main text of every page: page_id, url, text, n_chars (code points), n_blocks, n_kept.

    Blocks that the model takes for main text, each with its character references decoded
    and white space made one blank, are joined by line feeds in the order of the page.
    A null or empty page, or one without main text, has an empty text. Pages of any length
    are read whole; repeated rows and ids give a row each; a null id or url stays null.
    Other columns are ignored. An empty table gives no rows.
    """
    spark = pages.sparkSession
    common.tune(spark)
    slim = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("text"))
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.chunks(batches):
            read = [blocks.read(text) for text in batch.column("text").to_pylist()]
            texts, kept = [], []
            for page, label in zip(read, shared.value.label(read), strict=True):
                texts.append("\n".join(b.text for b, good in zip(page, label, strict=True) if good))
                kept.append(int(label.sum()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array([len(p) for p in read], pa.int64()), pa.array(kept, pa.int64())],
                names=["page_id", "url", "text", "n_chars", "n_blocks", "n_kept"],
            )

    kind = lambda c: slim.schema[c].dataType.simpleString()
    return slim.mapInArrow(run, f"page_id {kind('page_id')}, url {kind('url')}, text string, n_chars long, n_blocks long, n_kept long")
