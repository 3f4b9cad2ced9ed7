"""Token counts by a map-side lookup in two tiers, without a shuffle of pre-tokens.

A pre-token is a run of spaces with the word after it, or a word after a line feed.
Where no piece of the model crosses such borders (which is checked), a text's count
is the sum over its pre-tokens. Tier 1 is a compact open-addressing table of 64-bit
pre-token hashes and lengths in tokens, broadcast once; its size is a parameter.
Tier 2 is a cache in each Python worker, filled by the library itself.

Tier 1 is filled from a bounded sample of the input, chosen by hash. It never changes
a count: what it lacks, tier 2 finds, and what it has is held against the pre-token's
own bytes, as is every pre-token that shares a count within a batch. Hashes only guide.
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from terraquarry.llm import common

SPACE, LINE = 0x20, 0x0A
#: Places that a search of the table looks at.
PROBES = 8


class PieceModel:
    """A sentencepiece model and what its vocabulary says about borders."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            proto.ParseFromString(file.read())
        spec = proto.normalizer_spec
        plain = spec.add_dummy_prefix and spec.escape_whitespaces and not spec.remove_extra_whitespaces and not spec.precompiled_charsmap
        pieces = [p for p in proto.pieces if p.type != p.BYTE]
        own = {p.piece for p in pieces if p.type == p.USER_DEFINED}
        text = [p.piece for p in pieces if p.type == p.NORMAL]
        self.splits = plain and not own and proto.trainer_spec.model_type == proto.trainer_spec.BPE and not any("▁" in p.lstrip("▁") or "\n" in p for p in text)
        #: Tokens of a line feed: no piece holds one, so it never merges.
        self.line = len(self.model.encode("\n")) - 1

    def whole(self, text: str) -> int:
        return len(self.model.encode(text))

    def pre_tokens(self, spans: list[bytes]) -> list[int]:
        """The tokens of each pre-token. The library puts a space before its input: a leading one is left to it."""
        bare = [not s.startswith(b" ") for s in spans]
        found = self.model.encode([("\n" + s.decode()) if b else s[1:].decode() for s, b in zip(spans, bare, strict=True)], num_threads=1)
        lead = 1 + self.line
        # the library gives nothing for an empty input; a lone space is one token
        return [len(f) - lead if b else len(f) or 1 for f, b in zip(found, bare, strict=True)]


@functools.lru_cache(2)
def piece_model(path: str) -> PieceModel:
    return PieceModel(path)


def pre_token_spans(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pre-tokens of a batch: bytes with a space before each text, starts, ends, first of each text, line feeds of each text."""
    data, offsets = common.text_buffers(batch.column("text"))
    count = len(offsets) - 1
    lengths = np.diff(offsets)
    some = lengths > 0
    shift = np.cumsum(some)
    at = offsets + np.concatenate(([0], shift))
    wide = np.full(at[-1], SPACE, np.uint8)
    wide[np.arange(len(data)) + np.repeat(shift, lengths)] = data
    if not len(wide):
        none = np.empty(0, np.int64)
        return wide, none, none, np.zeros(count + 1, np.int64), np.zeros(count, np.int64)
    space, line = wide == SPACE, wide == LINE
    head = np.zeros(len(wide), bool)
    head[at[:-1][some]] = True
    starts = space.copy()
    starts[1:] &= ~space[:-1]
    after = ~space & ~line
    after[1:] &= line[:-1]
    after[0] = False
    starts = np.flatnonzero(starts | after | head)
    # a pre-token ends at the next one, at a line feed or with its text
    stops = np.flatnonzero(line | head)
    stops = np.append(stops, len(wide))
    ends = np.minimum(np.append(starts[1:], len(wide)), stops[np.searchsorted(stops, starts, "right")])
    lines = np.concatenate(([0], np.cumsum(line)))
    return wide, starts, ends, np.searchsorted(starts, at), lines[at[1:]] - lines[at[:-1]]


class Table:
    """An open-addressing table of pre-tokens at most half full; what finds no place in PROBES steps stays out.

    A place holds a 64-bit hash, the count of tokens, and where the pre-token's bytes stand.
    """

    def __init__(self, spans: list[bytes], lengths: list[int]):
        sizes = np.array([len(s) for s in spans], np.int64)
        counts = np.array(lengths, np.int64)
        self.data = np.frombuffer(b"".join(spans), np.uint8)
        ends = np.cumsum(sizes)
        starts = ends - sizes
        hashes = common.span_hashes(self.data, starts, ends) | np.uint64(1)  # 0: an empty place
        size = 1 << max(10, (2 * len(spans)).bit_length())
        self.keys, self.values = np.zeros(size, np.uint64), np.zeros(size, np.uint16)
        self.starts, self.sizes = np.zeros(size, np.int32), np.zeros(size, np.int32)
        left = np.flatnonzero((counts < 1 << 16) & (sizes <= common.LONG))
        for step in range(PROBES):
            if not len(left):
                break
            slot = ((hashes[left] >> np.uint64(32)).astype(np.int64) + step) & (size - 1)
            free = np.flatnonzero(self.keys[slot] == 0)
            _, first = np.unique(slot[free], return_index=True)
            placed = free[first]
            at, own = slot[placed], left[placed]
            self.keys[at], self.values[at], self.starts[at], self.sizes[at] = hashes[own], counts[own], starts[own], sizes[own]
            left = np.delete(left, placed)

    @functools.cached_property
    def eights(self) -> np.ndarray:
        return common.windows(self.data)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "eights"}

    def look_up(self, hashes: np.ndarray, eights: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of each span, and where it was found: its hash, and then its bytes."""
        slot = (hashes >> np.uint64(32)).astype(np.int64) & (len(self.keys) - 1)
        found = self.keys[slot] == hashes
        open_ = np.flatnonzero(~found & (self.keys[slot] != 0))
        for _ in range(PROBES - 1):
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) & (len(self.keys) - 1)
            key = self.keys[slot[open_]]
            hit = key == hashes[open_]
            found[open_[hit]] = True
            open_ = open_[~hit & (key != 0)]
        at = np.flatnonzero(found)
        place = slot[at]
        good = self.sizes[place] == ends[at] - starts[at]
        good[good] = common.equal_spans(eights, starts[at[good]], self.eights, self.starts[place[good]].astype(np.int64), (ends - starts)[at[good]])
        found[at[~good]] = False
        return np.where(found, self.values[slot], 0).astype(np.int64), found


class _Cache:
    """Tokens of pre-tokens by their bytes, in two generations: the older is dropped when the younger is full."""

    def __init__(self, limit: int = 200_000):
        self.young: dict[bytes, int] = {}
        self.old: dict[bytes, int] = {}
        self.limit = limit

    def lengths(self, model: PieceModel, spans: list[bytes]) -> np.ndarray:
        """The tokens of distinct pre-tokens. Those of over LONG bytes aren't kept."""
        young, old = self.young, self.old
        found = [young.get(s) for s in spans]
        missing = []
        for i, (s, n) in enumerate(zip(spans, found, strict=True)):
            if n is None:
                n = old.get(s)
                if n is None:
                    missing.append(i)
                else:
                    young[s] = found[i] = n
        for i, n in zip(missing, model.pre_tokens([spans[i] for i in missing]) if missing else [], strict=True):
            found[i] = n
            if len(spans[i]) <= common.LONG:
                young[spans[i]] = n
        if len(young) > self.limit:
            self.old, self.young = young, {}
        return np.array(found, np.int64)


@functools.lru_cache(2)
def _cache(path: str) -> _Cache:
    return _Cache()


def frequent_lengths(docs: DataFrame, model: str, *, rows: int = 2000, entries: int = 65_536) -> Table:
    """Tier 1 from about ``rows`` documents chosen by hash: at most ``entries`` of their most frequent pre-tokens."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, seen = piece_model(model), Counter()
        for batch in common.chunks(batches):
            data, starts, ends, _, _ = pre_token_spans(batch)
            whole = data.tobytes()
            seen.update(whole[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True) if b - a <= common.LONG)
        best = sorted(seen, key=lambda s: (-seen[s], s))[:entries]
        yield pa.RecordBatch.from_arrays([pa.array(best, pa.binary()), pa.array(pieces.pre_tokens(best) if best else [], pa.int64())], names=["span", "tokens"])

    found = common.sampled_texts(docs, rows).mapInArrow(run, "span binary, tokens long").collect()  # at most entries rows
    return Table([bytes(r.span) for r in found], [r.tokens for r in found])


def count_tokens(docs: DataFrame, model: str, *, limit: int = 4096, sample_rows: int = 2000, entries: int = 65_536, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The tokens of each whole text under a sentencepiece model, without begin or end tokens.

    A row per input row: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).
    A null text counts as empty: 0 bytes, 0 tokens. Repeated rows are counted each, other
    columns are ignored, an empty table gives no rows. A model whose pieces cross the
    borders of pre-tokens is applied to whole texts instead. Counts are exact: hashes find
    candidates, bytes decide.
    """
    spark = docs.sparkSession
    common.tune(spark)
    docs = common.documents(docs, id_col, text_col)
    table = spark.sparkContext.broadcast(frequent_lengths(docs, model, rows=sample_rows, entries=entries))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, cache = piece_model(model), _cache(model)
        for batch in common.chunks(batches):
            _, offsets = common.text_buffers(batch.column("text"))
            if pieces.splits:
                tokens = _sum(batch, pieces, cache, table.value)
            else:
                tokens = np.array([pieces.whole(t) for t in batch.column("text").to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array(tokens), pa.array(tokens > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")


def _sum(batch: pa.RecordBatch, pieces: PieceModel, cache: _Cache, table: Table) -> np.ndarray:
    data, starts, ends, first, lines = pre_token_spans(batch)
    if not len(starts):
        return np.zeros(batch.num_rows, np.int64)
    hashes, eights = common.span_hashes(data, starts, ends) | np.uint64(1), common.windows(data)
    lengths, found = table.look_up(hashes, eights, starts, ends)
    missed = np.flatnonzero(~found)
    odd: set[int] = set()
    if len(missed):
        _, at, back = np.unique(hashes[missed], return_index=True, return_inverse=True)
        one = missed[at]  # stands for the others of its hash, if they have its bytes
        sizes = ends - starts
        same = sizes[missed] == sizes[one[back]]
        same[same] = common.equal_spans(eights, starts[missed[same]], eights, starts[one[back[same]]], sizes[missed[same]])
        whole = data.tobytes()
        lengths[missed] = cache.lengths(pieces, [whole[a:b] for a, b in zip(starts[one].tolist(), ends[one].tolist(), strict=True)])[back]
        odd.update((np.searchsorted(first, missed[~same], "right") - 1).tolist())
    total = np.concatenate(([0], np.cumsum(lengths)))
    counts = total[first[1:]] - total[first[:-1]] + lines * pieces.line
    # the library reads the mark for a space as a space, and a text may hold it, or a NUL
    odd.update(i for i, t in enumerate(batch.column("text").to_pylist()) if "▁" in t or "\0" in t)
    for i in odd:
        counts[i] = pieces.whole(batch.column("text")[i].as_py())
    return counts
