"""Packing by powers of two: each document is split into pieces of binary lengths.

A document of n tokens (its end token included) becomes n // max_length pieces of
max_length tokens, then one piece for each set bit of the rest, longest first.
Every piece is a sequence of its own, of a power-of-two length, and sequences of
equal length form a bucket that a trainer batches by itself: no sequence crosses
documents and no padding is needed. One map pass does it, without a shuffle.
"""

from __future__ import annotations

import array
import functools
import json
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from terraquarry.llm import common

#: The structure under which a text's ids are those of its words, each encoded alone.
_NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The same for texts of ASCII and the letters of Latin-1, which no normal form changes.
_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+")
_OTHER = re.compile("[^\t\n\r\x20-\x7eÀ-ÖØ-öø-ÿ]")


class _Words(dict):
    """The ids of words, as bytes, in two generations: the older is dropped when the younger is full."""

    def __init__(self, tokenize, table: dict[int, str], limit: int):
        self.tokenize, self.table, self.limit, self.older = tokenize, table, limit, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = array.array("I", [t.id for t in self.tokenize(word.translate(self.table))]).tobytes()
        self[word] = ids
        return ids

    def age(self) -> None:
        if len(self) > self.limit:
            self.older = dict(self)
            self.clear()


class WordEncoder:
    """Exact ids of a tokenizer file; texts of a known structure go word by word through a bounded cache.

    Other texts, texts that may hold a special token and files of another structure
    go through the tokenizer itself.
    """

    def __init__(self, path: str, limit: int = 200_000):
        from tokenizers import Tokenizer, models

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.full = Tokenizer.from_file(path)
        model = spec["model"]
        stages = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        known = model["type"] == "BPE" and (spec.get("normalizer") or {}).get("normalizers") == _NORMAL
        known = known and [s["type"] for s in stages] == ["Split", "ByteLevel"]
        known = known and stages[0]["pattern"] == {"Regex": _SPLIT} and not (stages[1]["add_prefix_space"] or stages[1]["use_regex"])
        self.special = re.compile("|".join(re.escape(t["content"]) for t in spec.get("added_tokens", [])) or "(?!)")
        self.words = None
        if known:
            merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
            options = {k: model[k] for k in ("unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges") if model.get(k)}
            bpe = models.BPE(vocab=model["vocab"], merges=merges, cache_capacity=0, **options)
            self.words = _Words(bpe.tokenize, _byte_letters(), limit)

    def encode(self, text: str) -> bytes:
        """The ids of ``text`` as 32-bit integers of this machine (little-endian ones on all that Spark runs on)."""
        if self.words is None or _OTHER.search(text) or self.special.search(text):
            return array.array("I", self.full.encode(text, add_special_tokens=False).ids).tobytes()
        out = b"".join(map(self.words.__getitem__, _WORDS.findall(text.lower())))
        self.words.age()
        return out


def _byte_letters() -> dict[int, str]:
    """Each Latin-1 character as the letters that a byte-level model has for its UTF-8 bytes."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in plain}
    for b in range(256):
        letters.setdefault(b, chr(256 + len(letters) - len(plain)))
    return {c: "".join(letters[b] for b in chr(c).encode()) for c in range(256)}


@functools.lru_cache(2)
def encoder(path: str) -> WordEncoder:
    """One encoder per file and Python worker."""
    return WordEncoder(path)


def binary_lengths(n: int, max_length: int) -> list[int]:
    """max_length as often as it fits, then the powers of two that make up the rest, longest first."""
    rest = n % max_length
    return [max_length] * (n // max_length) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


SCHEMA = "doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, bucket int"


def pack(docs: DataFrame, tokenizer: str, *, max_length: int = 2048, end_id: int = 1, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Split each document into pieces of power-of-two lengths, one sequence each.

    A row per piece: doc_id, start, length, ids_crc32 (of the ids as little-endian
    unsigned 32-bit integers), doc_tokens (with the end token), sequence_id, offset (0:
    a piece fills its sequence), bucket (log2 of length) and, with ``keep_ids``, the ids.

    A null or empty text is its end token alone. Repeated rows are packed each. Other
    columns are ignored. An empty table gives no rows. A null doc_id stays null.
    sequence_id is the input partition times 2**40 plus a count: unique in one result,
    and the same on a retry wherever the input partition is read in a fixed order, as
    that of a file is. ``max_length`` must be a power of two.
    """
    if max_length < 1 or max_length & (max_length - 1):
        raise ValueError("max_length must be a power of two")
    common.tune(docs.sparkSession)
    docs = common.documents(docs, id_col, text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        end = array.array("I", [end_id]).tobytes()
        sequence = TaskContext.get().partitionId() << 40
        for batch in common.chunks(batches):
            rows, ids = [], []
            for at, text in enumerate(batch.column("text").to_pylist()):
                view = memoryview(encode(text) + end)
                total, start = len(view) // 4, 0
                for length in binary_lengths(total, max_length):
                    piece = view[4 * start : 4 * (start + length)]
                    rows.append((at, start, length, zlib.crc32(piece), total, sequence))
                    if keep_ids:
                        ids.append(np.frombuffer(piece, np.uint32).astype(np.int32))
                    start += length
                    sequence += 1
            table = np.array(rows, np.int64).reshape(-1, 6)
            columns = [batch.column("doc_id").take(pa.array(table[:, 0])), *(pa.array(table[:, i]) for i in range(1, 6)), pa.array(np.zeros(len(table), np.int64))]
            columns.append(pa.array(np.log2(table[:, 2]).astype(np.int32)))
            if keep_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket", *["ids"] * keep_ids])

    schema = SCHEMA.format(id=docs.schema["doc_id"].dataType.simpleString())
    return docs.mapInArrow(run, schema + ", ids array<int>" * keep_ids)


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Write sequences by bucket: each folder holds sequences of one length."""
    pieces.write.partitionBy("bucket").parquet(path)
