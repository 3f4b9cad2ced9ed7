"""Secret scans: fixed patterns, and random-looking strings by two character Markov models.

One model is fitted to random strings, one to ordinary identifiers, both from labelled
samples; a candidate string is a secret if the log-likelihood ratio per character of the
two is over a threshold. Patterns and model work on whole texts in one map pass.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from terraquarry.llm import common

KINDS = ("assign", "access", "hex", "markov")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
#: What the model judges: all long strings of identifier characters.
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
_WORD = re.compile(r"[A-Za-z]{3,12}")
#: Ordinary words that join the texts' own: tables of few words would else teach too little.
_ORDINARY = """
about access account action address after again agent allow amount analysis answer application archive array article average backup balance
bank batch begin between block board body book boundary branch buffer build business button cache calendar callback campaign cancel capture
catalog category center chain change channel character check child choice class clean client clock close cloud cluster collection color column
command comment common company compare component condition config connect constant container content context control convert copy core count
country create credit current customer data database date debug decimal default define delete delivery depth describe design detail device
dictionary different digest direct display distance document domain double driver during dynamic early edge effect element employee empty enable
engine enough entity entry environment equal error event every example exception exchange execute exist expect export express extend external
factory failure false family feature fetch field figure file filter final finish first float folder follow format forward found frame friend
function future gateway general generate global graph green group growth guide handle hash header health height help hidden history home host
house human image import include increase index information input insert inside instance integer interface internal invoice issue item join
journal justify kernel keyboard kind know label language large last launch layer layout leader learn left legal length level library license
light limit line link list load local location lock logic long lookup machine main manager many market master match matrix maximum measure
media member memory menu merge message metadata method middle minimum mobile mode model module money monitor month mouse move multiple music
name native network never next node normal nothing notice number object offer office online open operation option order origin other output
owner package page paper parameter parent parse part partition party path pattern payment people percent period person phone picture pixel place
plan platform player point policy pool position power prefix present previous price print priority private problem process product profile
program progress project property protocol provider proxy public purchase quality query question queue quick random range rate reader ready
really reason receive record reference region register relation release remote remove render replace report request require reset resource
response restore result return review right role root route router safe sample save scale schedule schema school science scope screen script
search second section segment select sender sequence serial server service session setting shape share ship short should signal simple single
size social software sort source space special speed stack stage standard start state station status step stock stop storage store stream
street string strong structure student style subject submit success suffix summary supply support switch symbol sync system table target task
team template term test text theme thread threshold ticket time title today tool total trace track trade traffic transaction transfer transform
travel tree trigger type union unique unit unknown update upload user utility valid value variable vector vendor version video view visible
visit volume wait warning watch water weather web week weight where while white width window with within word work world write yellow zone
""".split()
_HINTS = (b"password", b"passwd", b"secret", b"token", b"api")


class MarkovModel:
    """First-order character transitions from a start mark on, with add-half smoothing."""

    def __init__(self, strings: Iterable[str]):
        self.pairs, self.totals = Counter(), Counter()
        self.symbols = 66
        for s in strings:
            last = "^"
            for c in s:
                self.pairs[last + c] += 1
                self.totals[last] += 1
                last = c

    def table(self) -> dict[str, float]:
        """The log-probability of each seen pair, and of an unseen one by its first character."""
        out = {p: math.log((n + 0.5) / (self.totals[p[0]] + 0.5 * self.symbols)) for p, n in self.pairs.items()}
        return out | {c: math.log(0.5 / (n + 0.5 * self.symbols)) for c, n in self.totals.items()} | {"": -math.log(self.symbols)}


def labelled_samples(texts: Iterable[str], count: int = 4000, seed: int = 11) -> tuple[list[str], list[str]]:
    """Random strings and ordinary identifiers.

    Random strings are drawn over the alphabets that keys use, letters alone among them, and
    join what the fixed patterns found in the texts; identifiers are built of the texts' own
    words and ordinary ones, joined and numbered as programmers do, or long and without digits.
    """
    draw = random.Random(seed)
    words = sorted({w for t in texts for w in _WORD.findall(t)}.union(_ORDINARY))
    found = [t[a:b] for t in texts for kind, a, b in base_spans(t) if kind != "assign"]
    alphabets = ["0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"]
    alphabets += ["ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"]
    secrets = ["".join(draw.choices(draw.choice(alphabets), k=draw.randint(16, 48))) for _ in range(count)] + found[:count]
    names = []
    for _ in range(count):
        parts = [draw.choice(words) for _ in range(draw.randint(1, 4))]
        joined = draw.choice(["_".join(p.lower() for p in parts), "-".join(p.lower() for p in parts), "".join(p.capitalize() for p in parts), "".join(parts).lower(), "_".join(p.upper() for p in parts), "/".join(parts)])
        number = draw.choice(["", str(draw.randint(0, 9)), str(draw.randint(10, 9999)), f"{draw.randint(1990, 2030)}-{draw.randint(1, 12):02d}-{draw.randint(1, 28):02d}"])
        names.append(joined + draw.choice(["", "_", "-"]) * bool(number) + number)
    for _ in range(count // 2):
        parts = [draw.choice(draw.choice([words, _ORDINARY])) for _ in range(draw.randint(4, 10))]
        names.append(draw.choice(["", "", "_", "-", "/"]).join(draw.choice([parts, [p.lower() for p in parts], [p.upper() for p in parts], [p.capitalize() for p in parts]])))
    # separators, numbers and repeated characters alone are ordinary too
    names += ["".join(draw.choices("0123456789", k=draw.randint(16, 24))) for _ in range(count // 10)] + [c * draw.randint(16, 40) for c in "-=_0" for _ in range(20)] + [c * draw.randint(16, 40) for c in alphabets[3] for _ in range(5)]
    return secrets, names


class RatioModel:
    """The log-likelihood ratio of random string against identifier, per character."""

    def __init__(self, secrets: Iterable[str], names: Iterable[str]):
        self.secret, self.name = MarkovModel(secrets).table(), MarkovModel(names).table()

    def score(self, s: str) -> float:
        total, last = 0.0, "^"
        a, b = self.secret, self.name
        for c in s:
            p = last + c
            total += a[p] if p in a else a.get(last, a[""])
            total -= b[p] if p in b else b.get(last, b[""])
            last = c
        return total / max(1, len(s))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """What the fixed patterns find: leftmost matches per kind, those that are too short dropped."""
    low = text.encode("utf-8", "surrogatepass").lower()
    out = []
    if any(h in low for h in _HINTS):
        out += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if b"akia" in low:
        out += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return out


def markov_spans(text: str, model: RatioModel, threshold: float, taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Candidates over the threshold that no pattern has touched."""
    touched = common.overlap_test((a, b) for _, a, b in taken)
    return [("markov", *m.span()) for m in _CANDIDATE.finditer(text) if not touched(*m.span()) and model.score(m[0]) > threshold]


def written(found: list[tuple[str, int, int]]) -> str:
    """kind:start:end by start, then kind in the order of KINDS, joined by commas."""
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(found, key=lambda s: (s[1], KINDS.index(s[0]))))


def scan(docs: DataFrame, *, threshold: float = 0.35, sample_rows: int = 1000, samples: int = 4000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Secrets in every whole text.

    A row per input row: doc_id, n_assign, n_access, n_hex, base_sha256 (of the pattern
    spans as written by ``written``), spans (all spans), n_markov. Offsets are code points,
    the end exclusive. A null text counts as empty; a text without secrets has "" as spans;
    repeated rows are scanned each; other columns are ignored; an empty table gives no rows.
    The identifiers' model is fitted to words of about ``sample_rows`` documents, chosen by hash.

    Bounds of the method: the models judge strings of 16 and more identifier characters
    (``_CANDIDATE``); a shorter random string is found by a pattern or not at all, since too
    few characters tell the two models apart. Digits alone count as an ordinary number, of
    whatever length.
    """
    spark = docs.sparkSession
    common.tune(spark)
    docs = common.documents(docs, id_col, text_col)

    def sampled(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter[str] = Counter()
        found: list[str] = []
        for batch in common.chunks(batches):
            for text in batch.column("text").to_pylist():
                words.update(_WORD.findall(text))
                found += [text[a:b] for kind, a, b in base_spans(text) if kind != "assign"]
        best = sorted(words, key=lambda w: (-words[w], w))[:samples]
        yield pa.RecordBatch.from_arrays([pa.array(best + found[:samples], pa.string())], names=["text"])

    texts = [r.text for r in common.sampled_texts(docs, sample_rows).mapInArrow(sampled, "text string").collect()]  # at most 2 * samples
    model = spark.sparkContext.broadcast(RatioModel(*labelled_samples(texts, samples)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.chunks(batches):
            rows = []
            for text in batch.column("text").to_pylist():
                base = base_spans(text)
                more = markov_spans(text, model.value, threshold, base)
                kinds = Counter(k for k, _, _ in base)
                rows.append((*(kinds[k] for k in KINDS[:3]), hashlib.sha256(written(base).encode()).hexdigest(), written(base + more), len(more)))
            columns = list(zip(*rows, strict=True))
            types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_markov"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_markov long")
