"""Conversation structure repair: the cheapest edits that make roles well-formed, by a DP shared in a prefix trie.

A conversation's signature has one letter a row: its role class and fault. Distinct
signatures are counted out first, so that each is solved once however many conversations
have it; they are dealt by range and sorted, which makes every partition a depth-first walk
of a prefix trie: the layers of the DP lie on a stack, one a letter, and those of the prefix
that a signature shares with the one before it are kept. Where a signature ends, its answer
is read back from the layers.

Texts are shuffled once. Signatures come from rows without texts (a digest of each stands
for it), and the answers meet the texts as one leading row of each conversation. Both passes
stream over rows sorted by conversation and turn: of a conversation, one task holds its
signature and its edits (a byte a row each) and no texts. A conversation is read in one task
since a digest of its repaired turns has to be taken in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terraquarry.llm import common

INSERT, REROLE, DELETE, TRUNCATED = 2, 2, 3, 1
_FAR = 1 << 60

# States of the machine for (s?(ua)+)?: nothing yet, after system, after user, after assistant.
_ENDS = (0, 3)
_INSERTS = ((0, 2), (1, 2), (3, 2), (2, 3))
_BY_ROLE = {"s": ((0, 1),), "u": ((0, 2), (1, 2), (3, 2)), "a": ((2, 3),), "x": ()}
ROLES = {"u": "user", "a": "assistant"}


def _edges(letter: str) -> tuple[tuple[str, int, int, int], ...]:
    """What may become of a row: edit, state before and after, cost; the edits in ASCII order."""
    out = [("D", s, s, DELETE) for s in range(4)]
    if letter != "d":
        extra = TRUNCATED if letter.isupper() else 0
        out += [("K", s, t, extra) for s, t in _BY_ROLE[letter.lower()]]
        out += [("R", s, t, REROLE + extra) for s, t in (*_BY_ROLE["u"], *_BY_ROLE["a"])]
    return tuple(out)


#: By letter of a signature: s, u, a (roles) and x (other roles); upper case if the text is truncated; d if the row must go.
EDGES = {letter: _edges(letter) for letter in "suaxSUAXd"}


def _closed(costs: list[int]) -> tuple[int, ...]:
    """A layer after all inserts that pay."""
    none, system, user, assistant = costs
    user = min(user, INSERT + min(none, system, assistant))
    return none, system, user, min(assistant, user + INSERT)


START = _closed([0, _FAR, _FAR, _FAR])


def next_layer(layer: tuple[int, ...], letter: str) -> tuple[int, ...]:
    """The least cost of each state after one more row."""
    out = [_FAR] * 4
    for _, s, t, cost in EDGES[letter]:
        if layer[s] + cost < out[t]:
            out[t] = layer[s] + cost
    return _closed(out)


def answer(signature: str, layers: list[tuple[int, ...]]) -> tuple[int, str]:
    """The least cost, and of the cheapest edits' initials the ASCII-least: ``layers`` has one layer more than letters.

    Backward, the nodes on cheapest paths are marked; forward, all nodes that the least
    initials so far can have led to are kept (they lie in one layer).
    """
    size = len(signature)
    cost = min(layers[size][s] for s in _ENDS)
    marks: list[set[int]] = [set() for _ in range(size + 1)]
    marks[size] = {s for s in _ENDS if layers[size][s] == cost}
    for at in range(size, -1, -1):
        here, own = layers[at], marks[at]
        if at < size:
            after, ahead = layers[at + 1], marks[at + 1]
            own.update(s for _, s, t, c in EDGES[signature[at]] if t in ahead and here[s] + c == after[t])
        while more := {s for s, t in _INSERTS if t in own and s not in own and here[s] + INSERT == here[t]}:
            own |= more
    out, at, states = [], 0, {0}
    while True:
        if at == size and any(s in _ENDS and layers[at][s] == cost for s in states):
            return cost, "".join(out)
        best: dict[str, set[int]] = {}
        here = layers[at]
        for s, t in _INSERTS:
            if s in states and t in marks[at] and here[s] + INSERT == here[t]:
                best.setdefault("I", set()).add(t)
        if at < size:
            for edit, s, t, c in EDGES[signature[at]]:
                if s in states and t in marks[at + 1] and here[s] + c == layers[at + 1][t]:
                    best.setdefault(edit, set()).add(t)
        edit = min(best)
        out.append(edit)
        states = best[edit]
        at += edit != "I"


class Trie:
    """The path to the signature added last, with the DP's layers; sorted signatures share their prefixes' layers."""

    def __init__(self):
        self.path, self.layers, self.computed = "", [START], 0

    def add(self, signature: str) -> tuple[int, str]:
        shared, most = 0, min(len(signature), len(self.path))
        while shared < most and signature[shared] == self.path[shared]:
            shared += 1
        del self.layers[shared + 1 :]
        for letter in signature[shared:]:
            self.layers.append(next_layer(self.layers[-1], letter))
            self.computed += 1
        self.path = signature
        return answer(signature, self.layers)


# ---------------------------------------------------------------- rows and signatures

_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal")
_LEGAL = {"su", "ua", "au"}


def _rows(conversations: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str, present_col: str | None) -> DataFrame:
    either = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    present = F.coalesce(F.col(present_col), F.lit(False)) if present_col else F.lit(True)
    return conversations.select(F.col(id_col).alias("conv_id"), F.col(turn_col).alias("turn"), either(role_col).alias("role"), either(text_col).alias("text"), present.alias("present"))


#: Rows that tie in turn and role are ordered by it; equal texts have equal ones.
_DIGEST = "unhex(md5(cast(text AS binary)))"


def signatures(rows: DataFrame) -> DataFrame:
    """A row per conversation: conv_id, signature and the counts of what is wrong with it."""
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    slim = rows.select("conv_id", "turn", "role", F.expr(_DIGEST).alias("digest"), last.alias("last"), "present").repartition("conv_id")
    seen = F.row_number().over(Window.partitionBy("conv_id", "present", "role", "digest").orderBy("turn"))  # dealt by conv_id already
    fault = F.when(F.col("last") == "", "b").when(seen > 1, "d").when(F.col("last").isin(".", "!", "?"), "").otherwise("t")
    marked = slim.withColumn("seen", seen).select("conv_id", "turn", "role", "digest", "seen", "present", fault.alias("fault"))
    ordered = marked.sortWithinPartitions("conv_id", "turn", "role", "digest", "seen").select("conv_id", "turn", F.substring("role", 1, 1).alias("initial"), "fault", "present")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, done = None, []
        for batch in batches:
            kind = batch.column("conv_id").type
            for conv, turn, initial, fault, present in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if state is None or conv != state.conv:
                    if state is not None:
                        done.append(state.row())
                    state = _Signing(conv)
                if present:
                    state.add(turn, initial, fault)
            if len(done) >= 1000:
                yield _table(done, kind)
                done = []
        if state is not None:
            yield _table([*done, state.row()], kind)

    return ordered.mapInArrow(run, f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, signature string, " + ", ".join(f"{c} long" for c in _COUNTS))


def _table(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    names = ["conv_id", "signature", *_COUNTS]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [kind, pa.string(), *[pa.int64()] * len(_COUNTS)], strict=True)], names=names)


class _Signing:
    """What becomes of one conversation's rows: signature and counts."""

    def __init__(self, conv):
        self.conv, self.letters, self.before = conv, bytearray(), None
        self.low = self.high = None
        self.turns = 0
        self.counts = {"b": 0, "d": 0, "t": 0, "": 0}
        self.illegal = 0

    def add(self, turn, initial: str, fault: str) -> None:
        if turn is not None:
            if self.low is None:
                self.low = turn
            if turn != self.high:  # turns come in order
                self.turns, self.high = self.turns + 1, turn
        self.counts[fault] += 1
        if self.before is not None and self.before + initial not in _LEGAL:
            self.illegal += 1
        self.before = initial
        letter = "d" if fault in ("b", "d") else initial if initial in ("s", "u", "a") else "x"
        self.letters += (letter.upper() if fault == "t" else letter).encode()

    def row(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return self.conv, self.letters.decode(), gaps, self.counts["b"], self.counts["d"], self.counts["t"], self.illegal


def solved(distinct: DataFrame) -> DataFrame:
    """signature, cost, audit of each row of a table of distinct signatures, by the trie of each range of them."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie()
        for batch in batches:
            if batch.num_rows:
                found = [(s, *trie.add(s)) for s in batch.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.string(), pa.int64(), pa.string()), strict=True)], names=["signature", "cost", "audit"])

    ordered = distinct.select("signature").repartitionByRange("signature").sortWithinPartitions("signature")
    return ordered.mapInArrow(run, "signature string, cost long, audit string")


# ---------------------------------------------------------------- repair


def _forced(state: int) -> tuple[str, int]:
    """The role that an edit must give after a state, and the state after it."""
    return ("a", 3) if state == 2 else ("u", 2)


def repair(conversations: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", present_col: str | None = None) -> DataFrame:
    """Each conversation's faults, cheapest edits and repaired turns, dealt by conversation and in order.

    Of each conversation a leading row (place 0) with ``summary``: gaps (turn numbers
    missing between the least and greatest), blank, duplicate, truncated (rows by their first
    fault), illegal (adjacent role initials other than su, ua, au), cost and audit (the
    edits' initials: Keep, Rerole, Delete, Insert); then a row per repaired turn: place from
    1, edit, role, text. See ``EDGES`` for the edits and their costs; the roles' initials come
    out as (s?(ua)+)?, and of equally cheap edits the ASCII-least audit is taken.

    Rows go by turn, then role, then a digest of the text: a defined order where turns tie.
    Null turns come first, null roles and texts are one blank. Rows with a null id are one
    conversation of that id, as GROUP BY has it. Repeated rows count as duplicates. With
    ``present_col``, a row where it is false or null only names its conversation. Other
    columns are ignored. An empty table gives no rows.
    """
    common.tune(conversations.sparkSession)
    rows = _rows(conversations, id_col, turn_col, role_col, text_col, present_col)
    signed = common.materialize(signatures(rows), "signatures")
    answers = solved(signed.select("signature").distinct())
    heads = signed.join(answers, "signature").select("conv_id", F.struct(*_COUNTS, "cost", "audit").alias("summary"))
    turn = rows.schema["turn"].dataType
    texts = rows.where("present").select("conv_id", "turn", "role", "text", F.expr(_DIGEST).alias("digest"), F.lit(None).cast(heads.schema["summary"].dataType).alias("summary"))
    null: Column = F.lit(None)
    leads = heads.select("conv_id", null.cast(turn).alias("turn"), null.cast("string").alias("role"), null.cast("string").alias("text"), null.cast("binary").alias("digest"), "summary")
    both = leads.unionByName(texts).withColumn("is_turn", F.col("summary").isNull()).repartition("conv_id")
    ordered = both.sortWithinPartitions("conv_id", "is_turn", "turn", "role", "digest").select("conv_id", "role", "text", "summary")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audit, at, place, state = "", 0, 0, 0
        for batch in common.chunks(batches, "text"):
            out: list[tuple] = []  # row of the batch, place, edit, role, text
            audits = batch.column("summary").field("audit").to_pylist()
            heads = batch.column("summary").is_valid().to_pylist()
            for row, (head, held, role, text) in enumerate(zip(heads, audits, batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True)):
                if head:
                    audit, at, place, state = held, 0, 0, 0
                    out.append((row, 0, None, None, None))
                else:
                    edit = audit[at]
                    at += 1
                    if edit != "D":
                        place += 1
                        if edit == "K" and state == 0 and role.startswith("s"):
                            state = 1
                        else:
                            forced, state = _forced(state)
                            role = role if edit == "K" else ROLES[forced]
                        out.append((row, place, edit, role, text))
                while at < len(audit) and audit[at] == "I":
                    forced, state = _forced(state)
                    at, place = at + 1, place + 1
                    out.append((row, place, "I", ROLES[forced], ""))
            if out:
                rows, *columns = zip(*out, strict=True)
                take = pa.array(rows)
                lead = pa.array([p == 0 for p in columns[0]])
                summary = batch.column("summary").take(take)
                summary = pa.compute.if_else(lead, summary, pa.scalar(None, summary.type))
                types = (pa.int64(), pa.string(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([batch.column("conv_id").take(take), *(pa.array(c, t) for c, t in zip(columns, types, strict=True)), summary], names=["conv_id", "place", "edit", "role", "text", "summary"])

    kind = heads.schema["summary"].dataType.simpleString()
    return ordered.mapInArrow(run, f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, place long, edit string, role string, text string, summary {kind}")


def digests(repaired: DataFrame) -> DataFrame:
    """A row per conversation: conv_id, the summary's columns and repaired_sha256 of ``role:text`` of its turns, joined by line feeds.

    The input must be as ``repair`` returns it: no shuffle is made here.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, sha, summary, done, kinds = None, None, None, [], None

        def batch_of() -> pa.RecordBatch:
            ids, sums, shas = zip(*done, strict=True)
            sums = pa.array(sums, kinds[1])
            return pa.RecordBatch.from_arrays([pa.array(ids, kinds[0]), *(sums.field(c) for c in (*_COUNTS, "cost", "audit")), pa.array(shas)], names=["conv_id", *_COUNTS, "cost", "audit", "repaired_sha256"])

        for batch in batches:
            kinds = batch.column("conv_id").type, batch.column("summary").type
            for own, place, role, text, lead in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "place", "role", "text", "summary")), strict=True):
                if place == 0:
                    if sha is not None:
                        done.append((conv, summary, sha.hexdigest()))
                    conv, sha, summary = own, hashlib.sha256(), lead
                else:
                    sha.update(f"{chr(10) if place > 1 else ''}{role}:{text}".encode())
            if len(done) >= 1000:
                yield batch_of()
                done = []
        if sha is not None:
            done.append((conv, summary, sha.hexdigest()))
            yield batch_of()

    columns = ", ".join(f"{c} long" for c in (*_COUNTS, "cost"))
    return repaired.mapInArrow(run, f"conv_id {repaired.schema['conv_id'].dataType.simpleString()}, {columns}, audit string, repaired_sha256 string")


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations with planted faults, by crc32 of ``conv_id:turn`` (nulls: one blank) modulo 20.

    0 drops the row (present is false), 1 empties the text, 2 takes out its ``[.!?]``, 3
    repeats the row with the same turn, 4 makes the role user. Null roles and texts become
    one blank. Returns conv_id, turn, role, text, present.
    """
    either = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    draw = F.crc32(F.concat(either("conv_id"), F.lit(":"), either("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", either("role").alias("role"), either("text").alias("text"), draw.alias("draw"))
    text = F.when(F.col("draw") == 1, "").when(F.col("draw") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    changed = rows.select("conv_id", "turn", F.when(F.col("draw") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("draw") != 0).alias("present"), F.explode(F.array_repeat(F.lit(True), F.when(F.col("draw") == 3, 2).otherwise(1))).alias("copy"))
    return changed.drop("copy")
