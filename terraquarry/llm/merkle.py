"""Document fingerprints: a Merkle tree over paragraphs and sections, in SQL functions alone.

A paragraph ends with its line feeds, a section with its blank lines; the pieces of each
level join up to the text again, so nothing is left out. A paragraph's hash is the SHA-256
of its text, a section's that of its paragraphs' hashes, the root's that of its sections'.
Under each paragraph stand short hashes of its phrases (up to eight words, none across a
sentence's end) with their lengths (65,535 for longer ones), so that a change inside a
paragraph can be graded.

A fingerprint is written root:section=paragraph-phrase.phrase,paragraph-...;section=...
Equal roots mean equal texts; sections and paragraphs that differ locate edits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terraquarry.llm import common

_SECTION = r"(?<=\n\n)(?!\n)"
_PARAGRAPH = r"(?<=\n)(?!\n)"
#: Each match starts where the last one ended, and blanks are not given back: no place is tried twice.
_PHRASE = r"\G\s*+(?:\S*[^\s.!?]\s++){0,7}\S+\s*+"


def _sha(x: Column) -> Column:
    return F.sha2(x.cast("binary"), 256)


def fingerprint(text: Column) -> Column:
    """The written tree of a text (null: empty)."""

    def phrase(p: Column) -> Column:
        return F.concat(F.substring(_sha(p), 1, 12), F.lower(F.lpad(F.hex(F.least(F.length(p), F.lit(65535)).cast("long")), 4, "0")))

    def paragraph(p: Column) -> Column:
        return F.struct(_sha(p).alias("hash"), F.array_join(F.transform(F.regexp_extract_all(p, F.lit(_PHRASE), F.lit(0)), phrase), ".").alias("phrases"))

    def section(s: Column) -> Column:
        return F.transform(F.filter(F.split(s, _PARAGRAPH), lambda p: p != ""), paragraph)

    def written(s: Column) -> Column:
        paragraphs = F.transform(s, lambda p: F.concat(F.substring(p["hash"], 1, 16), F.lit("-"), p["phrases"]))
        return F.struct(_sha(F.array_join(F.transform(s, lambda p: p["hash"]), "")).alias("hash"), F.array_join(paragraphs, ",").alias("body"))

    sections = F.transform(F.transform(F.filter(F.split(F.coalesce(text, F.lit("")), _SECTION), lambda s: s != ""), section), written)
    # a lambda's variable is computed once: the tree is not built anew for each of its uses
    return F.transform(
        F.array(sections),
        lambda t: F.concat(_sha(F.array_join(F.transform(t, lambda s: s["hash"]), "")), F.lit(":"), F.array_join(F.transform(t, lambda s: F.concat(F.substring(s["hash"], 1, 16), F.lit("="), s["body"])), ";")),
    )[0]


def phrases(print_: Column) -> Column:
    """The distinct phrase hashes of a fingerprint, with their lengths."""
    return F.array_distinct(F.regexp_extract_all(print_, F.lit("[-.]([0-9a-f]{16})"), F.lit(1)))


def _weight(tokens: Column) -> Column:
    return F.aggregate(tokens, F.lit(0).cast("long"), lambda a, t: a + F.conv(F.substring(t, 13, 4), 16, 10).cast("long"))


def likeness(a: Column, b: Column) -> Column:
    """How much of two texts their fingerprints share, 0 to 1: characters in phrases of both, over those in either's, by Dice.

    1 where the roots are equal.
    """
    both = F.transform(
        F.array(F.struct(phrases(a).alias("a"), phrases(b).alias("b"))),
        lambda x: F.struct(_weight(F.array_intersect(x["a"], x["b"])).alias("shared"), (_weight(x["a"]) + _weight(x["b"])).alias("all")),
    )[0]
    graded = F.transform(F.array(both), lambda x: F.when(x["all"] > 0, 2.0 * x["shared"] / x["all"]).otherwise(F.lit(0.0)))[0]
    return F.when(F.substring_index(a, ":", 1) == F.substring_index(b, ":", 1), F.lit(1.0)).otherwise(graded)


#: Ranges of ids for each shuffle partition.
RANGES = 4


def _ranges(ids: DataFrame) -> tuple[list, dict]:
    """Ids that end the ranges, ascending, and for each range that has ids its largest one.

    Ranges hold about as many rows each. The driver gets two ids a range, of which there are
    ``RANGES`` for each shuffle partition.
    """
    count = RANGES * int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = F.array(*(F.lit((i + 1) / count) for i in range(count - 1)))
    found = ids.agg(F.percentile_approx("doc_id", shares, F.lit(max(10_000, 20 * count))).alias("ends")).first()
    ends = sorted(set(found["ends"] or []))
    return ends, {r["part"]: r["head"] for r in ids.groupBy(_range_of(ends).alias("part")).agg(F.max("doc_id").alias("head")).collect()}


def _range_of(ends: list) -> Column:
    """How many range ends lie below the id: a binary search in an array literal."""
    if not ends:
        return F.lit(0)
    table = F.array(*(F.lit(e) for e in ends))
    steps = F.array(*(F.lit(1 << k) for k in range(len(ends).bit_length() - 1, -1, -1)))
    further = lambda at, step: (at + step <= len(ends)) & (F.try_element_at(table, at + step) < F.col("doc_id"))
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(further(at, step), at + step).otherwise(at))


def _with_next(docs: DataFrame) -> DataFrame:
    """Each row with an id: doc_id, text, fingerprint and those of the next document by descending id, as ``next``.

    Texts are dealt once, by range of id, and sorted there. A range's last row finds its next
    document in the range below: a copy of each range's first document goes along to the range
    above it (of the first range's, to the last). Fingerprints are made after the dealing.
    """
    ids = docs.where("doc_id IS NOT NULL")
    ends, heads = _ranges(ids.select("doc_id"))
    if not heads:
        return docs.limit(0).select("doc_id", "text", F.lit("").alias("fingerprint"), F.struct(F.lit("").alias("text"), F.lit("").alias("fingerprint")).alias("next"))
    present = sorted(heads)
    above = dict(zip(present, [*present[1:], present[0]], strict=True))
    part = lambda: F.col("part")
    place = F.array(*(F.lit(heads.get(i)) for i in range(max(present) + 1)))
    to = F.array(*(F.lit(above.get(i)) for i in range(max(present) + 1)))
    own = F.struct(part().alias("part"), F.lit(False).alias("copy"))
    lent = F.struct(F.element_at(to, part() + 1).alias("part"), F.lit(True).alias("copy"))
    dealt = ids.withColumn("part", _range_of(ends))
    dealt = dealt.select("doc_id", "text", F.explode(F.when(F.element_at(place, part() + 1) == F.col("doc_id"), F.array(own, lent)).otherwise(F.array(own))).alias("at"))
    dealt = dealt.select("doc_id", "text", "at.part", "at.copy").repartition("part")
    rows = dealt.select("*", fingerprint(F.col("text")).alias("fingerprint"), F.expr("~doc_id").alias("down"), F.xxhash64("text").alias("pick"))
    order = Window.partitionBy("part").orderBy("copy", "down", "pick")
    rows = rows.withColumn("ahead", F.lead(F.struct("text", "fingerprint")).over(order))
    # of rows that share an id, the last one's next row has another id
    repeats = Window.partitionBy("part", "copy", "down").orderBy("pick").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return rows.withColumn("next", F.last("ahead").over(repeats)).where("NOT copy").select("doc_id", "text", "fingerprint", "next")


def compare_edited(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    The edited text has the last floor(n_chars / 2) code points replaced by as many first
    ones (or all) of the next document by descending doc_id (an integral column); the first
    follows the last. A row per input row: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next. A null text counts as empty. Rows that repeat
    a doc_id share their next document, that of the next smaller id; of an id's several texts
    the one of least hash stands for it. A row without a doc_id is in no order: its next
    document is empty. Other columns are ignored; an empty table gives no rows.
    """
    docs = common.documents(docs, id_col, text_col)
    loose = docs.where("doc_id IS NULL").select("doc_id", "text", fingerprint(F.col("text")).alias("fingerprint"), F.struct(F.lit("").alias("text"), fingerprint(F.lit("")).alias("fingerprint")).alias("next"))
    rows = _with_next(docs).unionByName(loose)
    n, half = F.length("text"), F.expr("length(text) div 2")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next.text"), F.lit(1), half))
    made = rows.select("doc_id", n.cast("long").alias("n_chars"), "fingerprint", edited.alias("edited"), F.col("next.fingerprint").alias("next_fingerprint"))
    made = made.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint", fingerprint(F.col("edited")).alias("edited_fingerprint"), "next_fingerprint")
    return made.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))


def changed_branches(a: Column, b: Column) -> Column:
    """Where two fingerprints differ: indices of b's paragraphs, in order of the text, that a does not have."""

    def own(print_: Column) -> Column:
        return F.regexp_extract_all(print_, F.lit("[=,]([0-9a-f]{16})-"), F.lit(1))

    # computed once, as a lambda's variable: b's paragraphs, and those of them that a lacks
    both = F.array(F.struct(own(b).alias("all"), F.array_except(own(b), own(a)).alias("new")))
    found = lambda x: F.transform(x["all"], lambda p, i: F.when(F.array_contains(x["new"], p), i).otherwise(F.lit(-1)))
    return F.filter(F.transform(both, found)[0], lambda i: i >= 0)
