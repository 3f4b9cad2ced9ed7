import hashlib
from collections import defaultdict

from terraquarry.llm import chat, queries

HARD = r"\### Assistant: </turn> ok"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_all_conversations_come_back(spark, sf):
    turns = defaultdict(list)
    for r in spark.read.parquet(f"{sf}/conversations.parquet").collect():
        turns[r.conv_id].append((r.turn, r.role or "", r.text or ""))
    turns[-7] = [(0, "user", HARD), (1, "assistant", HARD)]
    found = {r.conv_id: r for r in queries.op3_chat(spark, sf).collect()}
    assert found.keys() == turns.keys()
    for conv, rows in turns.items():
        rows.sort()
        loss = "".join(t for _, role, t in rows if role == "assistant")
        got = found[conv]
        assert got.n_turns == len(rows)
        assert got.turns_sha256 == digest("".join(f"{role}\n{t}\n" for _, role, t in rows))
        assert (got.loss_chars, got.loss_sha256) == (len(loss), digest(loss))
        assert got.formatted_chars > sum(len(t) for _, _, t in rows)


def test_the_machine_and_edge_cases(spark):
    rows = [
        (1, 0, "system", "be kind"), (1, 1, "user", "hi"), (1, 2, "assistant", "ho"),
        (2, 0, "assistant", "first"), (2, 1, "user", None),
        (3, 0, "user", "a"), (3, 1, "user", "b"),
        (4, 0, "tool:@<#\\", "x"), (4, 1, None, ""),
        (5, 0, "user", "same"), (5, 0, "user", "same"),
        (6, None, "user", " \n</turn>\n### User: "), (6, 1, "assistant", "é😀\\\\h"),
        (None, 0, "user", "nobody's"),
        (7, 0, "user", "q"), (7, 1, "assistant", "z" * 500_000),
        (8, 0, "system", "alone"),
    ]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, part string, loss int").repartition(3)
    segments = chat.format_segments(df)
    found = {r.conv_id: r for r in chat.digests(segments).collect()}
    assert {c: found[c].valid for c in found} == {1: True, 2: False, 3: False, 4: False, 5: False, 6: True, None: True, 7: True, 8: False}
    for conv in found:
        own = sorted((-1 if t is None else t, r or "", x or "") for c, t, r, x in rows if c == conv)
        assert found[conv].turns_sha256 == digest("".join(f"{r}\n{x}\n" for _, r, x in own))
        loss = "".join(x for _, r, x in own if r == "assistant")
        assert (found[conv].loss_chars, found[conv].loss_sha256) == (len(loss), digest(loss))
    assert found[3].fault == "user after user"
    assert chat.digests(chat.format_segments(df.limit(0))).count() == 0


def test_escapes_are_undone_and_hide_control_strings():
    template = chat.Template()
    for text in ["", HARD, "\\", "\\\\h", "#<@:", "###", "</turn>", "### @x: ", "a\nb", "\\l\\h"]:
        for name in (False, True):
            coded = template.encode(text, name)
            assert template.decode(coded) == text
            assert "###" not in coded and "</turn>" not in coded


def test_rows_without_an_id_are_one_conversation(spark):
    rows = spark.createDataFrame([(None, 2, "user", "c"), (None, 0, "user", "a"), (None, 1, "assistant", "b"), (1, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    found = {r.conv_id: r for r in chat.digests(chat.format_segments(rows)).collect()}
    assert found.keys() == {None, 1} and found[None].n_turns == 3
    assert found[None].turns_sha256 == digest("user\na\nassistant\nb\nuser\nc\n")
