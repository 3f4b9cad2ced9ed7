import functools
import hashlib
import itertools
import random
import re
import zlib

from terraquarry.llm import queries, repair

WELL = re.compile(r"(s?(ua)+)?")


def cheapest(signature):
    """Cost and audit by the suffix recursion: every edit of every row, at most two inserts in a row."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}

    @functools.cache
    def best(at, state, inserted):
        options = [(0, "")] if at == len(signature) and state in ("", "a") else []
        if inserted < 2:
            options += [(2 + c, "I" + t) for r in "ua" if (state, r) in step for c, t in [best(at, step[state, r], inserted + 1)]]
        if at < len(signature):
            letter = signature[at]
            c, t = best(at + 1, state, 0)
            options.append((3 + c, "D" + t))
            if letter != "d":
                cut = letter.isupper()
                for edit, price, roles in (("K", 0, letter.lower()), ("R", 2, "ua")):
                    options += [(price + cut + c, edit + t) for r in roles if (state, r) in step for c, t in [best(at + 1, step[state, r], 0)]]
        return min(options, default=(1 << 40, ""))

    return best(0, "", 0)


def expected(rows):
    """The contract's columns for one conversation's rows after damage: (turn, role, text)."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).digest()))
    seen, faults = set(), []
    for _, role, text in rows:
        body = text.rstrip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    letters = [("d" if f in ("blank", "duplicate") else (r[1][:1] if r[1][:1] in ("s", "u", "a") else "x")) for r, f in zip(rows, faults)]
    cost, audit = cheapest("".join(x.upper() if f == "truncated" else x for x, f in zip(letters, faults)))
    out, left = [], list(rows)
    for edit in audit:
        want = {"": "u", "s": "u", "a": "u", "u": "a"}[out[-1][0][:1] if out else ""]
        role, text = ("", "") if edit == "I" else left.pop(0)[1:]
        if edit in "IR":
            role = {"u": "user", "a": "assistant"}[want]
        if edit != "D":
            out.append((role, text))
    assert not left and WELL.fullmatch("".join(r[:1] for r, _ in out))
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
    return gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest


def broken(rows):
    """The damage, row by row: conversation -> rows left."""
    out = {}
    text_of = lambda v: " " if v is None else str(v)
    for conv, turn, role, text in rows:
        role, text, own = text_of(role), text_of(text), out.setdefault(conv, [])
        draw = zlib.crc32(f"{text_of(conv)}:{text_of(turn)}".encode()) % 20
        if draw == 1:
            text = ""
        elif draw == 2:
            text = re.sub("[.!?]", "", text)
        elif draw == 4:
            role = "user"
        own += [(turn, role, text)] * (0 if draw == 0 else 2 if draw == 3 else 1)
    return out


def held(found, rows):
    found = {r.conv_id: tuple(r)[1:] for r in found.collect()}
    want = broken(rows)
    assert found.keys() == want.keys()
    for conv, own in want.items():
        assert found[conv] == expected(own), (conv, own)


def test_query_over_whole_tables(spark):
    sf = "/root/testdata/sf0.01"
    held(queries.op13_repair(spark, sf), [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()])


def test_trie_against_the_suffix_recursion():
    draw = random.Random(13)
    signatures = {"".join(draw.choices("suaxSUAXd", k=draw.randint(0, 9))) for _ in range(2500)}
    signatures |= {"".join(s) for n in range(4) for s in itertools.product("suaxUd", repeat=n)}
    trie = repair.Trie()
    for s in sorted(signatures):
        assert trie.add(s) == cheapest(s), s
    prefixes = {s[:k] for s in signatures for k in range(1, len(s) + 1)}
    assert trie.computed == len(prefixes)  # one layer a node of the trie, none twice


def test_edge_cases(spark):
    draw = random.Random(4)
    rows = [(c, t, draw.choice(["user", "assistant", "system", "tool", "", None, "User"]), draw.choice(["Yes.", "No!", "cut", "", None, " \t\n", "é?", "Yes. \x0b", "\xa0"])) for c in range(60) for t in range(draw.randint(1, 14))]
    rows += [(c, draw.choice([None, 3, 3, 5, -2]), "user", draw.choice(["A.", "B", None])) for c in range(60, 80) for _ in range(6)]
    rows += rows[:40] + [(None, None, None, None), (None, 1, "user", "x." * 5)]
    rows += [(900, 1, "system", "s."), (901, 7, "user", "word " * 100_000 + ".")]
    rows += [(1000, t, ("user", "assistant")[t % 2], f"turn {t}.") for t in range(150)]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, summary string, place int")
    held(repair.digests(repair.repair(repair.damaged(table), present_col="present")), rows)
    assert repair.digests(repair.repair(table.limit(0))).count() == 0


def test_dropped_whole_and_turns(spark):
    table = spark.createDataFrame([(1, 0, "user", "Hi.", False), (2, 0, "user", "Hi.", True), (2, 1, "user", "Well?", True)], "conv_id long, turn long, role string, text string, here boolean")
    found = repair.repair(table, present_col="here").orderBy("conv_id", "place").collect()
    assert [(r.conv_id, r.place, r.edit, r.role, r.text) for r in found] == [(1, 0, None, None, None), (2, 0, None, None, None), (2, 1, "K", "user", "Hi."), (2, 2, "R", "assistant", "Well?")]
    assert found[0].summary.asDict() == {"gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": ""}
    (empty,) = repair.digests(repair.repair(table.where("conv_id = 1"), present_col="here")).collect()
    assert empty.repaired_sha256 == hashlib.sha256(b"").hexdigest()


def test_long_conversation(spark):
    """50,000 turns in their order, one of them twice: linear time, one deletion."""
    rows = spark.range(50_000).selectExpr("7L AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "concat('turn ', id, '.') AS text")
    (row,) = repair.digests(repair.repair(rows.unionByName(rows.where("turn = 40001")))).collect()
    assert (row.cost, row.duplicate, row.illegal) == (3, 1, 1) and row.audit.replace("K", "") == "D" and len(row.audit) == 50_001
