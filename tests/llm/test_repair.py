"""Conversation repair against a brute-force reading of its contract."""

import hashlib
import random
import re
import zlib
from itertools import product

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from test_sql_operators import check

from sextant.llm.repair import OP11_SQL, Survivors, damage, op11_repair, repair_summary, repaired_turns

LONG = "A long text. " * 20_000
SPACES = " \t\n\x0b\x0c\r"


def damaged(rows):
    """(conv, turn, role, text) -> conv -> rows in order."""
    found = {}
    for conv, turn, role, text in rows:
        told = [" " if x is None else str(x) for x in (conv, turn, role, text)]
        kind = zlib.crc32(f"{told[0]}:{told[1]}".encode()) % 20
        role, text = told[2:]
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        found.setdefault(conv, []).extend([(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1))
    return {conv: sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())) for conv, rows in found.items()}


def faults(rows):
    seen, found = set(), []
    for _, role, text in rows:
        stripped = text.strip(SPACES)
        found.append("blank" if not stripped else "duplicate" if (role, text) in seen else "truncated" if stripped[-1] not in ".!?" else "")
        seen.add((role, text))
    return found


def repaired(rows, audit):
    """The turns that an audit makes of rows; None if it does not make a legal conversation."""
    turns, left = [], list(rows)
    for edit in audit:
        role, text = ("", "") if edit == "I" else left.pop(0)[1:]
        if edit == "D":
            continue
        if edit in "IR":
            role = "assistant" if turns and turns[-1][0][:1] == "u" else "user"
        turns.append((role, text))
    return turns if not left and all(r for r, _ in turns) and re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in turns)) else None


def cost(kinds, audit):
    total, left = 0, list(kinds)
    for edit in audit:
        kind = "" if edit == "I" else left.pop(0)
        if kind in ("blank", "duplicate") and edit != "D":
            return None
        total += {"K": 0, "R": 2, "D": 3, "I": 2}[edit] + (kind == "truncated" and edit != "D")
    return total


def cheapest(rows):
    """All audits with up to two inserts before each row and at the end."""
    kinds, best = faults(rows), None
    for edits in product("DKR", repeat=len(rows)):
        for inserts in product(("", "I", "II"), repeat=len(rows) + 1):
            audit = "".join(a + b for a, b in zip(inserts, (*edits, ""), strict=True))
            price = cost(kinds, audit)
            if price is not None and (best is None or (price, audit) < best) and repaired(rows, audit) is not None:
                best = (price, audit)
    return best


def walked(rows):
    """The same by dynamic programming over whole audits, for rows that are too many."""
    kinds, alive = faults(rows), {"": (0, "")}
    for (_, role, _), kind in zip(rows, kinds, strict=True):
        following = {}
        for state, (price, audit) in alive.items():
            for inserts in range(3):
                here = state
                for _ in range(inserts):
                    here = "a" if here == "u" else "u"
                ways = [("D", 3, here)]
                if kind not in ("blank", "duplicate"):
                    more = kind == "truncated"
                    ways.append(("R", 2 + more, "a" if here == "u" else "u"))
                    if here + role[:1] in ("s", "u", "su", "ua", "au") and role:
                        ways.append(("K", more, role[0]))
                for edit, more, to in ways:
                    way = (price + 2 * inserts + more, audit + "I" * inserts + edit)
                    following[to] = min(following.get(to, way), way)
        alive = following
    ends = {"": "", "s": "II", "u": "I", "a": ""}
    return min((price + 2 * len(ends[s]), audit + ends[s]) for s, (price, audit) in alive.items())


def expected(rows, search):
    found = {}
    for conv, there in damaged(rows).items():
        kinds = faults(there)
        turns = [t for t, _, _ in there if t is not None]
        initials = [r[:1] for _, r, _ in there]
        price, audit = search(there)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired(there, audit)).encode()).hexdigest()
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        found[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), illegal, price, audit, digest)
    return found


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def table(rows):
    conv, turn, role, text = zip(*rows, strict=True) if rows else ([], [], [], [])
    return pa.table({"conv_id": pa.array(conv, pa.int64()), "turn": pa.array(turn, pa.int64()), "role": pa.array(role, pa.string()), "text": pa.array(text, pa.string()), "edits": ["x"] * len(conv), "lost": [True] * len(conv), "piece": [1] * len(conv), "cost": [0] * len(conv)})


def drawn(conversations, rows, seed):
    draw = random.Random(seed)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "ux", "User"]
    texts = ["Yes.", "No!", "open", "", " \t", "Why?", None, "more. ", "x.\n", "ä."]
    return [(c, draw.choice([None, *range(12)]), draw.choice(roles), draw.choice(texts) if draw.random() < 0.5 else f"{draw.random()}.") for c in conversations for _ in range(draw.randint(1, rows))]


@pytest.mark.parametrize("rows", [[], [(1, 1, "user", "Hi.")], [(None, None, None, None)], drawn([None, *range(40)], 4, 1), [(5, t, "system" if t == 0 else "user", LONG) for t in range(4)] * 2], ids=["empty", "one", "nulls", "drawn", "long_texts"])
def test_all_audits_tried(spark, tmp_path, rows):
    pq.write_table(table(rows), f"{tmp_path}/conversations.parquet")
    df = op11_repair(spark, str(tmp_path))
    got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in df.collect()}
    assert got == expected(rows, lambda there: cheapest(there) if len(there) < 5 else walked(there)) and df.columns == ["conv_id", *COLUMNS]


def test_same_as_sql(spark, tmp_path):
    check(spark, tmp_path, op11_repair, OP11_SQL, conversations=table(drawn([None, *range(60)], 9, 5)))


def test_whole_table(spark):
    folder = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = op11_repair(spark, folder).collect()
    assert {r.conv_id: tuple(r[c] for c in COLUMNS) for r in got} == expected(rows, walked) and len(got) == len({r[0] for r in rows})


@pytest.mark.parametrize("piece", [1, 7])
def test_long_conversations_in_pieces(spark, tmp_path, piece):
    rows = drawn([None, *range(12)], 40, 2) + [(99, i, "tool", f"{i}.") for i in range(60)] + [(98, i, "user", "") for i in range(30)]
    pq.write_table(table(rows), f"{tmp_path}/conversations.parquet")
    there = damage(spark.read.parquet(f"{tmp_path}/conversations.parquet"))
    got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in repair_summary(there, F.col("lost"), 10, piece).collect()}
    assert got == expected(rows, walked)
    turns = repaired_turns(there, F.col("lost"), 10, piece).orderBy("place").collect()
    for conv, want in got.items():
        mine = [r for r in turns if r.conv_id == conv]
        assert "".join(r.edit for r in mine) == want[6]
        assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in mine if r.edit != "D").encode()).hexdigest() == want[7]


def test_undecided_rows_are_few():
    search, held, most = Survivors(), 0, 0
    for i in range(10_000):
        held += 1 - len(search.push("ua"[i % 2] if i % 97 else "s", i % 31 == 0, i % 5 == 0))
        most = max(most, held)
    assert most < 50
