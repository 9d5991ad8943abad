"""Conversation repair against a plain dynamic program, at every chunk size, over odd rows."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from msgloom.llm import conversation_repair as repair
from tests.conftest import SF

SCHEMA = "conv_id long, turn int, role string, text string"


def least(codes, roles=None):
    """Cheapest (cost, audit) by going through rows and states in turn."""
    best = {0: (0, "")}

    def insert(b):
        for _ in range(3):
            for s, (c, a) in list(b.items()):
                to, own = repair.DUE[s], (c + 5, a + "I")
                b[to] = min(b.get(to, own), own)
        return b

    for code in codes:
        new = {}
        for s, (c, a) in insert(best).items():
            more = [(s, (c + 2, a + "D"))]
            if code != "D":
                own = c + 5 * code.isupper()
                more.append((repair.DUE[s], (own + 1, a + "R")))
                if code.lower() in repair.KEPT[s]:
                    more.append((repair.KEPT[s][code.lower()], (own, a + "K")))
            for to, x in more:
                new[to] = min(new.get(to, x), x)
        best = new
    return min(x for s, x in insert(best).items() if s in (0, 3))


@pytest.mark.parametrize("seed", range(6))
def test_search(seed):
    r = random.Random(seed)
    for _ in range(150):
        codes = "".join(r.choices("suaoDSUAO", (1, 6, 6, 1, 1, 0.3, 1, 1, 0.3), k=r.randrange(0, 14)))
        assert repair.cheapest(codes, repair.START, repair.WHOLE) == least(codes), codes


@pytest.mark.parametrize("codes", ["u" * 127, "ua" * 60, "s" * 100, "uuaa" * 30, "UA" * 60, "au" * 60, "uua" * 40])
def test_long_chunks(codes):
    assert repair.cheapest(codes, repair.START, repair.WHOLE) == least(codes)


def test_bounds_are_admissible():
    r = random.Random(9)
    for _ in range(300):
        codes = "".join(r.choices("suaoDUA", k=9))
        after, before = repair._bounds(codes)
        for entry in range(4):
            for to in repair.REACHES[entry]:
                if x := repair.cheapest(codes, entry, frozenset((to,))):
                    assert x[0] >= (before if entry == repair.START else after)[0]


def brute(rows):
    convs = {}
    for conv, turn, role, text in rows:
        own = convs.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fate == 0:
            continue
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        own += [(turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    out = []
    for conv, own in convs.items():
        own.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], hashlib.sha256(f"{len(x[1].encode())}:{x[1]}{x[2]}".encode()).hexdigest()))
        turns = {t for t, _, _ in own if t is not None}
        seen, codes, faults = set(), "", {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in own:
            last = re.findall(r"[^\x20\x09-\x0D]", text)[-1:]
            fault = "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[0] not in ".!?" else None
            seen.add((role, text))
            if fault:
                faults[fault] += 1
            code = role[:1] if role[:1] in ("s", "u", "a") else "o"
            codes += "D" if fault in ("blank", "duplicate") else code.upper() if fault else code
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(own, own[1:])]
        cost, audit = least(codes)
        said, at, last = [], 0, 0
        for edit in audit:
            if edit in "RI":
                last = repair.DUE[last]
                said.append(("", "system", "user", "assistant")[last] + ":" + (own[at][2] if edit == "R" else ""))
            elif edit == "K":
                last = repair.KEPT[last][own[at][1][:1]]
                said.append(f"{own[at][1]}:{own[at][2]}")
            at += edit != "I"
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out.append((conv, gaps, *faults.values(), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest()))
    return sorted(out, key=str)


def run(df, *sizes):
    found = repair.repaired(repair.damaged(df), *sizes).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    return sorted((tuple(r) for r in found.collect()), key=str)


def odd():
    r = random.Random(3)
    texts = [None, "", " \t", "Fine.", "Fine.", "cut", "Well? ", "a.b", "é!", "x" * 50_000 + "."]
    roles = ["user", "assistant", "user", "assistant", "system", None, "tool", "", "u"]
    rows = [(r.choice([1, 2, 3, 4, None]), r.choice([None, *range(9)]), r.choice(roles), r.choice(texts)) for _ in range(120)]
    long = [(77, i // 2, ("user", "assistant")[i % 2] if i % 7 else "user", f"Turn {i % 400}.") for i in range(900)]
    return rows + long + [(78, i, "user", "Same.") for i in range(300)] + [(k, None, "user", None) for k in range(200, 260)]


@pytest.mark.parametrize("chunk", [3, 32])
def test_against_brute_force(spark, chunk):
    rows = odd()
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("mine") for c in ("part", "index", "fault", "lost", "fate", "digest", "step", "edits")})
    assert run(df, chunk, 4) == brute(rows)


def test_table_and_empty(spark):
    df = spark.read.parquet(f"{SF}/conversations.parquet")
    assert run(df) == brute([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])
    assert run(df.limit(0)) == []
