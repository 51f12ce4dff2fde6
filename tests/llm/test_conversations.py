from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import pytest

from passagekit.llm import conversations as C

ROWS = "conv_id bigint, turn bigint, role string, text string, gone boolean"
ALLOWED = re.compile(r"(s?(ua)+)?").fullmatch


def by_definition(codes: str, most: int = 3) -> tuple[int, str]:
    """All edits of short conversations, with up to ``most`` insertions at each place."""
    best = None
    fills = [()] + [f for n in range(1, most + 1) for f in itertools.product("ua", repeat=n)]
    for ways in itertools.product(*([["D"] if c == "x" else ["D", "K", "u", "a"] for c in codes])):
        for inserted in itertools.product(fills, repeat=len(codes) + 1):
            roles, cost, audit = [], 0, ""
            for i in range(len(codes) + 1):
                roles += inserted[i]
                cost, audit = cost + 2 * len(inserted[i]), audit + "I" * len(inserted[i])
                if i < len(codes):
                    way, code = ways[i], codes[i]
                    cost += {"D": 3, "K": 0}.get(way, 2) + (way != "D" and code.isupper())
                    audit += way if way in "DK" else "R"
                    if way != "D":
                        roles.append(code.lower() if way == "K" else way)
            if ALLOWED("".join(roles)) and (best is None or (cost, audit) < best):
                best = (cost, audit)
    return best


def forward(codes: str) -> tuple[int, str]:
    """Turn by turn, every state's cheapest edits; insertions one by one."""

    def inserted(states):
        for _ in range(4):
            for role in "ua":
                for i, j in C.NEXT[role].items():
                    if i in states:
                        states[j] = min(states.get(j, (1 << 60, "")), (states[i][0] + 2, states[i][1] + "I"))
        return states

    states = {0: (0, "")}
    for code in codes:
        after = {}
        for i, (cost, audit) in inserted(dict(states)).items():
            ways = [(i, 3, "D")]
            if code != "x":
                more = code.isupper()
                ways += [(j, more, "K") for k, j in C.NEXT.get(code.lower(), {}).items() if k == i]
                ways += [(j, 2 + more, "R") for role in "ua" for k, j in C.NEXT[role].items() if k == i]
            for j, more, letter in ways:
                after[j] = min(after.get(j, (1 << 60, "")), (cost + more, audit + letter))
        states = after
    return min(e for j, e in inserted(states).items() if j in (0, 3))


def test_matrices_find_the_cheapest_edits():
    for n in range(4):
        for codes in itertools.product("xsuaoSUAO", repeat=n):
            if n < 3 or random.Random("".join(codes)).random() < 0.03:
                assert C.cheapest(C.product("".join(codes))) == by_definition("".join(codes), 2 if n < 3 else 1), codes


def test_products_in_any_grouping():
    rng = random.Random(5)
    for n in (0, 1, 7, 30, 200, 1000):
        codes = "".join(rng.choice("xsuaoSUAO" if n % 2 else "uaUAx") for _ in range(n))
        want = forward(codes)
        assert C.cheapest(C.product(codes)) == want
        m, at = C.ONE, 0
        while at < n:
            step = rng.randrange(1, 40)
            m, at = C.times(m, C.product(codes[at : at + step])), at + step
        assert C.cheapest(m) == want


def plain(rows, damaged=True):
    """What `digests` returns, by plain means; rows (conv_id, turn, role, text)."""
    convs: dict = {}
    for conv, turn, role, text in rows:
        kept = convs.setdefault(conv, [])
        role, text, copies = " " if role is None else role, " " if text is None else text, 1
        if damaged:
            key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
            fate = zlib.crc32(key.encode()) % 20
            if fate == 0:
                continue
            text = "" if fate == 1 else re.sub(r"[.!?]", "", text) if fate == 2 else text
            role, copies = "user" if fate == 4 else role, 2 if fate == 3 else 1
        kept += [(turn, role, text)] * copies
    out = {}
    for conv, kept in convs.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))
        codes, seen, blank, duplicate, truncated = "", set(), 0, 0, 0
        for _, role, text in kept:
            said = text.rstrip(" \t\n\x0b\x0c\r")
            code = role[:1] if role[:1] in ("s", "u", "a") else "o"
            if not said:
                blank, code = blank + 1, "x"
            elif (role, text) in seen:
                duplicate, code = duplicate + 1, "x"
            elif said[-1] not in ".!?":
                truncated, code = truncated + 1, code.upper()
            seen.add((role, text))
            codes += code
        turns = {r[0] for r in kept if r[0] is not None}
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(kept, kept[1:], strict=False))
        cost, audit = forward(codes)
        lines, odd, i = [], len(audit.replace("D", "")) % 2, 0
        for e in audit:
            new = "assistant" if (len(lines) - odd) % 2 else "user"
            if e == "I":
                lines.append(f"{new}:")
            else:
                if e != "D":
                    lines.append(f"{kept[i][1] if e == 'K' else new}:{kept[i][2]}")
                i += 1
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, blank, duplicate, truncated, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def made(seed, n, lengths=(0, 1, 2, 5, 9, 40)):
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(rng.choice(lengths)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rng.choice(["Yes.", "No", "Why? ", " \n\t", "", "é!", "…", "a\x0b", None, f"{rng.random()}.", "x" * 300])
            rows.append((conv if conv else None, rng.choice([turn, turn, turn, turn * 3, None]), role, text))
    rng.shuffle(rows)
    return rows


def collected(df):
    rows = df.collect()
    assert len({r.conv_id for r in rows}) == len(rows)
    return {r.conv_id: tuple(r)[1:] for r in rows}


@pytest.mark.parametrize("damaged", [True, False])
def test_against_plain_repair(spark, damaged):
    rows = made(1, 300)
    # Turns of one conversation that say different things at one number keep their own order.
    rows += [(7000, 1, "user", "A."), (7000, 1, "assistant", "B."), (7001, None, None, None), (7001, None, None, None)]
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(5)
    df = C.damage(table) if damaged else table.selectExpr("conv_id", "turn", "coalesce(role, ' ') role", "coalesce(text, ' ') text", "false gone")
    assert collected(C.digests(df)) == plain(rows, damaged)


def test_a_long_conversation_over_many_ranges(spark):
    """One conversation has half of all rows and lies in many ranges, joined in rounds of two."""
    rows = made(2, 60) + [(5, t, random.Random(t).choice(["user", "assistant"]), f"{t % 900}.") for t in range(4000)]
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        damaged = C.damage(table)
        assert C._places(damaged).where("conv_id = 5").select("part").distinct().count() > 5
        assert collected(C.digests(damaged, fan=2)) == plain(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_repaired_turns(spark):
    rows = [(1, 0, "system", "Be kind.", False), (1, 1, "assistant", "Yes.", False), (1, 2, "user", "Why", False), (2, 0, "user", " ", False), (3, 0, "user", "x", True)]
    df = spark.createDataFrame(rows, ROWS)
    found = C.edits(df)
    got = {r.conv_id: (r.cost, r.audit) for r in found.collect()}
    assert got == {1: forward("saU"), 2: (3, "D"), 3: (0, "")} and got[1][0] == 5
    turns = [tuple(r) for r in C.repair(df, found).orderBy("conv_id", "position").collect()]
    roles = "".join(t[3][0] for t in turns)
    assert {t[0] for t in turns} == {1} and ALLOWED(roles) and [t[1] for t in turns] == list(range(len(turns)))
    assert [t[2] for t in turns] == [e for e in got[1][1] if e != "D"]


def test_empty_table(spark):
    assert C.digests(C.damage(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string, n int"))).collect() == []
