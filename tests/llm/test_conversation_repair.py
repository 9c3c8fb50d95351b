"""The checkpointed repair beside a plain search over whole edit strings."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from functools import cache

from pyspark.sql import functions as F

from particlelake.llm import conversation_repair as repair
from particlelake.llm import queries
from tests.conftest import SMALL

SCHEMA = "conv_id long, turn long, role string, text string"
BARE = re.compile(r"[^\x20\x09-\x0D]")


def plain_repair(rows):
    """Totals of (turn, role, text) rows in order; every state keeps its cheapest, then least edit string."""
    seen, faults = set(), []
    for _, role, text in rows:
        bare = BARE.findall(text)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))

    @cache
    def best(i, state, inserted=0):
        due = "assistant" if state == "u" else "user"
        options = [(0, "", ())] if i == len(rows) and state in ("", "a") else [(math.inf, "", ())]
        if i < len(rows):
            (_, role, text), fault = rows[i], faults[i]
            c, a, t = best(i + 1, state)
            options.append((4 + c, "D" + a, t))
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                if role[:1] == due[0] or (role[:1] == "s" and state == ""):
                    c, a, t = best(i + 1, role[:1])
                    options.append((more + c, "K" + a, (f"{role}:{text}", *t)))
                c, a, t = best(i + 1, due[0])
                options.append((3 + more + c, "R" + a, (f"{due}:{text}", *t)))
        if inserted < 3:
            c, a, t = best(i, due[0], inserted + 1)
            options.append((3 + c, "I" + a, (due + ":", *t)))
        return min(options)

    cost, audit, texts = best(0, "")
    turns = [t for t, _, _ in rows if t is not None]
    roles = [r[:1] for _, r, _ in rows]
    count = lambda f: sum(x == f for x in faults)
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, count("blank"), count("duplicate"), count("truncated"),
        sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:])), cost, audit, hashlib.sha256("\n".join(texts).encode()).hexdigest(),
    )


def damaged(rows):
    out, spaced = {}, lambda v: " " if v is None else v
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, spaced(r[2]), spaced(r[3]))):
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = spaced(role), spaced(text)
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(kind, text)
        out.setdefault(conv, [])
        out[conv] += [(turn, "user" if kind == 4 else role, text)] * ((kind > 0) + (kind == 3))
    return out


def totals(df):
    return {r[0]: tuple(r)[1:] for r in df.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()}


def test_query_as_plain(spark):
    for sf in (SMALL, SMALL.replace("0.001", "0.01")):
        rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
        assert totals(queries.op12_checkpointed_repair(spark, sf)) == {c: plain_repair(r) for c, r in damaged(rows).items()}


def random_rows(seed, conversations, longest):
    draw, rows = random.Random(seed), []
    for conv in range(conversations):
        for k in range(draw.randrange(1, longest)):
            role = draw.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None])
            text = draw.choice(["One.", "Two!", "three", " ", "", None, "four \t\n", "Five? \x0b", " ", f"say {k}.", f"say {k}", "x."])
            rows.append((conv if conv else None, draw.choice([None, k, k, k // 2, 3 * k]), role, text))
    return rows


def test_random_faults_as_plain(spark):
    rows = random_rows(1, 300, 14)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("position", F.lit("clash")).withColumn("costs", F.lit(1)).repartition(5)
    assert totals(repair.repaired_totals(df)) == {c: plain_repair(r) for c, r in damaged(rows).items()}


def test_edits_rebuild_the_conversation(spark):
    rows = random_rows(2, 60, 12)
    out = repair.repair_conversations(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    ends = {r["conv"]: r for r in out if r["step"] < 0}
    for conv, end in ends.items():
        steps = sorted((r for r in out if r["conv"] == conv and r["step"] >= 0), key=lambda r: r["step"])
        kept = [r for r in steps if r["edit"] != "D"]
        assert "".join(r["edit"] for r in steps) == end["audit"]
        assert re.fullmatch("(s?(ua)+)?", "".join(r["role"][:1] for r in kept))
        assert hashlib.sha256("\n".join(f"{r['role']}:{r['text']}" for r in kept).encode()).hexdigest() == end["repaired_sha256"]


def test_long_conversation_in_small_blocks(spark):
    rows = [(1, k, ("user", "assistant", "assistant", "system")[k * k % 4], f"{k % 700}" + "." * (k % 3)) for k in range(5_000)]
    marks = []
    judged = sorted(((None, p, "uas"[p % 3], p % 2) for p in range(1_000)), key=lambda r: -r[1])
    for batch in repair._checkpoints([repair._as_batch(judged, [*repair.CHECKPOINT[:2], ("initial", repair.pa.string()), ("fault", repair.pa.int32())])]):
        marks += batch.column("position").to_pylist()
    assert sorted(marks) == list(range(0, 1_000, 32))
    got = totals(repair.repaired_totals(spark.createDataFrame(rows, SCHEMA).repartition(6)))
    wanted = {c: forward(r) for c, r in damaged(rows).items()}
    assert {c: x[5:7] for c, x in got.items()} == wanted


def forward(rows):
    """(cost, audit) of one long conversation without recursion: cheapest, then least string from every state."""
    seen, faults = set(), []
    for _, role, text in rows:
        bare = BARE.findall(text)
        faults.append(2 if not bare or (role, text) in seen else int(bare[-1] not in ".!?"))
        seen.add((role, text))
    best = {"": (0, ""), "s": (6, "II"), "u": (3, "I"), "a": (0, "")}
    for (_, role, _), fault in zip(reversed(rows), reversed(faults)):
        new = {}
        for state in best:
            due = "a" if state == "u" else "u"
            options = [(4 + best[state][0], "D" + best[state][1])]
            if fault < 2:
                options.append((3 + 3 * fault + best[due][0], "R" + best[due][1]))
                if role[:1] == due or (role[:1] == "s" and state == ""):
                    options.append((3 * fault + best[role[:1]][0], "K" + best[role[:1]][1]))
            new[state] = min(options)
        u, a = min(new["u"], (3 + new["a"][0], "I" + new["a"][1])), min(new["a"], (3 + new["u"][0], "I" + new["u"][1]))
        best = {"": min(new[""], (3 + u[0], "I" + u[1])), "s": min(new["s"], (3 + u[0], "I" + u[1])), "u": u, "a": a}
    return best[""]


def test_nothing_left_and_nothing_there(spark):
    assert repair.repaired_totals(spark.createDataFrame([], SCHEMA)).count() == 0
    gone = next(t for t in range(500) if zlib.crc32(f"7:{t}".encode()) % 20 == 0)
    got = totals(repair.repaired_totals(spark.createDataFrame([(7, gone, "user", "Hi.")], SCHEMA)))
    assert got == {7: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
