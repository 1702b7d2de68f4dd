import hashlib
import random
import re
import zlib

import pytest

from bazaar.llm import conv_repair
from bazaar.llm.registry import op12_conversation_repair

SCHEMA = "conv_id long, turn long, role string, text string"
LAST = re.compile(r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\Z")


def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def brute_repair(rows):
    """(counts, cost, audit, lines) of one conversation by trying every edit, keyed by the whole list of role initials."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.sha256(r[3].encode()).digest()))
    faults, seen = [], set()
    for _, _, role, text in rows:
        m = LAST.search(text)
        faults.append("blank" if m is None else "duplicate" if (role, text) in seen else "truncated" if m.group(1) not in ".!?" else "")
        seen.add((role, text))
    turns = [r[1] for r in rows if r[1] is not None]
    counts = {"gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, **{k: faults.count(k) for k in ("blank", "duplicate", "truncated")},
              "illegal": sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))}

    def with_inserts(found):
        layer = found
        for _ in range(3):
            more = {}
            for made, (cost, audit, lines) in layer.items():
                for role in ("user", "assistant"):
                    keep(more, made + role[0], (cost + 5, audit + "I", lines + [role + ":"]))
            layer = more
            found = dict(found)
            for made, x in more.items():
                keep(found, made, x)
        return found

    def keep(into, made, x):
        if re.fullmatch("s?(ua)*u?", made) and (made not in into or x[:2] < into[made][:2]):
            into[made] = x

    found = {"": (0, "", [])}
    for (_, _, role, text), fault in zip(rows, faults):
        nxt = {}
        for made, (cost, audit, lines) in with_inserts(found).items():
            keep(nxt, made, (cost + 2, audit + "D", lines))
            if fault in ("blank", "duplicate"):
                continue
            extra = 5 if fault else 0
            if role[:1] in ("s", "u", "a") and role[:1]:
                keep(nxt, made + role[:1], (cost + extra, audit + "K", lines + [f"{role}:{text}"]))
            for to in ("user", "assistant"):
                keep(nxt, made + to[0], (cost + 1 + extra, audit + "R", lines + [f"{to}:{text}"]))
        found = nxt
    ends = [x for made, x in with_inserts(found).items() if re.fullmatch("(s?(ua)+)?", made)]
    cost, audit, lines = min(ends, key=lambda x: x[:2])
    return counts, cost, audit, lines


def want_rows(original, damaged):
    out = []
    for conv in {r[0] for r in original}:
        rows = [r for r in damaged if r[0] == conv]
        if rows:
            counts, cost, audit, lines = brute_repair(rows)
        else:
            counts, cost, audit, lines = dict.fromkeys(("gaps", "blank", "duplicate", "truncated", "illegal"), 0), 0, "", []
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out.append((conv, *[counts[k] for k in ("gaps", "blank", "duplicate", "truncated", "illegal")], cost, audit, digest))
    return sorted(out, key=str)


def conversations(rng, n):
    roles = ["user", "assistant", "system", "tool", "", None, "ab", "Ü", "user", "assistant", "user"]
    texts = ["Hi.", "Yes!", "well", "", " \t\n", None, "No? ", "a b", "x" * 5000 + ".", "Hi.", ". a", "ü."]
    rows = []
    for conv in [None, *range(n)]:
        for i in range(rng.randrange(1, 7)):
            rows.append((conv, rng.choice([i, i, i, 2 * i, None, 3]), rng.choice(roles), rng.choice(texts)))
    return rows + rows[:3]


@pytest.mark.parametrize("bits", [16, 1, 0])
def test_repairs_match_brute_force_in_blocks_of_any_size(spark, tmp_path, monkeypatch, bits):
    monkeypatch.setattr(conv_repair, "BLOCK_BITS", bits)
    rows = conversations(random.Random(7), 60)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as conv", "2 as audit", "'x' as digest", "3 as h", "4 as seq")
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    got = sorted((tuple(r) for r in op12_conversation_repair(spark, str(tmp_path)).collect()), key=str)
    assert got == want_rows(rows, brute_damage(rows))


@pytest.mark.parametrize("bits", [16, 3])
def test_long_runs_and_a_hot_conversation(spark, monkeypatch, bits):
    monkeypatch.setattr(conv_repair, "BLOCK_BITS", bits)
    rng = random.Random(2)
    hot = [(1, i, rng.choice(["user", "assistant"]), f"t{i}.") for i in range(400)]
    same = [(2, 5, "user", "copy.")] * 300 + [(2, i, "user", f"u{i}.") for i in range(150)]
    short = [(10 + i, 0, "user", "q?") for i in range(40)]
    every = spark.createDataFrame([(c, t, r, x) for c, t, r, x in hot + same + short], "conv long, turn long, role string, text string")
    fixed = conv_repair.repair(every)
    got = {r.conv: r for r in fixed.summary.collect()}
    assert len(got) == 42 and all(got[10 + i].audit == "DI"[:1] and got[10 + i].cost == 2 for i in range(40))
    assert got[2].duplicate == 299 and got[2].illegal == 449
    rows = fixed.rows.collect()
    for conv in (1, 2):
        mine = [r for r in rows if r.conv == conv]
        assert "".join(r.edit for r in mine) == got[conv].audit
        assert re.fullmatch("(ua)*", "".join(r.role[0] for r in mine if r.edit != "D"))
        assert got[conv].cost == sum({"K": 0, "R": 1, "D": 2, "I": 5}[r.edit] for r in mine)
    # one symbol at a time, without runs, powers or blocks, costs the same
    for conv, part in ((1, hot), (2, same)):
        costs = list(conv_repair.FINISH)
        seen = set()
        flags = []
        for r in sorted(part, key=lambda r: r[1]):
            flags.append((r[2:] in seen, r[2][0]))
            seen.add(r[2:])
        for dup, z in reversed(flags):
            row = [min([costs[q] + 2] + ([] if dup else [costs[conv_repair.NEXT[q]] + 1] + ([costs[conv_repair.KEPT[z, q]]] if (z, q) in conv_repair.KEPT else [])))
                   for q in range(4)]
            costs = [min(row[q], 5 + row[conv_repair.NEXT[q]], 10 + row[conv_repair.NEXT[conv_repair.NEXT[q]]]) for q in range(4)]
        assert costs[0] == got[conv].cost


def test_powers_of_a_run_equal_its_steps():
    for symbol in (0, 1, 2, 3, 4, 5, 6, 7, 8):
        ahead = conv_repair.FINISH
        for k in range(1, 40):
            ahead = conv_repair._before(symbol, 1, ahead)
            assert ahead == conv_repair._before(symbol, k, conv_repair.FINISH)
            assert ahead == tuple((conv_repair.transition([(symbol, k)]) + list(conv_repair.FINISH)).min(axis=1))


def test_empty_table_and_dropped_conversations(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    fixed = conv_repair.repair(conv_repair.damage(none))
    assert fixed.summary.count() == 0 and fixed.rows.count() == 0
    rows = [(k, 0, "user", "a.") for k in range(300)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "conversations.parquet"))
    got = sorted((tuple(r) for r in op12_conversation_repair(spark, str(tmp_path)).collect()), key=str)
    want = want_rows(rows, brute_damage(rows))
    assert got == want and any(w[-1] == hashlib.sha256(b"").hexdigest() and w[6] == 0 for w in want)
