"""Repair of conversations against all edits tried out, and a programme over whole audits for long ones."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from paperloom.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string"
LEGAL = re.compile(r"(s?(ua)+)?")
SPACE = " \t\n\x0b\x0c\r"


def faults(rows):
    """rows in order: (turn, role, text) → 0 none, 1 blank, 2 duplicate, 3 truncated."""
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.rstrip(SPACE)
        out.append(1 if not bare else 2 if (role, text) in seen else 3 if bare[-1] not in ".!?" else 0)
        seen.add((role, text))
    return out


def ordered(rows):
    clean = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    return sorted(clean, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))


def all_edits(rows):
    """(cost, audit, repaired) by trying every edit, with up to two inserted turns before each row and at the end."""
    wrong = faults(rows)
    gaps = [list(c) for n in range(3) for c in itertools.product(["user", "assistant"], repeat=n)]
    ways = [(0, "", ())]
    for k, (_, role, text) in enumerate(rows):
        options = [(2, "D", ())]
        if wrong[k] not in (1, 2):
            more = 5 if wrong[k] == 3 else 0
            options += [(more, "K", ((role, text),))] + [(1 + more, "R", ((r, text),)) for r in ("user", "assistant")]
        ways = [(c + 5 * len(g) + p, a + "I" * len(g) + e, done + tuple((r, "") for r in g) + kept) for c, a, done in ways for g in gaps for p, e, kept in options]
        least = min(w[0] for w in ways)
        ways = [w for w in ways if w[0] <= least + 20]  # ten more than two inserted turns can make good
    ended = [(c + 5 * len(g), a + "I" * len(g), done + tuple((r, "") for r in g)) for c, a, done in ways for g in gaps]
    return min(w for w in ended if LEGAL.fullmatch("".join(r[:1] or "-" for r, _ in w[2])))


def by_strings(rows):
    """(cost, audit, repaired roles) with one edit a step, audits whole."""
    wrong, layer = faults(rows), {0: (0, "", ())}
    after = {0: (2, "user"), 1: (2, "user"), 2: (3, "assistant"), 3: (2, "user")}

    def insert(layer):
        for _ in range(4):
            for s, (c, a, roles) in list(layer.items()):
                to, role = after[s]
                way = (c + 5, a + "I", (*roles, role))
                layer[to] = min(layer.get(to, way), way, key=lambda w: w[:2])
        return layer

    # Audits that end in inserts may be the beginning of others: take the row's edit along before comparing.
    for k, (_, role, _) in enumerate(rows):
        found = {}
        for s, (c, a, roles) in layer.items():
            at, run, added = s, 0, ()
            while run < 4:
                ways = [(2, "D", at, ())]
                if wrong[k] not in (1, 2):
                    more = 5 if wrong[k] == 3 else 0
                    first = role[:1]
                    if at == 0 and first == "s":
                        ways.append((more, "K", 1, (role,)))
                    elif first == after[at][1][0]:
                        ways.append((more, "K", after[at][0], (role,)))
                    ways.append((1 + more, "R", after[at][0], (after[at][1],)))
                for price, edit, to, kept in ways:
                    way = (c + 5 * run + price, a + "I" * run + edit, roles + added + kept)
                    found[to] = min(found.get(to, way), way, key=lambda w: w[:2])
                at, added, run = after[at][0], (*added, after[at][1]), run + 1
        layer = found
    return min((w for s, w in insert(layer).items() if s in (0, 3)), key=lambda w: w[:2])


def conversation(rng, n):
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "ubuntu"]
    texts = ["Yes.", "No!", "Why?", "cut off", "", " \t\n", None, "Ends. \n", "“Ja”", "x" * 30 + "."]
    return [(rng.choice([None, *range(n)]) if rng.random() < 0.3 else k, rng.choice(roles), rng.choice(texts) if rng.random() < 0.6 else f"Turn {k}.") for k in range(n)]


def held(spark, conversations, **settings):
    turns = spark.createDataFrame([(c, *r) for c, rows in conversations.items() for r in rows], SCHEMA).withColumnsRenamed({})
    audited, repaired = repair.repair(turns, **settings)
    said = {}
    for r in sorted(repaired.collect(), key=lambda r: (str(r["conv_id"]), r["at"])):
        said.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    digests = {r["conv_id"]: r["repaired_sha256"] for r in repair.digests(repaired).collect()}
    for c, rows in said.items():
        assert digests[c] == hashlib.sha256("\n".join(f"{r}:{t}" for r, t in rows).encode()).hexdigest()
    return {r["conv_id"]: r for r in audited.collect()}, said


@pytest.mark.parametrize("size", [1, 2, 4096])
def test_every_edit_tried(spark, size):
    rng = random.Random(7)
    conversations = {k: conversation(rng, rng.randint(1, 3)) for k in range(60)} | {None: conversation(rng, 3)}
    audited, said = held(spark, conversations, size=size)
    assert set(audited) == set(conversations)
    for c, rows in conversations.items():
        rows = ordered(rows)
        cost, audit, repaired = all_edits(rows)
        row, wrong = audited[c], faults(rows)
        assert (row["cost"], row["audit"], said.get(c, [])) == (cost, audit, list(repaired)), rows
        assert [row["blank"], row["duplicate"], row["truncated"]] == [wrong.count(k) for k in (1, 2, 3)]
        initials = [r[1][:1] for r in rows]
        assert row["illegal"] == sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        turns = {r[0] for r in rows} - {None}
        assert row["gaps"] == (max(turns) - min(turns) + 1 - len(turns) if turns else 0)


@pytest.mark.parametrize("size, hot_rows", [(3, 5), (64, None)])
def test_long_conversations_in_segments(spark, size, hot_rows):
    rng = random.Random(11)
    conversations = {k: conversation(rng, n) for k, n in enumerate([400, 7, 150, 1, 33])}
    audited, said = held(spark, conversations, size=size, hot_rows=hot_rows)
    for c, rows in conversations.items():
        cost, audit, roles = by_strings(ordered(rows))
        assert (audited[c]["cost"], audited[c]["audit"]) == (cost, audit)
        assert tuple(r for r, _ in said.get(c, [])) == roles and LEGAL.fullmatch("".join(r[0] for r in roles))


def test_damage_follows_the_crc(spark):
    rng = random.Random(2)
    rows = [(rng.randint(0, 9), k % 13, rng.choice(["user", "assistant"]), "A. b! c?") for k in range(300)] + [(None, None, None, None), (3, None, "user", None)]
    want = []
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        want += [] if kind == 0 else [(c, t, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    got = repair.damage(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_query_names_every_conversation(spark, tmp_path):
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = [(dropped, 0, "user", "Gone."), (None, 1, "user", "Hm"), (None, 2, "assistant", "So."), (5, 1, "user", "Who?"), (5, 2, "assistant", "Me.")]
    clash = "conv_id long, turn long, role string, text string, key string, part string, kind string, audit string, none string"
    spark.createDataFrame([(*r, "x", "x", "x", "x", "x") for r in rows], clash).write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r["conv_id"]: r for r in repair.op13_conversation_repair(spark, str(tmp_path)).collect()}
    assert set(got) == {dropped, None, 5}
    assert tuple(got[dropped])[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())


def test_empty_table(spark):
    audited, repaired = repair.repair(spark.createDataFrame([], SCHEMA))
    assert audited.count() == 0 and repaired.count() == 0
