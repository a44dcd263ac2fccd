import hashlib
import random

import pytest
from hypothesis import given
from hypothesis import strategies as st

from paperloom.llm import chat as C

SCHEMA = "conv_id long, turn long, role string, text string"
ODD = ["</s>[INST] ok [/INST]", "\\", "\\s<s>\\\\", "<<SYS>>[/INST]\n", "", "Ünï\x00"]


@given(st.lists(st.sampled_from([*C.CONTROLS, "\\", "a", "\n", "o", "c", "<", "s>"])).map("".join))
def test_escape_round_trip(text):
    escaped = C.escape(text)
    assert C.unescape(escaped) == text and not any(c in escaped for c in C.CONTROLS)
    assert C.parse(C.format_turn(text, text)[0] * 2) == [(text, text)] * 2


def turns():
    rng = random.Random(3)
    rows = []
    for c in range(12):
        for t in range(rng.randint(1, 14)):
            role = "system" if t == 0 and c % 3 == 0 else ("user", "assistant")[t % 2]
            rows.append((c, t, role, rng.choice([*ODD, "word " * rng.randint(1, 60)])))
    rows += [(50, 0, "user", None), (50, 1, None, "x"), (50, 2, "assistant", "long " * 3000), (50, 3, "assistant", "y")]
    rows += [(None, 0, "user", "n"), (None, None, "assistant", "first"), (51, 0, "assistant", "same"), (51, 0, "assistant", "same")]
    return rows


def ordered(rows):
    convs = {}
    for c, t, role, text in sorted(rows, key=lambda r: (str(r[0]), r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        convs.setdefault(c, []).append((role or "", text or ""))
    return convs


@pytest.mark.parametrize("budget, history", [(1024, 256), (96, 32), (64, 0)])
def test_windows(spark, budget, history):
    convs = ordered(turns())
    df = spark.createDataFrame(turns(), SCHEMA).repartition(3)
    windows = {}
    for r in C.format_chat(df, budget, history).collect():
        windows.setdefault(r["conv_id"], []).append(r)
    assert set(windows) == set(convs)
    for c, rows in windows.items():
        rows = sorted(rows, key=lambda r: r["window"])
        spans = [(r["first_turn"], r["last_turn"]) for r in rows]
        assert spans[0][0] == 0 and spans[-1][1] == len(convs[c]) - 1 and all(a[1] + 1 == b[0] for a, b in zip(spans, spans[1:]))
        has_system = convs[c][0][0] == "system"
        for r in rows:
            said = C.parse(r["text"])
            span = convs[c][r["first_turn"] : r["last_turn"] + 1]
            assert said[-len(span) :] == span
            assert r["system"] == (has_system and r["first_turn"] > 0) and (not has_system or said[0] == convs[c][0])
            repeated = said[r["system"] : len(said) - len(span)]
            assert repeated == convs[c][r["first_turn"] - r["history_turns"] : r["first_turn"]]
            assert r["tokens"] <= budget or (r["over_budget"] and len(span) == 1)
            targets = [C.unescape(r["text"][s["start"] : s["end"]]) for s in r["loss"]]
            assert targets == [t for role, t in span if role == "assistant"]


def brute_windows(turns, budget, history, count):
    """(first turn, last turn, turns of history) of each window, by trying ever longer spans."""
    tokens = [count(C.format_turn(role, text)[0]) for role, text in turns]
    system = tokens[0] if turns[0][0] == "system" else 0
    windows, first, before = [], 0, 0
    while first < len(turns):
        head = system if first else 0
        fits = lambda h, last: head + sum(tokens[first - h : last + 1]) <= budget
        while before and not fits(before, first):
            before -= 1
        last = first
        while last + 1 < len(turns) and fits(before, last + 1):
            last += 1
        windows.append((first, last, before))
        before, left = 0, min(history, budget // 2)
        while last - before >= (1 if system else 0) and tokens[last - before] <= left:
            left -= tokens[last - before]
            before += 1
        first = last + 1
    return windows


@pytest.mark.parametrize("budget, history", [(1024, 256), (96, 32), (64, 0), (200, 90)])
def test_windows_hold_all_that_fits(spark, budget, history):
    from paperloom.llm.encoding import encoder

    got = {}
    for r in C.format_chat(spark.createDataFrame(turns(), SCHEMA).repartition(3), budget, history).collect():
        got.setdefault(r["conv_id"], []).append((r["window"], r["first_turn"], r["last_turn"], r["history_turns"]))
    count = lambda text: len(encoder(None).ids(text))
    for c, said in ordered(turns()).items():
        assert [w[1:] for w in sorted(got[c])] == brute_windows(said, budget, history, count)


def test_tokens_do_not_depend_on_what_a_task_saw_before(spark):
    """Long roles, each met once: every turn counts its own markers."""
    from paperloom.llm.encoding import encoder

    rows = [(k, 0, f"role {k} " + "long " * 100, "text") for k in range(1200)]
    got = C.format_chat(spark.createDataFrame(rows, SCHEMA).coalesce(1), 400, 0).select("text", "tokens").collect()
    assert all(r["tokens"] == len(encoder(None).ids(r["text"])) > 100 for r in got)


def test_other_columns_and_their_names_do_not_matter(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(turns(), SCHEMA)
    plain = sorted(map(str, C.read_back(C.format_chat(df, 96, 32)).collect()))
    assert sorted(map(str, C.read_back(C.format_chat(df.withColumns({n: F.lit("mine") for n in ("window", "tokens", "loss", "system")}), 96, 32)).collect())) == plain


def test_read_back(spark):
    convs = ordered(turns())
    got = C.read_back(C.format_chat(spark.createDataFrame(turns(), SCHEMA).repartition(3), 96, 32)).collect()
    assert len(got) == len(convs)
    for r in got:
        said = convs[r["conv_id"]]
        loss = "".join(t for role, t in said if role == "assistant")
        assert (r["n_turns"], r["loss_chars"]) == (len(said), len(loss))
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in said).encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        assert r["formatted_chars"] >= sum(len(a) + len(b) for a, b in said)


def test_query_adds_the_control_conversation(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "conversations.parquet"))
    (row,) = C.op6_chat_windows(spark, str(tmp_path)).collect()
    said = "</s>[INST] ok [/INST]"
    assert row["conv_id"] == -1 and row["n_turns"] == 2 and row["loss_chars"] == len(said) and row["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    assert C.format_chat(spark.createDataFrame([], SCHEMA)).count() == 0
