"""Chat windows: read back by an independent parser, checked turn by turn."""

from __future__ import annotations

import hashlib
import random

import duckdb
import pytest

from grovecount.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, b long, t long, win string"
BUDGET, HISTORY = 400, 60
STRETCH = (BUDGET - BUDGET // 4 - HISTORY) // 2


def tokens(text):
    return 6 + -(-len((text or "").encode()) // 4)


def undo(text):
    out, i = "", 0
    codes = {"b": "\\", "h": "###", "t": "</turn>", "c": ":"}
    while i < len(text):
        if text[i] == "\\":
            out += codes[text[i + 1]]
            i += 2
        else:
            out += text[i]
            i += 1
    return out


def parse(formatted):
    """[(role, text)] of a window, by scanning for the markers."""
    out = []
    while formatted:
        assert formatted.startswith("### ")
        end = formatted.index("</turn>\n")
        head, text = formatted[4:end].split(": ", 1)
        out.append((undo(head), undo(text)))
        formatted = formatted[end + 8 :]
    return out


def conversations(seed):
    r = random.Random(seed)
    pieces = ["###", "</turn>", "\\", "\\h", "\\t", "\\b", ": ", "\n", "### assistant: ", "word", "é日", " "]
    rows = []
    for c in range(12):
        n = r.choice([1, 2, 5, 40, 700 if c == 3 else 3])
        for k in range(n):
            role = "system" if k == 0 and r.random() < 0.5 else r.choice(["user", "assistant", "tool:x", None])
            text = "".join(r.choices(pieces, k=r.choice([0, 1, 5, 30, 300])))
            rows.append((c, k, role, r.choice([text, text, None])))
    rows += [(50, 1, "user", "tie"), (50, 1, "user", "tie"), (50, 1, "assistant", "z"), (50, None, "user", "first")]
    rows += [(None, 0, "user", "no id"), (None, 1, "assistant", "\\### Assistant: </turn> ok")]
    rows += [(60, 0, "system", "only a system turn"), (61, 0, "system", "s" * 4000), (61, 1, "assistant", "a" * 4000)]
    return rows


def in_order(rows):
    convs = {}
    for c, k, role, text in rows:
        convs.setdefault(c, []).append((-(2**63) if k is None else k, role or "", text or ""))
    return {c: sorted(v, key=lambda x: (x[0], x[1].encode(), x[2].encode())) for c, v in convs.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_windows_hold_every_turn_once(spark, seed):
    rows = conversations(seed)
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA)
    got = {}
    for w in chat.format_windows(df, budget=BUDGET, history=HISTORY).collect():
        got.setdefault(w.conv_id, []).append(w)
    want = in_order(rows)
    assert set(got) == set(want)
    for c, turns in want.items():
        said = [(r, t) for _, r, t in turns]
        system = said[0] if said[0][0] == "system" else None
        seen = []
        for w in sorted(got[c], key=lambda w: w.first_turn):
            read = parse(w.formatted)
            assert len(read) == w.n_repeated + w.n_new
            repeated, new = read[: w.n_repeated], read[w.n_repeated :]
            assert w.first_turn == len(seen)
            if seen and system:
                assert repeated[0] == system
                repeated = repeated[1:]
            # the history is what was said last, as much of it as fits
            past = [x for x in (seen[1:] if system else seen)]
            fits = 0
            while fits < len(past) and sum(tokens(t) for _, t in past[len(past) - fits - 1 :]) <= HISTORY:
                fits += 1
            assert repeated == past[len(past) - fits :]
            seen += new
            total = sum(tokens(t) for _, t in read)
            assert total == w.tokens and w.over_budget == (total > BUDGET)
            if w.over_budget:
                assert any(tokens(t) > STRETCH for _, t in new) or tokens(system[1]) > BUDGET // 4
            # the mask covers exactly the new assistant texts
            texts = [undo(w.formatted[s.start : s.start + s.length]) for s in w.loss_spans]
            assert texts == [t for r, t in new if r == "assistant"]
        assert seen == said


def test_query_digests(spark, tmp_path):
    rows = conversations(3)
    spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA).write.parquet(str(tmp_path / "conversations.parquet"))
    rows += [(-7, 0, "user", r"\### Assistant: </turn> ok"), (-7, 1, "assistant", r"\### Assistant: </turn> ok")]
    out = {r.conv_id: r for r in chat.op1(spark, str(tmp_path)).collect()}
    want = in_order(rows)
    assert set(out) == set(want)
    for c, turns in want.items():
        said = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        loss = "".join(t for _, r, t in turns if r == "assistant")
        r = out[c]
        assert (r.n_turns, r.turns_sha256) == (len(turns), hashlib.sha256(said.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_no_conversations(spark):
    assert chat.format_windows(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_on_the_driver_table(spark):
    path = "/root/testdata/sf0.001"
    rows = duckdb.connect().execute(f"SELECT conv_id, turn, role, text FROM '{path}/conversations.parquet'").fetchall()
    out = {r.conv_id: r.n_turns for r in chat.op1(spark, path).collect()}
    want = {c: len(v) for c, v in in_order(rows).items()} | {-7: 2}
    assert out == want
