"""Conversations through records of several layouts, against plain Python digests."""

import hashlib
import os
import sys
from collections import Counter, defaultdict

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from conftest import SF_SMALL, spark  # noqa: E402,F401

from winnow.llm import chatformat  # noqa: E402
from winnow.llm.queries import QUERIES  # noqa: E402

TURNS = "conv long, turn long, role string, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute(rows):
    """conv -> (turns, their digest, loss characters, their digest) of rows (conv, turn, role, text) without ties."""
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn, role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0))
        loss = "".join(t for _, r, t in turns if r == "assistant")
        out[conv] = (len(turns), sha("".join(f"{r}\n{t}\n" for _, r, t in turns)), len(loss), sha(loss))
    return out


def found(df):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in df.collect()}


def test_query_against_plain_python(spark):  # noqa: F811
    said = "</s>[INST] ok [/INST]"
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = brute(rows + [(-1, 0, "user", said), (-1, 1, "assistant", said)])
    assert found(QUERIES["op6_chat_format"](spark, SF_SMALL)) == want


def test_every_layout_keeps_all_text(spark):  # noqa: F811
    odd = ["", " \n\t", '"quoted" \\ back', "<|turn|>a<|text|>", "é 漢 \U0001f600", "\x00\x1f", "</s>\\[INST]", "{}", "null"]
    rows = []
    for c in range(40):                                             # lists of messages and pairs
        who = ["user", "assistant"] if c % 4 == 0 else ["system", "user", "assistant", "tool", "user"][:2 + c % 4]
        rows += [(c, 10 * k, r, odd[(c + k) % 9]) for k, r in enumerate(who)]
    rows += [(100, k, ["user", "assistant"][k % 2], f"long {k}") for k in range(500)]
    rows += [(101, 0, "user", "x" * (2 << 20)), (101, 1, "assistant", None)]
    rows += [(102, 0, "human", "a"), (103, 0, None, "b"), (104, None, "user", "c"), (104, 3, "assistant", "d")]
    rows += [(105, -5, "user", None), (105, 2**62, "assistant", "")]
    df = spark.createDataFrame(rows, TURNS).repartition(3)
    turns = chatformat.canonical_turns(chatformat.as_records(df), "conv", "record")
    kinds = Counter(r.layout for r in turns.collect())
    assert set(kinds) == {"turn rows", "messages", "conversations", "prompt completion"}
    assert kinds["turn rows"] == 500 + 2 + 1 + 1 + 2
    want = brute([(c, k, "user" if r == "human" else r, t) for c, k, r, t in rows])       # the registry renames it
    assert found(chatformat.digest(chatformat.format_turns(turns))) == want


def test_ties_repeats_and_null_ids(spark):  # noqa: F811
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (2, 1, "user", "x"), (2, 1, "user", "x"),
            (None, 0, "user", "n"), (None, 1, "assistant", "m")]
    df = spark.createDataFrame(rows, TURNS)
    got = found(chatformat.digest(chatformat.format_turns(chatformat.canonical_turns(chatformat.as_records(df), "conv", "record"))))
    assert got == {1: (2, sha("user\na\nuser\nb\n"), 0, sha("")), 2: (2, sha("user\nx\nuser\nx\n"), 0, sha("")),
                   None: (2, sha("user\nn\nassistant\nm\n"), 1, sha("m"))}
    none = chatformat.as_records(df.limit(0))
    assert none.columns == ["conv", "record"] and none.count() == 0
