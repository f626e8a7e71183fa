"""Chat formatting by schema fingerprint.

A record's nested field paths (``messages[].role`` and so on) are hashed; the fingerprint
selects a declarative mapping, which turns the record into canonical turns
``(conv, turn, role, text)``.  Turns are then written with a template that marks them and
escapes control strings inside texts, reversibly, with a loss mask.

The output has one row per turn, so a conversation of any length is never gathered; what
needs a conversation's turns in order streams over a partition sorted by (conv, turn).
"""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.llm.common import cut, ready, slices, small

# ---------------------------------------------------------------- fingerprints


def field_paths(value) -> set[str]:
    """Paths of all leaves of a JSON value, with their kinds.

    List items share the path ``[]``; an item that is a leaf adds ``=``, numbers add ``#n`` and
    booleans ``#b``; strings and nulls add nothing.
    """
    out, todo = set(), [(value, "", False)]
    while todo:
        v, path, item = todo.pop()
        if isinstance(v, dict):
            todo += [(x, f"{path}.{k}" if path else k, False) for k, x in v.items()]
        elif isinstance(v, list):
            todo += [(x, path + "[]", True) for x in v]
            if not v:
                out.add(path + "[]")
        else:
            kind = "#b" if isinstance(v, bool) else "#n" if isinstance(v, int | float) else ""
            out.add(path + "=" * item + kind)
    return out


def fingerprint(paths) -> str:
    return hashlib.md5("\n".join(sorted(paths)).encode()).hexdigest()


@dataclass(frozen=True)
class Mapping:
    """How to read turns from a record with exactly these ``paths``.

    Either ``turns`` names a list whose items hold ``role`` and ``text``, or ``fields``
    lists (role, field names joined by a blank line), one turn each.  ``conv`` and
    ``order`` name the fields of a record that is one turn of a longer conversation.
    """
    name: str
    paths: frozenset
    turns: str = ""
    role: str = ""
    text: str = ""
    fields: tuple = ()
    conv: str = ""
    order: str = ""

    def read(self, r: dict) -> list[tuple]:
        if self.turns:
            return [(k, x.get(self.role), x.get(self.text)) for k, x in enumerate(r[self.turns])]
        if self.order:
            return [(r[self.order], r[self.role], r[self.text])]
        out = []
        for role, names in self.fields:
            parts = [r[n] for n in names if r.get(n)]
            if parts or names[0] in r and role != "system":
                out.append((role, "\n\n".join(parts)))
        return [(k, role, text) for k, (role, text) in enumerate(out)]


def _named(name, *paths, **kw):
    return Mapping(name, frozenset(paths), **kw)


# Field and role names of public layouts.
MAPPINGS = (
    *(_named("turn rows", "conv_id" + c, "turn" + t, "role", "text", conv="conv_id", order="turn", role="role", text="text")
      for c in ("#n", "") for t in ("#n", "")),
    _named("messages", "messages[].role", "messages[].content", turns="messages", role="role", text="content"),
    _named("no messages", "messages[]", turns="messages", role="role", text="content"),
    _named("conversations", "conversations[].from", "conversations[].value", turns="conversations",
           role="from", text="value"),
    _named("instruction", "instruction", "input", "output",
           fields=(("user", ("instruction", "input")), ("assistant", ("output",)))),
    _named("instruction only", "instruction", "output",
           fields=(("user", ("instruction",)), ("assistant", ("output",)))),
    _named("system instruction", "system", "instruction", "input", "output",
           fields=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",)))),
    _named("prompt completion", "prompt", "completion",
           fields=(("user", ("prompt",)), ("assistant", ("completion",)))),
    _named("prompt response", "prompt", "response",
           fields=(("user", ("prompt",)), ("assistant", ("response",)))),
    _named("question answer", "question", "answer",
           fields=(("user", ("question",)), ("assistant", ("answer",)))),
)

# Role names of the layouts.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def registry(mappings=MAPPINGS) -> dict[str, Mapping]:
    out = {fingerprint(m.paths): m for m in mappings}
    if len(out) < len(mappings):
        raise ValueError("two mappings have the same paths")
    return out


def _turns_of(raw: str | None, key, known: dict, roles: dict, whole_ids: bool) -> tuple[list, str]:
    """``[(conv, turn, role, text)]`` and the layout's name of one record; no turns if it has no mapping."""
    try:
        r = json.loads(raw) if raw is not None else {}
    except (ValueError, RecursionError):
        return [], "unparsable"
    print_ = fingerprint(field_paths(r))
    m = known.get(print_)
    if m is None or not isinstance(r, dict):
        return [], print_
    out = []
    for turn, who, what in m.read(r):
        conv = r[m.conv] if m.conv else key
        if m.order and isinstance(turn, str):
            turn = int(turn) if re.fullmatch(r"-?[0-9]{1,18}", turn) else turn
        whole = conv is None or isinstance(conv, int) and abs(conv) < 2**63 or not whole_ids
        if not whole or not (turn is None or isinstance(turn, int) and abs(turn) < 2**63):
            return [], print_                                  # values that the columns can't hold
        out.append((conv if whole_ids or conv is None else str(conv), turn, roles.get(who, who), what))
    return out, m.name


def _reader(mappings, roles, conv_type: pa.DataType):
    def run(batches):
        known = registry(mappings)
        whole_ids = pa.types.is_integer(conv_type)
        for b in batches:
            conv, turn, role, text, layout = [], [], [], [], []
            for key, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found, name = _turns_of(raw, key, known, roles, whole_ids)
                for c, k, who, what in found or [(key, None, None, raw)]:
                    conv.append(c), turn.append(k), role.append(who), text.append(what), layout.append(name)
            yield pa.RecordBatch.from_arrays(
                [pa.array(conv, conv_type), pa.array(turn, pa.int64()), pa.array(role, pa.string()),
                 pa.array(text, pa.string()), pa.array(layout, pa.string())],
                names=["conv", "turn", "role", "text", "layout"])
    return run


def canonical_turns(records: DataFrame, key_col: str, json_col: str, mappings=MAPPINGS, roles=None) -> DataFrame:
    """JSON records of mixed layouts -> ``(conv, turn, role, text, layout)``.

    A record whose fingerprint has no mapping is kept as one row with null turn and role,
    its JSON as text and the fingerprint as layout: add a mapping for it.  So is one that isn't
    JSON (or nested too deeply to read; layout ``unparsable``), one whose ids or turn numbers
    the columns can't hold, and one that a mapping reads without any turn.  Ids are integers or text.
    """
    from pyspark.sql.pandas.types import to_arrow_type
    ready(records.sparkSession)
    r = records.select(F.col(key_col).alias("k"), F.col(json_col).alias("j"))
    t = r.schema["k"].dataType
    return r.mapInArrow(_reader(mappings, ROLES if roles is None else roles, to_arrow_type(t)),
                        f"conv {t.simpleString()}, turn long, role string, text string, layout string")


# A conversation becomes one record up to this many turns and bytes of text; longer ones stay a record a turn.
RECORD_TURNS, RECORD_BYTES = 64, 1 << 20


def as_records(turns: DataFrame) -> DataFrame:
    """``(conv, turn, role, text)`` as JSON records of several layouts: ``(conv, record)``.

    A conversation whose turns are numbered without ties becomes one record: a prompt with its completion
    where it is one user and one assistant turn, else a list of messages in one of two layouts, by the hash of its
    id.  All other rows (long conversations, equal or null turn numbers, null ids, and roles that are null or that
    the layouts rename) become a record each.  A null text is empty; nothing else is lost.
    """
    ready(turns.sparkSession)
    t = turns.select("conv", "turn", "role", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    plain = F.col("role").isNotNull() & ~F.col("role").isin(*ROLES)
    per = t.where("conv is not null").groupBy("conv").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("turn").alias("numbers"), F.bool_and(plain).alias("plain"),
        F.sum(F.octet_length("text")).alias("bytes"))
    whole = per.where(F.col("plain") & (F.col("n") == F.col("numbers")) & (F.col("n") <= RECORD_TURNS)
                      & (F.col("bytes") <= RECORD_BYTES)).select(F.col("conv").alias("whole"))
    whole = small(cut(whole, "whole"))
    single = t.join(whole, F.col("conv") == F.col("whole"), "left_anti").select(
        "conv", F.to_json(F.struct(F.col("conv").alias("conv_id"), "turn", "role", "text"),
                          {"ignoreNullFields": "false"}).alias("record"))
    x = F.col("x")
    pair = (F.size(x) == 2) & (x[0]["role"] == "user") & (x[1]["role"] == "assistant")
    messages = F.transform(x, lambda r: F.struct(r["role"].alias("role"), r["text"].alias("content")))
    said = F.transform(x, lambda r: F.struct(r["role"].alias("from"), r["text"].alias("value")))
    record = (F.when(pair, F.to_json(F.struct(x[0]["text"].alias("prompt"), x[1]["text"].alias("completion"))))
              .when(F.crc32(F.col("conv").cast("string")) % 2 == 0, F.to_json(F.struct(messages.alias("messages"))))
              .otherwise(F.to_json(F.struct(said.alias("conversations")))))
    grouped = (t.join(whole, F.col("conv") == F.col("whole"), "left_semi").groupBy("conv")
               .agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("x")))
    return single.unionByName(grouped.select("conv", record.alias("record")))


# ------------------------------------------------------------------- template

# Strings that mark turns in this template or in common public ones.
CONTROL = ("<|turn|>", "<|text|>", "<|end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>",
           "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>")
_CONTROL = re.compile("|".join(re.escape(c) for c in sorted(CONTROL, key=len, reverse=True)) + r"|\\")
_ESCAPED = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"<\|turn\|>(.*?)<\|text\|>(.*?)<\|end\|>\n", re.S)


def escape(text: str) -> str:
    """A backslash before each backslash, and behind the first character of each control string.

    No control string overlaps another, so none is left; ``unescape`` drops one backslash each.
    """
    return _CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def format_turn(role: str | None, text: str | None) -> tuple[str, int, int]:
    """``(formatted, mask start, mask end)``; the mask covers an assistant's escaped text."""
    head = "<|turn|>" + escape(role or "") + "<|text|>"
    body = escape(text or "")
    out = head + body + "<|end|>\n"
    return out, len(head), len(head) + len(body) if role == "assistant" else len(head)


def parse_turn(formatted: str) -> tuple[str, str]:
    m = _TURN.fullmatch(formatted)
    if not m:
        raise ValueError("not one formatted turn")
    return unescape(m[1]), unescape(m[2])


def _formatter(batches):
    for b in slices(batches):
        rows = [format_turn(r, t) for r, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.array([x[0] for x in rows], pa.string()),
             pa.array([x[1] for x in rows], pa.int64()), pa.array([x[2] for x in rows], pa.int64())],
            names=["conv", "turn", "formatted", "mask_start", "mask_end"])


def format_turns(turns: DataFrame) -> DataFrame:
    """``(conv, turn, role, text)`` -> ``(conv, turn, formatted, mask_start, mask_end)``.

    A conversation's formatted text is its rows' ``formatted`` by turn; the mask is a code
    point range in it (empty for other roles than assistant).  Null texts and roles are
    empty; repeated turns are all formatted; an empty table gives an empty one.
    """
    ready(turns.sparkSession)
    t = turns.select("conv", "turn", "role", "text")
    return t.mapInArrow(_formatter, f"conv {t.schema['conv'].dataType.simpleString()}, turn long, "
                                    "formatted string, mask_start long, mask_end long")


def _digester(batches):
    """Streams turns sorted by (conv, turn): one digest row per conversation, constant memory."""
    state, seen = None, False

    def row(s):
        return [s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), s[5]]

    schema = None
    for b in batches:
        schema = schema or pa.schema([("conv_id", b.schema.field(0).type), ("n_turns", pa.int64()),
                                      ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
                                      ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
        out = []
        for conv, formatted, s, e in zip(*(b.column(k).to_pylist() for k in (0, 2, 3, 4))):
            if not seen or conv != state[0]:
                if seen:
                    out.append(row(state))
                state, seen = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0], True
            role, text = parse_turn(formatted)
            loss = unescape(formatted[s:e])
            state[1] += 1
            state[2].update(f"{role}\n{text}\n".encode())
            state[3] += len(loss)
            state[4].update(loss.encode())
            state[5] += len(formatted)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)
    if seen:
        yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(row(state), schema.types)], schema=schema)


def digest(formatted: DataFrame) -> DataFrame:
    """Per conversation, read back from the formatted turns: counts and digests.

    Turns with equal numbers are taken in the order of their formatted text.  A null
    conversation id is a conversation of its own.
    """
    t = formatted.schema["conv"].dataType.simpleString()
    f = formatted.select("conv", "turn", "formatted", "mask_start", "mask_end")
    s = f.repartition("conv").sortWithinPartitions("conv", "turn", "formatted")
    return s.mapInArrow(_digester, f"conv_id {t}, n_turns long, turns_sha256 string, loss_chars long, "
                                   "loss_sha256 string, formatted_chars long")
