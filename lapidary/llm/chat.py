"""Chat formatting by schema fingerprints.

A record's fingerprint is the hash of its sorted nested field paths. It selects
a declarative mapping that turns the record's layout (messages, shared
conversations, instructions, prompts, questions) into canonical turns; a new
fingerprint is resolved once, to the most specific mapping whose paths it has,
and remembered. Turns are written with a template that marks them, and control
strings inside roles and texts are escaped so that reading back is exact.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

# Layouts. `needs`: paths a record must have. `turns`: steps in order,
# ("each", list path, role key, text key) or ("field", role, paths of the parts of its text).
MAPPINGS: dict[str, dict] = {
    "messages": {"needs": ["messages[].content", "messages[].role"], "turns": [("each", "messages", "role", "content")]},
    "system_messages": {
        "needs": ["messages[].content", "messages[].role", "system"],
        "turns": [("field", "system", ["system"]), ("each", "messages", "role", "content")],
    },
    "conversations": {"needs": ["conversations[].from", "conversations[].value"], "turns": [("each", "conversations", "from", "value")]},
    "turns": {"needs": ["turns[].role", "turns[].text"], "turns": [("each", "turns", "role", "text")]},
    "instruction": {"needs": ["instruction", "output"], "turns": [("field", "user", ["instruction"]), ("field", "assistant", ["output"])]},
    "instruction_input": {
        "needs": ["input", "instruction", "output"],
        "turns": [("field", "user", ["instruction", "input"]), ("field", "assistant", ["output"])],
    },
    "instruction_response": {"needs": ["instruction", "response"], "turns": [("field", "user", ["instruction"]), ("field", "assistant", ["response"])]},
    "prompt_completion": {"needs": ["completion", "prompt"], "turns": [("field", "user", ["prompt"]), ("field", "assistant", ["completion"])]},
    "prompt_response": {"needs": ["prompt", "response"], "turns": [("field", "user", ["prompt"]), ("field", "assistant", ["response"])]},
    "question_answer": {"needs": ["answer", "question"], "turns": [("field", "user", ["question"]), ("field", "assistant", ["answer"])]},
}
# Role names that mean a canonical role.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatbot": "assistant"}
START, END = "<|im_start|>", "<|im_end|>\n"


def paths(value, at: str = "") -> set[str]:
    """The nested field paths of a parsed record; list items add []."""
    if isinstance(value, dict):
        return {p for k, v in value.items() for p in paths(v, f"{at}.{k}" if at else k)} or ({at} if at else set())
    if isinstance(value, list):
        return {p for v in value for p in paths(v, at + "[]")} or {at + "[]"}
    return {at}


def fingerprint(value) -> str:
    return hashlib.sha256("\n".join(sorted(paths(value))).encode()).hexdigest()[:16]


def resolve(found: set[str], mappings: dict[str, dict] = MAPPINGS) -> str | None:
    """The mapping with the most needed paths among those that the record satisfies; ties by name."""
    # an empty list has no item paths: it fits a mapping over that list
    fits = lambda p: p in found or ("[]" in p and p.split(".")[0] in found)
    fit = [(-len(m["needs"]), name) for name, m in mappings.items() if all(map(fits, m["needs"]))]
    return min(fit)[1] if fit else None


def _text(v) -> str:
    return "" if v is None else v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)


def turns_of(record: dict, mapping: dict) -> list[tuple[str, str]]:
    out = []
    for kind, a, b, *c in mapping["turns"]:
        if kind == "each":
            for item in record.get(a) or []:
                role = _text(item.get(b))
                out.append((ROLES.get(role, role), _text(item.get(c[0]))))
        else:
            parts = [t for t in (_text(record.get(p)) for p in b) if t]
            out.append((a, "\n\n".join(parts)))
    return out


def escape(text: str) -> str:
    """No control string survives: every < and [ is followed by a backslash, and backslashes are doubled."""
    return text.replace("\\", "\\\\").replace("<", "<\\").replace("[", "[\\")


def unescape(text: str) -> str:
    return re.sub(r"([<\[])\\|\\(\\|n)", lambda m: m[1] or ("\n" if m[2] == "n" else "\\"), text)


def write_turns(turns: list[tuple[str, str]], learn: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The formatted string and the spans (code points, end exclusive) that carry loss: the texts of role `learn`."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape(role).replace(chr(10), chr(92) + 'n')}\n", escape(text)
        if role == learn:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted string; the inverse of write_turns."""
    out, at = [], 0
    while at < len(formatted):
        line, end = formatted.index("\n", at), formatted.index(END, at)
        out.append((unescape(formatted[at + len(START) : line]), unescape(formatted[line + 1 : end])))
        at = end + len(END)
    return out


def format_records(df: DataFrame, record: str, mappings: dict[str, dict] = MAPPINGS, learn: str = "assistant") -> DataFrame:
    """df with the JSON column `record` replaced by fingerprint, layout, formatted and loss_spans.

    A record that is null, not a JSON object or of no known layout keeps its
    row: layout null, formatted empty, no spans. Null roles and texts are
    empty. Records of no turns give an empty string. Texts are kept whole.
    """
    common.ship(df.sparkSession)
    made = ["fingerprint", "layout", "formatted", "loss_spans"]
    rest = [c for c in df.columns if c != record and c.lower() not in made]
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType(
        [*(df.schema[c] for c in rest), *(T.StructField(c, T.StringType()) for c in made[:3]), T.StructField(made[3], T.ArrayType(span))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, str | None] = {}
        kinds = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            rows = []
            for raw in batch.column(len(rest)).to_pylist():
                try:
                    value = json.loads(raw) if raw is not None else None
                except ValueError:
                    value = None
                if not isinstance(value, dict):
                    rows.append((None, None, "", []))
                    continue
                mark = fingerprint(value)
                if mark not in known:
                    known[mark] = resolve(paths(value), mappings)
                name = known[mark]
                text, spans = write_turns(turns_of(value, mappings[name]), learn) if name else ("", [])
                rows.append((mark, name, text, [{"start": a, "end": b} for a, b in spans]))
            columns = list(zip(*rows, strict=True)) or [[], [], [], []]
            new = [*(pa.array(c, pa.string()) for c in columns[:3]), pa.array(columns[3], kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], *new], [*rest, *made])

    return df.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{record}`")).mapInArrow(run, schema)


def conversation_records(df: DataFrame, id_col: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One JSON record of layout `turns` per conversation, from rows by turn.

    Rows sort by turn (null first), then role and text; repeated rows stay. A
    null id is a conversation of its own. A conversation is one record and must
    fit a task: its length, not the table's, is the bound.
    """
    item = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    grouped = df.groupBy(F.col(id_col).alias(id_col)).agg(F.sort_array(F.collect_list(item)).alias("turns"))
    slim = F.transform("turns", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    return grouped.select(id_col, F.to_json(F.struct(slim.alias("turns"))).alias("record"))


def read_back(df: DataFrame, id_col: str) -> DataFrame:
    """Digests read back from formatted and loss_spans alone."""
    common.ship(df.sparkSession)
    schema = T.StructType(
        [
            df.schema[id_col],
            T.StructField("n_turns", T.LongType()),
            T.StructField("turns_sha256", T.StringType()),
            T.StructField("loss_chars", T.LongType()),
            T.StructField("loss_sha256", T.StringType()),
            T.StructField("formatted_chars", T.LongType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                turns = read_turns(text)
                said = "".join(f"{r}\n{t}\n" for r, t in turns)
                loss = unescape("".join(text[s["start"] : s["end"]] for s in spans))
                digest = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
                rows.append((len(turns), digest(said), len(loss), digest(loss), len(text)))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            new = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *new], schema.names)

    return df.select(id_col, "formatted", "loss_spans").mapInArrow(run, schema)
