"""Chat formatting: schema fingerprints select declarative mappings to canonical turns.

A record is a JSON text of any layout.  The paths of its fields (``[]`` for
the items of a list), as far as any mapping knows them, are hashed; the hash
picks the mapping, which says by paths alone where roles and texts are.
Unknown layouts are kept, without turns.

The template marks each turn as ``<s>[INST]role[/INST]text</s>``.  Where a role or text
holds one of the four control strings, with any number of backslashes after
its first character, one more backslash is put there; reading takes it away.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain, combinations
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ESCAPE = re.compile(r"<(\\*)(/?s>)|\[(\\*)(/?INST\])")
UNESCAPE = re.compile(r"<\\(\\*)(/?s>)|\[\\(\\*)(/?INST\])")
TURN = re.compile(r"<s>\[INST\](.*?)\[/INST\](.*?)</s>", re.DOTALL)
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "model": "assistant", "bot": "assistant"}


@dataclass(frozen=True)
class Mapping:
    """One layout.  ``steps`` are (role, path of the text) for single fields; ``turns`` is (list, role field, text field)."""

    name: str
    steps: tuple[tuple[str, str], ...] = ()
    turns: tuple[str, str, str] | None = None
    optional: tuple[str, ...] = field(default=())

    def paths(self) -> tuple[str, ...]:
        return (*(p for _, p in self.steps), *((self.turns[0], f"{self.turns[0]}[].{self.turns[1]}", f"{self.turns[0]}[].{self.turns[2]}") if self.turns else ()))


MAPPINGS = (
    Mapping("messages", turns=("messages", "role", "content")),
    Mapping("messages_text", turns=("messages", "role", "text")),
    Mapping("system_messages", steps=(("system", "system"),), turns=("messages", "role", "content")),
    Mapping("conversations", turns=("conversations", "from", "value")),
    Mapping("system_conversations", steps=(("system", "system"),), turns=("conversations", "from", "value")),
    Mapping("instruction", steps=(("system", "system"), ("user", "instruction"), ("user", "input"), ("assistant", "output")), optional=("system", "input")),
    Mapping("prompt_response", steps=(("system", "system"), ("user", "prompt"), ("assistant", "response")), optional=("system",)),
    Mapping("prompt_completion", steps=(("system", "system"), ("user", "prompt"), ("assistant", "completion")), optional=("system",)),
    Mapping("question_answer", steps=(("system", "system"), ("user", "question"), ("assistant", "answer")), optional=("system",)),
    Mapping("nested_messages", turns=("data.messages", "role", "content")),
)


def field_paths(value: Any, at: str = "") -> Iterator[str]:
    """Paths of all fields below a value, the same one once for each time it occurs."""
    if isinstance(value, dict):
        for name, below in value.items():
            yield (path := f"{at}.{name}" if at else name)
            yield from field_paths(below, path)
    elif isinstance(value, list):
        for below in value:
            yield from field_paths(below, f"{at}[]")


def fingerprint(paths: Iterable[str]) -> str:
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()[:16]


class Registry:
    """Mappings by fingerprint: one for each choice of a mapping's optional fields."""

    def __init__(self, mappings: Iterable[Mapping] = MAPPINGS):
        mappings = tuple(mappings)
        self.known = {p for m in mappings for p in m.paths()} | {p[:k] for m in mappings for p in m.paths() for k in range(len(p)) if p[k] == "."}
        self.known = {p.removesuffix("[]") for p in self.known}
        self.by_print: dict[str, Mapping] = {}
        for m in mappings:
            for absent in chain.from_iterable(combinations(m.optional, n) for n in range(len(m.optional) + 1)):
                paths = [p for p in m.paths() if p not in absent]
                parents = [p[:k].removesuffix("[]") for p in paths for k in range(len(p)) if p[k] == "."]
                self.by_print.setdefault(fingerprint([*paths, *parents]), m)

    def print_of(self, record: Any) -> str:
        return fingerprint(p for p in field_paths(record) if p in self.known)

    def turns(self, record: Any) -> tuple[str, str | None, list[tuple[str, str]]]:
        """Fingerprint, name of the mapping or None, canonical turns."""
        mark = self.print_of(record)
        mapping = self.by_print.get(mark)
        if mapping is None:
            return mark, None, []
        get = lambda path: (lambda v: [v := v.get(p) if isinstance(v, dict) else None for p in path.split(".")][-1])(record)
        found = [(role, _text(get(path))) for role, path in mapping.steps if get(path) not in (None, "")]
        if mapping.turns:
            where, role, text = mapping.turns
            found += [((_role if role == "from" else _text)(item.get(role)), _text(item.get(text))) for item in get(where) or [] if isinstance(item, dict)]
        return mark, mapping.name, found


def _text(value: Any) -> str:
    """Texts as they are, null as empty, anything else as JSON."""
    return value if isinstance(value, str) else "" if value is None else json.dumps(value, ensure_ascii=False)


def _role(value: Any) -> str:
    return ROLES.get(value, value) if isinstance(value, str) else _text(value)


def escape(text: str) -> str:
    return ESCAPE.sub(lambda m: f"<\\{m[1]}{m[2]}" if m[2] else f"[\\{m[3]}{m[4]}", text)


def unescape(text: str) -> str:
    return UNESCAPE.sub(lambda m: f"<{m[1]}{m[2]}" if m[2] else f"[{m[3]}{m[4]}", text)


def render(turns: Iterable[tuple[str, str]], learn: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The formatted text and the spans, in code points, that the loss mask covers: the texts of role ``learn``."""
    out, at, spans = [], 0, []
    for role, text in turns:
        start, body = f"<s>[INST]{escape(role)}[/INST]", escape(text)
        if role == learn:
            spans.append((at + len(start), at + len(start) + len(body)))
        out.append(f"{start}{body}</s>")
        at += len(out[-1])
    return "".join(out), spans


def read_back(formatted: str) -> list[tuple[str, str]]:
    return [(unescape(m[1]), unescape(m[2])) for m in TURN.finditer(formatted)]


def format_chats(records: DataFrame, record: str = "record", mappings: Iterable[Mapping] = MAPPINGS, learn: str = "assistant") -> DataFrame:
    """All columns of ``records`` and ``schema_print``, ``layout``, ``formatted`` and ``loss_spans``.

    ``record`` holds JSON texts.  Null and broken ones, and layouts without a
    mapping, have a null layout, an empty text and no spans; records with no
    turns an empty text.  Repeated rows come back repeated.  The four names
    must not be columns already.
    """
    names = ["schema_print", "layout", "formatted", "loss_spans"]
    if taken := set(names) & set(records.columns):
        raise ValueError(f"columns {sorted(taken)} exist")
    mappings = tuple(mappings)

    @F.pandas_udf("schema_print string, layout string, formatted string, loss_spans array<struct<start: int, stop: int>>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        registry = Registry(mappings)
        for part in parts:
            rows = []
            for text in part:
                try:
                    value = json.loads(text) if text is not None else None
                except ValueError:
                    value = None
                mark, name, turns = registry.turns(value)
                formatted, spans = render(turns, learn)
                rows.append((mark, name, formatted, [{"start": a, "stop": b} for a, b in spans]))
            yield pd.DataFrame(rows, columns=names)

    return records.withColumn("_chat", run(F.col(record))).select(*records.columns, *(F.col(f"_chat.{n}").alias(n) for n in names))


def from_turns(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One record of layout ``messages`` for each key from a table of turns, ordered by turn, then role and text.

    Null roles and texts count as empty, null turns come first, repeated rows
    are turns of their own; rows with a null key form one record.  A
    conversation is one text in the end, so its turns have to meet in one row.
    """
    clean = rows.select(F.col(key), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("content"))
    listed = clean.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("turn", "role", "content"))).alias("m"))
    return listed.select(key, F.to_json(F.struct(F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))).alias("record"))


def digests(chats: DataFrame) -> DataFrame:
    """``chats`` and what can be read back from ``formatted`` and ``loss_spans`` alone, as digests of texts."""

    @F.pandas_udf("n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, spans in parts:
            rows = []
            for text, span in zip(texts, spans, strict=True):
                turns = read_back(text)
                loss = "".join(unescape(text[s["start"]: s["stop"]]) for s in span)
                sha = lambda t: hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest()
                rows.append((len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(text)))
            yield pd.DataFrame(rows, columns=["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return chats.withColumn("_read", run("formatted", "loss_spans")).select(*chats.columns, "_read.*")
