"""Conversations in several formats as turns: one row per message with role and content.

Each reader takes (conv_id, content) rows and gives (conv_id, turn, role, content, timestamp). Texts in none of the
formats give nothing; broken lines and parts are skipped.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Prefixes of turns in plain text, and their roles.
PREFIX = r"(?i)^(User|Human|Assistant|AI|System):\s*"
ROLES = {"user": "user", "human": "user", "assistant": "assistant", "ai": "assistant", "system": "system"}
TURNS = "conv_id bigint, turn int, role string, content string, timestamp string"


def detect_format(content: Column) -> Column:
    """agent-jsonl, message-tree, hosted-chat, team-chat or plaintext, by the keys of the JSON."""
    t = F.trim(content)
    return (
        F.when(t.startswith("{") & t.contains("\n{") & t.rlike(r'"(type|message)"\s*:'), "agent-jsonl")
        .when(t.contains('"chat_messages"'), "hosted-chat")
        .when(t.contains('"mapping"'), "message-tree")
        .when(t.startswith("[") & t.rlike(r'"ts"\s*:'), "team-chat")
        .when(t.startswith("{") & t.rlike(r'"(type|message)"\s*:'), "agent-jsonl")
        .otherwise("plaintext")
    )


def _role(prefix: Column) -> Column:
    p = F.lower(prefix)
    return F.when(p.isin("user", "human"), "user").when(p.isin("assistant", "ai"), "assistant").when(p == "system", "system")


def plaintext_turns(df: DataFrame) -> DataFrame:
    """Turns of plain text: a line with a role's prefix begins one, other lines continue it, lines before the first
    are dropped, empty turns too. All inside the row's array of lines, so nothing is shuffled."""
    lines = F.split(F.coalesce("content", F.lit("")), "\n")
    # a fold over the lines: (role, text) of each turn
    init = F.array().cast("array<struct<role:string,content:string>>")

    def step(acc: Column, line: Column) -> Column:
        prefix = F.regexp_extract(line, PREFIX, 1)
        fresh = F.struct(_role(prefix).alias("role"), F.trim(F.regexp_replace(line, PREFIX, "")).alias("content"))
        last = F.element_at(acc, -1)
        longer = F.struct(last["role"].alias("role"), F.concat(last["content"], F.when(last["content"] == "", "").otherwise("\n"), line).alias("content"))
        return F.when(prefix != "", F.concat(acc, F.array(fresh))).when(F.size(acc) > 0, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(longer))).otherwise(acc)

    turns = F.filter(F.transform(F.aggregate(lines, init, step), lambda t: F.struct(t["role"].alias("role"), F.regexp_replace(t["content"], r"(?U)^\s+|\s+$", "").alias("content"))), lambda t: t["content"] != "")
    return df.select("conv_id", F.posexplode(turns).alias("turn", "t")).select("conv_id", "turn", "t.role", "t.content", F.lit(None).cast("string").alias("timestamp"))


def _parts(content: object) -> str:
    if isinstance(content, str):
        return content
    if isinstance(content, list):
        return "\n".join(p["text"] for p in content if isinstance(p, dict) and isinstance(p.get("text"), str))
    return ""


def parse(text: str | None) -> list[tuple[str, str, str | None]]:
    """(role, content, timestamp) of a conversation in one of the JSON formats."""
    t, out = (text or "").strip(), []
    try:
        whole = json.loads(t)
    except ValueError:
        whole = None
    if isinstance(whole, dict) and isinstance(whole.get("chat_messages"), list):
        for m in whole["chat_messages"]:
            if isinstance(m, dict) and str(m.get("text") or "").strip():
                out.append(("user" if m.get("sender") == "human" else "assistant", m["text"].strip(), m.get("created_at")))
        return out
    if isinstance(whole, dict) and isinstance(whole.get("mapping"), dict):
        nodes = whole["mapping"]
        todo = [k for k, n in nodes.items() if isinstance(n, dict) and not n.get("parent")]
        seen: set[str] = set()
        while todo:
            k = todo.pop(0)
            n = nodes.get(k)
            if k in seen or not isinstance(n, dict):
                continue
            seen.add(k)
            todo += [c for c in n.get("children") or [] if isinstance(c, str)]
            m = n.get("message")
            if isinstance(m, dict) and isinstance(m.get("content"), dict):
                role = (m.get("author") or {}).get("role")
                body = "\n".join(p for p in m["content"].get("parts") or [] if isinstance(p, str)).strip()
                if role in ("user", "assistant", "system") and body:
                    out.append((role, body, None if m.get("create_time") is None else str(m["create_time"])))
        return out
    if isinstance(whole, list):
        for m in whole:
            if isinstance(m, dict) and isinstance(m.get("text"), str) and m["text"].strip():
                ts = m.get("ts")
                iso = pd.Timestamp(float(ts), unit="s").isoformat() if ts is not None and re.fullmatch(r"\d+(\.\d+)?", str(ts)) else None
                out.append(("assistant" if m.get("bot_id") else "user", m["text"].strip(), iso))
        return out
    for line in t.splitlines():
        try:
            o = json.loads(line)
        except ValueError:
            continue
        if not isinstance(o, dict):
            continue
        msg = o.get("message") if isinstance(o.get("message"), dict) else {}
        kind = o.get("type") if o.get("type") in ("human", "assistant", "user") else msg.get("role")
        role = {"human": "user", "user": "user", "assistant": "assistant"}.get(kind)
        body = _parts(msg.get("content")).strip()
        if role and body:
            out.append((role, body, o.get("timestamp")))
    return out


def json_turns(df: DataFrame) -> DataFrame:
    """Turns of conversations in JSON formats, one conversation per row."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(i, n, r, c, ts) for i, t in zip(f.conv_id, f.content) for n, (r, c, ts) in enumerate(parse(t))]
            yield pd.DataFrame(rows, columns=["conv_id", "turn", "role", "content", "timestamp"])

    return df.select("conv_id", "content").mapInPandas(run, TURNS)


def turns(df: DataFrame) -> DataFrame:
    """Turns of conversations in any of the formats."""
    kind = detect_format(F.coalesce("content", F.lit("")))
    return plaintext_turns(df.where(kind == "plaintext")).unionByName(json_turns(df.where(kind != "plaintext")))
