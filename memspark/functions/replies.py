"""JSON objects in the replies of language models, with the usual slips mended."""

from __future__ import annotations

import json
import re

_FENCE = re.compile(r"```(?:json)?\s*\n?(.*?)```", re.S)
_CONTROL = {"\n": "\\n", "\r": "\\r", "\t": "\\t"}


def candidate(reply: str) -> str | None:
    """The first fenced block, else the text from the first brace to the one that closes it; None without one."""
    if m := _FENCE.search(reply):
        return m[1].strip()
    start, depth = reply.find("{"), 0
    for m in re.finditer(r"[{}]", reply[start:] if start >= 0 else ""):
        depth += 1 if m[0] == "{" else -1
        if not depth:
            return reply[start : start + m.end()]
    return None


def mended(text: str) -> str:
    """Quotes inside strings escaped (one ends a string only before a comma, colon, bracket or the end), line ends and
    tabs in strings escaped, commas before a closing bracket left out."""
    out, inside, i = [], False, 0
    while i < len(text):
        c = text[i]
        if inside and c == "\\" and i + 1 < len(text):
            out.append(text[i : i + 2])
            i += 2
            continue
        if c == '"':
            ends = re.match(r"\s*(?:[,:\]}]|$)", text[i + 1 :])
            out.append('"' if not inside or ends else '\\"')
            inside = not inside if not inside or ends else inside
        elif inside:
            out.append(_CONTROL.get(c, c))
        elif c != "," or not re.match(r"\s*[\]}]", text[i + 1 :]):
            out.append(c)
        i += 1
    return "".join(out)


def json_of(reply: str | None) -> dict | None:
    """The object a reply holds; None for null, for replies without one, and for what cannot be mended."""
    text = candidate(reply or "")
    for attempt in (text, mended(text) if text else None):
        try:
            found = json.loads(attempt or "")
        except ValueError:
            continue
        return found if isinstance(found, dict) else None
    return None
