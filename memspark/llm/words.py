"""Words and fields of a text, as used by the operators of this subpackage."""

from __future__ import annotations

import json
import re

#: A word: a longest run of letters or digits; an underscore is neither.
WORD = re.compile(r"[^\W_]+")
_SEPARATORS = (re.compile(r"[\r\n]+"), re.compile(r"\|"), re.compile(r";"), re.compile(r","))
_FIELD = re.compile(r"\s*([^:=]{1,80}?)\s*(?::|=>|->|=)(.*)", re.S)
#: Longest name of a field in words.
NAME_WORDS = 4


def words(text: str | None) -> list[str]:
    """Words in order, letter case folded; none of a null text."""
    return WORD.findall(text.casefold()) if text else []


def fields(text: str | None) -> list[tuple[str, str]] | None:
    """Name-value fields (their words) of a text that consists of two or more of them, else None.

    Either a JSON object, or parts between line ends, bars, semicolons or commas that each begin with a name and a
    colon, equals sign or arrow.
    """
    if not text:
        return None
    t = text.strip()
    if t[:1] == "{" and t[-1:] == "}":
        try:
            pairs = json.loads(t, object_pairs_hook=list)
        except ValueError:
            pairs = []
        if isinstance(pairs, list) and len(pairs) > 1 and all(isinstance(p, tuple) for p in pairs):
            return [(" ".join(words(str(k))), " ".join(words(v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)))) for k, v in pairs]
    for sep in _SEPARATORS:
        parts = [p for p in sep.split(t) if p.strip()]
        if len(parts) < 2:
            continue
        out = []
        for p in parts:
            m = _FIELD.fullmatch(p)
            name = words(m.group(1)) if m else []
            if not 0 < len(name) <= NAME_WORDS:
                out = []
                break
            out.append((" ".join(name), " ".join(words(m.group(2)))))
        if out:
            return out
    return None
