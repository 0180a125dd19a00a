"""Recall and precision of ``repeats`` against an exact search, over whole tables.

    python -m memspark.llm.history_recall TABLES

The exact search goes through the rows in order in plain Python: all words of a row are looked up among the accepted rows
of its scope, rarest first, as far as a row alike must have one of them (a prefix filter). It holds the tables in memory,
so it is for measuring, not for use.
"""

from __future__ import annotations

import math
import sys
from collections import Counter, defaultdict

import numpy as np

from memspark.llm.history_dedup import COSINE, WORDS_SHARE, _usable, repeats
from memspark.llm.words import words


def exact(memories: list[tuple], incoming: list[tuple]) -> set[tuple[int, int]]:
    """(accepted_row_no, row_no) of rows (row_no, scope, text, vector), scopes as they are compared."""
    sets = {r[0]: frozenset(words(r[2])) for r in [*memories, *incoming]}
    often = Counter(w for s in sets.values() for w in s)
    vectors = {r[0]: None if (v := _usable(r[3])) is None else v.astype(float) / math.sqrt(float(v.astype(float) @ v.astype(float))) for r in [*memories, *incoming]}
    index: dict[tuple, list[int]] = defaultdict(list)

    def prefix(n: int) -> list[str]:
        s = sorted(sets[n], key=lambda w: (often[w], w))
        return s[: len(s) - math.ceil(WORDS_SHARE * len(s) - 1e-9) + 1]

    def alike(a: int, b: int) -> bool:
        both = len(sets[a] & sets[b])
        if both < WORDS_SHARE * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
            return False
        x, y = vectors[a], vectors[b]
        return x is None or y is None or len(x) != len(y) or float(np.dot(x, y)) >= COSINE - 1e-12

    out = set()
    for fresh, rows in ((False, memories), (True, incoming)):
        for n, scope, *_ in sorted(rows, key=lambda r: r[0]):
            if not sets[n]:
                continue
            if fresh:
                near = {m for w in prefix(n) for m in index[scope, w]}
                if hit := [m for m in near if alike(m, n)]:
                    out.add((min(hit), n))
                    continue
            for w in prefix(n):
                index[scope, w].append(n)
    return out


def main(tables: str) -> None:
    from memspark.functions.norm import scope_key
    from memspark.session import local_session, read_table

    spark = local_session(app="history-recall")
    spark.sparkContext.setLogLevel("ERROR")
    old, new = read_table(spark, tables, "memories"), read_table(spark, tables, "incoming_memories")
    got = {tuple(r) for r in repeats(old, new).collect()}
    rows = lambda t: [tuple(r) for r in t.select("row_no", scope_key(t["scope"]).alias("scope"), "text", "vector").collect()]
    true = exact(rows(old), rows(new))
    print(f"cases {len(true)}, found {len(got)}, both {len(true & got)}: recall {len(true & got) / max(1, len(true)):.4f}, precision {len(true & got) / max(1, len(got)):.4f}")
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1])
