"""Who may read which scopes: rules for one agent on the driver, and the same as a join for tables of agents."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds of scopes, and agents that bypass the rules.
SCOPE = re.compile(r"^(global|(?:agent|custom|project|user|reflection):.+)$")
BYPASS = (None, "", "system", "undefined")


def valid_scope(scope: str) -> bool:
    return bool(scope and SCOPE.match(scope.strip()))


def agent_of_session(key: str | None) -> str | None:
    """The agent in a session key ``agent:<id>:...``."""
    m = re.match(r"^agent:([^:]+)(?::|$)", key or "")
    return m.group(1) if m else None


def accessible(agent: str | None, acl: dict[str, list[str]] | None = None, shared: list[str] | None = None) -> list[str] | None:
    """Scopes an agent may read, None for all (bypass). An explicit list replaces global and the agent's own; shared
    scopes and the agent's reflections are always added."""
    if agent in BYPASS:
        return None
    base = (acl or {}).get(agent) or ["global", f"agent:{agent}"]
    return list(dict.fromkeys([*base, f"reflection:agent:{agent}", *(shared or [])]))


def default_scope(agent: str | None) -> str:
    return "global" if agent in BYPASS else f"agent:{agent}"


def restrict(asked: list[str] | None, agent: str | None, acl: dict[str, list[str]] | None = None) -> list[str] | None:
    """The asked scopes as far as the agent may read them; an empty list denies all."""
    may = accessible(agent, acl)
    if may is None:
        return asked
    return may if asked is None else [s for s in asked if s in may]


def accessible_rows(mem: DataFrame, access: DataFrame) -> DataFrame:
    """(agent, rows of ``mem``) for each agent of ``access`` (agent, scope): one join on the scope."""
    return mem.join(access.select("agent", F.col("scope")), "scope")
