"""Text rules as column expressions: noise, gates, topics, entities, keys. Fixed values are patterns that results depend on."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memspark.functions.norm import scope_key
from memspark.operators.skew import join_groups

__all__ = ["join_groups"]

#: Patterns of noise.
DENIALS = r"i don'?t have (any )?(information|data|memory|record)|i'?m not sure about|i don'?t recall|i don'?t remember|it looks like i don'?t|i wasn'?t able to find|no (relevant )?memories found|i don'?t have access to"
META_QUESTIONS = r"\bdo you (remember|recall|know about)\b|\bcan you (remember|recall)\b|\bdid i (tell|mention|say|share)\b|\bhave i (told|mentioned|said)\b|\bwhat did i (tell|say|mention)\b|如果你知道.+只回复|如果不知道.+只回复\s*none|只回复精确代号|只回复\s*none|你还?记得|记不记得|还记得.*吗|你[知晓]道.+吗|我(?:之前|上次|以前)(?:说|提|讲).*(?:吗|呢|？|\?)"
BOILERPLATE = r"^(?:(hi|hello|hey|good morning|good evening|greetings)|fresh session|new session|heartbeat)"
ARTIFACTS = r"\bquery\s*->\s*(none|no explicit solution|unknown|not found)\b|\buser asked for\b.*\b(none|no explicit solution|unknown|not found)\b|\bno explicit solution\b"
NOISE = f"(?i)(?:{DENIALS}|{META_QUESTIONS}|{BOILERPLATE}|{ARTIFACTS})"
#: Patterns of queries that need no retrieval, and of those that always do.
SKIP = (
    r"(?i)^(?:(?:hi|hello|hey|good\s*(?:morning|afternoon|evening|night)|greetings|yo|sup|howdy|what'?s up)\b|/|(?:run|build|test|ls|cd|git|npm|pip|docker|curl|cat|grep|find|make|sudo)\b"
    r"|(?:yes|no|yep|nope|ok|okay|sure|fine|thanks|thank you|thx|ty|got it|understood|cool|nice|great|good|perfect|awesome|👍|👎|✅|❌)\s*[.!]?$"
    r"|(?:go ahead|continue|proceed|do it|start|begin|next|实施|實施|开始|開始|继续|繼續|好的|可以|行)\s*[.!]?$|\[System|(?:ping|pong|test|debug)\s*[.!?]?$)|(?i)HEARTBEAT"
)
FORCE = r"(?i)\b(remember|recall|forgot|memory|memories)\b|\b(last time|before|previously|earlier|yesterday|ago)\b|\b(my (name|email|phone|address|birthday|preference))\b|\b(what did (i|we)|did i (tell|say|mention))\b|(你记得|[你妳]記得|之前|上次|以前|还记得|還記得|提到过|提到過|说过|說過)"
CJK = "[一-鿿぀-ゟ゠-ヿ가-힯]"
GREETING = r"^(hi|hello|hey|thanks|ok|yes|no|sure|got it|好的|谢谢|嗯|是的)[\s!.]*$"
CATEGORY_THRESHOLDS = {"profile": 0.25, "preferences": 0.25, "entities": 0.30, "events": 0.35, "cases": 0.45, "patterns": 0.45}
#: Topics and their words, in order of precedence.
TOPICS = {
    "auth": r"auth|login|oauth|jwt|session.?token|credentials?|password|sso|saml",
    "deploy": r"deploy|ci[\s/]?cd|pipeline|release|rollout|staging|production|rollback",
    "infra": r"docker|kubernetes|k8s|terraform|nginx|server|cluster|load.?balanc|cdn|dns",
    "testing": r"test|spec|jest|vitest|bun.?test|coverage|assertion|mock|fixture|e2e",
    "database": r"database|sql|postgres|mysql|sqlite|lancedb|mongodb|migration|schema|index",
    "api": r"api|endpoint|rest|graphql|grpc|webhook|http|request|response|route",
    "ui": r"ui|frontend|react|vue|svelte|css|tailwind|component|layout|responsive",
    "perf": r"performance|latency|throughput|cache|optimization|bottleneck|profil|benchmark",
    "security": r"security|vulnerability|xss|csrf|injection|encrypt|certificate|tls|ssl",
    "docs": r"documentation|readme|changelog|tutorial|guide|specification|api.?doc",
    "memory": r"memory|recall|retriev|embed|vector|checkpoint|distill|ingest|lancedb",
    "mcp": r"mcp|model.?context.?protocol|tool.?registr|mcp.?server",
    "llm": r"llm|language.?model|prompt|token|context.?window|embedding|openai|anthropic|claude",
    "config": r"config|settings?|environment|env.?var|dotenv|feature.?flag",
    "data": r"data|dataset|csv|json|parsing|transform|etl|pipeline|ingest",
}
TOPIC_CHARS = 2000


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def scoped(df: DataFrame, scopes: list[str] | None) -> DataFrame:
    """Rows of the scopes; None is no filter, an empty list denies all. A missing scope is ``global``."""
    if scopes is None:
        return df
    return df.where(scope_key(F.col("scope")).isin(scopes)) if scopes else df.where("false")


def scope_kind(c: Column) -> Column:
    """global, the prefix of a well-formed scope, or other."""
    return F.when(c == "global", "global").when(c.rlike("^(agent|custom|project|user|reflection):.+"), F.split_part(c, F.lit(":"), F.lit(1))).otherwise("other")


def is_noise(c: Column) -> Column:
    t = _strip(c)
    return (F.length(t) < 5) | t.rlike(NOISE)


def skip_retrieval(c: Column) -> Column:
    """True for queries that need no retrieval; cues of memory win over everything."""
    t = _strip(c)
    least = F.when(t.rlike(CJK), 6).otherwise(15)
    asks = t.contains("?") | t.contains("？")
    return ~t.rlike(FORCE) & ((F.length(t) < 5) | t.rlike(SKIP) | ((F.length(t) < least) & ~asks))


def should_capture(c: Column) -> Column:
    t = _strip(c)
    return (F.length(t) >= 20) & ~is_noise(c) & ~F.lower(t).rlike(GREETING)


def topic(c: Column) -> Column:
    """The topic with most words in the first ``TOPIC_CHARS`` characters, the first on ties, null without any.

    The bound is part of the feature: a topic is that of a text's beginning.
    """
    sample = F.lower(F.substring(c, 1, TOPIC_CHARS))
    counts = F.array(*[F.regexp_count(sample, F.lit(rf"\b(?:{p})\b")) for p in TOPICS.values()])
    most = F.array_max(counts)
    return F.when(most > 0, F.element_at(F.array(*map(F.lit, TOPICS)), F.array_position(counts, most).cast("int")))


def reason_key(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"\d+(?:\.\d+)?", "#"), r"\s+", " "))


def _lit(p: str) -> str:
    return "'" + p.replace("'", "''") + "'"


_T = r"regexp_replace({c}, '^\s+|\s+$', '', 'g')"
_BR = lambda p: p.replace("{", "{{").replace("}", "}}")
NOISE_SQL = f"(length({_T}) < 5 or regexp_matches({_T}, {_BR(_lit(NOISE))}))"
SKIP_SQL = f"(not regexp_matches({_T}, {_BR(_lit(FORCE))}) and (length({_T}) < 5 or regexp_matches({_T}, {_BR(_lit(SKIP))}) or (length({_T}) < case when regexp_matches({_T}, {_lit(CJK)}) then 6 else 15 end and not contains({_T}, '?') and not contains({_T}, '？'))))"
CAPTURE_SQL = f"(length({_T}) >= 20 and not {NOISE_SQL} and not regexp_matches(lower({_T}), {_BR(_lit(GREETING))}))"


def topic_sql(c: str) -> str:
    """SQL of ``topic`` for another engine."""
    counts = ", ".join(rf"len(regexp_extract_all(lower(substr({c}, 1, {TOPIC_CHARS})), '\b(?:{p})\b'))" for p in TOPICS.values())
    names = ", ".join(f"'{t}'" for t in TOPICS)
    return f"case when list_max([{counts}]) > 0 then [{names}][list_position([{counts}], list_max([{counts}]))] end"


#: Secrets that are replaced before text is stored. The last is an address with its local part.
SECRETS = (
    r"\bsk-(?:proj-|ant-)?[A-Za-z0-9\-_]{20,}|\bgh[pous]_[A-Za-z0-9]{36,}|\bgithub_pat_[A-Za-z0-9_]{22,}|\bxox[baprs]-[A-Za-z0-9-]{10,}|\bAIza[0-9A-Za-z_-]{20,}|\bAKIA[0-9A-Z]{16}\b|\bnpm_[A-Za-z0-9]{36,}"
    r"|(?i:\b(?:token|api[_-]?key|secret|password)\s*[:=]\s*[\"']?[^\s\"',;)}\]]{6,}[\"']?)|/home/[^\s\"',;)}\]]+|/Users/[^\s\"',;)}\]]+|[A-Z]:\\[^\s\"',;)}\]]+|[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
)
BEARER = r"Bearer\s+[A-Za-z0-9\-._~+/]+=*"
ERROR_SIGNAL = r"\[error\]|error:|exception:|fatal:|traceback|syntaxerror|typeerror|referenceerror|npm err!|command not found|no such file|permission denied|non-zero|exit code|\"status\"\s*:\s*\"error\"|\"status\"\s*:\s*\"failed\"|\biserror\b|错误\s*[：:]|异常\s*[：:]|报错\s*[：:]|失败\s*[：:]"
#: Words of storage categories, in order of precedence.
CATEGORY_WORDS = {
    "preference": r"prefer|radši|like|love|hate|want|偏好|喜歡|喜欢|討厭|讨厌|不喜歡|不喜欢|愛用|爱用|習慣|习惯",
    "decision": r"rozhodli|decided|we decided|will use|we will use|we'?ll use|switch(ed)? to|migrate(d)? to|going forward|from now on|budeme|決定|决定|選擇了|选择了|改用|換成|换成|以後用|以后用|規則|流程|sop",
    "entity": r"\+\d{10,}|@[\w.-]+\.\w+|is called|jmenuje se|我的\S+是|叫我|稱呼|称呼",
    "fact": r"\b(is|are|has|have|je|má|jsou)\b|總是|总是|從不|从不|一直|每次都|老是",
}
#: Cues of things worth keeping in conversations, in order of precedence.
SIGNALS = {
    "preferences": r"(?:\b(?:i prefer|i like|i don't like|i hate|i love|i want|i need)\b|我喜欢|我不喜欢|我偏好|我想要)",
    "profile": r"(?:\b(?:my name is|i am a|i'm a|i work at|i live in)\b|我叫|我是|我在)",
    "events": r"(?:\b(?:i decided|we decided|let's go with|the decision is)\b|决定了|我们选择)",
    "cases": r"(?:\b(?:actually|no,? not|that's wrong|correction:)\b|更正|其实不是|不对)",
}
SIGNAL_IMPORTANCE = {"preferences": 0.8, "profile": 0.9, "events": 0.7, "cases": 0.85}
#: Names that mean the same thing.
ALIASES = {
    "ts": "typescript", "js": "javascript", "py": "python", "rb": "ruby", "rs": "rust", "go": "golang", "cs": "csharp", "c#": "csharp", "react.js": "react", "reactjs": "react", "vue.js": "vue", "vuejs": "vue",
    "next.js": "nextjs", "next": "nextjs", "node.js": "nodejs", "node": "nodejs", "express.js": "express", "angular.js": "angular", "angularjs": "angular", "k8s": "kubernetes", "pg": "postgresql", "postgres": "postgresql",
    "mongo": "mongodb", "gcp": "google cloud platform", "aws": "amazon web services", "gpt": "openai gpt", "chatgpt": "openai gpt", "pt": "pytorch", "hf": "hugging face", "huggingface": "hugging face",
    "llm": "large language model", "rag": "retrieval augmented generation",
}


def redact_secrets(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, BEARER, "Bearer [REDACTED]"), SECRETS, "[REDACTED]")


def has_error(c: Column) -> Column:
    return F.lower(c).rlike(ERROR_SIGNAL)


def error_signature(c: Column) -> Column:
    """Secrets, paths and numbers out, white space collapsed, 240 characters."""
    t = F.regexp_replace(F.regexp_replace(F.lower(redact_secrets(c)), r"/[^ \n\r\t]+", "<path>"), r"\b0x[0-9a-f]+\b", "<hex>")
    return F.substring(F.trim(F.regexp_replace(F.regexp_replace(t, r"\b\d+\b", "<n>"), r"\s+", " ")), 1, 240)


def storage_category(c: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for name, p in CATEGORY_WORDS.items():
        out = out.when(F.lower(c).rlike(p), F.lit(name))
    return out.otherwise("other")


def token_estimate(c: Column) -> Column:
    return F.ceil(F.length(c) / 4)


def inline(c: Column, most: int = 300) -> Column:
    """One line without tags, angle brackets full-width, cut to ``most`` characters."""
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"[\r\n]+", " "), r"</?[a-zA-Z][^>]*>", ""), "<", "＜")
    return F.substring(_strip(F.regexp_replace(F.regexp_replace(t, ">", "＞"), r"\s+", " ")), 1, most)


def first_sentence(c: Column, most: int = 100) -> Column:
    """The first sentence, or the beginning, up to ``most`` characters."""
    s = F.regexp_extract(_strip(c), r"^([^.!?。！？\n]+[.!?。！？]?)", 1)
    return F.substring(F.when(s != "", s).otherwise(_strip(c)), 1, most)


def alias_of(c: Column) -> Column:
    t = F.lower(F.trim(c))
    m = F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv])
    return F.coalesce(F.try_element_at(m, t), t)


def entity_candidates(c: Column) -> Column:
    """Quoted strings and capitalised phrases, without repeats."""
    quoted = F.regexp_extract_all(c, F.lit(r"[\"`]([^\"`]{2,})[\"`]"), 1)
    caps = F.regexp_extract_all(c, F.lit(r"((?<![A-Za-z0-9_])[A-Z][a-zA-Z]+(?:[ -][A-Z][a-zA-Z]+)*(?![A-Za-z0-9_]))"), 1)
    return F.array_distinct(F.concat(quoted, caps))


def signal(c: Column) -> Column:
    """Category of the first cue in a sentence, null without one."""
    out = F.when(F.lit(False), F.lit(""))
    for name, p in SIGNALS.items():
        out = out.when(F.lower(c).rlike(p), F.lit(name))
    return out


def contradicts(a: Column, b: Column) -> Column:
    """One text says that someone does something, the other that they do not; verbs compare without a final s."""
    bare = lambda c: F.trim(F.regexp_replace(c, r"(?i)^(?:the user|user|they)\s+", ""))
    root = lambda c: F.regexp_replace(F.lower(c), "s$", "")
    pos, neg = r"^(\w+)\s+(.+)$", r"^(?:doesn't|does not|don't|do not)\s+(\w+)\s+(.+)$"

    def one(p: Column, n: Column) -> Column:
        v = F.regexp_extract(n, neg, 1)
        return (v != "") & (root(F.regexp_extract(p, pos, 1)) == root(v)) & (F.lower(F.trim(F.regexp_extract(p, pos, 2))) == F.lower(F.trim(F.regexp_extract(n, neg, 2))))

    x, y = bare(a), bare(b)
    return one(x, y) | one(y, x)


#: Headings of blocks that a host puts before a message, the start of a session's first message, how one
#: is spoken to, lines of system events, and the blocks of injected context.
ENVELOPES = ("Conversation info (untrusted metadata):", "Sender (untrusted metadata):", "Thread starter (untrusted, for context):", "Replied message (untrusted, for context):", "Forwarded message context (untrusted metadata):", "Chat history since last reply (untrusted, for context):")
RESET = "A new session was started via /new or /reset. Execute your Session Startup sequence now"
ADDRESSING = r"^(?:<@!?[0-9]+>|@[A-Za-z0-9_.-]+)\s*"
SYSTEM_EVENT = r"(?im)^System:\s*\[[^\n]*?\]\s*Exec\s+(?:completed|failed|started)\b.*$"
INJECTED = r"(?is)<relevant-memories>\s*.*?</relevant-memories>\s*|\[UNTRUSTED DATA[^\n]*\].*?\[END UNTRUSTED DATA\]\s*"
_BLOCK = r"(?:^|\n)\s*(?:" + "|".join(re.sub(r"([().])", r"\\\1", e) for e in ENVELOPES) + r")\s*\n```json[\s\S]*?\n```\s*"


def without_envelope(c: Column) -> Column:
    """A user's message without what the host put around it: injected context, the start of a session, blocks of
    metadata, system events, and how the agent is spoken to. Null stays null."""

    def bare(x: Column) -> Column:
        for _ in range(2):  # a block behind a block begins where the first one ended
            x = F.regexp_replace(F.regexp_replace(x, SYSTEM_EVENT, "\n"), _BLOCK, "\n")
            x = _strip(F.regexp_replace(x, r"\n{3,}", "\n\n"))
        return x

    t = _strip(F.regexp_replace(_strip(c), INJECTED, ""))
    lines = F.split(t, "\n")
    # a new session's first message goes on after the first blank line, or from the third line on
    rest = F.when(F.instr(t, "\n\n") > 0, F.regexp_replace(t, r"^[\s\S]*?\n\n", "")).when(F.size(lines) <= 2, "").otherwise(F.array_join(F.slice(lines, F.lit(3), F.greatest(F.size(lines) - 2, F.lit(0))), "\n"))
    t = F.when(t.startswith(RESET), _strip(rest)).otherwise(t)
    return _strip(F.regexp_replace(bare(_strip(F.regexp_replace(bare(t), ADDRESSING, ""))), r"\n{3,}", "\n\n"))
