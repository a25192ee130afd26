"""Text functions on columns: the normalisers, token features and line rules of evidence matching.

There are several normalisers on purpose: retrieval, scorecards and project ranking each have their own, and results depend on
which one is used.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Replaced in this order, anywhere in the text, before it is cut into tokens.
RETRIEVAL_REPLACEMENTS = (
    ("apis", "api"),
    ("databases", "database"),
    ("workflows", "workflow"),
    ("technologies", "technology"),
    ("machine-learning", "machine learning"),
    ("human-in-the-loop", "human review"),
    ("human in the loop", "human review"),
    ("large language models", "large language model llm"),
)
SCORECARD_REPLACEMENTS = (("apis", "api"), ("databases", "database"), ("workflows", "workflow"), ("technologies", "technology"))
PROJECT_REPLACEMENTS = (("apis", "api"), ("workflows", "workflow"), ("technologies", "technology"), ("google cloud ai", "google cloud"))
#: A token on the left is followed by the one on the right.
TOKEN_ALIASES = {"github": "git", "langchain": "llm", "langgraph": "llm", "openai": "llm", "rag": "llm"}
#: Tokens that say nothing about a requirement.
STOP_WORDS = ("a", "an", "and", "as", "at", "be", "build", "for", "from", "in", "of", "on", "or", "the", "to", "using", "with", "work")
#: What marks a line of a list.
BULLET = r"^\s*(?:[-*]|•|\d+[.)])\s*"
BULLET_LINE = r"^\s*(?:[-*]|•|\d+[.)])\s+"


def casefold(text: Column) -> Column:
    """Lower case with ß as ss: what casefold does to Latin-1 text."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def replaced(text: Column, pairs) -> Column:
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, text)


def retrieval_tokens(text: Column) -> Column:
    """Tokens for retrieval, in order, aliases behind their token; null gives no tokens."""
    low = replaced(casefold(F.coalesce(text, F.lit(""))), RETRIEVAL_REPLACEMENTS)
    # a run of token characters without the full stops at its ends
    tokens = F.regexp_extract_all(low, F.lit(r"[a-z0-9+#]++(?:\.++[a-z0-9+#]++)*+"), F.lit(0))
    alias = F.create_map(*(F.lit(x) for pair in TOKEN_ALIASES.items() for x in pair))
    told = F.flatten(F.transform(tokens, lambda t: F.when(F.map_contains_key(alias, t), F.array(t, F.element_at(alias, t))).otherwise(F.array(t))))
    return F.when(reduce(lambda a, b: a | b, (F.contains(low, F.lit(t)) for t in TOKEN_ALIASES)), told).otherwise(tokens)


def retrieval_text(text: Column) -> Column:
    return F.array_join(retrieval_tokens(text), " ")


def scorecard_text(text: Column) -> Column:
    return F.trim(F.regexp_replace(replaced(F.lower(text), SCORECARD_REPLACEMENTS), r"[^a-z0-9+#.]+", " "))


def project_text(text: Column) -> Column:
    return F.trim(F.regexp_replace(replaced(F.lower(text), PROJECT_REPLACEMENTS), r"[^a-z0-9+#.]+", " "))


def label(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(text)), r"[- ]", "_")


def slug(text: Column, default: str = "resume") -> Column:
    found = F.regexp_replace(F.lower(F.regexp_replace(text, r"[^A-Za-z0-9]+", "-")), r"^-+|-+$", "")
    return F.when(found == "", F.lit(default)).otherwise(found)


def job_title(text: Column) -> Column:
    t = F.regexp_replace(text, r"(?i)\s*[\(\[]\s*(remote|hybrid|on-?site)\s*[\)\]]", "")
    t = F.regexp_replace(t, r"(?i)\bsr\.?(?=\s|$)", "Senior")
    t = F.regexp_replace(t, r"(?i)\bjr\.?(?=\s|$)", "Junior")
    t = F.regexp_replace(t, r"(?i)\bsw(e|d)\b", "Software Engineer")
    return F.btrim(F.btrim(F.regexp_replace(t, r"\s+", " ")), F.lit(" -|,"))


def contains_word(text: Column, word: str) -> Column:
    """Whole-word search in any case; letters of any script count as word characters."""
    return text.rlike(rf"(?iu)(?U)(?<![\w])\Q{word}\E(?![\w])")


def contains_phrase(tokens: Column, phrase: list[str]) -> Column:
    """True where the tokens hold the phrase's tokens one after another; tokens hold no blanks, so a search in the joined ones is exact."""
    return F.contains(F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" ")), F.lit(f" {' '.join(phrase)} "))


def signal_tokens(tokens: Column) -> Column:
    return F.array_distinct(F.filter(tokens, lambda t: ~t.isin(*STOP_WORDS) & (F.length(t) > 1)))


def bigrams(tokens: Column) -> Column:
    last = F.size(tokens) - 1
    at = F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.concat_ws("_", F.element_at(tokens, i), F.element_at(tokens, i + 1)))


def clean_line(line: Column) -> Column:
    return F.btrim(F.regexp_replace(line, BULLET, ""))


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.btrim(s)), lambda s: s != "")


def content_hash(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


#: Patterns of secrets, in the order in which they are redacted; what the groups hold stays.
REDACTIONS = (
    (r"""(?i)(\b[A-Za-z_][A-Za-z0-9_]*(?:API_KEY|TOKEN|SECRET|PASSWORD|CREDENTIALS?|DATABASE_URL|DB_URL|CONNECTION_STRING)\b\s*[=:]\s*)(?:"[^"]*"|'[^']*'|[^\s,;]+)""", "$1[REDACTED]"),
    (r"(?i)([?&](?:api[_-]?key|access[_-]?token|auth(?:orization)?|secret|password)\s*=\s*)[^&#\s]+", "$1[REDACTED]"),
    (r"(?i)(\bBearer\s+)[A-Za-z0-9._~+/=-]+", "$1[REDACTED]"),
    (r"""(?i)\b(?:sk|rk|ghp|github_pat|xox[baprs])-[^\s,;'"}]+""", "[REDACTED]"),
    (r"(?i)\b(?:sk|rk|ghp|github_pat|xox[baprs])-[A-Za-z0-9_-]{8,}\b", "[REDACTED]"),
)


#: For each of these patterns, texts (lower case) of which a match holds one of each group.
REDACTION_HINTS = (
    (("=", ":"), ("api_key", "token", "secret", "password", "credential", "database_url", "db_url", "connection_string")),
    (("=",), ("?", "&"), ("api", "access", "auth", "secret", "password")),
    (("bearer",),),
    (("sk-", "rk-", "ghp-", "github_pat-", "xox"),),
    (("sk-", "rk-", "ghp-", "github_pat-", "xox"),),
)


def redact(text: Column) -> Column:
    """Secrets in a text replaced; the last pattern only finds what the one before it leaves.

    A pattern is tried where the text holds what every match of it holds, which most texts don't; nothing that is put in holds any of it."""
    one = lambda value, body: F.element_at(F.transform(F.array(value), body), 1)

    def hinted(low: Column, groups) -> Column:
        return reduce(lambda a, b: a & b, (reduce(lambda a, b: a | b, (F.contains(low, F.lit(h)) for h in hints)) for hints in groups))

    def step(value: Column, low: Column, groups, pair) -> Column:
        return one(value, lambda v: F.when(hinted(low, groups), F.regexp_replace(v, F.lit(pair[0]), F.lit(pair[1]))).otherwise(v))

    return one(F.lower(text), lambda low: reduce(lambda c, p: step(c, low, *p), zip(REDACTION_HINTS, REDACTIONS, strict=True), text))


#: Fixed value: keys whose values are secret, whatever they hold.
SECRET_KEY = r"(?i)(?:api[_-]?key|access[_-]?token|auth(?:orization)?|secret|password|credential|database[_-]?url)"


def redact_nested(value: Column, kind: T.DataType) -> Column:
    """A value of any nesting with secret texts redacted; what stands under a secret key is replaced as a whole (null where it is no
    text)."""
    if isinstance(kind, T.StringType):
        return redact(value)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: redact_nested(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda k, x: F.when(k.rlike(SECRET_KEY), hidden(kind.valueType)).otherwise(redact_nested(x, kind.valueType)))
    if isinstance(kind, T.StructType):
        named = [(hidden(f.dataType) if re.search(SECRET_KEY, f.name) else redact_nested(value[f.name], f.dataType)).alias(f.name) for f in kind.fields]
        return F.when(value.isNotNull(), F.struct(*named))
    return value


def hidden(kind: T.DataType) -> Column:
    return F.lit("[REDACTED]") if isinstance(kind, T.StringType) else F.lit(None).cast(kind)
