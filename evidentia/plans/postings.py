"""Posting analysis and text queries: fixture postings in both engines, documents, pages and parts from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidentia.functions import text
from evidentia.operators import catalogs
from evidentia.operators import extraction as X
from evidentia.operators import pages as P
from evidentia.operators.retrieval import spread
from evidentia.plans.common import fixture, table, tokens_sql, values

POSTINGS = [
    (1, "Sr. AI Backend Engineer (Hybrid)", "Requirements:\n- 3+ years of experience with Python and FastAPI\n- Experience with Django or Flask.\nWe value communication.\nPreferred qualifications\n- AWS and Docker knowledge is a plus. Kafka or Spark helps.\n* Degree in computer science or machine learning"),
    (2, "Junior Software Engineer", "What you will do\n- Build REST API services\n- Be a rockstar who can wear many hats\nQualifications\n1. 7+ years of experience\n2. SQL and PostgreSQL\nNice to have:\n- Kubernetes or Terraform\nOther benefits\nRemote work. Always on!"),
    (3, "Lead Data Engineer - Platform", "The role\nLead the data platform.\nRequirements\nPython is required here.\n- Airflow, Spark and Snowflake\n- 5-8 years of experience in data engineering\nPreferred skills\n- Machine learning or artificial intelligence degree preferred\nHybrid in office"),
    (4, "Internal Tools SWE [Remote]", "We use Git and GitHub. Ideally you know React or Node.js. Competitive salary, 24/7 support."),
    (5, "VP Engineering", "mid-level team. 10 years experience. Equity only."),
    (6, "jr developer , ", ""),
    (7, "Staff Engineer|", "Requirements\n- Large language models, RAG or LangChain\n- 2 yrs of experience\nResponsibilities\n- Own microservices and distributed systems\n"),
]
SCHEMA = "job_id bigint, title string, body string"
REDACT = [
    (1, "OPENAI_API_KEY=sk-abcdefgh1234 next"), (2, "see https://x.io/?api_key=12345&b=2"), (3, "Authorization: Bearer abc.def-123"),
    (4, 'token = "x" stays'), (5, "DB_PASSWORD: 'hunter 2' and ghp-12345678abc"), (6, "nothing here"), (7, ""),
]


def _postings(spark):
    return fixture(spark, POSTINGS, SCHEMA)


def _given(spark, rows):
    return _postings(spark) if rows is None else rows


def _part_postings(spark, d):
    """Postings (job_id, title, body) made of the columns of each part, with headings, bullets, alternatives and years."""
    low = F.lower("p_type")
    title = F.concat(F.element_at(F.array(*map(F.lit, ("Sr. ", "Jr ", "", "Lead "))), (F.col("p_size") % 4 + 1).cast("int")), "p_name", F.when(F.col("p_size") % 3 == 0, " (Remote)").otherwise(""))
    body = F.concat(
        F.lit("About "), "p_brand", F.lit(".\nRequirements:\n- Python or SQL with "), low, F.lit(", "), F.col("p_size").cast("string"), F.lit("+ years of experience\n* Docker. "), "p_name",
        F.when(F.col("p_size") % 2 == 0, F.lit("\nPreferred qualifications:\n1. Bachelor degree in computer science or related field\n")).otherwise("\n\n"), F.lit("Communication is a plus"),
    )
    parts = spread(table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size"), split=False)
    return parts.select(F.col("p_partkey").alias("job_id"), title.alias("title"), body.alias("body"))


def _text(items):
    return F.array_join(items, "|")


def section_carry_forward(spark, d, rows=None):
    return X.lines(_given(spark, rows), "job_id", "body").select("job_id", F.col("line_no").cast("bigint").alias("line_no"), "line", "section")


def prioritized_contexts(spark, d, rows=None):
    return X.contexts(_given(spark, rows), "job_id", "body").select("job_id", F.col("line_no").cast("bigint").alias("line_no"), "context", "priority")


def dictionary_tags(spark, d, rows=None):
    body = F.concat_ws(" ", "title", "body")
    return _given(spark, rows).select(
        "job_id", _text(X.tags(body, catalogs.TECHNOLOGIES)).alias("technologies"), _text(X.tags(body, catalogs.SKILLS)).alias("skills"),
        _text(X.tags(body, catalogs.SOFT_SKILLS)).alias("soft_skills"), _text(X.tags(body, catalogs.DOMAINS)).alias("domains"),
    )


def required_preferred_split(spark, d, rows=None):
    found = X.contexts(_given(spark, rows), "job_id", "body")
    return X.classified(found, "job_id", catalogs.TECHNOLOGIES | catalogs.SKILLS)  # no name is in both


def or_groups(spark, d, rows=None):
    return X.or_groups(X.contexts(_given(spark, rows), "job_id", "body"), "job_id").select("job_id", "priority", "kind", _text("alternatives").alias("alternatives"))


def canonical_bullets(spark, d, rows=None):
    rows = X.bullets(_given(spark, rows), "job_id", "body")
    return rows.select("job_id", F.col("line_no").cast("bigint").alias("line_no"), "requirement", "kind", "priority", "logic", _text("alternatives").alias("alternatives"))


def normalized_title(spark, d, rows=None):
    return _given(spark, rows).select("job_id", text.job_title(F.col("title")).alias("normalized_title"))


def experience_bounds(spark, d, rows=None):
    least, most = X.experience_bounds(F.col("body"))
    return _given(spark, rows).select("job_id", least.alias("least"), most.alias("most"))


def posting_profile(spark, d, rows=None):
    rows = _given(spark, rows).withColumn("t", text.job_title(F.col("title")))
    least, _ = X.experience_bounds(F.col("body"))
    rows = rows.withColumn("least", least)
    place = X.workplace(F.concat_ws(" ", "title", "body"))
    there = {"detailed job description": F.length("body") >= 80, "workplace type": place.isNotNull(), "experience requirement": F.col("least").isNotNull()}
    return rows.select(
        "job_id", X.seniority(F.col("t"), F.col("body"), F.col("least")).alias("seniority"), place.alias("workplace"),
        _text(X.red_flags(F.col("t"), F.col("body"), F.col("least"))).alias("red_flags"), _text(X.missing_information(there)).alias("missing"),
    )


def redact(spark, d):
    return fixture(spark, REDACT, "id bigint, body string").select("id", text.redact(F.col("body")).alias("redacted"))


def normalized_text(spark, d):
    tokens = text.retrieval_tokens(F.col("text"))
    return spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.size(tokens).cast("bigint").alias("n_tokens"), text.content_hash(F.array_join(tokens, " ")).alias("digest"))


def signal_tokens(spark, d):
    tokens = text.signal_tokens(text.retrieval_tokens(F.col("text")))
    return table(spark, d, "benchmark").select("item_id", F.array_join(F.array_sort(tokens), " ").alias("signal"))


def content_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", text.content_hash(F.col("text")).alias("content_hash"), F.length("text").cast("bigint").alias("chars"))


def slug(spark, d):
    return table(spark, d, "part").select("p_partkey", text.slug(F.concat_ws(" ", "p_name", "p_type")).alias("slug"), text.label(F.col("p_type")).alias("label"))


def contact_extract(spark, d):
    return P.contacts(table(spark, d, "documents"), "doc_id", "text")


def line_clean_dedupe(spark, d):
    return P.distinct_lines(table(spark, d, "documents"), "doc_id", "text").select("doc_id", "n_lines", text.content_hash(F.col("body")).alias("digest"))


def sentence_split(spark, d):
    rows = table(spark, d, "conversations")
    return rows.select("conv_id", "turn", F.size(text.sentences(F.col("text"))).cast("bigint").alias("n_sentences"))


def page_text(spark, d):
    return table(spark, d, "pages").select("page_id", text.content_hash(P.visible_text(F.col("html"))).alias("digest"), P.title(F.col("html")).alias("title"))


def page_url(spark, d):
    return table(spark, d, "pages").select("page_id", P.host(F.col("url")).alias("host"), P.query_value(F.col("url"), "page").alias("page_no"))


def redact_documents(spark, d):
    redacted = text.redact(F.col("text"))
    return table(spark, d, "documents").select("doc_id", (redacted != F.col("text")).alias("changed"), text.content_hash(redacted).alias("digest"))


QUERIES = {
    f.__name__: f
    for f in (
        section_carry_forward, prioritized_contexts, dictionary_tags, required_preferred_split, or_groups, canonical_bullets, normalized_title, experience_bounds,
        posting_profile, redact, normalized_text, signal_tokens, content_hash, slug, contact_extract, line_clean_dedupe, sentence_split, page_text, page_url, redact_documents,
    )
}


def _tags_sql(column: str, catalog: dict) -> str:
    """Whole-word tags of ASCII text; RE2 has no look-around, so the neighbours are matched."""
    import re

    checks = []
    for name, variants in catalog.items():
        pattern = "|".join(re.escape(v).replace("\\ ", " ") for v in variants)
        checks.append(f"CASE WHEN regexp_matches(lower({column}), '(^|[^a-z0-9_])({pattern})($|[^a-z0-9_])') THEN '{name}' END")
    return f"list_filter([{', '.join(checks)}], lambda x: x IS NOT NULL)"


_HEADINGS = "MAP {" + ", ".join(f"'{a.replace(chr(39), chr(39) * 2)}': '{b}'" for a, b in catalogs.SECTION_HEADINGS.items()) + "}"
_MARKERS = " OR ".join(f"contains(lower(line), '{m}')" for m in catalogs.PREFERRED_MARKERS)
_LINES = rf"""
        WITH p AS (SELECT * FROM {values(POSTINGS, "t", "job_id, title, body")}),
        parts AS (SELECT job_id, unnest(string_split(body, chr(10))) AS raw, unnest(range(len(string_split(body, chr(10))))) AS line_no FROM p),
        cleaned AS (SELECT *, trim(regexp_replace(raw, '^\s*(?:[-*]|•|\d+[.)])\s*', '')) AS line FROM parts),
        opened AS (SELECT *, {_HEADINGS}[rtrim(lower(line), ':')] AS o FROM cleaned WHERE line <> ''),
        lines AS (
            SELECT job_id, raw, line_no, line, section FROM (SELECT *, last_value(o IGNORE NULLS) OVER (PARTITION BY job_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS section FROM opened)
            WHERE o IS NULL
        )"""
_CONTEXTS = _LINES + rf""",
        contexts AS (
            SELECT job_id, line_no, priority, unnest(list_filter(list_transform(string_split(regexp_replace(line, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)),
                   lambda s: trim(s)), lambda s: s <> '')) AS context
            FROM (SELECT *, CASE WHEN coalesce(section = 'preferred', FALSE) OR {_MARKERS} THEN 'preferred' ELSE 'required' END AS priority FROM lines)
        )"""
_ABOUT = "contains(lower(context), 'degree') OR contains(lower(context), 'field') OR contains(lower(context), 'computer science')"
_ALTERNATIVES = f"""
        g AS (
            SELECT *, CASE WHEN {_ABOUT} THEN {_tags_sql("context", catalogs.EDUCATION)} ELSE [] END AS ed,
                   {_tags_sql("context", catalogs.TECHNOLOGIES)} AS te, {_tags_sql("context", catalogs.SKILLS)} AS sk,
                   regexp_matches(lower(context), '(^|[^a-z0-9_])or($|[^a-z0-9_])') AS has_or FROM c
        )"""
_EXPERIENCE = r"(\d{1,2})\s*(?:-\s*(\d{1,2})|(\+))?\s*(?:years?|yrs?)(?:\s+of)?\s+experience"
_BOUNDS = f"""
        b AS (SELECT *, regexp_extract(lower(body), '{_EXPERIENCE}', 1) AS lo, regexp_extract(lower(body), '{_EXPERIENCE}', 2) AS hi,
                     regexp_extract(lower(body), '{_EXPERIENCE}', 3) AS plus FROM p),
        bounds AS (SELECT *, CASE WHEN lo <> '' THEN CAST(lo AS INTEGER) END AS least,
                          CASE WHEN hi <> '' THEN CAST(hi AS INTEGER) WHEN lo <> '' AND plus = '' THEN CAST(lo AS INTEGER) END AS most FROM b)"""
_TITLE = r"""trim(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(title, '\s*[\(\[]\s*(remote|hybrid|on-?site)\s*[\)\]]', '', 'gi'),
                  '\bsr\.?(\s|$)', 'Senior\1', 'gi'), '\bjr\.?(\s|$)', 'Junior\1', 'gi'), '\bsw(e|d)\b', 'Software Engineer', 'gi'), '\s+', ' ', 'g')), ' -|,')"""
_POSTINGS = f"WITH p AS (SELECT * FROM {values(POSTINGS, 't', 'job_id, title, body')})"
_FLAGS = ", ".join(f"CASE WHEN contains(lower(body), '{p}') THEN '{m.replace(chr(39), chr(39) * 2)}' END" for p, m in catalogs.RED_FLAGS.items())
_SENIORITY = " ".join(f"WHEN contains(lower(t), '{m}') THEN '{v}'" for m, v in catalogs.SENIORITY_BY_TITLE)
ORACLE_SQL = {
    "section_carry_forward": _LINES + " SELECT job_id, line_no, line, section FROM lines",
    "prioritized_contexts": _CONTEXTS + " SELECT job_id, line_no, context, priority FROM contexts",
    "dictionary_tags": f"""
        {_POSTINGS}, b AS (SELECT job_id, title || ' ' || body AS body FROM p)
        SELECT job_id, array_to_string({_tags_sql("body", catalogs.TECHNOLOGIES)}, '|') AS technologies, array_to_string({_tags_sql("body", catalogs.SKILLS)}, '|') AS skills,
               array_to_string({_tags_sql("body", catalogs.SOFT_SKILLS)}, '|') AS soft_skills, array_to_string({_tags_sql("body", catalogs.DOMAINS)}, '|') AS domains FROM b""",
    "required_preferred_split": _CONTEXTS + f""",
        named AS (SELECT job_id, priority, unnest({_tags_sql("context", catalogs.TECHNOLOGIES)}) AS term FROM contexts
                  UNION ALL SELECT job_id, priority, unnest({_tags_sql("context", catalogs.SKILLS)}) FROM contexts)
        SELECT job_id, term, CASE WHEN bool_and(priority = 'preferred') THEN 'preferred' ELSE 'required' END AS priority FROM named GROUP BY job_id, term""",
    "or_groups": _CONTEXTS + f""", c AS (SELECT * FROM contexts), {_ALTERNATIVES}
        SELECT job_id, priority, 'education' AS kind, array_to_string(ed, '|') AS alternatives FROM g WHERE has_or AND len(ed) >= 2
        UNION ALL SELECT job_id, priority, 'technology', array_to_string(te, '|') FROM g WHERE has_or AND len(ed) < 2 AND len(te) >= 2
        UNION ALL SELECT job_id, priority, 'skill', array_to_string(sk, '|') FROM g WHERE has_or AND len(ed) < 2 AND len(sk) >= 2""",
    "canonical_bullets": _LINES + rf""",
        c AS (SELECT job_id, line_no, line AS context, section FROM lines WHERE section IN ('qualifications', 'preferred') AND regexp_matches(raw, '^\s*(?:[-*]|•|\d+[.)])\s+')),
        {_ALTERNATIVES},
        k AS (SELECT *, CASE WHEN has_or AND len(ed) >= 2 THEN 'education' WHEN has_or AND len(te) >= 2 THEN 'technology' WHEN has_or AND len(sk) >= 2 THEN 'skill' END AS gk FROM g)
        SELECT job_id, line_no, context AS requirement,
               coalesce(gk, CASE WHEN regexp_matches(lower(context), 'degree|bachelor|master') THEN 'education'
                                 WHEN regexp_matches(lower(context), '\b\d+\s*(?:-|–|\+|to)\s*\d*\s*years?\b') THEN 'experience'
                                 WHEN len(te) > 0 THEN 'technology' ELSE 'skill' END) AS kind,
               CASE WHEN section = 'preferred' THEN 'preferred' ELSE 'required' END AS priority, CASE WHEN gk IS NULL THEN 'all' ELSE 'any' END AS logic,
               array_to_string(CASE gk WHEN 'education' THEN ed WHEN 'technology' THEN te WHEN 'skill' THEN sk ELSE [] END, '|') AS alternatives FROM k""",
    "normalized_title": f"{_POSTINGS} SELECT job_id, {_TITLE} AS normalized_title FROM p",
    "experience_bounds": f"{_POSTINGS}, {_BOUNDS} SELECT job_id, least, most FROM bounds",
    "posting_profile": rf"""
        {_POSTINGS}, {_BOUNDS}, n AS (SELECT *, {_TITLE} AS t, lower(title || ' ' || body) AS low FROM bounds),
        w AS (SELECT *, CASE WHEN contains(low, 'hybrid') THEN 'hybrid' WHEN contains(low, 'remote') THEN 'remote'
                             WHEN regexp_matches(low, 'on-site|onsite|in office') THEN 'onsite' END AS workplace FROM n)
        SELECT job_id, workplace,
               CASE {_SENIORITY} WHEN least >= 8 THEN 'senior' WHEN least >= 3 THEN 'mid_level' WHEN least IS NOT NULL THEN 'junior'
                    WHEN regexp_matches(lower(body), '\bmid[- ]level\b') THEN 'mid_level' ELSE 'unknown' END AS seniority,
               array_to_string(list_filter([{_FLAGS}, CASE WHEN regexp_matches(lower(t), '\b(?:intern|junior|entry[- ]level)\b') AND least >= 5
                                            THEN '{catalogs.UNREALISTIC}' END], lambda x: x IS NOT NULL), '|') AS red_flags,
               array_to_string(list_filter([CASE WHEN length(body) < 80 THEN 'detailed job description' END, CASE WHEN workplace IS NULL THEN 'workplace type' END,
                                            CASE WHEN least IS NULL THEN 'experience requirement' END], lambda x: x IS NOT NULL), '|') AS missing FROM w""",
    "normalized_text": f"""
        SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, sha256(array_to_string(t, ' ')) AS digest
        FROM (SELECT doc_id, {tokens_sql("text")} AS t FROM documents)""",
    "signal_tokens": f"""
        SELECT item_id, array_to_string(list_sort(list_distinct(list_filter(t, lambda x: len(x) > 1 AND x NOT IN ({", ".join(f"'{w}'" for w in text.STOP_WORDS)})))), ' ') AS signal
        FROM (SELECT item_id, {tokens_sql("text")} AS t FROM benchmark)""",
    "content_hash": "SELECT doc_id, sha256(text) AS content_hash, CAST(length(text) AS BIGINT) AS chars FROM documents",
    "slug": """
        SELECT p_partkey, coalesce(nullif(trim(regexp_replace(lower(p_name || ' ' || p_type), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'resume') AS slug,
               regexp_replace(lower(trim(p_type)), '[- ]', '_', 'g') AS label FROM part""",
    "contact_extract": r"""
        SELECT doc_id, regexp_extract(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}') AS email,
               CAST(len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')) AS BIGINT) AS n_emails
        FROM documents WHERE regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')""",
    "line_clean_dedupe": r"""
        WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents),
        c AS (SELECT doc_id, pos, trim(regexp_replace(raw, '[ \t]+', ' ', 'g')) AS line FROM l),
        f AS (SELECT doc_id, line, min(pos) AS pos FROM c WHERE line <> '' GROUP BY ALL)
        SELECT doc_id, count(*) AS n_lines, sha256(string_agg(line, chr(10) ORDER BY pos)) AS digest FROM f GROUP BY 1""",
    "page_url": r"""
        SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) AS host, nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS page_no FROM pages""",
}


def _redact_sql(value: str) -> str:
    for pattern, kept in text.REDACTIONS:
        value = f"regexp_replace({value}, '{pattern.replace(chr(39), chr(39) * 2)}', '{kept.replace('$1', chr(92) + '1')}', 'g')"
    return value


def _entities_sql(value: str) -> str:
    for entity, letter in P.ENTITIES:
        value = f"replace({value}, '{entity}', '{letter.replace(chr(39), chr(39) * 2)}')"
    return value


#: Without look-behind and back-references: a sentence end is marked, and each element that is dropped has its own pattern.
_DROPPED = "|".join(f"<{n}\\b.*?</{n}\\s*>" for n in ("script", "style", "head")) + "|<!--.*?-->"
ORACLE_SQL |= {
    "redact": f"SELECT id, {_redact_sql('body')} AS redacted FROM {values(REDACT, 'v', 'id, body')}",
    "redact_documents": f"SELECT doc_id, r <> text AS changed, sha256(r) AS digest FROM (SELECT doc_id, text, {_redact_sql('text')} AS r FROM documents)",
    "sentence_split": r"""
        SELECT conv_id, turn, CAST(len(list_filter(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s) <> '')) AS BIGINT) AS n_sentences FROM conversations""",
    "page_text": rf"""
        WITH b AS (SELECT page_id, html, regexp_replace(regexp_replace(html, '{_DROPPED}', ' ', 'gis'), '<(?:br|/p|/div|/li|/h[1-6]|/tr)\b[^>]*>', chr(10), 'gi') AS x FROM pages),
        c AS (SELECT page_id, html, {_entities_sql("regexp_replace(x, '<[^>]*>', ' ', 'g')")} AS y FROM b),
        t AS (SELECT page_id, y, regexp_extract(html, '<title[^>]*>(.*?)</title>', 1, 'is') AS t FROM c)
        SELECT page_id, sha256(trim(regexp_replace(regexp_replace(y, '[ \t]+', ' ', 'g'), '\s*\n\s*', chr(10), 'g'), ' ' || chr(10))) AS digest, CASE WHEN t <> '' THEN trim({_entities_sql("t")}) END AS title FROM t""",
}

#: The same queries over a posting for each part.
_PARTS_SQL = r"""(SELECT p_partkey AS job_id, ['Sr. ', 'Jr ', '', 'Lead '][CAST(p_size % 4 + 1 AS INT)] || p_name || CASE WHEN p_size % 3 = 0 THEN ' (Remote)' ELSE '' END AS title,
        'About ' || p_brand || '.' || chr(10) || 'Requirements:' || chr(10) || '- Python or SQL with ' || lower(p_type) || ', ' || p_size || '+ years of experience' || chr(10) || '* Docker. ' || p_name
        || CASE WHEN p_size % 2 = 0 THEN chr(10) || 'Preferred qualifications:' || chr(10) || '1. Bachelor degree in computer science or related field' || chr(10) ELSE chr(10) || chr(10) END || 'Communication is a plus' AS body FROM part) AS t"""


def _over_parts(query):
    return lambda spark, d: query(spark, d, _part_postings(spark, d))


_OVER_PARTS = (section_carry_forward, prioritized_contexts, dictionary_tags, required_preferred_split, or_groups, canonical_bullets, normalized_title, experience_bounds, posting_profile)
QUERIES |= {f"part_{f.__name__}": _over_parts(f) for f in _OVER_PARTS}
ORACLE_SQL |= {f"part_{f.__name__}": ORACLE_SQL[f.__name__].replace(values(POSTINGS, "t", "job_id, title, body"), _PARTS_SQL) for f in _OVER_PARTS}
