"""Profile and draft queries: parts play projects and skills of the supplier that owns them; fixtures hold résumé texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidentia.operators import drafting as D
from evidentia.operators import profiles as P
from evidentia.operators import resumes as S
from evidentia.operators.retrieval import spread
from evidentia.plans.common import fixture, table, values

RESUMES = [
    (1, "Ada Example\nData Engineer\nada@example.org | +44 20 1234 5678\nhttps://github.com/ada, https://ada.dev.\nSkills\nLanguages: Python, SQL; python\n• Docker | Git.\nWork Experience\nEngineer at Acme Jan 2020 - Mar 2022\nLead | Initech 2022 - Present\nno dates here\nEducation\nBSc Physics | Uni of X | 2019\nEvening class"),
    (2, "PROFILE:\nCurious.\nProjects\nScraper | Collects pages | Playwright, Redis\nOnly a title\nCertificates\nCloud Cert | Vendor | 2021"),
]
PROFILE = [("p1", "Engineer", None, "Berlin"), ("p2", None, None, None), ("p3", None, "Builds tools.", "")]
ROLES = [
    (1, "legal court filings with ocr"), (2, "machine learning mlops model training"), (3, "zapier and n8n"), (4, "backend python api"), (5, "applied ai platform"), (6, "sales"), (7, "llm and rag"),
]


def resume_lines(spark, d):
    lines = P.resume_lines(fixture(spark, RESUMES, "id bigint, body string"), "id", "body")
    return lines.select("id", F.col("line_no").cast("bigint").alias("line_no"), "section", "line")


def resume_header(spark, d):
    rows = P.resume_header(P.resume_lines(fixture(spark, RESUMES, "id bigint, body string"), "id", "body"), "id")
    return rows.select("id", "full_name", "headline", "email", "phone", P.url_for(F.col("urls"), "github.com").alias("github"), P.portfolio_url(F.col("urls")).alias("portfolio"))


def resume_skills(spark, d):
    return P.resume_skills(P.resume_lines(fixture(spark, RESUMES, "id bigint, body string"), "id", "body"), "id")


def resume_jobs(spark, d):
    rows = P.resume_jobs(P.resume_lines(fixture(spark, RESUMES, "id bigint, body string"), "id", "body"), "id")
    return rows.select("id", F.col("line_no").cast("bigint").alias("line_no"), "job_title", "company", F.date_format("start_date", "yyyy-MM-dd").alias("start"), F.date_format("end_date", "yyyy-MM-dd").alias("end"), "is_current")


def profile_chunks(spark, d):
    profiles = fixture(spark, PROFILE, "id string, headline string, summary string, location string")
    return P.evidence_chunks({"profile": profiles})


def evidence_chunks(spark, d):
    parts = table(spark, d, "part").withColumn("profile_id", (F.col("p_partkey") % 100).cast("string")).withColumn("id", F.col("p_partkey").cast("string"))
    skills = parts.select("id", "profile_id", F.col("p_name").alias("name"), F.col("p_brand").alias("category"), F.col("p_size").alias("years_of_experience"))
    words = F.split(F.col("p_type"), " ")
    projects = parts.select("id", "profile_id", F.col("p_name").alias("title"), F.col("p_type").alias("description"), words.alias("technologies"), F.when(F.col("p_size") > 25, F.array("p_brand")).otherwise(F.array().cast("array<string>")).alias("outcomes"))
    certificates = parts.select("id", "profile_id", F.col("p_name").alias("name"), F.col("p_brand").alias("issuing_organization"))
    return P.evidence_chunks({"skill": skills, "project": projects, "certification": certificates})


def role_classification(spark, d):
    return fixture(spark, ROLES, "id bigint, context string").select("id", D.role(F.col("context")).alias("role"))


def project_rerank(spark, d):
    rows = table(spark, d, "part").select(
        F.col("p_brand").alias("owner"), F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("title"), F.col("p_size").alias("base"),
        F.when(F.col("p_partkey") % 3 == 0, F.col("p_partkey") % 100).cast("int").alias("external"), F.when(F.col("p_size") == 7, -20).alias("protection"),
    )
    return D.reranked(rows, "owner").filter("position <= 5")


def category_names(spark, d):
    return table(spark, d, "part").select("p_partkey", D.group_name(F.concat_ws(" ", "p_type", "p_name")).alias("category"))


def application_dates(spark, d):
    status = F.element_at(F.array(*map(F.lit, ("saved", "applied", "interview"))), (F.col("o_orderkey") % 3 + 1).cast("int"))
    held = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd"))
    return table(spark, d, "orders").select("o_orderkey", D.applied_at(status, held, F.lit("2030-01-01")).alias("applied_at"))


def first_available(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("candidate"), F.col("o_orderkey").alias("position"), (F.col("o_orderstatus") == "F").alias("available"))
    return D.first_available(rows, "owner")


#: A résumé for each customer, in SQL that both engines read: headings of several spellings, and lines that cannot be read.
CUSTOMER_RESUME = """concat_ws('{nl}', c_name, concat('Engineer for ', c_mktsegment), concat('c', c_custkey, '@example.org | +44 20 ', lpad(CAST(c_custkey AS {text}), 8, '1')),
        CASE WHEN c_custkey % 2 = 0 THEN concat('https://GitHub.com/u', c_custkey, ', https://u', c_custkey, '.dev.') ELSE concat('https://www.linkedin.com/in/u', c_custkey) END,
        'Technical Skills:', concat('Tools: Python,  sql; ', c_mktsegment, ', PYTHON'), '• Docker | Git.', 'WORK EXPERIENCE', 'Engineer at Acme Jan 2020 - March 2022',
        concat('Lead | ', c_mktsegment, ' | 201', c_custkey % 10, ' to Present'), CASE WHEN c_custkey % 3 = 0 THEN 'no dates here' END, CASE WHEN c_custkey % 7 = 0 THEN '2010 - 2011' END,
        'Education', concat('BSc | Uni ', c_custkey % 5, ' | 2019'), CASE WHEN c_custkey % 4 = 0 THEN 'Evening class' END, 'Profile', 'Curious.', 'And quick.',
        'Selected Projects', 'Scraper | Collects pages | Playwright, , Redis', 'Only a title', CASE WHEN c_custkey % 2 = 0 THEN 'Certificates' END, CASE WHEN c_custkey % 6 = 0 THEN 'Cloud Cert | Vendor | 2021' END)"""
FILES = """CASE c_custkey % 11 WHEN 0 THEN 'notes.txt' WHEN 1 THEN 'a/CV.PDF' ELSE 'cv.docx' END"""


def resume_import(spark, d):
    customers = spread(table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment"), split=False)
    rows = customers.select("c_custkey", F.expr(CUSTOMER_RESUME.format(nl="\\n", text="STRING")).alias("body"), F.expr(FILES).alias("file"))
    p = lambda n: F.col(f"preview.{n}")
    day = lambda c: F.coalesce(F.date_format(c, "yyyy-MM"), F.lit("-"))
    listed = lambda n, show: F.array_join(F.transform(p(n), show), ",").alias(n)
    return S.previews(rows, "body", "file").select(
        "c_custkey", "error", *(p(n).alias(n) for n in ("full_name", "headline", "email", "phone", "summary", "linkedin_url", "github_url", "portfolio_url")),
        listed("skills", lambda x: F.concat_ws(":", x["name"], x["category"])),
        listed("work_experiences", lambda x: F.concat_ws("/", x["job_title"], x["company"], day(x["start_date"]), day(x["end_date"]), x["is_current"].cast("string"))),
        listed("projects", lambda x: F.concat_ws("/", x["title"], x["description"], F.array_join(x["technologies"], "+"))),
        listed("education", lambda x: F.concat_ws("/", x["degree"], x["institution"], day(x["end_date"]))),
        listed("certifications", lambda x: F.concat_ws("/", x["name"], x["issuing_organization"], day(x["issue_date"]))),
        F.array_join(p("extracted_sections"), ",").alias("sections"), F.array_join(p("warnings"), "|").alias("warnings"),
    )


def customer_chunks(spark, d):
    k = F.col("c_custkey")
    text = lambda c: F.when(k % 3 != 0, c)
    profiles = table(spark, d, "customer").select(k.cast("string").alias("id"), text(F.col("c_mktsegment")).alias("headline"), F.when(k % 6 != 0, F.col("c_name")).alias("summary"), F.when(k % 2 == 0, F.lit("")).alias("location"))
    return P.evidence_chunks({"profile": profiles})


#: Words of postings for each role, and for none.
ROLE_WORDS = tuple(" ".join(terms[i : i + 3]) for terms in D.ROLE_TERMS.values() for i in (0, 2)) + ("applied ai", "sales and service")


def part_roles(spark, d):
    words = F.element_at(F.array(*map(F.lit, ROLE_WORDS)), (F.col("p_partkey") % len(ROLE_WORDS) + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", D.role(F.concat_ws(" ", words, F.lower("p_name"), F.lower("p_type"))).alias("role"))


QUERIES = {
    f.__name__: f
    for f in (resume_lines, resume_header, resume_skills, resume_jobs, profile_chunks, evidence_chunks, role_classification, project_rerank, category_names, application_dates, first_available, resume_import, customer_chunks, part_roles)
}
_HEADINGS = "MAP {" + ", ".join(f"'{a}': '{b}'" for a, b in P.RESUME_HEADINGS.items()) + "}"
_ROLE = " ".join(
    f"WHEN {' + '.join(f'''CAST(contains(context, '{t}') AS INT)''' for t in D.ROLE_TERMS[name])} >= {least}" + (" OR contains(context, 'applied ai')" if name == "general" else "") + f" THEN '{name}'"
    for name, least in D.ROLE_ORDER
)


def _resume_sql() -> str:
    email, url, phone = (p.removeprefix("(?i)") for p in (P.EMAIL, P.URL, P.PHONE))
    dates = P.DATES.removeprefix("(?i)")
    contact = f"(regexp_matches(line, '{email}', 'i') OR regexp_matches(line, '{url}', 'i') OR regexp_full_match(line, '{phone}'))"
    category = " ".join(f"WHEN lower(skill) IN ({', '.join(repr(t) for t in terms)}) THEN '{name}'" for name, terms in P.SKILL_CATEGORIES)

    def month(value: str) -> str:
        return f"(CASE WHEN length({value}) = 4 THEN {value} || '-01' ELSE strftime(try_strptime({value}[1:3] || ' ' || {value}[-4:], '%b %Y'), '%Y-%m') END)"

    def entries(section: str, shown: str) -> str:
        return f"string_agg({shown}, ',' ORDER BY n) FILTER (section = '{section}' AND len(parts) >= 2)"

    def lost(section: str, ok: str) -> str:
        return f"nullif(count(*) FILTER (section = '{section}' AND NOT ({ok})), 0) || ' {S.IGNORED[section]}'"

    year = r"regexp_extract(line, '\b(?:19|20)\d{2}\b')"
    job = "start <> '' AND len(jobs) >= 2"
    return rf"""
        WITH b AS (SELECT c_custkey, {CUSTOMER_RESUME.format(nl=chr(10), text="VARCHAR")} AS body, c_custkey % 11 = 0 AS wrong FROM customer),
        r AS (SELECT c_custkey, unnest(string_split(body, chr(10))) AS raw, unnest(range(len(string_split(body, chr(10))))) AS n FROM b WHERE NOT wrong),
        c AS (SELECT c_custkey, n, trim(regexp_replace(raw, '\s+', ' ', 'g'), ' •') AS line FROM r),
        o AS (SELECT *, {_HEADINGS}[trim(regexp_replace(lower(line), '[^a-z ]', '', 'g'))] AS o FROM c WHERE line <> ''),
        l AS (
            SELECT c_custkey, n, line, section, {contact} AS contact, regexp_extract(line, '{email}', 0, 'i') AS email, regexp_extract(line, '{phone}', 0) AS phone,
                   list_transform(regexp_extract_all(line, '{url}', 0, 'i'), lambda u: rtrim(u, '.,;)')) AS urls, list_filter(list_transform(string_split(line, '|'), lambda p: trim(p)), lambda p: p <> '') AS parts,
                   regexp_extract(line, '{dates}', 1, 'i') AS start, regexp_extract(line, '{dates}', 2, 'i') AS stop,
                   list_filter(string_split_regex(trim(regexp_extract(line, '^(.*?)(?:{dates})', 1, 'i'), ' |-–—'), '\s*\|\s*|\s+at\s+'), lambda p: p <> '') AS jobs
            FROM (SELECT *, coalesce(last_value(o IGNORE NULLS) OVER (PARTITION BY c_custkey ORDER BY n ROWS UNBOUNDED PRECEDING), 'header') AS section FROM o) WHERE o IS NULL
        ),
        v AS (SELECT c_custkey, n, unnest(string_split_regex(regexp_replace(line, '^[^:]{{1,30}}:\s*', ''), '[,;|•]')) AS x, generate_subscripts(string_split_regex(regexp_replace(line, '^[^:]{{1,30}}:\s*', ''), '[,;|•]'), 1) AS i FROM l WHERE section = 'skills'),
        k AS (SELECT c_custkey, n, i, trim(x, ' .') AS skill FROM v WHERE trim(x, ' .') <> ''),
        s AS (SELECT c_custkey, string_agg(skill || ':' || CASE {category} ELSE 'General' END, ',' ORDER BY n, i) AS skills FROM (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY c_custkey, lower(skill) ORDER BY n, i) = 1) GROUP BY 1),
        g AS (
            SELECT c_custkey, list(line ORDER BY n) FILTER (section = 'header' AND NOT contact) AS plain, arg_min(email, n) FILTER (section = 'header' AND email <> '') AS email,
                   arg_min(phone, n) FILTER (section = 'header' AND phone <> '') AS phone, flatten(list(urls ORDER BY n) FILTER (section = 'header')) AS urls,
                   string_agg(line, ' ' ORDER BY n) FILTER (section = 'summary') AS summary,
                   string_agg(trim(jobs[1]) || '/' || trim(jobs[2]) || '/' || {month("start")} || '/' || CASE WHEN lower(stop) IN ('present', 'current') THEN '-/true' ELSE {month("stop")} || '/false' END, ',' ORDER BY n) FILTER (section = 'experience' AND {job}) AS work_experiences,
                   {entries("projects", "parts[1] || '/' || parts[2] || '/' || array_to_string(list_filter(list_transform(string_split(coalesce(parts[3], ''), ','), lambda t: trim(t)), lambda t: t <> ''), '+')")} AS projects,
                   {entries("education", f"parts[1] || '/' || parts[2] || '/' || CASE WHEN {year} <> '' THEN {year} || '-12' ELSE '-' END")} AS education,
                   {entries("certifications", f"parts[1] || '/' || parts[2] || '/' || CASE WHEN {year} <> '' THEN {year} || '-01' ELSE '-' END")} AS certifications,
                   string_agg(DISTINCT section, ',' ORDER BY section) FILTER (section <> 'header') AS sections,
                   concat_ws('|', '{S.NOTES[0]}', '{S.NOTES[1]}', {lost("experience", job)}, {lost("education", "len(parts) >= 2")}, {lost("certifications", "len(parts) >= 2")}) AS warnings
            FROM l GROUP BY 1
        )
        SELECT b.c_custkey, CASE WHEN wrong THEN '{S.ERRORS["kind"]}' END AS error, plain[1] AS full_name, list_filter(plain, lambda x: x <> plain[1])[1] AS headline, email, phone, summary,
               list_filter(urls, lambda u: contains(lower(u), 'linkedin.com'))[1] AS linkedin_url, list_filter(urls, lambda u: contains(lower(u), 'github.com'))[1] AS github_url,
               list_filter(urls, lambda u: NOT regexp_matches(lower(u), 'linkedin\.com|github\.com'))[1] AS portfolio_url, skills, CASE WHEN NOT wrong THEN coalesce(work_experiences, '') END AS work_experiences,
               CASE WHEN NOT wrong THEN coalesce(projects, '') END AS projects, CASE WHEN NOT wrong THEN coalesce(education, '') END AS education, CASE WHEN NOT wrong THEN coalesce(certifications, '') END AS certifications, sections, warnings
        FROM b LEFT JOIN s USING (c_custkey) LEFT JOIN g USING (c_custkey)"""


def _fixture_sql(rest: str) -> str:
    """The lines of the fixture's résumés with their sections, then ``rest``."""
    email, url, phone = (p.removeprefix("(?i)") for p in (P.EMAIL, P.URL, P.PHONE))
    return rf"""
        WITH r AS (SELECT id, unnest(string_split(body, chr(10))) AS raw, unnest(range(len(string_split(body, chr(10))))) AS n FROM {values(RESUMES, "v", "id, body")}),
        c AS (SELECT id, n, trim(regexp_replace(raw, '\s+', ' ', 'g'), ' •') AS line FROM r),
        o AS (SELECT *, {_HEADINGS}[trim(regexp_replace(lower(line), '[^a-z ]', '', 'g'))] AS o FROM c WHERE line <> ''),
        l AS (
            SELECT id, n, line, section, (regexp_matches(line, '{email}', 'i') OR regexp_matches(line, '{url}', 'i') OR regexp_full_match(line, '{phone}')) AS contact, regexp_extract(line, '{email}', 0, 'i') AS email,
                   regexp_extract(line, '{phone}', 0) AS phone, list_transform(regexp_extract_all(line, '{url}', 0, 'i'), lambda u: rtrim(u, '.,;)')) AS urls
            FROM (SELECT *, coalesce(last_value(o IGNORE NULLS) OVER (PARTITION BY id ORDER BY n ROWS UNBOUNDED PRECEDING), 'header') AS section FROM o) WHERE o IS NULL
        ){rest}"""


def _jobs_sql() -> str:
    dates = P.DATES.removeprefix("(?i)")
    day = "(CASE WHEN length({0}) = 4 THEN {0} || '-01-01' ELSE strftime(try_strptime({0}[1:3] || ' ' || {0}[-4:], '%b %Y'), '%Y-%m-%d') END)"
    return _fixture_sql(rf""",
        j AS (SELECT id, n, regexp_extract(line, '{dates}', 1, 'i') AS s, regexp_extract(line, '{dates}', 2, 'i') AS e,
                     list_filter(list_transform(string_split_regex(trim(CASE WHEN regexp_matches(line, '{dates}', 'i') THEN regexp_extract(line, '^(.*?)(?:{dates})', 1, 'i') ELSE line END, ' |-–—'), '\s*\|\s*|\s+at\s+'), lambda p: trim(p)), lambda p: p <> '') AS parts
              FROM l WHERE section = 'experience'),
        k AS (SELECT *, s <> '' AND len(parts) >= 2 AS ok, lower(e) IN ('present', 'current') AS now FROM j)
        SELECT id, n AS line_no, CASE WHEN ok THEN parts[1] END AS job_title, CASE WHEN ok THEN parts[2] END AS company, CASE WHEN ok THEN {day.format("s")} END AS start,
               CASE WHEN ok AND NOT now THEN {day.format("e")} END AS "end", CASE WHEN ok THEN now END AS is_current FROM k""")


_CATEGORY = " ".join(f"WHEN lower(skill) IN ({', '.join(repr(t) for t in terms)}) THEN '{name}'" for name, terms in P.SKILL_CATEGORIES)
ORACLE_SQL = {
    "resume_header": _fixture_sql("""
        SELECT id, coalesce(list(line ORDER BY n) FILTER (NOT contact AND length(line) <= 100)[1], 'Candidate') AS full_name,
               list_filter(list(line ORDER BY n) FILTER (NOT contact), lambda x: x IS DISTINCT FROM (list(line ORDER BY n) FILTER (NOT contact AND length(line) <= 100))[1])[1][1:250] AS headline,
               arg_min(email, n) FILTER (email <> '') AS email, arg_min(phone, n) FILTER (phone <> '') AS phone,
               list_filter(flatten(list(urls ORDER BY n)), lambda u: contains(lower(u), 'github.com'))[1] AS github, list_filter(flatten(list(urls ORDER BY n)), lambda u: NOT regexp_matches(lower(u), 'linkedin[.]com|github[.]com'))[1] AS portfolio
        FROM l WHERE section = 'header' GROUP BY 1"""),
    "resume_skills": _fixture_sql(rf""",
        v AS (SELECT id, n, string_split_regex(regexp_replace(line, '^[^:]{{1,30}}:\s*', ''), '[,;|•]') AS x FROM l WHERE section = 'skills'),
        k AS (SELECT id, n, unnest(list_transform(x, lambda y: trim(y, ' .'))) AS skill, generate_subscripts(x, 1) AS i FROM v),
        u AS (SELECT * FROM k WHERE skill <> '' AND length(skill) <= 150 QUALIFY row_number() OVER (PARTITION BY id, lower(skill) ORDER BY n, i) = 1)
        SELECT id, row_number() OVER (PARTITION BY id ORDER BY n, i) AS position, skill, CASE {_CATEGORY} ELSE 'General' END AS category FROM u"""),
    "resume_jobs": _jobs_sql(),
    "resume_lines": rf"""
        WITH r AS (SELECT * FROM {values(RESUMES, "v", "id, body")}),
        p AS (SELECT id, unnest(string_split(body, chr(10))) AS raw, unnest(range(len(string_split(body, chr(10))))) AS line_no FROM r),
        c AS (SELECT id, line_no, trim(regexp_replace(raw, '\s+', ' ', 'g'), ' •') AS line FROM p),
        o AS (SELECT *, {_HEADINGS}[trim(regexp_replace(lower(line), '[^a-z ]', '', 'g'))] AS o FROM c WHERE line <> ''),
        s AS (SELECT *, coalesce(last_value(o IGNORE NULLS) OVER (PARTITION BY id ORDER BY line_no ROWS UNBOUNDED PRECEDING), 'header') AS section FROM o)
        SELECT id, line_no, section, line FROM s WHERE o IS NULL""",
    "profile_chunks": f"""
        WITH p AS (SELECT * FROM {values(PROFILE, "v", "id, headline, summary, location")})
        SELECT id AS profile_id, 'profile-' || id || '-summary' AS evidence_id, 'profile' AS category, coalesce(headline, 'Candidate profile summary') AS label,
               concat_ws(' ', nullif(headline, ''), nullif(summary, ''), nullif(location, '')) AS text FROM p
        WHERE concat_ws(' ', nullif(headline, ''), nullif(summary, ''), nullif(location, '')) <> ''""",
    "evidence_chunks": """
        WITH p AS (SELECT *, CAST(p_partkey % 100 AS VARCHAR) AS profile_id FROM part)
        SELECT profile_id, 'skill-' || p_partkey AS evidence_id, 'skill' AS category, p_name AS label,
               p_name || '. Category: ' || p_brand || '. Candidate-reported experience: ' || p_size || ' years.' AS text FROM p
        UNION ALL SELECT profile_id, 'project-' || p_partkey, 'project', p_name, concat_ws(' ', p_name, p_type, 'Technologies: ' || replace(p_type, ' ', ', '),
               CASE WHEN p_size > 25 THEN 'Verified outcomes: ' || p_brand END) FROM p
        UNION ALL SELECT profile_id, 'certification-' || p_partkey, 'certification', p_name, p_name || ' issued by ' || p_brand || '.' FROM p""",
    "part_roles": f"""
        SELECT p_partkey, CASE {_ROLE} ELSE 'general' END AS role
        FROM (SELECT p_partkey, concat_ws(' ', [{", ".join(f"'{w}'" for w in ROLE_WORDS)}][CAST(p_partkey % {len(ROLE_WORDS)} + 1 AS INT)], lower(p_name), lower(p_type)) AS context FROM part)""",
    "customer_chunks": """
        WITH p AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END AS headline, CASE WHEN c_custkey % 6 <> 0 THEN c_name END AS summary FROM customer)
        SELECT CAST(id AS VARCHAR) AS profile_id, 'profile-' || id || '-summary' AS evidence_id, 'profile' AS category, coalesce(headline, 'Candidate profile summary') AS label, concat_ws(' ', headline, summary) AS text
        FROM p WHERE concat_ws(' ', headline, summary) <> ''""",
    "resume_import": _resume_sql(),
    "role_classification": f"SELECT id, CASE {_ROLE} ELSE 'general' END AS role FROM {values(ROLES, 'v', 'id, context')}",
    "project_rerank": """
        WITH s AS (SELECT p_brand AS owner, p_name || ' ' || p_partkey AS title, CAST(p_size + round_even(coalesce(CASE WHEN p_partkey % 3 = 0 THEN p_partkey % 100 END, 0) * 0.8, 0)
                          + CASE WHEN p_size = 7 THEN -20 ELSE 0 END AS BIGINT) AS score FROM part)
        SELECT *, position <= 3 AS selected FROM (SELECT owner, title, score, row_number() OVER (PARTITION BY owner ORDER BY score DESC, lower(title), title) AS position FROM s) WHERE position <= 5""",
    "category_names": """
        SELECT p_partkey, CASE WHEN contains(x, 'language') OR x = 'programming' THEN 'Languages' WHEN regexp_matches(x, 'backend|database|api') THEN 'Backend'
               WHEN regexp_matches(x, 'ai|machine|ml|cloud|data') THEN 'AI / Machine Learning' WHEN regexp_matches(x, 'automation|browser|workflow') THEN 'Automation'
               ELSE 'Developer Tools' END AS category FROM (SELECT p_partkey, lower(p_type || ' ' || p_name) AS x FROM part)""",
    "application_dates": """
        SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN NULL WHEN 1 THEN coalesce(h, '2030-01-01') ELSE h END AS applied_at
        FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS h FROM orders)""",
    "first_available": """
        SELECT o_custkey AS owner, min(o_orderkey) FILTER (o_orderstatus = 'F') AS candidate,
               min(o_orderkey) FILTER (o_orderstatus = 'F') > min(o_orderkey) AS fallback FROM orders GROUP BY 1""",
}
