"""Page and document text: visible text of HTML, titles, URLs, contacts and line cleanup."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))
#: What login walls and blocked pages say, paths that lead to them, and lines that only navigate.
LOGIN_MARKERS = ("sign in with apple", "email or phone", "forgot password", "keep me logged in", "new to linkedin", "join linkedin")
LOGIN_TITLE = "linkedin login"
LOGIN_PATHS = ("/authwall", "/checkpoint/", "/login", "/uas/login")
BLOCK_MARKERS = (
    "captcha", "verify you are human", "access denied", "unusual traffic", "sign in to continue", "log in to continue", "login required", "authentication required",
)
NOISE_LINES = ("about", "accessibility", "careers", "cookies", "help", "home", "jobs", "privacy", "sign in", "terms")


def visible_text(html: Column) -> Column:
    """Text of a page without scripts, styles, comments and tags, blanks squeezed."""
    body = F.regexp_replace(html, r"(?is)<(script|style|head)\b.*?</\1\s*>|<!--.*?-->", " ")
    body = F.regexp_replace(body, r"(?i)<(?:br|/p|/div|/li|/h[1-6]|/tr)\b[^>]*>", "\n")
    body = reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), ENTITIES, F.regexp_replace(body, r"<[^>]*>", " "))
    return F.btrim(F.regexp_replace(F.regexp_replace(body, r"[ \t]+", " "), r"\s*\n\s*", "\n"), F.lit(" \n"))


def title(html: Column) -> Column:
    found = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)
    return F.when(found != "", F.btrim(reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), ENTITIES, found)))


def title_parts(page_title: Column) -> Column:
    """The parts of a page title around " - ", " | " or " at "."""
    return F.split(page_title, r"\s+(?:[-|]|at)\s+")


def host(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def query_value(url: Column, name: str) -> Column:
    return F.try_parse_url(url, F.lit("QUERY"), F.lit(name))


#: Hosts of known platforms.
PLATFORMS = (("linkedin.com", "linkedin"), ("indeed.com", "indeed"), ("glassdoor.com", "glassdoor"), ("greenhouse.io", "company_site"), ("lever.co", "company_site"))
#: Employment types and workplaces by what a page says, the first that it says counts.
EMPLOYMENT = (("full-time", "full_time"), ("full time", "full_time"), ("part-time", "part_time"), ("part time", "part_time"), ("contract", "contract"), ("internship", "internship"), ("freelance", "freelance"))
WORKPLACE = (("hybrid", "hybrid"), ("remote", "remote"), ("on-site", "onsite"), ("onsite", "onsite"))


def platform(url: Column) -> Column:
    """The platform of a URL by its host or a parent domain of it."""
    name, out = host(url), F.lit("unknown")
    for domain, value in reversed(PLATFORMS):
        out = F.when((name == domain) | name.endswith(f".{domain}"), value).otherwise(out)
    return out


def first_said(body: Column, pairs) -> Column:
    low, out = F.lower(body), F.lit(None).cast("string")
    for label, value in reversed(pairs):
        out = F.when(F.contains(low, F.lit(label)), value).otherwise(out)
    return out


def without_noise(body: Column, noise=NOISE_LINES) -> Column:
    """Lines with blanks squeezed, without navigation words, each once in any case, in order."""
    lines = F.filter(F.transform(F.split(body, r"\r\n|\r|\n"), lambda x: F.btrim(F.regexp_replace(x, r"\s+", " "))), lambda x: (x != "") & ~F.lower(x).isin(*noise))
    # lines and their keys are the variable of a lambda, so that they are made once and not once for each line
    both = F.array(F.struct(lines.alias("lines"), F.transform(lines, F.lower).alias("keys")))
    return F.flatten(F.transform(both, lambda s: F.filter(s["lines"], lambda x, i: F.array_position(s["keys"], F.lower(x)) == i + 1)))


def job_url(url: Column) -> Column:
    """A search of LinkedIn that shows a posting as the address of that posting; other addresses as they are."""
    name, shown = host(url), F.btrim(query_value(url, "currentJobId"))
    linkedin = (name == "linkedin.com") | name.endswith(".linkedin.com")
    return F.when(linkedin & shown.rlike(r"^\d+$"), F.concat(F.lit("https://www.linkedin.com/jobs/view/"), shown)).otherwise(url)


def fields(lines: Column, page_title: Column, known: dict[str, Column] | None = None) -> dict[str, Column]:
    """Title, company and location of a posting, from the page's title and the lines around it; those ``known`` (where not null) stand.

    The title is the first part of the page's title, else the first line of at most 250 characters; the company the second part,
    unless it names a platform, else the line behind the title, else the second line; the location the first of the four
    lines behind title and company that is at most 120 characters and no sentence."""
    parts = F.filter(F.transform(title_parts(F.coalesce(page_title, F.lit(""))), lambda p: F.btrim(p)), lambda p: (p != "") & ~F.lower(p).startswith("job search"))
    given = {n: F.lit(None).cast("string") for n in ("title", "company", "location")} | (known or {})
    name = F.coalesce(given["title"], F.get(parts, F.lit(0)), F.get(F.filter(lines, lambda x: F.length(x) <= 250), F.lit(0)))
    second = F.get(parts, F.lit(1))
    at = F.array_position(lines, F.coalesce(name, F.lit("")))
    behind = F.when(at > 0, F.get(lines, at.cast("int")))
    company = F.coalesce(given["company"], F.when(~F.lower(second).isin("linkedin", "indeed", "glassdoor"), second), behind, F.get(lines, F.lit(1)))
    start = F.greatest(at, F.array_position(lines, F.coalesce(company, F.lit("")))).cast("int")
    near = F.slice(lines, start + 1, F.lit(4))
    location = F.coalesce(given["location"], F.get(F.filter(near, lambda x: (F.length(x) <= 120) & ~x.rlike(r"[.!?]$")), F.lit(0)))
    return {"title": name, "company": company, "location": location}


def page_gate(body: Column, page_title: Column, final_url: Column) -> Column:
    """What keeps a page from being read as a posting: "login" by two markers, the title or the path, "blocked", or null for nothing."""
    low = F.lower(F.coalesce(body, F.lit("")))
    count = lambda c, words: reduce(lambda a, b: a + b, (F.contains(c, F.lit(w)).cast("int") for w in words))
    path = F.lower(F.coalesce(F.try_parse_url(final_url, F.lit("PATH")), F.lit("")))
    login = (count(low, LOGIN_MARKERS) >= 2) | F.contains(F.lower(F.coalesce(page_title, F.lit(""))), F.lit(LOGIN_TITLE)) | (count(path, LOGIN_PATHS) > 0)
    return F.when(login, "login").when(count(low, BLOCK_MARKERS) > 0, "blocked")


def confidence(has_title: Column, has_company: Column, has_location: Column, description: Column, by_selector: Column) -> Column:
    """Confidence of extracted fields, at most 1."""
    one = lambda c, w: F.when(c, F.lit(w)).otherwise(0)
    parts = one(has_title, 25) + one(has_company, 25) + one(has_location, 10) + one(F.length(description) >= 80, 30) + one(by_selector, 10)
    return F.least(parts, F.lit(100)) / 100


def contacts(df: DataFrame, key: str, body: str) -> DataFrame:
    """(key, email, n_emails) of the texts that hold an address."""
    found = F.regexp_extract_all(F.col(body), F.lit(EMAIL), F.lit(0))
    rows = df.filter(F.col(body).rlike(EMAIL)).withColumn("_e", found)
    return rows.select(key, F.element_at("_e", 1).alias("email"), F.size("_e").cast("bigint").alias("n_emails"))


def distinct_lines(df: DataFrame, key: str, body: str) -> DataFrame:
    """(key, n_lines, body): lines with blanks squeezed, empty ones and repeats after the first dropped."""
    cleaned = F.transform(F.split(F.col(body), "\n"), lambda x: F.btrim(F.regexp_replace(x, r"[ \t]+", " ")))
    kept = F.array_distinct(F.filter(cleaned, lambda x: x != ""))
    return df.select(key, F.size(kept).cast("bigint").alias("n_lines"), F.array_join(kept, "\n").alias("body")).filter("n_lines > 0")
