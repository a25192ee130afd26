"""Elements of HTML pages by selector, in column functions: a stream of tokens, folded with a stack of open elements.

A selector is a chain of compounds (``name.class#id[attr='value']``, each part optional) that an element and its ancestors match in
order.  Every compound of every selector has a bit.  A tag's bits are set where it matches a compound by itself; the fold keeps of
each open element the bits of chains that end at it or above, so a chain goes on where the bit before its own is set: one shift
and one mask for all selectors together.  The stack is as deep as elements are nested, so the fold is linear in the tags.

Elements whose end may be left out (``p``, ``li``, cells, rows, options, terms) end as in browsers; end tags without an element are
passed over; what is open at the end of the page ends there.  Null pages have null fields, empty ones too.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.operators import pages

#: Fixed values of HTML: elements without content, those whose content is no markup, those never shown, and blocks that end a paragraph.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
RAW = ("script", "style", "title", "textarea")
UNSEEN = ("head", "template", "noscript", *RAW[:3])
BLOCKS = (
    "address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
    "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul",
)
#: Fixed values of HTML: which open elements a tag ends, unless one of the others was opened since.
ENDS = (
    (BLOCKS, ("p",), ("button", "td", "th", "caption")), (("li",), ("li",), ("ul", "ol")), (("dt", "dd"), ("dt", "dd"), ("dl",)), (("option",), ("option",), ("select",)),
    (("tr",), ("tr",), ("table",)), (("td", "th"), ("td", "th"), ("tr",)),
)
TOKEN = (
    r"(?s)<!--.*?-->|<(?i:" + "|".join(RAW) + r")\b[^>]*>.*?</(?i:" + "|".join(RAW) + r")\s*>"
    r"""|<[/!?a-zA-Z](?:[^>"']++|"[^"]*+"|'[^']*+')*+>|<[/!?a-zA-Z][^>]*>|[^<]+|<"""
)
COMPOUND = re.compile(r"""\.(?P<cls>[\w-]+)|\#(?P<id>[\w-]+)|\[(?P<attr>[\w-]+)(?:=(?P<quote>['"]?)(?P<value>[^'"\]]*)(?P=quote))?\]|(?P<name>[A-Za-z][\w-]*)""")

#: Where postings of known platforms and hosts keep their fields, the first that is there counts.
PLATFORM_SELECTORS: dict[str, dict[str, tuple[str, ...]]] = {
    "linkedin": {
        "raw_title": (".top-card-layout__title", ".job-details-jobs-unified-top-card__job-title"),
        "company_name": (".topcard__org-name-link", ".job-details-jobs-unified-top-card__company-name"),
        "location": (".topcard__flavor--bullet", ".job-details-jobs-unified-top-card__primary-description-container"),
        "description_text": (".show-more-less-html__markup", ".jobs-description__content"),
    },
    "indeed": {
        "raw_title": ("h1[data-testid='jobsearch-JobInfoHeader-title']", "h1"),
        "company_name": ("[data-testid='inlineHeader-companyName']", "[data-company-name='true']"),
        "location": ("[data-testid='job-location']", "[data-testid='inlineHeader-companyLocation']"),
        "description_text": ("#jobDescriptionText",),
    },
    "glassdoor": {
        "raw_title": ("[data-test='job-title']", "h1"),
        "company_name": ("[data-test='employer-name']",),
        "location": ("[data-test='location']",),
        "description_text": ("[data-test='job-description']", ".JobDetails_jobDescription__"),
    },
}
DOMAIN_SELECTORS: dict[str, dict[str, tuple[str, ...]]] = {
    "greenhouse.io": {
        "raw_title": ("h1.app-title", ".job__title h1", "h1"),
        "company_name": (".company-name", ".job__company"),
        "location": (".location", ".job__location"),
        "description_text": ("#content", ".job__description", ".content"),
    },
    "lever.co": {
        "raw_title": (".posting-headline h2", "h2"),
        "company_name": (".posting-headline .company", ".company-name"),
        "location": (".posting-categories .location", ".location"),
        "description_text": (".posting-page .content", ".posting-description", ".section-wrapper.page-full-width"),
    },
}
FIELDS = ("raw_title", "company_name", "location", "description_text")


@dataclass(frozen=True)
class Compound:
    """What one element must have: ``tests`` are (kind, name, value)."""

    tests: tuple[tuple[str, str, str | None], ...]

    @classmethod
    def of(cls, text: str) -> Compound:
        tests, at = [], 0
        while at < len(text):
            found = COMPOUND.match(text, at)
            if not found or (found["name"] and at):
                raise ValueError(f"cannot read the selector part {text!r}")
            if found["cls"]:
                tests.append(("class", "class", found["cls"]))
            elif found["name"]:
                tests.append(("name", "", found["name"].lower()))
            else:
                tests.append(("attribute", "id" if found["id"] else found["attr"].lower(), found["id"] or found["value"]))
            at = found.end()
        return cls(tuple(tests))

    def holds(self, name: Column, attributes: dict[str, Column]) -> Column:
        def test(kind: str, attribute: str, value: str | None) -> Column:
            if kind == "name":
                return name == value
            if kind == "class":
                return F.contains(F.concat(F.lit(" "), F.regexp_replace(F.coalesce(attributes["class"], F.lit("")), r"\s+", " "), F.lit(" ")), F.lit(f" {value} "))
            return attributes[attribute].isNotNull() if value is None else F.coalesce(attributes[attribute], F.lit("")) == value

        return reduce(lambda a, b: a & b, (test(*t) for t in self.tests))


def chain(selector: str) -> list[Compound]:
    parts = selector.split()
    if not parts:
        raise ValueError("an empty selector")
    return [Compound.of(p) for p in parts]


def let(value: Column, body) -> Column:
    """``body(value)`` with the value made once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def tokens(html: Column) -> Column:
    """Tags, comments, elements whose content is no markup, and the texts between, as they stand."""
    return F.regexp_extract_all(html, F.lit(TOKEN), F.lit(0))


def _has_attributes(tag: Column) -> Column:
    """Most tags have none, which is told sooner than that they lack a certain one."""
    return F.rlike(tag, F.lit(r"\s"))


def attribute(tag: Column, name: str) -> Column:
    """The value of a tag's attribute: empty if it has no value, null if it is not there."""
    at = rf"""(?is)^<[a-z][^\s/>]*(?:\s+(?!{name}[\s=/>])[^\s=>]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+))?)*+\s+{name}(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)|(?=[\s/>]))"""
    return F.when(_has_attributes(tag) & F.rlike(tag, F.lit(at)), F.btrim(F.regexp_extract(tag, at, 1), F.lit("\"'")))


def tags(stream: Column, compounds: list[Compound]) -> Column:
    """The tags of a token stream: (at, name, kind, own, shown); ``at`` is the token's number, ``own`` has the bits of the compounds that a tag matches by itself."""
    names = sorted({t[1] for c in compounds for t in c.tests if t[0] != "name"})
    opened = F.transform(stream, lambda t, i: F.struct((i + 1).alias("at"), t.alias("tag"), F.lower(F.regexp_extract(t, r"^</?([A-Za-z][^\s/>]*)", 1)).alias("name")))

    def measured(t: Column) -> Column:
        kind = F.when(F.startswith(t["tag"], F.lit("</")), "end").when(t["name"].isin(*VOID, *RAW), "leaf").otherwise("start")
        begins = kind != "end"
        attributes = {n: attribute(t["tag"], n) for n in names}
        bits = F.lit(0).cast("bigint")
        for i, c in enumerate(compounds):
            bits = bits + F.when(c.holds(t["name"], attributes), F.lit(1 << i)).otherwise(0).cast("bigint")
        unseen = F.rlike(t["tag"], F.lit(r"(?is)^<[a-z][^>]*\s(?:hidden[\s=/>]|style\s*=\s*[\"']?[^\"'>]*display\s*:\s*none)"))
        hidden = t["name"].isin(*UNSEEN) | (_has_attributes(t["tag"]) & unseen)
        own = F.when(begins, bits).otherwise(F.lit(0).cast("bigint"))
        return F.struct(t["at"].alias("at"), t["name"].alias("name"), kind.alias("kind"), own.alias("own"), (~hidden).alias("shown"))

    return F.transform(F.filter(opened, lambda t: t["name"] != ""), measured)


def _last(names: Column, wanted) -> Column:
    """The place of the last of the names that is one of those wanted, 0 if there is none."""
    back = F.reverse(names)
    places = [F.array_position(back, F.lit(w) if isinstance(w, str) else w) for w in wanted]
    return reduce(F.greatest, (F.when(p > 0, F.size(names) + 1 - p).otherwise(0).cast("int") for p in places)) if len(places) > 1 else F.when(places[0] > 0, F.size(names) + 1 - places[0]).otherwise(0).cast("int")


def _kept(names: Column, tag: Column) -> Column:
    """How many open elements stay open when a tag comes."""
    size = F.size(names)
    closed = let(_last(names, [tag["name"]]), lambda p: F.when(p > 0, p - 1).otherwise(size))
    begun = size
    for openers, ended, walls in reversed(ENDS):
        place = F.struct(_last(names, ended).alias("p"), _last(names, walls).alias("w"))
        begun = F.when(tag["name"].isin(*openers), let(place, lambda x: F.when((x["p"] > 0) & (x["p"] > x["w"]), x["p"] - 1).otherwise(size))).otherwise(begun)
    return F.when(tag["kind"] == "end", closed).otherwise(begun)


def spans(stream: Column, selectors: list[str]) -> Column:
    """For each selector the first element that matches it: (begin, level, stop, shown), tokens by number; begin is null where none does."""
    chains = [chain(s) for s in selectors]
    flat = [c for part in chains for c in part]
    if len(flat) > 62:
        raise ValueError("more than 62 compounds in one set of selectors")
    firsts, lasts, at = 0, [], 0
    for part in chains:
        firsts |= 1 << at
        at += len(part)
        lasts.append(1 << (at - 1))
    nothing = F.struct(*(F.lit(None).cast(t).alias(n) for n, t in (("begin", "int"), ("level", "int"), ("stop", "int"), ("shown", "boolean"))))
    start = F.struct(
        F.array().cast("array<string>").alias("names"), F.array().cast("array<bigint>").alias("up"), F.array().cast("array<boolean>").alias("shown"),
        F.array(*[nothing] * len(chains)).alias("found"),
    )
    ends = F.array(*(F.lit(b).cast("bigint") for b in lasts))

    def step(state: Column, tag: Column) -> Column:
        def at_size(kept: Column) -> Column:
            above = F.when(kept > 0, F.element_at(state["up"], kept)).otherwise(F.lit(0).cast("bigint"))
            seen = F.when(kept > 0, F.element_at(state["shown"], kept)).otherwise(F.lit(True)) & tag["shown"]
            facts = F.struct(kept.alias("kept"), above.alias("above"), seen.alias("seen"), tag["own"].bitwiseAND(F.lit(firsts).cast("bigint").bitwiseOR(F.shiftleft(above, 1))).alias("bits"))
            return let(facts, pushed)

        def pushed(x: Column) -> Column:
            begins = tag["kind"] == "start"

            def grown(column: str, value: Column) -> Column:
                own = F.slice(state[column], F.lit(1), x["kept"])
                return F.when(begins, F.concat(own, F.array(value))).otherwise(own)

            def marked(f: Column, i: Column) -> Column:
                ended = f["begin"].isNotNull() & f["stop"].isNull() & (f["level"] > x["kept"])
                new = f["begin"].isNull() & (tag["kind"] != "end") & (x["bits"].bitwiseAND(F.element_at(ends, i + 1)) != 0)
                stop = F.when(ended | (new & (tag["kind"] == "leaf")), tag["at"]).otherwise(f["stop"])
                begin, level = F.when(new, tag["at"]).otherwise(f["begin"]), F.when(new, x["kept"] + 1).otherwise(f["level"])
                return F.struct(begin.alias("begin"), level.alias("level"), stop.alias("stop"), F.when(new, x["seen"]).otherwise(f["shown"]).alias("shown"))

            return F.struct(
                grown("names", tag["name"]).alias("names"), grown("up", x["above"].bitwiseOR(x["bits"])).alias("up"), grown("shown", x["seen"]).alias("shown"),
                F.transform(state["found"], marked).alias("found"),
            )

        return let(_kept(state["names"], tag), at_size)

    return F.aggregate(tags(stream, flat), start, step, lambda s: s["found"])


BREAKS = rf"(?i)^</?(?:{'|'.join((*BLOCKS, 'br', 'li', 'dt', 'dd', 'tr'))})(?:[\s/>]|$)"


def inner_text(stream: Column) -> Column:
    """The text that tokens show: blocks and breaks begin lines, cells are apart, blanks are squeezed, lines without text are dropped."""

    def shown(t: Column) -> Column:
        text = reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pages.ENTITIES, F.regexp_replace(t, r"\s+", " "))
        cell = F.rlike(t, F.lit(r"(?i)^<t[dh][\s/>]"))
        return F.when(F.rlike(t, F.lit(BREAKS)), "\n").when(cell, " ").when(F.rlike(t, F.lit(r"^<[/!?a-zA-Z]")), "").otherwise(text)

    joined = F.regexp_replace(F.array_join(F.transform(stream, shown), ""), r"[ \t]+", " ")
    return F.btrim(F.regexp_replace(joined, r" ?\n[ \n]*", "\n"), F.lit(" \n"))


def select_texts(html: Column, fields: dict[str, tuple[str, ...]]) -> Column:
    """A struct with, for each field, the visible text of the first of its selectors whose first element is shown and has text."""
    selectors = list(dict.fromkeys(s for found in fields.values() for s in found))

    def texts(stream: Column) -> Column:
        def read(found: Column) -> Column:
            def text(selector: str) -> Column:
                f = F.element_at(found, selectors.index(selector) + 1)
                stop = F.coalesce(f["stop"], F.size(stream) + 1)
                inner = F.slice(stream, f["begin"] + 1, F.greatest(stop - f["begin"] - 1, F.lit(0)))
                return F.when(f["shown"], F.nullif(inner_text(inner), F.lit("")))

            return F.struct(*(F.coalesce(*(text(s) for s in chosen)).alias(field) for field, chosen in fields.items()))

        return let(spans(stream, selectors), read)

    return let(tokens(html), texts)


def posting_texts(html: Column, url: Column) -> Column:
    """(raw_title, company_name, location, description_text) by the selectors of the page's host, else of its platform; null where there are none."""
    kind = f"struct<{', '.join(f'{n}: string' for n in FIELDS)}>"
    host, platform, out = pages.host(url), pages.platform(url), F.lit(None).cast(kind)
    for name, fields in PLATFORM_SELECTORS.items():
        out = F.when(platform == name, select_texts(html, fields)).otherwise(out)
    for domain, fields in DOMAIN_SELECTORS.items():
        out = F.when((host == domain) | host.endswith(f".{domain}"), select_texts(html, fields)).otherwise(out)
    return out


#: What a result warns of.
MANUAL = "Use manual import fallback for this posting."
WARNINGS = {
    "unsupported": "Unsupported job platform. Please paste the job description manually.",
    "login": "The job site showed a login page instead of the job posting. Paste the job description manually.",
    "blocked": "Extraction stopped because the page appears blocked, gated, or requires verification.",
    "title": "Job title could not be inferred from visible page content.",
    "company": "Company name could not be inferred from visible page content.",
    "description": "Visible job-description text is too short for reliable analysis.",
}
LEAST_DESCRIPTION = 80


def postings(df: DataFrame, html: str = "html", url: str = "url", by_selector: Column | None = None, any_platform: bool = False) -> DataFrame:
    """The rows with ``posting``, what their pages say as a job posting:

    (platform, outcome, pipeline_ready, raw_title, company_name, location, description_text, employment_type, workplace_type, confidence, warnings).
    Fields are read by selector (``by_selector``, or those of the platform), else inferred from the title and the lines.  A page of no
    known platform is ``unsupported_source`` unless ``any_platform``; one behind a login, blocked, without title or company, or with
    less than ``LEAST_DESCRIPTION`` characters is an ``extraction_failure``, without fields; the others are ready."""
    selected = posting_texts(F.col(html), F.col(url)) if by_selector is None else by_selector
    lines = pages.without_noise(pages.visible_text(F.coalesce(F.col(html), F.lit(""))))

    def read(x: Column) -> Column:
        own = {"title": x["by"]["raw_title"], "company": x["by"]["company_name"], "location": x["by"]["location"]}
        found = pages.fields(x["lines"], x["title"], own)
        body = F.array_join(x["lines"], "\n")
        return F.struct(
            x["by"].alias("by"), body.alias("body"), pages.page_gate(body, x["title"], F.col(url)).alias("gate"), F.coalesce(x["by"]["description_text"], body).alias("description"),
            *(F.nullif(c, F.lit("")).alias(n) for n, c in found.items()),
        )

    def judged(x: Column) -> Column:
        platform = pages.platform(F.col(url))
        short = F.length(x["description"]) < LEAST_DESCRIPTION
        ready = x["title"].isNotNull() & x["company"].isNotNull() & ~short & x["gate"].isNull()
        unsupported = F.lit(False) if any_platform else platform == "unknown"
        notes = F.array(
            F.when(x["gate"] == "login", WARNINGS["login"]).when(x["gate"] == "blocked", WARNINGS["blocked"]),
            *(F.when(x["gate"].isNull() & c, WARNINGS[n]) for n, c in (("title", x["title"].isNull()), ("company", x["company"].isNull()), ("description", short))),
            F.when(~ready, MANUAL),
        )
        warnings = F.when(unsupported, F.array(F.lit(WARNINGS["unsupported"]))).otherwise(F.array_compact(notes))
        outcome = F.when(unsupported, "unsupported_source").when(ready, "success").otherwise("extraction_failure")
        good = outcome == "success"
        any_selected = F.coalesce(*(x["by"][n] for n in FIELDS)).isNotNull()
        sure = pages.confidence(x["title"].isNotNull(), x["company"].isNotNull(), x["location"].isNotNull(), x["description"], any_selected).cast("double")
        values = {
            "raw_title": x["title"], "company_name": x["company"], "location": x["location"],
            "employment_type": pages.first_said(x["body"], pages.EMPLOYMENT), "workplace_type": pages.first_said(x["body"], pages.WORKPLACE),
        }
        return F.struct(
            platform.alias("platform"), outcome.alias("outcome"), good.alias("pipeline_ready"), *(F.when(good, c).alias(n) for n, c in values.items()),
            F.when(good, x["description"]).otherwise("").alias("description_text"), F.when(good, sure).otherwise(F.lit(0.0)).alias("confidence"), warnings.alias("warnings"),
        )

    page = F.struct(selected.alias("by"), lines.alias("lines"), pages.title(F.col(html)).alias("title"))
    return df.withColumn("posting", let(let(page, read), judged))
