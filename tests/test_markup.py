"""Selectors over pages, and postings read by them."""

from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from evidentia.operators import markup as M
from evidentia.operators import pages

LONG = "We build data pipelines for many teams and look for a person who likes to make them simple and quick."
PAGES = {
    "https://www.linkedin.com/jobs/view/1": (
        '<html><head><title>Other | LinkedIn</title></head><body><h1 class="a top-card-layout__title x">  Data <b>Engineer</b> </h1>'
        f'<a class="topcard__org-name-link" href="/x?a>b">Acme &amp; Co</a><span class="topcard__flavor--bullet">Berlin</span><div class="show-more-less-html__markup"><p>{LONG}<p>Remote, full-time</div></body></html>',
        ("Data Engineer", "Acme & Co", "Berlin", f"{LONG}\nRemote, full-time"),
    ),
    "https://de.indeed.com/viewjob?jk=2": (
        "<title>x</title><h1 data-testid=jobsearch-JobInfoHeader-title style='display: none'>Hidden</h1><h1>Shown</h1><div data-company-name='true'>Two</div>"
        f"<div data-testid=\"job-location\"></div><div data-testid='inlineHeader-companyLocation'>Paris</div><div id=jobDescriptionText>{LONG}",
        # the first h1 is not shown, and the second selector names it too: nothing is selected
        (None, "Two", "Paris", LONG),
    ),
    "https://boards.greenhouse.io/x/jobs/3": (
        f"<div class='job__title'><p>no<h1>Lead</h1></div><h1>Other</h1><p class='company-name'>Three</p><div class='location'>Rome<div>inner</div>.</div>after<div id='content'><ul><li>{LONG}<li>two</ul></div>tail",
        ("Lead", "Three", "Rome\ninner\n.", f"{LONG}\ntwo"),
    ),
    "https://jobs.lever.co/y/4": (
        f"<h2>Before</h2><div class='posting-headline'><h2>Dev</h2><div class='company'>Four</div></div><div class='location'>Away</div><div class=posting-categories><i class=location>Here</i></div><div class='section-wrapper page-full-width'>{LONG}</div>",
        ("Dev", "Four", "Here", LONG),
    ),
    "https://example.com/5": (f"<h1>x</h1>{LONG}", (None,) * 4),
}


@pytest.mark.parametrize("url", PAGES)
def test_platform_selectors(spark, url):
    page, want = PAGES[url]
    found = spark.range(1).select(M.posting_texts(F.lit(page), F.lit(url)).alias("f")).first()["f"]
    assert (tuple(found) if found else (None,) * 4) == want


def first_of(spark, page, *selectors):
    return spark.range(1).select(M.select_texts(F.lit(page), {f"s{i}": (s,) for i, s in enumerate(selectors)}).alias("f")).first()["f"]


def test_chains_and_parts(spark):
    page = "<main id=m><section class='a  b'><div><p lang='en' data-x>one<p>two</section><section class=b><p>three</p></section></main><p class='c'>four</p>"
    found = first_of(spark, page, ".b p", ".a.b p[lang]", "#m .b", "section p[data-x]", "section section p", ".a p .b", "p.c", ".missing", "[lang='en']", "main#m", "div .b p")
    assert tuple(found) == ("one", "one", "one\ntwo", "one", None, None, "four", None, "one", "one\ntwo\nthree", None)


@pytest.mark.parametrize(
    "page,want",
    [
        ("<!-- <p class=x>no</p> --><script>'<p class=x>no</p>'</script><p class=x>yes", "yes"),
        ("<ul><li class=x>one<ul><li>in</ul>out<li>two</ul>", "one\nin\nout"),
        ("<table><tr><td class=x>a<td>b<tr><td>c</table>", "a"),
        ("<div class=x>a</span></b>b</div>c", "ab"),
        ("<img class=x><p>b", None),
        ("<p class=X>b", None),
        ("<P CLASS='x'>b</P>c", "b"),
        ("<div hidden><p class=x>b</div><p class=x>c", None),
        ("<p title='class=x'>a</p><p title=\"a > b\" class=x>b</p>", "b"),
        ("", None),
        ("<", None),
        ("<p class=x", None),
        ("<p class=x>" + "<b>" * 300 + "deep", "deep"),
    ],
)
def test_odd_markup(spark, page, want):
    assert first_of(spark, page, ".x")[0] == want


def test_null_page(spark):
    found = spark.range(1).select(M.select_texts(F.lit(None).cast("string"), {"a": ("p",)}).alias("f")).first()["f"]
    assert found is None or found["a"] is None


class Texts(HTMLParser):
    """The text of the first element of a name, for well-formed pages."""

    def __init__(self, name):
        super().__init__(convert_charrefs=True)
        self.name, self.depth, self.done, self.parts = name, 0, False, []

    def handle_starttag(self, tag, attrs):
        if tag == self.name and not self.done:
            self.depth += 1

    def handle_endtag(self, tag):
        if tag == self.name and self.depth:
            self.depth -= 1
            self.done = self.depth == 0

    def handle_data(self, data):
        if self.depth:
            self.parts.append(data)


def test_whole_pages(spark):
    """Nested pages against the parser of the standard library."""
    import random

    rng = random.Random(7)

    def tree(depth):
        if depth == 0 or rng.random() < 0.2:
            return rng.choice(["a ", "b&amp;", "c d ", ""])
        name = rng.choice(["i", "b", "em", "span"])
        return f"<{name}>" + "".join(tree(depth - 1) for _ in range(rng.randint(1, 4))) + f"</{name}>"

    made = [(i, "<body>" + "".join(tree(5) for _ in range(4)) + "</body>") for i in range(60)]
    names = ("i", "b", "em", "span")
    df = spark.createDataFrame(made, "id int, html string").select("id", M.select_texts(F.col("html"), {n: (n,) for n in names}).alias("f"))
    for row in df.collect():
        for name in names:
            parser = Texts(name)
            parser.feed(made[row["id"]][1])
            assert (row["f"][name] or "") == " ".join("".join(parser.parts).split())


def test_selectors_that_cannot_be_read():
    for bad in ("", "p > a b", "p:first", "a,b", ".x%"):
        with pytest.raises(ValueError):
            [M.chain(bad)]


def test_postings(spark):
    rows = [(u, p) for u, (p, _) in PAGES.items()]
    rows += [("https://www.linkedin.com/login", PAGES["https://www.linkedin.com/jobs/view/1"][0]), ("https://lever.co/a", "<p>Please log in to continue"), ("https://lever.co/b", "<p>Dev</p>short"), ("https://lever.co/c", None)]
    got = {r["url"]: r["posting"] for r in M.postings(spark.createDataFrame(rows, "url string, html string")).collect()}
    one = got["https://www.linkedin.com/jobs/view/1"]
    assert (one["platform"], one["outcome"], one["pipeline_ready"], one["confidence"], one["warnings"]) == ("linkedin", "success", True, 1.0, [])
    assert (one["raw_title"], one["company_name"], one["employment_type"], one["workplace_type"]) == ("Data Engineer", "Acme & Co", "full_time", "remote")
    assert got["https://example.com/5"]["outcome"] == "unsupported_source" and got["https://example.com/5"]["warnings"] == [M.WARNINGS["unsupported"]]
    assert got["https://www.linkedin.com/login"]["warnings"] == [M.WARNINGS["login"], M.MANUAL]
    assert got["https://lever.co/a"]["warnings"] == [M.WARNINGS["blocked"], M.MANUAL]
    assert (got["https://lever.co/b"]["description_text"], got["https://lever.co/b"]["confidence"]) == ("", 0.0)
    assert got["https://lever.co/b"]["warnings"] == [M.WARNINGS["description"], M.MANUAL]
    assert got["https://lever.co/c"]["warnings"] == [M.WARNINGS["title"], M.WARNINGS["company"], M.WARNINGS["description"], M.MANUAL]


def test_job_url(spark):
    urls = [
        ("https://www.linkedin.com/jobs/search?currentJobId=12&x=1", "https://www.linkedin.com/jobs/view/12"), ("https://www.linkedin.com/jobs/search?currentJobId=a", None), ("https://notlinkedin.com/?currentJobId=1", None),
        ("no url", None), (None, None),
    ]
    got = spark.createDataFrame(urls, "u string, w string").select("u", "w", pages.job_url(F.col("u")).alias("g")).collect()
    assert all(r["g"] == (r["w"] or r["u"]) for r in got)
