"""Posting analysis: lines and sections, prioritised contexts, dictionary tags, requirement bullets, seniority and flags."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions import text
from evidentia.operators import catalogs
from evidentia.operators.markup import let

#: Fixed value: how a posting states years of experience.
EXPERIENCE = r"(?i)\b(\d{1,2})\s*(?:-\s*(\d{1,2})|(\+))?\s*(?:years?|yrs?)(?:\s+of)?\s+experience\b"
#: Letters outside ASCII that a search in any case takes for ASCII ones.
FOLDED = ("\u017f\u0131\u0130\u212a", "siik")
EDUCATION_WORDS = ("degree", "bachelor", "master")


def tags(body: Column, catalog: dict) -> Column:
    """Canonical names whose variants the text holds as whole words, in catalog order; a variant that it doesn't hold at all is not looked for as a word."""
    folded = F.lower(F.translate(body, *FOLDED))

    def named(low: Column) -> Column:
        hits = {name: reduce(lambda a, b: a | b, (F.contains(low, F.lit(v)) & text.contains_word(body, v) for v in variants)) for name, variants in catalog.items()}
        return F.array_compact(F.array(*(F.when(hit, F.lit(name)) for name, hit in hits.items())))

    return let(folded, named)


def lines(df: DataFrame, key: str, body: str) -> DataFrame:
    """(key, line_no, raw, line, section) of the non-empty lines; a heading line opens a section and is no line itself."""
    parts = df.select(key, F.posexplode(F.split(F.col(body), r"\r\n|\r|\n")).alias("line_no", "raw"))
    parts = parts.withColumn("line", text.clean_line(F.col("raw"))).filter("line != ''")
    headings = F.create_map(*(F.lit(x) for pair in catalogs.SECTION_HEADINGS.items() for x in pair))
    opened = F.element_at(headings, F.regexp_replace(F.lower("line"), r":+$", ""))
    order = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = parts.withColumn("_opened", opened).withColumn("section", F.last("_opened", ignorenulls=True).over(order))
    return placed.filter("_opened is null").drop("_opened")


def is_preferred(line: Column) -> Column:
    low = F.lower(line)
    out = F.lit(False)
    for marker in catalogs.PREFERRED_MARKERS:
        out = out | F.contains(low, F.lit(marker))
    return out


def contexts(df: DataFrame, key: str, body: str) -> DataFrame:
    """(key, line_no, part_no, context, priority): sentences of lines; a line is judged before it is cut."""
    rows = lines(df, key, body)
    preferred = F.coalesce(F.col("section") == "preferred", F.lit(False)) | is_preferred(F.col("line"))
    rows = rows.withColumn("priority", F.when(preferred, "preferred").otherwise("required"))
    return rows.select(key, "line_no", F.posexplode(text.sentences(F.col("line"))).alias("part_no", "context"), "priority")


def classified(rows: DataFrame, key: str, catalog: dict) -> DataFrame:
    """(key, term, priority): preferred only if every context that names the term is preferred."""
    named = rows.select(key, "priority", F.explode(tags(F.col("context"), catalog)).alias("term"))
    out = named.groupBy(key, "term").agg(F.bool_and(F.col("priority") == "preferred").alias("_all"))
    return out.select(key, "term", F.when(F.col("_all"), "preferred").otherwise("required").alias("priority"))


def alternatives(context: Column) -> tuple[Column, Column]:
    """(kind, alternatives) of the first group of alternatives that a context with "or" names; null kind without one."""
    low = text.casefold(context)
    about_education = F.contains(low, F.lit("degree")) | F.contains(low, F.lit("field")) | F.contains(low, F.lit("computer science"))
    has_or = context.rlike(r"(?i)\bor\b")
    options = (("education", tags(context, catalogs.EDUCATION), about_education), ("technology", tags(context, catalogs.TECHNOLOGIES), F.lit(True)), ("skill", tags(context, catalogs.SKILLS), F.lit(True)))
    kind, found = F.lit(None).cast("string"), F.array().cast("array<string>")
    for name, values, allowed in reversed(options):
        hit = has_or & allowed & (F.size(values) >= 2)
        kind, found = F.when(hit, F.lit(name)).otherwise(kind), F.when(hit, values).otherwise(found)
    return kind, found


def or_groups(rows: DataFrame, key: str) -> DataFrame:
    """(key, line_no, part_no, kind, alternatives): education alone, or technology and skill groups both."""
    low, ctx = text.casefold(F.col("context")), F.col("context")
    education = F.when(F.contains(low, F.lit("degree")) | F.contains(low, F.lit("field")) | F.contains(low, F.lit("computer science")), tags(ctx, catalogs.EDUCATION)).otherwise(F.array().cast("array<string>"))
    by_education = F.size(education) >= 2
    none = F.array().cast("array<string>")
    groups = F.array(
        F.struct(F.lit("education").alias("kind"), education.alias("alternatives")),
        F.struct(F.lit("technology").alias("kind"), F.when(by_education, none).otherwise(tags(ctx, catalogs.TECHNOLOGIES)).alias("alternatives")),
        F.struct(F.lit("skill").alias("kind"), F.when(by_education, none).otherwise(tags(ctx, catalogs.SKILLS)).alias("alternatives")),
    )
    found = rows.filter(ctx.rlike(r"(?i)\bor\b")).select(key, "line_no", "part_no", "priority", F.explode(F.filter(groups, lambda g: F.size(g["alternatives"]) >= 2)).alias("g"))
    return found.select(key, "line_no", "part_no", "priority", "g.kind", "g.alternatives")


def bullets(df: DataFrame, key: str, body: str) -> DataFrame:
    """(key, line_no, requirement, kind, priority, logic, alternatives) of bullet lines under requirement headings."""
    rows = lines(df, key, body).filter(F.col("section").isin("qualifications", "preferred") & F.col("raw").rlike(text.BULLET_LINE))
    kind, found = alternatives(F.col("line"))
    rows = rows.withColumns({"_kind": kind, "alternatives": found})
    low = text.casefold(F.col("line"))
    plain = F.when(low.rlike("degree|bachelor|master"), "education").when(low.rlike(r"\b\d+\s*(?:-|–|\+|to)\s*\d*\s*years?\b"), "experience")
    plain = plain.when(F.size(tags(F.col("line"), catalogs.TECHNOLOGIES)) > 0, "technology").otherwise("skill")
    return rows.select(
        key, "line_no", F.col("line").alias("requirement"), F.coalesce("_kind", plain).alias("kind"),
        F.when(F.col("section") == "preferred", "preferred").otherwise("required").alias("priority"),
        F.when(F.col("_kind").isNotNull(), "any").otherwise("all").alias("logic"), "alternatives",
    )


def experience_bounds(body: Column) -> tuple[Column, Column]:
    """(least, most) years from the first phrase "N years of experience"; "N+" has no upper bound, a bare N is both."""
    low, high, plus = (F.regexp_extract(body, EXPERIENCE, i) for i in (1, 2, 3))
    least = F.when(low != "", low.cast("int"))
    return least, F.when(high != "", high.cast("int")).when((low != "") & (plus == ""), low.cast("int"))


def seniority(title: Column, body: Column, least_years: Column) -> Column:
    low = F.lower(title)
    by_years = F.when(least_years >= 8, "senior").when(least_years >= 3, "mid_level").when(least_years.isNotNull(), "junior")
    out = F.coalesce(by_years, F.when(body.rlike(r"(?i)\bmid[- ]level\b"), "mid_level"), F.lit("unknown"))
    for marker, level in reversed(catalogs.SENIORITY_BY_TITLE):
        out = F.when(F.contains(low, F.lit(marker)), F.lit(level)).otherwise(out)
    return out


def workplace(body: Column) -> Column:
    low = F.lower(body)
    return F.when(F.contains(low, F.lit("hybrid")), "hybrid").when(F.contains(low, F.lit("remote")), "remote").when(low.rlike("on-site|onsite|in office"), "onsite")


def red_flags(title: Column, body: Column, least_years: Column) -> Column:
    low = F.lower(body)
    found = [F.when(F.contains(low, F.lit(p)), F.lit(m)) for p, m in catalogs.RED_FLAGS.items()]
    junior = title.rlike(r"(?i)\b(?:intern|junior|entry[- ]level)\b")
    found.append(F.when(junior & (least_years >= 5), F.lit(catalogs.UNREALISTIC)))
    return F.array_distinct(F.filter(F.array(*found), lambda x: x.isNotNull()))


def missing_information(fields: dict[str, Column]) -> Column:
    """Names of the fields whose condition "is there" does not hold, in order."""
    return F.filter(F.array(*(F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in fields.items())), lambda x: x.isNotNull())
