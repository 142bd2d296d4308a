"""Structure and staffing rules of work instructions: facts to findings to verdicts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.lexicons import (
    APPENDIX_BARE, APPENDIX_LABELLED, APPENDIX_REFERENCE, REQUIRED_MODULES, STAFFING_NUMBER, STAFFING_PATTERNS, TOC_ENTRY, TOC_TITLES,
)
from tidemark.operators import folds

TITLE_MAX, NUMBERED_SHARE = 40, 0.6


def structure_findings(chunks: DataFrame) -> DataFrame:
    """(doc_id, rule_id, severity, description) of the module, numbering and title rules."""
    heads = chunks.where("chunk_type = 'heading'")
    titles = heads.groupBy("doc_id").agg(F.array_join(F.collect_list("title"), " ").alias("blob"))
    docs = chunks.select("doc_id").distinct().join(titles, "doc_id", "left").withColumn("blob", F.coalesce("blob", F.lit("")))
    missing = F.array_compact(F.array(*[F.when(~tx.any_of(F.col("blob"), words), F.lit(name)) for name, words in REQUIRED_MODULES.items()]))
    modules = docs.select("doc_id", F.explode(missing).alias("name")).select("doc_id", F.lit("C1.module").alias("rule_id"), F.lit("medium").alias("severity"), F.concat(F.lit("missing module "), "name").alias("description"))
    none = docs.where("blob = ''").select("doc_id", F.lit("C1.hierarchy").alias("rule_id"), F.lit("high").alias("severity"), F.lit("no headings").alias("description"))
    numbered = F.avg((F.col("title").rlike(r"(?U)^\s*(\d+)([.．、]\s*\d+){1,4}\s") | (F.col("section_path") != "")).cast("double"))
    deep = heads.where(F.size(F.split("section_path", r"\.")) >= 2).groupBy("doc_id").agg(numbered.alias("share")).where(F.col("share") < NUMBERED_SHARE)
    deep = deep.select("doc_id", F.lit("C1.hierarchy").alias("rule_id"), F.lit("medium").alias("severity"), F.lit("few headings are numbered").alias("description"))
    sizes = heads.groupBy("doc_id").agg(F.min_by("title", F.when(F.length("title") > TITLE_MAX, F.col("pos"))).alias("long"), F.count_if(F.length("title") == 1).alias("short"))
    long = sizes.where(F.length("long") > TITLE_MAX).select("doc_id", F.lit("C1.title").alias("rule_id"), F.lit("low").alias("severity"), F.concat(F.lit("long title: "), F.substring("long", 1, TITLE_MAX)).alias("description"))
    short = sizes.where("short > 0").select("doc_id", F.lit("C1.title").alias("rule_id"), F.lit("low").alias("severity"), F.lit("title of one character").alias("description"))
    return reduce(lambda a, b: a.unionByName(b), [modules, none, deep, long, short])


def _finding(rule: str, severity: str, description: Column, is_problem: bool = True) -> list[Column]:
    return [F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity"), description.alias("description"), F.lit(is_problem).alias("is_problem")]


def appendix_sections(chunks: DataFrame) -> DataFrame:
    """(doc_id, pos, label, title, has_content): the appendix headings.

    One has content where a text or table row of more than 20 characters comes before the next of them.
    """
    title = tx.strip_emphasis(F.coalesce("title", F.lit("")))
    labelled = F.regexp_extract(title, "(?U)" + APPENDIX_LABELLED, 1)
    opens = (F.col("chunk_type") == "heading") & ((labelled != "") | title.rlike("(?U)" + APPENDIX_BARE))
    filled = F.col("chunk_type").isin("text", "table_summary", "table_full") & (F.length(F.trim(F.coalesce("content", F.lit("")))) > 20)
    rows = chunks.select("doc_id", "pos", title.alias("title"), F.upper(labelled).alias("label"), F.coalesce(opens, F.lit(False)).alias("opens"), filled.alias("filled"))
    running = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = rows.withColumn("part", F.sum(F.col("opens").cast("int")).over(running)).where("part > 0")
    return parts.groupBy("doc_id", "part").agg(
        *[F.max_by(c, F.col("opens")).alias(c) for c in ("pos", "label", "title")], F.bool_or(F.col("filled") & ~F.col("opens")).alias("has_content")
    ).select("doc_id", "pos", "label", "title", F.coalesce("has_content", F.lit(False)).alias("has_content"))


def appendix_references(chunks: DataFrame) -> DataFrame:
    """(doc_id, pos, label): references to appendices from outside of them; the label may be empty."""
    body = chunks.where(~F.coalesce(F.col("section_path").startswith("APP_"), F.lit(False)))
    found = F.regexp_extract_all(F.coalesce("content", F.lit("")), F.lit("(?U)" + APPENDIX_REFERENCE), F.lit(1))
    return body.select("doc_id", "pos", F.explode(found).alias("label")).withColumn("label", F.upper(F.trim("label")))


def toc_entries(chunks: DataFrame) -> DataFrame:
    """(doc_id, pos, line, title) of the lines of tables of contents, dots and page left out."""
    toc = chunks.where((F.col("chunk_type") == "toc") | tx.strip_emphasis(F.coalesce("title", F.lit(""))).isin(*TOC_TITLES))
    lines = toc.select("doc_id", "pos", F.posexplode(F.split("content", r"\r\n|\n|\r")).alias("line", "text")).withColumn("text", F.trim("text"))
    entry = F.regexp_extract("text", TOC_ENTRY, 1)
    titles = lines.withColumn("title", F.when(F.col("text").rlike(TOC_ENTRY), F.trim(entry)).otherwise(F.col("text")))
    return titles.where(F.length("title") >= 2).select("doc_id", "pos", "line", "title")


def appendix_findings(chunks: DataFrame) -> DataFrame:
    """(doc_id, rule_id, severity, description, is_problem) of the rules on appendices and the table of contents."""
    docs, sections, refs = chunks.select("doc_id").distinct(), appendix_sections(chunks), appendix_references(chunks)
    have = sections.groupBy("doc_id").agg(
        F.array_agg("label").alias("labels"), F.bool_or(F.col("label") == "").alias("bare"),
        F.array_sort(F.collect_list(F.when((F.length("label") == 1) & F.col("label").rlike(r"^[\p{L}]$"), F.col("label")))).alias("letters"))
    cited = refs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    lost = cited.join(have, "doc_id", "left_anti").select(
        "doc_id", *_finding("C1.key_appendix", "high", F.format_string("%d references to appendices, but no appendix", "n")))
    named = refs.where("label != ''").select("doc_id", "label").distinct().join(have, "doc_id")
    absent = named.where(~F.array_contains("labels", F.col("label")) & ~(F.col("bare") & F.col("label").rlike("^[0-9]+$"))).select(
        "doc_id", *_finding("C1.key_appendix", "medium", F.concat(F.lit("no appendix "), "label")))
    empty = sections.where("not has_content").select("doc_id", *_finding("C1.appendix_content", "medium", F.concat(F.lit("appendix without content: "), "title")))
    none = docs.join(have, "doc_id", "left_anti").select("doc_id", *_finding("C1.appendix_continuity", "low", F.lit("no appendix"), is_problem=False))
    step = F.exists(F.sequence(F.lit(0), F.size("letters") - 1), lambda i: F.ascii(F.get("letters", i)) != F.ascii(F.get("letters", F.lit(0))) + i)
    jumps = have.where(F.size("letters") >= 2).where(step).select(
        "doc_id", *_finding("C1.appendix_continuity", "low", F.concat(F.lit("appendices not in sequence: "), F.array_join("letters", ","))))
    heads = chunks.where("chunk_type = 'heading'").select("doc_id", tx.strip_emphasis(F.coalesce("title", "content", F.lit(""))).alias("title"))
    astray = toc_entries(chunks).join(heads, ["doc_id", "title"], "left_anti").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "line", "title"))).alias("t"))
    samples = F.array_join(F.transform(F.slice("t", 1, 3), lambda x: x["title"]), ", ")
    toc = astray.select("doc_id", *_finding("C1.toc_mismatch", "medium", F.concat(F.size("t").cast("string"), F.lit(" entries without heading: "), samples)))
    return reduce(lambda a, b: a.unionByName(b), [lost, absent, empty, none, jumps, toc])


def toc_page_findings(entries: DataFrame, pages: DataFrame) -> DataFrame:
    """Entries (doc_id, title, page) of a table of contents beyond the document's last page (doc_id, n_pages).

    The first five in the order of the entries (`pos`, or page and title where there is none) are cited, the rest
    counted in one more finding.
    """
    order = ["pos"] if "pos" in entries.columns else ["page", "title"]
    beyond = entries.join(pages, "doc_id").where("page > n_pages").withColumn("_rn", F.row_number().over(Window.partitionBy("doc_id").orderBy(*order)))
    cited = beyond.where("_rn <= 5").select("doc_id", *_finding("C1.toc_page", "medium", F.format_string("%s: page %d of %d", "title", "page", "n_pages")))
    more = beyond.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 5").select("doc_id", *_finding("C1.toc_page", "low", F.format_string("%d more entries", F.col("n") - 5)))
    return cited.unionByName(more)


def structure_results(chunks: DataFrame) -> DataFrame:
    """One verdict for each document by the structure rules.

    Rows without contents (headings alone) are judged by the rules on headings; those on appendices and
    the table of contents need the content column.
    """
    found = structure_findings(chunks).select("doc_id", "severity")
    if "content" in chunks.columns:
        found = found.unionByName(appendix_findings(chunks).select("doc_id", "severity"))
    rows = chunks.select("doc_id").distinct().join(found, "doc_id", "left")
    return folds.severity_counts(rows, ["doc_id"]).select("*", *folds.structure_verdict())


def toc_tree(headings: DataFrame) -> DataFrame:
    """(doc_id, outline): the headings in order, indented by their level; a level missing comes from the dots of the path."""
    level = F.coalesce("heading_level", heading_level(F.col("section_path")))
    line = F.concat(F.expr("repeat('  ', greatest(_level - 1, 0))"), "title")
    rows = headings.withColumn("_level", level)
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))), lambda x: x["line"]), "\n").alias("outline"))


def heading_level(path: Column) -> Column:
    """The level of a section by the dots of its path; 1 without a path."""
    return F.when(F.coalesce(path, F.lit("")) == "", 1).otherwise(F.length(path) - F.length(F.replace(path, F.lit("."), F.lit(""))) + 1)


def staffing_facts(text: Column) -> list[Column]:
    """The staffing numbers in a text, each by the first pattern that matches; null without one."""
    out = []
    for field, patterns in STAFFING_PATTERNS.items():
        found = [F.nullif(F.regexp_extract(text, "(?U)" + p.replace("{n}", STAFFING_NUMBER), 1), F.lit("")) for p in patterns]
        out.append(F.coalesce(*found).cast("double" if field.endswith("_km") else "int").alias(field))
    gas, oil = text.contains("天然气"), text.contains("成品油") | text.contains("输油")
    return [*out, F.array_compact(F.array(F.when(gas, F.lit("natural_gas")), F.when(oil, F.lit("oil")))).alias("pipeline_kinds")]


def enough_facts() -> Column:
    """Whether the facts of a row suffice for the formulas: a length, and the patrol workers."""
    return (F.coalesce("pipeline_length_km", F.lit(0.0)) > 0) & F.col("patrol_workers_actual").isNotNull()


def merge_facts(first: DataFrame, second: DataFrame, key: str = "doc_id") -> DataFrame:
    """Facts of the first source, with those of the second where they are null, zero or empty."""
    b = second.select(key, F.struct(*[c for c in second.columns if c != key]).alias("_b"))
    columns = []
    for name, kind in first.dtypes:
        if name == key:
            continue
        if name not in second.columns:
            columns.append(F.col(name))
            continue
        empty = F.size(name) == 0 if kind.startswith("array") else F.col(name) == F.lit("" if kind == "string" else 0)
        columns.append(F.when(F.coalesce(empty, F.lit(True)), F.col(f"_b.{name}")).otherwise(F.col(name)).alias(name))
    return first.join(b, key, "left").select(key, *columns)


def staffing_rules(facts: DataFrame, oil_km: int = 20, gas_km: int = 30) -> DataFrame:
    """(doc_id, rule_id, required, actual, passed, severity) of the rules whose facts are there."""
    km, per = F.col("pipeline_length_km"), F.col("pipeline_length_km") / F.nullif(F.col("patrol_workers_actual"), F.lit(0))
    gas = F.array_contains("pipeline_kinds", "natural_gas")
    oil = F.array_contains("pipeline_kinds", "oil") & ~gas
    supervisors = F.when(gas, F.ceil(km / gas_km)).when(oil, F.ceil(km / oil_km))
    need = F.greatest(F.lit(1), F.ceil(km / 100))
    rule = lambda name, required, actual, passed, severity: F.struct(
        F.lit(name).alias("rule_id"), required.cast("double").alias("required"), actual.cast("double").alias("actual"), passed.alias("passed"), severity.alias("severity"))
    rules = F.array(
        F.when(km > 0, rule("E1_staffing.safety_engineer", need, F.col("safety_engineers_actual"), F.coalesce(F.col("safety_engineers_actual") >= need, F.lit(False)), F.lit("high"))),
        F.when((km > 0) & supervisors.isNotNull() & F.col("section_supervisors_actual").isNotNull(),
               rule("E1_staffing.section_supervisor", supervisors, F.col("section_supervisors_actual"), F.col("section_supervisors_actual") >= supervisors, F.lit("medium"))),
        F.when(per.isNotNull(), rule("E1_staffing.patrol_worker", F.ceil(km / 10), F.col("patrol_workers_actual"), per.between(3, 10), F.when(per > 10, "high").otherwise("low"))),
    )
    return facts.select("doc_id", F.explode(F.array_compact(rules)).alias("r")).select("doc_id", "r.*")


def staffing_results(facts: DataFrame) -> DataFrame:
    """(doc_id, verdict, score, confidence); uncertain without any rule."""
    rules = facts.select("doc_id").join(staffing_rules(facts), "doc_id", "left").groupBy("doc_id").agg(
        F.count("rule_id").alias("n"), F.count_if(~F.col("passed")).alias("failed"), F.count_if(~F.col("passed") & (F.col("severity") == "high")).alias("high"))
    ladder = folds.ladder([(F.col("n") == 0, ("uncertain", 0, 30)), (F.col("failed") == 0, ("pass", 14, 95)), (F.col("high") > 0, ("fail", 5, 80)), (F.lit(True), ("partial", 10, 75))])
    return rules.select("doc_id", *ladder)
