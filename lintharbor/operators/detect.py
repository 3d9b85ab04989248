"""Rule scanning over text corpora.

A rule is a literal pattern in the plan, compiled once per task. Whole texts are tested first;
only texts with a hit are split into lines, so the explode is paid for a small part of a corpus.
There is no Python in the path, and no shuffle but that of the places of secrets.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lintharbor.functions.scale import join_per_project
from lintharbor.rules import (
    ALL_RULES, CODE_RULES, CONTROL_RULES, OWASP_CATEGORIES, REMEDIES, SECRET_RULES, Rule,
)
from lintharbor.schemas import FINDING_COLUMNS


def explode_lines(texts: DataFrame, text: str = "text") -> DataFrame:
    """(…, line, content): every line of every text, numbered from 1."""
    keep = [c for c in texts.columns if c != text]
    return texts.select(*keep, F.posexplode(F.split(text, "\n")).alias("pos", "content")).select(
        *keep, (F.col("pos") + 1).alias("line"), "content")


def _alternation(rules: list[Rule]) -> str:
    return "|".join(f"(?:{r.pattern})" for r in rules)


def _hit(text: Column, rule: Rule) -> Column:
    """The literal checks are byte searches; the pattern runs only where one succeeds."""
    matched = text.rlike(rule.pattern)
    if not rule.keywords:
        return matched
    return reduce(or_, [text.contains(k) for k in rule.keywords]) & matched


def _any_hit(text: Column, rules: list[Rule]) -> Column:
    return reduce(or_, [_hit(text, r) for r in rules])


def _rule_struct(rule: Rule) -> Column:
    return F.struct(F.lit(rule.rule_id).alias("rule_id"), F.lit(rule.title).alias("title"),
                    F.lit(rule.severity).alias("severity"), F.lit(rule.owasp).alias("owasp"),
                    F.lit(rule.family).alias("family"))


def _language_allows(rule: Rule) -> Column:
    return F.col("language").isin(*rule.languages)


def _located(rule: Rule) -> str:
    """The rule's core where its surroundings allow it, without taking them in: neighbours share separators."""
    before = "(?<![A-Za-z0-9_])" if rule.whole_word else ""
    after = f"(?![{rule.not_after}])" if rule.not_after else ""
    return f"{before}(?:{rule.core or rule.pattern}){after}"


def secret_matches(lines: DataFrame, rules: list[Rule]) -> DataFrame:
    """(_line, …, _rank, _start, _end): every match of every rule, by the position of its characters.

    A match begins behind the texts between the matches of its rule and those matches themselves, so
    the lengths of both, summed up, are its position. `lines` has `_line`, content and what is carried along.
    """
    carried = [c for c in lines.columns if c != "content"]
    content = F.col("content")

    def lengths(rank: int, rule: Rule) -> Column:
        # The text behind the last match has no partner.
        pairs = F.zip_with(F.split(content, _located(rule)), F.regexp_extract_all(content, F.lit(_located(rule)), F.lit(0)),
                           lambda gap, m: F.struct(F.length(gap).alias("gap"), F.length(m).alias("length")))
        return F.when(_hit(content, rule), F.transform(pairs, lambda x, k: F.struct(
            F.lit(rank).alias("_rank"), k.alias("_k"), x["gap"].alias("_gap"), x["length"].alias("_length"))))

    rows = lines.select(*carried, F.inline(F.flatten(F.array_compact(F.array(*[
        lengths(i, r) for i, r in enumerate(rules)]))))).filter("_length IS NOT NULL")
    upto = Window.partitionBy("_line", "_rank").orderBy("_k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("_gap") + F.col("_length")).over(upto)
    # All windows that follow are per line, so this is the only shuffle, and the texts do not take part in it.
    return rows.repartition("_line").select(*carried, "_rank", (end - F.col("_length")).alias("_start"), end.alias("_end"))


def without_overlaps(matches: DataFrame, generic: list[int], carried: list[str]) -> DataFrame:
    """Of matches that overlap, those a sweep over (start, longest, rank) meets first; specific rules before generic ones.

    Matches are cut into islands wherever one starts at or behind the end of all before it. Only
    within an island does the sweep have to look at what it kept.
    """
    order = ["_start", F.desc("_end"), "_rank"]
    reached = F.max("_end").over(Window.partitionBy("_line").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    apart = F.when(reached.isNull() | (F.col("_start") >= reached), 1).otherwise(0)
    islands = matches.withColumn("_apart", apart).withColumn(
        "_island", F.sum("_apart").over(Window.partitionBy("_line").orderBy(*order)))
    place = F.struct(F.col("_rank").isin(*generic).alias("generic"), F.col("_start").alias("start"),
                     (-F.col("_end")).alias("turn"), F.col("_rank").alias("rank"))
    swept = islands.groupBy("_line", "_island").agg(
        *[F.first(c).alias(c) for c in carried], F.sort_array(F.collect_list(place)).alias("_all"))
    free = F.aggregate(
        "_all", F.slice("_all", 1, 0),
        lambda kept, m: F.when(
            F.exists(kept, lambda x: (x["start"] < -m["turn"]) & (m["start"] < -x["turn"])), kept
        ).otherwise(F.concat(kept, F.array(m))))
    return swept.select("_line", *carried, F.inline(F.transform(free, lambda x: F.struct(
        x["rank"].alias("_rank"), x["start"].alias("_start")))))


def secret_detection(texts: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """Redacted secrets of (project, path, …, text), each with its `line`, `column` and place `nth` in the line.

    All columns but the text are carried along. Matches that overlap are one secret, reported by the
    specific rule before a generic one, else by the match that starts first, is longest, or whose rule
    comes first. Secrets beside each other are all reported.
    """
    chosen = SECRET_RULES if rules is None else rules
    keep = [c for c in texts.columns if c not in ("text", "line", "column", "nth")]
    lines = (
        explode_lines(texts.filter(_any_hit(F.col("text"), chosen)).select(*keep, "text"))
        .filter(_any_hit(F.col("content"), chosen))
        .select(F.monotonically_increasing_id().alias("_line"), "content",
                *[F.col(c).alias(f"_c{i}") for i, c in enumerate([*keep, "line"])]))
    # Columns are carried one by one, so that those nobody asks for are not even read.
    carried = [f"_c{i}" for i in range(len(keep) + 1)]
    found = without_overlaps(secret_matches(lines, chosen), [i for i, r in enumerate(chosen) if r.generic], carried)
    nth = F.row_number().over(Window.partitionBy("_line").orderBy("_start"))
    rule = F.element_at(F.array(*[_rule_struct(r) for r in chosen]), F.col("_rank") + 1)
    return (
        found.withColumns({"_nth": nth, "_rule": rule})
        .select(*[F.col(c).alias(n) for c, n in zip(carried, [*keep, "line"])], (F.col("_start") + 1).cast("int").alias("column"), F.col("_nth").alias("nth"),
                "_rule.rule_id", "_rule.title", "_rule.severity",
                F.lit("[REDACTED]").alias("code"),
                F.lit("Hardcoded secret detected").alias("description"))
    )


def as_findings(hits: DataFrame, tool: str, rules: list[Rule] | None = None) -> DataFrame:
    """Hits of `rules` that carry (project, scan_id, file_no) as findings of the common schema.

    `file_no` numbers the files of a scan (see `scale.dense_numbers`); with line and rule, or the place
    of a secret in its line, it gives each finding its `seq` without any sort. Room is for 2**24 files,
    2**28 lines per file and 2**10 rules or secrets a line; a hit beyond that, or of a rule that is not
    in the list, stops the run instead of sharing another's number.
    """
    known = ALL_RULES if rules is None else rules
    rule_no = F.array_position(F.array(*[F.lit(r.rule_id) for r in known]), F.col("rule_id"))
    # Files judged as a whole have no line.
    line = F.col("line") if "line" in hits.columns else F.lit(0)
    place = F.col("nth") if "nth" in hits.columns else rule_no
    fits = ((rule_no > 0) & place.between(1, 2**10 - 1) & line.between(0, 2**28 - 1)
            & F.col("file_no").between(0, 2**24 - 1))
    packed = (F.shiftleft(F.col("file_no").cast("bigint"), 38)
              + F.shiftleft(line.cast("bigint"), 10) + place)
    secret = tool == "Secret Scanner"
    absent = F.lit(None)
    values = {
        "project": F.col("project"), "scan_id": F.col("scan_id"),
        "seq": F.when(fits, packed).otherwise(F.raise_error(
            F.concat(F.lit("no number for a hit of rule "), F.coalesce("rule_id", F.lit("?"))))),
        "tool": F.lit(tool), "severity": F.col("severity"),
        "title": F.concat(F.lit("Exposed secret: "), "title") if secret else F.col("title"),
        "description": F.col("description") if secret else F.col("title"),
        "file": F.col("path"), "line": line,
        "column": F.col("column") if "column" in hits.columns else absent.cast("int"),
        "code": F.col("code") if "code" in hits.columns else F.lit(""),
        "fix": F.lit(dict(REMEDIES)["Hardcoded secrets"]) if secret else _remedy(F.col("family")),
        # Secrets are told apart by title, as in the reports of secret scanners.
        "rule_id": absent.cast("string") if secret else F.col("rule_id"),
        "cwe": absent.cast("array<string>"),
        "owasp": absent.cast("array<string>") if secret else F.array("owasp"),
        "references": absent.cast("array<string>"),
    }
    return hits.select(*[values[n].alias(n) for n in FINDING_COLUMNS])


def _remedy(family: Column) -> Column:
    chain = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, text in REMEDIES:
        chain = chain.when(family == name, text)
    return chain


def redacted(text: Column) -> Column:
    """Text with every secret cut out; lines shown as code may hold some."""
    clean = F.regexp_replace(text, _alternation(SECRET_RULES), " [REDACTED] ")
    return F.when(_any_hit(text, SECRET_RULES), clean).otherwise(text)


def vulnerable_pattern_scan(texts: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """Lines of (project, path, language, …, text) that show a vulnerable pattern of their language."""
    chosen = CODE_RULES if rules is None else rules
    known = sorted({lang for r in chosen for lang in r.languages})
    keep = [c for c in texts.columns if c != "text"]
    candidates = texts.filter(
        F.col("language").isin(*known) & _any_hit(F.col("text"), chosen))
    content = F.col("content")
    hits = F.array_compact(F.array(*[
        F.when(_language_allows(r) & _hit(content, r), _rule_struct(r)) for r in chosen]))
    return (
        explode_lines(candidates).filter(_any_hit(content, chosen))
        .select(*keep, "line", redacted(F.trim("content")).alias("code"), F.inline(hits))
    )


def missing_control_scan(texts: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """Files that need a control and do not contain it. Judged per file: a narrow step."""
    chosen = CONTROL_RULES if rules is None else rules
    text = F.col("text")
    hits = F.array_compact(F.array(*[
        F.when(_language_allows(r) & text.rlike(r.pattern) & ~text.rlike(r.guard), _rule_struct(r))
        for r in chosen]))
    return texts.select(*[c for c in texts.columns if c != "text"], F.inline(hits))


def remedy_table(spark: SparkSession) -> DataFrame:
    """Family, category and secure pattern per rule; its size is fixed by the rule list."""
    remedies = dict(REMEDIES)
    names = dict(OWASP_CATEGORIES)
    rows = F.array(*[F.struct(
        F.lit(r.rule_id).alias("rule_id"), F.lit(r.family).alias("family"),
        F.concat(F.lit(r.owasp), F.lit(":2021 - "), F.lit(names[r.owasp])).alias("owasp_category"),
        F.lit(remedies[r.family]).alias("secure_pattern")) for r in ALL_RULES])
    return spark.range(1).select(F.inline(rows))


def remediation_lookup(hits: DataFrame) -> DataFrame:
    """Attach family, category and secure pattern by rule id; unknown rules stay, unexplained.

    The rules are constants, so they are looked up in literal maps: no join.
    """
    remedies, names = dict(REMEDIES), dict(OWASP_CATEGORIES)

    def looked_up(values: list[str]) -> Column:
        pairs = [F.lit(x) for r, v in zip(ALL_RULES, values) for x in (r.rule_id, v)]
        return F.element_at(F.create_map(*pairs), F.col("rule_id"))

    return hits.drop("family", "owasp_category", "secure_pattern").select(
        "rule_id", *[c for c in hits.columns if c not in ("rule_id", "family", "owasp_category", "secure_pattern")],
        looked_up([r.family for r in ALL_RULES]).alias("family"),
        looked_up([f"{r.owasp}:2021 - {names[r.owasp]}" for r in ALL_RULES]).alias("owasp_category"),
        looked_up([remedies[r.family] for r in ALL_RULES]).alias("secure_pattern"))


def custom_rules(hits: DataFrame, overrides: DataFrame) -> DataFrame:
    """Per-project rule choice: overrides (project, rule_id, level) with level off, warn or error.

    A rule without an override keeps its severity.
    """
    level = F.lower("level")
    return (
        join_per_project(hits, overrides.select("project", "rule_id", "level"),
                         ["project", "rule_id"], "left", spread_by=["path", "line"])
        .filter(F.coalesce(level != "off", F.lit(True)))
        .withColumn("severity", F.when(level == "error", "high").when(level == "warn", "medium")
                    .otherwise(F.col("severity")))
        .drop("level")
    )


def owasp_rollup(findings: DataFrame) -> DataFrame:
    """Findings per project and category, all ten categories listed.

    The ten counters are folded in one aggregation and unfolded afterwards: one shuffle, no join.
    """
    ids = F.transform(
        F.coalesce("owasp", F.array().cast("array<string>")),
        # The 2021 edition, or no edition named; ids of other editions mean other categories.
        lambda o: F.regexp_extract(o, r"(A\d{2})(?::2021|(?!\s*:\s*\d{4}))", 1))
    counted = findings.select("project", ids.alias("ids")).groupBy("project").agg(*[
        F.count_if(F.array_contains("ids", c)).alias(c) for c, _ in OWASP_CATEGORIES])
    return counted.select("project", F.inline(F.array(*[
        F.struct(F.lit(c).alias("category"), F.lit(n).alias("category_name"),
                 F.col(c).alias("n_findings")) for c, n in OWASP_CATEGORIES])))
