"""Parsers of free text about ideas, line by line, as Spark columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from .text import SPACE

Column = F.Column
BULLETS = ("-", "*", "•", "1.", "2.", "3.")  # fixed values: how a list's line begins
NO_ITEMS = "See experiment plan"
NO_TITLE = "Untitled Research Idea"


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _has(line: Column, words: tuple[str, ...]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower(line), w))


def _begins(line: Column, starts: tuple[str, ...]) -> Column:
    return F.exists(F.array(*map(F.lit, starts)), lambda w: F.startswith(line, w))


def _unnumbered(line: Column) -> Column:
    """Without a step's number at the beginning."""
    return F.regexp_replace(line, rf"^(?:\d|[.)-]|{SPACE})+", "")


def section(text: Column, words: tuple[str, ...], other: str | Column = "") -> Column:
    """The text below headings that have one of some words, up to the next heading of another kind; else ``other``.

    A heading has a colon or begins with ``#``; what follows its colon belongs to the section.  At most 1000 characters.
    """
    none = F.array().cast("array<string>")
    state = lambda on, ended, found: F.struct(on.alias("on"), ended.alias("ended"), found.alias("found"))

    def step(s: Column, line: Column) -> Column:
        bare = stripped(line)
        heading = _has(line, words) & (line.contains(":") | line.startswith("#"))
        rest = stripped(F.substring(line, F.instr(line, ":") + F.lit(1), F.length(line)))
        own = F.when(line.contains(":") & (rest != ""), F.array(rest)).otherwise(none)
        ends = line.startswith("#") | bare.endswith(":")
        grown = F.when(bare != "", F.array_append(s["found"], bare)).otherwise(s["found"])
        within = F.when(ends, state(s["on"], F.lit(True), s["found"])).otherwise(state(s["on"], s["ended"], grown))
        return F.when(s["ended"], s).when(heading, state(F.lit(True), s["ended"], F.concat(s["found"], own))).when(s["on"], within).otherwise(s)

    found = F.aggregate(_lines(text), state(F.lit(False), F.lit(False), none), step)["found"]
    return F.when(F.size(found) > 0, F.substring(F.array_join(found, " "), 1, 1000)).otherwise(other if isinstance(other, Column) else F.lit(other))


def list_items(text: Column, words: tuple[str, ...], reach: int = 10, most: int = 5) -> Column:
    """Items of lists that are within ``reach`` lines of one with some word, from each such line on, the first ``most``."""
    lines = _lines(text)
    item = lambda x: F.when(_begins(stripped(x), BULLETS), stripped(F.ltrim(stripped(x), F.lit("-*•0123456789. "))))
    items = F.transform(lines, lambda x: F.when((F.length(item(x)) > 0) & (F.length(item(x)) < 200), item(x)))
    near = F.filter(F.sequence(F.lit(1), F.size(lines)), lambda i: _has(F.get(lines, i - 1), words))
    found = F.array_compact(F.flatten(F.transform(near, lambda i: F.slice(items, i, F.lit(reach)))))
    return F.when(F.size(found) > 0, F.slice(found, 1, most)).otherwise(F.array(F.lit(NO_ITEMS)))


def papers_from_chain(text: Column, most: int = 5) -> Column:
    """Titles in a chain of ideas: what is quoted in lines that speak of papers or have a colon, else the line itself; the first ``most`` different ones."""
    lines = F.filter(F.transform(_lines(text), stripped), lambda x: F.contains(F.lower(x), F.lit("paper")) | x.contains(":"))

    def titles(line: Column) -> Column:
        quoted = F.regexp_extract_all(line, F.lit('"([^"]+)"'), F.lit(1))
        bare = _unnumbered(line)
        plain = (F.length(line) > 10) & (F.length(line) < 200) & (bare != "") & ~_begins(F.lower(bare), ("step", "idea", "then", "next"))
        return F.when(F.size(quoted) > 0, quoted).when(plain, F.array(bare)).otherwise(F.array().cast("array<string>"))

    return F.slice(F.array_distinct(F.flatten(F.transform(lines, titles))), 1, most)


def entity_names(text: Column, most: int = 10) -> Column:
    """Names in a list that newlines or, without any, commas or else semicolons separate: the first ``most`` different ones.  A text without these is one name."""
    mark = F.when(text.contains("\n"), "\n").when(text.contains(","), ",").when(text.contains(";"), ";")
    parts = F.transform(F.split(text, F.coalesce(mark, F.lit("\n"))), lambda x: stripped(F.btrim(stripped(x), F.lit("-*•"))))
    names = F.slice(F.array_distinct(F.filter(parts, lambda x: (x != "") & (F.length(x) < 100))), 1, most)
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).when(mark.isNull(), F.array(F.substring(text, 1, 100))).otherwise(names)


def title_from_idea(text: Column) -> Column:
    """A line that says it is the title, or a heading of the first or second level; else the first line that isn't too long."""
    lines = F.filter(F.transform(_lines(text), stripped), lambda x: x != "")
    named = lambda x: F.startswith(F.lower(x), F.lit("title:"))
    marked = F.filter(lines, lambda x: named(x) | _begins(x, ("# ", "## ")))
    first = F.get(marked, F.lit(0))
    title = stripped(F.when(named(first), F.substring(first, F.lit(7), F.length(first))).otherwise(F.ltrim(first, F.lit("#"))))
    short = F.get(F.filter(lines, lambda x: F.length(x) < 200), F.lit(0))
    return F.coalesce(title, F.substring(short, 1, 100), F.lit(NO_TITLE))


def chain_mermaid(text: Column, most: int = 5) -> Column:
    """A diagram of the first steps of a chain of ideas, from left to right."""
    labels = F.transform(F.filter(F.transform(_lines(text), stripped), lambda x: F.length(x) > 5), lambda x: F.substring(_unnumbered(x), 1, 40))
    steps = F.slice(F.filter(labels, lambda x: x != ""), 1, most)
    node = lambda x, i: F.concat(F.lit("  N"), i.cast("string"), F.lit('["'), F.translate(x, '"[]', "'()"), F.lit('"]'), F.when(i > 0, F.concat(F.lit("\n  N"), (i - 1).cast("string"), F.lit(" --> N"), i.cast("string"))).otherwise(""))
    return F.when(F.size(steps) > 0, F.concat(F.lit("graph LR\n"), F.array_join(F.transform(steps, node), "\n"))).otherwise("graph LR\n  A[CoI Generated Idea]")


#: Headings of a text made of an extraction, and the types of entities under them.
NOTE = "Note: The following content is derived from a structured extraction cache, not full paper text."
KINDS = (("Key methods/approaches:", ("Method", "Approach", "Framework")), ("Datasets/benchmarks:", ("Dataset", "Benchmark")), ("Metrics:", ("Metric",)))


def _is_of(kinds: tuple[str, ...]):
    return lambda entity: entity["type"].isin(*kinds)


def extraction_text(summary: Column, claims: Column, entities: Column, cited: Column) -> Column:
    """The text that stands for a paper of which only the extraction is known; parts without content are left out."""
    some = lambda x: F.coalesce(x, F.array())
    blank = lambda x: stripped(F.coalesce(x, F.lit("")))
    listed = lambda found: F.concat(F.lit("\n- "), F.array_join(found, "\n- "))
    names = lambda found: F.array_sort(F.array_distinct(F.filter(F.transform(found, blank), lambda x: x != "")))
    part = lambda head, found: F.when(F.size(found) > 0, F.concat(F.lit(head), listed(found)))
    of_kind = [part(head, names(F.transform(F.filter(entities, _is_of(kinds)), lambda e: e["name"]))) for head, kinds in KINDS]
    numbered = lambda c: F.when((blank(c["title"]) == "") & c["reference_number"].isNotNull(), F.concat(F.lit("Reference #"), c["reference_number"].cast("string"))).otherwise(blank(c["title"]))
    compared = part("Comparison baselines (from citations):", names(F.transform(F.filter(cited, lambda c: c["citation_type"] == "COMPARES"), numbered)))
    said = lambda e: F.concat(F.lit("- "), blank(e["name"]), F.lit(" ("), blank(e["type"]), F.lit(")"), F.when(blank(e["description"]) != "", F.concat(F.lit(": "), blank(e["description"]))).otherwise(""))
    whole = F.transform(F.filter(entities, lambda e: (blank(e["name"]) != "") & (blank(e["type"]) != "")), said)
    parts = [F.lit(NOTE), F.when(F.coalesce(summary, F.lit("")) != "", F.concat(F.lit("Paper summary:\n"), summary)), part("Claims:", some(claims)), *of_kind, compared, F.when(F.size(whole) > 0, F.concat(F.lit("Key entities:\n"), F.array_join(whole, "\n")))]
    return stripped(F.array_join(F.array_compact(F.array(*parts)), "\n\n"))


def related_experiments(value: Column) -> Column:
    """A JSON field that is a list, or a text of lines, as a list of texts; null is an empty list."""
    as_list = F.filter(F.from_json(value, "array<string>"), lambda x: x.isNotNull())
    text = F.coalesce(F.get(F.from_json(F.concat(F.lit("["), value, F.lit("]")), "array<string>"), F.lit(0)), value)
    lines = F.filter(F.transform(F.split(text, r"\r\n|\n|\r"), stripped), lambda x: x != "")
    return F.when(value.isNull() | (value == "null"), F.array().cast("array<string>")).when(value.startswith("["), as_list).otherwise(F.when(F.size(lines) > 0, lines).otherwise(F.array(text)))


def entities_text(value: Column) -> Column:
    """A JSON field that is a text or a list of texts as one text."""
    text = F.coalesce(F.get(F.from_json(F.concat(F.lit("["), value, F.lit("]")), "array<string>"), F.lit(0)), value)
    as_list = F.array_join(F.filter(F.from_json(value, "array<string>"), lambda x: x.isNotNull()), "\n")
    return F.when(value.isNull() | (value == "null"), "").when(value.startswith("["), as_list).otherwise(text)


def metadata_json(published: Column) -> Column:
    """What is kept of a download: its date in ISO form, or null."""
    return F.to_json(F.struct(F.date_format(published, "yyyy-MM-dd'T'HH:mm:ss").alias("published_date")), {"ignoreNullFields": "false"})
