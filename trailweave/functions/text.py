"""Scalar text functions as Spark columns, and the few that need Python."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

Column = F.Column
#: All code points that Python's str.split() takes for white space.
SPACE = r"(?U)[\s\x1c-\x1f]"


def squeezed(text: Column) -> Column:
    """Runs of white space as one space each, none at the ends."""
    return F.trim(F.regexp_replace(text, f"{SPACE}+", " "))


@F.pandas_udf(StringType())
def _nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def nfc(text: Column) -> Column:
    """Composed characters.  Spark has no such function; Python gets nulls in place of texts that are all ASCII, which are composed already."""
    return F.coalesce(_nfc(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)


def normalize_title(text: Column, compose: bool = True) -> Column:
    return squeezed(F.lower(nfc(text) if compose else text))


def short_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def paper_id(title: Column, compose: bool = True) -> Column:
    return short_hash(normalize_title(title, compose))


def entity_id(kind: Column, name: Column) -> Column:
    return short_hash(F.concat(F.lower(kind), F.lit(":"), F.lower(name)))


def title_match_key(text: Column) -> Column:
    return squeezed(F.regexp_replace(F.lower(text), r"(?U)[^\w\s]", " "))


def _after(text: Column, mark: str) -> Column:
    """What follows the first ``mark``; the whole text without one."""
    at = F.instr(text, F.lit(mark))
    return F.when(at > 0, F.substring(text, at + F.lit(len(mark)), F.length(text))).otherwise(text)


def _without_option(text: Column) -> Column:
    """Without an argument in square brackets at the beginning."""
    return F.when(text.startswith("[") & text.contains("]"), _after(text, "]")).otherwise(text)


def _without_command(piece: Column) -> Column:
    """What follows a backslash, less the command's name and options; an argument without further ones joins what is before it."""
    rest = _without_option(F.regexp_replace(piece, "^[A-Za-z]+[*]?", ""))
    argument = F.substring_index(_after(rest, "{"), "}", 1)
    simple = rest.startswith("{") & rest.contains("}") & ~argument.contains("{")
    bare = F.when(simple, F.concat(argument, _after(rest, "}"))).otherwise(F.concat(F.lit(" "), rest))
    return F.when(piece.rlike("^[A-Za-z]"), bare).otherwise(F.concat(F.lit("\\"), piece))


def strip_latex(text: Column) -> Column:
    """Lines of comment and commands out, contents of arguments kept, braces and ties as spaces.

    A command's argument is kept, too, where another command comes directly before it; rules that take commands out
    one kind after the other lose it there, as they read ``\\newline\\section{S}`` as one long name ``\\newlineS``.
    """
    lines = F.filter(F.split(text, "\n"), lambda x: ~x.startswith("%"))
    pieces = F.split(F.array_join(lines, "\n"), r"\\")
    first, others = F.element_at(pieces, 1), F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0)))
    return squeezed(F.translate(F.concat(first, F.array_join(F.transform(others, _without_command), "")), "{}~", "   "))


def numbered_references(latex: Column, most: int = 200) -> Column:
    """Entries of a bibliography in order, without empty ones, stripped of commands.

    The bibliography's closing mark belongs to its last entry, which so ends in ``thebibliography``, and is that alone
    if nothing else is there; without both marks, the whole text is taken.
    """
    begin, end = "\\begin{thebibliography}", "\\end{thebibliography}"
    inside = _after(latex, begin)
    block = F.when(latex.contains(begin) & inside.contains(end), F.concat(F.substring_index(inside, end, 1), F.lit(end))).otherwise(latex)
    parts = F.split(block, r"\\bibitem(?=[\[{])")
    entries = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: _after(_without_option(x), "}"))
    return F.transform(F.slice(F.filter(entries, lambda x: squeezed(x) != ""), 1, most), strip_latex)


#: How what follows a title in a reference begins, and words that tell a whole reference.
VENUES = ("arxiv", "arxiveprint", "preprint", "in ", "proceedings", "proc.", "journal", "transactions", "conference", "workshop", "neurips", "nips", "icml", "iclr", "acl", "emnlp", "naacl", "cvpr", "eccv", "iccv", "aaai", "ijcai", "www", "kdd", "sigir")
TELLING = ("arxiv", "proceedings", "journal", "doi")


def _any_of(words: tuple[str, ...], test) -> Column:
    return F.exists(F.array(*map(F.lit, words)), test)


def _is_year(word: Column) -> Column:
    return word.rlike(r"^\d{4}$") & word.between("1900", "2099")


def _words(text: Column) -> Column:
    return F.split(text, r"(?U)\W+")


def title_from_reference(entry: Column) -> Column:
    """The title in a reference's text: quoted, or the sentence before a venue, or that before a year; null if none is found."""
    text = squeezed(entry)
    first = lambda found: F.get(found, F.lit(0))
    long = lambda x: F.length(x) >= 8
    inner = lambda parts: F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    curly = F.transform(F.filter(inner(F.split(text, "”")), lambda x: x.contains("“")), lambda x: _after(x, "“"))
    plain = F.slice(inner(F.split(text, '"')), 2, F.length(text))
    before = F.transform(F.split(text, "``"), lambda x: F.substring_index(x, "`", 1))
    ticks = F.transform(F.filter(F.slice(before, 2, F.length(text)), lambda x: x.contains("''")), lambda x: F.array_join(inner(F.split(x, "''")), "''"))
    quoted = [F.trim(first(F.filter(x, long))) for x in (curly, plain, ticks)]
    sentences = F.split(text, r"\. ")
    pairs = F.zip_with(sentences, F.slice(sentences, 2, F.length(text)), lambda x, y: F.struct(x.alias("title"), y.alias("next")))
    pairs = F.filter(F.slice(pairs, 2, F.length(text)), lambda x: x["next"].isNotNull() & long(x["title"]) & ~x["title"].contains("."))
    by_venue = F.filter(pairs, lambda x: _any_of(VENUES, lambda v: F.startswith(F.lower(x["next"]), v)))
    by_year = F.filter(pairs, lambda x: _is_year(F.get(_words(x["next"]), F.lit(0))))
    named = [F.btrim(first(x)["title"], F.lit(" ,;:")) for x in (by_venue, by_year)]
    return F.coalesce(*(F.rtrim(q, F.lit(" .")) for q in quoted), *(F.when(F.size(F.split(x, " ")) >= 2, F.rtrim(x, F.lit(" ."))) for x in named))


def looks_like_citation(text: Column) -> Column:
    """Whether a title may be a whole reference: long, with a venue's word, or with a year and many marks."""
    t = squeezed(F.coalesce(text, F.lit("")))
    crowded = (F.regexp_count(t, F.lit(",")) >= 2) | (F.regexp_count(t, F.lit("[.]")) >= 4)
    return (F.length(t) >= 140) | _any_of(TELLING, lambda w: F.contains(F.lower(t), w)) | (crowded & F.exists(_words(t), _is_year))


def safe_id(text: Column) -> Column:
    return F.translate(text, "/:", "__")


def idea_id(number: Column, title: Column) -> Column:
    return F.concat(F.lit("idea_"), number.cast("string"), F.lit("_"), F.regexp_replace(F.substring(title, 1, 30), r"[^\p{L}\p{N}]", "_"))


#: Fixed value: characters that have a meaning in the diagram language.
_UNSAFE = "\"'[](){}|<>`:;\n\r\t"


def mermaid_removed(text: Column) -> Column:
    """How many characters ``mermaid_sanitize`` takes out or replaces."""
    return F.length(text) - F.length(F.regexp_replace(F.translate(text, _UNSAFE, ""), r"[\p{Cc}\p{Cf}]", ""))


def mermaid_sanitize(text: Column) -> Column:
    """Characters with a meaning as spaces, other control and format characters out."""
    return squeezed(F.regexp_replace(F.translate(text, _UNSAFE, " " * len(_UNSAFE)), r"[\p{Cc}\p{Cf}]", ""))


def truncate_label(text: Column, most: int) -> Column:
    if most <= 3:
        return F.substring(text, 1, most)
    return F.when(F.length(text) > most, F.concat(F.rtrim(F.substring(text, 1, most - 3)), F.lit("..."))).otherwise(text)


def escape_html(text: Column) -> Column:
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(mark), F.lit(name))
    return text


def split_ids(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def fixed1(number: Column) -> Column:
    """One decimal, half to even on the exact value."""
    return F.replace(F.format_number(number, 1), F.lit(","), F.lit(""))


def python_float(name: str) -> Column:
    """A number as Python prints it, for the sizes that scores have."""
    return F.col(name).cast("double").cast("string")


def relation_type(text: Column) -> Column:
    """A relationship's type in upper case, or null if it isn't a name."""
    upper = F.upper(F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", ""))
    return F.when(upper.rlike(r"^[A-Z][A-Z0-9_]*\z"), upper)


def published_day(text: Column) -> Column:
    """A timestamp without a zone from ISO text; an offset is dropped, not applied."""
    return F.try_to_timestamp(F.regexp_replace(text, r"(Z|[+-]\d{2}:?\d{2})$", "")).cast("timestamp_ntz")


def unique_sorted(texts: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.transform(texts, squeezed), lambda x: x != "")))


def path_mermaid(names: Column, most: int = 30) -> Column:
    """A chain of labels as a diagram, from right to left; a longer label is cut at ``most`` and marked."""
    label = lambda x: F.when(F.length(x) > most, F.concat(F.substring(x, 1, most), F.lit("..."))).otherwise(x)
    node = lambda x, i: F.concat(F.lit("\n  N"), i.cast("string"), F.lit("["), label(x), F.lit("]"))
    arrow = lambda i: F.when(i > 0, F.concat(F.lit("\n  N"), (i - 1).cast("string"), F.lit(" --> N"), i.cast("string"))).otherwise("")
    lines = F.array_join(F.transform(names, lambda x, i: F.concat(node(x, i), arrow(i))), "")
    return F.concat(F.lit("graph RL"), F.when(F.size(names) > 0, lines).otherwise("\n  A[No path]"))
