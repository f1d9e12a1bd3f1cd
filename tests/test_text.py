"""Text functions against values worked out by hand."""

import pytest
from pyspark.sql import functions as F

from trailweave.functions import text as T


def values(spark, function, texts):
    df = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "k int, x string")
    return [r[0] for r in df.orderBy("k").select(function(F.col("x")).alias("y")).collect()]


def test_strip_latex(spark):
    cases = {
        "plain  text": "plain text",
        "% note\nkept % here": "kept % here",
        r"\textbf{Bold} and \emph{it}": "Bold and it",
        r"a\emph{b}c": "abc",
        r"\textbf{\emph{x}} y": "x y",
        r"see \cite[p. 3]{use}~now": "see use now",
        r"\newline its {own} \LaTeX": "its own",
        r"\newline\section*{S}": "S",
        r"\a\b{q}\c": "q",
        r"\section*{One} 50\% \& more": r"One 50\% \& more",
        r"\x[1] y": "y",
        "": "",
    }
    assert values(spark, T.strip_latex, cases) == list(cases.values())
    assert values(spark, T.strip_latex, [None]) == [None]


def test_numbered_references(spark):
    block = "before \\bibitem{z} no\\begin{thebibliography}{9}\n\\bibitem{a} One, \\emph{T}.\n\\bibitem[X]{b}\n Two.\n\\bibitem{c}\n \\bibitem{d} Four\\end{thebibliography} after"
    assert values(spark, T.numbered_references, [block, "\\bibitem{a} A\\bibitem{b} B", "none"]) == [["One, T.", "Two.", "Fourthebibliography"], ["A", "B"], []]
    ends = ["\\begin{thebibliography}\\bibitem{a} A\\bibitem{b} \n\\end{thebibliography}\\bibitem{c} C", "\\end{thebibliography}\\bibitem{a} A"]
    assert values(spark, T.numbered_references, ends) == [["A", "thebibliography"], ["A"]]
    assert values(spark, lambda x: T.numbered_references(x, 1), ["\\bibitem{a} A\\bibitem{b} B"]) == [["A"]]


def test_title_from_reference(spark):
    cases = {
        'A. Author. "A Great Title." arXiv 2020.': "A Great Title",
        "A. Author. “A Curly Title,” in Proc.": "A Curly Title,",
        "A. Author. ``A Ticked Title.'' 2019": "A Ticked Title",
        "B. Author. Another Great Title. arXiv:1234.5678.": "Another Great Title",
        "B. Author. Another Great Title. In Proceedings of X. 2020.": "Another Great Title",
        "C. Author. A Title by Year. 2019.": "A Title by Year",
        "C. Author. A Title by Year. 1850.": None,
        "Author. Word. 2019.": None,
        "Longsingleword. Otherword. 2019.": None,
        'short "abc" quotes': None,
        "": None,
    }
    assert values(spark, T.title_from_reference, cases) == list(cases.values())


@pytest.mark.parametrize(
    ("text", "said"),
    [(None, False), ("", False), ("A title", False), ("x" * 140, True), (" " * 300 + "A title", False), ("In Proceedings of", True), ("A, B, and C, 2020", True), ("A B 2020", False), ("A, B, 20201", False), ("a. b. c. d. 1999", True), (" " * 250 + "Journal of X", True)],
)
def test_looks_like_citation(spark, text, said):
    assert values(spark, T.looks_like_citation, [text]) == [said]


def test_normalize_title(spark):
    assert values(spark, T.normalize_title, ["  Test   Paper  ", "Cafe\u0301", "Caf\u00e9", None]) == ["test paper", "caf\u00e9", "caf\u00e9", None]
