import pytest

from harrow.llm import markup, plain_text as P

MARKED = [
    "CO<sub>2</sub> rose", "a <B>broken tag", "<p class='x'>One</p>", "ends with <i", "text <br />", "<jats:p>x</jats:p>", "<!-- note --> x",
    "5 &plusmn; 2", "A &amp; B", "x&nbsp;y", "&#8805;5 ha", "&#x3b1;", "**bold** word", "a *word* here", "_57%_ of", "# Heading", "Aim\n====\n\nText",
    "see [it](https://a.example/x)", "![map](fig.png)", "```\ncode\n```", "use `x` here", "| a | b |\n|---|---|\n| 1 | 2 |", "> quoted words",
    "== Setting ==", "'''Summary''' here", "''it'' is", "[[plant:maize]] grows", "{{cite|no=3}}", "{| class=\"t\"\n| a\n|}",
    r"\begin{itemize}", r"68\% of", r"A \& B", r"{\em x} y", r"\textit{x}", r"$\alpha=0.4$", r"the term \(x_{2}\) was", r"\[ q = 3 \]", r"x \cite{ref2}",
]
PLAIN = [
    "P < 0.05 and n > 8", "stones >9 mm and <2 mm", "ground (<10 mm)", "A&B type", "R&D at Venn & Sons", "from $20 to $23 a bag", "cost $ 8 per bag", "Sieve #9",
    "(#13)", "under 21 * 4 spacing", "a 9*9*9 layout", "35.0** and 38.1* differ", "set = 9 | 8 | 7", "17.6^2 kg and ~7 g", "lines Venn_15 and Olsen_3_b", "filter_7",
    "[In Russian]", "[Whole title [In German]]", "gain = loss", "", "plain words", "n\n> 159 farms", "a 3\n* 9 factorial",
]


@pytest.mark.parametrize("text", MARKED)
def test_markup_is_found(text):
    assert markup.find(text)


@pytest.mark.parametrize("text", PLAIN)
def test_signs_are_no_markup(text):
    assert markup.find(text) == []
    assert P.clean(text) == (text, [])


def test_structure_stays():
    assert P.clean("<h3>Aim</h3><p>Text &lt;5</p><ul><li>one</li><li>two</li></ul>")[0] == "# Aim\n\nText <5\n\n- one\n- two"
    assert P.clean("<pre>a  b\n c</pre><p>and <code>x</code> with <math>y=2</math></p>")[0] == "```\na  b\n c\n```\n\nand `x` with $y=2$"
    assert P.clean("== Site ==\nWet.\n* one\n* two")[0] == "# Site\nWet.\n- one\n- two"
    assert P.clean(r"\section{Aim} the \emph{mean} was $x^2 + 1$ \cite{a}")[0].split("\n")[0] == "# Aim"
    assert "$x^2 + 1$" in P.clean(r"\emph{mean} was $x^2 + 1$ \cite{a}")[0]
    assert P.clean("Aim\n===\n\n**Bold** [link](https://a.example) `code`")[0] == "# Aim\n\nBold link `code`"
    assert P.clean("{| class=x\n! a !! b\n|-\n| 1 || 2\n|}")[0] == "| a | b |\n| 1 | 2 |"


def test_content_is_chosen_by_density():
    links = "".join(f"<li><a href='/x{k}'>go {k}</a></li>" for k in range(40))
    body = "".join(f"<p>{'A long sentence about soils and plots. ' * 6}</p>" for _ in range(5))
    page = f"<html><body><div><ul>{links}</ul></div><div><h1>Soils</h1>{body}</div><div><a href='/a'>imprint</a></div></body></html>"
    text, kinds = P.clean(page)
    assert "# Soils" in text and text.count("A long sentence") == 30
    assert "go 3" not in text and "imprint" not in text


def test_defined_cases(spark):
    rows = [(1, None, "<i>x</i>"), (2, "", " "), (3, "**a** b", "plain"), (4, "x <i>" + "y" * 100_000, None), (3, "**a** b", "plain"), (5, "<p></p>", "P < 0.1")]
    df = spark.createDataFrame(rows, "id bigint, title string, abstract string").selectExpr("*", "1 as field", "2 as text", "3 as kinds")
    got = sorted((r["id"], r["field"]) for r in P.cleaned(df).collect())
    assert got == [(1, "abstract"), (3, "title"), (3, "title"), (4, "title"), (5, "title")]
    assert P.cleaned(df.where("id > 9")).count() == 0


def test_deep_trees_dont_overflow():
    assert P.clean("<div>" * 5000 + "x" + "</div>" * 5000)[0] == "x"


LONG = "The yields of maize rose in all of the plots that had been mulched, and farmers said so. " * 6


def test_blocks_go_for_their_density():
    page = f"<html><body><div><p>{LONG}</p><p>{LONG}</p></div><div>Copyright 2020 Some Press. Subscribe to our newsletter</div></body></html>"
    assert "Copyright" not in P.clean(page)[0] and P.boilerplate(page) == ["Copyright 2020 Some Press. Subscribe to our newsletter"]
    links = "<body><p>One short paragraph of text.</p><ul>" + "".join(f"<li><a href='x{k}'>link number {k}</a></li>" for k in range(30)) + "</ul></body>"
    assert P.clean(links)[0] == "One short paragraph of text." and len(P.boilerplate(links)) == 1
    # short blocks of text inside the content stay
    article = f"<p>Two <i>kinds</i> of soil.</p><p>{LONG}</p><ul><li>one</li><li>two</li></ul><h2>End</h2><p>x</p>"
    assert P.boilerplate(article) == [] and P.clean(article)[0].endswith("- one\n- two\n\n# End\n\nx")


def test_nesting_has_no_bound():
    for depth in (10, 500):
        assert P.clean("\\textbf{" * depth + "deep" + "}" * depth + " text")[0] == "deep text"
        assert P.clean("a {{x|" + "{{y|" * depth + "}}" * depth + "}} b ''it''")[0] == "a  b it"
    assert P.clean(r"\emph{a {b} c} and \{d\}")[0] == "a {b} c and {d}"


def test_dropped_blocks_as_rows(spark):
    page = f"<div><p>{LONG}</p><p>{LONG}</p></div><div>Copyright and so on</div>"
    df = spark.createDataFrame([(1, page, None), (2, "a < b", "<i>x</i>")], "id bigint, title string, abstract string").selectExpr("*", "1 as block", "2 as field")
    assert [tuple(r) for r in P.dropped(df).collect()] == [(1, "title", "Copyright and so on")]
    assert P.dropped(df.where("id > 9")).count() == 0
