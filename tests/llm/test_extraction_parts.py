"""What an article may hold, and what stands beside it without saying so."""

import pytest

from textloom.llm import extraction

FIRST = "<p>The committee met again on Tuesday to discuss the report, and it heard from several people who had read it. Nobody left early.</p>"
LAST = "<p>A second paragraph goes on about the same matter, with some more words, and it ends here after a while. It was long.</p>"
MENU = "<nav><ul><li><a href='/'>Home</a></li><li><a href='/a'>About</a></li><li><a href='/b'>Contact us</a></li></ul></nav>"
FOOT = "<footer>&copy; 2024 Example. All rights reserved.</footer>"


def page(inside="", behind="", end=""):
    return f"<html><head><title>t</title></head><body>{MENU}<article><h1>The report of the year</h1>{FIRST}{inside}{LAST}{end}</article>{behind}{FOOT}</body></html>"


def text(html):
    return extraction.texts([html], extraction.model())[0]


@pytest.mark.parametrize(
    ("html", "lines"),
    [
        (page("<table><thead><tr><th>Year</th><th>Sales</th></tr></thead><tbody><tr><td>2001</td><td>45</td></tr><tr><td>2002</td><td>57</td></tr></tbody></table>"), ["Year", "Sales", "2001", "45", "2002", "57"]),
        (page("<dl><dt>Anchor</dt><dd>A heavy thing that holds a ship.</dd><dt>Bow</dt><dd>The front of it.</dd></dl>"), ["Anchor", "A heavy thing that holds a ship.", "Bow", "The front of it."]),
        (page("<details><summary>Show the method</summary><p>We counted twice and took the mean of both.</p></details>"), ["Show the method", "We counted twice and took the mean of both."]),
        (page("<h2>Notes on related work</h2>"), ["Notes on related work"]),
        (page("<p class='header-image-text'>The picture shows the old bridge in the fog of an early morning.</p>"), ["The picture shows the old bridge in the fog of an early morning."]),
        (page("<p class='tags-explained'>Tags are short words that say what a page is about.</p>"), ["Tags are short words that say what a page is about."]),
        (page(end="<ul><li>Apples<ul><li>red</li><li>green</li></ul></li><li>Pears</li></ul>"), ["Apples", "red", "green", "Pears"]),
    ],
)
def test_op6_keeps_what_the_article_holds(html, lines):
    got = text(html).split("\n")
    at = got.index(lines[0])
    assert got[at : at + len(lines)] == lines
    assert len(got) == 3 + len(lines)


def test_op6_leaves_unnamed_comments_and_short_site_headers():
    remarks = "<li><b>Ann</b><p>I liked this a lot, thanks.</p></li><li><b>Bob</b><p>Not sure that I agree with it.</p></li>"
    for behind in (f"<section><h3>What readers say</h3><ol>{remarks}</ol></section>", f"<ol>{remarks}</ol>"):
        assert len(text(page(behind=behind)).split("\n")) == 3
    site = f"<html><body><header><h1>My Site</h1><p>Just words.</p></header>{MENU}<article><h1>Real title</h1><p>Short one.</p><p>Another short one.</p></article>{FOOT}</body></html>"
    assert text(site) == "Real title\nShort one.\nAnother short one."
