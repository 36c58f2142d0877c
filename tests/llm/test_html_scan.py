"""Broken and very long pages: the time to read them grows with their length, and class words empty no page."""

import time

import pytest

from agentlake.llm import html_text


@pytest.mark.parametrize("unit", ["<a ", "<", "<!", "<a \"", "<a '\"'>", "<a \">", "<!-- ", "</", "<svg>", "<a b='c\">", "</svg ", "<p class='x", "<a href=\"x>'", "&amp", "<?x"])
def test_broken_pages_are_linear(unit):
    tree = html_text.trained_tree()
    took = []
    for size in (60_000, 1_000_000):
        page = "<p>" + unit * (size // len(unit)) + "<p>A last paragraph of plain words that ends the page.</p>"
        began = time.process_time()
        html_text.main_text(page, tree)
        took.append(time.process_time() - began)
    assert took[1] < 60 * max(took[0], 0.05)


def test_tags():
    tags = lambda page: [(t.name, t.end, t.attrs) for t in iter_tags(page)]

    def iter_tags(page):
        reader, at = html_text.Tags(page), 0
        while t := reader.after(at):
            yield t
            at = t.stop

    assert tags("<a href='x>y' b=\"<p>\">t</A ><br/>") == [("a", False, " href='x>y' b=\"<p>\""), ("a", True, " "), ("br", False, "/")]
    assert tags("x < y <3 <!doctype html><!-- <p> --><p title=\"it's\">") == [("", False, ""), ("", False, ""), ("p", False, " title=\"it's\"")]
    assert tags("<p title=\"x>one<b>") == [("p", False, ' title="x'), ("b", False, "")]  # a quote without its other half
    assert tags("<p <b") == [] and tags("<!-- <p>") == [("", False, "")]


@pytest.mark.parametrize("wrapper", ["widget", "ad-free-layout", "share-story", "search-history", "social-history"])
def test_class_words_empty_no_page(wrapper):
    words = "The harvest was late this year and the mills stood idle until the first frost came down from the hills. " * 2
    page = f"<html><body><div class='{wrapper}'><p>{words}</p><p>{words}</p></div><nav><a href='/'>Home</a></nav></body></html>"
    assert html_text.main_text(page, html_text.trained_tree()) == "\n".join([words.strip()] * 2)


def test_comments_and_notices_stay_out():
    words = "We use small files to remember you and you may refuse them at any time in the settings of your browser. " * 2
    for name in ("comments", "cookie-notice"):
        assert html_text.main_text(f"<body><div class='{name}'><p>{words}</p></div></body>", html_text.trained_tree()) == ""
