"""Furniture is left out of pages at any depth, and what stands around it isn't."""

import pytest

from lamella.llm import wrapper

ARTICLE = "<p>Text of the article goes on here.</p>"


@pytest.mark.parametrize("levels", [1, 5, 100, 159, 160, 161, 165, 400])
@pytest.mark.parametrize("furniture", ["<nav>Menu home<div><ul><li>one</li></ul></div></nav>", "<div class='sidebar'>Menu home<div>two<div>three</div></div></div>", "<footer>Menu home</footer>", "<aside>Menu home<p>more</aside>", "<form>Menu home <input> <b>x</b></form>"])
def test_deep_furniture_goes(levels, furniture):
    page = f"<html><body>{'<div>' * levels}{furniture}{ARTICLE}{furniture}{'</div>' * levels}<p>After it all.</p></body></html>"
    assert wrapper.extract(page, [])[0] == "Text of the article goes on here.\nAfter it all."


def test_unclosed_deep_furniture_ends_with_what_is_around_it():
    page = f"<html><body><section>{'<div>' * 200}<nav>Menu<div>home{'</div>' * 90}</section><p>After.</p></body></html>"
    assert wrapper.extract(page, [])[0] == "After."


def test_deep_headers_of_articles_stay():
    page = f"<html><body><article>{'<div>' * 200}<header><h1>Title</h1></header><p>Body.</p>{'</div>' * 200}</article></body></html>"
    out = wrapper.extract(page, [])[0]
    assert "Title" in out and "Body." in out
