"""What names inside of an article leave alone, and what they don't."""

import pytest

from vantagrid.llm.html import main_text

LONG = "<p>" + "plain words of an article that goes on for a while " * 5 + "</p>"


def text_with(part):
    return main_text(f"<html><body><nav><a>menu</a></nav><div class='ad'>buy</div><article><h1>Head</h1>{LONG}{part}{LONG}</article><footer>foot</footer></body></html>")


@pytest.mark.parametrize("part, kept", [
    ('<div class="side-by-side"><p>left</p><p>right</p></div>', "left right"), ('<section class="related work"><p>others did</p></section>', "others did"), ('<p class="alert">mind this</p>', "mind this"),
    ('<ul><li><a href="1">one</a></li><li><a href="2">two</a></li><li><a href="3">three</a></li></ul>', "one two three"), ("<p>let <math><mi>x</mi></math> be</p>", "let x be"), ("<object>instead</object>", "instead"),
    ('<p id="comments-on-method">a view</p>', "a view"), ("<p>Sh is.</p>", "Sh is."), ('<div role="main"><p class="nav">way</p></div>', "way"),
])
def test_text_of_the_article_is_kept(part, kept):
    plain = " ".join(text_with("").split())
    head, rest = plain.split("while ", 5)[0], plain
    got = text_with(part)
    assert kept in got and got.replace(f" {kept}", "", 1) == rest and head in got


@pytest.mark.parametrize("part", ['<div class="ad">buy now</div>', '<section id="comments"><p>first!</p></section>', '<div class="share-buttons">share</div>', '<div class="cookie-notice">we use</div>', "<form>mail <input></form>", "<script>x</script><style>y</style>", "<aside>aside</aside>", '<ul class="breadcrumbs"><li>home</li></ul>'])
def test_other_parts_inside_of_an_article_go(part):
    assert text_with(part) == text_with("")
