"""Elements whose text is part of the page, and hidden ones that are never closed."""

import pytest

from stagekin.llm import html_text


def texts(page):
    return [text for text, _, _ in html_text.leaf_blocks(page)]


def test_formulas_drawings_and_fallbacks_are_text():
    page = ("<p>Energy <math><mi>E</mi><mo>=</mo><mi>m</mi><annotation>tex</annotation></math> holds.</p>"
            "<p>See <svg><title>no</title><path d='x'/><text>label</text></svg> here</p>"
            "<object data=x><param name=a><p>Fallback text</p></object><p>end")
    assert texts(page) == ["Energy E=m holds.", "See label here", "Fallback text", "end"]


@pytest.mark.parametrize("tag", ["object", "math", "svg", "template", "iframe", "noscript", "style", "script"])
def test_an_unclosed_element_does_not_take_the_page(tag):
    assert texts(f"<p>one</p><{tag}><p>two</p><p>three</p>") == ["one", "two", "three"]


def test_scripts_end_at_their_own_end_tag():
    assert texts("<p>a</p><script>if(a<b){x='<p>no</p>'}</script><p>c</p><STYLE>p>q{}</Style ><p>d") == ["a", "c", "d"]
    assert texts("<template><div>no</div></template><p>yes") == ["yes"]
