"""Nothing that a page shows is lost."""

import pytest
from stintline.llm.html_blocks import leaf_blocks


def texts(html):
    return [b.text for b in leaf_blocks(html)]


SHOWN = ['href="/the-hidden-valley"', "href=/the-hidden-valley", 'title="a hidden gem"', 'href="https://x.org/hidden?id=3"', 'data-hidden="x"', 'aria-hidden="false"', "data-is-hidden", 'data-style="display:none"', 'title="x style=display:none"', 'style="--display:none"']


@pytest.mark.parametrize("attribute", SHOWN)
def test_what_only_mentions_hidden_is_shown(attribute):
    assert texts(f"<p>See <a {attribute}>the valley</a> now.</p>") == ["See the valley now."]
    assert texts(f"<body {attribute}><p>One</p><p>Two</p></body>") == ["One", "Two"]


@pytest.mark.parametrize("attribute", ["hidden", "HIDDEN=''", "hidden/", 'class="a"hidden', 'style="color: red; Display : none"', "style=visibility:hidden"])
def test_hidden_elements_are_not_shown(attribute):
    assert texts(f"<p>A</p><div {attribute}><p>B</p></div><p>C</p>") == ["A", "C"]


def test_names_are_those_of_naming_attributes():
    (block,) = leaf_blocks('<div CLASS=mainText id="b" data-id="c" href="?class=d" class="e">x</div>')
    assert block.path == (("div", ("main", "text", "b")),)


@pytest.mark.parametrize("tag", ["SCRIPT", "Style", "xmp"])
def test_end_tags_of_raw_text_in_any_case(tag):
    assert texts(f"<p>İstanbul<{tag}>no</{tag.swapcase()} >.<p>Two</p>") == ["İstanbul .", "Two"]
    assert texts(f"<p>One<{tag}>no </{tag}x> no</{tag}>") == ["One"]


UNSEEN = "template noscript svg math object select datalist canvas audio video".split()


@pytest.mark.parametrize("tag", UNSEEN)
def test_an_unseen_element_without_an_end_tag_ends_with_its_block(tag):
    assert texts(f"<div>A<{tag}>no</div>B<p>C</p>") == ["A", "B", "C"]
    assert texts(f"<body><p>A<{tag}>no<p>B</p><p>C <{tag}>no</{tag}>D</p>") == ["A", "B", "C D"]
    assert texts(f"<body>A<{tag}>no<h2>B</h2><p>C</p>") == ["A", "B", "C"]


@pytest.mark.parametrize("tag", UNSEEN)
def test_an_unseen_element_with_an_end_tag_is_not_shown(tag):
    assert texts(f"<p>A <{tag} x='1'><p>no</p><a>no</a><div>no<hr></div><{tag}>no</{tag}> no</{tag}> B</p><p>C</p>") == ["A B", "C"]
    assert texts(f"<p>A <b>b<{tag}></b>no</{tag}> c</b> <{tag}/>B</p>") == ["A b c B"]


def test_unseen_elements_cost_in_proportion():
    assert texts("<svg " * 100_000) == [] and texts("<p>x<svg>" * 20_000) == ["x"] * 20_000
