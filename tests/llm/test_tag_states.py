"""Attributes and comments by the states of the HTML standard, and account numbers of any spacing."""

import time

import pytest

from stintline.llm import personal_data
from stintline.llm.html_blocks import leaf_blocks

CASES = [
    ("<p data-note=it's>one</p><p>don't go</p>", ["one", "don't go"]),
    ("<p title=a\"b>one</p><p>two \"quoted\"</p>", ["one", 'two "quoted"']),
    ("<p title='a > b' class=\"x > y\">one</p>", ["one"]),
    ("<p a'b=\"c\" d\"e>one</p><p>it's</p>", ["one", "it's"]),
    ("<p title=>one</p><p title= >two</p><p title = 'x'y>three</p>", ["one", "two", "three"]),
    ("<p =x>one</p><p a==b>two</p><p / class/=x>three</p>", ["one", "two", "three"]),
    ("<p title=x y>one</p>", ["one"]),
    ("a<!-->b<p>c<!--->d<p>e<!-- x --!>f<p>g<!-- - -- > -->h", ["ab", "cd", "ef", "gh"]),
    ("one<!-- never ended <p>two</p>", ["one"]),
    ("one</>two</ p>three</3>four<p>1 < 2 and 3 <4</p>", ["onetwothreefour", "1 < 2 and 3 <4"]),
    ('one<p title="never ended>two</p>', ["one"]),
    ("<div hidden>gone</div><p title=hidden>one</p><p data-hidden=\"hidden\">two</p><p style='display:none'>gone</p><p style=display:none>gone</p>", ["one", "two"]),
    ("<p class=a/b>one</p><br/><img alt='x>y'/>two", ["one", "two"]),
    ("<P CLASS='Main'>one</P ><A HREF=x?a=b&c='d'>two</A>", ["one", "two"]),
]


@pytest.mark.parametrize(("html", "want"), CASES)
def test_texts(html, want):
    assert [b.text for b in leaf_blocks(html)] == want


def test_names():
    (block,) = leaf_blocks("<div class='first one' class=second id=mainText><p role=\"note\">x</p></div>")
    assert block.path == (("div", ("first", "one", "main", "text")), ("p", ("note",)))


@pytest.mark.parametrize("html", ["<p a" * 30_000, "<p a=" * 30_000, "<p a='" * 30_001, '<p x="y" ' * 30_000, "<!--" * 50_000, "</" * 50_000, "<a " + "b" * 300_000, "<p " + "=" * 300_000, "<p a" + " " * 300_000])
def test_broken_tags_take_linear_time(html):
    began = time.time()
    leaf_blocks(html)
    assert time.time() - began < 5


CODE = "MT84MALT011000012345MTLCAST001S"


@pytest.mark.parametrize("gap", ["", " ", " - ", "   ", "-" * 9])
def test_account_numbers_of_any_spacing(spark, gap):
    text = f"IBAN: {gap.join(CODE)}, and so on. account {gap.join(CODE[:-1] + 'T')} is none"
    (row,) = personal_data.personal_data(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert [text[s["start"] : s["end"]] for s in row["spans"] if s["kind"] not in personal_data.BASE] == [gap.join(CODE)]


def test_long_keys(spark):
    text = "key ghp_" + "a1B2" * 100 + " and sk_live_" + "9z" * 200 + "."
    (row,) = personal_data.personal_data(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert sorted(text[s["start"] : s["end"]][:8] for s in row["spans"]) == ["ghp_a1B2", "sk_live_"]
