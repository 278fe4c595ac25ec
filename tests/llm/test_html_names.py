"""What classes, ids and attributes may and may not hide, over written pages."""

import pytest

pytest.importorskip("lodestar.llm")
from lodestar.llm import html_text  # noqa: E402

SAID = " ".join(f"word{i} said here and there" for i in range(12))
KEPT = [
    '<section id="discussion"><p>{}</p></section>', '<div class="reader-content"><p>{}</p></div>', '<div class="notice-of-award"><p>{}</p></div>', '<p title="the hidden truth">{}</p>',
    '<p class="x hidden-print">{}</p>', '<p data-hidden="no">{}</p>', '<div class="related-work"><p>{}</p></div>', '<div aria-hidden="false"><p>{}</p></div>', '<p>{} <math><mi>E</mi></math></p>',
]
GONE = [
    '<div class="ad">{}</div>', '<div class="reader-comments"><p>{}</p></div>', '<section id="comments-list"><p>{}</p></section>', '<div class="x sidebar-right"><p>{}</p></div>', "<div hidden><p>{}</p></div>",
    '<div aria-hidden="true"><p>{}</p></div>', '<div id=cookie-notice-2><p>{}</p></div>', "<form><p>{}</p></form>", "<nav><p>{}</p></nav>", '<div role="complementary"><p>{}</p></div>',
]


def page(inner):
    return f"<html><head><title>t</title></head><body><nav>home</nav><article><h1>Title here</h1><p>First {SAID}.</p>{inner}<p>Last {SAID}.</p></article><footer>foot</footer></body></html>"


def extracted(spark, inners):
    rows = [(i, f"u{i}", page(x.format(f"MIDDLE {SAID}"))) for i, x in enumerate(inners)]
    found = html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    return {r.page_id: r.text for r in found}


def test_names_that_are_no_furniture_stay(spark):
    for i, text in extracted(spark, KEPT).items():
        assert text.startswith("Title here\nFirst ") and f"MIDDLE {SAID}" in text and text.endswith(f"Last {SAID}."), KEPT[i]
        assert ("E" in text.split("MIDDLE")[1]) == ("math" in KEPT[i])


def test_furniture_goes(spark):
    for i, text in extracted(spark, GONE).items():
        assert "MIDDLE" not in text and text.startswith("Title here\nFirst ") and text.endswith(f"Last {SAID}."), GONE[i]


def test_attributes_of_a_tag():
    told = html_text.attributes("<div CLASS='A b' hidden data-x=\"<y hidden2>\" id=q checked=/x class=c>")
    assert (told["class"], told["id"], told["data-x"]) == ("a b", "q", "<y hidden2>") and "hidden" in told and "hidden2" not in told
    assert html_text.attributes("<p>") == {} and "hidden" not in html_text.attributes('<p title="a hidden b">')
