"""A word of a class or id does not cost a page its story."""

import pytest

from sextant.llm import html_text

PAGE = "<html><body><div class='menu'><a href='/'>Home</a></div><div class='{name}'><p>Story {k} first paragraph, long enough to be one of many.</p><p>Its second paragraph goes on, {k} words and more of them.</p></div><div class='bottom'><p>Copyright tail {k}</p></div></body></html>"


@pytest.mark.parametrize("name", ["social-post", "related-story", "promo-text", "story", "hidden-gem"])
def test_stories_with_suspect_names_stay(spark, name):
    rows = [(k, f"http://a.example/{k}", PAGE.format(name=name, k=k)) for k in range(20)]
    got = {r["page_id"]: r["text"] for r in html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: f"Story {k} first paragraph, long enough to be one of many. Its second paragraph goes on, {k} words and more of them." for k in range(20)}


@pytest.mark.parametrize("name", ["social", "related", "comments", "cookie-notice"])
def test_smaller_parts_with_such_names_still_go(spark, name):
    html = PAGE.format(name="story", k=1).replace("<div class='bottom'>", f"<div class='{name}'><p>Not of the story</p></div><div class='bottom'>")
    assert "Not of the story" not in html_text.extract(html, None)
