"""Pages with quotes and elements that have no end."""

import time

import pytest

from weftline.llm import html_extract


@pytest.mark.parametrize("source", ['<a ">" ' * 150_000 + '"', "<textarea>" * 100_000, "<a '>' b=\">\" " * 60_000 + "'", '<p x="' * 150_000, "<iframe><title>" * 60_000])
def test_a_megabyte_without_ends_takes_seconds(source):
    start = time.process_time()
    html_extract.Page(source)
    assert time.process_time() - start < 20


def test_tags_behind_a_quote_without_a_partner():
    page = html_extract.Page('<div id="a">one</div><p class="x>two</p><em class=\'b\'>three</em>')
    assert [x[1] for x in page.items if x and x[1].strip()] == ["one", "two", "three"] and page.tag[-1] == "em" and page.names[-1] == ("b",)


@pytest.mark.parametrize("source", ['<a ">" <b x="y">t</b>"', "<i>a</i><b '>'>c</b>'", '<p a="1" b=\'2\'>x</p>', "<p a"])
def test_tag_ends(source):
    at = source.index("<") + 2
    want = html_extract._TOKEN.match(source, source.index("<"))
    end = html_extract._tag_end(source, at, set())
    assert (end is None) == (want[2] is None) and (end is None or end == want.end())
