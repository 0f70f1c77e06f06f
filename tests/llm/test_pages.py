"""Pages labelled by hand: which of their blocks are the article, with names around it that mostly stand around something else."""

from __future__ import annotations

import pytest

from cuelattice.llm import html_text, warc

P1 = "The harbour of the town was quiet and the boats were in for the night, as they had been for all of the winter, and it was not until the spring that they were out on the sea."
P2 = "When the men came home they were met by all of their families, and there was a feast that went on for the whole of a week, with songs that none of us had heard before then."
P3 = "It is not known who it was that built the first of the houses, but the oldest of them has been there for more than two hundred years, and it will be there when we are gone."
MID = "There were no more than ten of them, and that was in the best of all the years."
ARTICLE = f"<p>{P1} {P2}</p><p>{P3} {P2}</p><p>{MID}</p>"
TEXT = f"{P1} {P2}\n\n{P3} {P2}\n\n{MID}"
SAID = "I was there at the time and I can say that it was not at all as they have it in this text, but who would want to know that of me after so many years. " * 2
COOKIES = "We and our partners use cookies on this site so that it can be of use to you, and so that we know what you do when you are on it. " * 2
NAV = '<nav><a href="/">Home</a> <a href="/a">About us</a></nav>'
FOOT = "<footer>All of the rights are with us and with those who have written for us in the past.</footer>"

AROUND = [
    "reader", "post legal-news", "notice-board", "search-results", "popular", "responses", "discussion", "legal", "share-story", "widget text", "register", "recommended-reading", "tags-page",
    "story", "post", "entry-content", "content", "column",
]
BESIDE = ["comments", "comment-list", "cookie-consent", "sidebar", "related-posts", "advert", "ad banner", "newsletter-signup", "sponsored", "reader-comments", "legal-notice", "popular", "promo", "discussion", "breadcrumbs"]


@pytest.mark.parametrize("name", AROUND)
def test_a_name_around_the_article_does_not_empty_it(name):
    page = f'<html><body>{NAV}<div class="{name}">{ARTICLE}</div>{FOOT}</body></html>'
    assert html_text.main_text(page) == TEXT
    inner = f'<html><body>{NAV}<div id="{name}"><div class="text">{ARTICLE}</div><div class="comments"><p>{SAID}</p></div></div><div class="cookie-notice"><p>{COOKIES}</p></div>{FOOT}</body></html>'
    assert html_text.main_text(inner) == TEXT


@pytest.mark.parametrize("name", BESIDE)
def test_a_name_beside_the_article_is_left_out(name):
    for page in (
        f'<html><body>{NAV}<div class="story">{ARTICLE}</div><div class="{name}"><p>{SAID}</p></div>{FOOT}</body></html>',
        f'<html><body><div class="{name}"><p>{COOKIES}</p></div><main>{ARTICLE}</main>{FOOT}</body></html>',
        f'<html><body><article>{ARTICLE}<div class="{name}"><p>{SAID}</p></div></article></body></html>',
    ):
        assert html_text.main_text(page) == TEXT


def test_pages_without_an_article_are_empty():
    for page in (
        f'<body>{NAV}<div class="cookie-consent"><p>{COOKIES}</p></div>{FOOT}', f'<div class="comments"><p>{SAID}</p></div>', f"<form><p>{SAID}</p></form>", f'<div hidden><p>{P1}</p></div>', f'<div role="dialog"><p>{COOKIES}</p></div>', "", NAV,
    ):
        assert html_text.main_text(page) == ""


def test_paragraphs_of_middling_length_and_other_languages():
    one = "<p>" + "</p><p>".join([MID] * 4) + "</p>"
    assert html_text.main_text(f'<div id="reader">{one}</div>') == html_text.main_text(f"<div>{one}</div>") == "\n\n".join([MID] * 4)
    other = "港は静かだった。船は冬のあいだずっと岸にあった。春になるまで海には出なかった。人々は家で待っていた。" * 5
    assert html_text.main_text(f'{NAV}<div class="notice-board"><p>{other}</p></div>') == other


def test_words_in_named_inline_elements_are_kept_apart():
    assert html_text.main_text(f'<p>{P1} {P2}<span class="ad">Buy it now for the best of all prices that you have seen in years.</span></p>') == f"{P1} {P2}"


def test_conversion_of_a_payload_with_a_late_zero_byte():
    assert not warc.is_text("", b"a" * 5000 + b"\0") and warc.is_text("", b"a" * 5000)


def test_written_files_are_records_and_nothing_else(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://x.example/{i}", f"<p>{P1} é {i}</p>") for i in range(7)], "page_id long, url string, html string")
    rows = warc.derivatives(warc.responses_of_pages(pages))
    warc.write_warc(rows.coalesce(1), str(tmp_path / "w"))
    (file,) = (tmp_path / "w").glob("part-*")
    data, n = file.read_bytes(), 0
    while data:  # as a strict reader does: a head, as many bytes as it says, two line ends, the next head
        head, _, rest = data.partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.")
        size = next(int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
        assert rest[size : size + 4] == b"\r\n\r\n"
        data, n = rest[size + 4 :], n + 1
    assert n == rows.count() == 14
    back = warc.read_warc(spark, str(tmp_path / "w"))
    assert {(r["record_id"], bytes(r["block"]), r["whole"]) for r in back.collect()} == {(r["record_id"], bytes(r["block"]), True) for r in rows.collect()}
