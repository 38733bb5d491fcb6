"""Names in pages: parts of words that tell of other content, words that the ratios may overrule, and ends that are cut off."""

import time

import pytest

from driftlog.llm.html_text import main_text

TEXT = "Long words of a paragraph that runs on and on. " * 4
P, LINE = f"<p>{TEXT}</p>", TEXT.strip()
ASIDE = "comments-section user-comments comment-thread post-comments ad-slot ads-box cookie-bar sidebar-left newsletter-signup related-articles share-buttons site-notice ad_banner AdSlot".split()


@pytest.mark.parametrize("name", ASIDE)
@pytest.mark.parametrize("key", ["class", "id"])
def test_parts_of_names_tell_of_other_content(name, key):
    other = f"<div {key}='x {name}'><p>Some other words of a reader here.</p></div>"
    assert main_text(f"<body><article>{P * 3}{other}{P}</article></body>") == "\n".join([LINE] * 4)
    assert main_text(f"<body><div class='content'>{P * 3}</div>{other}</body>") == "\n".join([LINE] * 3)


def test_advert_paragraphs_go_and_other_named_ones_stay():
    assert main_text(f"<article>{P * 3}<p class='advert'>Buy.</p><p id=sponsored-link>Buy.</p><p class='comment'>Said.</p>{P}</article>") == "\n".join([*[LINE] * 3, "Said.", LINE])


@pytest.mark.parametrize("name", ["header", "search", "side", "footer", "alert"])
def test_doubtful_names_count_only_with_the_ratios(name):
    assert main_text(f"<article><section id='{name}'>{P * 2}</section>{P}</article>") == "\n".join([LINE] * 3)
    assert main_text(f"<article>{P * 3}<div id='{name}'><a href='/'>Find</a> <b>x</b> <i>y</i> <u>z</u></div>{P * 3}</article>") == "\n".join([LINE] * 6)


def test_a_container_of_the_whole_text_stays_whatever_its_name():
    assert main_text(f"<body><div class='page with-sidebar'><article>{P * 3}</article><div class='sidebar'>Other.</div></div></body>") == "\n".join([LINE] * 3)


def test_what_the_end_cuts_off_is_no_text():
    cases = {"<p>a</p><!-- b <p>c": "a", "<p>a</p><!-- b --><p>c</p><!-- d <!-- e": "a\nc", "<p>a</p><a href='b": "a", "<p>a</p><script>b <!-- c": "a", "<script>x='<!--'</script><p>a</p>": "a", "<p>a < b &amp": "a < b &"}
    assert {h: main_text(h) for h in cases} == cases


def test_many_unfinished_tags_take_no_time():
    began = time.time()
    assert main_text("<p>a</p>" + "<a " * 100_000) == "a" and main_text("<p>a</p>" + "<!--" * 100_000) == "a"
    assert time.time() - began < 5
