from hypothesis import given, settings
from hypothesis import strategies as st

from loomsearch.functions.html import parse_html


def test_page():
    p = parse_html('<!DOCTYPE html><HTML lang="en-GB"><head><meta name="Description" content="two  words"><title>A <b>title</b>x</TITLE></head><body>Hi<br>there <b>you</b></body>')
    assert p.title_words == ["A", "titlex"] and p.words == ["Hi", "there", "you"] and p.description == ["two", "words"] and p.is_english


def test_language():
    assert not parse_html("<html><p>x").is_english
    assert not parse_html("<html lang='fr'>").is_english
    assert parse_html("<html class=x lang = 'english'>").is_english


def test_anchors():
    p = parse_html('<a class="c" href="/one">first <b>bold</b>word</a> x <a name="n">no link</a><a href=\'/two\'>t<img src=1>after</a>')
    assert p.links == ["/one", "/two"] and p.img_count == 1
    assert p.words == ["first", "bold", "word", "x", "no", "link", "after"]
    nested = parse_html('<a href="/a">lost<a href="/b">kept</a>')
    assert nested.links == ["/a", "/b"] and nested.words == ["kept"]


def test_sections_and_comments():
    assert parse_html("a<script>if (x<y) z</script>b<style>p{}</style>c<svg><g/></svg>d").words == ["a", "b", "c", "d"]
    assert parse_html("a<!-- b > c -->d<!--e-->f").words == ["a", "d", "f"]
    assert parse_html("a<SVG>b</svg>c<p>d").words == ["a"]  # looks for a script's end
    assert parse_html("a<radialGradient>b</radialGradient>c").words == ["a"]


def test_base_embed_image():
    p = parse_html('<base href="http://x/"><base href="http://y/"><embed src="m.mp4">t<img><img alt=">">')
    assert p.base == "http://x/" and p.links == ["m.mp4"] and p.img_count == 2 and p.words[0] == ">t"


def test_bare_signs():
    assert parse_html("1 < 2 and <> x").words == ["1", "<", "2", "and", "<>", "x"]
    assert parse_html("word <").words == ["word"] and parse_html("word<").words == []
    assert parse_html(None).words == [] and parse_html("").words == []
    assert parse_html('<p title="a > b">in</p>').words == ["in"]


@settings(deadline=None, max_examples=300)
@given(st.text(alphabet="<>/ab \"'=\nhreftilscmnoyv!-", max_size=60))
def test_never_crashes(text):
    parse_html(text)


@settings(deadline=None, max_examples=100)
@given(st.lists(st.text(alphabet="abcé.,&;", min_size=1, max_size=8), max_size=10))
def test_plain_text_is_words(words):
    assert parse_html(" \n".join(words)).words == words
