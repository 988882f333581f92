import html
import re

import pytest

from millrace.llm import main_text

PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="notice">Cookies, here, now.</div>
<div class="layout with-sidebar"><div id="content"><h1>A   title</h1><p>One, two &amp; three,<br>four.<p>Sh.</p>
<ul><li>a<li>b</ul><table><tr><td>x<td>y</table><form><p>Name, mail, and so on</p></form></div>
<div id="sidebar"><p>Side, text, long, enough, to, count.</p></div></div>
<section class="comments"><p>A reader writes, at length, about, commas, and, more, commas.</p></section>
<footer>&copy; us</footer></body></html>"""


def test_page():
    assert main_text.extract(PAGE) == "A title\n\nOne, two & three, four.\n\nSh.\n\na\n\nb\n\nx\n\ny"


@pytest.mark.parametrize(
    ("source", "text"),
    [
        (None, ""),
        ("", ""),
        ("<p></p> \n", ""),
        ("plain &lt;text", "plain <text"),
        ("<article><p>a<b>b<i>c</article><p>x", "abc"),
        ("<main><p>kept</p><aside>no</aside><p>kept</p></main>", "kept\n\nkept"),
        ("<div><p>one, two</p><div hidden>no</div><p style='display: none'>no</p></div>", "one, two"),
        ("<p>cut off &am", "cut off &am"),
        ("<p>a &lt; b < c</p>", "a < b < c"),
        ('<p title="a>b">t</p>', "t"),
        ("<article><p>One, two.</p><button>Menu<p>Second, too.</p></article>", "One, two.\n\nSecond, too."),
        ("<article><p>One</p><svg><text>x</text></svg> two<select><option>no</select><video>no<p>no</p></video><p>Second</p></article>", "One\n\ntwo\n\nSecond"),
        ("<article><p>One<svg>x<p>Second</p></article><button>y</button>", "One\n\nSecond"),
        ("<svg>" * 3 + "x" + "</svg>" * 3 + "<p>y</p>", "y"),
        ("<p>a <math><mi>x</mi></math> b</p>", "a x b"),
        ("<p class='a>b>one</p><p title=\"1>2\">next</p>", "b>one\n\nnext"),
        ('<article><p class="share-price">a</p><div id="ad-hoc"><p>b</p></div><div class="ad-slot"><p>no</p></div><p class="site-footer">no</p></article>', "a\n\nb"),
        (f'<article><p>a</p><div class="legal"><p>{"Law, " * 60}end.</p></div><div class="related"><a href="x">{"Other " * 60}</a></div><p class="share">no</p></article>', f"a\n\n{'Law, ' * 60}end."),
        (f"<body><article><p>{'One, ' * 40}</p></article><article><p>{'two, ' * 40}</p></article></body>", f"{('One, ' * 40).strip()}\n\n{('two, ' * 40).strip()}"),
    ],
)
def test_cases(source, text):
    assert main_text.extract(source) == text


def test_scoring_alone_finds_the_text():
    """No article or main element and no names: length, commas, links and the tree decide."""
    text = "A story, told at length, with commas, and more of them, so that it counts."
    links = "".join(f"<li><a href='/{k}'>Go, see, page {k}</a></li>" for k in range(40))
    page = f"<body><div><ul>{links}</ul></div><div><div><h2>Title</h2><p>{text}</p><p>{text}</p><p>Sh.</p></div></div><div><p><a href='/'>All, rights, reserved, here, and there</a></p></div></body>"
    assert main_text.extract(page) == f"Title\n\n{text}\n\n{text}\n\nSh."
    page = f"<body><div><p>{text} {text}</p></div><div><p>{text} {text}</p></div></body>"  # siblings that score alike
    assert main_text.extract(page) == f"{text} {text}\n\n{text} {text}"


@pytest.mark.parametrize("source", ["<" * 100_000, '<a "' * 50_000, "<p>" * 50_000 + "x", "<div>" * 20_000 + "</section>" * 20_000 + "x", "<ul><li>" * 20_000 + "x", "<button>" * 50_000, "<svg>" * 20_000 + "</svg>" * 20_000, "<a \">\" " * 5_000 + "'", f"<p>{'long, ' * 500_000}</p>"])
def test_long_and_broken_pages_end(source):
    assert isinstance(main_text.extract(source), str)


def test_query_equals_the_articles(spark, sf_dir):
    """The given pages hold their text in one article without other markup than p, h1, b and br."""
    got = {r["page_id"]: r for r in main_text.query(spark, sf_dir).collect()}
    for page in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        inner = re.search(r"<article>(.*?)(</article>|\Z)", page["html"], re.S)
        body = re.sub(r"<[^>]*\Z", "", inner[1]) if inner else ""
        blocks = (" ".join(html.unescape(re.sub("</?b>", "", s.replace("<br>", " "))).split()) for s in re.split("</?(?:p|h1)>", body))
        text = "\n\n".join(b for b in blocks if b)
        assert got[page["page_id"]]["text"] == text
        assert got[page["page_id"]]["n_chars"] == len(text)
        assert main_text.extract(re.sub(r"(</?)article(?=>)", r"\1div", page["html"])) == text  # by the scoring alone


def test_tables(spark):
    pages = spark.createDataFrame([(1, None, "z"), (1, "<p>x, y</p>", "z"), (None, "<p>x, y</p>", None)], "page_id bigint, html string, text string")
    assert [r["text"] for r in main_text.main_text(pages).collect()] == ["", "x, y", "x, y"]
    assert main_text.main_text(pages.limit(0)).collect() == []


STORY = "<div class=story>" + "<p>A long sentence of the story, with commas, and with more of them, so that it counts as text.</p>" * 6 + "</div>"


def test_link_lists_inside_article_and_main_are_left_out():
    items = "".join(f"<li><a href=/{k}>Another story number {k}</a></li>" for k in range(20))
    for tag in ("main", "article", "div"):
        for links in (f"<div class=xq7><ul>{items}</ul></div>", f"<ul>{items}</ul>", f"<section>{items}</section>", "<table>" + "".join(f"<tr><td><a href=/{k}>Row {k}</a></td></tr>" for k in range(9)) + "</table>"):
            text = main_text.extract(f"<body><{tag}>{links}{STORY}{links}</{tag}></body>")
            assert text.count("A long sentence") == 6 and "Another story" not in text and "Row" not in text
    kept = main_text.extract(f"<main><div><h1><a href=/>The title</a></h1></div>{STORY}<ul><li>Plain words of a list that has no links at all</li><li>and <a href=/>one</a> link</li><li>and more</li></ul><div><p>See <a href=/>this</a></p></div></main>")
    assert all(x in kept for x in ("The title", "Plain words", "and one link", "See this"))


def test_tags_of_any_length_and_quotes_without_end():
    import time

    for size in (1_000, 70_000, 300_000):
        text = main_text.extract(f"""<main><img alt='a > b' src="data:{'x' * size}"><p title="c > d">Seen, and read.</p></main>""")
        assert text == "Seen, and read."
    began = time.perf_counter()
    for mark in ("\"", "'", "\"'", "'\""):
        main_text.extract("<p>" + f"<b x={mark}>word " * 30_000 + "end</p>")  # in time that grows with the page
    assert time.perf_counter() - began < 20
