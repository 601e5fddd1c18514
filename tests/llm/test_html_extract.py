import html
import re
import time

from quillstone.llm.html_extract import extract, main_text

TEXT = "This is the text of an article that has quite a few of the common words in it, and so it is told from the rest of the page without any doubt at all."


def test_pages_of_the_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in extract(pages).collect()}
    for p in pages.collect():
        article = re.search("<article>(.*?)</article>", p.html, re.S)[1]
        parts = (" ".join(html.unescape(re.sub("<[^>]*>", "", re.sub("<br>", " ", x))).split()) for x in re.split("</?(?:p|h1)[^>]*>", article))
        want = "\n\n".join(x for x in parts if x)
        assert got[p.page_id].text == want and got[p.page_id].n_chars == len(want) and got[p.page_id].url == p.url


def test_parts_that_are_no_text():
    page = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body class="has-sidebar"><header><h1>Site</h1></header><nav><a href=x>Menu</a></nav>
    <div class="cookie-notice">We use cookies</div><main><article><h2>Head &amp; line</h2><p>{TEXT}<p>Short&nbsp;one.<br>Next <b>line</b>
    <script>var a = "</p>"; if (1 < 2) b();</script><form><label>Mail</label><input></form><aside>Aside</aside><div class="ad">Buy</div></article>
    <section class="comments"><h3>Comments</h3><article><p>{TEXT}</p></article></section></main><div id="sidebar"><p>{TEXT}</p></div><footer>End</footer>"""
    assert main_text(page) == f"Head & line\n\n{TEXT}\n\nShort one. Next line"


def test_pages_without_an_article():
    page = f"<body><div><a href=1>Home</a> <a href=2>News</a></div><div><h1>Title</h1><p>{TEXT}</p><p>Short.</p></div><p>{TEXT}"
    assert main_text(page) == f"Title\n\n{TEXT}\n\nShort.\n\n{TEXT}"


def test_broken_pages():
    assert main_text(None) == main_text("") == main_text("<") == main_text("<!-- never closed <p>x") == ""
    assert main_text("<article>a < b &#x41; &unknown; 1 &lt; 2") == "a < b A &unknown; 1 < 2"
    assert main_text("<article><script>never closed <p>x") == ""
    assert main_text("<article>" + "<div>" * 5000 + "deep") == "deep"
    assert main_text("<article><p title='a > b'>x</p>") == "x"


def test_odd_rows(spark):
    rows = spark.createDataFrame([(1, "u", None, "x"), (None, None, "", "x"), (1, "u", "<main>é 😀", "x"), (1, "u", "<main>é 😀", "x")], "page_id long, url string, html string, n_chars string")
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in extract(rows).collect()) == [(0, "", 0), (1, "", 0), (1, "é 😀", 3), (1, "é 😀", 3)]
    assert extract(rows.filter("false")).count() == 0


def test_end_tags_of_pages_that_change_length_in_lower_case():
    page = f"<body><ARTICLE><P>İ {TEXT}</P><SCRIPT>var a = 1;</SCRIPT><STYLE>p{{}}</Style><P>{TEXT}</P></ARTICLE>"
    assert len(page.lower()) != len(page)
    assert main_text(page) == f"İ {TEXT}\n\n{TEXT}"


def test_densities_decide_where_nothing_is_marked():
    links = "".join(f"<li><a href=/{i}>Link number {i} of the list</a>" for i in range(9))
    page = f"<body><div><ul>{links}</ul></div><div><h1>Head</h1><p>{TEXT}</p><p>Short one.</p><ul>{links}</ul><figure><img><figcaption>A caption</figcaption></figure><p>{TEXT}</p></div><div><ul>{links}</ul><span>Imprint</span></div>"
    assert main_text(page) == f"Head\n\n{TEXT}\n\nShort one.\n\nA caption\n\n{TEXT}"
    # Link lists go from articles as well, and an article of short blocks alone is kept.
    assert main_text(f"<article><p>{TEXT}</p><ul>{links}</ul><p>End.</p><p>{TEXT}</p></article>") == f"{TEXT}\n\nEnd.\n\n{TEXT}"
    assert main_text("<nav><a href=1>Menu</a></nav><article><h1>Head</h1><p>Short.</p></article><footer>End</footer>") == "Head\n\nShort."


CODES = "x1 " + " ".join(f"k{i}=v{i}" for i in range(40))


def test_stop_words_tell_long_text_from_long_lists(monkeypatch):
    from quillstone.llm import html_extract

    page = f"<body><section><p>{CODES}</p><p>Total</p><ul><li><a href=1>One</a></li></ul></section><section><p>{TEXT}</p><p>Short.</p></section></body>"
    assert main_text(page) == f"{TEXT}\n\nShort."
    for change in (0, 2):
        monkeypatch.setattr(html_extract, "STOP_DENSITY", change)
        assert CODES in main_text(page)


def test_pages_in_other_languages_and_of_short_lines_are_not_lost():
    italian = "Il paese si trova sulle colline che guardano il mare, dove ogni anno gli abitanti raccolgono le olive e preparano insieme una grande festa per tutti gli amici."
    russian = "Город стоит на берегу широкой реки, и каждую весну его жители выходят на улицы, чтобы вместе посмотреть, как по воде уходит последний лёд, и спеть старые песни."
    chinese = "这座城市建在河边，" * 20
    nav = "<nav><a href=1>Home</a></nav>"
    for text in (italian, russian, chinese):
        assert main_text(f"<body>{nav}<div><h1>T</h1><p>{text}</p></div><footer>c</footer>") == f"T\n\n{text}"
    assert main_text(f"<body>{nav}<p>It rained all day.</p><p>We stayed at home.</p></body>") == "It rained all day.\n\nWe stayed at home."
    assert main_text(f"<body>{nav}<div>aside words</div><article><p>It rained all day.</p></article></body>") == "It rained all day."


def test_a_form_around_a_page_is_no_form():
    page = f"<body><form action=/page><div><article><h1>Head</h1><p>{TEXT}</p></article></div><form><label>Mail</label></form></form>"
    assert main_text(page).startswith(f"Head\n\n{TEXT}")
    assert main_text(f"<body><form><p>It rained all day.</p><input></form></body>") == "It rained all day."
    assert main_text(f"<body><p>{TEXT}</p><form><p>Write to us and tell us what you think.</p></form></body>") == TEXT


def test_an_article_counts_where_densities_find_text_in_it():
    junk = "<div>Line one</div><div>Line two</div>"
    assert main_text(f"<body>{junk}<article><h2>Head</h2><section><p>{TEXT}</p></section><section><p>Short.</p></section></article>{junk}") == f"Head\n\n{TEXT}\n\nShort."
    assert TEXT in main_text(f"<body><article><a href=1>More</a></article><div><p>{TEXT}</p></div>")


def test_ties_go_to_text():
    links = "<p><a href=1>one two three</a></p>"
    assert main_text(f"<body>{links}<p>Middle.</p><p>{TEXT}</p></body>") == f"Middle.\n\n{TEXT}"


def test_broken_pages_of_a_megabyte():
    for piece in ("<a ", '<a "', "<a '\"", '<a ">"', "<a href='x>", "<", "</", "<!", "<p><a", "<script>", "<div>", "</div><li>", "&#", "<a =\"'>", "class class= <b class"):
        began = time.time()
        main_text(piece * (1_000_000 // len(piece)))
        main_text(piece * (1_000_000 // len(piece)) + ">")
        assert time.time() - began < 6, piece
