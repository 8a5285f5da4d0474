from haulbook.llm import site_templates as site

PAGES = "page_id long, url string, html string, text string"
ARTICLE = (
    "<html><head><title>T</title><style>p{}</style></head><body><header>Site</header><nav><ul><li>Home</ul></nav>"
    "<div class='cookie-notice'>we store</div><article class=post><header><h1>Head &amp; line</h1></header>"
    "<p>One<p>Two <b>bo</b>ld<br>line &lt;x&gt; 3 < 4</p><ul><li>a<li>b</ul><script>var p='</p>'</script>"
    "<form>mail <input></form><section id=comments><article class='comment'>me too</article></section></article>"
    "<aside>more</aside><footer>&copy; us</footer></body></html>"
)


def plain(number):
    return (
        f"<body><div><span>All rights by us</span></div><div><p>Story {number} begins</p><p>and  ends\n{number}</p></div>"
        f"<div>Made in {number % 2}</div></body>"
    )


def test_marked_articles():
    assert site.main_text(ARTICLE, set()) == "Head & line One Two bold line <x> 3 < 4 a b"


def test_subtrees_that_a_host_repeats_go(spark):
    rows = [(n, "https://Site.example.org/a", plain(n), "theirs") for n in range(8)]
    rows += [(n, "http://few.example.org/", plain(n), None) for n in range(20, 22)]
    rows += [(30, None, None, None), (31, "not a url", "", None), (32, "https://site.example.org:80/x", "<p>broken <b", None)]
    rows += [(33, None, "text <!-- never closed <p>x", None), (34, None, "<p>a</i></div>b<script>x", None)]
    rows += [(35, None, "<p>" + "long " * 50_000, None), (0, "https://site.example.org/a", plain(0), "again")]
    found = {}
    for row in site.with_main_text(spark.createDataFrame(rows, PAGES)).collect():
        found.setdefault(row["page_id"], row)
        assert row["n_chars"] == len(row["text"])
    for n in range(8):
        # Both footers are on half of nine pages and more: template like the line of rights.
        assert found[n]["text"] == f"Story {n} begins and ends {n}" + f" Made in {n % 2}" * (n % 2)
    assert found[20]["text"] == "All rights by us Story 20 begins and ends 20 Made in 0"
    assert [found[n]["text"] for n in range(30, 35)] == ["", "", "broken", "text", "a b"]
    assert found[35]["n_chars"] == 5 * 50_000 - 1


def test_paragraphs_of_articles_stay(spark):
    rows = [(n, "https://a.example.org/", f"<article><p>Same words</p><p>{n}</p></article>", "") for n in range(9)]
    found = site.with_main_text(spark.createDataFrame(rows, PAGES)).collect()
    assert {row["text"] for row in found} == {f"Same words {n}" for n in range(9)}


def test_columns_and_empty(spark):
    none = site.with_main_text(spark.createDataFrame([], PAGES))
    assert none.count() == 0 and none.columns == ["page_id", "url", "html", "text", "n_chars"]


def test_names_of_furniture_win():
    text = lambda page: site.main_text(page, set())
    for names in ("class='main-menu'", "class='main-nav'", "id='main-header'"):
        assert text(f"<body><div {names}>Home News</div><p>The story</p></body>") == "The story"
        assert text(f"<body><div {names}>Home News</div><article><p>The story</p></article></body>") == "The story"
    for names in ("post-comments", "article-comments"):
        assert text(f"<article><p>The story</p><div class='{names}'>me too</div></article>") == "The story"
    assert text("<article><h2 class='section-header'>Part one</h2><p>The story</p></article>") == "Part one The story"
    for names in ("id=main", "role=main", "class='wide main'"):
        assert text(f"<body><div>Before</div><div {names}>The story</div></body>") == "The story"
    assert text("<body><div class='main-part'>One</div><div>Two</div></body>") == "One Two"
    assert text("<body class='no-sidebar'><article class='post no-comments'>The story</article></body>") == "The story"


def test_blocks_that_articles_repeat_go(spark):
    box = "<div><p>Read us by mail</p><a href=/x>Sign on</a></div>"
    rows = [
        (n, "https://a.example.org/", f"<body><article><h2>Intro</h2><p>Story {n} on <b>Berlin</b></p>{box}</article></body>", "")
        for n in range(9)
    ]
    # Copies of one article on pages that differ elsewhere.
    rows += [(n, "https://b.example.org/", f"<body><p>{n}</p><article><div><p>Told once</p></div></article></body>", "") for n in range(9, 18)]
    found = {row["page_id"]: row["text"] for row in site.with_main_text(spark.createDataFrame(rows, PAGES)).collect()}
    assert found == {n: f"Intro Story {n} on Berlin" if n < 9 else "Told once" for n in range(18)}


def test_templates_of_few_among_many_pages(spark):
    """A block of a section of a large host goes; the story of a page that was stored five times stays."""
    box = "<div><p>More of this section</p></div>"
    rows = [(n, "https://a.example.org/", f"<body>{box * (n < 8)}<p>Story {n} on <b>Berlin</b></p></body>", "") for n in range(80)]
    rows += [(80 + n, "https://b.example.org/", f"<body><div><p>Told {max(n, 4)}</p></div></body>", "") for n in range(20)]
    found = {row["page_id"]: row["text"] for row in site.with_main_text(spark.createDataFrame(rows, PAGES)).collect()}
    assert found == {n: f"Story {n} on Berlin" for n in range(80)} | {80 + n: f"Told {max(n, 4)}" for n in range(20)}


def test_names_inside_articles():
    text = lambda page: site.main_text(page, set())
    page = (
        "<article><h1>T</h1><h2 id='social-impact'>Social impact</h2><p>a b c</p><section id='search-algorithms'>Trees</section>"
        "<p class='related-work'>rw</p><h3 id='ads-and-revenue'>Ads</h3><h3 id=comments>Remarks</h3>"
        "<p>so <math><mi>x</mi><mo>=</mo><mn>1</mn></math></p><div class='post-share'>tell</div></article>"
    )
    assert text(page) == "T Social impact a b c Trees rw Ads Remarks so x=1"
    assert text("<body><h2 id='news-menu'>Menu of the day</h2><p>soup</p></body>") == "Menu of the day soup"


def test_one_story_on_several_pages_stays(spark):
    story = "<div><p>" + "told again and again " * 8 + "</p><p>" + "to its end " * 4 + "</p></div>"
    rows = [(n, "https://a.example.org/", f"<body>{story}<p>views {n}</p></body>", "") for n in range(6)]
    found = site.with_main_text(spark.createDataFrame(rows, PAGES)).collect()
    for row in found:
        assert row["text"].split() == ["told", "again", "and", "again"] * 8 + ["to", "its", "end"] * 4 + ["views", str(row["page_id"])]


def test_menus_go_by_shape(spark):
    def menu(n):
        return "<div><ul>" + "".join(f"<li><a href=/{n}{k}>Part {n} {k}</a></li>" for k in range(3 + n % 3)) + "</ul></div>"

    rows = [(n, "https://a.example.org/", f"<body>{menu(n)}<p>Story {n} with <a href=/>one</a> link</p></body>", "") for n in range(9)]
    rows += [(n, "https://b.example.org/", f"<body>{menu(n)}<p>Story {n}</p></body>", "") for n in range(20, 23)]
    found = {row["page_id"]: row["text"] for row in site.with_main_text(spark.createDataFrame(rows, PAGES)).collect()}
    for n in range(9):
        assert found[n] == f"Story {n} with one link"
    for n in range(20, 23):
        assert found[n].startswith(f"Part {n} 0") and found[n].endswith(f"Story {n}")


def test_counts_per_host_equal_brute_force(spark):
    """Every page's text from template hashes that are counted here page by page."""
    rows = []
    for n in range(60):
        host = f"h{n % 3}.example.org"
        blocks = [f"<div><p>block {n % k} of {k}</p></div>" for k in (2, 3, 5, 7, 30)]
        page = f"<body>{''.join(blocks)}<p>{'word ' * 30}{n // 2}</p></body>"
        rows.append((n, f"https://{host}/{n}", page, ""))
    counts: dict = {}
    for _, url, page, _ in rows:
        for digest in site.candidates(page):
            counts.setdefault((url.split("/")[2], digest), []).append(page)
    frequent = {key for key, pages in counts.items() if len(pages) >= site.MIN_PAGES and len(set(pages)) >= site.MIN_BODIES}
    found = {row["page_id"]: row["text"] for row in site.with_main_text(spark.createDataFrame(rows, PAGES)).collect()}
    for n, url, page, _ in rows:
        host = url.split("/")[2]
        assert found[n] == site.main_text(page, {digest for own, digest in frequent if own == host})
    assert any("of 2" not in text for text in found.values()) and any("of 30" in text for text in found.values())
