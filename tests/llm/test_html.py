import random
import re

import pytest

from chartloom.llm import html_text
from chartloom.llm.html_text import main_text

PAGE = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style><script>var t="</p>";</script></head><body>
<div id="cookie-notice"><p>We use cookies. <div>nested</div> more</p></div><header><h1>Site</h1></header>
<nav><ul><li><a href="/x">Home</a></li></ul></nav><!-- <p>hidden</p> --><aside>side</aside>
<div class="content"><h1>Title &amp; more</h1><p><b>First   paragraph
with &lt;markup&gt;<br>and a break.<p>Second&nbsp;one.</p><form><p>Your name</p></form>
<div class="ad">Buy!</div><p>Short.</p><table><tr><td>cell</td></tr></table></div>
<section class="comments"><p>A reader says something rather long, longer than any surge threshold would need it to be at all.</p></section>
<footer>&copy; me</footer></body></html>"""


def test_article_is_kept_and_the_rest_dropped():
    assert main_text(PAGE).split("\n\n") == ["Title & more", "First paragraph with <markup> and a break.", "Second one.", "Short.", "cell"]


def test_article_element_and_truncated_pages():
    page = "<body><p>Stray text outside.</p><article><header><h1>T</h1></header><p>One.</p><p>Two &amp"
    assert main_text(page) == "T\n\nOne.\n\nTwo &"
    assert main_text(page + "; three <b") == "T\n\nOne.\n\nTwo & three"


def test_link_lists_far_from_the_article_are_dropped():
    links = "".join(f"<li><a href='/{i}'>link {i}</a></li>" for i in range(8))
    text = "".join(f"<p>{'word ' * 30}{i}.</p>" for i in range(4))
    assert main_text(f"<body><ul>{links}</ul>{text}<ul>{links}</ul>").count("word") == 120


def test_degenerate_pages():
    for page in (None, "", "   ", "<p></p>", "<script>x", "<!-- open", "<"):
        assert main_text(page) in ("", "<")
    assert main_text("plain text") == "plain text"
    assert main_text("a < b, 3 > 2") == "a < b, 3 > 2"


def test_surge_and_dive():
    assert html_text.kept_lines([10, 0, 0, 0, 20, 90, 80, 0, 0, 0, 5]) == [False] * 4 + [True] * 3 + [False] * 4
    assert html_text.kept_lines([5, 6]) == [True, True]
    assert html_text.kept_lines([]) == []


def brute_kept(weights):
    """The rule line by line: level, least weight, then each line's stretch between dives looked at on its own."""
    n, w = len(weights), html_text.WINDOW
    window = lambda values, i: sum(values[i : i + w])
    level = max([window(weights, i) for i in range(n)] or [0])
    least = max(0, level - w * html_text.CAP) // (3 * w)
    heavy = [x if x >= least else 0 for x in weights]
    surge = max(min(html_text.SURGE, level), w * least)
    kept = []
    for i in range(n):
        a = b = i
        while a > 0 and window(heavy, a - 1) > 0:
            a -= 1
        while b < n and window(heavy, b) > 0:
            b += 1
        kept.append(heavy[i] > 0 and surge > 0 and any(window(heavy, j) >= surge for j in range(a, b)))
    return kept


def test_kept_lines_match_brute_force():
    rng = random.Random(2)
    for _ in range(400):
        plain = [rng.choice([0, 0, 0, 3, 20, 60, 200, 258]) for _ in range(rng.randrange(30))]
        raised = [x + html_text.RAISE if x and rng.random() < 0.2 else x for x in plain]
        for weights in (plain, raised):
            assert html_text.kept_lines(weights) == brute_kept(weights), weights


LONG = "word " * 120


@pytest.mark.parametrize("odd", ['<svg class="i"/>', '<iframe src="x"/>', "<select>", "<object>", "<canvas>", "<math>", "<template>", "<noscript>", "<iframe>", "<svg/>", '<p class="notice">no', '<ul><li class="share">x<li>y</ul>'])
def test_self_closed_and_unclosed_elements_lose_nothing(odd):
    assert main_text(f"<body>{odd}<p>{LONG}</p><svg></svg><p>{LONG}</p>").count("word") == 240


@pytest.mark.parametrize("name", ["side-by-side", "share-price", "notice-board", "related-work", "search-history", "banner-story", "layout no-sidebar", "page has-banner", "comments-policy"])
def test_marks_are_whole_class_tokens(name):
    assert main_text(f'<div class="{name}"><p>{LONG}</p></div>').count("word") == 120


@pytest.mark.parametrize("name", ["ad", "cookie-notice", "site-footer", "sidebarLeft", "top-banner x", "ad_box", "Comments", "related-posts-list related"])
def test_marked_elements_weigh_nothing(name):
    assert main_text(f'<p>{LONG}</p><div class="{name}"><p>other text {"x " * 200}</p></div>').split("\n\n") == [LONG.strip()]


def test_an_article_lifts_the_marks_around_it_but_for_comments():
    assert main_text(f'<form class="sidebar"><article><p>{LONG}</p></article></form>').count("word") == 120
    page = f'<article><p>{LONG}</p></article><section class="comments"><article><p>{LONG} reader</p></article></section><article class="comment">{LONG}</article>'
    assert main_text(page) == LONG.strip()


def test_a_teaser_does_not_replace_the_paragraphs():
    for page in (f"<p>{LONG}</p><p>{LONG}</p><article><p>Teaser</p></article>", f"<article><p>Teaser</p></article><p>{LONG}</p><p>{LONG}</p>"):
        assert main_text(page).count("word") == 240


def test_pages_without_an_article_element():
    menu = "<ul>" + "".join(f"<li><a href='/{i}'>entry {i}</a></li>" for i in range(9)) + "</ul>"
    body = "".join(f"<div>{LONG}{i}<div>short {i}</div></div>" for i in range(5))
    footer = "".join(f"<div class='footer'>line {i}</div>" for i in range(4))
    found = main_text(f"<body><div>Site</div>{menu}{body}{footer}<div>Imprint</div>")
    assert found.startswith("word") and found.endswith("short 4") and found.count("word") == 600 and "Imprint" not in found and "Site" not in found


def test_table_cells_and_lists_without_end_tags():
    assert main_text("<table><tr><td>a<td>b<p>c<tr><td class=ad>x<td>d</table><dl><dt class=ad>x<dd>e</dl>").split("\n\n") == ["a", "b", "c", "d", "e"]


def test_query_over_the_table(spark, tmp_path):
    rows = [(1, "u", PAGE), (2, None, None), (3, "v", ""), (3, "v", ""), (4, "w", "<article><p>" + "long text. " * 50_000)]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("_x", __import__("pyspark").sql.functions.lit(1)).write.parquet(f"{tmp_path}/pages.parquet")
    from chartloom.llm.queries import op10_html

    found = op10_html(spark, str(tmp_path)).collect()
    assert sorted(r.page_id for r in found) == [1, 2, 3, 3, 4]
    for r in found:
        assert r.n_chars == len(r.text) and not re.search(r"<p>", r.text)
    clashing = spark.createDataFrame([(1, "<p>a</p>", "mine", 7)], "id int, html string, text string, n_chars int")
    assert html_text.with_main_text(clashing).first().asDict() == {"id": 1, "html": "<p>a</p>", "text": "mine", "n_chars": 1, "main_text": "a"}
    assert html_text.with_main_text(clashing.limit(0)).count() == 0


FIVE = "".join(f"<p>{LONG}{i}.</p>" for i in range(5))


@pytest.mark.parametrize("before", ["<div>Home / About us</div>", "<div>Home</div><div>About us</div>", "<ul><li>Home</li><li>About us</li></ul>", "<div><div>Home</div></div>"])
@pytest.mark.parametrize("after", ["<div>Terms / Privacy</div>", "<div><div><span>Terms</span> Privacy</div></div>"])
def test_short_lines_around_an_unmarked_article_are_its_frame(before, after):
    found = main_text(f"<body>{before}{FIVE}{after}").split("\n\n")
    assert [x[-2:] for x in found] == [f"{i}." for i in range(5)]
    titled = main_text(f"<body><div>{before}</div><div><h1>Title</h1>{FIVE}<p>End.</p><ul><li>a</li></ul></div>{after}").split("\n\n")
    assert (titled[0], titled[-2:], len(titled)) == ("Title", ["End.", "a"], 8)


def test_unseen_text_is_stripped():
    for style in ('style="display:none"', "STYLE='color:red; display : none'", 'style="visibility: hidden"', "hidden"):
        assert main_text(f"{FIVE}<div {style}><p>{LONG} unseen</p></div>").count("word") == 600, style
    assert main_text(f'<div style="display:block">{FIVE}</div>').count("word") == 600


def test_what_surrounds_an_article_element_is_left_out():
    for around in (f'<div class="voices"><p>{LONG} reader</p><p>{LONG} reader</p></div>', f"<div>{LONG} block</div>"):
        assert main_text(f"<article><h1>T</h1>{FIVE}<p>End.</p></article>{around}").split("\n\n")[0::6] == ["T", "End."]
        assert main_text(f"<div>{around}</div><article><p>{'short article ' * 20}</p></article>{around}") == ("short article " * 20).strip()


def test_marked_elements_between_paragraphs_are_no_dive():
    found = main_text(f"{FIVE}{'<nav>menu</nav>' * 4}<p>The last paragraph of the article.</p>")
    assert found.endswith("The last paragraph of the article.") and "menu" not in found


def test_nesting_makes_empty_lines_and_these_dives():
    deep = "<div><div><div><p>Far off</p></div></div></div>"
    assert main_text(f"<div><div><div><div>{FIVE}</div></div></div></div><p>Far off</p>").count("word") == 600
    assert "Far off" not in main_text(f"<div><div><div><div>{FIVE}</div></div></div></div><p>Far off</p>")
    assert "Far off" not in main_text(f"{deep}{FIVE}")
    same = "".join(f"<div><div>{x}</div></div>" for x in (LONG, "short one", LONG, "short two", LONG))
    assert main_text(same).split("\n\n") == [LONG.strip(), "short one", LONG.strip(), "short two", LONG.strip()]


def test_surge_and_dive_decide_on_pages_without_marks():
    """Pages of a menu, an article and a foot in bare containers: stripping alone keeps all lines, the distribution the article's."""
    rng, decided = random.Random(5), 0
    for _ in range(100):
        wrap = lambda x, n: "<div>" * n + x + "</div>" * n
        menu = "".join(f"<div>{w}</div>" for w in ("Home", "News", "About us")[: rng.randrange(1, 4)])
        article = [" ".join(rng.choice(["long", "plain", "words"]) for _ in range(rng.randrange(20, 90))) for _ in range(rng.randrange(2, 7))]
        page = wrap(menu, rng.randrange(3)) + wrap("".join(f"<p>{x}</p>" for x in article), rng.randrange(4)) + wrap("<div>Imprint</div>", rng.randrange(3))
        assert main_text(page).split("\n\n") == article
        decided += [x.text for x in html_text.lines_of(page) if not x.marked] != article
    assert decided == 100


def test_deep_and_long_pages_take_bounded_time():
    for page in ("<div>" * 50_000 + LONG, f"<div>{'<p>x</p>' * 50_000}</div>", "<div>a" * 20_000):
        assert main_text(page)
