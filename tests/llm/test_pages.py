"""Pages whose text is easily lost."""

import time

import pytest

from logscope.llm import html_wrappers


def text(page):
    return html_wrappers.extract(page, None)


@pytest.mark.parametrize("inner, want", [
    ("<p>one</p><svg viewBox='0 0 1 1'/><p>two</p>", "one\ntwo"),
    ("<p>one <math/> two</p><p>three</p>", "one two\nthree"),
    ("<p>one</p><svg><svg/><text>no</text></svg><p>two</p>", "one\ntwo"),
    ("<p>one</p><svg><svg><text>no</text></svg>no</svg><p>two</p>", "one\ntwo"),
    ("<p>one</p><object data='x'><p>two</p>", "one\ntwo"),
    ("<p>one</p><canvas id=c><p>two</p>", "one\ntwo"),
    ("<p>one</p><object data='x'>no</object><p>two</p>", "one\ntwo"),
    ("<p>one</p><script>a</p><p>b", "one"),
])
def test_raw_elements(inner, want):
    assert text(f"<body><article>{inner}</article></body>") == want


def test_deep_elements_close_themselves():
    deep = "<div>" * 200 + "<p>in</p>" + "</div>" * 200
    assert text(f"<body><article><h1>T</h1>{deep}<p>behind</p></article></body>") == "T\nin\nbehind"
    advert = "<b>" * 200 + "<div class=ad>buy<nav>go</nav></div><div>kept</div>" + "</b>" * 200
    assert text(f"<body><article><p>a</p>{advert}<p>z</p></article></body>") == "a\nkept\nz"
    assert text("<article>" + "<nav>" * 3000 + "x" + "</nav>" * 3000 + "y</article>") == "y"


@pytest.mark.parametrize("page", [
    "<svg>" * 40_000 + "x", "<article>" + "<b>" * 40_000 + "</i>" * 40_000 + "x", "<p><div>" + "<b>" * 40_000 + "<div></div><li>" * 20_000 + "x",
])
def test_hostile_nesting_takes_linear_time(page):
    start = time.perf_counter()
    assert text(page).endswith("x") and time.perf_counter() - start < 5


@pytest.mark.parametrize("body, want", [
    ("<main><h1>Title</h1><article><p>body text</p></article><p>after</p></main>", "Title\nbody text\nafter"),
    ("<main><p>intro</p><article><p>body text</p></article></main><p>outside</p>", "intro\nbody text\noutside"),
    ("<main><nav>no</nav><article><h1>T</h1><p>body</p></article><ul><li><a href=x>more</a></ul></main>", "T\nbody"),
    ("<div class=post><h1>Title</h1><div class=entry><p>" + "word " * 40 + "</p></div></div>", "Title\n" + ("word " * 40).strip()),
    ("<div class=post><header><h1>Title</h1><i>by me</i></header><div class=entry><p>" + "word " * 40 + "</p></div></div>", "Title\n" + ("word " * 40).strip()),
    ("<div><p>intro</p><div><p>" + "word " * 40 + "</p></div></div>", "intro\n" + ("word " * 40).strip()),
    ("<h1>Title</h1><article><p>body text</p></article>", "Title\nbody text"),
    ("<header><h1>Site</h1></header><div><a href=x>menu</a></div><div class=story><p>body</p></div>", "body"),
    ("<article><h1>T</h1><ul><li><a href=x>a reference</a></ul></article>", "T\na reference"),
    ("<article><p>a</p></article><article><p>b</p></article>", "a\nb"),
])
def test_no_text_is_left_beside_the_content(body, want):
    assert text(f"<html><body><nav><a href=/>Home</a></nav>{body}<footer>us</footer></body></html>") == want


@pytest.mark.parametrize("inner, want", [
    ("<h2 id=menu-design>Menu design</h2><p>a</p>", "Menu design\na"),
    ("<section id='related-work'><h2>Related work</h2><p>a</p></section>", "Related work\na"),
    ("<section id='comments'><p>a</p></section>", "a"),
    ("<section id='notification-settings'><p>a</p></section>", "a"),
    ("<div class='share-price'>12.5</div><p>a</p>", "12.5\na"),
    ("<div class='notice'><p>Mind the gap.</p></div>", "Mind the gap."),
    ("<div class='related-posts'><a href=x>one</a> <a href=y>two</a></div><p>a</p>", "a"),
    ("<div class='ad-728x90'>buy</div><div class='share-buttons'>tweet</div><div class='cookie_banner'>ok</div><p>a</p>", "a"),
])
def test_marks_of_text(inner, want):
    assert text(f"<body><article><p>first</p>{inner}</article></body>") == "first\n" + want


def test_weak_marks_are_supported_by_the_host(spark):
    rows = [(k, "http://x.org/", f"<body><article><div class=notice>Read our terms.</div><p>text {k}</p><div class=alert>Warning {k}</div></article></body>") for k in range(4)]
    got = html_wrappers.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["page_id"]: r["text"] for r in got} == {k: f"text {k}\nWarning {k}" for k in range(4)}


def test_each_template_of_a_host_keeps_its_text(spark):
    made = {}
    for k in range(60):
        made[k] = f"<body><article><p>plain {k}</p></article></body>", f"plain {k}"
    for k in range(60, 63):
        made[k] = f"<body><article>teaser</article><div class=content><p>long text {k}</p></div></body>", f"teaser\nlong text {k}"
        made[k + 10] = f"<body><div class=story>part {k}</div><p>a paragraph</p><section>a section</section></body>", f"part {k}\na paragraph\na section"
        # The tags on the way agree with those of the first template, the way does not.
        made[k + 20] = f"<body><article class=x></article><article class=y>other {k}</article></body>", f"other {k}"
    rows = [(k, "http://x.org/", page) for k, (page, _) in made.items()]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = html_wrappers.extract_pages(frame).collect()
    assert {r["page_id"]: r["text"] for r in got} == {k: want for k, (_, want) in made.items()}
    assert html_wrappers.wrappers(frame).count() == 2


@pytest.mark.parametrize("held_chars", [html_wrappers.HELD, 1000])
def test_all_pages_of_a_template_count(spark, held_chars):
    """One page of two hundred has another notice, so no page's notice is boilerplate; ids that name pages keep the way to the content."""
    notice = lambda k: "Read our terms." if k != 137 else "Closed today."
    rows = [
        (k, "http://x.org/", f"<body><div><a href=x>all of it</a></div><article id=post-{k}><div class=notice>{notice(k)}</div><p>text {k}</p></article></body>")
        for k in range(200)
    ]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert [(r["path"], r["fixed"]) for r in html_wrappers.wrappers(frame, held_chars).collect()] == [('["body", "article"]', "[]")]
    got = html_wrappers.extract_pages(frame).collect()
    assert {r["page_id"]: r["text"] for r in got} == {k: f"{notice(k)}\ntext {k}" for k in range(200)}


def test_wrapper_does_not_grow_with_the_pages():
    wrapper = None
    for k in range(1000):
        made = html_wrappers.fold(html_wrappers.parse(f"<body><article><p id=a{k}>one<b>x</b><i class=c{k}>y</i></p></article></body>"))
        wrapper = made if wrapper is None else html_wrappers.merge(wrapper, made)
    assert len(html_wrappers.written_out(wrapper)) < 50 * html_wrappers.KIDS
    again = html_wrappers.unpacked(html_wrappers.packed(wrapper))
    assert html_wrappers.written_out(again) == html_wrappers.written_out(wrapper)
    assert html_wrappers.content_path(again) == ["body", "article"]
