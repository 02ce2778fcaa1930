"""What the wrapper of a host takes from its pages, and what it leaves."""

from barloom.llm import html_extract


def texts(spark, pages, host="h.org"):
    d = spark.createDataFrame([(i, f"http://{host}/{i}", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    return [r["text"] for r in html_extract.extract_main_text(d).orderBy("page_id").collect()]


def test_a_constant_first_paragraph_leaves_its_siblings(spark):
    pages = [f"<body><div class=text><p>By our staff</p><p>story {w}</p><p>more of {w}</p></div></body>" for w in ("one", "two", "three", "four")]
    assert texts(spark, pages) == [f"story {w}\nmore of {w}" for w in ("one", "two", "three", "four")]


def test_near_copies_keep_their_text(spark):
    story = "A long story that all copies share. " * 20
    pages = [f"<body><h1>Title {i}</h1><div class=text><p>{story}</p></div></body>" for i in "abcd"]
    assert texts(spark, pages) == [f"Title {i}\n{story.strip()}" for i in "abcd"]


def test_slots_of_numbered_marks_are_aligned():
    pages = [f"<body class='post-x{w}'><div id=n{w}><p>Our site</p><p>tale {w}</p></div></body>" for w in "abcd"]
    w = html_extract.induce(pages)
    assert len(w["anchors"]) == 1 and html_extract.extract(pages[2], w) == "tale c"


def test_constant_lines_inside_articles_are_template(spark):
    pages = [f"<body><article><h1>Head {w}</h1><div>Tell your friends</div><p>story of {w}</p><p>Read on tomorrow</p></article></body>" for w in ("one", "two", "three", "four")]
    assert texts(spark, pages) == [f"Head {w}\nstory of {w}" for w in ("one", "two", "three", "four")]


def test_the_article_whose_text_varies_is_the_main_one():
    pages = [f"<body><div><article><p>Always the same offer of the same shop for everyone</p></article></div><section><article><p>news {w}</p></article></section></body>" for w in "abcd"]
    assert [html_extract.extract(p, html_extract.induce(pages)) for p in pages] == [f"news {w}" for w in "abcd"]


def test_copies_do_not_hide_a_host_from_its_wrapper(spark):
    pages = [f"<body><div>Our site</div><div class=text><p>story {w}</p></div></body>" for w in ("one", "two", "three", "four")]
    for copied in range(4):
        assert texts(spark, [*pages, *[pages[copied]] * 8])[:4] == ["story one", "story two", "story three", "story four"]


def test_layouts_beyond_the_sampled_pages_are_learned(spark):
    pages = [f"<body><{tag}><p>About {tag}</p></{tag}><div class={tag}><p>Rules of {tag}</p><p>{tag} text {i}</p></div></body>" for tag in ("section", "pre", "blockquote", "center", "dl", "ul", "ol", "table") for i in range(3)]
    got = texts(spark, pages)
    assert all(" text " in t and "\n" not in t for t in got)


def test_deep_elements_are_counted_too(spark):
    pages = [f"<body>{'<div>' * 60}<p>Our site</p><p>deep {w}</p></body>" for w in "abcd"]
    assert texts(spark, pages) == [f"deep {w}" for w in "abcd"]


def test_both_ways_find_one_wrapper(spark):
    pages = [f"<body><div>Our site</div><article><p>By staff</p><p>story {w}</p></article></body>" for w in "abcdefgh"]
    w = html_extract.induce(pages)
    assert texts(spark, pages) == [html_extract.extract(p, w) for p in pages] == [f"story {w}" for w in "abcdefgh"]


def test_a_page_is_not_dropped_for_its_wrapping():
    inner = "<nav>Menu</nav><article><p>Story</p></article><div class='sidebar'>Side</div>"
    for page in (
        f"<body class='has-sidebar'>{inner}", f"<body class=sidebar>{inner}", f"<div id=page class='no-sidebar'>{inner}</div>", f"<div class='ad-free'>{inner}</div>",
        f"<form id=aspnetForm>{inner}</form>", f"<html class='cookie'><body><div class='overlay'>{inner}</div>",
    ):
        assert html_extract.extract(page) == "Story", page
    assert html_extract.extract("<form><p>A story without an article, long enough to be most of the page</p><div class=menu>Menu</div></form>").startswith("A story")
    assert html_extract.extract("<article><p>x</p><div class='cookie-notice'>c</div><form>f</form></article><div class=related><article>teaser</article></div>") == "x"
