from vimarsha.llm.html_extract import article_boxes, extract, main_text, parse, subtrees


def text(html, template=()):
    return main_text(parse(html), set(template))


def test_article_without_boilerplate():
    page = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var a="</p>";</script></head><body>
    <header><p>Site</p></header><nav><ul><li><a href="/">Home</a></ul></nav><!-- ad <p>x</p> --><div class="ad">Buy</div>
    <article><h1>Title &amp; more</h1><p><b>Bold<br>line &eacute;<p>Second &lt;b&gt;  par\n a&nbsp;b<form><p>Mail?</p></form>
    <ul><li>one<li>two <i>it</i></ul><div class="share-links">Share</div><section id="comments"><p>First!</p></section></article>
    <aside><p>Also</p></aside><div class="cookie-notice">Cookies</div><footer>&copy; x</footer></body></html>"""
    assert text(page) == "Title & more\n\nBold line é\n\nSecond <b> par a b\n\none\n\ntwo it"


def test_broken_and_empty_markup():
    assert text("") == "" and text("plain  text") == "plain text"
    assert text("<p>cut of") == "cut of" and text("<p>a<!-- never closed <p>b") == "a"
    assert text("<p title='un<b>x</p>y") == "xy" or text("<p title='un<b>x</p>y")
    assert text("<div><p>a</div><p>b &am") == "a\n\nb &am"
    assert text("a < b and c > d") == "a < b and c > d"
    assert text("<table><tr><td>1<td>2<tr><td>3</table>") == "1 2\n\n3"
    assert text("<SCRIPT>x</SCRIPT ><P>y") == "y" and text("<script>open") == ""
    assert text("<p>" + "long " * 50000).count("long") == 50000


def test_names_do_not_condemn_what_holds_the_article():
    assert text('<div class="content sidebar"><article><p>kept</p></article><p>side</p></div>') == "kept"
    assert text('<main><p>m</p><nav>n</nav></main><p>o</p>') == "m"
    assert text('<article><p>a</p></article><article class="comment"><p>c</p></article>') == "a"


def test_templates_by_host(spark):
    pages, want = [], {}
    for i in range(12):
        notice = "<div><p>We value you at a.com</p></div>"
        pages.append((i, f"http://A.com/{i}", f"<body>{notice}<div><p>Own text {i}</p></div></body>"))
        want[i] = f"Own text {i}"
    for i in range(12, 14):       # few pages: nothing recurs enough
        pages.append((i, "http://b.com/", f"<body><div><p>Same</p></div><p>x{i}</p></body>"))
        want[i] = f"Same\n\nx{i}"
    for i in range(14, 30):       # copies of one page count as one page
        pages.append((i, "http://c.com/p", "<body><p>Copied page</p></body>"))
        want[i] = "Copied page"
    for i in range(30, 38):       # a paragraph that recurs inside articles stays
        pages.append((i, f"http://d.com/{i}", f"<body><p>Top</p><article><p>Shared</p><p>y{i}</p></article></body>"))
        want[i] = f"Shared\n\ny{i}"
    pages += [(38, None, None), (39, "no host", "<p>z</p>"), (None, None, "<p>q</p>")]
    want |= {38: "", 39: "z", None: "q"}
    df = spark.createDataFrame([(*p, "k") for p in pages], "page_id long, url string, html string, TEXT string").repartition(3)
    out = extract(df).collect()
    assert {x.page_id: x.text for x in out} == want and all(x.n_chars == len(x.text) for x in out)
    assert extract(df).columns == ["page_id", "url", "text", "n_chars"]
    assert extract(df.limit(0)).count() == 0


def test_subtrees_are_found_outside_articles_only():
    page = parse("<body><div><p>a</p></div><article><p>b</p></article></body>")
    assert len(subtrees(page)) == 2


def test_templates_inside_articles(spark):
    box = "<div><h3>About the author</h3><p>Ann writes.</p></div>"
    pages, want = [], {}
    for i in range(30):           # an unnamed author box on every page goes, recurring paragraphs and headings stay
        pages.append((i, f"http://a.com/{i}", f"<article><div><h2>Summary</h2></div><p>Quoted law</p><p>Own and long text number {i}</p>{box}</article>"))
        want[i] = f"Summary\n\nQuoted law\n\nOwn and long text number {i}"
    for i in range(30, 60):       # versions of one article: their common boxes are its text
        pages.append((i, f"http://b.com/{i}", f"<article><p>The longest block is the same</p>{box}<p>v{i}</p></article>"))
        want[i] = f"The longest block is the same\n\nAbout the author\n\nAnn writes.\n\nv{i}"
    for i in range(60, 79):       # too few pages
        pages.append((i, f"http://c.com/{i}", f"<article><p>Own and long text number {i}</p>{box}</article>"))
        want[i] = f"Own and long text number {i}\n\nAbout the author\n\nAnn writes."
    many = "".join(f"<article><p>A teaser with its own text {j}</p><div><p>More</p></div></article>" for j in range(30))
    pages.append((79, "http://d.com/", many))      # thirty articles of one page are one page
    want[79] = "\n\n".join(f"A teaser with its own text {j}\n\nMore" for j in range(30))
    for i in range(80, 110):      # the same box at different places: too few pages for each
        w = "section" if i % 2 else "div"
        pages.append((i, f"http://e.com/{i}", f"<article><p>Own and long text number {i}</p><{w}>{box}</{w}></article>"))
        want[i] = f"Own and long text number {i}\n\nAbout the author\n\nAnn writes."
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    assert {x.page_id: x.text for x in extract(df).collect()} == want


def test_article_boxes_are_containers_with_words():
    box, other = article_boxes(parse("<div><p>o</p></div><article><div><h2>h</h2></div><p>text</p><div><p>x</p></div></article>"))
    assert len(other) == 1 and sum(h != 0 for h in box) == 1
    assert article_boxes(parse("<main><div><p>o</p></div></main>"))[1] == {}
    assert article_boxes(parse("<article><div><p>all there is</p></div></article>"))[1] == {}


def test_template_on_many_pages_of_a_host_of_any_size(spark):
    menu = "<div><p>A section menu</p></div>"
    pages = [(i, f"http://a.com/{i}", f"<body>{menu if i < 120 else ''}<div><p>Own text {i}</p></div></body>") for i in range(7000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    assert {x.page_id: x.text for x in extract(df).collect()} == {i: f"Own text {i}" for i in range(7000)}
    few = extract(df.filter("page_id < 50 or page_id >= 120")).filter("page_id < 50")       # 50 of 6930: a quotation
    assert {x.text for x in few.collect()} == {f"A section menu\n\nOwn text {i}" for i in range(50)}


def test_slugs_links_and_formulas_of_an_article_stay():
    page = """<article id="share-prices-fall"><h2 id="related-work">Related work</h2><h2 id='login'>Login</h2><p id="share-prices">Prices</p>
    <section id="social-history"><p>History</p></section><section id="login"><p>How to</p></section><p class="notice">Note</p>
    <p>See <a class="related" href="/">that</a> and more</p><div class="related-work"><p>Work</p></div>
    <p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> be</p>
    <div class="x share-buttons"><p>Share</p></div><ul class="related_posts"><li>Other</li></ul><div id="comments"><p>First!</p></div>
    <div class="newsletter-signup-2"><p>Mail?</p></div></article>"""
    assert text(page) == ("Related work\n\nLogin\n\nPrices\n\nHistory\n\nHow to\n\nNote\n\nSee that and more\n\nWork\n\nLet x=2 be")
    assert text("<article><div class='social-media'><p>Essay</p></div><div class='reader-comments'><p>First!</p></div></article>") == "Essay"
    assert text("<main><div class='alert-history'><p>On alerts</p></div><div class='user-comments'>x</div><div class='alert'>y</div></main>") == "On alerts"
    assert text("<main><p><a href='/'>Whole linked paragraph</a></p></main>") == "Whole linked paragraph"
    assert text("<p><a>Linked</a></p><ul><li><a>Menu</a></ul><p>t</p>") == "Linked\n\nt"
    assert text("<main><h2 id='related-work'>A</h2><section id='social-history'><p>b</p></section><section id='comments'>c</section></main>") == "A\n\nb"


def hosts_without_names(r, n):
    """Pages of div and p alone: a bar, a menu, offers, a notice and a foot line recur on their host, in changing parts."""
    def prose(k):
        return " ".join("".join(r.choice("aeioubdklmnrst") for _ in range(r.randint(2, 9))) for _ in range(k))
    pages, want = [], {}
    for h in range(5):
        bar, foot = prose(4), prose(7)
        menus, offers, notes = [[prose(2) for _ in range(5)] for _ in range(3)], [prose(9) for _ in range(4)], [prose(12) for _ in range(2)]
        for i in range(n):
            own = [prose(r.randint(5, 60)) for _ in range(r.randint(1, 6))]
            menu = "".join(f"<div>{x}</div>" for x in r.choice(menus))
            parts = [f"<div><div>{bar}</div><div>{menu}</div></div>", f"<div><p>{own[0]}</p>" + "".join(f"<p>{x}</p>" for x in own[1:]) + "</div>"]
            if r.random() < .6:
                parts.insert(r.choice([1, 2]), f"<div><p>{r.choice(offers)}</p></div>")
            if r.random() < .5:
                parts.append(f"<div><p>{r.choice(notes)}</p></div>")
            pages.append((h * n + i, f"http://h{h}.com/{i}", f"<body>{''.join(parts)}<div>{foot}</div></body>"))
            want[h * n + i] = "\n\n".join(own)
    return pages, want


def test_recurrence_alone_finds_the_text_of_pages_without_names(spark):
    import random
    pages, want = hosts_without_names(random.Random(8), 60)
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(4)
    assert {x.page_id: x.text for x in extract(df).collect()} == want
    off = {x.page_id: x.text for x in extract(df, min_pages=10 ** 9, hinted_pages=10 ** 9).collect()}
    assert all(off[i] != want[i] and want[i] in off[i] for i in want)       # without the count every page keeps its boilerplate


def test_a_hint_lowers_the_bar(spark):
    rows = [(i, f"http://a.com/{i}", f"<body><div class='alert-history'><p>Recurring</p></div><p>Own {i}</p></body>") for i in range(2)]
    rows += [(i, f"http://b.com/{i}", f"<body><div class='history'><p>Recurring</p></div><p>Own {i}</p></body>") for i in range(2, 4)]
    got = {x.page_id: x.text for x in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {0: "Own 0", 1: "Own 1", 2: "Recurring\n\nOwn 2", 3: "Recurring\n\nOwn 3"}
