from collections import Counter
from html.parser import HTMLParser
from itertools import combinations

from wirelake.llm import html_wrappers as hw


def page(title, blocks, links=3, extra="", closed=True):
    end = "</p>" if closed else ""
    return (
        "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var x='</p>';</script></head><body><nav><ul>"
        + "".join(f"<li><a href='/{i}'>menu {i}</a></li>" for i in range(links))
        + f"</ul></nav><div class='ad'>buy now</div><article><h1>{title}</h1>"
        + "".join(f"<p>{b}{end}" for b in blocks)
        + extra
        + "</article><footer>foot</footer></body></html>"
    )


def test_blocks():
    text = hw.main_text(page("A &amp; B", ["one\n  two", "<b>three</b> four<br>five"], closed=False))
    assert text == "A & B\none two\nthree four five"
    inner = "<aside>no</aside><div id='comments'><p>reader</p></div><form><p>mail</p></form><!-- c --><ul><li>x<li>y</ul>"
    assert hw.main_text(page("T", ["p"], extra=inner)) == "T\np\nx\ny"
    assert hw.main_text(None) == hw.main_text("") == ""
    assert hw.main_text("just text < 3 &lt; 4") == "just text < 3 < 4"
    assert hw.main_text("<article><p>open") == "open"


def test_fold_and_align():
    assert hw.write(hw.fold(list("abababc"))) == "( a b )+ c"
    assert hw.read(hw.write([("+", ("a", ("?", ("b",)))), "c"])) == [("+", ("a", ("?", ("b",)))), "c"]
    streams = [list("xpqpqz"), list("xpqz"), list("xz"), list("xpqyz")]
    (wrapper,) = hw.merge([hw.fold(s) for s in streams])
    compiled = hw.Wrapper(hw.write(wrapper))
    for s in streams:
        assert compiled.accepts([(c, "") for c in s]), s
    # shapes that have nothing in common stay apart; long units fold
    assert len(hw.merge([list("abc"), list("uvw"), list("abcd")])) == 2
    unit = [f"t{i}" for i in range(300)]
    assert hw.fold(["x", *unit * 3, "y"]) == ["x", ("+", tuple(unit)), "y"]


def test_fold_against_brute_force():
    """The sizes of adjacent equal runs, by comparing all of them."""
    import random

    rng = random.Random(2)
    for _ in range(300):
        items = rng.choices("abc", k=rng.randint(0, 24))
        brute = [n for n in range(1, len(items) // 2 + 1) if any(items[i : i + n] == items[i + n : i + 2 * n] for i in range(len(items) - 2 * n + 1))]
        assert list(hw.repeated_sizes(items, 1)) == brute


class Plain(HTMLParser):
    """The article's text of a well-formed page, by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.now, self.inside, self.gone = [], "", 0, 0

    def flush(self):
        if self.now.split():
            self.out.append(" ".join(self.now.split()))
        self.now = ""

    def handle_starttag(self, tag, attrs):
        if tag in hw.BLOCKS:
            self.flush()
        if tag == "article":
            self.inside += 1
        elif tag in hw.DROPPED:
            self.gone += 1
        elif tag == "br":
            self.now += " "

    def handle_endtag(self, tag):
        if tag in hw.BLOCKS:
            self.flush()
        if tag == "article":
            self.inside -= 1
        elif tag in hw.DROPPED:
            self.gone -= 1

    def handle_data(self, data):
        if self.inside and not self.gone:
            self.now += data


def test_against_brute_force(spark, sf):
    """All pages of the test data against a plain parser; constants that the wrappers leave out are those that stand on nearly all pages of a host."""
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in hw.extract_main_text(pages).collect()}
    by_host = {}
    for r in pages.select("page_id", hw.host_of(pages.url).alias("host"), "html").collect():
        parser = Plain()
        parser.feed(r["html"] or "")
        parser.flush()
        by_host.setdefault(r["host"], {})[r["page_id"]] = parser.out, r["html"]
    for found in by_host.values():
        different = {html: out for out, html in found.values()}
        counts = Counter(line for out in different.values() for line, n in Counter(out).items() if n == 1)
        fixed = {line for line, n in counts.items() if n >= max(hw.CONSTANT_PAGES, hw.CONSTANT_SHARE * len(different))}
        for i, (out, _) in found.items():
            assert got[i] == "\n".join(line for line in out if line not in fixed)


def test_the_wrapper_decides(spark):
    """Constant parts of the template are left out wherever they stand, which the page's own elements can't tell; slots and copies stay."""
    body = "<html><body><div><b>The Daily Bugle</b></div><div><h1>Head {i}</h1><p>Story {i} text</p><p>Follow us for more!</p><p>More of {i}</p></div><div>All rights reserved {year}</div></body></html>"
    rows = [(i, f"http://a.test/{i}", body.format(i=i, year=2000)) for i in range(20)]
    rows += [(100 + i, f"http://b.test/{i}", body.format(i=0, year=1)) for i in range(50)]  # one page and its copies: nothing is known of the host
    rows += [(200 + i, f"http://c.test/{i}", f"<article><h1>Head {i}</h1><p>Only story</p></article>") for i in range(7)]  # too few pages
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in hw.extract_main_text(pages).collect()}
    for i in range(20):
        assert got[i] == f"Head {i}\nStory {i} text\nMore of {i}"
        assert hw.main_text(rows[i][2]) == f"The Daily Bugle\nHead {i}\nStory {i} text\nFollow us for more!\nMore of {i}\nAll rights reserved 2000"
    assert got[100] == got[149] == hw.main_text(rows[20][2])
    assert got[203] == "Head 3\nOnly story"


def test_odd_markup():
    text = hw.main_text
    for name in ("svg", "iframe", "object", "template", "noscript"):
        assert text(f"<article><p>one</p><{name} width=1/><p>two</p></article>") == "one\ntwo"
        assert text(f"<article><p>one</p><{name}><p>two</p></article>") == "one\ntwo"
        assert text(f"<article><p>one</p><{name}>gone</{name}><p>two</p></article>") == "one\ntwo"
    assert text("<p title=don't>one</p><p>two</p>") == "one\ntwo"
    assert text("<p title='a>b' x=\"c>d\">one</p><p a='open>two</p>") == "one\ntwo"
    for name in ("class=share-price", "class='popup-book-review'", "id=related-work"):
        assert text(f"<article><div {name}>kept</div></article>") == "kept"
    for name in ("class=ad", "class='x social-share'", "id=related-posts", "role=navigation", "class=comment-list-2", "class='cookie-notice'"):
        assert text(f"<article><p>a</p><div {name}>gone</div><p>b <span {name}>gone <i>too</i></span></p>c</article>") == "a\nb\nc"
    assert text("<html><head><title>t</title><meta charset=x><p>one<p>two") == "one\ntwo"
    assert text("<html><head><title>t</title>loose text") == "loose text"
    assert text("<article><p>energy <math><mi>E</mi> = mc</math> it is</p></article>") == "energy E = mc it is"
    assert text("<article><p>teaser</p></article><main><article><h1>Title</h1><p>the longest story</p></article></main><article>next</article>") == "Title\nthe longest story"
    assert text("<article><header><nav>n</nav><h1>Title</h1><p>by</p></header><p>story</p></article>") == "Title\nstory"
    assert text("<article class='post share'><h2 class=ad>kept</h2></article>") == "kept"
    assert text("<body class=has-sidebar><p>kept</p></body>") == text("<body class=sidebar><p>kept</p></body>") == "kept"
    assert text("<p " + "a=" * 5000) and text("<p a='" + "x>" * 5000)


def test_operator(spark, clash):
    rows = [(i, f"http://h{i % 2}.test/{i}", page(f"Title {i}", [f"text {i}.{j}" for j in range(i % 4 + 1)], links=i % 5 + 1)) for i in range(30)]
    rows += [(90, None, None), (91, "http://h0.test/x", ""), (92, None, page("N", ["n"])), (93, "nonsense", "<p>x"), (0, rows[0][1], rows[0][2]), (95, "http://h1.test/l", page("L", ["w " * 60_000]))]
    pages = clash(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = {r["page_id"]: r for r in hw.extract_main_text(pages).collect()}
    for i in range(30):
        assert got[i]["text"] == "\n".join([f"Title {i}", *(f"text {i}.{j}" for j in range(i % 4 + 1))])
    assert got[90]["text"] == got[91]["text"] == "" and got[92]["text"] == "N\nn" and got[93]["text"] == "x"
    assert got[95]["n_chars"] == 2 + 60_000 * 2 - 1
    empty = pages.where("page_id < 0")
    assert hw.extract_main_text(empty).count() == 0


def test_a_host_keeps_the_wrappers_of_all_its_shapes(spark):
    tags = "section ul ol dl table pre blockquote figure address details h1 h2 h3 h4 h5 h6 p div main article".split()
    chosen: list[tuple] = []
    for four in combinations(tags, 4):  # no two have more than one element in common
        if all(len(set(four) & set(other)) <= 1 for other in chosen):
            chosen.append(four)
    pages = [("a.test", "<body>" + "".join(f"<{t}>" for t in four) + "text" + "".join(f"</{t}>" for t in reversed(four)) + "</body>") for four in chosen]
    separate = hw.merge([hw.read(hw.expression(html)) for _, html in pages])
    df = spark.createDataFrame(pages, "host string, html string")
    found = hw.infer_wrappers(df, hw.find_constants(df)).collect()
    assert len(separate) > 16 and len(found[0].wrappers) > 16
