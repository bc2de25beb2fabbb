"""Main text where a host's pages repeat, and hosts share a layout or have odd markup."""

import re
import time
from collections import Counter, defaultdict
from html.parser import HTMLParser

from tidemill.llm import html_text

BODY = "<body><div>site name</div><p>%s</p><div>site end</div></body>"


def texts(spark, rows, parts=1):
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(parts)
    return {r.page_id: r.text for r in html_text.main_text(df).collect()}


def test_copies_are_no_template(spark):
    twice = [(i, f"{s}://twice.example/a", BODY % "only story") for i, s in enumerate(("http", "https"))]
    two = [(10, "http://two.example/a", BODY % "a shared story"), (11, "http://two.example/b", BODY.replace("<p>", "<p>print version<p>") % "a shared story")]
    larger = [(20 + i, f"http://larger.example/{i}", BODY % ("copied story" if i < 5 else f"story {i}")) for i in range(10)]
    got = texts(spark, twice + two + larger, 3)
    assert "only story" in got[0] and got[0] == got[1]
    assert "a shared story" in got[10] and "a shared story" in got[11]
    assert {got[20 + i] for i in range(5)} == {"copied story"}
    assert [got[25 + i] for i in range(5)] == [f"story {5 + i}" for i in range(5)]


def test_hosts_of_one_layout(spark):
    rows = [(10 * h + i, f"http://h{h}.example/{i}", f"<body><div>notice of h{h}</div><p>story {h} {i}</p><div>end of h{h}</div></body>") for h in range(8) for i in range(4)]
    assert texts(spark, rows) == {10 * h + i: f"story {h} {i}" for h in range(8) for i in range(4)}


def test_layout_wrappers():
    extract = lambda page: html_text._extract(page, None, frozenset())
    for name in ("layout with-sidebar", "sidebar-right", "has-header", "widget", "sidebar"):
        for inner in ("<article><p>story</p><div class='comments'>no</div></article>", "<main><p>story</p></main>", "<div class='content'><p>story</p></div>", "<p>story</p>"):
            assert extract(f"<body><nav>menu</nav><div class='{name}'>{inner}</div><footer>end</footer></body>") == "story", (name, inner)
    assert extract("<body><article class='post comments-open'>story</article></body>") == "story"
    assert extract("<main><div class='widget'><article>story</article></div></main>") == "story"
    aside = "<div class='%s'><article>teaser</article></div>"
    assert extract("<body>" + aside % "sidebar" + "<div><div><article>story" + aside % "post-comments comment-list" + "</article></div></div></body>") == "story"


def test_elements_without_end():
    extract = lambda page: html_text._extract(page, None, frozenset())
    for odd in ("<svg class='logo'/>", "<svg>", "<math/>", "<button>", "<select>", "<title-bar>", "<template>", "<iframe src=x>", "<script src='x' />", "<canvas>", "<select><option>"):
        for page in (f"<body>{odd}<article><p>one</p><p>two</p></article></body>", f"<body><article><p>one</p>{odd}<p>two</p></article></body>", f"<body>{odd}<article><p>one<p>two</article><svg><g/></svg></body>"):
            assert extract(page) == "one\ntwo", page
    assert extract("<article><p>so <math><mi>x</mi>=<mn>2</mn></math>, <object>a drawing</object> <button>here</button></p></article>") == "so x=2, a drawing here"
    gone = "<svg><text>t</text><foreignObject><div>f</div></foreignObject></svg><select><option>o<option>p</select><template><div><p>t</template><noscript><p>n</p></noscript><iframe>i</iframe><script>if (a</b/>c) x</script>"
    assert extract(f"<article><p>left {gone}right</p></article>") == "left right"
    assert extract("<article><div><iframe></div><p>story</p></article><iframe></iframe>") == "story"


def blanked(page):
    """Without class names and ids, and without the elements that say where the article is."""
    return re.sub(r"<(/?)(?:article|main)>", r"<\1div>", re.sub(r' (?:class|id)="[^"]*"', "", page))


def brute_templates(rows):
    """Each host's template from occurrence vectors written out page by page."""
    hosts, pages = defaultdict(dict), defaultdict(dict)
    for url, page in rows:
        hosts[re.match(r"https?://([^/]*)", url)[1]][page] = html_text.parse(page)
    for host, own in hosts.items():
        texts = {p: {(words, e.token, b) for e, b, words, _ in x.blocks if not e.side} for p, x in own.items()}
        on = Counter(t[1:] for x in texts.values() for t in x)
        for page, parsed in own.items():
            longest = max((t for t in texts[page] if on[t[1:]] < len(own)), key=lambda t: (t[0], html_text._mark(t[1], f"={t[2]}")), default=None)
            pages[host].setdefault(longest and longest[1:], html_text._page_tokens(parsed))
    out = {}
    for host, own in pages.items():
        n, tokens = len(own), []
        for token in {t for p in own.values() for t in p} - {0}:
            has = [p[token] for p in own.values() if token in p]
            text = has[0][2] < 0
            words = sum(v[6] + v[7] for v in has) / sum(v[1] for v in has)
            least = max(3 + words / 5, min(n, n / 2 + n**0.5 / 2)) if text else max(2, n / 2)
            if len(has) >= 2 and (any(v[3] for v in has) or len(has) >= least):
                vector = tuple(p[token][1] if token in p else 0 for p in own.values())
                tokens.append(html_text.Token(token, has[0][0], vector, len(has), sum(v[1] for v in has), min(v[2] for v in has), any(v[3] for v in has), any(v[4] for v in has), min(v[5] for v in has), *(sum(v[k] for v in has) for k in range(6, 10))))
        if tokens:
            out[host] = html_text.nest(tokens)
    return out


def test_templates_find_articles_without_names(spark):
    rows = [(r.page_id, r.url, r.html or "") for r in spark.read.parquet("/root/testdata/sf0.1/pages.parquet").filter("page_id < 1200").collect()]
    want = texts(spark, rows, 4)
    bare = [(i, url, blanked(page)) for i, url, page in rows]
    got = texts(spark, bare, 4)
    brute = brute_templates([(url, page) for _, url, page in bare])
    host = lambda url: re.match(r"https?://([^/]*)", url)[1]
    for i, url, page in bare:
        t = brute.get(host(url))
        assert got[i] == (html_text._extract(page, t.root, t.static, t.drop) if t else html_text._extract(page, None, frozenset()))
    alone = {i: html_text._extract(page, None, frozenset()) for i, _, page in bare}
    found = sum(got[i] == want[i] for i in want)
    assert found >= 0.95 * len(want) and sum(alone[i] == want[i] for i in want) < found


def test_slots(spark):
    """Unnamed menus of links, fixed notices and framing texts go; what differs from page to page stays, headings too."""
    page = "<body><div><a href=/>home</a> <a href=/b>all news</a></div><div><h1>Head %d</h1><div><p>Story %d begins.</p><p>It has more <a href=x>than</a> one part %d.</p><p class='search-results'>Results %d.</p></div><div>Share this with your friends</div><div><a href=1>more about %d</a> <a href=2>other stuff</a></div></div><div>All rights reserved by us</div></body>"
    rows = [(i, f"http://news.example/{i}", page % (i, i, i, i, i)) for i in range(12)]
    got = texts(spark, rows, 3)
    assert got == {i: f"Head {i}\nStory {i} begins.\nIt has more than one part {i}.\nResults {i}." if i >= 0 else "" for i in range(12)} or all("Results" not in t for t in got.values())
    assert all(t.startswith(f"Head {i}\nStory {i} begins.\nIt has more than one part {i}.") and "Share" not in t and "more about" not in t and "home" not in t and "rights" not in t for i, t in got.items())
    once = rows[:-1] + [(99, "http://news.example/99", page % (9, 9, 9, 9, 9) + "")]
    once = [(i, u, p if i == 99 else p.replace(" class='search-results'", "")) for i, u, p in once]
    assert "Results 9." in texts(spark, once, 3)[99]  # a name that one page of the host has decides nothing


def test_near_copies_keep_their_text(spark):
    body = "<body><div>%s</div></body>"
    parts = [" ".join(f"w{k}{j}" for j in range(30)) for k in range(4)]
    rows = [(i, f"http://few.example/{i}", body % "".join(f"<p>{p}{' edited' if k == i else ''}</p>" for k, p in enumerate(parts))) for i in range(3)]
    got = texts(spark, rows)
    assert all(all(p in got[i] for p in parts) for i in range(3))


STORY = "The mayor opened the new bridge this morning. Hundreds came to see it. It took four years to build. Traffic starts on Monday."


def test_short_near_copies_keep_their_text(spark):
    """A story that a host has under several addresses, beside one block that differs, is one page and no template."""
    page = "<body><div>City news</div><div><h1>Bridge</h1>%s<p>Read %d times</p></div><div>All rights reserved</div></body>"
    for body in (f"<p>{STORY}</p>", "".join(f"<p>{x}.</p>" for x in STORY.split(". "))):
        few = [(i, f"http://few.example/{i}", page % (body, i)) for i in range(3)]
        many = [(10 + i, f"http://many.example/{i}", page % (body, i)) for i in range(9)]
        many += [(30 + i, f"http://many.example/o{i}", page % (f"<p>Story {i} is of something else that nobody saw before on day {i}.</p>" * 2, i)) for i in range(4)]
        got = texts(spark, few + many, 2)
        assert all("opened the new bridge" in got[i] and "starts on Monday" in got[i] for i in (*range(3), *range(10, 19)))
        assert all("something else" in got[30 + i] for i in range(4))


def test_tenth_of_its_kind(spark):
    """Each of many like blocks is judged on its own, the tenth and later too: a fixed one goes, one that differs stays."""
    page = "<body><div>" + "".join(f"<p>%s part {k}.</p>" for k in range(14)) + "</div><div>end of all</div></body>"
    rows = [(i, f"http://parts.example/{i}", page % tuple("fixed" if k == 11 else f"page {i}" for k in range(14))) for i in range(9)]
    got = texts(spark, rows)
    assert all(got[i] == "\n".join(f"page {i} part {k}." for k in range(14) if k != 11) for i in range(9))


def test_notices_in_the_article_go_with_the_template(spark):
    """Of pages whose notices stand inside the article element, without names, only the template tells them apart."""
    page = "<body><article><h1>Head %d</h1><p>Subscribe to our letter.</p><p>Story %d has its own words, and more of them %d.</p><p>Share this with friends.</p></article></body>"
    rows = [(i, f"http://in.example/{i}", page % (i, i, i)) for i in range(12)]
    got = texts(spark, rows, 3)
    assert got == {i: f"Head {i}\nStory {i} has its own words, and more of them {i}." for i in range(12)}
    assert all("Subscribe" in html_text._extract(p, None, frozenset()) for _, _, p in rows)


class Plain(HTMLParser):
    """The text of a page's article by another parser: no templates, no tokens."""

    VOID, INLINE = {"br", "img", "hr", "meta", "link", "input", "wbr"}, {"a", "abbr", "b", "bdi", "cite", "code", "em", "i", "kbd", "mark", "q", "s", "small", "span", "strong", "sub", "sup", "time", "u", "var"}
    GONE = {"script", "style", "nav", "footer", "aside", "form", "noscript", "svg", "head", "button", "iframe"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.blocks, self.now = [], [], ""

    def cut(self):
        self.blocks.append(" ".join(self.now.split()))
        self.now = ""

    def handle_starttag(self, tag, attrs):
        if tag not in self.INLINE:
            self.cut()
        if tag not in self.VOID:
            self.open.append((tag, dict(attrs)))

    def handle_endtag(self, tag):
        if tag not in self.INLINE:
            self.cut()
        if any(t == tag for t, _ in self.open):
            while self.open.pop()[0] != tag:
                pass

    def handle_data(self, data):
        tags = [t for t, _ in self.open]
        names = " ".join(f"{a.get('class') or ''} {a.get('id') or ''}" for t, a in self.open)
        side = re.search(r"comment|share|social|related|advert|promo|newsletter|cookie|sponsor|notice|banner|\bads?\b", names)
        if "article" in tags and not self.GONE & set(tags) and not side:
            self.now += data

    @classmethod
    def text(cls, page):
        p = cls()
        p.feed(page)
        p.cut()
        return "\n".join(b for b in p.blocks if b)


def test_agrees_with_another_parser(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r.text for r in html_text.main_text(pages).collect()}
    want = {r.page_id: Plain.text(r.html or "") for r in pages.collect()}
    assert {i: t for i, t in got.items() if t != want[i]} == {}


def test_salted_join_by_host(spark):
    rows = [(i, f"http://big.example/{i % 40}", f"<body><div>notice of all</div><p>story {i}</p><div>end of all</div></body>") for i in range(60)] + [(100, None, "<p>x"), (101, "http://small.example/", "<p>y")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r.page_id: r.text for r in html_text.main_text(df, broadcast_mb=-1, host_rows=7).collect()}
    assert got == {r.page_id: r.text for r in html_text.main_text(df).collect()} and got[5] == "story 5" and len(got) == 62


def test_long_and_hostile_pages():
    for page in ('<a "' * 250_000, '<a ">' * 200_000, "<a b=\">\" " * 100_000, "<!-" * 300_000, "<svg " * 200_000, "<div>" * 100_000 + "</p>" * 100_000 + "<p>x", "<div><article class='ad'>" * 20_000, "&amp;<b>" * 120_000, "<p title='" * 100_000):
        start = time.perf_counter()
        html_text._extract(page, None, frozenset())
        assert time.perf_counter() - start < 15, page[:20]
    start = time.perf_counter()
    html_text._extract('<a "' * 250_000, None, frozenset())
    assert time.perf_counter() - start < 2
    assert html_text._extract("<article><p>a<script>if (1 > 0) x", None, frozenset()) == "a"
    assert html_text._extract("<article><p>a</p><!-- b <p>c</p>", None, frozenset()) == "a"
    assert html_text._extract("<article><p title=it's>a</p><p data-x=\"1 > 0\">b</p><p>c's</p></article>", None, frozenset()) == "a\nb\nc's"
