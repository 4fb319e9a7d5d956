"""HTML extraction, decontamination and the classifier on planted cases, and the pipeline stage by stage."""

import random
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from test_llm_operators import frame, plain_components, words_of  # noqa: E402

# HTML

PAGES = {
    "<html><head><title>t</title><style>p{}</style></head><body><nav>menu</nav><article><h1>A &amp; B</h1><p>one <b>two</b>\n three<p>four&nbsp;five</article><footer>f</footer></body></html>": "A & B\none two three\nfour five",
    "<body><header>h</header><main><p>text</p><aside>side</aside><form><p>mail</p></form><div class='comments'><p>nice!</p></div><p>more<br>lines</p></main></body>": "text\nmore lines",
    "<div class=ad>buy</div><div id='cookie-notice'>ok?</div><p>No article here.</p><script>var a='<p>x</p>'</script><ul><li>one<li>two</ul>": "No article here.\none\ntwo",
    "<article><p>cut in the mid": "cut in the mid",
    "<article>a<!-- <p>no</p> -->b<table><tr><td>1<td>2</table></article>": "ab\n1\n2",
    "plain text &lt;only&gt;": "plain text <only>",
    "<article></article>": "",
    "": "",
    "<article><p hidden>x</p><p style='display: none'>y</p><p>z &#233; &#x20AC;</p></article>": "z é €",
    "<article><blockquote>a &unknown; b</blockquote><p>  </p><p>c</p></article>": "a &unknown; b\nc",
}


def test_main_text_of_pages(spark):
    from tallyspark.llm.html_extraction import extract_text

    rows = [(i, f"http://h{i}.com/", h, "old") for i, h in enumerate(PAGES)] + [(90, None, None, "old"), (91, "http://h0.com/", None, "old")]
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in extract_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()}
    want = {i: t for i, t in enumerate(PAGES.values())} | {90: "", 91: ""}
    assert got == {i: (t, len(t)) for i, t in want.items()}


@pytest.mark.parametrize("limit", [200_000, 0])
def test_templates_go_by_host(spark, limit):
    from tallyspark.llm.html_extraction import extract_text

    box = "<div><span>All our offers</span> today</div>"
    rows = [(i, f"https://Site.com/{i}", f"<body>{box}<div><p>Page {i}</p></div></body>") for i in range(8)] + [(50, "http://other.com/", f"<body>{box}<p>Own</p></body>")]
    got = {r["page_id"]: r["text"] for r in extract_text(spark.createDataFrame(rows, "page_id long, url string, html string"), broadcast_rows=limit).collect()}
    assert got == {i: f"Page {i}" for i in range(8)} | {50: "All our offers today\nOwn"}


def test_a_repeated_article_is_no_template(spark):
    from tallyspark.llm.html_extraction import extract_text

    rows = [(i, "http://a.com/", "<nav>m</nav><article><h1>Same</h1><p>Same text</p></article>") for i in range(9)]
    assert {r["text"] for r in extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()} == {"Same\nSame text"}


def texts_of(spark, rows, **options):
    from tallyspark.llm.html_extraction import extract_text

    return {r["page_id"]: r["text"] for r in extract_text(spark.createDataFrame(rows, "page_id long, url string, html string"), **options).collect()}


def neutral_pages(n=12):
    """Pages without article, main or telling names: a menu, a box of offers, the text, and a foot."""
    menu = "<div class=c1><div>Home</div><div>Shop</div><div>About us and our long story</div></div>"
    foot = "<div class=c9><p>All rights reserved by the owners of this site</p></div>"
    body = lambda i: f"<h2>Title {i}</h2><div class=c5><p>{' '.join(f'word{i}x{k}' for k in range(40))}</p><p>Second part {i}</p></div>"
    # A box that no other page has is no template, whatever its size.
    want = lambda i: f"Title {i}\n{' '.join(f'word{i}x{k}' for k in range(40))}\nSecond part {i}\nonly here {i}"
    return [(i, f"http://s.com/a/{i}", f"<body>{menu}{body(i)}<div>only here {i}</div>{foot}</body>") for i in range(n)], {i: want(i) for i in range(n)}


@pytest.mark.parametrize("limit", [200_000, 0])
def test_pages_without_an_article_need_templates(spark, limit):
    rows, want = neutral_pages()
    assert texts_of(spark, rows, broadcast_rows=limit) == want
    without = texts_of(spark, rows, min_pages=1000, broadcast_rows=limit)
    assert all("About us" in t and "All rights" in t for t in without.values())


def test_a_section_has_its_own_template(spark):
    box = "<div><span>Only in the news section</span></div>"
    page = lambda i, extra: f"<body>{extra}<div><p>{' '.join(f'w{i}y{k}' for k in range(30))}</p></div></body>"
    rows = [(i, f"http://big.com/news/{i}", page(i, box)) for i in range(6)] + [(100 + i, f"http://big.com/other/{i}", page(100 + i, "")) for i in range(60)]
    got = texts_of(spark, rows)
    assert not any("Only in" in t for t in got.values()) and all(got[i].startswith(f"w{i}y0 ") for i in got)


def test_what_recurs_inside_articles(spark):
    words = lambda i: " ".join(f"w{i}z{k}" for k in range(30))
    page = lambda i, own: f"<article><h1>T{i}</h1><p>{own}</p><p>A line that some print</p>{'<p>Subscribe to us today</p>'}<div><span>Rate this</span></div></article>"
    rows = [(i, f"http://a.com/{i}", page(i, words(i))) for i in range(30)]
    rows = [(i, u, h if i % 2 else h.replace("<p>A line that some print</p>", "")) for i, u, h in rows]
    got = texts_of(spark, rows)
    assert got == {i: f"T{i}\n{words(i)}" + ("\nA line that some print" if i % 2 else "") for i in range(30)}
    # Copies of one article, each beside another advert, stay whole; so do whole pages.
    for tag in ("article", "section"):
        rows = [(i, "http://b.com/x", f"<body><div class='ad'>Buy {i}</div><{tag}><div><p>{words(1)}</p><p>End</p></div></{tag}></body>") for i in range(30)]
        assert set(texts_of(spark, rows).values()) == {f"{words(1)}\nEnd"}


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<body><div>{'word ' * 200}</div><div><p>second part of the article</p></div></body>", f"{'word ' * 199}word\nsecond part of the article"),
        (f"<body><div>{'word ' * 200}</div><ul><li>one</li></ul><table><tr><td>two</td></tr></table></body>", f"{'word ' * 199}word\none\ntwo"),
        ("<main><h1>Title</h1><p>intro</p><article><p>body</p></article></main>", "Title\nintro\nbody"),
        ("<main><div>links</div><article><p>body</p></article></main>", "body"),
        ("<article><p>See <a class='banner'>the banner link</a> now</p><p class='share'>Shares fell</p></article>", "See the banner link now\nShares fell"),
        ("<article><header><h1>Title</h1><span>by someone</span></header><p>body</p></article>", "Title\nbody"),
        ("<body><header><h1>Site</h1></header><p>body</p></body>", "body"),
    ],
)
def test_what_is_an_article_goes_by_element_and_not_by_size(spark, page, want):
    assert texts_of(spark, [(1, "http://a.com/", page)]) == {1: want}


def test_prose_and_boxes_that_recur(spark):
    words = lambda i: " ".join(f"w{i}q{k}" for k in range(10))
    # A paragraph on a few pages stays without an article element as it does in one; a long box of links goes though the article is short.
    links = "<div><ul>" + "".join(f"<li>a long related link number {k}</li>" for k in range(20)) + "</ul></div>"
    for tag in ("div", "article"):
        rows = [(i, f"http://c.com/{i}", f"<body><{tag}><p>{words(i)}</p>{'<p>Printed on some</p>' if i < 8 else ''}{links}</{tag}></body>") for i in range(20)]
        assert texts_of(spark, rows) == {i: words(i) + ("\nPrinted on some" if i < 8 else "") for i in range(20)}


def test_names_with_other_words_say_nothing(spark):
    kept = "<div class='share-price'><p>Up by two</p></div><div id='relatedWorks'><p>Cited</p></div><div class='socialScience'><p>Field</p></div>"
    gone = "<div class='share-buttons'>Tweet</div><div class='site-header x'>Logo</div><div id='comments'>Hi</div><div class='cookieNotice'>Ok</div><div class='ad'>Buy</div>"
    assert texts_of(spark, [(1, "http://a.com/", f"<body>{gone}{kept}</body>")]) == {1: "Up by two\nCited\nField"}


def test_templates_against_a_plain_count(spark):
    from html.parser import HTMLParser

    from tallyspark.llm.html_extraction import site_templates
    from tallyspark.llm.html_tree import read

    class Plain(HTMLParser):
        """Subtrees as nested tuples."""

        def __init__(self):
            super().__init__(convert_charrefs=False)
            self.stack, self.found = [["root", []]], []

        def handle_starttag(self, tag, attrs):
            self.stack.append([(tag, dict(attrs).get("class", "")), []])

        def handle_endtag(self, tag):
            name, parts = self.stack.pop()
            node = (name, tuple(parts))
            self.found.append(node)
            self.stack[-1][1].append(node)

        def handle_data(self, data):
            if data.strip():
                self.stack[-1][1].append(" ".join(data.split()))

    r = random.Random(21)
    bits = ["<div><span>menu</span></div>", "<ul><li>a</li><li>b</li></ul>", "<div class='x'>box</div>", "<p>note</p>"]
    rows = []
    for k in range(80):
        extra = "".join(r.choice(bits) for _ in range(r.randrange(3)))
        rows.append((r.choice(["h1", "h2", "h3"]), r.choice(["n", "m"]), f"<body>{extra}<div><p>own {k}</p></div></body>"))
    count, pages, hash_of = {}, {}, {}
    for host, section, page in rows:
        p = Plain()
        p.feed(page)
        nodes = {n for n in p.found if n[0][0] != "body"}
        closed = [n.hash for kind, n in read(page) if kind == "close" and n.tag != "body"]
        hash_of.update(zip([n for n in p.found if n[0][0] != "body"], closed, strict=True))
        for key in ((host, section), (host, None)):
            pages[key] = pages.get(key, 0) + 1
            for n in nodes:
                count[key, n] = count.get((key, n), 0) + 1
    want = {(*key, hash_of[n], k >= 6 and k >= 0.4 * pages[key]) for (key, n), k in count.items() if k >= 3 and k >= 0.2 * pages[key]}
    got = site_templates(spark.createDataFrame(rows, "host string, section string, html string"), 3, 0.2, 6, 0.4)
    assert {tuple(x) for x in got.collect()} == want and len(want) > 10 and any(w[3] for w in want)


# decontamination

ITEM = "a train leaves Paris at 9 and travels 120 km in 2 hours before it meets the other train that left from Lyon at noon"


def test_leaks(spark):
    from tallyspark.llm.decontamination import leaks

    pad = " ".join(f"filler{i}" for i in range(50))
    docs = {
        1: f"{pad} {ITEM} {pad}",  # verbatim
        2: f"{pad} {ITEM.replace('9', '7').replace('120', '95').replace('Paris', 'Oslo')} {pad}",  # other numbers and names
        3: pad,
        4: None,
        5: "",
        6: f"{ITEM.upper()}.",
        7: " ".join(ITEM.split()[:7]) + " " + pad,  # a few words only
        8: "a 1 b 2 c 3 " * 40,
    }
    got = {(r["doc_id"], r["item_id"]): r for r in leaks(frame(spark, [*docs.items(), (1, docs[1]), (None, docs[1])]), spark.createDataFrame([(10, ITEM), (11, None), (12, "too short"), (None, ITEM), (13, "1 2 3 4 5 6 7 8 9 10 11 12")], "item_id long, text string")).collect()}
    assert {(1, 10), (2, 10)} <= set(got) and not {k for k in got if k[0] in (3, 4, 5, 7, 8)}
    assert got[1, 10]["changed"] == 0 and got[2, 10]["changed"] >= 2


def test_slots_must_be_consistent(spark):
    from tallyspark.llm.decontamination import leaks

    item = "take 5 apples and 5 pears then add 7 plums so that the basket holds all of them for the way home"
    same, mixed = item.replace("5", "8"), item.replace("5", "8", 1).replace("5", "9", 1)
    got = leaks(spark.createDataFrame([(1, same), (2, mixed)], "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string"), min_match=0.9)
    assert [r["doc_id"] for r in got.collect()] == [1]


def test_values_that_become_equal_and_units_are_slots(spark):
    from tallyspark.llm.decontamination import leaks

    item = "a shop sells 5 apples and 3 pears for 20 dollars so how many of them can we buy for 60 dollars in all the days of spring"
    docs = [(1, item.replace("5", "8").replace("3", "8")), (2, item.replace("dollars", "euros")), (3, item.replace("dollars", "euros", 1)), (4, item.replace("20 dollars", "20")), (5, item)]
    got = {r["doc_id"]: r["changed"] for r in leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string"), passage=1000).collect()}
    # Not 3: one unit stands for two.
    assert got == {1: 2, 2: 2, 4: 0, 5: 0}


TRICKY = "aB Bob Anna O'Neil Apollo11 X 5 12 3.5 1,200 7:30 9. kg km m % $ \u20ac hours Hours it's Lopez, end. (now) \u00c9mile \ue000 \ue003x \u00bd a\u0301 KM/H 10km 5m2 ... \n".split(" ")


def plain_template(text):
    """(word, value) for each template word; reads a text from left to right, one token after the other."""
    import regex

    text = regex.sub("[\ue000-\ue003]", " ", text or "")
    names = [m.span() for m in regex.finditer(r"(?<=[\p{Ll}\p{N},;:)] )\p{Lu}[\p{L}\p{N}]*(?: \p{Lu}\p{Ll}[\p{L}\p{N}]*)*", text)]
    units = "|".join(map(regex.escape, UNIT_WORDS))
    number = regex.compile(r"\p{N}+(?:[.,:/]\p{N}+)*")
    unit = regex.compile(rf" *((?i:{units}))(?![\p{{L}}\p{{N}}])")
    out, at, literal = [], 0, ""

    def flush():
        nonlocal literal
        out.extend((w.lower(), None) for w in regex.findall(r"\p{L}+", literal))
        literal = ""

    starts = dict(names)
    while at < len(text):
        if at in starts:
            flush()
            out.append(("\ue001", text[at : starts[at]].lower().replace(" ", "\ue003")))
            at = starts[at]
            continue
        end = min([a for a, _ in names if a > at], default=len(text))
        if m := number.match(text, at, end):
            flush()
            out.append(("\ue000", m[0]))
            at = m.end()
            if u := unit.match(text, at, end):
                after = text[u.end() : u.end() + 1]
                if u.end() < end or not after or u.end() in starts:
                    out.append(("\ue002", u[1].lower()))
                    at = u.end()
            continue
        literal += text[at]
        at += 1
    flush()
    return out


UNIT_WORDS = "kg mg g km/h km cm mm ml mph mi m ft lbs lb oz hours hour hrs hr h minutes minute mins min seconds second sec ms s days day weeks week years year usd eur gbp dollars dollar euros euro percent % \u00b0c \u00b0f \u00b0 $ \u20ac \u00a3".split()


def test_template_words_against_a_plain_reader(spark):
    from tallyspark.llm.decontamination import template_words

    r = random.Random(11)
    texts = [" ".join(r.choice(TRICKY) for _ in range(r.randrange(30))) for _ in range(600)] + ["", None, " \t ", "5 kg", "costs 20 dollars or 3% of it, and Anna Maria Lopez pays 7:30"]
    got = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, t string").select("k", template_words(F.col("t")).alias("w"), template_words(F.col("t"), True).alias("v")).collect()
    for x in got:
        want = plain_template(texts[x["k"]])
        assert x["w"] == [w for w, _ in want], texts[x["k"]]
        assert x["v"] == [w + (v or "") for w, v in want], texts[x["k"]]


def test_long_runs_of_names_and_numbers(spark):
    """Runs so long that a pattern which calls itself for each repeat overflows the stack."""
    from tallyspark.llm.decontamination import leaks, template_words

    runs = {
        1: "it said " + "Foo " * 50_000,
        2: "it said " + " ".join("Fo" + "o" * (k % 7) for k in range(50_000)),
        3: "it said " + ",".join(map(str, range(50_000))) + " km",
        4: "it said " + "1.2:3/4," * 50_000 + "5 Foo Bar",
        5: "it said Foo" + " AB" * 300,
    }
    docs = spark.createDataFrame([*runs.items(), *((10 + k, f"{t} {ITEM}") for k, t in runs.items())], "doc_id long, text string")
    for x in docs.where("doc_id < 10").select("doc_id", template_words(F.col("text")).alias("w"), template_words(F.col("text"), True).alias("v")).collect():
        want = plain_template(runs[x["doc_id"]])
        assert x["w"] == [w for w, _ in want] and x["v"] == [w + (v or "") for w, v in want], x["doc_id"]
    items = spark.createDataFrame([(1, ITEM), (2, f"{runs[1]}, and the answer is in the book that he wrote")], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in leaks(docs, items).collect()} == {(10 + k, 1) for k in runs}


def test_leaks_against_a_plain_rule(spark):
    """What lies at one offset is found, and nothing of which no order-preserving match covers enough."""
    from tallyspark.llm.decontamination import leaks

    r = random.Random(12)
    words = [f"w{chr(97 + k)}" for k in range(14)]
    make = lambda n: " ".join(r.choice([*words, *words, str(r.randrange(4)), "x Bob", "x Ann Lee", "3 km"]) for _ in range(n))
    items = [(k, make(r.choice([4, 7, 12, 20]))) for k in range(15)]
    docs = []
    for k in range(120):
        body = items[r.randrange(15)][1].split(" ")
        for _ in range(r.randrange(4)):
            at = r.randrange(len(body))
            body[at : at + r.choice([0, 1, 1])] = r.choice([[], ["odd"], [str(r.randrange(9))], ["Eve"]])
        docs.append((k, f"{make(r.randrange(12))} {' '.join(body)} {make(r.randrange(12))}"))
    got = {(x["doc_id"], x["item_id"]) for x in leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), window=5, passage=9).collect()}
    slot = lambda w: w[0] in "\ue000\ue001\ue002"

    def agrees(pairs, least):
        """The rule for words laid on each other: enough agree, slots are consistent, and they aren't all template."""
        same = [(a, b) for a, b in pairs if a[0] == b[0]]
        value = {}
        consistent = all(value.setdefault(a, b) == b for a, b in same if slot(a))
        n_slots, changed = sum(slot(a) for a, _ in same), sum(a != b for a, b in same)
        return len(same) >= least and consistent and (len(same) - n_slots >= 2 or not changed)

    sure, possible = set(), set()
    for d, text in docs:
        doc = plain_template(text)
        for i, item in items:
            it = plain_template(item)
            n = min(5, len(it))
            met = {(k, at) for k in range(len(doc) - n + 1) for at in range(len(it) - n + 1) if all(doc[k + j][0] == it[at + j][0] for j in range(n))}
            for off in {k - at for k, at in met}:
                if agrees([(it[at], doc[at + off]) for at in range(len(it)) if 0 <= at + off < len(doc)], 0.8 * len(it)):
                    sure.add((d, i))
                cells = sorted({at + j for k, at in met for j in range(n) if k - at == off})
                for run in (cells[a:b] for a in range(len(cells)) for b in [next((e for e in range(a + 1, len(cells)) if cells[e] != cells[e - 1] + 1), len(cells))] if a == 0 or cells[a - 1] != cells[a] - 1):
                    if len(run) >= 9 and agrees([(it[at], doc[at + off]) for at in run], 0):
                        sure.add((d, i))
            cells = {(k + j, at + j) for k, at in met for j in range(n)}
            best = [[0] * (len(it) + 1) for _ in range(len(doc) + 1)]
            for k in range(len(doc)):
                for at in range(len(it)):
                    best[k + 1][at + 1] = max(best[k][at + 1], best[k + 1][at], best[k][at] + ((k, at) in cells))
            if best[-1][-1] >= 0.8 * len(it):
                possible.add((d, i))
    assert sure and sure <= got <= sure | possible


def test_recall_of_planted_variants(spark):
    from tallyspark.llm.decontamination import leaks

    r = random.Random(13)
    lower = [a + b for a in "ba ke lo mi nu ra se ti vo zu".split() for b in "nd rt lk mp st ng rm sk".split()]
    names = [["Bob"], ["Anna", "Maria"], ["Eve", "Van", "Dorn"], ["Omar"]]
    units = ["km", "kg", "hours", "dollars"]

    def item():
        out = []
        while len(out) < 30:
            out += r.choice([[r.choice(lower)]] * 8 + [[r.choice(lower), str(r.randrange(100))], [r.choice(lower), str(r.randrange(100)), r.choice(units)], [r.choice(lower), *r.choice(names)]])
        return out

    def changed(w):
        out, mapped = [], {}
        for k, x in enumerate(w):
            if x.isdigit():
                out.append(mapped.setdefault(x, str(r.randrange(1000))))
            elif x[0].isupper():
                if not w[k - 1][0].isupper():
                    run = " ".join(w[k : next((e for e in range(k, len(w)) if not w[e][0].isupper()), len(w))])
                    out += mapped.setdefault(run, r.choice(names))
            elif x in units and k and w[k - 1].isdigit():
                out.append(mapped.setdefault(x, r.choice(units)))
            else:
                out.append(x)
        return out

    def variant(w, kind):
        w = changed(w)
        at = r.randrange(5, len(w) - 5)
        if kind == 1:
            w.insert(at, "really")
        if kind == 2:
            del w[at]
        if kind == 3:
            w[at] = "other"
        return w

    items = [item() for _ in range(60)]
    pad = lambda: " ".join(r.choice(lower) for _ in range(40))
    docs = [(4 * k + kind, f"{pad()} {' '.join(variant(w, kind))} {pad()}") for k, w in enumerate(items) for kind in range(4)]
    docs += [(1000 + k, " ".join([pad(), *item(), pad()])) for k in range(200)]
    got = {(x["doc_id"], x["item_id"]) for x in leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")).collect()}
    found = [[(4 * k + kind, k) in got for k in range(60)] for kind in range(4)]
    recall = [sum(f) / 60 for f in found]
    assert min(recall) >= 0.9, recall
    assert got == {(d, k) for d, k in got if d // 4 == k}


def test_leaks_at_every_offset_and_of_any_item(spark):
    from tallyspark.llm.decontamination import leaks

    item = "these are fifteen plain lower words which the reader may find anywhere in some document"
    words = item.split()
    changed = " ".join(w if i not in (4, 11) else "other" for i, w in enumerate(words))
    docs = [(k, " ".join(["pad"] * k + [changed, "pad"])) for k in range(8)]
    docs += [(20, "before 12 + 7 - 3 + 44 = 60 after"), (21, "before 13 + 7 - 3 + 44 = 61 after"), (22, "we ask what is 5 plus 6 now"), (23, "we ask what is 8 plus 9 now"), (24, "we ask what was 8 plus 9 now")]
    items = [(1, item), (2, "12 + 7 - 3 + 44 = 60"), (3, "what is 5 plus 6"), (4, ""), (5, "21 7 3 44 60 and 81 then 9 10 11 12 13 14")]
    docs.append((25, f"pad pad {items[-1][1]} pad"))
    got = leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(k, 1) for k in range(8)} | {(20, 2), (22, 3), (23, 3), (25, 5)}


def test_leaks_with_words_put_in_or_left_out_and_of_half_an_item(spark):
    from tallyspark.llm.decontamination import leaks

    item = "when the old baker Bob brought 12 loaves to the market on the hill he sold 7 of them before the rain came down in the late morning"
    w = item.split()
    docs = {
        1: " ".join([*w[:13], "really", *w[13:]]),
        2: " ".join([*w[:13], *w[14:]]),
        3: item.replace("Bob", "Anna Maria Lopez").replace("12", "30"),
        4: " ".join(w[14:]),  # half of it
        5: " ".join(w[:8]),
        6: " ".join([*w[13:], *w[:13]]).replace("the", "a", 9),
        7: " ".join(w[:13]) + " and again " + " ".join(w[:13]),
    }
    docs = [(k, f"pad {x} pad") for k, x in docs.items()]
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r["doc_id"]: r for r in leaks(spark.createDataFrame(docs, "doc_id long, text string"), items, passage=13).collect()}
    assert {1, 2, 3, 4} <= set(got) and not {5, 6} & set(got)
    assert got[3]["n_equal"] == got[3]["n_words"] and got[3]["changed"] == 2
    whole = {r["doc_id"]: r["n_equal"] for r in leaks(spark.createDataFrame(docs, "doc_id long, text string"), items, passage=1000).collect()}
    assert set(whole) == {1, 2, 3} and whole[1] == len(w) and whole[2] == len(w) - 1


def test_leaks_against_a_direct_search(spark, small):
    from tallyspark.llm.decontamination import leaks

    d, b = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "benchmark"))
    items = [" ".join(words_of(r["text"])) for r in b.collect()]
    holds = {r["doc_id"] for r in d.collect() if any(f" {x} " in f" {' '.join(words_of(r['text']))} " for x in items)}
    got = {r["doc_id"] for r in leaks(d, b).collect()}
    assert holds and holds <= got


def test_broadcast_or_not_gives_the_same(spark, small):
    from tallyspark.llm.decontamination import leaks

    d, b = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "benchmark"))
    assert sorted(map(tuple, leaks(d, b).collect())) == sorted(map(tuple, leaks(d, b, broadcast_rows=0).collect()))


def test_decontamination_is_native(spark, small):
    from tallyspark.llm.decontamination import leaks

    plan = leaks(spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/benchmark.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


# quality


def labelled(seed, n):
    r = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in "river stone cloud light forest garden paper table window letter".split() for b in range(60)]
    bad = ["vile", "wretch", "fool", "filth"]
    docs, labels = [], []
    for i in range(n):
        w = [r.choice(vocabulary) for _ in range(r.randint(60, 120))]
        toxic, junk = r.random() < 0.15, r.random() < 0.15
        if toxic:
            for x in r.sample(bad, 3):
                w.insert(r.randrange(len(w)), x)
        if junk:
            w = [r.choice(["CLICK", "$$$", "BUY!!!", "###"]) for _ in w]
        docs.append((i, " ".join(w), "en", f"host{i % 7}"))
        labels.append((i, int(not junk), int(toxic)))
    return docs, labels


def test_held_out_accuracy(spark):
    from tallyspark.llm.quality import quality

    docs, labels = labelled(1, 1200)
    d = spark.createDataFrame([(*x, 1, "y") for x in docs], "doc_id long, text string, lang string, source string, junk int, half string")
    got = {r["doc_id"]: r["keep"] for r in quality(d, spark.createDataFrame(labels[:800], "doc_id long, quality int, toxic int")).collect()}
    test = labels[800:]
    right = sum(got[i] == (q == 1 and (t == 0 or False)) for i, q, t in test)
    assert right >= 0.97 * len(test)
    assert sum(not got[i] for i, q, t in test if q and not t) <= 0.01 * len(test)


def test_hosts_shrink_towards_the_global_rate(spark):
    from tallyspark.llm.quality import quality

    docs, labels = labelled(2, 900)
    r = random.Random(8)
    labels = [(i, q if r.random() > 0.2 else 1 - q, t) for i, q, t in labels]  # evidence that doesn't settle it alone
    docs = [(i, t, lang, "spam" if not labels[i][1] and i % 10 else s) for i, t, lang, s in docs]
    # An empty text tells little, so host and path do.
    docs += [(5000, "", "en", "spam"), (5001, None, "en", "never seen"), (5002, "", "en", "host1")] + [(9000, None, None, None)] * 2
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    out = quality(d, spark.createDataFrame([*labels, (9000, None, None), (77777, 0, 1)], "doc_id long, quality int, toxic int")).collect()
    got = {r["doc_id"]: r["p_junk"] for r in out}
    assert got[5000] > got[5001] > got[5002]
    assert len(out) == len(docs)


def test_every_stretch_of_a_long_text_counts():
    from tallyspark.llm.quality import lexicon_hits, statistics

    r = random.Random(3)
    fresh = lambda n: [f"w{r.randrange(10**6)}".encode() for _ in range(n)]
    looped = [b"one", b"two", b"three", b"four"] * 1000
    distinct = lambda w: statistics(b" ".join(w), w)[4]
    assert distinct(fresh(400) + looped) < 0.2 and distinct(looped[:400] + fresh(4000)) > 0.85
    assert abs(distinct(fresh(400)) - distinct(fresh(20_000))) < 0.01
    assert distinct([]) == 0 and distinct([b"x"] * 401) == 1 / 400
    lexicon = frozenset(f"bad{k}".encode() for k in range(60))
    sparse = fresh(20_000)
    for k in range(6):
        sparse[3000 * k + 7] = f"bad{k}".encode()
    dense = fresh(20_000)
    dense[15_000:15_060] = [f"BAD{k}!".encode() for k in range(60)]
    assert lexicon_hits(sparse, lexicon) == 1 and lexicon_hits(dense, lexicon) == 8 and lexicon_hits(fresh(500), lexicon) == 0


def test_posteriors_against_plain_formulas(spark):
    import math

    from tallyspark.llm.quality import evidence, fit, quality

    docs, labels = labelled(5, 500)
    r = random.Random(9)
    docs = [(i, t, r.choice(["en", "de", None]), r.choice(["h1", "h1", "h2", "h3", f"own{i}", None])) for i, t, _, _ in docs]
    labels = [(i, q if r.random() > 0.1 else 1 - q, t) for i, q, t in labels]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = fit(d.withColumnRenamed("doc_id", "id"), lab.withColumnRenamed("doc_id", "id"), 20_000, 2_000, 5, 8.0)
    rows = [x.asDict() for x in evidence(d, model).collect()]
    chance = lambda ratio, rate: 1 / (1 + math.exp(-max(-700, min(700, ratio + math.log(rate / (1 - rate))))))
    want = {}
    for head in ("junk", "toxic"):
        rate = model[head]
        own = {x["doc_id"]: chance(x[head], rate) for x in rows}
        host, path = {}, {}
        for x in rows:
            h = x["source"] or ""
            host.setdefault(h, []).append(own[x["doc_id"]])
            path.setdefault((h, x["lang"] or ""), []).append(own[x["doc_id"]])
        many = [(sum(v), len(v)) for v in host.values() if len(v) >= 2]
        n = sum(k for _, k in many)
        between = sum((s / k - rate) ** 2 * k for s, k in many) / n - rate * (1 - rate) * len(many) / n
        m = min(1000.0, max(5.0, rate * (1 - rate) / between - 1 if between > 1e-9 else 1000.0))
        for x in rows:
            h, c = x["source"] or "", own[x["doc_id"]]
            up = (m * rate + sum(host[h]) - c) / (m + len(host[h]) - 1)
            of = path[h, x["lang"] or ""]
            prior = max(1e-6, min(1 - 1e-6, (m * up + sum(of) - c) / (m + len(of) - 1)))
            want.setdefault(x["doc_id"], {})[head] = chance(x[head], prior)
    got = quality(d, lab).collect()
    assert len(got) == len(docs)
    for x in got:
        w = want[x["doc_id"]]
        assert abs(x["p_junk"] - w["junk"]) < 1e-3 and abs(x["p_toxic"] - w["toxic"]) < 1e-3
        assert x["keep"] == (1 - (1 - x["p_junk"]) * (1 - x["p_toxic"]) < 0.5)


def test_statistics_and_ratios_against_plain_counts(spark):
    import math

    from tallyspark.llm.quality import BORDERS, fit

    docs, labels = labelled(6, 200)
    d = spark.createDataFrame(docs, "id long, text string, lang string, source string")
    model = fit(d, spark.createDataFrame(labels, "id long, quality int, toxic int"), 20_000, 2_000, 5, 8.0)
    junk = {i: q == 0 for i, q, _ in labels}
    bad, n = sum(junk.values()), len(docs)
    plain = {
        "words": lambda t: len(t.split()),
        "upper": lambda t: sum("A" <= c <= "Z" for c in t) / len(t),
        "signs": lambda t: sum(c in "!\"#$%&()*+/:;<=>?@[\\]^_`{|}~" for c in t) / len(t),
        "repeats": lambda t: sum(a == b for a, b in zip(t.split(), t.split()[1:])) / len(t.split()),
        "distinct": lambda t: len(set(t.split())) / len(t.split()),
        "length": lambda t: len(t) / len(t.split()),
    }
    for f, (name, borders) in enumerate(BORDERS.items()):
        at = {i: sum(plain[name](t) >= b for b in borders) for i, t, _, _ in docs}
        for k in range(len(borders) + 1):
            x, y = sum(at[i] == k and junk[i] for i in at), sum(at[i] == k and not junk[i] for i in at)
            share = bad / n
            assert math.isclose(model["shapes"][f][k], math.log((x + share) / share) - math.log((y + 1 - share) / (1 - share)), abs_tol=1e-9)


# the pipeline


@pytest.fixture(scope="module")
def pipeline():
    return pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def stages(spark, small, pipeline):
    """What each stage got and gave."""
    from tallyspark.llm.common import written

    docs = spark.read.parquet(f"{small}/documents.parquet")
    docs = docs.unionByName(docs.where("doc_id < 5").withColumn("doc_id", F.lit(None).cast("long")))
    out = []
    for name, stage in pipeline.STAGES:
        after = written(stage(spark, docs, small), f"test-{name}")
        out.append((name, docs, after))
        docs = after
    return out


def key(df):
    return sorted(map(tuple, df.select("doc_id", "text", "lang", "source").collect()), key=repr)


def test_columns_and_order_of_stages(stages):
    assert [s[0] for s in stages] == ["quality_classifier", "line_dedup", "ngram_jaccard_join", "benchmark_decontamination", "best_fit_packing"]
    for _, before, after in stages[:-1]:
        assert after.columns == ["doc_id", "text", "lang", "source", "n_chars"] and after.schema == before.schema
        assert 0 < after.count() <= before.count()


def test_rejected_documents_go(spark, small, stages):
    from tallyspark.llm.quality import quality

    _, before, after = stages[0]
    rows = before.select("*", F.monotonically_increasing_id().alias("row"))
    verdict = quality(rows, spark.read.parquet(f"{small}/labels.parquet"), carry=("row",)).where("keep").select("row")
    assert key(after) == key(rows.join(verdict, "row")) and after.count() < before.count()


def test_repeated_lines_go(stages):
    from test_llm_operators import plain_lines, sha

    _, before, after = stages[1]
    known = [(r["doc_id"], r["text"]) for r in before.where("doc_id is not null").collect()]
    assert sorted((r["doc_id"], sha(r["text"])) for r in after.where("doc_id is not null").collect()) == [(i, s) for i, _, _, s in plain_lines(known)]
    assert all(r["n_chars"] == len(r["text"]) for r in after.collect())


def test_one_of_each_group_stays(stages):
    _, before, after = stages[2]
    known = [(r["doc_id"], r["text"]) for r in before.where("doc_id is not null").collect()]
    assert sorted(r["doc_id"] for r in after.where("doc_id is not null").collect()) == sorted(i for i, _, c in plain_components(known) if i == c)
    assert before.where("doc_id is null").count() == after.where("doc_id is null").count()


def test_contaminated_documents_go(spark, small, stages):
    _, before, after = stages[3]
    items = [" ".join(words_of(r["text"])) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    holds = lambda t: any(f" {x} " in f" {' '.join(words_of(t))} " for x in items)
    assert not any(holds(r["text"]) for r in after.where("doc_id is not null").collect())
    assert after.count() >= sum(not holds(r["text"]) for r in before.collect()) - 3


def test_everything_left_is_packed(stages):
    _, before, after = stages[4]
    assert sorted(set(r["doc_id"] for r in after.collect() if r["doc_id"] is not None)) == sorted(r["doc_id"] for r in before.where("doc_id is not null").collect())
    assert after.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0


def test_run_is_the_stages_in_order(spark, small, pipeline, stages, tmp_path, monkeypatch):
    from tallyspark import session

    monkeypatch.setattr(session, "shared_dir", lambda _: f"file://{tmp_path}")
    out = pipeline.run(spark, small)
    # Only the stages' results are left in the shared folder.
    assert sorted(p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir() if p.is_dir()) == sorted(name for name, _ in pipeline.STAGES)
    ids = spark.read.parquet(f"{small}/documents.parquet").select("doc_id").distinct()
    assert out.select("doc_id").distinct().join(ids, "doc_id").count() == out.select("doc_id").distinct().count() > 0
    assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0
