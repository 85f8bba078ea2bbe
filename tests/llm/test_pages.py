"""Main text of pages: by hand on the table's own markup, and on odd pages."""

import html
import random
import re
import time

from corpusforge.llm import entries, html_template


def by_hand(page):
    inner = re.search(r"<article>(.*)</article>", page, re.S).group(1)
    blocks = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", inner).replace("<br>", " "))
    texts = [" ".join(html.unescape(b).split()) for b in blocks]
    return "\n".join(t for t in texts if t)


def test_main_text_of_the_table(spark, sf):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = {r.page_id: r for r in entries.op6_main_text(spark, sf).collect()}
    assert got.keys() == pages.keys()
    for k, page in pages.items():
        assert got[k].text == by_hand(page) and got[k].n_chars == len(got[k].text)


def page(k, body):
    return (
        f"<html><head><title>t {k}</title><script>if (a<b) x('</p>')</script></head><body><div class='topbar menu'>Home News</div>"
        f"<div id='wrap'><div class='post-text'>{body}<div class='comments'><p>first! {k}</p></div></div><div class='sidebar'>side {k}</div></div>"
        f"<form><p>mail</p></form><footer>site {k}</footer></body></html>"
    )


def test_slots_without_an_article_element(spark):
    rows = [(k, f"http://a.example/{k}", page(k, f"<p>Long text number {k} of the page &amp; more,<br>with  space</p><p>second {'word ' * k}</p>")) for k in range(1, 9)]
    got = {r.page_id: r.text for r in html_template.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "Long text number 3 of the page & more, with space\nsecond word word word"


def random_host(r, host, pages):
    """Pages whose elements and names are random tokens of the host: (url, page, text)."""
    name = lambda: "x" + "".join(r.choice("bcdfghjklmnpqrstvwxz") for _ in range(6))
    top, menu, item, wrap, body, head, para, side, note, foot = (f"{name()}-{name()}" for _ in range(10))
    cls = {t: f' class="{name()} {name()}"' for t in (top, menu, wrap, body, side, note, foot)}
    word = lambda: "".join(r.choice("aeioulmnrst") for _ in range(r.randint(2, 8)))
    some = lambda n: " ".join(word() for _ in range(n))
    adverts = [some(6) for _ in range(2)]
    box = some(5)
    for k in range(pages):
        title, paragraphs = some(5), [some(r.randint(10, 60)) for _ in range(r.randint(1, 6))]
        inner = f"<{head}>{title}</{head}>" + "".join(f"<{para}>{p}</{para}>" for p in paragraphs[:1]) + f"<{para}>{box}</{para}>" + "".join(f"<{para}>{p}</{para}>" for p in paragraphs[1:])
        if k % 4 == 0:  # a part of one page, with a name that a word list would take for boilerplate
            inner += '<section id="related-work"><p class="form-of-rule">rule of the form</p></section>'
            paragraphs.append("rule of the form")
        yield f"http://{host}/{k}", (
            f"<html><body><{top}{cls[top]}>{host} {adverts[k % 2]}</{top}><{menu}{cls[menu]}>" + "".join(f"<{item}>{w}</{item}>" for w in ("home", "news", "mail")) + f"</{menu}>"
            f"<{wrap}{cls[wrap]}><{body}{cls[body]}>{inner}</{body}><{side}{cls[side]}>{some(3)}</{side}></{wrap}>"
            f"<{note}{cls[note]}>we use small files</{note}><{foot}{cls[foot]}>about {host}</{foot}></body></html>"
        ), "\n".join([title, *paragraphs])


def test_classes_decide_on_pages_with_random_elements_and_names(spark):
    r = random.Random(21)
    made = [row for k in range(4) for row in random_host(r, f"host{k}.example", 20)]
    made += made[:1] * 30  # copies of one page change nothing
    df = spark.createDataFrame([(k, u, p) for k, (u, p, _) in enumerate(made)], "page_id long, url string, html string")
    got = {x.page_id: x.text for x in html_template.main_text(df).collect()}
    assert got == {k: t for k, (_, _, t) in enumerate(made)}
    # Without the classes nothing is left that could decide.
    assert all(html_template.article(p) != t for _, p, t in made)


def extracted(spark, host, bodies):
    rows = [(k, f"http://{host}/{k}", f"<html><body>{b}</body></html>") for k, b in enumerate(bodies)]
    return {x.page_id: x.text for x in html_template.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def varied(n, salt=0):
    r = random.Random(n * 1000 + salt)
    return " ".join("".join(r.choice("aeioulmnrst") for _ in range(r.randint(2, 8))) for _ in range(n))


def test_closing_sections_stay(spark):
    for closing in (1, 2, 3):  # paragraphs of the last section: one, or a number that differs between pages
        number = lambda k, c=closing: 1 + k % c
        texts = {k: (varied(60, k), [f"CONCLUSION {varied(4, 50 + k + j)}" for j in range(number(k))]) for k in range(12)}
        bodies = [
            f"<div class=menu>Home News</div><div class=story><div class=text><p>{t}</p></div><div class=ending>" + "".join(f"<p>{c}</p>" for c in ends) + "</div></div><div class=foot>about</div>"
            for t, ends in texts.values()
        ]
        want = {k: "\n".join([t, *ends]) for k, (t, ends) in texts.items()}
        assert extracted(spark, "e.example", bodies) == want
        # The same without an element around both, and with a box beside them.
        bare = [b.replace("<div class=story>", "").replace("</div></div>", "</div>") for b in bodies]
        assert extracted(spark, "b.example", bare) == want
        boxed = [b.replace("</div></div><div class=foot>", f"</div><div class=box>{varied(3, k)}</div></div><div class=foot>") for k, b in enumerate(bodies)]
        assert extracted(spark, "x.example", boxed) == want


def test_pages_in_a_form(spark):
    texts = [varied(70, k) for k in range(12)]
    inner = [f"<div class=menu>Home News</div><div class=post><h2>{t[:20]}</h2><p>{t}</p></div><select><option>pick one</select><div class=foot>about</div>" for t in texts]
    whole = [f"<form action=/ method=post><input type=hidden value=x>{b}</form>" for b in inner]
    assert extracted(spark, "f.example", whole) == {k: f"{t[:20].strip()}\n{t}" for k, t in enumerate(texts)}
    # Without a template: the body is all there is, and the form holds it.
    alone = html_template.article(f"<body>{whole[0]}</body>")
    assert texts[0] in alone and "pick one" not in alone
    # A form beside the text stays apart, also one that is larger than a short article.
    assert html_template.article(f"<body><p>{texts[0]}</p><form><p>your mail</p></form></body>") == texts[0]
    assert html_template.article(f"<body><article><p>short</p></article><form><p>{texts[0]}</p></form></body>") == "short"


def test_lists_of_comments_go(spark):
    texts = [varied(70, k) for k in range(12)]
    for outer, one in (("<div class=remarks>{}</div>", "<div class=who><b>{}</b><p>{}</p></div>"), ("<section id=comments>{}</section>", "<p>{}: {}</p>"), ("<div class=more>{}</div>", "<p><a href=x>{} {}</a></p>")):
        bodies = [
            f"<div class=menu>Home News</div><div class=story><div class=text><p>{t}</p></div>" + outer.format("".join(one.format(varied(1, k + j), varied(3, 9 * k + j)) for j in range(1 + k % 3))) + "</div><div class=foot>about</div>"
            for k, t in enumerate(texts)
        ]
        assert extracted(spark, "c.example", bodies) == dict(enumerate(texts))
    # A page that is all comments by name keeps them: nothing else is there.
    assert html_template.article(f"<body><div class=comments><p>{texts[0]}</p></div></body>") == texts[0]


def test_near_copies_on_a_host_keep_their_common_paragraphs(spark):
    common = "".join(f"<p>paragraph {k} that all of the near copies share</p>" for k in range(5))
    rows = [(k, f"http://n.example/{k}", f"<body><div class=a>menu</div><div class=b>{common}<p>own {k}</p></div></body>") for k in range(12)]
    got = html_template.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all("paragraph 4 that all" in x.text and f"own {x.page_id}" in x.text for x in got)


def test_hostile_pages_take_linear_time():
    for page_ in ('<p a="' * 100_000, "<div>" * 50_000 + "x", "<b>" * 20_000 + "<p>x" * 20_000, '<p a="> ' * 50_001, "<" * 200_000, "<li>x" * 50_000, "<i>" * 20_000 + "</u>" * 20_000):
        began = time.process_time()
        html_template.article(page_)
        html_template.page_tokens(page_)
        assert time.process_time() - began < 10


def test_unclosed_quotes_and_depth_lose_no_text():
    assert html_template.article('<article><p a="x>one</p><p>two</p></article>') == "one\ntwo"
    assert html_template.article("<div>" * 3000 + "<article><p>deep</p></article>") == "deep"


def test_odd_pages(spark):
    rows = [(1, None, None), (2, "", ""), (3, "x", "only text"), (4, "http://h/", "<p>a<p>b < c &lt;d&gt;"), (5, "http://h/", "<article><p>one</p></article>"), (5, "http://h/", "<article><p>one</p></article>"), (6, "http://h/2", "<div" * 300 + "<p>deep"), (7, "http://q/", "<!-- <p>x</p> --><b>bold</b> text <style>p{}</style>")]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, text string")
    got = [(r.page_id, r.text) for r in html_template.main_text(df).collect()]
    assert len(got) == len(rows)
    texts = dict(got)
    assert texts[1] == texts[2] == "" and texts[3] == "only text" and texts[5] == "one" and texts[7] == "bold text"
    assert texts[4] == "a\nb < c <d>"
    assert html_template.main_text(df.limit(0)).count() == 0


def test_templates_nest_and_broadcast_bound_gives_the_same(spark, sf, monkeypatch):
    want = {r.page_id: r.text for r in entries.op6_main_text(spark, sf).collect()}
    monkeypatch.setattr(html_template, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(html_template, "COPIES", -1)
    assert {r.page_id: r.text for r in entries.op6_main_text(spark, sf).collect()} == want
