"""HTML extraction."""

import json
import random

from chatmill.llm import wrapper as wr


def test_simple_tree_matching_counts_aligned_nodes():
    a = wr.parse("<div><p>1</p><ul><li>x</li></ul><p>2</p></div>")
    b = wr.parse("<div><p>1</p><p>2</p></div>")
    pairs = []
    assert wr.match(a, b, pairs) == 4 and len(pairs) == 4
    assert wr.match(a, wr.parse("<span></span>")) == 1


def test_text_of_a_page_without_furniture():
    page = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body class="no-js">
    <header><a href="/">Home</a></header><nav>menu</nav><div class="ad-box">buy</div><div id="cookie-notice">ok?</div>
    <main><h1>A &amp; B</h1><p>one <b>two</b>three<br>four<p>five &eacute;&#33;<script>x("</p>")</script>
    <!-- <p>no</p> --><form><input>name</form><aside>side</aside><ul><li>six<li>seven</ul><table><tr><td>8<td>9</table></main>
    <section class="comments"><article>me too</article></section><footer>&copy; x</footer></body></html>"""
    assert wr.read(page, None) == "A & B one twothree four five é! six seven 8 9"


def test_odd_pages():
    assert [wr.read(x, None) for x in (None, "", "   ", "plain", "<p>a", "a < b", "<p>x</p", "<<p>>y")] == ["", "", "", "plain", "a", "a < b", "x</p", "< >y"]
    deep = "<div>" * 900 + "deep" + "</div>" * 900
    assert wr.read(deep, None) == "deep"
    assert wr.read("<p>" + "long " * 200_000 + "</p>", None) == " ".join(["long"] * 200_000)


def test_pages_of_any_depth(spark, rows):
    """100,000 nested elements read, and thousands aligned with others and as pages of a job."""
    deep = lambda k, n=4000: "<html><body>" + "<div>" * n + f"page {k} says {'so ' * (k + 1)}" + "</div>" * n + "</body></html>"
    assert wr.read(deep(0, 100_000), None) == "page 0 says so"
    other = "<html><body>" + "<div><p>a</p>" * 3000 + "<i>text</i>" + "</div>" * 3000
    assert wr.match(wr.parse(other), wr.parse(other.replace("<i>", "<b>"))) == 6003
    found = wr.induce([deep(k) for k in range(5)] + [other])
    assert found is None or wr.read(deep(3), found) == "page 3 says so so so so"
    pages = rows([(k, f"http://h/{k}", deep(k)) for k in range(6)], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in wr.extract(pages).collect()} == {k: f"page {k} says " + " ".join(["so"] * (k + 1)) for k in range(6)}


def test_scores_equal_the_recursive_definition():
    rng = random.Random(3)

    def tree(depth):
        kids = "".join(tree(depth - 1) for _ in range(rng.randrange(0, 4))) if depth else "x"
        tag = rng.choice(["div", "section", "b"])
        return f"<{tag}>{kids}</{tag}>"

    def plain(a, b):
        if a.label != b.label:
            return 0
        xs, ys = a.elements(), b.elements()
        best = [[0] * (len(ys) + 1) for _ in range(len(xs) + 1)]
        for i, x in enumerate(xs):
            for j, y in enumerate(ys):
                best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + plain(x, y))
        return 1 + best[-1][-1]

    for _ in range(60):
        a, b = wr.parse(tree(4)), wr.parse(tree(4))
        assert wr.match(a, b) == plain(a, b)


def layout(k, title="T"):
    body = "".join(f"<p>{w}{k} varies on page {k}, paragraph {w}, at some length.</p>" for w in ("un", "deux", "trois")[: 1 + k % 3])
    return (f'<html><body><div class="top">Site name<a href="/">link {k}</a></div><div class="box"><div class="story">'
            f"<h2>{title} {k}</h2>{body}<div>Printed with permission of the owners.</div></div></div><div>Bottom line {k}</div></body></html>")  # fmt: skip


def test_induced_wrapper_finds_slot_and_template():
    pages = [layout(k) for k in range(10)]
    found = wr.induce(pages + pages[:3])
    assert found["path"][-1] == ["div.story", 0] and found["template"] == ["Printed with permission of the owners."]
    assert wr.read(layout(31), found) == "T 31 un31 varies on page 31, paragraph un, at some length. deux31 varies on page 31, paragraph deux, at some length."
    assert wr.read("<p>another layout</p>", found) == "another layout"


def test_too_few_different_pages_give_no_wrapper():
    assert wr.induce([layout(1)] * 50) is None and wr.induce([]) is None


def test_extract_rows(spark, rows):
    data = [(k, "http://Host.example/a?b", layout(k)) for k in range(12)]
    data += [(12, "https://u@other.example:80/x", "<article>solo &lt;page&gt;</article>"), (13, None, "<p>no url</p>"), (14, "http://host.example", None)]
    data += [(None, "x", "<p>null id</p>"), (3, "http://host.example/", layout(3)), (3, "http://host.example/", layout(3))]
    given = rows(data, "page_id long, url string, html string").selectExpr("*", "1 AS host", "'w' AS wrapper", "'t' AS text").repartition(5)
    got = {(r["page_id"], r["url"]): (r["text"], r["n_chars"]) for r in wr.extract(given).collect()}
    assert wr.extract(given).count() == len(data)
    assert got[(5, "http://Host.example/a?b")][0].startswith("T 5 un5 varies") and "permission" not in got[(5, "http://Host.example/a?b")][0]
    assert got[(12, "https://u@other.example:80/x")] == ("solo <page>", 11) and got[(13, None)] == ("no url", 6)
    assert got[(14, "http://host.example")] == ("", 0) and got[(None, "x")] == ("null id", 7)
    assert wr.extract(given.where("false")).collect() == []


def test_all_children_are_aligned():
    def page(k):
        links = "".join(f"<section>Link {j} of all</section>\n" for j in range(90))
        body = "".join(f"<p>Paragraph {j} of page {k} varies.</p>\n" for j in range(60 + k))
        return f'<body><div class="lead">Teaser {k} {k}</div>{links}<div class="text">{body}<div>All rights with the owners.</div></div></body>'

    found = wr.induce([page(k) for k in range(8)])
    assert found["path"][-1] == ["div.text", 0] and found["template"] == ["All rights with the owners."]
    assert wr.read(page(20), found).endswith("Paragraph 79 of page 20 varies.")


def test_halved_tables_give_the_same_score(monkeypatch):
    rng = random.Random(2)
    trees = ["".join(rng.choice(("<p>a</p>", "<h2>b</h2>", "<ul><li>c<li>d</ul>", "<ul><li>c</ul>")) for _ in range(30)) for _ in range(20)]
    want = [wr.match(wr.parse(a), wr.parse(b)) for a, b in zip(trees, trees[1:])]
    monkeypatch.setattr(wr, "CELLS", 8)
    assert [wr.match(wr.parse(a), wr.parse(b)) for a, b in zip(trees, trees[1:])] == want


def test_long_notice_does_not_make_pages_copies():
    notice = "This text may be printed only with the written permission of its owners. " * 20
    pages = [f'<body><div class="box"><h2>T {k}</h2><p>Short paragraph {k} on page {k}.</p><div>{notice}</div></div></body>' for k in range(8)]
    assert wr.read(pages[5], wr.induce(pages)) == "T 5 Short paragraph 5 on page 5."


def test_names_that_only_hold_a_furniture_word():
    text = "The article itself, at some length. " * 5
    for name in ("content no-sidebar", "post has-comments", "story share", "col-2 with-widgets"):
        for page in (f'<div class="{name}"><p>{text}</div><div class="ad">buy</div>', f'<p>Before</p><div id="{name}">{text}</div>'):
            got = wr.read(page, None)
            assert got.endswith(text.strip()) and "buy" not in got
    furniture = ('class="ad"', 'class="x ad-box"', 'id="cookie-notice"', 'class="post-comments"', 'role="navigation"', 'aria-label="Main menu"')
    for name in furniture:
        assert wr.read(f"<p>{text}</p><div {name}>away</div>", None) == text.strip()
    assert wr.read(f'<p>short</p><div class="comments">{text}</div>', None) == "short"


def test_raw_elements_without_a_close():
    assert wr.read('<p>a</p><svg class="i" /><p>b</p><iframe src="x"/><p>c</p>', None) == "a b c"
    assert wr.read("<p>a</p><svg><p>b</p><iframe src=x><p>c</p><svg><p>d</p>", None) == "a b c d"
    assert wr.read("<p>a</p><SCRIPT>if (x) y('</scripts>')</Script ><p>b</p><style>p {} <p>c</p>", None) == "a b"
    turkish = "<p>" + "\u0130" * 30 + "</p>"
    assert wr.read(turkish + "<script>x</script><p>one</p><style>y</style><p>two</p>", None) == "\u0130" * 30 + " one two"


def test_layouts_of_one_host_and_long_pages(spark, rows):
    def page(k):
        kind, words = ("story", "recipe", "gallery")[k % 3], "word " * 10
        note = f"Notice of the {kind} desk."
        return f'<body><div class="{kind}"><div class="{kind}-text"><p>Page {k} {words}{k}</p><p>{note}</p></div></div><div class="end">x {k}</div></body>'

    data = [(k, "http://h.example/", page(k)) for k in range(90)]
    data += [(100 + k, "http://long.example/", f'<body><div class="a"><p>{k} text</p><p>{k} more</p><div>Same.</div></div></body>' + " " * 300_000) for k in range(5)]
    got = {r["page_id"]: r["text"] for r in wr.extract(rows(data, "page_id long, url string, html string")).collect()}
    assert all("Notice" not in got[k] and got[k].startswith(f"Page {k} word") for k in range(90))
    assert [got[100 + k] for k in range(5)] == [f"{k} text {k} more" for k in range(5)]


def test_short_articles_beside_long_furniture():
    text = "Long text that is not the article. " * 5
    for name in ("ad", "sidebar", "comments"):
        assert wr.read(f'<div class="{name}">{text}</div><article>short</article>', None) == "short"
    assert wr.read(f'<div class="ad">{text}</div><p>short</p>', None) == "short"


def test_path_comes_from_all_pages(spark, rows):
    """24 short pages with the smallest ids have more text among their links than in their stories; most pages have not."""

    def page(k, site):
        links, story = (30, 1) if k < 24 else (2, 20)
        words = lambda what, n: "".join(f"<p>{what} {j} of {site} page {k}</p>" for j in range(n))
        return (f'<html><body><div class="links">{words("Link", links)}</div><div class="story">{words("Line", story)}<p>Printed by {site}.</p></div>'
                f"</body></html>{' ' * 270_000 * (site == 'long' and k >= 24)}")  # fmt: skip

    counts = {"many": 400, "long": 60}
    data = [(k, f"http://{site}/{k}", page(k, site)) for site, n in counts.items() for k in range(n)]
    data += data[:24] * 30  # copies count once
    given = rows(data, "page_id long, url string, html string").repartition(7)
    learned = [json.loads(r.wrapper)["path"] for r in wr.wrappers(given).collect()]
    assert learned == [[["html", 0], ["body", 0], ["div.story", 0]]] * 4
    got = {(r.url, r.text) for r in wr.extract(given).collect()}
    lines = lambda k, site: " ".join(f"Line {j} of {site} page {k}" for j in range(1 if k < 24 else 20))
    assert got == {(f"http://{site}/{k}", lines(k, site)) for site, n in counts.items() for k in range(n)}


def test_wrappers_of_a_table_are_those_of_its_pages(spark, rows):
    rng = random.Random(5)

    def page(k, host):
        notes = "".join(f"<div>Note {j} of {host}</div>" for j in range(2) if rng.random() < 0.95)
        body = "".join(f"<p>Text {j} of page {k} {'so ' * rng.randrange(20, 30)}</p>" for j in range(rng.randrange(3, 9)))
        teasers = "".join(f"<section><p>Teaser {rng.random()}</p></section>" for _ in range(rng.randrange(4)))
        kind = rng.choice(("a", "b"))
        return f'<body><div>Top of {host}</div>{teasers}<div class="{kind}"><div>{body}{notes}</div></div>{teasers}</body>'

    pages = {host: [page(k, host) for k in range(n)] for host, n in (("one", 90), ("two", 40), ("three", 6), ("four", 3))}
    data = [(None, f"http://{host}/", html) for host, all_ in pages.items() for html in all_ + all_[:5]]
    got = {(r.host, r.layout): json.loads(r.wrapper) for r in wr.wrappers(rows(data, "page_id long, url string, html string").repartition(6)).collect()}
    want = {}
    for host, all_ in pages.items():
        layouts = {html: wr.profile(wr.parse(html))[0] for html in all_}
        for layout in {0, *layouts.values()}:
            found = wr.induce([html for html in all_ if layout in (0, layouts[html])])
            if found:
                want[host, layout] = {"path": found["path"], "template": sorted(map(wr._hash, found["template"]))}
    assert got == want and len(want) > 6
    assert all("div.a" in str(x) or "div.b" in str(x) for (_, layout), x in got.items() if layout)


def test_template_texts_are_known_by_their_hashes():
    page = '<body><div class="x"><p>Own  text</p><p>Same\n text</p></div></body>'
    for template in (["Same text"], [wr._hash("Same text")]):
        assert wr.read(page, {"path": [["body", 0], ["div.x", 0]], "template": template}) == "Own text"
