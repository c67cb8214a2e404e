"""Wrapper induction on invented sites whose article text is known."""

import collections
import random

from wayfold.llm import wrapper

PAGE = """<!DOCTYPE html><html><head><title>t{i}</title><script>if (a < b) x("</p>")</script></head><body>
<nav><ul><li><a href="/a">Home{i}</a><li><a href="/b">News</a></ul></nav><div class="box top">Buy our thing today</div>
<div id="x{kind}"><h1>Title {i}</h1>{body}<div class="c">This line is the same on every page</div></div>
<form><p>Search <input name=q></form><div class="comments"><p>Reader {i} says no</p></div><footer>&copy; {i}</footer></body></html>"""


def site(n):
    rng = random.Random(3)
    pages, wanted = [], {}
    for i in range(n):
        blocks = [" ".join(rng.choice(["alpha", "beta", "R&amp;D", "x&lt;y", "caf&eacute;"]) for _ in range(9)) + f" {i} {j}" for j in range(1 + i % 4)]
        body = "".join(f"<p>{b}" + ("</p>" if j % 2 else "") for j, b in enumerate(blocks))
        pages.append((i, f"https://site.example/{i}", PAGE.format(i=i, kind="", body=body)))
        wanted[i] = "\n\n".join([f"Title {i}"] + [b.replace("&amp;", "&").replace("&lt;", "<").replace("&eacute;", "é") for b in blocks])
    return pages, wanted


def test_constant_slots_go_and_varying_slots_stay(spark):
    pages, wanted = site(12)
    found = {r["page_id"]: r["text"] for r in wrapper.extract(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)).collect()}
    assert found == wanted


def test_copies_of_one_page_are_no_template(spark):
    page = "<body><div><h1>Only one</h1><p>Its text</div></body>"
    rows = [(i, "http://copies.example/", page) for i in range(20)] + [(50, None, None), (None, "x", ""), (51, "http://y.example", "<p>a < b <b>bold</i> &amp <br>c")]
    found = {r["page_id"]: (r["text"], r["n_chars"]) for r in wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found[3] == ("Only one\n\nIts text", 18)
    assert found[50] == ("", 0) and found[None] == ("", 0)
    assert found[51] == ("a < b bold & c", 14)
    assert wrapper.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_simple_tree_matching_equals_the_plain_recursion():
    def brute(a, b):
        if a[0] != b[0]:
            return 0
        m = [[0] * (len(b[1]) + 1) for _ in range(len(a[1]) + 1)]
        for i, c in enumerate(a[1]):
            for j, d in enumerate(b[1]):
                m[i + 1][j + 1] = max(m[i][j + 1], m[i + 1][j], m[i][j] + brute(c, d))
        return 1 + m[-1][-1]

    rng = random.Random(1)

    def tree(depth):
        return [rng.choice("ab"), [tree(depth - 1) for _ in range(rng.randint(0, 3))] if depth else []]

    def labels(t):
        return collections.Counter([t[0]]) + sum((labels(c) for c in t[1]), collections.Counter())

    for _ in range(200):
        a, b = ["r", [tree(2), tree(2)]], ["r", [tree(2), tree(2)]]
        size = wrapper._match(a, b, {})[0]
        same = [c[0] for c in a[1]] == [c[0] for c in b[1]]
        assert size == brute(a, b) or (same and size <= brute(a, b))
        assert labels(wrapper.merge(a, b)) >= labels(a)


def test_deep_and_broken_pages_end():
    wrapper.main_text(wrapper.aligned("<div>" * 50_000 + "x", None, {}))
    assert wrapper.main_text(wrapper.aligned("<p>" * 20_000 + "x", None, {})) == "x"
    assert wrapper.main_text(wrapper.aligned('<a href="x>y">z</a><script>never closed', None, {})) == "z"
