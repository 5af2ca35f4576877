"""Operators on pages and captures."""

import datetime as dt
import math
import random
import time
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from poolwise.llm import revisits, site_tree
from poolwise.llm.site_tree import main_text


def test_main_text():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class=x><header>Top</header><nav><ul><li>A<li>B</ul></nav>
    <div class="ad">Buy</div><aside>Side</aside><form>Name <input></form><div id="cookie-notice">We use</div>
    <article><h1>One &amp; two</h1><p><b>First   line<br>goes on<p>Second <i>in</i>line &eacute;&#33;<script>var a="</p>"</script></p>
    <div class="comments"><p>Me too</p></div><!-- no --><p>a &lt; b<table><tr><td>x<td>y</table></article><footer>&copy;</footer>"""
    assert main_text(page) == "One & two\nFirst line goes on\nSecond inline é!\na < b\nx\ny"
    assert main_text(None) == main_text("") == main_text("<p>") == ""
    assert main_text("bare text & more") == "bare text & more"
    assert main_text("<p class='shadow'>kept<div class=header>gone</div>") == "kept"
    assert main_text("<div><p>" * 300 + "deep") == "deep"


def test_nothing_but_boilerplate_is_lost():
    assert main_text("<p>" + "12 x İ" * 12 + "</p><script>x</script><p>kept</p><p>also</p>").endswith("İ\nkept\nalso")
    assert main_text("<p title=it's>Hello") == "Hello" and main_text("<p title=\"oops>Hello</p><p>there") == "Hello\nthere"
    assert main_text("<div class='search-results'>a</div><p class='post-header'>b</p><div class='related-work'>c</div>") == "a\nb\nc"
    assert main_text("<article><p class=form>a</p><div class=header>b</div><div class='ad x'>c</div><p>d<svg><text>e</text></svg> f</article>") == "a\nb\nd f"
    assert main_text("<svg><p>a<noscript><p>b <button>c") == "a\nb c" and main_text("a<!-- b") == main_text("a<script>b") == "a"


@pytest.mark.parametrize("source", ["<a " * 350_000 + "'", "<div>" * 100_000 + "x", "<b>" * 40_000 + "<div>" * 40_000 + "</b>" * 40_000 + "x", "<i>" * 80_000 + "<p>x" * 20_000, "<svg><p>x" * 20_000, "<" * 500_000, '<a x="\'' * 100_000, "<a =" * 200_000])
def test_reading_takes_linear_time(source):
    began = time.time()
    main_text(source)
    assert time.time() - began < 15


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int").repartition(4)


def test_unnamed_boilerplate_is_learned(spark):
    rng = random.Random(2)
    words = [f"w{k}" for k in range(500)]
    menu = ["Home News Sport", "Imprint Contact", "All rights"]
    rows, expected = [], {}
    for k in range(60):
        body = [" ".join(rng.choices(words, k=12)) for _ in range(3)]
        expected[k] = "\n".join(body)
        blocks = "".join(f"<p>{b}</p>" for b in body)
        rows.append((k, f"http://www.site.org/{k}", f"<html><body><div class=top7>{menu[0]}</div><div class=text>{blocks}</div><div class=low>{menu[k % 3]}</div></body></html>"))
    got = {r["page_id"]: r["text"] for r in site_tree.extract_main_text(pages_of(spark, rows)).collect()}
    assert got == expected


def test_unnamed_boilerplate_of_small_hosts(spark):
    rng = random.Random(7)
    words = [f"w{k}" for k in range(500)]
    menu = ["Home News Sport", "Imprint Contact", "All rights"]
    rows, expected = [], {}
    for host in range(42):
        for _ in range(1 + host % 7):
            k = len(rows)
            expected[k] = "\n".join(" ".join(rng.choices(words, k=12)) for _ in range(3))
            blocks = "".join(f"<p>{b}</p>" for b in expected[k].split("\n"))
            rows.append((k, f"http://h{host}.org/{k}", f"<html><body><div class=top7>{menu[0]}</div><div class=text>{blocks}</div><div class=low>{menu[k % 3]}</div></body></html>"))
    got = {r["page_id"]: r["text"] for r in site_tree.extract_main_text(pages_of(spark, rows)).collect()}
    assert got == expected


def random_tree(rng, depth=0):
    """A block element as (tag, class, children); children are texts of paragraphs or elements."""
    out = []
    for _ in range(rng.randint(1, 3)):
        if depth < 3 and rng.random() < 0.5:
            out.append(random_tree(rng, depth + 1))
        else:
            out.append(rng.choice(["Home", "All rights kept", "Terms", *(f"line {k}" for k in range(12))]) if rng.random() < 0.6 else f"own {rng.random()}")
    return ("div", rng.choice(["", "ka", "kb"]), out)


def rendered(tree):
    tag, name, children = tree
    return f"<{tag}{f' class={name}' if name else ''}>" + "".join(f"<p>{c}</p>" if isinstance(c, str) else rendered(c) for c in children) + f"</{tag}>"


def plain_texts(pages, threshold=site_tree.THRESHOLD):
    """Main texts by style trees that are computed from their definition, of (host, tree)."""
    nodes = []  # per page: {branch: (styles, [texts])}, with branches as paths of names

    def visit(tree, path, into):
        path = (*path, f"{tree[0]}.{tree[1]}")
        styles, _ = into.setdefault(path, (set(), []))
        styles.add(tuple("p" if isinstance(c, str) else f"{c[0]}.{c[1]}" for c in tree[2]))
        for c in tree[2]:
            if isinstance(c, str):
                into.setdefault((*path, "p"), ({()}, []))[1].append(c)
            else:
                visit(c, path, into)

    everywhere = Counter()
    for _, tree in pages:
        into = {}
        visit(tree, (), into)
        nodes.append(into)
        everywhere.update(t for _, texts in into.values() for t in set(texts))
    dropped = defaultdict(set)
    for host in {h for h, _ in pages}:
        mine = [n for n, (h, _) in zip(nodes, pages, strict=True) if h == host]
        branches = {b for n in mine for b in n}
        importance, chars = {}, Counter()
        for b in branches:
            m = sum(b in n for n in mine)
            styles = Counter(s for n in mine if b in n for s in n[b][0])
            total = sum(styles.values())
            style = -sum(c / total * math.log(c / total) for c in styles.values()) / math.log(m) if m > 1 else 1.0
            below = [t for n in mine for c in n if c[: len(b)] == b for t in set(n[c][1])]
            if not below:
                continue
            base = math.log(max(m, site_tree.PRIOR_PAGES))
            content = 1 - sum(min(1, math.log(everywhere[t]) / base) for t in below) / len(below)
            fade = site_tree.GAMMA ** len(styles)
            importance[b] = (1 - fade) * min(style, 1) + fade * content
            chars[b] = sum(len(t) for n in mine if b in n for t in set(n[b][1]))
        direct = [b for b in importance if chars[b]]
        best = importance[max(direct, key=lambda b: importance[b] * chars[b])]
        dropped[host] = {b for b in direct if max(importance[c] for c in direct if c[: len(b)] == b) < threshold * best}

    def kept(tree, path, gone):
        path = (*path, f"{tree[0]}.{tree[1]}")
        return [t for c in tree[2] for t in (([c] if (*path, "p") not in gone else []) if isinstance(c, str) else kept(c, path, gone))]

    return ["\n".join(kept(tree, (), dropped[host])) for host, tree in pages]


def test_importance_against_plain(spark):
    rng = random.Random(21)
    pages = [(f"h{min(rng.randrange(5), 2)}.org", random_tree(rng)) for _ in range(120)]
    expected = plain_texts(pages)
    rows = [(k, f"http://{h}/{k}", rendered(t)) for k, (h, t) in enumerate(pages)]
    got = {r["page_id"]: r["text"] for r in site_tree.extract_main_text(pages_of(spark, rows)).collect()}
    assert got == dict(enumerate(expected))
    whole = ["\n".join(plain_texts([p], 0.0)) for p in pages]
    assert sum(a != b for a, b in zip(expected, whole, strict=True)) > 20  # the tree does decide


def test_the_tree_needs_no_names(spark):
    """Where a host has enough pages, its text is the same without a single class or id."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    bare = pages.withColumn("html", F.regexp_replace("html", r'(class|id)="[^"]*"', '$1="q"'))
    named, neutral = ({r["page_id"]: r["text"] for r in site_tree.extract_main_text(p).collect()} for p in (pages, bare))
    hosts = {r["page_id"]: r["h"] for r in pages.select("page_id", site_tree.host_of(F.col("url")).alias("h")).collect()}
    size = Counter(hosts.values())
    many = [k for k in named if size[hosts[k]] >= 10]
    assert len(many) > 2000 and sum(named[k] == neutral[k] for k in many) >= 0.95 * len(many)


def test_the_tree_overrules_names(spark):
    rng = random.Random(3)
    rows = [(k, f"http://a.org/{k}", f"<form><div class=sidebar><p>{' '.join(rng.choices('abcdefgh', k=40))} {k}</p></div><div class=ad>{rng.random()}</div></form>") for k in range(20)]
    got = site_tree.extract_main_text(pages_of(spark, rows)).collect()
    assert all(r["text"].endswith(f" {r['page_id']}") for r in got)


def test_awkward_pages(spark):
    rows = [(1, None, None), (2, "", ""), (3, "http://a.b/c", "<p>x"), (3, "http://a.b/c", "<p>x"), (None, "nonsense", "<article>" + "long text " * 20_000)]
    out = site_tree.extract_main_text(pages_of(spark, rows)).collect()
    assert len(out) == 5 and sorted(r["n_chars"] for r in out) == [0, 0, 1, 1, 199_999]
    assert site_tree.extract_main_text(pages_of(spark, [])).count() == 0


def at(day):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=day)


def plain_revisits(captures):
    out = {}
    for rid, url, when, status, headers, digest in captures:
        if status != 304:
            continue
        past = [c for c in captures if 200 <= (c[3] or 0) < 300 and c[1] == url and url and c[2] <= when]
        best = max(past, key=lambda c: (c[2], c[0]), default=None)
        if best is None:
            out[rid] = (None, "orphan")
            continue
        pairs = [(headers.get("etag"), best[4].get("etag")), (headers.get("last-modified"), best[4].get("last-modified")), (digest, best[5])]
        told = [a.removeprefix("W/") == b.removeprefix("W/") for a, b in pairs if a and b]
        out[rid] = (best[0], "conflict" if False in told else "verified" if told else "unverified")
    return out


def test_as_of_against_plain(spark):
    rng = random.Random(9)
    captures = []
    for rid in range(400):
        url = "http://hot.org/p" if rng.random() < 0.4 else f"http://h{rng.randrange(40)}.org/p"
        headers = {k: v for k, v in (("etag", rng.choice(['"a"', 'W/"a"', '"b"', None])), ("last-modified", rng.choice(["x", None, None]))) if v}
        captures.append((rid, url, at(rng.randrange(300) / 3), rng.choice([200, 304, 304, 404, None]), headers, rng.choice([None, "d1", "d1", "d2"])))
    df = spark.createDataFrame(captures, revisits.CAPTURE).repartition(5)
    for chunks in (None, 1, 7, 60):
        got = {r["record_id"]: (r["response_id"], r["state"]) for r in revisits.resolve_revisits(df, chunks).collect()}
        assert got == plain_revisits(captures)


def test_a_url_of_one_second_is_split(spark):
    captures = [(rid, "http://hot.org/p", at(1), 200 if rid % 40 == 7 else 304, {"etag": f'"{rid % 3}"'}, None) for rid in range(400)]
    got = {r["record_id"]: (r["response_id"], r["state"]) for r in revisits.resolve_revisits(spark.createDataFrame(captures, revisits.CAPTURE), 16).collect()}
    assert got == plain_revisits(captures) and {of for of, _ in got.values()} == {367}


def test_headers_merge(spark):
    full = (1, "HTTP://www.A.org:80/x/index.html?b=2&utm_source=f&a=1#top", at(1), 200, {"ETag": '"v"', "Content-Type": "text/html", "Date": "old", "Set-Cookie": "s"}, "d")
    seen = (2, "https://a.org/x?a=1&b=2", at(2), 304, {"etag": 'W/"v"', "DATE": "new", "Content-Length": "0"}, None)
    other = (3, "https://a.org/x?a=1&b=2", at(3), 304, {"etag": '"w"'}, None)
    blank = [(4, None, at(2), 200, None, None), (5, "", at(3), 304, None, None), (6, "a", None, 304, None, None), (None, None, None, None, None, None), (2, "https://a.org/x?a=1&b=2", at(2), 304, {"etag": 'W/"v"'}, None)]
    rows = revisits.resolve_revisits(spark.createDataFrame([full, seen, other, *blank], revisits.CAPTURE)).collect()
    by = {(r["record_id"], r["headers"].get("date")): r for r in rows}
    got = by[2, "new"]
    assert (got["canonical"], got["response_id"], got["state"], got["digest"]) == ("a.org/x?a=1&b=2", 1, "verified", "d")
    assert got["headers"] == {"etag": 'W/"v"', "content-type": "text/html", "date": "new", "set-cookie": "s"}
    assert (by[3, None]["state"], by[3, None]["digest"], by[3, None]["headers"]) == ("conflict", None, {"etag": '"w"'})
    assert {r["record_id"] for r in rows if r["state"] == "orphan"} == {5, 6} and len(rows) == 5
    assert revisits.resolve_revisits(spark.createDataFrame([], revisits.CAPTURE)).count() == 0
