"""Main text of pages by site style trees.

The pages of a host are merged by the names of their branches.  Pass one counts, for each branch of a host,
its pages, its styles (sequences of block children) and its texts, as hashes.  Of a branch on m pages,

- presentation importance is the entropy of its styles to the base m (1 on a single page);
- content importance is one less the mean entropy of the texts in and below it: log(pages) of a text, counted
  over all hosts, so that adverts which rotate over sites are known, to the base m or ``PRIOR_PAGES``, if more;
- composite importance is (1 - g**l) of the former and g**l of the latter, with l styles and g = ``GAMMA``.

The main branch of a host is the one whose texts have the most characters, each worth its importance.  A
branch is noise if neither it nor any branch below that holds text has ``THRESHOLD`` of the main branch's
importance; pass two leaves out the texts of noisy branches, in articles and outside.  Elements and whole
names (of grouping elements only) that mean menus, headers, footers, sidebars, notices, adverts, forms and
comments are left out as well, unless the main branch lies in them: then the tree overrules the name.

Counts are grouped by text before they are grouped by branch, and by how common a text is before a branch's
pages are known, so a host with a third of all pages is spread over its texts.  What pass two needs of a host
is the list of its noisy branches and of those around its main one.

Defined cases: null and empty pages have an empty text; a null url is a host of its own name (empty); equal
rows are counted once each and give equal texts; a null id is carried along; no other column is read.  On
single pages of unknown hosts names decide alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from poolwise.llm.dom import Element, hash_of, walk
from poolwise.llm.staging import ship, small, stage

GAMMA, THRESHOLD, PRIOR_PAGES = 0.9, 0.75, 30
#: Elements, and whole classes or ids, that are no part of an article; inside of one and outside.
_NO_TAGS = frozenset("head nav aside footer form menu dialog".split())
_INSIDE = frozenset(
    "nav navbar navigation topnav subnav sidenav menu mainmenu main-menu submenu nav-menu breadcrumb breadcrumbs sidebar side-bar left-sidebar right-sidebar aside widget widgets "
    "cookie cookies cookie-notice cookie-banner cookie-bar cookie-consent consent popup modal newsletter newsletter-signup subscribe "
    "ad ads adv advert adverts advertisement advertisements advertising ad-container ad-slot ad-banner adsbygoogle sponsor sponsored sponsors promo promotion promotions "
    "form contact-form comment comments comment-list commentlist comment-form commentform comments-section comments-area user-comments reader-comments replies reply respond disqus disqus_thread "
    "share sharing share-buttons social social-share social-links social-media related related-posts related-articles recommended recommendations pagination pager".split()
)
_OUTSIDE = _INSIDE | frozenset(
    "header site-header page-header top-header masthead footer site-footer page-footer bottom-footer side notice notices site-notice alert alerts banner banners "
    "search search-box search-form login login-form signup signup-form copyright legal disclaimer".split()
)
_GROUPS = frozenset("div section ul ol dl table fieldset details figure span center dir td".split())
_ARTICLE = frozenset("article main".split())
_NUMBERED = re.compile(r"[-_]?0$")


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


_SEEN = "host string, branch long, kind int, hash long, pages long, chars long"
_BRANCH, _STYLE, _TEXT, _WITHIN = range(4)


def _observe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``_SEEN``: the pages of a branch, of its styles and its own texts, and the branches that one with texts lies in."""
    seen: dict[tuple[str, int, int, int], list[int]] = {}

    def out() -> pa.RecordBatch:
        keys, values = list(zip(*seen, strict=True)), list(zip(*seen.values(), strict=True))
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((*keys, *values), (pa.string(), pa.int64(), pa.int32(), *[pa.int64()] * 3), strict=True)], [x.split()[0] for x in _SEEN.split(", ")])
        seen.clear()
        return batch

    for batch in batches:
        for host, source in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            found: dict[tuple[str, int, int, int], int] = {}

            def left(e: Element, found: dict = found, host: str = host) -> None:
                found[host, e.branch, _BRANCH, 0] = 0
                found[host, e.branch, _STYLE, e.style] = 0

            for e, text in walk(source.as_py() or "", lambda *_: None, left):
                found[host, e.branch, _TEXT, hash_of(text)] = len(text)
                if (host, e.branch, _WITHIN, e.branch) not in found:
                    found.update(((host, e.branch, _WITHIN, b), 0) for b in (e.chain() or [0]))
            for key, chars in found.items():
                held = seen.setdefault(key, [0, 0])
                held[0] += 1
                held[1] += chars
            if len(seen) > 100_000:
                yield out()
    if seen:
        yield out()


def style_tree(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, branch, m, chars, importance, peak, within) of every branch that holds text itself; ``peak`` is the
    greatest importance in and below it, ``within`` the branches that it lies in, itself among them."""
    ship(pages.sparkSession)
    seen = pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html")).mapInArrow(_observe, _SEEN)
    seen = stage(seen.groupBy("host", "branch", "kind", "hash").agg(F.sum("pages").alias("pages"), F.sum("chars").alias("chars")), "branches")
    n, key = F.col("pages"), ["host", "branch"]
    of = lambda kind, x: F.sum(F.when(F.col("kind") == kind, x))
    own = seen.where(F.col("kind") <= _STYLE).groupBy(*key).agg(of(_BRANCH, n).alias("m"), of(_STYLE, n * F.log(n)).alias("style_log"), of(_STYLE, n).alias("style_n"), F.count_if(F.col("kind") == _STYLE).alias("styles"))
    own = stage(own, "own")
    # how common each text is over all hosts; a branch's texts by that
    texts = seen.where(F.col("kind") == _TEXT)
    common = texts.groupBy("hash").agg(F.sum("pages").alias("everywhere")).where("everywhere > 1")
    texts = texts.join(common, "hash", "left").withColumn("everywhere", F.coalesce("everywhere", F.lit(1)))
    texts = stage(texts.groupBy(*key, "everywhere").agg(F.sum("pages").alias("n"), F.sum("chars").alias("chars")), "texts")
    within = stage(seen.where(F.col("kind") == _WITHIN).select(*key, F.col("hash").alias("outer")), "within")
    # those of an outer branch are those of all branches below
    below = texts.join(small(within), key).groupBy("host", F.col("outer").alias("branch"), "everywhere").agg(F.sum("n").alias("n"))
    base = F.log(F.greatest("m", F.lit(PRIOR_PAGES)))
    entropy = F.sum(F.col("n") * F.least(F.lit(1.0), F.log("everywhere") / base)) / F.sum("n")
    content = below.join(small(own.select(*key, "m")), key, "left").withColumn("m", F.coalesce("m", F.lit(1))).groupBy(*key).agg(entropy.alias("entropy"))
    rows = content.join(small(own), key, "left").withColumn("styles", F.coalesce("styles", F.lit(1)))
    style = F.when(F.col("m") > 1, (F.log("style_n") - F.col("style_log") / F.col("style_n")) / F.log("m")).otherwise(1.0)
    fade = F.pow(F.lit(GAMMA), F.col("styles"))
    rows = rows.withColumn("importance", (1 - fade) * F.least(style, F.lit(1.0)) + fade * (1 - F.col("entropy")))
    rows = stage(rows.select(*key, F.coalesce("m", F.lit(1)).alias("m"), "importance"), "importance")
    direct = texts.groupBy(*key).agg(F.sum("chars").alias("chars")).join(rows, key)
    direct = stage(direct, "direct")
    peaks = direct.select(*key, "importance").join(small(within), key).groupBy("host", F.col("outer").alias("branch")).agg(F.max("importance").alias("peak"))
    chains = within.groupBy(*key).agg(F.sort_array(F.collect_set("outer")).alias("within"))
    return direct.join(peaks, key).join(chains, key)


def noise(tree: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(host, dropped, spared): each host's noisy branches, and the branches that its main one lies in."""
    tree = stage(tree, "tree")
    weight = F.struct((F.col("importance") * F.col("chars")).alias("w"), "branch", "importance", "within")
    main = stage(tree.groupBy("host").agg(F.max(weight).alias("main")).select("host", F.col("main.importance").alias("best"), F.col("main.within").alias("spared")), "main")
    low = tree.join(small(main.select("host", "best")), "host").where(F.col("peak") < threshold * F.col("best"))
    return main.join(low.groupBy("host").agg(F.sort_array(F.collect_set("branch")).alias("dropped")), "host", "left").select("host", "dropped", "spared")


def _named(element: Element, inside: bool) -> bool:
    if element.tag not in _GROUPS or element.name == element.tag:
        return False
    known = _INSIDE if inside else _OUTSIDE
    return any(x in known or _NUMBERED.sub("", x) in known for x in element.name.split(".")[1:])


def main_text(source: str | None, dropped: frozenset[int] = frozenset(), spared: frozenset[int] = frozenset()) -> str:
    """The blocks that stay, joined by line ends."""

    def enter(parent: Element, element: Element) -> tuple[bool, bool]:
        if parent is element:
            return False, False
        gone, inside = parent.state
        if gone:
            return True, inside
        tag = element.tag
        if (tag in _NO_TAGS or (tag == "header" and not inside) or _named(element, inside)) and (tag == "head" or element.owner is not element or element.branch not in spared):
            return True, inside
        return False, inside or tag in _ARTICLE

    return "\n".join(text for element, text in walk(source or "", enter) if not element.state[0] and element.branch not in dropped)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, urls, sources, dropped, spared = batch.columns
        texts = [main_text(s.as_py(), frozenset(d.as_py() or ()), frozenset(k.as_py() or ())) for s, d, k in zip(sources, dropped, spared, strict=True)]
        yield pa.RecordBatch.from_arrays([ids, urls, pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["id", "url", "text", "n_chars"])


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: id, url, ``text`` and ``n_chars``."""
    lists = stage(noise(style_tree(pages, url_col, html_col), threshold), "noise")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_of(F.col(url_col)).alias("host"))
    rows = rows.join(small(lists), "host", "left").select("id", "url", "html", "dropped", "spared")
    return rows.mapInArrow(_extract, "id long, url string, text string, n_chars long").withColumnRenamed("id", id_col)


def op1_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
