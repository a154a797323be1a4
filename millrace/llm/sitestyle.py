"""HTML main-text extraction with a site style tree.

Every page's elements, the named ones too, are merged, host by host, into one tree of style paths (tags with their
classes).  For each style path two entropies are counted over the host's different pages: of presentation (which child
elements follow each other) and of content (the text below).  A path's importance is that of its content, raised a
little where its presentation varies; importance and number of pages tell on how many pages the same thing stands, and
a branch that repeats itself is removed from each page.  Names and tags are a prior: what is an advert, a menu or a form
by its name goes whatever it says, words that name other things as well need a repetition or a place outside the
article, and text beside the article stays if the tree finds it as important as an article.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.memory import small_batches
from millrace.llm.storage import written

#: Elements without content, and elements whose content isn't markup.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark meter output progress q rp rt ruby s samp small span strike strong sub sup time tt u var button select option optgroup math mi mo mn ms mtext mrow mfrac msup msub msubsup msqrt mroot mover munder munderover mfenced mspace mpadded mstyle menclose semantics".split())
#: Elements that are never part of an article's text.
NEVER = frozenset("nav footer aside form button select textarea script style noscript template iframe object svg canvas dialog menu head title audio video map datalist annotation annotation-xml".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
#: Names of classes that mean page furniture; those of the second list name other things as well, and those of the third
#: are furniture outside an article only.  A class counts if it is made of such names and of words for boxes alone, so
#: "related-posts" does and "related-work" doesn't.
FURNITURE = frozenset(
    """ad ads advert adverts advertisement advertising adsense sponsored nav navbar navigation menu submenu breadcrumb breadcrumbs footer sidebar aside
    cookie cookies consent gdpr modal lightbox newsletter subscribe signup signin social sharing related comment comments commentlist disqus replies
    pagination pager toolbar outbrain taboola paywall tagcloud searchbox recommendations banner promo promotion widget widgets popup overlay subscription
    login share""".split()
)
PERHAPS = frozenset(
    "sponsor sponsors notice register recommended skip hidden copyright disclaimer search tags byline survey feedback".split()
)
OUTSIDE = frozenset("header masthead topbar topnav logo branding alert blogroll".split())
#: Those of the first list below which an article is no article of the page.
OTHERS = frozenset("comment comments commentlist disqus replies reply related recommended recommendations sponsored promo".split())
#: Words for boxes and their places, which don't tell what is in them.
BOXES = frozenset("area article articles bar block box btn button buttons col column container content form group inner item items left link links list main more outer page panel post posts right row section site slot stories story top bottom unit user wrap wrapper".split())
#: Elements whose ids count, outside articles and as a whole: those of headings and sections are made of their titles, so
#: a section's counts only if it says that readers' comments are in it.
NAMED_BY_ID = frozenset("div ul ol dl table".split())
READERS = frozenset("comment comments commentlist disqus replies reply".split())
#: Elements of an article that go for their names only if the tree says so too.
PLAIN = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd td th section figure figcaption".split())
#: A branch is noise if the same stands on so many pages on average (on hosts of less than twice as many pages: on all),
#: GAMMA weighing what presentation adds; names of the second list make it noise at fewer.
REPEATS, NAMED_REPEATS, GAMMA = 4, 1.5, 0.9
#: Beside an article, what has at least this importance on at least so many pages is text like the article.
LIVE, LIVE_PAGES = 0.9, 3
#: Words of classes that name articles which stand for another page.
TEASERS = frozenset("card cards teaser teasers preview excerpt summary tile".split())
_NAMES = FURNITURE | PERHAPS | OUTSIDE | OTHERS | TEASERS
#: Bytes of the paths of hosts that are broadcast at most; beyond that pages are joined with their host's by shuffle, a
#: host's pages dealt out over so many tasks.
BROADCAST_BYTES, SALTS = 16 << 20, 32

_TAG = re.compile(r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+>|[^>]*(?:>|\Z))""", re.S)
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?(?=[\s/>]|$)""", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_DIGITS = re.compile(r"\d+")


@lru_cache(100_000)
def _name(style: str) -> int:
    return _digest(style)


@lru_cache(100_000)
def _furniture(value: str, whole: bool = False) -> frozenset[str]:
    """The names of furniture in a class attribute: of each class that is made of them and of words for boxes; of an id
    (``whole``) that is one such name."""
    found: set[str] = set()
    for token in value.split():
        words = {w.lower() for w in _WORDS.findall(token)}
        named = words - BOXES
        if named and named <= _NAMES and not (whole and len(words) > 1) and token.isascii():
            found |= named
    return frozenset(found)


def _digest(text: str) -> int:
    """A hash that is the same in every process, unlike that of str; of numbers, hash() of a tuple is."""
    from xxhash import xxh3_64_intdigest

    return xxh3_64_intdigest(text)


#: How an element is dropped: by what it is, or by a class that an article inside may be free of.  DOUBTFUL: by a class in
#: an article that may mean something else; it goes if the tree says so.
GONE, WRAPPED, DOUBTFUL = 1, 2, 3
#: What an element holds by its tag or role: the page, or an article.
PAGE, ARTICLE = 1, 2


class Page:
    """A page's elements (path, parent, whether named as furniture, whether in an article) and blocks of text."""

    def __init__(self, html: str, names: bool = True):
        """``names``: whether classes and ids tell what is furniture (else only the tree, tags and roles do)."""
        self.names, self.doubt, self.inline = names, [False], set()
        self.path, self.parent, self.drop, self.main, self.shape = [0], [-1], [0], [False], [0]
        self.holds, self.teaser = [PAGE], [False]
        self.blocks: list[tuple[int, str, int]] = []  # element, text, characters in links
        self._parse(html)

    def _open(self, tag: str, rest: str, top: int) -> int:
        drop, main, style = self.drop[top], self.main[top] or tag in ("article", "main"), tag
        teaser, doubt = self.teaser[top] and not self.main[top], self.doubt[top]
        if drop == WRAPPED and tag in ("article", "main"):  # a class that only says what stands beside the article
            drop = 0
        if tag in NEVER or tag == "header" and not self.main[top]:
            drop = GONE
        if rest and not drop:
            for name, value in _ATTRIBUTE.findall(rest):
                name, value = name.lower(), value.strip("\"'")
                if name in ("class", "id"):
                    words = _furniture(value) if name == "class" else _furniture(value, True) if (tag in NAMED_BY_ID or tag == "section") and not main else frozenset()
                    if name == "id" and tag == "section":
                        words &= READERS
                    if words and tag not in ("body", "html") and self.names:
                        teaser |= bool(words & TEASERS)
                        plain = main and tag in PLAIN
                        if words & OTHERS and not plain:
                            drop = GONE
                        elif not drop and tag not in ("article", "main"):
                            if not plain and (words & FURNITURE or not main and words & (OUTSIDE | PERHAPS)):
                                drop = WRAPPED
                            elif words & (PERHAPS | FURNITURE | OTHERS):
                                doubt = True
                    if name == "class":
                        style += "." + _DIGITS.sub("0", value)
                elif name == "role":
                    drop = GONE if value.lower() in ROLES else drop
                    main |= value.lower() == "main"
                elif name == "hidden":
                    drop = GONE
                elif name == "aria-hidden":
                    drop = GONE if value.lower() == "true" else drop
                elif name == "style":
                    drop = GONE if "display:none" in value.replace(" ", "").lower() else drop
        self.teaser.append(teaser)
        self.holds.append(PAGE if tag in ("html", "body") else ARTICLE if main and not self.main[top] else 0)
        self.path.append(hash((self.path[top], _name(style))))
        self.shape[top] = hash((self.shape[top], _name(tag)))
        self.parent.append(top)
        self.drop.append(drop)
        self.main.append(main)
        self.doubt.append(doubt)
        self.shape.append(0)
        return len(self.path) - 1

    def _parse(self, html: str) -> None:
        stack: list[tuple[str, int]] = [("", 0)]
        buffer: list[str] = []
        owner, linked, links, at, n = 0, 0, 0, 0, len(html)

        def close() -> None:
            nonlocal linked
            if buffer:
                text = " ".join(unescape("".join(buffer)).split())
                if text:
                    self.blocks.append((owner, text, linked))
                buffer.clear()
            linked = 0

        def pop_to(k: int) -> None:
            del stack[k:]

        def add(text: str) -> None:
            nonlocal owner, linked
            top = stack[-1][1]
            if buffer and (self.drop[top] > 0) != (self.drop[owner] > 0):  # furniture inside a line is not a part of its block
                if self.drop[top]:
                    return
                buffer.clear()
            if not buffer:
                owner = top
                while owner and owner in self.inline:
                    owner = self.parent[owner]
                if self.drop[top]:
                    owner = top
            buffer.append(text)
            if links:
                linked += len(text)

        while at < n:
            m = _TAG.search(html, at)
            if m is None:
                add(html[at:])
                break
            if m.start() > at:
                add(html[at : m.start()])
            at = m.end()
            end, tag, rest = m.groups()
            if tag is None:
                continue
            tag = tag.lower()
            if tag == "br" or tag in ("wbr", "img", "input"):
                if tag == "br" and buffer:
                    buffer.append(" ")
                continue
            if tag in INLINE:
                if end:
                    for k in range(len(stack) - 1, 0, -1):
                        if stack[k][0] == tag:
                            if tag == "a":
                                links = 0
                            pop_to(k)
                            break
                        if stack[k][0] not in INLINE:
                            break
                else:
                    e = self._open(tag, rest[:-1], stack[-1][1])
                    self.inline.add(e)
                    stack.append((tag, e))
                    if tag == "a":
                        links = 1
                continue
            close()
            if end:
                if tag == "p" and not any(t == "p" for t, _ in stack):
                    continue
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == tag:
                        pop_to(k)
                        links = int(any(t == "a" for t, _ in stack))
                        break
                continue
            k = len(stack) - 1
            while k and stack[k][0] in INLINE:
                k -= 1
            if stack[k][0] == "p":
                pop_to(k)
            elif tag in _CLOSES:
                stops, same = _CLOSES[tag]
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] in same:
                        pop_to(k)
                        break
                    if stack[k][0] in stops:
                        break
            links = int(any(t == "a" for t, _ in stack))
            e = self._open(tag, rest[:-1], stack[-1][1])
            if tag in RAW:
                stop = re.compile(f"</{re.escape(tag)}", re.I).search(html, at)
                at = html.find(">", stop.start()) + 1 or n if stop else n
            elif tag not in VOID and not rest.endswith("/>"):
                stack.append((tag, e))
        close()

    def features(self) -> list[tuple[int, int, int, bool]]:
        """By path: hashes of the presentation and the content of all elements of that path on this page, and whether
        one is in an article.  Elements without text, and those inside a line, have none."""
        content = [0] * len(self.path)
        for e, text, _ in self.blocks:
            h = _digest(text)
            while e >= 0:
                content[e] = hash((content[e], h))
                e = self.parent[e]
        out: dict[int, tuple[int, int, bool]] = {}
        for e, (path, shape, text, main) in enumerate(zip(self.path, self.shape, content, self.main, strict=True)):
            if text and e not in self.inline:
                look, read, inside = out.get(path, (0, 0, False))
                out[path] = hash((look, shape)), hash((read, text)), inside or main
        return [(path, *v) for path, v in out.items()]

    def _sizes(self) -> list[int]:
        """Characters of the text below each element, without named furniture."""
        size = [0] * len(self.path)
        for e, text, _ in self.blocks:
            if not self.drop[e]:
                size[e] += len(text)
        for e in range(len(size) - 1, 0, -1):
            size[self.parent[e]] += size[e]
        return size

    def text(self, noise: set[int], few: set[int] = frozenset(), named: set[int] = frozenset(), live: set[int] = frozenset()) -> str:
        """The blocks that are left, in page order, joined by an empty line.

        ``noise``: paths that repeat themselves; ``few``: those that few pages tell of, which holds outside articles and
        for at most half of the page's text; ``named``: those that repeat themselves less, which holds for elements whose
        names are in doubt; ``live``: paths outside articles that are as important as those.  What holds the page, and an
        article that has most of its text, is never noise; nor is the largest branch, if nothing else is left."""
        size, held = self._sizes(), [h == PAGE for h in self.holds]
        for e, h in enumerate(self.holds):
            if h == ARTICLE and 2 * size[e] > size[0]:
                while e >= 0 and not held[e]:
                    held[e], e = True, self.parent[e]
        while True:
            noisy, lives, most = [False] * len(self.path), [False] * len(self.path), -1
            for e, (p, path) in enumerate(zip(self.parent, self.path, strict=True)):
                alike = path in noise or path in few and not self.main[e] and 2 * size[e] <= size[0] or self.doubt[e] and path in named
                noisy[e] = p >= 0 and (noisy[p] or alike and not held[e])
                lives[e] = path in live or p >= 0 and lives[p]
                if noisy[e] and not noisy[p] and not self.doubt[e] and (most < 0 or size[e] > size[most]):
                    most = e
            left = [(e, t, n) for e, t, n in self.blocks if not noisy[e] and not self.drop[e]]
            if left or most < 0 or not size[most]:
                break
            held[most] = True  # a page of many near copies reads like noise
        # Lists outside articles that are links for the most part are menus.
        lists: dict[int, list[int]] = {}
        for e, t, n in left:
            s = lists.setdefault(self.parent[e], [0, 0, 0])
            s[0] += len(t)
            s[1] += n
            s[2] += n > 0
        menus = {e for e, (all_, linked, n) in lists.items() if n >= 3 and 10 * linked >= 8 * all_}
        outside = [b for b in left if not self.main[b[0]] and self.parent[b[0]] not in menus]
        if len(outside) == len(left):
            return "\n\n".join(t for _, t, _ in left)
        # Text in links doesn't weigh.  The tags decide unless more text stands outside than in the largest article.
        weight = lambda blocks: sum(max(0, len(t) - n) for _, t, n in blocks)
        articles: dict[int, list[tuple[int, str, int]]] = {}
        for b in left:
            if self.main[b[0]]:
                articles.setdefault(self._article(b[0]), []).append(b)
        most = max(map(weight, articles.values()), default=0)
        # Articles that stand for another page: by their name, mostly links, or a linked headline over less than the half of another's text.
        whole = lambda b: 10 * b[2] >= 9 * len(b[1])
        teasers = {a for a, bs in articles.items() if 2 * weight(bs) < sum(len(t) for _, t, _ in bs) or (self.teaser[a] or whole(bs[0])) and 2 * weight(bs) < max(most, weight(outside))}
        if weight(outside) <= most:
            stay = lambda e: self._article(e) not in teasers if self.main[e] else lives[e] and self.parent[e] not in menus and not self.teaser[e]
        else:
            # The page's article is outside: what stands for other pages goes, what else there is stays.
            alike = Counter(self.path[a] for a in articles)
            less = sum(map(weight, articles.values())) < weight(outside)
            gone = teasers | {a for a in articles if self.teaser[a] or less and alike[self.path[a]] > 1}
            stay = lambda e: self._article(e) not in gone if self.main[e] else self.parent[e] not in menus
        return "\n\n".join(t for e, t, _ in left if stay(e))

    def _article(self, e: int) -> int:
        """The outermost article around an element that is in one."""
        while self.main[self.parent[e]]:
            e = self.parent[e]
        return e


#: For elements whose end may be left out: where the search for an open one stops, and which it ends.
_CLOSES = {
    "li": (frozenset(("ul", "ol", "menu")), frozenset(("li",))), "dt": (frozenset(("dl",)), frozenset(("dt", "dd"))), "dd": (frozenset(("dl",)), frozenset(("dt", "dd"))),
    "tr": (frozenset(("table", "tbody", "thead", "tfoot")), frozenset(("tr",))), "td": (frozenset(("tr", "table")), frozenset(("td", "th"))), "th": (frozenset(("tr", "table")), frozenset(("td", "th"))),
}


def site_paths(pages: DataFrame, url_col: str = "url", html_col: str = "html", names: bool = True) -> DataFrame:
    """One row per host and style path: ``host, path, m`` (different pages that have it), ``look`` and ``read`` (entropies
    of its presentation and content, as shares of the most that so many pages could have; 1 on a single page), ``inside``
    (whether one is in an article), ``importance`` and ``repeats`` (on how many pages the same stands, on average)."""
    host = F.lower(F.coalesce(F.try_parse_url(F.col(f"`{url_col}`"), F.lit("HOST")), F.lit("")))
    rows = small_batches(pages).select(host.alias("host"), F.col(f"`{html_col}`").alias("html"))
    _page = "host string, page long, size long, paths array<struct<path:long,look:long,read:long,inside:boolean>>"

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("path", pa.int64()), ("look", pa.int64()), ("read", pa.int64()), ("inside", pa.bool_())]))
        for b in batches:
            hosts, keys, sizes, paths = [], [], [], []
            for host, html in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                html = html.as_py() or ""
                hosts.append(host)
                key = _digest(html)
                keys.append(key - (1 << 64) if key >> 63 else key)
                sizes.append(len(html))
                paths.append([dict(zip(("path", "look", "read", "inside"), f, strict=True)) for f in Page(html, names).features()])
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), pa.array(paths, kind)], ["host", "page", "size", "paths"])

    # Copies of a page count once; a host's pages lie apart by their hashes, and copies are gathered before the shuffle.
    different = rows.mapInArrow(features, _page).groupBy("host", "page", "size").agg(F.first("paths").alias("paths"))
    seen = different.select("host", F.explode("paths").alias("p")).select("host", "p.*")
    kinds = F.explode(F.expr("array(struct(0 as kind, look as value), struct(1 as kind, read as value))"))
    seen = seen.select("host", "path", "inside", kinds.alias("k")).groupBy("host", "path", "k.kind", "k.value").agg(F.count("*").alias("c"), F.max("inside").alias("inside"))
    stats = seen.groupBy("host", "path", "kind").agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.log("c")).alias("s"), F.max("inside").alias("inside"))
    stats = stats.withColumn("share", F.expr("if(m > 1, greatest(0D, (ln(m) - s / m) / ln(m)), 1D)"))
    tree = stats.groupBy("host", "path").agg(
        F.max("m").alias("m"), F.max("inside").alias("inside"), F.max(F.expr("if(kind = 0, share, null)")).alias("look"), F.max(F.expr("if(kind = 1, share, null)")).alias("read")
    )
    # An element's content covers all below it, so a path that reads alike everywhere has no varied branch in it.
    return tree.withColumn("importance", F.expr(f"read + {1 - GAMMA} * look * (1 - read)")).withColumn("repeats", F.expr("exp(ln(m) * (1 - importance))"))


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", names: bool = True) -> DataFrame:
    """One row per row of ``pages``: id, url, ``text`` (blocks joined by an empty line; '' if none).

    Character references are decoded and white space in a block becomes one space.  Null html is empty, a null or
    odd url belongs to the host ''; null ids stay.  Broken markup is read as browsers do in the common cases (ends left
    out, ends without a start, comments and tags that never end).  Pages of any length are read whole; repeated rows give
    a row each and count as one page of their host; of equal articles both stay; empty tables give no rows; extra columns
    are ignored.  ``names``: whether classes and ids are a prior.  A host's rules are the paths that repeat themselves on
    it or are important outside its articles, 8 bytes each; each of its rows carries them.
    """
    tree = site_paths(pages, url_col, html_col, names)
    many = f"m >= {2 * REPEATS} AND repeats >= {REPEATS}"
    alike = f"m >= 2 AND m < {2 * REPEATS} AND ln(repeats) >= 0.9 * ln(m)"
    rules = tree.withColumn("rule", F.expr(f"CASE WHEN {many} THEN 'noise' WHEN {alike} THEN 'few' WHEN m >= 2 AND repeats >= {NAMED_REPEATS} THEN 'named' WHEN NOT inside AND m >= {LIVE_PAGES} AND importance >= {LIVE} THEN 'live' END"))
    lists = {"noise": "rule = 'noise'", "few": "rule = 'few'", "named": "rule IN ('noise', 'few', 'named')", "live": "rule = 'live'"}
    # Paths in articles that are neither are no rules; most of a site's paths are.
    rules = rules.where("rule IS NOT NULL").groupBy("host").agg(*(F.expr(f"collect_list(if({test}, path, null))").alias(name) for name, test in lists.items()))
    rules = written(rules, "site-rules")
    size = rules.agg(F.coalesce(F.sum(F.octet_length("host") + 8 * sum(F.size(n) for n in lists)), F.lit(0))).first()[0]
    host = F.lower(F.coalesce(F.try_parse_url(F.col(f"`{url_col}`"), F.lit("HOST")), F.lit("")))
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").alias("url"), F.col(f"`{html_col}`").alias("html"), host.alias("host"))
    if size <= BROADCAST_BYTES:
        joined = rows.join(F.broadcast(rules), "host", "left")
    else:
        salted = rules.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("salt", F.pmod(F.xxhash64("id", "url", F.length("html")), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")
    joined = joined.select("id", "url", "html", *lists)
    kind_of = rows.schema["id"].dataType.simpleString()

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [Page(html.as_py() or "", names).text(*(set(r.as_py() or ()) for r in rs)) for html, *rs in zip(*b.columns[2:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string())], [id_col, url_col, "text"])

    return joined.mapInArrow(texts, f"`{id_col}` {kind_of}, `{url_col}` string, text string")


def query(spark, sf_dir: str) -> DataFrame:
    texts = extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return texts.withColumn("n_chars", F.length("text").cast("long"))
