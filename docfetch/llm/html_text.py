"""Main text of web pages by consensus container paths of their hosts.

Pass 1 parses every page into containers (body, main, article, section, div, table cells),
scores them by the text they hold outside of links and boilerplate, and votes for the one
that holds the article: one vote a page for its generalised tag-class path (classes in
order, numbers and long hexadecimal names made equal). Spark counts the votes per host.
Pass 2 parses again and takes the text of all containers with the host's winning path; a
page without such a container, or whose own best container lies elsewhere and holds far
more text, is of another kind than most of its host and uses its own path.

Only what the markup or a class, id or role names as a menu, header, footer, sidebar,
notice, advert, form, comment or the like is left out. A header element inside an article
is the article's own. A class does not hide a container that holds the page's headline or
an article: the name then tells the layout.

Defined cases: a null or empty page gives an empty text; unclosed tags end where their
parent does, an unclosed comment or script at the end of the page; a tag cut off by the
end of the page is dropped; a page whose url is null or has no host uses its own path;
pages of one url, or one id, are pages of their own; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docfetch.llm.chunks import small_batches, stored

SHARE = 0.5      # of a container's score that one child needs to be looked into
TRUST = 1 / 3    # of the page's own best score that the host's container needs

CONTAINERS = frozenset("body main article section div td center form".split())
#: elements whose content is never article text
HIDDEN = frozenset("nav footer aside menu search dialog template noscript button select label svg canvas audio video "
                   "object map datalist".split())
#: elements whose content is not markup
RAW = frozenset("script style title textarea iframe xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: elements that begin a block of text
BLOCKS = CONTAINERS | HIDDEN | frozenset(
    "address blockquote br caption dd details dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 header hgroup hr html "
    "legend li ol option p pre summary table tbody tfoot th thead tr ul".split())
#: a start tag closes these open elements, up to the enclosing ones
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
          "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
          "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select", "datalist"})}
#: words of a class, id or role that name something other than the article
BOILERPLATE = frozenset(
    "nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars aside complementary ad ads adbox adslot "
    "advert adverts advertisement advertisements advertising adsense sponsor sponsored promo promos promotion banner "
    "cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription "
    "signup login share sharing social comment comments reply replies respond disqus discussion footer contentinfo "
    "masthead toolbar topbar menubar pagination pager related recommended recommendations widget widgets search".split())
STEMS = ("commentlist", "commentbox", "commentarea", "advert", "sponsor", "newsletter", "cookie", "sidebar", "navbar",
         "breadcrumb", "promo", "disqus")

_TAG = re.compile(r"""</?([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)>""")
_NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_NUMBER = re.compile(r"[0-9]+")
_HEX = re.compile(r"(?=[a-z]*[0-9])[0-9a-f]{6,}")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I) for name in RAW}


class Page:
    """Containers (parent, path, named as boilerplate) and blocks of text in page order."""

    def __init__(self, html: str):
        self.parents, self.paths, self.flags = [-1], ["body"], [False]
        self.headline = [False]                    # holds a first-level heading of its own
        self.blocks: list[tuple[int, str, int]] = []           # container, text, characters in links
        self._stack: list[tuple[str, int, bool]] = [("body", 0, False)]
        self._text: list[str] = []
        self._linked = self._link = 0
        self._read(html)
        self._judge()

    # parsing

    def _read(self, html: str) -> None:
        at, start, n = 0, 0, len(html)
        while at < n:
            lt = html.find("<", at)
            if lt < 0:
                break
            mark = html[lt + 1:lt + 2]
            if mark in ("!", "?"):
                self._say(html[start:lt])
                end = html.find("-->", lt + 4) if html.startswith("<!--", lt) else html.find(">", lt)
                if end < 0:
                    start = n
                    break
                start = at = end + (3 if html.startswith("<!--", lt) else 1)
            elif mark == "/" or mark.isascii() and mark.isalpha():
                tag = _TAG.match(html, lt)
                if tag is None:
                    if html.find(">", lt) < 0:     # cut off by the end of the page
                        self._say(html[start:lt])
                        start = n
                        break
                    at = lt + 1                    # such as "</>" or "</3 >": text
                    continue
                self._say(html[start:lt])
                start = at = tag.end()
                name = tag[1].lower()
                if mark == "/":
                    self._close(name)
                elif name in RAW:
                    end = _RAW_END[name].search(html, at)
                    start = at = end.end() if end else n
                else:
                    self._open(name, tag[2])
            else:
                at = lt + 1
        self._say(html[start:])
        self._flush()

    def _say(self, text: str) -> None:
        if text and not self._stack[-1][2]:
            self._text.append(text)
            if self._link:
                self._linked += len(text)

    def _flush(self) -> None:
        if self._text:
            text = " ".join(entities.unescape("".join(self._text)).split())
            if text:
                self.blocks.append((self._stack[-1][1], text, min(self._linked, len(text))))
            self._text.clear()
        self._linked = 0

    def _open(self, name: str, attributes: str) -> None:
        if name == "a":
            self._link = len(self._stack)
            return
        if name not in BLOCKS:
            return
        self._flush()
        if name == "body" or name == "html" or name in ("br", "hr"):
            return
        closes, within = CLOSES.get(name, (None, None))
        if closes:
            self._pop(next((k for k in self._outward(within) if self._stack[k][0] in closes), None))
        elif name != "option":
            self._pop(next((k for k in self._outward({"td", "th", "li"} | HIDDEN) if self._stack[k][0] == "p"), None))
        if self._stack[-1][2] and name in ("main", "article"):       # an unclosed menu or header ends here
            self._pop(next((k for k, (tag, _, out) in enumerate(self._stack) if out and (
                name == "main" or tag in ("nav", "header"))), None))
        _, node, hidden = self._stack[-1]
        names = {k.lower(): a or b or c for k, a, b, c in _NAMED.findall(attributes)} if attributes else {}
        if name in HIDDEN or name == "header" and not self._in_article(node):
            hidden = True
        elif not hidden and (name in CONTAINERS or _named(names, name)):
            # also a paragraph or list named as boilerplate is a container of its own
            self.parents.append(node)
            self.paths.append(f"{self.paths[node]}/{_general(name, names.get('class', ''))}")
            self.flags.append(name == "form" or _named(names, name))
            self.headline.append(False)
            node = len(self.parents) - 1
        if name == "h1" and not hidden:
            self.headline[node] = True
        self._stack.append((name, node, hidden))

    def _outward(self, limits: set[str] | frozenset[str]) -> Iterator[int]:
        for k in range(len(self._stack) - 1, 0, -1):
            if self._stack[k][0] in limits:
                return
            yield k

    def _within(self, node: int, outer: int) -> bool:
        while node > outer:                        # parents come before their children
            node = self.parents[node]
        return node == outer

    def _in_article(self, node: int) -> bool:
        while node > 0:
            if self.paths[node].rpartition("/")[2].startswith(("article", "main")):
                return True
            node = self.parents[node]
        return False

    def _close(self, name: str) -> None:
        if name == "a":
            self._link = 0
            return
        if name in ("body", "html"):               # what follows still belongs to the page
            return
        if name not in BLOCKS:
            return
        self._flush()
        if name not in VOID:
            self._pop(next((k for k in range(len(self._stack) - 1, 0, -1) if self._stack[k][0] == name), None))

    def _pop(self, k: int | None) -> None:
        if k is not None:
            del self._stack[k:]
            if self._link > len(self._stack):
                self._link = 0

    # scoring

    def _judge(self) -> None:
        """Which containers are left out, and the score of each with all it holds."""
        n = len(self.parents)
        article = [False] * n                      # an article or headline in it, itself included
        for i in range(n - 1, 0, -1):
            tag = self.paths[i].rpartition("/")[2].partition(".")[0]
            own = self.headline[i] or tag in ("main", "article") and not self.flags[i]
            article[i] |= own
            if self.flags[i] and article[i]:
                self.flags[i] = False
            if article[i] and not self.flags[i]:
                article[self.parents[i]] = True
        self.out = list(self.flags)
        for i in range(1, n):
            self.out[i] |= self.out[self.parents[i]]
        self.scores = [0.0] * n
        for node, text, linked in self.blocks:
            if not self.out[node] and 2 * linked < len(text):
                self.scores[node] += len(text) - linked
        for i in range(n - 1, 0, -1):
            self.scores[self.parents[i]] += self.scores[i]

    def best(self) -> int:
        """The container of the article: from the body down, as long as one child holds most
        of the text, but not past a container with a headline of its own."""
        children: dict[int, list[int]] = {}
        for i in range(1, len(self.parents)):
            if not self.out[i]:
                children.setdefault(self.parents[i], []).append(i)
        at = 0
        while at == 0 or not self.headline[at]:
            down = max(children.get(at, []), key=lambda i: self.scores[i], default=None)
            if down is None or self.scores[down] <= SHARE * self.scores[at]:
                break
            if sum(self.paths[i] == self.paths[down] for i in children[at]) > 1:
                break                              # parts of one kind: the whole is the article
            at = down
        return at

    def text(self, path: str | None) -> str:
        own = self.best()
        taken = [i for i in range(len(self.paths)) if self.paths[i] == path and not self.out[i]]
        apart = not any(self._within(i, own) for i in taken)       # the page's own best lies elsewhere
        if apart and sum(self.scores[i] for i in taken) < TRUST * self.scores[own] or not taken:
            taken = [own]
        inside = [False] * len(self.paths)
        for i in taken:
            inside[i] = True
        for i in range(1, len(self.paths)):
            inside[i] |= inside[self.parents[i]]
        return " ".join(t for node, t, _ in self.blocks if inside[node] and not self.out[node])


def _general(name: str, classes: str) -> str:
    tokens = sorted({_NUMBER.sub("0", _HEX.sub("0", c)) for c in classes.lower().split()})
    return ".".join([name, *tokens])


def _named(names: dict[str, str], tag: str) -> bool:
    for kind, value in names.items():
        words = {w.lower() for w in _WORD.findall(value)}
        if words & BOILERPLATE or any(w.startswith(STEMS) for w in words) or "header" in words and tag not in ("article", "main") and kind != "role" \
                and not words & {"article", "entry", "post", "content", "story"}:
            return True
    return False


def host_of(url: Column) -> Column:
    """Lower-case host without user and port; null if there is none."""
    host = F.lower(F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.when(host != "", host)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page row: page_id, url, text and n_chars, its code points."""
    small_batches(pages.sparkSession)
    base = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        F.col(html_col).cast("string").alias("html"))
    base = base.withColumn("host", host_of(F.col("url")))
    # stored, so that its size is known: the winners are only broadcast under Spark's threshold
    winners = stored(winning_paths(base), "host_paths").withColumnRenamed("host", "of_host")
    joined = base.join(winners, F.col("host") == F.col("of_host"), "left").select("page_id", "url", "html", "path")
    kind = dict(base.dtypes)["page_id"]

    def texts(batches):
        for batch in batches:
            found = [Page(h).text(p) if h else "" for h, p in zip(batch["html"].to_pylist(), batch["path"].to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch["page_id"], batch["url"], pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())],
                names=["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(texts, f"page_id {kind}, url string, text string, n_chars long")


def winning_paths(pages: DataFrame) -> DataFrame:
    """The path with most votes of each host (ties: more text, then the greater path)."""
    def vote(batches):
        for batch in batches:
            rows = []
            for host, html in zip(batch["host"].to_pylist(), batch["html"].to_pylist()):
                page = Page(html)
                best = page.best()
                if page.scores[best] > 0:
                    rows.append((host, page.paths[best], page.scores[best]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.string(), pa.string(), pa.float64()))],
                names=["host", "path", "score"])

    votes = (pages.where("host is not null and html is not null").select("host", "html")
             .mapInArrow(vote, "host string, path string, score double"))
    counted = votes.groupBy("host", "path").agg(F.count(F.lit(1)).alias("votes"), F.sum("score").alias("score"))
    return counted.groupBy("host").agg(F.max_by("path", F.struct("votes", "score", "path")).alias("path"))
