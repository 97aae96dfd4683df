"""Main text of web pages by consensus among the pages of a host.

Each page's containers are scored by the running text in them. The best
container's generalised path, tags with their classes without digits, is the
page's vote, or that of the article or main element that it lies in; votes are counted per host in Spark. Then every page is read
again and gives the text of its containers on the host's winning path, or, if
it has none, that of its own best container.

Boilerplate inside of a container (menus, headers, footers, sidebars, notices,
adverts, forms, scripts, styles, reader comments) is left out by tag and role.
A class or id nominates a container if one of its names, as a whole, says so:
all of the name's words are words for boilerplate or for boxes. Each page
votes on its nominated containers' paths too: it would keep one that holds one
of the page's larger articles, or most of the page's running text if no such
article is elsewhere. What the majority of the host's pages says on a path
that NOTED of them have goes for all of them; on rarer paths, a page's own
word counts.

Defined results: null html is an empty page; a page without text gives the
empty text; null or broken urls share the host ""; ties of votes go to the
path with more text, then to the larger hash of a path, and nominated paths with a tie are
left out; cut-off markup ends where the page ends, and an element without an
end tag where its parent ends; pages of any length are read whole; rows with equal ids,
repeated rows too, are rows of their own; an empty table gives no rows; extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator, Mapping
from html import unescape
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_128_hexdigest

from ..operators.skew import hot_keys, salted_lookup
from ..storage import materialize
from .tables import read, small, texts_of

#: Share of a host's pages that a nominated path must be on for the host's vote to count.
NOTED = 0.05

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements whose content is no markup.
RAW = frozenset("script style textarea title iframe".split())
#: Noise that stands between words rather than within them.
APART = frozenset("noscript template object select button".split())
BLOCKS = frozenset("address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINERS = frozenset("article main section div td body html".split())
#: Starting one of these ends an open element of the same row, unless one of the second set is between.
ENDS = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
#: An article or main element counts beside a longer one of up to so many times its running text.
ARTICLES = 4
NOISE_TAGS = frozenset("nav header footer aside form dialog menu head svg annotation annotation-xml".split()) | RAW | APART
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar".split())
NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist disqus consent cookie cookies dialog disclaimer footer form gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification pager pagination popup promo promoted promotion related replies reply responses respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar topbar widget widgets".split()
)
#: Words that go with those in a name without taking back what they say.
BOX_WORDS = frozenset("area article bar block body bottom box btn button center col column container entry fixed global group inline inner item items label left line link links list main outer page panel post region right row section site slot sticky text title top unit view wrap wrapper".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)|(?P<text>[^<]+|<)", re.S)
_ATTR = re.compile(r"""(?i)(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_SPACE = re.compile(r"\s+")
_DIGITS = re.compile(r"\d+")
_WORDS = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"([a-z])([A-Z])")
_END = {tag: re.compile(f"</{tag}\\b[^>]*(?:>|\\Z)", re.I) for tag in RAW}


def nominated(names: str) -> bool:
    """Whether one of these class names or ids says that its element is boilerplate."""
    for name in names.split():
        words = set(_WORDS.findall(_CAMEL.sub(r"\1 \2", name).lower()))
        if not NOISE_WORDS.isdisjoint(words) and words <= NOISE_WORDS | BOX_WORDS:
            return True
    return False


class Page:
    """Nodes in page order (tag, hash of the path, parent, noise, last node below) and blocks (node, text, characters in links).

    verdicts: by path, whether the host keeps a nominated container.
    """

    def __init__(self, html: str, verdicts: Mapping[str, bool] = {}):
        self.tags, self.paths, self.parents, self.noise, self.last = ["html"], ["html"], [-1], [False], [0]
        self.blocks: list[tuple[int, str, int]] = []
        #: Nominated nodes, and whether this page would keep them.
        self.named: dict[int, bool] = {}
        runs = self._read(html)
        if self.named:
            self._judge(runs, verdicts)
        for run in runs:
            kept = [x for x in run if x[0] < 0 or not self.noise[x[0]]]
            whole = _SPACE.sub(" ", "".join([piece for _, piece, _ in kept])).strip()
            if whole:
                self.blocks.append((next(node for node, _, _ in kept if node >= 0), whole, sum(len(piece) for _, piece, in_link in kept if in_link)))

    def _read(self, html: str) -> list[list[tuple[int, str, bool]]]:
        """The page's runs of pieces (node, or -1 for a mere space; text; whether in a link) between starts and ends of blocks."""
        stack, runs, text, at = [0], [], [], 0
        opened: Counter[str] = Counter()  # by tag, the elements on the stack

        def flush() -> None:
            nonlocal text
            if text:
                runs.append(text)
            text = []

        def close(depth: int) -> None:
            for node in stack[depth:]:
                self.last[node] = len(self.tags) - 1
                opened[self.tags[node]] -= 1
            del stack[depth:]

        size = len(html)
        while at < size:
            m = _TOKEN.match(html, at)
            at = m.end()
            kind = m.lastgroup
            if kind in ("text", "cdata"):
                if not self.noise[stack[-1]]:
                    text.append((stack[-1], unescape(m[kind]) if kind == "text" else m[kind], opened["a"] > 0))
                continue
            tag = (m["tag"] or m["tag2"] or "").lower()
            if not tag:
                continue
            if m["end"] or m["end2"]:
                if tag in BLOCKS:
                    flush()
                if opened[tag] > 0 and tag != "html":
                    close(next(depth for depth in range(len(stack) - 1, 0, -1) if self.tags[stack[depth]] == tag))
                continue
            attrs = m["attrs"] if m["tag"] else m["attrs2"]
            closed = attrs.endswith("/")
            if tag in RAW:
                if not closed or tag in ("script", "style", "title", "textarea"):
                    end = _END[tag].search(html, at)
                    at = end.end() if end else size
                if opened["svg"] <= 0:
                    text.append((-1, " ", False))
                continue
            if tag in VOID:
                if tag == "hr":
                    flush()
                elif tag == "br":
                    text.append((-1, " ", False))
                continue
            if closed and (opened["svg"] > 0 or opened["math"] > 0 or tag in ("svg", "math")):
                continue
            if tag in APART:
                text.append((-1, " ", False))
            if tag in BLOCKS:
                flush()
                if opened["svg"] > 0:  # a block can't be in a drawing
                    close(next(depth for depth in range(1, len(stack)) if self.tags[stack[depth]] == "svg"))
                for depth in range(len(stack) - 1, 0, -1) if opened["p"] > 0 else ():  # a block ends an open paragraph
                    if self.tags[stack[depth]] == "p":
                        close(depth)
                        break
                    if self.tags[stack[depth]] in BLOCKS:
                        break
                ended, between = ENDS.get(tag, ((), ()))
                for depth in range(len(stack) - 1, 0, -1) if any(opened[t] > 0 for t in ended) else ():
                    if self.tags[stack[depth]] in between:
                        break
                    if self.tags[stack[depth]] in ended:
                        close(depth)
                        if tag != "tr":
                            break
            before = len(stack)
            self._open(tag, attrs, stack)
            opened[tag] += len(stack) > before and stack[-1] > 0
        flush()
        close(0)
        return runs

    def _judge(self, runs: list[list[tuple[int, str, bool]]], verdicts: Mapping[str, bool]) -> None:
        """Decides which nominated containers this page would keep, and makes noise of those that the verdicts, or else the page, leave out, with all below them."""
        own = [0] * len(self.tags)
        for run in runs:
            for node, piece, in_link in run:
                if node >= 0 and not in_link:
                    own[node] += len(_SPACE.sub(" ", piece).strip())
        upto = [0, *accumulate(own)]
        running = lambda k: upto[self.last[k] + 1] - upto[k]
        articles = [k for k, tag in enumerate(self.tags) if tag in ("article", "main") and k not in self.named and not self.noise[k] and running(k)]
        most = max(map(running, articles), default=0)
        articles = [k for k in articles if running(k) * ARTICLES >= most]

        def spared(k: int) -> bool:
            if self.tags[k] in ("article", "main"):
                return True
            at = bisect_right(articles, k)
            if at < len(articles) and articles[at] <= self.last[k]:
                return True
            return 2 * running(k) > upto[-1] and not any(running(a) * ARTICLES >= running(k) for a in articles if a > self.last[k] or self.last[a] < k)

        for node in range(1, len(self.tags)):
            silent = False
            if node in self.named:
                self.named[node] = spared(node)
                silent = not verdicts.get(self.paths[node], self.named[node])
            self.noise[node] = self.noise[node] or self.noise[self.parents[node]] or silent

    def _open(self, tag: str, attrs: str, stack: list[int]) -> None:
        parent = stack[-1]
        noise = self.noise[parent] or tag in NOISE_TAGS
        step, named = tag, False
        if attrs.strip():
            found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(attrs)}
            classes = sorted({_DIGITS.sub("#", c) for c in found.get("class", "").split()})
            if tag not in ("html", "body"):
                named = nominated(f"{found.get('class', '')} {found.get('id', '')}")
            if tag not in ("html", "body", "article", "main"):
                noise = noise or found.get("role", "").lower() in NOISE_ROLES or "hidden" in found or found.get("aria-hidden") == "true"
            step = ".".join([tag, *classes])
        if tag == "html" and parent == 0:
            stack.append(0)  # the root is there already
            return
        self.tags.append(tag)
        # A nominated element has a path of its own, so that votes on it are on nothing else.
        self.paths.append(xxh3_128_hexdigest(f"{self.paths[parent]}>{step}") if tag in BLOCKS or named else self.paths[parent])
        self.parents.append(parent)
        self.noise.append(noise)
        self.last.append(len(self.tags) - 1)
        if named and not noise:
            self.named[len(self.tags) - 1] = False
        stack.append(len(self.tags) - 1)

    def best(self) -> tuple[int, float] | None:
        """The container with most running text, or the article or main element around it, and the score: a block counts in its container and half as much in the next."""
        scores: dict[int, float] = {}
        for node, text, linked in self.blocks:
            worth = max(0.0, len(text) - 1.5 * linked)
            share = 1.0
            while node >= 0 and share > 0.2:
                if self.tags[node] in CONTAINERS:
                    scores[node] = scores.get(node, 0.0) + worth * share
                    share /= 2
                node = self.parents[node]
        if not scores:
            return None
        node = min(scores, key=lambda k: (-scores[k] * (1.3 if self.tags[k] in ("article", "main") else 1.0), k))
        score, around = scores[node], node
        while around >= 0 and self.tags[around] not in ("article", "main"):
            around = self.parents[around]
        return (around if around >= 0 else node), score

    def text(self, path: str | None) -> str:
        """The blocks of the containers on the path, else of the best one."""
        starts, ends = [], []
        for node, own in enumerate(self.paths):
            if own == path and (not ends or node > ends[-1]) and self.tags[node] in CONTAINERS and not self.noise[node]:
                starts.append(node)
                ends.append(self.last[node])
        found = self._within(starts, ends)
        if not found:
            best = self.best()
            found = self._within([best[0]], [self.last[best[0]]]) if best else []
        return "\n".join(found)

    def _within(self, starts: list[int], ends: list[int]) -> list[str]:
        """The texts of blocks in these spans of nodes, which are apart and in order."""
        out = []
        for node, text, _ in self.blocks:
            at = bisect_right(starts, node) - 1
            if at >= 0 and node <= ends[at]:
                out.append(text)
        return out


VOTES = "host string, path string, pages long, mass double, keep long, out long, total long"


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of votes per host and path; a host's row without a path counts its pages."""
    for b in small(batches):
        votes: dict[tuple[str, str], list[float]] = {}
        for host, html in zip(texts_of(b, "host"), texts_of(b, "html")):
            page = Page(html)
            votes.setdefault((host, ""), [0, 0.0, 0, 0, 0])[4] += 1
            best = page.best()
            if best:
                mine = votes.setdefault((host, page.paths[best[0]]), [0, 0.0, 0, 0, 0])
                mine[0] += 1
                mine[1] += best[1]
            # A path counts once a page, however many of the page's containers have it.
            said: Counter[str] = Counter()
            for node, keeps in page.named.items():
                said[page.paths[node]] += 1 if keeps else -1
            for path, sense in said.items():
                votes.setdefault((host, path), [0, 0.0, 0, 0, 0])[2 if sense > 0 else 3] += 1
        columns = list(zip(*[(*key, *sums) for key, sums in votes.items()]))
        kinds = (pa.string(), pa.string(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], [x.split()[0] for x in VOTES.split(", ")])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in small(batches):
        texts = []
        for html, path, kept, left in zip(texts_of(b, "html"), b["path"].to_pylist(), b["kept"].to_pylist(), b["left_out"].to_pylist()):
            texts.append(Page(html, dict.fromkeys(kept or (), True) | dict.fromkeys(left or (), False)).text(path))
        yield pa.RecordBatch.from_arrays([b["page_id"], b["url"], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])


def host_paths(hosted: DataFrame) -> DataFrame:
    """(host, path, kept, left_out, total): each host's winning container path, its verdicts on nominated paths, and its pages.

    As a nominated path counts from NOTED of the pages on, there are at most
    1 / NOTED times the nominated paths of a page.
    """
    cast = hosted.select("host", "html").mapInArrow(_vote, VOTES)
    votes = materialize(cast.groupBy("host", "path").agg(*[F.sum(c).alias(c) for c in ("pages", "keep", "out", "total")], F.sum(F.round("mass")).alias("mass")), "votes")
    totals = votes.where("path = ''").select("host", F.col("total").alias("all_pages"))
    paths = votes.where("path <> ''")
    # A host may have as many paths as pages.
    rows = salted_lookup(paths, totals, "host", hot_keys(totals, "host", "all_pages", max(1, paths.count())), F.xxhash64("path"))
    noted = (F.col("keep") + F.col("out")) >= NOTED * F.col("all_pages")
    order = F.when(F.col("pages") > 0, F.struct(F.col("pages"), F.col("mass"), F.col("path")))
    won = rows.groupBy("host").agg(
        F.max_by("path", order).alias("path"), F.collect_list(F.when(noted & (F.col("keep") > F.col("out")), F.col("path"))).alias("kept"),
        F.collect_list(F.when(noted & (F.col("keep") <= F.col("out")) & (F.col("out") > 0), F.col("path"))).alias("left_out"),
    )
    return totals.join(won, "host", "left").select("host", "path", "kept", "left_out", F.col("all_pages").alias("total"))


def extract_texts(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of pages (page_id, url, html)."""
    host = F.regexp_extract(F.lower(F.coalesce("url", F.lit(""))), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    hosted = pages.select("page_id", "url", "html", host.alias("host"))
    won = materialize(host_paths(hosted), "host_paths")
    total = won.agg(F.sum("total")).first()[0] or 0
    joined = salted_lookup(hosted, won.drop("total"), "host", hot_keys(won, "host", "total", total), F.xxhash64("page_id", "url"), "left")
    return joined.select("page_id", "url", "html", "path", "kept", "left_out").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_texts(read(spark, sf_dir, "pages"))
