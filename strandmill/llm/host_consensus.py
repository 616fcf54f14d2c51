"""HTML extraction by consensus host paths.

Each page is parsed into elements and text blocks; blocks under menus, headers, footers, sidebars, notices, adverts, forms
and reader comments are marked. A page's own best container is found by descending from the root while one child holds
nearly all unmarked text outside links, but not out of an article or main element, nor where text of the parent's own, an h1, or
another child of the same kind (or a quotation or section) would be left behind. Its generalised path (tags with classes, digits as #,
places left out), as a running hash, is the page's vote. Votes are counted by host in Spark; a second pass extracts from the container
that the host's pages agree on, and from the page's own one where none of the host's winning paths occurs with text, so that a page
loses nothing to a path that its host has few votes for.

What is marked: elements that are no part of an article by their name or role (nav, aside, form, a header outside an article, ...), and elements
with a class or id that says so as a whole ("sidebar", "cookie-notice", "related-posts"). A word within a longer name ("search-results",
"related-work", "has-sidebar") is no such sign: those are marked only where most of their text is in links.

The scanner reads a page once, in time proportional to its length, whatever its bytes: places of later '>', quotes and end tags that
aren't there are remembered, and open elements are counted by name. A tag that the page's end cuts off is dropped. Only script, style, title, textarea and iframe hold raw text.

Winners (ten hashes a host) are broadcast where there are few hosts, which is counted; else they meet the pages on (host, salt).

Defined cases: a null html is empty and has empty text; a null url has the host ''. Broken markup (unclosed or stray tags) never
fails. Paths of equal votes go by the text they hold, then by hash. Repeated rows vote and are extracted each. An empty table gives an
empty result. A very long page is one row like any other. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, join_small

#: A path wins on a host with this share of its votes at least.
LEAST_SHARE = 0.1
DESCEND = 0.7
#: Of elements that a part of their name points to, those go whose text is in links by this share.
LINKED = 0.5

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
GAP = re.compile(r"[\s/]*")
ATTRIBUTE = re.compile(r"[^\s/>=][^\s/>=]*")
EQUALS = re.compile(r"\s*=\s*")
BARE = re.compile(r"[^\s>]*")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup.
RAW = frozenset("script style title textarea iframe".split())
#: Elements whose content is no text of the page, unless they are never closed.
OTHER = frozenset("noscript template svg object canvas audio video select".split())
ENDS = re.compile(r"</(" + "|".join(sorted(RAW | OTHER)) + r")(?=[\s/>])", re.I)
BLOCK = frozenset("html body p div section article main h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th blockquote pre figure figcaption header footer aside nav form fieldset hr address details summary center menu dialog".split())
#: Elements that can be the container of an article.
CONTAINER = frozenset("html body div section article main td center blockquote".split())
#: A start tag closes open elements of these names, up to the nearest one that bounds them.
CLOSES = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table"))}
OUTSIDE = frozenset("nav footer aside form button dialog menu option".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner menu nav navbar navigation sidebar footer header masthead topbar toolbar cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login search share sharing social comment comments disqus replies related recommended breadcrumb breadcrumbs pagination pager widget widgets hidden".split()
)
#: Words that say no more than what kind of box it is that one of NAMES names.
KINDS = frozenset("area bar block box button buttons container form global group icon icons inner item items left link links list main module outer page panel pane posts primary right row secondary section site slot text top bottom unit wrap wrapper a the".split())
#: Names that stand for the whole at the end of a longer one, unless it starts with one of DENIES.
LAST = frozenset("comments comment sidebar footer nav navigation navbar menu breadcrumb breadcrumbs pagination ads advert banner newsletter share sharing".split())
DENIES = frozenset("has with no without hide".split())
PARTS = re.compile(r"[^a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
DIGITS = re.compile(r"\d+")


def named(names: str) -> int:
    """Of class and id: 2 if one of the names says that an element is no part of an article, 1 if a part of one hints at it, else 0."""
    found = 0
    for name in names.split():
        parts = [x for x in PARTS.split(CAMEL.sub("-", name).lower()) if x]
        if not NAMES.intersection(parts) or DENIES.intersection(parts):
            continue
        if all(x in NAMES or x in KINDS for x in parts) or parts[-1] in LAST:
            return 2
        found = 1
    return found


class Page:
    """Elements (parent, path, own score) and blocks (element, text, marked)."""

    __slots__ = ("blocks", "name", "parent", "path", "score", "titled")

    def __init__(self, source: str):
        self.parent, self.path, self.name, self.score, self.titled = [-1], [0], [""], [0.0], [False]
        self.blocks: list[tuple[int, str, bool]] = []
        # The open elements: name, element number, marked, in an article, in a link, in an h1, first block and linked and all text so far if hinted at.
        stack: list[tuple[str, int, bool, bool, bool, bool, tuple[int, int, int] | None]] = [("", 0, False, False, False, False, None)]
        count: Counter[str] = Counter()
        held: list[str] = []
        linked, at, n = 0, 0, len(source)
        all_linked = all_text = 0
        last_gt, none_after = source.rfind(">"), {'"': n, "'": n}
        ends: dict[str, list[int]] = {}
        for m in ENDS.finditer(source):
            ends.setdefault(m[1].lower(), []).append(m.start())

        def flush() -> None:
            nonlocal linked, all_linked, all_text
            if held:
                text = "".join(held)
                if "&" in text:
                    text = html.unescape(text)
                text = " ".join(text.split())
                if text:
                    _, element, marked, _, _, titled, _ = stack[-1]
                    self.blocks.append((element, text, marked))
                    all_linked += min(linked, len(text))
                    all_text += len(text)
                    if not marked:
                        self.score[element] += max(len(text) - linked, 0)
                        self.titled[element] |= titled
                held.clear()
            linked = 0

        def add(text: str) -> None:
            nonlocal linked
            if text and not stack[-1][2]:
                held.append(text)
                if stack[-1][4]:
                    linked += len(text)

        def close(k: int) -> None:
            """Ends stack[k:]."""
            if any(s[0] in BLOCK or s[6] for s in stack[k:]):
                flush()
            for s in stack[k:]:
                count[s[0]] -= 1
            for s in reversed(stack[k:]):
                if s[6]:
                    first, links_then, text_then = s[6]
                    if all_linked - links_then > LINKED * (all_text - text_then):
                        for b in range(first, len(self.blocks)):
                            element, text, marked = self.blocks[b]
                            if not marked:
                                self.blocks[b] = element, text, True
                                self.score[element] = max(0.0, self.score[element] - len(text))
            del stack[k:]

        def close_to(names: tuple[str, ...], bounds) -> None:
            if any(count[x] for x in names):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] in names:
                        close(k)
                        return
                    if stack[k][0] in bounds:
                        return

        while at < n:
            lt = source.find("<", at)
            if lt < 0 or lt > last_gt:
                rest = source[at:] if lt < 0 else source[at:lt]
                add(rest)
                if lt >= 0 and not re.match(r"<[a-zA-Z/!?]", source[lt : lt + 2]):
                    at = lt + 1
                    add("<")
                    continue
                break
            add(source[at:lt])
            at = lt + 1
            sign = source[at : at + 1]
            if sign in ("!", "?"):
                if source.startswith("!--", at):
                    end = source.find("-->", at + 3)
                    at = n if end < 0 else end + 3
                else:
                    end = source.find(">", at)
                    at = n if end < 0 else end + 1
                continue
            closing = sign == "/"
            m = NAME.match(source, at + closing)
            if m is None:
                if closing:
                    end = source.find(">", at)
                    at = n if end < 0 else end + 1
                else:
                    add("<")
                continue
            name, at = m[0].lower(), m.end()
            attributes: dict[str, str] = {}
            while source[at : at + 1] != ">":
                at = GAP.match(source, at).end()
                if at >= n or source[at] == ">":
                    break
                m = ATTRIBUTE.match(source, at)
                if m is None:  # a stray '='
                    at += 1
                    continue
                key, at, value = m[0].lower(), m.end(), ""
                if m := EQUALS.match(source, at):
                    at = m.end()
                    quote = source[at : at + 1]
                    if quote in ('"', "'") and at < none_after[quote]:
                        end = source.find(quote, at + 1)
                        if end < 0:
                            none_after[quote] = at
                        else:
                            value, at = source[at + 1 : end], end + 1
                            attributes.setdefault(key, value)
                            continue
                    m = BARE.match(source, at)
                    value, at = m[0], m.end()
                attributes.setdefault(key, value)
            empty = at < n and source[at - 1] == "/"
            if at >= n:
                break  # the page ends within a tag
            at += 1
            if closing:
                if count[name]:
                    for k in range(len(stack) - 1, 0, -1):
                        if stack[k][0] == name:
                            close(k)
                            break
                continue
            if name in RAW or name in OTHER:
                own = ends.get(name, [])
                k = bisect_left(own, at)
                if name in RAW:
                    held.append(" ")
                    if k < len(own):
                        end = source.find(">", own[k])
                        at = n if end < 0 else end + 1
                    elif name in ("script", "style"):
                        break
                    continue
                if empty or k == len(own):
                    held.append(" ")
                    continue
            if name in VOID:
                held.append(" ")
                if name == "hr":
                    flush()
                continue
            if name in BLOCK:
                for x in ("option", "select", "svg"):
                    if count[x]:
                        close_to((x,), ())
                if count["p"]:
                    close_to(("p",), BLOCK - {"p"})
                if name in CLOSES:
                    close_to(*CLOSES[name])
                flush()
            elif empty and name in ("path", "rect", "circle", "use", "mspace"):
                continue
            _, element, marked, inside, link, titled, _ = stack[-1]
            inside = inside or name in ("article", "main")
            hint, classes = None, ""
            if attributes and name != "a":
                attributes = {k: html.unescape(v) if "&" in v else v for k, v in attributes.items()}
                classes = attributes.get("class", "")
                sure = self.outside(name, attributes, inside)
                marked = marked or sure == 2
                if sure == 1 and not marked:
                    flush()
                    hint = len(self.blocks), all_linked, all_text
            marked = marked or name in OUTSIDE or name in OTHER or (name == "header" and not inside)
            if name in CONTAINER:
                step = name + "".join(f".{c}" for c in sorted(DIGITS.sub("#", classes.lower()).split()))
                self.parent.append(element)
                self.path.append(xxhash.xxh64_intdigest(f"{self.path[element]}/{step}".encode("utf-8", "replace")) >> 1)
                self.name.append(step)
                self.score.append(0.0)
                self.titled.append(False)
                element = len(self.path) - 1
            stack.append((name, element, marked, inside, link or name == "a", titled or name == "h1", hint))
            count[name] += 1
        flush()
        close(1)

    @staticmethod
    def outside(name: str, attributes: dict[str, str], inside: bool) -> int:
        """2 if the attributes say that an element is no part of an article, 1 if a part of its names hints at it, else 0."""
        if name in ("html", "body", "article", "main"):
            return 0
        if attributes.get("role", "").lower() in ROLES or "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or "display:none" in attributes.get("style", "").replace(" ", "").lower():
            return 2
        names = " ".join(x for x in (attributes.get("class", ""), attributes.get("id", "")) if x)
        if inside:
            names = " ".join(x for x in names.split() if x.lower() not in ("header", "hidden"))
        return named(names) if names else 0

    def totals(self) -> list[float]:
        total = list(self.score)
        for k in range(len(total) - 1, 0, -1):
            total[self.parent[k]] += total[k]
        return total

    def own_best(self) -> int:
        """The deepest container that holds nearly all of what its parent holds and leaves no part of an article behind."""
        total, titled = self.totals(), list(self.titled)
        for k in range(len(titled) - 1, 0, -1):
            titled[self.parent[k]] |= titled[k]
        name = lambda k: self.name[k]
        plain = lambda k: self.name[k].partition(".")[0]
        children: dict[int, list[int]] = {}
        for k in range(1, len(total)):
            children.setdefault(self.parent[k], []).append(k)
        at = 0
        while own := children.get(at):
            top = max(own, key=lambda k: total[k])
            if total[top] <= 0 or total[top] < DESCEND * total[at] or plain(at) in ("article", "main"):
                break
            left = [k for k in own if k != top and total[k] > 0]
            if plain(top) not in ("article", "main") and (self.score[at] > 0 or any(titled[k] or name(k) == name(top) or plain(k) in ("blockquote", "section") for k in left)):
                break
            at = top
        return at

    def text(self, chosen: set[int]) -> str:
        under = [False] * len(self.path)
        for k in range(len(under)):
            under[k] = k in chosen or (k > 0 and under[self.parent[k]])
        return "\n\n".join(t for e, t, marked in self.blocks if under[e] and not marked)

    def extract(self, winners: list[int]) -> str:
        for path in winners:
            if found := self.text({k for k, p in enumerate(self.path) if p == path}):
                return found
        return self.text({self.own_best()})


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        hosts, paths, scores = [], [], []
        for host, source in zip(b.column("host"), b.column("html"), strict=True):
            page = Page(source.as_py())
            best, total = page.own_best(), page.totals()
            if best and total[best] > 0:
                hosts.append(host.as_py())
                paths.append(page.path[best])
                scores.append(int(total[best]))
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.int64()), pa.array(scores, pa.int64())], ["host", "path", "score"])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [Page(source.as_py()).extract(paths.as_py() or []) for source, paths in zip(b.column("html"), b.column("paths"), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def winning_paths(pages: DataFrame) -> DataFrame:
    """host, paths: those with LEAST_SHARE of the host's votes, most votes first (ten at most)."""
    votes = pages.select("host", "html").mapInArrow(_votes, "host string, path long, score long")
    counted = votes.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("score").alias("score"))
    share = counted.withColumn("all", F.sum("n").over(Window.partitionBy("host"))).where(F.col("n") >= LEAST_SHARE * F.col("all"))
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), (-F.col("score")).alias("s"), "path")))
    return share.groupBy("host").agg(F.transform(ranked, lambda x: x["path"]).alias("paths"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars."""
    host = F.regexp_extract(F.lower(F.coalesce("url", F.lit(""))), r"^[a-z][a-z0-9+.-]*://([^/?#]*)", 1)
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host.alias("host"))
    winners = Scratch(pages.sparkSession).write(winning_paths(rows))
    joined = join_small(rows, winners, "host", F.xxhash64("page_id", "url")).select("page_id", "url", "html", "paths")
    return joined.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
