"""Main text of web pages by line-block distribution.

Markup is stripped and each block of a page becomes a line, which weighs as many characters as it has outside links; a block of
prose (paragraph, heading, quotation) weighs ``PROSE`` at least. The sums of weights over a sliding window of ``WINDOW`` lines rise to
``SURGE`` where a body of text begins (surge) and fall below it where the body ends (dive). Lines at a run's ends that only its neighbours
lifted, short ones that are no prose, go with the menu they belong to. Of the runs the heaviest is kept and every other
one that is dense: of long lines, and mostly outside links.

Parts that say that they are no article (menus, page headers, footers, sidebars, notices, adverts, forms, scripts, styles, reader
comments) weigh nothing: whole page regions leave a gap as wide as the window, small insets a narrower one, so that an inset does not end the
text around it. An element is such a part by its tag, or by a class, id or role all of whose words say so; if nothing is left that
way, only names of comments are believed, and runs with several lines of prose are kept.

``article`` and ``main`` are weights: what stands in them reaches a surge by itself and what does not weighs nothing, if as much text is marked so as any run
beside it holds; a page whose marked text is a teaser next to a longer story is read as if nothing were marked. Without marks a run is held
against the page's boxes: lines at its ends that stand outside the box with most of its text, alone and neither prose nor long beside it, are
no part of it. Rows of nothing but links (menus) and calls to sign up or to accept cookies are left out inside of runs too.
"""

from __future__ import annotations

import html
import re
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textops import batches

#: Lines in a window of the distribution.
WINDOW = 3
#: Weight of a window from which it is text, least weight of a line of prose, and weight that a line of no prose needs at a run's end.
SURGE, PROSE, END = 40, 40, 20
#: Mean length of line, each character counted alike, from which a run is dense, and the share of it that may be links.
LINE, LINKED = 40, 1 / 3
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>|<[!?][^>]*>""", re.S)
_RAW = {t: re.compile(rf"</{t}\s*>|\Z", re.I) for t in ("script", "style", "noscript", "template", "svg", "textarea", "iframe", "object", "canvas", "math", "title")}
_INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that are regions of a page beside its article.
_REGION = {"nav", "footer", "aside", "header", "head", "menu"}
#: Elements that are insets.
_INSET = {"form", "button", "select", "dialog", "fieldset", "audio", "video"}
#: Elements that hold blocks, and how many open ones a closing tag may close.
_BOX = {"div", "section", "article", "main", "body", "ul", "ol", "dl", "table", "tbody", "tr", "td", "center", "figure", "details"}
BOXES = 50
#: Elements that hold prose, however short.
_PROSE = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "dd", "figcaption"}
_NAMES = re.compile(r"""\b(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_REGION_WORDS = set("nav navbar navigation menu footer sidebar breadcrumb breadcrumbs masthead complementary contentinfo banner comments comment disqus related recommended teaser teasers".split())
_INSET_WORDS = set("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent notice notices alert popup modal newsletter subscribe subscription signup login share sharing social widget toolbar pager pagination respond replies".split())
#: Words of layout that say nothing of what an element holds.
_LAYOUT_WORDS = set("area bar block bottom box button buttons card column container content extra fixed form global group header holder inline inner item items left link links list main mobile module outer page panel post posts primary right row secondary section site slot small stories sticky tools top unit wrap wrapper".split())
_QUOTED = re.compile(r""""[^"]*"|'[^']*'""")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?=[\s=/]|$)", re.I)
_UNSEEN = re.compile(r"""aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_COMMENT_WORDS = {"comments", "comment", "disqus", "respond", "replies"}
#: Words beside them in names of comment sections, names of comments outside of marked text, and names that an ``article`` is believed.
_TALK_WORDS = set("user users reader readers visitor visitors guest guests thread threads discussion view views feed form new latest all count".split())
_TALK = {"discussion", "discussions"}
_TEASER_WORDS = set("teaser teasers related recommended promo promotion sponsored advert advertisement ad".split())
#: A short line that is a notice, whatever element holds it.
_NOTICE = re.compile(r"(?:sign up (?:to|for) .*newsletter|subscribe to .*newsletter|(?:we|this site|this website) uses? cookies|accept (?:all )?cookies)\b.{0,20}$", re.I)
NOTICE = 80
#: Share of a run's weight from which a box holds the body, and share of the body that lines beside it need.
BOX, BESIDE = 0.6, 0.25


def _said(attributes: str) -> set[str]:
    """Words for boilerplate in an element's names, of names without any other word."""
    out: set[str] = set()
    for m in _NAMES.finditer(attributes):
        for name in (m[1] or m[2] or m[3] or "").split():
            words = {w.lower() for w in _WORDS.findall(name)}
            if words & _COMMENT_WORDS and words <= _REGION_WORDS | _INSET_WORDS | _LAYOUT_WORDS | _TALK_WORDS:
                out |= words & _COMMENT_WORDS
            if words & _TALK and words <= _LAYOUT_WORDS | _TALK_WORDS | _TALK:
                out |= words & _TALK
            if words <= _REGION_WORDS | _INSET_WORDS | _LAYOUT_WORDS:
                out |= words - _LAYOUT_WORDS
    return out


def _kind(tag: str, attributes: str, in_body: bool, named: bool) -> tuple[int, bool]:
    """(gap that the element leaves, or 0 if it stays; whether it holds reader comments). ``named``: names other than those of comments are believed."""
    if tag == "header":
        return (0, False) if in_body else (WINDOW, False)
    if tag in _REGION:
        return WINDOW, False
    if tag in _INSET:
        return 1, False
    if not attributes or tag in ("html", "body", "main"):
        return 0, False
    words = _said(attributes)
    if not named:
        words &= _COMMENT_WORDS
    if words & _COMMENT_WORDS or (words & _TALK and not in_body):
        return WINDOW, True
    words -= _TALK
    if tag == "article":
        return (WINDOW if words & _TEASER_WORDS else 0), False
    if words & _REGION_WORDS:
        return WINDOW, False
    return (1, False) if words or _HIDDEN.search(_QUOTED.sub('""', attributes)) or _UNSEEN.search(attributes) else (0, False)


def _closed(page: str) -> set[int]:
    """Where the opening tags end whose elements are closed somewhere; a closing tag closes the last open one of its name."""
    out, opened, at, end = set(), {}, 0, page.rfind(">") + 1
    while m := _TOKEN.search(page, at, end):
        at, name, closing = m.end(), (m[2] or m[5] or "").lower(), bool(m[1] or m[4])
        if name in _RAW and not closing:
            at = _RAW[name].search(page, at).end()
        elif name and not closing:
            opened.setdefault(name, []).append(at)
        elif name and opened.get(name):
            out.add(opened[name].pop())
    return out


class Line(NamedTuple):
    """A block of a page; without a text, a stripped part."""

    text: str = ""
    body: bool = False  # in article or main
    linked: int = 0  # characters in links
    prose: bool = False
    box: int = 0  # innermost element that holds blocks, in order of opening

    @property
    def weight(self) -> int:
        own = len(self.text) - self.linked
        return max(own, PROSE) if self.prose and own > self.linked else own


def lines(page: str, named: bool = True) -> tuple[list[Line], list[int]]:
    """Blocks of a page in order, and the parent of each box."""
    out: list[Line] = []
    boxes, parent = [("", 0)], [0]
    parts: list[str] = []
    # a tag needs a ">", so none begins after the last: that bounds the search for one that is never closed
    body, skip, depth, comments, at, end, last = 0, "", 0, False, 0, len(page), page.rfind(">") + 1
    begin, closed, link, linked, prose = 0, None, False, 0, False

    def close() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Line(text, body > 0, min(linked, len(text)), prose, boxes[-1][1]))
            parts.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        parts.append(text)
        if link:
            linked += len(text.strip())

    while at < end:
        m = _TOKEN.search(page, at, last) if at < last else None
        if m is None:
            if not skip:
                add(page[at:])
            break
        if not skip and m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        if m[0].startswith("<!--") and not m[0].endswith("-->"):
            break  # never closed: all that follows is a comment
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing, attributes = bool(m[1] or m[4]), m[3] or m[6] or ""
        if tag in _RAW and not closing:
            if attributes.endswith("/") and tag in ("svg", "math"):
                continue
            at = _RAW[tag].search(page, at).end()
            continue
        if skip:
            freed = tag in ("article", "main") and not closing and not comments and skip != tag
            if freed and (body or skip in _REGION):  # a teaser, unless the region was never closed
                closed = _closed(page) if closed is None else closed
                freed = begin not in closed
            if freed:
                skip = ""
            else:
                if tag == skip:
                    depth += -1 if closing else 1
                    if depth == 0:
                        skip = ""
                continue
        if not closing and tag not in _VOID and not attributes.endswith("/"):
            gap, talk = _kind(tag, attributes, body > 0, named)
            if gap:
                close()
                if not body:
                    out.extend([Line()] * gap)
                skip, depth, comments, begin = tag, 1, talk, at
                continue
        if tag == "a":
            link = not closing and "href" in attributes.lower()
        if tag in _INLINE:
            continue
        close()
        if tag in _BOX:
            if not closing:
                parent.append(boxes[-1][1])
                boxes.append((tag, len(parent) - 1))
            elif any(t == tag for t, _ in boxes[-BOXES:]):
                while boxes.pop()[0] != tag:
                    pass
        link = link and not closing  # a link that was never closed ends with its block
        if tag not in _VOID:
            prose = tag in _PROSE and not closing
        if tag in ("article", "main"):
            out.extend([Line()] * (WINDOW if body <= 1 else 0))
            body = max(0, body - 1) if closing else body + 1
    close()
    return out, parent


def between_surges_and_dives(weights: list[int | None], window: int = WINDOW, surge: int = SURGE) -> list[tuple[int, int]]:
    """First and past-the-last line of each run: from where the window's sum reaches ``surge`` (or the highest there is) until no window does.

    A stripped line's weight is None; runs neither begin nor end with one.
    """
    n, known = len(weights), [x or 0 for x in weights]
    sums = [sum(known[max(0, k - window + 1) : k + 1]) for k in range(n)]  # of the window that ends with line k
    sums += [sum(known[k:]) for k in range(max(0, n - window + 1), n)]  # and of those that reach beyond the last
    least = min(surge, max(sums, default=0))
    runs: list[tuple[int, int]] = []
    for k, total in enumerate(sums):
        if total >= least > 0:
            a, b = max(0, k - window + 1), min(k + 1, n)
            while weights[a] is None:
                a += 1
            while weights[b - 1] is None:
                b -= 1
            if runs and a <= runs[-1][1]:
                runs[-1] = (runs[-1][0], max(b, runs[-1][1]))
            else:
                runs.append((a, b))
    return runs


def _run(found: list[Line], a: int, b: int) -> list[Line]:
    """Lines of a run without ends that only their neighbours lifted: short ones that are no prose, and links one after another."""
    link = lambda k: 0 <= k < len(found) and bool(found[k].text) and found[k].weight == 0
    fits = [k for k in range(a, b) if found[k].weight >= END or (found[k].prose and link(k) and not link(k - 1) and not link(k + 1))]
    return [x for x in (found[fits[0] : fits[-1] + 1] if fits else found[a:b]) if x.text]


def _dense(run: list[Line]) -> bool:
    size = sum(len(x.text) for x in run)
    return sum(len(x.text) ** 2 for x in run) >= LINE * size and sum(x.linked for x in run) <= LINKED * size


def _main_box(run: list[Line], parent: list[int]) -> tuple[int, int]:
    """First and last box of the innermost element that holds ``BOX`` of a run's weight (of its prose, if it has any): boxes are numbered in order of opening, so those inside one follow it."""
    weight, last = [0] * len(parent), list(range(len(parent)))
    prose = any(x.prose for x in run)
    for x in run:
        weight[x.box] += x.weight if x.prose or not prose else 0
    for k in range(len(parent) - 1, 0, -1):
        weight[parent[k]] += weight[k]
        last[parent[k]] = max(last[parent[k]], last[k])
    here = 0
    for k in range(1, len(parent)):  # a heavy child of the current box, then of that, as they open
        if parent[k] == here and weight[k] >= BOX * weight[0] > 0:
            here = k
    return here, last[here]


def _in_box(run: list[Line], parent: list[int]) -> list[Line]:
    """A run without what stands at its ends outside its main box: a line alone, that is no prose or short beside the body."""
    first, last = _main_box(run, parent)
    inside = [first <= x.box <= last for x in run]
    if not any(inside):
        return run
    a, b = inside.index(True), len(run) - inside[::-1].index(True)
    size = sum(x.weight for x in run[a:b])
    prose = any(x.prose for x in run[a:b])

    def stays(part: list[Line]) -> bool:
        return sum(x.weight for x in part) >= BESIDE * size if not prose else len(part) > 1 and sum(x.prose for x in part) > 1 or any(x.prose and x.weight >= BESIDE * size for x in part)

    return [x for part, kept in ((run[:a], stays(run[:a])), (run[a:b], True), (run[b:], stays(run[b:]))) if kept for x in part]


def _clean(run: list[Line]) -> list[str]:
    """Texts of a run without rows of nothing but links and without notices."""
    only = [not x.prose and 10 * x.linked >= 9 * len(x.text) for x in run] + [False]
    menu = [link and (only[k + 1] or (k > 0 and only[k - 1])) for k, link in enumerate(only[:-1])]
    return [x.text for x, m in zip(run, menu) if not m and not (len(x.text) < NOTICE and _NOTICE.match(x.text))]


def main_text(page: str | None) -> str:
    """The article of a page: its blocks, one per line; empty if there is none."""
    for named in (True, False):
        found, parent = lines(page or "", named)
        weigh = lambda x: x.weight if x.text else None
        beside = [weigh(x) if not x.body else None for x in found]
        marked = sum(x.weight for x in found if x.body)
        if any(x.body for x in found) and marked >= max((sum(w or 0 for w in beside[a:b]) for a, b in between_surges_and_dives(beside)), default=0):
            weights = [(max(x.weight, SURGE) if x.linked < len(x.text) or x.prose else 0) if x.body and x.text else None for x in found]
            kept = [x for a, b in between_surges_and_dives(weights) for x in found[a:b] if x.body and x.text]
            return "\n".join(_clean(kept or [x for x in found if x.body]))
        runs = [_run(found, a, b) for a, b in between_surges_and_dives([weigh(x) for x in found])]
        if runs and named:
            most = max(range(len(runs)), key=lambda k: (sum(x.weight for x in runs[k]), -k))
            alone = lambda run: len(run) == 1 and not run[0].prose and any(x.prose for x in runs[most])
            return "\n".join(t for k, run in enumerate(runs) if k == most or (_dense(run) and not alone(run)) for t in _clean(_in_box(run, parent)))
    return "\n".join(t for run in runs if _dense(run) and sum(x.prose for x in run) >= WINDOW for t in _clean(run))


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Columns of ``pages`` under ``row_`` (without the html), text, n_chars (code points).

    Null and empty html have an empty text, as has a page without any text outside links. Pages of any length are read whole; repeated rows are extracted
    one by one; an empty table gives an empty result. Of runs that weigh alike the first is the heaviest.
    """
    source = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns if c != html_col]).alias("row_"), F.col(f"`{html_col}`").alias("h_"))
    schema = f"row_ {source.schema['row_'].dataType.simpleString()}, text string, n_chars long"

    def run(rows):
        for whole in rows:
            for batch in batches(whole, "h_"):
                texts = [main_text(h) for h in batch.column("h_").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("row_"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["row_", "text", "n_chars"])

    return source.mapInArrow(run, schema)
