"""Main text of web pages by a maximum-scoring subsequence.

A page is a sequence of words and tags.  Words score positive, less so (or negative) in containers that
labelled pages show to be beside the content; tags score negative, the more the rarer they are within content.
The contiguous stretch of the largest sum, found in one linear scan, is the content region; its words that score
positive are the text.  Labelled pages are those that mark their content themselves (one article or main
element); weights are log-odds of counts over a bounded sample of them, added to fixed priors for the names of
boilerplate, so that other templates work too.  Fixed priors of what wraps a page don't count: of html, body, elements
with nearly all of its words, those around its only main or article, and, on pages without one, of elements that hold most of
the running text.  A compound name tells what its head says: "sidebar-left" is a sidebar, "content-with-sidebar" is content and
"ad-free" neither; classes of a main or article itself never tell against it, nor does a prior that the labelled pages contradict.
Boilerplate within the only main or article is passed over at no cost, so that an article goes on after it.

The tokenizer and the scan are linear in the page, whatever is left unclosed; paragraphs, list items, cells and the like
end where HTML implies it.  A null or empty html gives an empty text; null ids and urls are passed through; repeated rows are extracted one
by one; an empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, sample_by_key

#: Elements without content of their own, elements within a line, raw elements that are dropped.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
RAW = ("script", "style", "noscript", "template", "textarea", "iframe", "svg", "annotation", "annotation-xml", "object", "canvas", "select", "button", "audio", "video")
#: Raw elements that go on to the end of a page when nothing closes them; those that never hold another of their name.
TO_THE_END, FLAT = frozenset(("script", "style", "textarea")), frozenset(("noscript", "iframe", "select", "button", "audio", "video", "canvas"))
CONTAINER = frozenset("article main aside nav header footer form head dialog menu".split())
#: Words of names, classes, ids and roles that tell what a container holds.
BESIDE = frozenset("ad ads advert advertisement adverts advertising sponsor sponsored promo promotion banner nav navbar navigation navi menu sidebar aside complementary footer foot form cookie cookies consent gdpr notice notices alert comment comments commentlist disqus reply replies respond share sharing social related recommended newsletter subscribe subscription signup login search breadcrumb breadcrumbs pagination pager widget popup modal overlay dialog skip copyright".split())
#: Words of compound names that say where or what kind of box, not what it holds; those that say what is not there.
BOX = frozenset("left right top bottom box list item items wrapper wrap container inner outer block section area bar link links site page global primary secondary panel button buttons form title div row col column grid global mobile desktop fixed sticky wide small large first last one two three old new default inline unit slot group set holder region zone placeholder".split())
LACKS = frozenset("with without has have no not non free less hide hidden is".split())
#: Names that tell comments and the like, which running text doesn't excuse.
NEVER_SPARED = frozenset("comment comments commentlist disqus reply replies respond nav navbar navigation navi menu footer foot cookie cookies consent breadcrumb breadcrumbs pagination pager".split())
#: Words of a block of running text at least, and the share of those that excuses a name.
RUNNING, MOST = 8, 0.5
MILD = frozenset("header masthead head topbar toolbar meta byline tags".split())
INSIDE = frozenset("article main content post entry story".split())
#: Elements that don't wrap a page, whatever they hold.
NEVER_WRAP = frozenset("nav aside footer menu".split())
#: Share of a page's words that makes an element its wrapper, and that its only main or article must hold to count as such.
NEARLY_ALL, MARKED = 0.9, 0.25
#: Elements whose own name outweighs being within an article.
STRONG, WEAK, BONUS = -9.0, -3.0, 3.0

#: Labelled pages (about) that weights are counted on, and the bounds of a learned weight.
TRAIN_PAGES, CLIP = 5_000, 4.0
#: Scores of a word (before its containers), of a usual and of the worst tag, of being a link, and of the worst word.
WORD, TAG, DEEPEST_TAG, LINK, WORST_WORD = 1.0, -0.05, -0.6, -0.5, -0.2

OPENING = re.compile(r"<(/?)([A-Za-z][^\s/>]*)")
#: The rest of a tag, in one pass: quoted values may hold a ">".
REST = re.compile(r"((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
#: Opening tags that end an open paragraph, and those that end an open element of their own kind within a list or table.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
ENDS_OWN = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Elements beyond which an opening tag ends nothing.
SCOPE = frozenset("html body article aside blockquote button caption details div fieldset figure footer form header main nav object section td th ul ol dl table menu".split())
NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
PART = re.compile(r"[a-z]+")
#: Class words that tell what a page has or lacks, not what an element is: taken whole.
STATE = re.compile(r"(?:no|not|non|has|have|with|without|is|hide|hides|show|shows|enable|disable|support|supports)[-_]")


@dataclass
class Weights:
    """Log-odds of container names and of tags: within content against beside it."""

    container: dict[str, float] = field(default_factory=dict)
    tag: dict[str, float] = field(default_factory=dict)
    prior: dict[str, float] = field(default_factory=dict)

    def of(self, name: str) -> float:
        """The weight of a container's name or class word: fixed prior and learned."""
        if (w := self.prior.get(name)) is None:
            fixed = STRONG if name in BESIDE else WEAK if name in MILD else BONUS if name in INSIDE else 0.0
            learned = self.container.get(name, 0.0)
            w = self.prior[name] = learned + (fixed if fixed * learned >= 0 else 0.0)
        return w

    def tag_score(self, name: str) -> float:
        return max(DEEPEST_TAG, min(TAG, self.tag.get(name, TAG)))


def heads(name: str) -> tuple[str, ...]:
    """What a class, id or role tells: itself, if it is one word; of a compound its head, the last word that is no box, and the whole."""
    parts = PART.findall(name)
    if len(parts) < 2:
        return tuple(parts)
    if STATE.match(name) or LACKS.intersection(parts):
        return (name,)
    head = next((p for p in reversed(parts) if p not in BOX), parts[-1])
    return (name, head)


def lexed(html: str):
    """(tag name or None, is closing, attributes of an opening tag, text, where it ends) in page order; linear in the page."""
    at, last, n = 0, html.rfind(">"), len(html)
    while at < n:
        begin = html.find("<", at)
        if begin < 0 or begin > last:  # no tag can end any more
            yield None, False, "", html[at:], n
            return
        if begin > at:
            yield None, False, "", html[at:begin], begin
        if html.startswith("<!--", begin):
            end = html.find("-->", begin + 4)
            at = n if end < 0 else end + 3
        elif html.startswith(("<!", "<?"), begin):
            at = html.find(">", begin) + 1
        elif (m := OPENING.match(html, begin)) is None:
            yield None, False, "", "<", begin + 1
            at = begin + 1
        else:
            rest = REST.match(html, m.end())
            # A quote that nothing closes: the tag ends at the next ">".
            at = rest.end() if rest else html.find(">", m.end()) + 1
            at = (yield m[2].lower(), bool(m[1]), html[m.end() : at - 1], "", at) or at


def tokens(html: str):
    """(tag name or None, is closing, features of an opening container, text) in page order; raw elements are left out, and end tags that HTML implies are told."""
    ends: dict[str, re.Match | None] = {}
    opened = Stack()
    source = lexed(html)
    skip = None
    while True:
        try:
            name, closing, rest, text, at = source.send(skip)
        except StopIteration:
            return
        skip = None
        if name is None:
            yield None, False, (), text
            continue
        if closing:
            opened.close(name)
            yield name, True, (), ""
            continue
        if name in RAW and not rest.endswith("/"):
            if name not in ends or ends[name] and ends[name].start() < at:
                ends[name] = re.compile(rf"</{name}\s*>", re.I).search(html, at)
            if (end := ends[name]) is None:
                skip = len(html) if name in TO_THE_END else None
            elif name not in FLAT or not re.compile(rf"<{name}[\s/>]", re.I).search(html, at, end.start()):
                skip = end.end()
            yield "raw", False, (), ""
            continue
        for implied in (("p",) if name in ENDS_P else ()) + ENDS_OWN.get(name, ()):
            if opened.within(implied, name):
                opened.close(implied)
                yield implied, True, (), ""
        if name not in VOID:
            opened.open(name)
        found: tuple[str, ...] = ()
        if name in CONTAINER or rest:
            words = [p for v in NAMED.findall(rest) for w in "".join(v).lower().split() for p in heads(w)] if rest else []
            if name in ("main", "article"):
                words = [w for w in words if w not in BESIDE and w not in MILD]
            found = (name, *words) if name in CONTAINER else tuple(words)
        yield name, False, found, ""


class Stack:
    """Open elements, with the places of each name: closing costs what it closes."""

    def __init__(self) -> None:
        self.names: list[str] = []
        self.at: dict[str, list[int]] = {}

    def open(self, name: str) -> None:
        self.at.setdefault(name, []).append(len(self.names))
        self.names.append(name)

    def close(self, name: str) -> int | None:
        """Closes the last open element of a name and all within it: its place, None if there is none."""
        if not (own := self.at.get(name)):
            return None
        k = own[-1]
        while len(self.names) > k:
            self.at[self.names.pop()].pop()
        return k

    def holds(self, name: str) -> bool:
        return bool(self.at.get(name))

    def within(self, name: str, opening: str) -> bool:
        """Whether an element of a name is open with no element of SCOPE within it (but, for rows of a table, their cells)."""
        if not (own := self.at.get(name)):
            return False
        cells = ("td", "th") if opening == "tr" else ()
        return all((self.at.get(s) or (-1,))[-1] <= own[-1] for s in SCOPE if s != name and s not in cells)


class Open:
    """The open elements of a page, with what each adds to the score of a word."""

    def __init__(self, weights: Weights):
        self.weights, self.opened, self.sums, self.features = weights, Stack(), [WORD], []
        self.live: dict[str, int] = {}  # features of open elements, each with how many have it

    def tag(self, name: str, closing: bool, found: tuple[str, ...], wraps: bool = False) -> None:
        if closing:
            if (k := self.opened.close(name)) is not None:
                for f in (f for x in self.features[k:] for f in set(x)):
                    self.live[f] -= 1
                    if not self.live[f]:
                        del self.live[f]
                del self.sums[k + 1 :], self.features[k:]
        elif name not in VOID and name != "raw":
            self.opened.open(name)
            self.features.append(found)
            for f in set(found):
                self.live[f] = self.live.get(f, 0) + 1
            self.sums.append(self.sums[-1] + sum(self.weights.container.get(f, 0.0) if wraps else self.weights.of(f) for f in set(found)) + (LINK if name == "a" else 0.0))

    def word(self) -> float:
        return max(WORST_WORD, min(WORD, self.sums[-1]))


def _held(page: list[tuple], within: set[int] | None) -> tuple[dict[int, tuple[int, int]], dict[str, list[tuple[int, list[int]]]], int, int]:
    """Words and words of running text that each opening tag holds, article and main tags with what is open around them, and both sums.

    What nav, aside, footer, comments and the like hold isn't counted, unless they are ``within`` (None: all is counted).
    """
    names, opened, held, marks = Stack(), [], {}, {"article": [], "main": []}
    words, running, run, beside = 0, 0, 0, 0  # run: words of the block so far; beside: open elements beside the text
    for k, (name, closing, found, text) in enumerate(page):
        if name is None:
            n = 0 if beside else len(text.split())
            words += n
            run += n
            continue
        if name not in INLINE or name == "a":  # a link is no running text
            running += run if run >= RUNNING else 0
            run = 0
        if closing:
            if (cut := names.close(name)) is not None:
                held.update((at, (words - before, running - ran)) for at, before, ran, _ in opened[cut:])
                beside -= sum(b for *_, b in opened[cut:])
                del opened[cut:]
        elif name not in VOID and name != "raw":
            if name in marks:
                marks[name].append((k, [at for at, *_ in opened] if not marks[name] else []))
            names.open(name)
            off = within is not None and k not in within and (name in NEVER_WRAP or not NEVER_SPARED.isdisjoint(found))
            beside += off
            opened.append((k, words, running, off))
    running += run if run >= RUNNING else 0
    held.update((at, (words - before, running - ran)) for at, before, ran, _ in opened)
    return held, marks, words, running


def wrappers(page: list[tuple]) -> tuple[set[int], int | None]:
    """Positions of the opening tags whose fixed priors don't count, and that of the page's only article (or main), if it holds enough of the text."""
    held, marks, words, _ = _held(page, None)
    spared = {k for k, (n, _) in held.items() if n >= NEARLY_ALL * words or page[k][0] in ("html", "body")}
    around = {at for own in marks.values() if len(own) == 1 for at in own[0][1]}
    held, marks, words, running = _held(page, {k for k in spared | around if page[k][0] not in NEVER_WRAP})
    marked = {name: own[0][0] for name, own in marks.items() if len(own) == 1 and words and held[own[0][0]][0] >= MARKED * words}
    for name in marked:
        spared.update(marks[name][0][1])
    if not marked:
        spared.update(k for k, (_, n) in held.items() if running and n > MOST * running and NEVER_SPARED.isdisjoint(page[k][2]))
    return {k for k in spared if page[k][0] not in NEVER_WRAP}, marked.get("article", marked.get("main"))


def extract(html: str | None, weights: Weights) -> str:
    """The main text: blocks in page order, white space as one space."""
    if not html:
        return ""
    state = Open(weights)
    pieces: list[tuple[float, str]] = []  # score, text; a block's end is a space
    page = list(tokens(html))
    wide, mark = wrappers(page)
    depth = None  # of the marked element, while it is open
    for k, (name, closing, found, text) in enumerate(page):
        if name is None:
            text = entities.unescape(text)
            n = len(text.split())
            pieces.append((n * state.word() if depth is None else max(n * state.word(), 0.0), text))
        else:
            beside = depth is not None and state.sums[-1] <= 0
            if k == mark:
                depth = len(state.sums)
            state.tag(name, closing, found, k in wide)
            if depth is not None and len(state.sums) <= depth:
                depth = None
            pieces.append((0.0 if beside and depth is not None else weights.tag_score(name), "" if name in INLINE or name == "raw" else " "))
    best, best_at, total, begin = 0.0, (0, 0), 0.0, 0
    for i, (score, _) in enumerate(pieces):
        if total <= 0:
            total, begin = 0.0, i
        total += score
        if total > best:
            best, best_at = total, (begin, i + 1)
    # Words that score negative stay out; white space and breaks between words stay in.
    return " ".join("".join(t for s, t in pieces[best_at[0] : best_at[1]] if s > 0 or not t.strip()).split())


def _counts(batch: pa.RecordBatch) -> pa.RecordBatch:
    """(kind, name, inside, n) over labelled pages: words by open container, tags."""
    found: Counter = Counter()
    for html in batch.column(0).to_pylist():
        t = list(tokens(html or ""))
        names = [n for n, closing, _, _ in t if n in ("article", "main") and not closing]
        if len(names) != 1:
            continue
        mark, state = names[0], Open(Weights())
        for name, closing, features, text in t:
            if name is None:
                n, inside = len(text.split()), state.opened.holds(mark)
                for f in state.live if n else ():
                    found["container", f, inside] += n
                found["container", "", inside] += n
            else:
                state.tag(name, closing, features)
                if name != mark:
                    found["tag", name, state.opened.holds(mark)] += 1
                    found["tag", "", state.opened.holds(mark)] += 1
    keys = list(zip(*found, strict=True)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(keys[0], pa.string()), pa.array(keys[1], pa.string()), pa.array(keys[2], pa.bool_()), pa.array(list(found.values()), pa.int64())], names=["kind", "name", "inside", "n"])


#: Names that a model keeps at most, the most frequent ones.
NAMES = 5_000


def fit(pages: DataFrame, train_pages: int = TRAIN_PAGES) -> Weights:
    sample = sample_by_key(pages.select("page_id", F.col("html").cast("string").alias("html")), "page_id", train_pages).select("html")
    sums = map_batches(sample, _counts, "kind string, name string, inside boolean, n long").groupBy("kind", "name").agg(F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("inside"), 0).otherwise(F.col("n"))).alias("b"))
    rows = {(r["kind"], r["name"]): (r["a"], r["b"]) for r in sums.orderBy(F.desc(F.col("a") + F.col("b")), "kind", "name").limit(NAMES).collect()}
    out = Weights()
    for (kind, name), (a, b) in rows.items():
        ta, tb = rows[kind, ""]
        if name and a + b >= 20 and ta and tb and name not in ("html", "body"):
            odds = math.log((a + 1) / (ta + 2)) - math.log((b + 1) / (tb + 2))
            (out.container if kind == "container" else out.tag)[name] = max(-CLIP, min(CLIP, odds))
    # What lies around all content tells nothing, and parts of it are told apart by their own names.
    return out


def extract_pages(pages: DataFrame, weights: Weights | None = None) -> DataFrame:
    """Per page: page_id, url, text, n_chars (code points)."""
    weights = weights or fit(pages)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [extract(h, weights) for h in batch.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return map_batches(pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")), run, "page_id long, url string, text string, n_chars long")


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES = {"op7_html_extraction": op7_html_extraction}
