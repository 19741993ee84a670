"""Main text of web pages: the best-scoring contiguous region of words and tags.

A page becomes a sequence of words and tags. Words score positive and tags negative, by weights that labelled pages teach;
one linear scan finds the contiguous run of the largest sum. Labelled pages are those that mark their content themselves, by
one <article> or <main>: a tag costs the more, the more often it stands outside that element; words outside it score
negative on a page that marks its content; and the class names, ids and roles of elements that only stand outside it are
learnt as those of menus, adverts and the like. Such elements (noise) have no words to score and cost one fixed crossing,
nothing within marked content. A list of such names is the prior: a name counts whole, or if it is made of such words and of
words for parts of a page. What holds the content (the page's main, only article or heading, and half of its text) is never noise. Last, the region grows to the element that holds it: what the scan would cut off there
(a table, a short last paragraph) belongs to the text.
"""

from __future__ import annotations

import html as html_lib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import UNSPACED

#: Labelled pages that the weights are learnt from, at most.
TRAINING_PAGES = 1000
# Tags of HTML by their part in a page.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark meter q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr".split())
RAW = frozenset("script style title textarea noscript template iframe object svg math canvas audio video noframes xmp select option datalist".split())
UNBROKEN = INLINE | RAW - frozenset(("title", "noframes", "xmp"))
ASIDE = frozenset("nav header footer aside form button dialog menu fieldset label input search".split())
SECTION = frozenset("article main body html head nav header footer aside form".split())
CONTENT = frozenset(("article", "main"))
PARAGRAPH = frozenset("p li dt dd td th h1 h2 h3 h4 h5 h6 pre figcaption caption summary".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
KNOWN = INLINE | RAW | ASIDE | SECTION | VOID | frozenset("address section blockquote caption center colgroup dd details div dl dt figcaption figure h1 h2 h3 h4 h5 h6 hgroup legend li ol p pre summary table tbody td tfoot th thead tr ul".split())
# Elements that end where one of these begins.
ENDS = {k: frozenset(v.split()) for k, v in {"li": "li", "dt": "dt dd", "dd": "dt dd", "td": "td th", "th": "td th", "tr": "td th tr", "tbody": "td th tr thead tbody", "tfoot": "td th tr tbody"}.items()}
# Names in class, id or role that mark what isn't content, beside those that labelled pages teach; and words that stand beside them in longer names.
NOISE = frozenset(
    "ad ads adsense advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist complementary consent contentinfo cookie cookies discussion disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification pagination popup promo promoted related replies respond share sharing sidebar signup skip social sponsor sponsored sponsors subscribe toolbar widget".split()
)
FILLER = frozenset("area bar block blocks bottom box btn buttons cell center col column container fixed floating form global group icon icons inner item items left link links list main mobile module outer overlay page panel post posts primary right row secondary section site slot small sticky tab text title top unit view wrap wrapper zone".split())
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*(?:"[^"]*"|'[^']*'|(?!["'])))*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
_CLOSE = re.compile(r"</([a-zA-Z][^\s/>]*)")
_NAMED = re.compile(r"""(?:^|[\s"'/])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PART = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z0-9]+")
_SPACE = re.compile(r"\s+")

#: Costs in words: of any tag at least, at most if it stands outside content only, of a section's border and of crossing noise.
LEAST, MOST, BORDER, CROSSING = 0.1, 4.0, 25.0, 1.0
DEFAULT = {t: (LEAST if t in INLINE or t in ("p", "br", "h1", "h2", "h3", "h4", "blockquote", "pre") else 1.0) for t in KNOWN}
#: A name is noise if labelled pages have it outside content this many times as often as inside; sightings inside start at INSIDE.
RATIO, INSIDE = 2.0, 10


@dataclass
class Weights:
    """What labelled pages teach: costs of tags and names (of class, id or role) of noise."""

    cost: dict[str, float]
    noise: frozenset[str] = NOISE


@dataclass
class Page:
    """Tokens in page order: (kind, value, element), kind "text", "tag" or "end", element the innermost open one.

    Elements, by number, 0 being the page: tag, attributes, parent, first token, the token after the last one and whether
    something ended it.
    """

    tokens: list[tuple[str, str, int]] = field(default_factory=list)
    tag: list[str] = field(default_factory=lambda: [""])
    attrs: list[str] = field(default_factory=lambda: [""])
    parent: list[int] = field(default_factory=lambda: [-1])
    begin: list[int] = field(default_factory=lambda: [0])
    end: list[int] = field(default_factory=lambda: [0])
    ended: list[bool] = field(default_factory=lambda: [False])


def parse(page: str) -> Page:
    """The tokens and elements of a page, in time in proportion to its length; contents of scripts and the like are skipped."""
    out = Page()
    closing: dict[str, list[int]] = {}
    for m in _CLOSE.finditer(page):
        if (name := m[1].lower()) in RAW:
            closing.setdefault(name, []).append(m.start())
    stack, blocks, of_name = [0], [0], {}  # open elements; places of block elements in the stack; places by name

    def pop(to: int) -> None:
        short = out.tag[stack[to]] in ("p", "li", *INLINE)
        while len(stack) > to:
            e = stack.pop()
            # Inline elements that nobody closes go on to the end of a paragraph or an item, not of a whole section.
            out.end[e], out.ended[e] = len(out.tokens), short or len(stack) == to or out.tag[e] not in INLINE
            of_name[out.tag[e]].pop()
            if blocks[-1] == len(stack):
                blocks.pop()

    at = 0
    while True:
        m = _TOKEN.search(page, at)
        text = page[at : m.start() if m else len(page)]
        if text:
            out.tokens.append(("text", " " if text.isspace() else text, stack[-1]))
        if not m:
            break
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        attrs = m[3] or m[6] or ""
        if m[1] or m[4]:
            places = of_name.get(name)
            out.tokens.append(("end", name, stack[-1]))
            if places and (name not in INLINE or places[-1] > blocks[-1]):
                pop(places[-1])
            continue
        if name in RAW:
            if not attrs.endswith("/"):
                ends = closing.get(name, [])
                k = bisect_left(ends, at)
                if k < len(ends):
                    close = page.find(">", ends[k])
                    at = close + 1 if close >= 0 else len(page)
                elif name in ("script", "style", "title", "textarea"):
                    at = len(page)
            out.tokens.append(("tag", name, stack[-1]))
            continue
        if name not in INLINE:
            while len(blocks) > 1 and ((last := out.tag[stack[blocks[-1]]]) == "p" or last in ENDS.get(name, ())):
                pop(blocks[-1])
        out.tokens.append(("tag", name, stack[-1]))
        if name in VOID or attrs.endswith("/") or name in ("html", "head", "body"):
            continue
        e = len(out.tag)
        out.tag.append(name)
        out.attrs.append(attrs)
        out.parent.append(stack[-1])
        out.begin.append(len(out.tokens) - 1)
        out.end.append(0)
        out.ended.append(False)
        of_name.setdefault(name, []).append(len(stack))
        if name not in INLINE:
            blocks.append(len(stack))
        stack.append(e)
    for e in stack:
        out.end[e] = len(out.tokens)
    return out


def names_of(attrs: str) -> list[str]:
    """Names in class, id and role."""
    if "=" not in attrs:
        return []
    return [x for m in _NAMED.finditer(attrs) for x in (m[1] or m[2] or m[3] or "").split()]


@lru_cache(10_000)
def compound(name: str) -> bool:
    """Whether a name of several words is made of names of noise and of words for parts of a page only; content-sidebar, ad-free or social-history aren't."""
    parts = [x.lower().rstrip("0123456789") for x in _PART.findall(name)]
    return not NOISE.isdisjoint(parts) and all(x in NOISE or x in FILLER or not x for x in parts)


def called_noise(attrs: str, names: frozenset[str]) -> bool:
    return any(x.lower() in names or compound(x) for x in names_of(attrs))


def n_words(text: str) -> int:
    """Words of a text; two letters of scripts without blanks count as one."""
    return len(text.split()) + (0 if text.isascii() else len(UNSPACED.findall(text)) // 2)


def noise_of(page: Page, names: frozenset[str], keep: tuple[int, int] | None = None) -> list[int]:
    """For each element the outermost noise element around it (itself included), 0 for none.

    Noise is what a tag or a name says, if it is closed somewhere; never an element that has the kept tokens inside, nor one
    that holds at least half of the page's words with its only article, its only main or its first heading; nor a form, or
    an element of a compound name, with nine words in ten.
    """
    out = [0] * len(page.tag)
    said = [e for e in range(1, len(page.tag)) if page.ended[e] and (page.tag[e] in ASIDE or page.attrs[e] and called_noise(page.attrs[e], names))]
    if not said:
        return out
    size = [0]
    for kind, value, _ in page.tokens:
        size.append(size[-1] + (n_words(value) if kind == "text" and value != " " else 0))
    articles, mains = ([e for e in range(1, len(page.tag)) if page.tag[e] == t] for t in ("article", "main"))
    heads = [next((e for e in range(1, len(page.tag)) if page.tag[e] == "h1"), 0)]
    centres = [x[0] for x in (articles, mains, heads) if len(x) == 1 and x[0]]
    wanted = set(said)
    for e in range(1, len(page.tag)):
        if above := out[page.parent[e]]:
            out[e] = above
        elif e in wanted and not (keep and page.begin[e] < keep[0] and keep[1] <= page.end[e]):
            held = size[page.end[e]] - size[page.begin[e]]
            whole = page.tag[e] in ASIDE - {"form"} or any(x.lower() in names for x in names_of(page.attrs[e]))
            around = page.tag[e] not in ASIDE - {"form"} and 2 * held >= size[-1] and any(page.begin[e] <= page.begin[c] and page.end[c] <= page.end[e] for c in centres)
            out[e] = 0 if around or not whole and 10 * held >= 9 * size[-1] else e
    return out


def marked(page: Page, noise: list[int]) -> int:
    """The element that the page marks as its content: its only outermost article (with words), else its only main; 0 without."""
    if CONTENT.isdisjoint(page.tag):
        return 0
    texts = [0]
    for kind, value, e in page.tokens:
        texts.append(texts[-1] + (kind == "text" and value != " " and not noise[e]))
    for tag in ("article", "main"):
        found = []
        for e in range(1, len(page.tag)):
            # Those without words, such as frames of pictures, mark nothing.
            if page.tag[e] == tag and not noise[e] and not (found and page.end[e] <= page.end[found[-1]]) and texts[page.end[e]] > texts[page.begin[e]]:
                found.append(e)
        if len(found) == 1:
            return found[0]
    return 0


def understood(page: Page, names: frozenset[str]) -> tuple[list[int], int]:
    """Noise of a page and its marked element; what holds the marked element is no noise."""
    noise = noise_of(page, names)
    mark = marked(page, noise)
    if not mark and (hidden := [e for e in range(1, len(page.tag)) if page.tag[e] in CONTENT and noise[e] and noise[e] != e]):
        # All marks are inside something that looks like noise, such as a form around the whole page.
        e = hidden[0]
        if sum(page.tag[x] == page.tag[e] for x in hidden) == 1 and not called_noise(page.attrs[noise[e]], names) and page.tag[noise[e]] == "form":
            noise = noise_of(page, names, (page.begin[e], page.end[e]))
            mark = marked(page, noise)
    return noise, mark


def label(page: str) -> tuple[Counter, Counter]:
    """Of a page that marks its content: how often each tag stands inside (True) and outside it, and which names do; else nothing.

    Tags of noise don't count, since they cost nothing. A name counts once a page, as inside if any of its elements is within
    the content or holds it.
    """
    tags, names = Counter(), Counter()
    own = parse(page)
    noise, mark = understood(own, NOISE)
    if not mark:
        return tags, names
    lo, hi = own.begin[mark], own.end[mark]
    for i, (kind, value, e) in enumerate(own.tokens):
        if kind != "text" and value in KNOWN and not noise[e]:
            tags[value, lo < i < hi - 1] += 1
    inside, outside = set(), set()
    for e in range(1, len(own.tag)):
        if own.attrs[e] and (found := names_of(own.attrs[e])):
            (inside if own.begin[e] < hi and lo < own.end[e] else outside).update(x.lower() for x in found if len(x) <= 40)
    names.update({(x, True): 1 for x in inside} | {(x, False): 1 for x in outside - inside})
    return tags, names


def weights(tags: dict[tuple[str, bool], int], names: dict[tuple[str, bool], int] | None = None) -> Weights:
    """What each tag costs (log-odds of standing outside the content, from LEAST to MOST; BORDER for sections), and names of noise."""
    cost = dict(DEFAULT)
    for name in {k for k, _ in tags}:
        cost[name] = min(MOST, max(LEAST, math.log((tags.get((name, False), 0) + 1) / (tags.get((name, True), 0) + 1))))
    learnt = {x for x, inside in names or {} if not inside and names[x, False] >= RATIO * (names.get((x, True), 0) + INSIDE)}
    return Weights(cost | {t: BORDER for t in SECTION}, NOISE | learnt)


def scores(page: Page, noise: list[int], mark: int, cost: dict[str, float]) -> list[float]:
    """What each token scores."""
    lo, hi = (page.begin[mark], page.end[mark]) if mark else (-1, -1)
    out, crossed = [], 0
    for i, (kind, value, e) in enumerate(page.tokens):
        inside = lo <= i < hi
        if n := noise[e]:
            out.append(0.0 if inside or n == crossed else -CROSSING)
            crossed = n
        elif kind == "text":
            out.append(0.0 if value == " " else float(n_words(value)) * (-1.0 if mark and not inside else 1.0))
        else:
            # Borders of noise elements are their own: the opening tag stands in the parent, so it pays with the crossing.
            out.append(-cost.get(value, MOST))
    for e in {x for x in noise if x}:
        out[page.begin[e]] = 0.0
    return out


def best_region(score: list[float]) -> tuple[int, int]:
    """[from, to) of the contiguous run of the largest sum, the first of several; (0, 0) if no sum is positive."""
    total = low = best = 0.0
    low_at, span = 0, (0, 0)
    for i, s in enumerate(score):
        total += s
        if total < low:
            low, low_at = total, i + 1
        elif total - low > best:
            best, span = total - low, (low_at, i + 1)
    return span


def grown(page: Page, noise: list[int], mark: int, region: tuple[int, int]) -> tuple[int, int]:
    """The region, grown to the innermost block element that holds all of its words; where only the page does, to whole paragraphs.

    A marked element is taken whole, but for a main of several articles.
    """
    words = [i for i in range(*region) if page.tokens[i][0] == "text" and page.tokens[i][1] != " " and not noise[page.tokens[i][2]]]
    if not words:
        return region
    several = page.tag[mark] == "main" and any(t == "article" and page.begin[mark] < b < page.end[mark] and not n for t, b, n in zip(page.tag, page.begin, noise, strict=True))
    e = mark if mark and not several else page.tokens[words[0]][2]
    while e and e != mark and (page.end[e] <= words[-1] or page.tag[e] in INLINE or page.tag[e] == "p"):
        e = page.parent[e]
    if e:
        return min(region[0], page.begin[e]), max(region[1], page.end[e])
    lo, hi = region
    for i in (words[0], words[-1]):
        e = page.tokens[i][2]
        while page.tag[e] in INLINE:
            e = page.parent[e]
        if page.tag[e] in PARAGRAPH:
            lo, hi = min(lo, page.begin[e]), max(hi, page.end[e])
    return lo, hi


def extract(page: str | None, own: Weights) -> str:
    """Blocks of the best region, one a line; white space within a block is one space."""
    if not page:
        return ""
    parsed = parse(page)
    noise, mark = understood(parsed, own.noise)
    region = grown(parsed, noise, mark, best_region(scores(parsed, noise, mark, own.cost)))
    blocks, line = [], []
    for kind, value, e in parsed.tokens[slice(*region)]:
        if kind == "text":
            if not noise[e]:
                line.append(html_lib.unescape(value))
        elif value not in UNBROKEN:
            blocks.append("".join(line))
            line = []
    blocks.append("".join(line))
    return "\n".join(b for b in (_SPACE.sub(" ", x).strip() for x in blocks) if b)


def learn(pages: DataFrame, html: str = "html", most: int = TRAINING_PAGES) -> Weights:
    """Weights from a bounded sample of labelled pages, those with the smallest hashes; without any, the defaults hold.

    What comes to the driver is counts of tags of KNOWN and of names that noise can be: those on enough of the sampled pages.
    """
    texts = pages.select(F.col(html).alias("html")).where(F.col("html").rlike("(?i)</(article|main)"))
    chosen = texts.select(F.xxhash64("html").alias("h")).distinct().orderBy("h").limit(most)
    sample = texts.withColumn("h", F.xxhash64("html")).join(F.broadcast(chosen), "h", "left_semi").dropDuplicates(["h"])  # most rows of 8 bytes

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for x in pdf["html"]:
                for what, counts in zip(("tag", "name"), label(x), strict=True):
                    rows += [(what, k, i, n) for (k, i), n in counts.items()]
            yield pd.DataFrame(rows, columns=["what", "k", "inside", "n"])

    rows = sample.select("html").mapInPandas(count, "what string, k string, inside boolean, n bigint").groupBy("what", "k").pivot("inside", [False, True]).agg(F.sum("n"))
    rows = rows.select("what", "k", F.coalesce("false", F.lit(0)).alias("out"), F.coalesce("true", F.lit(0)).alias("in"))
    found = rows.where(f"what = 'tag' OR out >= {RATIO} * (in + {INSIDE})").collect()
    counts = {what: {(r["k"], side): r["in" if side else "out"] for r in found if r["what"] == what for side in (False, True)} for what in ("tag", "name")}
    return weights(counts["tag"], counts["name"])


def main_text(html: Column | str, own: Weights) -> Column:
    """The main text of a column of pages; empty for null, and where no words are content."""
    shared = SparkContext._active_spark_context.broadcast(own)

    @F.pandas_udf("string")
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([extract(x, shared.value) for x in part], dtype=object)

    return of(html)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page, from its whole html.

    Null or empty html, or a page without content, gives an empty text; repeated rows give repeated results; an empty table
    gives none; other columns are left out.
    """
    out = pages.select("page_id", "url", main_text(F.col("html"), learn(pages)).alias("text"))
    return out.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))
