"""Main text of web pages by a maximum-scoring subsequence (operator 7).

A page is a sequence of words, each worth 1, and tags, each worth less than 0.
The contiguous stretch with the highest sum, found in one pass, is the content
region. What a tag costs is learned from labelled pages: those that mark their
article as such. A tag that is seen outside of articles costs the logarithm of
how much more it is seen there than inside, times TAG_SCALE; a tag of running
text costs little. The region is then widened to whole blocks: up to the next
tag on either side that costs more than those of running text, and then to the
whole article, or the innermost container, around it.

Elements that are never content (scripts, styles, navigation, and those whose
class, id or role names them as menu, advert, notice, comments, ...) count
neither as words nor as tags, inside the region as well.

Where the name alone does not tell, it has a cost: the element counts only if its
words outside of links and form fields are worth more. That is NAMED_COST words
for a section of an article whose id could be that of a chapter (discussion,
related work); for a form or widget, which may hold the whole page, it
is half of the page's words, and NAMED_COST at least. An element that counts
brings its cost into the scan, where it opens.

Character references are decoded; white space within a block becomes one space;
blocks are joined in page order by one space. Nothing else is dropped.

Defined cases: null and empty pages, and pages without words, have the empty
text; unclosed tags, and pages cut off anywhere, are read as far as they go; an
element to be skipped that is never closed ends with the element around it, or,
if that is the body or page, at its first block of text or container. An article
or main element ends a skip, but not one of comments, related pages or an aside.
A class counts as a whole word or in the forms of _PREFIXES. Rows are independent: repeated ones give repeated results. Without
labelled pages, the fixed costs hold.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourvault.llm.flat import small_batches
from hourvault.llm.sample import drawn_ids

SAMPLE = 2000
#: Tags, opening and closing ones apart, whose costs are learned at most.
MOST_TAGS = 100_000
TAG_SCALE = 10.0
#: Cost of tags of running text, of other tags that no labelled page has, and the most of a learned cost.
TEXT_COST, OTHER_COST, MOST_COST = 0.1, 1.0, 200.0
#: Words that an element with a name of two meanings must be worth.
NAMED_COST = 30.0

# Names of HTML: fixed values.
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split()
)
_TEXT = _INLINE | frozenset(
    "blockquote br caption dd dl dt figcaption figure h1 h2 h3 h4 h5 h6 hr img li ol p picture pre source table tbody td tfoot th thead tr ul".split()
)
_SKIPPED = frozenset(
    "script style noscript template iframe svg math canvas object embed audio video nav footer aside form button select textarea input dialog menu title".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SKIPPED_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion promoted sidebar sidenav nav navbar navigation "
    "menu menus breadcrumb breadcrumbs pagination pager footer masthead topbar toolbar cookie cookies consent gdpr notice notices alert popup modal "
    "overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments commentlist "
    "disqus reply replies respond discussion widget skip".split()
)
#: Names that also count as the first part of a class, as in "sidebar-left", and as its end after one of _PLACES.
_PREFIXES = frozenset(
    "ad ads advert adverts advertisement advertising sponsored sidebar sidenav nav navbar navigation menu breadcrumb breadcrumbs pagination pager "
    "footer masthead cookie cookies newsletter comment comments related".split()
)
_PLACES = frozenset("site main primary secondary top bottom global mobile post page".split())
#: First and last parts of classes that only tell of a state.
_STATE, _STATES = frozenset("has no with without".split()), frozenset("open closed none off on enabled disabled".split())
#: Elements and names that may hold a whole page, and ids that a chapter of an article may have.
_HOLDERS = frozenset("form widget".split())
_CHAPTERS = frozenset("discussion related recommended recommendations social notice notices".split())
#: Elements whose words say nothing for the element around them.
_UNCOUNTED = frozenset("a button select option label legend textarea".split())
#: Elements and names that an article inside does not end.
_ASIDES = frozenset("aside comment comments commentlist disqus reply replies respond discussion related recommended recommendations".split())
#: Kinds of tokens that are no tags.
_MARKS = frozenset(["text", "|", "+"])
_HEAD = frozenset("base link meta".split())
_ENDS_P = frozenset(
    "address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre "
    "section table ul".split()
)
_IMPLIED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"td", "th", "tr"}}
_SKIPPED_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|textarea|title|iframe)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)"
    r"|</?[a-zA-Z][^>]*(?:>|\Z)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")


def _named(value: str) -> str:
    """The name by which a class or id says that its element is no content; empty if none does."""
    for token in value.split():
        if token in _SKIPPED_NAMES:
            return token
        parts = re.split("[-_]+", token)
        if len(parts) < 2 or parts[0] in _STATE or parts[-1] in _STATES:
            continue
        if parts[0] in _PREFIXES:
            return parts[0]
        if len(parts) == 2 and parts[0] in _PLACES and parts[1] in _PREFIXES:
            return parts[1]
    return ""


def _skips(name: str, rest: str, in_article: bool) -> str:
    """The element, attribute or class name for which an element that opens so never holds content; empty if it may.

    Of names with two meanings, chapters end in "?", so that `_worth` can tell.
    """
    if name in _SKIPPED or (name == "header" and not in_article):
        return name
    if not rest or name in ("html", "body", "article", "main"):
        return ""
    doubtful = ""
    for kind, *values in _ATTRIBUTE.findall(rest):
        value, kind = "".join(values).lower(), kind.lower()
        if kind == "hidden" or (kind == "aria-hidden" and value == "true"):
            return "hidden"
        if kind == "style" and re.search(r"display\s*:\s*none", value):
            return "hidden"
        if kind == "role" and value in _SKIPPED_ROLES:
            return kind
        if kind in ("class", "id") and (found := _named(value)):
            if found not in _HOLDERS and not (found in _CHAPTERS and kind == "id" and name == "section" and in_article):
                return found
            doubtful = found if found in _HOLDERS else found + "?"
    return doubtful


def _plain_words(page: str, found: list[re.Match], ends: dict[int, tuple[int, bool, bool]]) -> list[int]:
    """Words before each tag that are neither in links nor in form fields."""
    out, total, at, until = [], 0, 0, -1
    for n, f in enumerate(found):
        if n > until and f.start() > at:
            total += len(page[at : f.start()].split())
        out.append(total)
        at = f.end()
        if n >= until:
            until = ends[n][0] if f["name"] and not f["close"] and n in ends and ends[n][1] and f["name"].lower() in _UNCOUNTED else -1
    out.append(total + (len(page[at:].split()) if len(found) > until else 0))
    return out


def _worth(why: str, words: int, whole: int) -> bool:
    """Do the words of an element outweigh the name for which it would be skipped?"""
    if why.endswith("?"):
        return words > NAMED_COST
    return why in _HOLDERS and words > max(NAMED_COST, whole / 2)


def _ends(tags: list[str]) -> list[tuple[int, bool, bool]]:
    """Of each tag that opens an element: the tag where it ends, if that is its own end tag, and if it ends with the page or its body.

    An element without an end tag ends with the one around it.
    """
    out = [(len(tags), False, True)] * len(tags)
    open_: list[tuple[str, int]] = []
    held: Counter = Counter()

    def end(i: int, own: bool, last: bool) -> None:
        name, at = open_.pop()
        held[name] -= 1
        out[at] = (i, own, last)

    for i, tag in enumerate(tags):
        if tag.startswith("</"):
            name = tag[2:]
            if not held[name]:
                continue
            if name in _INLINE or name == "p":  # these end no block
                at = len(open_) - 1
                while open_[at][0] in _INLINE and open_[at][0] != name:
                    at -= 1
                if open_[at][0] != name:
                    continue
            while open_[-1][0] != name:
                end(i, False, name in ("body", "html"))
            end(i, True, False)
        else:
            name = tag[1:]
            if name in _VOID:
                continue
            while open_ and (open_[-1][0] in _IMPLIED.get(name, ()) or (open_[-1][0] == "p" and name in _ENDS_P)):
                end(i, False, False)
            open_.append((name, i))
            held[name] += 1
    return out


def tokens(page: str) -> list[tuple[str, str]]:
    """("text", words) and ("<name" or "</name", "") in order, without what is never content; ("|", "") stands for that.

    ("+", "") stands before an element that counts in spite of its name.
    """
    found = list(_TOKEN.finditer(page))
    tags = [(n, f) for n, f in enumerate(found) if f["raw"] is None and f["name"] and not (not f["close"] and f["rest"].endswith("/"))]
    names = [("</" if f["close"] else "<") + f["name"].lower() for _, f in tags]
    at_tag = {n: k for k, (n, _) in enumerate(tags)}
    ends = {tags[k][0]: (tags[e][0] if e < len(tags) else len(found), own, last) for k, (e, own, last) in enumerate(_ends(names))}
    plain: list[int] = []
    out: list[tuple[str, str]] = []
    at, in_article, in_head = 0, 0, False
    until, own, article_ends, block_ends, level = -1, False, False, False, 0

    for n, f in enumerate(found):
        skipping = n <= until or until == len(found)
        begin, words = f.start(), page[at : f.start()]
        if begin > at and not skipping and not (in_head and not words.strip()):
            out.append(("text", words))
            in_head = False
        at = f.end()
        name = (f["name"] or "").lower()
        if f["raw"] is not None or not name:
            if f["raw"] is not None and not skipping and not in_head:
                out.append(("|", ""))
            continue
        if skipping:
            if not f["close"] and ((article_ends and name in ("article", "main")) or (block_ends and not level and name in _ENDS_P - {"ul", "ol", "menu", "nav"})):
                until = -1
            elif n < until or own:
                if block_ends and n in at_tag and name not in _VOID:
                    level = max(0, level + (-1 if f["close"] else 1))
                if n == until:
                    until = -1
                continue
            else:  # the end of the element around it
                until = -1
        if in_head:
            if name in _HEAD and not f["close"]:
                continue
            in_head = False
            if name == "head":
                continue
        if not f["close"]:
            if name == "head":
                out.append(("|", ""))
                in_head = True
                continue
            why = _skips(name, f["rest"], in_article > 0)
            if why and (why in _HOLDERS or why.endswith("?")) and n in at_tag and ends[n][1]:
                plain = plain or _plain_words(page, found, ends)
                if _worth(why, plain[ends[n][0]] - plain[n], plain[-1]):
                    out.append(("+", ""))
                    why = ""
            why = why.rstrip("?")
            if why:
                out.append(("|", ""))
                if name not in _VOID and n in at_tag:
                    until, own, last = ends[n]
                    article_ends, block_ends, level = why not in _ASIDES or (why == "aside" and not own), last and (why == "aside" or why not in _ASIDES), 0
                continue
        if name == "article":
            in_article += -1 if f["close"] else 1
        out.append((("</" if f["close"] else "<") + name, ""))
    if at < len(page) and until != len(found):
        out.append(("text", page[at:]))
    return out


def _fixed_cost(tag: str) -> float:
    if tag == "+":
        return NAMED_COST
    return TEXT_COST if tag.lstrip("</") in _TEXT or tag == "|" else OTHER_COST


def best_stretch(values: list[float]) -> tuple[int, int]:
    """First and last + 1 of the contiguous stretch with the highest sum; (0, 0) if none is above 0."""
    best, low, high, total, begin = 0.0, 0, 0, 0.0, 0
    for i, value in enumerate(values):
        total += value
        if total > best:
            best, low, high = total, begin, i + 1
        if total <= 0:
            total, begin = 0.0, i + 1
    return low, high


def best_region(sequence: list[tuple[str, str]], costs: dict[str, float]) -> tuple[int, int]:
    """First and last + 1 of the stretch with the highest sum, widened to whole blocks and to the element around it.

    That is each article or main element with words of the stretch; without one,
    the innermost container that opens before the stretch and closes after it.
    """
    price = [0.0 if kind == "text" else costs[kind] if kind in costs else _fixed_cost(kind) for kind, _ in sequence]
    low, high = best_stretch([len(words.split()) if kind == "text" else -cost for (kind, words), cost in zip(sequence, price, strict=True)])
    if high:
        while low > 0 and price[low - 1] <= 2 * TEXT_COST:
            low -= 1
        while high < len(sequence) and price[high] <= 2 * TEXT_COST:
            high += 1
        at = [i for i, (kind, _) in enumerate(sequence) if kind not in _MARKS]
        spans = [(at[k], at[e] + 1 if e < len(at) else len(sequence), own) for k, (e, own, _) in enumerate(_ends([sequence[i][0] for i in at]))]
        inside = lambda a, b: any(kind == "text" and words.strip() for kind, words in sequence[max(a, low) : min(b, high)])
        around = [(a, b) for a, b, _ in spans if sequence[a][0] in ("<article", "<main") and inside(a, b)]
        if not around:
            around = [
                (a, b) for a, b, own in spans
                if own and a <= low and high <= b and sequence[a][0][1:] not in _TEXT and sequence[a][0] not in ("<body", "<html")
            ][-1:]
        low, high = min([low, *(a for a, _ in around)]), max([high, *(b for _, b in around)])
    return low, high


def main_text(page: str | None, costs: dict[str, float]) -> str:
    """The main text of one page."""
    if not page:
        return ""
    sequence = tokens(page)
    low, high = best_region(sequence, costs)
    parts = []
    for kind, words in sequence[low:high]:
        if kind == "text":
            parts.append(html.unescape(words))
        elif kind.lstrip("</") not in _INLINE:
            parts.append(" ")
    return " ".join("".join(parts).split())


def count_tags(page: str) -> Counter:
    """(tag, inside) counts of a page that marks one article; nothing for other pages."""
    sequence = tokens(page)
    opens = [i for i, (kind, _) in enumerate(sequence) if kind == "<article"]
    if len(opens) != 1:
        return Counter()
    closes = [i for i, (kind, _) in enumerate(sequence) if kind == "</article"]
    low, high = opens[0], closes[-1] if closes else len(sequence)
    return Counter((kind, low < i < high) for i, (kind, _) in enumerate(sequence) if kind not in _MARKS)


def fit(df: DataFrame, key: str = "page_id", page: str = "html", sample: int = SAMPLE, most_tags: int = MOST_TAGS) -> dict[str, float]:
    """Tag costs learned from the labelled pages among a hash-drawn sample of ids.

    `most_tags` bounds the model: HTML has some 140 names, of others the most used are learned.
    """
    spark = df.sparkSession
    ids = drawn_ids(df.where(F.col(key).isNotNull()).select(F.col(key).alias("id")), "id", sample, 7).distinct()
    few = spark.createDataFrame(ids.toPandas(), ids.schema)  # at most 2 * sample ids
    rows = df.select(F.col(key).alias("id"), F.col(page).cast("string").alias("html")).join(F.broadcast(few), "id").select("html")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for text in batch.column("html").to_pylist():
                total.update(count_tags(text or ""))
        if total:
            kinds, inside = zip(*total, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(inside), pa.array(list(total.values()), pa.int64())], ["tag", "inside", "n"])

    counts = rows.mapInArrow(count, "tag string, inside boolean, n long").groupBy("tag").agg(
        F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0)).alias("i"), F.sum(F.when(F.col("inside"), 0).otherwise(F.col("n"))).alias("o")
    )
    costs = {}
    for row in counts.orderBy(F.desc(F.col("i") + F.col("o")), "tag").limit(most_tags).collect():
        learned = TAG_SCALE * math.log((row["o"] + 1) / (row["i"] + 1))
        costs[row["tag"]] = min(MOST_COST, max(_fixed_cost(row["tag"]), learned))
    return costs


def extract(df: DataFrame, costs: dict[str, float], key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """Per row: page_id, url, text, n_chars."""
    rows = df.select(F.col(key).alias("page_id"), F.col(url).cast("string").alias("url"), F.col(page).cast("string").alias("html"))
    kind = rows.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "html"):
            texts = [main_text(p, costs) for p in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    return rows.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
