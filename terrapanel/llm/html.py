"""Main text of web pages by two passes over blocks.

The page is cut into blocks at block-level tags. The first pass decides each block from where it
stands, its length, the density of its links and of stop words; short or middling blocks stay
open. In the second pass an open block takes the label of the nearest decided block of its own
region, so a short paragraph follows the text around it. Elements that hold menus, forms,
adverts, notices or comments (by tag, role, class or id) form no blocks at all. Standing in an
article or main element lowers the limits of the first pass, unless the rest of the page holds
more decided text than these elements.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements whose content is never shown as text.
RAW = ("script", "style", "noscript", "template", "svg", "math", "iframe", "object", "canvas", "textarea", "title")
# Elements that stand beside the text.
ASIDE = frozenset("nav footer aside form menu dialog select button fieldset datalist".split())
# Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements that begin a block of their own.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre "
    "section summary table tbody td tfoot th thead tr ul".split()
)
#: Words of a class, id or role that mark what is beside the text.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion popup modal overlay "
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar aside widget footer masthead toolbar pagination pager "
    "cookie cookies consent gdpr notice disclaimer alert newsletter subscribe signup login search share sharing social "
    "related recommended recommendations comment comments commentlist disqus respond responses replies reactions "
    "complementary contentinfo".split()
)
#: Words that turn a mark beside them into a state of the page: no sidebar, comments open.
DENIALS = frozenset("no not non has have with without free open opened closed off on enabled disabled result results count".split())
#: Words for the text itself; one of them last in a name outweighs a mark before it.
CONTENT = frozenset("article articles content contents main body text story entry post page section wrapper container".split())
#: Elements that marks may remove.
MARKED = frozenset("div section ul ol dl table p span header article figure details h2 h3 h4 li dt dd td tr a center".split())
# Elements that end at the start of others, and the elements that shield them from those outside.
ENDED_BY = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "tbody": ("tbody", "thead", "tfoot", "tr", "td", "th", "caption"), "tfoot": ("tbody", "thead", "tfoot", "tr", "td", "th", "caption"),
    "thead": ("caption",),
    **{h: ("h1", "h2", "h3", "h4", "h5", "h6") for h in ("h1", "h2", "h3", "h4", "h5", "h6")},
}
SHIELDS = {
    "li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",), "option": ("select", "datalist"), "tr": ("table",), "td": ("tr", "table"),
    "th": ("tr", "table"), "tbody": ("table",), "tfoot": ("table",), "thead": ("table",), "p": ("button", "td", "th", "caption", "table"),
}
# Elements whose start ends an open paragraph.
ENDS_P = frozenset(
    "address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr li main menu nav ol p pre section summary table ul".split()
)
#: Stop words of English, French, German and Spanish.
STOP_WORDS = frozenset(
    "a an and are as at be been but by for from had has have he her his i if in is it its not of on or she that the "
    "their they this to was we were which who will with you "
    "au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur mais ne nous ou par pas plus pour "
    "qu que qui sa se ses son sont sur un une vous "
    "als am auch auf aus bei das dass dem den der die ein eine einem einen einer er es für hat ich ihr im ist mit nach "
    "nicht noch nur oder sich sie sind so über um und von vor war was wie wir wird zu zum zur "
    "al como con del el ella ellos entre era esta este fue ha hay las lo los más me muy no nos para pero por porque "
    "sin sobre su sus también todo uno ya y".split()
)

_NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*")
_STOP = re.compile(r"[>\"']")
_RAW = frozenset(RAW)
_MARK = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
_SPACE = re.compile(r"\s+")


@dataclass(frozen=True)
class Rules:
    """Limits of the first pass."""

    long_chars: int = 140
    short_chars: int = 70
    high_stop_density: float = 0.30
    low_stop_density: float = 0.12
    high_link_density: float = 0.5
    #: Inside a marked article the limits are lower.
    article_stop_density: float = 0.02
    #: Stop words that an article's block without any would have at the density of its page.
    article_missing_words: float = 8
    article_link_density: float = 0.9
    article_link_count: int = 2
    #: Characters that make a text an article.
    article_chars: int = 400


@dataclass
class Block:
    inside: bool
    texts: list[str] = field(default_factory=list)
    link_chars: int = 0
    links: int = 0


def _is_mark(token: str) -> bool:
    """Whether a class, id or role names something beside the text: by its last word, or its first unless it ends in a content word."""
    words = [w for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", token).lower()) if w]
    if not words or DENIALS.intersection(words):
        return False
    return words[-1] in MARKS or words[0] in MARKS and words[-1] not in CONTENT


def _marked(name: str, attributes: str) -> bool:
    if name not in MARKED or not attributes:
        return False
    return any(_is_mark(token) for groups in _MARK.findall(attributes) for token in " ".join(groups).split())


def _tags(page: str):
    """(text before, closing, name, attributes) of every tag in order, and last (text, False, "", "") for the rest.

    Comments, declarations and elements of raw text are passed over. One scan: quotes that never end are
    no quotes from then on, and a tag that never ends takes the rest with it.
    """
    at = begin = 0
    quotes, held = True, []
    n = len(page)
    while True:
        lt = page.find("<", at)
        if lt < 0 or lt + 1 >= n:
            break
        after = page[lt + 1]
        if after in "!?":
            held.append(page[begin:lt])
            end = page.find("-->", lt + 4) if page.startswith("<!--", lt) else page.find(">", lt)
            at = begin = n if end < 0 else end + (3 if page.startswith("<!--", lt) else 1)
            held.append(" " if page.startswith("<!--", lt) else "")
            continue
        closing = after == "/"
        name = _NAME.match(page, lt + 1 + closing)
        if not name:
            at = lt + 1
            continue
        end = name.end()
        while quotes:
            stop = _STOP.search(page, end)
            if not stop:
                quotes = False
            elif stop[0] == ">":
                end = stop.start()
                break
            else:
                end = page.find(stop[0], stop.end()) + 1
                if not end:
                    quotes = False
        if not quotes:
            end = page.find(">", name.end())
        held.append(page[begin:lt])
        if end < 0:
            at = begin = n
            break
        word, attributes = name[0].lower(), page[name.end() : end]
        at = begin = end + 1
        if word in _RAW:
            if not closing and not attributes.endswith("/"):
                close = re.compile(rf"</{word}\s*>", re.I).search(page, at)
                at = begin = close.end() if close else n
            held.append(" ")
            continue
        yield "".join(held), closing, word, attributes
        held = []
    yield "".join(held) + page[begin:], False, "", ""


def blocks_of(page: str, marks: bool = True) -> list[Block]:
    """Blocks of the page in order, without those of elements beside the text; ``marks`` off leaves their marks aside."""
    out: list[Block] = []
    # Open elements: name, whether it hides its content (2: by a mark alone), whether it is an article.
    stack: list[list] = []
    opened: Counter = Counter()
    hidden = articles = links = breaks = 0
    seen_article = False
    now = Block(False)

    def close() -> None:
        nonlocal now
        if any(t.strip() for t in now.texts):
            out.append(now)
        now = Block(articles > 0)

    def text(piece: str) -> None:
        if piece and not hidden:
            plain = entities.unescape(piece)
            now.texts.append(plain)
            if links:
                now.link_chars += len(_SPACE.sub(" ", plain).strip())

    def leave(depth: int) -> None:
        """Close the open elements from ``depth`` on."""
        nonlocal hidden, articles, links
        while len(stack) > depth:
            name, hides, is_article = stack.pop()
            opened[name] -= 1
            hidden -= hides > 0
            if is_article:
                articles -= 1
                now.inside = articles > 0
            if name == "a":
                links = 0

    def innermost(names: tuple[str, ...], shields: tuple[str, ...]) -> int | None:
        """Depth of the outermost of ``names`` that is open inside the nearest shield."""
        found = None
        if not any(opened[x] for x in names):
            return None
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in shields:
                break
            if stack[i][0] in names:
                found = i
        return found

    for before, closing, name, attributes in _tags(page):
        text(before)
        if before.strip():
            breaks = 0
        if not name:
            continue
        if name == "br":
            if not hidden:
                breaks += 1
                if breaks > 1:
                    close()
                else:
                    now.texts.append(" ")
            continue
        if not hidden and (name in BLOCK or name in ASIDE):
            breaks = 0
            close()
        if closing:
            if not opened[name]:
                continue
            block = name in BLOCK or name in ASIDE
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    leave(i)
                    break
                # An inline end tag reaches no further than its block, others not out of a table's cell.
                if not block and (stack[i][0] in BLOCK or stack[i][0] in ASIDE):
                    break
                if stack[i][0] in ("td", "th", "caption") and name not in ("table", "tr", "tbody", "thead", "tfoot", "body", "html"):
                    break
            continue
        if name in ENDS_P and (depth := innermost(("p",), SHIELDS["p"])) is not None:
            leave(depth)
        if name in ENDED_BY:
            ended = ENDED_BY[name]
            if name[0] == "h":
                ended = ended if stack and stack[-1][0] in ended else ()
            if ended and (depth := innermost(ended, SHIELDS.get(name, ()))) is not None:
                leave(depth)
        if name in VOID or attributes.endswith("/"):
            continue
        # a page header stands beside the text, that of an article holds its title
        hides = int(name in ASIDE or name == "header" and not articles or bool(_HIDDEN.search(attributes)))
        if not hides and marks and _marked(name, attributes):
            hides = 2
        is_article = name in ("article", "main")
        if is_article:
            if not seen_article and not any(h == 1 for _, h, _ in stack):
                # No mark removes the first article, or what it stands in.
                hides = 0 if hides == 2 else hides
                for element in stack:
                    hidden -= element[1] == 2
                    element[1] = 0 if element[1] == 2 else element[1]
            seen_article = True
        stack.append([name, hides, is_article])
        opened[name] += 1
        hidden += hides > 0
        if is_article:
            articles += 1
            now.inside = True
        elif name == "a" and not hidden:
            links = 1
            now.links += 1
    close()
    return out


def _stop_density(text: str) -> float:
    words = _WORD.findall(text.lower())
    return sum(w in STOP_WORDS for w in words) / max(1, len(words))


def decide(text: str, block: Block, rules: Rules, inside: bool, usual: float) -> bool | None:
    """First pass: text (True), not text (False) or open (None). ``usual`` is the density of stop words in the page."""
    if _all_links(text, block, rules, inside):
        return False
    if len(text) < rules.short_chars:
        return None
    stop = _stop_density(text)
    long = len(text) >= rules.long_chars
    # pages of other languages hold hardly any of the stop words, so these decide nothing there
    if usual < rules.low_stop_density / 2:
        return True if inside or long else None
    if inside:
        missing = usual * len(_WORD.findall(text)) >= rules.article_missing_words
        return False if stop < rules.article_stop_density and missing else True if stop >= rules.low_stop_density else None
    if stop >= rules.high_stop_density and long:
        return True
    if stop < rules.low_stop_density:
        return False
    return True if long else None


def _all_links(text: str, block: Block, rules: Rules, inside: bool) -> bool:
    density = block.link_chars / max(1, len(text))
    if inside:
        return block.links >= rules.article_link_count and density >= rules.article_link_density
    return density > rules.high_link_density


def _follow(found: list[tuple[Block, str]], labels: list[bool | None], at: list[int], rules: Rules, inside: bool, default: bool) -> None:
    """Second pass over the blocks ``at`` of one region: the nearest decided block, the next one if two are equally near."""
    decided = [i for i in at if labels[i] is not None]
    # a list of links beside it says nothing of an article's block without links
    prose = [i for i in decided if not (inside and _all_links(found[i][1], found[i][0], rules, inside))]
    told = dict(zip(decided, (labels[i] for i in decided)))
    k = {False: 0, True: 0}
    for i in at:
        if i in told:
            continue
        plain = found[i][0].links == 0
        use = prose if plain else decided
        while k[plain] < len(use) and use[k[plain]] < i:
            k[plain] += 1
        near = [use[j] for j in (k[plain], k[plain] - 1) if 0 <= j < len(use)]
        labels[i] = told[min(near, key=lambda j: abs(j - i))] if near else default


def main_text(page: str | None, rules: Rules = Rules()) -> str:
    """Main text of the page, one block a line; empty for a null or empty page.

    A page of any length or disorder is read in one scan. Where marks leave nothing but hide the text of an
    article's length, they are left aside.
    """
    if not page:
        return ""
    text = _main_text(page, rules, True)
    if not text:
        unmarked = _main_text(page, rules, False)
        text = unmarked if len(unmarked) >= rules.article_chars else ""
    return text


def _main_text(page: str, rules: Rules, marks: bool) -> str:
    found = [(b, _SPACE.sub(" ", "".join(b.texts)).strip()) for b in blocks_of(page, marks)]
    found = [(b, t) for b, t in found if t]
    usual = _stop_density(" ".join(t for _, t in found))
    labels = [decide(t, b, rules, b.inside, usual) for b, t in found]
    text_in = [sum(len(t) for (b, t), label in zip(found, labels) if label and b.inside == side) for side in (False, True)]
    if text_in[0] > text_in[1]:
        # the marked part is a teaser or a comment: all blocks are judged alike
        labels = [decide(t, b, rules, False, usual) for b, t in found]
        _follow(found, labels, list(range(len(found))), rules, False, True)
    else:
        marked = any(b.inside for b, _ in found)
        for side in (False, True):
            _follow(found, labels, [i for i, (b, _) in enumerate(found) if b.inside == side], rules, side, side or not marked)
    return "\n".join(t for (_, t), label in zip(found, labels) if label)


def extract(pages: DataFrame, html_column: str = "html", rules: Rules = Rules()) -> DataFrame:
    """``pages`` with the column ``text``; a column of that name is replaced.

    Null and empty pages give an empty text, any row gives one row, and other columns (nulls,
    repeated ids) pass through untouched. Very long and broken pages take time in proportion to
    their length.
    """
    @F.pandas_udf("string")
    def text(pages):
        return pages.map(lambda p: main_text(p, rules))

    return pages.withColumn("text", text(F.col(html_column).cast("string")))
