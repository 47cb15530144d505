"""Main-text extraction from HTML by two-pass block rules.

A page is cut into blocks at block-level tags.  Pass one decides a block by its own counts: stop-word
density, length and link density.  Where it stands is one more feature: menus, forms, notices and the
like are out, on a page with an article so is what lies beside it, and inside the article a block needs less of the counts.
Short blocks, headings and blocks full of links stay undecided.  Pass two gives each undecided block the label of its nearest
decided neighbours, of those on its own side of the article's border; where they differ, or there is none, it is left out outside an article
and kept inside one, and a heading goes with what follows it.

The scanner is linear in the page (possessive patterns, no backtracking over the page),
so very long pages cost in proportion.  One pass over the table in Arrow batches, no
shuffle; nothing is kept between rows.

Defined cases: null html is empty and gives an empty text with 0 characters; a page
without text likewise; unclosed tags, scripts and comments end with the page; repeated
rows give repeated results; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Common words of the languages the pages are in.
STOP_WORDS = frozenset(
    """a about after all also an and are as at be been but by can for from had has have he her his i if in into is it its more no not of on one or
    other she so some than that the their them then there they this to was we were what when which who will with would you your
    aber als am an auch auf aus bei bin bis das dass dem den der des die durch ein eine einem einen einer er es für hat ich im in ist kann mit nach
    nicht noch nur oder sich sie sind so über um und unter vom von vor war was wenn werden wie wird zu zum zur
    au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur mais ne nous on ou où par pas plus pour qu que qui sa se ses son
    sont sur un une vous
    al como con de del desde el ella en entre era es esta este ha la las le lo los más muy no o para pero por que se sin sobre su sus también un una y ya""".split()
)

#: Elements whose text is never page text.
RAW = {"script", "style", "title", "textarea", "noscript", "template", "iframe", "xmp", "noembed", "noframes"}
DROPPED = {"nav", "footer", "aside", "form", "select", "option", "button", "dialog", "menu", "svg", "canvas", "object", "audio", "video", "map", "head", "fieldset", "datalist"}
MAIN = {"article", "main"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = (
    MAIN | HEADINGS | DROPPED | {"address", "blockquote", "body", "caption", "center", "dd", "details", "dir", "div", "dl", "dt", "figcaption", "figure", "header", "hr", "html", "legend", "li", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "br"}
) - {"option", "svg", "canvas", "object", "audio", "video", "map"}
#: Words of class, id or role names that mark page furniture.
FURNITURE = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|advertising|sponsor(?:ed)?|promo(?:tion)?s?|banner|side-?bar|nav|navbar|navigation|menu|breadcrumbs?|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay"
    r"|comments?|commentlist|disqus|respond|replies|reply|discussion|share|sharing|social|related|recommended|newsletter|subscribe|subscription|signup|login|footer|header|masthead|toolbar|pagination|pager|widget|search|complementary|contentinfo)(?:$|[\s_-])",
    re.I,
)
#: Those of them whose articles are not the page's either; others may name a wrapper of the article, as with-sidebar does.
APART = re.compile(
    r"(?:^|[_-])(?:ads?|adverts?|advertisement|advertising|sponsor(?:ed)?|promo(?:tion)?s?|nav|navbar|navigation|menu|breadcrumbs?|comments?|commentlist|disqus|respond|replies|reply|discussion|related|recommended"
    r"|footer|complementary|contentinfo)(?:$|[_-])|^side-?bar$",
    re.I,
)
LAYOUT = ("with-", "with_", "has-", "has_", "no-", "no_")
#: Tags that leave an open head open, as do those of RAW.
IN_HEAD = {"base", "basefont", "bgsound", "link", "meta", "head", "html"}
TOKEN = re.compile(
    r"<!--(?:.*?-->|.*)|<[!?][^>]*>?|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^\"'>]++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>?",
    re.S,
)
NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)

#: Lengths (characters) and densities of the block rules.
SHORT, LONG, STOP_HIGH, STOP_LOW, LINKS = 70, 200, 0.30, 0.20, 0.5


def blocks(page: str) -> Iterator[tuple[str, int, str, bool, bool]]:
    """(text, characters inside links, tag, inside furniture, inside an article), in page order."""
    stack: list[tuple[str, int, bool]] = []  # of block and dropped elements: name, furniture (1: an article in it is none), main
    parts: list[str] = []
    links = anchor = 0
    at, end, tag, furniture, main = 0, len(page), "", 0, False
    raw_end: dict[str, re.Pattern] = {}

    def flush():
        nonlocal links
        text = " ".join(entities.unescape("".join(parts)).split())
        got = (text, links, tag, furniture > 0, main) if text else None
        parts.clear()
        links = 0
        return got

    def close_head():
        nonlocal tag, furniture, main
        if stack and stack[-1][0] == "head":
            stack.pop()
            tag, furniture, main = stack[-1] if stack else ("", 0, False)

    while at < end:
        m = TOKEN.search(page, at)
        if not m:
            break
        if m.start() > at:
            piece = page[at : m.start()]
            if piece.strip():
                close_head()
            parts.append(piece)
            if anchor:
                links += len(piece)
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            if name == "a":
                anchor = max(0, anchor - 1)
            if name in BLOCKS or name in DROPPED or name in RAW:
                if got := flush():
                    yield got
                anchor = 0
                if any(x[0] == name for x in stack):
                    while stack.pop()[0] != name:
                        pass
            _, furniture, main = stack[-1] if stack else ("", 0, False)
            tag = stack[-1][0] if stack else ""
            continue
        if name in RAW:
            if name not in raw_end:
                raw_end[name] = re.compile(rf"</{name}\b[^>]*>?", re.I)
            close = raw_end[name].search(page, at)
            at = close.end() if close else end
            continue
        if name not in IN_HEAD:
            close_head()
        if name == "a":
            anchor = 1
        if name in BLOCKS or name in DROPPED:
            if got := flush():
                yield got
            if name not in ("a",):
                anchor = 0
            if name in VOID:
                continue
            if stack and (name in ("p", "li", "td", "th", "tr", "dd", "dt") or name in HEADINGS) and stack[-1][0] in ({name} | ({"p"} if name != "li" else set())) and stack[-1][0] not in MAIN:
                stack.pop()  # an end tag that may be left out
                _, furniture, main = stack[-1] if stack else ("", 0, False)
            marks = " ".join(x for y in NAMED.findall(m[3]) for x in y if x) if m[3] else ""
            is_main = main or name in MAIN or "main" in marks.lower().split()
            out = 0 if name in MAIN and furniture == 1 else furniture
            if name in DROPPED or (name == "header" and not main):
                out = 2
            elif marks and name not in MAIN | {"body", "html"} and FURNITURE.search(marks):
                out = max(out, 2 if any(APART.search(x) for x in marks.split() if not x.lower().startswith(LAYOUT)) else 1)
            furniture, main, tag = out, is_main, name
            if not m[3].rstrip().endswith("/") or name in BLOCKS:
                stack.append((name, furniture, main))
    if at < end:
        if page[at:].strip():
            close_head()
        parts.append(page[at:])
    if got := flush():
        yield got


def stop_density(text: str) -> float:
    words = text.lower().split()
    return sum(w.strip(".,;:!?()\"'") in STOP_WORDS for w in words) / max(1, len(words))


def decide(text: str, links: int, tag: str, furniture: bool, main: bool, has_main: bool) -> bool | None:
    """Pass one: True (text), False (not) or None (undecided)."""
    if furniture or (has_main and not main):
        return False
    n = len(text)
    if main:
        if n < SHORT or links > LINKS * n or tag in HEADINGS:
            return None
        return True if n >= LONG or stop_density(text) >= STOP_LOW else None
    if links > LINKS * n:
        return False
    if "\xa9" in text or links > 0.2 * n:
        return False if n < SHORT or links > 0.2 * n else None
    if n < SHORT or tag in HEADINGS:
        return None
    density = stop_density(text)
    if density >= STOP_HIGH or (density >= STOP_LOW and n >= LONG):
        return True
    return True if n >= LONG and tag in ("p", "blockquote", "pre", "td", "dd") and not links else (None if density >= STOP_LOW or tag == "p" else False)


def inherit(tags: list[str], first: list[bool | None], alone: bool) -> list[bool]:
    """Pass two over blocks in page order: the undecided take their nearest decided neighbours' label; alone is that of blocks without any, and where neighbours differ."""
    after: list[bool | None] = [None] * len(first)
    seen = None
    for i in range(len(first) - 1, -1, -1):
        after[i] = seen
        seen = first[i] if first[i] is not None else seen
    labels, before = [], None
    for tag, label, follows in zip(tags, first, after, strict=True):
        if label is not None:
            before = label
        elif tag in HEADINGS:
            label = alone if follows is None else follows
        elif before is None or follows is None:
            known = follows if before is None else before
            label = alone if known is None else known
        else:
            label = before if before == follows else alone
        labels.append(label)
    return labels


def main_text(page: str) -> str:
    found = list(blocks(page))
    has_main = any(b[4] and not b[3] for b in found)
    first = [decide(*b, has_main) for b in found]
    labels = [False] * len(found)
    for inside in (True, False):
        own = [i for i, b in enumerate(found) if inside == (b[4] and not b[3])]
        for i, label in zip(own, inherit([found[i][2] for i in own], [first[i] for i in own], inside), strict=True):
            labels[i] = label
    if found and not any(labels) and not any(x is True for x in first):
        labels = [x is None for x in first]  # a page of short blocks only
    return " ".join(b[0] for b, label in zip(found, labels, strict=True) if label)


def extract(pages: DataFrame, key: list[str], html_col: str = "html") -> DataFrame:
    """The key columns of each page, with text and n_chars."""
    rows = pages.select(*key, F.col(html_col).alias("__html"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    def run(batches):
        for batch in batches:
            texts = [main_text(x or "") for x in batch.column(len(key)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [*key, "text", "n_chars"])

    return rows.mapInArrow(run, f"{fields}, text string, n_chars bigint")
