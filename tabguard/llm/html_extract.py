"""Main text of web pages by consensus paths of each host.

A page is parsed into containers (block elements) and text blocks. Each container
gets the text that it holds, less what is marked as menus, adverts and the like,
and less linked text. The page votes for the generalised paths of its containers
(tags, with classes whose digits are folded) in proportion to these scores; the
votes of a host are added up in Spark, and its winning path decides what is the
article on all its pages. A page on which that path yields no text, or whose url
has no host, is read by its own best path.

Within the chosen elements everything stays but menus, headers and footers,
sidebars, notices, adverts, forms, scripts, styles and reader comments. These are told
by their elements and roles, and by their classes and ids. A name is no proof if it is
a compound or stands beside one that says main text: such an element is overruled
where it holds the main text itself, that is, where hardly any wanted text is left
without it. Names of states (menu-open, has-sidebar) say nothing. Character references
are decoded, white space in a block becomes one space, blocks are
trimmed and joined in page order by an empty line.

Votes are whole numbers and added up before the shuffle, so a host that holds a
large part of the pages sends one row per path and task.

Defined cases: a null or empty html gives an empty text; broken markup is read as
far as a browser would (unclosed elements and comments end with the page); very
long pages are read whole; equal votes go to the deeper, then to the smaller path;
repeated rows vote each; an empty table gives an empty result; other columns pass
through, and one that bears the name of an output gives way.
"""

from __future__ import annotations

import re
from collections import defaultdict
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabguard.llm.common import cut, map_arrow, shielded, slices

#: Size up to which the winners (host, path) are broadcast; beyond it they are joined by host, with salt.
BROADCAST_BYTES = 8 << 20
SALTS = 32

_TAG = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"'=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^\s>\"']*+)|[\"'])*+)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([a-zA-Z][\w:-]*)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""")
_DIGITS = re.compile(r"\d+")
_TOKEN = re.compile(r"[a-z]+")

#: Kinds of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg object canvas audio video annotation annotation-xml".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody "
    "td tfoot th thead tr ul head legend".split()
)
CONTAINER = frozenset("article body div main section td table html center blockquote ul ol dl details fieldset".split())
UNWANTED = frozenset("nav footer aside form menu dialog search button select option label fieldset head".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form toolbar note".split())
UNWANTED_CLASSES = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adsense banner sponsor sponsored promo promotion "
    "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager sidebar aside side rail footer "
    "header masthead topbar toolbar comment comments commentlist discussion disqus respond reply replies "
    "cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe "
    "subscription signup login share sharing social related recommended recommendations widget skiplink "
    "search searchform form paywall".split()
)
#: Words of names that say main text.
WANTED_CLASSES = frozenset("article content main post story entry body text".split())
#: Names of states of an element, which don't say what it is.
STATE = re.compile(r"(?:has|with|no|without|is|js)-.*|.*-(?:open|opened|closed|active|inactive|fixed|visible|collapsed|expanded|enabled|disabled|layout)")
SKIP = re.compile(r"skip-(?:links?|nav|navigation|to-.*)")
CLOSED_BY = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dd": ({"dd", "dt"}, {"dl"}),
    "dt": ({"dd", "dt"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
#: Weight of elements that are named as the article.
BONUS = 3


class Element:
    __slots__ = ("bonus", "depth", "good", "hard", "inside_article", "linked", "named", "path", "suspects", "tag", "up", "waste")

    def __init__(self, tag: str, up: Element | None):
        self.tag, self.up = tag, up
        self.good = self.waste = 0
        self.bonus, self.named = 1, False
        if up is None:
            self.path, self.depth, self.hard, self.suspects, self.linked, self.inside_article = "", 0, False, (), False, False
        else:
            self.path, self.depth, self.hard, self.suspects = up.path, up.depth + 1, up.hard, up.suspects
            self.linked, self.inside_article = up.linked or tag == "a", up.inside_article

    def chain(self):
        e = self
        while e is not None:
            yield e
            e = e.up


def _marks(attributes: str) -> tuple[list[str], str, bool]:
    """Class names, role, and whether the element is hidden."""
    names, role, hidden = [], "", False
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key in ("class", "id"):
            names += value.lower().split()
        elif key == "role":
            role = value.strip().lower()
        elif key == "aria-hidden":
            hidden |= value.lower() == "true"
        elif key == "style":
            hidden |= "display:none" in value.lower().replace(" ", "")
    if re.search(r"(?:^|\s)hidden(?:\s|=|$)", attributes):
        hidden = True
    return names, role, hidden


SURE, DOUBTFUL, MAIN = "sure", "doubtful", "main text, but doubtful"


def _unwanted(tag: str, names: list[str], role: str, inside_article: bool) -> str | None:
    """How sure it is that an element isn't main text; None if nothing says so."""
    if tag in ("body", "html", "main"):
        return None
    if tag in UNWANTED or role in ROLES:
        return SURE
    if tag == "header" and not inside_article:
        return SURE
    plain = compound = wanted = False
    for name in names:
        if SKIP.fullmatch(name):
            plain = True
        if STATE.fullmatch(name):
            continue
        tokens = _TOKEN.findall(name)
        bad = any(t in UNWANTED_CLASSES for t in tokens)
        plain |= bad and len(tokens) == 1
        compound |= bad and len(tokens) > 1
        wanted |= not bad and any(t in WANTED_CLASSES for t in tokens)
    if not plain and not compound:
        return None
    if plain:
        return DOUBTFUL if wanted else SURE
    return MAIN if wanted or tag == "article" else DOUBTFUL


def _overruled(blocks: list[tuple[str, int, Element]]) -> set[Element]:
    """Doubtful elements that hold the main text themselves."""
    out: set[Element] = set()
    while True:
        wanted, held = 0, defaultdict(int)
        for text, linked, e in blocks:
            if e.hard:
                continue
            if shut := [s for s in e.suspects if s not in out]:
                held[shut[-1]] += len(text) - min(len(text), linked)
            else:
                wanted += len(text) - min(len(text), linked)
        found = [s for s, n in held.items() if n and (wanted * 4 < n if s.named else not wanted)]
        if not found:
            return out
        best = max(found, key=lambda s: (held[s], -s.depth))
        out.update(best.suspects)


def parse(page: str) -> tuple[list[Element], list[tuple[str, tuple[Element, ...]]]]:
    """Containers, and the blocks of wanted text with the containers around them."""
    elements, blocks = _parse(page)
    spared = _overruled(blocks) if any(e.suspects for _, _, e in blocks) else set()
    wanted = lambda e: not e.hard and all(s in spared for s in e.suspects)
    kept = []
    for text, linked, top in blocks:
        n = len(text)
        if wanted(top):
            around = tuple(e for e in top.chain() if e.tag in CONTAINER or not e.tag)
            kept.append((text, around))
            for e in around:
                e.good += n - min(n, linked)
                e.waste += min(n, linked)
        else:
            for e in top.chain():
                e.waste += n
    return [e for e in elements if wanted(e)], kept


def _parse(page: str) -> tuple[list[Element], list[tuple[str, int, Element]]]:
    """Containers, and all blocks of text with the characters in links and the innermost element."""
    root = Element("", None)
    stack, elements, blocks = [root], [root], []
    words: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if words:
            if text := " ".join("".join(words).split()):
                blocks.append((text, linked, stack[-1]))
            words.clear()
        linked = 0

    def text_found(raw: str) -> None:
        nonlocal linked
        if raw:
            value = unescape(raw) if "&" in raw else raw
            words.append(value)
            if stack[-1].linked:
                linked += len(value.strip())

    def pop_to(index: int) -> None:
        if any(e.tag in BLOCK for e in stack[index:]):
            flush()
        del stack[index:]

    at, size = 0, len(page)
    while at < size:
        m = _TAG.search(page, at)
        if m is None:
            text_found(page[at:])
            break
        text_found(page[at : m.start()])
        at = m.end()
        if m[0].startswith("<![CDATA["):
            text_found(m[0][9:-3])
            continue
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "br":
                words.append(" ")
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    pop_to(i)
                    break
                if stack[i].tag in ("td", "th", "table") and tag not in BLOCK:
                    break
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            if not (m[3] and m[3].rstrip().endswith("/") and tag == "svg"):
                if tag == "xmp":  # shown as it is
                    words.append(page[at : close.start() if close else size])
                at = close.end() if close else size
            continue
        if tag == "br":
            words.append(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        if tag in BLOCK:
            if tag not in ("html", "head"):
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == "head" and tag != "head":
                        pop_to(i)
                        break
                    if stack[i].tag == "p":
                        pop_to(i)
                        break
                    if stack[i].tag in BLOCK:
                        break
            flush()
        closing = CLOSED_BY.get(tag)
        if closing:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in closing[1]:
                    break
                if stack[i].tag in closing[0]:
                    pop_to(i)
                    if tag not in ("tr", "tbody", "thead", "tfoot"):
                        break
        if tag in ("body", "html") and any(e.tag == tag for e in stack):
            continue
        e = Element(tag, stack[-1])
        names, role, hidden = _marks(m[3]) if m[3] else ([], "", False)
        doubt = SURE if hidden else _unwanted(tag, names, role, e.inside_article)
        e.hard |= doubt == SURE
        if doubt in (DOUBTFUL, MAIN):
            e.suspects, e.named = (*e.suspects, e), doubt == MAIN
        article = tag in ("article", "main") or role in ("main", "article")
        if article or any(t in ("article", "content", "main", "post", "story", "entry") for n in names for t in _TOKEN.findall(n)):
            e.bonus = BONUS
        e.inside_article |= article
        if tag in CONTAINER:
            e.path += f"/{tag}" + "".join("." + _DIGITS.sub("0", n) for n in names)
        stack.append(e)
        if tag in CONTAINER and not e.hard:
            elements.append(e)
        if m[3] and m[3].endswith("/") and tag not in BLOCK:
            stack.pop()
    flush()
    return elements, blocks


def votes(page: str) -> dict[str, int]:
    """For each generalised path the page's score of it, in thousandths of all its wanted text."""
    elements, blocks = parse(page)
    out: dict[str, float] = defaultdict(float)
    for e in elements:
        if e.good:
            out[e.path] += max(0, e.good - 2 * e.waste) * e.bonus
    total = sum(len(t) for t, _ in blocks)
    return {p: round(1000 * s / total) for p, s in out.items() if s > 0} if total else {}


def best(found: dict[str, int]) -> str | None:
    return max(found, key=lambda p: (found[p], p.count("/"), p), default=None)


def extract(page: str, path: str | None) -> str:
    """The text inside the elements of the path; without any, inside those of the page's own best path."""
    elements, blocks = parse(page)
    for p in (path, None):
        if p is None:
            p = best(votes(page))
        if p is None:
            return "\n\n".join(t for t, _ in blocks)
        text = "\n\n".join(t for t, around in blocks if any(e.path == p for e in around))
        if text:
            return text
    return ""


def host(url: Column) -> Column:
    """The url's host in lower case, without user, port and leading www; empty if there is none."""
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.regexp_replace(F.lower(raw), r"^www\.", "")


def winners(pages: DataFrame) -> DataFrame:
    """One row (host, path) per host: the path with the most votes."""
    rows = pages.select(host(F.col("url")).alias("host"), F.col("html").alias("html")).filter("host <> ''")

    def run(batches):
        for batch in batches:
            sums: dict[tuple[str, str], int] = defaultdict(int)
            for h, page in zip(batch.column(0).to_pylist(), batch.column(1)):
                for p, n in votes(page.as_py() or "").items():
                    sums[h, p] += n
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([h for h, _ in sums], pa.string()),
                    pa.array([p for _, p in sums], pa.string()),
                    pa.array(list(sums.values()), pa.int64()),
                ],
                names=["host", "path", "n"],
            )

    counted = map_arrow(rows, run, "host string, path string, n long").groupBy("host", "path").agg(F.sum("n").alias("n"))
    depth = F.length("path") - F.length(F.replace(F.col("path"), F.lit("/"), F.lit("")))
    return counted.groupBy("host").agg(F.max(F.struct(F.col("n"), depth, F.col("path"))).alias("top")).select("host", F.col("top.path").alias("path"))


NEW = ("text", "n_chars")


def main_text(pages: DataFrame) -> DataFrame:
    """pages with text and n_chars."""
    return shielded(pages, ("page_id", "url", "html"), NEW, _main_text)


def _main_text(pages: DataFrame) -> DataFrame:
    won = cut(winners(pages).toDF("__host", "__path"))
    size = won.agg(F.coalesce(F.sum(F.length("__host") + F.length("__path") + 32), F.lit(0)).alias("n")).first()["n"]
    kept = pages.columns
    rows = pages.withColumn("__host", host(F.col("url")))
    if size <= BROADCAST_BYTES:
        rows = rows.join(F.broadcast(won), "__host", "left")
    else:
        salt = F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")
        copies = won.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("__salt", salt).join(copies, ["__host", "__salt"], "left")
    rows = rows.select(*kept, "__path")
    at, path = kept.index("html"), len(kept)
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches):
        for batch in batches:
            for part in slices(batch, at):
                texts = [extract(h.as_py() or "", p.as_py()) for h, p in zip(part.column(at), part.column(path))]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:path], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=[f.name for f in schema.fields],
                )

    return map_arrow(rows, run, schema)
