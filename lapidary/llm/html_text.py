"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. Pass one decides long blocks by
link density, stop-word density and length, and by the element they stand in:
menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and
reader comments are no candidates; inside an article or main element a block
is text unless it is mostly links. Pass two gives ambiguous short blocks the
label of their nearest decided neighbours.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

# Frequent function words of English, German, French and Spanish.
STOP = set(
    """a an and are as at be been but by can for from had has have he her his if in is it its not of on or our she so that the their them
    there they this to was we were what when which who will with would you your
    aber als am auch auf aus bei bin bis das dass dem den der des die du durch ein eine einem einen einer es für hat ich ihr im ist kann
    man mit nach nicht noch nur oder sich sie sind so über um und uns unter von vor war wenn werden wie wir wird zu zum zur
    au aux avec ce ces cette dans de des du elle en est et eux il ils je la le les leur lui mais me même mes ne nous on ou où par pas plus
    pour qu que qui sa se ses son sont sur ta te tu un une vos votre vous
    al como con del desde donde el ella ellos en entre era es esta este están fue ha hay la las lo los más me mi muy no nos o para pero por
    que se ser si sin sobre su sus también te tiene un una uno y ya""".split()
)
# Elements that never hold main text, those that cut blocks, and those without an end tag.
DROPPED = set("head nav footer aside form script style noscript template svg iframe object select button textarea dialog menu canvas math".split())
BLOCKS = set(
    """address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header
    hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul""".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
# Words in class, id and role that mark what is not the article, and what is.
OTHER = set(
    """ad ads adbox adslot adsense advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice
    notification alert popup modal overlay newsletter subscribe subscription signup login sidebar widget menu nav navbar navigation breadcrumb
    breadcrumbs footer masthead topbar toolbar pagination pager share sharing social related recommended recommendations comment comments
    commentlist disqus respond reply replies discussion skip legal copyright search complementary contentinfo dialog""".split()
)
COMMENTS = {"comment", "comments", "commentlist", "disqus", "respond", "reply", "replies", "discussion"}
HEADS = {"header", "banner"}
MAIN = {"article", "content", "post", "entry", "story", "main"}

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*+)(?P<rest2>[^>]*+)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
RAW_END = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in ("script", "style", "textarea", "title", "template", "noscript", "iframe", "svg")}
WORDS = re.compile(r"[^\W\d_]+")


@dataclass
class Block:
    text: str
    linked: int
    heading: bool
    inside: bool  # an article, main or content element


def _hints(rest: str) -> tuple[set[str], bool]:
    words, hidden = set(), False
    for name, a, b, c in ATTRIBUTE.findall(rest):
        name, value = name.lower(), a or b or c
        if name in ("class", "id", "role"):
            words.update(re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower()))
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and HIDDEN.search(value)):
            hidden = True
    return words, hidden


def blocks(page: str, hints: bool = True) -> list[Block]:
    """The candidate blocks of a page in order; without hints, class and id names drop nothing."""
    out: list[Block] = []
    parts: list[tuple[str, bool]] = []
    heading = False
    links, inner = 0, []  # inner: open article, main and content elements
    skip, depth, comments = "", 0, False
    at, n = 0, len(page)

    def flush() -> None:
        if parts:
            text = " ".join("".join(p for p, _ in parts).split())
            if text:
                linked = sum(len("".join(p.split())) for p, link in parts if link)
                out.append(Block(text, linked, heading, bool(inner)))
            parts.clear()

    while at < n:
        m = TOKEN.search(page, at)
        stop = m.start() if m else n
        if stop > at and not skip:
            parts.append((html.unescape(page[at:stop]), links > 0))
        if not m:
            break
        at = m.end()
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag:
            if m[0].startswith("<![CDATA[") and not skip:
                parts.append((m[0][9:].removesuffix("]]>"), links > 0))
            continue
        end = bool(m["end"] or m["end2"])
        rest = m["rest"] or m["rest2"] or ""
        if not end and tag in RAW_END and not rest.rstrip().endswith("/"):
            close = RAW_END[tag].search(page, at)
            at = close.end() if close else (n if tag in ("script", "style") else at)
            if close or tag in ("script", "style"):
                continue
        if skip:
            words = _hints(rest)[0] if not end and tag in ("article", "main") else set()
            if not end and tag in ("article", "main") and not comments and not words & COMMENTS:
                skip = ""  # an article begins: what was skipped was never closed
            elif not end and tag == skip and skip in ("p", "li"):
                skip = ""
            elif skip == "p" and tag in BLOCKS and (end or tag != "p"):
                skip = ""
                if end and tag == "p":
                    continue
            elif not end and skip == "head" and tag == "body":
                skip = ""
            else:
                if tag == skip and tag not in VOID and not rest.rstrip().endswith("/"):
                    depth += -1 if end else 1
                    if not depth:
                        skip = ""
                continue
        if end:
            if tag == "a":
                links = max(0, links - 1)
            if tag in BLOCKS:
                flush()
                heading = False
                if tag in inner:  # also what was left open inside it
                    while inner and inner.pop() != tag:
                        pass
                elif inner and tag == "div" and "div+" in inner:
                    k = len(inner) - 1 - inner[::-1].index("div+")
                    del inner[k:]
            continue
        if tag == "br":
            parts.append((" ", False))
            continue
        words, hidden = _hints(rest) if rest else (set(), False)
        main = words & MAIN
        other = words & OTHER if hints else set()
        if main and other <= HEADS or tag in ("body", "html", "main") or (tag == "article" and not words & COMMENTS):
            other = set()
        drop = hidden or tag in DROPPED or bool(other) or (tag == "header" or hints and "header" in words and not main) and not inner
        if drop and tag not in VOID and tag not in ("body", "html"):
            if tag in BLOCKS or tag in DROPPED:
                flush()
            skip, depth, comments = tag, 1, bool(words & COMMENTS)
            continue
        if tag == "a":
            links = 1
        if tag in BLOCKS:
            flush()
            heading = tag in ("h1", "h2", "h3", "h4", "h5", "h6")
            if tag in ("article", "main"):
                inner.append(tag)
            elif tag in ("div", "section", "td") and (main or any(x.rstrip("+") == tag for x in inner)):
                inner.append(tag if tag != "div" else "div+")
    flush()
    return out


def _first(b: Block, framed: bool, short: int, long: int) -> bool | None:
    """True: text; False: not; None: ambiguous."""
    size = len(b.text)
    density = b.linked / max(1, size)
    if framed and not b.inside:
        return False
    if density > 0.5 or "©" in b.text and size < long and not b.inside:
        return False
    if b.inside:
        return True if size >= short and density <= 0.33 else None
    words = WORDS.findall(b.text.lower())
    stops = sum(w in STOP for w in words) / max(1, len(words))
    if size < short:
        return False if density > 0.2 else None
    if density > 0.33:
        return False
    if stops >= 0.12:
        return True
    return None if size >= long and density <= 0.1 else False


def main_blocks(found: list[Block], short: int = 70, long: int = 200) -> list[str]:
    """The texts of the blocks that are main text."""
    framed = any(b.inside for b in found)
    label = [_first(b, framed, short, long) for b in found]
    decided = [i for i, x in enumerate(label) if x is not None]
    out, k = [], 0
    for i, b in enumerate(found):
        keep = label[i]
        if keep is None:
            while k < len(decided) and decided[k] < i:
                k += 1
            before = decided[k - 1] if k else None
            after = decided[k] if k < len(decided) else None
            if before is None and after is None:
                keep = True
            elif before is None or after is None:
                keep = label[after if before is None else before]
            elif label[before] == label[after] or b.heading:
                keep = label[after]
            else:
                keep = label[before if i - before < after - i else after]
            if b.inside and not keep:  # what stands outside the article does not speak for what is in it
                near = [label[j] for j in (before, after) if j is not None and found[j].inside]
                keep = not near or any(near)
        if keep:
            out.append(b.text)
    return out


def extract_text(page: str | None, short: int = 70, long: int = 200) -> str:
    if not page:
        return ""
    found = main_blocks(blocks(page), short, long)
    if not found:  # a name such as page-with-sidebar may have dropped the whole body: then only clear text counts
        clear = [b.text for b in blocks(page, hints=False) if _first(b, False, short, long)]
        found = clear if sum(map(len, clear)) >= 2 * long else []
    return "\n".join(found)


def extract(df: DataFrame, page: str = "html", out: str = "text", short: int = 70, long: int = 200) -> DataFrame:
    """df without `page`, with the string column `out`: the main text, blocks joined by newlines.

    Null and empty pages give an empty text; pages are read whole. A column of
    df named like `out` in any case is left out in favour of it.
    """
    common.ship(df.sparkSession)
    rest = [c for c in df.columns if c != page and c.lower() != out.lower()]
    schema = T.StructType([*(df.schema[c] for c in rest), T.StructField(out, T.StringType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract_text(p, short, long) for p in batch.column(len(rest)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], pa.array(texts, pa.string())], [*rest, out])

    return df.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{page}`")).mapInArrow(run, schema)
