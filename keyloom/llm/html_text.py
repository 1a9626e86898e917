"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. Each block has its text, the share of its characters
in links (link density), the share of its words that are function words of English, German, French
or Spanish (stop-word density; marks around a word do not count), and the region it stands in.

Names in classes and ids only leave out what the page can spare. A name after a modifier word (has-,
no-, category-, ...) says nothing. A named element stays if it holds more than half of the page's
text, or if it is or holds an article or main part, unless a larger one stands beside it (reader
comments and teasers are often marked as articles). An ambiguous name (related, discussion, ...)
counts only where the element is mostly links, or short with a link.

Pass 1 decides what can be decided from the block alone. Regions that are not text (menus, page
headers and footers, sidebars, notices, adverts, forms, scripts, reader comments, by tag, role, class
or id) are bad. Mostly linked blocks are bad, but in an article only as list items. Else a long
block dense in stop words is good, any other long one with few links near good, and a short block is
ambiguous. Where the long blocks of a page are poor in stop words altogether, its language is taken
as unknown and length and links decide alone. Wide (East Asian) characters count three times.
If the page marks an article or main part, blocks outside it are bad and what is inside needs no
stop words.

Pass 2 gives ambiguous blocks the label of their nearest decided neighbours in their region. A near
good block, or any in an article, is bad only between two bad ones, and outside an article only if
the near good blocks between these are little text; a short block outside needs a good neighbour and
no bad one. If nothing is good, the near good blocks are.

Pages are handled one by one inside a task; nothing is shuffled.

Defined results: a null or empty page gives an empty text; a page cut in the middle of a tag or of
an unclosed region ends there; rows that repeat get equal rows; null ids and urls stay; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RESULT = "page_id bigint, url string, text string, n_chars bigint"

# Element names and the words that name regions in classes and ids.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset"
    " figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol"
    " optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template".split())
OUT_TAGS = frozenset(
    "head script style noscript template title nav footer aside form button select textarea iframe"
    " svg canvas object audio video dialog menu map".split()
)
OUT_ROLES = frozenset(
    "navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar"
    " toolbar".split()
)
OUT_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox adslot sponsor sponsored"
    " sponsors promo cookie cookies gdpr popup modal newsletter subscribe signup login sidebar sidebars"
    " sidenav nav navbar navigation topnav breadcrumb breadcrumbs masthead footer comment comments"
    " commentlist disqus pagination pager toolbar".split()
)
UNSURE_NAMES = frozenset(
    "banner promotion consent notice notices notification overlay subscription widget widgets menu"
    " menus replies reply respond discussion share sharing social related recommended"
    " recommendations search skip".split()
)
MODIFIERS = frozenset("has have no not non with without category cat tag type format".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

LONG = 70  # characters: shorter blocks are ambiguous
SURE = 200  # characters: longer blocks rich in stop words are good
STOP_LOW, STOP_HIGH = 0.30, 0.32
MAX_LINKED = 0.5
FEW_LINKED = 0.2

# Function words, without marks; elided ones (l', don't) as the parts they fall into.
STOP_WORDS = {
    "en": "a about above after again against all also although am an and any are as at be because"
    " been before being below between both but by can cannot could did do does doing don down during"
    " each either else even ever every few for from further had has have having he her here hers"
    " herself him himself his how however i if in into is it its itself just ll may me might more"
    " most much must my myself neither no nor not now of off often on once one only or other our"
    " ours out over own re same shall she should since so some such t than that the their theirs"
    " them themselves then there these they this those though through thus to too under unless until"
    " up upon us ve very was we were what when where whether which while who whom whose why will"
    " with within without would yet you your yours yourself",
    "de": "ab aber alle allem allen aller alles als also am an andere anderen anderer auch auf aus"
    " bei beim bin bis da dabei dadurch dafür damit dann daran das dass dein dem den denn der des"
    " deshalb die dies diese diesem diesen dieser dieses doch dort du durch ein eine einem einen einer"
    " eines einige er es etwa etwas euch für gegen habe haben hat hatte hatten hier hin hinter ich"
    " ihm ihn ihnen ihr ihre ihrem ihren ihrer im in indem ins ist ja jede jedem jeden jeder jedes"
    " jedoch kann kein keine keinen können könnte man mehr mein meine mich mir mit muss müssen nach"
    " nicht nichts noch nun nur ob oder ohne schon sehr sein seine seinem seinen seiner seit sich sie"
    " sind so sollte soll sondern sonst über um und uns unser unter viel vom von vor war waren was weil"
    " wenn wer werden wie wieder will wir wird wurde wurden zu zum zur zwar zwischen während worden",
    "fr": "a ai ainsi alors après au aucun aucune aussi autre autres aux avait avant avec avoir c ça"
    " car ce ceci cela celle celui ces cet cette ceux chaque chez comme contre d dans de depuis des"
    " donc dont du elle elles en encore entre es est et étaient était été être eu eux fait fois font"
    " ici il ils j je jusqu l la le les leur leurs lors lui m ma mais me même mes moi moins mon n ne ni"
    " non nos notre nous on ont ou où par parce pas peu peut plus pour pourquoi puis qu quand que quel"
    " quelle quelles quels qui quoi s sa sans se selon sera ses si son sont sous sur t ta tandis te"
    " tes toi ton tous tout toute toutes très tu un une vers vos votre vous y",
    "es": "a al algo algún alguna algunos además ahora ante antes aquel aquella así aún aunque bajo"
    " bien cada como cómo con contra cual cuales cuando de del desde después donde dos durante e el él"
    " ella ellas ellos en entre era eran es esa esas ese eso esos esta está estaba estado están estar"
    " este esto estos fue fueron ha había han has hasta hay la las le les lo los más me mi mientras mis"
    " mucho muchos muy nada ni no nos nosotros o otra otras otro otros para pero poco por porque puede"
    " pueden pues que qué quien quienes se sea según ser si sí sido sin sino sobre son su sus también"
    " tan tanto te tenía tiene tienen toda todas todo todos tras tu un una unas uno unos usted y ya yo",
}

_TOKEN = re.compile(
    r"<!--(?:.*?-->|.*\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
_NAMED = re.compile(r"""\b(class|id|role|hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_PARTS = re.compile(r"[^a-z0-9]+")
_WORD = re.compile(r"[^\W\d_]+")
_WIDE = re.compile("[\u2e80-\u9fff\uac00-\ud7af\uf900-\ufaff\U00020000-\U0003ffff]")
_STOP = frozenset(w for words in STOP_WORDS.values() for w in words.split())


class _Block:
    __slots__ = ("texts", "linked", "size", "region", "out", "item", "label", "text", "named", "home")

    def __init__(self, region: int, out: bool, item: bool, named: int, home: int):
        self.texts: list[str] = []
        self.linked = 0
        self.size = 0
        self.region, self.out, self.item = region, out, item
        self.label, self.text = "", ""
        self.named, self.home = named, home  # named elements around it and around its article


class _Named:
    """An element whose name may leave it out; the first of a page stands for the page."""

    __slots__ = ("parent", "sure", "size", "linked", "articles", "beside", "out")

    def __init__(self, parent: int, sure: bool):
        self.parent, self.sure, self.out = parent, sure, False
        self.size = self.linked = 0  # of its text
        self.articles = 0  # size of the text of articles opened in it
        self.beside = 0  # size of the text in an article and in none or the named elements around only
# A slash that closes the element: after a blank or a quote, not at the end of an unquoted address.
_CLOSED = re.compile(r"""(?:^|[\s"'])/$""")


def _names(attributes: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for m in _NAMED.finditer(attributes):
        found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return found


def _leaves_out(tag: str, attributes: str, in_article: bool) -> str:
    """Whether an element opens a region that is no text: "yes", or by its name "named" or "unsure"."""
    if tag in OUT_TAGS or tag == "header" and not in_article:
        return "yes"
    if not attributes or tag in ("html", "body", "main"):
        return ""
    named = _names(attributes)
    if not named:
        return ""
    if named.get("role", "").lower() in OUT_ROLES or "hidden" in named:
        return "yes"
    if "display:none" in named.get("style", "").replace(" ", "").lower():
        return "yes"
    found = ""
    for name in f"{named.get('class', '')} {named.get('id', '')}".split():
        for word in _PARTS.split(_CAMEL.sub("-", name).lower()):
            if word in MODIFIERS:
                break
            if word in OUT_NAMES or word == "header" and not in_article and tag not in HEADINGS:
                return "named"
            if word in UNSURE_NAMES:
                found = "unsure"
    return found


def _leave_out_named(blocks: list[_Block], named: list[_Named]) -> None:
    """Decides which named elements are left out, and their blocks with them."""
    for b in blocks:
        if not b.out:
            named[b.named].size += b.size
            named[b.named].linked += b.linked
            if b.region:
                named[b.named].beside += b.size
                named[b.home].articles += b.size
    for e in reversed(named[1:]):
        up = named[e.parent]
        up.size, up.linked, up.articles = up.size + e.size, up.linked + e.linked, up.articles + e.articles
    for e in named[1:]:
        up = named[e.parent]
        linked = e.linked > MAX_LINKED * e.size or e.linked > 0 and e.size < LONG
        spared = e.articles <= up.beside and 2 * e.size <= named[0].size
        e.out = up.out or spared and (e.sure or linked)
        e.beside += up.beside
    for b in blocks:
        b.out = b.out or named[b.named].out


def blocks_of(html: str) -> list[_Block]:
    """The non-empty blocks of a page in order; region 0 is outside of any article."""
    out: list[_Block] = []
    # Open elements: (tag, opened a left-out region, opened an article, opened a named element).
    stack: list[tuple[str, bool, bool, bool]] = []
    n_out, articles, regions, links = 0, [], 0, 0
    named, inside, homes = [_Named(0, False)], [0], []
    now = _Block(0, False, False, 0, 0)

    def close() -> None:
        nonlocal now
        if now.texts:
            now.text = " ".join("".join(now.texts).split())
            if now.text:
                out.append(now)
        item = any(t[0] == "li" for t in stack[-6:])
        now = _Block(articles[-1] if articles else 0, n_out > 0, item, inside[-1], homes[-1] if homes else 0)

    def say(text: str) -> None:
        if not text:
            return
        text = unescape(text)
        now.texts.append(text)
        if links:
            now.linked += len("".join(text.split()))
        now.size += len("".join(text.split()))

    def pop(k: int) -> None:
        nonlocal n_out, links
        for tag, left, article, is_named in reversed(stack[k:]):
            n_out -= left
            links -= tag == "a"
            if article:
                articles.pop()
                homes.pop()
            if is_named:
                inside.pop()
        del stack[k:]

    at, n = 0, len(html)
    while at < n:
        m = _TOKEN.search(html, at)
        if m is None:
            say(html[at:])
            break
        say(html[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        ends = bool(m[1] or m[4])
        attributes = m[3] or m[6] or ""
        if tag in BLOCKS:
            close()
        if ends:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    pop(k)
                    break
            if tag in BLOCKS:
                close()
            continue
        if tag in VOID:
            if tag == "br":
                say("\n")
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(html, at)
            at = end.end() if end else n
            continue
        if _CLOSED.search(attributes):
            continue
        if tag == "p" or tag == "li":  # closed by the next of its kind
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    pop(k)
                    break
                if stack[k][0] in BLOCKS:
                    break
        leaves = _leaves_out(tag, attributes, bool(articles))
        left, is_named = leaves == "yes", leaves in ("named", "unsure")
        if is_named:
            named.append(_Named(inside[-1], leaves == "named"))
            inside.append(len(named) - 1)
        article = not left and not n_out and (
            tag in ("article", "main") or bool(attributes) and _names(attributes).get("role") == "main"
        )
        if article:
            regions += 1
            articles.append(articles[0] if articles else regions)
            homes.append(inside[-1])
        n_out += left
        links += tag == "a"
        stack.append((tag, left, article, is_named))
        if tag in BLOCKS:
            close()
    close()
    _leave_out_named(out, named)
    return out


def _length(text: str) -> int:
    return len(text) if text.isascii() else len(text) + 2 * len(_WIDE.findall(text))


def _stop_words(text: str) -> tuple[int, int]:
    """(stop words, words)."""
    words = _WORD.findall(text.lower())
    return sum(w in _STOP for w in words), len(words)


def _linked(block: _Block) -> float:
    return block.linked / max(block.size, 1)


def _knows_language(blocks: list[_Block]) -> bool:
    """Whether the long blocks with few links are dense in stop words altogether."""
    stop = total = 0
    for b in blocks:
        if not b.out and _linked(b) <= FEW_LINKED and _length(b.text) >= LONG:
            s, n = _stop_words(b.text)
            stop, total = stop + s, total + n
    return stop >= STOP_LOW * max(total, 1)


def _first_pass(block: _Block, has_article: bool, known: bool) -> str:
    if block.out or has_article and not block.region:
        return "bad"
    linked, length = _linked(block), _length(block.text)
    if linked > MAX_LINKED and (block.item or not block.region):
        return "bad"
    if block.region and length >= LONG:
        return "good"
    if not block.region and length < LONG:
        return "bad" if block.linked else "short"
    n, total = _stop_words(block.text)
    stop = n / max(total, 1)
    if block.region:
        return "good" if stop >= STOP_LOW else "short"
    few = linked <= FEW_LINKED
    if stop >= STOP_HIGH or few and not known:
        return "good" if length > SURE else "near"
    return "near" if stop >= STOP_LOW or few else "bad"


def _second_pass(blocks: list[_Block]) -> None:
    """Labels of one region: ambiguous blocks follow their nearest decided neighbours."""
    first = [b.label for b in blocks]
    before, after = [""] * len(blocks), [""] * len(blocks)
    seen, run = "", 0
    runs, near = [0] * len(blocks), [0]  # run of each block; text of the near good blocks of each
    for i, label in enumerate(first):
        before[i], runs[i] = seen, run
        if label in ("good", "bad"):
            seen, run = label, run + 1
            near.append(0)
        elif label == "near":
            near[run] += _length(blocks[i].text)
    seen = ""
    for i in range(len(first) - 1, -1, -1):
        after[i] = seen
        seen = first[i] if first[i] in ("good", "bad") else seen
    for i, b in enumerate(blocks):
        if b.label not in ("short", "near"):
            continue
        sides = {before[i], after[i]}
        if b.label == "near":
            b.label = "bad" if sides == {"bad"} and near[runs[i]] <= SURE else "good"
        elif b.region:
            b.label = "bad" if sides == {"bad"} else "good"
        else:
            b.label = "good" if "good" in sides and "bad" not in sides else "bad"


def main_text(html: str | None) -> str:
    found = blocks_of(html or "")
    has_article = any(b.region and not b.out for b in found)
    known = has_article or _knows_language(found)
    for b in found:
        b.label = _first_pass(b, has_article, known)
    near = [b for b in found if b.label == "near"]
    for region in sorted({b.region for b in found}):
        _second_pass([b for b in found if b.region == region and not b.out])
    if not any(b.label == "good" for b in found):
        for b in near:
            b.label = "good"
    return "\n".join(b.text for b in found if b.label == "good")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column(2)]
            yield pa.record_batch(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(texts, pa.string()),
                    pa.array([len(t) for t in texts], pa.int64()),
                ],
                names=["page_id", "url", "text", "n_chars"],
            )

    rows = pages.select(
        F.col("page_id").cast("bigint"), F.col("url").cast("string"), F.col("html").cast("string")
    )
    return rows.mapInArrow(run, RESULT)
