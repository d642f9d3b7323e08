"""Main text of web pages by two-pass block rules.

Pass one classifies each block by stop-word density, length and link density: good, bad, short or near-good.
Pass two gives short and near-good blocks the label of the nearest decided neighbours.

Markup helps where it agrees with these rules. Blocks of an element whose name or whole class, id or role (never a word of a longer
name) says that it holds no main text are bad; classes and forms count for nothing where neither an article nor a good block is left
without them. ``article`` and ``main`` mark the main text if they hold at least half of the page's good text; then blocks outside of them
are bad, and within only blocks of links are.

Function words are a fixed list for some twenty languages. Where a page has few of these, its own most frequent short words
(single characters in scripts without spaces) stand for them; where it has not even such, sentence marks do, so no language is left out.

Cases: null and empty html and pages without main text give the empty text and 0; a tag that the page's end cuts off is dropped and a
cut-off reference kept as text, as browsers do; a quote that never ends is no quote; pages of any length and form take linear time, for a
character is read once and closing tags look only for elements that are open; equal pages give equal texts; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainloom.llm.common import arrow_map, batch, read

# Frequent function words of English, German, French, Spanish, Italian, Portuguese, Dutch, Swedish, Danish, Polish, Czech, Turkish,
# Indonesian, Russian, Ukrainian, Greek, Arabic, Hebrew and Hindi, and function characters of Japanese and Chinese.
STOP = frozenset(
    """a about after all also an and are as at be been but by can could did do for from had has have he her his how i if in into is it its
    more my no not of on one or other our out she so some such than that the their them then there these they this to up was we were what
    when which who will with would you your
    aber als am an auch auf aus bei bin bis da das dass dem den der des die dir du durch ein eine einem einen einer er es für haben hat ich
    ihr im in ist ja kann man mit nach nicht noch nur oder sein sich sie sind so über um und uns von vor war was wenn wer wie wir wird zu zum zur
    au aux avec ce ces cette dans de des du elle en est et eux il ils je la le les leur lui mais mes nous on ou où par pas pour qu que qui sa se ses
    son sur un une vous
    al como con de del el ella en entre era es esta este ha hay la las lo los mas me mi muy no nos o para pero por que se ser si sin sobre son su
    sus también tiene un una y ya
    che chi con da dal della di e gli ho il ma nel non per più sono
    ao com da das do dos e em foi mais mas na nas no nos os ou pela pelo são sem seu sua um uma
    aan dat de een er het ik je maar met naar niet om ook op te van voor wat we wij zijn zo
    att av den det eller en ett från för har i inte jag kan med men och om på som till var vi är af at der et fra ikke jeg og til være
    być by co dla do i jak jest lub ma na nie od oraz po przez się są tak to w z za że ale až by být co do i jako je jsou k který ke na o od po pro s se to tak v že
    bir bu çok da daha de değil gibi için ile ne o olan olarak ve veya ya adalah akan dan dari dengan di dalam ini itu juga ke pada oleh tidak untuk yang
    а без бы был была были было быть в во вот все всех вы где да для до его ее если есть еще же за и из или им их к как когда который которые ли мы на не него нет но о об он она они от по под при с со так также то
    только у уже чем что чтобы это этого этот я але був була бути від він вона вони де для до є з за й і із її їх на не по під при та те то у це цей що як
    από αυτό για δεν είναι ένα και με να ο οι σε στην στο στη τα την της τι το του των ως
    أن إلى إن التي الذي على عن في كان لا ما مع من هذا هذه هو هي و את אל אם אני הוא היא הם זה כי לא מה על עם של
    और एक का कि की के को तो था थी थे ने नहीं पर भी में यह लिए वह से है हैं हो
    の に は を が で と も た て れ し な 的 了 是 在 不 有 和 也 这 這 就 我 他""".split()
)

# Elements by their role.
HIDDEN = frozenset("script style head title noscript template iframe object svg math select textarea button canvas audio video map datalist".split())
RAW = frozenset("script style textarea title noscript iframe template".split())
SIDE = frozenset("nav footer aside form menu dialog header".split())
MAIN = frozenset("article main".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Names in class, id and role of what is not main text. They count as whole names only.
ROLES = frozenset(
    """ad ads adv advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment comments comment-list commentlist comment-section complementary consent
    contentinfo cookie cookies cookie-banner cookie-consent cookie-notice disclaimer disqus disqus_thread footer gdpr header legal login masthead menu modal nav navbar navigation newsletter notice notices
    notification notifications pagination pager popup post-comments promo promoted promotion related related-articles related-posts replies reply respond search search-form share sharing sidebar side-bar
    signup site-footer site-header skip skip-link skip-to-content social social-share sponsor sponsored subscribe subscription teaser teasers toolbar topbar user-comments widget widgets""".split()
)
# Which start tags end which open elements, and what holds them together.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
HOLDS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}

#: A start or end tag up to its end; quotes count in values only. Nothing in it is read twice.
TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|))*+)""")
BARE_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)([^>]*+)")
ATTRIBUTE = re.compile(r"""(?:^|[\s"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))|(?=[\s/]|\Z))""", re.I)
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: Scripts without spaces between words, and marks that end sentences.
UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]")
SENTENCE = re.compile("[.!?\u2026\u3002\uff01\uff1f\u061f\u06d4\u0964\u104b\u17d4]")
EDGES = ".,;:!?()\"'«»„“”‘’¿¡…[]"

MIN_LENGTH, LONG, LOW, HIGH, MAX_LINKS, HEADING_REACH = 70, 200, 0.08, 0.14, 0.33, 200
#: What a character of a script without spaces weighs in lengths; a page's own function words have so many letters at most.
WEIGHT, OWN_LENGTH = 2.5, 4

SCHEMA = "page_id long, url string, text string, n_chars long"
ARROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


class Block:
    """A block's text, its words, its characters in links, what names it as no main text (0: nothing, 1: a class, 2: a form, 3: an
    element), whether it is in an article, whether it is a heading, and its label."""

    __slots__ = ("heading", "label", "linked", "main", "side", "text", "words")

    def __init__(self, text: str, linked: int, side: int, main: bool, heading: bool) -> None:
        self.text, self.linked, self.side, self.main, self.heading, self.label = text, linked, side, main, heading, ""
        self.words = tokens(text)


def named_side(name: str, attributes: str, inside_main: bool) -> tuple[bool, int]:
    """Whether an element is not shown, and the strength (see ``Block``) with which it is named as no main text."""
    side = 0
    if name in SIDE and not (name == "header" and inside_main):
        side = 2 if name == "form" else 3
    if len(attributes) > 3:
        for m in ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and UNSEEN.search(value)):
                return True, side
            if key in ("class", "id", "role") and not side and name not in ("body", "html", "article", "main") and not ROLES.isdisjoint(value.lower().split()):
                side = 1
    return False, side


def blocks(page: str) -> list[Block]:
    """Blocks of text in page order. Unclosed elements end with the element around them. Elements that neither break text nor
    name a role are not kept open."""
    out: list[Block] = []
    stack: list[tuple[str, bool, int, bool]] = []  # name, hidden, side, main
    top: tuple[str, bool, int, bool] = ("", False, 0, False)
    depth: Counter = Counter()
    parts: list[str] = []
    linked = 0
    link = heading = False

    def flush() -> None:
        nonlocal linked, parts
        if parts:
            if text := " ".join("".join(parts).split()):
                out.append(Block(text, linked, top[2], top[3], heading))
            parts = []
        linked = 0

    def close(k: int) -> None:
        nonlocal top
        for entry in stack[k:]:
            depth[entry[0]] -= 1
        del stack[k:]
        top = stack[-1] if stack else ("", False, 0, False)

    def say(text: str) -> None:
        nonlocal linked
        if text and not top[1]:
            text = entities.unescape(text)
            parts.append(text)
            if link:
                linked += len("".join(text.split()))

    end, at, raw = len(page), 0, None
    last = page.rfind(">")  # tags that begin behind it are cut off
    tag = TAG
    while at < end:
        if raw:
            m = re.compile(rf"</{re.escape(raw)}(?=[\s/>]|\Z)[^>]*+>?", re.I).search(page, at)
            at, raw = m.end() if m else end, None
            continue
        lt = page.find("<", at)
        if lt < 0:
            say(page[at:])
            break
        say(page[at:lt])
        mark = page[lt + 1 : lt + 2]
        if mark in ("!", "?"):
            closer = "-->" if page.startswith("<!--", lt) else "]]>" if page.startswith("<![CDATA[", lt) else ">"
            stop = page.find(closer, lt + (4 if closer == "-->" else 2))
            at = stop + len(closer) if stop >= 0 else end
            continue
        if not (mark.isascii() and mark.isalpha() or mark == "/" and page[lt + 2 : lt + 3].isascii() and page[lt + 2 : lt + 3].isalpha()):
            say("<")
            at = lt + 1
            continue
        if lt > last:
            break
        m = tag.match(page, lt)
        if m.end() >= end:  # a quote without an end
            tag = BARE_TAG
            m = tag.match(page, lt)
        at = m.end() + 1
        name, closing = m[2].lower(), bool(m[1])
        is_block = name in BLOCKS
        if is_block:
            flush()
        elif name == "br":
            parts.append(" ")
        elif name == "a":
            link = not closing
        if name in HEADINGS:
            heading = not closing
        if closing:
            if depth[name] > 0 and name not in VOID:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == name:
                        close(k)
                        break
                    if stack[k][0] in BLOCKS and not is_block:
                        break
            if is_block:
                link = False
            continue
        if name in VOID or m[3].endswith("/") and not is_block and name not in RAW:
            continue
        if name in RAW:
            raw = name
            continue
        if is_block:
            ends, holds = CLOSES.get(name, ()), HOLDS.get(name, ())
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p" or stack[k][0] in ends:
                    close(k)
                    break
                if stack[k][0] in holds or stack[k][0] in BLOCKS and stack[k][0] not in ends:
                    break
        hidden, side = named_side(name, m[3], top[3])
        hidden = hidden or name in HIDDEN
        if is_block or hidden or side:
            stack.append((name, top[1] or hidden, max(top[2], side), top[3] or name in MAIN))
            top = stack[-1]
            depth[name] += 1
    flush()
    return out


def tokens(text: str) -> list[str]:
    """Words of a text; in scripts without spaces its characters."""
    text = text.lower()
    if not text.isascii() and UNSPACED.search(text):
        text = UNSPACED.sub(r" \g<0> ", text)
    return [x.strip(EDGES) for x in text.split()]


def weight(text: str) -> float:
    """Characters, of which those without spaces between words say more."""
    n = len(text)
    return n if text.isascii() else n + (WEIGHT - 1) * len(UNSPACED.findall(text))


def function_words(found: list[Block]) -> frozenset[str] | None:
    """The fixed list where the page has its words; else the page's own short words that come most often; None where there are none."""
    counts: Counter = Counter()
    for b in found:
        if b.linked <= MAX_LINKS * len(b.text):
            counts.update(b.words)
    total = counts.total()
    if sum(map(counts.__getitem__, STOP & counts.keys())) >= LOW * total:
        return STOP
    often = sorted(((-n, w) for w, n in counts.items() if n >= max(3, 0.005 * total) and len(w) <= OWN_LENGTH and w.isalpha()))
    own = frozenset(w for _, w in often[:40])
    return own if sum(counts[w] for w in own) >= HIGH * total else None


def rated(b: Block, stop: frozenset[str] | None) -> str:
    """Pass one."""
    n = weight(b.text)
    if b.linked > MAX_LINKS * max(1, len(b.text) - b.text.count(" ")):
        return "bad"
    if n < MIN_LENGTH:
        return "bad" if b.linked else "short"
    if stop is None:
        marks = len(SENTENCE.findall(b.text))
        return ("good" if n > LONG else "near") if marks else "bad"
    density = sum(map(stop.__contains__, b.words)) / max(1, len(b.words))
    if density >= HIGH:
        return "good" if n > LONG else "near"
    return "near" if density >= LOW else "bad"


def classify(found: list[Block]) -> None:
    """Sets each block's label to good or bad."""
    stop = function_words(found)
    first = [rated(b, stop) for b in found]
    sound = [x in ("good", "near") for x in first]
    # names of classes and forms count if an article or good blocks are left without them, those of other elements always
    article = any(b.main and not b.side for b in found)
    least = 1 if article else next((k for k in (1, 2) if any(s and b.side < k for b, s in zip(found, sound, strict=True))), 3)
    for i, b in enumerate(found):
        if b.side >= least:
            first[i], sound[i] = "bad", False
    held = [len(b.text) if b.main else -len(b.text) for b, s in zip(found, sound, strict=True) if s]
    inside = [b.main and b.side < least for b in found]
    marked = any(inside) and sum(held) >= 0
    if marked:
        for i, b in enumerate(found):
            if not b.main:
                first[i] = "bad"
            elif inside[i] and first[i] == "bad" and b.linked <= MAX_LINKS * len(b.text):
                first[i] = "short"
    if marked and not any(x in ("good", "near") for x in first):
        for b, x in zip(found, first, strict=True):
            b.label = "good" if x == "short" else "bad"
        return

    def nearest(labels: list[str], order: Iterator[int]) -> list[str]:
        """For each block the decided label met last on the way; edge where there is none."""
        out, last = [""] * len(found), "edge"
        for i in order:
            out[i] = last
            if labels[i] in ("good", "bad"):
                last = labels[i]
        return out

    n = len(found)
    before, after = nearest(first, iter(range(n))), nearest(first, iter(range(n - 1, -1, -1)))
    almost = ["good" if x == "near" else x for x in first]
    near_before, near_after = nearest(almost, iter(range(n))), nearest(almost, iter(range(n - 1, -1, -1)))
    reaches, far = [False] * n, math.inf  # whether a good block follows within reach of a heading
    for i in range(n - 1, -1, -1):
        reaches[i] = far <= HEADING_REACH
        far = 0 if first[i] in ("good", "near") else far + len(found[i].text) if first[i] == "short" else math.inf
    for i, b in enumerate(found):
        if first[i] in ("good", "bad"):
            b.label = first[i]
            continue
        sides = [before[i], after[i]]
        if marked:  # within an article only its own blocks decide
            sides = [x if x == "good" else "edge" for x in sides]
        if first[i] == "near":
            b.label = "good" if "good" in sides or marked or "bad" not in sides else "bad"
            if b.label == "bad" and len(b.text) > LONG and "good" in (near_before[i], near_after[i]):
                b.label = "good"
        elif b.heading:
            b.label = "good" if marked or reaches[i] else "bad"
        else:
            b.label = "good" if "bad" not in sides and (marked or "good" in sides) else "bad"


def main_text(page: str) -> str:
    found = blocks(page)
    classify(found)
    return "\n".join(b.text for b in found if b.label == "good")


def extract(pages: DataFrame) -> DataFrame:
    table = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url"), F.coalesce(F.col("html"), F.lit("")).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x or "") for x in b.column(2).to_pylist()]
            yield batch(ARROW, [b.column(0), b.column(1), texts, [len(t) for t in texts]])

    return arrow_map(table, run, SCHEMA)


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))
