"""Main text of web pages by block rules in two passes.

A scanner cuts a page into blocks at block-level tags. First each block is judged by itself: what
stands in a navigation, header, footer, sidebar, notice, advert, form or comment section, or mostly
in links, is boilerplate; long blocks with many stop words are text; long ones with hardly any are
boilerplate. Short blocks and those in between stay open and, in a second pass, take the label of the
nearest decided blocks around them. A section is named by the last word of a whole class or id ("post-comments",
but not "search-engine-article"); a form that holds most of the text of a page, or a named section that does while
nothing long stands outside of it, is a container of the page. A section without its end tag ends where an article
or a further section begins. Where no block has enough stop words, all long blocks that aren't
mostly links are text, and blocks of links label no others. An <article> or <main> that holds the text (not a teaser with
less than half as much as there is outside) bounds it: blocks outside of it are never text, and inside of it
stop words only count in favour of a block.
"""
import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Elements of HTML, and words by which pages name what isn't their text.
SKIPPED = "script style noscript template textarea select datalist option button svg math iframe object canvas title".split()
RAW = set("script style textarea iframe title option".split())
BLOCKS = set("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
SECTIONS = set("article main section h1".split())
MAINS = set("article main h1".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
ASIDE = set("nav footer aside form menu dialog".split())
NAMED = set("""ad ads advert advertisement advertising adverts banner sponsor sponsored promo sidebar menu nav navbar navigation
breadcrumb breadcrumbs footer masthead cookie cookies consent gdpr notice popup modal newsletter subscribe share sharing social related
recommended comment comments replies disqus discussion form login signup search pagination widget copyright""".split())
SPOKEN = set("comment comments replies disqus discussion cookie cookies consent gdpr".split())  # these never name a container
PLAIN = set("bar box buttons button list links link section container wrapper wrap area block inner panel left right top bottom slot unit item items bottom toggle".split())
STATES = set("has no with without is".split())
POSTS = set("post entry hentry story article blog-post post-content entry-content article-content post-body article-body".split())
OPTIONAL = set("p li dt dd tr td th tbody thead tfoot caption".split())  # elements whose end tag may be left out
ROLES = set("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
STOP = set("""the of and to a in is that it for was with be as on are by at this from or an not have but they you which were
de la le les et des en du un une est que dans pour qui sur pas au par il se ce avec plus sont ou son
der die das und ist ein eine nicht mit den von zu sich auf für dem des im auch es an als bei nach wie oder sind
el los las y que en un por con una para su al lo como más pero sus no es del se""".split())

TOKEN = re.compile(r"""<!--(?P<comment>.*?)(?:-->|\Z)|<(?P<skip>%s)(?=[\s/>])(?:[^>"']|"[^"]*"|'[^']*')*+>|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attributes>(?:[^>"']|"[^"]*"|'[^']*')*+)>|<[!?/][^>]*>""" % "|".join(SKIPPED), re.I | re.S)
ENDS = {name: re.compile(rf"</{name}\s*(?=[\s>/])[^>]*>", re.I) for name in SKIPPED}
# The end tag of an option may be left out: the next option, the end of its list or a block ends it too.
ENDS["option"] = re.compile(r"</option\s*(?=[\s>/])[^>]*>|(?=<(?:/?(?:optgroup|%s)|option|/select|/datalist)[\s>/])" % "|".join(sorted(BLOCKS)), re.I)
TAG = re.compile(r"<[a-zA-Z/!]")
HINT = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
LETTERS = re.compile(r"[^\W\d_]+")


def _named(value: str) -> str:
    """The word by which one of the names of a class or id says that this isn't the text, or ''."""
    for name in value.lower().replace("side-bar", "sidebar").split():
        words = [w for w in re.split(r"[_-]+", name) if w]
        if STATES.intersection(words[:-1]):
            continue
        while len(words) > 1 and (words[-1] in PLAIN or words[-1].isdigit()):
            words.pop()
        if words and words[-1] in NAMED:
            return words[-1]
    return ""


def _aside(name: str, attributes: str) -> str:
    """Why an element isn't text: "tag", "form", "name" (of a class, id or role), "spoken" (a name that can't be that of a container) or ''."""
    why = "form" if name == "form" else "tag" if name in ASIDE else ""
    for key, a, b, c in HINT.findall(attributes) if attributes else ():
        value, key = a or b or c, key.lower()
        if key in ("class", "id") and name not in ("body", "html", "article", "main"):
            word = _named(value)
            if word:
                why = "spoken" if word in SPOKEN else why or "name"
        if key == "role" and value.lower() in ROLES:
            why = why or "name"
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return "spoken"
    return why


def _post(attributes: str) -> bool:
    return any(key.lower() in ("class", "id") and POSTS.intersection((a or b or c).lower().split()) for key, a, b, c in HINT.findall(attributes))


def blocks(page: str) -> list[tuple[str, int, bool, int]]:
    """(text, characters in links, stands aside, number of the article it is in or 0) in page order."""
    out, parts, linked = [], [], 0
    open_, links, posts, articles, article = [], 0, 0, 0, 0
    asides, aside = [[-1, "", 0.0, 0, False]], 0  # of each: the one around it, why, first block past it, characters, holds an article
    at, size = 0, len(page)
    endless = set()

    def shut(element, ended):
        """Takes the element off; an aside that ends without its end tag ends at the section seen in it, if any."""
        nonlocal aside, links, posts, article
        name, own, main, post, bound = element
        links -= name == "a"
        posts -= post
        if main:
            article = 0
        if own:
            aside = asides[own][0]
            if not ended and name not in OPTIONAL and asides[own][1] != "spoken" and bound[0] is not None:
                asides[own][2] = bound[0]

    def add(text):
        nonlocal linked
        if "&" in text:
            text = html.unescape(text)
        parts.append(text)
        if links:
            linked += len("".join(text.split()))

    def close_block():
        nonlocal parts, linked
        text = " ".join("".join(parts).split())
        if text:
            out.append((text, linked, aside, article))
        parts, linked = [], 0

    while at < size:
        found = TOKEN.search(page, at)
        if found is None:
            add(page[at:])
            break
        if found.start() > at:
            add(page[at:found.start()])
        at = found.end()
        if found["skip"]:
            if not found[0].endswith("/>"):
                skip = found["skip"].lower()
                end = None if skip in endless else ENDS[skip].search(page, at)
                if end:
                    at = end.end()
                else:  # without an end it is its tag alone, or its tag and what can only be its own text
                    endless.add(skip)
                    tag = TAG.search(page, at) if skip in RAW else None
                    at = tag.start() if tag else size if skip in RAW else at
            if found["skip"].lower() == "title":
                close_block()
            continue
        name = (found["name"] or "").lower()
        if not name:
            continue
        if name == "br":
            parts.append(" ")
        if name in BLOCKS:
            close_block()
        if name in VOID or name == "head" or found["attributes"].endswith("/"):  # </head> may be left out
            continue
        if not found["close"]:
            if name == "p" and open_ and any(x[0] == "p" for x in open_[-3:]):  # a new paragraph ends the last
                while open_[-1][0] != "p" and open_[-1][0] not in BLOCKS:
                    shut(open_.pop(), True)
                if open_[-1][0] == "p":
                    shut(open_.pop(), True)
            if aside and (name in SECTIONS or name == "p"):
                for x in open_[-64:]:
                    if x[1] and x[4][0] is None and (name != "p" or x[0] in ("nav", "menu")):
                        x[4][0] = len(out)
            if name in MAINS:
                held = aside
                while held and not asides[held][4]:
                    asides[held][4] = True
                    held = asides[held][0]
            why = _aside(name, found["attributes"])
            # The header of an article or post holds its title; any other one is the page's.
            if not why and name == "header" and not article and not posts:
                why = "tag"
            own = 0
            if why:
                asides.append([aside, why, float("inf"), 0, False])
                own = aside = len(asides) - 1
            main = name in ("article", "main") and not article and not why
            if main:
                articles += 1
                article = articles
            post = not why and name in BLOCKS and _post(found["attributes"])
            open_.append((name, own, main, post, [None]))
            links += name == "a"
            posts += post
        else:
            depth = next((i for i in range(len(open_) - 1, -1, -1) if open_[i][0] == name), None)
            if depth is None or name not in BLOCKS and any(x[0] in BLOCKS for x in open_[depth + 1:]):
                continue
            while len(open_) > depth:
                shut(open_.pop(), len(open_) == depth)
    close_block()
    while open_:
        shut(open_.pop(), False)
    return [(text, linked, stands, part) for (text, linked, _, part), stands in zip(out, _stands(out, asides))]


def _stands(found, asides, long=70) -> list[bool]:
    """Whether each block stands aside, once the containers of the whole page are told from sections of it."""
    solid = [max(0, len(text.replace(" ", "")) - linked) for text, linked, _, _ in found]
    for (_, _, aside, _), n in zip(found, solid):
        asides[aside][3] += n
    for x in reversed(asides[1:]):
        asides[x[0]][3] += x[3]
    half = sum(solid) / 2

    def judge():
        reach = [0]
        for around, _, end, _, _ in asides[1:]:
            reach.append(max(end, reach[around]))
        return [i < reach[aside] for i, (_, _, aside, _) in enumerate(found)]

    for x in asides[1:]:
        if x[1] == "form" and x[3] > half:
            x[2] = 0
    stands = judge()
    outside = [len(text) for (text, linked, _, _), off, n in zip(found, stands, solid) if not off and n > linked]
    if not outside or max(outside) < long:
        for x in asides[1:]:
            if x[1] == "name" and x[3] > half and (x[4] or not outside):
                x[2] = 0
        stands = judge()
    return stands


def main_text(page: str, long=70, many=0.25, few=0.1, linked=0.5) -> str:
    """The text blocks of a page, two line ends between them."""
    found = blocks(page)
    held = [0, 0]  # characters of long blocks outside of articles and in them
    for text, links, aside, article in found:
        if not aside and len(text) >= long and links <= linked * len(text.replace(" ", "")):
            held[article > 0] += len(text)
    bounded = any(article and not aside for _, _, aside, article in found) and held[0] <= 2 * held[1]
    if not bounded:
        found = [(text, links, aside, 0) for text, links, aside, _ in found]
    labels, barren, listing = [], set(), set()
    for i, (text, links, aside, article) in enumerate(found):
        solid = len(text.replace(" ", ""))
        if aside or bounded and not article or links > linked * solid:
            labels.append(False)
            if not aside and (article or not bounded):
                listing.add(i)
            continue
        words = LETTERS.findall(text.lower())
        density = sum(w in STOP for w in words) / len(words) if words else 0.0
        if len(text) >= long and density >= many:
            labels.append(True)
        elif len(text) >= 3 * long and density < few and not article:
            labels.append(False)
            barren.add(i)
        else:
            labels.append(None)
    if True not in labels:  # no stop words anywhere: they can't tell text from the rest, but length can
        labels = [True if i in barren or x is None and len(found[i][0]) >= long else x for i, x in enumerate(labels)]
        mute = listing if bounded or True in labels else set()  # a byline or a list of tags says nothing about the text next to it
    else:
        mute = set()
    out, before = [], [None] * len(labels)
    last = None
    for i, label in enumerate(labels):  # nearest decided block of the same part of the page, before and after
        if i and found[i][3] != found[i - 1][3]:
            last = None
        if label is not None and not found[i][2] and i not in mute:
            last = (i, label)
        before[i] = last
    last = None
    for i in range(len(labels) - 1, -1, -1):
        if i + 1 < len(labels) and found[i][3] != found[i + 1][3]:
            last = None
        label = labels[i]
        if label is None:
            near = [x for x in (before[i], last) if x]
            if near:
                gaps = [abs(x[0] - i) for x in near]
                label = any(x[1] for x, gap in zip(near, gaps) if gap == min(gaps))
            else:
                label = True  # nothing decided around it: it is all the text there is
        elif not found[i][2] and i not in mute:
            last = (i, label)
        if label:
            out.append(found[i][0])
    return "\n\n".join(reversed(out))


def extract(pages: DataFrame, page_id="page_id", url="url", page="html") -> DataFrame:
    """page_id, url, text, n_chars of every row. A null or empty page has an empty text; a page without
    any markup is one block and its own text. Row by row, without a shuffle."""
    source = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(page), F.lit("")).alias("html"))
    kind = source.schema["page_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                texts = [main_text(x.as_py()) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return source.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars bigint")
